"""Gold to a relational database over JDBC. Credentials come from the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Parallel connections a database is asked to carry; a cluster has far more tasks.
MAX_CONNECTIONS = 16


def postgres_url(host: str, port: int, database: str) -> str:
    return f"jdbc:postgresql://{host}:{port}/{database}"


def jdbc_options(
    url: str, table: str, user: str, password: str, connections: int = MAX_CONNECTIONS,
    batch_rows: int = 10_000,
) -> dict[str, str]:
    return {
        "url": url,
        "dbtable": table,
        "user": user,
        "password": password,
        "driver": "org.postgresql.Driver",
        "numPartitions": str(connections),
        "batchsize": str(batch_rows),
        # Keep the table, its grants and indexes; replace only its rows.
        "truncate": "true",
    }


def write_jdbc(df: DataFrame, options: dict[str, str], mode: str = "overwrite") -> None:
    df.write.format("jdbc").options(**options).mode(mode).save()
