"""Reference tables. Their size is fixed by the domain, so they may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caudal import domain


def pais_ciudad(spark: SparkSession) -> DataFrame:
    rows = [(pais, ciudad) for pais, ciudades in domain.CIUDADES.items() for ciudad in ciudades]
    return spark.createDataFrame(rows, "pais string, ciudad string")


def categoria_comercio(spark: SparkSession) -> DataFrame:
    rows = [(cat, comercio) for cat, comercios in domain.COMERCIOS.items() for comercio in comercios]
    return spark.createDataFrame(rows, "categoria_comercio string, comercio string")
