"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.tables import kept


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links (bigint ``a, b``); equal roots: connected.

    In each round every node moves to the one of its neighbours, or itself, that a
    hash seeded with the round puts first; links between moved nodes remain. A
    constant share of the nodes goes in each round, whatever the shape, so the rounds
    grow with the logarithm of the largest component. Neighbours are reduced to one
    before the shuffle (a node with very many links is no hot key there), and the
    joins with the moves are left to adaptive execution. Each round is a written
    table: a lost executor repeats one round. No links: no rows.
    """
    live = kept(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        "links",
    )
    labels, turn = None, 0
    while turn == 0 or not live.isEmpty():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = kept(
            both.groupBy("a")
            .agg(F.min(order("b")).alias("first"))
            .select(F.col("a").alias("node"), F.least("first", order("a"))["id"].alias("root")),
            "moves",
        )
        live = kept(
            live.join(moves.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(moves.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "links",
        )
        if labels is None:
            labels = moves
        else:
            step = moves.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = labels.join(step, "root", "left").select(
                "node", F.coalesce("next", "root").alias("root")
            )
    return labels
