"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Every source is a queue. Its documents come in a shuffled order that depends on
their ids alone and are sent up to ``passes`` times, one pass after the other. A
document's virtual finish time is the words its source has sent by its end, divided
by the source's target. Sorted by that time the queues advance together, and the
budget is used up for all of them at virtual time one. Each source is clipped there on
its own, at its whole words of target, in place of a truncation of the global order.
A document on its way at that moment counts with the words sent by then.

One source may hold a third of all rows: running sums are taken inside 4,096 hash
blocks of a source and shifted by the sums of the blocks before, so no task sees a
whole source. Two reads of the texts, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caudal.llm.tables import WORD, whole_text

_BLOCK_DIGITS = 3  # hex digits of the hash: 16 ** 3 blocks a source


def targets(
    sources: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """Add each source's ``target``: ``share`` of all words dealt by weight, never above ``most`` sizes.

    ``sources``: one row per source with ``absent`` (source is null), ``origin`` and
    ``source_size``. Weights repeat over the sources by code point, null last. What a
    full source can't take is dealt again by weight: with sources by growing
    ``cap / weight``, the level is the largest of
    ``(budget - caps before) / weights from here on``. The two windows hold one row
    per source. No words at all: every target is zero.
    """
    by_name = Window.orderBy("absent", "origin")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights) + 1)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "absent", "origin")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sources.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("budget", share * F.sum("source_size").over(whole))
        .withColumn(
            "level",
            (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / F.sum("weight").over(after),
        )
        .withColumn("level", F.max("level").over(whole))
        .withColumn("target", F.least("cap", F.col("weight") * F.col("level")))
        .select("absent", "origin", "source_size", "target")
    )


def schedule(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    passes: int = 2,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, sent, virtual_finish`` and ``keep``.

    ``sent`` lists the words taken in each pass, ``virtual_finish`` the time at which
    each pass of the document ends (null for a source without words). Null texts have
    size 0; null ids hash as the empty text; rows that repeat an id each get a place
    of their own; other columns of ``docs`` are ignored unless named in ``keep``.
    """
    rows = docs.select(
        "doc_id",
        F.col("source").isNull().alias("absent"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("origin"),
        F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("draw"),
        F.struct(*keep).alias("kept_row") if keep else F.lit(None).cast("boolean").alias("kept_row"),
    ).withColumn("block", F.substring("draw", 1, _BLOCK_DIGITS))
    queue = ["absent", "origin"]
    blocks = rows.groupBy(*queue, "block").agg(F.sum("size").alias("block_size"))
    earlier = Window.partitionBy(*queue).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("sent_before", F.coalesce(F.sum("block_size").over(earlier), F.lit(0)))
    sizes = blocks.groupBy(*queue).agg(F.sum("block_size").alias("source_size"))
    blocks = blocks.join(targets(sizes, weights, share, float(passes)), queue)
    inside = Window.partitionBy(*queue, "block").orderBy("draw", "doc_id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    finish = [F.col("ends") + n * F.col("source_size") for n in range(passes)]
    words = F.floor("target").cast("long")
    return (
        rows.withColumn("ends", F.sum("size").over(inside))
        .join(blocks, [*queue, "block"])
        .withColumn("ends", F.col("ends") + F.col("sent_before"))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            F.array(
                *[F.greatest(F.lit(0), F.least(F.col("size"), words - f + F.col("size"))) for f in finish]
            ).alias("sent"),
            F.array(*[F.try_divide(f.cast("double"), F.col("target")) for f in finish]).alias("virtual_finish"),
            *([F.col(f"kept_row.{c}") for c in keep]),
        )
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix in order: whole copies, globally range-sorted by virtual finish.

    A copy is in if more than half of it was sent before the budget ended, so a
    source misses its target by half a document at most. Columns of ``docs`` only.
    """
    columns = docs.columns
    plan = schedule(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in columns])), keep=["_row"], **settings)
    copies = plan.select("_row", "size", F.explode(F.arrays_zip("sent", "virtual_finish")).alias("copy"))
    return (
        copies.filter(2 * F.col("copy.sent") > F.col("size"))
        .orderBy("copy.virtual_finish", F.col("_row.doc_id"))
        .select("_row.*")
    )
