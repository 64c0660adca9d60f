"""Mixing sources to target weights by capped water-filling.

A source's target is its weight's share of the whole size, at most ``max_epochs`` times the source's own size. What a capped
source leaves over is shared among the others by weight, until none is above its cap. Then every document of a source is repeated
``floor(target / source size)`` times, and the rest of the target is filled with a seeded sample: documents in the order of a
hash, whole, and of the last one as many words as are still wanted. So a source meets its target to the word.

Defined results: a null text has size 0; a null source is a source of its own, the last one; sources that are all empty get 0;
rows with the same id and size are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize
from .ranks import dealt

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def ranked_sources(sizes: DataFrame, parts: int = 32) -> DataFrame:
    """sizes(source, source_size) with rank, from 0, by code point with null last.

    The ranks are found in two steps, within ranges of sources and over the ranges, so no task holds all sources.
    """
    keyed = sizes.withColumn("last", F.col("source").isNull())
    dealt = materialize(keyed.repartitionByRange(parts, "last", "source").withColumn("part", F.spark_partition_id()))
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("last", "source"))
    return dealt.withColumn("own", own).join(before, "part").select("source", "source_size", (F.col("before") + F.col("own") - 1).alias("rank"))


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sources(source, source_size, weight) with target.

    Each round is one aggregate of the sources to two numbers: the weight that isn't clamped and the size left for it. A round
    clamps every source that the level would lift over its cap; the last round clamps none.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        free = F.lit(True) if level is None else F.col("weight") * F.lit(level) < cap
        w, clamped = sources.agg(F.sum(F.when(free, F.col("weight"))), F.sum(F.when(~free, cap))).first()
        now = (total - (clamped or 0.0)) / w if w else None
        if now is None or level is not None and now <= level:
            break
        level = now
    lifted = F.least(cap, F.col("weight") * F.lit(float(level or 0.0)))
    return sources.withColumn("target", lifted)


def mix(docs: DataFrame, max_epochs: float = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """docs(doc_id, text, source) as doc_id, size, source_size, target, taken, source, copies and part.

    taken is how many of its words the mix takes: ``copies`` times the whole text and its first ``part`` words.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = dealt(sized.withColumn("h", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed)))), "source", ["h", "doc_id", "size"])
    sources = materialize(
        water_fill(
            materialize(
                ranked_sources(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).select(
                    "source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).alias("weight")
                )
            ),
            max_epochs,
        )
        .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.least(F.col("source_size"), F.floor(F.col("target") - F.col("copies") * F.col("source_size") + 0.5).cast("long")))
    )
    # Where a document begins in its source's seeded order: what earlier parts hold, and what is before it in its own part. Parts are
    # ranges of that order, so rows with no id, or with one id, are split over as many as others are.
    sized = sized.withColumnRenamed("part", "p")
    held = sized.groupBy("source", "p").agg(F.sum("size").alias("held"))
    starts = held.select("source", "p", (F.sum("held").over(Window.partitionBy("source").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).alias("start"))
    cut = (
        starts.alias("a")
        .join(sources.alias("s"), F.col("a.source").eqNullSafe(F.col("s.source")))
        .select("a.source", "a.p", "a.start", "s.source_size", "s.target", "s.copies", "s.rest")
    )
    inside = Window.partitionBy("source", "p").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("at", F.sum("size").over(inside) - F.col("size"))
    want = F.col("c.rest") - F.col("c.start") - F.col("d.at")
    out = (
        placed.alias("d")
        .join(cut.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.p") == F.col("c.p")))
        .select("d.doc_id", "d.size", "c.source_size", "c.target", "d.source", "c.copies", F.greatest(F.lit(0), F.least(F.col("d.size"), want)).cast("long").alias("part"))
    )
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"), "source", "copies", "part")
