"""Similarity join of labels (inventory H19)."""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.staging import staged

CUTOFF = 0.75
#: Pairs with so many characters or more are found by their pairs of neighbouring characters, shorter ones by single characters.
LONG = 16


def counted(grams: Column) -> Column:
    """Each gram with its number among equal ones, so that a set of these is as good as a bag of grams."""
    return F.transform(grams, lambda g, i: F.struct(g.alias("g"), F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g)).alias("k")))


def grams(text: Column, q: int) -> Column:
    n = F.length(text) - (q - 1)
    return counted(F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>")))


def least_shared(total: Column, q: int, cutoff: float) -> Column:
    """Grams that two texts of so many characters in all share at least, if they are alike.

    Alike are texts with m >= cutoff * total / 2 matched characters, in m or fewer stretches. Two stretches have an unmatched character between them, so there are total - 2m + 1
    of them at most; a stretch of k characters has k grams of one character, and k - 1 of two.
    """
    m = F.ceil(total * F.lit(cutoff / 2) - F.lit(1e-9))
    return m if q == 1 else 3 * m - total - 1


def candidates(left: DataFrame, right: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """left(a) and right(b), distinct labels, to the pairs (a, b) that may be alike by the cutoff.

    An inverted index by gram. Of a label only its rarest grams are filed: so many that two alike labels have one filed gram in common whatever the other's length,
    so frequent grams meet no one. Of the pairs that meet, those with impossible lengths go, then those that share too few grams.
    """
    c = F.col
    ratio = (2 - cutoff) / cutoff  # an alike label is at most so many times as long
    found = []
    for q in (1, 2):
        def cut(df: DataFrame, name: str, q: int = q) -> DataFrame:
            n = F.length(name)
            longest = n + F.floor(n * ratio + 1e-9) if q == 2 else F.least(n + F.floor(n * ratio + 1e-9), F.lit(LONG - 1))
            shortest = n + F.ceil(n / ratio - 1e-9) if q == 1 else F.greatest(n + F.ceil(n / ratio - 1e-9), F.lit(LONG))
            own = df.select(name, n.alias("n"), grams(F.col(name), q).alias("grams"), shortest.alias("least_total"), longest.alias("most_total"))
            return own.filter("least_total <= most_total").withColumn("file", F.size("grams") - least_shared(F.col("least_total"), q, cutoff) + 1)

        a, b = staged(cut(left, "a")), staged(cut(right, "b"))
        every = lambda df, name: df.select(name, "n", "file", F.explode("grams").alias("x"))
        # How often a gram occurs in either table; the least shared count is least for the shortest total, as both bounds grow with it.
        often = every(a, "a").select("x").unionByName(every(b, "b").select("x")).groupBy("x").agg(F.count("*").alias("often"))

        def filed(df: DataFrame, name: str) -> DataFrame:
            rank = F.row_number().over(Window.partitionBy(name).orderBy("often", "x"))
            return every(df, name).join(often, "x").withColumn("rank", rank).filter("rank <= file").select(name, "n", "x")

        met = filed(a, "a").join(filed(b, "b").withColumnRenamed("n", "m"), "x")
        total, fits = c("n") + c("m"), (F.least("n", "m") >= F.lit(cutoff / 2) * (c("n") + c("m")) - 1e-9)
        met = met.filter(fits & ((total < LONG) if q == 1 else (total >= LONG))).select("a", "b").distinct()
        both = met.join(a.select("a", "n", c("grams").alias("ga")), "a").join(b.select("b", c("n").alias("m"), c("grams").alias("gb")), "b")
        found.append(both.filter(F.size(F.array_intersect("ga", "gb")) >= least_shared(total, q, cutoff)).select("a", "b"))
    return found[0].unionByName(found[1])


def matched(left: DataFrame, right: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """left(a) and right(b), distinct labels, to a, b and ratio: of each a that has any the most alike b, the last by code point of equals.

    Ratios are the standard library's, of candidates alone, in batches.
    """

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, last = difflib.SequenceMatcher(), None
        for batch in batches:
            out = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                if a != last:
                    matcher.set_seq2(a)
                    last = a
                matcher.set_seq1(b)
                out.append(matcher.ratio())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "ratio"])

    pairs = candidates(left.filter("length(a) > 0"), right.filter("length(b) > 0"), cutoff).repartition("a").sortWithinPartitions("a")
    scored = pairs.mapInArrow(score, "a string, b string, ratio double").filter(F.col("ratio") >= cutoff)
    return scored.groupBy("a").agg(F.max_by(F.struct("b", "ratio"), F.struct("ratio", "b")).alias("x")).select("a", "x.*")


def labels(t) -> tuple[DataFrame, DataFrame]:
    """Names as they are written, of parts and of odd pages' sites, and known ones, of parts and of even pages' sites."""
    site = F.regexp_extract(F.lower("url"), "://(?:www[.]|m[.])?([^./?#]*)", 1)
    left = t.part.select(F.concat(F.translate("p_name", " ", "-"), F.lit("s")).alias("a")).unionByName(t.pages.filter("page_id % 2 = 1").select(site.alias("a")))
    right = t.part.select(F.col("p_name").alias("b")).unionByName(t.pages.filter("page_id % 2 = 0").select(site.alias("b")))
    return left.distinct(), right.distinct()


@query("h19_similarity_join")
def h19_join(t):
    """Each written name with the known one that it is most like, if by 0.75 or more; names without one have none. No SQL has this measure: tests hold it against all pairs."""
    left, right = labels(t)
    return left.join(matched(left, right), "a", "left")
