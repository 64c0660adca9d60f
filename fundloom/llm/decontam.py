"""Benchmark decontamination: which documents hold which benchmark items.

Texts become lower-case words of letters and digits and shingles of five words (a shorter text is one shingle). Where items have fewer
words, documents are cut into runs of as many words too, so such an item is found wherever a document has its words in a row. An item leaks into
a document that holds at least 0.8 of its shingles; the document may be far longer than the item, so what is compared is
containment, not resemblance. Items are partitioned by size. All items of a partition keep as many least hashes of their
shingles (a bottom-k MinHash sketch) that, if 0.8 of an item's shingles are in a document, some of its sketch must be too: the
partition's largest item may miss m shingles, so m + 1 hashes are kept; hashes that fewer items have come first, so that items
with a common opening don't all meet every document that has it. Documents are searched for sketch hashes, pairs with too
few are dropped, and the rest are verified by exact containment of the shingles themselves. No leak is lost.

Defined results: a text that is null or without words has no shingle, leaks nothing and holds nothing; rows with the same item_id
are one item with all their shingles; document rows count each for itself, told apart by id and text; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize

WORDS, LEAST = 5, 0.8
#: An index with at most so many rows, of 8 to about 100 bytes each, may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000
#: So many distinct hashes alone, some 50 bytes each, may be broadcast to leave out shingles that no item has before the rest is shuffled.
BROADCAST_HASHES = 1_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case. Only the first and the last part of the cut can be empty."""

    def inner(w: Column) -> Column:
        first = F.when(w[0] == "", 2).otherwise(1)
        return F.slice(w, first, F.size(w) + 1 - first - F.when((F.size(w) >= first) & (F.element_at(w, -1) == ""), 1).otherwise(0))

    return F.element_at(F.transform(F.array(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")), inner), 1)


def shingles(text: Column, one: str, sizes: Sequence[int] = (WORDS,)) -> Column:
    """Of a text: hashes or texts, as one says, of these sizes, repeats included. The words are cut once and then looked at by place."""

    def cut(w: Column) -> Column:
        starts = lambda k: F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1)))
        run = lambda k: lambda i: F.xxhash64(F.slice(w, i, k)) if one == "hash" else F.array_join(F.slice(w, i, k), " ")
        made = F.concat(*[F.transform(starts(k), run(k)) for k in sizes])
        return F.when(F.size(w) > 0, made).otherwise(F.array().cast("array<bigint>" if one == "hash" else "array<string>"))

    return F.element_at(F.transform(F.array(words(text)), cut), 1)


def index(items: DataFrame, least: float = LEAST) -> DataFrame:
    """items(item_id, text) as item_id, n (its shingles), shingle, h, sketched, needed (least sketch hashes that a leak shows)."""
    cut = items.select("item_id", F.explode(F.arrays_zip(shingles(F.col("text"), "text").alias("shingle"), shingles(F.col("text"), "hash").alias("h"))).alias("x"))
    one = cut.select("item_id", "x.shingle", "x.h").distinct()
    one = one.join(one.groupBy("h").agg(F.count("*").alias("items")), "h")
    item = Window.partitionBy("item_id")
    sized = one.withColumn("n", F.count("*").over(item))
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    missed = lambda n: n - F.ceil(n * F.lit(least) - F.lit(1e-9))
    sized = sized.select("*", (missed(largest) + 1).cast("long").alias("k"), missed(F.col("n")).cast("long").alias("may_miss"), F.row_number().over(item.orderBy("items", "h", "shingle")).alias("at"))
    return sized.select("item_id", "n", "shingle", "h", (F.col("at") <= F.col("k")).alias("sketched"), (F.least("k", "n") - F.col("may_miss")).alias("needed"))


def sizes_of(items: DataFrame) -> list[int]:
    """The sizes to cut documents to: five words, and the sizes of items that have fewer. Five numbers at most."""
    n = items.select(F.size(words(F.col("text"))).alias("n")).filter(F.col("n").between(1, WORDS - 1)).distinct()
    return [WORDS, *sorted(r["n"] for r in n.collect())]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked to be broadcast if it has been counted and found small."""
    return F.broadcast(df) if df.count() <= rows else df


def leaks(docs: DataFrame, items: DataFrame, least: float = LEAST, broadcast_rows: int = BROADCAST_ROWS, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """docs(doc_id, text) and items(item_id, text) to doc_id, text_hash, item_id, n_item, n_shared, containment."""
    filed = materialize(index(items, least))
    sizes = sizes_of(items)
    sketch = filed.filter("sketched").select("item_id", "h", "needed").distinct()
    probes = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(shingles(F.col("text"), "hash", sizes)).alias("h"))
    if sketch.count() <= broadcast_rows:
        sketch = F.broadcast(sketch)
    else:
        hashes = sketch.select("h").distinct()
        probes = probes.join(F.broadcast(hashes), "h", "left_semi") if hashes.count() <= broadcast_hashes else probes
    tally = probes.join(sketch, "h").groupBy("doc_id", "text_hash", "item_id").agg(F.count_distinct("h").alias("met"), F.max("needed").alias("needed"))
    candidates = materialize(tally.filter("met >= needed").select("doc_id", "text_hash", "item_id"))
    # Only documents of a candidate pair are cut again, and only such pairs are counted.
    who = candidates.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
    again = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    again = again.join(small(who, broadcast_rows), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left_semi")
    held = again.select("doc_id", "text_hash", F.explode(F.array_distinct(shingles(F.col("text"), "text", sizes))).alias("shingle"))
    full = small(filed.select("item_id", "n", "shingle"), broadcast_rows)
    pair = [F.col("doc_id").eqNullSafe(F.col("d")), F.col("text_hash") == F.col("t"), F.col("item_id").eqNullSafe(F.col("i"))]
    shared = held.join(full, "shingle").join(candidates.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("item_id").alias("i")), pair[0] & pair[1] & pair[2], "left_semi")
    counted = shared.groupBy("doc_id", "text_hash", "item_id").agg(F.first("n").alias("n_item"), F.count_distinct("shingle").alias("n_shared"))
    ratio = F.col("n_shared") / F.col("n_item")
    return counted.filter(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(least) - F.lit(1e-9))).select("doc_id", "text_hash", "item_id", "n_item", "n_shared", ratio.alias("containment"))


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, with their columns, that hold no item."""
    names: list[str] = []
    for name in ("leak_id", "leak_hash"):
        names.append(free_name([*docs.columns, *names], name))
    found = leaks(docs.select("doc_id", "text"), items, least)
    hit = found.select(F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1])).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(names[0])) & (F.xxhash64("text") == F.col(names[1])), "left_anti")
