"""Prefix trie of conversations.

Every distinct sequence of a conversation's first d turns is a node. Its fingerprint is a polynomial of the turns' contents, sum of x_i * B ** i
modulo a prime, twice; numpy scans find all prefixes' fingerprints within a range of (conversation, position), and what a conversation has in
earlier ranges is added. Turns with one depth and fingerprint are a candidate group. A group is right if its members have the last turn of its
representative, the one with the least conv_id, and their prefixes without that turn are one group too, which is checked likewise; all its members then have
the representative's turns. Where they differ the group is split, and the groups below it are checked again until none is split.
Contents are compared by their hash and, where two texts have one hash, by which of these texts it is.

Sums over subtrees take about log2(depth) rounds: each round adds the sums found ``2 ** k`` levels below and doubles the reach. Nodes of one
conversation are chains that save nothing, and don't take part.

A turn is written down by its content's hash and size; texts are read twice, and only compared within the hash. Conversations of any length are
split over tasks, and so are nodes with any number of members or children. Only the ids of the conversations that end in one node are streamed through one task, eight bytes
each, as their digest asks for.

Defined results: turns are in order of turn, null first, then of role and of the text's md5; repeated rows are turns each; a null role or text is
empty; rows of a null conv_id are no conversation and left out; an empty table has no node; texts of any length are hashed whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .ranks import dealt, ranked, starts

#: Two primes and a base for each. Products of two residues fit in 64 bits.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1812433253)
#: A conversation borrows this many turns at most, and from the first of a run of so many ids.
BORROWED, RUN = 9, 5
KEY = ["depth", "f0", "f1", "split"]
EMPTY = sha256(b"").hexdigest()


def content_hash(role: Column, text: Column) -> Column:
    return F.xxhash64(role, text)


def contents(turns: DataFrame) -> DataFrame:
    """turns(h, role, text, ...) with same, which tells texts of one hash apart. Nothing is joined unless two texts have one hash."""
    distinct = turns.select("h", "role", "text").distinct()
    shared = materialize(distinct.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h"))
    if not shared.limit(1).count():
        discard(shared)
        return turns.withColumn("same", F.lit(0))
    number = F.row_number().over(Window.partitionBy("h").orderBy("role", "text")) - 1
    told = distinct.join(shared, "h").withColumn("same", number)
    return turns.join(told, ["h", "role", "text"], "left").withColumn("same", F.coalesce("same", F.lit(0)))


def rebuilt(conversations: DataFrame, hashed: Callable[[Column, Column], Column] = content_hash) -> tuple[DataFrame, DataFrame]:
    """The turns after rebuilding, as conv_id, pos, h, same, size and last, and all conversations as conv_id and turns."""
    c = F.col
    text = F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(c("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    turns = contents(turns.withColumn("h", hashed(c("role"), c("text"))))
    slim = turns.select("conv_id", "turn", "role", F.md5("text").alias("digest"), "h", "same", F.octet_length("text").cast("long").alias("size"))
    rows = dealt(slim, "conv_id", ["turn", "role", "digest"])
    at = materialize(starts(rows, "conv_id"))
    lengths = at.groupBy("conv_id").agg(F.max("n").alias("n"))
    wanted = F.pmod(F.crc32(c("conv_id").cast("string").cast("binary")), F.lit(BORROWED))
    own = lengths.select("conv_id", "n", wanted.alias("wanted"), (c("conv_id") - c("conv_id") % RUN).alias("base"))
    convs = own.join(lengths.select(c("conv_id").alias("base"), c("n").alias("base_n")), "base", "left")
    convs = convs.withColumn("borrowed", F.least("wanted", F.coalesce("base_n", F.lit(0)))).withColumn("turns", c("borrowed") + F.greatest(F.lit(0), c("n") - c("wanted")))
    convs = materialize(convs.select("conv_id", "base", "wanted", "borrowed", "turns"))
    kept = ranked(rows, at.join(convs.select("conv_id", "wanted", "borrowed", "turns"), "conv_id"), "conv_id").filter("rank >= wanted")
    kept = kept.select("conv_id", (c("rank") - c("wanted") + c("borrowed")).alias("pos"), "h", "same", "size", "turns")
    lent = ranked(rows, at.filter(c("before") < BORROWED), "conv_id").filter(c("rank") < BORROWED).select(c("conv_id").alias("base"), c("rank").alias("pos"), "h", "same", "size")
    lent = convs.join(lent, "base").filter(c("pos") < c("wanted")).select("conv_id", "pos", "h", "same", "size", "turns")
    out = kept.unionByName(lent)
    return out.select("conv_id", "pos", "h", "same", "size", (c("pos") + 1 == c("turns")).alias("last")), convs.select("conv_id", "turns")


def power(base: int, exponents: np.ndarray, p: int) -> np.ndarray:
    """base ** exponents modulo p."""
    out, factor, left = np.ones(len(exponents), dtype=np.uint64), np.uint64(base % p), exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * factor % np.uint64(p), out)
        factor, left = factor * factor % np.uint64(p), left >> np.uint64(1)
    return out


def terms(h: np.ndarray, same: np.ndarray, pos: np.ndarray, primes: tuple[int, ...] = PRIMES) -> list[np.ndarray]:
    """Each turn's summand of the polynomial, for each prime."""
    v = h.view(np.uint64) + same.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = []
    for k, (p, base) in enumerate(zip(primes, BASES, strict=True)):
        mixed = (v ^ (v >> np.uint64(29 + k))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        x = (mixed ^ (mixed >> np.uint64(32))) % np.uint64(p - 1) + np.uint64(1)
        out.append(x * power(base, pos, p) % np.uint64(p))
    return out


def scanned(rows: DataFrame, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """rows(conv_id, pos, h, same, ...) with f0 and f1, the fingerprint up to each turn, and g0 and g1, that without it."""
    ranged = rows.repartitionByRange("conv_id", "pos").sortWithinPartitions("conv_id", "pos")
    names = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, [np.uint64(0), np.uint64(0)]
        for b in batches:
            if not b.num_rows:
                continue
            ids, h, same, pos = (b.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "h", "same", "pos"))
            new = np.append(ids[0] != conv if conv is not None else True, ids[1:] != ids[:-1])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
            made = []
            for k, (x, p) in enumerate(zip(terms(h, same, pos, primes), primes, strict=True)):
                so_far = np.append(np.uint64(0), np.cumsum(x))
                sums = (so_far[1:] - so_far[np.maximum(begin, 0)] + np.where(begin < 0, held[k], np.uint64(0))) % np.uint64(p)
                made += [sums.astype(np.int64), ((sums + np.uint64(p) - x) % np.uint64(p)).astype(np.int64)]
                held[k] = sums[-1]
            conv = ids[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, made)], names=[*names, "f0", "g0", "f1", "g1"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    local = materialize(ranged.mapInArrow(run, f"{kinds}, f0 long, g0 long, f1 long, g1 long").withColumn("part", F.spark_partition_id()))
    # Only a conversation that was begun in an earlier part is lifted: one a part at most.
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.groupBy("conv_id", "part").agg(*[F.max_by(f"f{k}", "pos").alias(f"f{k}") for k in range(2)])
    sums = sums.select("conv_id", "part", *[F.sum(f"f{k}").over(earlier).alias(f"e{k}") for k in range(2)]).filter("e0 is not null")
    met = local.join(sums, ["conv_id", "part"], "left")
    lifted = [F.pmod(F.col(f"{x}{k}") + F.coalesce(f"e{k}", F.lit(0)), F.lit(p)).alias(f"{x}{k}") for k, p in enumerate(primes) for x in "fg"]
    return met.select(*names, *lifted)


def grouped(rows: DataFrame) -> DataFrame:
    """rows(conv_id, depth, f0, f1, split, g0, g1, above, h, same, size) by node: its parent, members, size, and bad where its members differ."""
    told = ["g0", "g1", "above", "h", "same"]
    sums = rows.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), *[f(c).alias(f"{f.__name__}_{c}") for c in told for f in (F.min, F.max)])
    bad = F.lit(False)
    for c in told:
        bad |= F.col(f"min_{c}") != F.col(f"max_{c}")
    parent = [F.col(a).alias(b) for a, b in (("min_g0", "g0"), ("min_g1", "g1"), ("min_above", "above"))]
    return sums.select(*KEY, "n_convs", "conv_id", "size", *parent, bad.alias("bad"))


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(conv_id, pos, h, same, size, last, f0, f1, g0, g1) with depth, split and above (its prefix's split), and their nodes, none of them bad."""
    rows = rows.withColumn("depth", F.col("pos") + 1).drop("pos").withColumns({"split": F.lit(0), "above": F.lit(0)})
    rows = materialize(rows)
    nodes = materialize(grouped(rows))
    while nodes.filter("bad").limit(1).count():
        # Splits are numbered anew in each candidate group that holds several (prefix, last turn), the representative's first.
        group, told = ["depth", "f0", "f1"], ["g0", "g1", "above", "h", "same"]
        kinds = rows.groupBy(*group, *told).agg(F.min("conv_id").alias("least"))
        number = F.row_number().over(Window.partitionBy(*group).orderBy("least")) - 1
        kinds = kinds.withColumn("number", number).filter("number > 0").drop("least")
        split = rows.drop("split").join(kinds, [*group, *told], "left").withColumn("split", F.coalesce("number", F.lit(0))).drop("number")
        split = materialize(split)
        up = split.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("split").alias("up"))
        again = materialize(split.drop("above").join(up, ["conv_id", "depth"], "left").withColumn("above", F.coalesce("up", F.lit(0))).drop("up").select(*rows.columns))
        discard(rows, nodes, split)
        rows, nodes = again, materialize(grouped(again))
    return rows, nodes


def ends(rows: DataFrame) -> DataFrame:
    """rows(KEY, conv_id) to KEY and ends_sha256: the digest of the ids in order, joined by commas. Ids are streamed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None

        def told() -> Iterator[pa.RecordBatch]:
            if key is not None:
                yield pa.RecordBatch.from_arrays([*[pa.array([x], t) for x, t in zip(key, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], pa.array([sha.hexdigest()])], names=[*KEY, "ends_sha256"])

        for b in batches:
            columns = [b.column(c).to_numpy(zero_copy_only=False) for c in KEY]
            ids = b.column("conv_id").to_pylist()
            changed = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if len(ids) else []
            for a, z in zip([0, *changed], [*changed, len(ids)], strict=True):
                if a == z:
                    continue
                own = tuple(int(c[a]) for c in columns)
                text = ",".join(map(str, ids[a:z])).encode()
                if own == key:
                    sha.update(b"," + text)
                else:
                    yield from told()
                    key, sha = own, sha256(text)
        yield from told()

    dealt_out = rows.select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return dealt_out.mapInArrow(run, "depth long, f0 long, f1 long, split int, ends_sha256 string")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """nodes(key, depth, up, saved, leaves), up being the parent's key, to key, saved and leaves summed over each subtree."""
    state, reach = materialize(nodes.select("key", "depth", "up", "saved", "leaves")), 1
    while state.filter(F.col("depth") >= reach).limit(1).count():
        below = state.filter(F.col("depth") >= reach).groupBy(F.col("up").alias("key")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        far = state.filter(F.col("depth") >= reach).select("key", F.col("up").alias("middle"))
        doubled = far.join(state.select(F.col("key").alias("middle"), F.col("up").alias("next_up"), F.col("depth").alias("d")).filter(F.col("d") >= reach), "middle").select("key", "next_up")
        more = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        now = state.join(below, "key", "left").join(doubled, "key", "left").select("key", "depth", F.col("next_up").alias("up"), more("saved"), more("leaves"))
        last, state = state, materialize(now)
        discard(last)
        reach *= 2
    return state.select("key", "saved", "leaves")


def prefix_trie(conversations: DataFrame, hashed: Callable[[Column, Column], Column] = content_hash, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node."""
    c = F.col
    turns, convs = rebuilt(conversations, hashed)
    rows, nodes = verified(scanned(turns, primes))
    root = convs.agg(F.min("conv_id"), F.count("*")).first()
    zero = [F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("f0"), F.lit(0).cast("long").alias("f1"), F.lit(0).alias("split")]
    ended = ends(rows.filter("last").select(*KEY, "conv_id").unionByName(convs.filter("turns = 0").select(*zero, "conv_id")))
    key, up = F.struct(*KEY).alias("key"), F.struct((c("depth") - 1).alias("depth"), c("g0").alias("f0"), c("g1").alias("f1"), c("above").alias("split")).alias("up")
    nodes = nodes.select(key, "depth", F.when(c("depth") > 0, up).alias("up"), "n_convs", "conv_id", "size")
    spark = conversations.sparkSession
    top = spark.range(1).filter(F.lit(root[1] > 0)).select(F.struct(*zero).alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast(nodes.schema["up"].dataType).alias("up"), F.lit(root[1]).cast("long").alias("n_convs"), F.lit(root[0]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("size"))
    nodes = nodes.unionByName(top)
    below = nodes.filter("depth > 0").groupBy(c("up").alias("key")).agg(F.count("*").alias("n_children"), F.sum((c("n_convs") == 1).cast("long")).alias("alone"))
    nodes = nodes.join(below, "key", "left").join(ended.select(key, "ends_sha256"), "key", "left")
    nodes = materialize(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).withColumn("alone", F.coalesce("alone", F.lit(0))))
    shared = nodes.filter("n_convs > 1").select("key", "depth", "up", ((c("n_convs") - 1) * c("size")).alias("saved"), (c("alone") + (c("n_children") == 0).cast("long")).alias("leaves"))
    nodes = nodes.join(subtree_sums(shared), "key", "left")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")]
    parents = nodes.select(c("key").alias("up"), c("conv_id").alias("parent_conv_id"))
    deep = nodes.filter("depth > 1").join(parents, "up").select(*out)
    # The root is the one parent that may have a share of all nodes as children.
    near = nodes.filter("depth <= 1").withColumn("parent_conv_id", F.when(c("depth") == 1, F.lit(root[0])).cast("long")).select(*out)
    return deep.unionByName(near)
