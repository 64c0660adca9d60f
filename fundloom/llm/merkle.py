"""Merkle manifest of a dataset: one tree a language over its documents, and one tree over the languages.

A leaf is the hash of a row's fields. While a tree has several nodes, every eight consecutive ones become their hash; the last run
may be shorter. How many leaves a tree has is known, so it is known of each run how many nodes it waits for. A ``Forest`` holds the
nodes that aren't resolved yet, by tree, level and run. Adding a node, or another forest's nodes, resolves each run that is complete.
Merging is associative and commutative, so forests of any parts of the data merge in any order. Parts are ranges of the rows in order; each
leaves the few nodes at its two edges. The parts' forests are merged as a tree, ``FAN`` neighbours a task, until one is left.

Proofs go down again. Of the nodes from level ``UNIT`` on, each learns its steps to the root from its parent's, a level at a time. A unit is the
8 ** UNIT leaves below such a node: one task at a time holds a unit's digests and gives each leaf its steps.

Defined results: a null field is written ``-``, an empty one ``0:``; rows of a null lang are a tree of their own, the first; within a
tree documents are in order of doc_id, null first, rows of one id in order of their leaf; repeated rows are leaves each; an empty table has no root and
gives no rows; a text of any length is hashed whole; the doc_id of a null id isn't tampered with; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import ascii_lower, crc_mod, discard, materialize
from .ranks import dealt, ranked, starts

ARITY = 8
#: Nodes from this level on are written down; a unit has ARITY ** UNIT leaves at most.
UNIT = 4
#: So many neighbouring parts are merged by one task in a round.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes on that level of a tree with n leaves."""
    return -(-n // ARITY**level)


class Forest:
    """Unresolved nodes of trees, by tree, its number of leaves, level and run. Nodes made on level ``keep`` or above, and roots, are told."""

    def __init__(self, keep: int = UNIT):
        self.keep = keep
        self.runs: dict[tuple, dict[int, str]] = {}
        self.made: list[tuple] = []

    def add(self, tree: str | None, n: int, level: int, idx: int, node: str, new: bool = False) -> None:
        """The node, and every node that is complete with it. new: it hasn't been told by another forest yet."""
        while True:
            nodes = width(n, level)
            if new and (level >= self.keep or nodes == 1):
                self.made.append((tree, n, level, idx, node))
            if nodes == 1:
                return
            run, at = divmod(idx, ARITY)
            held = self.runs.setdefault((tree, n, level, run), {})
            held[at] = node
            if len(held) < min(ARITY, nodes - run * ARITY):
                return
            del self.runs[tree, n, level, run]
            level, idx, node, new = level + 1, run, digest(held[k] for k in sorted(held)), True

    def merge(self, other: Forest) -> Forest:
        """This forest with the other's unresolved nodes. The empty forest changes nothing."""
        for node in other.open():
            self.add(*node)
        self.made += other.made
        return self

    def open(self) -> Iterator[tuple]:
        for (tree, n, level, run), held in self.runs.items():
            for at, node in held.items():
                yield tree, n, level, run * ARITY + at, node


NODE = T.StructType([T.StructField(c, t()) for c, t in (("part", T.IntegerType), ("tree", T.StringType), ("n", T.LongType), ("level", T.IntegerType), ("idx", T.LongType), ("digest", T.StringType), ("made", T.BooleanType))])


def table_of(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema.fields]
    return pa.RecordBatch.from_arrays([pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields, strict=True)], names=schema.names)


def merged(nodes: DataFrame, keep: int) -> DataFrame:
    """nodes(part, tree, n, level, idx, digest), sorted by part within partitions, to each part's unresolved nodes and those made."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, part = Forest(keep), None

        def told(whole: bool) -> Iterator[pa.RecordBatch]:
            rows = [(part, *x, True) for x in forest.made] + ([(part, *x, False) for x in forest.open()] if whole else [])
            forest.made = []
            for at in range(0, len(rows), 10_000):
                yield table_of(rows[at : at + 10_000], NODE)

        for batch in batches:
            for own, tree, n, level, idx, node in zip(*[batch.column(c).to_pylist() for c in ("part", "tree", "n", "level", "idx", "digest")], strict=True):
                if own != part:
                    yield from told(True)
                    forest, part = Forest(keep), own
                forest.add(tree, n, level, idx, node, level == 0)
            yield from told(False)
        yield from told(True)

    return nodes.select("part", "tree", "n", "level", "idx", "digest").mapInArrow(run, NODE)


def build(leaves: DataFrame, order: list[str], keep: int = UNIT, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """leaves(tree, digest, ...) to those with rank and n, and the nodes from level keep on and all roots as tree, n, level, idx, digest."""
    made = materialize(leaves)  # bounds of ranges are sampled first: texts would be hashed once more for that
    rows = dealt(made, "tree", order)
    leaves = materialize(ranked(rows, starts(rows, "tree"), "tree"))
    discard(made, rows)
    place = ["part", "tree", "level", "idx"]
    now = materialize(merged(leaves.select("part", "tree", "n", F.lit(0).alias("level"), F.col("rank").alias("idx"), "digest").sortWithinPartitions(*place), keep))
    rounds = [now]
    while now.filter(~F.col("made")).limit(1).count():
        held = now.filter(~F.col("made")).withColumn("part", F.floor(F.col("part") / fan).cast("int"))
        now = materialize(merged(held.repartition("part").sortWithinPartitions(*place), keep))
        rounds.append(now)
    return leaves, reduce(DataFrame.unionByName, [r.filter("made").drop("part", "made") for r in rounds])


def is_root() -> Column:
    return F.col("n") <= F.pow(F.lit(float(ARITY)), F.col("level"))


STEPS = "array<struct<left:string,right:string>>"


def units(nodes: DataFrame, above: DataFrame | None, keep: int = UNIT) -> DataFrame:
    """tree, unit, subroot, steps of each node on level keep, and of lower roots. above(tree, steps) has the roots' own steps; null: none.

    A node has at most ARITY children, so no join here has a hot key.
    """
    roots = nodes.filter(is_root()).select("tree", "level", "idx", F.col("digest").alias("subroot"))
    if above is None:
        roots = roots.withColumn("steps", F.array().cast(STEPS))
    else:
        own = above.select(F.col("tree").alias("_tree"), "steps")
        roots = roots.join(own, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
    top = nodes.agg(F.max("level")).first()[0] or 0
    known = roots.filter(F.col("level") == top)
    for level in range(top - 1, keep - 1, -1):
        run = F.floor(F.col("idx") / ARITY).cast("long")
        runs = nodes.filter((F.col("level") == level) & ~is_root()).groupBy(F.col("tree").alias("t"), run.alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("held"))
        cut = runs.select("t", "run", "held", F.explode("held").alias("x"))
        side = lambda near: F.array_join(F.transform(F.filter("held", near), lambda y: y["digest"]), "")
        step = F.struct(side(lambda y: y["idx"] < F.col("x.idx")).alias("left"), side(lambda y: y["idx"] > F.col("x.idx")).alias("right"))
        cut = cut.select("t", "run", F.col("x.idx").alias("at"), step.alias("step"))
        met = cut.join(known.select("tree", "idx", "subroot", "steps"), F.col("t").eqNullSafe(F.col("tree")) & (F.col("run") == F.col("idx")))
        below = met.select("tree", F.lit(level).alias("level"), F.col("at").alias("idx"), "subroot", F.concat(F.array("step"), "steps").alias("steps"))
        known = below.unionByName(roots.filter(F.col("level") == level))
    known = known.unionByName(roots.filter(F.col("level") < min(keep, top)))
    return known.select("tree", F.col("idx").alias("unit"), "subroot", "steps")


def unit_steps(digests: list[str], n: int, keep: int) -> list[list[tuple[str, str]]]:
    """Of the leaves of a unit, in order: the digests left and right of it in its run, a level at a time, up to the unit's node."""
    steps: list[list[tuple[str, str]]] = [[] for _ in digests]
    level = 0
    while level < keep and width(n, level) > 1:
        sides = []
        above = []
        for at in range(0, len(digests), ARITY):
            run = digests[at : at + ARITY]
            sides += [("".join(run[:k]), "".join(run[k + 1 :])) for k in range(len(run))]
            above.append(digest(run))
        span = ARITY**level
        for i, own in enumerate(steps):
            own.append(sides[i // span])
        digests, level = above, level + 1
    return steps


def fold(leaf: str, steps: Iterable[tuple[str, str]]) -> str:
    """The root that the leaf leads to by its steps."""
    return reduce(lambda node, s: digest((s[0], node, s[1])), steps, leaf)


def walked(leaves: DataFrame, tops: DataFrame, fields: str, one: Callable[[dict, list[tuple[str, str]]], tuple], keep: int = UNIT) -> DataFrame:
    """The leaves' columns but tree, digest, part, rank and n, with subroot and the fields that one(row, steps) finds for each."""
    carried = [f for f in leaves.schema.fields if f.name not in ("part", "rank", "n")]
    more = T._parse_datatype_string(fields)
    schema = T.StructType([*carried, T.StructField("subroot", T.StringType()), *more.fields])
    unit = F.floor(F.col("rank") / ARITY**keep).cast("long").alias("unit")
    own = leaves.select(unit, F.lit(1).alias("kind"), "rank", "n", *[f.name for f in carried])
    both = tops.withColumn("kind", F.lit(0)).unionByName(own, allowMissingColumns=True)
    both = both.repartition("tree", "unit").sortWithinPartitions("tree", "unit", "kind", "rank")
    names = [f.name for f in carried]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict = {}
        held: list[dict] = []

        def told() -> Iterator[pa.RecordBatch]:
            if held:
                upper = [(s["left"], s["right"]) for s in top["steps"]]
                found = unit_steps([r["digest"] for r in held], held[0]["n"], keep)
                yield table_of([(*[r[c] for c in names], top["subroot"], *one(r, own + upper)) for r, own in zip(held, found, strict=True)], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    yield from told()
                    top, held = row, []
                else:
                    held.append(row)
        yield from told()

    return both.mapInArrow(run, schema)


def told(c: str | Column) -> Column:
    """A field as it is hashed: its length in bytes and its value."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[told(c) for c in FIELDS[:-1]], told(text)), 256)


def proofs(docs: DataFrame, tampered: Column, keep: int = UNIT, fan: int = FAN) -> DataFrame:
    """docs(doc_id, source, lang, n_chars, text) as doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where ``tampered`` holds, the leaf that is checked is that of the text with A-Z in lower case.
    """
    shown = F.when(tampered, leaf(ascii_lower(F.col("text"))))
    leaves, nodes = build(docs.select("doc_id", F.col("lang").alias("tree"), leaf(F.col("text")).alias("digest"), shown.alias("shown")), ["doc_id", "digest"], keep, fan)
    roots = nodes.filter(is_root()).select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest")
    langs, top = build(roots, ["lang"], keep, fan)
    root = top.filter(is_root()).first()
    lang_steps = walked(langs, units(top, None, keep), f"steps {STEPS}", lambda row, steps: ([{"left": a, "right": b} for a, b in steps],), keep)
    above = lang_steps.select(F.col("lang").alias("tree"), "steps")
    check = lambda row, steps: (digest(x for s in steps for x in s), fold(row["shown"] or row["digest"], steps))
    out = walked(leaves, units(nodes, above, keep), "proof_sha256 string, folded_root string", check, keep)
    root = F.lit(root["digest"] if root else None).cast("string")
    return out.select("doc_id", F.col("tree").alias("lang"), F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def tampered(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, 3) == 0, F.lit(False))
