"""Secret scanning with multipart credential linking.

Strong spans are reported as they are found: assignments to secret names, access identifiers and long hex strings. Weak candidates
(40-character keys, account names, endpoints) mean little alone. They are joined, by intervals within a scope, with the
identifiers and secrets near them and are reported only if the complementary parts are there: a key with an identifier, an
account name with a secret, an endpoint with both. Scope: at most ``SCOPE`` characters between two spans of one text.

Weak kinds are looked for only in texts that also hold something of a complementary kind; others can't be reported. A weak candidate that
overlaps a strong span is none. Places are found by running sums over the lengths of matches and of what stands between them,
block by block, so a text with n matches costs about n ** 1.5 small steps and its length once for each pattern.

Defined results: a null text is empty; spans are (kind, start, end) in code points, end exclusive; rows with equal texts have
equal spans; a text of any length is read whole; an empty table gives an empty result; other columns, whatever their names, are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize

SCOPE = 200
# What a secret name, an access identifier and a hex string look like, and how long a match must be to stay.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
# A shorter run than the least never holds a longer one, so these two may ask for the length at once.
ACCESS = rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"
HEX = rf"[0-9a-f]{{{HEX_LEAST},}}"
# Weak candidates: the kept span is group 2, what stands before it is group 1. A key may follow '='; what follows it isn't consumed, so that it can stand before the next.
KEY40 = r"(^|[^A-Za-z0-9+/_-])([A-Za-z0-9+/]{40})(?![A-Za-z0-9+/=_-])"
IDENT = r"""((?:[Uu][Ss][Ee][Rr](?:_?[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9_.@-]+)"""
ENDPOINT = r"(^|[^A-Za-z])((?:https?|ftp|jdbc:[a-z]+|postgres|mysql|redis|mongodb|amqp|s3)://[^\x00-\x20\x22\x27<>]+)"
#: Hex strings and keys are runs of at least so many of these characters; a run is looked at from its start only.
LONG_RUN = rf"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{{{HEX_LEAST}}}"
#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "key40", "ident", "endpoint")
SPAN = "array<struct<start:int,rank:int,end:int>>"


#: redact cuts a text in pieces of so many characters, so that no substring is counted from the start of a long text.
PIECE = 1024


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op over each start of values, an array of ints that aren't negative; op is a sum or a maximum. Found within blocks, then lifted by the blocks before."""

    def step(acc: Column, x: Column) -> Column:
        return let(op(acc["last"], x), lambda y: F.struct(y.alias("last"), F.array_append(acc["out"], y).alias("out")))

    def whole(v: Column) -> Column:
        nothing = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out"))
        side = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
        made = F.transform(F.sequence(F.lit(0), F.greatest(side, F.lit(1)) - 1), lambda k: F.aggregate(F.slice(v, k * side + 1, side), nothing, step))

        def lifted(blocks: Column) -> Column:
            before = F.aggregate(blocks, nothing, lambda acc, b: F.struct(op(acc["last"], b["last"]).alias("last"), F.array_append(acc["out"], acc["last"]).alias("out")), lambda acc: acc["out"])
            return F.flatten(F.zip_with(blocks, before, lambda b, o: F.transform(b["out"], lambda y: op(o, y))))

        return let(made, lifted)

    return let(values, whole)


def lengths(strings: Column) -> Column:
    return F.transform(strings, lambda x: F.length(x))


def found(text: Column, pattern: str, kind: str, least: int = 0, whole: bool = True, where: Column | None = None) -> Column:
    """Spans of the leftmost matches that don't overlap. least: of group 2, in characters. whole: the span is the match, else group 2, which ends it. where: else none."""
    rx, rank = F.lit(pattern), KINDS.index(kind)
    grouped = "(" in pattern
    value = lengths(F.regexp_extract_all(text, rx, 2 if grouped else 0))
    matched = lengths(F.regexp_extract_all(text, rx, 0)) if whole and grouped else value if whole else F.zip_with(lengths(F.regexp_extract_all(text, rx, 1)), value, lambda a, b: a + b)
    cut = F.struct(lengths(F.split(text, pattern, -1)).alias("between"), matched.alias("matched"), value.alias("value"))

    def spans(c: Column) -> Column:
        ends = running(F.zip_with(F.slice(c["between"], 1, F.size(c["matched"])), c["matched"], lambda a, b: a + b), lambda a, b: a + b)
        start = lambda e, m: e - (m["matched"] if whole else m["value"])
        sizes = F.arrays_zip(c["matched"].alias("matched"), c["value"].alias("value"))
        made = F.zip_with(ends, sizes, lambda e, m: F.struct(start(e, m).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), m["value"].alias("value")))
        kept = F.filter(made, lambda x: x["value"] >= least) if least else made
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))

    asked = text.rlike(pattern) if where is None else where
    return F.when(asked, let(cut, spans)).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with three more columns, and their names by role: base and weak spans, and the text's key where it has weak ones."""
    names = {k: free_name(docs.columns, k) for k in ("base", "weak", "key")}
    flags = free_name([*docs.columns, *names.values()], "flags")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # Cheap tests first: a kind is looked for only in texts with what all its matches hold.
    named, long = t.contains("=") | t.contains(":"), t.rlike(LONG_RUN)
    tests = {"assign": named & t.rlike(ASSIGN), "access": t.contains("AKIA") & t.rlike(ACCESS), "hex": long & t.rlike(HEX), "key40": long & t.rlike(KEY40), "ident": named & t.rlike(IDENT), "endpoint": t.contains("://") & t.rlike(ENDPOINT)}
    flagged = docs.withColumn(flags, F.struct(*[c.alias(k) for k, c in tests.items()]))
    has = {k: F.col(flags)[k] for k in tests}
    identifier, secret = has["access"] | has["ident"], has["hex"] | has["assign"] | has["key40"]
    base = F.concat(found(t, ASSIGN, "assign", ASSIGN_LEAST, where=has["assign"]), found(t, ACCESS, "access", where=has["access"]), found(t, HEX, "hex", where=has["hex"]))
    weak = F.concat(
        found(t, KEY40, "key40", whole=False, where=has["key40"] & identifier),
        found(t, IDENT, "ident", whole=False, where=has["ident"] & secret),
        found(t, ENDPOINT, "endpoint", whole=False, where=has["endpoint"] & identifier & secret),
    )
    out = flagged.withColumn(names["base"], F.array_sort(base)).withColumn(names["weak"], weak)
    return out.withColumn(names["key"], F.when(F.size(names["weak"]) > 0, F.md5(t))).drop(flags), names


def binned(spans: Column, name: str, scope: int, more: int = 0) -> list[Column]:
    """Of exploded spans: the span and each stretch of the text that it touches, more of them on either side."""
    return ["key", spans.alias(name), F.explode(F.sequence(F.floor(spans["start"] / scope) - more, F.floor(spans["end"] / scope) + more)).alias("bin")]


def complementary(scanned: DataFrame, names: dict[str, str], scope: int = SCOPE) -> DataFrame:
    """key and linked, the weak spans whose complementary parts are within the scope.

    Each text counts once. Its spans are dealt out by (key, stretch of the text), so a very long text is not one task's work.
    """
    texts = scanned.filter(F.col(names["key"]).isNotNull()).select(F.col(names["key"]).alias("key"), F.col(names["base"]).alias("base"), F.col(names["weak"]).alias("weak")).dropDuplicates(["key"])
    texts = materialize(texts)
    rank = {k: i for i, k in enumerate(KINDS)}
    weak, base = texts.select("key", F.explode("weak").alias("w")), texts.select("key", F.explode("base").alias("p"))
    hit = weak.select(*binned(F.col("w"), "w", scope)).join(base.select(*binned(F.col("p"), "p", scope)), ["key", "bin"]).filter((F.col("p.start") < F.col("w.end")) & (F.col("w.start") < F.col("p.end")))
    weak = materialize(weak.join(hit.select("key", "w").distinct(), ["key", "w"], "left_anti"))
    part = base.unionByName(weak.select("key", F.col("w").alias("p"))).filter(F.col("p.rank") != rank["endpoint"])
    near = (F.col("p.start") - F.col("w.end") <= scope) & (F.col("w.start") - F.col("p.end") <= scope) & (F.col("p.rank") != F.col("w.rank"))
    identifier = F.col("p.rank").isin(rank["access"], rank["ident"])
    met = weak.select(*binned(F.col("w"), "w", scope, 1)).join(part.select(*binned(F.col("p"), "p", scope)), ["key", "bin"]).filter(near).groupBy("key", "w").agg(F.max(identifier).alias("i"), F.max(~identifier).alias("s"))
    told = met.filter(F.when(F.col("w.rank") == rank["key40"], F.col("i")).when(F.col("w.rank") == rank["ident"], F.col("s")).otherwise(F.col("i") & F.col("s")))
    return told.groupBy("key").agg(F.collect_list("w").alias("linked"))


def find(scanned: DataFrame, names: dict[str, str], scope: int = SCOPE) -> DataFrame:
    """scanned with one more column, spans: base ones and linked weak ones, in order. Rows without weak candidates don't move."""
    spans = free_name(scanned.columns, "spans")
    key, linked = free_name([*scanned.columns, spans], "text_key"), free_name([*scanned.columns, spans], "linked")
    plain = scanned.filter(F.col(names["key"]).isNull()).withColumn(spans, F.col(names["base"]))
    told = complementary(scanned, names, scope).select(F.col("key").alias(key), F.col("linked").alias(linked))
    weak = scanned.filter(F.col(names["key"]).isNotNull()).join(told, F.col(names["key"]) == F.col(key), "left")
    both = F.array_sort(F.concat(names["base"], F.coalesce(linked, F.array().cast(SPAN))))
    return plain.unionByName(weak.withColumn(spans, both).drop(key, linked))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with each stretch that spans cover replaced by mark; spans are sorted and may overlap."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0)

    def between(p: Column, a: Column, b: Column) -> Column:
        """The characters from a to b of the text that the pieces make up."""
        part = lambda k: F.substring(F.element_at(p, k + 1), F.greatest(a - k * PIECE, F.lit(0)) + 1, F.least(b - k * PIECE, F.lit(PIECE)) - F.greatest(a - k * PIECE, F.lit(0)))
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        return F.when(b > a, F.concat_ws("", F.transform(F.sequence(first, last), part))).otherwise(F.lit(""))

    def whole(x: Column) -> Column:
        reached = x["reached"]  # how far the spans up to each one cover the text
        made = F.transform(x["spans"], lambda s, i: let(F.when(i > 0, F.try_element_at(reached, i)).otherwise(F.lit(0)), lambda at: F.when(s["start"] >= at, F.concat(between(x["pieces"], at, s["start"]), F.lit(mark))).otherwise(F.lit(""))))
        return F.concat(F.concat_ws("", made), between(x["pieces"], F.element_at(reached, -1), x["length"]))

    reached = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    cut = F.struct(pieces.alias("pieces"), spans.alias("spans"), reached.alias("reached"), F.length(text).alias("length"))
    return F.when(F.size(spans) > 0, let(cut, whole)).otherwise(text)


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """docs with their spans replaced in the text, and n_chars, where there is such a column, counted anew."""
    scanned, names = scan(docs, text)
    out = find(materialize(scanned), names, scope)
    spans = F.col(next(c for c in out.columns if c not in scanned.columns))
    out = out.withColumn(text, redact(F.col(f"`{text}`"), spans, mark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(f"`{text}`").cast("long"), F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
