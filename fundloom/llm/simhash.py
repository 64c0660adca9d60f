"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two fingerprints of eight bytes that differ in three bits or fewer share at least five bytes in place, for a bit spoils one byte at
most. The inverted index is filed under (positions, bytes) of fourfold sets of the eight positions: a posting's key then has 32 bits, not 8,
and lists don't grow with the corpus as those of single bytes would. The sets are two Steiner systems S(3, 4, 8) without a common set;
of each, exactly one set misses any three spoilt positions. So a pair to be found shares two postings at least. For each pair that
meets, the shared postings are tallied; pairs under the guaranteed two are dropped, the rest are verified by their differing bits. Links
are between distinct fingerprints only, copies join by equality; each posting's least print is linked first, then pairs across classes.

``near_duplicates`` is for texts whose sets of five-word shingles have a cosine of at least 0.8, the similarity that a SimHash
estimates; all texts of a Jaccard similarity of 0.8 are among them. A 64-bit SimHash puts such texts nine bits apart and more,
so three bits miss most of them; there the positional bytes are min-wise ones (each of 64 positions holds a byte of the
least shingle hash under its own permutation), filed by threes of positions and held against postings' pivots; verification is exact on shingles.
``deduplicated`` takes both: the classes of op8's fingerprints, by their index and tally, and then what is similar but differs in more bits.

Defined results: a null text is empty; texts without words have fingerprint zero and are linked like any other; repeated rows are in one
component; a component's id is its smallest doc_id, null only if all are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts
from .common import discard, free_name, materialize, settled, shuffled
from .components import components

SEED, SHINGLE, BYTES, MAX_BITS = 42, 3, 8, 3
#: The blocks of S(3, 4, 8), fourfold sets of positions whose exclusive or is zero, and of one made from it by renaming positions.
FIRST = {frozenset(b) for b in combinations(range(BYTES), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0}
SECOND = next(r for p in permutations(range(BYTES)) if not (r := {frozenset(p[i] for i in b) for b in FIRST}) & FIRST)
BLOCKS = sorted(tuple(sorted(b)) for b in FIRST | SECOND)
#: So many postings any two fingerprints share that differ in MAX_BITS bits.
LEAST_SHARED = min(sum(not set(b) & set(spoilt) for b in BLOCKS) for spoilt in combinations(range(BYTES), MAX_BITS))

WORDS, SIMILAR = 5, 0.8
#: Min-wise positions, in BANDS postings of ROWS positions each (the last position is in none). Of texts of cosine 0.8 whose Jaccard
#: similarity is the least possible, 0.64, one pair in 600 meets in none; of those of Jaccard 0.8 one in three million.
POSITIONS, ROWS = 64, 3
BANDS = POSITIONS // ROWS
#: A pair of Jaccard similarity 0.64 shares 41 of 64 positions on average, with a standard deviation of 3.8; fewer than this is under one in 10,000.
LEAST_POSITIONS = 26
#: So many texts of a posting are held against all of its texts, before any others.
PIVOTS = 3
#: A shingle that so many texts or fewer have is rare: all pairs of its texts are looked at.
RARE = 16
#: Texts are filed by size in classes, each a tenth wider than the one before.
SIZE_STEP = 1.1
MULTIPLIERS = [(xxhash.xxh64_intdigest(str(i).encode(), 1) | 1, xxhash.xxh64_intdigest(str(i).encode(), 2)) for i in range(POSITIONS)]


def hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of the k-word shingles in order, repeats included; of the whole sequence if it has fewer words; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    runs = zip(*[words[i:] for i in range(k)], strict=False)
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs), dtype=np.uint64, count=len(words) - k + 1)


def fingerprint(text: str | None) -> tuple[int]:
    """The 64 majority bits, as a signed long."""
    h = hashes(text, SHINGLE)
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        bits += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return (int.from_bytes(np.packbits(2 * bits > len(h)).tobytes(), "big", signed=True) if len(h) else 0,)


def filed(prints: DataFrame) -> DataFrame:
    """prints(fp), each once, as fp, block and bytes: its 28 postings."""
    masks = [sum(255 << 8 * i for i in b) for b in BLOCKS]
    keys = [F.struct(F.lit(n).alias("block"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m)).alias("bytes")) for n, m in enumerate(masks)]
    return prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.block", "k.bytes")


def close(u: Column, v: Column) -> Column:
    return F.bit_count(u.bitwiseXOR(v)) <= MAX_BITS


def star_links(prints: DataFrame) -> DataFrame:
    """prints(fp), each once, to u and v: each with the least of a posting, where they differ in MAX_BITS or fewer bits."""
    posted = filed(prints)
    least = posted.groupBy("block", "bytes").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).filter("v < most").drop("most")
    return posted.withColumnRenamed("fp", "u").join(shuffled(least), ["block", "bytes"]).filter((F.col("u") != F.col("v")) & close(F.col("u"), F.col("v"))).select("u", "v").distinct()


def links(prints: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """prints(fp), each once, to u and v, those that differ in MAX_BITS or fewer bits. All links are found; with roots(key, root), all those between classes."""
    posted = filed(prints)
    if roots is None:
        posted = posted.withColumn("root", F.col("fp"))
    else:
        posted = posted.join(shuffled(roots.withColumnRenamed("key", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        several = posted.groupBy("block", "bytes").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("block", "bytes")
        posted = posted.join(shuffled(several), ["block", "bytes"])
    a, b = posted.select("block", "bytes", F.col("fp").alias("u"), F.col("root").alias("ur")), posted.select("block", "bytes", F.col("fp").alias("v"), F.col("root").alias("vr"))
    tally = a.join(shuffled(b), ["block", "bytes"]).filter((F.col("u") > F.col("v")) & (F.col("ur") != F.col("vr"))).groupBy("u", "v").agg(F.count("*").alias("shared"))
    return tally.filter(F.col("shared") >= LEAST_SHARED).filter(close(F.col("u"), F.col("v"))).select("u", "v")


def print_classes(prints: DataFrame) -> DataFrame:
    """prints(fp), each once, to key and root, the least print that links lead to; prints without a link don't occur.

    Prints of a posting are first linked with its least one. Only where a posting then still holds several classes are pairs
    across them tallied, so the prints of one cluster, which may be tens of thousands, aren't held against each other.
    """
    roots = materialize(components(star_links(prints)).select(F.col("node").alias("key"), "root"))
    return merged(roots, links(prints, roots))


def linked(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as doc_id, fingerprint, component_id."""
    prints = materialize(map_texts(docs.select("doc_id", "text"), fingerprint, "fp long"))
    own = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = print_classes(own.select("fp")).withColumnRenamed("key", "fp")
    rooted = own.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None) -> np.ndarray:
    """The distinct hashes of WORDS-word shingles; texts without words share one of their own."""
    h = np.unique(hashes(text, WORDS))
    return h if len(h) else np.zeros(1, dtype=np.uint64)


def sketch(text: str | None) -> tuple[int, list[int], list[int]]:
    """How many distinct shingles there are; a byte of the least shingle hash at each position, eight a word; the posting keys, hashes of ROWS least hashes each."""
    h = shingle_hashes(text)
    least = np.empty(POSITIONS, dtype=np.uint64)
    for i, (a, b) in enumerate(MULTIPLIERS):
        least[i] = (h * np.uint64(a) + np.uint64(b)).min()
    keys = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)]
    return len(h), (least >> np.uint64(24)).astype(np.uint8).view(np.int64).tolist(), keys


def shingle_set(text: str | None) -> tuple[list[int]]:
    return (shingle_hashes(text).view(np.int64).tolist(),)


def differing_bytes(a: Column, b: Column) -> Column:
    """In how many positional bytes two longs differ: each byte is folded to its lowest bit, then the bits are counted."""
    x = a.bitwiseXOR(b)
    for k in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, k))
    return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def differing(a: Column, b: Column) -> Column:
    """In how many positional bytes two sketches differ."""
    return sum((differing_bytes(a["words"][i], b["words"][i]) for i in range(1, POSITIONS // 8)), differing_bytes(a["words"][0], b["words"][0]))


def plausible(a: Column, b: Column, similar: float) -> Column:
    """Whether two sketches share enough positional bytes, and their sizes allow the similarity."""
    n, m = a["n"], b["n"]
    return (F.least(n, m) >= F.lit(similar * similar) * F.greatest(n, m) - 1e-9) & (differing(a, b) <= POSITIONS - LEAST_POSITIONS)


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Of pairs(u, v), each once, those whose shingle sets have at least the cosine."""
    side = lambda key, name: sets.select(F.col("key").alias(key), F.col("shingles").alias(name))
    cut = pairs.select("u", "v").join(side("u", "a"), "u").join(side("v", "b"), "v")
    common = F.size(F.array_intersect("a", "b"))
    return materialize(cut.filter(common >= F.lit(similar) * F.sqrt(F.size("a").cast("double") * F.size("b")) - 1e-9).select("u", "v"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots(key, root), of linked texts, after links(u, v) between texts have joined their classes."""
    of = lambda name: roots.select(F.col("key").alias(name), F.col("root").alias(f"{name}_root"))
    ends = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    found = materialize(components(ends))
    old = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left").select("key", F.coalesce("now", "root").alias("root"))
    new = found.select(F.col("node").alias("key"), "root").join(roots.select("key"), "key", "left_anti")
    return materialize(old.unionByName(new))


def apart(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Of links(u, v) those between texts of different classes."""
    of = lambda name: roots.select(F.col("key").alias(name), F.col("root").alias(f"{name}_root"))
    return links.join(of("u"), "u", "left").join(of("v"), "v", "left").filter(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")


def postings(drawn: DataFrame) -> DataFrame:
    """drawn(key, n, words, keys) as bucket and of, a text's sketch with ``near``, how many texts it meets; only of buckets with two texts or more."""
    posted = drawn.select("key", F.explode("keys").alias("bucket"))
    shared = posted.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    posted = materialize(posted.join(shuffled(shared), "bucket"))
    near = posted.groupBy("key").agg(F.sum("size").alias("near"))
    of = drawn.join(shuffled(near), "key").select("key", F.struct("key", "n", "words", "near").alias("of"))
    out = materialize(posted.select("bucket", "key").join(shuffled(of), "key").select("bucket", "of"))
    discard(posted)
    return out


def near_pivots(posted: DataFrame, similar: float) -> DataFrame:
    """u, a text, and tried, the pivots of its postings that are plausible partners, the likeliest first: PIVOTS * BANDS at most."""
    seeded = [F.min(F.struct(F.xxhash64(F.lit(i), "of.key").alias("h"), "of"))["of"] for i in range(PIVOTS - 1)]
    pivots = [F.max(F.struct(F.col("of.near").alias("near"), F.col("of.key").alias("key"), "of"))["of"], *seeded]
    chosen = posted.groupBy("bucket").agg(F.array_distinct(F.array(*pivots)).alias("pivots"))
    met = posted.join(shuffled(chosen), "bucket").select("of", F.explode("pivots").alias("pivot")).filter(F.col("of.key") != F.col("pivot.key")).filter(plausible(F.col("of"), F.col("pivot"), similar))
    one = F.struct(differing(F.col("of"), F.col("pivot")).alias("differ"), (-F.col("pivot.near")).alias("near"), F.col("pivot.key").alias("v"))
    return met.groupBy(F.col("of.key").alias("u")).agg(F.array_sort(F.collect_set(one)).alias("tried"))


def shared_shingles(placed: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of placed(key, root): texts, with n (shingles), often (those that more than RARE of the texts have) and common (those that another one has);
    and rare, the shingles h that two to RARE of them have, with the text's key, root, n and often."""
    label = [F.xxhash64("key").alias("a"), F.xxhash64("key", F.lit(1)).alias("b")]
    own = materialize(sets.join(placed, "key").select("key", "root", "shingles", *label))
    held = own.select("a", "b", F.explode("shingles").alias("h"))
    met = materialize(held.join(shuffled(held.groupBy("h").agg(F.count("*").alias("texts")).filter("texts > 1")), "h"))
    tally = met.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum((F.col("texts") > RARE).cast("long")).alias("often"))
    texts = own.select("key", "root", "a", "b", F.size("shingles").cast("long").alias("n")).join(shuffled(tally), ["a", "b"])
    texts = materialize(texts)
    return texts, met.filter(F.col("texts") <= RARE).select("h", "a", "b").join(shuffled(texts), ["a", "b"]).select("h", "key", "root", "n", "often", "common")


def enough(common: Column, n: Column, m: Column, similar: float) -> Column:
    return common >= F.lit(similar) * F.sqrt(n.cast("double") * m) - 1e-9


def by_rare_shingles(rare: DataFrame, similar: float) -> DataFrame:
    """u and v, the pairs of different classes with a rare shingle in common that have enough in common if all their frequent ones are."""
    able = rare.filter(F.col("common") >= F.lit(similar * similar) * F.col("n") - 1e-9).drop("common")
    x, y = (able.select("h", *[F.col(c).alias(side + c) for c in ("key", "root", "n", "often")]) for side in "xy")
    met = x.join(shuffled(y), "h").filter((F.col("xkey") > F.col("ykey")) & (F.col("xroot") != F.col("yroot")))
    met = met.groupBy("xkey", "ykey", "xn", "yn", "xoften", "yoften").agg(F.count("*").alias("met"))
    return met.filter(enough(F.col("met") + F.least("xoften", "yoften"), F.col("xn"), F.col("yn"), similar)).select(F.col("xkey").alias("u"), F.col("ykey").alias("v"))


def size_class(n: Column) -> Column:
    return F.floor(F.log(F.greatest(n.cast("double"), F.lit(1.0))) / float(np.log(SIZE_STEP)))


def by_frequent_shingles(placed: DataFrame, similar: float) -> DataFrame:
    """u and v, the pairs of different classes in one bucket of placed(bucket, of, root, often) whose frequent shingles alone can be enough.

    Then a text of n shingles, ``often`` of them frequent, has a partner of often * often / (similar * similar * n) shingles at most. A text x
    looks for smaller ones in the classes of size that it can reach; a text y is found if it reaches that of x. Which classes of
    near-duplicates meet in such a cell is found first, so texts of one class aren't held against each other.
    """
    n, squared = F.col("of.n"), F.lit(similar * similar)
    least = n * squared - F.lit(1e-9)
    placed = placed.withColumn("most", F.floor(F.col("often") * F.col("often") / (squared * n) + F.lit(1e-9))).filter(F.col("most") >= least)
    x = placed.select("bucket", F.explode(F.sequence(size_class(least), size_class(F.least(n, F.col("most"))))).alias("cell"), F.col("of").alias("x"), F.col("root").alias("xr"), F.col("most").alias("x_most"))
    y = placed.filter(F.col("most") >= n).select("bucket", size_class(n).alias("cell"), F.col("of").alias("y"), F.col("root").alias("yr"), F.col("most").alias("y_most"))
    meet = x.select("bucket", "cell", "xr").distinct().join(shuffled(y.select("bucket", "cell", "yr").distinct()), ["bucket", "cell"]).filter("xr <> yr")
    smaller = F.struct(F.col("y.n"), F.col("y.key")) < F.struct(F.col("x.n"), F.col("x.key"))
    fits = smaller & (F.col("y.n") <= F.col("x_most")) & (F.col("x.n") <= F.col("y_most"))
    held = x.join(shuffled(meet), ["bucket", "cell", "xr"]).join(shuffled(y), ["bucket", "cell", "yr"]).filter(fits).filter(plausible(F.col("x"), F.col("y"), similar))
    return held.select(F.col("x.key").alias("u"), F.col("y.key").alias("v"))


def across(posted: DataFrame, roots: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """u and v, the pairs of different classes that may still be similar: of texts in buckets where several classes meet.

    What two texts share is rare shingles, which an index finds with RARE texts or fewer a shingle, and frequent ones, of which they share no
    more than either has. A family of copies that aren't near enough to each other has few frequent shingles a text, so it isn't compared pair by pair.
    """
    placed = posted.select(F.col("of.key").alias("key"), "bucket", "of").join(roots, "key", "left").select("bucket", "of", "key", F.coalesce("root", "key").alias("root"))
    several = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).filter("lo < hi and size > 2").select("bucket")
    placed = materialize(placed.join(shuffled(several), "bucket"))
    texts, rare = shared_shingles(placed.select("key", "root").distinct(), sets)
    frequent = by_frequent_shingles(placed.join(shuffled(texts.select("key", "often")), "key"), similar)
    return materialize(by_rare_shingles(rare, similar).unionByName(frequent).distinct())


def sketch_and_print(text: str | None) -> tuple[int, list[int], list[int], int]:
    return *sketch(text), *fingerprint(text)


def print_links(texts: DataFrame) -> DataFrame:
    """texts(key, fp), each key once, to u and v: each text with the least one of its class of fingerprints. The classes are those of op8."""
    prints = materialize(texts.groupBy("fp").agg(F.min("key").alias("least"), F.max("key").alias("most")))
    found = print_classes(prints.select("fp")).withColumnRenamed("key", "fp")
    rooted = prints.join(shuffled(found), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("v"), F.max("most").alias("most")).filter("v < most")
    of = rooted.select("fp", "root").join(shuffled(heads.select("root", "v")), "root").select("fp", "v")
    return texts.select(F.col("key").alias("u"), "fp").join(shuffled(of), "fp").filter("u <> v").select("u", "v")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, prints: bool = False) -> DataFrame:
    """docs(doc_id, text) to key (the text's md5) and root (the least key of its class), one row a distinct text.

    With prints, texts that the inverted index of SimHash fingerprints links are of one class beforehand; what follows finds the similar texts that differ in more bits.

    First each text is held against the likeliest pivot of its postings, then against those other pivots that are in another class.
    The pivot that meets most texts is, in a family of copies, their original. Only then are texts of one posting that are still in
    different classes held against each other, where sizes and what they share with any text at all leave room for a link. So a large
    group of near copies costs a few comparisons a text, a text that only shares a passage with many is ruled out by its own
    words, and no link that matters for the classes is passed over.
    """
    keyed = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), "text")
    fields = ["n long", "words array<long>", "keys array<long>"] + ["fp long"] * prints
    drawn = map_texts(keyed, sketch_and_print if prints else sketch, ", ".join(fields))
    drawn = materialize(drawn.groupBy("key").agg(*[F.first(c).alias(c) for c in (f.split()[0] for f in fields)]))
    roots = materialize(components(print_links(drawn.select("key", "fp"))).select(F.col("node").alias("key"), "root")) if prints else None
    posted = postings(drawn)
    tried = materialize(near_pivots(posted, similar))
    texts = keyed.groupBy("key").agg(F.first("text").alias("text")).join(posted.select("of.key").distinct(), "key", "left_semi")
    sets = materialize(map_texts(texts, shingle_set, "shingles array<long>"))
    first = tried.select("u", F.col("tried")[0]["v"].alias("v"))
    if prints:
        roots = merged(roots, verified(apart(first, roots), sets, similar))
    else:
        roots = materialize(components(verified(first, sets, similar)).select(F.col("node").alias("key"), "root"))
    others = tried.select("u", F.explode(F.slice("tried", 2, PIVOTS * BANDS)).alias("p")).select("u", F.col("p.v").alias("v"))
    roots = merged(roots, verified(apart(others, roots), sets, similar))
    roots = merged(roots, verified(across(posted, roots, sets, similar), sets, similar))
    discard(posted, tried, sets)
    return drawn.select("key").join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"))


def deduplicated(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of docs for each class of near-duplicate texts, by fingerprints or similarity: the one with the least doc_id (null last), then the least other values, then md5."""
    names = []
    for name in ("text_key", "stay_key", "stay_row"):
        names.append(free_name([*docs.columns, *names], name))
    key, stay_key, stay_row = names
    classes = settled(lambda: near_duplicates(docs.select("doc_id", "text"), similar, prints=True))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    told = [F.col("doc_id").isNull().alias("_null_id"), F.col("doc_id").alias("_id"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rest)]]
    keyed = docs.withColumn(key, F.md5(F.coalesce("text", F.lit(""))))
    rows = keyed.select(F.col(key).alias("key"), F.struct(*told, F.col(key).alias("_key")).alias("row")).groupBy("key").agg(F.min("row").alias("row"))
    best = classes.join(rows, "key").groupBy("root").agg(F.min("row").alias("row")).select("row.*")
    same = F.struct(F.col("_id"), *[F.col(f"_c{i}") for i in range(len(rest))])
    best = materialize(best.select(F.col("_key").alias(stay_key), same.alias(stay_row)))
    own = F.struct(F.col("doc_id"), *[F.col(f"`{c}`") for c in rest])
    kept = keyed.join(best, (F.col(key) == F.col(stay_key)) & own.eqNullSafe(F.col(stay_row)), "left_semi")
    return kept.dropDuplicates([key]).drop(key)
