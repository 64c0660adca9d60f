"""Token files, the Merkle manifest and the prefix trie against plain versions."""

import json
import random
import zlib
from collections import defaultdict
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fundloom.llm import merkle, queries, tokenfiles, trie

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(VOCABULARY)


def crc(x) -> int:
    return zlib.crc32(str(x).encode())


# Token files


def plain_rows(whole, docs):
    """docs in order, as (doc_id, start, n_tokens, ids_crc32)."""
    out, start = [], 0
    for doc_id, text in docs:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_of_the_table(spark, sf, whole):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(map(tuple, queries.op11_token_ids(spark, sf).collect())) == plain_rows(whole, docs)


def test_token_files_of_odd_rows(spark, whole, tmp_path):
    rows = [(5, "Bonjour, l'été!", 0), (None, "null id", 0), (2, None, 0), (7, "", 0), (-3, "a<|endoftext|>b", 1), (9, "x" * 200_000 + " y z" * 50_000, 0), (11, "same", 0), (11, "same", 0), (11, "same", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    folder = str(tmp_path / "tokens")
    parts = tokenfiles.write(docs, VOCABULARY, folder).collect()
    got = sorted(map(tuple, tokenfiles.read(spark, folder).collect()), key=lambda r: r[1])
    assert got == plain_rows(whole, sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)))
    assert sum(p["docs"] for p in parts) == len(rows)
    for p in parts:  # bases are what all earlier parts hold
        assert p["first_tokens"] == sum(q["tokens"] for q in parts if q["part"] < p["part"])
    one = next(p for p in parts if p["first_tokens"] == 0)
    assert tokenfiles.token_ids(folder, one["part"], 0).tolist() == whole.encode("null id", add_special_tokens=False).ids + [1]
    with open(tokenfiles.paths(folder, one["part"])[0], "ab") as f:
        f.write(b"\0\0")
    with pytest.raises(Exception, match="bytes, not"):
        tokenfiles.read(spark, folder).collect()


def test_token_files_of_nothing_and_of_one_hot_id(spark, whole, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfiles.write(none, VOCABULARY, str(tmp_path / "none")).count() == 0 and tokenfiles.read(spark, str(tmp_path / "none")).count() == 0
    hot = spark.range(4000).select(F.lit(3).alias("doc_id"), F.concat(F.repeat(F.lit("ten words of the one id that all rows have "), 60), F.lit("x")).alias("text"))
    parts = tokenfiles.write(hot, VOCABULARY, str(tmp_path / "hot")).collect()
    assert len(parts) >= 4 and max(p["docs"] for p in parts) < 3000
    assert {tuple(r) for r in tokenfiles.read(spark, str(tmp_path / "hot")).select("doc_id", "n_tokens").distinct().collect()} == {(3, 10 * 60 + 2)}
    with pytest.raises(ValueError, match="mounted"):
        tokenfiles.local("hdfs://somewhere/x")


def test_pieces_are_encoded_as_whole_texts_are(whole):
    code, rnd = tokenfiles.Encoder(open(VOCABULARY, encoding="utf-8").read()), random.Random(1)
    some = ["a", "B", "é", "é", "İ", "ı", "'", "'s", "'S", ".", "..", ",", "!", " ", "\n", "\t", "\r", "\x0b", "\x85", "\x1c", " ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "1", "12", "ß", "ſ", "Σ", "ς", "你好", "́", "‍", "😀", "-", "_", "’", "the", "Straße", "ﬁ", "K", "Å", "\x00", "q.", "ŉ", "Ĳ", "%%%", "&", "#"]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 14))) for _ in range(20_000)]
    want = [e.ids + [1] for e in whole.encode_batch(texts, add_special_tokens=False)]
    for plain in (True, False):
        code.plain = plain
        ids, sizes = code.batch(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    other = json.loads(open(VOCABULARY, encoding="utf-8").read()) | {"normalizer": None}
    assert not tokenfiles.Encoder(json.dumps(other)).plain


# Merkle manifest


def plain_tree(nodes):
    """The root, and of each leaf its siblings a level at a time as (left, right)."""
    steps = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        now, under = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for k in range(len(run)):
                for i in below[at + k]:
                    steps[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            now.append(sha256("".join(run).encode()).hexdigest())
            under.append([i for b in below[at : at + 8] for i in b])
        nodes, below = now, under
    return nodes[0], steps


def plain_leaf(row, lower):
    shown = []
    for k, v in enumerate(row):
        v = None if v is None else str(v)
        if k == 4 and lower and v is not None:
            v = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in v)
        shown.append("-" if v is None else f"{len(v.encode())}:{v}")
    return sha256("".join(shown).encode()).hexdigest()


def plain_proofs(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0], plain_leaf(r, False), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    roots, own = [], {}
    for lang in langs:
        leaves = sorted(trees[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        sub, steps = plain_tree([x[1] for x in leaves])
        roots.append(sub)
        own[lang] = leaves, steps, sub
    if not langs:
        return []
    root, lang_steps = plain_tree(roots)
    out = []
    for lang, top in zip(langs, lang_steps, strict=True):
        leaves, steps, sub = own[lang]
        for (doc_id, leaf, row), s in zip(leaves, steps, strict=True):
            path = s + top
            node = plain_leaf(row, doc_id is not None and crc(doc_id) % 3 == 0)
            for a, b in path:
                node = sha256((a + node + b).encode()).hexdigest()
            out.append((doc_id, leaf, sub, root, sha256("".join(a + b for a, b in path).encode()).hexdigest(), node, node == root))
    return out


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


def proofs(docs, **more):
    return merkle.proofs(docs, merkle.tampered(F.col("doc_id")), **more).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_proofs_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(*merkle.FIELDS).collect()
    got = queries.op12_merkle_manifest(spark, sf).collect()
    assert by_text(got) == by_text(plain_proofs(list(map(tuple, rows)))) and {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize(("keep", "fan"), [(4, 16), (1, 2), (2, 3)])
def test_proofs_of_odd_rows(spark, keep, fan):
    rnd = random.Random(keep)
    rows = [(i, rnd.choice([None, "", "s", "é:1"]), rnd.choice([None, "", "de", "fr", "ü"]), rnd.choice([None, 0, 12]), rnd.choice([None, "", "Plain A", "no capital", "ÉÀ", "1:2"])) for i in range(700)]
    rows += [(None, None, None, None, None)] * 3 + [(5, "twice", "de", 1, "Same")] * 20 + [(5, "twice", "de", 1, "Other")] * 2 + [(900, "s", "alone", 1, "X" * 300_000)]
    rows += [(1000 + i, "s", f"lang{i}", 1, "t") for i in range(90)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, part int, tree string").repartition(7)
    assert by_text(proofs(docs, keep=keep, fan=fan).collect()) == by_text(plain_proofs(rows))


def test_proofs_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert proofs(spark.createDataFrame([], schema)).count() == 0
    for n in (1, 2, 8, 9, 64, 65):
        rows = [(i, "s", "de", i, "T") for i in range(n)]
        assert by_text(proofs(spark.createDataFrame(rows, schema), keep=1).collect()) == by_text(plain_proofs(rows))


def test_forests_merge_in_any_order():
    rnd = random.Random(3)
    for n in (1, 7, 8, 9, 63, 64, 65, 700):
        leaves = [sha256(str(i).encode()).hexdigest() for i in range(n)]
        parts = [merkle.Forest(0) for _ in range(9)]
        for i, x in enumerate(leaves):
            rnd.choice(parts).add("t", n, 0, i, x, True)
        while len(parts) > 1:
            rnd.shuffle(parts)
            parts.append(parts.pop().merge(parts.pop()))
        (only,) = parts
        assert not list(only.open()) and [x[4] for x in only.made if merkle.width(n, x[2]) == 1] == [plain_tree(leaves)[0]]
        assert len({x[:4] for x in only.made}) == len(only.made)


# Prefix trie


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    nodes, last = defaultdict(list), defaultdict(list)
    for c in turns:
        h = crc(c) % 9
        whole = turns.get(c - int(np.fmod(c, 5)), [])[:h] + turns[c][h:]
        for d in range(len(whole) + 1):
            nodes[tuple(whole[:d])].append(c)
        last[tuple(whole)].append(c)
    below = defaultdict(list)
    for x in nodes:
        if x:
            below[x[:-1]].append(x)
    out = {}
    for x in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[x]) - 1) * (len(x[-1][1].encode()) if x else 0) + sum(out[y][6] for y in below[x])
        leaves = sum(out[y][5] for y in below[x]) or 1
        ids = ",".join(map(str, sorted(last[x]))) if x in last else ""
        out[x] = (min(nodes[x]), len(x), min(nodes[x[:-1]]) if x else None, len(nodes[x]), len(below[x]), leaves, saved, sha256(ids.encode()).hexdigest())
    return by_text(out.values())


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert by_text(queries.op13_prefix_trie(spark, sf).collect()) == plain_trie(list(map(tuple, rows)))


def odd_turns(seed, n=1500):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, -7, -3, *range(60), *range(200, 220)]), rnd.choice([None, *range(9)]), rnd.choice([None, "", "user", "bot"]), rnd.choice([None, "", "a", "b", "é", "a"])) for _ in range(n)]
    rows += [(300, i, "user", "long") for i in range(400)] + [(304, i, "user", "long") for i in range(380)] + [(305, 0, "u", "x" * 300_000)]
    return rows + [(c, t, "u", "copy") for c in range(1000, 1200) for t in range(3)]


def test_trie_of_odd_rows(spark):
    rows = odd_turns(1)
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], TURNS + ", depth int, split int").repartition(5)
    assert by_text(trie.prefix_trie(turns).collect()) == plain_trie(rows)


def test_trie_splits_collisions(spark):
    """With a hash that has three values, and polynomials modulo 5 and 7, most candidate groups hold several sequences."""
    rows = [r for r in odd_turns(2, 400) if r[0] is None or r[0] < 300]
    turns = spark.createDataFrame(rows, TURNS)
    assert by_text(trie.prefix_trie(turns, lambda role, text: F.pmod(F.xxhash64(role, text), F.lit(3)), (5, 7)).collect()) == plain_trie(rows)


def test_trie_of_nothing_and_of_one(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    for rows in ([(0, 0, "u", "a")], [(1, 0, "u", "a")], [(4, 0, "u", "a"), (0, 0, "u", "b")], [(2, None, None, None)] * 12):
        assert by_text(trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()) == plain_trie(rows)


# Components


@pytest.mark.parametrize("hub", [10_000, 5, 1])
def test_components_with_hubs(spark, monkeypatch, hub):
    from fundloom.llm import components

    monkeypatch.setattr(components, "HUB", hub)
    rnd = random.Random(9)
    edges = [(0, i) for i in range(1, 80)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(40)] + [(i, i + 1) for i in range(200, 240)] + [(300, 300), (500, 501), (501, 500), (90, 79), (90, 91)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    got = {(r["node"], r["root"]) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(x, find(x)) for x in list(root)}
