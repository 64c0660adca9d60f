"""The numbered queries against brute-force versions, on the smallest tables with odd rows added."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from fundloom.llm import langid, licences, quality, queries, rules, simhash, textstats

W = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "one", "two words", "a b c a b c a b c", "x " * 30000, "É\u0085É\xa0b\x1cc\n\nÉ\u0085É\xa0b\x1cc", "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\n" + "word " * 60, "cc by cc BY general public license all rights reserved"]


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    """The smallest tables, with null, empty, very long, tied and repeated rows, and a column more that clashes with results."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([Row(doc_id=10_000 + i, text=t, lang=[None, "en"][i % 2], source=[None, "src0"][i % 2], n_chars=None if t is None else len(t)) for i, t in enumerate(ODD)] + [Row(doc_id=None, text="no id at all", lang=None, source=None, n_chars=12)], docs.schema)
    docs.unionByName(odd).unionByName(docs.filter("doc_id < 3")).withColumn("score", F.lit("clash")).withColumn("key", F.lit(1)).write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "pages", "benchmark", "conversations"):
        spark.read.parquet(f"{sf}/{t}.parquet").withColumn("fp", F.lit("clash")).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages", "benchmark", "conversations"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.fixture(scope="module")
def docs(spark, tables):
    return [r.asDict() for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_empty_tables_give_empty_results(spark, empty, name):
    f = {**queries.QUERIES, "pipeline": corpus_pipeline.run}[name]
    assert f(spark, empty).count() == 0


def crc(i, k):
    return zlib.crc32(str(i).encode()) % k


def test_language_id(spark, tables, docs):
    got = queries.op1_language_id(spark, tables).collect()
    assert len(got) == len(docs)
    lang, text = {r["doc_id"]: r["lang"] for r in docs}, {r["doc_id"]: r["text"] for r in docs}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is None or crc(r["doc_id"], 4) == 2)
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text[r["doc_id"]] or ""))) and 0 <= r["score"] <= 1
    tested = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 10_000]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in tested) >= 0.97 * len(tested)


def test_language_sample_counts_distinct_texts(spark):
    copies = spark.range(4000).select(F.concat(F.lit("abc "), F.translate((F.col("id") % 5).cast("string"), "01234", "vwxyz")).alias("text"), F.lit("copied").alias("lang"))
    single = spark.range(4000).select(F.concat(F.lit("def "), F.col("id").cast("string")).alias("text"), F.lit("single").alias("lang"))
    n = collections.Counter(r[0] for r in langid.sample(copies.unionByName(single), rows=100))
    assert n["copied"] == 5 and 60 <= n["single"] <= 150
    assert set(langid.fit(copies.unionByName(single), rows=100)["langs"]) == {"copied", "single"}


def test_any_number_of_languages(spark):
    """With more than LANGS languages the most taught are learned, and every text gets one of them; the sample keeps its bounds."""
    n = langid.LANGS + 40
    rows = [(f"{chr(0x4E00 + k)}{chr(0x5000 + k)} " * (3 + i), f"lang{k:04d}") for k in range(n) for i in range(2 + (k < langid.LANGS))]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    got = langid.identify(docs, F.lit(False)).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} <= {f"lang{k:04d}" for k in range(langid.LANGS)}
    right = sum(r["lang_pred"] == rows[r["doc_id"]][1] for r in got)
    assert right >= 0.8 * 3 * langid.LANGS


def test_language_sample_keeps_its_bounds(spark, monkeypatch):
    docs = spark.range(3000).select(F.concat(F.lit("text "), F.col("id").cast("string"), F.repeat(F.lit(" abc"), (F.col("id") % 9).cast("int"))).alias("text"), (F.col("id") % 3).cast("string").alias("lang"))
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 300)
    assert 220 <= len(langid.sample(docs)) <= 380
    monkeypatch.setattr(langid, "SAMPLE_PAIRS", 2000)
    assert 0 < sum(len(r[2]) for r in langid.sample(docs)) <= 3000


def test_ngrams_do_not_depend_on_stretches(monkeypatch):
    text = "Où est-ce que le café? " * 40
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "STRETCH", 7)
    parts = langid.grams(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def grams_by_hand(text):
    """N-grams of one to three characters in a dictionary, then their buckets by plain integers."""
    plain = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    out, low = collections.Counter(), (1 << 32) - 1
    for k in (1, 2, 3):
        for i in range(len(plain) - k + 1):
            c = list(map(ord, plain[i : i + k]))
            two = c[0] * 0x9E3779B1 + c[1] * 0x85EBCA77 if k > 1 else 0
            h = (c[0] * 0xC2B2AE3D if k == 1 else two if k == 2 else (two & low) * 0x27D4EB2F + c[2] * 0x165667B1) & low
            out[((h ^ h >> 15) * 0x2C1B3C6D & low) >> (32 - langid.BITS)] += 1
    return out


def test_ngrams_by_hand():
    for text in ("Où est-ce que le café?", "a", "ß 12 x", "The quick, brown fox; it's 10 o'clock"):
        found, times = langid.grams(text)
        assert dict(zip(found.tolist(), times.tolist(), strict=True)) == grams_by_hand(text)


def test_training_by_hand():
    """FTRL-proximal coordinate by coordinate, in plain Python."""
    rnd = random.Random(1)
    rows = [(rnd.randrange(3), sorted(rnd.sample(range(30), 6)), [rnd.random() for _ in range(6)]) for _ in range(40)]
    z, n, alpha, beta, l1, l2 = collections.defaultdict(float), collections.defaultdict(float), langid.ALPHA, langid.BETA, langid.L1, langid.L2
    w = lambda i, c: 0.0 if abs(z[i, c]) <= l1 else -(z[i, c] - math.copysign(l1, z[i, c])) / ((beta + math.sqrt(n[i, c])) / alpha + l2)
    for _ in range(langid.EPOCHS):
        for y, at, x in rows:
            old = {(i, c): w(i, c) for i in at for c in range(3)}
            e = [math.exp(sum(v * old[i, c] for i, v in zip(at, x, strict=True))) for c in range(3)]
            for i, v in zip(at, x, strict=True):
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == y))
                    z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / alpha * old[i, c]
                    n[i, c] += g * g
    got = langid.train([(y, np.array(at), np.array(x)) for y, at, x in rows], 3)
    assert all(got[i, c] == pytest.approx(w(i, c), abs=1e-9) for i in range(31) for c in range(3))


def test_trees_one_walk_a_row():
    rnd = np.random.default_rng(5)
    x = rnd.random((600, 4)).round(2)
    y = ((x[:, 0] > 0.4) & (x[:, 2] < 0.7)).astype(float)
    m = quality.grow(x, y)
    got = quality.scores(m, x)
    for row, score in zip(x, got, strict=True):
        total = m["base"]
        for at in m["roots"]:
            while m["feature"][at] != quality.LEAF:
                at = m["left"][at] if row[m["feature"][at]] <= m["threshold"][at] else m["right"][at]
            total += m["value"][at]
        assert score == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((got > 0.5) == (y == 1)).mean() > 0.97


def test_copies_teach_a_model(spark):
    """400 labelled rows of 4 distinct statistics, with a bound of 40: all four are learned from, by their mean labels."""
    for k in range(6):
        rows = [([float(i % 4 + k)] * len(textstats.FEATURES), float(i % 4 > 1)) for i in range(400)]
        model = quality.fit(spark.createDataFrame(rows, "x array<double>, y double"), 40)
        assert model is not None and abs(model["base"]) < 1e-9
    one = quality.fit(spark.createDataFrame([([float(i)] * len(textstats.FEATURES), 1.0) for i in range(50)], "x array<double>, y double"), 1)
    assert quality.scores(one, np.zeros((1, len(textstats.FEATURES))))[0] > 0.7


def test_growth_of_trees_by_hand():
    """A plain version: every split of every node by trying all cuts between the bins' edges."""
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 12, (300, 3)).astype(float)
    y = (x[:, 0] + rnd.normal(0, 2, 300) > 6).astype(float)
    model = quality.grow(x, y)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for j in range(3)]
    f = np.full(300, model["base"])

    def leaf_values(rows, g, h, depth, out):
        gs, hs, best, cut = g[rows].sum(), h[rows].sum(), 1e-6, None
        for j in range(3) if depth < quality.DEPTH else ():
            for e in edges[j]:
                left, right = rows[x[rows, j] <= e], rows[x[rows, j] > e]
                if min(len(left), len(right)) < quality.LEAST_LEAF:
                    continue
                part = lambda r: g[r].sum() ** 2 / (h[r].sum() + quality.SHRINK)
                gain = part(left) + part(right) - gs**2 / (hs + quality.SHRINK)
                if gain > best + 1e-9:
                    best, cut = gain, (left, right)
        if cut is None:
            out[rows] = quality.RATE * gs / (hs + quality.SHRINK)
        else:
            for r in cut:
                leaf_values(r, g, h, depth + 1, out)

    for k in range(5):
        p = 1 / (1 + np.exp(-f))
        out = np.zeros(300)
        leaf_values(np.arange(300), y - p, p * (1 - p), 0, out)
        f += out
        part = dict(model, roots=model["roots"][: k + 1])
        assert quality.scores(part, x) == pytest.approx(1 / (1 + np.exp(-f)), abs=1e-9)


def test_binomial_tails():
    for n, k, p in ((50, 3, 0.02), (50, 0, 0.02), (10, 9, 0.3), (10, 10, 0.3), (400, 12, 0.05), (400, 40, 0.05), (7, -1, 0.5)):
        want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert rules.binomial_below(k, n, p) == pytest.approx(want, rel=1e-10, abs=1e-300)
    assert rules.binomial_below(10**7 - 10**4, 10**9, 0.01) == pytest.approx(0.00074, rel=0.02)  # a normal deviate of -3.178


def test_quality_classifier(spark, sf, tables, docs):
    got = queries.op2_quality_classifier(spark, tables).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is None or crc(r["doc_id"], 3) == 1) for r in got)
    big = sf.replace("0.001", "0.01")
    mark = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    tested = [(mark[r["doc_id"]], r["score"]) for r in queries.op2_quality_classifier(spark, big).collect() if r["held_out"] and r["doc_id"] in mark]
    bad, good = [s for y, s in tested if y == 0], [s for y, s in tested if y == 1]
    assert sum((b < g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good)) > 0.9


def base_counts(text):
    words = W.findall(text or "")
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    times = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for k in range(3)}
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_rules(spark, tables, docs):
    got = queries.op3_quality_rules(spark, tables).collect()
    want = [(r["doc_id"], *(c := base_counts(r["text"])), c[0] < 50 or 100 * c[4] > 50 * c[0]) for r in docs]
    same([tuple(r)[:7] for r in got], want)
    assert all(r["kept"] == (not r["base_failed"] and not r["failed"]) for r in got)


def test_cutoffs_are_controlled():
    assert rules.binomial_below(0, 10, 0.1) == pytest.approx(0.9**10)
    assert rules.binomial_below(3, 50, 0.2) == pytest.approx(sum(math.comb(50, i) * 0.2**i * 0.8 ** (50 - i) for i in range(4)))
    cells = [(0, 5000, 10), (40, 2, 300), (70, 0, 200)]
    cut = rules.chosen(cells, 0.01, 0.001)
    assert cut is not None and cut < 40
    assert rules.chosen([(0, 100, 0), (70, 0, 50)], 0.01, 0.001) is None  # too few to be sure
    assert rules.chosen([(0, 85, 0), (70, 0, 50)], 0.05, 0.05 / 4) is None and rules.chosen([(0, 86, 0), (70, 0, 50)], 0.05, 0.05 / 4) is not None


def test_copies_are_one_trial(spark):
    """85 good texts are too few with four strata, and no number of copies or of labels makes them enough; 86 are enough."""
    for n, found in ((85, 0), (86, 1)):
        rows = [(lang, f"{lang}{i % n}", [0.0] * 6, 1) for lang in ("a", "b", "c", "d") for i in range(n if lang == "a" else 3)] * 9
        rows += [("a", f"bad{i}", [0.3, 0, 0, 0, 0, 0], 0) for i in range(20)]
        df = spark.createDataFrame([(s, k, list(map(float, m)), q) for s, k, m, q in rows], "stratum string, text_key string, measures array<double>, quality int")
        assert rules.thresholds(df).count() == found


def kept_by_hand(docs, labels):
    """Of each document, in order, whether the base rules and the cutoffs keep it: by counting over distinct texts."""
    marks = collections.defaultdict(list)
    for r in labels:
        if r["quality"] is not None and r["doc_id"] is not None:
            marks[r["doc_id"]].append(r["quality"])
    strain, good = [], collections.defaultdict(dict)
    for r in docs:
        m = rules.measure(r["text"])
        strain.append((max(x / s for x, s in zip(m[5], rules.SCALES, strict=True)), m[0] < 50 or 100 * m[4] > 50 * m[0]))
        told = marks[r["doc_id"]] if r["doc_id"] is not None else []
        if told and not strain[-1][1]:
            known = good[r["lang"] or ""].get(r["text"], (0, 0))[0]
            good[r["lang"] or ""][r["text"]] = max(known, *told), strain[-1][0]
    cuts = {}
    for lang, texts in good.items():
        best = 0
        for j in range(rules.GRID - 1, -1, -1):
            over = [g for g, s in texts.values() if s > j / rules.STEPS + 1e-9]
            n, k = sum(g for g, _ in texts.values()), sum(over)
            if not n or sum(math.comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1)) > 0.05 / len(good):
                break
            if len(over) - k - 10 * k > best:
                best, cuts[lang] = len(over) - k - 10 * k, j / rules.STEPS
    return [not (failed or s > cuts.get(r["lang"] or "", 1e9) + 1e-9) for r, (s, failed) in zip(docs, strain, strict=True)]


def test_cutoffs_against_counting(spark, sf):
    """The rejected documents of a table whose labels suffice; what the method adds to the base rules."""
    big = sf.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet").collect() for t in ("documents", "labels"))
    got = queries.op3_quality_rules(spark, big).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {r["doc_id"]: k for r, k in zip(docs, kept_by_hand(docs, labels), strict=True)}
    bad = {r["doc_id"] for r in labels if r["quality"] == 0}
    added = [r["doc_id"] for r in got if not r["kept"] and not r["base_failed"]]
    assert len(added) > 20 and sum(i in bad for i in added) > 5 and not any(r["quality"] == 1 and r["doc_id"] in added for r in labels)


def test_cutoffs_reject_and_filter(spark):
    rows = [(i, ("#*$ " if i % 10 == 0 else "") * 60 + " ".join(f"w{i}x{k}" for k in range(60)), "en", "s", 1) for i in range(2000)]
    docs = spark.createDataFrame([*rows, (None, "### $$$ " * 2 + " ".join(f"z{k}" for k in range(60)), None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(2000)], "doc_id long, quality int")
    out = rules.judged(docs, labels).collect()
    assert {r["doc_id"] for r in out if not r["kept"] and not r["base_failed"]} == {i for i in range(0, 2000, 10) if not next(r for r in out if r["doc_id"] == i)["base_failed"]}
    assert {r["doc_id"] for r in rules.filtered(docs, labels).collect()} == {r["doc_id"] for r in out if r["kept"]}


def test_license_scan(spark, tables, docs):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for r in docs:
        words = rx.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        at = [(i, label) for phrase, label in licences.BASE.items() for n in [phrase.split()] for i in range(len(words)) if words[i : i + len(n)] == n]
        want.append((r["doc_id"], len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    got = queries.op4_license_scan(spark, tables).collect()
    same([tuple(r)[:6] for r in got], want)
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    told = next(r for r in got if r["doc_id"] == 10_008)
    assert {"mit", "gpl-2.0-only", "apache-2.0"} <= set(told["labels"].split(","))


@pytest.mark.parametrize(("text", "value"), [("MIT OR GPL-3.0", 0.95), ("MIT AND GPL-3.0", 0.4), ("GPL-2.0 WITH Classpath-exception-2.0", 0.7), ("MIT AND (GPL-3.0 OR CC0-1.0)", 0.95), ("GPL-3.0 OR MIT AND CC0-1.0", 0.95)])
def test_expressions(text, value):
    assert licences.evaluate(licences.postfix(licences.tokens(text))) == pytest.approx(value)


@pytest.mark.parametrize(("text", "score", "labels"), [
    ("SPDX-License-Identifier: mitre", 0.5, "mitre"), ("GNU Lesser General Public License", 0.6, "gpl,lgpl"), ("the General Public License or the Lesser General Public License", 0.4, "gpl,lgpl"),
    ("CC BY-SA", 0.6, "cc-by,cc-by-sa"), ("SPDX-License-Identifier: GPL-2.0-only OR MIT", 0.95, "gpl-2.0-only,mit"),
])
def test_scores(text, score, labels):
    assert licences.scan(text)[5:7] == (labels, score)


def test_broken_expressions():
    assert licences.postfix(["(", "MIT"]) is None and licences.postfix(["AND", "MIT"]) is None and licences.postfix(["MIT", "MIT"]) is None
    assert licences.tokens("MIT, and more") == ["MIT"]


def shingled(text, k, low=str.lower):
    words = W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def print_of(text):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingled(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(keys, near):
    """Least key reachable, by comparing all pairs."""
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash(spark, tables, docs):
    prints = [(r["doc_id"], print_of(r["text"])) for r in docs]
    root = classes(sorted({p for _, p in prints}), lambda a, b: (a ^ b).bit_count() <= 3)
    least = collections.defaultdict(list)
    for i, p in prints:
        least[root[p]] += [i] if i is not None else []
    same([tuple(r) for r in queries.op8_simhash(spark, tables).collect()], [(i, f"{p:016x}", min(least[root[p]], default=None)) for i, p in prints])


def test_every_link_shares_the_guaranteed_postings():
    assert len(simhash.BLOCKS) == 28 and simhash.LEAST_SHARED == 2


def test_simhash_finds_all_links_of_dense_prints(spark):
    rnd = random.Random(5)
    seeds = [rnd.getrandbits(64) for _ in range(20)]
    prints = {s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for s in seeds for _ in range(40)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long")).collect()
    assert {frozenset((r["u"], r["v"])) for r in got} == {frozenset((signed(a), signed(b))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}


def test_near_duplicates(spark, tables, docs):
    sets = {hashlib.md5((r["text"] or "").encode()).hexdigest(): frozenset(shingled(r["text"], 5)) for r in docs}
    near = lambda a, b: (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) * len(sets[b])) ** 0.5 - 1e-9 and (sets[a] and sets[b])
    root = classes(sorted(sets), near)
    got = {r["key"]: r["root"] for r in simhash.near_duplicates(spark.read.parquet(f"{tables}/documents.parquet")).collect()}
    assert got == root
    kept = simhash.deduplicated(spark.read.parquet(f"{tables}/documents.parquet"))
    assert kept.count() == len(set(root.values())) and kept.columns == [*docs[0]]


def test_near_duplicates_below_and_above_the_similarity(spark):
    """Families with from none to half of their words changed, some of the changes shared, against all pairs."""
    rnd = random.Random(11)
    rows = []
    for f in range(4):
        base = [f"f{f}w{i}" for i in range(150)]
        for k in range(60):
            rate = rnd.choice([0.01, 0.03, 0.04, 0.05, 0.08, 0.2])
            words = [f"x{rnd.randrange(3)}" if rnd.random() < rate else w for w in base]
            rows.append((len(rows), " ".join(words[: rnd.choice([150, 150, 150, 140, 120, 100])])))
    sets = {hashlib.md5(t.encode()).hexdigest(): frozenset(shingled(t, 5)) for _, t in rows}
    root = classes(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) * len(sets[b])) ** 0.5 - 1e-9)
    assert 20 < len(set(root.values())) < 200
    assert {r["key"]: r["root"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == root


def test_near_duplicates_in_one_large_group(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :])) for i, k in enumerate(range(0, 200, 2))] + [(900 + i, " ".join(f"other{i}x{k}" for k in range(80))) for i in range(20)]
    docs = spark.createDataFrame([*rows, *rows], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.deduplicated(docs).collect()} == {0, *range(900, 920)}


def test_statistics_have_their_names():
    assert all(len(textstats.features(t)[0]) == len(textstats.FEATURES) for t in ODD)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, tables, name):
    """On the given tables, and on those with odd rows."""
    for d in (sf, tables):
        c = duckdb.connect()
        for t in ("documents", "benchmark", "conversations"):
            at = f"{d}/{t}.parquet"
            c.sql(f"create view {t} as select * from '{at + '/*.parquet' if os.path.isdir(at) else at}'")
        df = queries.QUERIES[name](spark, d)
        want = c.sql(queries.ORACLES[name])
        assert sorted(want.columns) == sorted(df.columns)
        plain = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
        rows = lambda got, columns: sorted(tuple(plain(r[columns.index(k)]) for k in sorted(columns)) for r in got)
        assert rows(map(tuple, df.collect()), df.columns) == rows(want.fetchall(), want.columns)
