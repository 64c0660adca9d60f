"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters, over lower-case letters with other characters as one blank, are hashed into buckets. Document
frequencies are counted over all documents to learn from. The weights are trained by follow-the-regularised-leader with elastic
net, on at most about ``TRAIN_ROWS`` distinct texts a language and ``SAMPLE_ROWS`` in all, chosen by a hash; each fifth of those is kept back, and on it a
temperature is fitted that calibrates the scores; with fewer than 20 * ``CALIBRATION`` sampled texts none is kept back and the temperature is 1.
Every text is then scored whole.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is any text if there is nothing to learn from; with
one language only, all other texts get it with score 1; rows with a null language teach nothing; repeated rows count once in training;
of equally likely languages the first by code point is told; of more than ``LANGS`` languages those with the most distinct texts are learned, the first by
code point of equals, and every text is still given one of them; a very long text is hashed in
stretches; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts, slices
from .common import discard, materialize

BITS = 15
BUCKETS = 1 << BITS
#: Bound of the sample that trains the weights, in distinct texts a language.
TRAIN_ROWS = 1500
#: So many languages are learned, those with the most distinct texts: the weights of one take 128 kB, sent to every executor.
LANGS = 400
#: Bounds of the whole sample: distinct texts, which the languages share, and (bucket, count) pairs, some eight bytes each in the driver.
SAMPLE_ROWS, SAMPLE_PAIRS = 20_000, 20_000_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.001
#: One of so many sampled texts is kept back for the temperature.
CALIBRATION = 5
#: N-grams are hashed in stretches of so many characters; no n-gram is lost between them.
STRETCH = 1 << 18
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that the text's n-grams fall in, and how often; none if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype=np.uint32)
    is_letter = letters()[codes]
    none = np.zeros(0, dtype=np.int64)
    if not is_letter.any():
        return none, none
    codes = np.concatenate([[np.uint32(32)], np.where(is_letter, codes, np.uint32(32)), [np.uint32(32)]]).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    tally = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(codes), STRETCH):
        c = codes[at : at + STRETCH + 2]
        own = c[:STRETCH]
        two = (c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77))[: len(own)]
        three = (two[: len(c) - 2] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1))[: len(own)]
        one = own * np.uint32(0xC2B2AE3D)
        for h in (one, two, three):
            h = h ^ (h >> np.uint32(15))
            tally += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS), minlength=BUCKETS)
    found = np.flatnonzero(tally)
    return found, tally[found]


def weighed(found: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(times)) * idf[found]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows of texts(text): in how many each bucket occurs, and how many rows there are. At most BUCKETS + 1 rows reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS + 1, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                for text in batch.column("text").to_pylist():
                    held[grams(text)[0]] += 1
                    held[BUCKETS] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out[:BUCKETS], int(out[BUCKETS])


def sample(taught: DataFrame, rows: int = TRAIN_ROWS) -> list:
    """About rows distinct texts of each language, fewer if that would pass the bounds of the whole sample, chosen by the text's hash, as (lang, h, found, times)."""
    distinct = taught.select("lang", F.xxhash64("text").alias("h")).distinct()
    sizes = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()}
    if not sizes:
        return []
    rows = max(1, min(rows, SAMPLE_ROWS // len(sizes)))
    parts = 1 << 50
    h = F.pmod(F.xxhash64("text"), F.lit(parts))
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, max(1, int(min(1.0, rows / n) * parts)))])
    chosen = taught.filter(h < F.try_element_at(shares, F.col("lang"))).select("lang", "text").distinct().withColumn("h", F.xxhash64("text"))
    cut = materialize(map_texts(chosen, lambda t: tuple(x.tolist() for x in grams(t)), "found array<int>, times array<int>").filter(F.size("found") > 0))
    pairs = cut.agg(F.sum(F.size("found"))).first()[0] or 0
    held = cut.filter(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(parts)) < F.lit(int(min(1.0, SAMPLE_PAIRS / max(pairs, 1)) * parts)))
    got = sorted(((r["lang"], r["h"], np.array(r["found"], dtype=np.int32), np.array(r["times"], dtype=np.int32)) for r in held.toLocalIterator()), key=lambda r: (r[1], r[0]))
    discard(cut)
    return got


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> np.ndarray:
    """Weights, BUCKETS + 1 by classes, from (class, buckets, values); the last row is the bias. Per-coordinate FTRL-proximal."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    weigh = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for _ in range(EPOCHS):
        for y, at, x in rows:
            zs, ns = z[at], n[at]
            w = weigh(zs, ns)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
            n[at] = more
    return weigh(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes the kept-back texts likeliest, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    lo, hi, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(taught: DataFrame, rows: int = TRAIN_ROWS) -> dict | None:
    """taught(text, lang) to a model: langs, idf, weights, temperature; None if there is nothing to learn from."""
    taught = taught.select("text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    got = sample(taught, rows)
    if not got:
        return None
    df, n = document_frequencies(taught)
    idf = np.log((1 + n) / (1 + df)) + 1
    langs = sorted({r[0] for r in got})
    cut = [(langs.index(lang), np.append(found, BUCKETS), np.append(weighed(found, times, idf), 1.0)) for lang, _, found, times in got]
    back = cut[::CALIBRATION] if len(cut) >= 20 * CALIBRATION else []
    weights = train([r for i, r in enumerate(cut) if not back or i % CALIBRATION], len(langs))
    logits = np.array([x @ weights[at] for _, at, x in back]).reshape(len(back), len(langs))
    return {"langs": langs, "idf": idf.astype(np.float32), "weights": weights.astype(np.float32), "temperature": temperature(logits, np.array([r[0] for r in back], dtype=np.int64))}


def predict_one(model: dict | None, text: str | None) -> tuple[str, float]:
    found, times = grams(text)
    if model is None or not len(found):
        return UNKNOWN, 0.0
    logits = weighed(found, times, model["idf"]) @ model["weights"][found] + model["weights"][BUCKETS]
    p = softmax(logits.astype(np.float64) / model["temperature"])
    best = int(p.argmax())
    return model["langs"][best], float(min(p[best], 1.0))


def predict(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """docs without the text, with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # langs times BUCKETS floats: 128 kB a language
    return map_texts(docs, lambda t: predict_one(sent.value, t), "lang_pred string, score double", text)


def identify(docs: DataFrame, held_out: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs(doc_id, text, lang) as doc_id, held_out, lang_pred, score; held-out rows teach nothing."""
    own = docs.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(True)).alias("held_out"))
    model = fit(own.filter(~F.col("held_out")), rows)
    return predict(own.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
