"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of every whole text are found once and written down. Trees are grown on at most about ``TRAIN_ROWS`` distinct statistics of
labelled rows, chosen by their hash; of rows with equal statistics the mean label counts: each statistic is cut into ``BINS`` bins by its quantiles, and a node is split where the
histogram of gradients gains most. The grown trees are flattened into arrays (feature, threshold, left, right, value), and a batch
of rows goes down all trees at once, level by level, in numpy.

Defined results: a null text is empty, and an empty text is scored like any other; several labels of one document count as
their mean, a null label as none; without labels every score is 0.5; with labels of one kind only it is their smoothed share. A null
doc_id has no label. Repeated rows are scored each; rows of equal statistics have equal scores; a text of any length is measured whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts
from .common import materialize
from .textstats import FEATURES, features

#: Bound of the distinct statistics of labelled rows that the trees are grown on.
TRAIN_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAST_LEAF, SHRINK = 64, 60, 4, 0.15, 20, 1.0
LEAF = -1


def grow(x: np.ndarray, y: np.ndarray) -> dict:
    """Flattened trees for the log-odds of y = 1; x: rows by features, y: 0 to 1."""
    prior = float(np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-6, 1 - 1e-6))
    base = float(np.log(prior / (1 - prior)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # bin b: at most edge b
    flat = binned + np.arange(x.shape[1]) * BINS
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots, f = [], np.full(len(y), base)
    for _ in range(TREES if 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([LEAF, 0.0, 0, 0, 0.0])
        open_ = [(roots[-1], np.arange(len(y)), 0)]
        while open_:
            at, rows, depth = open_.pop()
            gs, hs = float(g[rows].sum()), float(h[rows].sum())
            best, cut = 1e-6, None
            if depth < DEPTH and len(rows) >= 2 * LEAST_LEAF:
                cells = flat[rows].ravel()
                shape, k = (x.shape[1], BINS), x.shape[1]
                hg, hh, hn = (np.bincount(cells, weights=None if v is None else np.repeat(v[rows], k), minlength=k * BINS).reshape(shape).cumsum(axis=1) for v in (g, h, None))
                gain = hg**2 / (hh + SHRINK) + (gs - hg) ** 2 / (hs - hh + SHRINK) - gs**2 / (hs + SHRINK)
                gain[(hn < LEAST_LEAF) | (len(rows) - hn < LEAST_LEAF)] = 0
                j, b = np.unravel_index(int(gain.argmax()), shape)
                best, cut = (float(gain[j, b]), (int(j), int(b))) if gain[j, b] > best else (best, None)
            if cut is None:
                nodes[at][4] = value = RATE * gs / (hs + SHRINK)
                f[rows] += value
                continue
            j, b = cut
            goes = binned[rows, j] <= b
            left, right = len(nodes), len(nodes) + 1
            nodes += [[LEAF, 0.0, 0, 0, 0.0], [LEAF, 0.0, 0, 0, 0.0]]
            nodes[at][:4] = [j, float(edges[j][b]), left, right]
            open_ += [(left, rows[goes], depth + 1), (right, rows[~goes], depth + 1)]
    a = np.array(nodes, dtype=np.float64).reshape(-1, 5)
    return {"base": base, "roots": np.array(roots, dtype=np.int32), "feature": a[:, 0].astype(np.int32), "threshold": a[:, 1], "left": a[:, 2].astype(np.int32), "right": a[:, 3].astype(np.int32), "value": a[:, 4]}


def scores(model: dict | None, x: np.ndarray) -> np.ndarray:
    """Of the rows of x: all go down all trees at once."""
    if model is None:
        return np.full(len(x), 0.5)
    at = np.repeat(model["roots"][None, :], len(x), axis=0)
    rows = np.arange(len(x))[:, None]
    for _ in range(DEPTH):
        j = model["feature"][at]
        down = np.where(x[rows, np.maximum(j, 0)] <= model["threshold"][at], model["left"][at], model["right"][at])
        at = np.where(j == LEAF, at, down)
    return 1 / (1 + np.exp(-(model["base"] + model["value"][at].sum(axis=1))))


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> dict | None:
    """labelled(x, y) to a model; None if it has no rows."""
    distinct = labelled.withColumn("h", F.xxhash64(F.col("x"), F.lit(7))).groupBy("h", "x").agg(F.avg("y").alias("y"))
    n = distinct.count()
    if not n:
        return None
    parts = 1 << 50
    chosen = distinct.filter(F.pmod("h", F.lit(parts)) < F.lit(max(1, int(min(1.0, rows / n) * parts))))
    # With a bound of a few rows it may happen that none is chosen; then the first by hash are.
    got = list(chosen.toLocalIterator()) or distinct.orderBy("h").limit(max(1, rows)).collect()
    got = sorted((r["h"], r["y"], r["x"]) for r in got)
    return grow(np.array([r[2] for r in got], dtype=np.float64), np.array([r[1] for r in got], dtype=np.float64))


def score(stats: DataFrame, model: dict | None) -> DataFrame:
    """stats with its column x replaced by score."""
    sent = stats.sparkSession.sparkContext.broadcast(model)  # TREES times 2 ** (DEPTH + 1) nodes at most
    kept = [f for f in stats.schema.fields if f.name != "x"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array(scores(sent.value, x))], names=[*[f.name for f in kept], "score"])

    return stats.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "score double"]))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with x, the statistics named in FEATURES."""
    return map_texts(docs, features, "x array<double>", text)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs(doc_id, text) and labels(doc_id, quality) as doc_id, held_out, score, predicted; labels of held-out rows aren't looked at."""
    stats = materialize(statistics(docs.select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "text")))
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    model = fit(stats.filter(~F.col("held_out")).join(marks, "doc_id").select("x", "y"), rows)
    return score(stats, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
