"""Quality rules with risk-controlled thresholds.

Base rules reject very short and very repetitive texts. Beyond them, a text is rejected where its strain, the largest of its measures
in units of ``SCALES``, is over its stratum's (its language's) cutoff. Cutoffs come from labelled holdouts: for each stratum, the cutoffs of
a fixed grid are tried from the most lenient on; one holds if the exact binomial test rejects, at the corrected level, that it
turns away a fraction ``RISK`` or more of good documents. Trying stops at the first that fails (fixed-sequence testing), and the number of strata
is corrected for by Bonferroni. So with probability 1 - ``DELTA`` no stratum loses more than ``RISK`` of its good documents. Of the
cutoffs that hold, the one that turns away most bad documents, less ``PRICE`` times the good ones, is set; none is set if nothing is
won. A trial is a distinct text of a stratum: copies and several labels are one trial, good if any label says so. A cutoff
needs ln(DELTA / strata) / ln(1 - RISK) good texts at least: 86 with four strata.

Defined results: a null text is empty, so it fails the base rules; a null language is the stratum of the empty one; without enough
labels there are no cutoffs, and base rules alone decide; a null label doesn't count; a strain equal to the cutoff is kept; a text of any length is
measured whole; an empty table gives an empty result. Repeated rows are judged each; other columns, whatever their names, are carried along by ``filtered`` and ignored by ``judged``.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts
from .common import free_name, materialize
from .textstats import LEAST_WORDS, counted

RISK, DELTA, PRICE = 0.05, 0.05, 10
MEASURES = ("symbols", "dup_lines", "repeats", "upper", "bangs", "pipes")
#: The share at which each measure has a strain of 1: fixed before any label is seen, so that the order of cutoffs doesn't depend on labels.
SCALES = (0.1, 0.5, 0.5, 0.5, 0.1, 0.1)
#: Cutoffs are multiples of 1 / STEPS; a strain of GRID / STEPS or more is in the last bin.
STEPS, GRID = 20, 80
#: Cutoff rows, one a stratum, that may be broadcast: 50 bytes each.
BROADCAST_ROWS = 20_000
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, measures array<double>"


def measure(text: str | None) -> tuple:
    """The base counts and the measures of one text."""
    text = text or ""
    counts, words, lines, _ = counted(text)
    n, chars, symbols, dup, repeat = counts
    per = 1.0 / max(chars, 1)
    cased = sum(map(str.isalpha, text)) if not text.isascii() else sum(map(text.count, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    bars = sum(w == b"|" for w in words)
    bangs = sum(w.rstrip(b".,").endswith(b"!!") for w in words)
    return (*counts, [symbols * per, dup / max(len(lines), 1), repeat / max(n, 1), upper / max(cased, 1), bangs / max(n, 1), bars / max(n, 1)])


def binomial_below(k: int, n: int, p: float) -> float:
    """Probability of k or fewer of n, each with probability p, to double precision.

    The shorter tail is summed from k outwards, each term from its neighbour, until terms vanish: some sqrt(n) of them.
    """
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    down = k <= n * p
    i = k if down else k + 1
    odds = p / (1 - p)
    first = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    term, tail = 1.0, 0.0
    while term > 1e-18 * tail and 0 <= i <= n:
        tail += term
        term *= i / ((n - i + 1) * odds) if down else (n - i) * odds / (i + 1)
        i += -1 if down else 1
    return min(1.0, first * tail) if down else max(0.0, 1.0 - first * tail)


def chosen(cells: list[tuple[int, int, int]], risk: float, level: float, price: float = PRICE) -> int | None:
    """cells: (bin, good, bad) of a stratum; the cutoff bin, over which is rejected, or None. Bins go from 0 to GRID."""
    good, bad = {b: g for b, g, _ in cells}, {b: x for b, _, x in cells}
    n, gone_good, gone_bad, best, out = sum(good.values()), 0, 0, 0.0, None
    for cut in range(GRID - 1, -1, -1):
        gone_good += good.get(cut + 1, 0)
        gone_bad += bad.get(cut + 1, 0)
        if not n or binomial_below(gone_good, n, risk) > level:
            break
        if gone_bad - price * gone_good > best:
            best, out = gone_bad - price * gone_good, cut
    return out


def in_scale(measures: Column) -> Column:
    return F.transform(measures, lambda x, k: x / F.element_at(F.array(*map(F.lit, SCALES)), k + 1))


def bin_of(x: Column) -> Column:
    """The least bin whose cutoff the strain x isn't over: x <= bin / STEPS."""
    return F.least(F.lit(GRID), F.greatest(F.lit(0), F.ceil(x * STEPS - F.lit(1e-9)))).cast("int")


def thresholds(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """labelled(stratum, text_key, measures, quality) to stratum and cut, its bin. Counted over all labelled rows."""
    texts = labelled.groupBy("stratum", "text_key", bin_of(F.array_max(in_scale(F.col("measures")))).alias("b")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"))
    cells = materialize(texts.groupBy("stratum", "b").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")))
    tests = max(1, cells.select("stratum").distinct().count())

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:  # GRID + 1 rows at most
        cut = chosen(list(pdf[["b", "good", "bad"]].itertuples(index=False, name=None)), risk, delta / tests)
        return pdf[["stratum"]].head(0 if cut is None else 1).assign(cut=cut if cut is not None else 0)

    return cells.groupBy("stratum").applyInPandas(choose, "stratum string, cut int")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with FIELDS and base_failed."""
    out = map_texts(docs, measure, FIELDS, text)
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def verdicts(found: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """found(doc_id, lang, text_key and what measured() adds) with kept and failed, the names of the measures over their stratum's cutoff."""
    own = found.withColumn("stratum", F.coalesce("lang", F.lit("")))
    marks = labels.filter("quality is not null and doc_id is not null").select("doc_id", "quality")
    cuts = materialize(thresholds(own.filter("not base_failed").join(marks, "doc_id").select("stratum", "text_key", "measures", "quality"), risk, delta))
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_ROWS else cuts
    names = F.array(*map(F.lit, MEASURES))
    over = F.transform(in_scale(F.col("measures")), lambda x, k: F.when(bin_of(x) > F.col("cut"), F.try_element_at(names, k + 1)))
    out = own.join(cuts, "stratum", "left").withColumn("failed", F.coalesce(F.filter(over, lambda m: m.isNotNull()), F.array().cast("array<string>")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("stratum", "cut")


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """docs(doc_id, text, lang): doc_id, the base counts, base_failed, kept, failed."""
    found = materialize(measured(docs.select("doc_id", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), "text")))
    return verdicts(found, labels, risk, delta).select("doc_id", *[f.split()[0] for f in FIELDS.split(", ")[:-1]], "base_failed", "kept", "failed")


def filtered(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of docs that are kept, with their columns. Texts are measured where they are; the verdict comes back by the text's hash and id."""
    names: list[str] = []
    for name in ("text_key", "row_key", "gone_key", "gone_row"):
        names.append(free_name([*docs.columns, *names], name))
    key, row, gone_key, gone_row = names
    keyed = docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")))).withColumn(row, F.struct(F.col("doc_id"), F.col("lang")))
    found = materialize(measured(keyed.select("doc_id", "lang", F.col(key).alias("text_key"), "text")))
    out = verdicts(found, labels, risk, delta).filter("not kept").select(F.col("text_key").alias(gone_key), F.struct("doc_id", "lang").alias(gone_row)).distinct()
    return keyed.join(out, (F.col(key) == F.col(gone_key)) & F.col(row).eqNullSafe(F.col(gone_row)), "left_anti").drop(key, row)
