"""What the findings of round 4 are about, for the corpus operators."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from fundloom.llm import common, simhash


def test_postings_are_not_broadcast(spark):
    """Postings are 28 times the prints they are exploded from: Spark takes them to be as small as those, and at 250,000 texts broadcast seven million rows."""
    prints = common.materialize(spark.range(3000).select(F.xxhash64("id").alias("fp")).unionByName(spark.range(300).select(F.xxhash64("id").bitwiseXOR(F.lit(5)).alias("fp"))))
    roots = common.materialize(spark.range(300).select(F.xxhash64("id").alias("key"), F.xxhash64("id").alias("root")))
    for made in (simhash.star_links(prints), simhash.links(prints), simhash.links(prints, roots)):
        assert len(made.collect()) >= 300
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_pipeline_drops_what_fingerprints_link(spark, sf):
    """Texts within three bits whose shingles are less similar than the stage's measure asks: op8 links them, so the pipeline keeps one."""
    for seed in range(1000):
        rnd = random.Random(seed)
        told, rest = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)]
        changed = [f"c{seed}x{i}" if i % 9 == 4 else w for i, w in enumerate(rest)]
        one, two = (" ".join(told * 3 + x + [f"d{rnd.random()}"]) for x in (rest, changed))
        u, v = (set(simhash.shingle_hashes(x).tolist()) for x in (one, two))
        if (simhash.fingerprint(one)[0] ^ simhash.fingerprint(two)[0]).bit_count() <= simhash.MAX_BITS and len(u & v) < 0.78 * (len(u) * len(v)) ** 0.5:
            break
    else:
        raise AssertionError("no such pair")
    other = " ".join(f"e{i}" for i in range(60))
    docs = spark.createDataFrame([(3, one), (1, two), (2, other), (4, one), (5, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == [1, 2, 5]
