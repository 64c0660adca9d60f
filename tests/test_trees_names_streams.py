"""Ancestors, similar names, whole orders and the price stream against plain versions."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundloom import catalog
from fundloom.operators import names, relational, trees
from fundloom.streaming import prices


def test_ancestors_of_a_long_chain_and_a_cycle(spark):
    chain = spark.range(10_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    more = spark.createDataFrame([(20_000, 20_001), (20_001, 20_002), (20_002, 20_000), (20_003, 20_001), (30_000, 77_777), (30_001, 30_000), (40_000, None)], "id long, parent long")
    nodes = chain.unionByName(more)
    held, told = trees.jumps(nodes)
    assert len(held) <= 16
    got = {r["id"]: (r["depth"], r["top"], r["state"]) for r in told.collect()}
    assert all(got[i] == (i, 0, "rooted") for i in range(10_000))
    assert all(got[i] == (None, None, "cycle") for i in range(20_000, 20_004))
    assert got[30_000] == (0, 30_000, "orphan") and got[30_001] == (1, 30_000, "orphan") and got[40_000] == (0, 40_000, "rooted")
    asked = spark.createDataFrame([(9_999,), (20_003,), (30_001,), (5,)], "id long")
    ways = {}
    for r in trees.ancestors(nodes, asked).collect():
        ways.setdefault(r["id"], {})[r["distance"]] = r["ancestor"]
    assert ways == {9_999: {k: 9_999 - k for k in range(1, 10_000)}, 30_001: {1: 30_000}, 5: {k: 5 - k for k in range(1, 6)}}
    assert trees.ancestors(nodes.limit(0)).count() == 0


def test_no_similar_pair_is_lost(spark):
    rnd = random.Random(4)
    some = sorted({"".join(rnd.choice("abcde -") for _ in range(rnd.randint(0, 26))) for _ in range(260)} | {"net revenue", "net revenues", "Revenue", "ab", "abc", "abcd", "a", "", "aaaa", "aaa", "aaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaa"})
    near = sorted({x[:k] + rnd.choice("abcdexyz") + x[k + rnd.randint(0, 2) :] for x in some for k in (0, len(x) // 2)} | set(some[:60]))
    left, right = spark.createDataFrame([(x,) for x in some], "a string"), spark.createDataFrame([(x,) for x in near], "b string")
    for cutoff in (0.75, 0.9, 0.6):
        want, edge = {}, 0
        for a in some:
            found = [(r, b) for b in near if a and b and (r := difflib.SequenceMatcher(None, b, a).ratio()) >= cutoff]
            edge += sum(r == cutoff for r, _ in found)
            if found:
                want[a] = max(found)
        got = {r["a"]: (r["ratio"], r["b"]) for r in names.matched(left, right, cutoff).collect()}
        assert got == want and (edge or cutoff == 0.9)
        for a in some[:20]:  # as the library would choose
            assert (difflib.get_close_matches(a, [b for b in near if b], 1, cutoff) if a else []) == ([got[a][1]] if a in got else [])


def test_similarity_join_of_the_tables(spark, sf):
    from fundloom.sources.tables import Tables

    left, right = ([r[0] for r in x.collect()] for x in names.labels(Tables(spark, sf)))
    got = {r["a"]: r["b"] for r in catalog.QUERIES["h19_similarity_join"](spark, sf).collect()}
    want = {a: (difflib.get_close_matches(a, right, 1, 0.75) or [None])[0] if a else None for a in left}
    assert got == want and sum(b is not None for b in want.values()) > 20


def test_positions_over_many_ranges(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = relational.positions(rows, [F.col("k"), F.col("id")]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(range(5000), key=lambda i: (i % 3 > 0, i % 5 if i % 3 else 0, i))
    assert [r["id"] for r in sorted(got, key=lambda r: r["pos"])] == want and sorted(r["pos"] for r in got) == list(range(1, 5001))


def test_prices_are_judged_one_by_one():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 400):
        x = np.exp(np.cumsum(rnd.normal(0, 0.15, n))) if n % 2 == 0 else rnd.uniform(1, 2, n)
        for start in (None, 1.3):
            last, want = start, []
            for p in x:
                ok = last is None or abs(p - last) / last <= prices.BREAK
                last = p if ok else last
                want.append(ok)
            got, end = prices.judged(x, start)
            assert got.tolist() == want and end == last


def test_stream_of_prices_goes_on_after_a_restart(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").collect()
    cuts = [0, len(events) // 5, len(events) // 2, len(events) * 4 // 5, len(events)]
    for k in range(4):
        spark.createDataFrame(events[cuts[k] : cuts[k + 1]], prices.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # Each part is read by a query of its own, which goes on from the checkpoint of the one before it.
        q = prices.accepted(prices.prices(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("val_id", "accepted").collect()))
    assert got == sorted(map(tuple, catalog.QUERIES["e11_circuit_breaker"](spark, sf).select("val_id", "accepted").collect())) and {x[1] for x in got} == {True, False}
