import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from modalith.llm import line_spread
from modalith.llm.line_spread import SpreadParams, drop_boilerplate
from modalith.llm.sharding import ShardParams, fisher_yates, shuffled, write_shards
from tests.llm.odd import SCHEMA, no_documents, odd_documents


def brute_clean(rows, least):
    sites = {}
    for _, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            if s is not None and line.strip(" \t\r"):
                sites.setdefault(line.strip(" \t\r"), set()).add(s)
    bad = {k for k, v in sites.items() if len(v) >= least}
    out = []
    for d, t, *_ in rows:
        if t is None:
            out.append((d, None, 0))
        else:
            kept = [x for x in t.split("\n") if x.strip(" \t\r") not in bad]
            out.append((d, "\n".join(kept), t.count("\n") + 1 - len(kept)))
    return sorted(out, key=str)


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize("least,band,literal", [(3, 0.1, 20_000), (3, 0.1, 5), (5, 0.9, 20_000), (40, 0.1, 0)])
def test_boilerplate_matches_brute_force(spark, monkeypatch, ansi, least, band, literal):
    monkeypatch.setattr(line_spread, "LITERAL_LINES", literal)
    rng = random.Random(least)
    rows = [(i, "\n".join(f" line {int(rng.paretovariate(0.6)) % 90}\t" if rng.random() < 0.9 else "" for _ in range(rng.randrange(9))), "en", f"s{rng.randrange(60)}" if rng.random() < 0.97 else None, 1) for i in range(900)]
    rows += [(5000, None, "en", "s1", 1), (5001, "", "en", None, 1), (5002, "\n\n", "en", "s2", 1), (5003, "line 1", "en", "s3", 1), (5003, "line 1", "en", "s3", 1)]
    got = drop_boilerplate(spark.createDataFrame(rows, SCHEMA).repartition(6), p=SpreadParams(min_sites=least, band=band))
    assert sorted(((r["doc_id"], r["text"], r["lines_removed"]) for r in got.collect()), key=str) == brute_clean(rows, least)


def test_spread_on_odd_rows(spark):
    docs = odd_documents(spark, clash=True)
    got = drop_boilerplate(docs, p=SpreadParams(min_sites=2))
    assert got.columns == [*docs.columns, "lines_removed"] and got.count() == docs.count()
    assert {(r["text"], r["lines_removed"]) for r in got.where("doc_id in (1, 2)").collect()} == {("", 1)}
    assert drop_boilerplate(no_documents(spark)).count() == 0


def test_fisher_yates_reaches_every_order_alike():
    assert sorted(fisher_yates(50, 1)) == list(range(50)) and fisher_yates(0, 1).size == 0 and list(fisher_yates(1, 1)) == [0]
    from collections import Counter

    seen = Counter(tuple(fisher_yates(3, s)) for s in range(6000))
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())


def test_shuffle_is_a_permutation_and_repeats(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    p = ShardParams(bucket_bytes=8000)
    one = {r["doc_id"]: (r["shard"], r["position"]) for r in shuffled(docs.repartition(7), p).collect()}
    two = {r["doc_id"]: (r["shard"], r["position"]) for r in shuffled(docs.repartition(3), p).collect()}
    assert one == two and len(one) == 3000
    shards = {}
    for s, n in one.values():
        shards.setdefault(s, []).append(n)
    assert len(shards) > 5 and all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert max(map(len, shards.values())) < 2 * 3000 / len(shards)
    # no trend is left: neighbours are as far apart as in a random order
    order = [d for d, _ in sorted(one.items(), key=lambda x: x[1])]
    gap = sum(abs(a - b) for a, b in zip(order, order[1:])) / 3000
    assert 900 < gap < 1100
    assert one != {r["doc_id"]: (r["shard"], r["position"]) for r in shuffled(docs, ShardParams(seed=8, bucket_bytes=8000)).collect()}
    write_shards(docs, str(tmp_path / "out"), p)
    folders = sorted((tmp_path / "out").glob("shard=*"))
    assert len(folders) == len(shards)
    for f in folders:
        files = list(f.glob("*.parquet"))
        assert len(files) == 1
        t = pq.ParquetFile(files[0]).read()
        assert t["position"].to_pylist() == list(range(len(t)))


def test_shuffle_on_odd_rows(spark):
    docs = odd_documents(spark, clash=True)
    got = shuffled(docs, ShardParams(bucket_bytes=1000))
    assert got.count() == docs.count()
    kept = [c for c in docs.columns if c not in ("shard", "position")]
    quoted = [f"`{c}`" for c in kept]
    assert got.columns == [*kept, "shard", "position"] and got.select(*quoted).exceptAll(docs.select(*quoted)).count() == 0
    assert shuffled(no_documents(spark)).count() == 0
    maps = spark.createDataFrame([({"a": 1}, 1), (None, 2)], "m map<string,int>, n int")
    assert shuffled(maps).count() == 2


def brute_shuffle(rows, p, shards, of):
    """The order of each shard's rows: by hash, then Fisher and Yates, swap by swap."""
    out = {}
    for row, key in rows:
        out.setdefault(of[row], []).append((key, row))
    done = {}
    for shard, mine in out.items():
        mine.sort()
        rng = np.random.default_rng([p.seed, shard])
        swaps = rng.integers(0, np.arange(len(mine), 0, -1))
        for i, j in zip(range(len(mine) - 1, 0, -1), swaps):
            mine[i], mine[j] = mine[j], mine[i]
        done[shard] = [r for _, r in mine]
    return done


@pytest.mark.parametrize("tasks", [16_384, 3])
def test_shuffle_matches_brute_force(spark, tasks):
    p = ShardParams(bucket_bytes=3000, tasks=tasks)
    docs = spark.range(800).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    got = shuffled(docs.repartition(5), p)
    keys = [(r[0], r[1]) for r in docs.select("doc_id", F.xxhash64("doc_id", "text", F.lit(p.seed))).collect()]
    size = docs.agg(F.sum(F.length("text") + 16)).first()[0]
    shards = -(-size // p.bucket_bytes)
    of = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.xxhash64("doc_id", "text", F.lit(p.seed)), F.lit(p.seed + 1)), F.lit(shards))).collect()}
    have = {}
    for r in sorted(got.collect(), key=lambda r: (r["shard"], r["position"])):
        have.setdefault(r["shard"], []).append(r["doc_id"])
    assert have == brute_shuffle(keys, p, shards, of) and len(have) > 5
    assert got.rdd.getNumPartitions() <= max(tasks, 3) and (tasks > 3 or got.rdd.getNumPartitions() == 3)


def test_repeated_rows_are_spread(spark):
    docs = spark.range(2000).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text")).union(spark.range(500).select(F.col("id").cast("int"), F.lit("y")))
    got = shuffled(docs.repartition(6), ShardParams(bucket_bytes=100_000)).groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("b"), F.max("position").alias("m")).collect()
    assert sum(r["n"] for r in got) == 2500 and len(got) == 21 and max(r["b"] for r in got) < 160_000
    assert all(r["m"] == r["n"] - 1 for r in got)


def test_nested_columns_count(spark):
    docs = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: x.cast("int")).alias("tokens"))
    assert shuffled(docs, ShardParams(bucket_bytes=100_000)).select("shard").distinct().count() == 13  # 300 rows of 4000 + 8 bytes
    deep = spark.range(100).select("id", F.struct(F.array(F.repeat(F.lit("z"), 2000)).alias("a"), F.create_map(F.lit("k"), F.repeat(F.lit("z"), 2000)).alias("m")).alias("s"), F.lit(None).cast("array<string>").alias("none"))
    assert shuffled(deep, ShardParams(bucket_bytes=40_000)).select("shard").distinct().count() >= 10
