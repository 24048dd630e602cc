import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalith.llm.components import components
from modalith.llm.exact_dedup import digest_roots, digest_runs, drop_exact_copies, exact_copies, merged
from modalith.llm.near_dedup import Circulant, NearParams, Shingler, crowd_pairs, drop_near_copies, near_copies
from tests.llm.odd import ROWS, SCHEMA, no_documents, odd_documents


def brute_copies(rows):
    by = {}
    for d, t, *_ in rows:
        if t is not None:
            by.setdefault(t, []).append(d)
    out = []
    for ids in by.values():
        ids.sort(key=lambda d: (d is None, d or 0))
        out += [(d, ids[0]) for d in ids[1:]]
    return sorted(out, key=str)


@pytest.mark.parametrize("parts,fan_in", [(1, 2), (3, 2), (40, 2), (40, 3), (7, 16)])
def test_exact_copies_match_brute_force(spark, parts, fan_in):
    rng = random.Random(parts)
    rows = [(i, f"text {rng.randrange(60)}", "en", "s", 1) for i in range(300)] + ROWS
    got = exact_copies(spark.createDataFrame(rows, SCHEMA).repartition(parts), fan_in)
    assert sorted(map(tuple, got.collect()), key=str) == brute_copies(rows)


def test_exact_copies_of_a_coalesced_join(spark):
    # the plan of doc_id alone is coalesced into fewer partitions than the one with texts
    conf = {"shuffle.partitions": "40", "autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "8k", "adaptive.coalescePartitions.minPartitionSize": "1b", "adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in conf}
    rng = random.Random(8)
    texts = ["".join(chr(rng.randrange(33, 0x2000)) for _ in range(600)) for _ in range(300)]
    rows = [(i, rng.choice(texts)) for i in range(1500)]
    try:
        for k, v in conf.items():
            spark.conf.set(f"spark.sql.{k}", v)
        docs = spark.range(1500).withColumnRenamed("id", "doc_id").join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
        assert 2 * docs.select("doc_id").rdd.getNumPartitions() < docs.rdd.getNumPartitions()
        got = sorted(map(tuple, exact_copies(docs, 2).collect()), key=str)
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)
    assert got == brute_copies(rows)


def test_lanes_follow_the_entries_of_a_run(spark):
    rows = [(i, f"text {i % 700}", "en", "s", 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(9)
    for lane_rows in (1, 50, 10**6):
        got = digest_roots(docs, 2, lane_rows).collect()
        assert len(got) == len({r["sha"] for r in got}) == 700 and {r["rows"] for r in got} == {2, 3} and {r["id"] for r in got} == set(range(700))


def test_runs_collapse_over_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(d, t) for t in ("a", "b", None, "c") for d in (None, 5, 3, 3, 9) for _ in range(7)]
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        got = {r["bytes"]: tuple(r)[4:] for r in digest_runs(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
        n = digest_runs(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {1: (3, 35, 14)} and n == 3


def test_merge_keeps_apart_what_shares_a_short_digest():
    a, b = (5, b"x", 3, 7, 1, 1), (5, b"y", 3, 2, 1, 1)
    assert list(merged([iter([a]), iter([b]), iter([a])])) == [(5, b"x", 3, 7, 2, 2), b]


def test_exact_on_odd_rows(spark):
    docs = odd_documents(spark, clash=True)
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in left.collect()) == [(0, ""), (1, "one t"), (3, ""), (4, ""), (5, "   \n\t"), (6, "word0"), (6, "word0"), (7, "naïve")]
    assert exact_copies(no_documents(spark)).count() == 0 and drop_exact_copies(no_documents(spark)).count() == 0


def test_bad_fan_in(spark):
    with pytest.raises(ValueError):
        exact_copies(no_documents(spark), 1)


@pytest.mark.parametrize("n", [1, 2, 50])
def test_components(spark, n):
    rng = random.Random(n)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(n)] + [(i, i + 1) for i in range(100, 100 + n)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = sorted((x, root(x)) for x in list(parent) if root(x) != x)
    assert sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == want


def mutated(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def near_rows():
    rng = random.Random(3)
    rows, i = [], 0
    for g in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((i, " ".join(mutated(rng, base, rng.choice([0, 1, 3, 6]))), "en", "s", 1))
            i += 1
    return rows


def test_near_copies_have_the_recall_of_brute_force(spark):
    p, rows = NearParams(), near_rows()
    shingler = Shingler(p.ngram)
    sets = [set(shingler(r[1]).tolist()) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= p.threshold * len(sets[a] | sets[b])]
    for a, b in near:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = dict(map(tuple, near_copies(spark.createDataFrame(rows, SCHEMA).repartition(5), p).collect()))
    same = lambda a, b: got.get(a, a) == got.get(b, b)
    # recall is that of pairs at or above the threshold; one missed pair may give a whole group another head
    assert sum(same(a, b) for a, b in near) >= 0.95 * len(near) and all(root(a) == root(b) for a, b in got.items())
    left = drop_near_copies(spark.createDataFrame(rows, SCHEMA), p)
    assert left.count() == len(rows) - len(got)


def test_signature_estimates_jaccard():
    p = NearParams()
    c, rng = Circulant(p), np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    errors = []
    for k in (100, 300, 500):
        a, b = x[:600], x[k : k + 400] if k else x
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        errors.append(abs((c.signature(a) == c.signature(b)).mean() - true))
    assert max(errors) < 0.17


def test_near_on_odd_rows(spark):
    docs = odd_documents(spark, clash=True)
    left = drop_near_copies(docs)
    assert left.columns == docs.columns
    ids = sorted((r["doc_id"] or 0) for r in left.collect())
    # 2 repeats 1 and 6 + " more" repeats 6; the row without doc_id takes no part
    assert ids == [0, 0, 1, 1, 3, 4, 5, 6, 7, 7]
    assert near_copies(no_documents(spark)).count() == 0
    assert drop_near_copies(no_documents(spark)).columns == no_documents(spark).columns


def test_group_that_is_one_star_costs_no_square(spark):
    base = " ".join(f"w{i}" for i in range(100))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit(base + " x"), F.col("id")).alias("text"))
    assert near_copies(docs).where("kept_id = 0").count() == 399


def joined(pairs):
    """The groups of the pairs, as a set of sets."""
    head = {}

    def root(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in pairs:
        head[root(a)] = root(b)
    out = {}
    for x in list(head):
        out.setdefault(root(x), set()).add(x)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("hot,crowd", [(40, 3), (12, 8), (200, 64)])
def test_crowd_pairs_join_what_all_pairs_join(spark, hot, crowd):
    rng, p = random.Random(hot), NearParams(crowd=crowd)
    sets = []
    for _ in range(25):  # selections of hot n-grams, each with some of its own
        some = rng.sample(range(hot), rng.randrange(4, min(hot, 40)))
        sets += [{*some, *rng.sample(range(1000, 100_000), rng.randrange(0, 14))} for _ in range(rng.randrange(1, 8))]
    for _ in range(30):
        own = rng.sample(range(1000, 100_000), 12)
        sets += [{*rng.sample(range(hot), 4), *own[: rng.randrange(5, 12)]} for _ in range(2)]
    link = lambda a, b: len(sets[a] & sets[b]) >= p.threshold * len(sets[a] | sets[b])
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if link(a, b)}
    rows = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "v long, set array<bigint>")
    got = {tuple(sorted(r)) for r in crowd_pairs(rows, p).collect()}
    assert joined({x for x in got if link(*x)}) == joined(want) and want
    assert len(got) < len(sets) * (len(sets) - 1) / 2


def test_a_bucket_of_many_groups_is_not_squared(spark):
    rng, shared = random.Random(4), " ".join(f"b{i}" for i in range(60))
    docs, groups = [], 0
    for g in range(700):
        own = [f"g{g}w{i}" for i in range(50)]
        for _ in range(rng.choice([1, 2, 2, 3])):
            docs.append((len(docs), f"{shared} {' '.join(mutated(rng, own, 1))}", "en", "s", 1))
        groups += 1
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    p = NearParams(crowd=16)
    got = near_copies(df, p).collect()
    base = lambda d: docs[d][1].split()[60:]
    assert len(got) == len(docs) - groups
    assert all({w.split("w")[0] for w in base(r["doc_id"]) if w[0] == "g"} == {w.split("w")[0] for w in base(r["kept_id"]) if w[0] == "g"} for r in got)
    # whether a bucket is a crowd changes nothing
    assert {tuple(r) for r in near_copies(df, NearParams(crowd=10_000)).collect()} == {tuple(r) for r in got}


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "s", 1)] * 300 + [(2, text + " more", "en", "s", 1)] * 300 + [(3, text, "en", "s", 1)]
    assert sorted(map(tuple, near_copies(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())) == [(2, 1), (3, 1)]
