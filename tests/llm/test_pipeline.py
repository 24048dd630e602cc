import itertools

import corpus_pipeline
import numpy as np
import tiktoken

import __spark_entry__
from modalith.llm.bpe import PATTERN, VOCABULARY, load_ranks
from modalith.llm.decontaminate import LeakParams, edits, normalised
from modalith.llm.near_dedup import NearParams, Shingler
from modalith.llm.quality import QualityParams, Scorer, labelled_sample, train
from tests.llm.odd import no_documents, odd_documents


def brute(spark, sf):
    """The pipeline, stage by stage, in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    p = QualityParams()
    shares, bias = train(*labelled_sample(docs, spark.read.parquet(f"{sf}/labels.parquet"), p), p)
    scorer = Scorer(shares.astype(np.float32), bias, p)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    sizes = [len(rows)]
    rows = [r for r in rows if scorer.score(r[1])[1] >= p.keep_from]
    sizes.append(len(rows))
    first = {}
    for d, t in rows:
        first.setdefault(t, d)
    rows = sorted((d, t) for t, d in first.items())
    sizes.append(len(rows))
    near, shingler = NearParams(), Shingler(NearParams().ngram)
    sets = [set(shingler(t).tolist()) for _, t in rows]
    head = list(range(len(rows)))

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and len(sets[a] & sets[b]) >= near.threshold * len(sets[a] | sets[b]):
            ra, rb = root(a), root(b)
            head[max(ra, rb)] = min(ra, rb)
    rows = [r for i, r in enumerate(rows) if root(i) == i]
    sizes.append(len(rows))
    leak = LeakParams()
    items = [normalised(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    budgets = [(f" {s} ", int(leak.error_rate * len(s)) if len(s) >= leak.min_chars else 0) for s in items if len(s) >= leak.least_chars]
    rows = [(d, t) for d, t in rows if not any(edits(s, f" {normalised(t)} ") <= k for s, k in budgets)]
    sizes.append(len(rows))
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(VOCABULARY), special_tokens={})
    return {d: enc.encode_ordinary(t) for d, t in rows}, sizes


def test_run_matches_plain_python(spark, sf):
    want, sizes = brute(spark, sf)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: list(r["tokens"]) for r in got} == want and len(got) == len(want)
    assert all(r["round_trip"] for r in got) and sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 5


def test_odd_tables(spark, tmp_path):
    for name, docs in (("odd", odd_documents(spark, clash=True)), ("empty", no_documents(spark))):
        at = tmp_path / name
        docs.write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (3, 1, 0), (6, 1, 0), (7, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
        spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(at)).collect()
        assert len(got) == len({(r["doc_id"], r["n_tokens"]) for r in got}) and all(r["round_trip"] is not False for r in got)
        assert (len(got) == 0) == (name == "empty")
        d = docs
        for stage, f in corpus_pipeline.STAGES[:-1]:
            d = f(spark, d, str(at))
            assert d.columns == docs.columns, stage


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names) and [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
