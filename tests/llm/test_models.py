import math
import random

import pytest

from modalith.llm import bpe, quality
from modalith.llm.bpe import PATTERN, VOCABULARY, Decoder, Encoder, Transducer, decode_documents, encode_documents, load_ranks, odd_characters
from modalith.llm.quality import QualityParams, features, keep_good, labelled_sample, quality_scores, train
from tests.llm.odd import SCHEMA, no_documents, odd_documents

LABELS = "doc_id long, quality int, toxic int"
FAST = QualityParams(bits=14, epochs=6)


def brute_features(text, p):
    """The same features, word by word."""
    out, last = [], None
    for w in text.split():
        out.append(("w", w))
        if w == last:
            out.append(("again", ""))
        last = w
        s = f" {w.lower()} "
        for n in p.ngrams:
            out += [(n, s[i : i + n]) for i in range(len(s) - n + 1)]
    return out


@pytest.mark.parametrize("text", ["", " \n", "a", "a a a", "Hello hello, wörld 日本 \U0001f600!", "x" * 300 + " end", "the cat  the\tcat"])
def test_features_are_those_of_the_definition(text):
    p = QualityParams(bits=40)  # no two features share a bucket
    want, got = brute_features(text, p), features(text, p).tolist()
    assert len(got) == len(want) and len(set(got)) == len(set(want))
    counts = sorted(want.count(x) for x in set(want))
    assert counts == sorted(got.count(x) for x in set(got))


def test_long_texts_have_the_features_of_their_parts(monkeypatch):
    text = " ".join(f"word{i % 97} word{i % 97}" for i in range(3000))
    p = QualityParams(bits=40)
    whole = sorted(features(text, p).tolist())
    monkeypatch.setattr(quality, "BLOCK", 256)
    # a word's hash holds the space after it, so blocks change nothing
    assert sorted(features(text, p).tolist()) == whole


def sample(rng, n, at=0):
    docs, labels = [], []
    for i in range(at, at + n):
        words = [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit"]) + rng.choice(["", "us", "a"]) for _ in range(rng.randrange(20, 90))]
        kind = rng.choice([0, 1, 1, 2])
        if kind == 0:
            words = [w for x in words for w in (x + "%%%", x + "%%%")]
        if kind == 2:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "vile" + rng.choice(["ness", "st", "r", "fy"]))
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(kind != 0), int(kind == 2)))
    return docs, labels


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    docs, labels = sample(rng, 600)
    test, truth = sample(rng, 300, 1000)
    scored = quality_scores(spark.createDataFrame(test, SCHEMA), spark.createDataFrame(labels, LABELS), FAST, spark.createDataFrame(docs, SCHEMA))
    keep = {r["doc_id"]: r["keep"] for r in scored.collect()}
    right = [keep[d] == (q == 1 and t == 0) for d, q, t in truth]
    assert sum(right) / len(right) > 0.95


def test_labels_of_other_documents_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 1) for i in range(60)] + [(3, "text 3 again", "en", "s", 1)], SCHEMA)
    labels = spark.range(4000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    texts, classes = labelled_sample(docs, labels, QualityParams(train_rows=100))
    assert len(texts) == len(classes) == 61 and set(texts) == {r["text"] for r in docs.collect()}
    some, _ = labelled_sample(docs, labels, QualityParams(train_rows=10))
    assert len(some) == 10 and set(some) <= set(texts)


def brute_probability(text, shares, bias, p):
    """Of good: the average of the features' class scores, plus the biases, through softmax."""
    f = features(text, p).tolist()
    z = [sum(float(shares[i][k]) for i in f) / max(1, len(f)) + float(bias[k]) for k in range(3)]
    e = [math.exp(x - max(z)) for x in z]
    return e[1] / sum(e)


def test_scores_match_brute_force(spark):
    rng = random.Random(2)
    docs, labels = sample(rng, 300)
    df, p = spark.createDataFrame(docs, SCHEMA), FAST
    labels = spark.createDataFrame(labels, LABELS)
    shares, bias = train(*labelled_sample(df, labels, p), p)
    got = {r["doc_id"]: (r["p_good"], r["keep"]) for r in quality_scores(df, labels, p).collect()}
    for d, t, *_ in docs:
        want = brute_probability(t, shares, bias, p)
        assert abs(got[d][0] - want) < 1e-4 and (got[d][1] == (want >= p.keep_from) or abs(want - p.keep_from) < 1e-4)


def test_quality_on_odd_rows(spark):
    docs = odd_documents(spark, clash=True)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 0), (4, 0, 1), (6, 1, None), (7, 0, 0), (None, 1, 1), (5, None, 1), (99, 1, 0)], LABELS)
    got = quality_scores(docs, labels, FAST)
    assert got.count() == docs.count() and got.where("p_good is null").count() == 0
    assert got.columns == [*(c for c in docs.columns if c != "keep"), "p_low", "p_good", "p_toxic", "keep"]
    kept = keep_good(docs, labels, FAST)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    assert keep_good(docs, labels.limit(0), FAST).count() == docs.count()
    assert quality_scores(no_documents(spark), labels, FAST).count() == 0


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(VOCABULARY)


def texts():
    rng = random.Random(8)
    out = ["", " ", "hello world", "don't STOP 123 ¡olé!\n\n  x", "\x00\x7f", "日本語テキスト", "\U0001f600\U0001f468‍\U0001f469", "a" * 5000, "<|endoftext|>", "�", "x  \t y", "٣٤ Ⅷ ² ª", " _under_score_ "]
    letters = [chr(c) for c in [*range(32, 127), *range(0xC0, 0x180), *range(0x400, 0x450), 0x3042, 0x1F600, 0x2028, 0x85, 0xA0, 0x1C, 10, 9]]
    return out + ["".join(rng.choices(letters, k=rng.randrange(1, 200))) for _ in range(300)] + ["".join(rng.choices("abne t", k=120)) for _ in range(100)]


def test_tokens_are_those_of_a_reference_library(ranks):
    import tiktoken

    want = tiktoken.Encoding("own", pat_str=r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{L}\p{N}\s]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})
    e, d = Encoder(ranks, odd_characters()), Decoder({v: k for k, v in ranks.items()})
    for t in texts():
        ids = e.encode(t)
        assert ids == want.encode_ordinary(t) and d.decode(ids) == t
    assert PATTERN


def test_transducer_matches_plain_merging(ranks):
    t, rng = Transducer(ranks), random.Random(5)
    for _ in range(300):
        data = bytes(rng.choices(b"abcdetion \xc3\xa9\xff0", k=rng.randrange(1, 60)))
        assert list(t.encode(data)) == t.merge(data)
    with pytest.raises(ValueError):
        Transducer({b"a": 0})


def test_all_bytes_are_read_by_moves_of_the_machine(ranks, monkeypatch):
    t, rng = Transducer(ranks), random.Random(7)
    calls, made = [], t._made
    monkeypatch.setattr(t, "_made", lambda at, b: calls.append(1) or made(at, b))
    pieces = [" " + "".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 9))).capitalize() for _ in range(3000)]
    for x in pieces:
        assert list(t.encode(x.encode())) == t.merge(x.encode())
    assert t.read == sum(map(len, pieces)) and t.made == len(calls) == len(t.moves)
    for x in pieces:
        t.encode(x.encode())
    assert t.made == len(calls) < 0.6 * t.read / 2  # nothing is made twice


def test_moves_survive_by_use(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "MOVES", 300)
    t, rng = Transducer(ranks), random.Random(9)
    for i in range(1500):
        data = bytes(rng.choices(b"abcdetion \xc3\xa9\xff0", k=rng.randrange(1, 40))) if i % 2 else b" hello"
        made = t.made
        assert list(t.encode(data)) == t.merge(data)
        assert i < 2 or i % 2 or t.made == made  # what is used is never made again
        assert len(t.moves) <= 340 and len(t.old) <= 340 and len(t.states) < 1500


def test_long_runs_take_linear_time(ranks):
    import time

    rng, t = random.Random(10), Transducer(ranks)
    data = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300_000)).encode()
    began = time.time()
    t.encode(data[:30_000])
    short, began = time.time() - began, time.time()
    ids = t.encode(data)
    assert time.time() - began < 30 * short + 5
    back = {v: k for k, v in ranks.items()}
    assert b"".join(map(back.get, ids)) == data


def test_decoder_is_that_of_utf8(ranks):
    byte = {bytes([b]): ranks[bytes([b])] for b in range(256)}
    d, rng = Decoder({v: k for k, v in ranks.items()}), random.Random(6)
    for _ in range(3000):
        data = bytes(rng.choices(b"a\xc3\xa9\xe2\x82\xac\xf0\x9f\x98\x80\xed\xa0\x80\xc0\xff\xf4\x90", k=rng.randrange(8)))
        ids = [byte[data[i : i + 1]] for i in range(len(data))]
        assert d.decode(ids) == data.decode("utf-8", "replace")
        d.reset()
        assert "".join(map(d.feed, ids)) + d.finish() == data.decode("utf-8", "replace")


def test_bpe_on_odd_rows(spark, ranks):
    docs = odd_documents(spark, clash=True)
    got = encode_documents(docs)
    rows = got.collect()
    assert len(rows) == docs.count() and all(r["round_trip"] is (None if r["text"] is None else True) for r in rows)
    assert all((r["tokens"] is None) == (r["text"] is None) and r["n_tokens"] == (None if r["tokens"] is None else len(r["tokens"])) for r in rows)
    back = decode_documents(got.select("doc_id", "tokens", got["text"].alias("was")))
    assert back.where("not (text <=> was)").count() == 0
    assert encode_documents(no_documents(spark)).count() == 0 and decode_documents(encode_documents(no_documents(spark))).count() == 0
