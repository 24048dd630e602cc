"""MinHash near-dedup with circulant signatures.

A document is the set of its word n-grams. One permutation sigma places each n-gram on a circle; a second, pi, is read from there on:
coordinate k of the signature is the least pi[sigma(x) + k] over the set, so two permutations give all coordinates, the k-th by
shifting pi circularly by k. Because an n-gram's values are neighbours in memory, a signature is a column-wise minimum over slices.

Coordinates are cut into bands; documents with an equal band are candidates. Documents with the same set collapse first. In each
bucket a pivot is compared with all others. Buckets that then still hold several groups are compared pair by pair if they are small.
The documents of the larger ones meet in an exact set-similarity join instead (`crowd_pairs`), so no bucket is capped and none costs
its square. A pair is linked only if the exact Jaccard index of the two sets, kept as 64-bit hashes, reaches the threshold. Groups are
the connected components of the links.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalith.llm.common import checkpointed, col, fresh, sized, with_texts
from modalith.llm.components import components

#: Words whose hashes a task remembers at most; then it starts anew.
MEMO = 200_000
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class NearParams:
    """bands x rows coordinates. A pair at the threshold shares a band with probability 0.95, one of index 0.6 with 0.999. A copy with
    one word in ten exchanged has an index of about 0.57. crowd: buckets of more documents are a crowd, and n-grams of more documents
    of crowds are hot; it changes the plan, not the links."""

    threshold: float = 0.5
    ngram: int = 3
    bands: int = 48
    rows: int = 4
    circle: int = 1 << 20
    seed: int = 11
    crowd: int = 64


class Shingler:
    """A text's set of word n-grams, as sorted distinct 64-bit hashes. Case and punctuation don't count; a text of fewer words than n
    is one n-gram, one without words is the empty set."""

    def __init__(self, n: int) -> None:
        self.n, self.memo = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, get, h = self.memo, self.memo.get, xxhash.xxh64_intdigest
        ids = []
        for w in words:
            v = get(w)
            if v is None:
                v = memo[w] = h(w)
            ids.append(v)
        x = np.array(ids, np.uint64)
        n = min(self.n, len(x))
        out = np.full(len(x) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ x[k : len(x) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


class Circulant:
    def __init__(self, p: NearParams) -> None:
        rng = np.random.default_rng(p.seed)
        k = p.bands * p.rows
        self.p, self.sigma = p, rng.permutation(p.circle).astype(np.int32)
        pi = rng.permutation(p.circle).astype(np.int32)
        self.pi = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.sigma[(shingles % np.uint64(self.p.circle)).astype(np.int64)]
        best = self.pi[at[:1024]].min(0)
        for i in range(1024, len(at), 1024):
            np.minimum(best, self.pi[at[i : i + 1024]].min(0), out=best)
        return best

    def bands(self, shingles: np.ndarray) -> list[int]:
        s = np.ascontiguousarray(self.signature(shingles)).reshape(self.p.bands, self.p.rows)
        return [xxhash.xxh64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(s)]


def signatures(docs: DataFrame, p: NearParams) -> DataFrame:
    """(v, doc_id, th, n, same, bands) of every row with words: a number, hash of its text, size and digest of its set, hashes of its
    bands; checkpointed, so that the numbers stay."""

    def make() -> Callable:
        shingler, circulant = Shingler(p.ngram), Circulant(p)

        def work(texts: list[str]) -> tuple:
            sets = [shingler(t) for t in texts]
            return [len(x) for x in sets], [xxhash.xxh128_digest(x.tobytes()) for x in sets], [circulant.bands(x) if len(x) else [] for x in sets]

        return work

    some = docs.where(col("doc_id").isNotNull() & col("text").isNotNull())
    keyed = some.select(col("doc_id").cast("long").alias("doc_id"), F.xxhash64(col("text")).alias("th"), col("text").alias("text"))
    made = with_texts(keyed, make, "n int, same binary, bands array<bigint>", ["doc_id", "th"]).where("n > 0")
    return checkpointed(made.withColumn("v", F.monotonically_increasing_id()))


def shingle_sets(docs: DataFrame, wanted: DataFrame, p: NearParams) -> DataFrame:
    """(v, set) of the wanted documents (doc_id, th, v); checkpointed."""

    def make() -> Callable:
        shingler = Shingler(p.ngram)
        return lambda texts: ([shingler(t).view(np.int64) for t in texts],)

    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text")).withColumn("th", F.xxhash64("text"))
    found = with_texts(rows.join(sized(wanted), ["doc_id", "th"]).dropDuplicates(["v"]).select("v", "text"), make, "set array<bigint>", ["v"])
    return checkpointed(found)


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets' Jaccard index reaches the threshold."""
    left = pairs.join(sets.select(F.col("v").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("v").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= F.lit(threshold) * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


def crowd_pairs(sets: DataFrame, p: NearParams) -> DataFrame:
    """Pairs (a, b) of the sets (v, set), among them enough that their links join all that the links of all pairs would.

    Sets whose index reaches the threshold t share an n-gram among the first size - ceil(t x size) + 1 of each, whatever the order. In
    order of rising frequency these are mostly rare. N-grams in at most `crowd` sets give their pairs. A pair that shares none of these
    shares hot n-grams alone, of which either then has t x size or more; such a set is paired with the smallest set of each distinct
    selection of hot n-grams with which it shares one. That is enough: if i and j are linked by hot n-grams alone, and r and s are the
    smallest sets with the selections of i and of j, then so are i and s, r and j, and r and s, as an index only grows with a smaller
    union. Sets over a few n-grams, in ever new selections that are all hot, cost the square of the number of selections.
    """
    n = F.size("set")
    sized_sets = sets.select("v", n.alias("n"), F.explode("set").alias("t"))
    counts = sized_sets.groupBy("t").agg(F.count("*").alias("f"))
    ordered = sized_sets.join(counts, "t").groupBy("v", "n").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("ts"))
    keep = (F.col("n") - F.ceil(F.lit(p.threshold) * F.col("n") - 1e-9) + 1).cast("int")
    hot = F.filter("ts", lambda x: x["f"] > p.crowd)
    marked = checkpointed(
        ordered.select(
            "v", "n", F.transform(F.filter(F.slice("ts", 1, keep), lambda x: x["f"] <= p.crowd), lambda x: x["t"]).alias("cold"),
            F.when(F.size(hot) >= F.lit(p.threshold) * F.col("n") - 1e-9, F.transform(hot, lambda x: x["t"])).alias("hot"), keep.alias("keep"),
        )
    )
    fits = F.least("n", "m") >= F.lit(p.threshold) * F.greatest("n", "m")
    cold = marked.select("v", "n", F.explode("cold").alias("t"))
    rare = cold.join(cold.select(F.col("v").alias("b"), F.col("n").alias("m"), "t"), "t").where("v < b").where(fits).select(F.col("v").alias("a"), "b")
    heavy = marked.where("hot is not null").select("v", "n", "keep", F.array_sort("hot").alias("hot")).withColumn("key", F.sha2(F.array_join("hot", ","), 256))
    least = heavy.groupBy("key").agg(F.min(F.struct("n", "v")).alias("r"), F.first("hot").alias("hot"))
    mine = heavy.select("v", "n", F.explode("hot").alias("t"))
    # of the smallest sets the t-prefix within the hot n-grams is enough: a pair that shares these alone has t x size of them in common
    theirs = least.select(F.col("r.v").alias("b"), F.col("r.n").alias("m"), F.explode(F.slice("hot", 1, F.greatest(F.lit(1), F.size("hot") - F.ceil(F.lit(p.threshold) * F.col("r.n") - 1e-9).cast("int") + 1))).alias("t"))
    often = mine.join(theirs, "t").where("v != b").where(fits).select(F.col("v").alias("a"), "b")
    return rare.unionByName(often).distinct()


def near_groups(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """(doc_id, th, kept_id, kept_th) of every document but the kept one of each group of near copies, each once.

    Nodes are rows, known by number. Wherever rows meet by a key, be it a set, a bucket or a group, what all of them need of each other
    is aggregated first and joined back: a key that a third of all rows have is then split like any skewed join.
    """
    sigs = signatures(docs, p)
    alike = checkpointed(sigs.groupBy("same").agg(F.min("v").alias("rep"), F.max("v").alias("top")).where("rep != top").select("same", "rep"))
    paired = sigs.join(sized(alike), "same", "left")
    twins = paired.where("v != rep").select(F.col("v").alias("a"), F.col("rep").alias("b"))
    rows = paired.where("rep is null or v = rep").select("v", "n", F.explode("bands").alias("h"))
    buckets = rows.groupBy("h").agg(F.min("v").alias("p"), F.max("v").alias("top"), F.count("*").alias("size")).where("p != top")
    full = checkpointed(rows.join(buckets.drop("top"), "h"))  # (h, v, n, p, size) of the buckets with several nodes, of which p is the pivot
    members = checkpointed(full.select("v").distinct())
    wanted = checkpointed(sigs.select("v", "doc_id", "th").join(sized(members), "v", "left_semi"))
    sets = shingle_sets(docs, wanted.groupBy("doc_id", "th").agg(F.min("v").alias("v")), p)
    fits = F.least("n", "m") >= F.lit(p.threshold) * F.greatest("n", "m")  # else the index can't reach the threshold
    pivots = full.where("v = p").select("p", F.col("n").alias("m")).distinct()
    stars = full.where("v != p").select("v", "n", "p").distinct().join(pivots, "p").where(fits).select(F.col("v").alias("a"), F.col("p").alias("b"))
    first = checkpointed(_linked(stars, sets, p.threshold))
    label = components(first)
    named = full.join(label.select(F.col("a").alias("v"), F.col("b").alias("root")), "v", "left").withColumn("root", F.coalesce("root", "v"))
    # buckets that still hold several groups besides the pivot's own comparisons
    mixed = named.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("h")
    split = checkpointed(named.where("size > 2 and v != p").join(mixed, "h", "left_semi").select("h", "v", "n", "root", "size"))
    few = split.where(F.col("size") <= p.crowd)
    other = few.select("h", F.col("v").alias("b"), F.col("n").alias("m"), F.col("root").alias("root2"))
    rest = few.join(other, "h").where("v < b and root != root2").where(fits).select(F.col("v").alias("a"), "b")
    crowd = checkpointed(split.where(F.col("size") > p.crowd).select("v").distinct())
    if not crowd.isEmpty():
        rest = rest.unionByName(crowd_pairs(sets.join(sized(crowd), "v", "left_semi"), p))
    links = first.unionByName(_linked(rest.distinct(), sets, p.threshold)).unionByName(twins)
    final = components(links)
    # the number of a group's kept row is its smallest doc_id's
    at = sigs.select("v", "doc_id", "th")
    roots = checkpointed(final.select(F.col("a").alias("v"), "b").unionByName(final.select(F.col("b").alias("v"), "b").distinct()))
    placed = checkpointed(at.join(sized(roots), "v"))
    kept = placed.groupBy("b").agg(F.min(F.struct("doc_id", "th")).alias("k"))
    return placed.join(kept, "b").where("doc_id != k.doc_id or th != k.th").select("doc_id", "th", F.col("k.doc_id").alias("kept_id"), F.col("k.th").alias("kept_th")).distinct()


def near_copies(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """(doc_id, kept_id) for every document that is in a group of near copies and not its smallest doc_id.

    Rows with a null doc_id, a null text or a text without words take no part. Rows that repeat both doc_id and text are one document;
    rows that share a doc_id but not the text are several, and if these are near copies give doc_id = kept_id. An empty table gives no
    rows; other columns play no part.
    """
    return near_groups(docs, p).select("doc_id", "kept_id")


def drop_near_copies(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """docs without the documents that near_groups lists: of every group one document stays. Rows that take no part stay; rows that
    repeat doc_id and text stand or fall together."""
    th, did = fresh(docs, "th", "did")
    gone = near_groups(docs, p).select(F.col("doc_id").alias(did), F.col("th").alias(th))
    marked = docs.withColumns({th: F.xxhash64(col("text")), did: col("doc_id").cast("long")})
    return marked.join(sized(checkpointed(gone.distinct())), [did, th], "left_anti").select(*(col(c) for c in docs.columns))
