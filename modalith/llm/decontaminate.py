"""Benchmark decontamination: pigeonhole edit matching.

Text is lowered and every run of other characters than letters, digits and underscores becomes a space. Text and item then get a space
at either end, so that an item begins and ends with a word: an item that must occur unchanged occurs in whole words only. A test item
of m characters may occur with up to k = floor(error_rate x m) edits. Cut into k + 1 pieces, one of them then occurs unchanged: an Aho-Corasick
automaton finds all pieces in one pass over a document, and the stretch around each hit is verified by Myers' bit-parallel edit
distance.

Two cheap tests come before that. Pieces are paired: if each pair had two edits or more and an unpaired piece one or more, there would
be more than k, so in some pair one piece is unchanged and the other has at most one edit. A hit thus counts only if one half of the
piece beside it is there unchanged too, shifted by one character at most; only for an unpaired piece this isn't asked. And a stretch
is dismissed if it lacks more than 2k of the item's character pairs, which no k edits can destroy.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalith.llm.common import col, fresh, with_texts

_GAP = re.compile(r"\W+")


@dataclass(frozen=True)
class LeakParams:
    """Items shorter than min_chars, after normalisation, must occur unchanged; those shorter than least_chars, such as a bare "yes",
    prove nothing and are left out. batch_chars: of the items that one automaton holds; more items than that are matched in several
    passes, so what a task receives stays bounded."""

    error_rate: float = 0.1
    min_chars: int = 20
    least_chars: int = 8
    batch_chars: int = 8_000_000


def normalised(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def edits(pattern: str, text: str) -> int:
    """The least edit distance of pattern to any substring of text."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    get = peq.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full
        pv = (mh << 1 & full) | (full & ~(xv | ph))
        mv = ph & xv
    return best


def _pairs(s: str) -> Counter:
    return Counter(map(str.__add__, s, s[1:]))


class Matcher:
    def __init__(self, items: list[tuple[str | None, str]], p: LeakParams) -> None:
        """items: (name, text)."""
        self.items = []
        pieces: dict[str, list[tuple[int, int, tuple | None]]] = {}
        for name, text in items:
            t = normalised(text)
            if len(t) < max(1, p.least_chars):
                continue
            k = int(p.error_rate * len(t)) if len(t) >= p.min_chars else 0
            t = f" {t} "
            m, at = len(t), len(self.items)
            self.items.append((name, t, k, _pairs(t)))
            cuts = [i * m // (k + 1) for i in range(k + 2)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                pieces.setdefault(t[a:b], []).append((at, b, self._beside(t, cuts, i)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, where)
        if pieces:
            self.automaton.make_automaton()
        self.some = bool(pieces)

    @staticmethod
    def _beside(t: str, cuts: list[int], i: int) -> tuple | None:
        """Of the piece that is paired with piece i: for either half, the half and where it is at the least and the most from the end
        of piece i. None if it has no pair."""
        if i | 1 > len(cuts) - 2:
            return None
        a, b = cuts[i ^ 1], cuts[(i ^ 1) + 1]
        mid, end = (a + b) // 2, cuts[i + 1]
        near, far = ((a, mid), (mid, b)) if i % 2 == 0 else ((mid, b), (a, mid))
        return t[slice(*near)], near[0] - end, t[slice(*far)], far[0] - end - 1, far[1] - end + 1

    def leaks(self, text: str | None) -> list[tuple[str | None, int, int]]:
        """(name, edits, length) of every item that the text holds."""
        if not text or not self.some:
            return []
        t = f" {normalised(text)} "
        spots: dict[int, list[tuple[int, int]]] = {}
        for end, where in self.automaton.iter(t):
            for item, b, beside in where:
                if beside:
                    near, at, far, lo, hi = beside
                    at += end + 1
                    if not (at >= 0 and t.startswith(near, at)) and t.find(far, max(0, end + 1 + lo), max(0, end + 1 + hi)) < 0:
                        continue
                _, s, k, _ = self.items[item]
                lo = end + 1 - b - k
                hi = lo + len(s) + 2 * k
                mine = spots.setdefault(item, [])
                if mine and lo <= mine[-1][0] + 2 * k and lo >= mine[-1][0]:  # much the same stretch
                    mine[-1] = (mine[-1][0], max(hi, mine[-1][1]))
                else:
                    mine.append((lo, hi))
        out = []
        for item, mine in spots.items():
            name, s, k, pairs = self.items[item]
            best = k + 1
            for lo, hi in mine:
                stretch = t[max(0, lo) : hi]
                if s in stretch:
                    best = 0
                    break
                if k and sum((pairs - _pairs(stretch)).values()) <= 2 * k:
                    best = min(best, edits(s, stretch))
            if best <= k:
                out.append((name, best, len(s) - 2))
        return out


def _batches(benchmark: DataFrame, p: LeakParams) -> Iterator[list[tuple[str | None, str]]]:
    """The items, in lists of about batch_chars each."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    n = 1 + (items.agg(F.sum(F.length("text"))).first()[0] or 0) // p.batch_chars
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).distinct().collect()
        if rows:
            yield sorted(((r["item"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x[0] or "", x[1]))


def _matcher(batch: list[tuple[str | None, str]], p: LeakParams) -> Callable:
    def make() -> Callable:
        matcher = Matcher(batch, p)
        return lambda texts: ([[{"item": a, "edits": b, "chars": c} for a, b, c in matcher.leaks(t)] for t in texts],)

    return make


_HITS = "array<struct<item:string,edits:int,chars:int>>"


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """(doc_id, item, similarity) for every document and item that it holds: similarity is 1 - edits / characters, after
    normalisation. item is item_id as a string, null for a null one. doc_id is read as a long; one that is none is an error under ANSI
    and null otherwise.

    Null texts, null items and items of fewer than least_chars characters match nothing. Repeated rows of docs give repeated rows; repeated
    items one. Empty tables give no rows; other columns play no part.
    """
    out = docs.sparkSession.createDataFrame([], "doc_id long, item string, similarity double")
    ids = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text")).where("text is not null")
    for batch in _batches(benchmark, p):
        hits = with_texts(ids, _matcher(batch, p), f"hits {_HITS}", ["doc_id"]).select("doc_id", F.explode("hits").alias("h"))
        out = out.unionByName(hits.select("doc_id", F.col("h.item").alias("item"), (1 - F.col("h.edits") / F.col("h.chars")).alias("similarity")))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """docs without the rows that hold an item. See benchmark_leaks; rows with a null text stay."""
    (hits,) = fresh(docs, "hits")
    names = docs.columns
    for batch in _batches(benchmark, p):
        docs = with_texts(docs, _matcher(batch, p), f"{hits} {_HITS}").where(F.size(hits) == 0).select(*(col(c) for c in names))
    return docs
