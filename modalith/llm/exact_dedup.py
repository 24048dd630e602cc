"""Exact dedup: tree-merge of sorted digest runs.

Every partition makes a run: its texts' digests in order, each with the smallest identifier that has it. Runs then merge in rounds, as
in a binomial reduction with ``fan_in`` children a node: in each round the runs whose numbers agree after division by ``fan_in`` meet,
and are merged in one pass that keeps the smallest identifier of each digest. Where the merged run would be too long for one task, the
runs are cut into lanes of digests by their first bits, and each lane is a task of its own. Lanes thus double as runs become fewer: at
every level a task has about as many entries, and there are about as many tasks.

A run is ordered by an 8-byte digest. Two entries that agree in it are the same text only if SHA-256 and byte length agree as well;
this is verified at every level, and entries that differ there are both retained.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modalith.llm.common import checkpointed, col, fresh, sized

#: An entry of a run.
ENTRY = "run long, digest long, sha binary, bytes long, id long, rows long, id_rows long"
_SCHEMA = pa.schema([("run", pa.int64()), ("digest", pa.int64()), ("sha", pa.binary()), ("bytes", pa.int64()), ("id", pa.int64()), ("rows", pa.int64()), ("id_rows", pa.int64())])
#: Entries that a task should merge at most.
LANE_ROWS = 200_000


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """One run of several: tuples (digest, sha, bytes, id or None, rows, rows with that id), in order of (digest, sha, bytes)."""
    for key, same in groupby(heapq.merge(*runs, key=lambda e: e[:3]), key=lambda e: e[:3]):
        best, best_rows, rows = None, 0, 0
        for e in same:
            rows += e[4]
            if e[3] == best:
                best_rows += e[5]
            elif best is None or (e[3] is not None and e[3] < best):
                best, best_rows = e[3], e[5]
        yield (*key, best, rows, best_rows)


def digest_columns(text: str) -> list:
    t = col(text)
    return [F.xxhash64(t).alias("digest"), F.unhex(F.sha2(t, 256)).alias("sha"), F.octet_length(t).cast("long").alias("bytes")]


def digest_runs(docs: DataFrame) -> DataFrame:
    """A sorted run for each partition. Rows with a null text take no part. The JVM sorts, and spills if it must; repeats are then
    neighbours and fall together batch by batch."""
    hashed = docs.where(col("text").isNotNull()).select(F.spark_partition_id().cast("long").alias("run"), *digest_columns("text"), col("doc_id").cast("long").alias("id"))
    ordered = hashed.sortWithinPartitions("digest", "sha", "bytes", F.col("id").asc_nulls_last())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not len(batch):
                continue
            ones = pa.array(np.ones(len(batch), np.int64))
            whole = _collapsed(pa.RecordBatch.from_arrays([*batch.columns, ones, ones], schema=_SCHEMA), held)
            # the last entry may go on in the next batch
            held = whole.slice(len(whole) - 1)
            yield whole.slice(0, len(whole) - 1)
        if held is not None:
            yield held

    return ordered.mapInArrow(make, ENTRY)


def _collapsed(entries: pa.RecordBatch, before: pa.RecordBatch | None = None) -> pa.RecordBatch:
    """One entry for every (digest, sha, bytes) of entries in order of these and of id; before: an entry that comes first."""
    if before is not None:
        entries = pa.Table.from_batches([before, entries]).combine_chunks().to_batches()[0]
    new = np.ones(len(entries), bool)
    for name in ("digest", "sha", "bytes"):
        c = entries[name]
        differs = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        new[1:] = differs if name == "digest" else new[1:] | differs
    starts = np.flatnonzero(new)
    if len(starts) == len(entries):
        return entries
    ids, none = entries["id"].fill_null(0).to_numpy(), entries["id"].is_null().to_numpy(zero_copy_only=False)
    first = np.repeat(starts, np.diff(np.append(starts, len(entries))))
    own = (ids == ids[first]) & (none == none[first])
    rows = np.add.reduceat(entries["rows"].to_numpy(), starts)
    id_rows = np.add.reduceat(np.where(own, entries["id_rows"].to_numpy(), 0), starts)
    kept = entries.take(pa.array(starts))
    return pa.RecordBatch.from_arrays([*kept.columns[:5], pa.array(rows), pa.array(id_rows)], schema=_SCHEMA)


def merge_round(runs: DataFrame, fan_in: int, bits: int = 0) -> DataFrame:
    """The runs of the next level: one for every fan_in of these, merged in 2^bits lanes."""

    def merge(table: pa.Table) -> pa.Table:
        by_run: dict[int, list] = {}
        for run, *e in zip(*(table[c].to_pylist() for c in ("run", "digest", "sha", "bytes", "id", "rows", "id_rows"))):
            by_run.setdefault(run, []).append(tuple(e))
        for entries in by_run.values():
            entries.sort(key=lambda e: e[:3])  # a run that was cut in transit comes in ordered pieces, which this joins in linear time
        done = list(zip(*merged([iter(e) for e in by_run.values()])))
        return pa.table([pa.array([table["parent"][0].as_py()] * len(done[0]), pa.int64()), *(pa.array(c, f.type) for c, f in zip(done, list(_SCHEMA)[1:]))], schema=_SCHEMA)

    lane = F.shiftrightunsigned("digest", 64 - bits) if bits else F.lit(0).cast("long")
    up = runs.withColumns({"parent": F.floor(F.col("run") / fan_in).cast("long"), "lane": lane})
    return up.groupBy("lane", "parent").applyInArrow(merge, ENTRY)


def digest_roots(docs: DataFrame, fan_in: int = 16, lane_rows: int = LANE_ROWS) -> DataFrame:
    """One entry for every distinct text: the roots of all lanes."""
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    # the number of runs is read from the runs: another plan over docs, as a count of partitions is, may be cut otherwise
    runs = checkpointed(digest_runs(docs))
    facts = runs.agg(F.max("run").alias("run"), F.count("*").alias("n")).first()
    left, tasks = (facts["run"] or 0) + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = 0
    while left > 1:
        if rounds and rounds % 3 == 0:
            runs = checkpointed(runs)
        left = -(-left // fan_in)
        # enough lanes for the entries of a merged run, and for all tasks to have work
        bits = max(0, max(-(-facts["n"] // lane_rows), tasks) - 1) // left
        runs, rounds = merge_round(runs, fan_in, bits.bit_length()), rounds + 1
    return runs


def repeated_texts(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """(digest, sha, bytes, kept_id, rows, id_rows) of every text that has several rows; checkpointed."""
    return checkpointed(digest_roots(docs, fan_in).where("rows > 1").select("digest", "sha", "bytes", F.col("id").alias("kept_id"), "rows", "id_rows"))


def exact_copies(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """(doc_id, kept_id) for every row whose text another row keeps: the one with the smallest doc_id.

    Texts are equal if their bytes are; an empty text equals another, a null one none. Of rows that share both text and smallest
    doc_id one is kept, and each further one gives a row with doc_id = kept_id. A null doc_id comes after all others; if no row of a
    text has one, one row is kept and each other gives a row of two nulls. Other columns play no part. An empty table gives no rows.
    """
    same = repeated_texts(docs, fan_in)
    ids = docs.where(col("text").isNotNull()).select(col("doc_id").alias("doc_id"), *digest_columns("text"))
    others = ids.join(sized(same), ["digest", "sha", "bytes"]).where(~F.col("doc_id").eqNullSafe(F.col("kept_id"))).select("doc_id", "kept_id")
    again = same.where("id_rows > 1").select(F.col("kept_id").alias("doc_id"), "kept_id", F.explode(F.sequence(F.lit(2), F.col("id_rows"))).alias("n"))
    return others.unionByName(again.select("doc_id", "kept_id"))


def drop_exact_copies(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """docs without the rows that exact_copies lists; where several rows share text and doc_id, the one whose other columns, as JSON,
    come first stays."""
    same = repeated_texts(docs, fan_in)
    row, digest, sha, size, place, kept, times = fresh(docs, "row_", "digest", "sha", "bytes", "place", "kept_id", "id_rows")
    keyed = docs.withColumns(dict(zip((digest, sha, size), digest_columns("text"))))
    facts = same.select(F.col("digest").alias(digest), F.col("sha").alias(sha), F.col("bytes").alias(size), F.col("kept_id").alias(kept), F.col("id_rows").alias(times))
    found = keyed.join(sized(facts), [digest, sha, size], "left")
    once = found.where(F.col(times).isNull() | ((F.col(times) == 1) & col("doc_id").eqNullSafe(F.col(kept))))
    out = once.select(*(col(c) for c in docs.columns))
    several = facts.where(F.col(times) > 1)
    if several.isEmpty():
        return out
    order = Window.partitionBy(digest, sha, size).orderBy(F.to_json(F.struct(*(col(c) for c in docs.columns))))
    tied = found.where((F.col(times) > 1) & col("doc_id").eqNullSafe(F.col(kept))).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return out.unionByName(tied.select(*(col(c) for c in docs.columns)))
