"""Writers: any dataset to shards (table and tar) or to folders (table and folder).

Rows get a dense index, which gives the shard (index // max_files) and the file's number. Each shard is built by one task, in the
order of the index, under a name of its own attempt, and moved to its place in a commit on the driver: a task that runs twice, or
fails, leaves nothing half-written. A later write goes on behind the last shard that is there.
"""

from __future__ import annotations

import csv
import io
import os
import shutil
import tarfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalith.operators.tables import dense_index
from modalith.sources.media import Fetcher
from modalith.sources.spec import COLUMN, FOLDERS, MODALITIES, SHARDS, DatasetSpec, Stored
from modalith.sources.storage import Storage, local, openers, scheme

_DONE = "shard long, rows long, temporary string"


def column_order(columns: list[str]) -> list[str]:
    """Names of files first, then paths, then text, then the rest."""
    ms = MODALITIES.values()
    first = [*(m.name for m in ms), *(m.path for m in ms), *(m.column for m in ms if m.column)]
    return [c for c in first if c in columns] + [c for c in columns if c not in first]


def renamed(row: dict, names: dict[str, str]) -> dict:
    lacking = set(names) - set(row)
    if lacking:
        raise KeyError(f"there is no column {sorted(lacking)}")
    return {names.get(k, k): v for k, v in row.items()}


def next_shard(df: DataFrame, folder: str, table_ext: str = "csv") -> int:
    """One more than the largest shard's number in a folder, which is made if it isn't there."""
    storage = Storage(df.sparkSession)
    if not storage.exists(folder):
        storage.mkdir(folder)
        return 0
    taken = [int(n.partition(".")[0]) for n in storage.names(folder) if n.endswith(f".{table_ext}") and n.partition(".")[0].isdigit()]
    return max(taken, default=-1) + 1


def write(
    df: DataFrame,
    spec: DatasetSpec,
    folder: str,
    layout: str = SHARDS,
    max_files: int = 1000,
    naming: str = "counter",
    columns: list[str] | None = None,
    rename: dict[str, str] | None = None,
    order: list[Column] | None = None,
    table_ext: str = "csv",
    archive_ext: str = "tar",
) -> DatasetSpec:
    """Writes the modalities of df, and columns of it, and returns the new dataset's spec.

    folder must be one that all executors see. Files keep their extension; naming is counter or uuid, and samples of several
    modalities share their number. rename applies to the written table.
    """
    if layout not in (SHARDS, FOLDERS):
        raise ValueError("layout must be shards or sharded_files")
    if naming not in ("counter", "uuid"):
        raise ValueError("naming must be counter or uuid")
    if scheme(folder) not in ("", "file"):
        raise ValueError("shards are written to a mounted file system; copy them from there")
    if table_ext not in ("csv", "parquet"):
        raise ValueError("tables are csv or parquet")
    columns, rename, root = columns or [], rename or {}, local(folder)
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise KeyError(f"there is no column {lacking}")
    first = next_shard(df, folder, table_ext)
    own = [s.final for s in spec.stored]
    extra = [c for c in columns if c not in own]
    indexed = dense_index(df.select(*own, *extra), order or [F.col(own[0])], "_index")
    plan = indexed.withColumn("_shard", F.floor(F.col("_index") / max_files) + first)
    ext = spec.archive_ext if spec.layout == SHARDS else None
    files = {s.final: MODALITIES[s.modality].name for s in spec.stored if s.how != COLUMN}
    base = first * max_files

    found = openers()

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        get, shard = Fetcher(ext, found), int(rows["_shard"].iloc[0])
        temporary = os.path.join(root, f".{shard}-{uuid.uuid4().hex}")
        os.makedirs(temporary)
        names = [n for n in column_order([*files.values(), *(c for c in own if c not in files), *extra])]
        records = []
        inside = os.path.join(temporary, f"{shard}.{archive_ext}" if layout == SHARDS else str(shard))
        tar = tarfile.open(inside, "w") if layout == SHARDS else os.makedirs(inside)
        for row in rows.sort_values("_index").to_dict("records"):
            stem = str(base + int(row["_index"])) if naming == "counter" else uuid.uuid4().hex
            record = {c: row[c] for c in names if c in row}
            for path, name in files.items():
                dot = os.path.basename(row[path]).rfind(".")
                record[name] = stem + (os.path.basename(row[path])[dot:] if dot >= 0 else "")
                blob = get(row[path])
                if tar is not None:
                    info = tarfile.TarInfo(record[name])
                    info.size = len(blob)
                    tar.addfile(info, io.BytesIO(blob))
                else:
                    with open(os.path.join(inside, record[name]), "wb") as f:
                        f.write(blob)
            records.append(renamed({c: record[c] for c in names}, rename))
        if tar is not None:
            tar.close()
        get.close()
        table = os.path.join(temporary, f"{shard}.{table_ext}")
        if table_ext == "csv":
            with open(table, "w", newline="", encoding="utf-8") as f:
                out = csv.DictWriter(f, list(records[0]), lineterminator="\n")
                out.writeheader()
                out.writerows(records)
        else:
            pd.DataFrame(records).to_parquet(table, index=False)
        return pd.DataFrame({"shard": [shard], "rows": [len(records)], "temporary": [temporary]})

    # one row a shard comes back
    done = plan.groupBy("_shard").applyInPandas(build, _DONE).collect()
    try:
        for r in done:
            # files before the table that tells of them
            for name in sorted(os.listdir(r["temporary"]), key=lambda n: n.endswith(f".{table_ext}")):
                os.rename(os.path.join(r["temporary"], name), os.path.join(root, name))
    finally:
        mine = {os.path.basename(r["temporary"]).partition("-")[0] for r in done}
        for name in os.listdir(root):
            if name.startswith(".") and name.partition("-")[0] in mine:
                shutil.rmtree(os.path.join(root, name), ignore_errors=True)
    stored = tuple(
        Stored(s.modality, s.how if s.how == COLUMN else "sharded", rename.get(c, c))
        for s in spec.stored
        for c in [s.final if s.how == COLUMN else MODALITIES[s.modality].name]
    )
    return DatasetSpec(layout, folder.rstrip("/"), stored, table_ext, archive_ext)


def write_single_table(df: DataFrame, path: str) -> None:
    """df as one CSV or Parquet file, in place of what is there. For tables of a shard's size: one task writes it."""
    from modalith.sources.storage import table_format

    storage, kind = Storage(df.sparkSession), table_format(path)
    folder = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        out = df.coalesce(1).write.option("header", True).option("escape", '"').option("quote", '"')
        out.format(kind).save(folder)
        part = next(n for n in storage.names(folder) if n.startswith("part-"))
        storage.move(f"{folder}/{part}", path)
    finally:
        storage.delete(folder)


def file_rows(path: str) -> Iterator[dict]:
    """Rows of a CSV file on this machine."""
    with open(path, newline="", encoding="utf-8") as f:
        yield from csv.DictReader(f)
