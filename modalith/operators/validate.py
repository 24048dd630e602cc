"""Validation: does a dataset hold what its tables say?

Problems are rows (kind, path, column, value). Kinds of the tables: missed_columns, duplicated_values, missing_value; of the file
structure: no_such_file, is_not_key, and, only if asked for, file_not_in_data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modalith.functions.columns import base_name
from modalith.operators.tables import has_repeats
from modalith.sources.media import archive_members
from modalith.sources.readers import header, headers, read_table
from modalith.sources.spec import COLUMN, FILES, SHARDED, SHARDS, DatasetSpec
from modalith.sources.storage import Storage, join, stem


@dataclass(frozen=True)
class Problem:
    kind: str
    path: str | None = None
    column: str | None = None
    value: str | None = None


@dataclass(frozen=True)
class Report:
    structure: list[Problem]
    tables: dict[str, list[Problem]]

    @property
    def total(self) -> int:
        return len(self.structure) + sum(map(len, self.tables.values()))


def _keys(df: DataFrame, spec: DatasetSpec) -> list[Problem]:
    """File columns whose base names repeat over the whole dataset."""
    out = []
    for s in spec.stored:
        if s.how != COLUMN and has_repeats(df.select(base_name(F.col(s.final)).alias("n")), "n"):
            out.append(Problem("is_not_key", column=s.user_column))
    return out


def _pairs(names: list[str], spec: DatasetSpec) -> list[Problem]:
    have, table = set(names), f".{spec.table_ext}"
    suffix = f".{spec.archive_ext}" if spec.layout == SHARDS else ""
    want = [n[: -len(table)] + suffix for n in names if n.endswith(table)]
    if spec.layout == SHARDS:
        want += [n[: -len(suffix)] + table for n in names if n.endswith(suffix)]
    return [Problem("no_such_file", join(spec.path, n)) for n in want if n not in have]


def _members(spark: SparkSession, spec: DatasetSpec, splits: list[str]) -> DataFrame:
    """(split, member) of all files in archives or folders."""
    if spec.layout == SHARDS:
        paths = spark.createDataFrame([(join(spec.path, f"{s}.{spec.archive_ext}"),) for s in splits], "path string").repartition(max(1, len(splits)))
        m = archive_members(paths)
        return m.select(F.regexp_extract("archive", r"([^/]*)\.[^./]*$", 1).alias("split"), "member")
    found = spark.read.format("binaryFile").load([join(spec.path, s) for s in splits]).select("path")
    parts = F.split("path", "/")
    return found.select(F.element_at(parts, -2).alias("split"), F.element_at(parts, -1).alias("member"))


def validate(spark: SparkSession, df: DataFrame, spec: DatasetSpec, check: list[str] | None = None, structure: bool = True, metadata: bool = True, extras: bool = False) -> Report:
    """df: the dataset as it was read. check: columns that every table must have, by default the spec's. extras: also tell of files
    that no table names.

    Files that a table names and its archive lacks are missing_value; they are no_such_file too if the archive has files that the
    table doesn't name, but those alone are no problem.
    """
    check = spec.required if check is None else check
    if spec.layout == FILES:
        tables: list[Problem] = []
        lacking = sorted(set(check) - set(header(spark, spec.path)))
        if lacking:
            tables.append(Problem("missed_columns", spec.path, value=",".join(lacking)))
        tables += [Problem("duplicated_values", spec.path, s.user_column) for s in spec.stored if s.how != COLUMN and has_repeats(df, s.final)]
        return Report(_keys(df, spec) if structure else [], {spec.path: tables} if metadata and tables else {})
    found: list[Problem] = []
    by_table: dict[str, list[Problem]] = {}
    names = Storage(spark).names(spec.path)
    if structure:
        found += _keys(df, spec) + _pairs(names, spec)
    have, suffix = set(names), f".{spec.archive_ext}" if spec.layout == SHARDS else ""
    paired = [n for n in names if n.endswith(f".{spec.table_ext}") and n[: -len(spec.table_ext) - 1] + suffix in have]
    path_of = {stem(n): join(spec.path, n) for n in paired}
    heads: dict[tuple[str, ...], list[str]] = {}
    by_path = headers(spark, list(path_of.values()))
    for path in path_of.values():
        h = by_path[path]
        heads.setdefault(tuple(h), []).append(path)
        lacking = sorted(set(check) - set(h))
        if lacking:
            by_table.setdefault(path, []).append(Problem("missed_columns", path, value=",".join(lacking)))
    members = _members(spark, spec, list(path_of)) if path_of else None
    for s in spec.stored:
        if s.how != SHARDED or members is None:
            continue
        rows = None
        for h, paths in heads.items():
            if s.user_column in h:
                part = read_table(spark, paths).select(F.regexp_extract("_metadata.file_name", r"^([^.]*)", 1).alias("split"), F.col(s.user_column).alias("member"))
                rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            continue
        # both comparisons in one shuffle: how often each name is in the table and whether its archive has it
        both = rows.select("split", "member", F.lit(1).alias("t"), F.lit(0).alias("a")).unionByName(members.select("split", "member", F.lit(0).alias("t"), F.lit(1).alias("a")))
        each = both.groupBy("split", "member").agg(F.sum("t").alias("t"), F.max("a").alias("a"))
        odd = each.where("t > 1 or (t > 0 and a = 0) or (t = 0 and a = 1)").collect()  # problems alone come to the driver
        repeated = sorted({r["split"] for r in odd if r["t"] > 1})
        extra = {r["split"] for r in odd if r["t"] == 0}
        for split in repeated:
            by_table.setdefault(path_of[split], []).append(Problem("duplicated_values", path_of[split], s.user_column))
        for r in sorted(odd, key=lambda r: (r["split"], str(r["member"]))):
            path = path_of[r["split"]]
            inside = join(spec.path, r["split"] + suffix, str(r["member"]))
            if r["t"] and not r["a"]:
                by_table.setdefault(path, []).append(Problem("missing_value", path, s.user_column, r["member"]))
                if structure and r["split"] in extra:
                    found.append(Problem("no_such_file", inside))
            elif extras and structure and not r["t"]:
                found.append(Problem("file_not_in_data", inside))
    return Report(found, by_table if metadata else {})
