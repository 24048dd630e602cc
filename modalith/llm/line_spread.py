"""Line dedup by spread over sites.

A line that many sites carry is boilerplate. For each line's hash a HyperLogLog sketch of the sites that carry it is built per
partition and merged by aggregation. An estimate well above the threshold settles a line, and so does one well below; the lines
between, within `band` of it, get exact distinct counts. Then every document loses its boilerplate lines.

Lines are compared without spaces, tabs and carriage returns at either end, and known by a 64-bit hash: two lines whose hashes agree
count as one. Blank lines are never boilerplate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalith.llm.common import checkpointed, col, fresh, sized


#: Boilerplate lines that may be sent along with the plan, as a set of hashes; beyond, texts meet theirs in a shuffle.
LITERAL_LINES = 20_000


@dataclass(frozen=True)
class SpreadParams:
    """A line on min_sites sites or more is boilerplate. log_k: the sketch has 2^log_k registers, its standard error is
    1.04 / sqrt(2^log_k), or 1.6 %; band is six times that."""

    min_sites: int = 10
    log_k: int = 12
    band: float = 0.1


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def _hashes(text: Column) -> Column:
    """The hashes of a text's lines but the blank ones, each once."""
    kept = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")) != "")
    return F.array_distinct(F.transform(kept, _key))


def _sites(docs: DataFrame, site: str) -> DataFrame:
    known = docs.where(col("text").isNotNull() & col(site).isNotNull())
    return known.select(col(site).cast("string").alias("site"), F.explode(_hashes(col("text"))).alias("h"))


def boilerplate(docs: DataFrame, site: str = "source", p: SpreadParams = SpreadParams()) -> DataFrame:
    """(h) of the boilerplate lines; checkpointed."""
    lines = _sites(docs, site)
    low, high = p.min_sites * (1 - p.band), p.min_sites * (1 + p.band)
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", p.log_k)).alias("sites"))
    wide = checkpointed(spread.where(F.col("sites") >= low))
    near = checkpointed(wide.where(F.col("sites") <= high).select("h"))
    exact = lines.join(sized(near), "h").groupBy("h").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= p.min_sites)
    return checkpointed(wide.where(F.col("sites") > high).select("h").unionByName(exact.select("h")))


def drop_boilerplate(docs: DataFrame, site: str = "source", p: SpreadParams = SpreadParams()) -> DataFrame:
    """docs, text without its boilerplate lines, and lines_removed (int). A column of that name in docs is replaced.

    A null text stays null, with no lines removed, and an empty one empty; a text of nothing but boilerplate becomes empty. A row of
    a null site adds nothing to any line's spread but loses its boilerplate lines like the others. Repeated rows are cleaned alike;
    how often a site carries a line plays no part. An empty table gives an empty table.
    """
    docs = docs.drop("lines_removed")
    bad = boilerplate(docs, site, p)
    few = [r["h"] for r in bad.limit(LITERAL_LINES + 1).collect()]
    lines = F.split(col("text"), "\n")
    th, marks, kept = fresh(docs, "th", "marks", "kept")
    if len(few) <= LITERAL_LINES:
        out = docs.withColumn(kept, F.filter(lines, lambda x: ~_key(x).isin(few)) if few else lines)
    else:
        texts = docs.where(col("text").isNotNull()).select(F.xxhash64(col("text")).alias(th), F.explode(_hashes(col("text"))).alias("h"))
        # texts whose hashes agree share the union of their boilerplate: as each line is looked up by its own hash, that harms neither
        marked = texts.join(sized(bad), "h").groupBy(th).agg(F.collect_set("h").alias(marks))
        found = docs.withColumn(th, F.xxhash64(col("text"))).join(marked, th, "left")
        out = found.withColumn(kept, F.when(F.col(marks).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(marks), _key(x)))))
    text = F.array_join(F.col(kept), "\n").alias("text")
    # the size of a null depends on the session, so it isn't asked for
    removed = F.when(col("text").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(F.col(kept))).alias("lines_removed")
    return out.select(*(text if c == "text" else col(c) for c in docs.columns), removed)
