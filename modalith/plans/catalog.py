"""Queries over the driver's tables, one for each operator that these can try, and the SQL that gives the same rows.

Queries of media files make their files first, from rows of `nation`, so that SQL knows what must come out.
"""

from __future__ import annotations

import io
import os
import tarfile
import uuid
import wave
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modalith.functions import captions, language
from modalith.functions import columns as X
from modalith.functions.images import encode_png
from modalith.operators import extractors, tables, transforms
from modalith.plans.dataset import Dataset
from modalith.plans.pipeline import Pipeline
from modalith.sources import readers
from modalith.sources.datasource import TarShards
from modalith.sources.spec import COLUMN, FILES, DatasetSpec, Stored, files_spec, shards_spec
from modalith.sources.storage import local, work_folder
from modalith.streaming import shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules that mean the same in the JVM and in RE2: ASCII, no look-ahead.
PLAIN_RULES = [(r"https?://[^ ]+", ""), (r"[a-z0-9._-]+@[a-z0-9.-]+", ""), (r"\.\.+", " "), (r"\([ ]?#?[ ]?[0-9]+[ ]?\)", " "), (r"[0-9]{5,}", ""), (r"[()]", ""), (r"[ \n]+", " ")]


def _plain(column: str) -> Column:
    c = F.lower(column)
    for p, r in PLAIN_RULES:
        c = F.regexp_replace(c, p, r)
    return c


def _plain_sql(column: str) -> str:
    sql = f"lower({column})"
    for p, r in PLAIN_RULES:
        sql = f"regexp_replace({sql}, E'{p.replace(chr(92), chr(92) * 2).replace(chr(92) * 2 + 'n', chr(92) + 'n')}', '{r}', 'g')"
    return sql


# sources and schema


@query("SELECT lang AS text_lang, text, doc_id, source, n_chars FROM documents")
def read_rename_rearrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = DatasetSpec(FILES, f"{sf_dir}/documents.parquet", (Stored("text", COLUMN, "text"),), "parquet")
    df = readers.read_files(spark, spec).withColumnsRenamed({"lang": "text_lang"})
    return df.select("text_lang", *(c for c in df.columns if c != "text_lang"))


@query("""
    SELECT split_name, doc_id, lang, n_chars FROM (
        SELECT source AS split_name, doc_id, lang, NULL::BIGINT AS n_chars FROM documents WHERE n_chars % 2 = 0
        UNION ALL BY NAME SELECT source AS split_name, doc_id, n_chars FROM documents WHERE n_chars % 2 = 1)
""")
def shard_union_schema_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").withColumnRenamed("source", "split_name")
    a, b = d.where("n_chars % 2 = 0").select("split_name", "doc_id", "lang"), d.where("n_chars % 2 = 1").select("split_name", "doc_id", "n_chars")
    return a.unionByName(b, allowMissingColumns=True)


@query("""
    SELECT doc_id, 's3://bucket/set/' || source || '.tar/' || doc_id || '.a.txt' AS text_path, doc_id || '.a.txt' AS base,
           doc_id::VARCHAR AS stem, '.txt' AS ext, source || '.tar' AS archive
    FROM documents
""")
def path_columns_from_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".a.txt"))
    d = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("s3://bucket/set/"), "source", F.lit(".tar/"), name).alias("text_path"), "source")
    p = F.col("text_path")
    return d.select("doc_id", "text_path", X.base_name(p).alias("base"), X.path_stem(p).alias("stem"), X.extension(p).alias("ext"), X.with_extension(F.concat("source", F.lit(".csv")), "csv", "tar").alias("archive"))


# text


@query(f"SELECT doc_id, {_plain_sql('text')} AS clean_caption FROM documents")
def regex_clean_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", captions.clean_native(F.lower("text"), PLAIN_RULES).alias("clean_caption"))


@query()
def regex_clean_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*captions.RULES["emoji"], *captions.RULES["special"]]
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", captions.clean(F.col("text"), rules).alias("clean_caption"))


@query()
def regex_clean_exact_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "conversations").select("conv_id", "turn", captions.cleaned(F.col("text"), {k: captions.RULES[k] for k in ("en", "ru")}).alias("c"))
    return d.select("conv_id", "turn", *(F.col(f"c.{k}").alias(f"clean_caption_{k}") for k in ("en", "ru")))


@query()
def lang_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("known"), language.language(F.col("text")).alias("l"))
    return d.select("doc_id", "known", "l.lang", "l.lang_score")


@query("""
    SELECT conv_id, turn, CASE WHEN len(list_distinct(string_split(text, '.'))) = len(string_split(text, '.')) THEN text ELSE '' END AS caption
    FROM conversations
""")
def caption_repeat_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", X.caption_without_repeats(F.col("text")).alias("caption"))


@query("SELECT conv_id, turn, role, CASE WHEN role IS NULL THEN NULL ELSE upper(role) || '!' END AS role_translated FROM conversations")
def translate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return language.translated(d, "role", lambda texts: [t.upper() + "!" for t in texts], budget=20)


@query("SELECT conv_id, turn, text, length(text) || ':' || text || '!' AS text_translated FROM conversations")
def translate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return language.translated(d, "text", lambda texts: [f"{len(t)}:{t}!" for t in texts])


@query("SELECT p_partkey, 'size ' || p_size AS word, CAST(p_partkey % 50 AS INTEGER) AS x0, CAST(p_size AS INTEGER) AS y1, round(abs((CAST(p_partkey % 50 AS DOUBLE) - 7) * (3 - p_size)) / 5000, 6) AS area FROM part")
def json_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('[[[[%d, 3], [7, %d]], "size %d"]]', F.col("p_partkey") % 50, F.col("p_size"), F.col("p_size"))
    text = F.regexp_replace(text, r"^\[\[(\[\[.*\]\]), ", '[["$1", ')  # the box of a pair is JSON of its own
    d = _table(spark, sf_dir, "part").select("p_partkey", X.boxes_from_json(text)[0].alias("b"))
    box = F.col("b.box")
    return d.select("p_partkey", F.col("b.text").alias("word"), box[0][0].alias("x0"), box[1][1].alias("y1"), F.round(X.text_area(F.array(box), F.lit(100), F.lit(50)), 6).alias("area"))


# rows


@query("SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.keep_first(_table(spark, sf_dir, "documents"), ["text"], [F.col("doc_id")])


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang, n_chars ORDER BY doc_id) > 1 AS is_repeat FROM documents")
def flag_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return tables.is_repeat(d, ["lang", "n_chars"], [F.col("doc_id")]).select("doc_id", "is_repeat")


@query("SELECT text AS value, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.repeated_values(_table(spark, sf_dir, "documents"), "text")


@query("SELECT count(*) > count(DISTINCT text) AS has_duplicates FROM documents")
def has_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(tables.has_repeats(_table(spark, sf_dir, "documents"), "text"),)], "has_duplicates boolean")


@query("SELECT doc_id, n_chars FROM documents JOIN labels USING (doc_id) WHERE quality > 0 AND NOT toxic > 0 AND n_chars > 200")
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where("quality > 0 and not toxic > 0").select("doc_id")
    return _table(spark, sf_dir, "documents").where("n_chars > 200").select("doc_id", "n_chars").join(labels, "doc_id")


@query("SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def merge_back_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.merge_back(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id, text, lang, source, quality * 10 AS n_chars, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def update_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 10).alias("n_chars"), "toxic")
    return tables.update_by_key(_table(spark, sf_dir, "documents"), new, "doc_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_missing_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.missing_from(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels"), "doc_id")


@query("""
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'left' ELSE 'right' END AS side
    FROM (SELECT DISTINCT n_chars AS id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id AS id FROM labels) b ON a.id = b.id
    WHERE a.id IS NULL OR b.id IS NULL
""")
def pairing_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pairing(_table(spark, sf_dir, "documents").select(F.col("n_chars").alias("id")), _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id")


def _describe_sql(table: str, columns: list[str]) -> str:
    part = "SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, round(min({c})::DOUBLE, 2) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 2) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 2) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 2) AS p75, round(max({c})::DOUBLE, 2) AS max FROM " + table
    return " UNION ALL ".join(part.format(c=c) for c in columns)


@query(_describe_sql("documents", ["n_chars", "doc_id"]))
def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.describe(_table(spark, sf_dir, "documents"), ["n_chars", "doc_id"])


@query(_describe_sql("part", ["p_size", "p_retailprice"]))
def describe_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.describe(_table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])


@query("SELECT DISTINCT source AS split_name FROM documents")
def distinct_split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("source").alias("split_name")).distinct()


@query("SELECT source, count(*) AS n, min(doc_id) AS least, max(doc_id) AS most, sum(n_chars) AS chars FROM documents GROUP BY source")
def collect_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.collect_by(_table(spark, sf_dir, "documents"), "source", ["doc_id", "n_chars"])
    ids = F.transform("rows", lambda r: r["doc_id"])
    return rows.select("source", F.size("rows").cast("long").alias("n"), F.array_min(ids).alias("least"), F.array_max(ids).alias("most"), F.aggregate("rows", F.lit(0).cast("long"), lambda s, r: s + r["n_chars"]).alias("chars"))


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 100) AS BIGINT) AS shard FROM documents")
def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.dense_index(_table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], "i")
    return d.select("doc_id", F.floor(F.col("i") / 100).alias("shard"))


@query("SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS part FROM documents")
def device_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.even_split(_table(spark, sf_dir, "documents").select("doc_id"), 7, [F.col("doc_id")])


@query("""
    SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
    WHERE i BETWEEN 2 * (n // 4 + 1) AND 3 * (n // 4 + 1) - 1
""")
def rank_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.rank_slice(_table(spark, sf_dir, "documents").select("doc_id"), 2, 4, [F.col("doc_id")])


@query("""
    SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('3' || chr(31) || '{"v":' || doc_id || '}')) - 1 AS place FROM documents
""")
def shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.shuffled(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), seed=3, key=["doc_id"])
    return tables.dense_index(d, [F.col("_row_id")], "place").select("doc_id", "n_chars", "place")


@query("SELECT CAST(1 AS BIGINT) AS drawn, true AS matches")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = DatasetSpec(FILES, f"{sf_dir}/documents.parquet", (Stored("text", COLUMN, "text"),), "parquet")
    data, row = Dataset.read(spark, spec).sample("lang = 'en'", seed=5)
    return spark.createDataFrame([(len([row]), row["lang"] == "en" and data["text"] == row["text"])], "drawn long, matches boolean")


# sizes


def _resized(mode: X.SizeMode, downscale_only: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37 + 1).cast("int").alias("w"), (F.col("p_partkey") % 1900 + 1).cast("int").alias("h"))
        s = X.new_size(F.col("w"), F.col("h"), mode, 512, (768, 640), downscale_only)
        return p.select("p_partkey", s["width"].alias("width"), s["height"].alias("height"), X.even(s["width"]).alias("even_width"))

    return f


def _resized_sql(side: str, to_width: str, downscale: bool) -> str:
    keep = f"{side}(w, h) < 512" if downscale else "false"
    size = f"""
        SELECT p_partkey, CASE WHEN {keep} THEN w WHEN {to_width} THEN 512 ELSE CAST(trunc(512::DOUBLE * w / h) AS INTEGER) END AS width,
               CASE WHEN {keep} THEN h WHEN {to_width} THEN CAST(trunc(512::DOUBLE * h / w) AS INTEGER) ELSE 512 END AS height
        FROM (SELECT p_partkey, CAST(p_size * 37 + 1 AS INTEGER) AS w, CAST(p_partkey % 1900 + 1 AS INTEGER) AS h FROM part)
    """
    return f"SELECT *, width + width % 2 AS even_width FROM ({size})"


for _name, _mode, _side, _to, _down in (("min", X.SizeMode.MIN_SIZE, "least", "h >= w", True), ("max", X.SizeMode.MAX_SIZE, "greatest", "w >= h", True), ("max_up", X.SizeMode.MAX_SIZE, "greatest", "w >= h", False)):
    QUERIES[f"resize_dims_{_name}"] = _resized(_mode, _down)
    ORACLES[f"resize_dims_{_name}"] = _resized_sql(_side, _to, _down)
QUERIES["resize_dims_fixed"] = _resized(X.SizeMode.FIXED)
ORACLES["resize_dims_fixed"] = "SELECT p_partkey, 768 AS width, 640 AS height, 768 AS even_width FROM part"


@query("SELECT event_id, CAST(least(floor(floor(25.0 * (event_id % 100) / 7.0) * 0.5), 200) AS INTEGER) AS frame FROM events")
def frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "events")
    return d.select("event_id", X.frame_index(F.lit(25.0), F.col("event_id") % 100 / 7.0, 0.5, F.lit(201)).alias("frame"))


@query("SELECT p_partkey, len(range(12, least(121, p_size * 5), 12)) AS n, coalesce(list_sum(range(12, least(121, p_size * 5), 12)), 0) AS total FROM part")
def frame_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.sampled_frames(12, 10, F.col("p_size") * 5)
    d = _table(spark, sf_dir, "part").select("p_partkey", s.alias("s"))
    return d.select("p_partkey", F.size("s").alias("n"), F.aggregate("s", F.lit(0), lambda a, x: a + x).alias("total"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 24.9 OR l_quantity > 25.1 THEN 25.0 ELSE l_quantity END AS fps, round(l_extendedprice / l_quantity, 6) AS ratio FROM lineitem")
def fps_and_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "lineitem")
    return d.select("l_orderkey", "l_linenumber", X.adjusted_fps(F.col("l_quantity"), 25).alias("fps"), F.round(X.aspect_ratio(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("ratio"))


# vectors

_PROTOTYPES = {k: [((i * 7 + k * 13) % 11 - 5) / 5 for i in range(64)] for k in range(3)}
_SCALED = "list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 5))"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = 1 + F.col("vec_id") % 5
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * scale).alias("v"))


def _literal(k: int) -> Column:
    return F.array(*(F.lit(x) for x in _PROTOTYPES[k]))


def _cosine_sql(k: int) -> str:
    return f"list_cosine_similarity(v, {_PROTOTYPES[k]}::DOUBLE[])"


@query(f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 5) AS total, round(v[1] / sqrt(list_dot_product(v, v)), 5) AS first FROM (SELECT vec_id, {_SCALED} AS v FROM embeddings)")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _vectors(spark, sf_dir).select("vec_id", X.l2_normalised(F.col("v")).alias("u"))
    return d.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.col("u")[0], 5).alias("first"))


@query(f"SELECT vec_id, round({_cosine_sql(0)}, 5) AS similarity FROM (SELECT vec_id, {_SCALED} AS v FROM embeddings)")
def cosine_to_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.round(X.cosine(F.col("v"), _literal(0)), 5).alias("similarity"))


@query(f"SELECT vec_id, {', '.join(f'round({_cosine_sql(k)}, 5) AS label_{k}' for k in range(3))} FROM (SELECT vec_id, {_SCALED} AS v FROM embeddings)")
def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", *(F.round(X.cosine(F.col("v"), _literal(k)), 5).alias(f"label_{k}") for k in range(3)))


@query(f"SELECT vec_id, round(list_dot_product(v, {_PROTOTYPES[1]}::DOUBLE[]) + 0.25, 4) AS score FROM (SELECT vec_id, {_SCALED} AS v FROM embeddings)")
def linear_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.round(X.linear_head(F.col("v"), _PROTOTYPES[1], 0.25), 4).alias("score"))


@query(f"SELECT vec_id, round(exp(2.5) * {_cosine_sql(2)}, 4) AS similarity FROM (SELECT vec_id, {_SCALED} AS v FROM embeddings)")
def scaled_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.round(X.scaled_similarity(F.col("v"), _literal(2), 2.5), 4).alias("similarity"))


# pipelines

_PIPELINE_SQL = f"""
    WITH c AS (SELECT doc_id, lang, n_chars, {_plain_sql('text')} AS clean FROM documents),
    d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY doc_id) AS n FROM c) WHERE n = 1)
    SELECT lang, count(*) AS n_docs, count(quality) AS n_labelled, round(avg(length(clean)), 4) AS mean_length
    FROM d LEFT JOIN labels USING (doc_id) GROUP BY lang
"""


@query(_PIPELINE_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean captions, keep the first of each, attach labels, sum up by language."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", _plain("text").alias("clean"))
    first = tables.keep_first(docs, ["clean"], [F.col("doc_id")])
    labelled = first.join(tables.small(_table(spark, sf_dir, "labels").select("doc_id", "quality")), "doc_id", "left")
    return labelled.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count("quality").alias("n_labelled"), F.round(F.avg(F.length("clean")), 4).alias("mean_length"))


@query(f"""
    SELECT * EXCLUDE (n) FROM (
        SELECT doc_id, lang, {_plain_sql('text')} AS clean, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE n_chars > 100
    ) WHERE n = 1
""")
def pipeline_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = DatasetSpec(FILES, f"{sf_dir}/documents.parquet", (Stored("text", COLUMN, "text"),), "parquet")
    p = Pipeline("end_to_end").dataframe(lambda df: df.where("n_chars > 100")).dataframe(lambda df: tables.keep_first(df, ["text"], [F.col("doc_id")]))
    p.dataframe(lambda df: df.select("doc_id", "lang", _plain("text").alias("clean")))
    return p.run(Dataset.read(spark, spec)).df


# streams


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS rows FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream, counted by hour and type."""
    rows = spark.readStream.schema("event_id long, ts timestamp, event_type string").parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as a stream takes no single file
    counts = shards.counts_per_window(rows, "ts", "event_type", "1 hour", "1 day")
    name = f"counts_{uuid.uuid4().hex}"
    q = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", work_folder(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).withColumn("start", F.col("start").cast("timestamp_ntz"))


# media


def _pictures(spark: SparkSession, sf_dir: str, archives: bool, faults: bool = False, alike: bool = False) -> DatasetSpec:
    """A picture for every nation, 8 + key wide and 5 + region high, a damaged one for every seventh; as files or in five archives.

    faults: every sixth picture is missing, every tenth is in its table twice, every eighth has an unnamed one beside it, and all tables
    but that of region 4 have a column more. alike: all pictures are of one size, and those of keys that agree modulo 5 are the same.
    """
    folder = work_folder(spark, "media")
    at = local(folder).removeprefix("file:")
    os.makedirs(at, exist_ok=True)
    rows = sorted((r["n_nationkey"], r["n_regionkey"], r["n_name"]) for r in _table(spark, sf_dir, "nation").collect())  # 25 rows
    lines: dict[int, list[str]] = {}
    tars: dict[int, tarfile.TarFile] = {}
    for key, region, name in rows:
        px = np.random.default_rng(key % 5).integers(0, 255, (40, 40, 3) if alike else (5 + region, 8 + key, 3)).astype(np.uint8)
        blob = b"no picture" if key % 7 == 6 else encode_png(px)
        shard = region if archives else 0
        more = faults and shard != 4
        lines.setdefault(shard, ["file,title,more" if more else "file,title"]).extend([f"{key}.png,{name}" + ",x" * more] * (2 if faults and key % 10 == 9 else 1))
        if archives:
            if faults and key % 6 == 5:
                continue
            if faults and key % 8 == 7:
                lines[shard].pop()
            tar = tars.setdefault(shard, None) or tarfile.open(f"{at}/{shard}.tar", "w")
            tars[shard] = tar
            info = tarfile.TarInfo(f"{key}.png")
            info.size = len(blob)
            tar.addfile(info, io.BytesIO(blob))
        else:
            with open(f"{at}/{key}.png", "wb") as f:
                f.write(blob)
    for tar in tars.values():
        tar.close()
    for shard, text in lines.items():
        with open(f"{at}/{shard if archives else 'data'}.csv", "w") as f:
            f.write("\n".join(text) + "\n")
    return shards_spec(at, image="file", text="title") if archives else files_spec(f"{at}/data.csv", image="file", text="title")


_INFO_SQL = "SELECT CAST(n_nationkey AS INTEGER) AS n, n_name AS title, n_nationkey % 7 <> 6 AS is_correct, CASE WHEN n_nationkey % 7 <> 6 THEN 8 + n_nationkey END AS width, CASE WHEN n_nationkey % 7 <> 6 THEN 5 + n_regionkey END AS height, CASE WHEN n_nationkey % 7 <> 6 THEN 3 END AS channels FROM nation"


def _facts(df: DataFrame) -> DataFrame:
    return df.select(X.path_stem(F.col("image_path")).cast("int").alias("n"), F.col("text").alias("title"), "is_correct", "width", "height", "channels")


@query(_INFO_SQL)
def image_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(Dataset.read(spark, _pictures(spark, sf_dir, True)).extract(extractors.ImageInfo()).df)


@query(_INFO_SQL)
def image_info_loose_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(extractors.image_info_native(Dataset.read(spark, _pictures(spark, sf_dir, False)).df))


@query("""
    SELECT CAST(n_nationkey AS INTEGER) AS n, CASE WHEN n_nationkey % 7 <> 6 THEN 48 END AS digits,
           CASE WHEN n_nationkey % 7 <> 6 THEN CAST(min(n_nationkey) OVER (PARTITION BY n_nationkey % 5, n_nationkey % 7 = 6) AS INTEGER) END AS least_alike
    FROM nation
""")
def phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pictures have the same hash: the least of them."""
    d = Dataset.read(spark, _pictures(spark, sf_dir, True, alike=True)).extract(extractors.PerceptualHash(), on_error="null", validate=False).df
    d = d.select(X.path_stem(F.col("image_path")).cast("int").alias("n"), F.col("image_phash_8").alias("h"))
    least = d.where("h is not null").groupBy("h").agg(F.min("n").alias("least_alike"))
    return d.join(least, "h", "left").select("n", F.length("h").alias("digits"), "least_alike")


@query("SELECT n_regionkey::VARCHAR AS split_name, n_nationkey::VARCHAR || '.png' AS member FROM nation")
def tar_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(TarShards)
    return spark.read.format("tarshards").option("path", _pictures(spark, sf_dir, True).path).load().select("split_name", "member")


@query("SELECT CAST(i AS INTEGER) AS n, i // 10 || '' AS split_name, n_name AS title FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)")
def tar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Dataset.read(spark, _pictures(spark, sf_dir, False))
    new = d.write_shards(work_folder(spark, "shards").removeprefix("file:"), max_files=10, order=[X.path_stem(F.col("image_path")).cast("int")])
    return new.df.select(X.path_stem(F.col("image_path")).cast("int").alias("n"), F.col("split_name").cast("string"), F.col("text").alias("title"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS n, true AS is_correct, (n_nationkey + 1) / 10.0 AS duration, 8000 AS sample_rate FROM nation")
def audio_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = work_folder(spark, "audio").removeprefix("file:")
    os.makedirs(at, exist_ok=True)
    keys = sorted(r[0] for r in _table(spark, sf_dir, "nation").select("n_nationkey").collect())  # 25 rows
    for k in keys:
        with wave.open(f"{at}/{k}.wav", "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(8000)
            w.writeframes(b"\0\0" * (800 * (k + 1)))
    with open(f"{at}/data.csv", "w") as f:
        f.write("\n".join(["file", *(f"{k}.wav" for k in keys)]) + "\n")
    d = Dataset.read(spark, files_spec(f"{at}/data.csv", audio="file")).extract(extractors.AudioInfo()).df
    return d.select(X.path_stem(F.col("audio_path")).cast("int").alias("n"), "is_correct", "duration", "sample_rate")


@query("SELECT CAST(n_nationkey AS INTEGER) AS n, 1 AS dummy_label FROM nation")
def dummy_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline("dummy").extract(extractors.Constant).extract(extractors.Constant)
    d = p.run(Dataset.read(spark, _pictures(spark, sf_dir, True)))
    return d.df.select(X.path_stem(F.col("image_path")).cast("int").alias("n"), "dummy_label")


@query("SELECT CAST(n_nationkey AS INTEGER) AS n, CASE WHEN 8 + n_nationkey >= 16 THEN 16 ELSE 8 + n_nationkey END AS width FROM nation WHERE n_nationkey % 7 <> 6")
def resize_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Dataset.read(spark, _pictures(spark, sf_dir, False)).extract(extractors.ImageInfo()).where("is_correct")
    names = d.with_column("n", X.path_stem(F.col("image_path")).cast("int"))
    new = names.resize_images(transforms.Resizer(X.SizeMode.MAX_SIZE, 16), work_folder(spark, "resized").removeprefix("file:"))
    return new.extract(extractors.ImageInfo()).df.select("n", "width")


@query("""
    WITH d AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation),
    t AS (SELECT * FROM d WHERE k % 8 <> 7 OR k % 6 = 5)
    SELECT 'missing_value' AS kind, r || '.csv' AS place, k || '.png' AS value FROM t WHERE k % 6 = 5
    UNION ALL SELECT DISTINCT 'duplicated_values', r || '.csv', NULL FROM t WHERE k % 10 = 9
    UNION ALL SELECT 'missed_columns', '4.csv', 'more'
    UNION ALL SELECT 'is_not_key', NULL, NULL
    UNION ALL SELECT 'file_not_in_data', k || '.png', NULL FROM d WHERE k % 8 = 7 AND k % 6 <> 5 AND k % 10 <> 9
    UNION ALL SELECT 'no_such_file', k || '.png', NULL FROM t JOIN (SELECT DISTINCT r FROM d WHERE k % 8 = 7 AND k % 6 <> 5 AND k % 10 <> 9) USING (r) WHERE k % 6 = 5
""")
def validate_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The problems of a set with planted ones."""
    spec = _pictures(spark, sf_dir, True, faults=True)
    report = Dataset.read(spark, spec, validate_columns=False).validate(["file", "title", "more"], extras=True)
    found = [*report.structure, *(p for ps in report.tables.values() for p in ps)]
    return spark.createDataFrame([(p.kind, p.path and p.path.rpartition("/")[2], p.value) for p in found], "kind string, place string, value string")


@query("SELECT CAST(n_nationkey AS INTEGER) AS n, n_name AS text, CAST(n_nationkey * 3 AS VARCHAR) AS points, CASE WHEN n_regionkey = 1 THEN 'one' END AS place FROM nation WHERE n_regionkey <> 9")
def metadata_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of tables on disk are updated, renamed and deleted."""
    spec = _pictures(spark, sf_dir, True)
    n = X.path_stem(F.col("image_path")).cast("int")
    d = Dataset.read(spark, spec).with_column("score", n * 3).with_column("gone", n).with_column("place", F.when(F.col("split_name") == "1", "one"))
    d.update_columns(["score", "gone", "place"])
    d.rename_columns({"score": "points"})
    d.delete_columns(["gone"])
    new = Dataset.read(spark, spec).df
    return new.select(X.path_stem(F.col("image_path")).cast("int").alias("n"), "text", F.col("points").cast("string").alias("points"), "place", *(c for c in new.columns if c in ("gone", "score")))
