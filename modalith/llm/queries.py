"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from modalith.llm.bpe import encode_documents
from modalith.llm.common import table
from modalith.llm.decontaminate import benchmark_leaks
from modalith.llm.exact_dedup import exact_copies
from modalith.llm.line_spread import drop_boilerplate
from modalith.llm.near_dedup import near_copies
from modalith.llm.quality import quality_scores
from modalith.llm.sharding import shuffled
from modalith.llm.surrogates import SurrogateParams, pseudonymised
from modalith.llm.url_filter import DEFAULT_RULES, default_rules, page_verdicts
from modalith.llm.warc import derivatives


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), default_rules(spark))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), text=False)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's; without one that of this query, which protects nothing."""
    key = spark.conf.get("modalith.surrogates.key", "a key for trying out").encode()
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), SurrogateParams(key))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_sharding, op3_near_dedup, op4_url_filter, op5_quality, op6_bpe, op7_pii, op8_warc, op9_exact_dedup,
        op10_decontaminate,
    )
}

_RULES = ", ".join(f"('{e.split('/', 1)[0]}', '/{e.split('/', 1)[1]}', '{a}', {p})" for e, a, p in DEFAULT_RULES)

ORACLES: dict[str, str] = {
    "op1_line_dedup": r"""
        WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
        l AS (SELECT DISTINCT source, trim(unnest(lines), E' \t\r') AS line FROM d WHERE source IS NOT NULL),
        bad AS (SELECT line AS bad_line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
        u AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d)
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad_line IS NULL), '') AS text,
               any_value(source) AS source, CAST(count(bad_line) AS INTEGER) AS lines_removed
        FROM (SELECT u.*, trim(line, E' \t\r') AS t, source FROM u JOIN documents USING (doc_id)) LEFT JOIN bad ON t = bad_line
        GROUP BY doc_id
    """,
    "op4_url_filter": f"""
        WITH rules(host, path, action, priority) AS (VALUES {_RULES}),
        p AS (
            SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS h,
                   regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS q, regexp_extract(url, '^[^#]*?[?]([^#]*)', 1) AS args
            FROM pages
        ),
        m AS (
            SELECT page_id, url, action, host || path AS rule,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(host) DESC, length(path) DESC, priority DESC, action) AS n
            FROM p JOIN rules ON (h = host OR ends_with(h, '.' || host))
             AND (q = path OR q || '?' || args = path OR (ends_with(path, '/') AND starts_with(q, path)))
        )
        SELECT page_id, url, action, rule FROM m WHERE n = 1
    """,
    "op9_exact_dedup": """
        SELECT doc_id, kept_id
        FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id FROM documents WHERE text IS NOT NULL)
        WHERE doc_id <> kept_id
    """,
}
