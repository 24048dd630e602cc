"""URL filters by hashed host-suffix and path-prefix expressions.

A URL is made canonical and expanded into expressions: its host and the suffixes of it, each with its path with and without the query,
and the folders of the path. A rule is such an expression and an action. Of suffixes and folders, at any depth, only those are made
that have as many labels or folders as some rule has; no other could match. URLs and rules meet in an equi-join on the first bytes of
their expressions' SHA-256 digests; whole digests then confirm a match. Of several matching rules the one with the longest host wins,
then the one with the longest path, then, as for one expression in several rules, the larger priority, then "allow" over "block".
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modalith.llm.common import checkpointed, col, fresh, sized

#: Domains that the registered query blocks, whether or not a table has pages of them.
BAD_DOMAINS = [
    f"{a}-{b}.example.{top}"
    for a in "spam cheap casino free ads adult poker loan crypto warez".split()
    for b in "farm pills win bets track x mirror club deals shop".split()
    for top in ("com", "net", "org")
]
#: Rules of the registered query: (expression, action, priority).
DEFAULT_RULES = [
    *((f"{d}/", "block", 0) for d in BAD_DOMAINS),
    *((f"www.{d}/fr/", "allow", 0) for d in BAD_DOMAINS),
    *((f"m.{d}/en/archive/2019/12/31/", "allow", 0) for d in BAD_DOMAINS[::3]),
    *((f"example.{top}/en/{n}{end}", "block", 0) for top in ("com", "net", "org") for end in ("", ".html", "/") for n in range(0, 10_000, 97)),
    *((f"example.{top}/en/{n}", "allow", 1) for top in ("com", "net", "org") for n in range(0, 10_000, 485)),
    ("example.net/es/", "block", 0),
    ("blog.ththan.example.net/es/874", "allow", 0),
    ("example.com/en/853/", "block", 0),
    ("example.com/en/853/", "allow", -1),
]


@dataclass(frozen=True)
class UrlParams:
    """prefix_bytes: of the digests that the join is on. Safe against misses at any value; more means fewer candidates."""

    prefix_bytes: int = 4


_SCHEME = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://")
_ODD = set(b"#%") | set(range(33)) | set(range(127, 256))


def _unescaped(s: str) -> bytes:
    b = s.encode("utf-8", "surrogatepass")
    while True:  # every round shortens it
        new = unquote_to_bytes(b)
        if new == b:
            return b
        b = new


def _escaped(b: bytes) -> str:
    return "".join(f"%{c:02X}" if c in _ODD else chr(c) for c in b)


def _address(host: str) -> str | None:
    """Dotted quad of an IPv4 address in any base or number of parts."""
    parts = host.split(".")
    if not 1 <= len(parts) <= 4:
        return None
    try:
        ns = [int(x, 16 if x[:2] == "0x" else 8 if len(x) > 1 and x[0] == "0" else 10) for x in parts if x.isascii() and x.isalnum()]
    except ValueError:
        return None
    if len(ns) != len(parts) or any(n > 255 for n in ns[:-1]) or ns[-1] >= 256 ** (5 - len(ns)):
        return None
    total = ns[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(ns[:-1]))
    return ".".join(str(total >> s & 255) for s in (24, 16, 8, 0))


def canonical(url: str | None) -> tuple[str, str, str | None] | None:
    """(host, path, query) or None if there is no host. Lower-case host without port, user or stray dots; no fragment; escapes undone
    as often as they were made; "." and ".." gone from the path and slashes single."""
    if url is None:
        return None
    url = re.sub(r"[\t\r\n]", "", url.strip()).split("#", 1)[0]
    rest = _SCHEME.sub("", url, count=1) if _SCHEME.match(url) else url.removeprefix("//")
    cut = re.search(r"[/?]", rest)
    authority, tail = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    path, mark, query = tail.partition("?")
    host = _unescaped(authority.rpartition("@")[2]).decode("utf-8", "replace").lower()
    host = re.sub(r":\d*$", "", host)
    host = re.sub(r"\.{2,}", ".", host.strip("."))
    if not host:
        return None
    host = _address(host) or _escaped(host.encode())
    raw = _unescaped(path or "/")
    parts: list[bytes] = []
    pieces = raw.split(b"/")
    for piece in pieces:
        if piece == b"..":
            parts[-1:] = []
        elif piece not in (b"", b"."):
            parts.append(piece)
    clean = b"/" + b"/".join(parts)
    if parts and pieces[-1] in (b"", b".", b".."):
        clean += b"/"
    return host, _escaped(clean), _escaped(_unescaped(query)) if mark else None


def canonical_parts(url: str) -> Column:
    """struct (host, path, query) of a column."""

    @F.pandas_udf("host string, path string, query string")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            yield pd.DataFrame([canonical(u) or (None, None, None) for u in urls], columns=["host", "path", "query"])

    return parts(F.col(url))


def expressions(c: Column, labels: list[int], folders: list[int]) -> Column:
    """array of (host, path), distinct, of a struct (host, path, query): suffixes of so many labels, paths of so many folders ("/" is
    one), and the whole path."""
    parts, steps = F.split(c["host"], r"\."), F.split(c["path"], "/")
    some = lambda ns, most: F.filter(F.array(*map(F.lit, ns)).cast("array<int>"), lambda k: k <= most)
    suffixes = F.transform(some(labels, F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    # an address has no suffixes
    hosts = F.when(c["host"].rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.array(c["host"])).otherwise(suffixes)
    prefixes = F.transform(some(folders, F.size(steps) - 1), lambda k: F.concat(F.array_join(F.slice(steps, 1, k), "/"), F.lit("/")))
    whole = F.filter(F.array(F.when(c["query"].isNotNull(), F.concat(c["path"], F.lit("?"), c["query"])), c["path"]), lambda x: x.isNotNull())
    paths = F.array_distinct(F.concat(whole, prefixes))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda q: F.struct(h.alias("host"), q.alias("path")))))


def compiled_rules(rules: DataFrame, p: UrlParams) -> DataFrame:
    """(prefix, digest, action, priority, rule, labels, folders) of the rules (expression, action, priority): one row for each
    expression. labels and folders: arrays of the number that its host and, if it ends in "/", its path has."""
    parts = canonical_parts("expression")
    r = rules.where("expression is not null and action in ('allow', 'block')").select("action", F.coalesce("priority", F.lit(0)).alias("priority"), parts.alias("c")).where("c.host is not null")
    path = F.concat("c.path", F.coalesce(F.concat(F.lit("?"), F.col("c.query")), F.lit("")))
    labels, folders = F.size(F.split("c.host", r"\.")), F.when(path.endswith("/"), F.size(F.split(path, "/")) - 1)
    each = r.select(F.concat("c.host", path).alias("rule"), "action", "priority", labels.alias("labels"), folders.alias("folders"))
    best = each.groupBy("rule").agg(F.max(F.struct("priority", (F.col("action") == "allow").alias("allow"))).alias("m"), *(F.collect_set(n).alias(n) for n in ("labels", "folders")))
    digest = F.unhex(F.sha2("rule", 256))
    return best.select(
        F.substring(digest, 1, p.prefix_bytes).alias("prefix"), digest.alias("digest"), "rule",
        F.when(F.col("m.allow"), "allow").otherwise("block").alias("action"), F.col("m.priority").alias("priority"), "labels", "folders",
    )


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, "expression string, action string, priority int")


def url_verdicts(urls: DataFrame, rules: DataFrame, key: str = "url", p: UrlParams = UrlParams()) -> DataFrame:
    """(url, action, rule) of every distinct URL that a rule matches: the winning rule.

    A null URL, or one without a host, matches nothing; so does a rule of null expression or unknown action. A rule's null priority is
    0. Repeated URLs and rules count once. Empty tables give no rows; other columns play no part.
    """
    # repeated URLs meet in the last aggregation: a shuffle before the expansion would leave that to few tasks
    parted = urls.select(col(key).alias("url")).where("url is not null").select("url", canonical_parts("url").alias("c")).where("c.host is not null")
    compiled = checkpointed(compiled_rules(rules, p))
    labels, folders = (sorted(r[0] for r in compiled.select(F.explode(n)).distinct().collect()) for n in ("labels", "folders"))
    e = parted.select("url", F.explode(expressions(F.col("c"), labels, folders)).alias("e"))
    digest = F.unhex(F.sha2(F.concat("e.host", "e.path"), 256))
    e = e.select("url", F.length("e.host").alias("host_length"), F.length("e.path").alias("path_length"), digest.alias("mine")).withColumn("prefix", F.substring("mine", 1, p.prefix_bytes))
    hits = e.join(sized(compiled.drop("labels", "folders")), "prefix").where("mine = digest")
    order = F.struct("host_length", "path_length", "priority", (F.col("action") == "allow").alias("allow"), "action", "rule")
    return hits.groupBy("url").agg(F.max(order).alias("m")).select("url", "m.action", "m.rule")


def apply_url_rules(pages: DataFrame, rules: DataFrame, key: str = "url", p: UrlParams = UrlParams()) -> DataFrame:
    """pages without the rows whose URL is blocked. Rows whose URL is null, matches no rule or is allowed stay."""
    (name,) = fresh(pages, "blocked")
    blocked = checkpointed(url_verdicts(pages, rules, key, p).where("action = 'block'").select(F.col("url").alias(name)))
    return pages.join(sized(blocked), col(key) == F.col(name), "left_anti")


def page_verdicts(pages: DataFrame, rules: DataFrame, key: str = "url", p: UrlParams = UrlParams()) -> DataFrame:
    """pages with action and rule of every row whose URL a rule matches; columns of these names in pages are replaced. Repeated rows
    give repeated rows."""
    pages = pages.drop("action", "rule")
    (name,) = fresh(pages, "matched")
    found = checkpointed(url_verdicts(pages, rules, key, p).withColumnRenamed("url", name))
    return pages.join(sized(found), col(key) == F.col(name)).select(*(col(c) for c in pages.columns), "action", "rule")
