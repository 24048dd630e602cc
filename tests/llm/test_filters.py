import itertools
import random

import pytest

from modalith.llm.decontaminate import LeakParams, Matcher, benchmark_leaks, drop_leaks, edits, normalised
from modalith.llm.url_filter import apply_url_rules, canonical, page_verdicts, url_verdicts
from tests.llm.odd import SCHEMA, no_documents, odd_documents

RULES = "expression string, action string, priority int"


def hosts_of(h):
    if h.replace(".", "").isdigit():
        return [h]
    parts = h.split(".")
    return list(dict.fromkeys([h, *(".".join(parts[-k:]) for k in range(min(5, len(parts) - 1), 1, -1))]))


def paths_of(p, q):
    steps = p.split("/")
    return {p, *([p + "?" + q] if q is not None else []), *("/".join(steps[:k]) + "/" for k in range(1, min(4, len(steps) - 1) + 1))}


def brute_verdict(url, rules):
    c = canonical(url)
    if not c:
        return None
    found = []
    for e, action, priority in rules:
        r = canonical(e) if e else None
        if r and action in ("allow", "block"):
            path = r[1] + ("" if r[2] is None else "?" + r[2])
            if r[0] in hosts_of(c[0]) and path in paths_of(c[1], c[2]):
                found.append((len(r[0]), len(path), priority or 0, action == "allow", action, r[0] + path))
    return max(found)[-2:] if found else None


@pytest.mark.parametrize(
    "url,want",
    [
        ("http://Host.Com/%25%32%35", ("host.com", "/%25", None)),
        ("http://a.com/b/../c/./d//e/#x", ("a.com", "/c/d/e/", None)),
        ("a.com", ("a.com", "/", None)),
        ("//a.com?q=/x?y", ("a.com", "/", "q=/x?y")),
        ("https://user:pw@a.com:8080/x", ("a.com", "/x", None)),
        ("http://3279880203/blah", ("195.127.0.11", "/blah", None)),
        ("http://0x7f.1/", ("127.0.0.1", "/", None)),
        ("http://..a...b.com../", ("a.b.com", "/", None)),
        ("ht\ttp://a.com/\r\n x", ("a.com", "/%20x", None)),
        ("http://a.com/%2E%2E/%2e/x", ("a.com", "/x", None)),
        ("http://a.com/..", ("a.com", "/", None)),
        ("http:///x", None),
        ("", None),
        (None, None),
    ],
)
def test_canonical(url, want):
    assert canonical(url) == want


@pytest.mark.parametrize("prefix", [1, 4])
def test_verdicts_match_brute_force(spark, prefix):
    from modalith.llm.url_filter import UrlParams

    rng = random.Random(9)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "q.w.e.r.t.y.a.com", "b.org", "1.2.3.4"]
    paths = ["/", "/p", "/p/", "/p/q", "/p/q/r/s/t/u", "/z.html"]
    urls = [f"http://{h}{p}{q}" for h, p, q in itertools.product(hosts, paths, ("", "?k=1", "#f"))] + [None, "", "nonsense", "http://"]
    rules = [(f"{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '', '?k=1'])}", rng.choice(["allow", "block"]), rng.choice([None, 0, 1])) for _ in range(25)]
    rules += [(None, "block", 0), ("a.com/", "mystery", 9), ("b.org/p", "block", 0), ("b.org/p", "allow", 0), ("b.org/z.html", "allow", 0), ("b.org/z.html", "block", 1)]
    got = {r["url"]: (r["action"], r["rule"]) for r in url_verdicts(spark.createDataFrame([(u,) for u in urls * 2], "url string"), spark.createDataFrame(rules, RULES), p=UrlParams(prefix_bytes=prefix)).collect()}
    assert got == {u: v for u in urls if (v := brute_verdict(u, rules))}


def test_rules_match_at_any_depth(spark):
    host, path = "q.w.e.r.t.y.u.a.com", "/1/2/3/4/5/6/7/p.html"
    urls = [f"http://{host}{path}?k=1", f"http://{host}/1/2/3/4/5/6/7", "http://a.com/w/x/y/z/p.html", "http://h.a.b.c.d.e.com/", "http://b.com/1/2/3/4/5/", "http://1.2.3.4/1/2/3/4/5/6", "http://localhost/x"]
    rules = [(f"{'.'.join(host.split('.')[-k:])}{'/'.join(path.split('/')[:n])}/", ("block", "allow")[k + n & 1], 0) for k in range(2, 10) for n in range(1, 9)]
    rules += [("a.com/w/x/y/z/", "block", 0), ("a.b.c.d.e.com/", "block", 0), ("b.com/", "block", 0), ("b.com/1/2/3/4/5/", "allow", 0), ("com/", "block", 0), ("1.2.3.4/1/2/3/4/5/", "block", 0), ("3.4/", "allow", 0)]

    def verdict(url, rules):
        h, path, _ = canonical(url)
        found = [(len(r[0]), len(r[1]), a, r[0] + r[1]) for e, a, _ in rules if (r := canonical(e)) and (h == r[0] or h.endswith("." + r[0])) and (path == r[1] or (r[1].endswith("/") and path.startswith(r[1])))]
        return max(found)[-2:] if found else None

    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    for some in (rules, rules[::3], rules[:8], rules[-7:]):
        got = {r["url"]: (r["action"], r["rule"]) for r in url_verdicts(pages, spark.createDataFrame(some, RULES)).collect()}
        assert got == {u: v for u in urls if (v := verdict(u, some))}


def test_default_rules_fit_any_table(spark):
    from modalith.llm.url_filter import default_rules

    bad = [f"http://{sub}{name}.example.{top}/en/7" for sub in ("", "www.", "m.", "blog.") for name in "spam-farm cheap-pills casino-win free-bets ads-track adult-x".split() for top in ("com", "net", "org")]
    fine = ["http://example.com/fr/7", "http://farm.example.com/en/7", "http://www.spam-farm.example.org/fr/7"]
    got = {r["url"]: r["action"] for r in url_verdicts(spark.createDataFrame([(u,) for u in bad + fine], "url string"), default_rules(spark)).collect()}
    assert got == {**dict.fromkeys(bad, "block"), fine[2]: "allow"}


def test_urls_on_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://bad.com/x", "k"), (1, "http://bad.com/x", "k"), (2, None, None), (3, "http://bad.com/ok/1", "k"), (None, "http://fine.com/", "k")], "page_id long, url string, `blocked` string")
    rules = spark.createDataFrame([("bad.com/", "block", None), ("bad.com/ok/", "allow", 0)], RULES)
    assert sorted((r["page_id"] or 0) for r in apply_url_rules(pages, rules).collect()) == [0, 2, 3]
    assert [tuple(r)[-2:] for r in page_verdicts(pages, rules).where("page_id = 1").collect()] == [("block", "bad.com/")] * 2
    none = spark.createDataFrame([], RULES)
    assert apply_url_rules(pages, none).count() == 5 and url_verdicts(pages.limit(0), rules).count() == 0


def brute_edits(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edits_match_the_table():
    rng = random.Random(2)
    for _ in range(300):
        p, t = ("".join(rng.choices("ab c", k=rng.randrange(1, n))) for n in (90, 140))
        assert edits(p, t) == brute_edits(p, t)


def leak_cases():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(1, 8)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 12, 30])))) for i in range(40)]
    docs = []
    for d in range(360):
        x = list(items[rng.randrange(40)][1])
        for _ in range(rng.randrange(int(0.1 * len(x)) + 4)):
            if x:
                i, op = rng.randrange(len(x)), rng.randrange(3)
                x[i : i + 1] = [[], [rng.choice("abc ")], [x[i], rng.choice("abc ")]][op]
        docs.append((d, " ".join(word() for _ in range(20)) + " " + "".join(x) + "! " + " ".join(word() for _ in range(20)), "en", "s", 1))
    return items, docs


def brute_leaks(items, docs, p):
    out = set()
    for i, t in items:
        s = normalised(t or "")
        k = int(p.error_rate * len(s)) if len(s) >= p.min_chars else 0
        for d, text, *_ in docs:
            if len(s) >= p.least_chars and text is not None and (e := brute_edits(f" {s} ", f" {normalised(text)} ")) <= k:
                out.add((d, str(i), round(1 - e / len(s), 6)))
    return out


def test_short_items_prove_nothing_and_words_are_whole():
    m = Matcher([("a", "a"), ("y", "yes"), ("x", "the answer"), ("n", "banana")], LeakParams())
    assert m.leaks("banana and eyesight, yes: a") == [] and m.leaks("breathe answers") == []
    assert m.leaks("What is THE answer?") == [("x", 0, 10)]
    m = Matcher([("y", "yes"), (None, "no")], LeakParams(least_chars=0))
    assert m.leaks("eyesight, another") == [] and m.leaks("Yes, no.") == [("y", 0, 3), (None, 0, 2)]


@pytest.mark.parametrize("batch", [300, 8_000_000])
def test_leaks_match_brute_force(spark, batch):
    items, docs = leak_cases()
    p = LeakParams(batch_chars=batch)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item"], round(r["similarity"], 6)) for r in benchmark_leaks(spark.createDataFrame(docs, SCHEMA), bench, p).collect()}
    want = brute_leaks(items, docs, p)
    assert got == want and len({d for d, *_ in want}) > 100
    left = {r["doc_id"] for r in drop_leaks(spark.createDataFrame(docs, SCHEMA), bench, p).collect()}
    assert left == {d[0] for d in docs} - {d for d, *_ in want}


def test_paired_pieces_lose_nothing():
    rng = random.Random(12)
    text = "".join(rng.choices("abcde ", k=130)).strip()
    m, s = Matcher([("x", text)], LeakParams()), normalised(text)
    k = int(0.1 * len(s))
    for _ in range(800):
        x = list(s)
        for _ in range(rng.randint(0, k + 1)):
            i, op = rng.randrange(len(x)), rng.randrange(3)
            x[i : i + 1] = [[], [rng.choice("abcde")], [x[i], rng.choice("abcde")]][op]
        t = normalised("zz " + "".join(x) + " zz")
        e = brute_edits(f" {s} ", f" {t} ")
        assert m.leaks(t) == ([("x", e, len(s))] if e <= k else [])


def test_leaks_on_odd_rows(spark):
    docs = odd_documents(spark, clash=True)
    bench = spark.createDataFrame([(1, "One two three four FIVE six sevn"), (1, "One two three four FIVE six sevn"), (None, "word0 word1"), (2, "o"), (3, None), (4, ""), (5, "!!!")], "item_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["item"])) for r in benchmark_leaks(docs, bench).collect())
    assert got == sorted([("1", "1"), ("1", "1"), ("2", "1"), ("None", "1"), ("6", "None"), ("6", "None")])
    left = drop_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 6
    assert benchmark_leaks(no_documents(spark), bench).count() == 0 and benchmark_leaks(docs, bench.limit(0)).count() == 0
