import gzip
import hashlib
import json
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from modalith.llm.surrogates import SurrogateParams, Surrogates, find, luhn, pseudonymised, redrawn, render, replaced
from modalith.llm.warc import derivatives, derived, digest, parsed, responses, warc_bytes, warc_records
from tests.llm.odd import SCHEMA, no_documents, odd_documents

P = SurrogateParams(b"a key for tests")


def entities(text):
    return [(k, text[a:b]) for a, b, k, _ in find(text)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("write to Ann.Lee+x@Mail5.Example.com.", [("email", "Ann.Lee+x@Mail5.Example.com")]),
        ("éa.05@mail5.example.com", [("email", "éa.05@mail5.example.com")]),
        ("call +1 (743) 555-3824, or 743-555-3824!", [("phone", "+1 (743) 555-3824"), ("phone", "743-555-3824")]),
        ("+49 30 1234567, +4930123456789", [("phone", "+49 30 1234567"), ("phone", "+4930123456789")]),
        ("tel (743) 555-3824%%%", [("phone", "(743) 555-3824")]),
        ("card 4111 1111 1111 1111 or 4111111111111111", [("card", "4111 1111 1111 1111"), ("card", "4111111111111111")]),
        ("at 1700000000123, no 4111111111111112 and 4111 1111 1111 1112", [("card", "4111 1111 1111 1112")]),
        ("host 10.0.0.1, 300.1.1.1, 1.2.3.4.5 and 2.0.", [("ip", "10.0.0.1")]),
        ("ssn 078-05-1120", [("ssn", "078-05-1120")]),
        ("DE89 3704 0044 0532 0130 00 and DE88 3704", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ('TOKEN = "24BE64439E3E49CF46B2"!!', [("secret", "24BE64439E3E49CF46B2")]),
        ("api_key: abcDEF123456, the token of love, password = hunter22x", [("secret", "abcDEF123456"), ("secret", "hunter22x")]),
        ("Dr. said Mr. Smith met Mary Jones. Smith left.", [("surname", "Smith"), ("first", "Mary"), ("surname", "Jones"), ("surname", "Smith")]),
        ("Ольга Иванова", [("first", "Ольга"), ("surname", "Иванова")]),
        ("Mary. Then James was 2024-01-02 a@b version 3.0 @ x 123456", []),
        ("", []),
    ],
)
def test_what_is_found(text, want):
    assert entities(text) == want


def test_surrogates_keep_type_format_and_coreference():
    text = 'Ann.05@mail5.example.com ANN.05@MAIL5.EXAMPLE.COM +1 (743) 555-3824 743-555-3824 4111 1111 1111 1111 10.0.0.1 078-05-1120 DE89 3704 0044 0532 0130 00 token = "24be64439e3e49cf46b2" Mr. John Smith, Mary Jones, Smith. Ольга Иванова, Иван Иванов.'
    new, n = replaced(text, Surrogates(P), {})
    assert n == len(find(text)) == 18
    before, after = entities(text), entities(new)
    assert [k for k, _ in before] == [k for k, _ in after] and not {v for _, v in before} & {v for _, v in after}
    shape = lambda s: re.sub(r"\d", "9", s)
    values = [v for _, v in after]
    for (k, a), b in zip(before, values):
        if k in ("phone", "card", "ssn"):
            assert shape(a) == shape(b)
    assert values[0].upper() == values[1] and values[0] != values[1]
    assert values[2] == re.sub(r"^(\d{3})-", r"+1 (\1) ", values[3])
    card = re.sub(r"\D", "", values[4])
    assert int(card[-1]) == luhn(card[:-1])
    assert re.fullmatch("[0-9a-f]{20}", values[8])
    assert values[10] == values[13]  # Smith
    assert values[15] in (values[17] + "а", values[17][:-4] + "ская")  # Ivanov's name, with her ending
    from modalith.llm.surrogates import FIRST_NAMES

    assert values[9] in FIRST_NAMES["latin", "m"].split() and values[11] in FIRST_NAMES["latin", "f"].split()
    assert values[14] in FIRST_NAMES["cyrillic", "f"].split() and values[16] in FIRST_NAMES["cyrillic", "m"].split()
    assert replaced(text, Surrogates(SurrogateParams(b"other than that")), {})[0] != new


def test_cipher_is_one_to_one():
    s = Surrogates(P)
    assert len({s.digits(f"{i:03d}") for i in range(1000)}) == 1000
    assert len({s.of("card", f"{i:013d}") for i in range(3000)}) == 3000
    assert len({s.of("ip", f"1.2.{i // 256}.{i % 256}") for i in range(3000)}) == 3000
    assert len({s.first[n] for n in s.first}) == len(s.first) and all(k != v for k, v in s.first.items())


def test_collisions_are_drawn_again(spark):
    # three digits leave a thousand surrogates: many that are drawn are another's original
    rows = [("ssn", f"{i:03d}") for i in range(120)] + [("surname", f"name{i}") for i in range(30)]
    got = {(r["kind"], r["value"]): r["attempt"] for r in redrawn(spark.createDataFrame(rows, "kind string, value string"), P).collect()}
    make = Surrogates(P)
    final = {(k, v): make.of(k, v, got.get((k, v), 0)) for k, v in rows}
    for kind in ("ssn", "surname"):
        values, new = {v for k, v in rows if k == kind}, [x for (k, _), x in final.items() if k == kind]
        assert len(set(new)) == len(new) and not values & set(new)
    assert got


def test_a_key_is_asked_for_and_a_full_space_is_an_error(spark):
    with pytest.raises(TypeError):
        SurrogateParams()
    with pytest.raises(ValueError):
        SurrogateParams(b"short")
    every = spark.createDataFrame([("ssn", str(i)) for i in range(10)], "kind string, value string")
    with pytest.raises(ValueError, match="no free surrogates"):
        redrawn(every, SurrogateParams(b"a key for tests", rounds=3))


def brute_replaced(rows, redo):
    """The corpus rewritten entity by entity, each with the surrogate of its own last draw."""
    make, out = Surrogates(P), []
    for d, t in rows:
        new, at, n = "", 0, 0
        for a, b, kind, value in find(t):
            s = make.first[value] if kind == "first" else make.of(kind, value, redo.get((kind, value), 0))
            new, at, n = new + t[at:a] + render(kind, t[a:b], s), b, n + 1
        out.append((d, new + t[at:], n))
    return sorted(out)


def test_corpus_matches_brute_force(spark):
    rows = [(i, f"No {i % 40:03d}-45-{i % 7:04d}, Mr. {'Ab' if i % 2 else 'Cd'}{'xyz'[i % 3]}eson at 10.0.{i % 30}.{i % 9} or u{i}@a.com. Nothing else.") for i in range(150)]
    values = {(k, v) for _, t in rows for *_, k, v in find(t) if k != "first"}
    make, redo = Surrogates(P), {x: 0 for x in values}
    while True:  # all collisions of a round are found before the next
        now = {x: make.of(*x, redo[x]) for x in values}
        holders = {}
        for (k, v), s in now.items():
            holders.setdefault((k, s), []).append((redo[k, v], v))
        again = [(k, v) for (k, v), s in now.items() if (k, s) in values or min(holders[k, s])[1] != v]
        if not again:
            break
        for x in again:
            redo[x] += 1
    got = pseudonymised(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), P).collect()
    assert sorted(map(tuple, got)) == brute_replaced(rows, redo)


def test_corpus_is_consistent(spark):
    docs = spark.createDataFrame([(i, f"mail u{i % 50}.x@a.com and {i % 40:03d}-45-6789", "en", "s", 1) for i in range(200)] + [(900, "nothing here", "en", "s", 1)], SCHEMA)
    got = pseudonymised(docs.repartition(5), P).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").collect()
    seen = {}
    for r in got:
        a, b = entities(r["was"]), entities(r["text"])
        assert r["n_replaced"] == len(a) == len(b)
        for x, y in zip(a, b):
            assert seen.setdefault(x, y) == y
        if not a:
            assert r["text"] == r["was"]
    assert len(set(seen.values())) == len(seen) and not set(seen) & set(seen.values())


def test_surrogates_on_odd_rows(spark):
    docs = odd_documents(spark, clash=True)
    got = pseudonymised(docs, P)
    assert got.columns == [*(c for c in docs.columns if c != "n_replaced"), "n_replaced"]
    assert got.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0 and got.where("n_replaced <> 0").count() == 0
    assert pseudonymised(no_documents(spark), P).count() == 0


class Plain(HTMLParser):
    """The text of simple pages, by a parser of another make."""

    BLOCKS = {"p", "div", "h1", "title", "body", "html", "head", "li", "ul", "br", "nav", "article"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.out += ["\n"] if tag in self.BLOCKS else []

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        self.out += ["\n"] if tag in self.BLOCKS else []

    def handle_data(self, data):
        self.out += [] if self.skip else [data]


def test_text_matches_another_parser(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        p = Plain()
        p.feed(r["html"])
        p.close()
        assert parsed(r["html"], r["url"])[0].split() == "".join(p.out).split()


def test_odd_pages():
    text, facts = parsed('<!-- <p>no</p> --><TITLE>A &amp; B</TITLE><script src="/s.js">if (a < b) "<p>"</script><p title="a > b">x<b>y</b><br/>z&nbsp;&lt;q&gt;<a href=\'../u?a=1&amp;b=2\'>k</a> 1 < 2 <style>p{', "http://h.com/d/e")
    assert text == "A & B\nxy\nz <q>k 1 < 2" and facts["title"] == "A & B"
    assert [x["url"] for x in facts["links"]] == ["http://h.com/s.js", "http://h.com/u?a=1&b=2"]
    assert parsed("", None)[0] == "" and parsed("<" * 3000 + "<a href=" * 3000, None)[0]
    assert parsed('<a href="http://[bad">x</a>', "http://[worse")[1]["links"][0]["url"] == "http://[bad"


def test_records_are_linked_and_read_back(spark):
    rows = derived(7, "http://h.com/", "<html lang=de><p>Grüße</p>", source={"WARC-IP-Address": "1.2.3.4"})
    data = b"".join(warc_bytes(r[8], r[9].encode()) for r in rows)
    for (headers, block), row in zip(warc_records(data), rows, strict=True):
        assert headers["WARC-Refers-To"] == row[3] and headers["WARC-Record-ID"] == row[2] and headers["WARC-Block-Digest"] == digest(block)
        assert headers["WARC-Payload-Digest"] == digest("<html lang=de><p>Grüße</p>".encode()) and int(headers["Content-Length"]) == len(block)
    assert rows[1][9] == "Grüße" and "Content-Language: de" in rows[1][8] and json.loads(rows[0][9])["source"]["WARC-IP-Address"] == "1.2.3.4"
    with pytest.raises(ValueError):
        list(warc_records(data[:-9], strict=True))
    assert len(list(warc_records(data[:-9]))) == 1
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>one</p>"
    head = f"WARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: http://a.com/\r\nX-Own: kept\r\nContent-Length: {len(block)}"
    info = warc_bytes("WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0>\r\nContent-Length: 0", b"")
    files = spark.createDataFrame([("a", bytearray(info + warc_bytes(head, block))), ("b", bytearray(gzip.compress(warc_bytes(head, block))))], "path string, content binary")
    got = derivatives(responses(files), own=True).collect()
    assert len(got) == 4 and {r["refers_to"] for r in got} == {"<urn:uuid:1>"} and all("WARC-Date: 2020-01-01" in r["headers"] for r in got)
    assert json.loads(got[0]["block"])["source"]["X-Own"] == "kept"
    assert hashlib.sha1(b"<p>one</p>").digest() and got[0]["payload_digest"] == digest(b"<p>one</p>")


def test_derivatives_on_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "<p>x"), (1, "http://a.com/", "<p>x"), (2, None, "y"), (None, None, ""), (3, "u", None), (4, "not a url", "<p>" + "long " * 200_000)], "page_id long, url string, html string").withColumn("block", F.lit(1)).withColumn("a.b", F.lit(2))
    got = derivatives(pages).collect()
    assert sorted((str(r["page_id"]), r["record_type"]) for r in got) == sorted([*[("1", k) for k in ("metadata", "conversion")] * 2, *((i, k) for i in ("2", "None", "4") for k in ("metadata", "conversion"))])
    assert all(r["content_length"] == len(r["block"].encode()) for r in got)
    assert {len(r["block"]) for r in got if r["page_id"] == 4 and r["record_type"] == "conversion"} == {999_999}
    assert derivatives(pages.limit(0)).count() == 0


def test_pages_take_linear_time():
    import time

    for page in ("<a " * 100_000, "<a '" * 50_000 + ">", "<" * 200_000, "<a " + "b" * 200_000 + " c=d>", "<script>" * 50_000, "<!--" * 100_000, "<a b=\"" * 100_000, "<p>x</p>" * 50_000, "&amp" * 100_000, "<a x='" + "y" * 100_000 + "<b>" * 50_000):
        began = time.time()
        parsed(page, "http://a.com/")
        assert time.time() - began < 5, page[:20]
    assert parsed("a <b c='d>e <i>f</i> g", None)[0] == "a e f g" and parsed("x < y <b", None)[0] == "x < y <b"


def brute_tags(page):
    """Text and link targets of a page without comments and hidden elements, character by character."""
    text, links, i = [], [], 0
    while i < len(page):
        if page[i] != "<" or not page[i + 1 : i + 2].isalpha() and page[i + 1 : i + 2] != "/":
            text.append(page[i])
            i += 1
            continue
        j, quote = i + 1, ""
        while page[j] != ">" or quote:
            quote = "" if page[j] == quote else quote or (page[j] if page[j] in "\"'" else "")
            j += 1
        inside = page[i + 1 : j]
        if inside.startswith("a href="):
            links.append(inside[7:].strip("\"'"))
        if inside.strip("/") == "p":
            text.append("\n")
        i = j + 1
    return "".join(text), links


def test_pages_match_brute_force():
    import random

    rng = random.Random(3)
    pieces = ["<p>", "</p>", "<b>", "</b>", '<a href="http://h.com/a>b">', "<a href='http://h.com/c\"d'>", "<a href=http://h.com/e>", "</a>", "word ", "1 < 2 ", "x", ' "quoted" ', "\n"]
    for _ in range(400):
        page = "".join(rng.choices(pieces, k=rng.randrange(30)))
        text, facts = parsed(page, None)
        want, links = brute_tags(page)
        assert text.split() == want.split() and [x["url"] for x in facts["links"]] == links


def test_source_digests_and_encodings_are_kept(spark):
    import zlib

    def record(number, block, more=""):
        head = f"WARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{number}>\r\nWARC-Target-URI: http://a.com/{number}{more}\r\nContent-Length: {len(block)}"
        return warc_bytes(head, block)

    http = lambda more, body: b"HTTP/1.1 200 OK\r\n" + more + b"\r\n\r\n" + body
    page = "<p>Gr\u00fc\u00dfe</p>"
    latin, packed = page.encode("latin-1"), gzip.compress(page.encode())
    chunks = b"5\r\n" + latin[:5] + b"\r\n" + b"%x;x=y\r\n" % (len(latin) - 5) + latin[5:] + b"\r\n0\r\n\r\n"
    blocks = [
        http(b"Content-Type: text/html; charset=ISO-8859-1", latin),
        http(b"Content-Encoding: gzip", packed),
        http(b"Transfer-Encoding: chunked\r\nContent-Type: text/html;charset=latin1", chunks),
        http(b"Content-Encoding: deflate", zlib.compress(page.encode())),
        http(b"X: y", b"<meta charset='latin-1'>" + latin),
        http(b"Content-Encoding: gzip\r\nContent-Type: text/html; charset=nonsense", page.encode()),
    ]
    whole = b"".join(record(i, b) for i, b in enumerate(blocks)) + record(9, blocks[0], "\r\nWARC-Payload-Digest: sha1:OWN\r\nWARC-Block-Digest: sha1:BLOCK")
    got = derivatives(responses(spark.createDataFrame([("a", bytearray(whole)), ("n", None)], "path string, content binary")), own=True).collect()
    texts = {r["refers_to"]: r["block"] for r in got if r["record_type"] == "conversion"}
    assert set(texts.values()) == {"Gr\u00fc\u00dfe"} and len(texts) == 7
    of = {(r["refers_to"], r["record_type"]): r for r in got}
    assert {of["<urn:uuid:9>", k]["payload_digest"] for k in ("metadata", "conversion")} == {"sha1:OWN"}
    assert all("WARC-Payload-Digest: sha1:OWN" in of["<urn:uuid:9>", k]["headers"] for k in ("metadata", "conversion"))
    assert json.loads(of["<urn:uuid:9>", "metadata"]["block"])["source"]["WARC-Block-Digest"] == "sha1:BLOCK"
    assert of["<urn:uuid:1>", "metadata"]["payload_digest"] == digest(packed) and of["<urn:uuid:2>", "metadata"]["payload_digest"] == digest(latin)


def test_damaged_files_end_nothing(spark):
    block = b"HTTP/1.1 200 OK\r\n\r\n<p>x"
    one = lambda n: warc_bytes(f"WARC-Type: response\r\nno header here\r\nWARC-Record-ID: <urn:uuid:{n}>\r\nContent-Length: {len(block)}", block)
    files = {
        "junk": b"nothing of the kind", "empty": b"", "junk between": one(1) + b"junk\r\nmore\r\n" + one(2), "no length": b"WARC/1.0\r\nWARC-Type: response\r\n\r\nabc\r\n" + one(3),
        "cut": one(4) + one(5)[:-9], "bad length": one(6).replace(b"Length: ", b"Length: x") + one(7), "bad gzip": gzip.compress(one(8)) + gzip.compress(one(9))[:-12],
    }
    got = responses(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")).collect()
    assert {r["record_id"] for r in got} >= {f"<urn:uuid:{i}>" for i in (1, 2, 3, 4, 7, 8)} and {r["html"] for r in got} == {"<p>x"}


def test_foreign_columns_are_left_alone(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "<p>x", "no JSON", "17", "mine")], "page_id long, url string, html string, headers string, date string, record_id string")
    got = derivatives(pages).collect()
    assert {r["refers_to"] for r in got} == {r["refers_to"] for r in derivatives(pages.select("page_id", "url", "html")).collect()}
    assert {r["refers_to"] for r in derivatives(pages, own=True).collect()} == {"mine"}
    assert len(derivatives(pages.withColumn("headers", F.lit("[1, 2]")), own=True).collect()) == 2
