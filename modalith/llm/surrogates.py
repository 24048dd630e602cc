"""Personal data becomes surrogates.

Found are e-mail and IPv4 addresses, telephone and card numbers (a plain run of digits only with a right check digit), social security numbers, IBANs, secrets behind a keyword, and names:
a known first name or a title before a surname, and that surname wherever else in the text it stands.

An entity's surrogate depends on a key, its kind and its canonical form alone, so one entity has one surrogate in all documents and
formats. Digits and letters are enciphered class by class by a Feistel network over strings of their length, which is one-to-one;
check digits are made anew. First names map to others of their gender and script, surnames to invented ones of their script, with the
gender's ending. Over the corpus, surrogates are then checked: one that two entities share, or that is itself an entity of the corpus,
is drawn again for all but the first, until none is left.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalith.llm.common import checkpointed, col, fresh, sized

FIRST_NAMES = {
    ("latin", "m"): "James Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Andrew Kenneth Joshua Kevin Brian George Timothy Edward Jacob Nicholas Jonathan Stephen Benjamin Samuel Gregory Patrick Peter Hans Klaus Jürgen Wolfgang Stefan Pierre Jacques Philippe François Carlos Miguel Javier Alejandro John Mark Paul Frank Henry",
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Margaret Sandra Ashley Emily Kimberly Michelle Dorothy Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Laura Cynthia Kathleen Angela Anna Emma Nicole Helen Samantha Katherine Christine Ursula Monika Sabine Claudia Nathalie Isabelle Camille Sophie Carmen Lucía María Pilar Rachel Julia Victoria",
    ("cyrillic", "m"): "Александр Дмитрий Сергей Андрей Алексей Михаил Николай Владимир Иван Евгений Павел Виктор Юрий Олег Константин Григорий Василий Борис Степан Роман",
    ("cyrillic", "f"): "Елена Ольга Наталья Анна Мария Татьяна Ирина Светлана Екатерина Людмила Галина Юлия Оксана Дарья Вера Надежда Любовь Валентина Ксения Полина",
}
TITLES = {"m": "Mr Mister Herr Monsieur Señor Sir Господин", "f": "Mrs Ms Miss Frau Madame Mademoiselle Señora Señorita Госпожа"}
_GENDER_SCRIPT = {n: k for k, names in FIRST_NAMES.items() for n in names.split()}
_TITLE = {t: g for g, ts in TITLES.items() for t in ts.split()}
_SURNAME = r"[^\W\d_a-zа-яё][^\W\d_]+(?:-[^\W\d_]+)?"
_FIRST, _ANY_TITLE = ("|".join(sorted(names, key=len, reverse=True)) for names in (_GENDER_SCRIPT, _TITLE))
_NAME = re.compile("|".join(sorted({*_GENDER_SCRIPT, *_TITLE}, key=len, reverse=True)))
_NAMED = re.compile(rf"({_ANY_TITLE})\.? (?:({_FIRST}) )?({_SURNAME})(?!\w)|({_FIRST}) ({_SURNAME})(?!\w)")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])")
_LOCAL = re.compile(r"[^\W_][\w.+%'-]*\Z|[\w.+%'-]+\Z")
_NUMBER = re.compile(
    r"(?P<ip>(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>\+\d{1,3}[ .-]?\(\d{1,5}\)[ .-]?\d{2,5}(?P<s1>[ .-])\d{2,5}(?:(?P=s1)\d{2,5}){0,2}(?!\w)|\+\d{1,3}(?P<s2>[ .-])\d{2,5}(?:(?P=s2)\d{2,8}){1,4}(?!\w)|\+\d{8,15}(?!\w)|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)|\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<card>\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}(?![\w-])|\d{4}[ -]\d{6}[ -]\d{5}(?![\w-])|\d{13,19}(?!\w))"
)
_START = re.compile(r"[+(]?\d+")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_KEYWORDS = ("token", "secret", "password", "passwd", "passphrase", "api_key", "apikey", "api-key", "access_key", "access-key", "private_key")
_SECRET = re.compile(r"(?:token|secret|passw(?:or)?d|passphrase|(?:api|access|private)[_-]?key)(?:[\w-]*)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_+/=.~-]{8,}(?<![.]))", re.I)

ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ", "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "αβγδεζηθικλμνξοπρστυφχψω"]
_CLASS = {c: k for k, a in enumerate(ALPHABETS) for c in a}


@dataclass(frozen=True)
class SurrogateParams:
    """key: secret, at least 8 bytes; with another key all surrogates are others. rounds: of drawing again, at most; more are needed only
    if nearly all values of a shape are in the corpus, and then there is an error."""

    key: bytes
    rounds: int = 50

    def __post_init__(self) -> None:
        if len(self.key) < 8:
            raise ValueError("a key has 8 bytes or more")


def luhn(digits: str) -> int:
    """The check digit behind these."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


class Surrogates:
    """canonical -> surrogate, both canonical: for kinds other than names, a string of the same shape."""

    def __init__(self, p: SurrogateParams) -> None:
        self.key = p.key
        self.first: dict[str, str] = {}
        for names in FIRST_NAMES.values():
            ring = sorted(names.split(), key=lambda n: self._mac("first", n))
            self.first |= dict(zip(ring, ring[1:] + ring[:1]))

    def _mac(self, *parts: object) -> bytes:
        return hmac.new(self.key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), hashlib.sha256).digest()

    def cipher(self, s: list[int], radix: int, *tweak: object) -> list[int]:
        """A permutation of the strings of this length over range(radix)."""
        if len(s) == 1:
            return [(s[0] + 1 + int.from_bytes(self._mac("one", radix, *tweak), "big") % (radix - 1)) % radix]
        half = len(s) // 2
        a, b = s[:half], s[half:]
        for r in range(8):
            size = radix ** len(a)
            f = int.from_bytes(self._mac(r, radix, len(s), *tweak, ",".join(map(str, b))), "big") % size
            n = 0
            for d in a:
                n = n * radix + d
            n = (n + f) % size
            new = [0] * len(a)
            for i in range(len(a) - 1, -1, -1):
                n, new[i] = divmod(n, radix)
            a, b = b, new
        return a + b

    def shaped(self, s: str, *tweak: object) -> str:
        """Letters and digits of each class enciphered where they stand; case and all else stay."""
        out = list(s)
        shape = "".join("?" if (k := _CLASS.get(c.lower())) is None else str(k) for c in s)
        for k, alphabet in enumerate(ALPHABETS):
            at = [i for i, x in enumerate(shape) if x == str(k)]
            if at:
                new = self.cipher([alphabet.index(s[i].lower()) for i in at], len(alphabet), k, shape, *tweak)
                for i, d in zip(at, new):
                    out[i] = alphabet[d].upper() if s[i] != s[i].lower() else alphabet[d]
        return "".join(out)

    def digits(self, s: str, *tweak: object) -> str:
        return "".join(map(str, self.cipher(list(map(int, s)), 10, *tweak))) if s else s

    def surname(self, s: str, attempt: int) -> str:
        cyrillic = "а" <= s[0] <= "ё"
        onsets, vowels, ends = ("б в г д ж з к л м н п р с т".split(), "а е и о у".split(), "ов ев ин ский".split()) if cyrillic else ("b br c d dr f g h k l m n p r s st t tr v w".split(), "a e i o u".split(), "son er man ley ton ard ell".split())
        out, bits = "", int.from_bytes(self._mac("surname", s, attempt), "big")
        for _ in range(3):
            bits, i = divmod(bits, len(onsets))
            bits, j = divmod(bits, len(vowels))
            out += onsets[i] + vowels[j]
        return out + onsets[bits % len(onsets)][0] + ends[bits // 31 % len(ends)]

    @lru_cache(maxsize=100_000)  # noqa: B019
    def of(self, kind: str, s: str, attempt: int = 0) -> str:
        if kind == "email":
            local, _, domain = s.rpartition("@")
            name, dot, top = domain.rpartition(".")
            return f"{self.shaped(local, 'local', domain, attempt)}@{self.shaped(name, 'domain')}{dot}{top}"
        if kind == "ip":
            n = self.cipher(list(bytes(map(int, s.split(".")))), 256, "ip", attempt)
            return ".".join(map(str, n))
        if kind in ("ssn", "phone"):
            return self.digits(s, kind, attempt)
        if kind == "card":
            shift = (int(s[-1]) - luhn(s[:-1])) % 10
            new = self.digits(s[:-1], kind, attempt)
            return new + str((luhn(new) + shift) % 10)
        if kind == "iban":
            body = self.shaped(s[4:], "iban", attempt)
            return f"{s[:2]}{98 - int(''.join(str(int(c, 36)) for c in body + s[:2] + '00')) % 97:02d}{body}"
        if kind == "secret":
            if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
                new = "".join("0123456789abcdef"[d] for d in self.cipher([int(c, 16) for c in s], 16, "hex", attempt))
                return new if s == s.lower() else new.upper()
            return self.shaped(s, "secret", attempt)
        return self.surname(s, attempt)


def _iban_ok(s: str) -> bool:
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _stem(surname: str) -> tuple[str, str]:
    """(canonical, ending that marks the gender)."""
    low = surname.lower()
    for end, instead in (("ская", "ский"), ("цкая", "цкий")):
        if low.endswith(end):
            return low[:-4] + instead, "f"
    if re.search(r"(?:ов|ев|ёв|ин|ын)а$", low) and len(low) > 4:
        return low[:-1], "f"
    return low, ""


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical) of every entity, in order and without overlap."""
    spans: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if local and domain:
            spans.append((local.start(), domain.end(), "email", text[local.start() : domain.end()].lower()))
        at = text.find("@", at + 1)
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        spans += [(*m.span(1), "secret", m.group(1).lower() if re.fullmatch(r"[0-9a-fA-F]{16,}", m.group(1)) else m.group(1)) for m in _SECRET.finditer(text) if any(c.isdigit() for c in m.group(1))]
    for m in _IBAN.finditer(text):
        s = m.group().replace(" ", "")
        if _iban_ok(s) and not (m.start() and text[m.start() - 1].isalnum()):
            spans.append((*m.span(), "iban", s))
    for m in _numbers(text):
        before = text[m.start() - 1] if m.start() else " "
        if before.isalnum() or before == "_" or before in ".-" and m.start() > 1 and text[m.start() - 2].isalnum():
            continue
        kind, s = m.lastgroup, m.group()
        if kind == "ip":
            if all(int(x) < 256 for x in s.split(".")):
                spans.append((*m.span(), "ip", ".".join(str(int(x)) for x in s.split("."))))
        elif kind == "phone":
            spans.append((*m.span(), "phone", _national(s)))
        else:
            digits = re.sub(r"\D", "", s)
            # a plain run of digits may be a clock or an identifier; that of a card has its check digit
            if kind != "card" or digits != s or int(s[-1]) == luhn(s[:-1]):
                spans.append((*m.span(), kind, digits))
    spans += _names(text)
    spans.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str, str]] = []
    for x in spans:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def _numbers(text: str) -> Iterator[re.Match]:
    """What _NUMBER finds where a digit, a plus or a parenthesis begins, tried at no other place."""
    at = 0
    while start := _START.search(text, at):
        m = _NUMBER.match(text, start.start())
        at = m.end() if m else start.end()
        if m:
            yield m


def _country(phone: str) -> int:
    """How many characters of a number in international format are its country code, with the plus."""
    if phone[0] != "+":
        return 0
    m = re.match(r"\+\d{1,3}(?=[ .(-])", phone)
    return m.end() if m else 2


def _national(phone: str) -> str:
    return re.sub(r"\D", "", phone[_country(phone) :])


def _names(text: str) -> list[tuple[int, int, str, str]]:
    spans, surnames = [], set()
    at = 0
    # the alternation of plain words is searched fast; what is around them is looked at only there
    while start := _NAME.search(text, at):
        m = _NAMED.match(text, start.start())
        at = start.end()
        if not m or m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
            continue
        g, h = (2, 3) if m[1] else (4, 5)
        last = m[h]
        if last in _GENDER_SCRIPT or last in _TITLE or last.isupper():
            continue
        at = m.end()
        if m[g]:
            spans.append((*m.span(g), "first", m[g]))
        spans.append((*m.span(h), "surname", _stem(last)[0]))
        surnames.add(last)
    done = {s[:2] for s in spans}
    for last in surnames:
        for m in re.finditer(rf"(?<!\w){re.escape(last)}(?!\w)", text):
            if m.span() not in done:
                spans.append((*m.span(), "surname", _stem(last)[0]))
    return spans


def render(kind: str, original: str, surrogate: str) -> str:
    """The canonical surrogate in the original's format."""
    if kind in ("phone", "card", "ssn"):
        new = iter(surrogate)
        skip = _country(original) if kind == "phone" else 0
        return original[:skip] + "".join(next(new) if c.isdigit() else c for c in original[skip:])
    if kind == "iban":
        new = iter(surrogate)
        return "".join(c if c == " " else next(new) for c in original)
    if kind == "surname":
        if _stem(original)[1] == "f":
            surrogate = surrogate[:-4] + "ская" if surrogate.endswith("ский") else surrogate + "а"
        return surrogate.capitalize()
    if kind in ("email", "secret") and original == original.upper() != original.lower():
        return surrogate.upper()
    return surrogate


def replaced(text: str, make: Surrogates, attempts: dict[tuple[str, str], int]) -> tuple[str, int]:
    """(text with surrogates, their number)."""
    spans = find(text)
    if not spans:
        return text, 0
    out, at = [], 0
    for a, b, kind, s in spans:
        new = make.first[s] if kind == "first" else make.of(kind, s, attempts.get((kind, s), 0))
        out += [text[at:a], render(kind, text[a:b], new)]
        at = b
    return "".join([*out, text[at:]]), len(spans)


def corpus_entities(docs: DataFrame) -> DataFrame:
    """(th, kind, value): entities but first names of each text, known by its hash; checkpointed."""

    @F.pandas_udf("array<struct<kind:string,value:string>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "value": v} for k, v in sorted({x[2:] for x in find(t)}) if k != "first"] for t in texts], dtype=object)

    rows = docs.where(col("text").isNotNull()).select(F.xxhash64(col("text")).alias("th"), F.explode(found(col("text"))).alias("e"))
    return checkpointed(rows.select("th", "e.kind", "e.value").distinct())


def redrawn(entities: DataFrame, p: SurrogateParams) -> DataFrame:
    """(kind, value, attempt) of the entities (kind, value, each once) that don't keep their first surrogate; checkpointed. The check
    covers all of them in every round, and each surrogate's holder is the entity that has been drawn least, then the least value."""

    @F.pandas_udf("string")
    def drawn(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        make = Surrogates(p)
        for kinds, values, attempts in batches:
            yield pd.Series([make.of(k, v, int(a)) for k, v, a in zip(kinds, values, attempts)], dtype=object)

    now = entities.select("kind", "value", F.lit(0).alias("attempt"))
    for _ in range(p.rounds):
        made = now.withColumn("surrogate", drawn("kind", "value", "attempt"))
        taken = entities.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("taken"))
        # one shuffle by (kind, surrogate) finds both sorts of collision
        all_ = made.select("kind", "surrogate", F.struct("attempt", "value").alias("who"), F.lit(False).alias("taken")).unionByName(taken.withColumn("who", F.lit(None).cast("struct<attempt:int,value:string>")))
        group = all_.groupBy("kind", "surrogate").agg(F.max("taken").alias("taken"), F.min("who").alias("first"), F.count("who").alias("n"))
        trouble = checkpointed(group.where("(taken and n > 0) or n > 1"))
        if trouble.isEmpty():
            return checkpointed(now.where("attempt > 0"))
        hit = made.join(sized(trouble), ["kind", "surrogate"], "left")
        again = F.col("n").isNotNull() & (F.col("taken") | (F.col("value") != F.col("first.value")))
        now = checkpointed(hit.select("kind", "value", (F.col("attempt") + again.cast("int")).alias("attempt")))
    raise ValueError(f"no free surrogates are left for some of {[r[0] for r in trouble.select('kind').distinct().limit(5).collect()]}")


def pseudonymised(docs: DataFrame, p: SurrogateParams) -> DataFrame:
    """docs, text with surrogates for personal data, and n_replaced (int). A column of that name in docs is replaced.

    A null text stays null with none replaced, and an empty one empty. Repeated texts change alike. What is no entity stays, character
    by character. An empty table gives an empty table; other columns play no part and are not searched.
    """
    docs = docs.drop("n_replaced")
    entities = corpus_entities(docs)
    again = redrawn(entities.select("kind", "value").distinct(), p)
    th, redo, new = fresh(docs, "th", "redo", "new")
    entry = F.struct("kind", "value", "attempt")
    redone = checkpointed(entities.join(sized(again), ["kind", "value"]).groupBy(F.col("th").alias(th)).agg(F.to_json(F.collect_list(entry)).alias(redo)))

    @F.pandas_udf("text string, n int")
    def rewritten(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import json

        make = Surrogates(p)
        for texts, redos in batches:
            rows = []
            for t, r in zip(texts, redos):
                attempts = {(e["kind"], e["value"]): e["attempt"] for e in json.loads(r)} if r else {}
                rows.append((None, 0) if t is None else replaced(t, make, attempts))
            yield pd.DataFrame(rows, columns=["text", "n"])

    if redone.isEmpty():
        work = docs.withColumn(redo, F.lit(None).cast("string"))
    else:
        work = docs.withColumn(th, F.xxhash64(col("text"))).join(sized(redone), th, "left")
    work = work.withColumn(new, rewritten(col("text"), F.col(redo)))
    return work.select(*(F.col(f"{new}.text").alias("text") if c == "text" else col(c) for c in docs.columns), F.col(f"{new}.n").alias("n_replaced"))
