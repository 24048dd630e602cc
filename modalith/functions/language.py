"""Language identification and translation of a text column.

The identifier is pluggable. The one that is here is a naive Bayes over character n-grams with profiles of frequent words, small but
self-contained; its labels are not those of any other tool.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SAMPLES = {
    "en": "the of and to in is that it was for on are as with his they at be this have from or had by but not what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know thing tion ing ation ther",
    "fr": "le la les de des et un une en est que qui dans pour ne pas sur se ce il elle au aux par avec plus son sa ses mais comme nous vous ils ont cette tout être fait sont leur même aussi où très été entre sans deux peu moi toi faire dire voir avoir bien ans jour eau monde ment tion eux elle que éé aient oire ière",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich du wir ihr keit heit ung lich sch ein pf tz ß äö",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora ción mente ado ando ñ í ó",
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой ты от сказать так мочь о для уже человек вот год такой только себя один как другой когда ещё бы до время если сам очень рука жизнь первый самый ость ение ого ами",
}


def _grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [f"={word}", *w, *map(str.__add__, w, w[1:]), *(w[i : i + 3] for i in range(len(w) - 2))]


@lru_cache(1)
def _profiles() -> tuple[list[str], dict[str, int], np.ndarray]:
    """(languages, row of each n-gram, log probabilities by row and language); row 0 is that of all others."""
    counts = {}
    for lang, text in _SAMPLES.items():
        counts[lang] = Counter(g for w in text.split() for g in _grams(w) if g[0] != "=")
        counts[lang].update({f"={w}": 8 for w in text.split()})
    rows = {g: i for i, g in enumerate(sorted(set().union(*counts.values())), 1)}
    table = np.zeros((len(rows) + 1, len(counts)))
    for k, c in enumerate(counts.values()):
        total = sum(c.values()) + 4000
        table[:, k] = math.log(0.5 / total)
        for g, n in c.items():
            table[rows[g], k] = math.log((n + 0.5) / total)
    return list(counts), rows, table


@lru_cache(200_000)
def _word(word: str) -> np.ndarray:
    _, rows, table = _profiles()
    return table[[rows.get(g, 0) for g in _grams(word)]].sum(0)


def identify(text: str | None) -> tuple[str | None, float | None]:
    """(language, probability); a text without letters has neither."""
    words = Counter(re.findall(r"[^\W\d_]+", (text or "").lower()))
    if not words:
        return None, None
    scores = np.array(list(words.values())) @ np.array([_word(w) for w in words])
    best = int(scores.argmax())
    return _profiles()[0][best], round(float(1 / np.exp(np.minimum(0.0, scores - scores[best])).sum()), 2)


def language(text: Column, identifier: Callable[[str | None], tuple[str | None, float | None]] = identify) -> Column:
    """struct (lang, lang_score)."""

    @F.pandas_udf("lang string, lang_score double")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([identifier(t) for t in texts], columns=["lang", "lang_score"])

    return labelled(text)


def request_batches(texts: Iterable[str], budget: int) -> Iterator[list[str]]:
    """Texts in requests of fewer than budget characters; a text that alone has as many is a request of its own."""
    some: list[str] = []
    size = 0
    for t in texts:
        if len(t) >= budget:
            yield [t]
        elif size + len(t) >= budget:
            if some:
                yield some
            some, size = [t], len(t)
        else:
            some.append(t)
            size += len(t)
    if some:
        yield some


def translated(df: DataFrame, column: str, client: Callable[[list[str]], list[str]], budget: int = 3000, retries: int = 2) -> DataFrame:
    """df with <column>_translated. Every distinct text is sent once; a request that keeps failing gives null for its texts.

    client takes a list of texts and returns as many; it runs in tasks.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for request in request_batches(batch["source"], budget):
                answer: list[str | None] = [None] * len(request)
                for _ in range(retries + 1):
                    try:
                        got = client(request)
                    except Exception:  # noqa: BLE001, S112 - whatever a client raises
                        continue
                    if len(got) == len(request):
                        answer = got
                        break
                yield pd.DataFrame({"source": request, "target": answer})

    done = df.select(F.col(column).alias("source")).where("source is not null").distinct().mapInPandas(send, "source string, target string")
    out = f"{column}_translated"
    return df.drop(out).join(done.withColumnRenamed("target", out), F.col(column) == F.col("source"), "left").drop("source")
