"""Problem 5: languages of pages and of the segments they mix.

Word-first backoff: a known word is scored by its log frequency in each
language; an unseen one falls back to its longest character n-grams that are
known, and so on to shorter ones.  The model is fitted on a bounded sample of
labelled pages (``SAMPLE_PAGES`` per label), then once more on the same pages
under the language it gave them, which takes out wrong labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

#: Pages per declared language the model is fitted on, drawn by hash; documented bound of the training sample.
SAMPLE_PAGES = 500
#: Longest n-grams of the backoff.
LONGEST = 4
_UNSPACED = "一-鿿㐀-䶿぀-ヿ฀-๿"
_WORDS = re.compile(rf"[{_UNSPACED}]+|[^\W\d_{_UNSPACED}]+(?:[’'\-][^\W\d_{_UNSPACED}]+)*[ऀ-ॿ]*|[ऀ-ॿ]+")
_NAMED = re.compile(r"\d|\w[._/\\]\w")  # file names, paths, versions: no language of their own
_OTHERS = re.compile(rf"[^{_UNSPACED}]+")
_HEADING = re.compile(r"^##\s.*$", re.M)

# fixed values: labels that name a language, in the spellings of ISO 639 codes and English names
_SPELLINGS = {
    "en": "en eng english", "de": "de deu ger german", "fr": "fr fra fre french", "es": "es spa spanish", "pt": "pt por portuguese",
    "pl": "pl pol polish", "ru": "ru rus russian", "zh": "zh zho chi cmn chinese", "ja": "ja jpn japanese", "th": "th tha thai", "hi": "hi hin hindi",
    "uk": "uk ukr ukrainian", "it": "it ita italian", "nl": "nl nld dut dutch", "sv": "sv swe swedish", "cs": "cs ces cze czech", "ar": "ar ara arabic",
    "ko": "ko kor korean", "tr": "tr tur turkish", "vi": "vi vie vietnamese", "ca": "ca cat catalan", "bg": "bg bul bulgarian",
}
CODES = {s: code for code, names in _SPELLINGS.items() for s in names.split()}


def declared(label: Column) -> Column:
    """Two-letter code a label names in any spelling (code, region, English name); null if it names no language."""
    plain = F.lower(F.regexp_replace(F.trim(label), "[-_].*$", ""))
    pairs = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    code = F.element_at(pairs, plain)
    other = F.when(plain.rlike("^[a-z]{2}$") & ~plain.isin("un", "xx", "zz", "qq"), plain)
    return F.coalesce(code, other)


def _token_words(tok: str) -> list[str]:
    if _NAMED.search(tok):
        tok = _OTHERS.sub(" ", tok)
    out = []
    for w in _WORDS.findall(tok):
        if "\u0e00" <= w[0] <= "\u0e7f" or "\u3040" <= w[0] <= "\u9fff":
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(w)
    return out


def words(text: str) -> list[str]:
    """Lower-case words; runs of unspaced scripts are cut into pieces of two characters."""
    out: list[str] = []
    for tok in text.lower().split():
        if tok.isalpha() and tok[-1] < "\u0900":
            out.append(tok)
        else:
            out += _token_words(tok)
    return out


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class LanguageModel:
    """Log frequencies of words and n-grams per language; tokens are scored many at a time and remembered."""

    #: Tokens remembered at once; then the memory starts anew.
    MOST = 300_000

    def __init__(self, langs: list[str], counts: dict[str, dict[str, list[float]]]):
        self.langs = langs
        self.places: dict[str, dict[str, int]] = {}
        self.logs: dict[str, np.ndarray] = {}
        for level, table in counts.items():
            n = np.array(list(table.values())).reshape(len(table), len(langs))
            self.places[level] = dict(zip(table, range(len(table))))
            self.logs[level] = np.log((n + 0.3) / (n.sum(axis=0) + 1.0 + 0.3 * len(table)))
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.matrix = np.zeros((1024, len(self.langs)))

    def scores(self, words: list[str]) -> np.ndarray:
        """Per word its log frequency in each language, or that of its longest known n-grams; differences are what counts."""
        out = np.zeros((len(words), len(self.langs)))
        known = self.places["w"]
        at = np.fromiter((known.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        out[at >= 0] = self.logs["w"][at[at >= 0]]
        left = np.flatnonzero(at < 0).tolist()
        for n in range(LONGEST, 0, -1):
            places, owners, found, rest = self.places[str(n)], [], [], []
            for i in left:
                got = [p for g in grams(words[i], n) if (p := places.get(g)) is not None]
                if got and (n == 1 or len(got) * 2 >= len(words[i])):
                    owners.append(i)
                    found.append(got)
                else:
                    rest.append(i)
            if owners:
                starts = np.cumsum([0, *map(len, found[:-1])])
                # names have no language: an unseen word weighs less than a known one
                out[owners] = np.add.reduceat(self.logs[str(n)][np.concatenate(found)], starts, axis=0) * (0.4 * n / LONGEST)
            left = rest
        return np.clip(out - out.max(axis=1, keepdims=True, initial=-np.inf), -8.0, 0.0)

    def token_scores(self, toks: list[str]) -> np.ndarray:
        """Summed scores of the words of each token without white space."""
        parts = [words(t) for t in toks]
        number: dict[str, int] = {}
        ids = [number.setdefault(w, len(number)) for p in parts for w in p]
        out = np.zeros((len(toks), len(self.langs)))
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        if ids:
            some = sizes > 0
            out[some] = np.add.reduceat(self.scores(list(number))[ids], (np.cumsum(sizes) - sizes)[some], axis=0)
        return out

    def numbers(self, toks: list[str]) -> np.ndarray:
        """Row of each token in ``matrix``; tokens not met before are scored together."""
        if len(self.rows) > self.MOST:
            self.forget()
        new = list(set(toks).difference(self.rows))
        if new:
            n = len(self.rows)
            while n + len(new) > len(self.matrix):
                self.matrix = np.vstack([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[n : n + len(new)] = self.token_scores(new)
            self.rows.update(zip(new, range(n, n + len(new))))
        return np.fromiter(map(self.rows.__getitem__, toks), dtype=np.int64, count=len(toks))

    def evidence(self, text: str) -> np.ndarray:
        rows = self.numbers(text.split())
        return self.matrix[rows].sum(axis=0)

    def around(self, toks: list[str], before: int = 10, after: int = 3) -> list[str]:
        """Language of the words around each of the tokens."""
        if not toks:
            return []
        rows = self.numbers(toks)
        sums = np.vstack([np.zeros(len(self.langs)), np.cumsum(self.matrix[rows], axis=0)])
        at = np.arange(len(toks))
        window = sums[np.minimum(len(toks), at + after + 1)] - sums[np.maximum(0, at - before)]
        return [self.langs[i] for i in window.argmax(axis=1)]

    def best(self, text: str) -> tuple[str | None, float]:
        """Language and its confidence (posterior under equal priors); None for text without words."""
        e = self.evidence(text)
        if not e.any():
            return None, 0.0
        p = np.exp(e - e.max())
        return self.langs[int(e.argmax())], float(1.0 / p.sum())


def _tally(rows: list[tuple[str, str]]) -> pd.DataFrame:
    seen: Counter = Counter()
    for lang, text in rows:
        seen.update((lang, w) for w in words(_HEADING.sub(" ", text)))
    out: Counter = Counter()
    for (lang, w), n in seen.items():
        out[(lang, "w", w)] += n
        for size in range(1, LONGEST + 1):
            for g in grams(w, size):
                out[(lang, str(size), g)] += n
    return pd.DataFrame([(*k, v) for k, v in out.items()], columns=["lang", "level", "gram", "n"])


def _merge(table: pd.DataFrame) -> pd.DataFrame:
    """Gives a label the words of which are those of a more frequent label to that label: it is a mistake, no language."""
    w = table[table.level == "w"].pivot_table(index="gram", columns="lang", values="n", aggfunc="sum", fill_value=0)
    by_size = list(w.sum().sort_values(ascending=False).index)
    share = w / w.sum()
    into: dict = {}
    for i, small in enumerate(by_size):
        for big in by_size[:i]:
            if big not in into and float(np.minimum(share[small], share[big]).sum()) > 0.5:
                into[small] = big
                break
    return table.assign(lang=table["lang"].replace(into)).groupby(["lang", "level", "gram"], as_index=False)["n"].sum()


def _fit(sample: DataFrame, model: tuple | None) -> tuple[list[str], dict]:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value and LanguageModel(*shared.value)
        for b in batches:
            rows = []
            for lang, text in zip(b["lang"], b["text"]):
                if known is not None:
                    got, sure = known.best(text)
                    if got is None or sure < 0.9:
                        continue
                    lang = got
                rows.append((lang, text))
            yield _tally(rows)

    table = sample.mapInPandas(count, "lang string, level string, gram string, n long").groupBy("lang", "level", "gram").agg(F.sum("n").alias("n")).filter("n > 1").toPandas()
    table = _merge(table)
    total = table[table.level == "w"].groupby("lang")["n"].sum()
    langs = sorted(total[total >= 0.002 * total.sum()].index) or ["en"]  # a label hardly ever right is no language of the corpus
    counts: dict = {level: {} for level in ("w", *map(str, range(1, LONGEST + 1)))}
    for lang, level, gram, n in table.itertuples(index=False):
        if lang in langs:
            counts[level].setdefault(gram, [0.0] * len(langs))[langs.index(lang)] = float(n)
    return langs, counts


def learn_languages(pages: DataFrame, text: str = "text", label: str = "lang") -> tuple[list[str], dict]:
    """Arguments of a :class:`LanguageModel`; at most SAMPLE_PAGES pages per declared language are read for it."""
    named = pages.select(F.col(text).alias("text"), declared(F.col(label)).alias("lang")).filter("lang is not null and length(text) > 80")
    rates = {r["lang"]: min(1.0, SAMPLE_PAGES / r["n"]) for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per code
    if not rates:
        return ["en"], {level: {} for level in ("w", *map(str, range(1, LONGEST + 1)))}
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col("lang"))
    drawn = cut(named.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < rate * 1_000_000))
    return _fit(drawn, _fit(drawn, None))


def page_language(pages: DataFrame, model: tuple, text: str = "text") -> Column:
    """Column with the page's main language; null where there are no words."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def best(cols: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = LanguageModel(*shared.value)
        for col in cols:
            yield pd.Series([known.best(_HEADING.sub(" ", t))[0] if t is not None else None for t in col], dtype=object)

    return F.pandas_udf(best, "string")(F.col(text))


def segments(sentences: list[str], model: LanguageModel) -> list[tuple[str, float, int, int]]:
    """(language, confidence, first, last sentence) of runs in one language.

    Sentences with little evidence follow the one before, or the first sure one after.
    """
    scores = [model.evidence(s) for s in sentences]
    own: list[int | None] = []
    for e in scores:
        top = np.sort(e)[::-1]
        own.append(int(e.argmax()) if e.any() and (len(top) < 2 or top[0] - top[1] > 2.0) else None)
    for i in range(1, len(own)):
        own[i] = own[i - 1] if own[i] is None else own[i]
    for i in range(len(own) - 2, -1, -1):
        own[i] = own[i + 1] if own[i] is None else own[i]
    out, i = [], 0
    while i < len(own):
        j = i
        while j + 1 < len(own) and own[j + 1] == own[i]:
            j += 1
        if own[i] is not None:
            e = np.sum(scores[i : j + 1], axis=0)
            out.append((model.langs[own[i]], float(1.0 / np.exp(np.minimum(e - e[own[i]], 50.0)).sum()), i, j))
        i = j + 1
    return out
