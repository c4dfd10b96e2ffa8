"""Problem 2: statistics of page text, and from them the kind of each page.

Per page the statistics named in ``STATS``; from these, ``FEATURES`` on which a
Gaussian mixture is fitted by expectation-maximization.  Line forms (entries,
rows, repeats, unreadable words) enter as soft scores, and sentence ends count
only on lines that are no entries.  Each round is one Spark pass: tasks compute
partial sums, Spark adds them, and COMPONENTS * (1 + 2 * len(FEATURES)) numbers
come to the driver.  The first centres are the mean and the farthest of all
rows.  Components get their kind from inspected examples; the kind of a page is
that of its component.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import cut

COMPONENTS, ROUNDS = 14, 12
#: Least variance of a component, in variances of all rows.
FLOOR = 0.02
STATS = ("words", "word_length", "symbols", "digits", "ends", "common", "entries", "rows", "repeats", "letters", "line_length", "odd_words", "chunks", "phrase", "hexes", "mixed", "misread", "top_line", "lines")
FEATURES = ("entries", "rows", "repeats", "unreadable", "ends", "common", "letters", "digits", "symbols", "odd_words", "line_length", "word_length")
_UNSPACED = "一-鿿㐀-䶿぀-ヿ฀-๿"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W\d_{_UNSPACED}]+[ऀ-ॿ]*")
_LETTERS = re.compile("(?:[^\\W\\d_]|[\u0900-\u0e7f])+")  # vowel signs of Indic scripts and Thai are no symbols
_DIGITS = re.compile(r"\d+")
_ENDS = tuple(".!?…。！？।:")
_ENTRY = re.compile(
    r"^\s*(?:[-*•+–·▪◦‣►»]\s+\S|\(?\d{1,3}[.):]\s|\(?[a-zA-Zа-яА-Я][.)]\s|\[[ xX✓✗]?\]\s|[│|`]*\s*[├└+|`][─\-]+|[0-9a-fA-F]{8,64}\s+\*?\S+$|[\w.\-]+(?: [\w.\-]+){0,3}\s*[=:：]\s*\S|\S+\.\w{2,4}(?:\s+\(?\d[\d.,]*\s*\w*\)?)?$|\S+/$|\S.{0,60} / \S.{0,60}[^.!?。！？।]$)"
)
_VOWELS = re.compile("[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýąęóаеёиоуыэюяіїє]", re.I)
_CLUSTER = re.compile("[^aeiouyàâäéèêëîïôöûüóáíúąęаеёиоуыэюя]{5,}")
_HEX = re.compile(r"(?:[0-9a-fA-F]{2}|[0-9a-fA-F]{4}|[0-9a-fA-F]{8,}:?)$")
_MIXED = re.compile(r"\w[^\w\s.,'’\-/@:]+\w|[a-z][A-Z0-9]+[a-z]")
_MISREAD = re.compile("[\x80-\u024f\u2010-\u2122]+")  # another script read with a Western page


def body_lines(text: str) -> list[str]:
    """Lines with content, without ``## path`` headings."""
    return [x for x in text.split("\n") if x.strip() and not x.startswith("## ")]


def _columns(line: str) -> tuple[str, int]:
    """Separator and number of cells of a line, if it has three or more."""
    bare = line.strip()
    for sep, parts in (("|", bare.strip("|").split("|")), ("\t", line.split("\t")), (";", bare.split(";")), (",", bare.split(",")), ("  ", re.split(r" {2,}", bare))):
        if len(parts) >= 3 and (sep != "," and sep != ";" or all(len(p.split()) <= 3 and not p.startswith(" ") for p in parts)):
            return sep, len(parts)
    return "", 0


@functools.lru_cache(1 << 17)
def _word_form(word: str) -> int:
    """1 for a longer word of the Latin alphabet, 2 if it reads like random letters, else 0."""
    if len(word) <= 3 or word[0] >= "\u0250" or not word.isalpha():
        return 0
    return 2 if not _VOWELS.search(word) or _CLUSTER.search(word) or len(word) > 24 else 1


@functools.lru_cache(1 << 17)
def _chunk_form(chunk: str) -> int:
    """1 for hexadecimal digits, 2 for letters and signs mixed up, 3 for both, else 0."""
    return bool(_HEX.match(chunk)) + 2 * (max(chunk) < "\u0250" and bool(_MIXED.search(chunk)))


def phrase_share(words: list[str]) -> float:
    """Share of the most frequent three words in a row; 0 for short texts."""
    return max(Counter(zip(words, words[1:], words[2:])).values()) / len(words) if len(words) >= 24 else 0.0


def row_share(lines: list[str]) -> float:
    """Share of lines that are rows of the most frequent shape of three or more columns."""
    shapes = Counter(s for s in map(_columns, lines) if s[1] >= 3)
    wide = sum(n for (sep, _), n in shapes.items() if sep == "  ")  # aligned by spaces, empty cells merge columns
    return max([wide, *shapes.values()], default=0) / max(1, len(lines))


def statistics(text: str | None, common: set[str]) -> list[float]:
    """The STATS of one text; zeros for a text without lines."""
    lines = body_lines(text or "")
    if not lines:
        return [0.0] * len(STATS)
    whole, n = "\n".join(lines), len(lines)
    chunks, words = whole.split(), _WORD.findall(whole.lower())
    solid = max(1, sum(map(len, chunks)))
    letters, digits = sum(map(len, _LETTERS.findall(whole))), sum(map(len, _DIGITS.findall(whole)))
    forms, looks = Counter(map(_word_form, words)), Counter(map(_chunk_form, chunks))
    misread = "".join(_MISREAD.findall(whole)) if not whole.isascii() else ""
    return [
        math.log1p(len(words)), sum(map(len, words)) / max(1, len(words)), max(0, solid - letters - digits) / solid, digits / solid,
        sum(x.rstrip("\"'”»’)」』 ").endswith(_ENDS) for x in lines) / n, sum(map(common.__contains__, words)) / max(1, len(words)),
        sum(map(bool, map(_ENTRY.match, lines))) / n, row_share(lines), 1 - len({x.strip() for x in lines}) / n, letters / solid, math.log1p(len(whole) / n),
        forms[2] / max(1, forms[1] + forms[2]), sum(len(c) for c in chunks if len(c) > 40 and c.isascii()) / max(1, len(whole)), phrase_share(words),
        (looks[1] + looks[3]) / max(1, len(chunks)), (looks[2] + looks[3]) / max(1, len(chunks)),
        max(len(misread) / solid if len(set(misread)) >= 12 else 0.0, 4 * whole.count("\ufffd") / solid), max(Counter(x.strip() for x in lines).values()) / n if n > 3 else 0.0, float(n),
    ]


def features(stats: np.ndarray) -> np.ndarray:
    """FEATURES (columns) from rows of STATS; shares become soft scores around the point where a form is that of most lines."""
    s = dict(zip(STATS, stats.T))

    def ramp(x: np.ndarray, low: float, high: float) -> np.ndarray:
        return np.clip((x - low) / (high - low), 0, 1)

    entries = ramp(s["entries"] * np.clip((s["lines"] - 1.5) / 2, 0, 1), 0.35, 0.6)
    legible = 1 - ramp(s["misread"], 0.25, 0.4)  # misread prose stays prose
    strange = ramp(-s["common"], -0.09, -0.03)  # hardly any common words
    unreadable = np.maximum.reduce([ramp(s["hexes"], 0.4, 0.7), ramp(-s["letters"], -0.55, -0.45) * ramp(-s["digits"], -0.5, -0.4), ramp(s["odd_words"], 0.15, 0.3) * strange, ramp(s["mixed"], 0.25, 0.45) * strange])
    repeats = np.maximum.reduce([ramp(s["top_line"], 0.45, 0.65), ramp(s["phrase"], 0.14, 0.2), ramp(s["chunks"], 0.35, 0.6) * (1 - ramp(s["rows"], 0.6, 0.8))])
    rows = ramp(s["rows"], 0.35, 0.6) * (1 - ramp(s["odd_words"], 0.25, 0.45))  # cells hold words or numbers
    return np.column_stack([
        entries, rows, repeats * legible, unreadable * legible, s["ends"] * (1 - entries), np.clip(s["common"], 0, 0.4), s["letters"], s["digits"], s["symbols"],
        s["odd_words"], s["line_length"], np.clip(s["word_length"], 0, 12),
    ])


#: Inspected examples, written for this purpose: what pages of each kind look like.
EXAMPLES = {
    "prose": (
        "The first chapter tells how the small tool came to be. It was written in a week, and nobody thought that it would last.\nYears later it is still in use, and the authors are glad of every letter they get.",
        "Das Programm liest zuerst die Liste und schreibt danach das Ergebnis. Wer es nicht braucht, kann diese Seite überspringen.",
        "Le programme lit la liste et écrit le résultat dans un fichier. Ceux qui ne s’en servent pas peuvent passer cette page.",
        "这个程序先读取列表，然后把结果写入文件。不需要的人可以跳过这一页。",
        "Программа сначала читает список, а потом пишет результат в файл. Кому это не нужно, тот может пропустить страницу.",
        "この道具は先に一覧を読み、その後で結果を書きます。必要のない人はこのページを飛ばせます。",
    ),
    "list": (
        "- the red box\n- the blue box\n- a short rope\n- two lamps\n- the map", "1. open the box\n2. take the map\n3. close the box\n4. go home", "• das Buch: liste.txt (12 KB)\n• das Heft: notiz.md (30 KB)\n• die Karte: karte.png (99 KB)",
        "name = box\nsize = 12\ncolor = red\nfile: map.txt\nlevel: 3", "[x] the map 1.2\n[ ] the rope 0.4\n[x] the lamp 2.0", "├── src/\n│   ├── main.py\n│   └── util.py\n└── readme.md", "0a1b2c3d4e5f6071  src/main.py\n1b2c3d4e5f60718a  src/util.py",
        "- The tool reads the list first.\n- Nobody needs the old map.\n- We tested the lamp on ten roads.", "a) la caja\nb) el mapa\nc) la cuerda\nd) la lista",
    ),
    "table": (
        "| name | size | date |\n| --- | --- | --- |\n| box | 12 | 2020-01-02 |\n| map | 7 | 2021-05-09 |", "name,size,date\nbox,12.4,2020-01-02\nmap,7.1,2021-05-09\nrope,3.0,2019-11-30", "name\tsize\tcolor\nbox\t12\tred\nmap\t7\tblue",
        "name   size  date\nbox      12  2020-01-02\nmap       7  2021-05-09\nrope      3  2019-11-30", "box;12;red;yes\nmap;7;blue;no\nrope;3;green;yes",
    ),
    "junk": (
        "k3JhdVQ9x0LmZp2+Rt7/wq8YbN1sD4vG5hE6uCjXoKiT\nZzA0mB9nQ8wE7rT6yU5iO4pL3kJ2hG1fD+/sAxCvBn", "3f a9 00 1c 7e 52 bb 04 c8 9d 6a f1 20 37 e5\n88 1b d4 90 2f 6c a3 0e 57 b9 cc 41 fa 13 76",
        "█▓▒░║═╗╔╝╚▄▀ ▌▐█▓\n░▒▓█╗╔═║▐▌▀▄ ╚╝░", "xq vzkrt pfl mwqzx bnrtk\ngkq pqwfs hdfkbrw zzxv tlmn", "]O{}[] sOnI |0I]|t[lk~ 1lt{~}[}~ en]m$n$~", "??? ??? ???\n??? ??? ???\n??? ??? ???\n??? ??? ???", "%#@: *##~+^ *<~*%\n&=*@=|^= >/+:==<##-",
        "please wait here\n" * 12, "to be or not " * 30,
    ),
}


class Mixture:
    """Gaussian mixture with diagonal covariances on standardized features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, center: np.ndarray, var: np.ndarray):
        self.mean, self.scale, self.weight, self.center, self.var = mean, scale, weight, center, var

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        d = ((z[:, None, :] - self.center[None]) ** 2 / self.var[None]).sum(2)
        logs = np.log(self.weight)[None] - 0.5 * (d + np.log(self.var).sum(1)[None])
        p = np.exp(logs - logs.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def args(self) -> tuple:
        return self.mean, self.scale, self.weight, self.center, self.var


def _blocks(batches: Iterator[pd.DataFrame], column: str) -> Iterator[np.ndarray]:
    return (np.stack(b[column].to_numpy()) for b in batches if len(b))


def fit_mixture(rows: DataFrame, column: str = "features") -> Mixture:
    """EM over all rows; sums of the tasks are added in Spark.

    The first centres are the mean of all rows and, one after the other, the row farthest from those before: a pass
    each, damped against outliers.
    """
    dims = len(FEATURES)
    m = rows.agg(*[F.avg(F.col(column)[i]).alias(f"m{i}") for i in range(dims)], *[F.stddev(F.col(column)[i]).alias(f"s{i}") for i in range(dims)]).first()
    mean = np.array([m[f"m{i}"] or 0.0 for i in range(dims)])
    scale = np.array([m[f"s{i}"] if m[f"s{i}"] and m[f"s{i}"] > 1e-9 and not math.isnan(m[f"s{i}"]) else 1.0 for i in range(dims)])
    centers = [np.zeros(dims)]
    for _ in range(COMPONENTS - 1):

        def farthest(batches: Iterator[pd.DataFrame], known: tuple = tuple(centers)) -> Iterator[pd.DataFrame]:
            best = None
            for x in _blocks(batches, column):
                z = (x - mean) / scale
                far = np.min([np.clip((z - c) ** 2, 0, 9).sum(1) for c in known], axis=0)
                best = max([(far.max(), tuple(r)) for r in z[far == far.max()]] + ([best] if best else []))
            if best:
                yield pd.DataFrame({"far": [best[0]], "row": [list(best[1])]})

        top = rows.select(column).mapInPandas(farthest, "far double, row array<double>").agg(F.max(F.struct("far", "row")).alias("top")).first()["top"]
        centers.append(np.array(top["row"]) if top else np.zeros(dims))
    model = Mixture(mean, scale, np.full(COMPONENTS, 1 / COMPONENTS), np.array(centers), np.ones((COMPONENTS, dims)))
    for _ in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast(model.args())

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now = Mixture(*shared.value)
            total = np.zeros((COMPONENTS, 1 + 2 * dims))
            for x in _blocks(batches, column):
                p, z = now.posterior(x), (x - now.mean) / now.scale
                total += np.hstack([p.sum(0)[:, None], p.T @ z, p.T @ z**2])
            yield pd.DataFrame({"at": np.arange(total.size), "sum": total.ravel()})

        total = np.zeros(COMPONENTS * (1 + 2 * dims))
        for r in rows.select(column).mapInPandas(sums, "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect():
            total[r["at"]] = r["sum"]
        total = total.reshape(COMPONENTS, 1 + 2 * dims)
        n = total[:, 0] + 1e-6
        center = total[:, 1 : 1 + dims] / n[:, None]
        model = Mixture(mean, scale, n / n.sum(), center, np.maximum(total[:, 1 + dims :] / n[:, None] - center**2, FLOOR))
    return model


def component_kinds(model: Mixture, common: set[str]) -> list[str]:
    """Kind of each component: that of the nearest inspected example."""
    kinds = [k for k, texts in EXAMPLES.items() for _ in texts]
    z = (features(np.array([statistics(t, common) for texts in EXAMPLES.values() for t in texts])) - model.mean) / model.scale
    return [kinds[int(np.clip((z - c) ** 2 / (v + 0.5), 0, 16).sum(1).argmin())] for c, v in zip(model.center, model.var)]


def classify_pages(pages: DataFrame, common_words: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, stats, component, prose_share, page_kind) of every page; ``page_kind`` is the kind of its component.

    Null and empty pages have zero statistics and count as junk.  ``common_words`` is a small fixed table (column
    ``word``); its nulls are ignored.  Repeated rows are classified each for itself.
    """
    common = {r["word"].lower() for r in common_words.select("word").distinct().collect() if r["word"]}
    words = pages.sparkSession.sparkContext.broadcast(common)

    def measure(cols: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for col in cols:
            stats = np.array([statistics(t, words.value) for t in col]).reshape(len(col), len(STATS))
            yield pd.DataFrame({"stats": list(stats), "features": list(features(stats))})

    measured = pages.select(F.col(key).alias("k"), F.pandas_udf(measure, "stats array<double>, features array<double>")(F.col(text)).alias("m"))
    rows = cut(measured.select("k", "m.stats", "m.features"))
    model = fit_mixture(rows)
    shared = pages.sparkSession.sparkContext.broadcast((model.args(), component_kinds(model, common)))

    def kind(cols: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        args, names = shared.value
        now, prose = Mixture(*args), np.array([n == "prose" for n in names])
        for col in cols:
            p = now.posterior(np.stack(col.to_numpy())) if len(col) else np.zeros((0, COMPONENTS))
            best = p.argmax(1)
            yield pd.DataFrame({"component": best.astype(np.int32), "prose_share": p[:, prose].sum(1), "page_kind": [names[b] for b in best]})

    got = F.pandas_udf(kind, "component int, prose_share double, page_kind string")("features")
    empty = F.col("stats")[STATS.index("lines")] == 0
    return rows.withColumn("g", got).select(F.col("k").alias(key), "stats", "g.component", "g.prose_share", F.when(empty, F.lit("junk")).otherwise(F.col("g.page_kind")).alias("page_kind"))


def content_pages(pages: DataFrame, run: str = "run_id", number: str = "page_no") -> DataFrame:
    """Pages that are neither first nor last of their run; the last is found by a grouped maximum, no window."""
    last = pages.groupBy(F.col(run).alias("__run")).agg(F.max(number).alias("__last"))
    inner = pages.join(last, F.col(run).eqNullSafe(F.col("__run"))).filter((F.col(number) > 1) & (F.col(number) < F.col("__last")))
    return inner.select(*pages.columns)


def find_kinds(pages: DataFrame, common_words: DataFrame) -> DataFrame:
    """(page_id, page_kind) of the content pages that aren't prose."""
    found = classify_pages(content_pages(pages), common_words)
    return found.filter("page_kind <> 'prose'").select("page_id", "page_kind").distinct()
