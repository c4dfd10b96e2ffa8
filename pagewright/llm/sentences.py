"""Problem 6: sentence boundaries across languages and scripts.

Unsupervised, per language: Spark counts over the whole corpus how often each
word type comes with a period, what follows it and what starts sentences.
Log-likelihood ratios pick abbreviations, sentence starters and ordinal
collocations; each period is then classified from them.  Scripts with marks of
their own (ideographic full stop, danda) and spaces between Thai letters need
no statistics.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut
from .langid import LanguageModel, declared, segments

#: A type must have this share of its language's periods (starts, collocations), so at most its inverse can be kept
#: per language and kind: the proven bound of the broadcast model, the same at every corpus size.
LEAST_SHARE = 1 / 20_000
OPENERS = "\"'“„«‘‚「『（(【[¿¡‹"
CLOSERS = "\"'”“»’」』）)】]›"
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", '"': '"', "‘": "’"}
_TOKEN = re.compile(r"\S+")
#: What goes on behind a mark inside a word: 3.5, z.B., notes.txt; ideographs and kana don't.
_ON = r"(?!(?![぀-ヿ一-鿿])[\w./\\\-@&=,;:])"
_END = re.compile(rf"\.{{2,}}+[!?]*+{_ON}|…+[!?！？]*|[.!?]++{_ON}|[。！？]+|।+|(?<=[฀-๿])[ \t\r\n]+(?=[฀-๿])")
_OPENING = re.compile(f"[{''.join(PAIRS)}]")
_CLOSING = re.compile(rf"[ \xa0{re.escape(CLOSERS)}]*")
_NEXT = re.compile(r"\s*(\S+)")
_SIX = re.compile(r"\W*(?:\w\W*){6}")  # six letters
_MARK = re.compile("(?<=[。！？।…])(?=[^。！？।…])")
#: A mark that ends a token, as sentences need it (see :func:`_split_block`), or a Thai letter, which a space may follow.
_ENDING = re.compile(r"[.!?…](?![\w.!?…_/\\\-@&=,;:])|[.!?…](?=[\u3040-\u30ff\u4e00-\u9fff])|[。！？।\u0e00-\u0e7f]")
_DOUBT = 1.9  # a little less than what decides, as tokens may be cut differently
_THAI_SPACE = re.compile(r"[ \t\r\n]+")
_BLANK = re.compile(r"\n[ \t\r\f\v]*\n\s*")
_BREAK = "\x00"  # stands between blocks of tokens
_PAGE = "\x01"  # stands before each page
_PARTS = re.compile(rf"{_BREAK}|{_PAGE}|^##\s.*$|{_BLANK.pattern}", re.M)
_NOISE = set("[]{}|~$<>^=*#@\\§°¬")  # a few may stand in a sentence, many make it corrupted text
_UNSPACED = re.compile("[一-鿿㐀-䶿぀-ヿ฀-๿]")
_HIRAGANA = re.compile("[぀-ゟ]")


def _core(token: str) -> str:
    return token.strip(OPENERS + CLOSERS + ",;:—–")


def _type(core: str) -> str:
    """Word type before a period; numbers are one type, single letters keep their case (initials)."""
    if core.isdecimal():
        return "##"
    if not core.isalpha() and any(map(str.isdigit, core)):
        return "#.#"
    return core if len(core) == 1 else core.lower()


def _follow(token: str) -> str:
    """What stands after a period: lower, digit, initial, or upper (also scripts without case)."""
    core = token.lstrip(OPENERS + "—–-")
    if not core:
        return "lower" if token[:1] in ",;:—–-" else "upper"
    if re.match(r"[^\W\d_]\.", core) and core[0].isupper():
        return "initial"
    if core[0].isdigit():
        return "digit"
    return "lower" if core[0].islower() or core[0] in ",;:)" else "upper"


def _counted(t: str) -> str:
    """The type itself; empty for long runs of scripts without spaces, which are whole clauses and no words."""
    return "" if len(t) > 12 and _UNSPACED.search(t) else t


@functools.lru_cache(1 << 17)
def _features(tok: str) -> tuple[str, str, str, str]:
    """(dot, mark or plain; type before a period; what it is after one; type as a start) of a token."""
    if tok.isalpha():
        t = _counted(_type(tok))
        return "plain", t, "lower" if tok[0].islower() else "upper", t
    bare = tok.rstrip(CLOSERS)
    if bare.endswith(".") and not bare.endswith(".."):
        kind, t = "dot", _type(_core(bare[:-1]))
    else:
        kind, t = "mark" if bare[-1:] in ("!", "?") else "plain", _type(_core(bare))
    return kind, _counted(t), _follow(tok), _counted(_type(_core(tok).rstrip(".")))


class _Counts:
    """Counts of one task: tokens become numbers of types, whose features are looked up once and applied as arrays.

    The numbering starts anew when it holds ``MOST`` types; what was counted so far is handed out then.
    """

    MOST = 300_000
    PLAIN, DOT, MARK, BREAK = range(4)
    KINDS = ("plain", "dot", "after", "start")

    def __init__(self, known: LanguageModel):
        self.known = known
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {_BREAK: 0, _PAGE: 1}
        self.names: dict[str, int] = {"": 0}
        self.types = np.array([[self.BREAK, 0, 0, 0, 0, 0, 1]] * 2)
        self.scores = np.zeros((2, len(self.known.langs)))
        self.keys: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []

    def name(self, word: str) -> int:
        return self.names.setdefault(word, len(self.names))

    def features(self, tok: str) -> tuple[int, ...]:
        kind, before, follow, start = _features(tok)
        upper = follow == "upper"
        code = self.PLAIN if kind == "plain" else self.DOT if kind == "dot" else self.MARK
        return code, self.name(before), self.name(start if upper else follow), self.name(start), upper, not tok.strip(CLOSERS), bool(_ENDING.search(tok))

    def add(self, toks: list[str], labels: list[str | None] | None = None) -> np.ndarray:
        """Counts a run of tokens; ``_PAGE`` stands before each page, ``_BREAK`` between blocks and at the end.

        With the pages' ``labels``: whether each is in doubt, see :meth:`doubts`.
        """
        if new := list(set(toks).difference(self.index)):
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.types = np.vstack([self.types, np.array([self.features(t) for t in new])])
            self.scores = np.vstack([self.scores, self.known.token_scores(new)])
        ids = np.fromiter(map(self.index.__getitem__, toks), dtype=np.int64, count=len(toks))
        kind, before, after, start, upper, closing, ending = self.types[ids].T
        upper, closing = upper > 0, closing > 0
        n, at = len(ids), np.arange(len(ids))
        breaks = np.flatnonzero(kind == self.BREAK)
        block = np.searchsorted(breaks, at, side="right")  # number of the block's end among the breaks
        low, high = breaks[block - 1] + 1, breaks[np.minimum(block, len(breaks) - 1)]
        scores = self.scores[ids]
        sums = np.vstack([np.zeros(len(self.known.langs)), np.cumsum(scores, axis=0)])
        lang = (sums[np.minimum(high, at + 4)] - sums[np.maximum(low, at - 10)]).argmax(axis=1)  # as LanguageModel.around
        word = np.where(closing, n - 1, at)  # French sets a space before its closing quotes
        nxt = np.append(np.minimum.accumulate(word[::-1])[::-1][1:], n - 1)
        ends = (kind == self.DOT) | (kind == self.MARK)
        follows = ends & (nxt < high)
        first = np.minimum(breaks[:-1] + 1, n - 1)
        first = first[kind[first] != self.BREAK]
        self._keep(lang, 0, before, 0, ((kind == self.PLAIN) | (kind == self.MARK)) & (before > 0))
        self._keep(lang, 1, before, 0, (kind == self.DOT) & (before > 0))
        self._keep(lang, 2, before, after[nxt], (kind == self.DOT) & (before > 0) & follows)
        self._keep(lang[nxt], 3, start[nxt], 0, (kind == self.MARK) & follows & upper[nxt] & (start[nxt] > 0))
        self._keep(lang[first], 3, start[first], 0, upper[first] & (start[first] > 0))
        return np.zeros(0, dtype=bool) if labels is None else self.doubts(sums[1:], np.flatnonzero(ids == 1), ending > 0, labels)

    def doubts(self, sums: np.ndarray, first: np.ndarray, ending: np.ndarray, labels: list[str | None]) -> np.ndarray:
        """Whether each page may hold sentences of another language than its label names.

        A sentence goes to another language than the page's best if its words speak for that one by more than 2; then
        the running difference of the two languages' scores rises by as much between two places where sentences may
        end.  Pages without words of any language, or without marks that may end two sentences, are in no doubt.
        """
        last = np.append(first[1:], len(sums) - 1)  # where each page ends: before the next one, at the last break
        total = sums[last] - sums[first]
        best = total.argmax(axis=1)
        page = np.searchsorted(first, np.arange(len(sums)), side="right") - 1
        ends = ending | (np.append(page[1:], -1) != page)
        page, lead = page[ends], (sums - sums[np.arange(len(sums)), best[page]][:, None])[ends]
        begin = np.flatnonzero(np.append(True, page[1:] != page[:-1]))  # the page marks, where the lead is 0
        lead = lead - lead[begin][page]
        drop = (page * (4.0 * np.abs(lead).max(initial=1.0)))[:, None]  # each page lower than all before: its minimum starts anew
        sentences = np.add.reduceat(ending.astype(np.int64), first)
        rise = np.maximum.reduceat((lead - (np.minimum.accumulate(lead - drop, axis=0) + drop)).max(axis=1), begin)
        named = np.array([self.known.langs.index(x) if x in self.known.langs else -1 for x in labels])
        return total.any(axis=1) & (sentences > 1) & ((rise > _DOUBT) | (named != best))

    def _keep(self, lang: np.ndarray, kind: int, a: np.ndarray, b: np.ndarray | int, which: np.ndarray) -> None:
        key = ((lang * 4 + kind) << 52) + (a << 26) + b
        keys, n = np.unique(key[which], return_counts=True)
        self.keys.append(keys)
        self.numbers.append(n)

    def result(self) -> pd.DataFrame:
        """(lang, kind, a, b, n) of all that was added; starts anew."""
        keys, where = np.unique(np.concatenate([np.zeros(0, np.int64), *self.keys]), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([np.zeros(0), *self.numbers]), minlength=len(keys)).astype(np.int64)
        names, langs, kinds = np.array(list(self.names), dtype=object), np.array(self.known.langs, dtype=object), np.array(self.KINDS, dtype=object)
        code, part = keys >> 52, (1 << 26) - 1
        out = pd.DataFrame({"lang": langs[code // 4], "kind": kinds[code % 4], "a": names[(keys >> 26) & part], "b": names[keys & part], "n": n})
        self.reset()
        return out


def _survey(rows: Iterator[tuple], known: LanguageModel, doubtful: bool) -> Iterator[pd.DataFrame]:
    """Partial counts of one task, (lang, kind, a, b, n); the language is that of the words around.

    ``rows`` are (key, label, text).  With ``doubtful`` there are also rows of kind ``page``, with key, label and text,
    for each page that may hold sentences of another language than its label names.
    """
    counts, waiting, size = _Counts(known), [], 0

    def add() -> list[tuple]:
        found = counts.add([*" ".join(f"{_PAGE} {_PARTS.sub(f' {_BREAK} ', _MARK.sub(' ', t))}" for _, _, t in waiting).split(), _BREAK], [x[1] for x in waiting] if doubtful else None)
        out = [(*x, "page") for x, doubt in zip(waiting, found) if doubt]
        waiting.clear()
        return out

    for row in rows:
        waiting.append(row)
        size += len(row[2])
        if size > 1 << 19:
            if out := add():
                yield pd.DataFrame(out, columns=["k", "l", "t", "kind"])
            size = 0
            if len(counts.index) > counts.MOST:
                yield counts.result()  # which starts anew
    if waiting and (out := add()):
        yield pd.DataFrame(out, columns=["k", "l", "t", "kind"])
    yield counts.result()


def _observe(texts: Iterator[str], known: LanguageModel) -> pd.DataFrame:
    return pd.concat(_survey(((None, None, t) for t in texts), known, False))


def _llr(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's log-likelihood ratio that two shares k1/n1 and k2/n2 differ."""

    def ll(k: Column, n: Column, p: Column) -> Column:
        q = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
        return k * F.log(q) + (n - k) * F.log(1 - q)

    both = (k1 + k2) / (n1 + n2)
    return 2 * (ll(k1, n1, k1 / n1) + ll(k2, n2, k2 / n2) - ll(k1, n1, both) - ll(k2, n2, both))


def survey(pages: DataFrame, languages: tuple, text: str = "text", key: str | None = None, label: str | None = None) -> DataFrame:
    """One pass over all pages, written as a table: counts around periods, rows of :func:`_survey`; with ``key`` and ``label`` also the pages in doubt."""
    shared = pages.sparkSession.sparkContext.broadcast(languages)
    cols = ["lang", "kind", "a", "b", "n", "k", "l", "t"]

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (x for b in batches for x in zip(b["k"], b["l"], b["t"]) if x[2] is not None)
        for out in _survey(rows, LanguageModel(*shared.value), key is not None):
            yield pd.DataFrame({c: out[c].to_numpy() if c in out else np.full(len(out), None) for c in cols}, dtype=object)

    kind = pages.schema[key].dataType.simpleString() if key else "string"
    null = F.lit(None).cast("string")
    named = pages.select((F.col(key) if key else null).alias("k"), (declared(F.col(label)) if label else null).alias("l"), F.col(text).alias("t"))
    return cut(named.mapInPandas(observe, f"lang string, kind string, a string, b string, n long, k {kind}, l string, t string"))


def learn_periods(pages: DataFrame, languages: tuple, text: str = "text") -> dict[tuple[str, str], str]:
    """{(language, type): kind}; see :func:`fit_periods`."""
    return fit_periods(survey(pages, languages, text))


def fit_periods(seen: DataFrame) -> dict[tuple[str, str], str]:
    """{(language, type): kind} from the counts of a survey; kinds are ``start`` (sentence starter), ``title``
    (abbreviation that never ends a sentence before a capital), ``abbr`` (one that may) and ``ordinal`` (noun that
    follows ordinal numbers).

    Counts cover every text; only types above LEAST_SHARE come to the driver.
    """
    spark = seen.sparkSession
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    types = cut(seen.filter("kind in ('dot', 'plain', 'start')").groupBy("lang", "a").agg(n("dot").alias("dots"), n("plain").alias("plain"), n("start").alias("starts")))
    total = types.groupBy("lang").agg(F.sum("dots").alias("all_dots"), F.sum("plain").alias("all_plain"), F.sum("starts").alias("all_starts"))
    types = types.join(F.broadcast(total), "lang")  # one row per language of the model
    # sentence starters: more frequent at sure starts than elsewhere
    inner, all_plain = F.greatest(F.col("plain") - F.col("starts"), F.lit(0)), F.greatest(F.col("all_plain"), F.lit(1))
    s = types.filter((F.col("starts") >= F.col("all_starts") * LEAST_SHARE) & (F.col("starts") >= 3) & (F.col("starts") / F.col("all_starts") > inner / all_plain))
    s = s.filter(_llr(F.col("starts").cast("double"), F.col("all_starts").cast("double"), inner.cast("double"), all_plain.cast("double")) > 10)
    found = [(r["lang"], r["a"]) for r in s.select("lang", "a").collect()]  # at most 1 / LEAST_SHARE per language
    starters = F.broadcast(spark.createDataFrame([(*x, 1) for x in found], "lang string, b string, is_start int"))
    # abbreviations: bound to their period, and followed by what starts no sentence
    case = F.col("b").isin("lower", "digit", "initial")
    follow = seen.filter("kind = 'after'").join(starters, ["lang", "b"], "left").groupBy("lang", "a").agg(
        F.sum("n").alias("followed"), F.sum(F.when(~case & F.col("is_start").isNotNull(), F.col("n")).otherwise(0)).alias("before_start"),
        F.sum(F.when(~case | (F.col("b") == "initial"), F.col("n")).otherwise(0)).alias("before_upper"),
    )
    own = F.col("dots") + F.col("plain")
    rest_dots, rest = F.col("all_dots") - F.col("dots"), F.col("all_dots") + F.col("all_plain") - own
    bound = types.filter(~F.col("a").isin("##", "#.#") & (F.col("dots") >= 3) & (F.col("dots") >= F.col("all_dots") * LEAST_SHARE) & ((F.col("dots") / own > 0.8) | (F.length("a") == 1)))
    bound = bound.filter(_llr(F.col("dots").cast("double"), own.cast("double"), rest_dots.cast("double"), F.greatest(rest, F.lit(1)).cast("double")) > 8)
    d = bound.join(follow, ["lang", "a"], "left").na.fill(0)
    unlike_end = (F.col("followed") - F.col("before_start")) / F.greatest(F.col("followed"), F.lit(1))
    ends = (F.col("before_upper") > 0) & (F.col("before_start") / F.greatest(F.col("before_upper"), F.lit(1)) > 0.5)
    kinds = d.filter((unlike_end > 0.35) | (F.length("a") == 1)).select("lang", "a", F.when(ends, F.lit("abbr")).otherwise(F.lit("title")).alias("kind"))
    # nouns behind ordinal numbers: most of their occurrences follow a number with a period
    o = seen.filter("kind = 'after' and a = '##' and b not in ('', 'lower', 'digit', 'initial')").groupBy("lang", "b").agg(F.sum("n").alias("k")).filter("k >= 3")
    o = o.join(starters, ["lang", "b"], "left_anti").withColumnRenamed("b", "a").join(types.select("lang", "a", "dots", "plain"), ["lang", "a"], "left").na.fill(0).join(F.broadcast(total), "lang")
    o = o.filter((F.col("k") > 0.3 * (F.col("plain") + F.col("dots"))) & (F.col("k") >= F.col("all_dots") * LEAST_SHARE))
    kept = kinds.unionByName(o.select("lang", "a", F.lit("ordinal").alias("kind")))
    model: dict = {}
    for lang, word, kind in [*((*x, "start") for x in found), *kept.collect()]:
        model.setdefault((lang, word), set()).add(kind)
    return {k: " ".join(sorted(v)) for k, v in model.items()}


def _quotes(block: str) -> list[tuple[int, int]]:
    """Spans (opening mark, closing mark) of quotations that are closed within the block; each closing mark is looked for once."""
    spans, at = [], 0
    ends: dict[str, int] = {}  # next place of each closing mark
    while m := _OPENING.search(block, at):
        i, at = m.start(), m.end()
        c = block[i]
        if c in "\"‘" and i and block[i - 1].isalnum():
            continue
        for e in PAIRS[c]:
            if -1 < ends.get(e, 0) <= i:
                ends[e] = block.find(e, i + 1)
        if closed := [ends[e] for e in PAIRS[c] if ends[e] > i]:
            spans.append((i, min(closed)))
            at = min(closed) + 1
    return spans


def _has(places: list[int], place: int) -> bool:
    """Whether a sorted list holds a place."""
    i = bisect.bisect_left(places, place)
    return i < len(places) and places[i] == place


def _split_block(block: str, known: LanguageModel, model: dict) -> Iterator[tuple[int, int]]:
    """Spans of sentences in a text without blank lines and headings; each period is judged in the language around it."""
    langs: list[str] = []
    begins: list[int] = []
    lang = ""

    def has(word: str, kind: str) -> bool:
        return kind in model.get((lang, word), "").split()

    quotes, start = _quotes(block), 0
    opened = [q[0] for q in quotes]
    for m in _END.finditer(block):
        if m.start() < start:
            continue
        mark, end = m.group(), m.end()
        q = bisect.bisect_left(opened, m.start()) - 1
        inside = q >= 0 and m.start() < quotes[q][1]
        if _THAI_SPACE.fullmatch(mark):
            if not inside:
                yield start, m.start()
                start = end
            continue
        # closing marks belong to the sentence; French sets a space before them
        if inside:
            b = quotes[q][1]
            if _CLOSING.match(block, end, b).end() < b:
                continue
            end = b + 1
        while end < len(block) and block[end] in CLOSERS and not (block[end] in PAIRS and _has(opened, end)):
            end += 1
        if block[end : end + 1] and mark[0] in ".!?" and not block[end].isspace() and (block[end].isalnum() or block[end] in "._/\\-@&=,;:") and not ("一" <= block[end] <= "鿿" or "぀" <= block[end] <= "ヿ"):
            continue
        after = _NEXT.match(block, end)
        nxt = after.group(1) if after else ""
        if nxt and nxt[0] in "，、,;；:：—–":
            continue
        follow = _follow(nxt) if nxt else "upper"
        if mark[0] in "。！？।" or mark[0] == "…" and end < len(block) and not block[end].isspace():
            if inside and nxt and _HIRAGANA.match(nxt):
                continue
            if mark[0] == "…" and (not _SIX.match(block, start, m.start()) or nxt and follow == "lower"):
                continue
        elif nxt:
            if follow == "lower":
                continue
            if mark == ".":
                if not langs:
                    toks = list(_TOKEN.finditer(block))
                    langs, begins = known.around([t.group() for t in toks]), [t.start() for t in toks]
                lang = langs[max(0, bisect.bisect_right(begins, m.start()) - 1)]
                at = m.start()
                while at > start and not block[at - 1].isspace():
                    at -= 1
                word = _type(_core(block[at : m.start()]))
                nword = _type(_core(nxt).rstrip("."))
                starter = has(nword, "start")
                if word in ("##", "#.#"):
                    if follow == "upper" and has(nword, "ordinal") and not starter:
                        continue
                elif has(word, "title") or has(word, "abbr"):
                    if follow in ("digit", "initial") and not (follow == "initial" and has(word, "abbr") and not has(word, "title")):
                        continue
                    if not starter and not has(word, "abbr"):
                        continue
                elif len(word) == 1 and word.isalpha():
                    if not starter or word.isupper():
                        continue
                elif follow == "digit" and len(word) <= 4 and word.isalpha():
                    continue
            elif mark.startswith("..") and follow != "upper":
                continue
        yield start, end
        start = end
    yield start, len(block)


def split_page(text: str, known: LanguageModel, model: dict) -> list[tuple[int, int]]:
    """(start, end) of every sentence, from its first character to after its last."""
    out = []
    pieces, at = [], 0
    for m in re.finditer(r"^##[ \t].*$", text, re.M):  # a heading line is a unit
        pieces += [(at, m.start()), (m.start(), -m.end())]
        at = m.end()
    pieces.append((at, len(text)))
    for a, b in pieces:
        if b < 0:
            out.append((a, -b))
            continue
        edge = a
        for m in [*_BLANK.finditer(text, a, b), None]:
            stop = m.start() if m else b
            out += [(edge + x, edge + y) for x, y in _split_block(text[edge:stop], known, model)]
            edge = m.end() if m else b
    trimmed = []
    for a, b in out:
        piece = text[a:b]
        a, b = a + len(piece) - len(piece.lstrip()), b - (len(piece) - len(piece.rstrip()))
        if b > a:
            trimmed.append((a, b))
    return trimmed


def split_sentences(pages: DataFrame, languages: tuple, periods: dict, key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, start_pos, end_pos) of the sentences of all pages; offsets in code points.

    Null, empty and blank texts have no sentences; a text without any mark is one.  Repeated rows repeat theirs.
    """
    shared = pages.sparkSession.sparkContext.broadcast((languages, periods))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, model = LanguageModel(*shared.value[0]), shared.value[1]
        for b in batches:
            rows = [(k, *span) for k, t in zip(b["k"], b["t"]) if t is not None for span in split_page(t, known, model)]
            yield pd.DataFrame(rows, columns=["k", "start_pos", "end_pos"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(split, f"k {kind}, start_pos long, end_pos long").withColumnRenamed("k", key)


def find_languages(pages: DataFrame, languages: tuple, periods: dict, key: str = "page_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Segments of every page: (key, label_code, segment, lang, confidence, first, last, sentences, langs).

    Only units that end like sentences count; a run of one sentence between others of one language joins them, since
    a single foreign sentence makes no segment.  ``langs`` lists the languages with two sentences in a row.
    """
    return _languages(pages.select(F.col(key).alias("k"), declared(F.col(label)).alias("l"), F.col(text).alias("t")), languages, periods).withColumnRenamed("k", key)


def _languages(named: DataFrame, languages: tuple, periods: dict) -> DataFrame:
    """Segments of pages (k, l, t)."""
    shared = named.sparkSession.sparkContext.broadcast((languages, periods))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, model = LanguageModel(*shared.value[0]), shared.value[1]
        for b in batches:
            rows = []
            for k, t, l in zip(b["k"], b["t"], b["l"]):
                if t is None:
                    continue
                spans = split_page(t, known, model)
                full = [t[a:e] for a, e in spans if not t[a:e].startswith("## ") and is_sentence(t[a:e])]
                parts = segments(full, known)
                langs = sorted({p[0] for p in parts if p[3] > p[2]})
                rows += [(k, l, i, p[0], p[1], p[2], p[3], len(full), langs) for i, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["k", "label_code", "segment", "lang", "confidence", "first", "last", "sentences", "langs"])

    kind = named.schema["k"].dataType.simpleString()
    return named.mapInPandas(run, f"k {kind}, label_code string, segment long, lang string, confidence double, first long, last long, sentences long, langs array<string>")


def is_sentence(unit: str) -> bool:
    """Whether a unit is worded as a sentence: ends with a full stop, mark or Thai letter and holds letters enough."""
    letters = sum(c.isalpha() for c in unit)
    if letters < 8 or letters < 0.4 * len(unit) or sum(c in _NOISE for c in unit) > 0.05 * len(unit):
        return False
    bare = unit.rstrip(CLOSERS + " \xa0")
    return bare[-1:] in ".!?…。！？।" or "฀" <= bare[-1:] <= "๿"


def wrong_labels(pages: DataFrame, languages: tuple, periods: dict | None = None, key: str = "page_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(key, lang): languages of the pages whose label is missing or wrong, or that hold several languages.

    Without ``periods`` these are learned from the pages; the pass that counts for them scores every word of every
    page too, so that only pages in doubt are cut into sentences.
    """
    if periods is None:
        seen = survey(pages, languages, text, key, label)
        found = _languages(seen.filter("kind = 'page'").select("k", "l", "t"), languages, fit_periods(seen)).withColumnRenamed("k", key)
    else:
        found = find_languages(pages, languages, periods, key, text, label)
    case = F.col("label_code").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label_code"))
    return found.filter((F.size("langs") > 0) & case).select(key, F.explode("langs").alias("lang")).distinct()
