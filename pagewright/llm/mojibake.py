"""Problem 1: text that was decoded with the wrong character encoding.

A wrong decoding is a substitution cipher: going back through the reader's code
page gives bytes, and an unknown table maps units of bytes (one byte, or the
bytes of one multi-byte character) to the letters that were meant.

1. Spark counts letter bigrams of the whole corpus into a hashed table of fixed
   size and words with non-ASCII letters exactly; only words above a share stay.
2. One pass over the pages picks suspicious words (an unlikely bigram, a rare
   word) and, per page, the known encodings that would make them more probable.
   They are starting points of ciphers and no repairs yet; words that none of
   them helps may belong to an unknown page.
3. Per source (a run) and cipher, neighbouring units are counted in Spark, and
   expectation-maximization against the bigrams learns the table from units to
   letters.  A group holds distinct pairs of units with their counts, so a source
   with a third of all rows is no larger than one with all letters.
4. Tables go back to the pages' suspicious words and are applied with
   ``str.translate``.  A page is damaged where repaired words are more probable
   than stored ones by more than the prior odds, or where characters are lost
   (U+FFFD, C1 controls).
5. The words with non-ASCII characters of damaged texts are taken out of the
   counts and steps 2 to 4 run again: the outer EM over "damaged or not".
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

BUCKETS = 1 << 18
SINGLE = 1 << 16
#: Log odds for a repair that gives a common word; a word under RARE of all is looked at, one over COMMON is common,
#: words over KEPT have their exact counts broadcast: at most its inverse, whatever the corpus holds.
KNOWN, RARE, COMMON, KEPT = 12.0, 5e-5, 1e-5, 4e-6
#: Log odds a page's repairs must win, by how much the kind of cipher leaves to chance: valid UTF-8 behind another
#: page is hardly an accident, pairs of bytes may be, a learned single-byte table fits the most.
PRIOR = {"utf-8": 4.5, "pairs": 14.0, "learned": 16.0}
#: A word is looked at when one of its bigrams is less likely than this.
SUSPICIOUS = -7.0
#: Distinct improbable words without a known cipher from which a source's own table is learned.
LEAST_UNKNOWN = 60
#: Pseudo-counts with which a known encoding enters the estimates of a table, by the kind of cipher.
TRUST = {"utf-8": 20.0, "pairs": 20.0, "learned": 2.0}

# fixed values: names of code pages known to Python
READERS = ("cp1252", "latin-1", "mac_roman", "cp1251", "koi8-r", "cp437", "cp850", "cp866", "cp1250", "iso8859-2",
           "cp852", "mac_cyrillic", "cp874", "gbk", "cp932", "big5", "cp949")
SINGLE_BYTE = ("cp1252", "cp1250", "cp1251", "koi8-r", "cp866", "iso8859-2", "iso8859-5", "cp852", "mac_roman",
               "mac_cyrillic", "cp437", "cp850", "cp874")
MULTI_BYTE = ("utf-8", "gbk", "big5", "cp932", "euc_jp", "euc_kr")
MULTI_READERS = ("gbk", "cp932", "big5", "cp949")
AGAIN = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437")

_WORD = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")  # C1 controls and no-break spaces may be halves of a letter
_ODD = re.compile("[A-Za-z][\u00a4-\u00bf\u00d7\u00f7\u2500-\u259f\u2310-\u2321\u2219-\u2265\u0391-\u03c9\u207f\u20a7\u0192]|[\u00a4-\u00bf\u00f7\u2500-\u259f\u2310-\u2321\u2219-\u2265\u0391-\u03c9\u207f\u20a7\u0192][A-Za-z]")  # signs grown into Latin words
_LOST = r"[\x{FFFD}\x{80}-\x{9F}]"
_FULL = re.compile("[\u3000-\u303f\uff00-\uffef]")
_CUT = re.compile("(?<=[\u3000-\u303f\uff00-\uffef])")
_PLAIN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def _pair_bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 1000003 + b * 7919 + (a >> 3) * 31) & (BUCKETS - 1)


def _plain_words(text: str) -> list[str]:
    """Words with non-ASCII letters; scripts without spaces have none."""
    return [w for w in _PLAIN.findall(text) if not w.isascii() and max(w) < "\u2e80"]


class BigramModel:
    """Smoothed log P(next | previous) from hashed counts, and exact counts of words above a share."""

    def __init__(self, pairs: np.ndarray, singles: np.ndarray, words: dict[str, int], all_words: float):
        self.pairs, self.singles, self.words = pairs.astype(np.float32), singles.astype(np.float32), words
        self.all_words = max(1.0, all_words)
        self.total = float(singles.sum()) + SINGLE

    def args(self) -> tuple:
        return self.pairs, self.singles, self.words, self.all_words

    def without(self, pairs: np.ndarray, singles: np.ndarray, words: dict[str, int]) -> BigramModel:
        """The model of a corpus from which some damaged words are taken out."""
        left = {w: n - words.get(w, 0) for w, n in self.words.items() if n > words.get(w, 0)}
        return BigramModel(np.maximum(self.pairs - pairs, 0), np.maximum(self.singles - singles, 0), left, self.all_words - sum(words.values()))

    def chances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Probability of code ``b`` after code ``a``."""
        base = (self.singles[b & (SINGLE - 1)] + 0.1) / self.total
        return (self.pairs[_pair_bucket(a, b)] + 8.0 * base) / (self.singles[a & (SINGLE - 1)] + 8.0)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.log(self.chances(a, b))

    def logs(self, codes: np.ndarray) -> np.ndarray:
        return self.between(codes[:-1], codes[1:])

    def count(self, word: str) -> int:
        return self.words.get(word, 0)

    def rare(self, word: str) -> bool:
        """Whether a plain word of it is hardly ever seen."""
        least = RARE * self.all_words
        return any(self.count(w) < least for w in _plain_words(word)) or bool(_ODD.search(word))

    def known(self, text: str, word: str) -> bool:
        """Whether all plain words of a repair are common, and far more so than the word as it stands."""
        new = _plain_words(text)
        own = max((self.count(w) for w in _plain_words(word)), default=0)
        return bool(new) and all(self.count(w) >= max(COMMON * self.all_words, 10 * (own + 1)) for w in new)

    def score(self, text: str) -> float:
        return float(self.logs(_codes(text)).sum())

    def scores(self, texts: list[str]) -> np.ndarray:
        """:meth:`score` of many texts at once."""
        codes = _codes(" ".join(texts))[:-1]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        return np.add.reduceat(self.between(codes, np.append(codes[1:], 32)), begins)

    @functools.cached_property
    def frequent(self) -> np.ndarray:
        """Codes of the most frequent non-ASCII letters below the ideographs, by frequency."""
        order = np.argsort(-self.singles[:0x2E80], kind="stable")
        return np.array([c for c in order[:2000] if c > 127 and chr(c).isalpha()][:64], dtype=np.int64)


def _letters(byte: int) -> list[int]:
    """Codes a high byte stands for in any known single-byte page."""
    out = []
    for page in SINGLE_BYTE:
        c = bytes([byte]).decode(page, "replace")
        if ord(c) not in out and (c.isalnum() or c in "«»“”‘’„–—…№§°±µ¿¡ªº×"):
            out.append(ord(c))
    return out


LETTERS = {b: _letters(b) for b in range(128, 256)}


def to_bytes(word: str, reader: str) -> bytes | None:
    """The bytes that ``reader`` turned into ``word``; None if it cannot have produced it."""
    try:
        return word.encode(reader)
    except UnicodeEncodeError:
        if reader in MULTI_READERS:
            return None
    out = bytearray()
    for c in word:  # C1 controls stand for bytes the page leaves undefined
        try:
            out += c.encode(reader)
        except UnicodeEncodeError:
            if 0x80 <= ord(c) < 0xA0:
                out.append(ord(c))
            elif c == "�":
                out.append(0x3F)
            else:
                return None
    return bytes(out)


def _shapes() -> str:
    """Pattern of what the bytes of one UTF-8 character look like through a single-byte page."""
    out = []
    for reader in READERS:
        if reader not in MULTI_READERS:
            seen = [re.escape(bytes([b]).decode(reader, "ignore")) or chr(b) for b in range(256)]
            tail, lead2, lead3 = "".join(seen[0x80:0xC0]), "".join(seen[0xC2:0xE0]), "".join(seen[0xE0:0xF0])
            out.append(f"[{lead2}][{tail}]|[{lead3}][{tail}][{tail}]")
    return "|".join(out)


_SHAPED = re.compile(_shapes())


def multi_byte(word: str) -> Iterator[tuple[str, str]]:
    """(cipher name, text) for each reading of ``word`` as bytes of a multi-byte encoding, also applied twice."""
    wide = max(word) >= "\u2e80"  # only a multi-byte reader makes ideographs
    shaped = wide or bool(_SHAPED.search(word))
    paired = sum(c > "\x7f" for c in word) >= 2
    if not shaped and not paired:
        return
    for reader in MULTI_READERS if wide else READERS[:-len(MULTI_READERS)]:
        raw = to_bytes(word, reader)
        if raw is None or raw.isascii():
            continue
        for true in ("utf-8",) if wide else MULTI_BYTE:
            if not (shaped if true == "utf-8" else paired):
                continue
            try:
                text = raw.decode(true)
            except UnicodeDecodeError:
                continue
            if text == word or not text or true != "utf-8" and len(re.findall("[⺀-퟿＀-￯]", text)) < 2:
                continue
            yield f"{reader}>{true}", text
            if true == "utf-8":
                for again in AGAIN:
                    raw2 = to_bytes(text, again)
                    if raw2 and not raw2.isascii():
                        try:
                            yield f"{reader}>{true}>{again}>utf-8", raw2.decode("utf-8")
                        except UnicodeDecodeError:
                            pass


def kind_of(cipher: str) -> str:
    """Key of PRIOR for a cipher."""
    return "utf-8" if cipher.endswith("utf-8") else "pairs" if cipher.rpartition(">")[2] in MULTI_BYTE else "learned"


_UTF8 = re.compile(rb"[\x00-\x7f]|[\xc0-\xff][\x80-\xbf]*|[\x80-\xbf]")
_PAIRED = re.compile(rb"[\x00-\x7f]|[\x80-\xff].?", re.S)


def split_units(word: str, cipher: str) -> list[bytes] | None:
    """The units a cipher's table maps to letters: bytes, or the bytes of one character of a multi-byte encoding."""
    reader, _, rest = cipher.partition(">")
    if cipher == "unknown":
        return [c.encode("utf-8", "surrogatepass") for c in word]
    raw = to_bytes(word, reader)
    if raw is None:
        return None
    if rest.count(">") == 2:  # encoded twice: the outer layer is known to be UTF-8
        inner = to_bytes(raw.decode("utf-8", "replace"), rest.split(">")[1])
        return None if inner is None else _UTF8.findall(inner)
    if rest == "utf-8":
        return _UTF8.findall(raw)
    return _PAIRED.findall(raw) if rest in MULTI_BYTE else [bytes([b]) for b in raw]


#: Distinct pairs of units from which a single-byte table may go beyond the letters of known pages.
WIDE = 80


def candidates(unit: bytes, cipher: str, model: BigramModel, wide: bool = False) -> tuple[list[int], list[float]]:
    """Codes of the letters a unit may stand for, the known encoding's first, and their first probabilities."""
    if unit.isascii():
        return [unit[0]], [1.0]
    true = cipher.rpartition(">")[2]
    if cipher == "unknown":
        own = ord(unit.decode("utf-8", "surrogatepass"))
        letters = [own, *(int(c) for c in model.frequent if c != own)]
        return letters, [0.2, *[0.8 / (len(letters) - 1)] * (len(letters) - 1)] if len(letters) > 1 else [1.0]
    first = unit.decode(true, "replace")
    if true in SINGLE_BYTE:
        others = [*LETTERS[unit[0]], *(int(c) for c in model.frequent if wide and c not in LETTERS[unit[0]])]
    elif true == "utf-8":  # letters of the same block
        others = [int(c) for c in model.frequent if len(first) == 1 and c >> 8 == ord(first) >> 8][:6]
    else:
        others = [ord(t) for e in MULTI_BYTE if len(t := unit.decode(e, "replace")) == 1 and t != "�"]
    start = [ord(first)] if len(first) == 1 else []
    letters = [*start, *(c for c in others if c not in start)] or [0xFFFD]
    rest = len(letters) - len(start)
    weight = 0.95 if rest else 1.0
    return letters, [*([weight] * len(start)), *([(1 - weight * len(start)) / max(1, rest)] * rest)]


def learn_table(left: list[bytes], right: list[bytes], n: np.ndarray, cipher: str, model: BigramModel, rounds: int = 0) -> dict[bytes, int]:
    """Unit-to-letter table of one source by EM over the counts of its neighbouring units.

    E-step: for each pair of units, the joint probability of two letters under the table and the bigram model.  M-step:
    a unit's letters get their expected counts, plus TRUST times what the known encoding says.
    """
    units = sorted({*left, *right})
    number = {u: i for i, u in enumerate(units)}
    wide = len(left) >= WIDE
    both = [candidates(u, cipher, model, wide) for u in units]
    most = max(len(c) for c, _ in both)
    letters = np.array([c + [0] * (most - len(c)) for c, _ in both], dtype=np.int64)
    prior = np.array([p + [0.0] * (most - len(p)) for _, p in both])
    hidden = np.array([len(c) > 1 for c, _ in both])
    u, v = np.array([number[x] for x in left]), np.array([number[x] for x in right])
    open_ = hidden[u] | hidden[v]  # pairs that tell something
    u, v, n = u[open_], v[open_], n[open_]
    table, trust = prior.copy(), 0.1 if cipher == "unknown" else TRUST[kind_of(cipher)]
    step = max(1, 4_000_000 // most**2)  # pairs at once, so that memory doesn't grow with them
    chances = None  # the same in every round; kept where all pairs are taken at once
    for _ in range(rounds or (20 if cipher == "unknown" else 8 if wide else 3)):
        expected = np.zeros_like(table)
        for at in range(0, len(u), step):
            a, b, w = u[at : at + step], v[at : at + step], n[at : at + step]
            if chances is None or len(u) > step:
                chances = model.chances(letters[a][:, :, None], letters[b][:, None, :])
            joint = chances * table[a][:, :, None] * table[b][:, None, :]
            joint *= (w / np.maximum(joint.sum(axis=(1, 2)), 1e-300))[:, None, None]
            np.add.at(expected, a, joint.sum(axis=2))
            np.add.at(expected, b, joint.sum(axis=1))
        table = expected + trust * prior
        table /= table.sum(axis=1, keepdims=True)
    return {x: int(letters[i, table[i].argmax()]) for x, i in number.items()}


def apply_table(words: list[str], cipher: str, table: dict[bytes, int]) -> list[str | None]:
    """The words with each unit's letter in its place, by ``str.translate`` over one private code per unit."""
    codes = {u: 0xF0000 + i for i, u in enumerate(table)}
    trans = {codes[u]: c for u, c in table.items()}
    out: list[str | None] = []
    for w in words:
        units = split_units(w, cipher)
        out.append(None if units is None or any(u not in codes for u in units) else "".join(map(chr, (codes[u] for u in units))).translate(trans))
    return out


def _words_of(text: str) -> list[str]:
    """Words that hold non-ASCII characters; unspaced scripts are cut after full-width marks."""
    out = []
    for w in _WORD.findall(text):
        out += [x for x in _CUT.split(w) if x and not x.isascii()] if _FULL.search(w) else [w]
    return out


def _suspects(texts: list[str], model: BigramModel, rare: dict[str, bool]) -> list[list[str]]:
    """Per text its suspicious words: with an unlikely bigram that holds a non-ASCII character, rare, or shaped like misread UTF-8."""
    whole = " ".join(texts)
    codes = _codes(whole)
    codes[(codes == 10) | (codes == 9)] = 32
    logs = model.logs(codes)
    least = np.where(codes[:-1] == 32, SUSPICIOUS - 3.0, SUSPICIOUS)  # any single letter is a rare start of a word
    low = np.concatenate([[0], np.cumsum((logs < least) & ((codes[:-1] > 127) | (codes[1:] > 127)))])
    words, begins = [], []
    for m in _WORD.finditer(whole):
        if not _FULL.search(m.group()):
            words.append(m.group())
            begins.append(m.start())
            continue
        at = m.start()
        for part in _CUT.split(m.group()):
            if part and not part.isascii():
                words.append(part)
                begins.append(at)
            at += len(part)
    for w in set(words).difference(rare):
        rare[w] = model.rare(w) or bool(_SHAPED.search(w))
    starts = np.array(begins, dtype=np.int64)
    ends = starts + np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    odd = (low[ends + 1] > low[starts]) | np.fromiter(map(rare.__getitem__, words), dtype=bool, count=len(words))  # pair k lies before character k
    page = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in texts)]), starts, side="right") - 1
    out: list[list[str]] = [[] for _ in texts]
    for i in np.flatnonzero(odd):
        out[page[i]].append(words[i])
    return out


_LIMIT = 0x2600


@functools.cache
def _exchanges() -> list[tuple[str, np.ndarray]]:
    """(cipher, code to code) for every two known single-byte pages; -1 where the reader cannot have made a character."""
    high = np.arange(128, 256)
    letters = {page: np.array([ord(bytes([i]).decode(page, "replace")) for i in high]) for page in READERS if page not in MULTI_READERS} | {
        page: np.array([ord(bytes([i]).decode(page, "replace")) for i in high]) for page in SINGLE_BYTE
    }
    out = []
    for reader in READERS:
        if reader in MULTI_READERS:
            continue
        made = np.full(_LIMIT, -1)
        made[:160] = np.arange(160)  # C1 controls stand for bytes the page leaves undefined
        seen = letters[reader] < _LIMIT
        made[letters[reader][seen]] = high[seen]
        for true in SINGLE_BYTE:
            if true != reader:
                meant = np.concatenate([np.arange(128), letters[true], [-1]])  # the last for what the reader can't make
                meant[128:160][(meant[128:160] >= 0x80) & (meant[128:160] < 0xA0)] = -1  # nobody means a control
                out.append((f"{reader}>{true}", meant[made]))
    return out


def _single_gains(words: list[str], model: BigramModel) -> np.ndarray:
    """Log odds of each word (row) as read through each of :func:`_exchanges`; -inf where that can't be."""
    out = np.full((len(words), len(_exchanges())), -np.inf)
    fit = [i for i, w in enumerate(words) if max(w) < chr(_LIMIT)]
    if not fit:
        return out
    codes = _codes(" ".join(words[i] for i in fit))[:-1]
    begins = np.cumsum([0, *(len(words[i]) + 1 for i in fit[:-1])])
    after = np.append(codes[1:], 32)
    own = np.add.reduceat(model.between(codes, after), begins)
    for k, (_, table) in enumerate(_exchanges()):
        new = table[codes]
        able = np.minimum.reduceat(new, begins) >= 0
        if not able.any():
            continue
        new = np.maximum(new, 0)
        gain = np.add.reduceat(model.between(new, np.append(new[1:], 32)), begins) - own
        for j in np.flatnonzero(able):
            i = fit[j]
            text = "".join(map(chr, new[begins[j] + 1 : begins[j] + 1 + len(words[i])])) if gain[j] > -0.5 * KNOWN else ""
            out[i, k] = (-np.inf if text == words[i] else gain[j] + KNOWN * model.known(text, words[i])) if text else gain[j]
    return out


def _best_multi(words: list[str], model: BigramModel) -> list[tuple[float, str]]:
    """Best (gain, cipher) of each word over the multi-byte encodings."""
    read: dict[tuple[int, str], str] = {}
    for i, w in enumerate(words):
        for name, text in multi_byte(w):
            read.setdefault((i, text), name)
    out = [(0.0, "")] * len(words)
    if read:
        of = np.array([i for i, _ in read])
        own = model.scores([words[i] for i in np.unique(of)])
        gains = model.scores([t for _, t in read]) - own[np.searchsorted(np.unique(of), of)]
        for ((i, text), name), gain in zip(read.items(), gains):
            if gain > -0.5 * KNOWN and (gain := gain + KNOWN * model.known(text, words[i])) > out[i][0]:
                out[i] = (float(gain), name)
    return out


def improbable(word: str, model: BigramModel) -> bool:
    """Whether a letter inside a word is very unlikely after the one before."""
    codes = _codes(word)[1:-1]
    return len(codes) > 2 and bool(((model.logs(codes) < SUSPICIOUS) & ((codes[:-1] > 127) | (codes[1:] > 127))).any())


def assign(texts: list[str], model: BigramModel, memory: dict) -> list[dict[str, list[str]]]:
    """Per text, the known encodings that make its suspicious words more probable, with these words.

    Single-byte ciphers are chosen by all suspicious words of the text together; improbable words that no known encoding
    helps are listed under ``unknown``.
    """
    found = _suspects(texts, model, memory.setdefault("rare", {}))
    multi, rows = memory.setdefault("multi", {}), memory.setdefault("single", {})
    new = [w for w in {w for ws in found for w in ws} if w not in multi]
    rows.update(zip(new, _single_gains(new, model)))
    multi.update(zip(new, _best_multi(new, model)))
    lonely = memory.setdefault("lonely", {})
    lonely.update((w, max(w) < chr(_LIMIT) and improbable(w, model)) for w in new)
    names, out = [n for n, _ in _exchanges()], []
    for ws in found:
        mine: dict[str, list[str]] = {}
        gains = np.array([rows[w] for w in ws])
        single = np.full(len(ws), -np.inf)
        if ws:
            best = [multi[w][0] for w in ws]
            plain = np.array([b <= 0 or not multi[w][1].endswith("utf-8") for b, w in zip(best, ws)])  # valid UTF-8 is no accident
            total = np.where(np.isfinite(gains), np.clip(gains, -4.0, None), -4.0)[plain].sum(axis=0)
            k = int(total.argmax())
            if total[k] > 0:
                single = np.where(plain, gains[:, k], -np.inf)
        for w, g in zip(ws, single):
            if multi[w][0] > max(0.0, g):
                mine.setdefault(multi[w][1], []).append(w)
            elif np.isfinite(g):
                mine.setdefault(names[k], []).append(w)
            elif lonely[w]:
                mine.setdefault("unknown", []).append(w)
        out.append(mine)
    if len(multi) > 100_000:
        memory.clear()
    return out


def _judge(words: list[str], repaired: list[str | None], kind: str, model: BigramModel, least: float = 3.0) -> list[float]:
    """Log odds of each repaired word; 0 where they are not above ``least``, too little for a learned table, or nothing changed."""
    out = []
    for w, t in zip(words, repaired):
        if t is None or t == w or not t:
            out.append(0.0)
            continue
        logs, common = model.logs(_codes(t)), model.known(t, w)
        gain = float(logs.sum()) - model.score(w) + KNOWN * common
        changed = sum(x != y for x, y in zip(w, t)) if len(w) == len(t) else 1
        sure = gain > least and (kind != "learned" or common or logs.min() > SUSPICIOUS and gain > 2.0 * changed)
        out.append(gain if sure else 0.0)
    return out


def _cells(texts: Iterator[str]) -> Iterator[pd.DataFrame]:
    """Partial counts of one task: rows of (cell, word, n)."""
    pairs, singles, words = np.zeros(BUCKETS), np.zeros(SINGLE), Counter()

    def rows(counts: Counter) -> pd.DataFrame:
        return pd.DataFrame({"cell": np.full(len(counts), -1), "word": np.array(list(counts), dtype=object), "n": np.array(list(counts.values()), dtype=float)})

    batch, size = [], 0

    def add() -> None:
        codes = _codes(" ".join(batch))
        codes[(codes == 10) | (codes == 9)] = 32
        pairs[:] += np.bincount(_pair_bucket(codes[:-1], codes[1:]), minlength=BUCKETS)
        singles[:] += np.bincount(codes[:-1] & (SINGLE - 1), minlength=SINGLE)

    for t in texts:
        batch.append(t)
        size += len(t)
        if not t.isascii():
            words.update(_plain_words(t))
            if len(words) > 300_000:
                yield rows(words)
                words.clear()
        if size > 1 << 18:
            add()
            batch, size = [], 0
    if batch:
        add()
    yield rows(words)
    both = np.concatenate([pairs, singles])
    at = np.flatnonzero(both)
    yield pd.DataFrame({"cell": at, "word": np.full(len(at), None), "n": both[at]})


def _counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[str, int], float]:
    """Tables of the letters and words of the texts (t); at most BUCKETS + SINGLE + 1 / KEPT rows reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _cells(t for b in batches for t in b["t"] if t is not None)

    parts = cut(texts.mapInPandas(count, "cell long, word string, n double").groupBy("cell", "word").agg(F.sum("n").alias("n")))
    letters = parts.filter("cell >= 0").select("cell", "n").toPandas()
    table = np.zeros(BUCKETS + SINGLE)
    table[letters["cell"].to_numpy(dtype=np.int64)] = letters["n"].to_numpy(dtype=float)
    words = parts.filter("cell < 0")
    total = float(words.agg(F.sum("n")).first()[0] or 0.0)
    kept = {r["word"]: int(r["n"]) for r in words.filter(F.col("n") >= KEPT * total).select("word", "n").toLocalIterator()}
    return table[:BUCKETS], table[BUCKETS:], kept, total


def learn_bigrams(pages: DataFrame, text: str = "text") -> BigramModel:
    """Letter bigrams and common words of all texts."""
    return BigramModel(*_counts(pages.select(F.col(text).alias("t"))))


def damaged_words(pages: DataFrame, model: BigramModel, key: str, source: str, text: str, last: bool = True) -> DataFrame:
    """(k, odds, cipher, words, repaired): per text and cipher, the words its source's table repairs, and their log odds less the prior.

    In rounds before the ``last``, whose counts still hold the damage, every gain of valid UTF-8 counts.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(model.args())
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, source)]

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, memory = BigramModel(*shared.value), {}

        def flush(rows: list[tuple]) -> pd.DataFrame:
            found = assign([r[2] for r in rows], now, memory)
            return pd.DataFrame([(r[0], r[1], c, ws) for r, mine in zip(rows, found) for c, ws in mine.items()], columns=["k", "s", "cipher", "words"])

        waiting, size = [], 0
        for b in batches:
            for row in zip(b["k"], b["s"], b["t"]):
                if row[2] is None or row[2].isascii():
                    continue
                waiting.append(row)
                size += len(row[2])
                if size > 1 << 18:
                    yield flush(waiting)
                    waiting, size = [], 0
        if waiting:
            yield flush(waiting)

    named = pages.select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(text).alias("t"))
    started = cut(named.mapInPandas(start, f"k {kinds[0]}, s {kinds[1]}, cipher string, words array<string>"))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for s, cipher, words in zip(b["s"], b["cipher"], b["words"]):
                for w in words:
                    units = split_units(w, cipher)
                    if units:
                        seen.update((s, cipher, x, y) for x, y in zip([b" ", *units], [*units, b" "]))
            yield pd.DataFrame([(*x, n) for x, n in seen.items()], columns=["s", "cipher", "u", "v", "n"])

    own = started.filter("cipher = 'unknown'").select("s", F.explode("words").alias("w")).groupBy("s").agg(F.approx_count_distinct("w").alias("types")).filter(F.col("types") >= LEAST_UNKNOWN).select("s", F.lit("unknown").alias("c"))
    same = F.col("s").eqNullSafe(F.col("s2"))
    learnable = started.filter("cipher <> 'unknown'").unionByName(started.filter("cipher = 'unknown'").join(own.withColumnRenamed("s", "s2"), same, "left_semi"))
    counted = learnable.select("s", "cipher", "words").mapInPandas(pairs, f"s {kinds[1]}, cipher string, u binary, v binary, n long").groupBy("s", "cipher", "u", "v").agg(F.sum("n").alias("n"))
    groups = counted.groupBy("s", "cipher").agg(F.collect_list(F.struct("u", "v", "n")).alias("pairs"))  # distinct pairs of units only

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = BigramModel(*shared.value)
        for b in batches:
            rows = []
            for s, cipher, found in zip(b["s"], b["cipher"], b["pairs"]):
                table = learn_table([bytes(x["u"]) for x in found], [bytes(x["v"]) for x in found], np.array([x["n"] for x in found], dtype=float), cipher, now)
                rows.append((s, cipher, list(table), list(table.values())))
            yield pd.DataFrame(rows, columns=["s2", "c2", "units", "letters"])

    tables = groups.mapInPandas(learn, f"s2 {kinds[1]}, c2 string, units array<binary>, letters array<int>")

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = BigramModel(*shared.value)
        for b in batches:
            rows = []
            for k, cipher, words, units, letters in zip(b["k"], b["cipher"], b["words"], b["units"], b["letters"]):
                words, kind = list(words), kind_of(cipher)
                new = apply_table(words, cipher, dict(zip(map(bytes, units), map(int, letters))))
                soft = kind == "utf-8" and not last
                gains = _judge(words, new, kind, now, 0.0 if soft else 3.0)
                best = {w: g for w, g in zip(words, gains) if g > 0}
                odds = sum(best.values()) - (0.0 if soft else PRIOR[kind])
                if odds > 0:
                    kept = [(w, t) for w, t, g in zip(words, new, gains) if g > 0]
                    rows.append((k, odds, cipher, [w for w, _ in kept], [t for _, t in kept]))
            yield pd.DataFrame(rows, columns=["k", "odds", "cipher", "words", "repaired"])

    joined = learnable.join(tables, same & (F.col("cipher") == F.col("c2"))).select("k", "cipher", "words", "units", "letters")
    return cut(joined.mapInPandas(repair, f"k {kinds[0]}, odds double, cipher string, words array<string>, repaired array<string>"))


def _foreign_words(pages: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """(t): the words with non-ASCII characters of each text found damaged, most of which its cipher made."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"t": [" ".join(_words_of(t)) for t in b["t"] if t is not None]}, dtype=object)

    keys = cut(found.select(F.col("k").alias("__k")).distinct())
    return pages.join(keys, F.col(key) == F.col("__k"), "left_semi").select(F.col(text).alias("t")).mapInPandas(words, "t string")


def find_damage(pages: DataFrame, key: str = "page_id", source: str | None = None, text: str = "text", rounds: int = 2) -> DataFrame:
    """(key, damage_odds, cipher, repairs) of the damaged texts; ``repairs`` maps words to what they were meant to be."""
    model = learn_bigrams(pages, text)
    for i in range(max(1, rounds)):
        found = damaged_words(pages, model, key, source or key, text, i + 1 >= rounds)
        if i + 1 < rounds:  # the corpus without its damaged words
            model = model.without(*_counts(_foreign_words(pages, found, key, text))[:3])
    each = found.select("k", F.explode(F.arrays_zip("words", "repaired")).alias("x"), "odds").groupBy("k", "x.words").agg(F.max_by("x.repaired", "odds").alias("repaired"))
    maps = each.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("words", "repaired"))).alias("repairs"))  # words of one text
    repaired = found.groupBy("k").agg(F.max("odds").alias("odds"), F.max_by("cipher", "odds").alias("cipher")).join(maps, "k")
    lost = pages.filter(F.col(text).rlike(_LOST)).select(F.col(key).alias("k"), F.lit(PRIOR["learned"]).alias("odds"), F.lit(None).cast("string").alias("cipher"), F.lit(None).cast("map<string,string>").alias("repairs"))
    both = repaired.unionByName(lost).groupBy("k").agg(F.max("odds").alias("damage_odds"), F.first("cipher", ignorenulls=True).alias("cipher"), F.first("repairs", ignorenulls=True).alias("repairs"))
    return both.withColumnRenamed("k", key)


def _replace(text: Column, repairs: Column) -> Column:
    @F.pandas_udf("string")
    def replace(texts: pd.Series, maps: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(texts, maps):
            if t is None or m is None or not len(m):
                out.append(t)
                continue
            new, at = dict(m), 0
            parts = []
            for w in _words_of(t):
                place = t.index(w, at)
                parts += [t[at:place], new.get(w, w)]
                at = place + len(w)
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    return replace(text, repairs)


def repair_encoding(pages: DataFrame, key: str = "page_id", source: str | None = None, text: str = "text", rounds: int = 2) -> DataFrame:
    """Adds ``repaired``, ``damage_odds`` (log odds that a stretch was decoded wrongly) and ``cipher``.

    Tables are learned per ``source`` column (each text for itself where it is None).  Nulls, empty texts and plain
    ASCII are never damaged; ``repaired`` is then the text itself.  A text whose characters were lost for good (U+FFFD,
    C1 controls) counts as damaged even where nothing can be restored; its ``cipher`` is then null.  Columns of the input
    keep their names and values; repeated rows give repeated rows.
    """
    found = find_damage(pages, key, source, text, rounds).select(F.col(key).alias("__k"), F.col("damage_odds").alias("__odds"), F.col("cipher").alias("__cipher"), F.col("repairs").alias("__repairs"))
    return pages.join(found, F.col(key) == F.col("__k"), "left").select(
        *[F.col(f"`{c}`") for c in pages.columns], F.when(F.col("__repairs").isNull(), F.col(text)).otherwise(_replace(F.col(text), F.col("__repairs"))).alias("repaired"),
        F.coalesce("__odds", F.lit(-PRIOR["utf-8"])).alias("damage_odds"), F.col("__cipher").alias("cipher"),
    )


def find_damaged(pages: DataFrame, key: str = "page_id", source: str | None = None, text: str = "text") -> DataFrame:
    """Distinct keys of the texts with at least one damaged stretch."""
    return find_damage(pages, key, source, text).select(key)
