"""Problem 8: passages of evaluation items inside a training corpus.

Greedy string tiling.  Seeds (short runs of shared tokens) are joined between
documents and items; for each pair that shares one, maximal matches are grown
from the seeds, the longest that overlaps nothing marked is marked again and
again, and neighbouring tiles that are parted by one exchanged word form a
stretch.  Seed hashes are Karp-Rabin hashes rolled over hashes of tokens.  A passage
cut up and put together in another order has no long stretch, but its tiles
cover it: such pairs are reported as ``reordered``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut

SEED_WORDS, SEED_CHARS = 5, 8
#: Shortest stretch that counts, in words and in characters of unspaced scripts; words that must agree between two exchanged ones.
LEAST_WORDS, LEAST_CHARS, BETWEEN = 12, 20, 10
#: Share of a passage under tiles from which it counts as reordered where it has no long enough stretch.
COVERED = 0.8
#: Shared windows without which neither rule can hold: twelve words have eight windows of five, one exchanged word takes
#: at most five; tiles that cover a passage of twelve words are two at least.
LEAST_WINDOWS = 2
#: Characters of item text whose seed hashes are broadcast at once; larger test sets go through in blocks of this size.
BLOCK_CHARS = 20_000_000
BASE, MASK = 1_000_003, (1 << 61) - 1

_UNSPACED = "一-鿿㐀-䶿぀-ヿ฀-๿"
_TOKENS = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")


def tokens(text: str) -> list[str]:
    """Words, or single characters of unspaced scripts, without case, punctuation, layout and character width."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _TOKENS.findall(text.casefold())


class _Hashes(dict):
    """Hash of each token, computed once; the memory starts anew when it is large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = h = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) >> 1
        return h

    def of(self, toks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, toks), dtype=np.int64, count=len(toks))


def _is_unspaced(toks: list[str]) -> bool:
    return 2 * sum(len(t) == 1 and bool(re.match(f"[{_UNSPACED}]", t)) for t in toks) > len(toks)


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of each window of ``k`` token hashes (wrapping 64-bit arithmetic)."""
    n = len(ids) - k + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for i in range(k if n > 0 else 0):
        out = out * np.uint64(BASE) + ids[i : i + n].astype(np.uint64)
    return (out & np.uint64(MASK)).astype(np.int64) * 2 + (k == SEED_CHARS)


def _grow(doc: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, place in document, place in item) around all shared windows of ``k`` tokens."""
    places = defaultdict(list)
    for p, h in enumerate(rolling(item, k)):
        places[int(h)].append(p)
    shared = rolling(doc, k)
    found, done = [], {}
    for j in np.flatnonzero(np.isin(shared, np.fromiter(places, dtype=np.int64, count=len(places)))):
        for p in places[int(shared[j])]:
            if done.get(j - p, -1) >= p or not np.array_equal(doc[j : j + k], item[p : p + k]):
                continue
            a, b = int(j), p
            while a > 0 and b > 0 and doc[a - 1] == item[b - 1]:
                a, b = a - 1, b - 1
            e, f = int(j) + k, p + k
            while e < len(doc) and f < len(item) and doc[e] == item[f]:
                e, f = e + 1, f + 1
            done[j - p] = f - k
            found.append((f - b, a, b))
    return found


def tiles(doc: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in document, place in item, length), longest first, none overlapping in either text."""
    used_doc, used_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out = []
    queue = sorted(set(_grow(doc, item, k)), key=lambda m: (-m[0], m[1], m[2]))
    while queue:
        n, a, b = queue.pop(0)
        taken = used_doc[a : a + n] | used_item[b : b + n]
        if taken.any():  # what is left of an overlapped match queues again
            edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
            parts = [(int(y - x), a + int(x), b + int(x)) for x, y in zip(edges[::2], edges[1::2]) if y - x >= k]
            queue = sorted({*queue, *parts}, key=lambda m: (-m[0], m[1], m[2]))
            continue
        used_doc[a : a + n], used_item[b : b + n] = True, True
        out.append((a, b, n))
    return sorted(out)


def longest_stretch(found: list[tuple[int, int, int]], doc: np.ndarray, item: np.ndarray, gap: int) -> int:
    """Length, in item tokens, of the longest chain of tiles with one exchanged word (up to ``gap`` tokens) between two."""
    best = 0
    for start in range(len(found)):
        a, b, n = found[start]
        first = b
        while True:
            end_doc, end_item = a + n, b + n
            tail = 0  # a short agreeing run behind one more exchanged word
            while end_doc + 1 + tail < len(doc) and end_item + 1 + tail < len(item) and doc[end_doc + 1 + tail] == item[end_item + 1 + tail]:
                tail += 1
            own = found[start]
            head = 0
            while own[0] - 2 - head >= 0 and own[1] - 2 - head >= 0 and doc[own[0] - 2 - head] == item[own[1] - 2 - head]:
                head += 1
            longer = end_item - first
            if tail >= 3 and (b == first or n >= BETWEEN):  # an inner run needs ten words, an outer one doesn't
                longer = max(longer, end_item + 1 + tail - first)
            if head >= 3 and (b == first or own[2] >= BETWEEN):
                longer = max(longer, end_item - first + 1 + head)
            best = max(best, longer)
            if b != first and n < BETWEEN:
                break
            after = [t for t in found if 1 <= t[0] - end_doc <= gap and 1 <= t[1] - end_item <= gap]
            if not after:
                break
            a, b, n = after[0]
    return best


def _blocks(items: DataFrame, text: str) -> list[DataFrame]:
    total = items.agg(F.sum(F.length(text))).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_CHARS))
    return [items.filter(F.pmod(F.xxhash64(text), F.lit(n)) == i) for i in range(n)]


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", passage: str = "passage") -> DataFrame:
    """(key, item_key, stretch, coverage, leak): every document with a long enough stretch of an item's passage, or with
    most of the passage in another order.

    ``stretch`` counts passage words (characters of unspaced scripts), ``coverage`` is the share of the passage under
    tiles, ``leak`` is ``stretch`` or ``reordered``.  Null or empty texts and passages match nothing; repeated rows give
    one pair.  Items too many for one broadcast of seed hashes are searched in blocks.
    """
    out = None
    for block in _blocks(items.select(F.col(item_key).alias("i"), F.col(passage).alias("p")).filter("p is not null"), "p"):
        part = _search(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null"), block)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("k").alias(key), F.col("i").alias(item_key), "stretch", "coverage", "leak")


def _search(docs: DataFrame, items: DataFrame) -> DataFrame:
    def code_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for b in batches:
            rows = []
            for i, p in zip(b["i"], b["p"]):
                toks = tokens(p)
                ids, chars = hashes.of(toks), _is_unspaced(toks)
                rows.append((i, ids, chars, np.unique(rolling(ids, SEED_CHARS if chars else SEED_WORDS))))
            yield pd.DataFrame(rows, columns=["i", "item", "chars", "seeds"])

    kind = items.schema["i"].dataType.simpleString()
    coded = cut(items.distinct().mapInPandas(code_items, f"i {kind}, item array<bigint>, chars boolean, seeds array<bigint>"))
    seeds = coded.select("i", F.explode("seeds").alias("hit"))
    wanted = np.sort(seeds.select("hit").distinct().toPandas()["hit"].to_numpy(dtype=np.int64))  # 8 bytes a token of BLOCK_CHARS
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, hashes = shared.value, _Hashes()
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"]) if len(known) else ():
                ids = hashes.of(tokens(t))
                both = np.concatenate([rolling(ids, SEED_WORDS), rolling(ids, SEED_CHARS)])
                both = both[known[np.minimum(np.searchsorted(known, both), len(known) - 1)] == both]
                if len(both) >= LEAST_WINDOWS:
                    hits, n = np.unique(both, return_counts=True)
                    out.append((k, ids, hits, n))
            yield pd.DataFrame(out, columns=["k", "doc", "hits", "n"])

    schema = f"k {docs.schema['k'].dataType.simpleString()}, doc array<bigint>, hits array<bigint>, n array<bigint>"
    coded_docs = cut(docs.mapInPandas(code, schema).withColumn("uid", F.xxhash64("k", "doc")))
    windows = coded_docs.select("uid", "k", F.explode(F.arrays_zip("hits", "n")).alias("w")).select("uid", "k", F.col("w.hits").alias("hit"), F.col("w.n").alias("n"))
    pairs = windows.join(seeds, "hit").groupBy("uid", "k", "i").agg(F.sum("n").alias("shared")).filter(F.col("shared") >= LEAST_WINDOWS)
    texts = coded_docs.select("uid", F.col("k").alias("k2"), "doc").dropDuplicates(["uid", "k2"])
    together = pairs.alias("x").join(texts.alias("y"), (F.col("x.uid") == F.col("y.uid")) & F.col("x.k").eqNullSafe(F.col("y.k2")))
    together = together.join(coded.select("i", "item", "chars"), "i")

    @F.pandas_udf("stretch long, coverage double, chars boolean")
    def tile(doc: pd.Series, item: pd.Series, chars: pd.Series) -> pd.DataFrame:
        out = []
        for d, p, c in zip(doc, item, chars):
            d, p, k = np.asarray(d), np.asarray(p), SEED_CHARS if c else SEED_WORDS
            found = tiles(d, p, k)
            out.append((longest_stretch(found, d, p, 4 if c else 1), sum(n for _, _, n in found) / max(1, len(p)), c))
        return pd.DataFrame(out, columns=["stretch", "coverage", "chars"])

    scored = together.select("k", "i", F.size("item").alias("size"), tile("doc", "item", "chars").alias("s"))
    least = F.when(F.col("s.chars"), F.lit(LEAST_CHARS)).otherwise(F.lit(LEAST_WORDS))
    leak = F.when(F.col("s.stretch") >= least, F.lit("stretch")).when((F.col("s.coverage") >= COVERED) & (F.col("size") >= least), F.lit("reordered"))
    best = scored.withColumn("leak", leak).filter("leak is not null").groupBy("k", "i")
    return best.agg(F.max("s.stretch").alias("stretch"), F.max("s.coverage").alias("coverage"), F.max("leak").alias("leak"))  # stretch is the greater word
