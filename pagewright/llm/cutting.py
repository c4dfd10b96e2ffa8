"""Problem 9: cut oversized texts into pieces at natural boundaries, with overlap.

Per text: offsets of all tokens (their prefix sums are token numbers) and a
sorted array of boundaries; binary search finds the last boundary under the
limit, the next piece steps back by the overlap, and where a stretch has no
boundary the cut is hard.
"""

from __future__ import annotations

from collections.abc import Iterator

import functools
import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import token_count

SPACE, RUN, SINGLE = 0, 1, 2
# fixed values: marks after which a text may be cut, ends of sentences, what may close behind them
BOUNDARY_MARKS = "。！？；，、"
ENDS = ".!?…。！？"
CLOSERS = "\"'”’»)]」』"


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point under the size rule: white space, part of a run, a token of its own."""
    out = np.full(sys.maxunicode + 1, RUN, dtype=np.uint8)
    out[[i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == "P"]] = SINGLE
    out[[ord(c) for c in "$+<=>^`|~"]] = SINGLE
    out[0x4E00:0xA000] = SINGLE
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def _among(codes: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(codes, np.array([ord(c) for c in chars], dtype=codes.dtype))


def token_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of all tokens of a text given as code points."""
    kind = _classes()[codes]
    before, after = np.append(SPACE, kind[:-1]), np.append(kind[1:], SPACE)
    starts = np.flatnonzero((kind == SINGLE) | (kind == RUN) & (before != RUN))
    ends = np.flatnonzero((kind == SINGLE) | (kind == RUN) & (after != RUN)) + 1
    return starts, ends


def boundaries(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted offsets where a text may be cut, and which of them end a sentence or paragraph."""
    blank = _classes()[codes] == SPACE
    after_space = np.flatnonzero(blank & ~np.append(blank[1:], False)) + 1
    run_start = np.flatnonzero(blank & ~np.append(False, blank[:-1]))
    lines = np.append(0, np.cumsum(codes == 10))
    closing, ending = _among(codes, CLOSERS), _among(codes, ENDS)
    one, two = run_start - 1, run_start - 2
    strong = (one >= 0) & (ending[one] | closing[one] & (two >= 0) & ending[two]) | (lines[after_space] - lines[run_start] > 1)
    marks = np.flatnonzero(_among(codes, BOUNDARY_MARKS)) + 1
    full = marks[_among(codes[marks - 1], "。！？")]
    return np.union1d(after_space, marks), np.union1d(after_space[strong], full)


def cut_text(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int, bool]], bool]:
    """Pieces (start, end, size, whether its end is a hard cut) and whether an unbreakable stretch exceeds the limit.

    Boundaries are white space and the marks ``。！？；，、``; ends of paragraphs and sentences go first if one lies in
    the second half of the window.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts, ends = token_spans(codes)
    n = len(starts)
    if n == 0:
        return [], False
    # a boundary as the number of tokens before it; none lies inside a token
    marks, strong = (np.unique(np.append(np.searchsorted(starts, at), n)) for at in boundaries(codes))
    marks, strong = marks[marks > 0], strong[strong > 0]
    hard = bool(np.max(np.diff(np.concatenate([[0], marks]))) > limit)
    pieces, first, last = [], 0, 0
    while last < n:
        top = first + limit
        if top >= n:
            end, forced = n, False
        else:
            end, forced = top, True
            for bounds, least in ((strong, max(last, first + limit // 2)), (marks, last)):
                k = int(np.searchsorted(bounds, top, side="right")) - 1
                if k >= 0 and bounds[k] > least:
                    end, forced = int(bounds[k]), False
                    break
        pieces.append((int(starts[first]), int(ends[end - 1]), end - first, forced))
        last = end
        first = max(first + 1, end - overlap)
    return pieces, hard


def cut_documents(docs: DataFrame, limit: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_size, piece, start_pos, end_pos, size, hard_end, cut_kind) for texts above the limit.

    ``cut_kind`` is ``hard`` where a stretch without any boundary exceeds the limit, else ``soft``.  Texts within the
    limit, null and empty texts need no cut and give no rows.  Sizes are counted in the JVM first, so only oversized
    texts reach Python; repeated rows are cut each for itself.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    big = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), token_count(F.col(text)).alias("doc_size")).filter(F.col("doc_size") > limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, size in zip(b["k"], b["t"], b["doc_size"]):
                pieces, hard = cut_text(t, limit, overlap)
                rows += [(k, size, i, *p, "hard" if hard else "soft") for i, p in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["k", "doc_size", "piece", "start_pos", "end_pos", "size", "hard_end", "cut_kind"])

    kind = docs.schema[key].dataType.simpleString()
    out = big.mapInPandas(run, f"k {kind}, doc_size long, piece long, start_pos long, end_pos long, size long, hard_end boolean, cut_kind string")
    return out.withColumnRenamed("k", key)
