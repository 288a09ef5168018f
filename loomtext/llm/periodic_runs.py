"""Periodic runs of words: Main-Lorentz divide and conquer on interned word ids.

A text's words are halved again and again. A run that crosses a midpoint reaches two periods into one of the halves (three
words for period 1), so it shows as a place where the half, read away from the midpoint, agrees with itself one period on:
the half's Z-function tells for how long. What is found is extended over the midpoint and kept by the smallest node that holds it.

All texts of a batch go through one level of halving together: numpy rules out the (midpoint, period) pairs that differ in one
of a few words, which is nearly all of them; Z-functions are computed for the midpoints that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import PASS_BYTES, fresh, passes, raw_texts

#: A run has as many words at least, and as many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
RUNS = T.ArrayType(RUN, False)
GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts (bytes, offsets) one after the other, and offsets of each text's words."""
    inside = ~GAP[raw]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    begins = off[:-1][off[:-1] < len(raw)]
    before[begins] = False
    starts = np.flatnonzero(inside & ~before)
    upto = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(inside, out=upto[1:])
    offsets = np.append(upto[starts], upto[-1])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return words, np.searchsorted(starts, off)


def z_function(x: list[int]) -> list[int]:
    """z[i]: the length of the longest common beginning of x and x[i:] (z[0]: all)."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and x[k] == x[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements a and b share, compared in growing pieces."""
    n, at, piece = min(len(a), len(b)), 0, 64
    while at < n:
        end = min(n, at + piece)
        differ = np.flatnonzero(a[at:end] != b[at:end])
        if len(differ):
            return at + int(differ[0])
        at, piece = end, piece * 2
    return n


def candidates(ids: np.ndarray, mid: np.ndarray, reach: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, period) pairs whose half may begin with two periods: some of its words agree one period on.

    way 1: the halves ids[mid : mid + reach]; way -1: ids[mid - reach : mid] read backwards.
    """
    many = np.where(reach >= 3, np.maximum(reach // 2, 1), 0)
    node = np.repeat(np.arange(len(mid)), many)
    period = np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many) + 1
    origin = mid if way == 1 else mid - 1
    # a half reads origin, origin + way, ...; period 1 needs two agreements, period q needs q
    for share in (0.0, 1.0, 0.5, 0.25, 0.75):
        k = ((np.maximum(period, 2) - 1) * share).astype(np.int64)
        k[period == 1] = int(share > 0)
        at = origin[node] + way * k
        fine = ids[at] == ids[at + way * period]
        node, period = node[fine], period[fine]
        if not len(node):
            break
    return node, period


def crossing(ids: np.ndarray, low: int, left: int, mid: int, right: int, high: int, periods: np.ndarray, way: int, found: dict[tuple[int, int], int]) -> None:
    """Runs that reach two periods from mid into one half of the node [left, right) of the text [low, high), put into found."""
    half = ids[mid:right] if way == 1 else ids[left:mid][::-1]
    rest = ids[left:mid][::-1] if way == 1 else ids[mid:right]
    z = z_function(half.tolist())
    known: list[tuple[int, int]] = []  # periods that are not multiples of another, and how far into the half they last
    for q in periods.tolist():
        if z[q] < max(q, 2 if q == 1 else q) or any(q % p == 0 and 2 * q <= far for p, far in known):
            continue
        far = q + z[q]
        known.append((q, far))
        # over the midpoint: the rest read away from it, against what lies one period into the half
        back = half[q - 1 :: -1]
        near = agreeing(rest, back)
        if near == len(back) < len(rest):
            near += agreeing(rest[near:], rest)
        start, end = (mid - near, mid + far) if way == 1 else (mid - far, mid + near)
        if end - start < max(LEAST_WORDS, LEAST_PERIODS * q):
            continue
        # what goes on beyond the node belongs to a larger one
        if (start == left > low and ids[left - 1] == ids[left - 1 + q]) or (end == right < high and ids[right] == ids[right - q]):
            continue
        found[start, end] = min(q, found.get((start, end), q))


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, end, period) of all runs; ids of all texts' words, and the offsets of each text in them."""
    text = np.flatnonzero(np.diff(bounds) >= LEAST_WORDS)
    left, right = bounds[text], bounds[text + 1]
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(len(bounds) - 1)]
    while len(text):
        mid = (left + right) // 2
        for way, reach in ((1, right - mid), (-1, mid - left)):
            node, period = candidates(ids, mid, reach, way)
            cuts = np.flatnonzero(np.diff(node)) + 1
            for part, periods in zip(np.split(node, cuts), np.split(period, cuts)):
                if len(part):
                    k = int(part[0])
                    t = int(text[k])
                    crossing(ids, int(bounds[t]), int(left[k]), int(mid[k]), int(right[k]), int(bounds[t + 1]), periods, way, found[t])
        text, left, right = np.concatenate([text, text]), np.concatenate([left, mid]), np.concatenate([mid, right])
        large = right - left >= LEAST_WORDS
        text, left, right = text[large], left[large], right[large]
    return [(t, s, e, q) for t, runs in enumerate(found) for s, e, q in sorted((s, e, q) for (s, e), q in runs.items())]


def _joined(words: pa.Array, kept: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The kept words of each text joined by one space."""
    values = words if len(kept) == len(words) else words.take(pa.array(kept))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), values), pa.scalar(b" ", pa.large_binary()))


def _pass(raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Words, runs and collapsed text of each text."""
    words, bounds = words_of(raw, off)
    n = np.diff(bounds)
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int32)
    runs = runs_of(ids, bounds)
    change = np.zeros(len(words) + 1, np.int64)
    for _, s, e, q in runs:
        change[s + q] += 1
        change[e] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    text = np.array([r[0] for r in runs], np.int64)
    table = np.array([r[1:] for r in runs], np.int64).reshape(-1, 3)
    counts = np.bincount(text, minlength=len(n))
    fields = [table[:, 0] - bounds[text], table[:, 1] - table[:, 0], table[:, 2]]
    structs = pa.StructArray.from_arrays([pa.array(f) for f in fields], fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    listed = pa.ListArray.from_arrays(offsets, structs)
    return pa.array(n.astype(np.int64)), listed, _joined(words, kept, np.diff(np.searchsorted(kept, bounds)))


def find(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with n_words, runs (start, length, period; by start, then period) and collapsed; {name: column}.

    A run is a stretch of words, at least six and four periods long, that repeats with a smallest period and that no neighbouring
    word extends. collapsed: the words without those that any run holds after its first period, joined by one space. Null and
    wordless texts have no runs and collapse to the empty text. Rows are judged alone: repeated ones alike, nothing is shuffled. A text
    of any length is one row of one task, in n log n steps and about 60 bytes of memory a word.
    """
    names = dict(zip(("n_words", "runs", "collapsed"), fresh(docs, "n_words", "runs", "collapsed")))
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(names["n_words"], T.LongType()), T.StructField(names["runs"], RUNS), T.StructField(names["collapsed"], T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = raw_texts(batch.column(place))
            for i, j in passes(off, PASS_BYTES):
                piece = batch.slice(i, j - i)
                n, listed, joined = _pass(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([*piece.columns, n, listed, joined.cast(pa.large_string())], names=schema.names)

    return docs.mapInArrow(run, schema), names

