"""Counts over the words of whole Arrow batches: one pass over the bytes, one look at each distinct word. Words and spaces are those of text.py (\\S+, \\s)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

#: Texts of a batch are taken in runs of about so many bytes, at least one text each, so that memory follows the run, not the batch.
RUN_BYTES = 1 << 20
SPACE, MARK, OPENED, DIGIT = (np.isin(np.arange(256), list(chars)) for chars in (b" \t\n\x0b\f\r", b".,;:!?", b"([", b"0123456789"))


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an array of strings, and where each one starts and the last one ends."""
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)])


def lower(words: pa.Array) -> pa.Array:
    """Words in lower case as Java and Python have it: Arrow knows neither the two letters that İ becomes nor the sigma at a word's end."""
    out, special = pc.utf8_lower(words), pc.or_(pc.match_substring(words, "İ"), pc.match_substring(words, "Σ"))
    return pc.replace_with_mask(out, special, pa.array([w.lower() for w in words.filter(special).to_pylist()], words.type)) if pc.any(special).as_py() else out


class Words:
    """The words of an array of texts without nulls: row and distinct number of each, in order; bytes and places of the texts."""

    def __init__(self, texts: pa.Array):
        self.rows, (self.data, self.at) = len(texts), _flat(texts)
        space = SPACE[self.data]
        first, last = np.ones(len(space), bool), np.ones(len(space), bool)
        first[1:], last[:-1] = space[:-1], space[1:]
        there = np.diff(self.at) > 0  # texts end words
        first[self.at[:-1][there]] = last[self.at[1:][there] - 1] = True
        self.start, self.end = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
        self.n = self.per_text(self.start)
        self.row = np.repeat(np.arange(self.rows), self.n)
        coded = _strings(self.data[~space], np.append(0, np.cumsum(self.end - self.start))).dictionary_encode()
        self.distinct, self.word = coded.dictionary, coded.indices.to_numpy()
        heads = pc.utf8_slice_codeunits(self.distinct, 0, 1).dictionary_encode()
        self.capital = np.array([unicodedata.category(c) == "Lu" for c in heads.dictionary.to_pylist()], bool)[heads.indices.to_numpy()]

    def per_text(self, places: np.ndarray) -> np.ndarray:
        """How many of these sorted places are in each text."""
        return np.diff(np.searchsorted(places, self.at))

    def chars(self, wanted: np.ndarray) -> np.ndarray:
        """How many of these (ASCII) characters are in each text."""
        return self.per_text(np.flatnonzero(wanted[self.data]))

    def sentences(self) -> np.ndarray:
        """Population deviation of the numbers of words between ". "; NaN for a single part."""
        inside = self.end < self.at[1:][self.row]
        ends = np.zeros(len(self.start), bool)
        ends[inside] = (self.data[self.end[inside] - 1] == 46) & (self.data[self.end[inside]] == 32)
        parts = np.bincount(self.row[ends], minlength=self.rows) + 1
        row = np.repeat(np.arange(self.rows), parts)
        part, counted = self.row + np.cumsum(ends) - ends, ~(ends & (self.end - self.start == 1))  # a lone point is no word of its part
        n = np.bincount(part[counted], minlength=len(row)).astype(float)
        mean = np.bincount(row, n, self.rows) / parts
        return np.where(parts > 1, np.sqrt(np.bincount(row, (n - mean[row]) ** 2, self.rows) / parts), np.nan)

    def repeated(self, group: np.ndarray, low: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group and number of the words that stand in each group of texts, in order, and how often they do. low, chosen: coded lower-cased distinct words, and which of the distinct ones count."""
        there, size = chosen[self.word], max(1, len(low.dictionary))
        key = group[self.row[there]] * size + low.indices.to_numpy()[self.word[there]]
        key.sort()
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
        return *np.divmod(key[at], size), np.diff(np.append(at, len(key)))


def _lists(row: np.ndarray, values: pa.Array, rows: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), values.cast(pa.string()))


def _runs(at: np.ndarray, *columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of all columns whose texts have about RUN_BYTES. at: where texts start and the last one ends."""
    k = 0
    while k < len(at) - 1:
        to = max(k + 1, int(np.searchsorted(at, at[k] + RUN_BYTES, "right")) - 1)
        yield tuple(c.slice(k, to - k) for c in columns)
        k = to


def _structs(runs: list[pa.Array], kind: pa.StructType, nulls: pa.Array) -> pa.Array:
    """All runs as one array, null where the text is."""
    out = pa.concat_arrays(runs) if runs else pa.array([], kind)
    return pa.StructArray.from_arrays(out.flatten(), fields=list(kind), mask=nulls.cast(pa.bool_()))


SOURCE = pa.struct({"words": pa.int32(), "capitals": pa.list_(pa.string()), "opened": pa.int32(), "digits": pa.bool_()})
COUNTS = pa.struct({**dict.fromkeys(("words", "capitals", "most", "marks", "opened"), pa.int32()), "spread": pa.float64(), "kept": pa.int32()})
LISTS = pa.list_(pa.string())


def _source(texts: pa.Array) -> pa.Array:
    w = Words(texts)
    key = np.unique((w.row * max(1, len(w.distinct)) + w.word)[w.capital[w.word]])
    row, word = np.divmod(key, max(1, len(w.distinct)))
    capitals = _lists(row, w.distinct.take(pa.array(word)), w.rows)
    return pa.StructArray.from_arrays([pa.array(w.n, pa.int32()), capitals, pa.array(w.chars(OPENED), pa.int32()), pa.array(w.chars(DIGIT) > 0)], fields=list(SOURCE))


def _counts(texts: pa.Array, wanted: pa.Array) -> pa.Array:
    w = Words(texts)
    row, _, n = w.repeated(np.arange(w.rows), lower(w.distinct).dictionary_encode(), pc.utf8_length(w.distinct).to_numpy() >= 4)
    most = np.zeros(w.rows, np.int64)
    np.maximum.at(most, row, n)
    there = w.capital[w.word]
    row, word = w.row[there], w.word[there]
    # wanted words by the numbers that distinct capitalised words have here: one without a number is in no text of this run
    size, lists = max(1, len(w.distinct)), pc.list_parent_indices(wanted).to_numpy()
    ids = np.flatnonzero(w.capital)
    number = pc.index_in(pc.list_flatten(wanted).cast(w.distinct.type), value_set=w.distinct.take(pa.array(ids)))
    known = number.is_valid().to_numpy(zero_copy_only=False)
    lists = lists[known]
    kept = np.isin(lists * size + ids[number.drop_null().to_numpy()], row * size + word)
    ints = (w.n, np.bincount(row, minlength=w.rows), most, w.chars(MARK), w.chars(OPENED))
    return pa.StructArray.from_arrays([*(pa.array(a, pa.int32()) for a in ints), pa.array(w.sentences(), from_pandas=True), pa.array(np.bincount(lists[kept], minlength=w.rows), pa.int32())], fields=list(COUNTS))


def _often(lists: pa.Array) -> pa.Array:
    """Lists without nulls, of texts without nulls."""
    w = Words(_texts(pc.list_flatten(lists)))
    words = lower(w.distinct)
    low = words.dictionary_encode()
    row, word, n = w.repeated(pc.list_parent_indices(lists).to_numpy(), low, pc.utf8_length(words).to_numpy() >= 5)
    return _lists(row[n > 1], low.dictionary.take(pa.array(word[n > 1])), len(lists))


def _texts(texts: pa.Array) -> pa.Array:
    """Empty texts for nulls; malformed bytes become replacement characters, as in Java."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        texts = pa.array([t.decode(errors="replace") for t in texts.cast(pa.large_binary()).to_pylist()], texts.type)
    return texts


@F.arrow_udf(from_arrow_type(SOURCE))
def source_words(texts: pa.Array) -> pa.Array:
    """Number of words, the distinct capitalised ones, number of opened brackets, and whether there are digits; null for null."""
    x = _texts(texts)
    return _structs([_source(run) for run, in _runs(_flat(x)[1], x)], SOURCE, texts.is_null())


@F.arrow_udf(from_arrow_type(COUNTS))
def text_counts(texts: pa.Array, wanted: pa.Array) -> pa.Array:
    """Numbers of words, capitalised ones, the most frequent word of four characters or more in any case (0: none), punctuation marks and opened brackets; the
    deviation of sentence lengths in words (null: one sentence); how many of the distinct words `wanted` are capitalised words of the text. Null for null."""
    x = _texts(texts)
    return _structs([_counts(*run) for run in _runs(_flat(x)[1], x, wanted)], COUNTS, texts.is_null())


@F.arrow_udf(from_arrow_type(LISTS))
def repeated_words(lists: pa.Array) -> pa.Array:
    """Lower-cased words of five characters or more that stand twice or more in a list of texts; null for null, and where a text is null."""
    inner = pc.list_flatten(lists)
    null = np.append(0, np.cumsum(inner.is_null().to_numpy(zero_copy_only=False)))
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))
    whole = (np.diff(null[ends]) == 0) & lists.is_valid().to_numpy(zero_copy_only=False)
    x = pc.if_else(pa.array(whole), lists, pa.scalar([], lists.type))
    at = _flat(pc.fill_null(pc.list_flatten(x), ""))[1][np.append(0, np.cumsum(pc.list_value_length(x).to_numpy()))]
    out = pa.concat_arrays([_often(run) for run, in _runs(at, x)] or [pa.array([], LISTS)])
    return pc.if_else(pa.array(whole), out, pa.scalar(None, LISTS))
