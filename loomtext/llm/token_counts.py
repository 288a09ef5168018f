"""Token counts with the whole-token shortcut.

Offline, `prove` finds the vocabulary strings that are one pre-token and come out as one token when they
stand alone. A text's pre-tokens that are such strings count one each; only the rest is merged.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .codec import FragmentCodec, codec
from .common import passes, raw_texts

#: Merged pre-tokens whose counts a worker remembers; it starts afresh beyond, which changes no result.
CACHE_ENTRIES = 400_000


def char_class(first: str) -> str:
    """The ranges of all code points whose general category starts with `first`, as the inside of a regex class."""
    out, start, last = [], None, None
    for c in range(sys.maxunicode + 2):
        if c <= sys.maxunicode and unicodedata.category(chr(c))[0] == first:
            start, last = (c if start is None else start), c
        elif start is not None:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def splitter() -> re.Pattern:
    """The byte-level pre-token pattern, in classes that Python's own engine has."""
    letter, number = char_class("L"), char_class("N")
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def prove(path: str) -> list[str]:
    """The vocabulary strings that are one pre-token and encode alone as their own single token."""
    c: FragmentCodec = codec(path)
    strings = []
    for i, b in enumerate(c.bytes_of):
        try:
            s = b.decode()
        except UnicodeDecodeError:
            continue
        if s and b not in c.specials and splitter().findall(s) == [s]:
            strings.append((s, i))
    coded = c.tok.encode_batch_fast([s for s, _ in strings], add_special_tokens=False)
    return [s for (s, i), e in zip(strings, coded) if e.ids == [i]]


class Counter:
    def __init__(self, path: str, proven: list[str]):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        c = codec(path)
        self.codec, self.specials = c, [s.decode() for s in c.specials]
        self.by_special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.known = dict.fromkeys(proven, 1)
        self.merged: dict[str, int] = {}
        self.find = splitter().findall

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens outside of special strings; how many special strings there are."""
        if self.by_special is None or not any(s in text for s in self.specials):
            return self.find(text), 0
        pieces = self.by_special.split(text)
        return [t for p in pieces for t in self.find(p)], len(pieces) - 1

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pretokens(t) for t in texts]
        rest = [p for p in set().union(*(s for s, _ in split)) if p not in self.known]
        missing = [p for p in rest if p not in self.merged]
        if missing:
            if len(self.merged) + len(missing) > CACHE_ENTRIES:
                self.merged.clear()
                missing = rest
            self.merged.update(dict(zip(missing, map(len, self.codec.merge(missing)))))
        extra = {m: self.merged[m] - 1 for m in rest}  # whole tokens count one each; the rest, what merging leaves
        return [len(s) + k + sum(map(extra.get, filter(extra.__contains__, s))) for s, k in split]


@lru_cache(maxsize=2)
def _counter(path: str, proven: tuple[str, ...]) -> Counter:
    return Counter(path, list(proven))


def count_tokens(docs: DataFrame, path: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """docs with a long column `n_tokens` for the whole `text` (null and empty: 0); a column of that name is replaced. No shuffle.

    The proven strings are broadcast; the vocabulary bounds them (tens of thousands of short strings).
    """
    proven = docs.sparkSession.sparkContext.broadcast(tuple(prove(path)))
    keep = [f for f in docs.schema.fields if f.name.lower() != n_tokens.lower()]
    schema = T.StructType([*keep, T.StructField(n_tokens, T.LongType(), False)])
    docs = docs.select(*(docs[f"`{f.name}`"] for f in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, proven.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            _, off = raw_texts(column)
            n = np.zeros(len(column), np.int64)
            for i, j in passes(off):
                n[i:j] = counter.count([t or "" for t in column.slice(i, j - i).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)
