"""Many patterns in one scan: which of a list of strings stand in each row's text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

#: Automata of this worker, by the name of their scan: one is built for all its tasks. Only the last scan's are kept.
_built: dict[str, list] = {}


def build(patterns: list[str | None]) -> tuple[ahocorasick.Automaton | None, list[list[int]], list[int]]:
    """The automaton of the distinct patterns, the places of each in the list, and the places of empty ones (null: no pattern)."""
    places: dict[str, list[int]] = {}
    for k, p in enumerate(patterns):
        if p is not None:
            places.setdefault(p, []).append(k)
    everywhere = places.pop("", [])
    if not places:
        return None, [], everywhere
    found = ahocorasick.Automaton()
    for n, p in enumerate(places):
        found.add_word(p, n)
    found.make_automaton()
    return found, list(places.values()), everywhere


def standing(automaton: ahocorasick.Automaton | None, places: list[list[int]], everywhere: list[int], text: str | None) -> set[int]:
    """Places of the patterns that stand in the text."""
    if text is None:
        return set()
    out = set(everywhere)
    if automaton is not None:
        for n in {n for _, n in automaton.iter(text)}:
            out.update(places[n])
    return out


def scan(rows: DataFrame, patterns: list[tuple[Column, list[str | None]]], out: str) -> DataFrame:
    """rows with `out`: places (ascending) of the patterns that stand in their texts, by text column. All lists have one length, which
    the caller has bounded: they are broadcast."""
    wanted = [(t, p) for t, p in patterns if any(x is not None for x in p)]
    name, kept, texts = uuid.uuid4().hex, rows.columns, [f"_text{k}" for k in range(len(wanted))]
    lists = rows.sparkSession.sparkContext.broadcast([p for _, p in wanted])
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = [build(p) for p in lists.value]
        for b in batches:
            found: list[set[int]] = [set() for _ in range(b.num_rows)]
            for t, built in zip(texts, _built[name]):
                for k, text in enumerate(b.column(t).to_pylist()):
                    found[k] |= standing(*built, text)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([sorted(f) for f in found], pa.list_(pa.int32()))], names=schema.names)

    return rows.withColumns({n: t for n, (t, _) in zip(texts, wanted)}).mapInArrow(run, schema)
