"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all test items.

Texts are lower-cased (A-Z), cut into words of digits, letters and non-ASCII bytes and joined by single
spaces, so a window of words is a string and the automaton finds every occurrence in one scan. Ends of
occurrences lead to word numbers, and these to byte offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, materialize, raw_texts

WINDOW = 10
#: UTF-8 bytes of item text that one automaton takes; a larger benchmark takes as many scans, one after the other.
BLOCK_BYTES = 8 << 20
#: ASCII: digits and small letters stand for themselves, capitals for small letters, all else for a space.
NORMAL = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows_of(text: str | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    w = words_of((text or "").encode())
    return [tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []


class Automaton:
    """Finds windows in texts. Windows are kept as ' w1 w2 ... wn ' so that matches hold whole words."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = WINDOW):
        import ahocorasick

        owners: dict[tuple[bytes, ...], list] = defaultdict(list)
        for item, text in items:
            for w in dict.fromkeys(windows_of(text, size)):
                owners[w].append(item)
        self.machine = ahocorasick.Automaton()
        for w, ids in owners.items():
            self.machine.add_word((b" " + b" ".join(w) + b" ").decode("latin-1"), (len(w), ids))
        self.any = bool(owners)
        if self.any:
            self.machine.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list]:
        """Words in text; runs [first, last] of hit words, in order; items with occurring windows."""
        words = words_of(text)
        if not words or not self.any:
            return len(words), [], []
        line = b" " + b" ".join(words) + b" "
        found = list(self.machine.iter(line.decode("latin-1")))
        if not found:
            return len(words), [], []
        ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)  # the k-th word ends before the (k+1)-th space
        last = np.searchsorted(ends, [e for e, _ in found]) - 1
        runs: list[list[int]] = []
        for a, b in sorted((e - v[0] + 1, e) for e, (_, v) in zip(last.tolist(), found)):
            if runs and a <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        return len(words), [(a, b) for a, b in runs], list({i for _, v in found for i in v[1]})


def offsets(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets [start, end) in the original text of runs of words."""
    if not runs:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b][1]) for a, b in runs]


def blocks(benchmark: DataFrame, item_id: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items, in blocks whose size is measured before they come to the driver."""
    total = benchmark.agg(F.sum(F.coalesce(F.octet_length(col(text)), F.lit(0)) + 64)).first()[0] or 0
    n = max(1, -(-2 * total // limit)) if total > limit else 1
    part = F.pmod(F.xxhash64(col(item_id), col(text)), F.lit(n))
    for k in range(n):
        rows = benchmark.select(col(item_id), col(text))
        yield [tuple(r) for r in (rows if n == 1 else rows.where(part == k)).collect()]


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_runs", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("spans", SPAN), T.StructField("items", T.ArrayType(T.StringType()))])


_machines: dict[str, Automaton] = {}


def _machine(shared, size: int) -> Automaton:
    """The broadcast block's automaton, built once in each worker; the one before goes."""
    name, items = shared.value
    if name not in _machines:
        _machines.clear()
        _machines[name] = Automaton(items, size)
    return _machines[name]


def _joined(runs: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, e in sorted(map(list, runs)):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return out


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, found: str = "found") -> DataFrame:
    """docs with a struct column `found`: n_words; hit_runs ([first, last] word numbers); spans (byte offsets in the
    original text); items (their ids as strings, sorted). A column of that name is replaced. No shuffle of docs.

    Null or wordless texts: no words, no hits. Items without words never occur; items of equal text all do; items without an id
    hit like others but aren't listed. Repeated rows come out alike. A benchmark beyond BLOCK_BYTES is scanned for block by block: one
    automaton is in memory at a time, and documents are written between two scans.
    """
    keep = [f for f in docs.schema.fields if f.name.lower() != found.lower()]
    docs = docs.select(*(col(f.name) for f in keep))
    schema = T.StructType([*keep, T.StructField(found, FOUND, False)])
    kind = pa.struct([("n_words", pa.int64()), ("hit_runs", pa.list_(pa.list_(pa.int64()))), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
    at, width = [f.name for f in keep].index(text), len(keep)

    def scan(x: DataFrame, items: list[tuple]) -> DataFrame:
        shared = x.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = _machine(shared, size)
            for batch in batches:
                b, off = raw_texts(batch.column(at))
                before = batch.column(width).to_pylist() if batch.num_columns > width else [None] * len(batch)
                rows = []
                for i, j, old in zip(off.tolist(), off[1:].tolist(), before):
                    raw = b[i:j].tobytes()
                    n, runs, ids = machine.scan(raw)
                    named = {str(k) for k in ids if k is not None}
                    if old:
                        runs, named = _joined([*old["hit_runs"], *runs]), named | set(old["items"])
                    rows.append({"n_words": n, "hit_runs": [list(r) for r in runs], "spans": [{"start": s, "end": e} for s, e in offsets(raw, runs)], "items": sorted(named)})
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(rows, kind)], names=schema.names)

        return x.mapInArrow(run, schema)

    given = blocks(benchmark, item_id, item_text)
    docs = scan(docs, next(given))
    for items in given:
        docs = scan(materialize(docs), items)
    return docs


def n_hit(found: str = "found"):
    """Hit words of the struct that find() makes."""
    return F.aggregate(F.col(f"{found}.hit_runs"), F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0] + 1)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
