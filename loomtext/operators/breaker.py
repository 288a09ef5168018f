"""The breaker of each service, replayed over a log of calls, as a table or as a stream.

A breaker opens after `failures` failures in a row or at once when the service is busy; calls within `cool_down` seconds are
skipped, and the first call after that finds it closed, without failures. A success forgets the failures before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.scratch import PART, in_ranges

ADDED = ("attempted", "failures", "open_until", "opened")
_ORDER = ("service", "ts", "seq", "outcome")


@dataclass(frozen=True)
class Rule:
    failures: int = 3
    cool_down: int = 300

    @property
    def micros(self) -> int:
        return self.cool_down * 1_000_000


def step(failures: int, until: int | None, ts: int, outcome: str | None, rule: Rule) -> tuple[bool, int, int | None, bool]:
    """One call at ts (microseconds): whether it is made, then failures in a row, end of the pause, and whether this call opened it."""
    if until is not None:
        if ts < until:
            return False, failures, until, False
        failures = 0
    if outcome == "ok":
        return True, 0, None, False
    failures += outcome != "busy"
    opened = outcome == "busy" or failures >= rule.failures
    return True, failures, ts + rule.micros if opened else None, opened


def replay(calls: DataFrame, rule: Rule = Rule(), parts: int | None = None) -> DataFrame:
    """Each call with whether the breaker let it pass (attempted), and the state after it (failures, open_until, opened).

    calls: service, seq, ts, outcome (ok, busy; all else, and null, is a failure), and any others; columns named as the added ones are
    replaced. Order is ts, seq, outcome. A null service is a service; calls without a time change nothing and get nulls.

    No service needs one task: the log is cut by range into parts. Each part says how it would leave its first service for every
    state in which it could get it (one row a state and, after merging equal ones, a span of pause ends); one ordered pass over
    these rows gives every part's true start; then the parts are replayed side by side.
    """
    x = calls.drop(*ADDED)
    timed = x.where("ts is not null")
    keys = [F.col(c).asc_nulls_first() for c in _ORDER]
    table = in_ranges(timed, keys, parts)
    kind = x.schema["service"].dataType
    ordered = lambda d: (d.repartition(parts, PART) if parts else d.repartition(PART)).sortWithinPartitions(PART, *keys)
    exits = T.StructType([T.StructField("service", kind)]).add("part", "integer").add("first", "boolean").add("kind", "integer").add("value", "long").add("failures", "integer").add("until", "long")
    spans = ordered(table.select(PART, *_ORDER)).mapInArrow(_spans(rule), exits)
    order = [F.col(c).asc_nulls_first() for c in ("service", "part", "kind", "value")]
    starts = spans.repartition("service").sortWithinPartitions(*order).mapInArrow(_walk, "part int, failures int, until long")
    known = {r["part"]: (r["failures"], r["until"]) for r in starts.collect()}  # at most a row for each part of the shuffle
    out = T.StructType([*x.schema.fields, T.StructField("attempted", T.BooleanType()), T.StructField("failures", T.IntegerType()), T.StructField("open_until", x.schema["ts"].dataType), T.StructField("opened", T.BooleanType())])
    done = ordered(table).mapInArrow(_states(known, rule), out)
    untimed = x.where("ts is null").withColumns({f.name: F.lit(None).cast(f.dataType) for f in out.fields[-4:]})
    return done.unionAll(untimed)


def _runs(parts: list, services: list) -> Iterator[tuple[int, int]]:
    """Stretches of one part and service."""
    a = 0
    for k in range(1, len(parts) + 1):
        if k == len(parts) or parts[k] != parts[a] or services[k] != services[a]:
            yield a, k
            a = k


def exits(ts: np.ndarray, bad: np.ndarray, busy: np.ndarray, rule: Rule, whole: bool) -> list[tuple[int, int, int, int | None]]:
    """How calls of one service leave its breaker: (0, failures, ...) for a closed one, (1, last pause end, ...) for spans of pause ends.

    Without `whole`, only for a closed breaker without failures. A pause beyond all calls has no row: it stays.
    """
    m, n = len(ts), rule.failures
    k = np.arange(m)
    row = k - np.maximum.accumulate(np.where(bad, -1, k))  # failures in a row up to each call
    full, quick = np.flatnonzero(row >= n), np.flatnonzero(busy)
    after = lambda hits, at: np.append(hits, m)[np.searchsorted(hits, at)]
    opens = np.minimum(after(full, k + n - 1), after(quick, k))  # call that opens a breaker which was closed before call k
    again = np.full(m, m)
    hit = opens < m
    again[hit] = np.maximum(np.searchsorted(ts, ts[opens[hit]] + rule.micros), opens[hit] + 1)
    last = np.where(again < m, np.minimum(again, m - 1), k)
    while not np.array_equal(last, last[last]):
        last = last[last]

    def leave(start: int, before: int = 0) -> tuple[int, int | None]:
        """State after all calls if the breaker is closed at call `start`, which `before` failures precede."""
        e = int(last[start])
        j = int(opens[e])
        if j == m:
            return int(min(row[m - 1], m - e)), None
        count = n
        if busy[j]:
            count = min(int(row[j - 1]), j - e) if j > e else 0
            count += before if e == start and count == j - e else 0
        return count, int(ts[j]) + rule.micros

    out = [(0, 0, *leave(0))]
    if not whole:
        return out
    for f in range(1, n):
        j = n - f - 1
        if j < m and row[j] == j + 1:
            nxt = max(int(np.searchsorted(ts, ts[j] + rule.micros)), j + 1)
            out.append((0, f, *(leave(nxt) if nxt < m else (n, int(ts[j]) + rule.micros))))
        elif row[m - 1] == m:
            out.append((0, f, f + m, None))
        else:
            out.append((0, f, *leave(0, f)))
    reach = int(np.searchsorted(ts, ts[0] + rule.micros)) + 1
    pieces: list[tuple] = []
    for s in range(min(reach, m)):
        one = (1, int(ts[s]), *leave(s))
        if pieces and pieces[-1][1] == one[1]:
            continue  # a pause that ends at this time ends before the first of its calls
        if pieces and pieces[-1][2:] == one[2:]:
            pieces.pop()
        pieces.append(one)
    return out + pieces


def _spans(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the current stretch: part, service, its place in the part, columns
        kind = None

        def rows(last: bool) -> list[tuple]:
            part, service, first, cols = held[0]
            if not (first or last):
                return []
            ts, bad, busy = (np.concatenate(c) for c in zip(*cols))
            return [(service, part, first, *e) for e in exits(ts, bad, busy, rule, first)]

        def packed(found: list[tuple]) -> pa.RecordBatch:
            kinds = (kind, pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["service", "part", "first", "kind", "value", "failures", "until"])

        for b in batches:
            kind = b.column("service").type
            parts, services = b.column(PART).to_pylist(), b.column("service").to_pylist()
            ts = b.column("ts").cast(pa.int64()).to_numpy(zero_copy_only=False)
            said = b.column("outcome").to_pylist()
            busy = np.array([o == "busy" for o in said], dtype=bool)
            bad = np.array([o not in ("ok", "busy") for o in said], dtype=bool)
            for a, z in _runs(parts, services):
                if held and (held[0][0], held[0][1]) != (parts[a], services[a]):
                    found = rows(held[0][0] != parts[a])
                    if found:
                        yield packed(found)
                    first = held[0][0] != parts[a]
                    held.clear()
                else:
                    first = True
                if not held:
                    held.append((parts[a], services[a], first, []))
                held[0][3].append((ts[a:z], bad[a:z], busy[a:z]))
        if held:
            yield packed(rows(True))

    return run


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States in which parts get their first service, where it isn't a closed breaker without failures."""
    at, service, failures, until, moved = None, None, 0, None, True
    for b in batches:
        found = []
        for r in b.to_pylist():
            if at is None or (r["service"], r["part"]) != (service, at):
                if at is None or r["service"] != service:
                    failures, until = 0, None
                at, service, moved = r["part"], r["service"], False
                if r["first"] and (failures or until is not None):
                    found.append((at, failures, until))
            if not moved and (r["kind"] == 0 and r["value"] == failures if until is None else r["kind"] == 1 and r["value"] >= until):
                failures, until, moved = r["failures"], r["until"], True
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.int64()))], names=["part", "failures", "until"])


def _states(starts: dict[int, tuple[int, int | None]], rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = service = None
        state: tuple[int, int | None] = (0, None)
        for b in batches:
            kind, out = b.column("ts").type, []
            for p, s, t, o in zip(b.column(PART).to_pylist(), b.column("service").to_pylist(), b.column("ts").cast(pa.int64()).to_pylist(), b.column("outcome").to_pylist()):
                if p != part:
                    state = starts.get(p, (0, None))
                elif s != service:
                    state = (0, None)
                part, service = p, s
                made, failures, until, opened = step(*state, t, o, rule)
                state = (failures, until)
                out.append((made, failures, until, opened))
            made, failures, until, opened = zip(*out) if out else ((),) * 4
            keep = [n for n in b.schema.names if n != PART]
            cols = [b.column(n) for n in keep] + [pa.array(made, pa.bool_()), pa.array(failures, pa.int32()), pa.array(until, pa.int64()).cast(kind), pa.array(opened, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *ADDED])

    return run


class _Live(StatefulProcessor):
    def __init__(self, rule: Rule) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", T.StructType().add("failures", "integer").add("until", "long"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        failures, until = self.state.get() if self.state.exists() else (0, None)
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"], r["outcome"] or "")):
            made, failures, until, opened = step(failures, until, r["at"], r["outcome"], self.rule)
            if opened:
                self.handle.registerTimer(-(-until // 1000))
            yield Row(service=key[0], seq=r["seq"], at=r["at"], attempted=made, failures=failures, until=until, opened=opened)
        self.state.update((failures, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A pause has ended: one row without a call; the state is dropped if no later call changed it."""
        end = expiredTimerInfo.getExpiryTimeInMs()
        failures, until = self.state.get() if self.state.exists() else (0, None)
        if until is not None and -(-until // 1000) == end:
            self.state.clear()
        yield Row(service=key[0], seq=None, at=end * 1000, attempted=None, failures=0, until=None, opened=False)


def live(calls: DataFrame, rule: Rule = Rule(), late: str = "0 seconds") -> DataFrame:
    """As `replay`, over a stream (service, seq, ts, outcome): a row for each call, and one without seq when a pause has ended.

    State is two numbers a service, kept in the RocksDB state store, which the session must name; pauses end by event-time timers.
    Calls of a service are ordered within a micro-batch; those that come in a later one follow the state that is then.
    """
    x = calls.where("ts is not null").select("service", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "outcome").withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    out = T.StructType([x.schema["service"]]).add("seq", "long").add("at", "long").add("attempted", "boolean").add("failures", "integer").add("until", "long").add("opened", "boolean")
    y = x.groupBy("service").transformWithState(_Live(rule), out, "Append", "EventTime")
    return y.select("service", "seq", F.timestamp_micros("at").alias("ts"), "attempted", "failures", F.timestamp_micros("until").alias("open_until"), "opened")
