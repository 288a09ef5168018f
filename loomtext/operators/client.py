"""A client for translation services: several requests at a time, retries, waits where a service is busy, and answers in order."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

Service = Callable[[str], str]


class Busy(Exception):
    """A service that asks to wait (HTTP 429)."""


def is_busy(error: Exception) -> bool:
    return isinstance(error, Busy) or "429" in str(error) or "Too Many Requests" in str(error)


@dataclass
class TokenBucket:
    """At most `rate` calls a second on average, `burst` at once; rate 0: no limit."""

    rate: float = 0.0
    burst: int = 1
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    #: When the bucket is full again.
    _full: float = field(init=False, default=0.0)
    _lock: Lock = field(init=False, default_factory=Lock, repr=False)

    def take(self) -> float:
        """Wait for the next call's turn; the seconds waited."""
        if self.rate <= 0:
            return 0.0
        with self._lock:
            now = self.clock()
            wait = max(0.0, self._full - (self.burst - 1) / self.rate - now)
            self._full = max(self._full, now) + 1 / self.rate
        if wait:
            self.sleep(wait)
        return wait


@dataclass(frozen=True)
class Policy:
    """in_flight: requests that a partition has open. retries: calls to a busy service for one text, waiting 2, 4, 6 ... seconds between.
    rate, burst: calls a second of a partition (0: any)."""

    in_flight: int = 5
    retries: int = 3
    wait: float = 2.0
    rate: float = 0.0
    burst: int = 1


@dataclass
class Answer:
    translation: str | None = None
    service: str | None = None
    calls: int = 0
    busy: int = 0
    waited: float = 0.0
    error: str | None = None


def ask(text: str, services: list[tuple[str, Service]], policy: Policy, bucket: TokenBucket, sleep: Callable[[float], None]) -> Answer:
    """The first service's answer that isn't empty. A busy service is asked again after a wait, any other error leads to the next one."""
    out = Answer()
    for name, call in services:
        for attempt in range(policy.retries):
            bucket.take()
            out.calls += 1
            try:
                found = call(text)
            except Exception as e:  # a service may raise anything
                out.error = f"{name}: {e}"
                if not is_busy(e):
                    break
                out.busy += 1
                pause = (attempt + 1) * policy.wait
                out.waited += pause
                sleep(pause)
                continue
            if found:
                out.translation, out.service, out.error = found, name, None
                return out
    out.error = out.error or "no service gave an answer"
    return out


def in_order(texts: Iterator[str], services: list[tuple[str, Service]], policy: Policy = Policy(), sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> Iterator[Answer]:
    """Answers in the order of the texts, with at most policy.in_flight of them open; a slow one holds back only so many."""
    bucket = TokenBucket(policy.rate, policy.burst, clock, sleep)
    open_: deque = deque()
    with ThreadPoolExecutor(max(1, policy.in_flight)) as pool:
        for t in texts:
            open_.append(pool.submit(ask, t, services, policy, bucket, sleep))
            if len(open_) >= policy.in_flight:
                yield open_.popleft().result()
        while open_:
            yield open_.popleft().result()


SCHEMA = "translation string, service string, calls int, busy int, waited double, error string"


def translate_concurrently(blocks: DataFrame, services: list[tuple[str, Service]], policy: Policy = Policy(), text: str = "source_text", out: str = "translated_text", clients: int = 0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """blocks with the services' answers to each distinct text, and service, calls, busy, waited and error of it.

    Every distinct text is asked once and handed to all its rows; blank texts pass unasked, a text that no service answers stays as it is.
    clients: partitions, each a client of its own; 0: as many as planned. Services and sleep run in Python workers.
    """
    todo = blocks.where(~tx.blank(text)).select(F.col(text).alias("asked")).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = list(in_order(iter(f["asked"]), services, policy, sleep))
            yield pd.DataFrame({"asked": f["asked"], **{c: [getattr(a, c) for a in got] for c in ("translation", "service", "calls", "busy", "waited", "error")}})

    answered = (todo.repartition(clients, "asked") if clients else todo).mapInPandas(run, f"asked string, {SCHEMA}")
    joined = blocks.join(answered, F.col(text) == F.col("asked"), "left")
    return joined.withColumn(out, F.coalesce("translation", text)).drop("asked", "translation")
