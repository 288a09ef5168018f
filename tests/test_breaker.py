"""Breaker states over tables and streams against a plain loop."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomtext.operators import breaker
from tests.test_library import SF

T0 = datetime(2024, 1, 1)


def plain(rows, failures=3, cool=300):
    """The loop that one machine would run: rows of (service, seq, seconds, outcome)."""
    out, count, until = {}, {}, {}
    for s, q, t, o in sorted(rows, key=lambda r: (r[2], r[1], r[3] or "")):
        if s in until:
            if t < until[s]:
                out[q] = (False, count.get(s, 0), until[s], False)
                continue
            del until[s]
            count[s] = 0
        opened = False
        if o == "ok":
            count[s] = 0
        elif o == "busy":
            opened = True
        else:
            count[s] = count.get(s, 0) + 1
            opened = count[s] >= failures
        if opened:
            until[s] = t + cool
        out[q] = (True, count.get(s, 0), until.get(s), opened)
    return out


def log(rnd, n, weights, spread=40):
    t, rows = 0, []
    for q in range(n):
        t += rnd.choice([0, 1, 5, spread])
        rows.append((rnd.choice(["a", "a", "a", "b", None]), q, t, rnd.choices(["ok", "busy", "failed", None], weights)[0]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(s, q, T0 + timedelta(seconds=t), o, "kept", 7) for s, q, t, o in rows], "service string, seq long, ts timestamp, outcome string, extra string, failures int")


def seconds(ts):
    return None if ts is None else round((ts - T0).total_seconds())


@pytest.mark.parametrize("weights", [(5, 1, 4, 1), (0, 1, 0, 0), (1, 0, 8, 0), (9, 0, 1, 0)])
@pytest.mark.parametrize("parts", [1, 7, 40])
def test_replay(spark, weights, parts):
    """Any cut into parts gives the loop's states: mixed logs, a service that is always busy, one that mostly fails, one that seldom does."""
    rows = log(random.Random(parts), 400, weights)
    x = breaker.replay(frame(spark, rows), breaker.Rule(), parts).collect()
    assert {r["seq"]: (r["attempted"], r["failures"], seconds(r["open_until"]), r["opened"]) for r in x} == plain(rows)
    assert len(x) == len(rows) and {r["extra"] for r in x} == {"kept"}


def test_exits_of_every_state():
    """A part's exits, for each state in which it could start, are those of the loop."""
    import numpy as np

    rnd = random.Random(5)
    for _ in range(300):
        rule = breaker.Rule(rnd.choice([1, 2, 3, 4]), rnd.choice([0, 3, 20]))
        m = rnd.randint(1, 14)
        ts = np.sort(np.array([rnd.randint(0, 30) for _ in range(m)])) * 1_000_000
        said = rnd.choices(["ok", "busy", "x"], [2, 1, rnd.choice([1, 6])], k=m)
        found = breaker.exits(ts, np.array([o == "x" for o in said]), np.array([o == "busy" for o in said]), rule, True)
        states = [(f, None) for f in range(rule.failures)] + [(0, int(ts[0]) + u * 500_000) for u in range(-2, 2 * rule.cool_down + 1)]
        for failures, until in states:
            want = (failures, until)
            for t, o in zip(ts.tolist(), said):
                want = breaker.step(*want, t, o, rule)[1:3]
            hits = [e[2:] for e in found if (e[:2] == (0, failures) if until is None else e[0] == 1 and e[1] >= until)]
            got = hits[0] if hits else (failures, until)
            assert tuple(got) == want, (ts, said, failures, until)


def test_replay_edges(spark):
    assert breaker.replay(frame(spark, []), parts=3).count() == 0
    x = frame(spark, [("a", 1, 0, "busy"), ("a", 2, 300, "ok")]).withColumn("ts", F.when(F.col("seq") == 1, F.col("ts")))
    got = {r["seq"]: (r["attempted"], r["opened"]) for r in breaker.replay(x).collect()}
    assert got == {1: (True, True), 2: (None, None)}


def test_stream_equals_table(spark, tmp_path):
    """Whole events, as a table and as a stream of several batches; each pause that ended has its row."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    outcome = F.when(F.col("user_id") % 3 == 0, "ok").when(F.col("user_id") % 7 == 1, "busy").otherwise("failed")
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("service"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), outcome.alias("outcome"))
    cuts = [r[0] for r in e.select(F.percentile_approx("ts", [0.3, 0.6]).alias("c")).select(F.explode("c")).collect()]
    for k, c in enumerate([F.col("ts") < cuts[0], (F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1]), F.col("ts") >= cuts[1]]):
        e.where(c).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = breaker.live(s).writeStream.format("memory").queryName("breaker_states").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    try:
        got = spark.table("breaker_states")
        cols = ["service", "seq", "ts", "attempted", "failures", "open_until", "opened"]
        assert sorted(map(tuple, got.where("seq is not null").select(cols).collect())) == sorted(map(tuple, breaker.replay(e, parts=4).select(cols).collect()))
        ended, opened = got.where("seq is null").count(), got.where("opened and seq is not null").count()
        assert 0 < ended <= opened
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
