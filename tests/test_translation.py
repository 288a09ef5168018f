"""Translation in order and by concurrent clients against plain loops, and their queries against SQL."""

import os
import random
import threading
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext.operators import client, sequential, translate
from loomtext.plans import translation as plans
from tests.test_library import SF, normal

SCHEMA = "doc_id string, segment_id string, pos int, block_type string, source_text string, masked_text string, masks array<struct<placeholder:string>>, translated_text string, extra int"


def answers(request):
    n = len(request.text)
    if n % 11 == 5:
        raise RuntimeError("no answer")
    if n % 7 == 3:
        return []
    told = "|".join(f"{a[:3]}>{b[:9]}" for a, b in request.context)
    return ["", f"<{told}> {request.text}"] if n % 2 else [f"<{told}> {request.text} M1", request.text]


def fallback(request):
    if len(request.text) % 5 == 0:
        raise RuntimeError("down")
    return ["  "] if len(request.text) % 3 == 0 else ["f " + request.text]


def plain(rows, how):
    """The loop that a single machine would run, document by document."""
    out = {}
    for doc in {r[0] for r in rows}:
        mine, done, known = sorted((r for r in rows if r[0] == doc), key=lambda r: r[2]), [], {}
        for r in mine:
            _, seg, pos, kind, source, masked, masks, before, _ = r
            text, can = masked if masked is not None else source or "", kind not in ("EQUATION", "CODE")
            near = [d for d in done if d[0] == seg or how.extended]
            if how.extended:
                ctx = [(s, t) for _, s, t, c in near if t and t.strip() and c][-2 * how.window :]
            else:
                # blocks of the same segment that follow each other
                near = near[-how.window :]
                ctx = [(s, t) for _, s, t, _ in near if t]
            status, t, ph = "skipped", before, [m[0] for m in masks or []]
            if can and text in known:
                status, t = "cached", known[text]
            elif can:
                try:
                    a = answers(sequential.Request(text, tuple(ctx), how.candidates))
                    best = next((x for x in a if all(p in x for p in ph)), a[0]) if a else ""
                    if best and best.strip() != text.strip() and all(p in best for p in ph):
                        status, t = "translated", best
                        known[text] = best
                    else:
                        status, t = "source", source or ""
                        try:
                            f = fallback(sequential.Request(text))[0] if text.strip() else ""
                            if f.strip():
                                status, t = "fallback", f
                        except RuntimeError:
                            pass
                except RuntimeError:
                    status, t = "failed", before
            out[doc, pos] = (status, t)
            done.append((seg, source or "", t, can))
    return out


def documents():
    rnd, rows = random.Random(2), []
    for d in range(12):
        pos = 0
        for seg in range(rnd.randint(1, 3)):
            for _ in range(rnd.randint(0, 25)):
                text = rnd.choice([None, "", " ", "same text again", "word " * rnd.randint(1, 9), "x" * rnd.randint(1, 40)])
                masked = rnd.choice([None, None, "M1 in here " * rnd.randint(1, 3)])
                rows.append((f"d{d}", f"s{seg}", pos, rnd.choice(["PARAGRAPH"] * 5 + ["EQUATION"]), text, masked, [("M1",)] if masked else None, rnd.choice([None, None, "old"]), 1))
                pos += 1
    return rows


@pytest.mark.parametrize("how", [sequential.Settings(window=2), sequential.Settings(window=4, candidates=2), sequential.Settings(window=2, extended=True), sequential.Settings(window=0)])
def test_in_order_equals_loop(spark, how):
    rows = documents()
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # documents go over many batches
    try:
        x = sequential.translate_in_order(spark.createDataFrame(rows, SCHEMA).repartition(5), answers, fallback, how=how)
        got = {(r["doc_id"], r["pos"]): (r["status"], r["translated_text"]) for r in x.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    want = plain(rows, how) if how.window else None
    assert len(got) == len(rows) and "extra" in x.columns
    if want:
        assert got == want and {s for s, _ in got.values()} == {"skipped", "cached", "translated", "fallback", "source", "failed"}
    else:
        assert all(r["context_used"] == 0 for r in x.collect())


def test_in_order_with_a_cache(spark):
    """A fresh entry is taken, one that repeats the source or is too old isn't."""
    b = spark.createDataFrame([("d", 0, "PARAGRAPH", "one"), ("d", 1, "PARAGRAPH", "two"), ("d", 2, "PARAGRAPH", "three"), (None, 0, "PARAGRAPH", "one")], "doc_id string, pos int, block_type string, source_text string")
    c = spark.createDataFrame([("one", "un", 1), ("two", " two ", 1), ("three", "trois", 30)], "t string, value string, age int")
    now = F.expr("timestamp '2024-06-10 00:00:00'")
    c = c.select(translate.key(F.col("t"), F.lit("en"), F.lit("fr")).alias("key"), "value", (now - F.make_interval(days="age")).alias("ts"))
    x = sequential.translate_in_order(b, lambda r: [f"{len(r.context)} {r.text}"], cache=c, now=now)
    assert sorted((str(r["doc_id"]), r["pos"], r["status"], r["translated_text"]) for r in x.collect()) == [("None", 0, "cached", "un"), ("d", 0, "cached", "un"), ("d", 1, "translated", "1 two"), ("d", 2, "translated", "2 three")]
    assert sequential.translate_in_order(b.limit(0), lambda r: ["x"]).count() == 0


def test_a_long_document_streams(spark):
    """100,000 blocks of one document: each answer counts on from the one before; the worker's memory hardly grows."""
    import resource

    def step(request):
        last = int(request.context[-1][1].split()[0]) if request.context else 0
        return [f"{last + 1} {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024} {'x' * 300}"]

    n = 100_000
    b = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("pos"), F.lit("PARAGRAPH").alias("block_type"), F.concat(F.lit("block "), F.col("id"), F.repeat(F.lit(" words"), 60)).alias("source_text"))
    x = sequential.translate_in_order(b, step).select("pos", F.split("translated_text", " ").alias("t"))
    r = x.agg(F.count_if(F.col("t")[0].cast("int") != F.col("pos") + 1).alias("wrong"), F.max(F.when(F.col("pos") < 5000, F.col("t")[1].cast("int"))).alias("early"), F.max(F.col("t")[1].cast("int")).alias("late"), F.count(F.lit(1)).alias("n")).first()
    assert (r.wrong, r.n) == (0, n) and r.late - r.early < 60, r


def test_client_order_and_errors():
    """Busy twice, then an answer; errors lead to the next service; nothing is out of order and the window is never passed."""
    lock, open_, most, slept, seen = threading.Lock(), 0, 0, [], {}

    def first(t):
        nonlocal open_, most
        with lock:
            open_ += 1
            most = max(most, open_)
            seen[t] = seen.get(t, 0) + 1
        time.sleep(0.002 * (int(t) % 4))
        with lock:
            open_ -= 1
        if int(t) % 5 == 0 and seen[t] <= 2:
            raise RuntimeError("HTTP 429 Too Many Requests")
        if int(t) % 5 == 1:
            raise client.Busy("wait")
        if int(t) % 5 == 2:
            raise KeyError("no")
        return "" if int(t) % 5 == 3 else "a" + t

    def second(t):
        if int(t) % 3 == 0:
            raise ValueError("down")
        return "b" + t

    got = list(client.in_order(map(str, range(60)), [("a", first), ("b", second)], client.Policy(in_flight=6), sleep=slept.append))
    for k, a in enumerate(got):
        m = k % 5
        want = "a" if m in (0, 4) else None if k % 3 == 0 else "b"
        assert (a.service, a.translation) == (want, want and want + str(k))
        assert (a.calls, a.busy, a.waited) == ([3, 3, 1, 3, 1][m] + (m in (1, 2, 3)), [2, 3, 0, 0, 0][m], [6.0, 12.0, 0, 0, 0][m])
        assert (a.error is None) == (want is not None)
    assert most == 6 and sorted(set(slept)) == [2.0, 4.0, 6.0]
    assert list(client.in_order(iter([]), [])) == [] and client.in_order(iter(["x"]), []).__next__().error == "no service gave an answer"


def test_token_bucket():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 6))
        now[0] += s

    b = client.TokenBucket(rate=2.0, burst=3, clock=lambda: now[0], sleep=sleep)
    assert [round(b.take(), 6) for _ in range(6)] == [0, 0, 0, 0.5, 0.5, 0.5]
    now[0] += 100
    assert [round(b.take(), 6) for _ in range(4)] == [0, 0, 0, 0.5] and client.TokenBucket().take() == 0.0


def test_concurrent_frames(spark):
    """Distinct texts are asked once, blank ones never; what fails keeps its source."""
    b = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "a"), (4, None), (5, " ")], "k int, source_text string")

    def service(t):
        if t == "bad":
            raise ValueError("no")
        return t.upper()

    x = client.translate_concurrently(b, [("s", service)], clients=2).orderBy("k")
    assert [(r["translated_text"], r["service"], r["calls"], r["error"]) for r in x.collect()] == [("A", "s", 1, None), ("bad", None, 1, "s: no"), ("A", "s", 1, None), (None, None, None, None), (" ", None, None, None)]
    assert client.translate_concurrently(b.limit(0), [("s", service)]).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(plans.queries()))
def test_query_equals_sql(spark, name):
    a = plans.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    pd.testing.assert_frame_equal(normal(a), normal(con.execute(plans.oracle_sql()[name]).df()), check_dtype=False)


def test_moody_forgets_answered_texts():
    """The double holds a text only while it is busy with it: its memory doesn't grow with the texts."""
    service = plans._Moody()
    got = [client.ask("x" * n, [("a", service), ("b", plans._second)], client.Policy(), client.TokenBucket(), lambda s: None) for n in range(1, 41)]
    assert not service.calls
    assert [(a.service, a.calls, a.busy) for a in got[4:10:5]] == [("a", 3, 2), ("a", 3, 2)] and got[2].busy == 3
