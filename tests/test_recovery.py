"""Recovery operators on small tables, and their queries against SQL."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext.operators import recovery, translate
from loomtext.plans import recovery as plans
from tests.test_library import LONG, SF, blocks, normal


def waits():
    """A back-off that notes how long it would sleep."""
    slept = []
    return slept, recovery.Backoff(sleep=slept.append)


def test_rounds_and_guarantee(spark):
    b = blocks(spark, [("PARAGRAPH", LONG, None), ("PARAGRAPH", LONG, LONG), ("PARAGRAPH", LONG, "bon"), ("EQUATION", "x", None), ("PARAGRAPH", "alone here", " ")])
    s, k = F.col("source_text"), F.col("pos")
    attempts = [F.when(k == 0, F.upper(s)).otherwise(F.lit(" ")), F.when(k < 2, F.concat(F.lit("a "), s))]
    slept, backoff = waits()
    got = [tuple(r) for r in recovery.rounds(b, attempts, backoff).orderBy("pos").select("round", "waited", "failed", "translated_text").collect()]
    assert got == [(2, 1.0, False, "a " + LONG), (2, 1.0, False, "a " + LONG), (None, 0.0, False, "bon"), (None, 0.0, False, None), (None, 1.0, True, " ")] and slept == [1.0]
    g = recovery.guarantee(b, attempts, backoff=backoff)
    assert [r["status"] for r in g.orderBy("pos").collect()] == ["retried", "retried", "ok", "ok", "failed"]
    assert tuple(recovery.guaranteed_coverage(g).first()) == ("d", 4, 2, 1, 0.75)
    with pytest.raises(recovery.CoverageError, match="1 of 4 blocks") as e:
        recovery.guaranteed_coverage(g, strict=True)
    assert e.value.coverage == 0.75 and [(r["doc_id"], r["pos"], r["reason"]) for r in e.value.report.collect()] == [("d", 4, "missing_translation")]
    slept.clear()
    saved = recovery.guarantee(b, attempts, F.lit("au secours"), backoff)
    assert recovery.guaranteed_coverage(saved, strict=True).first()["coverage"] == 1.0 and slept == [1.0]  # no wait before the fallback
    assert recovery.guarantee(b, []).where("status = 'failed'").count() == 3 and recovery.rounds(b.limit(0), attempts, backoff).count() == 0


def test_translators_see_only_what_is_left(spark, tmp_path):
    """Each call leaves a file, so that calls of Python workers can be counted."""
    n = 200
    b = blocks(spark, [("PARAGRAPH", f"{LONG} number {k}", None if k % 2 == 0 else "bon") for k in range(n)] + [("EQUATION", "x = 1", None)]).repartition(4)

    def counting(name, helps):
        folder = tmp_path / name
        folder.mkdir()

        def run(texts):
            out = []
            for t in texts:
                k = int(t.rsplit(" ", 1)[1])
                (folder / str(k)).touch(exist_ok=False)  # a second call for a text would fail
                if k % 10 == 4:
                    raise RuntimeError("no answer")
                out.append("ok " + t if helps(k) else None)
            return out

        return folder, (lambda texts: run(texts) if len(texts) == 1 else many())

    def many():
        raise RuntimeError("one text at a time")

    seen, translators = zip(*(counting(n, f) for n, f in (("one", lambda k: k % 4 == 0), ("two", lambda k: k % 6 == 0), ("three", lambda k: False), ("last", lambda k: k != 10))))
    slept, backoff = waits()
    out = recovery.guarantee(b, list(translators[:3]), translators[3], backoff).collect()
    left, want = [k for k in range(n) if k % 2 == 0], []
    for f in (lambda k: k % 4 == 0, lambda k: k % 6 == 0, lambda k: False, lambda k: k != 10):
        want.append(sorted(left))
        left = [k for k in left if k % 10 == 4 or not f(k)]
    assert [sorted(int(p.name) for p in folder.iterdir()) for folder in seen] == want and slept == [1.0, 2.0]
    assert sorted(int(r["source_text"].rsplit(" ", 1)[1]) for r in out if r["status"] == "failed") == sorted(left) and len(out) == n + 1


def test_no_round_without_a_remainder(spark):
    """Once nothing is left, no further translator is asked; a translator may take a DataFrame."""
    b = blocks(spark, [("PARAGRAPH", LONG, None), ("PARAGRAPH", "fine", "bon")])
    asked = []

    @translate.on_frames
    def frames(df):
        asked.append(df.count())
        return df.withColumn("translated_text", F.concat(F.lit("f "), "source_text"))

    slept, backoff = waits()
    got = recovery.rounds(b, [F.lit(None).cast("string"), frames, frames, frames], backoff).orderBy("pos").collect()
    assert asked == [1] and slept == [1.0] and [(r["round"], r["translated_text"]) for r in got] == [(2, "f " + LONG), (None, "bon")]


def test_single_fallback_and_list(spark):
    d = spark.createDataFrame([("a", " b ."), ("a", None), ("a", " "), (None, "b"), (" ", "b")], "s string, a string")
    assert [r["t"] for r in d.select(recovery.single_fallback(F.col("s"), F.col("a")).alias("t")).collect()] == ["b.", "a", "a", "", " "]
    b = blocks(spark, [("PARAGRAPH", "x", "y"), ("PARAGRAPH", "z", "w")])
    listed = spark.createDataFrame([("d", 1), ("d", 1), ("e", 0), (None, None)], "doc_id string, pos int")
    assert [(r["retried"], r["translated_text"]) for r in recovery.retry_listed(b, listed, F.lit("n")).orderBy("pos").collect()] == [(False, "y"), (True, "n")]


def test_refine(spark):
    b = blocks(spark, [("PARAGRAPH", "s", f"{k} <<M>> réseau " + "x" * 200) for k in range(7)] + [("EQUATION", "e", "t"), ("PARAGRAPH", "s", None)])
    m, t = F.array(F.struct(F.lit("<<M>>").alias("placeholder"))), F.array(F.lit("réseau"))
    answer = lambda c: F.when(F.col("pos") == 0, F.lit("bon <<M>> Réseau")).when(F.col("pos") == 1, F.lit("bon réseau")).when(F.col("pos") == 2, F.lit("bon <<M>>")).when(F.col("pos") == 3, F.lit("")).otherwise(F.col("translated_text"))
    r = recovery.refine(b, answer, m, t).orderBy("pos").collect()
    assert [x["status"] for x in r] == ["refined", "violation", "violation", "unchanged", "unchanged", "unchanged", "unchanged", "skipped", "skipped"]
    assert r[0]["translated_text"] == "bon <<M>> Réseau" and r[1]["translated_text"].startswith("1 <<M>>")
    assert r[8]["segment_context"] == "\n".join("- " + (f"{k} <<M>> réseau " + "x" * 200)[:100] for k in range(5))


def test_recover_cut(spark):
    """Against a plain loop that packs whole sentences."""
    sentences = [f"Sentence number {k} has some words in it." for k in range(40)]
    text = " ".join(sentences)
    chunks, now = [], ""
    for s in sentences:
        if now and len(now) + 1 + len(s) > 450:
            chunks.append(now)
            now = s
        else:
            now = f"{now} {s}".strip()
    chunks.append(now)
    d = spark.createDataFrame([(1, text, text[:50]), (2, text, text.lower()), (3, text[:400], "x"), (4, text + "\n\n" + text, "x"), (5, None, None)], "k int, s string, a string")
    mark = lambda c: F.when(c.startswith(chunks[1][:25]), None).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    got = {r["k"]: r["t"] for r in d.select("k", recovery.recover_cut(F.col("s"), F.col("a"), mark).alias("t")).collect()}
    told = [c if k == 1 else f"<{c}>" for k, c in enumerate(chunks)]
    assert len(chunks) > 3 and got == {1: " ".join(told), 2: text.lower(), 3: "x", 4: "\n\n".join(told * 2), 5: None}


def test_translator_errors(spark):
    """A text that the translator fails at keeps its source; the others are translated."""

    def fails(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    b = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c"), (4, None)], "k int, source_text string")
    got = [r["translated_text"] for r in translate.translate_distinct(b.coalesce(1), fails, sources=1).orderBy("k").collect()]
    assert got == ["A", "bad", "C", None]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(plans.queries()))
def test_query_equals_sql(spark, name):
    a = plans.queries()[name](spark, SF).toPandas()
    if name not in plans.oracle_sql():
        assert len(a)
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    pd.testing.assert_frame_equal(normal(a), normal(con.execute(plans.oracle_sql()[name]).df()), check_dtype=False)
