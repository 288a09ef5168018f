"""Progress, overflowing texts, languages and matches against plain loops; their queries against SQL."""

import json
import os
import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext.functions import languages
from loomtext.operators import overflow, progress
from loomtext.plans import service as plans
from tests.test_library import SF, normal

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("given", [None, 500])
@pytest.mark.parametrize("parts", [1, 6])
def test_progress(spark, parts, given):
    """Runs that span parts, one of them much longer, one null; ties in time; columns of clashing names."""
    rnd, rows, t = random.Random(parts), [], 0
    for q in range(200):
        t += rnd.choice([0, 0, 2, 9])
        rows.append((rnd.choice(["long"] * 6 + ["b", None]), q, t, rnd.choice(["completed", "completed", "failed", "skipped", None])))
    x = spark.createDataFrame([(r, q, T0 + timedelta(seconds=t), s, 1.0) for r, q, t, s in rows], "run string, seq long, ts timestamp, status string, rate double")
    got = {r["seq"]: r for r in progress.follow(x.withColumn("total", F.lit(given)) if given else x, parts).collect()}
    assert len(got) == len(rows)
    count, begin = {}, {}
    for r, q, t, s in rows:
        c = count.setdefault(r, {"completed": 0, "failed": 0, "skipped": 0})
        begin.setdefault(r, t)
        if s:
            c[s] += 1
        total, elapsed = given or sum(o[0] == r for o in rows), t - begin[r]
        rate = c["completed"] / elapsed if elapsed else 0.0
        want = [c["completed"] / total * 100, float(elapsed), rate, (total - c["completed"]) / rate if rate else None]
        g = got[q]
        assert (g["completed"], g["failed"], g["skipped"]) == tuple(c.values()) and [g[k] for k in ("percentage", "elapsed", "rate")] == pytest.approx(want[:3])
        assert g["eta"] == (None if want[3] is None else pytest.approx(want[3]))
    assert progress.follow(x.limit(0), parts).count() == 0


def test_messages(spark):
    x = spark.createDataFrame([(0, 7, 1, 2), (None, 7, None, None)], "b int, n int, p int, m int")
    got = [r[0] for r in x.select(progress.message(F.lit("Go"), F.lit(0.425), F.col("b"), F.col("n"), F.col("p"), F.col("m"))).collect()]
    assert got == ["[42%] Go (Block 1/7) (Page 2/2)", "[42%] Go"]


def boxes(rnd, n):
    rows = []
    for k in range(n):
        x0, y0 = rnd.choice([0.0, 36.0, 50.0, 300.0, 420.0]), float(rnd.randint(5, 740))
        rows.append((rnd.choice(["d", "e", None]), rnd.randint(0, 2), k, x0, y0, x0 + rnd.choice([40.0, 100.0, 280.0]), y0 + rnd.choice([8.0, 14.0, 30.0]), "w" * rnd.choice([0, 3, 40, 90, 300]) + "\nx" * rnd.choice([0, 0, 2])))
    return rows


def columns(r, grain=12.0):
    first = int(min(max(r[3], 0), 611) // grain)
    return set(range(first, max(first + 1, -int(-min(max(r[5], 0), 611) // grain))))


def plain_space(rows, needy):
    """Every pair of boxes on a page, as one machine would compare them."""
    out = {}
    for r in rows:
        if r[2] not in needy:
            continue
        above, below = r[4] - 10, 782 - r[6]
        for o in rows:
            if o[2] == r[2] or o[:2] != r[:2] or not columns(r) & columns(o):
                continue
            half = 2 if o[2] in needy else 1
            if (o[4], o[2]) > (r[4], r[2]):
                below = min(below, (o[4] - r[6]) / half)
            else:
                above = min(above, (r[4] - o[6]) / half)
        out[r[2]] = (max(above, 0.0), max(below, 0.0))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_overflow(spark, seed):
    rows = boxes(random.Random(seed), 90)
    d = spark.createDataFrame(rows, "doc_id string, page int, pos int, x0 double, y0 double, x1 double, y1 double, source_text string").repartition(3)
    for strategy in overflow.STRATEGIES:
        x = overflow.resolve(d, strategy).cache()
        got = {r["pos"]: r for r in x.collect()}
        assert len(got) == len(rows)
        needy = {k for k, r in got.items() if r["overflowed"]}
        assert needy == {r[2] for r in rows if r[7] and all(max(len(r[7].split("\n")), -(-len(r[7]) * 5.5 * s // (r[5] - r[3]))) * max(6.0, 11 * s) * 1.2 > r[6] - r[4] + 1e-9 for s in overflow.LADDER)}
        space = {r["pos"]: (r["above"], r["below"]) for r in overflow.space(d.withColumn("needy", F.col("pos").isin(list(needy)))).collect()}
        assert space == plain_space(rows, needy)
        for a in rows:  # boxes that did not meet don't meet after growing
            g = got[a[2]]
            if g["how"] in ("down", "up", "both"):
                assert g["new_y0"] >= min(10, a[4]) and g["new_y1"] <= max(782, a[6])
            for o in rows:
                if o[2] < a[2] and o[:2] == a[:2] and columns(a) & columns(o) and (o[4] >= a[6] or a[4] >= o[6]):
                    h = got[o[2]]
                    assert h["new_y0"] >= g["new_y1"] - 1e-9 or g["new_y0"] >= h["new_y1"] - 1e-9
        reports = {r["doc_id"]: json.loads(r["report"]) for r in overflow.report(x, strategy).collect()}
        assert {k: v["total_overflows"] for k, v in reports.items()} == {doc: n for doc in ("d", "e", None) if (n := sum(r[0] == doc and r[2] in needy for r in rows))}
        moved = {k for k, r in got.items() if r["how"] == "append"}
        assert {e["block_id"] for v in reports.values() for e in v["events"] if "full_text" in e} == moved and all(v["strategy"] == strategy for v in reports.values())
        assert {r["pos"] for r in overflow.appended(x).collect()} == moved
        x.unpersist()


def test_overflow_edges(spark):
    d = spark.createDataFrame([("d", 0, 1, None, 1.0, 2.0, 3.0, "a", "x"), ("d", 0, 2, 5.0, 5.0, 5.0, 40.0, None, "y"), ("d", 0, 3, 5.0, 50.0, 5.0, 60.0, "long text " * 50, "z")], "doc_id string, page int, pos int, x0 double, y0 double, x1 double, y1 double, source_text string, how string")
    assert {r["pos"]: r["how"] for r in overflow.resolve(d).collect()} == {1: "unplaced", 2: "fits", 3: "append"}
    assert overflow.resolve(d.limit(0)).count() == 0 and overflow.report(overflow.resolve(d.limit(0))).count() == 0
    with pytest.raises(ValueError):
        overflow.resolve(d, "other")
    x = overflow.resolve(d, "marker+append_pages").select("pos", overflow.shown(F.col("source_text"), F.col("how"), "marker+append_pages").alias("s"))
    assert {r["pos"]: r["s"] for r in x.collect()} == {1: "a", 2: None, 3: overflow.MARKER}


def test_languages(spark):
    x = spark.createDataFrame([("French ",), ("zh",), ("zh-TW",), ("RU",), ("xx",), (None,)], "lang string")
    got = [tuple(r) for r in x.select(languages.code(F.col("lang")), languages.script(F.col("lang")), languages.font_file(F.col("lang"))).collect()]
    assert got == [("fr", None, None), ("zh-CN", "chinese", "noto-chinese.ttf"), ("zh-tw", "chinese", "noto-chinese.ttf"), ("ru", "cyrillic", "noto-cyrillic.ttf"), ("xx", None, None), (None, None, None)]
    urls = {"https://a.b/v1/": "https://a.b", "a.b//": "https://a.b", "http://a/v1": "http://a", "a/v12": "https://a/v12"}
    y = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r[0]: r[1] for r in y.select("u", languages.address(F.col("u"))).collect()} == urls


def test_best_match(spark):
    rows = [([("a", "0.5"), ("b", "0.9"), ("c", "0.9")], "d", "b"), ([("a", "0.7")], "d", "d"), ([("a", "none"), ("b", "1")], "d", "d"), ([("a", None)], "", None), ([], "d", "d"), (None, None, None), ([(None, "0.9")], "d", None)]
    x = spark.createDataFrame(rows, "m array<struct<translation:string,quality:string>>, direct string, want string")
    assert all(a == b for a, b in x.select(languages.best_match(F.col("m"), F.col("direct")), "want").collect())


def test_routes(spark):
    r = languages.Route("Cascade", candidates=3).settled()
    assert (r.candidates, r.rerank, r.batched) == (1, False, True)
    r = languages.Route("other", candidates=3, without=frozenset({"masking"}))
    assert r.settled() == r and languages.Route("other", fast=True).settled().batched
    d = spark.range(3)
    twice = lambda x: x.union(x)
    assert r.stage("masking", twice, d).count() == 3 and r.stage("glossary", twice, d).count() == 6
    with pytest.raises(ValueError):
        languages.Route("other", without=frozenset({"nothing"})).settled()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(plans.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    a = plans.queries()[name](spark, SF).toPandas()
    pd.testing.assert_frame_equal(normal(a), normal(con.execute(plans.oracle_sql()[name]).df()), check_dtype=False)
