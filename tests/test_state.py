"""State that outlives a run: smoothed scores, cache tables, write-back into nested documents; and merged blocks split back."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomtext.operators import cache, context, report


def plain(records, state=None, rate=0.1):
    out = {t: list(s) for t, s in (state or {}).items()}
    for t, _, bleu, chrf, ok in sorted(records, key=lambda r: r[1]):
        b, c, s, n = out.get(t, (0.0, 0.0, 0.0, 0))
        out[t] = [(1 - rate) * b + rate * bleu, (1 - rate) * c + rate * chrf, (s * n + ok) / (n + 1), n + 1]
    return out


@pytest.mark.parametrize("width", [3, 7, 10_000])
def test_template_progress(spark, monkeypatch, width):
    """The same for any division into slices, and resumed from a loaded state."""
    monkeypatch.setattr(report, "SLICE", width)
    rnd = random.Random(1)
    records = [(rnd.choice("abc"), k * 2, rnd.random() * 100, rnd.random() * 100, rnd.random() < 0.7) for k in range(60)]
    state = {"a": (40.0, 50.0, 0.5, 10), "z": (1.0, 2.0, 1.0, 3)}
    r = spark.createDataFrame(records, "template string, seq long, bleu double, chrf double, success boolean").repartition(3)
    s = spark.createDataFrame([(t, *v) for t, v in state.items()], "template string, bleu double, chrf double, success_rate double, usage long")
    for given, want in ((None, plain(records)), (s, plain(records, state))):
        got = {x[0]: x[1:] for x in map(tuple, report.template_progress(r, state=given).collect())}
        assert set(got) == set(want) and all(got[t] == pytest.approx(want[t], abs=2e-6) for t in want)
    assert report.template_progress(r.limit(0)).count() == 0 and report.template_progress(r.limit(0), state=s).count() == 2


def test_cache_upsert(spark, tmp_path):
    now, path = F.expr("timestamp '2024-06-10 00:00:00'"), str(tmp_path / "cache")
    rows = lambda *r: spark.createDataFrame(list(r), "t string, value string, age int").select(cache.key(F.col("t"), F.lit("en"), F.lit("fr"), F.lit("x")).alias("key"), "value", (now - F.make_interval(days="age")).alias("ts"))
    seen = lambda *t: {r["t"]: r["cached"] for r in cache.get(spark.createDataFrame([(x,) for x in t], "t string").withColumn("key", cache.key(F.col("t"), F.lit("en"), F.lit("fr"), F.lit("x"))), path, now).collect()}
    assert seen("a") == {"a": None}
    cache.upsert(rows(("a", "un", 3), ("b", "deux", 6), ("c", "old", 8), ("d", " ", 0), ("e", "first", 2)), path, now)
    cache.upsert(rows(("a", "newer", 1), ("e", "older", 4), ("f", "same", 1), ("f", "time", 1)), path, now)
    cache.upsert(rows(), path, now)
    assert seen("a", "b", "c", "d", "e", "f", "g", None) == {"a": "newer", "b": "deux", "c": None, "d": None, "e": "first", "f": "time", "g": None, None: None}
    later = F.expr("timestamp '2024-06-12 00:00:00'")
    before = cache.read(spark, path).count()
    cache.upsert(rows(("b", "again", -2)), path, later)  # b's part is written anew; its old entry went with it
    assert cache.read(spark, path).count() == before and seen("b") == {"b": "again"}
    import hashlib

    assert rows(("a", "v", 0)).first()["key"] == hashlib.md5(b"a|en|fr|x").hexdigest()


def test_write_back(spark):
    kind = "document_id string, title string, segments array<struct<segment_id:string,blocks:array<struct<block_id:string,source_text:string,scores:map<string,double>,note:string>>>>"
    docs = [("d", "T", [("s", [("1", "a", {"x": 0.1}, "n"), ("2", "b", None, None)]), ("t", [("3", "c", None, "m")]), ("u", None)]), ("e", None, [("s", [("1", "a", None, "kept")])]), ("f", None, None)]
    updates = [("d", "1", 0.5, None), ("d", "3", 0.25, "new"), ("d", "3", 0.2, "last"), ("d", "9", 0.9, "nowhere"), ("g", "1", 1.0, "x"), ("d", None, 1.0, "x")]
    d = spark.createDataFrame(docs, kind)
    u = spark.createDataFrame(updates, "document_id string, block_id string, s double, note string").withColumn("scores", F.create_map(F.lit("total"), "s"))
    x = {r["document_id"]: r.asDict(recursive=True) for r in report.write_back(d, u.drop("s"), {"note": "note"}).collect()}
    assert [b["note"] for s in x["d"]["segments"] for b in s["blocks"] or []] == ["n", None, "new"] and x["d"]["segments"][2]["blocks"] is None
    was = {r["document_id"]: r.asDict(recursive=True) for r in d.collect()}
    assert x["e"] == was["e"] and x["f"] == was["f"] and x["d"]["title"] == "T" and x["d"]["segments"][0]["blocks"][0]["scores"] == {"x": 0.1}
    y = {r["document_id"]: r for r in report.write_back(d, u.where("s in (0.5, 0.9)"), {"scores": "scores", "note": "note"}).collect()}
    assert [b["scores"] for s in y["d"]["segments"] for b in s["blocks"] or []] == [{"total": 0.5}, None, None] and y["d"]["segments"][0]["blocks"][0]["note"] == "n"
    assert {r["document_id"]: r.asDict(recursive=True) for r in report.write_back(d, u.limit(0), {"note": "note"}).collect()} == was


def test_cut_in_parts():
    """Against all cuts, by cost; as many parts as asked, nothing lost, placeholders whole."""
    rnd = random.Random(3)
    for _ in range(300):
        sentences = [" ".join(rnd.choice(["word", "<<MATH_0001>>", "a", "longer"]) for _ in range(rnd.randint(1, 6))) + "." for _ in range(rnd.randint(1, 7))]
        k = rnd.randint(1, 4)
        lengths, text = [rnd.randint(0, 40) for _ in range(k)], rnd.choice([" ", "  "]).join(sentences)
        got = context.cut_in_parts(text, lengths)
        assert len(got) == k and " ".join(p for p in got if p).split() == text.split()
        if len(sentences) > k > 1:
            n, total = len(sentences), sum(lengths) or 1
            cost = lambda parts: sum((sum(map(len, p)) / sum(map(len, sentences)) - x / total) ** 2 for p, x in zip(parts, lengths))
            every = [[sentences[i:j] for i, j in zip((0, *c), (*c, n))] for c in combinations(range(1, n), k - 1)]
            mine, at = [], 0
            for p in got:
                m = len([s for s in sentences[at:] if s]) and next(j for j in range(at, n + 1) if " ".join(sentences[at:j]).split() == p.split())
                mine.append(sentences[at:m])
                at = m
            assert cost(mine) <= min(map(cost, every)) + 1e-9
    assert context.cut_in_parts("", [1, 2]) == ["", ""] and context.cut_in_parts("one", [5, 5]) == ["one", ""] and context.cut_in_parts("x", []) == []


def test_merge_and_split_back(spark):
    b = spark.createDataFrame([("d", 0, 0, "This goes on"), ("d", 1, 1, "over the page. And a second sentence."), ("d", 2, 1, "Alone.")], "doc_id string, pos int, page int, source_text string")
    m = context.part_lengths(b).withColumn("translated_text", F.when(F.col("pos") == 0, "Ceci va <<M_0001>> loin. Et une phrase de plus ici."))
    got = {r["pos"]: (r["lengths"], r["translated_parts"]) for r in context.split_back(m).collect()}
    assert got == {0: ([12, 37], ["Ceci va <<M_0001>> loin.", "Et une phrase de plus ici."]), 2: ([6], None)}
