"""Operators on small tables with hand-computed results, and queries against their SQL."""

import json
import os
import random
import re
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomtext.functions import text as tx
from loomtext.operators import automaton, context, coverage, glossary, layout, masking, metrics, report, scoring, translate
from loomtext.plans import oracles, queries
from loomtext.sources import blocks as src
from loomtext.streaming import events

SF = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, kind",
    [("$E = mc^2$", "latex_inline"), ("see https://example.com now", "url_full"), ("use `print(1)` here", "code_inline"), ("as in [1]", "citation_bracket"), ("(Smith et al., 2020)", "citation_author"), ("$f'(x)$", "latex_apostrophe"), (r"\newcommand{\foo}{\text{bar}}", "latex_newcommand"), ("doi:10.1000/xyz", "doi"), (r"\begin{align}x\end{align}", "latex_environment")],
)
def test_mask_types(spark, text, kind):
    m = masking.mask(spark.createDataFrame([("d", 0, text)], "doc_id string, pos int, source_text string")).first()
    assert [x["mask_type"] for x in m["masks"]][:1] == [kind] and m["masks"][0]["placeholder"] == f"<<{kind.upper()}_0001>>"
    assert m["masks"][0]["original"] in text


def test_mask_places(spark):
    """Places are those of the pattern, against Python's re and plain loops."""
    import re

    texts = ["our homepage 12 has more, see page 12 now", "a.b@c.org xa.b@c.org, a.b@c.org!", "$$x$$ and $y$ and \\(z'\\) `c` ``` d ``` [1] x[1] [1,2]", "p. 3 top. 3 p. 3", "\x01$a$\x02 [3] \x01", "", None, "Fig. 2 figure 2 a tableau 3. See also page 4, (→ voir page suivante)", "x ... 12\ny..... 3"]
    # spaces that don't break, digits and letters of other scripts
    texts += ["voir p.\u00a012 et Fig.\u00a03", "la page\u202f14", "pp.\u200912\u201315, §\u00a04 Section\u2003IX", "FIGURE\u00a0٣ und Tab. १२", "doi:10.1000/abc\u00a0suite", "(Smith et\u00a0al., 2020) (Müller, 2020)", "éfig. 3 fig. 3é pagé 4 ſection 5 spage 6", "\\alphaé \\alpha é", "..\u00a0 7\n"]
    d = spark.createDataFrame(list(enumerate(texts)), "pos int, source_text string").selectExpr("'d' as doc_id", "pos", "source_text")
    got = {r["pos"]: [(s["start"], s["end"], s["name"]) for s in r["spans"] or []] for r in masking.spans(d).collect()}
    for k, t in enumerate(texts):
        every = sorted((m.start(), -m.end(), -priority, name) for name, priority, p in masking.PATTERNS for m in re.finditer(p, t or ""))
        chosen = []
        for start, end, rank, name in every:
            x = (start, -end, rank, name)
            if not chosen or start >= chosen[-1][1]:
                chosen.append(x)
            elif -end > chosen[-1][1] and rank < chosen[-1][2]:
                chosen[-1] = x
        assert got[k] == [(a, b, n) for a, b, _, n in chosen]
    masked = {r["pos"]: r for r in masking.mask(d).collect()}
    assert masked[0]["masked_text"].startswith("our homepage 12 has more, ")
    assert [[m["original"] for m in masked[k]["masks"]] for k in (9, 10)] == [["voir p.\u00a012", "Fig.\u00a03"], ["page\u202f14"]]


def test_mask_roundtrip_and_numbering(spark):
    rows = [("d", 0, r"let $\alpha$ be, see https://doi.org/10.1000/x and [1]."), ("d", 1, "again $x$ and $y$"), ("e", 0, "plain"), ("e", 1, None)]
    m = masking.mask(spark.createDataFrame(rows, "doc_id string, pos int, source_text string")).where("source_text is not null")
    out = {(r["doc_id"], r["pos"]): r for r in m.withColumn("b", masking.unmask(F.col("masked_text"), F.col("masks"))).collect()}
    assert all(r["b"]["text"] == r["source_text"] and not r["b"]["missing"] for r in out.values())
    assert [x["placeholder"] for x in out["d", 1]["masks"]] == ["<<LATEX_INLINE_0002>>", "<<LATEX_INLINE_0003>>"]
    assert out["e", 0]["masked_text"] == "plain"


def test_masking_report_is_whole(spark):
    rows = [("d", 10, "again $x$ and $y$ at https://a.org/b"), ("d", 2, "see [1]"), ("d", 3, "plain"), ("d", 4, None), ("e", 0, "plain")]
    m = masking.mask(spark.createDataFrame(rows, "doc_id string, pos int, source_text string"))
    got = {r["doc_id"]: r for r in report.masking(m).collect()}
    d, e = got["d"], got["e"]
    assert (d["total_masks"], d["blocks_with_masks"], json.loads(d["by_type"])) == (4, 2, {"citation_bracket": 1, "latex_inline": 2, "url_full": 1})
    shown = json.loads(d["blocks"])
    assert [(b["pos"], b["num_masks"]) for b in shown] == [(2, 1), (10, 3)]
    want = {r["pos"]: r for r in m.where("doc_id = 'd'").collect()}
    for b in shown:
        assert b["masked_text"] == want[b["pos"]]["masked_text"] and b["masks"] == [x.asDict() for x in want[b["pos"]]["masks"]]
    assert (e["total_masks"], e["blocks_with_masks"], e["by_type"], e["blocks"]) == (0, 0, "{}", "[]")


def test_unmask_variants_and_loss(spark):
    d = spark.createDataFrame([("a « url_0001 » b", 1), ("First. Second", 2), ("nothing", 3)], "t string, k int")
    masks = F.array(F.struct(F.when(F.col("k") == 2, "$x$").otherwise("http://e.org").alias("original"), F.lit("<<URL_0001>>").alias("placeholder"), F.when(F.col("k") == 2, "latex_inline").otherwise("url_full").alias("mask_type"), F.lit(True).alias("preserve_formatting")))
    got = {r["k"]: r["u"] for r in d.withColumn("u", masking.unmask(F.col("t"), masks)).collect()}
    assert got[1]["text"] == "a http://e.org b" and got[1]["restored"] == 1
    assert got[2]["text"] == "First. $x$ Second" and got[2]["missing"] == ["<<URL_0001>>"]
    assert got[3]["text"] == "nothing http://e.org"


def test_truncation(spark):
    s = "word " * 104
    d = spark.createDataFrame([(s, "ok text", "length", True), (s, "Ceci", None, True), ("w " * 105, "w" * 32, None, True), ("short", "court", "stop", False), (s, "mot " * 100, "stop", False), ("", "x", "length", False)], "s string, t string, f string, want boolean")
    assert all(r["got"] == r["want"] for r in d.withColumn("got", tx.truncated("s", "t", F.col("f"))).collect())


def test_text_functions(spark):
    assert one(spark, "  A  B\n", tx.normalize) == "a b"
    assert one(spark, "<think>a\nb</think>x", tx.clean_output) == "x" and one(spark, '"quoted"', tx.clean_output) == "quoted"
    assert one(spark, "<think>all</think>", tx.clean_output) == "<think>all</think>"
    assert one(spark, "a b  c\t\td .", tx.postprocess) == "a b cd."
    assert one(spark, "Value 3,14 and 42 and 42", tx.numbers) == ["3.14", "42"]
    assert one(spark, "#ff0080", tx.rgb) == [1.0, 0.0, 128 / 255]
    assert one(spark, "a\u0007b", tx.strip_control) == "ab"
    assert one(spark, "INTRODUCTION", tx.layout_type) == "TITLE" and one(spark, "1. item one of the list that is long enough to count here.", tx.layout_type) == "LIST_ITEM"
    r = spark.range(1).select(tx.base_font(F.lit("Times New Roman"), F.lit("bold"), F.lit("italic")).alias("a"), tx.style_type({"heading_level": F.lit(1)}).alias("b"), tx.style_type({"is_code": F.lit(True)}).alias("c")).first()
    assert tuple(r) == ("timesbi", "HEADING", "CODE")


def blocks(spark, rows):
    return spark.createDataFrame([("d", 0, k, t, s, u) for k, (t, s, u) in enumerate(rows)], "doc_id string, page int, pos int, block_type string, source_text string, translated_text string")


LONG = "This is a long sentence with more than six words in it."


def test_coverage(spark):
    b = blocks(spark, [("HEADING", "Title", "Titre"), ("PARAGRAPH", LONG, "x"), ("EQUATION", "e", None), ("PARAGRAPH", "b", "y")])
    r = coverage.validate(b).first()
    assert (r["translatable"], r["coverage"], r["is_valid"]) == (3, 1.0, True)
    b = blocks(spark, [("PARAGRAPH", "a b", "Translated"), ("PARAGRAPH", "b", None), ("PARAGRAPH", "c", ""), ("PARAGRAPH", "Hello world", "Hello world"), ("PARAGRAPH", "123.456", "123.456")])
    assert [(r["pos"], r["reason"]) for r in coverage.defects(b).orderBy("pos").collect()] == [(1, "missing_translation"), (2, "missing_translation"), (3, "identity_translation")]
    r = coverage.validate(blocks(spark, [("PARAGRAPH", LONG, LONG)])).first()
    assert (r["identity_blocks"], r["is_valid"]) == (1, False)
    r = coverage.validate(blocks(spark, [("EQUATION", "e", None)])).first()
    assert r["coverage"] == 1.0 and r["is_valid"]
    fixed = coverage.repair(b, [lambda x: x.withColumn("translated_text", F.lit("ok"))])
    assert {r["status"] for r in fixed.collect()} == {"ok", "repaired_0"}
    assert [r["attempt"] for r in coverage.final_guard(b, F.col("translated_text")).orderBy("pos").collect()] == [0, 1, 1, 0, 0]


def test_gates(spark):
    m = F.array(F.struct(F.lit("<<M_1>>").alias("placeholder")))
    d = spark.createDataFrame([("a <<M_1>>", "b <<M_1>> réseau", "c <<M_1>> Réseau"), ("a <<M_1>>", "b <<M_1>> réseau", "c Réseau"), ("a", "réseau <<M_1>>", "x <<M_1>>")], "s string, t string, u string")
    got = [r["ok"] for r in d.select(coverage.refinement_ok(F.col("t"), F.col("u"), m, F.array(F.lit("réseau"))).alias("ok")).collect()]
    assert got == [True, False, False]
    assert d.select(coverage.quality_gate(F.col("s"), F.col("t"), m, F.lit(0.9), 0.5).alias("g")).first()["g"]


def test_glossary(spark, tmp_path):
    g = spark.createDataFrame([(0, "neural network", "réseau de neurones", "ml", False), (1, "neuron", "neurone", "ml", False)], "term_id int, source string, target string, domain string, case_sensitive boolean")
    p = spark.createDataFrame([("d", "The NEURAL NETWORK is powerful.", "réseau neuronal"), ("e", "a neuron", "un neurone"), ("f", "nothing", "rien")], "doc_id string, source_text string, translated_text string")
    got = {r["doc_id"]: (r["found"], r["enforced"], r["rate"]) for r in glossary.adherence(p, g, ["doc_id"]).collect()}
    assert got == {"d": (1, 0, 0.0), "e": (1, 1, 1.0), "f": (0, 0, 1.0)}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "ml_en_fr.json").write_text(json.dumps({"domain": "ml", "terms": {"a": "b", "c": "d"}}))
    (tmp_path / "g" / "cs_en_fr.json").write_text(json.dumps({"x": "y"}))
    assert {(r["source"], r["target"], r["domain"]) for r in src.read_glossary(spark, str(tmp_path / "g")).collect()} == {("a", "b", "ml"), ("c", "d", "ml"), ("x", "y", "cs")}


def test_mask_counts_all_types(spark, monkeypatch):
    """Types outside PORTABLE against Python's re, on a fixture that holds each of them."""
    texts = [
        "\\begin{align*}\na &= b\n\\end{align*} and \\begin{table}x\\end{figure}", "\\newcommand{\\R}{x} \\newcommand{\\S} [1] {y} \\providecommand{\\Q}{z}",
        "\\DeclareMathOperator*{\\argmax}{arg} \\alpha \\alphabet \\sum_", "```py\nx = 1\n``` Fig. 2 on page 12", "Table 3.1 a, figure 4; pp. 3-9 and p. 7",
        "see page 4, voir page suivante, cf. p. 9", "Section IV.2, chapter 3, Ch. X", "Intro .... 12\nEnd .. 3 x\nLast ... 4", "nothing here",
    ]
    b = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, source_text string")
    monkeypatch.setattr(queries, "_noted", lambda spark, sf: b)
    got = {r["mask_type"]: r["n"] for r in queries.queries()["mask_counts_all_types"](spark, "").collect()}
    assert set(got) == {n for n, _, _ in masking.PATTERNS}
    for name, _, p in masking.PATTERNS:
        if name not in queries.PORTABLE:
            assert got[name] == sum(1 for t in texts for _ in re.finditer(p, t)) > 0, name


def test_glossary_paths_agree(spark, monkeypatch):
    """Repeated rows, empty terms, and terms that change in lower case: alike on both sides of the limit."""
    b = spark.createDataFrame([(1, "the İstanbul and ΑΣΑ"), (1, "the İstanbul and ΑΣΑ"), (2, ""), (3, None), (4, "of THE ab")], "doc_id int, source_text string")
    g = spark.createDataFrame([(1, "İstanbul", "x", False), (2, "", "y", False), (3, "the", "z", None), (3, "the", "z", None), (4, "ΑΣ", "s", True), (5, "THE", "t", True), (6, "İ", "i", False), (7, None, "n", False), (8, "", "e", True)], "term_id int, source string, target string, case_sensitive boolean")
    small = sorted(map(str, glossary.hits(b, g).collect()))
    monkeypatch.setattr(glossary, "AUTOMATON_BYTES", 1)
    assert sorted(map(str, glossary.hits(b, g).collect())) == small and len(small) == 2 * 7 + 2 + 5


def test_shipped_dictionaries(spark):
    g = glossary.load_domains(spark)
    rows = g.collect()
    assert {r["domain"] for r in rows} == set(glossary.shipped_domains()) and len({r["source"].lower() for r in rows}) == len(rows) > 50
    one = glossary.load_domains(spark, ["physics", "no such domain"], "fr-en")
    assert ("entropie", "entropy") in {(r["source"], r["target"]) for r in one.collect()} and glossary.load_domains(spark, []).count() == 0
    p = spark.createDataFrame([("d", "The Wave Function and the entropy", "la fonction d'onde et l'énergie")], "doc_id string, source_text string, translated_text string")
    assert tuple(glossary.adherence(p, g, ["doc_id"]).first()) == ("d", 2, 1, 0.5)


def test_automaton_is_linear(spark):
    """100,000 terms: the same rows as by plain search on some texts, and hardly more time than for ten terms."""
    rnd = random.Random(1)
    terms = sorted({"".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(4, 9))) for _ in range(100_000)} | {"", "aa"})
    built = automaton.build(terms)
    for _ in range(20):
        t = "".join(rnd.choice("abcdefghij ") for _ in range(200))
        assert automaton.standing(*built, t) == {k for k, w in enumerate(terms) if w in t}
    few, texts = automaton.build(terms[5:15]), ["".join(rnd.choice("abcdefghij ") for _ in range(2000)) for _ in range(300)]

    def seconds(a):
        begun = time.perf_counter()
        found = sum(len(automaton.standing(*a, t)) for t in texts)
        return time.perf_counter() - begun, found

    (few_s, _), (all_s, found) = seconds(few), seconds(built)
    assert all_s < 50 * few_s + 2e-6 * found + 0.5
    g = spark.createDataFrame([(k, w, w.upper(), k % 3 == 0) for k, w in enumerate(terms) if w], "term_id int, source string, target string, case_sensitive boolean")
    b = spark.createDataFrame([(k, t.upper() if k % 2 else t) for k, t in enumerate(texts[:40])], "doc_id int, source_text string")
    want = {(d, k) for d, t in enumerate(texts[:40]) for k in automaton.standing(*built, t) if terms[k] and (d % 2 == 0 or k % 3)}
    assert {(r["doc_id"], r["term_id"]) for r in glossary.hits(b, g).collect()} == want


def test_glossary_beyond_broadcast(spark, monkeypatch):
    b = queries._blocks(spark, SF).limit(200).cache()
    g = glossary.demo(spark)
    small = {tuple(r) for r in glossary.hits(b, g).select("doc_id", "pos", "term").collect()}
    monkeypatch.setattr(glossary, "AUTOMATON_BYTES", 1)
    assert {tuple(r) for r in glossary.hits(b, g).select("doc_id", "pos", "term").collect()} == small


def test_metrics(spark):
    p = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat", "Value 3.14 and 42", "Valeur 3,14"), (2, "a b c d", "a b c d", "none", "none")], "pair_id int, hypothesis string, reference string, source_text string, translated_text string").withColumn("k", F.lit(1))
    assert metrics.bleu(p, ["k"]).first()["bleu"] == 1.0 and metrics.chrf(p, ["k"]).first()["chrf"] == 1.0
    assert metrics.numeric_consistency(p, ["k"]).first()["consistency"] == 0.5 and metrics.comet(p, ["k"]).first()["comet"] is None
    with pytest.raises(ValueError):
        metrics.check_aligned(p, p.where("pair_id = 1"), ["pair_id"])


def test_scoring(spark):
    m = F.array(F.struct(F.lit("<<M>>").alias("placeholder")))
    d = spark.createDataFrame([("b", 0, "See Figure 3.", "Voir Figure 3."), ("b", 1, "See Figure 3.", "<<M>> autre"), ("c", 0, "x", "y")], "block string, candidate_id int, source_text string, text string")
    s = scoring.score(d.withColumn("masks", F.when(F.col("block") == "b", m).otherwise(F.array().cast("array<struct<placeholder:string>>"))).withColumn("previous", F.array(F.lit("autre autre"))), [("figure", "figure")])
    r = scoring.rerank(s, ["block"]).where("rank = 1").orderBy("block").collect()
    assert [x["candidate_id"] for x in r] == [1, 0]
    assert sum(scoring.adapt(scoring.WEIGHTS, {"fluency": 1.0}).values()) == pytest.approx(1)


def test_context_and_layout(spark):
    b = blocks(spark, [("PARAGRAPH", f"s{k}", f"t{k}" if k % 2 else None) for k in range(8)])
    last = {r["pos"]: r["previous"] for r in context.last_translations(b, 2).collect()}
    assert last[0] == [] and last[2] == ["t1"] and last[7] == ["t3", "t5"]
    x = spark.createDataFrame([("d", 0, 0, 0.0, 0.0, 10.0, 10.0), ("d", 0, 1, 100.0, 0.0, 110.0, 10.0)], "doc_id string, page int, pos int, x0 double, y0 double, x1 double, y1 double")
    det = spark.createDataFrame([("d", 0, 0, "text", 0.0, 0.0, 10.0, 10.0), ("d", 0, 1, "figure", 0.0, 0.0, 10.0, 10.0)], "doc_id string, page int, det_idx int, cls string, x0 double, y0 double, x1 double, y1 double")
    assert [(r["det_idx"], r["iou"]) for r in layout.match_detections(x, det).orderBy("pos").collect()] == [(0, 1.0), (None, None)]
    assert layout.columns(x).first()["columns"] == 2
    assert report.render_text(b.where("pos < 2")).first()["text"] == "s0\n\nt1"


def test_translate(spark):
    b = spark.createDataFrame([(1, "the cat"), (2, "the cat"), (3, " ")], "k int, source_text string")
    calls = spark.sparkContext.accumulator(0)

    def upper(texts):
        calls.add(len(texts))
        return [t.upper() for t in texts]

    got = [r["translated_text"] for r in translate.translate_distinct(b, upper).orderBy("k").collect()]
    assert got == ["THE CAT", "THE CAT", " "] and calls.value == 1
    parts = one(spark, "One two. Three four! " + "x" * 25, lambda c: translate.chunk(c, 10))
    assert parts == ["One two.", "Three", "four!"] or all(len(p) <= 10 for p in parts)
    kept = one(spark, "See <<MATH_0001>> here.\n\nAlso <<URL_0002>> there.", lambda c: translate.chunk_masked(c, 25))
    assert "".join(kept).count("<<MATH_0001>>") == 1 and all(p.count("<<") == p.count(">>") for p in kept)


def test_document_json(spark, tmp_path):
    doc = {"document_id": "d", "source_lang": "en", "segments": [{"segment_id": "s", "blocks": [{"block_id": "b0", "source_text": "x", "block_type": "Kind.HEADING", "bbox": {"x0": 1, "page": 0}}, {"block_id": "b1", "block_type": "WEIRD"}]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    r = src.flatten(src.read_documents(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(x["block_id"], x["block_type"], x["pos"]) for x in r] == [("b0", "HEADING", 0), ("b1", "PARAGRAPH", 1)]
    assert json.loads(report.document_json(src.flatten(src.read_documents(spark, str(tmp_path))).select("doc_id", "pos", "block_id")).first()["json"])[1]["block_id"] == "b1"


def test_config(tmp_path):
    (tmp_path / "c").write_text("name: x\nworkers: 3\n")
    assert src.load_config({"name": "d", "workers": 1}, str(tmp_path / "c"), environ={"LOOMTEXT_NAME": "env"})["name"] == "env"


def test_stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = events.rate(s, 3600, late="1 hour").writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("rates").collect()} == {tuple(r) for r in events.rate(e.withColumn("ts", F.col("ts").cast("timestamp")), 3600).collect()}


def normal(d: pd.DataFrame) -> pd.DataFrame:
    d = d[sorted(d.columns)].copy()
    for c in d.columns:
        d[c] = d[c].map(lambda v: "null" if v is None or v is pd.NaT or v != v else f"{float(v):.6f}" if hasattr(v, "dtype") and v.dtype.kind in "iuf" or isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return d.sort_values(list(d.columns)).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(oracles.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    a, b = normal(queries.queries()[name](spark, SF).toPandas()), normal(con.execute(oracles.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_mask_spans_search_each_text_once(spark):
    """Rows of spans come from one search for each pattern, not one more for each use of the spans."""
    d = spark.createDataFrame([(0, "see https://a.org/b and [1]"), (1, None), (2, "plain")], "pos int, source_text string")
    x = masking.spans(d, patterns=[p for p in masking.PATTERNS if p[0] == "url_full"]).select("pos", F.explode("spans").alias("s"))
    assert x._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    assert [(r["pos"], r["s"]["start"], r["s"]["end"]) for r in x.collect()] == [(0, 4, 19)]
    # what settles texts and places without a search speaks of the shipped patterns only
    own = masking.spans(d, patterns=[("url_full", 60, "plain"), ("page_reference", 50, "a")]).orderBy("pos").collect()
    assert [len(r["spans"]) for r in own] == [2, 0, 1] and own[2]["spans"][0]["name"] == "url_full"


def test_numbers_are_those_of_the_sql(spark):
    """A number that touches a letter goes whole: no part of its digits is left to count."""
    texts = ["1.5a", "a1.5 2", "12.34.56b", "3a4 5", "x_7 8_ 9", "\u00e912 \u00b23 \u00bd4 5\u00b5 6", "1,5 2.50. 3", "", "34a45 1.2.3", "v2.0.1-rc3 10%", "5.12.13a7 .5 x.5 5.a1.2.3"]
    x = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = [r["n"] for r in x.select("k", scoring._numbers(F.col("t")).alias("n")).orderBy("k").collect()]
    con = duckdb.connect()
    assert got == [con.execute(f"select {oracles._NUM.format('?::varchar')}", [t]).fetchone()[0] for t in texts]
    assert got[0] == [] and got[1] == ["2"]


def test_scores_make_each_array_once(spark):
    """Deviations and means don't make their array again for each element or use."""
    from loomtext.operators import scoring

    d = spark.createDataFrame([("The cat sat. A dog ran far away. 12 Birds (sing) 3.5",), ("",), (None,)], "t string")
    x = d.select(scoring.fluency(F.col("t")).alias("f"), scoring.consistency(F.col("t"), F.array(F.lit("birds birds"), F.lit("horse horse"))).alias("c"))
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("lower(t") == 1
    rows = x.collect()
    words, lengths = 12, [3, 5, 4]
    mean = sum(lengths) / 3
    deviation = (sum((n - mean) ** 2 for n in lengths) / 3) ** 0.5
    parts = [1 - (1 / words) / 0.3, deviation / 10, max(0, 1 - abs(3 / words - 0.15) / 0.15), max(0, 1 - abs(3 / words - 0.1) / 0.1)]
    assert rows[0]["f"] == pytest.approx(sum(parts) / 4) and rows[0]["c"] == 0.5 and rows[1]["f"] == 0


def test_learned_glossary_first_word_once(spark):
    """The first word of a translation is found below the generator of words: once for each block."""
    d = spark.createDataFrame([("en", 1, 0, "Neural nets, neural", "Réseaux de"), ("en", 1, 1, "", "x"), ("en", 2, 0, "neural with cats", "\tAutre mot"), ("en", 2, 1, "lone", " ")], "lang string, doc_id int, pos int, source_text string, translated_text string")
    x = glossary.learned(d)
    assert {(r["word"], r["target"]) for r in x.collect()} == {("neural", "réseaux"), ("nets,", "réseaux"), ("cats", "autre")}
    plan = x._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(plan) if "posexplode" in line)
    assert not any("translated_text" in line for line in plan[:at]) and sum(line.count("regexp_extract_all(") for line in plan) == 1


def test_scores_share_a_block_s_parts(spark):
    """What scores take from a source and from previous translations is made once a block, below its candidates; parts of a candidate once for both dimensions."""
    from loomtext.operators import scoring

    rows = [(0, "Die Katze [1] sah 3.5 Ziele", ["Horse horse (Figure", "figure (figure horse"]), (1, "", []), (2, None, None), (3, "1 Ab Ab", [None, "horse horse"])]
    d = spark.createDataFrame(rows, "pos int, source_text string, previous array<string>")
    texts = ["A cat saw 3.5 aims. The horse (figure [x", "The the THE then İabc i̇abc word word word word Horse  Horse ", "", None]
    masks = F.array().cast("array<struct<placeholder:string>>").alias("masks")
    explode = lambda b, *more: b.select("pos", "source_text", "previous", *more, masks, F.posexplode(F.array(*map(F.lit, texts))).alias("candidate_id", "text"))
    terms = [("horse", "cheval")]
    shared, alone = scoring.score(explode(scoring.prepared(d), "_source", "_often"), terms), scoring.score(explode(d), terms)
    key = ["pos", "candidate_id"]
    assert shared.orderBy(*key).drop("masks").collect() == alone.orderBy(*key).drop("masks").collect()
    got = {(r["pos"], r["candidate_id"]): r for r in shared.collect()}
    assert got[0, 0]["consistency"] == 1 and got[0, 1]["consistency"] == 0.5 and got[3, 0]["consistency"] == 1
    plan = shared._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(plan) if "posexplode" in line)
    assert not any("regexp_extract_all(source_text" in line or "regexp_extract_all(lower(lambda" in line for line in plan[:at])
    assert sum(line.count("regexp_extract_all(text#") for line in plan[:at]) <= 6  # words, capitals, long words, numbers, punctuation, brackets
    count = lambda words: spark.range(1).select(scoring.top_count(F.array(*map(F.lit, words)).cast("array<string>"))).first()[0]
    assert [count(w) for w in ([], ["a"], ["b", "a", "b"], ["ab", "a", "a", "ab"], ["x\u0085", "x", "x\u0085"], ["w"] * 20000)] == [0, 1, 2, 2, 2, 20000]


def test_normalize_searches_once(spark):
    """Outer spaces go without a pattern, and one search finds the inner ones that change anything; \\s, nothing else, is a space."""
    texts = [" a  b\tc \n", "\r\n\x0b\x0ca b", "a\n b \t  C", "", " \t ", "é  x ", "a b", "abc \u0085", "  x "]
    d = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string").select("k", "t", tx.trim_ws("t").alias("trimmed"), tx.normalize("t").alias("n"))
    ascii_spaces = " \t\n\x0b\f\r"
    for r in d.collect():
        want = None if r["t"] is None else r["t"].strip(ascii_spaces)
        assert r["trimmed"] == want and r["n"] == (None if want is None else re.sub(r"\s+", " ", want.lower(), flags=re.ASCII))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def test_validation_text_takes_one_pass(spark):
    """All lists of a report come from one pass over the blocks, beside the one that validated takes."""
    long = "one two three four five six seven eight nine"
    rows = [("d", k, "PARAGRAPH", "s", None) for k in range(7)] + [("d", 7, "PARAGRAPH", long, long), ("d", 8, "PARAGRAPH", "s", "<<A>> x"), ("d", 9, "EQUATION", "s", None), ("e", 0, "PARAGRAPH", "s", "<<A>> <<B>>")]
    masks = F.array(*(F.struct(F.lit(p).alias("placeholder"), F.lit("t").alias("mask_type")) for p in ("<<A>>", "<<B>>")))
    b = spark.createDataFrame(rows, "doc_id string, pos int, block_type string, source_text string, translated_text string").withColumn("masks", F.when(F.col("pos") != 7, masks))
    x = report.validation_text(b, coverage.validate(b))
    assert {r["doc_id"]: r["report"] for r in x.collect()} == {"d": "not valid: 2 of 9 blocks translated\n7 without a translation: 0, 1, 2, 3, 4 and 2 more\n1 copied from the source: 7\n1 lost placeholders: 8 <<B>> (t)", "e": "valid: 1 of 1 blocks translated"}
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2


def test_sizes_of_equal_texts_once(spark):
    """Words are counted without a step for each of them, and those of a reference that equals its hypothesis aren't counted again."""
    d = spark.createDataFrame([("g", "  a b c ", "  a b c "), ("g", "a  b", "\x1ca b c d"), ("g", None, "x"), ("g", " ", "")], "k string, h string, r string")
    x = metrics._clipped(d, ["k"], F.col("h"), F.col("r"), 2, True)
    assert {r["n"]: (r["h"], r["r"], r["m"]) for r in x.collect()} == {1: (5, 8, 5), 2: (3, 5, 3)}
    assert "filter(split(" not in x._jdf.queryExecution().optimizedPlan().toString()


def test_scores_count_whole_batches(spark, monkeypatch):
    """Words are counted for whole batches, without an expression that makes an array of them; counts are those of the expressions."""
    import random

    import pyarrow as pa

    from loomtext.functions import batches
    from loomtext.operators import scoring

    r = random.Random(5)
    bits = ["word", "Word", "WORD", "İabc", "i̇abc", "ΣΑΣΣ", "σασς", "σασσ", "Éa", "é", "Ǆungla", "\U00010400bcd", "\U00010428bcd", "𝟘𝟘𝟘𝟘", "x\u0085yz", "a b", ".", ". ", " . ", ".", "(", "[3.5)", ";", "12", "1.5a", " ", "\t", "\n", "\x0b", "\x1c", "\r\n", ".\t"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", " "]) for _ in range(r.randrange(40))) for _ in range(400)] + ["", " ", ". ", ". . ", "a. ", None]
    d = spark.createDataFrame([(k, t, texts[k - 1], [texts[k - 1], t]) for k, t in enumerate(texts)], "k int, text string, source_text string, previous array<string>")
    x = d.withColumn("c", batches.source_words("source_text")).select("k", "text", "source_text", "previous", "c", batches.text_counts("text", "c.capitals").alias("n"), scoring.counts(F.col("text")).alias("want"), F.size(F.array_intersect(scoring.capitals(F.col("source_text")), scoring.capitals(F.col("text")))).alias("kept"), tx.count("text", r"[(\[]").alias("opened"))
    x = x.withColumns({"fast": scoring.fluency(F.col("text"), F.col("n")), "slow": scoring.fluency(F.col("text"))})
    for row in x.orderBy("k").collect():
        if row["text"] is None:
            assert row["n"] is None and row["fast"] == row["slow"]
            continue
        n, want = row["n"].asDict(), row["want"].asDict()
        assert {c: n[c] for c in want} == want, row["text"]
        assert n["opened"] == row["opened"] and n["kept"] == (row["kept"] if row["source_text"] is not None else 0) and row["fast"] == row["slow"]
    # any runs give the same rows
    t, runs = pa.array([t or "" for t in texts]), batches.repeated_words.func
    caps, lists = batches._source(t).field("capitals"), pa.array([[a or "", b or ""] for a, b in zip(texts, texts[1:])])
    whole, often = batches._counts(t, caps), runs(lists)
    monkeypatch.setattr(batches, "RUN_BYTES", 50)
    assert batches.text_counts.func(t, caps).to_pylist() == whole.to_pylist() and [set(w) for w in runs(lists).to_pylist()] == [set(w) for w in often.to_pylist()]
    low = [(a or "").lower() + " " + (b or "").lower() for a, b in zip(texts, texts[1:])]
    words = [[w for w in re.findall(r"[^ \t\n\x0b\f\r]+", t) if len(w) >= 5] for t in low]
    assert [set(w) for w in often.to_pylist()] == [{w for w in ws if ws.count(w) > 1} for ws in words]
    # every dimension may be taken alone
    s = scoring.score(d.withColumn("masks", F.array(F.struct(F.lit("a").alias("placeholder")))), [("word", "mot")])
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text_counts(") == plan.count("source_words(") == plan.count("repeated_words(") == 1 and plan.count("regexp_extract_all(text#") == 1  # numbers, where a source has any
    every = [row.asDict() for row in s.orderBy("k").collect()]
    for c in (*scoring.WEIGHTS, "total"):
        assert [row[c] for row in s.select("k", c).orderBy("k").collect()] == [row[c] for row in every]


def test_scores_lower_a_candidate_once(spark):
    """Terminology and consistency share a candidate's text in lower case."""
    from loomtext.operators import scoring

    d = spark.createDataFrame([("Horse WORD", "horse x", ["HORSE a", "b horse"])], "text string, source_text string, previous array<string>")
    s = scoring.score(d.withColumn("masks", F.array(F.struct(F.lit("a").alias("placeholder")))), [("Mot", "word"), ("x", "y")])
    assert s.select("terminology", "consistency").first() == (0.5, 1.0)
    assert s._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
