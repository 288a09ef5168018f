"""Filter audit, URL rules and periodic runs against brute-force versions on small tables of hard cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from loomtext.llm import filter_audit, periodic_runs, queries, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def audited_rows():
    rnd = random.Random(8)
    prose = lambda n, v: " ".join(rnd.choice(v) for _ in range(n))
    many = [f"w{k}" for k in range(900)]
    texts = [None, "", " \t", "same", "same", "same", "ABC DEF", "a # b", "é" * 50, "x" * 9000]
    for _ in range(60):
        t = prose(rnd.choice([20, 99, 100, 150]), rnd.choice([many, many[:30]]))
        t = t.upper() if rnd.random() < 0.2 else t
        texts.append(t + rnd.choice(["", "", " 5%", " $x|y"]))
    texts += rnd.choices(texts, k=40)
    rows = [(k, t, rnd.choice(["en", "de", None, ""]), "E", 1, "extra") for k, t in enumerate(texts)]
    # repeated rows, rows without an id, one id with two texts
    rows += [rows[5], rows[20], (None, "same", "en", "E", 1, "extra"), (None, "only here", "en", "E", 1, "extra"), (4, "another text", "en", "E", 1, "extra")]
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for k in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5000, 1, 1)]
    return rows, labels


def brute_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    judged = []
    for d, t, lang, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        judged.append((lang or "", fails, d in good, d in toxic))
    out = []
    for part in {j[0] for j in judged}:
        mine, taken = [j for j in judged if j[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for s, f in enumerate(order, 1):
                gone, stay = [j for j in left if j[1][f]], [j for j in left if not j[1][f]]
                taken[f] += len(gone)
                fail = [j for j in mine if j[1][f]]
                out.append((part, order, s, len(stay), len(gone), len(fail) - len(gone), sum(sum(j[1].values()) == 1 for j in fail), sum(j[2] for j in gone), sum(j[3] for j in gone)))
                left = stay
        out = [r if len(r) == 10 or r[0] != part else (*r, taken[r[1][r[2] - 1]]) for r in out]
    return sorted(out)


def test_filter_audit(spark):
    rows, labels = audited_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mask string, n int, digest string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.mask_counts(docs, marks), "ABCDE")
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)
    assert filter_audit.audit(filter_audit.mask_counts(docs.limit(0), marks), "ABCDE").count() == 0
    assert sorted(map(tuple, filter_audit.audit(filter_audit.mask_counts(docs, marks.limit(0)), "ABCDE").collect())) == brute_audit(rows, [])


def test_filter_audit_own_filters(spark):
    """Two filters beside the copies; survivors of every subset are counted directly."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, "x" * (k % 5) + "y" * (k % 3)) for k in range(40)], "doc_id long, text string").withColumn("lang", F.lit("p"))
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = filter_audit.mask_counts(docs, marks, {"S": F.length("t") < 3, "Y": F.contains("t", F.lit("y"))})
    (row,) = filter_audit.survivors(counts, 3).collect()
    texts = [("x" * (k % 5) + "y" * (k % 3)) for k in range(40)]
    masks = [(len(t) < 3) + 2 * ("y" in t) + 4 * (t in texts[:k]) for k, t in enumerate(texts)]
    assert row.n == [sum(not m & s for m in masks) for s in range(8)]
    with pytest.raises(ValueError):
        filter_audit.survivors(counts, 8)


def brute_url(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2] if best else None, best[3] if best else default)


URLS = [None, "", "no scheme", "http://", "http:///x", "HTTP://EXAMPLE.ORG/ES/", "http://example.org/es/", "http://www.Example.Org/es/a?b#c", "http://example.org/es", "http://example.org/en/17", "http://xexample.org/en/1", "https://a.com/fr/x", "https://a.com/de/", "https://a.com/de?x", "com/fr/", "x://com/fr/", "x://a.b.c.com:80/fr/", "x://user@a.com/fr/", "x://..org/", "x://org./", "x://a.org#/es/", "x://É.Org/ß/\n/q", "x://y://a.com/fr/", "x://example.org//es/", "http://b.org/xyz", "http://a.b.org/xyz"]


def test_url_filters(spark):
    rnd = random.Random(4)
    hosts, paths = ["org", "example.org", "a.com", "b.c.example.org", "com", "net", ""], ["", "/", "/es/", "/es/x", "/en/1", "/en/12", "/fr/", "/de/", "/" + "long/" * 300]
    urls = URLS + [f"http://{rnd.choice(['', 'www.', 'm.'])}{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?q=/es/', '#f'])}" for _ in range(300)]
    pages = spark.createDataFrame([(k % 250, u, "h", "p", 1) for k, u in enumerate(urls)], "page_id long, url string, host string, path string, found int").repartition(3)
    more = [("allow", "b.org", "/xy"), ("block", "a.b.org", "/"), ("block", "com", "/" + "long/" * 300), ("allow", "NET", "/es/"), ("block", "net", "/es/"), ("block", "", "/"), ("allow", "org", "/")]
    for rules in (queries.URL_RULES, queries.URL_RULES + more):
        r = spark.createDataFrame(rules + [("block", None, "/"), ("block", "org", None)], "action string, host string, path string")
        want = sorted((u or "", *map(str, brute_url(u, [(a, h.lower(), p) for a, h, p in rules]))) for u in urls)
        for most in (url_filters.BROADCAST_BYTES, 0):
            kept, url_filters.BROADCAST_BYTES = url_filters.BROADCAST_BYTES, most
            x, n = url_filters.judge(pages, r)
            url_filters.BROADCAST_BYTES = kept
            got = sorted((g["url"] or "", *(str(g[n[c]]) for c in ("host", "path", "rule", "verdict"))) for g in collected(x))
            assert got == want and set(pages.columns) <= set(x.columns)
    none, n = url_filters.judge(pages, r.limit(0), default="block")
    assert {(g[n["rule"]], g[n["verdict"]]) for g in collected(none)} == {(None, "block")}
    assert url_filters.judge(pages.limit(0), r)[0].count() == 0


def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapse(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_runs_of_fuzz():
    rnd = random.Random(1)
    for _ in range(1500):
        texts = []
        for _ in range(rnd.randint(1, 5)):
            w = [rnd.randrange(rnd.choice([1, 2, 3])) for _ in range(rnd.randint(0, 40))]
            if rnd.random() < 0.5:
                w += [rnd.randrange(3) for _ in range(rnd.randint(1, 7))] * rnd.randint(1, 9) + [rnd.randrange(3) for _ in range(rnd.randint(0, 5))]
            texts.append(w)
        bounds = np.cumsum([0] + [len(t) for t in texts])
        got = periodic_runs.runs_of(np.array(sum(texts, []), np.int32), bounds)
        want = [(t, int(bounds[t]) + s, int(bounds[t]) + s + n, q) for t, w in enumerate(texts) for s, n, q in brute_runs(w)]
        assert [tuple(map(int, r)) for r in got] == want


def test_z_function():
    rnd = random.Random(2)
    for _ in range(200):
        x = [rnd.randrange(2) for _ in range(rnd.randint(0, 30))]
        assert periodic_runs.z_function(x) == [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]


def run_rows():
    rnd = random.Random(9)
    texts = [None, "", " \t\r\n", "one", "a " * 5, "a " * 6, "\x0ba\x0ca a\ra\na\ta ", "x y " * 4, "x y " * 4 + "x", "ab a b ab a b ab a b ab a b", "é ß " * 5 + "中", "\x1ca " * 9, "a\xa0b " * 7, "no run here at all", "a b a b a b a b c c c c c c b a b a b a b a", "w" * 3000 + " x" * 20]
    texts += [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    texts += [" ".join(rnd.choice("abcdefgh") for _ in range(300)) for _ in range(60)]
    return [(k, t, "r", 3) for k, t in enumerate(texts)] + [(5, "a " * 6, "r", 3), (None, "b " * 8, "r", 3)]


def test_periodic_runs_operator(spark):
    d = spark.createDataFrame(run_rows(), "doc_id long, text string, runs string, n_words int").repartition(3)
    x, n = periodic_runs.find(d)
    got = collected(x)
    assert len(got) == len(run_rows()) and {"runs", "n_words"} <= set(x.columns)
    for r in got:
        w = WORD.findall(r["text"] or "")
        runs = brute_runs(w)
        assert r[n["n_words"]] == len(w) and [tuple(v.values()) for v in r[n["runs"]]] == runs
        assert r[n["collapsed"]] == collapse(w, runs)
    assert periodic_runs.find(d.limit(0))[0].count() == 0


def test_long_text_runs(spark):
    """A text longer than one pass, with a run of many words over its middle."""
    rnd = random.Random(3)
    base = [f"longword{rnd.randrange(5000)}" for _ in range(20_000)]
    w = base + base[:9000] * 5 + base[::-1] + ["z"] * 300
    d = spark.createDataFrame([(1, " ".join(w)), (2, "a " * 30)], "doc_id long, text string")
    x, n = periodic_runs.find(d)
    assert len(" ".join(w)) > periodic_runs.PASS_BYTES
    long, short = sorted(collected(x), key=lambda r: r["doc_id"])
    assert [tuple(v.values()) for v in long[n["runs"]]] == [(20_000, 45_000, 9000), (85_000, 300, 1)] and long[n["collapsed"]] == collapse(w, [(20_000, 45_000, 9000), (85_000, 300, 1)])
    assert [tuple(v.values()) for v in short[n["runs"]]] == [(0, 30, 1)]


def test_periodic_runs_query(spark, tmp_path):
    """The whole query, texts with repeated tails included, against plain loops."""
    rnd = random.Random(10)
    rows = [(k, t) for k, t, *_ in run_rows()] + [(k, " ".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 200)))) for k in range(200, 500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()))
    want, tails = Counter(), 0
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d, t in rows:
        w = WORD.findall(t or "")
        h = None if d is None else zlib.crc32(str(d).encode())
        if h is not None and h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            tails += 1
        runs = brute_runs(w)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        want[d, len(runs), s, n, q, n and 1000 * n // q, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapse(w, runs))] += 1
    assert got == want and tails > 20
