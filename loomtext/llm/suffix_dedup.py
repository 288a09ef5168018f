"""Removal of repeated byte strings by a distributed difference-cover sort.

1. Candidates. Every string of LENGTH bytes holds an anchor, its least GRAM-byte gram by hash, and equal strings hold it at the
   same place. Texts list their anchors, each with the run of strings that it is the anchor of; anchors that occur once
   drop out. Runs whose bytes all agree by hash are collapsed into the first of them, the claim is checked byte by byte
   against that first one, and runs that fail it go through the sort like the rest. Hashes never remove anything by themselves.
2. Sampled triples. What is left are pieces of text around anchors that have several neighbourhoods. Blocks of BLOCK bytes
   are counted from the anchor, so equal strings are cut alike. Triples of blocks at places 1 and 2 modulo 3 are sorted over
   all tasks (range partitions of distinct triples, so a hot one counts once) and named by their place in that order.
3. Recursion. The names are strings themselves, nine blocks to a triple of them; as that reaches to within a string's length,
   the recursion ends there: triples of names are sorted and named in the same way.
4. Remaining suffixes. Each string starts with up to two blocks' bytes before the next sampled place and has the name of
   the nine blocks from there; that and the few bytes on both sides are its sort key. All strings are sorted over all tasks,
   equal ones by place, and neighbours in that order are compared. All but the first of equal ones are late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, discard, fresh, materialize, passes, raw_texts
from .shingles import _power, mix

LENGTH, GRAM = 100, 32
#: Bytes of a block: nine of them and the two at most before a sampled place fit into a string.
BLOCK = 9
#: Ranges of the anchor's place in a string: strings of one range share a core, and only cores that repeat are sorted.
RANGES = (0, 17, 34, 51, LENGTH - GRAM + 1)
#: Longer texts are cut into pieces, which overlap so that no string is lost.
PIECE = 1 << 20
#: Bytes of a first run that are checked together.
CELL = 256
LAST = 2**63 - 1
#: Keys of copies are broadcast up to so many bytes (48 a key); more of them are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def anchors(b: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts b[off[k]:off[k+1]]: text number, gram hash, anchor's place, first and last start of its strings, their bytes' hash."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64, np.uint64))
    n = len(b)
    if n < length:
        return empty
    up, down = _power(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
        h = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    # least (hash, place) of each run of length - gram + 1 grams, by doubling
    least = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width, want = 1, length - gram + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    start = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])
    if not len(start):
        return empty
    q, t = at[start], text[start]
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (t[1:] != t[:-1])])
    first = np.flatnonzero(new)
    lo, hi = start[first], start[np.concatenate([first[1:], [len(start)]]) - 1]
    with np.errstate(over="ignore"):
        around = mix((sums[hi + length] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    q = q[first]
    around = mix(around ^ (q - lo).astype(np.uint64))
    return t[first], h[q], q, lo, hi, around


def _unique(few: DataFrame) -> DataFrame:
    """The side of a join that has each key once and fewer rows: it is hashed in each partition, so that the larger side is not sorted."""
    return few.hint("shuffle_hash")


def _sub(body: str, start: Column, length: Column) -> Column:
    return F.substring(body, start.cast("int"), length.cast("int"))


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


ANCHOR = T.StructType(_longs("ord", "h", "gram", "around", "lo", "hi", "q"))


def _list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b, off = raw_texts(batch.column("text"))
        for i, j in passes(off, 256 << 10):
            for at in range(0, max(1, off[j] - off[i] - LENGTH + 1), PIECE):  # several pieces only for a long text
                piece = b[off[i] + at : min(off[j], off[i] + at + PIECE + LENGTH - 1)]
                bounds = off[i : j + 1] - off[i] if off[j] - off[i] <= PIECE + LENGTH - 1 else np.array([0, len(piece)])
                t, g, q, lo, hi, around = anchors(piece, bounds)
                rows, base = pa.array(t + i), bounds[t] - at
                yield pa.RecordBatch.from_arrays([batch.column("ord").take(rows), batch.column("h").take(rows), *map(pa.array, (g.view(np.int64), around.view(np.int64), lo - base, hi - base, q - base))], names=[f.name for f in ANCHOR])


def _list_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only the anchors' grams: what repeats is found without moving the rest."""
    for x in _list_anchors(batches):
        yield x.select(["gram"])


#: What is wanted of a text: late runs (a: lo, b: hi, c, d: text that holds the first, e: its lo), cells of first runs (a: number), pieces (a: lo, b: hi, c: id, d: anchor).
LATE, FIRST, PIECES = range(3)
CUT = T.StructType([T.StructField("kind", T.IntegerType()), *_longs("k1", "k2", "k3", "at", "ord", "h"), T.StructField("body", T.BinaryType())])


def _want(kind: int, *values) -> Column:
    return F.struct(F.lit(kind).alias("kind"), *(F.lit(0).cast("long").alias(n) if v is None else F.col(v).cast("long").alias(n) for n, v in zip("abcde", [*values, *[None] * 5])))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b, off = raw_texts(batch.column("text"))
        raw, o, h = b.tobytes(), batch.column("ord").to_numpy(), batch.column("h").to_numpy()
        row = pc.list_parent_indices(batch.column("wants")).to_numpy()
        kind, *x = (c.to_numpy() for c in batch.column("wants").flatten().flatten())

        def cut(kind: int, row: np.ndarray, keys: list, at, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
            """A row for each [start, stop) of texts; what lies behind a text's end is not there."""
            ends = np.minimum(off[row] + stop, off[row + 1])
            body = pa.array([raw[i:j] for i, j in zip((off[row] + start).tolist(), ends.tolist())], pa.binary())
            longs = (pa.array(np.broadcast_to(np.asarray(c, np.int64), len(row))) for c in (*keys, at, o[row], h[row]))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), kind, np.int32)), *longs, body], names=[f.name for f in CUT])

        some = kind == FIRST
        r, cell = row[some], x[0][some]
        yield cut(FIRST, r, [o[r], h[r], cell], 0, cell * CELL, (cell + 1) * CELL)
        some = kind == PIECES
        lo, hi, no, q = (v[some] for v in x[:4])
        yield cut(PIECES, row[some], [no, 0, 0], q - lo, lo, hi + LENGTH)
        some = np.flatnonzero(kind == LATE)
        if not len(some):
            continue
        lo, hi, fo, fh, flo = (v[some] for v in x)
        order = np.lexsort((lo, flo - lo, fh, fo, row[some]))
        r, lo, hi, fo, fh, shift = (v[order] for v in (row[some], lo, hi, fo, fh, flo - lo))
        # runs that follow each other here and there are one run; it is checked cell by cell of the first text
        new = np.append(True, lo[1:] > hi[:-1] + LENGTH)
        for v in (r, fo, fh, shift):
            new[1:] |= v[1:] != v[:-1]
        new = np.flatnonzero(new)
        start, stop, (r, fo, fh, shift) = lo[new], np.maximum.reduceat(hi, new) + LENGTH, (v[new] for v in (r, fo, fh, shift))
        first = (start + shift) // CELL
        cells = (stop + shift - 1) // CELL + 1 - first
        one = np.repeat(np.arange(len(new)), cells)
        cell = first[one] + np.arange(len(one)) - np.repeat(np.cumsum(cells) - cells, cells)
        r, fo, fh, shift = (v[one] for v in (r, fo, fh, shift))
        start, stop = np.maximum(start[one], cell * CELL - shift), np.minimum(stop[one], (cell + 1) * CELL - shift)
        yield cut(LATE, r, [fo, fh, cell], start + shift - cell * CELL, start, stop)


def _fetch(texts: DataFrame, wants: DataFrame) -> DataFrame:
    """What is wanted (ord, h, want) of texts, cut out and written."""
    lists = wants.groupBy("ord", "h").agg(F.collect_list("want").alias("wants"))
    return materialize(texts.join(_unique(lists), ["ord", "h"]).select("ord", "h", "text", "wants").mapInArrow(_cut_out, CUT))


def _named(keys: DataFrame, name: str) -> DataFrame:
    """Distinct rows of keys with a number that grows in their order: a sort over all tasks."""
    ordered = keys.distinct().repartitionByRange(*keys.columns).sortWithinPartitions(*keys.columns)
    return materialize(ordered.withColumn(name, F.monotonically_increasing_id()))


def sampled_names(pieces: DataFrame) -> DataFrame:
    """(id, names: {place: name of the nine blocks from there}) of pieces (id, at: the anchor, body): triples of blocks at places 1 and 2 modulo 3, then triples of their names."""
    last = F.floor((F.octet_length("body") - F.col("at") - 3 * BLOCK) / BLOCK)
    places = F.filter(F.sequence(-F.floor(F.col("at") / BLOCK), last), lambda j: F.pmod(j, F.lit(3)) != 0)
    triples = pieces.where(last >= -F.floor(F.col("at") / BLOCK)).select("id", "at", "body", F.explode(places).alias("j"))
    triples = triples.select("id", "j", _sub("body", F.col("at") + BLOCK * F.col("j") + 1, F.lit(3 * BLOCK)).alias("bytes"))
    names = _named(triples.select("bytes"), "name")
    reduced = triples.join(_unique(names), "bytes").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("j", "name"))).alias("m"))
    at = lambda j: F.element_at("m", j)
    trios = F.filter(F.transform(F.map_keys("m"), lambda j: F.struct(j.alias("j"), at(j).alias("x"), at(j + 3).alias("y"), at(j + 6).alias("z"))), lambda t: t["y"].isNotNull() & t["z"].isNotNull())
    trios = materialize(reduced.select("id", F.explode(trios).alias("t")).select("id", "t.*"))
    upper = _named(trios.select("x", "y", "z"), "name")
    out = materialize(trios.join(_unique(upper), ["x", "y", "z"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("j", "name"))).alias("names")))
    for t in (names, trios, upper):
        discard(t)
    return out


SORTED = T.StructType([T.StructField("edge", T.IntegerType()), T.StructField("task", T.IntegerType()), *_longs("id", "d", "name"), T.StructField("sides", T.BinaryType())])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings equal to the one before in sorted order (edge 0), and each task's first (1) and last (2) string."""
    task, before = TaskContext.get().partitionId(), None
    columns = ("name", "sides", "d")
    out = lambda t, edge: pa.RecordBatch.from_arrays([pa.array(np.full(len(t), edge, np.int32)), pa.array(np.full(len(t), task, np.int32)), *(t.column(c) for c in ("id", "d", "name", "sides"))], names=[f.name for f in SORTED])
    for batch in batches:
        if not len(batch):
            continue
        t = batch if before is None else pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0]
        if before is None:
            yield out(batch.slice(0, 1), 1)
        a, b = t.slice(0, len(t) - 1), t.slice(1)
        same = np.ones(len(a), bool)
        for c in columns:
            same &= pc.equal(a.column(c), b.column(c)).to_numpy(zero_copy_only=False)
        yield out(b.filter(pa.array(same)), 0)
        before = batch.slice(len(batch) - 1)
    if before is not None:
        yield out(before, 2)


def late_strings(strings: DataFrame) -> DataFrame:
    """(id, d) of strings (name, sides, d, id) that are equal to one of a smaller id: a sort over all tasks, then neighbours."""
    order = ["name", "sides", "d", "id"]
    found = materialize(strings.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, SORTED))
    edges = sorted(found.where("edge > 0").collect(), key=lambda r: (r["task"], r["edge"]))  # two rows for each task
    more = [(y["id"], y["d"]) for x, y in zip(edges, edges[1:]) if x["edge"] == 2 and (x["name"], x["sides"], x["d"]) == (y["name"], y["sides"], y["d"])]
    late = found.where("edge = 0").select("id", "d")
    return late.unionByName(found.sparkSession.createDataFrame(more, "id long, d long")) if more else late


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of strings (anchor - d) as runs."""
    for batch in batches:
        n = batch.column("ds").value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n)), n)
        p = batch.column("q").to_numpy()[row] - batch.column("ds").flatten().to_numpy()
        order = np.lexsort((p, row))
        row, p = row[order], p[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (p[1:] - p[:-1] > 1)])[: len(p)]
        last = np.concatenate([new[1:], [True]])[: len(p)]
        r = pa.array(row[new])
        yield pa.RecordBatch.from_arrays([batch.column("ord").take(r), batch.column("h").take(r), pa.array(p[new]), pa.array(p[last])], names=["ord", "h", "lo", "hi"])


def sorted_out(mixed: DataFrame, cut: DataFrame) -> DataFrame:
    """(ord, h, lo, hi): late runs among pieces. mixed: id (in order of place), gram, ord, h, lo, hi, q; cut: their bodies."""
    pieces = cut.where(F.col("kind") == PIECES).select(F.col("k1").alias("id"), "at", "body")
    most, least = F.col("at"), F.col("at") - (F.octet_length("body") - LENGTH)  # the anchor's places in the piece's strings
    spans = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(e - 1).alias("e")) for a, e in zip(RANGES, RANGES[1:])))
    cores = pieces.withColumn("x", F.explode(spans)).where((F.col("x.a") <= most) & (F.col("x.e") >= least))
    cores = cores.select("id", "x", F.xxhash64("x", _sub("body", F.col("at") - F.col("x.a") + 1, LENGTH + F.col("x.a") - F.col("x.e"))).alias("core"))
    often = materialize(cores.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"))
    wanted = cores.join(_unique(often), "core").groupBy("id").agg(F.collect_set("x").alias("spans"))
    held = materialize(pieces.join(wanted, "id"))
    names = sampled_names(held)
    d = F.col("d")
    places = F.flatten(F.transform("spans", lambda x: F.sequence(F.greatest(x["a"], least), F.least(x["e"], most))))
    x = held.join(names, "id").select("id", "at", "body", "names", F.explode(F.transform(places, lambda v: v.cast("long"))).alias("d"))
    j = -F.floor(d / BLOCK)
    j = j + F.when(F.pmod(j, F.lit(3)) == 0, 1).otherwise(0)
    x = x.withColumn("j", j)
    left = BLOCK * F.col("j") + d
    sides = F.concat(_sub("body", F.col("at") - d + 1, left), _sub("body", F.col("at") + BLOCK * F.col("j") + 9 * BLOCK + 1, LENGTH - 9 * BLOCK - left))
    late = late_strings(x.select("id", "d", F.element_at("names", F.col("j")).alias("name"), sides.alias("sides")))
    by_piece = late.groupBy("id").agg(F.collect_set("d").alias("ds")).join(mixed.select("id", "ord", "h", "q"), "id")
    return by_piece.select("ord", "h", "q", "ds").mapInArrow(_runs, T.StructType(_longs("ord", "h", "lo", "hi")))


def late_starts(texts: DataFrame) -> DataFrame:
    """(ord, h, lo, hi): runs of starts whose LENGTH-byte strings also start earlier. texts: ord, h, text; distinct texts."""
    rows = texts.mapInArrow(_list_anchors, ANCHOR)
    grams = texts.mapInArrow(_list_grams, T.StructType(_longs("gram")))
    often = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    kept = materialize(rows.join(_unique(often), "gram"))
    place = ["ord", "h", "lo", "hi", "q"]
    first = materialize(kept.groupBy("gram", "around").agg(F.min(F.struct(*place)).alias("f")))
    late = kept.join(first, ["gram", "around"]).where(F.struct(*place[:3]) != F.struct("f.ord", "f.h", "f.lo"))
    late = materialize(late.select("gram", "ord", "h", "lo", "hi", F.col("f.ord").alias("fo"), F.col("f.h").alias("fh"), F.col("f.lo").alias("flo")))
    several = materialize(first.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    numbered = lambda d: materialize(d.repartitionByRange(*place[:3]).sortWithinPartitions(*place[:3]).withColumn("id", F.monotonically_increasing_id()))
    mixed = numbered(first.join(_unique(several), "gram").select("gram", "f.*"))
    cells = late.select(F.col("fo").alias("ord"), F.col("fh").alias("h"), F.explode(F.sequence(F.floor(F.col("flo") / CELL), F.floor((F.col("flo") + F.col("hi") - F.col("lo") + LENGTH - 1) / CELL))).alias("cell")).distinct()
    pieces = lambda m: m.select("ord", "h", _want(PIECES, "lo", "hi", "id", "q").alias("want"))
    cut = _fetch(texts, late.select("ord", "h", _want(LATE, "lo", "hi", "fo", "fh", "flo").alias("want")).unionByName(cells.select("ord", "h", _want(FIRST, "cell").alias("want"))).unionByName(pieces(mixed)))
    own = cut.where(F.col("kind") == FIRST).select("k1", "k2", "k3", F.col("body").alias("given"))
    claims = cut.where(F.col("kind") == LATE).join(own, ["k1", "k2", "k3"], "left")
    failed = claims.where(~_sub("given", F.col("at") + 1, F.octet_length("body")).eqNullSafe(F.col("body"))).select("ord", "h").distinct()
    failed = materialize(failed)
    if failed.take(1):  # other bytes under an equal hash: all runs of such anchors are sorted
        grams = materialize(late.join(failed, ["ord", "h"]).select("gram").distinct())
        late = late.join(grams, "gram", "left_anti")
        mixed = numbered(mixed.drop("id").unionByName(kept.join(grams, "gram").select("gram", *place)).distinct())
        cut = _fetch(texts, pieces(mixed))
    out = materialize(late.select("ord", "h", "lo", "hi").unionByName(sorted_out(mixed, cut)))
    for t in (often, kept, first, several, mixed, cut, failed):
        discard(t)
    return out


def spans(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) in order: maximal removed byte spans [start, end) of runs of starts in texts that begin and end at off."""
    lo, hi = off[row] + lo, off[row] + np.minimum(hi, np.diff(off)[row] - length) + length
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], np.maximum.accumulate(hi[order])  # no span reaches beyond its text
    new = np.append(True, (row[1:] != row[:-1]) | (lo[1:] > hi[:-1]))[: len(row)]
    row, start, end = row[new], lo[new], hi[np.append(new[1:], True)[: len(new)]]
    return row, start - off[row], end - off[row]


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with removed (array of byte spans [start, end)) and kept (binary: the bytes that stay); {name: column}.

    Null texts are empty, null keys come last and, with equal keys, texts are in the order of a hash. Rows equal in key
    and text are one document and come out alike. Texts equal by SHA-256 to that of a smaller key go whole; all else that goes has
    been compared byte by byte or by names that stand for bytes.
    """
    removed, kept, o, h, lead, o2, h2, runs = fresh(docs, "removed", "kept", "ord", "h", "lead", "o2", "h2", "runs")
    body = F.coalesce(col(text), F.lit(""))
    keyed = docs.select(F.coalesce(col(key).cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(body).alias("h"), F.sha2(body, 256).alias("sha"), body.alias("text")).where(F.octet_length("text") >= LENGTH)
    leads = materialize(keyed.groupBy("sha").agg(F.min("ord").alias("lead"), F.first("h").alias("h"), F.count_distinct("ord").alias("n"), F.count(F.lit(1)).alias("rows")))
    copies = leads.where("n > 1").select("sha", F.col("lead"))
    # first rows of their text; rows equal in key and text once
    copy_keys = keyed.join(copies, "sha").where("ord > lead").select(F.col("ord").alias("o2"), F.col("h").alias("h2")).distinct()
    gone = materialize(copy_keys)
    texts = keyed.select("ord", "h", "text")
    small = 48 * gone.count() <= BROADCAST_BYTES
    texts = texts.join(F.broadcast(gone) if small else gone, (F.col("ord") == F.col("o2")) & (F.col("h") == F.col("h2")), "left_anti")
    if leads.where("rows > n").take(1):  # the same key and text in several rows
        texts = texts.dropDuplicates(["ord", "h"])
    late = late_starts(texts)
    lists = late.groupBy("ord", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    whole = gone.select(F.col("o2").alias("ord"), F.col("h2").alias("h"), F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(LAST - LENGTH).alias("hi"))).alias("runs"))
    found = materialize(lists.unionByName(whole)).select(F.col("ord").alias(o2), F.col("h").alias(h2), F.col("runs").alias(runs))
    x = docs.withColumn(o, F.coalesce(col(key).cast("long"), F.lit(LAST))).withColumn(h, F.xxhash64(body))
    x = x.join(_unique(found), (F.col(o) == F.col(o2)) & (F.col(h) == F.col(h2)), "left").drop(o, h, o2, h2)
    at = docs.columns.index(text)
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(removed, kind), T.StructField(kept, T.BinaryType())])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = raw_texts(batch.column(at))
            lists = batch.column(batch.num_columns - 1)
            lo, hi = (c.to_numpy() for c in lists.flatten().flatten())
            row, start, end = spans(pc.list_parent_indices(lists).to_numpy(), lo, hi, off)
            each = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], fields=list(arrow.value_type))
            gone = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(off))), pa.int32()), each)
            change = np.zeros(len(b) + 1, np.int32)  # spans of a text don't touch, those of neighbours may
            np.add.at(change, off[row] + start, 1)
            np.add.at(change, off[row] + end, -1)
            stay = b[np.cumsum(change[:-1]) == 0]
            sizes = np.diff(off) - np.bincount(row, end - start, len(off) - 1).astype(np.int64)
            bounds = np.append(0, np.cumsum(sizes)).astype(np.int32)
            stay = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(stay)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], gone, stay], names=[f.name for f in schema])

    return x.mapInArrow(cut, schema), {"removed": removed, "kept": kept}


__all__ = ["anchors", "dedup", "late_starts", "late_strings", "sampled_names", "spans"]
