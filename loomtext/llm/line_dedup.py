"""Removal of repeated passages of lines through content-defined chunks on two levels.

A rolling hash over the hashes of two neighbouring lines decides whether a chunk ends there, so boundaries depend on nearby
lines alone and a passage is cut alike wherever it stands. Chunks whose digests occur more than once are fetched and compared byte
by byte; all but the first occurrence go. That settles what is inside repeated chunks, however often they stand.

A passage rarely begins and ends at boundaries, and a short one may hold none. So a second level cuts at every line: chunks of two
neighbouring lines, and of one long line. Only those that aren't inside a chunk that goes take part; they extend a chunk's match
over equal neighbouring lines, and find passages too short for the first level. They are matched and compared alike.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, discard, fresh, materialize

#: A chunk ends after a line with a chance of one in so many.
DIVISOR = 3
#: A line with more words than this is a passage by itself.
LONG_LINE = 50
#: Documents' keys and lists of units are broadcast to the second pass up to so many bytes; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def full_lines(text: str) -> tuple[list[str], list[int]]:
    """All lines, and numbers of those with more than white space. Blank lines part nothing."""
    lines = text.split("\n")
    return lines, [k for k, x in enumerate(lines) if x and not x.isspace()]


def chunks(lines: list[str]) -> list[tuple[int, int]]:
    """Bounds [i, j) of the chunks of two lines or more that a rolling hash over the lines' hashes cuts; all lines are in one."""
    out, begin, before = [], 0, 0
    for k, line in enumerate(lines):
        h = zlib.crc32(line.encode())
        rolled = ((before * 0x9E3779B1 + h) * 0x85EBCA77) & 0xFFFFFFFF
        if k > begin and (rolled >> 8) % DIVISOR == 0:
            out.append((begin, k + 1))
            begin = k + 1
        before = h
    if begin < len(lines):
        out.append((begin, len(lines)))
    return out


#: Kinds of units: number = KINDS * first line + kind.
CHUNK, PAIR, LINE = range(3)
KINDS = 3


def units(text: str) -> dict[int, tuple[int, int, str, int | None]]:
    """{number: (first line, line after the last, body, number of the chunk around it)} of a text's chunks, of its pairs of neighbouring
    lines and its long lines. A text of one line is only looked up: copies of whole texts are for the near duplicates' operator."""
    lines, full = full_lines(text)
    out: dict[int, tuple[int, int, str, int | None]] = {}
    own: list[int | None] = [None] * len(full)
    for i, j in chunks([lines[k] for k in full]):
        if j - i > 1:
            no = KINDS * full[i] + CHUNK
            out[no] = full[i], full[j - 1] + 1, "\n".join(lines[k] for k in full[i:j]), None
            own[i:j] = [no] * (j - i)
    for n, (i, j) in enumerate(zip(full, full[1:])):
        out[KINDS * i + PAIR] = i, j + 1, f"{lines[i]}\n{lines[j]}", own[n] if own[n] == own[n + 1] else None
    for n, i in enumerate(full):
        if len(lines[i].split()) > LONG_LINE:
            out[KINDS * i + LINE] = i, i + (len(lines) > 1), lines[i], own[n]
    return out


def _row_key(text: str):
    return F.xxhash64(col(text), F.octet_length(col(text)))


def _small(lists: DataFrame, numbers: str) -> bool:
    """At 64 bytes a row and 4 a number."""
    rows, n = lists.agg(F.count(F.lit(1)), F.sum(F.size(numbers))).first()
    return 64 * rows + 4 * (n or 0) <= BROADCAST_BYTES


def _place():
    """The order of occurrences: smallest key (null last), digest of the text, number."""
    return F.struct(F.col("key").isNull().alias("last"), F.col("key"), F.col("digest"), F.col("no"))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", by_chunks: bool = True) -> DataFrame:
    """(key, digest of the row's text, drop: numbers of the units to remove) for rows that lose some.

    The first occurrence of a unit stays. Rows equal in key and text count as one document. by_chunks: what is inside a chunk that goes
    takes no further part.
    """
    slim = docs.select(col(key).alias("key"), _row_key(text).alias("digest"), col(text).alias("text")).where("text is not null")
    ks = slim.schema["key"]

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, no, unit, inside = [], [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                for k, (_, _, body, chunk) in units(t).items():
                    row.append(i)
                    no.append(k)
                    unit.append(hashlib.blake2b(body.encode(), digest_size=16, salt=bytes([k % KINDS])).digest())
                    inside.append(chunk)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("digest").take(at), pa.array(no, pa.int32()), pa.array(unit, pa.binary()), pa.array(inside, pa.int32())], names=["key", "digest", "no", "unit", "inside"])

    schema = T.StructType([ks, slim.schema["digest"], T.StructField("no", T.IntegerType()), T.StructField("unit", T.BinaryType()), T.StructField("inside", T.IntegerType())])
    found = materialize(slim.mapInArrow(spots, schema))
    # written before each join, so that a hot unit's rows can be split there
    chunked, fine = found.where(F.col("no") % KINDS == CHUNK), found.where(F.col("no") % KINDS != CHUNK)
    # repeated rows have the same places: a unit occurs twice if not all hashes of its places are equal
    places = F.xxhash64("key", "digest", "no")
    twice = (F.min(places).alias("low"), F.max(places).alias("high"))
    often = materialize(chunked.groupBy("unit").agg(F.min(_place()).alias("first"), *twice).where("low <> high").select("unit", "first"))
    marked = materialize(chunked.join(often, "unit").select("key", "digest", "no", (~_place().eqNullSafe(F.col("first"))).alias("later")))
    # what occurs once is left first, so that less is looked up in the chunks that go
    fine = materialize(fine.join(fine.groupBy("unit").agg(*twice).where("low <> high").select("unit"), "unit"))
    discard(found)
    discard(often)
    if by_chunks:
        gone = marked.where("later").select(F.col("key").alias("k3"), F.col("digest").alias("d3"), F.col("no").alias("inside3"))
        apart = materialize(fine.join(gone, F.col("key").eqNullSafe(F.col("k3")) & (F.col("digest") == F.col("d3")) & (F.col("inside") == F.col("inside3")), "left_anti"))
        discard(fine)
        fine = apart.join(apart.groupBy("unit").agg(*twice).where("low <> high").select("unit"), "unit")
    every = marked.select("key", "digest", "no").unionByName(fine.select("key", "digest", "no"))
    wanted = materialize(every.groupBy("key", "digest").agg(F.collect_set("no").alias("nos")))  # a text's own units
    discard(fine)
    given = F.broadcast(wanted) if _small(wanted, "nos") else wanted
    given = given.select(F.col("key").alias("k2"), F.col("digest").alias("d2"), "nos")
    again = slim.join(given, F.col("key").eqNullSafe(F.col("k2")) & (F.col("digest") == F.col("d2"))).select("key", "digest", "text", "nos")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, no, body = [], [], []
            for i, (t, nos) in enumerate(zip(batch.column("text").to_pylist(), batch.column("nos").to_pylist())):
                cut = units(t)
                for k in nos:
                    row.append(i)
                    no.append(k)
                    body.append(cut[k][2])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("digest").take(at), pa.array(no, pa.int32()), pa.array(body, pa.string())], names=["key", "digest", "no", "body"])

    bodies = materialize(again.mapInArrow(fetch, T.StructType([*schema.fields[:3], T.StructField("body", T.StringType())])).withColumn("kind", F.col("no") % KINDS))
    first = materialize(bodies.groupBy("kind", "body").agg(F.min(_place()).alias("first")))  # equal bytes, by value
    judged = bodies.join(first, ["kind", "body"]).select("key", "digest", "no", "kind", (~_place().eqNullSafe(F.col("first"))).alias("goes"))
    dropped = materialize(judged.where("goes").groupBy("key", "digest").agg(F.sort_array(F.collect_set("no")).alias("drop")))
    for done in (wanted, bodies, first):
        discard(done)
    if by_chunks:
        # two chunks of one digest with other bytes: then the second level has to see all lines
        kept = marked.where("later").groupBy("key", "digest").agg(F.count_distinct("no").alias("n")).agg(F.sum("n")).first()[0] or 0
        went = dropped.agg(F.sum(F.size(F.filter("drop", lambda n: n % KINDS == CHUNK)))).first()[0] or 0
        if went != kept:
            return repeated(docs, key, text, False)
    return dropped


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs whose `text` lacks its repeated passages; {n_lines, n_removed (lines): column}.

    A line goes if a run of two or more lines that holds it (blank lines between them aside), or itself with over LONG_LINE words, also
    starts earlier: in a document of smaller key (null last; then smaller digest of the text), or before in the same one. Overlaps count, so
    of five equal lines one stays. Null texts stay null, rows are never dropped, and rows equal in key and text are one document.
    Texts of one line stay whole, but what they hold counts as said. A text of any length is cut in one task's memory.
    """
    gone = repeated(docs, key, text)
    drop, k2, d2, n_lines, n_removed = fresh(docs, "drop", "k2", "d2", "n_lines", "n_removed")
    lists = gone.select(F.col("key").alias(k2), F.col("digest").alias(d2), F.col("drop").alias(drop))
    lists = F.broadcast(lists) if _small(gone, "drop") else lists
    x = docs.join(lists, col(key).eqNullSafe(F.col(k2)) & (_row_key(text) == F.col(d2)), "left").drop(k2, d2)
    schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_removed, T.LongType())])
    at = docs.columns.index(text)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, removed = batch.column(at).to_pylist(), [], []
            for i, (t, nos) in enumerate(zip(texts, batch.column(batch.num_columns - 1).to_pylist())):
                lines.append(0 if t is None else t.count("\n") + 1)
                if nos:
                    cut = units(t)
                    out = {x for k in nos for x in range(cut[k][0], cut[k][1])}
                    texts[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in out)
                    removed.append(len(out))
                else:
                    removed.append(0)
            columns = [*batch.columns[:-1], pa.array(lines, pa.int64()), pa.array(removed, pa.int64())]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return x.mapInArrow(rebuild, schema), {"n_lines": n_lines, "n_removed": n_removed}
