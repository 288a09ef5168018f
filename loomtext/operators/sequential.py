"""Block after block: each request carries the new translations before it.

Blocks of a document meet in one partition in order; an iterator over Arrow batches carries the last few translations
from row to row and from batch to batch. So a document of any number of blocks needs the memory of one batch. The chain itself
is what the feature is: a document's blocks wait for each other, different documents run side by side.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from . import translate


@dataclass(frozen=True)
class Request:
    """What a translator is asked: the text, pairs (source, translation) before it, the number of answers and the block's glossary section."""

    text: str
    context: tuple[tuple[str, str], ...] = ()
    candidates: int = 1
    section: str | None = None
    source: str = "en"
    target: str = "fr"


#: Answers to a request, best first or not.
Translator = Callable[[Request], list[str]]
#: The place of the best answer of several.
Choice = Callable[[Request, list[str], list[str]], int]

ADDED = [("translated_text", T.StringType()), ("status", T.StringType()), ("context_used", T.IntegerType()), ("candidates_generated", T.IntegerType()), ("error", T.StringType())]


def whole_first(request: Request, answers: list[str], placeholders: list[str]) -> int:
    """The first answer that keeps all placeholders, else the first."""
    return next((k for k, a in enumerate(answers) if all(p in (a or "") for p in placeholders)), 0)


@dataclass(frozen=True)
class Settings:
    """window: blocks before one, in its segment, whose translations are its context. extended: the last 2 * window translations of
    the document instead. check_masks: answers without a placeholder fail. fallback: asked without context where the answer fails."""

    window: int = 5
    extended: bool = False
    candidates: int = 1
    check_masks: bool = True
    source: str = "en"
    target: str = "fr"
    context: bool = True


def passes(source: str, answer: str | None, placeholders: list[str], how: Settings) -> bool:
    """An answer that isn't empty, isn't the source (between two languages) and keeps the placeholders."""
    if not answer or (how.source != how.target and answer.strip() == source.strip()):
        return False
    return not how.check_masks or all(p in answer for p in placeholders)


class _Document:
    """The state that a document's blocks hand on."""

    def __init__(self, how: Settings):
        self.segment: object = None
        # translations of the last blocks of the segment, or of the last translated ones of the document
        self.last: deque = deque(maxlen=max(1, 2 * how.window if how.extended else how.window))
        self.known: dict[str, str] = {}  # translations of texts that come again

    def enter(self, segment: object, how: Settings) -> None:
        if segment != self.segment and not how.extended:
            self.last.clear()
        self.segment = segment

    def context(self, how: Settings) -> tuple[tuple[str, str], ...]:
        return tuple(p for p in self.last if p) if how.context and how.window > 0 else ()

    def leave(self, source: str, translation: str | None, can: bool, how: Settings) -> None:
        pair = (source, translation) if translation else None
        if not how.extended:
            self.last.append(pair)
        elif pair and can and translation.strip():
            self.last.append(pair)


def _answer(block: dict, state: _Document, translator: Translator, fallback: Translator | None, choose: Choice, how: Settings) -> tuple[str | None, str, int, int, str | None]:
    """(translation, status, pairs of context, answers, error) of one block."""
    if not block["can"]:
        return block["before"], "skipped", 0, 0, None
    text = block["text"]
    cached = state.known.get(text) or block["cached"]
    if cached and cached.strip() != text.strip():
        return cached, "cached", 0, 0, None
    context = state.context(how)
    request = Request(text, context, how.candidates, block["section"], how.source, how.target)
    try:
        answers = list(translator(request))
        best = answers[choose(request, answers, block["placeholders"]) if len(answers) > 1 else 0] if answers else ""
        if passes(text, best, block["placeholders"], how):
            return best, "translated", len(context), len(answers), None
    except Exception as e:  # a translator may raise anything; the block keeps what it had
        return block["before"], "failed", len(context), 0, f"{type(e).__name__}: {e}"
    if text.strip() and fallback is not None:
        try:
            last = next(iter(fallback(Request(text, (), 1, None, how.source, how.target))), "")
            if last and last.strip():
                return last, "fallback", len(context), len(answers), None
        except Exception as e:
            return block["source"], "source", len(context), len(answers), f"{type(e).__name__}: {e}"
    return block["source"], "source", len(context), len(answers), None


def translate_in_order(
    blocks: DataFrame,
    translator: Translator,
    fallback: Translator | None = None,
    choose: Choice = whole_first,
    how: Settings = Settings(),
    cache: DataFrame | None = None,
    now=None,
    by: str = "doc_id",
    order: str = "pos",
) -> DataFrame:
    """blocks with translated_text, status, context_used, candidates_generated and error.

    Read where blocks have them: segment_id (context ends with it), masked_text (asked instead of source_text), masks (placeholders to keep),
    section (glossary part of the request), translated_text (stays where nothing is asked or the translator raises). status: skipped (not
    translatable), cached (`cache`, or an equal text of the same document that passed before; never a copy of the source), translated, fallback,
    source (nothing passed: the source text), failed. Null sources are empty texts. Blocks equal in `order` come in the order of their texts.
    """
    have = set(blocks.columns)
    text = F.coalesce("masked_text", "source_text", F.lit("")) if "masked_text" in have else F.coalesce("source_text", F.lit(""))
    x = blocks.withColumn("_text", text).withColumn("_can", tx.is_translatable("block_type"))
    if cache is not None:
        keyed = x.withColumn("key", translate.key(F.col("_text"), F.lit(how.source), F.lit(how.target)))
        x = translate.lookup(keyed, cache, F.current_timestamp() if now is None else now).withColumnRenamed("cached", "_cached").drop("key")
    else:
        x = x.withColumn("_cached", F.lit(None).cast("string"))
    # one shuffle: the window's key contains the partition's
    x = x.repartition(by)
    again = F.lead(F.lit(True)).over(Window.partitionBy(by, "_text").orderBy(order)).isNotNull()
    x = x.withColumn("_again", again).sortWithinPartitions(by, order, "_text")
    kept = [f for f in blocks.schema.fields if f.name not in {n for n, _ in ADDED}]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in ADDED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: object = run  # no document yet
        state = _Document(how)
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            out: list[tuple] = []
            for i in range(batch.num_rows):
                get = lambda n, none=None: col[n][i].as_py() if n in col else none  # noqa: B023, E731
                doc = get(by)
                if doc != here:
                    here, state = doc, _Document(how)
                state.enter(get("segment_id"), how)
                source = get("source_text") or ""
                block = {"can": get("_can"), "text": get("_text"), "source": source, "before": get("translated_text"), "cached": get("_cached"), "section": get("section"), "placeholders": [m["placeholder"] for m in get("masks") or []]}
                row = _answer(block, state, translator, fallback, choose, how)
                if row[1] in ("translated", "cached") and get("_again"):
                    state.known[block["text"]] = row[0]
                elif not get("_again"):
                    state.known.pop(block["text"], None)
                state.leave(source, row[0], block["can"], how)
                out.append(row)
            added = [pa.array([r[k] for r in out], pa.int32() if isinstance(t, T.IntegerType) else pa.string()) for k, (_, t) in enumerate(ADDED)]
            yield pa.RecordBatch.from_arrays([*(col[f.name] for f in kept), *added], names=schema.names)

    return x.mapInArrow(run, schema)
