"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that stands inside no vocabulary token can never end up in one token, so a cut between
the two is certain. A text is cut at all such pairs where the cut also leaves the pre-tokens on both
sides as they are (`safe` below); each fragment is encoded alone, once for all its occurrences, and the
ids are concatenated.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches, passes, raw_texts

#: Fragments that a worker remembers; it starts afresh beyond, which changes no result.
CACHE_ENTRIES = 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict, dict[bytes, int], dict[int, bytes], list[bytes]]:
    """The file's contents, special strings, the other tokens' bytes by id, and the bytes of each id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
        raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that reach into their surroundings aren't supported")
    alphabet = byte_alphabet()
    specials = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
    vocab = {i: bytes(alphabet[c] for c in s) for s, i in spec["model"]["vocab"].items() if i not in specials.values()}
    bytes_of = [b""] * (1 + max([*vocab, *specials.values()]))
    for i, b in [*vocab.items(), *((i, s) for s, i in specials.items())]:
        bytes_of[i] = b
    return spec, specials, vocab, bytes_of


class Decoder:
    """Token bytes alone: all that decoding needs."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of = bytes_of

    def decode(self, ids: list[int] | None) -> str:
        """As decode(ids, skip_special_tokens=False): ids that the vocabulary lacks are left out, broken UTF-8 is replaced."""
        table, n = self.bytes_of, len(self.bytes_of)
        ids = ids or ()
        if ids and min(ids) >= 0 and max(ids) < n:
            joined = b"".join(map(table.__getitem__, ids))
        else:
            joined = b"".join(table[i] for i in ids if 0 <= i < n)
        return joined.decode("utf-8", "replace")


class FragmentCodec(Decoder):
    """Encodes and decodes as the tokenizers library does with the file at `path` (byte-level BPE, no normalizer)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        spec, self.specials, vocab, bytes_of = read_vocabulary(path)
        super().__init__(bytes_of)
        self.path, self._tok = path, None
        self.forced = np.ones(65536, bool)
        for b in vocab.values():
            if len(b) > 1:
                x = np.frombuffer(b, np.uint8).astype(np.int32)
                self.forced[(x[:-1] << 8) | x[1:]] = False
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        del spec
        self.by_rank = self._by_rank(vocab, pairs)
        self.cache: dict[bytes, bytes] = {}
        self._forget()

    @property
    def tok(self):
        """The library's own encoder, loaded where it is needed."""
        if self._tok is None:
            from tokenizers import Tokenizer

            self._tok = Tokenizer.from_file(self.path)
            self._tok.no_truncation()
            self._tok.no_padding()
        return self._tok

    @staticmethod
    def _by_rank(vocab: dict[int, bytes], pairs: list[tuple[str, str]]):
        """A faster merger that joins any two neighbours whose bytes together are a token, lowest id first; None unless proven equal.

        It may only differ from the listed merges where two neighbours l, r make up a token t and (l, r) isn't
        listed. Whatever stands around, the merges inside t are then those of t alone, which would end as [l, r].
        So it is equal if ids follow the order of the merges and each token, alone, comes out whole.
        """
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        id_of = {b: i for i, b in vocab.items()}
        made = [id_of.get(a + b, -1) for a, b in rank]
        if made != sorted(set(made)) or len(id_of) != len(vocab) or any(id_of.get(bytes([x])) is None for x in range(256)):
            return None
        for t in vocab.values():
            parts = [t[k : k + 1] for k in range(len(t))]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda k: rank.get((parts[k], parts[k + 1]), len(rank)))
                if (parts[best], parts[best + 1]) not in rank:
                    return None
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
        try:
            import tiktoken
        except ImportError:
            return None
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("by_rank", pat_str=pattern, mergeable_ranks=id_of, special_tokens={})

    def merge(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece by itself."""
        if self.by_rank is not None:
            return list(map(self.by_rank.encode_ordinary, pieces))
        return [e.ids for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _forget(self) -> None:
        self.cache.clear()
        self.cache.update({s: np.array([i], np.int32).tobytes() for s, i in self.specials.items()})

    def cuts(self, b: np.ndarray) -> np.ndarray:
        """Positions p so that a cut before b[p] is certain and leaves pre-tokens as they are."""
        if len(b) < 2:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.forced[(b[:-1].astype(np.uint16) << 8) | b[1:]]) + 1
        left, right = b[at - 1], b[at]
        before = [np.where(at - k >= 0, b[np.maximum(at - k, 0)], 0) for k in (2, 3, 4)]
        tail = lambda x: (x & 0xC0) == 0x80
        space = lambda x: (x == 32) | ((x >= 9) & (x <= 13))
        # What stands left: a plain ASCII character; a longer one that can't be white space; or one white space alone.
        p1, p2, p3 = before
        plain = (left < 0x80) & ~space(left)
        longer = tail(left) & (((p1 >= 0xC3) & (p1 <= 0xDF)) | (tail(p1) & ((p2 == 0xE0) | ((p2 >= 0xE4) & (p2 <= 0xEF)))) | (tail(p1) & tail(p2) & (p3 >= 0xF0)))
        alone = space(left) & ((at < 2) | ((p1 < 0x80) & ~space(p1))) & ~space(right) & ~np.isin(right, (0xC2, 0xE1, 0xE2, 0xE3))
        # An apostrophe at the start of a fragment could turn into a contraction.
        return at[(plain | longer | alone) & ~tail(right) & (right != 0x27)]

    def encode_flat(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        raw = b.tobytes()
        at = self.cuts(b)
        for s in self.specials:
            found, k = [], raw.find(s)
            while k >= 0:
                found.append(k)
                k = raw.find(s, k + len(s))
            # a text's end inside s: no occurrence
            found = [k for k in found if np.searchsorted(off, k, "right") == np.searchsorted(off, k + len(s), "left")]
            for k in found:
                at = at[(at <= k) | (at >= k + len(s))]
            at = np.concatenate([at, [x for k in found for x in (k, k + len(s))]]).astype(np.int64)
        edge = np.zeros(len(b) + 1, bool)
        edge[at] = edge[off] = True
        edges = np.flatnonzero(edge)
        e = edges.tolist()
        fragments = [raw[i:j] for i, j in zip(e, e[1:])]
        missing = [f for f in set(fragments) if f not in self.cache]
        if missing:
            if len(self.cache) + len(missing) > CACHE_ENTRIES:
                self._forget()
                missing = [f for f in set(fragments) if f not in self.cache]
            coded = self.merge([m.decode() for m in missing])
            self.cache.update({m: np.array(c, np.int32).tobytes() for m, c in zip(missing, coded)})
        packed = list(map(self.cache.__getitem__, fragments))
        ids = np.frombuffer(b"".join(packed), np.int32)
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) >> 2)])
        return ids, np.diff(upto[np.searchsorted(edges, off)]) if len(edges) else np.zeros(len(off) - 1, np.int64)

    def encode(self, text: str | None) -> list[int]:
        b = np.frombuffer((text or "").encode(), np.uint8)
        return self.encode_flat(b, np.array([0, len(b)], np.int64))[0].tolist()


@lru_cache(maxsize=2)
def codec(path: str) -> FragmentCodec:
    return FragmentCodec(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(read_vocabulary(path)[3])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", checked: str | None = None) -> DataFrame:
    """docs with an array<int> column `ids`: the tokens of the whole `text` (null and empty text: no tokens).

    checked: name of a boolean column that says whether the ids, decoded by the same worker, are the text again (null: the empty text).
    All other columns stay as they are; columns named like the new ones are replaced. Rows stay where they are (no shuffle).
    """
    bound_batches(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name.lower() not in (ids.lower(), (checked or ids).lower())]
    schema = T.StructType([*keep, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(checked, T.BooleanType(), False)] if checked else [])])
    docs = docs.select(*(docs[f"`{f.name}`"] for f in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            b, off = raw_texts(batch.column(batch.schema.get_field_index(text)))
            for i, j in passes(off):
                flat, n = c.encode_flat(b[off[i] : off[j]], off[i : j + 1] - off[i])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
                part = batch.slice(i, j - i)
                same = []
                if checked:
                    at, raw = np.concatenate([[0], np.cumsum(n)]).tolist(), b[off[i] : off[j]].tobytes()
                    for k in range(j - i):
                        back = c.decode(flat[at[k] : at[k + 1]].tolist())
                        same.append(back == raw[off[i + k] - off[i] : off[i + k + 1] - off[i]].decode())
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *([pa.array(same, pa.bool_())] if checked else [])], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with a string column `text`: the decoded `ids` (null and empty arrays: ''). No shuffle."""
    keep = [f for f in docs.schema.fields if f.name.lower() != text.lower()]
    schema = T.StructType([*keep, T.StructField(text, T.StringType(), False)])
    docs = docs.select(*(docs[f"`{f.name}`"] for f in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = decoder(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            for i in range(0, len(lists), 256):
                part = lists.slice(i, 256)
                off = np.concatenate([[0], np.cumsum(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                flat = part.flatten().fill_null(-1).to_pylist()
                texts = [c.decode(flat[x:y]) for x, y in zip(off.tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 256).columns, pa.array(texts, pa.string())], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)
