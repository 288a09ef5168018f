"""Word and shingle hashes of many texts at once, in numpy, and shingles themselves.

A word's hash chains its bytes, eight at a time, through a bijective mixer (long words: BLAKE2b); a shingle's is a mixed
linear form of its words' hashes. So words may be parted by any white space. Hashes choose candidates; exact_sets() compares words.
"""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
#: Words of more bytes are hashed one by one.
LANES = 4
SEGMENT = 1 << 18

#: Fixed odd multipliers.
BASE = 0x9E3779B97F4A7C15
FORMS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
SHORT = 0x8EBC6AF09C88C6E3

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: What is left of eight bytes of which the first n belong to a word.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) <= n:
        size = 1 << max(19, int(n).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _chained(x: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the words x[s[k]:e[k]]."""
    padded = np.concatenate([x, np.zeros(8 * LANES + 8, np.uint8)])
    eights = np.ndarray((len(x) + 8 * LANES,), "<u8", padded, strides=(1,))
    size = e - s
    with np.errstate(over="ignore"):
        h = size.astype(np.uint64) * np.uint64(SHORT)
        for k in range(LANES):
            more = size > 8 * k
            h = np.where(more, mix((h ^ (eights[s + 8 * k] & KEEP[np.clip(size - 8 * k, 0, 8)])) + np.uint64(BASE)), h)
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(x[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(b: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words [^\\x20\\x09-\\x0D]+ of the texts b[off[k]:off[k+1]], and how many each text has."""
    first = np.zeros(len(b) + 1, bool)
    first[off] = True
    hashes, starts, at = [], [], 0
    while at < len(b):
        end = min(len(b), at + SEGMENT)
        while end < len(b) and not (SPACE[b[end]] or first[end]):  # no word is cut
            stop = np.flatnonzero(SPACE[b[end : end + SEGMENT]] | first[end : end + SEGMENT][: len(b) - end])
            end = end + (int(stop[0]) if len(stop) else min(SEGMENT, len(b) - end))
        x = b[at:end]
        space = SPACE[x]
        f = first[at : end + 1]
        s = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | f[:-1]))
        e = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | f[1:])) + 1
        if len(s):
            hashes.append(_chained(LOWER[x] if lower else x, s, e))
            starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), off))


def shingle_sets(b: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct 5-word shingles as sorted hashes; of fewer words, the whole sequence is one; of none, none."""
    h, n = word_hashes(b, off)
    with np.errstate(over="ignore"):
        full = mix(sum((h[k : len(h) - WORDS + 1 + k] * FORMS[k] for k in range(WORDS)), np.zeros(max(0, len(h) - WORDS + 1), np.uint64))) if len(h) >= WORDS else np.zeros(0, np.uint64)
        out, at = [], 0
        for k in n.tolist():
            if k >= WORDS:
                out.append(np.unique(full[at : at + k - WORDS + 1]))
            elif k:
                out.append(mix((h[at : at + k] * FORMS[:k]).sum(dtype=np.uint64, keepdims=True) + np.uint64(k * SHORT % 2**64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += k
    return out


def normal(text: bytes) -> bytes:
    """Lower-case words, parted by single spaces."""
    return b" ".join(text.translate(LOWER.tobytes()).split())


def exact_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each normal text's distinct shingles, numbered among those of all the texts by comparing words."""
    known: dict[bytes, int] = {}
    parts = [t.split(b" ") if t else [] for t in texts]
    n = np.array([len(p) for p in parts], np.int64)
    ids = np.fromiter((known.setdefault(w, len(known)) for p in parts for w in p), np.int64, int(n.sum()))
    code = ids
    for k in range(1, WORDS):  # numbers of runs of k + 1 words
        code = np.unique(code[:-1] * (len(known) + 1) + ids[k:], return_inverse=True)[1] if len(code) > 1 else code[:0]
    short: dict[tuple, int] = {}
    out, at = [], 0
    for k, p in zip(n.tolist(), parts):
        if k >= WORDS:
            out.append(np.unique(code[at : at + k - WORDS + 1]))
        else:  # a sequence of fewer words is one shingle, unlike all others
            out.append(np.array([-1 - short.setdefault(tuple(p), len(short))] if k else [], np.int64))
        at += k
    return out


def shingles_of(text: bytes) -> set[tuple[bytes, ...]]:
    """A normal text's shingles, as words."""
    w = text.split(b" ")
    return set(zip(*(w[k:] for k in range(WORDS)))) if len(w) >= WORDS else {tuple(w)} if text else set()
