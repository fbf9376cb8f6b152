"""Hashes of words and word windows, for whole batches of texts at a time."""

from __future__ import annotations

import re

import numpy as np

from .common import mix64

_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 1 << 64)
#: Bytes of text that are hashed at once (some 30 bytes of arrays each); a longer text is cut at white space.
SEGMENT = 1 << 17

_SPACE_BYTES = b" \t\n\x0b\x0c\r"
_SPACE_RE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(_SPACE_BYTES)] = False
_VALUES = np.where(_IS_WORD, np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64), np.uint64(0))
_powers = np.ones((2, 1), dtype=np.uint64)


def _power_tables(n: int) -> np.ndarray:
    """Powers of ``_STEP`` and of its inverse, for ``n`` places."""
    global _powers
    if _powers.shape[1] < n:
        out = np.empty((2, max(n, SEGMENT + 2)), dtype=np.uint64)
        out[:, 0] = 1
        for row, base in zip(out, (_STEP, _BACK)):
            row[1:] = np.uint64(base)
            np.multiply.accumulate(row, out=row)
        if n > 2 * SEGMENT:
            return out
        _powers = out
    return _powers


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def _hash_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    raw = np.frombuffer(data, dtype=np.uint8)
    word = _IS_WORD[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts
    powers = _power_tables(len(raw))
    sums = np.add.reduceat(_VALUES[raw] * powers[0, : len(raw)], starts)  # white space adds nothing
    return mix64(sums * powers[1, starts]), starts


def _segments(data: bytes):
    at = 0
    while len(data) - at > SEGMENT:
        m = _SPACE_RE.search(data, at + SEGMENT)
        if m is None:
            break
        yield data[at : m.start()]
        at = m.start()
    yield data[at:]


def hash_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space of all texts, end to end, and how many each text has."""
    counts = np.zeros(len(texts), dtype=np.int64)
    out, at = [], 0
    while at < len(texts):
        if len(texts[at]) > SEGMENT:
            parts = [_hash_segment(s)[0] for s in _segments(texts[at])]
            counts[at] = sum(map(len, parts))
            out += parts
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) + 1 <= SEGMENT + 1:
            size += len(texts[end]) + 1
            end += 1
        h, starts = _hash_segment(b"\n".join(texts[at:end]))
        bounds = np.cumsum([len(t) + 1 for t in texts[at:end]])
        counts[at:end] = np.diff(np.searchsorted(starts, bounds), prepend=0)
        out.append(h)
        at = end
    return (np.concatenate(out) if out else np.empty(0, dtype=np.uint64)), counts


def chunks(ids: list, texts: list, words: int = 1 << 16):
    """Runs of rows of about ``words`` words: (ids, word hashes end to end, words of each row)."""
    limit, start, size, run = words * 6, 0, 0, []
    for i, t in enumerate(texts):
        b = folded(t)
        if run and size + len(b) > limit:
            yield (ids[start:i], *hash_texts(run))
            start, size, run = i, 0, []
        run.append(b)
        size += len(b)
    if run:
        yield (ids[start:], *hash_texts(run))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that begin at each word, also across texts."""
    m = max(0, len(words) - n + 1)
    s = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        s = s * _MULT + words[k : k + m]
    return mix64(s)


def inside(owner: np.ndarray, n: int) -> np.ndarray:
    """Whether the ``n`` words that begin at each word are of one text."""
    m = max(0, len(owner) - n + 1)
    return owner[:m] == owner[len(owner) - m :]
