"""Benchmark decontamination: a BM25 inverted index of the test items, block-max WAND, verification.

The test items are indexed in blocks of bounded size. Impacts are divided by the threshold of their
item, so an item is retrieved when its impacts sum to 1. Items are indexed by length class, and every
passage of a class's length of every document is a query (passages overlap by half): it is passed over when the maxima of its terms don't sum to 1; else the pivots are the blocks where the
terms' block maxima do, all other blocks are skipped, and only the pivots' postings are scored. Items
that are retrieved are verified on their word windows inside the passage, question and answer apart.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64
from .words import _IS_WORD, _VALUES, SEGMENT, _power_tables, _segments

K1, B = 1.2, 0.75
#: Items of one index block.
BLOCK = 8
#: Words of the least length class; each further one is twice as long. A passage is two of its class.
CLASS = 64
#: Items that one pass over the documents holds in memory, and their characters.
PASS_ITEMS, PASS_CHARS = 50_000, 64 << 20
#: Terms times items up to which impacts are kept as a dense table (8 bytes each) and not as lists.
DENSE = 1 << 22

_NOISE = re.compile(r"[\W_]+")
_OTHER_NOISE = re.compile(r"[^\w\x00-\x7f]+")
_QUESTION = re.compile(r"\?|\n")
#: ASCII characters that stay when noise is taken out of words; white space parts them.
_STAYS = np.array([i >= 128 or not _IS_WORD[i] or not _NOISE.match(chr(i)) for i in range(256)])


def tokens(text: str) -> list[str]:
    """Lower-case words between white space, without their non-word characters."""
    return [w for w in (_NOISE.sub("", w) for w in text.lower().split()) if w]


def _plain(text: str | None) -> bytes:
    """Lower-case text with single spaces, without noise beyond ASCII, as bytes."""
    text = " ".join((text or "").lower().split())
    return (text if text.isascii() else _OTHER_NOISE.sub("", text)).encode("utf-8", "surrogatepass")


def _hash_run(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = raw[_STAYS[raw]]
    word = _IS_WORD[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(raw == 10)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), counts
    powers = _power_tables(len(raw))
    return mix64(np.add.reduceat(_VALUES[raw] * powers[0, : len(raw)], starts) * powers[1, starts]), counts


def hash_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the :func:`tokens` of plain texts, end to end, and how many each text has; a long text is read in segments."""
    hashes, counts = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]

    def add(run: list[bytes], whole: bool) -> None:
        """Hash a run of texts, or with ``whole`` the segments of one text."""
        for part in [run] if not whole else [[s] for s in run]:
            h, c = _hash_run(np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8))
            hashes.append(h)
            if not whole:
                counts.append(c)
        if whole:
            counts.append(np.array([sum(map(len, hashes[-len(run) :]))]))

    run, size = [], 0
    for t in texts:
        if run and size + len(t) > SEGMENT:
            add(run, False)
            run, size = [], 0
        if len(t) > SEGMENT:
            add(list(_segments(t)), True)
        else:
            run.append(t)
            size += len(t)
    if run:
        add(run, False)
    return np.concatenate(hashes), np.concatenate(counts)


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words up to the first question mark or line end, and the rest; halves where there is neither."""
    m = _QUESTION.search(text)
    if m:
        q, a = tokens(text[: m.end()]), tokens(text[m.end() :])
        if q and a:
            return q, a
    words = tokens(text)
    half = (len(words) + 1) // 2
    return words[:half], words[half:]


def _windows(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of several ranges, end to end."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def statistics(words: list[list[str]]) -> tuple:
    """(items, mean words, {term: items that hold it})."""
    return len(words), sum(map(len, words)) / max(1, len(words)), Counter(t for w in words for t in set(w))


class Index:
    """Impacts of the test items by term, and their maxima by term and block of ``BLOCK`` items."""

    def __init__(self, words: list[list[str]], share: float, stats: tuple | None = None, size: int = CLASS):
        """``words`` of each item; ``share`` of the score that an item gives itself is its threshold.

        ``stats`` are (items, mean words, {term: items that hold it}) of all items; without it those of these.
        No item may have more than ``size`` words.
        """
        n, mean, df = stats or statistics(words)
        mean = max(1.0, mean)
        by_term: dict[str, list[tuple[int, float]]] = {}
        for i, w in enumerate(words):
            scores = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in Counter(w).items()}
            own = share * sum(scores.values())
            for t, score in scores.items():
                by_term.setdefault(t, []).append((i, score / own))
        hashes = hash_tokens([_plain(t) for t in by_term])[0] if by_term else np.empty(0, dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, names = hashes[order], list(by_term)
        lists = [by_term[names[k]] for k in order]
        self.item = np.array([i for p in lists for i, _ in p], dtype=np.int64)
        self.impact = np.array([s for p in lists for _, s in p], dtype=np.float64)
        term = np.repeat(np.arange(len(lists)), [len(p) for p in lists])
        # a posting begins a block's part of its list where term or block change; items ascend in a list
        block = self.item // BLOCK
        new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(term) else np.empty(0, dtype=np.int64)
        self.part_start, self.part_length = new, np.diff(np.append(new, len(term)))
        self.part_block, self.part_most = block[new], np.maximum.reduceat(self.impact, new) if len(new) else self.impact
        self.term_start = np.searchsorted(term[new], np.arange(len(lists)))
        self.term_length = np.diff(np.append(self.term_start, len(new)))
        self.term_most = np.maximum.reduceat(self.impact, np.searchsorted(term, np.arange(len(lists)))) if len(lists) else np.empty(0)
        self.blocks = -(-len(words) // BLOCK)
        self.dense = self.dense_most = None
        if len(lists) * len(words) <= DENSE:
            self.dense = np.zeros((len(lists), self.blocks * BLOCK))
            self.dense[term, self.item] = self.impact
            self.dense_most = self.dense.reshape(len(lists), self.blocks, BLOCK).max(axis=2)
        self.passage = 2 * size
        self.seen = self.scored = 0

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers of token hashes, -1 where no item has the token."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def search(self, terms: np.ndarray) -> np.ndarray:
        """Items whose impacts over the distinct ``terms`` sum to 1 or more.

        The pivots are the blocks in which the terms' block maxima sum to 1; the cursor of each term
        jumps from pivot to pivot, and the postings of other blocks are not read. ``seen`` and ``scored`` count blocks.
        """
        self.seen += self.blocks
        if self.term_most[terms].sum() < 1 - 1e-9:
            return np.empty(0, dtype=np.int64)
        if self.dense is not None:
            pivots = np.flatnonzero(self.dense_most[terms].sum(axis=0) >= 1 - 1e-9)
            self.scored += len(pivots)
            items = (pivots[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            return items[self.dense[terms[:, None], items].sum(axis=0) >= 1 - 1e-9]
        parts = _ranges(self.term_start[terms], self.term_length[terms])
        bound = np.bincount(self.part_block[parts], weights=self.part_most[parts], minlength=self.blocks)
        pivot = bound >= 1 - 1e-9
        self.scored += int(pivot.sum())
        parts = parts[pivot[self.part_block[parts]]]
        at = _ranges(self.part_start[parts], self.part_length[parts])
        item, where = np.unique(self.item[at], return_inverse=True)
        return item[np.bincount(where, weights=self.impact[at], minlength=len(item)) >= 1 - 1e-9]

    def find(self, terms: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(first word, items) of each passage of a document that retrieves items; ``terms`` has -1 for words that no item has.

        Passages overlap by half, so one of them holds any item whole. A passage whose words' maxima,
        repeats included, don't sum to 1 can retrieve nothing.
        """
        half = self.passage // 2
        most = np.append(0.0, np.cumsum(np.append(self.term_most, 0.0)[terms]))  # the last entry is for -1
        starts = np.arange(0, max(1, len(terms) - half), half)
        sums = most[np.minimum(starts + self.passage, len(terms))] - most[starts]
        for at in starts[sums >= 1 - 1e-6].tolist():
            t = np.sort(terms[at : at + self.passage])
            t = t[np.append(t[0] >= 0, (t[1:] != t[:-1]) & (t[1:] >= 0))]
            found = self.search(t).tolist()
            if found:
                yield at, found


def _passes(benchmark: DataFrame):
    """Broadcasts (ids, texts, statistics) of the test items, pass by pass; the statistics are those of all items."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").filter("text is not null")
    stats = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).head()
    passes = max(1, math.ceil(stats["n"] / PASS_ITEMS), math.ceil((stats["chars"] or 0) / PASS_CHARS))
    if passes > 1:

        def terms(batches):
            for pdf in batches:
                for t in pdf["text"]:
                    q, a = question_and_answer(t)
                    n = Counter(q + a)
                    yield pd.DataFrame({"term": list(n), "f": list(n.values())}).astype({"f": "int64"})

        counted = materialize(items.mapInPandas(terms, "term string, f long").groupBy("term").agg(F.count("*").alias("df"), F.sum("f").alias("f")))
        mean = (counted.agg(F.sum("f")).head()[0] or 0) / max(1, stats["n"])
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else items
        held = part.orderBy("item_id", "text").collect()
        whole = None
        if passes > 1:
            own = part.mapInPandas(terms, "term string, f long").select("term").distinct()
            whole = stats["n"], mean, {r["term"]: r["df"] for r in counted.join(own, "term").select("term", "df").collect()}
        yield spark.sparkContext.broadcast(([r["item_id"] for r in held], [r["text"] for r in held], whole))


class Matcher:
    """Verified test items of texts."""

    def __init__(self, ids: list, texts: list[str], stats: tuple | None, threshold: float, overlap: float, width: int):
        self.ids, self.items, self.overlap, self.width = ids, [question_and_answer(t) for t in texts], overlap, width
        self.parts: dict[int, tuple] = {}
        words = [q + a for q, a in self.items]
        stats = stats or statistics(words)
        by_class: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_class.setdefault(CLASS << max(0, math.ceil(math.log2(max(1, len(w)) / CLASS))), []).append(i)
        self.indexes = [(members, Index([words[i] for i in members], threshold, stats, size)) for size, members in sorted(by_class.items())]

    def _verified(self, text: str, found: list[tuple[int, int, list[int]]]) -> list[tuple]:
        """Items of passages (first word, words, items), with their overlaps in the passage that holds most of them."""
        words, best = tokens(text), {}
        for at, length, items in found:
            grams = _windows(words[at : at + length], self.width)
            for i in items:
                if i not in self.parts:
                    q, a = self.items[i]
                    self.parts[i] = (_windows(q, self.width), _windows(a, self.width), _windows(q + a, self.width))
                q, a, both = (len(x & grams) / len(x) if x else 0.0 for x in self.parts[i])
                if both >= self.overlap and max(q, a) >= self.overlap:
                    best[i] = max(best.get(i, (0.0, 0.0, 0.0)), (both, q, a))
        return [(self.ids[i], q, a, both) for i, (both, q, a) in sorted(best.items())]

    def __call__(self, texts: list[str | None]) -> Iterator[list[tuple]]:
        """Per text (item_id, question, answer and whole overlap); texts are hashed ``SEGMENT`` bytes at a time."""
        run, size, start = [], 0, 0
        for k, text in enumerate(texts):
            run.append(_plain(text))
            size += len(run[-1])
            if size >= SEGMENT or k == len(texts) - 1:
                hashes, counts = hash_tokens(run)
                terms, ends = [index.terms(hashes) for _, index in self.indexes], np.cumsum(counts)
                for j, (end, n) in enumerate(zip(ends.tolist(), counts.tolist())):
                    found = [
                        (at, index.passage, [members[i] for i in items])
                        for (members, index), t in zip(self.indexes, terms if n else [])
                        for at, items in index.find(t[end - n : end])
                    ]
                    yield self._verified(texts[start + j], found) if found else []
                run, size, start = [], 0, k + 1


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.4,
    overlap: float = 0.5,
    width: int = 3,
) -> DataFrame:
    """Documents that hold test items.

    ``benchmark`` has item_id and text. Passages are twice as long as the length class of an item (64 words,
    128, ...), which depends on no other item, and overlap by half. A passage retrieves every item that scores
    ``threshold`` of what the item scores itself; the pair is then verified: the share of the item's
    ``width``-word windows that the passage holds must reach ``overlap`` in all, and in the question or the
    answer, so parts of an item that lie further apart don't count together. A document that holds only a smaller part, such as a short question without its long answer, is not
    reported. Items of fewer words than ``width`` have one window, all their words.
    Returns doc_id, item_id, question_overlap, answer_overlap, overlap (in the passage that holds most), one row per pair found
    (repeated rows of a document repeat it). Null and empty texts and items without words find nothing;
    rows with a null doc_id have no row here, but :func:`drop_contaminated` decides them by their text.

    The index is read in passes of at most about ``PASS_ITEMS`` items and ``PASS_CHARS`` characters, each
    a scan of the documents; only a pass is ever held by the driver or broadcast. Term statistics are
    those of all items, so results don't depend on the passes. One pass is the rule for a benchmark suite.
    """
    doc_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, question_overlap double, answer_overlap double, overlap double"
    names = [x.split()[0] for x in schema.split(", ")]
    out = None
    for shared in _passes(benchmark):

        def scan(batches, shared=shared):
            match = Matcher(*shared.value, threshold, overlap, width)
            for pdf in batches:
                rows = [(d, *m) for d, found in zip(pdf["doc_id"], match(list(pdf["text"]))) for m in found]
                yield pd.DataFrame(rows, columns=names)

        found = docs.select("doc_id", "text").filter("doc_id is not null").mapInPandas(scan, schema)
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, overlap: float = 0.5, width: int = 3) -> DataFrame:
    """The rows whose text holds no test item, columns unchanged. Needs no shuffle: a row is decided by its own text."""
    for shared in _passes(benchmark):
        docs = docs.filter(_clean_udf(shared, threshold, overlap, width)("text"))
    return docs


def _clean_udf(shared, threshold: float, overlap: float, width: int):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = Matcher(*shared.value, threshold, overlap, width)
        for texts in batches:
            yield pd.Series([not found for found in match(list(texts))], dtype=bool)

    return clean
