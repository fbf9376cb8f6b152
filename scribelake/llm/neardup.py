"""Near-duplicate search over documents by MinHash banding.

Steps, each linear in the documents:

1. one pass over the texts gives every row the hash of its shingle set and a MinHash signature;
   rows with equal sets form one class, and only the class goes on;
2. signatures are cut into bands, buckets are formed on band hashes, and inside a bucket
   signatures are compared in blocks. A block returns a spanning forest, never its pairs;
3. components of that forest are the groups that can hold links;
4. each group's full shingle sets are compared exactly, in blocks of bounded size. A block
   returns link counts per class and again a forest, never its pairs.

Hot groups are dealt out over block pairs, so no task holds more than two blocks. The comparisons
inside one group of N different texts grow with N squared, as exact link counts need.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, objects
from .components import connected_components
from .words import _MULT, chunks, grams, inside

#: Members of a bucket or group that one block holds at most on average.
BLOCK = 512
#: Shingles that one block holds at most on average.
BLOCK_SHINGLES = 400_000
#: Shingles of pairs that are compared at once (some 60 bytes of arrays each).
AT_ONCE = 100_000
#: Rows up to which a side of a join is broadcast, and a hundredth of its bytes.
BROADCAST_ROWS = 250_000
#: Words of a batch whose hashes are held at once.
CHUNK_WORDS = 1 << 16
#: Members up to which groups are compared together, pair by pair.
FEW = 24
_SALT, _HI, _LO = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def choose_bands(threshold: float, recall: float, rows: int) -> int:
    """Least number of bands of ``rows`` rows that finds a pair at ``threshold`` with chance ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word windows, text by text, and where each text's begin.

    A text of fewer words than ``width`` has one window, all its words.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    ok = inside(owner, width)
    s, own = grams(words, width)[ok], owner[: len(ok)][ok]
    short = np.flatnonzero(counts < width)
    if len(short):
        ends = np.cumsum(counts)
        extra = np.full(len(short), 0, dtype=np.uint64)
        for k, i in enumerate(short.tolist()):
            v = np.full(1, counts[i], dtype=np.uint64)
            for h in words[ends[i] - counts[i] : ends[i]]:
                v = v * _MULT + h
            extra[k] = mix64(v)[0]
        own = np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        s, own = np.concatenate([s, extra])[order], own[order]
    return s, np.searchsorted(own, np.arange(len(counts)))


def distinct_mask(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """1 for the first of equal shingles of a text, else 0."""
    owner = np.repeat(np.arange(len(starts), dtype=np.uint64), np.diff(np.append(starts, len(s))))
    key = mix64(s + owner * _SALT)
    order = np.argsort(key)
    first = np.ones(len(s), dtype=np.uint64)
    first[order[1:][key[order[1:]] == key[order[:-1]]]] = 0
    return first


def digests(s: np.ndarray, first: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128-bit hash of each text's shingle set, whatever its order, and the size of the set."""
    hi = np.add.reduceat(mix64(s ^ _HI) * first, starts)
    lo = np.add.reduceat(mix64(s ^ _LO) * first, starts)
    return hi.view(np.int64), lo.view(np.int64), np.add.reduceat(first, starts).astype(np.int32)


def signatures(s: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """MinHash of each text under ``count`` permutations, 16 bits of each."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, count, dtype=np.uint64)
    out = np.empty((len(starts), count), dtype=np.uint16)
    for j in range(count):
        out[:, j] = mix64(np.minimum.reduceat(s * a[j] + b[j], starts)) >> np.uint64(48)
    return out


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, least member) for each component of the local graph."""
    parent = np.arange(n)
    while len(i):  # labels fall to the least neighbour, then jump
        low = parent.copy()
        np.minimum.at(low, i, parent[j])
        np.minimum.at(low, j, parent[i])
        low = low[low]
        if (low == parent).all():
            break
        parent = low
    child = np.flatnonzero(parent != np.arange(n))
    return child, parent[child]


def _neighbours(group: np.ndarray, apart: np.ndarray):
    """All pairs (i, j), i < j, inside equal neighbouring values of ``group``, batch by batch.

    ``apart`` is None, or tells two sides of a group apart: then pairs of one side are left out
    where the group has two.
    """
    live = np.arange(len(group))
    d = 1
    while len(live):
        live = live[live + d < len(group)]
        live = live[group[live] == group[live + d]]
        yield live[apart[live] != apart[live + d]], live[apart[live] != apart[live + d]] + d
        d += 1


def _sides(pdf: pd.DataFrame) -> np.ndarray:
    """Blocks of a pair of blocks; inside one block every row is a side of its own."""
    return np.where(pdf["bi"] == pdf["bj"], -1 - np.arange(len(pdf)), pdf["own"])


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of pairwise intersection sizes of sorted distinct sets."""
    n, every = len(sets), np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    new = np.empty(len(every), dtype=bool)
    new[:1] = True
    np.not_equal(every[1:], every[:-1], out=new[1:])
    col = np.cumsum(new) - 1
    shared = np.bincount(col) > 1
    keep = shared[col]
    row, col = row[keep], (np.cumsum(shared) - 1)[col[keep]]
    out = np.zeros((n, n), dtype=np.float32)
    step, width = 1024, int(col[-1]) + 1 if len(col) else 0
    for lo in range(0, width, step):  # col is sorted
        i, j = np.searchsorted(col, (lo, lo + step))
        m = np.zeros((n, min(step, width - lo)), dtype=np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        out += m @ m.T
    return out


def _pair_intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Intersection size of each pair of sets, some ``AT_ONCE`` shingles at a time."""
    out = np.zeros(len(i), dtype=np.int64)
    sizes = np.array([len(s) for s in sets])
    load = np.cumsum(sizes[i] + sizes[j])
    at = 0
    while at < len(i):
        end = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + AT_ONCE)))
        both = np.concatenate([x for a, b in zip(i[at:end], j[at:end]) for x in (sets[a], sets[b])])
        pair = np.repeat(np.arange(at, end), sizes[i[at:end]] + sizes[j[at:end]])
        key = mix64(both + pair.astype(np.uint64) * _SALT)
        order = np.argsort(key)
        twice = order[1:][key[order[1:]] == key[order[:-1]]]
        out[at:end] = np.bincount(pair[twice] - at, minlength=end - at)
        at = end
    return out


def _blocked(rows: DataFrame, count, size_column: str | None = None) -> DataFrame:
    """Deal each row of a group out to the block pairs it belongs to: adds bi, bj, own (its block)."""
    nb = F.ceil(count / BLOCK)
    if size_column:
        nb = F.greatest(nb, F.ceil(F.col(size_column) / BLOCK_SHINGLES))
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("nb"))
    other = F.col("other")
    return (
        rows.withColumn("nb", nb.cast("long"))
        .withColumn("own", own.cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("nb") - 1).cast("int"))))
        .withColumn("bi", F.least("own", other))
        .withColumn("bj", F.greatest("own", other))
        .drop("other")
    )


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcast when its first ``rows`` + 1 rows show that it has no more, nor 100 bytes for each of these."""
    wide = [F.coalesce(F.octet_length(f.name) if f.dataType.typeName() in ("string", "binary") else F.size(f.name) * 8, F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary", "array")]
    size = F.sum(sum(wide, F.lit(16 * len(df.columns))).cast("long"))
    count, held = df.limit(rows + 1).agg(F.count("*"), size).head()
    return F.broadcast(df) if count <= rows and (held or 0) <= 100 * rows else df


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, rows: int = 5, recall: float = 0.9995) -> tuple[DataFrame, DataFrame]:
    """Link rows whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    ``docs`` needs ``doc_id`` and ``text``; a row is told by its doc_id and ``row_hash`` (xxhash64 of the
    text), so rows that share a doc_id but not a text are rows of their own, and equal rows are one.
    Returns (members, classes). Members: doc_id, row_hash, hi, lo (the class). Classes: hi, lo,
    node (an id of this run), copies (rows with just that set), first (least doc_id and row_hash),
    size (shingles), links (rows that one of its rows is linked to, equal sets included), root
    (node that stands for its linked component). Rows with a null doc_id are left out.
    """
    bands = choose_bands(threshold, recall, rows)
    total = bands * rows
    floor = threshold - 4 * math.sqrt(threshold * (1 - threshold) / total)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for pdf in batches:
            ids, marks = objects(pdf["doc_id"]), pdf["row_hash"].to_numpy()
            for run, words, counts in chunks(list(range(len(pdf))), list(pdf["text"]), CHUNK_WORDS):
                s, starts = shingles(words, counts, width)
                hi, lo, size = digests(s, distinct_mask(s, starts), starts)
                sig = [x.tobytes() for x in signatures(s, starts, total)]
                yield pd.DataFrame({"doc_id": ids[run], "row_hash": marks[run], "hi": hi, "lo": lo, "size": size, "sig": sig})

    known = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    scanned = materialize(known.mapInPandas(scan, f"doc_id {kind}, row_hash long, hi long, lo long, size int, sig binary"))
    if scanned.groupBy("doc_id", "row_hash").count().filter("count > 1").limit(1).count():
        scanned = materialize(scanned.dropDuplicates(["doc_id", "row_hash"]))
    grouped = scanned.groupBy("hi", "lo").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "row_hash")).alias("first"), F.first("size").alias("size"), F.first("sig").alias("sig")
    )
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()))  # written, so the ids stay
    coarse = connected_components(_estimated_edges(classes.select("node", "sig"), bands, rows, floor))
    coarse = coarse.join(classes.select("node", "copies", "size", "hi", "lo", "first.*"), "node")
    sums = coarse.groupBy("root").agg(F.count("*").alias("members"), F.sum("size").alias("shingles"))
    coarse = materialize(coarse.join(materialize(sums), "root"))
    checked = _verified(known, coarse, width, threshold)
    final = connected_components(checked.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    near = checked.filter("other is null").groupBy("node").agg(F.sum("links").alias("near"))
    linked = broadcast_if_small(materialize(near.join(final, "node")))
    links = (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links")
    return scanned.select("doc_id", "row_hash", "hi", "lo"), classes.drop("sig").join(linked, "node", "left").select(
        "hi", "lo", "node", "copies", "first", "size", links, F.coalesce("root", "node").alias("root")
    )


def _estimated_edges(signed: DataFrame, bands: int, rows: int, floor: float) -> DataFrame:
    """Forest of the classes that share a bucket and whose signatures agree in ``floor`` of their rows."""

    def matrix(column) -> np.ndarray:
        return np.frombuffer(b"".join(column), dtype=np.uint16).reshape(len(column), bands * rows)

    def band_keys(batches):
        for pdf in batches:
            m = matrix(pdf["sig"]).reshape(len(pdf), bands, rows).astype(np.uint64)
            key = np.arange(bands, dtype=np.uint64)[None, :] * np.ones((len(pdf), 1), dtype=np.uint64)
            for r in range(rows):
                key = mix64(key * _MULT + m[:, :, r])
            yield pd.DataFrame({"bucket": key.reshape(-1).view(np.int64), "node": np.repeat(pdf["node"].to_numpy(), bands)})

    keys = signed.mapInPandas(band_keys, "bucket long, node long")
    full = keys.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    members = materialize(keys.join(materialize(full), "bucket"))
    packs = max(1, members.count() // 2000)
    dealt = _blocked(members, F.col("members")).join(signed, "node")
    task = F.when(F.col("nb") == 1, F.pmod("bucket", F.lit(packs))).otherwise(F.xxhash64("bucket", "bi", "bj"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "bi", "bj"], ignore_index=True)
        group, m, node = pdf.groupby(["bucket", "bi", "bj"], sort=False).ngroup().to_numpy(), matrix(pdf["sig"]), pdf["node"].to_numpy()
        left, right = [], []
        for i, j in _neighbours(group, _sides(pdf)):
            alike = np.concatenate([(m[i[k : k + 4096]] == m[j[k : k + 4096]]).mean(axis=1) >= floor for k in range(0, len(i), 4096)] or [np.zeros(0, dtype=bool)])
            left.append(i[alike])
            right.append(j[alike])
        # a class is in several buckets of a task: its rows are one node of the forest
        _, own = np.unique(node, return_inverse=True)
        ids = np.unique(node)
        child, least = _forest(len(ids), own[np.concatenate(left)], own[np.concatenate(right)]) if left else (np.zeros(0, dtype=int),) * 2
        return pd.DataFrame({"a": ids[child], "b": ids[least]})

    return dealt.select("bucket", "bi", "bj", "own", "node", "sig", task.alias("task")).groupBy("task").applyInPandas(compare, "a long, b long").distinct()


def _verified(docs: DataFrame, coarse: DataFrame, width: int, threshold: float) -> DataFrame:
    """Exact similarity inside each coarse group.

    Returns (node, links, null): rows that a block found linked to the class, and (node, null,
    other): forest edges.
    """
    wanted = coarse.select(F.col("doc_id").alias("__doc"), F.col("row_hash").alias("__row"), "node", "hi", "lo")
    wanted = broadcast_if_small(materialize(wanted))

    def extract(batches):
        for pdf in batches:
            want, nodes = pdf[["hi", "lo"]].to_numpy(), pdf["node"].to_numpy()
            for run, words, counts in chunks(list(range(len(pdf))), list(pdf["text"]), CHUNK_WORDS):
                s, starts = shingles(words, counts, width)
                hi, lo, _ = digests(s, distinct_mask(s, starts), starts)
                # another text with this doc_id and row_hash would have other digests
                same = [k for k, i in enumerate(run) if hi[k] == want[i, 0] and lo[k] == want[i, 1]]
                ends = np.append(starts[1:], len(s))
                yield pd.DataFrame({"node": nodes[[run[k] for k in same]], "shingles": [np.unique(s[starts[k] : ends[k]]).tobytes() for k in same]})

    found = docs.join(wanted, (F.col("doc_id") == F.col("__doc")) & (F.col("row_hash") == F.col("__row")))
    sets = found.select("text", "node", "hi", "lo").mapInPandas(extract, "node long, shingles binary")
    sets = materialize(sets.groupBy("node").agg(F.first("shingles").alias("shingles")))
    packs = max(1, int(coarse.agg(F.sum("size")).head()[0] or 0) // (2 * BLOCK_SHINGLES))
    dealt = _blocked(coarse.select("root", "node", "copies", "members", "shingles"), F.col("members"), "shingles").drop("shingles").join(sets, "node")
    task = F.when(F.col("nb") == 1, F.pmod(F.xxhash64("root"), F.lit(packs))).otherwise(F.xxhash64("root", "bi", "bj"))

    def linked(both: np.ndarray, size: np.ndarray, i, j) -> np.ndarray:
        return both >= threshold * (size[i] + size[j] - both) - 1e-9

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["root", "bi", "bj"], ignore_index=True)
        group = pdf.groupby(["root", "bi", "bj"], sort=False).ngroup().to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf["shingles"]]
        size, sides = np.array([len(x) for x in sets], dtype=np.float64), _sides(pdf)
        members = np.bincount(group)
        left, right = [], []
        few = np.flatnonzero(members[group] <= FEW)
        for i, j in _neighbours(group[few], sides[few]):
            i, j = few[i], few[j]
            ok = linked(_pair_intersections(sets, i, j), size, i, j)
            left.append(i[ok])
            right.append(j[ok])
        for g in np.flatnonzero(members > FEW):
            at = np.flatnonzero(group == g)
            both, every = _intersections([sets[k] for k in at]), np.arange(len(at))
            for k in range(0, len(at), 64):  # rows at a time, so that the tests of all pairs aren't held at once
                some = every[k : k + 64]
                i, j = np.nonzero(linked(both[some].astype(np.float64), size[at], some[:, None], every[None, :]) & (some[:, None] < every[None, :]))
                i, j = at[some[i]], at[j]
                apart = sides[i] != sides[j]
                left.append(i[apart])
                right.append(j[apart])
        i, j = (np.concatenate(x) if x else np.zeros(0, dtype=int) for x in (left, right))
        copies, node = pdf["copies"].to_numpy(), pdf["node"].to_numpy()
        links = np.bincount(i, weights=copies[j], minlength=len(pdf)) + np.bincount(j, weights=copies[i], minlength=len(pdf))
        some = np.flatnonzero(links)
        child, least = _forest(len(pdf), i, j)
        return pd.DataFrame(
            {
                "node": np.concatenate([node[some], node[child]]),
                "links": pd.array([*links[some].astype(int).tolist(), *[None] * len(child)], dtype="Int64"),
                "other": pd.array([*[None] * len(some), *node[least].tolist()], dtype="Int64"),
            }
        )

    return materialize(
        dealt.select("root", "bi", "bj", "own", "node", "copies", "shingles", task.alias("task"))
        .groupBy("task")
        .applyInPandas(compare, "node long, links long, other long")
    )
