"""Phrase collocations from a weighted de Bruijn graph of the corpus.

Nodes are pairs of neighbouring words, edges triples; the edge (w1 w2 w3) leads from (w1 w2) to (w2 w3).

1. Words are counted per language; those that occur ``least`` times can be in phrases. They get
   codes: ranks while the dictionary is small enough for every task, else 63-bit digests of which
   it is proven that no frequent word shares one.
2. Every word occurrence is the start of one edge, shortened at the end of its piece. Edges are counted per
   task, dealt by first word (frequent ones by two or three words, so no word is a hot key), sorted, and
   counted while they stream by. In the same pass the flow out of a node, shortened edges included, is
   the count of its pair, and the flow out of all nodes of a word is the word's.
3. Nodes whose only in-edge and only out-edge carry their whole flow are inside unary paths, which are
   compacted by pointer doubling. Inside a path every pair occurs as often as the path, so flows are
   looked up for the ends of paths only, and pairs inside are never candidates: the path holds them.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64
from .neardup import broadcast_if_small

#: Words, and bytes of them, up to which every task holds the dictionary (some 150 MB in Python at most).
DICTIONARY_WORDS, DICTIONARY_BYTES = 700_000, 16 << 20
#: Word occurrences, and different words, that a task holds before it hands on their counts.
HELD, HELD_WORDS = 1 << 20, 200_000
#: Bytes of a text that are split at once, and keys that edges are dealt by.
SEGMENT, KEYS = 1 << 20, 4096

#: Bytes: A-Z lower-cased, ends of pieces a line feed, ends of words a blank.
_BYTES = bytes(0x0A if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b in b" \t" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_EMPTY, _END = -1, -2
_BITS, _TRIPLE = np.int64(21), "k int, a long, b long, c long, n long"
_ARROW = pa.schema([pa.field("k", pa.int32()), *[pa.field(x, pa.int64()) for x in "abcn"]])


def _segments(data: bytes):
    at = 0
    while len(data) - at > SEGMENT:
        end = data.find(b" ", at + SEGMENT)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _columns(batch, *names):
    return zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in names))


def vocabulary(docs: DataFrame) -> DataFrame:
    """lang, word, n: all words with their occurrences."""

    def scan(batches):
        held: dict = {}

        def rows():
            for lang, count in held.items():
                text = [pa.array(x, pa.binary()).cast(pa.string(), safe=False) for x in ([lang] * len(count), list(count))]
                yield pa.record_batch([*text, pa.array(count.values(), pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for i, (lang, text) in enumerate(_columns(batch, "lang", "text")):
                count = held.setdefault(lang, Counter())
                for part in _segments(text.translate(_BYTES)):
                    count.update(part.split())
                if i % 64 == 0 and sum(map(len, held.values())) > HELD_WORDS:
                    yield from rows()
                    held = {}
        yield from rows()

    found = _named(docs).mapInArrow(scan, "lang string, word string, n long")
    return materialize(found.groupBy("lang", "word").agg(F.sum("n").alias("n")))


def digest(lang: bytes, word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(lang + b"\0" + word, seed) >> 1 | 1


class _Codes(dict):
    """Codes of the words of one language; words that it doesn't know get ``other``'s."""

    def __init__(self, known: dict, other):
        super().__init__(known)
        self.update({b"": _EMPTY, b"\n": _END})
        self.other = other

    def __missing__(self, word: bytes) -> int:
        if self.other is None:
            return 0
        if len(self) > HELD_WORDS:
            self.clear()
            self.update({b"": _EMPTY, b"\n": _END})
        self[word] = code = self.other(word)
        return code


def _coded(spark, words: DataFrame, least: int):
    """(words with their code, how a task gets the codes of a language, a limit of rank codes or None)."""
    frequent = words.filter(F.col("n") >= least)
    count, size = frequent.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word") + F.octet_length("lang")), F.lit(0))).head()
    if count <= DICTIONARY_WORDS and size <= DICTIONARY_BYTES:
        rows = sorted((-r.n, r.lang, r.word) for r in frequent.select("lang", "word", "n").toLocalIterator())
        ranks: dict = {}
        for i, (_, lang, word) in enumerate(rows):
            ranks.setdefault(lang.encode("utf-8", "surrogatepass"), {})[word.encode("utf-8", "surrogatepass")] = i + 1
        known = spark.sparkContext.broadcast(ranks)
        table = spark.createDataFrame([(i + 1, lang, word, -n) for i, (n, lang, word) in enumerate(rows)], "code long, lang string, word string, n long")
        return materialize(table), lambda lang: _Codes(known.value.get(lang, {}), None), 1 << int(_BITS)
    for seed in range(64):

        def coded(batches, seed=seed):
            for batch in batches:
                codes = pa.array([digest(a, b, seed) for a, b in _columns(batch, "lang", "word")], pa.int64())
                yield pa.record_batch([codes, *[batch.column(c) for c in ("lang", "word", "n")]], names=["code", "lang", "word", "n"])

        every = materialize(words.mapInArrow(coded, "code long, lang string, word string, n long"))
        shared = every.groupBy("code").agg(F.count("*").alias("words"), F.sum("n").alias("n")).filter(f"words > 1 and n >= {least}")
        if not shared.limit(1).count():
            return every.filter(F.col("n") >= least), lambda lang: _Codes({}, lambda w: digest(lang, w, seed)), None
    raise RuntimeError("no seed keeps the digests of frequent words apart")


def _unique(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray | None, ranks: int | None):
    """Different triples in order, with their counts."""
    n = np.ones(len(a), dtype=np.int64) if n is None else n
    if ranks:
        key = a << (_BITS + _BITS) | b << _BITS | c
        order = np.argsort(key)
        new = np.flatnonzero(np.diff(key[order], prepend=-1))
    else:
        order = np.lexsort((c, b, a))
        new = np.zeros(len(a), dtype=bool)
        new[:1] = True
        for x in (a[order], b[order], c[order]):
            new[1:] |= x[1:] != x[:-1]
        new = np.flatnonzero(new)
    if not len(a):
        return a, b, c, n
    first = order[new]
    return a[first], b[first], c[first], np.add.reduceat(n[order], new)


def edges(docs: DataFrame, codes_of, ranks: int | None, hot: np.ndarray) -> DataFrame:
    """k, a, b, c, n: partial counts of edges. 0 in b or c is the end of a piece or a word that is in no phrase."""

    def keyed(x):
        a, b, c, n = _unique(*(np.concatenate(y) for y in zip(*x)), None, ranks)
        u = [v.astype(np.uint64) for v in (a, b, c)]
        one, two, three = mix64(u[0]), mix64(mix64(u[0]) + u[1]), mix64(mix64(mix64(u[0]) + u[1]) + u[2])
        of, a_hot, b_hot = np.uint64(KEYS), np.isin(a, hot), np.isin(b, hot)
        k = np.where(a_hot, two % of, one % of).astype(np.int32)
        k = np.where(a_hot & b_hot, -1 - (three % of).astype(np.int32), k).astype(np.int32)
        for at in range(0, len(a), 1 << 17):
            some = slice(at, at + (1 << 17))
            yield pa.record_batch([pa.array(v[some]) for v in (k, a, b, c, n)], schema=_ARROW)

    def scan(batches):
        codes, held, size = {}, [], 0
        for batch in batches:
            for lang, text in _columns(batch, "lang", "text"):
                if lang not in codes:
                    codes[lang] = codes_of(lang)
                of = codes[lang].__getitem__
                parts = []
                for part in _segments(text.translate(_BYTES)):
                    tokens = part.replace(b"\n", b" \n ").split(b" ")
                    parts.append(np.fromiter(map(of, tokens), dtype=np.int64, count=len(tokens)))
                x = np.concatenate([*parts, np.array([_END, _END, _END], dtype=np.int64)])
                x = x[x != _EMPTY]
                a, b, c = x[:-2], np.maximum(x[1:-1], 0), np.maximum(x[2:], 0)
                starts = a > 0
                a, b, c = a[starts], b[starts], c[starts]
                held.append((a, b, np.where(b > 0, c, 0)))
                size += len(a)
                if size >= HELD:
                    yield from keyed(held)
                    held, size = [], 0
        if size:
            yield from keyed(held)

    return _named(docs).mapInArrow(scan, _TRIPLE)


def flows(partial: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges a, b, c, n), (nodes a, b, f) and (words a, f) with the counts of triples, pairs and words, triples and pairs from ``least`` on."""

    def close(k, a, b, c, n):
        """Rows of complete nodes, in order: edges and nodes that may be frequent, and what each word is due."""
        new = np.flatnonzero(np.diff(a, prepend=-1) | np.diff(b, prepend=-1) | np.diff(c, prepend=-1) | np.diff(k, prepend=k[0] - 1))
        k, a, b, c, n = k[new], a[new], b[new], c[new], np.add.reduceat(n, new)
        node = np.flatnonzero(np.diff(k, prepend=k[0] - 1) | np.diff(a, prepend=-1) | np.diff(b, prepend=-1))
        flow = np.add.reduceat(n, node)
        word = np.flatnonzero(np.diff(a[node], prepend=-1))
        some, kept = (c > 0) & (n >= least), (b[node] > 0) & ((flow >= least) | (k[node] < 0))
        zero = np.zeros(len(a), dtype=np.int64)
        at = node[kept]
        parts = [(a[some], b[some], c[some], n[some]), (a[at], b[at], zero[: len(at)], flow[kept]), (a[node[word]], zero[: len(word)], zero[: len(word)], np.add.reduceat(flow, word))]
        return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*parts)], names=list("abcn"))

    def stream(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(x).to_numpy() for x in "kabcn"]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            k, a, b, c, n = now
            last = len(a) - int(np.argmax(((k != k[-1]) | (a != a[-1]) | (b != b[-1]))[::-1])) if (k[0], a[0], b[0]) != (k[-1], a[-1], b[-1]) else 0
            if last:
                yield close(*(x[:last] for x in now))
            held = [x[last:] for x in now]
            if len(held[0]) > 1 << 16:  # a node that is longer than a batch
                k = held[0][:1]
                a, b, c, n = _unique(*held[1:], None)
                held = [np.repeat(k, len(a)), a, b, c, n]
        if held is not None:
            yield close(*held)

    dealt = partial.repartition("k").sortWithinPartitions("k", "a", "b", "c")
    found = materialize(dealt.mapInArrow(stream, "a long, b long, c long, n long"))
    nodes = found.filter("b > 0 and c = 0").groupBy("a", "b").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    words = found.filter("b = 0").groupBy("a").agg(F.sum("n").alias("f"))
    return found.filter("c > 0"), materialize(nodes), materialize(words)


def unary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (a, b, f) with held, the count of the most frequent triple that holds the pair, and inner: the node is inside a unary path."""
    into = edges.groupBy("b", "c").agg(F.max("n").alias("into")).select(F.col("b").alias("a"), F.col("c").alias("b"), "into")
    out = edges.groupBy("a", "b").agg(F.max("n").alias("out"))
    both = nodes.join(into, ["a", "b"], "left").join(out, ["a", "b"], "left")
    inner = F.coalesce((F.col("into") == F.col("f")) & (F.col("out") == F.col("f")), F.lit(False))
    return materialize(both.select("a", "b", "f", F.greatest("into", "out").alias("held"), inner.alias("inner")))


def paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """codes (the words of a maximal unary path, three at least), n (how often it occurs), first and last (counts of its first and last pair)."""
    inner = nodes.filter("inner").select("a", "b", "f")
    # the only edge into an inner node: the path goes up through it
    up = edges.select("a", "b", "c", "n").join(inner.select(F.col("a").alias("b"), F.col("b").alias("c"), "f"), ["b", "c"]).filter("n = f")
    up = up.select(F.col("b").alias("x"), F.col("c").alias("y"), F.col("a").alias("up_x"), F.col("b").alias("up_y"), F.struct("a", "b", "c").alias("head"), F.lit(1).cast("long").alias("hops"))
    now = materialize(up)
    while True:
        above = now.select(F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.struct(F.col("up_x").alias("x"), F.col("up_y").alias("y"), "head", "hops").alias("above"))
        moved = now.join(above, ["up_x", "up_y"], "left")
        pick = lambda c, new: F.when(F.col("above").isNull(), F.col(c)).otherwise(new).alias(c)
        now = materialize(
            moved.select("x", "y", pick("up_x", F.col("above.x")), pick("up_y", F.col("above.y")), pick("head", F.col("above.head")), pick("hops", F.col("hops") + F.col("above.hops")), F.col("above").isNotNull().alias("moved"))
        )
        if not now.filter("moved").limit(1).count():
            break
        now = now.drop("moved")
    # an edge that starts inside a path belongs to it, any other begins one
    placed = edges.join(now.select(F.col("x").alias("a"), F.col("y").alias("b"), "head", "hops"), ["a", "b"], "left")
    placed = placed.select(F.coalesce("head", F.struct("a", "b", "c")).alias("head"), F.coalesce("hops", F.lit(0)).alias("at"), "c", "n")
    grouped = placed.groupBy("head").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "c"))).alias("rest"))
    codes = F.concat(F.array("head.a", "head.b"), F.transform("rest", lambda x: x["c"])).alias("codes")
    found = grouped.select(codes, "n").withColumns({"x": F.col("codes")[0], "y": F.col("codes")[1], "v": F.element_at("codes", -2), "w": F.element_at("codes", -1)})
    ends = nodes.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("f").alias("first"))
    found = found.join(ends, ["x", "y"]).join(ends.select(F.col("x").alias("v"), F.col("y").alias("w"), F.col("first").alias("last")), ["v", "w"])
    return found.select("codes", "n", "first", "last")


def _score(a: str, left: str, right: str):
    """floor(10^6 a a / (left right)), in exact decimals."""
    wide = [f"cast({x} as decimal(15,0))" for x in (a, left, right)]
    return F.expr(f"(cast(1000000 as decimal(7,0)) * ({wide[0]} * {wide[0]})) div ({wide[1]} * {wide[2]})")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of two or three words of each language, by how far they exceed chance.

    Null texts count as empty, a null lang as ``und``. Texts are lower-cased (A-Z), cut into pieces at
    ``[.,;:!?\\x0A-\\x0D]`` and into words at blanks and tabs. Candidates occur ``least`` times inside
    pieces; those that lie inside a longer candidate with ``share`` hundredths of their count are dropped.
    The score of a cut is floor(10^6 a a / (l r)) with the counts of phrase, left and right part; the
    lowest cut counts, of equal ones the first. Returns lang, rank, phrase, a, l, r, n (words of the
    language), score, k (the cut); order: score, a, both descending, then phrase in UTF-8 order. A row is a
    document, also a repeated one; a text is never cut; an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    every = vocabulary(docs)
    table, codes_of, ranks = _coded(spark, every, least)
    total = every.groupBy("lang").agg(F.sum("n").alias("n"))
    occurrences = every.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    hot = np.array([r.code for r in table.filter(F.col("n") * 1000 >= occurrences).select("code").collect()], dtype=np.int64)  # 1,000 at most
    found, pairs, singles = flows(edges(docs, codes_of, ranks, hot), least)
    nodes = unary(found, pairs)
    whole = materialize(paths(found, nodes))

    steps = F.sequence(F.lit(0), F.size("codes") - 3)
    flow = lambda x, end: F.when(end, F.col(x)).otherwise(F.col("n"))
    triples = whole.select("*", F.explode(steps).alias("i")).select(
        *[F.expr(f"codes[i + {j}]").alias(f"w{j + 1}") for j in range(3)], F.col("n").alias("a"), flow("first", F.col("i") == 0).alias("f12"), flow("last", F.col("i") == F.size("codes") - 3).alias("f23")
    )
    f = broadcast_if_small(singles)
    word = lambda df, c: df.join(f.select(F.col("a").alias(c), F.col("f").alias(f"f_{c}")), c)
    triples = word(word(triples, "w1"), "w3").withColumn("s1", _score("a", "f_w1", "f23")).withColumn("s2", _score("a", "f12", "f_w3"))
    first = F.col("s1") <= F.col("s2")
    cut = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    triples = triples.select("w1", "w2", "w3", "a", cut("f_w1", "f12").alias("l"), cut("f23", "f_w3").alias("r"), cut("s1", "s2").alias("score"), F.when(first, 1).otherwise(2).alias("k"))
    free = nodes.filter(~F.col("inner") & (F.coalesce("held", F.lit(0)) * 100 < F.col("f") * share))
    doubles = word(word(free.select(F.col("a").alias("w1"), F.col("b").alias("w2"), F.col("f").alias("a")), "w1"), "w2").withColumn("score", _score("a", "f_w1", "f_w2"))
    doubles = doubles.select("w1", "w2", F.lit(None).cast("long").alias("w3"), "a", F.col("f_w1").alias("l"), F.col("f_w2").alias("r"), "score", F.lit(1).alias("k"))

    text = materialize(table.select("code", "lang", "word"))
    langs = text.select(F.col("code").alias("w1"), "lang")
    tied = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    ranked = materialize(doubles.unionByName(triples).join(langs, "w1").withColumn("rank", tied).filter(F.col("rank") <= top))
    for c in ("w1", "w2", "w3"):
        ranked = ranked.join(text.select(F.col("code").alias(c), F.col("word").alias(f"{c}_text")), c, "left")
    phrase = F.concat_ws(" ", "w1_text", "w2_text", "w3_text")
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    listed = ranked.withColumn("phrase", phrase).withColumn("rank", order).filter(F.col("rank") <= top)  # each task keeps as many at most
    return listed.join(broadcast_if_small(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "k")
