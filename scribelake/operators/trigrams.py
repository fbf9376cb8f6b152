"""A trigram index over searched texts, for sets of queries that are asked again and again.

Three Parquet tables in one folder:

- ``texts``: the normalised texts, partitioned by a hash of their key, so that only the partitions of
  candidates are read, and numbered in blocks;
- ``postings``: (gram, part, block, places), the places of a block's texts that hold the gram, two bytes each, in
  ranges of grams and sorted in each, so that a look-up skips what other grams fill, and a gram that very many
  texts hold is spread over files;
- ``grams``: in how many texts a gram is.

A form of three characters or more is looked up by its rarest grams; the texts that hold all of them
are candidates, and the form is looked for in these only. The result is that of a scan, row for row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scribelake.functions.text import nospace_lower

from .shared import cut, small

#: Grams of a form that are looked up, the rarest ones.
RAREST = 3
#: Grams up to which a look-up names them to the file reader.
NAMED = 2000
#: Bits of a place in a block; two bytes hold it.
PLACE_BITS = 11
#: Grams of texts that are sorted at a time, and rows that are Python objects at a time.
GRAMS_AT_ONCE, ROWS_AT_ONCE = 2_000_000, 256


def gram_codes(text: str) -> np.ndarray:
    """Different trigrams of a text, each the number that its three characters make."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def _asked_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            forms = batch.column(0).slice(start, ROWS_AT_ONCE).to_pylist()
            grams = [gram_codes(v) for v in forms]
            if forms:
                yield pa.RecordBatch.from_arrays([pa.array([v for v, g in zip(forms, grams) for _ in g], pa.string()), pa.array(np.concatenate(grams))], ["variant", "gram"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, block, place, text) -> (gram, part, block, texts, places): rows of one block that follow each other become one list a gram."""

    def lists(part: int, block: int, places: list[int], grams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every, held = np.concatenate(grams), np.repeat(np.array(places, dtype="<u2"), [len(g) for g in grams])
        order = np.argsort(every, kind="stable")
        every, held = every[order], held[order]
        starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        ends = np.append(starts, len(every)).astype("<i4")
        n = len(starts)
        binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends * held.itemsize), pa.py_buffer(held)])
        columns = [pa.array(every[starts]), pa.array(np.full(n, part, "i4")), pa.array(np.full(n, block)), pa.array(np.diff(ends).astype("i8")), binary]
        out = pa.RecordBatch.from_arrays(columns, ["gram", "part", "block", "texts", "places"])
        for start in range(0, n, 1 << 16):
            yield out.slice(start, 1 << 16)

    at, places, grams, size = None, [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            for part, block, place, text in zip(*(c.slice(start, ROWS_AT_ONCE).to_pylist() for c in batch.columns)):
                if size and ((part, block) != at or size > GRAMS_AT_ONCE):
                    yield from lists(*at, places, grams)
                    places, grams, size = [], [], 0
                at, own = (part, block), gram_codes(text)
                if len(own):
                    places.append(place)
                    grams.append(own)
                    size += len(own)
    if size:
        yield from lists(*at, places, grams)


def occurrences(text: Column, form: Column) -> Column:
    """How often a form that isn't empty is in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, form, F.lit("")))) / F.length(form)).cast("long")


class TrigramIndex:
    """The index in the folder ``path``; ``key`` names the rows."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path, key

    @classmethod
    def build(cls, texts: DataFrame, path: str, key: str = "doc_id", parts: int = 64) -> TrigramIndex:
        """``texts``: key, field, weight, text, a row for each searched field (``search.search_text``). A folder that holds an index is replaced."""
        norm = texts.select(key, "field", "weight", nospace_lower("text").alias("text")).filter("text <> ''")
        norm = norm.withColumn("size", F.length("text").cast("long")).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        dealt = norm.repartition("part").sortWithinPartitions("part").withColumn("block", F.monotonically_increasing_id())
        place = F.col("block").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        dealt = dealt.withColumn("place", place).withColumn("block", F.shiftright("block", PLACE_BITS))
        dealt.write.mode("overwrite").partitionBy("part").parquet(f"{path}/texts")
        index = cls(texts.sparkSession, path, key)
        found = index.texts().select("part", "block", "place", "text").mapInArrow(_postings, "gram long, part int, block long, texts long, places binary")
        found = cut(found)  # dealing by range reads it twice
        found.repartitionByRange("gram", "part", "block").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/postings")
        found.groupBy("gram").agg(F.sum("texts").alias("texts")).write.mode("overwrite").parquet(f"{path}/grams")
        return index

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def rarest(self, forms: DataFrame) -> DataFrame:
        """(variant, gram): the rarest grams of each form of three characters or more, of forms all of whose grams some text holds."""
        asked = forms.select("variant").mapInArrow(_asked_grams, "variant string, gram long")
        known = self.spark.read.parquet(f"{self.path}/grams")
        counted = asked.join(known, "gram", "left")
        order = F.row_number().over(Window.partitionBy("variant").orderBy(F.coalesce("texts", F.lit(0)), "gram"))
        rarest = counted.withColumn("place", order).filter(F.col("place") <= RAREST)
        # a gram that no text holds ends the search for its form here
        rarest = rarest.withColumn("needed", F.count("*").over(Window.partitionBy("variant"))).withColumn("found", F.count("texts").over(Window.partitionBy("variant")))
        return cut(rarest.filter("found = needed").select("variant", "gram"))

    def candidates(self, grams: list[list[int]]) -> DataFrame:
        """(part, block, place, forms): texts that hold all the given grams of some forms, and the numbers of these forms; other grams aren't asked."""
        named = sorted({g for some in grams for g in some})
        postings = self.postings()
        if len(named) <= NAMED:
            postings = postings.filter(F.col("gram").isin(named))
        else:
            postings = postings.join(small(self.spark.createDataFrame([(g,) for g in named], "gram long")), "gram")
        shared = self.spark.sparkContext.broadcast(grams)

        def meet(block: pa.Table) -> pa.Table:
            lists: dict[int, list[np.ndarray]] = {}
            for gram, places in zip(block["gram"].to_pylist(), block["places"].to_pylist()):
                lists.setdefault(gram, []).append(np.frombuffer(places, dtype="<u2"))
            at, forms = [], []
            for i, some in enumerate(shared.value):
                if all(g in lists for g in some):
                    n = np.bincount(np.concatenate([x for g in some for x in lists[g]]))  # a list holds a place once
                    at.append(np.flatnonzero(n == len(some)))
                    forms.append(np.full(len(at[-1]), i, "i4"))
            every = np.concatenate([*at, np.empty(0, "i8")])
            order = np.argsort(every, kind="stable")
            every, which = every[order], np.concatenate([*forms, np.empty(0, "i4")])[order]
            starts = np.flatnonzero(np.diff(every, prepend=-1))
            asked = pa.ListArray.from_arrays(pa.array(np.append(starts, len(every)).astype("i4")), pa.array(which))
            one = lambda name, kind: pa.array(np.full(len(starts), block[name][0].as_py(), kind))
            return pa.table({"part": one("part", "i4"), "block": one("block", "i8"), "place": pa.array(every[starts].astype("i4")), "forms": asked})

        return postings.groupBy("part", "block").applyInArrow(meet, "part int, block long, place int, forms array<int>")

    def found(self, forms: list[str], grams: list[list[int]], counted: bool) -> DataFrame:
        """(variant, key, field, weight, n) for the candidates of ``forms`` that hold them."""
        from .search import JAMO

        candidates = cut(self.candidates(grams))
        read = [r["part"] for r in candidates.select("part").distinct().collect()]  # as many as there are partitions, at most
        texts = self.texts().filter(F.col("part").isin(read)).join(small(candidates), ["part", "block", "place"])
        shared = self.spark.sparkContext.broadcast([(v, bool(re.search(JAMO, v))) for v in forms])
        kind, key = texts.schema[self.key].dataType.simpleString(), self.key

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                    some = batch.slice(start, ROWS_AT_ONCE)
                    held, row, n = [], [], []
                    for i, (field, text, numbers) in enumerate(zip(*(some.column(c).to_pylist() for c in ("field", "text", "forms")))):
                        initials = field.startswith("initials:")
                        for v, jamo in map(asked.__getitem__, numbers):
                            if jamo == initials and v in text:
                                held.append(v)
                                row.append(i)
                                n.append(text.count(v) if counted else 1)
                    of = lambda c: some.column(c).take(pa.array(row, pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), of(key), of("field"), of("weight"), pa.array(n, pa.int64())], ["variant", key, "field", "weight", "n"])

        return texts.select(key, "field", "weight", "text", "forms").mapInArrow(check, f"variant string, {key} {kind}, field string, weight double, n long")

    def hits(self, variants: DataFrame, counted: bool = False) -> DataFrame:
        """(variant, key, field, weight, n) as ``search.form_hits`` gives them, ``counted`` too.

        Forms of initials are looked for in fields of initials, others in the others. Forms under three
        characters have no gram: all texts are read for them. ``search.PASS_FORMS`` forms are looked up in one pass.
        """
        from .search import PASS_FORMS, form_hits

        forms = cut(variants.select("variant").distinct())
        rarest = self.rarest(forms.filter(F.length("variant") >= 3))
        passes = max(1, -(-forms.count() // PASS_FORMS))
        texts, out = self.texts(), None
        for p in range(passes):
            part = rarest.filter(F.pmod(F.xxhash64("variant"), F.lit(passes)) == p)
            grams: dict[str, list[int]] = {}
            for r in part.collect():  # a few numbers for each of about PASS_FORMS forms
                grams.setdefault(r["variant"], []).append(r["gram"])
            some = self.found(list(grams), list(grams.values()), counted)
            out = some if out is None else out.unionByName(some)
        short = forms.filter(F.length("variant") < 3)
        if short.limit(1).count():
            out = out.unionByName(form_hits(texts, short, self.key, counted).filter("variant is not null"))
        if counted:
            out = out.unionByName(texts.select(F.lit(None).cast("string").alias("variant"), self.key, "field", "weight", F.col("size").alias("n")))
        return out
