"""Corpus operators: copies, answers by reference, blocks, merges, evidence, reports."""

from __future__ import annotations

import bisect
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelake.functions.dates import DONE
from scribelake.functions.metadata import target_year
from scribelake.functions.text import cell_text, col, content_hash, empty, mask_pii, nonblank

from .ledger import active
from .shared import cut, ranked, running_before


def exact_copies(docs: DataFrame) -> DataFrame:
    """(keep_id, n, hash) of texts that occur more than once; hashes are combined before the shuffle."""
    groups = docs.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return groups.filter("n > 1").select("keep_id", "n", "hash")


def preferred(rows: DataFrame, group: Column, order: Column, key: str = "doc_id") -> DataFrame:
    """(key, keep_id, keep): the least row of each group by ``order``."""
    keyed = rows.select(key, group.alias("__g"), order.alias("__o"))
    best = keyed.groupBy("__g").agg(F.min_by(key, "__o").alias("keep_id"))
    return keyed.join(best, "__g").select(key, "keep_id", (F.col(key) == F.col("keep_id")).alias("keep"))


def answers_by_reference(qa: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    """Answers found verbatim in their parent as (start, n); others stay inline. Offsets are code points."""
    joined = qa.join(bodies, key).withColumn("at", F.expr("instr(body, answer)"))
    return joined.select(key, "turn", F.when(F.col("at") > 0, F.col("at") - 1).alias("start"), F.length("answer").alias("n"), F.when(F.col("at") == 0, F.col("answer")).alias("inline"))


def rebuild_answers(slim: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    inside = F.expr("substring(body, start + 1, n)")
    return slim.join(bodies, key).select(key, "turn", "start", "n", F.coalesce("inline", inside).alias("rebuilt"))


def body_blocks(rows: DataFrame, part: str, key: str, body: str, size: int, threshold: int = 0) -> DataFrame:
    """(key, part, block): running size of the bodies before the row, by ``size``; lengths are shuffled, not bodies.

    Up to ``threshold`` characters in all there is one block, 0.
    """
    sized = rows.select(key, part, F.coalesce(F.length(body), F.lit(0)).cast("long").alias("n"))
    if threshold and (sized.agg(F.sum("n")).head()[0] or 0) <= threshold:
        return sized.select(key, part, F.lit(0).cast("long").alias("block"))
    return running_before(sized, [part], [key], "n", "before").select(key, part, F.expr(f"before div {size}").alias("block"))


def greedy_blocks(rows: DataFrame, order: list[str], key: str, body: str, chunk: int = 3_000_000, threshold: int = 4_000_000) -> DataFrame:
    """(key, n, block): rows in ``order`` fill blocks; one closes once it holds ``chunk`` characters, and the next starts anew.

    Up to ``threshold`` characters in all there is one block, 0. Lengths are shuffled, not bodies. Where a block
    closes depends on all rows before, but of a range of rows only two things matter to what follows: how many
    blocks it closed and how full the open one is. Each range says both for any fill it may start with (a
    step for each row that could close the first block); these functions are applied one after the
    other, range by range, and then every range numbers its rows. ``order`` and ``key`` tell rows apart.
    """
    sized = rows.select(*dict.fromkeys([*order, key]), F.coalesce(F.length(body), F.lit(0)).cast("long").alias("n"))
    if (sized.agg(F.sum("n")).head()[0] or 0) <= threshold:
        return sized.select(key, "n", F.lit(0).cast("long").alias("block"))
    dealt = cut(sized.repartitionByRange(*order, key).sortWithinPartitions(*order, key).withColumn("__part", F.spark_partition_id()))

    def summary(batches):
        held = [(pdf["n"].to_numpy(dtype=np.int64), pdf["__part"].iat[0]) for pdf in batches if len(pdf)]
        if not held:
            return
        n = np.concatenate([x for x, _ in held])
        ends = np.append(0, np.cumsum(n))
        closes = np.searchsorted(ends[1:], ends[:-1] + chunk)  # the row at which a block that starts at each row closes
        count, left = np.zeros(len(n) + 1, dtype=np.int64), np.zeros(len(n) + 1, dtype=np.int64)
        for i in range(len(n) - 1, -1, -1):
            j = int(closes[i])
            count[i], left[i] = (count[j + 1] + 1, left[j + 1]) if j < len(n) else (0, ends[-1] - ends[i])
        first = np.flatnonzero((ends[:-1] < chunk) & (n > 0))  # only these can close the block that was open before
        yield pd.DataFrame({"part": [int(held[0][1])], "total": [int(ends[-1])], "ends": [ends[first + 1].tolist()], "count": [(count[first + 1] + 1).tolist()], "left": [left[first + 1].tolist()]})

    # the walk over the ranges keeps one number for each; rows without characters never close a block
    starts, block, fill = {}, 0, 0
    steps = dealt.select("n", "__part").mapInPandas(summary, "part int, total long, ends array<long>, count array<long>, left array<long>")
    for r in cut(steps).orderBy("part").toLocalIterator():
        starts[r["part"]] = (block, fill)
        i = bisect.bisect_left(r["ends"], chunk - fill)
        if i < len(r["ends"]):
            block, fill = block + r["count"][i], r["left"][i]
        else:
            fill += r["total"]
    kind = rows.schema[key].dataType.simpleString()

    def number(batches):
        block, fill, begun = 0, 0, False
        for pdf in batches:
            if not len(pdf):
                continue
            if not begun:
                (block, fill), begun = starts[int(pdf["__part"].iat[0])], True
            out = []
            for n in pdf["n"].to_list():
                out.append(block)
                fill += n
                if fill >= chunk:
                    block, fill = block + 1, 0
            yield pd.DataFrame({key: pdf[key], "n": pdf["n"], "block": np.array(out, dtype=np.int64)})

    return dealt.select(key, "n", "__part").mapInPandas(number, f"{key} {kind}, n long, block long")


def write_blocks(rows: DataFrame, blocks: DataFrame, path: str, key: str, body: str) -> None:
    """A JSON-lines folder for each block, with the bodies of its rows."""
    rows.select(key, body).join(blocks.select(key, "block"), key).repartition("block").write.mode("overwrite").partitionBy("block").json(path)


def merge_plan(stored: DataFrame, incoming: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Incoming rows with action: skip where the content is stored already, else copy.

    With ``path``, a row whose path is stored with another content, which is stored nowhere, is
    ``keep_both``: it goes under a ``new_path`` with the first eight characters of its hash.
    """
    there = stored.select(F.sha2(text, 256).alias("__h")).distinct().withColumn("__there", F.lit(True))
    hashed = incoming.withColumn("__h", F.sha2(text, 256)).drop(text).join(there, "__h", "left")
    action = F.when(F.col("__there"), "skip").otherwise("copy")
    if path is None:
        return hashed.withColumn("action", action).drop("__h", "__there")
    taken = stored.select(F.col(path).alias("__path")).distinct()
    both = hashed.join(taken, F.col(path) == F.col("__path"), "left")
    clash = F.col("__there").isNull() & F.col("__path").isNotNull()
    renamed = F.concat(F.regexp_replace(F.col(path), r"\.[^./]+$", ""), F.lit("_"), F.left("__h", F.lit(8)), F.regexp_extract(F.col(path), r"(\.[^./]+)?$", 1))
    return both.withColumn("action", F.when(clash, "keep_both").otherwise(action)).withColumn("new_path", F.when(clash, renamed).otherwise(F.col(path))).drop("__h", "__there", "__path")


def unseen(docs: DataFrame, seen: DataFrame, text: str = "text") -> DataFrame:
    """Documents whose content hash is not in ``seen`` (hash)."""
    return docs.withColumn("hash", F.sha2(text, 256)).drop(text).join(seen, "hash", "left_anti")


def incremental(listing: DataFrame, previous: DataFrame, key: str = "path", force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of ``listing`` (key, hash) that need work, rows of ``previous`` that are carried over).

    A file needs work when its hash differs from that of the last run, or always with ``force``.
    """
    if force:
        return listing, previous.limit(0)
    same = listing.select(key, "hash")
    return listing.join(previous.select(key, "hash"), [key, "hash"], "left_anti"), previous.join(same, [key, "hash"], "left_semi")


#: Rows are added up modulo this prime.
_PRIME = (1 << 61) - 1


def multiset_hash(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (n, h1, h2): a hash of the rows as a multiset, whatever their order; repeated rows count.

    Each row gives two numbers below 2^61 - 1 that are added up modulo that prime, so hashes of parts add up to
    that of the whole (:func:`merged_hash`). Nulls are told from empty values.
    """
    values = [F.struct(F.lit(i), F.col(c).isNull(), F.col(c)) for i, c in enumerate(columns or sorted(rows.columns))]
    part = lambda seed: F.pmod(F.xxhash64(F.lit(seed), *values), F.lit(_PRIME)).cast("decimal(20,0)")
    total = lambda seed: F.coalesce(F.sum(part(seed)) % F.lit(_PRIME).cast("decimal(20,0)"), F.lit(0)).cast("long")
    return rows.agg(F.count("*").alias("n"), total(1).alias("h1"), total(2).alias("h2"))


def merged_hash(state: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """``state`` with the hash of ``added`` rows added and that of ``removed`` ones taken away; all are rows of :func:`multiset_hash`."""
    signs = [state.withColumn("sign", F.lit(1)), added.withColumn("sign", F.lit(1))] + ([removed.withColumn("sign", F.lit(-1))] if removed is not None else [])
    every = reduce(lambda a, b: a.unionByName(b), signs)
    h = lambda c: F.pmod(F.sum(F.col(c).cast("decimal(20,0)") * F.col("sign")), F.lit(_PRIME).cast("decimal(20,0)")).cast("long").alias(c)
    return every.agg(F.sum(F.col("n") * F.col("sign")).alias("n"), h("h1"), h("h2"))


def fingerprint(tables: dict[str, DataFrame], newest: dict[str, str] | None = None) -> DataFrame:
    """A row for each table (table, n, newest, h1, h2, hash) and one for all of them (table '').

    ``newest`` names a column of a table whose greatest value belongs to its hash. The hash of all covers
    the names and hashes of the tables. No global sort; each table is read once.
    """
    of = newest or {}
    each = []
    for name, rows in sorted(tables.items()):
        top = rows.agg(F.max(of[name]).cast("string").alias("newest")) if name in of else rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("newest"))
        each.append(multiset_hash(rows).crossJoin(top).select(F.lit(name).alias("table"), "n", "newest", "h1", "h2"))  # one row each
    every = reduce(lambda a, b: a.unionByName(b), each)
    hashed = cut(every.withColumn("hash", F.sha2(F.concat_ws("|", "table", "n", F.coalesce("newest", F.lit("-")), "h1", "h2"), 256)))
    whole = hashed.agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(F.concat_ws(":", "table", "hash")))), 256).alias("hash"))  # a row a table
    null = F.lit(None)
    return hashed.unionByName(whole.select(F.lit("").alias("table"), "n", null.cast("string").alias("newest"), null.cast("long").alias("h1"), null.cast("long").alias("h2"), "hash"))


def compare_candidates(asked: DataFrame, docs: DataFrame, group: str, k: int) -> DataFrame:
    """(doc_id, other, rank): the ``k`` newest others, those of the same group first, for each asked document.

    Of each group, and of all documents, only the ``k`` + 1 newest can be candidates; only they are joined.
    """
    w = Window.partitionBy(group).orderBy(F.desc("doc_id"))
    newest = docs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).select(F.col("doc_id").alias("other"), F.col(group).alias("g"))
    top = docs.orderBy(F.desc("doc_id")).limit(k + 1 + k).select(F.col("doc_id").alias("other"), F.col(group).alias("g"))
    own = asked.join(newest, F.col(group).eqNullSafe(F.col("g"))).select("doc_id", "other", F.lit(0).alias("far"))
    rest = asked.join(F.broadcast(top), ~F.col(group).eqNullSafe(F.col("g"))).select("doc_id", "other", F.lit(1).alias("far"))  # at most 2k + 1 rows
    order = Window.partitionBy("doc_id").orderBy("far", F.desc("other"))
    every = own.unionByName(rest).filter("doc_id <> other")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("doc_id", "other", "rank")


#: Sources that a pack cites, and characters of an excerpt.
PACK_SOURCES, EXCERPT = 10, 2000


def build_evidence(cited: DataFrame, sources: DataFrame, masked: bool = True) -> DataFrame:
    """Evidence rows of packs: pack_id, place, source_id, kind, hash, excerpt, state.

    ``cited``: pack_id, source_id, place, optionally offset and length of the excerpt. ``sources``:
    source_id, kind, body. The first ``PACK_SOURCES`` places of a pack count. The excerpt is masked, and that can
    itself keep it from being a part of the text: then it is ``unverified``.
    """
    w = Window.partitionBy("pack_id").orderBy("place", "source_id")
    first = cited.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= PACK_SOURCES)
    at = F.coalesce("offset", F.lit(0)) if "offset" in cited.columns else F.lit(0)
    n = F.least(F.coalesce("length", F.lit(EXCERPT)), F.lit(EXCERPT)) if "length" in cited.columns else F.lit(EXCERPT)
    joined = first.join(sources.select("source_id", "kind", F.coalesce("body", F.lit("")).alias("body")), "source_id", "left")
    piece = F.substring(F.col("body"), (at + 1).cast("int"), n.cast("int"))
    shown = mask_pii(piece) if masked else piece
    state = F.when(F.col("body").isNull(), "source_missing").when((shown != "") & F.contains(F.col("body"), shown), "source_text_match").otherwise("unverified")
    return joined.select("pack_id", "place", "source_id", "kind", F.when(F.col("body").isNotNull(), content_hash("body")).alias("hash"), shown.alias("excerpt"), state.alias("state"))


def verify_evidence(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """cited: pack_id, source_id, hash, excerpt, optionally start and end. Adds state: missing, stale, failed or match.

    A range must lie in the text and hold the excerpt.
    """
    s = sources.select(F.col("source_id").alias("__id"), F.col("body").alias("__body"))
    held = F.contains(F.col("__body"), F.col("excerpt"))
    if {"start", "end"} <= set(cited.columns):
        sound = (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.length("__body"))
        there = F.substring(F.col("__body"), F.col("start") + 1, F.col("end") - F.col("start")).contains(F.col("excerpt"))
        held = held & F.when(F.col("start").isNotNull(), F.coalesce(sound & there, F.lit(False))).otherwise(F.lit(True))
    state = (
        F.when(F.col("__id").isNull(), "source_missing")
        .when(F.concat(F.lit("sha256:"), F.sha2("__body", 256)) != F.col("hash"), "source_stale")
        .when(~held, "verification_failed")
        .otherwise("source_text_match")
    )
    return cited.join(s, F.col("source_id") == F.col("__id"), "left").withColumn("state", state).drop("__id", "__body")


def find_source(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Source file of each Markdown file: its header, else the same path, else the same stem, else the name alone.

    ``rows``: path, header. ``listing``: source_path. Adds source_path, null where none is found.
    """
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    name = lambda c: F.regexp_extract(c, r"([^/]+?)(?:\.[^./]+)?$", 1)
    by = lambda key, out: listing.groupBy(key.alias(f"k_{out}")).agg(F.min("source_path").alias(out))
    full, stems, names = by(F.col("source_path"), "full"), by(stem(F.col("source_path")), "stems"), by(name(F.col("source_path")), "names")
    return (
        rows.join(full, F.col("header") == F.col("k_full"), "left")
        .join(stems, stem(F.col("path")) == F.col("k_stems"), "left")
        .join(names, name(F.col("path")) == F.col("k_names"), "left")
        .withColumn("source_path", F.coalesce("full", "stems", "names"))
        .select(*rows.columns, "source_path")
    )


def orphans(rows: DataFrame, listing: DataFrame, staging: str = r"(?:^|/)_staging/") -> DataFrame:
    """Markdown rows (path, header) whose source is not in the listing any more, and all copies in the staging folder.

    Only a list; whether to delete is for :func:`ledger.may_prune`.
    """
    found = find_source(rows, listing)
    return found.filter(F.col("source_path").isNull() | F.col("path").rlike(staging)).select(*rows.columns)


def expected_path(source: Column | str, year: Column | str, root: str = "") -> Column:
    """Where the Markdown of a source belongs: the folder of its year, under its own name."""
    name = F.regexp_extract(col(source), r"([^/]+)$", 1)
    return F.concat(F.lit(root), col(year), F.lit("/"), name, F.lit(".md"))


def layout_plan(rows: DataFrame, listing: DataFrame, year: Column | None = None, root: str = "") -> DataFrame:
    """(source_path, keep_path, move_to, drop_paths): one Markdown file of each source stays, in its year's folder.

    ``rows``: path, header, modified. A file with a header goes before one without, then the newest,
    then the first by path. ``drop_paths`` are the other copies, in order. No file is touched.
    """
    found = find_source(rows, listing).filter("source_path is not null")
    best = F.struct(F.col("header").isNull().alias("bare"), (-F.unix_micros(F.col("modified").cast("timestamp"))).alias("age"), F.col("path").alias("path"))
    plan = found.groupBy("source_path").agg(F.sort_array(F.collect_list(best)).alias("copies"))  # the copies of one source are few
    paths = F.transform("copies", lambda c: c["path"])
    of = target_year("source_path") if year is None else year
    return plan.select("source_path", paths[0].alias("keep_path"), expected_path("source_path", of, root).alias("move_to"), F.slice(paths, F.lit(2), F.greatest(F.size(paths) - 1, F.lit(0))).alias("drop_paths"))


def one_per_source(rows: DataFrame) -> DataFrame:
    """One Markdown file per source: with a header first, then the newest, then by path."""
    w = Window.partitionBy("source_path").orderBy(F.col("header").isNotNull().desc(), F.desc("modified"), "path")
    known = rows.filter("source_path is not null").withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    return known.unionByName(rows.filter("source_path is null"))


def questions_per_document(docs: DataFrame, qa: DataFrame, listed: str = "key_questions") -> DataFrame:
    """(doc_id, n_questions, single, suspect): a single-question document whose own list has several lines is suspect."""
    counts = qa.groupBy("doc_id").agg(F.count("*").alias("n"))
    lines = F.size(F.filter(F.split(F.coalesce(F.col(listed), F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    n = F.coalesce("n", F.lit(0))
    return docs.select("doc_id", lines.alias("__lines")).join(counts, "doc_id", "left").select("doc_id", n.alias("n_questions"), (n == 1).alias("single"), ((n == 1) & (F.col("__lines") > 1)).alias("suspect"))


def metadata_gaps(docs: DataFrame, unknown: str = "미분류", samples: int = 5) -> DataFrame:
    """(gap, n, samples): documents without a date, of unknown requester, without a year, and without a year but dated."""
    gaps = F.array(
        F.when(empty("request_date"), "no date"),
        F.when(empty("requester") | (F.col("requester") == unknown), "no requester"),
        F.when(empty("year"), "no year"),
        F.when(empty("year") & ~empty("request_date"), "no year but dated"),
    )
    rows = docs.select(F.col("doc_id"), F.explode(F.filter(gaps, lambda g: g.isNotNull())).alias("gap"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("gap").orderBy("doc_id"))).filter(F.col("r") <= samples)
    some = first.groupBy("gap").agg(F.sort_array(F.collect_list("doc_id")).alias("samples"))
    return rows.groupBy("gap").agg(F.count("*").alias("n")).join(some, "gap")


def topic_counts(docs: DataFrame, column: str = "topic_tags", separator: str = r"\s*,\s*") -> DataFrame:
    """(tag, n) of a column of separated tags, blank ones left out."""
    tags = F.explode(F.split(F.coalesce(F.col(column), F.lit("")), separator)).alias("tag")
    return docs.select(tags).filter("trim(tag) <> ''").groupBy(F.trim("tag").alias("tag")).agg(F.count("*").alias("n"))


def volumes(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, n, chars): rows and characters of a text column of each table."""
    each = [df.agg(F.count("*").alias("n"), F.sum(F.length(c)).alias("chars")).select(F.lit(t).alias("table"), "n", "chars") for t, (df, c) in tables.items()]
    return reduce(DataFrame.unionByName, each)


def indicators(docs: DataFrame, qa: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row of report figures: documents, questions, documents with tables, institutions, requests, open and done requests."""
    d = docs.agg(F.count("*").alias("documents"), F.count_if(F.col("has_tables") == "Y").alias("with_tables"), F.count_distinct("institution").alias("institutions"))
    q = qa.agg(F.count("*").alias("questions"))
    done = F.trim("status").isin(*DONE)
    r = active(ledger).agg(F.count("*").alias("requests"), F.count_if(done).alias("done"), F.count_if(~F.coalesce(done, F.lit(False))).alias("open"))
    return d.crossJoin(q).crossJoin(r)  # one row each


def reports(docs: DataFrame, qa: DataFrame, ledger: DataFrame) -> dict[str, DataFrame]:
    """The five report tables: KPIs, master list, question detail, ledger, statistics index.

    Lists are numbered in each year, without a task that holds a whole year.
    """
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kpi"), "n")
    kpi = count(docs, "documents").unionByName(count(qa, "questions")).unionByName(count(ledger, "ledger")).unionByName(count(docs.filter("has_tables = 'Y'"), "with tables"))
    index = docs.filter("has_tables = 'Y'").select("doc_id", "year", "title", F.coalesce(nonblank("table_summary"), F.lit("(요약 없음)")).alias("table_summary"))
    questions = qa.select("doc_id", "qa_id", "q_num", "question_title", cell_text("answer_markdown").alias("answer"), "has_tables") if "answer_markdown" in qa.columns else qa
    return {"kpi": kpi, "master": ranked(docs, ["year"], ["doc_id"], "no"), "questions": questions, "ledger": ranked(active(ledger), ["year"], ["ledger_id"], "no"), "statistics": index}
