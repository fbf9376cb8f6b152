"""Listings: pages, point look-ups with excerpts, histories, views of the browser, set differences."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelake.functions.dates import due_rank, due_state
from scribelake.functions.text import col, content_hash, empty, mask_pii, nospace_lower

from .ledger import active, by_due, by_status, by_year, mask_fields, mask_snapshot
from .search import department_filter
from .shared import ranked

#: Bounds and default of a page in the API of the server, and in that of agents.
PAGE, AGENT_PAGE = (1, 1000, 100), (1, 50, 10)


def clamp(value, bounds: tuple[int, int, int]) -> int:
    """A page size inside its bounds; the default for what is no number."""
    low, high, default = bounds
    try:
        return min(high, max(low, int(value)))
    except (TypeError, ValueError):
        return default


def page(rows: DataFrame, order: list[Column | str], limit=None, offset=0, bounds: tuple[int, int, int] = PAGE) -> DataFrame:
    """One page by offset, with the ``total`` of all rows in each row. A top-k: no global sort is kept."""
    n = clamp(limit, bounds)
    try:
        skip = max(0, int(offset))
    except (TypeError, ValueError):
        skip = 0
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(skip).limit(n).crossJoin(F.broadcast(total))  # one row


def numbered_pages(rows: DataFrame, group: list[str], order: list[Column | str], size: int) -> DataFrame:
    """Adds ``place`` and ``page`` in each group, for all pages at once and without a task that holds a group."""
    return ranked(rows, group, order, "place").withColumn("page", F.expr(f"(place - 1) div {size}"))


def keyset_page(rows: DataFrame, keys: list[tuple[str, bool]], after: dict | None = None, limit=None, bounds: tuple[int, int, int] = AGENT_PAGE) -> DataFrame:
    """The page that follows ``after``, the sort keys of the last row seen; ``keys`` are (column, descending).

    The filter reaches the scan, so a deep page costs no more than the first. Adds ``has_next``: whether a
    page follows; the cursor for it are the keys of the last row.
    """
    n = clamp(limit, bounds)
    if after:
        cases, equal = [], F.lit(True)
        for c, down in keys:
            cases.append(equal & (F.col(c) < F.lit(after[c]) if down else F.col(c) > F.lit(after[c])))
            equal = equal & (F.col(c) == F.lit(after[c]))
        rows = rows.filter(reduce(lambda a, b: a | b, cases))
    order = [F.desc(c) if down else F.asc(c) for c, down in keys]
    more = rows.orderBy(*order).limit(n + 1)
    counted = more.agg((F.count("*") > n).alias("has_next"))
    return more.orderBy(*order).limit(n).crossJoin(F.broadcast(counted))  # one row


def excerpts(rows: DataFrame, asked: DataFrame, key: str, body: str, most: int = 2000) -> DataFrame:
    """Point look-ups: key, excerpt, next_offset (null at the end), total_chars, hash.

    ``asked``: key, offset, max_chars, each inside its bounds. Keys that aren't there have no row.
    """
    text = F.coalesce(col(body), F.lit(""))
    start = F.greatest(F.coalesce("offset", F.lit(0)), F.lit(0))
    n = F.greatest(F.least(F.coalesce("max_chars", F.lit(most)), F.lit(most)), F.lit(1))
    total = F.length(text)
    end = start + n
    found = rows.join(F.broadcast(asked) if asked.limit(10_001).count() <= 10_000 else asked, key)
    return found.select(
        key, F.substring(text, (start + 1).cast("int"), n.cast("int")).alias("excerpt"), F.when(end < total, end).alias("next_offset"), total.alias("total_chars"), content_hash(text).alias("hash")
    )


def look_up(rows: DataFrame, key: str, value) -> DataFrame:
    """The row with a key; a tombstone counts as not there. The filter reaches the scan."""
    found = rows.filter(F.col(key) == F.lit(value))
    return active(found) if "status" in rows.columns else found


def history_listing(history: DataFrame, item=None, limit=None, bounds: tuple[int, int, int] = PAGE, key: str = "ledger_id") -> DataFrame:
    """Changes of one item or of all, newest first, snapshots masked."""
    rows = history if item is None else history.filter(F.col(key) == F.lit(item))
    newest = rows.orderBy(F.desc("history_id")).limit(clamp(limit, bounds))
    return newest.withColumn("snapshot", mask_snapshot("snapshot"))


def ledger_listing(rows: DataFrame, as_of: datetime.date, year: str | None = None, status: str | None = None, due: str | None = None, limit=None, offset=0) -> DataFrame:
    """Requests by year, status and due state, masked, with the total before paging."""
    found = by_status(by_year(active(rows), year), status)
    if due:
        found = by_due(found, due, as_of)
    order = [F.desc("year"), F.desc("request_date"), F.desc("seq_no"), F.col("ledger_id")]
    return mask_fields(page(found, order, limit, offset, AGENT_PAGE))


def view(tables: dict[str, DataFrame], mode: str, institution: str | None = None, topic: str | None = None, department: str | None = None, favourites: DataFrame | None = None) -> DataFrame:
    """Rows of a view of the browser: docs, qa, tables (documents with tables) or ledger.

    Institution and topic are contained; the topic in tags, title and question together. They and
    favourites (key) don't apply to ledger rows; tombstones are never shown.
    """
    if mode == "ledger":
        return active(tables["ledger"])
    rows = tables["qa" if mode == "qa" else "docs"]
    if mode == "tables":
        rows = rows.filter("has_tables = 'Y'")
    norm = lambda v: "".join(v.split()).lower()
    if institution:
        rows = rows.filter(nospace_lower("institution").contains(norm(institution)))
    if topic:
        parts = [F.coalesce(F.col(c), F.lit("")) for c in ("topic_tags", "title", "question_title") if c in rows.columns]
        rows = rows.filter(nospace_lower(F.concat_ws(" ", *parts)).contains(norm(topic)))
    if department:
        rows = department_filter(rows, department)
    if favourites is not None:
        rows = rows.join(favourites, [c for c in favourites.columns if c in rows.columns], "left_semi")
    return rows


def browser_order(rows: DataFrame, by: str, as_of: datetime.date | None = None) -> list[Column]:
    """Sort keys of the browser: relevance, newest, oldest, questions, tables or deadline."""
    day = F.coalesce(F.nullif(F.trim("request_date"), F.lit("")), F.col("year")) if "request_date" in rows.columns else None
    key = [c for c in ("doc_id", "qa_id", "ledger_id") if c in rows.columns][:1]
    if by == "relevance":
        first = [F.desc("score")]
    elif by == "newest":
        first = [day.desc()]
    elif by == "oldest":
        first = [day.asc()]
    elif by == "questions":
        first = [F.desc("n_questions")]
    elif by == "tables":
        first = [(F.col("has_tables") == "Y").desc(), day.desc()] if day is not None else [(F.col("has_tables") == "Y").desc()]
    elif by == "deadline":
        first = [due_rank(due_state("deadline", "status", as_of)).asc(), F.asc("deadline")]
    else:
        raise ValueError(f"no order {by!r}")
    return [*first, *[F.asc(k) for k in key]]


def set_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of two stores: left only, right only or both; each key once."""
    a, b = left.select(F.col(key).alias("a")).distinct(), right.select(F.col(key).alias("b")).distinct()
    side = F.when(F.col("b").isNull(), "left only").when(F.col("a").isNull(), "right only").otherwise("both")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias(key), side.alias("side"))


def sheet_report(sheet: DataFrame, stored: DataFrame, key: str = "ledger_id") -> DataFrame:
    """(key, state): only in sheet, only in table (alive and not made by the system), or there but deleted."""
    s = sheet.select(F.col(key).alias("a")).filter(~empty(F.col("a").cast("string"))).distinct()
    t = stored.select(F.col(key).alias("b"), "status", "request_type")
    joined = s.join(t, F.col("a") == F.col("b"), "full_outer")
    dead = F.coalesce(F.trim("status"), F.lit("")) == "[삭제]"
    state = (
        F.when(F.col("b").isNull(), "only in sheet")
        .when(F.col("a").isNotNull() & dead, "deleted in table")
        .when(F.col("a").isNull() & ~dead & (F.coalesce(F.trim("request_type"), F.lit("")) != "시스템"), "only in table")
    )
    return joined.select(F.coalesce("a", "b").alias(key), state.alias("state")).filter("state is not null")


def union_queues(*queues: DataFrame, key: str = "operation_id", order: str = "seq") -> DataFrame:
    """Operations of several queues, each operation once: the one of the least ``order``, then of the first queue."""
    parts = [q.withColumn("__q", F.lit(n)) for n, q in enumerate(queues)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for c in every.columns if c not in (key, "__q")]
    best = every.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(order, "__q")).alias("r"))
    return best.select(key, "r.*")


def years(*tables: DataFrame, column: str = "year", four_digits: bool = True) -> DataFrame:
    """Different years of several tables, newest first."""
    every = reduce(DataFrame.union, [t.select(F.col(column).cast("string").alias("year")) for t in tables]).distinct()
    return (every.filter(F.col("year").rlike(r"^\d{4}$")) if four_digits else every.filter(~empty("year"))).orderBy(F.desc("year"))


def masked_hits(found: DataFrame, column: str = "snippet") -> DataFrame:
    """Search hits with their snippets masked."""
    return found.withColumn(column, mask_pii(column))
