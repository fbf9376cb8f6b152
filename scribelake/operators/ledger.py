"""Ledger operators: filters, linkage, change application, timelines, retention, identifiers, gates."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelake.functions.dates import due_state, strict_date
from scribelake.functions.text import digits, empty, mask_pii, nonblank, requester_stem

from .shared import cut, ranked

# Fixed value: status of a tombstone.
DELETED = "[삭제]"
BLANK = "(없음)"
#: Fields that changes and snapshots compare.
COMPARED = ["year", "seq_no", "party", "requester", "aide", "title", "details", "request_date", "deadline", "submit_date", "department", "status", "note", "linked_doc_id"]
# Actions whose snapshot is the state before them.
BEFORE_ACTIONS = ("UPDATE", "DELETE", "EXCEL_SYNC_UPDATE", "EXCEL_SYNC_DELETE")
# Shape of an identifier; fields that hold dates, and fields that are masked.
ID_SHAPE = r"^REQ-\d{4}-\d+$"
DATE_FIELDS = ("request_date", "deadline", "submit_date")
MASKED_FIELDS = ("requester", "aide", "title", "details", "note")
# What a new request gets where nothing is given.
DEFAULTS = {"status": "작성중", "request_type": "시스템"}


def active(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce(F.trim("status"), F.lit("")) != DELETED)


def by_year(rows: DataFrame, year: str | None) -> DataFrame:
    return rows if not year or year == "ALL" else rows.filter(F.col("year") == year)


def by_status(rows: DataFrame, status: str | None) -> DataFrame:
    return rows if not status or status == "ALL" else rows.filter(F.trim("status") == status)


def by_due(rows: DataFrame, due: str, as_of: datetime.date) -> DataFrame:
    state = due_state("deadline", "status", as_of)
    return rows.filter(state != "done" if due == "open" else state == due)


def date_range(rows: DataFrame, low: str | None, high: str | None, column: str = "request_date") -> DataFrame:
    """Text comparison on ISO dates; either end may be open; rows without a date fail."""
    out = rows.filter(~empty(column))
    out = out if low is None else out.filter(F.col(column) >= low)
    return out if high is None else out.filter(F.col(column) <= high)


def mask_fields(rows: DataFrame, fields: tuple[str, ...] = ("contact_person", "aide", "note")) -> DataFrame:
    return rows.withColumns({f: mask_pii(f) for f in fields if f in rows.columns})


def validate(rows: DataFrame, stored_status: str | None = None) -> DataFrame:
    """Adds ``errors``: what keeps a request from being accepted; empty when nothing does.

    Title and requester are required, the year has four digits, dates are empty or days of the
    calendar, an identifier has its shape. With ``stored_status``, a column of the stored status, a
    status that was filled may not become blank.
    """
    iso = lambda c: empty(c) | F.try_to_date(F.col(c), "yyyy-MM-dd").isNotNull()
    checks = [
        F.when(empty("title"), "title"),
        F.when(empty("requester"), "requester"),
        F.when(~F.coalesce(F.col("year"), F.lit("")).rlike(r"^\d{4}$"), "year"),
        *[F.when(~iso(c), c) for c in DATE_FIELDS if c in rows.columns],
    ]
    if "ledger_id" in rows.columns:
        ident = F.col("ledger_id").cast("string")
        checks.append(F.when(~empty(ident) & ~ident.rlike(ID_SHAPE), "ledger_id"))
    if stored_status:
        checks.append(F.when(empty("status") & ~empty(stored_status), "status"))
    return rows.withColumn("errors", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce(nonblank("status"), F.lit(BLANK)).alias("status")).agg(F.count("*").alias("n"))


def due_counts(rows: DataFrame, as_of: datetime.date) -> DataFrame:
    s = rows.select(due_state("deadline", "status", as_of).alias("s"))
    return s.agg(F.count_if(F.col("s") == "overdue").alias("overdue"), F.count_if(F.col("s") == "soon").alias("soon"), F.count_if(F.col("s") != "done").alias("open"), F.count("*").alias("total"))


def top_values(rows: DataFrame, column: str, k: int) -> DataFrame:
    """(column, n, share): the ``k`` most frequent filled values, with their share of all filled ones in percent."""
    counts = rows.filter(~empty(column)).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), column).limit(k)
    return top.crossJoin(F.broadcast(total)).select(column, "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("share"))  # one row


def requester_profiles(rows: DataFrame, newest: list[str], fields: tuple[str, ...] = ("party", "aide")) -> DataFrame:
    """(requester, n, fields): the number of requests and the newest filled value of each field."""
    last = lambda f: F.max_by(F.when(~empty(f), F.col(f)), F.when(~empty(f), F.struct(*newest))).alias(f)
    return rows.groupBy("requester").agg(F.count("*").alias("n"), *[last(f) for f in fields])


def suggest(sources: list[tuple[DataFrame, str, str]], prefix: str, limit: int) -> DataFrame:
    """Values that contain the prefix, by source (table, column, label); the first source of a pair counts."""
    low, parts = prefix.lower(), []
    for n, (df, column, label) in enumerate(sources):
        counted = df.filter(~empty(column)).filter(F.lower(F.col(column)).contains(low)).groupBy(F.trim(column).alias("value")).agg(F.count("*").alias("n"))
        best = counted.orderBy(F.desc("n"), "value").limit(limit)
        parts.append(best.select(F.lit(label).alias("label"), "value", "n", F.lit(n).alias("source")))
    every = reduce(DataFrame.unionByName, parts)
    first = every.withColumn("r", F.row_number().over(Window.partitionBy("label", "value").orderBy("source"))).filter("r = 1")
    return first.select("label", "value", "n", F.lower("value").startswith(low).alias("starts")).orderBy(F.desc("starts"), F.desc("n"), "value", "label").limit(limit)


# --- linkage -------------------------------------------------------------------------------------


def link_by_number(ledger: DataFrame, docs: DataFrame) -> DataFrame:
    """(ledger_id, doc_id) by year and digits of the number; of several documents the last wins."""
    last = docs.withColumn("n", digits("doc_number")).filter("n <> ''").groupBy("year", "n").agg(F.max_by("doc_id", "doc_order").alias("doc_id"))
    return ledger.withColumn("n", digits("seq_no")).join(last, ["year", "n"]).select("ledger_id", "doc_id")


def link_by_requester(ledger: DataFrame, docs: DataFrame) -> DataFrame:
    """(ledger_id, doc_id) by year, requester stem and date; the last document wins."""
    key = lambda df: df.withColumn("stem", requester_stem("requester")).filter("stem <> '' and coalesce(request_date, '') <> ''")
    last = key(docs).groupBy("year", "stem", "request_date").agg(F.max_by("doc_id", "doc_order").alias("doc_id"))
    return key(ledger).join(last, ["year", "stem", "request_date"]).select("ledger_id", "doc_id")


def link(ledger: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds linked_doc_id: the link there was, else by number, else by requester."""
    number = link_by_number(ledger, docs).withColumnRenamed("doc_id", "by_number")
    requester = link_by_requester(ledger, docs).withColumnRenamed("doc_id", "by_requester")
    old = F.col("linked_doc_id") if "linked_doc_id" in ledger.columns else F.lit(None)
    joined = ledger.join(number, "ledger_id", "left").join(requester, "ledger_id", "left")
    return joined.withColumn("linked_doc_id", F.coalesce(F.nullif(old.cast("string"), F.lit("")), F.col("by_number").cast("string"), F.col("by_requester").cast("string"))).drop("by_number", "by_requester")


def link_by_token(ledger: DataFrame, docs: DataFrame) -> DataFrame:
    """(ledger_id, doc_id) where exactly one document of the year shows the number as a whole digit run."""
    runs = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "doc_number", "original_path"), F.lit(r"(\d+)"), 1))
    tokens = docs.select("year", "doc_id", F.explode(runs).alias("token"))
    whole = F.regexp_replace(F.coalesce("seq_no", F.lit("")), r"\D", "")
    variants = ledger.select("ledger_id", "year", F.explode(F.array_distinct(F.array(whole, digits("seq_no")))).alias("token")).filter("token <> ''")
    # one row a token before the join: how many documents show it, and which, is in the least and the greatest
    shown = tokens.groupBy("year", "token").agg(F.min("doc_id").alias("__least"), F.max("doc_id").alias("__most"))
    found = variants.join(shown, ["year", "token"]).groupBy("ledger_id").agg(F.min("__least").alias("doc_id"), F.max("__most").alias("__most"))
    return found.filter("doc_id = __most").select("ledger_id", "doc_id")


def link_by_contained(ledger: DataFrame, docs: DataFrame) -> DataFrame:
    """(ledger_id, doc_id): documents of the same day whose requester holds the stem; the years agree unless one is empty.

    Of several documents the least counts. Each requester is laid out as its pieces of the lengths that the stems of
    its day have, and the least document of each piece is kept, so a row meets one piece: rows, not pairs, are joined.
    """
    asked = ledger.select("ledger_id", F.col("year").alias("__year"), "request_date", requester_stem("requester").alias("stem")).filter("stem <> '' and coalesce(request_date, '') <> ''")
    lengths = asked.groupBy("request_date").agg(F.collect_set(F.length("stem")).alias("__lengths"))  # no more than the longest stem has characters
    there = docs.filter("coalesce(request_date, '') <> '' and requester <> ''").groupBy("request_date", F.col("year").alias("__year"), "requester").agg(F.min("doc_id").alias("doc_id"))
    sized = there.join(lengths, "request_date").withColumn("__n", F.explode("__lengths")).filter(F.length("requester") >= F.col("__n"))
    places = sized.withColumn("__at", F.explode(F.sequence(F.lit(1), F.length("requester") - F.col("__n") + 1)))
    # a document is found under its year, or as one without, and by requests without a year
    of = lambda kind, year: F.struct(F.lit(kind).alias("__kind"), year.alias("__year"))
    year = F.col("__year")
    none, any_year = (of(kind, F.lit(None).cast(docs.schema["year"].dataType)) for kind in ("none", "any"))
    held = F.array(any_year, F.when(empty("__year"), none).otherwise(of("own", year)))
    pieces = places.select("request_date", F.substring("requester", F.col("__at"), F.col("__n")).alias("stem"), F.inline(held), "doc_id")
    least = pieces.groupBy("request_date", "stem", "__kind", "__year").agg(F.min("doc_id").alias("doc_id"))
    no_year = F.lit(None).cast(ledger.schema["year"].dataType)
    wanted = F.when(empty("__year"), F.array(of("any", no_year))).otherwise(F.array(of("none", no_year), of("own", year)))
    asked = asked.select("ledger_id", "request_date", "stem", F.inline(wanted))
    a, b = asked.alias("a"), least.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("request_date", "stem", "__kind")]
    found = a.join(b, [*same, F.col("a.__year").eqNullSafe(F.col("b.__year"))])
    return found.groupBy("ledger_id").agg(F.min("doc_id").alias("doc_id"))


def auto_link(ledger: DataFrame, docs: DataFrame) -> DataFrame:
    """(ledger_id, doc_id) by number token, else by contained requester and day."""
    token, contained = link_by_token(ledger, docs), link_by_contained(ledger, docs)
    return token.unionByName(contained.join(token.select("ledger_id"), "ledger_id", "left_anti"))


def repair_links(ledger: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mend links of requests to documents that are gone. Returns (ledger, docs, summary).

    A dangling link is found anew by :func:`auto_link`, else cleared; links that hold are left
    alone. Then documents lose back-references to requests that are gone. Summary: checked, relinked, cleared.
    """
    bad = dangling(ledger, "linked_doc_id", docs, "doc_id")
    again = auto_link(bad, docs).select("ledger_id", F.col("doc_id").cast("string").alias("__new"))
    marks = bad.select("ledger_id").join(again, "ledger_id", "left").select("ledger_id", "__new", F.lit(True).alias("__bad"))
    mended = ledger.join(marks, "ledger_id", "left").withColumn("linked_doc_id", F.when(F.col("__bad"), F.coalesce("__new", F.lit(""))).otherwise(F.col("linked_doc_id").cast("string")))
    summary = mended.agg(
        F.count_if(~empty(F.col("linked_doc_id")) | F.col("__bad")).alias("checked"), F.count_if(F.col("__bad") & F.col("__new").isNotNull()).alias("relinked"), F.count_if(F.col("__bad") & F.col("__new").isNull()).alias("cleared")
    )
    out = docs
    if "linked_ledger_id" in docs.columns:
        gone = dangling(docs, "linked_ledger_id", ledger, "ledger_id").select("doc_id", F.lit(True).alias("__gone"))
        out = docs.join(gone, "doc_id", "left").withColumn("linked_ledger_id", F.when(F.col("__gone"), F.lit("")).otherwise(F.col("linked_ledger_id").cast("string"))).drop("__gone")
    return mended.drop("__new", "__bad"), out, summary


def change_links(docs: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Back-references after links changed: (docs, rejects).

    ``changes``: ledger_id, old_doc_id, new_doc_id. A new document that isn't there rejects the change. The
    old document is cleared only if it still points at the request; the last change of a document wins.
    """
    known = docs.select(F.col("doc_id").cast("string").alias("__doc"))
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    asked = changes.select("ledger_id", text("old_doc_id").alias("old"), text("new_doc_id").alias("new"))
    rejects = asked.filter("new <> ''").join(known, F.col("new") == F.col("__doc"), "left_anti")
    good = asked.join(rejects.select("ledger_id"), "ledger_id", "left_anti").filter("old <> new")
    clear = good.filter("old <> ''").groupBy("old").agg(F.collect_set(F.col("ledger_id").cast("string")).alias("__by"))  # requests that leave one document
    point = good.filter("new <> ''").groupBy("new").agg(F.max(F.col("ledger_id").cast("string")).alias("__to"))
    d = F.col("doc_id").cast("string")
    joined = docs.join(clear, d == F.col("old"), "left").join(point, d == F.col("new"), "left")
    now = F.coalesce(F.col("linked_ledger_id").cast("string"), F.lit(""))
    left = F.when(F.coalesce(F.array_contains("__by", now), F.lit(False)), F.lit("")).otherwise(now)
    return joined.withColumn("linked_ledger_id", F.coalesce("__to", left)).select(*docs.columns), rejects.select("ledger_id", F.col("new").alias("new_doc_id"))


def dangling(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose non-empty reference has no parent; a reference of another type is compared as text."""
    same = rows.schema[column].dataType == parents.schema[key].dataType
    ref, there = (F.col(column), F.col(key)) if same else (F.col(column).cast("string"), F.col(key).cast("string"))
    return rows.filter(~empty(F.col(column).cast("string"))).join(parents.select(there.alias("__key")), ref == F.col("__key"), "left_anti")


def back_references(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(doc_id, linked_ledger_id): the last ledger row that points at the document, empty if none does."""
    last = ledger.filter("linked_doc_id is not null").groupBy(F.col("linked_doc_id").alias("doc_id")).agg(F.max("ledger_id").alias("linked_ledger_id"))
    return docs.select("doc_id").join(last, "doc_id", "left").select("doc_id", F.coalesce(F.col("linked_ledger_id").cast("string"), F.lit("")).alias("linked_ledger_id"))


# --- changes -------------------------------------------------------------------------------------


def changed(old: Callable[[str], Column], new: Callable[[str], Column], fields: list[str]) -> Column:
    """Names of the fields whose trimmed texts differ."""
    text = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit(""))
    return F.filter(F.array(*[F.when(text(old(f)) != text(new(f)), F.lit(f)) for f in fields]), lambda x: x.isNotNull())


def snapshot_diff(stored: DataFrame, incoming: DataFrame, fields: list[str], key: str = "ledger_id") -> DataFrame:
    """key, action (INSERT, UPDATE, DELETE, UNCHANGED), changed_fields between two snapshots."""
    s, i = stored.select(key, *fields).alias("s"), incoming.select(key, *fields).alias("i")
    diff = changed(lambda f: F.col(f"s.{f}"), lambda f: F.col(f"i.{f}"), fields)
    joined = s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full_outer")
    action = F.when(F.col(f"s.{key}").isNull(), "INSERT").when(F.col(f"i.{key}").isNull(), "DELETE").when(F.size(diff) > 0, "UPDATE").otherwise("UNCHANGED")
    return joined.select(F.coalesce(f"s.{key}", f"i.{key}").alias(key), action.alias("action"), F.when(action == "UPDATE", diff).otherwise(F.array().cast("array<string>")).alias("changed_fields"))


def protected_fields(operations: DataFrame) -> DataFrame:
    """(ledger_id, fields): union of the fields of undelivered operations; null protects the whole row."""
    live = operations.filter("not coalesce(conflict, false)")
    each = live.select("ledger_id", F.col("fields").isNull().alias("whole"), F.explode_outer("fields").alias("field"))
    # a set of field names, combined before the shuffle
    return each.groupBy("ledger_id").agg(F.when(~F.bool_or("whole"), F.sort_array(F.collect_set("field"))).alias("fields"), F.lit(True).alias("protected"))


def merge_snapshot(stored: DataFrame, incoming: DataFrame, fields: list[str], protected: DataFrame, key: str = "ledger_id") -> DataFrame:
    """Incoming values win, but not over a tombstone or a protected field; stored-only rows stay."""
    s, i, p = stored.alias("s"), incoming.alias("i"), protected.alias("p")
    joined = i.join(s, F.col(f"s.{key}") == F.col(f"i.{key}"), "left").join(p, F.col(f"i.{key}") == F.col(f"p.{key}"), "left")
    dead = F.coalesce(F.trim(F.col("s.status")), F.lit("")) == DELETED
    whole = F.col("p.protected").isNotNull() & F.col("p.fields").isNull()
    known = F.col(f"s.{key}").isNotNull()
    keep = lambda f: known & (dead | whole | F.coalesce(F.array_contains("p.fields", f), F.lit(False)))
    merged = joined.select(F.col(f"i.{key}").alias(key), *[F.when(keep(f), F.col(f"s.{f}")).otherwise(F.col(f"i.{f}")).alias(f) for f in fields])
    return merged.unionByName(stored.select(key, *fields).join(incoming.select(key), key, "left_anti"))


def normal_items(operations: DataFrame, stored: DataFrame, fields: list[str], as_of: datetime.date, key: str = "ledger_id") -> DataFrame:
    """Adds ``values`` (trimmed, masked) and ``dates`` (coerced; null where there is no such day) to operations."""
    text = lambda f: F.trim(F.element_at("item", F.lit(f)))
    pair = lambda f, v: F.when(F.map_contains_key(F.col("item"), F.lit(f)), F.struct(F.lit(f).alias("key"), v.alias("value")))
    keep = lambda pairs: F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull()))
    empty_map = F.create_map().cast("map<string,string>")
    values = keep([pair(f, F.coalesce(mask_pii(text(f)) if f in MASKED_FIELDS else text(f), F.lit(""))) for f in fields])
    there = [f for f in DATE_FIELDS if f in fields]
    rows = operations
    if there and "year" in stored.columns:
        rows = rows.join(stored.select(F.col(key), F.col("year").alias("__year")), key, "left")
    else:
        rows = rows.withColumn("__year", F.lit(""))
    year = F.coalesce(F.nullif(text("year"), F.lit("")), F.col("__year"), F.lit(""))
    dates = keep([pair(f, strict_date(text(f), year, as_of)) for f in there]) if there else empty_map
    blank = F.col("item").isNull()
    return rows.select(*operations.columns, F.when(blank, empty_map).otherwise(values).alias("values"), F.when(blank, empty_map).otherwise(dates).alias("dates"))


#: Fields of history rows and rejects.
HISTORY, REJECT = ("action", "seq", "snapshot", "changed_fields"), ("operation_id", "seq", "action", "reason")


#: Rows of a batch that are Python objects at a time.
AT_ONCE = 1000


def _step(state: dict | None, deleted: dict | None, o: dict, fields: list[str], defaults: dict) -> tuple:
    """Apply one operation to a row: (state, deleted, history row or null, reject or null)."""
    values, dates = dict(o["values"] or ()), dict(o["dates"] or ())
    action, reason, after, named = o["action"], None, None, ""
    alive = state is not None and (state.get("status") or "").strip() != DELETED
    if action == "insert":
        bad = next((f for f in ("title", "requester") if f in fields and not values.get(f)), None) or next((f for f in dates if dates[f] is None), None)
        if state is not None:
            reason = "exists"
        elif bad:
            reason = "invalid"
        else:
            filled = {k: v for k, v in defaults.items() if k in fields and (k not in values or (k != "request_type" and not values[k]))}
            after = {f: "" for f in fields} | values | dates | filled
    elif state is None:
        reason = "missing"
    elif action == "restore":
        if alive:
            reason = "not deleted"
        elif not deleted or (deleted.get("status") or "").strip() in ("", DELETED):
            reason = "invalid"
        else:
            after = state | {f: (deleted.get(f) or "").strip() for f in ("status", "note") if f in fields}
            named = ",".join(sorted([f for f in ("note", "status") if f in fields] + ["updated_at"]))
    elif not alive:
        reason = "missing" if action == "delete" else "deleted"
    elif action == "delete":
        after = state | {"status": DELETED}
    else:
        changes = {}
        for f, v in values.items():
            now = (state.get(f) or "").strip()
            if v == now:
                continue
            v = dates.get(f) if f in dates else v
            if v is None or (f in ("title", "requester", "status") and not v) or (f == "year" and not re.fullmatch(r"\d{4}", v)):
                reason = "invalid"
            elif v != now:
                changes[f] = v
        if o["expected_version"] is not None and o["expected_version"].strip() != (state.get("updated_at") or "").strip():
            reason = "conflict"
        if reason is None and changes:
            after, named = state | changes, ",".join(sorted([*changes, "updated_at"]))
    if reason:
        return state, deleted, None, (o["operation_id"], o["seq"], action, reason)
    if after is None:
        return state, deleted, None, None
    after = after | {"updated_at": o["version"]}
    shown = state if action in ("update", "delete") else after
    row = (action.upper(), o["seq"], json.dumps({k: v for k, v in shown.items() if v is not None}, ensure_ascii=False, sort_keys=True), named)
    return after, state if action == "delete" else deleted, row, None


def _folded(rows: Iterator[dict], key: str, fields: list[str], defaults: dict) -> Iterator[dict]:
    """Results of rows that are sorted by key and turn: the stored states of a key, its latest deletion, its operations.

    Between two rows only the states of one key are held. A key without operations gives nothing.
    """
    begun, now, applied, states, last = False, None, False, [], None

    def closed() -> Iterator[dict]:
        yield from ({key: now, "state": [*s.items()]} for s, _ in states if applied and s is not None)

    for o in rows:
        if not begun or o[key] != now:
            yield from closed()
            begun, now, applied, states, last = True, o[key], False, [], None
        if o["turn"] == 0:
            states.append((dict(o["values"]), None))
        elif o["turn"] == 1:
            last = dict(o["values"])
        else:
            if not applied:
                applied, states = True, [(s, last) for s, _ in states] or [(None, last)]
            for i, (state, deleted) in enumerate(states):
                state, deleted, row, refused = _step(state, deleted, o, fields, defaults)
                states[i] = state, deleted
                if row:
                    yield {key: now, "history": dict(zip(HISTORY, row))}
                if refused:
                    yield {key: now, "reject": dict(zip(REJECT, refused))}
    yield from closed()


def apply_operations(
    stored: DataFrame,
    operations: DataFrame,
    fields: list[str],
    key: str = "ledger_id",
    deletions: DataFrame | None = None,
    *,
    as_of: datetime.date,
    defaults: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply a batch of inserts, updates, deletes and restores. Returns (table, history, rejects).

    ``operations``: operation_id, seq, key, action, item map<string,string>, expected_version. One
    operation_id counts once. Per key the operations apply one after the other in order of seq, each to
    the state that the one before left. Values are compared as they are stored (trimmed, masked, dates
    coerced): an update that changes nothing writes nothing. An update may carry the version it
    expects; each write gives a new one, its seq. Years of two digits are read as of ``as_of``. Deletion is a tombstone; a restore takes status and note
    from the latest deletion, of this batch or of ``deletions`` (key, snapshot). Inserts get ``defaults``.

    History: key, action, seq, snapshot (JSON; the state before an update or deletion, after an insert
    or restore), changed_fields. Rejects have a reason: exists, missing, deleted, not deleted, conflict, invalid.
    The operations of one key are read in one task, one by one; those of different keys wherever Spark deals them.
    """
    once = operations.withColumn("__n", F.row_number().over(Window.partitionBy("operation_id").orderBy("seq"))).filter("__n = 1").drop("__n")
    wanted = list(dict.fromkeys([*fields, "updated_at"]))
    text = {f: F.col(f).cast("string") for f in wanted if f in stored.columns}
    kind = stored.schema[key].dataType.simpleString()
    normal = normal_items(once, stored, fields, as_of, key).withColumn("version", F.col("seq").cast("string"))
    given = {c: normal.schema[c].dataType for c in ("seq", "operation_id", "action", "expected_version", "version", "values", "dates")}

    def turn(df: DataFrame, number: int, columns: dict[str, Column]) -> DataFrame:
        each = [columns[c].alias(c) if c in columns else F.lit(None).cast(t).alias(c) for c, t in given.items()]
        return df.select(F.col(key).cast(kind).alias(key), F.lit(number).alias("turn"), *each)

    asked = operations.select(F.col(key).cast(kind).alias(key)).distinct()
    state = F.map_from_arrays(F.array(*[F.lit(f) for f in text]), F.array(*text.values()))
    rows = turn(stored.join(asked, key, "left_semi"), 0, {"values": state}).unionByName(turn(normal, 2, {c: F.col(c) for c in given}))
    if deletions is not None:
        order = "history_id" if "history_id" in deletions.columns else "snapshot"
        newest = deletions.join(asked, key, "left_semi").groupBy(key).agg(F.max_by("snapshot", order).alias("__deleted"))
        rows = rows.unionByName(turn(newest, 1, {"values": parse_snapshot("__deleted")}))
    # an operation a row, so that a batch is small however many of them a key has; dealt by a hash, because Spark takes
    # a union of parts that are dealt by the key for dealt already, and may yet deal the parts otherwise as it runs
    dealt = rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, "turn", "seq", "operation_id", "action", "expected_version", "version", F.map_entries("values"), F.map_entries("dates"))
    schema = f"{key} {kind}, state map<string,string>, history struct<action:string,seq:long,snapshot:string,changed_fields:string>, reject struct<operation_id:string,seq:long,action:string,reason:string>"
    filled = DEFAULTS if defaults is None else defaults

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape: list[pa.Schema] = []

        def each() -> Iterator[dict]:
            for batch in batches:
                if not shape:
                    row = lambda names: pa.struct([(n, pa.int64() if n == "seq" else pa.string()) for n in names])
                    shape.append(pa.schema([(key, batch.schema.field(key).type), ("state", pa.map_(pa.string(), pa.string())), ("history", row(HISTORY)), ("reject", row(REJECT))]))
                for start in range(0, batch.num_rows, AT_ONCE):
                    yield from batch.slice(start, AT_ONCE).to_pylist()

        results = _folded(each(), key, fields, filled)
        while some := [*islice(results, AT_ONCE)]:
            yield pa.RecordBatch.from_pylist(some, shape[0])

    folded = cut(dealt.mapInArrow(fold, schema))
    new = folded.filter("state is not null").select(key, *[F.element_at("state", F.lit(f)).alias(f) for f in wanted])
    kept = stored.join(new.select(key), key, "left_anti").select(key, *[(F.col(f) if f in stored.columns else F.lit(None)).cast("string").alias(f) for f in wanted])
    others = [c for c in stored.columns if c not in (key, *wanted)]
    table = kept.unionByName(new)
    if others:
        table = table.join(stored.select(key, *others), key, "left")
    history = folded.filter("history is not null").select(key, "history.*")
    rejects = folded.filter("reject is not null").select(key, "reject.*")
    return table, history, rejects.select(key, "operation_id", "seq", "action", "reason")


def mark_submitted(rows: DataFrame, as_of: datetime.date, key: str = "ledger_id") -> DataFrame:
    """Update operations that set the status to handed in, and the day of it where that is empty: for :func:`apply_operations`."""
    status = F.create_map(F.lit("status"), F.lit("제출"))
    day = F.create_map(F.lit("status"), F.lit("제출"), F.lit("submit_date"), F.lit(as_of.isoformat()))
    item = F.when(empty("submit_date"), day).otherwise(status)
    return rows.select(key, F.lit("update").alias("action"), item.alias("item"), F.col("updated_at").alias("expected_version"))


def with_versions(rows: DataFrame, at: Column | None = None, order: str = "seq", name: str = "updated_at") -> DataFrame:
    """Adds a version to each row of a batch: its time and its place, so that no two writes share one."""
    stamp = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return rows.withColumn(name, F.concat(stamp, F.lit("-"), F.lpad(F.col(order).cast("string"), 12, "0")))


def new_requests(stored: DataFrame, docs: DataFrame, items: DataFrame, as_of: datetime.date, department: str = "자료요구담당부서", order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Rows for requests that come in without a key: (accepted, rejected).

    ``items``: seq and text columns of the ledger. Values are trimmed and masked, dates coerced, blanks filled
    with the defaults; then the row is validated, numbered after the largest number of its year, and
    linked to a document where it has no link.
    """
    given = [c for c in ("seq_no", "party", "requester", "aide", "title", "details", "department", "status", "note", "request_type", "linked_doc_id") if c in items.columns]
    year = F.coalesce(nonblank("year"), F.lit(str(as_of.year))) if "year" in items.columns else F.lit(str(as_of.year))
    clean = {c: (mask_pii(F.trim(c)) if c in MASKED_FIELDS else F.coalesce(F.trim(c), F.lit(""))) for c in given}
    for c, value in DEFAULTS.items():
        clean[c] = F.coalesce(nonblank(c), F.lit(value)) if c in items.columns and c != "request_type" else F.coalesce(F.trim(c), F.lit(value)) if c in items.columns else F.lit(value)
    clean["department"] = F.coalesce(nonblank("department"), F.lit(department)) if "department" in items.columns else F.lit(department)
    dates = {c: strict_date(c, year, as_of) for c in DATE_FIELDS if c in items.columns}
    bad = F.filter(F.array(*[F.when(v.isNull(), F.lit(c)) for c, v in dates.items()], F.lit(None).cast("string")), lambda x: x.isNotNull())
    rows = items.select(order, year.alias("year"), *[v.alias(c) for c, v in clean.items()], *[F.coalesce(v, F.lit("")).alias(c) for c, v in dates.items()], bad.alias("__bad"))
    judged = validate(rows).withColumn("errors", F.array_union("errors", "__bad")).drop("__bad")
    rejected = judged.filter(F.size("errors") > 0)
    numbered = next_numbers(stored.select("ledger_id"), judged.filter(F.size("errors") == 0).drop("errors"), [order], "REQ", "ledger_id")
    stamped = with_versions(numbered, F.lit(as_of).cast("timestamp"), order)
    if "linked_doc_id" not in stamped.columns:
        stamped = stamped.withColumn("linked_doc_id", F.lit(""))
    for c in ("seq_no", "request_date"):
        if c not in stamped.columns:
            stamped = stamped.withColumn(c, F.lit(""))
    stamped = cut(stamped)
    found = auto_link(stamped.filter(empty("linked_doc_id")), docs).select("ledger_id", F.col("doc_id").cast("string").alias("__doc"))
    linked = stamped.join(found, "ledger_id", "left").withColumn("linked_doc_id", F.coalesce(nonblank("linked_doc_id"), F.col("__doc"), F.lit(""))).drop("__doc")
    return linked.withColumn("created_at", F.col("updated_at")), rejected


# --- history -------------------------------------------------------------------------------------


def timeline(history: DataFrame, current: DataFrame | None = None, limit: int = 15, before: tuple[str, ...] = BEFORE_ACTIONS, key: str = "ledger_id") -> DataFrame:
    """Adds before and after texts to change rows, newest first, ``limit`` per item.

    An update's own snapshot is its before; its after is the next such snapshot of the item, else the
    ``current`` (key, state). Inserts and restores carry the state after them.
    """
    pre = F.col("action").isin(*before)
    ahead = Window.partitionBy(key).orderBy("history_id").rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(pre, F.col("snapshot")), ignorenulls=True).over(ahead)
    rows = history.withColumn("next_state", following)
    rows = rows.join(current.select(key, F.col("state").alias("now")), key, "left") if current is not None else rows.withColumn("now", F.lit(None).cast("string"))
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("history_id")))
    return (
        rows.withColumn("n", newest)
        .filter(F.col("n") <= limit)
        .select(key, "history_id", "action", F.when(pre, F.col("snapshot")).alias("before"), F.when(pre, F.coalesce("next_state", "now")).otherwise(F.col("snapshot")).alias("after"))
    )


def field_changes(before: Column, after: Column, fields: list[str], limit: int = 300) -> Column:
    """array<struct(field, before, after, clipped)> of the fields in ``before`` that differ between two maps."""
    text = lambda m, f: F.coalesce(F.trim(F.element_at(m, F.lit(f))), F.lit(""))
    clip = lambda c: F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…"))).otherwise(c)
    each = [
        F.when(
            F.map_contains_key(before, F.lit(f)) & (text(before, f) != text(after, f)),
            F.struct(F.lit(f).alias("field"), clip(text(before, f)).alias("before"), clip(text(after, f)).alias("after"), (F.greatest(F.length(text(before, f)), F.length(text(after, f))) > limit).alias("clipped")),
        )
        for f in fields
    ]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def parse_snapshot(c: Column | str) -> Column:
    """JSON object to a text map; anything else to an empty map."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.when(F.trim(c).startswith("{"), F.from_json(c, "map<string,string>")), F.create_map().cast("map<string,string>"))


def mask_snapshot(c: Column | str, fields: tuple[str, ...] = ("contact_person", "aide")) -> Column:
    """JSON object with the given fields masked; a text that is no object is masked as a whole."""
    text = F.col(c) if isinstance(c, str) else c
    parsed = F.when(F.trim(text).startswith("{"), F.from_json(text, "map<string,string>"))
    masked = F.to_json(F.transform_values(parsed, lambda k, v: F.when(k.isin(*fields), mask_pii(v)).otherwise(v)))
    return F.when(parsed.isNotNull(), masked).otherwise(mask_pii(text))


def retention(history: DataFrame, cutoff: str, groups: Column, time: str = "changed_at", key: str = "ledger_id") -> DataFrame:
    """Adds ``archive``: older than ``cutoff`` and not the latest of its item in any of the kept groups.

    ``groups`` names the group an action is kept for, null for none; unreadable times stay.
    """
    latest = F.max("history_id").over(Window.partitionBy(key, "__group"))
    rows = history.withColumn("__group", groups)
    keep = F.col("__group").isNotNull() & (F.col("history_id") == latest)
    return rows.withColumn("archive", ~keep & F.coalesce(F.col(time) < F.lit(cutoff), F.lit(False))).drop("__group")


# --- identifiers ---------------------------------------------------------------------------------


def next_numbers(existing: DataFrame, fresh: DataFrame, order: list[str], prefix: str, key: str = "id") -> DataFrame:
    """Number the ``fresh`` rows of each year after the largest number in use: PREFIX-year-nnn.

    Years are dealt by range of ``order``, so a large year is no single task.
    """
    used = existing.select(F.regexp_extract(key, rf"^{prefix}-(\d{{4}})-(\d+)$", 1).alias("year"), F.expr(f"try_cast(regexp_extract({key}, '^{prefix}-(\\\\d{{4}})-(\\\\d+)$', 2) as int)").alias("n"))
    top = used.filter("year <> ''").groupBy("year").agg(F.max("n").alias("top"))
    out = ranked(fresh, ["year"], order, "__k").join(top, "year", "left").withColumn("__n", F.coalesce("top", F.lit(0)) + F.col("__k"))
    return out.withColumn(key, F.concat_ws("-", F.lit(prefix), "year", F.when(F.col("__n") < 1000, F.lpad(F.col("__n").cast("string"), 3, "0")).otherwise(F.col("__n").cast("string")))).drop("__k", "__n", "top")


def greedy_match(claims: DataFrame, taker: str, taken: str, order: list[str]) -> DataFrame:
    """(taker, taken): what is left when claims are served one after the other in ``order``, each to a free taker and a free prize.

    ``order`` tells all claims apart. In rounds, a claim wins when it is the first of its taker's and the first
    of its prize's open claims, for then no other can take either away; claims of winners and of what
    they won go. Each round is a minimum by taker and by prize (combined before the shuffle) and joins, and is
    written, so lineage stays short. Claims that hang on one another in a chain need a round a link.
    """
    live = cut(claims.select(taker, taken, F.struct(*order).alias("__turn")).filter(F.col(taker).isNotNull() & F.col(taken).isNotNull()))
    won = None
    while live.limit(1).count():
        first = live.groupBy(taker).agg(F.min(F.struct("__turn", taken)).alias("__c")).select(taker, f"__c.{taken}", "__c.__turn")
        wanted = live.groupBy(taken).agg(F.min("__turn").alias("__first"))
        now = cut(first.join(wanted, taken).filter("__turn = __first").select(taker, taken))
        won = now if won is None else won.unionByName(now)
        live = cut(live.join(now.select(taker), taker, "left_anti").join(now.select(taken), taken, "left_anti"))
    return won if won is not None else claims.select(taker, taken).limit(0)


def reuse_ids(fresh: DataFrame, known: DataFrame, kinds: list[str]) -> DataFrame:
    """Give fresh rows the ids that their keys had before; adds old_id, null where there is none.

    ``fresh``: path and a column per kind of key. ``known``: kind, value, old_id. Rows take turns in the order of
    path, and each takes the first of its kinds whose id is still free. A row's keys stand for that row
    from its turn on, whatever id it got, so a key that several rows hold serves the first of them only.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("__rank"), F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for i, k in enumerate(kinds)])
    held = fresh.select("path", F.inline(keys)).filter("value is not null and value <> ''")
    first = held.groupBy("kind", "value").agg(F.min(F.struct("path", "__rank")).alias("c")).select("kind", "value", "c.*")
    one = known.groupBy("kind", F.col("value").cast("string").alias("value")).agg(F.max("old_id").alias("old_id"))
    claims = first.join(one, ["kind", "value"]).groupBy("path", "old_id").agg(F.min("__rank").alias("__rank"))
    return fresh.join(greedy_match(claims, "path", "old_id", ["path", "__rank"]), "path", "left")


# --- gates ---------------------------------------------------------------------------------------


class GateError(RuntimeError):
    """A table that must not be published."""


def shrink_gate(old: DataFrame, new: DataFrame, least: float = 0.9) -> None:
    """Raise when the new table is empty or has under ``least`` of the old one's rows."""
    n_old, n_new = old.count(), new.count()
    if n_old and (n_new == 0 or n_new < least * n_old):
        raise GateError(f"{n_new} rows would replace {n_old}")


def may_delete(incoming: int, stored: int, least: float = 0.5) -> bool:
    """Whether rows that are absent from a snapshot may be deleted."""
    return not stored or incoming >= least * stored


def may_prune(orphans: int, sources: int, most: int = 5, share: float = 0.3) -> bool:
    return sources > 0 and not (orphans >= most and orphans > share * sources)


def failed_stage(results: DataFrame, error: str = "error", most: float = 0.5) -> DataFrame:
    """files, failed, rate, and state: ok, partial or failed (all, or over ``most`` of them)."""
    n = results.agg(F.count("*").alias("files"), F.count_if(~empty(error)).alias("failed"))
    rate = F.when(F.col("files") > 0, F.col("failed") / F.col("files")).otherwise(F.lit(0.0))
    return n.select("files", "failed", rate.alias("rate"), F.when(F.col("failed") == 0, "ok").when(rate > most, "failed").otherwise("partial").alias("state"))
