"""Sheet extracts against the ledger table: identifiers, snapshot sync, write-back, purge and intake reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelake.functions.text import empty

from .ledger import DELETED, changed
from .shared import cut

# Shape of a ledger identifier; identity fields in order of precedence; actions that prove a sheet row.
ID_SHAPE = r"^REQ-(\d{4})-(\d+)$"
IDENTITY = ("title", "requester", "aide", "seq_no")
SHEET_ACTIONS = ("EXCEL_APPLIED", "EXCEL_SYNC_INSERT", "EXCEL_SYNC_UPDATE")


def _text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def _dead(status: Column | str) -> Column:
    return _text(status) == DELETED


def numbered(rows: DataFrame, group: list[str], position: str, name: str, span: int = 65_536) -> DataFrame:
    """Adds 1, 2, ... in each group by a long ``position``, without a task that holds a whole group.

    Positions fall into spans; only the number of rows of each span is summed over the group. Positions
    are unique in a group.
    """
    spans = rows.withColumn("__span", F.floor(F.col(position) / span))
    sizes = spans.groupBy(*group, "__span").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*group).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*group, "__span", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*group, "__span").orderBy(position))
    out = spans.withColumn("__inside", inside).join(starts, [*group, "__span"])
    return out.withColumn(name, F.col("__start") + F.col("__inside")).drop("__span", "__inside", "__start")


def make_id(year: str, number: str, prefix: str = "REQ") -> Column:
    n = F.col(number).cast("string")
    return F.concat_ws("-", F.lit(prefix), F.col(year), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))


def id_number(c: str) -> Column:
    """Number of an identifier, null where it has another shape."""
    return F.when(F.col(c).rlike(ID_SHAPE), F.regexp_extract(c, ID_SHAPE, 2).cast("long"))


# --- identifiers of sheet rows --------------------------------------------------------------------


def position_ids(sheet: DataFrame) -> DataFrame:
    """Ledger ids of a sheet extract (year, row_no, ledger_id): (year, row_no, ledger_id).

    A year with a valid id keeps its valid ids and leaves out rows without one; a year with none numbers its
    rows. Of rows with one id the first of the newest year stays.
    """
    valid = F.coalesce(_text("ledger_id").rlike(ID_SHAPE), F.lit(False))
    rows = sheet.select("year", "row_no", _text("ledger_id").alias("ledger_id"), valid.alias("valid"))
    stamped = rows.filter("valid").select("year").distinct()
    given = rows.filter("valid").select("year", "row_no", "ledger_id")
    free = numbered(rows.join(stamped, "year", "left_anti"), ["year"], "row_no", "n")
    every = given.unionByName(free.select("year", "row_no", make_id("year", "n").alias("ledger_id")))
    first = every.groupBy("ledger_id").agg(F.min(F.struct((-F.col("year").cast("int")).alias("newest"), "row_no", "year")).alias("f"))
    return first.select("f.year", "f.row_no", "ledger_id")


def plan_ids(sheet: DataFrame, stored: DataFrame) -> DataFrame:
    """(year, row_no, ledger_id, origin) for every sheet row.

    ``sheet``: year, row_no, ledger_id, title, requester. ``stored``: ledger_id, year, title, requester, status.
    Origins in order of precedence: ``explicit`` (valid, first use), ``position`` (the id at the row's place among
    unstamped rows is stored; where the sheet has explicit ids it must also be alive and of the same title and
    requester), ``content`` (a living stored row of the same year, title and requester), ``legacy`` (place in a sheet
    without explicit ids), ``new`` (next number). Each step is settled for all rows before the next one, so
    an id by position goes before one by content, whichever row stands first. Blank title and requester are a content.
    """
    base = sheet.select("year", F.col("row_no").cast("long").alias("row_no"), *[_text(c).alias(c) for c in ("ledger_id", "title", "requester")])
    table = stored.select(*[_text(c).alias(c) for c in ("ledger_id", "year", "title", "requester", "status")]).filter("ledger_id <> ''")

    valid = base.filter(F.col("ledger_id").rlike(ID_SHAPE)).groupBy("ledger_id").agg(F.min(F.struct((-F.col("year").cast("int")).alias("newest"), "row_no", "year")).alias("f"))
    explicit = cut(valid.select("f.year", "f.row_no", "ledger_id", F.lit("explicit").alias("origin")))
    stamped = explicit.select("year").distinct().withColumn("stamped", F.lit(True))

    rest = base.drop("ledger_id").join(explicit.select("year", "row_no"), ["year", "row_no"], "left_anti")
    placed = cut(numbered(rest, ["year"], "row_no", "n").withColumn("ledger_id", make_id("year", "n")).drop("n").join(stamped, "year", "left"))

    s = table.select("ledger_id", F.col("title").alias("s_title"), F.col("requester").alias("s_requester"), "status")
    same = (F.col("title") == F.col("s_title")) & (F.col("requester") == F.col("s_requester")) & (F.col("status") != DELETED)
    held = placed.join(explicit.select("ledger_id"), "ledger_id", "left_anti").join(s, "ledger_id").filter(F.col("stamped").isNull() | same)
    position = cut(held.select("year", "row_no", "ledger_id", F.lit("position").alias("origin")))

    done = explicit.unionByName(position)
    key = ["year", "title", "requester"]
    asking = cut(numbered(placed.join(position, ["year", "row_no"], "left_anti"), key, "row_no", "k"))
    offers = table.filter(F.col("status") != DELETED).withColumn("number", id_number("ledger_id")).filter("number is not null")
    offers = numbered(offers.join(done.select("ledger_id"), "ledger_id", "left_anti"), key, "number", "k").select(*key, "k", "ledger_id")
    content = cut(asking.drop("ledger_id").join(offers, [*key, "k"]).select("year", "row_no", "ledger_id", F.lit("content").alias("origin")))

    done = done.unionByName(content)
    open_rows = asking.join(content, ["year", "row_no"], "left_anti")
    legacy = cut(open_rows.filter("stamped is null").join(done.select("ledger_id"), "ledger_id", "left_anti").select("year", "row_no", "ledger_id", F.lit("legacy").alias("origin")))

    done = done.unionByName(legacy)
    last = open_rows.join(legacy, ["year", "row_no"], "left_anti").select("year", "row_no")
    used = done.select("ledger_id").unionByName(table.select("ledger_id")).select(F.regexp_extract("ledger_id", ID_SHAPE, 1).alias("year"), id_number("ledger_id").alias("number"))
    top = used.filter("number is not null").groupBy("year").agg(F.max("number").alias("top"))
    fresh = numbered(last, ["year"], "row_no", "k").join(top, "year", "left").withColumn("n", F.coalesce("top", F.lit(0)) + F.col("k"))
    return done.unionByName(fresh.select("year", "row_no", make_id("year", "n").alias("ledger_id"), F.lit("new").alias("origin")))


def next_sequence(sheet: DataFrame, fresh: DataFrame) -> DataFrame:
    """Adds seq_no to ``fresh`` rows (year, row_no) that have none: after the largest plain number of the year."""
    plain = F.when(F.trim("seq_no").rlike(r"^\d+$"), F.expr("try_cast(trim(seq_no) as long)"))
    top = sheet.groupBy("year").agg(F.coalesce(F.max(plain), F.lit(0)).alias("__top"))
    blank = empty(F.col("seq_no").cast("string"))
    given = numbered(fresh.filter(blank), ["year"], "row_no", "__k").join(top, "year", "left")
    filled = given.withColumn("seq_no", (F.coalesce("__top", F.lit(0)) + F.col("__k")).cast("string")).drop("__k", "__top")
    return filled.unionByName(fresh.filter(~blank))


# --- requests and row identity --------------------------------------------------------------------


def replay(requests: DataFrame, stored: DataFrame, content: list[str]) -> DataFrame:
    """Outcome of each request: (request_id, outcome, ledger_id).

    ``requests``: request_id, seq, request_key and the content columns; ``stored``: request_key, content_hash,
    ledger_id, status. A blank key always inserts. A stored key replays its row if the contents agree, and
    conflicts if they don't or the row is deleted. Of a batch's requests with one key the first inserts.
    """
    keyed = requests.withColumn("__key", _text("request_key")).withColumn("__hash", content_hash(content))
    first = keyed.filter("__key <> ''").groupBy("__key").agg(F.min(F.struct("seq", "request_id", "__hash")).alias("f"))
    known = stored.select(_text("request_key").alias("__key"), "content_hash", "ledger_id", _dead("status").alias("dead")).filter("__key <> ''")
    joined = keyed.join(first.join(known, "__key", "left"), "__key", "left")
    agrees = F.coalesce(F.col("content_hash"), F.col("f.__hash")) == F.col("__hash")
    outcome = (
        F.when((F.col("__key") == "") | (F.col("ledger_id").isNull() & (F.col("request_id") == F.col("f.request_id"))), "insert")
        .when(agrees & ~F.coalesce("dead", F.lit(False)), "replay")
        .otherwise("conflict")
    )
    return joined.select("request_id", outcome.alias("outcome"), F.when(outcome == "replay", F.col("ledger_id")).alias("ledger_id"))


def content_hash(fields: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[_text(f).alias(f) for f in fields])), 256)


def same_identity(a: str, b: str) -> Column:
    """Whether two struct columns name one item: by the first field with a value on both sides; null if none has."""

    def norm(side: str, f: str) -> Column:
        t = F.regexp_replace(F.coalesce(F.col(f"{side}.{f}").cast("string"), F.lit("")), r"\s+", "")
        return F.when(t.rlike(r"^\d+$"), F.coalesce(F.nullif(F.ltrim(t, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(t) if f == "seq_no" else t

    return F.coalesce(*[F.when((norm(a, f) != "") & (norm(b, f) != ""), norm(a, f) == norm(b, f)) for f in IDENTITY])


def accepts(action: str = "action", row: str = "row", expected: str = "expected", item: str = "item") -> Column:
    """Whether an operation may touch the row it found: its new values, or for changes its old ones, name the row."""
    old, new = same_identity(row, expected), same_identity(row, item)
    known = F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False)) | (old.isNull() & new.isNull())
    return F.when(F.col(action) == "insert", F.coalesce(new, F.lit(True))).otherwise(known)


# --- snapshot sync --------------------------------------------------------------------------------


def web_only(history: DataFrame, key: str = "ledger_id") -> DataFrame:
    """Items that were inserted and never seen in a sheet."""
    seen = history.groupBy(key).agg(F.count_if(F.col("action") == "INSERT").alias("i"), F.count_if(F.col("action").isin(*SHEET_ACTIONS)).alias("s"))
    return seen.filter("i > 0 and s = 0").select(key)


def plan_sync(stored: DataFrame, incoming: DataFrame, fields: list[str], protected: DataFrame, unseen: DataFrame, known: DataFrame, least: float = 0.5, key: str = "ledger_id") -> DataFrame:
    """(key, action, changed_fields) of a sheet snapshot against the table.

    ``protected``: key, fields (null protects the row); ``unseen``: keys never written to a sheet; ``known``: keys
    from before the read. Actions: INSERT, UPDATE, DELETE, UNCHANGED, or PROTECTED, TOMBSTONE and KEEP for what the
    rules leave alone. Absent rows go only when the snapshot has at least ``least`` of the living rows that a sheet
    has seen. Rows without a key don't take part; each key counts once on either side.
    """
    s = stored.filter(~empty(key)).select(key, *fields).alias("s")
    i = incoming.filter(~empty(key)).select(key, *fields).alias("i")
    flags = [protected.select(key, F.col("fields").alias("guarded"), F.lit(True).alias("guard"))]
    flags += [unseen.select(key).distinct().withColumn("unseen", F.lit(True)), known.select(key).distinct().withColumn("known", F.lit(True))]
    both = s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full_outer").withColumn("__key", F.coalesce(F.col(f"s.{key}"), F.col(f"i.{key}")))
    for n, f in enumerate(flags):
        f = f.withColumnRenamed(key, f"__k{n}")
        both = both.join(f, F.col("__key") == F.col(f"__k{n}"), "left")
    living = stored.filter(~_dead("status")).join(unseen, key, "left_anti").agg(F.count("*").alias("n_living"))
    sheet = incoming.filter(~empty(key)).agg(F.count_distinct(key).alias("n_sheet"))
    both = both.crossJoin(F.broadcast(living.crossJoin(sheet)))  # one row

    has_s, has_i = F.col(f"s.{key}").isNotNull(), F.col(f"i.{key}").isNotNull()
    guard, guarded = F.col("guard").isNotNull(), F.coalesce(F.col("guarded"), F.array().cast("array<string>"))
    whole = guard & F.col("guarded").isNull()
    diff = F.array_except(changed(lambda f: F.col(f"s.{f}"), lambda f: F.col(f"i.{f}"), fields), guarded)
    enough = (F.col("n_sheet") > 0) & (F.col("n_sheet") >= least * F.col("n_living"))
    may_go = F.col("known").isNotNull() & F.col("unseen").isNull() & ~guard & enough
    dead_s, dead_i = _dead("s.status"), _dead("i.status")
    action = (
        F.when(~has_i, F.when(dead_s, "TOMBSTONE").when(may_go, "DELETE").otherwise("KEEP"))
        .when(whole | (dead_i & (F.size(guarded) > 0)), "PROTECTED")
        .when(dead_i, F.when(has_s & ~dead_s, "DELETE").otherwise("TOMBSTONE"))
        .when(dead_s, "TOMBSTONE")
        .when(~has_s, "INSERT")
        .when(F.size(diff) > 0, "UPDATE")
        .otherwise("UNCHANGED")
    )
    out = both.select(F.col("__key").alias(key), action.alias("action"), diff.alias("diff"))
    return out.select(key, "action", F.when(F.col("action") == "UPDATE", F.col("diff")).otherwise(F.array().cast("array<string>")).alias("changed_fields"))


def apply_sync(stored: DataFrame, incoming: DataFrame, plan: DataFrame, fields: list[str], key: str = "ledger_id") -> DataFrame:
    """The table after a plan: changed fields from the snapshot, tombstones for deletions, new rows."""
    s, i, p = stored.select(key, *fields).alias("s"), incoming.select(key, *fields).alias("i"), plan.alias("p")
    rows = p.join(s, F.col(f"p.{key}") == F.col(f"s.{key}"), "left").join(i, F.col(f"p.{key}") == F.col(f"i.{key}"), "left")
    rows = rows.filter(F.col(f"s.{key}").isNotNull() | (F.col("p.action") == "INSERT"))
    take = lambda f: (F.col("p.action") == "INSERT") | F.array_contains("p.changed_fields", f)
    value = lambda f: F.when(take(f), F.col(f"i.{f}")).otherwise(F.col(f"s.{f}"))
    return rows.select(F.col(f"p.{key}").alias(key), *[(F.when(F.col("p.action") == "DELETE", DELETED).otherwise(value(f)) if f == "status" else value(f)).alias(f) for f in fields])


def write_back(sheet: DataFrame, operations: DataFrame, fields: list[str], remark: str = "[삭제]", key: str = "ledger_id") -> DataFrame:
    """The sheet extract after one operation a row: (key, fields).

    ``operations``: key, action, changed_fields and the fields. An update with changed fields writes those alone, if the
    row is there; other inserts and updates write all. A deletion marks the status and appends ``remark`` to the
    note once. The year is a field, so a changed year moves the row to that year's extract.
    """
    s, o = sheet.select(key, *fields).alias("s"), operations.select(key, "action", "changed_fields", *fields).alias("o")
    rows = s.join(o, F.col(f"s.{key}") == F.col(f"o.{key}"), "full_outer")
    there, gone = F.col(f"s.{key}").isNotNull(), F.coalesce(F.col("o.action") == "delete", F.lit(False))
    rows = rows.filter(there | ~gone)
    narrow = (F.col("o.action") == "update") & there & (F.coalesce(F.size("o.changed_fields"), F.lit(0)) > 0)

    def value(f: str) -> Column:
        mine = F.col(f"s.{f}")
        if f == "status":
            mine = F.when(gone, DELETED).otherwise(mine)
        if f == "note":
            mine = F.when(gone & ~F.contains(_text(mine), F.lit(remark)), F.trim(F.concat_ws(" ", _text(mine), F.lit(remark)))).otherwise(mine)
        asked = F.col(f"o.{key}").isNotNull() & ~gone & (~F.coalesce(narrow, F.lit(False)) | F.array_contains("o.changed_fields", f))
        return F.when(F.coalesce(asked, F.lit(False)), F.col(f"o.{f}")).otherwise(mine).alias(f)

    return rows.select(F.coalesce(F.col(f"s.{key}"), F.col(f"o.{key}")).alias(key), *[value(f) for f in fields])


def merge_concurrent(rebuilt: DataFrame, live: DataFrame, started_at: str, key: str = "ledger_id") -> DataFrame:
    """Rebuilt rows, but live rows that are new or were written since ``started_at`` (empty: none were)."""
    since = F.coalesce(F.col("updated_at"), F.lit("")) >= F.lit(started_at) if started_at else F.lit(False)
    live, columns = live.filter(~empty(key)), rebuilt.columns
    newer = live.filter(since).select(*columns)
    older = live.filter(~since).join(rebuilt.select(key), key, "left_anti").select(*columns)
    return rebuilt.join(newer.select(key), key, "left_anti").select(*columns).unionByName(newer).unionByName(older)


# --- purge, reports, budgets ----------------------------------------------------------------------


def purge(rows: DataFrame, history: DataFrame, listed: DataFrame, key: str = "ledger_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept rows, kept history, purged keys) for a list of (requester, title) pairs.

    History goes with its row, and where an applied snapshot itself holds a listed pair.
    """
    pairs = listed.select(_text("requester").alias("__r"), _text("title").alias("__t")).distinct()
    on = lambda r, t: (r == F.col("__r")) & (t == F.col("__t"))
    purged = rows.join(pairs, on(_text("requester"), _text("title")), "left_semi").select(key)
    kept = rows.join(pairs, on(_text("requester"), _text("title")), "left_anti")
    snap = lambda f: F.when(F.col("action") == "EXCEL_APPLIED", _text(F.get_json_object("snapshot", f"$.{f}")))
    left = history.join(purged, key, "left_anti").join(pairs, on(snap("requester"), snap("title")), "left_anti")
    return kept, left, purged


def ghosts(sheet: DataFrame) -> DataFrame:
    """Sheet rows with an id and nothing else."""
    return sheet.filter(~empty("ledger_id") & reduce(lambda a, b: a & b, [empty(c) for c in ("seq_no", "title", "details", "requester")]))


def reconcile(tables: dict[str, DataFrame], exports: dict[str, DataFrame]) -> DataFrame:
    """(name, n_table, n_export, mismatch) for each name on either side."""

    def counts(side: dict[str, DataFrame], column: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias(column)).select(F.lit(n).alias("name"), column) for n, df in side.items()])

    both = counts(tables, "n_table").join(counts(exports, "n_export"), "name", "full_outer")
    return both.select("name", "n_table", "n_export", (~F.col("n_table").eqNullSafe(F.col("n_export"))).alias("mismatch"))


def oversize(rows: DataFrame, most: int = 256 * 1024) -> DataFrame:
    """Adds ``bytes`` of the row as JSON and ``too_large``."""
    return rows.withColumn("bytes", F.octet_length(F.to_json(F.struct("*")))).withColumn("too_large", F.col("bytes") > most)


def containing_counts(rows: DataFrame, column: str = "institution", top: int = 8) -> DataFrame:
    """(value, n): the ``top`` values by exact count, with the rows that contain them.

    Only distinct values meet the top ones, so the containment test runs on ``top`` times the distinct values.
    """
    counted = rows.filter(~empty(column)).groupBy(F.trim(column).alias("value")).agg(F.count("*").alias("n"))
    best = counted.orderBy(F.desc("n"), "value").limit(top).select(F.col("value").alias("chip"))
    met = counted.join(F.broadcast(best), F.contains("value", F.col("chip")))
    return met.groupBy(F.col("chip").alias("value")).agg(F.sum("n").alias("n"))


def intake_plan(files: DataFrame, year: Column) -> DataFrame:
    """(year, n_files) of a listing; files without a year count under an empty one."""
    return files.groupBy(F.coalesce(year, F.lit("")).alias("year")).agg(F.count("*").alias("n_files"))


def parse_report(results: DataFrame, ok: str = "ok", seconds: str = "seconds") -> DataFrame:
    """files, success, fail, success percent and mean seconds of a table of parse results; 0 for an empty one."""
    n = results.agg(F.count("*").alias("files"), F.count_if(F.col(ok)).alias("success"), F.coalesce(F.avg(seconds), F.lit(0.0)).alias("mean_seconds"))
    rate = F.when(F.col("files") > 0, F.round(100.0 * F.col("success") / F.col("files"), 1)).otherwise(F.lit(0.0))
    return n.select("files", "success", (F.col("files") - F.col("success")).alias("fail"), rate.alias("rate"), "mean_seconds")


def intake_names(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, state, target) for files (path, name, size, sha256) that meet stored ones (name, size, sha256).

    The same name, size and hash is a ``copy``; of equal new files the first path is taken. Another content under a name
    in use gets eight characters of its hash; the first new content in path order keeps a free name.
    """
    same = ["name", "size", "sha256"]
    first = files.groupBy(*same).agg(F.min("path").alias("path"))
    new = first.join(stored.select(*same).distinct(), same, "left_anti")
    owner = new.groupBy("name").agg(F.min("path").alias("owner"))
    taken = stored.select("name").distinct().withColumn("taken", F.lit(True))
    named = new.join(owner, "name").join(taken, "name", "left")
    renamed = F.col("taken").isNotNull() | (F.col("path") != F.col("owner"))
    suffixed = F.concat(F.regexp_replace("name", r"(\.[^.]+)?$", ""), F.lit("_"), F.left("sha256", F.lit(8)), F.regexp_extract("name", r"(\.[^.]+)$", 1))
    kept = named.select("path", F.when(renamed, "renamed").otherwise("new").alias("state"), F.when(renamed, suffixed).otherwise(F.col("name")).alias("target"))
    copies = files.join(kept.select("path"), "path", "left_anti").select("path", F.lit("copy").alias("state"), F.col("name").alias("target"))
    return kept.unionByName(copies)
