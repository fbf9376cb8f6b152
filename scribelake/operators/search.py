"""Batch text search: a table of queries against a table of documents.

Query text becomes a table of terms; matching is substring containment in white-space-free lower
case, as a full scan gives it. The queries are a stated set, so their forms go to the tasks, a
bounded number at a time; each text is normalised once a pass and read against all of them.
Bodies are never shuffled: only (query, document, term) hits are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelake.functions.dates import normalize_date
from scribelake.functions.text import INITIALS, PER_INITIAL, agent_snippet, choseong, clean_term, col, nospace_lower, snippet, strip_suffix

from .shared import cut, small
from .trigrams import TrigramIndex, occurrences

# Names of field qualifiers and the column that each stands for.
FIELDS = {
    "요구자": "requester", "의원": "requester", "requester": "requester",
    "상태": "status", "진행상태": "status", "status": "status",
    "연도": "year", "년도": "year", "year": "year",
    "문서번호": "doc_number", "docno": "doc_number",
    "연번": "seq_no", "seq": "seq_no",
    "정당": "party", "party": "party",
    "부서": "department", "담당부서": "department", "department": "department",
    "기관": "institution", "institution": "institution",
    "기간": "date", "일자": "date", "date": "date",
}
# Fields whose whole value must be equal.
WHOLE_FIELDS = ("status", "year", "seq_no", "doc_number")
#: Columns that a filter may name.
FIELD_COLUMNS = tuple(dict.fromkeys(x for x in FIELDS.values() if x != "date"))
#: Forms of terms that one pass over the texts looks for.
PASS_FORMS = 20_000
#: Forms from which an automaton is faster than one look for each.
MANY_FORMS = 400
#: Characters from which a form goes into the automaton.
LONG_FORM = 5
#: Forms up to which texts are read without leaving the JVM.
FEW_FORMS = 48
#: A form of initials.
JAMO = "^[ㄱ-ㅎ]+$"
#: Longest text whose initials are compared.
INITIALS_LIMIT = 4000


def query_terms(queries: DataFrame, synonyms: DataFrame | None = None, browser: bool = False) -> DataFrame:
    """(query_id, query) -> (query_id, group_no, term_no, kind, field, value, variants).

    Groups are separated by OR or ``|``; inside one, terms are ANDed. ``"…"`` is a phrase, ``-x`` an
    exclusion, ``field:value`` a qualifier where the field is known; those three belong to the whole
    query (group -1). ``date:a..b`` gives the qualifiers date_from and date_to. A term's variants are
    itself, its stem and the ``synonyms`` (word, variant) of both; a term of initials has only itself.

    The ``browser``'s grammar differs: OR and ``|`` part groups only between spaces and are words elsewhere, words
    and exclusions keep their punctuation, stems under two characters are no variants, and a group without a
    term asks for the phrases alone, so then no other group's terms are needed (they get the kind ``extra``).
    """
    known = "|".join(FIELDS)
    q = queries.select("query_id", F.coalesce("query", F.lit("")).alias("q"))
    if browser:
        q = q.select("query_id", F.regexp_replace("q", r"(?U)^\s+|\s+$", "").alias("q"))
    phrases = q.select("query_id", F.posexplode(F.regexp_extract_all("q", F.lit('"([^"]*)"'), 1)).alias("term_no", "value")).select(
        "query_id", F.lit(-1).alias("group_no"), "term_no", F.lit("phrase").alias("kind"), F.lit("").alias("field"), nospace_lower("value").alias("value")
    )
    rest = F.regexp_replace("q", '"[^"]*"', " ")
    parted = r"(?U)\s+(?:OR|or|\|)\s+" if browser else r"(?U)\s+(?:OR|or|\|)\s+|\s*\|\s*"
    groups = q.select("query_id", F.posexplode(F.split(rest, parted)).alias("group_no", "g"))
    words = groups.select("query_id", "group_no", F.posexplode(F.split("g", r"(?U)\s+")).alias("term_no", "w")).filter("w <> ''" if browser else "w <> '' and upper(w) <> 'OR'")
    clean = F.lower if browser else clean_term
    qualifier = F.col("w").rlike(f"(?i)^(?:{known}):")
    kind = F.when(F.col("w").rlike("^-."), "not").when(qualifier, "field").otherwise("term")
    value = F.when(kind == "not", clean(F.substring("w", 2, 10_000))).when(kind == "field", F.btrim(F.regexp_replace("w", "^[^:]*:", ""), F.lit('"'))).otherwise(clean("w"))
    names = F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair])
    parsed = words.select(
        "query_id",
        F.when(kind == "term", F.col("group_no")).otherwise(-1).alias("group_no"),
        "term_no",
        kind.alias("kind"),
        F.when(kind == "field", F.try_element_at(names, F.lower(F.substring_index("w", ":", 1)))).otherwise("").alias("field"),
        nospace_lower(value).alias("value"),
    )
    # a date qualifier is one or both ends of a range
    ranged = F.col("value").contains("..")
    ends = F.array(
        F.struct(F.lit("date_from").alias("field"), normalize_date(F.when(ranged, F.substring_index("value", "..", 1)).otherwise(F.col("value"))).alias("value")),
        F.struct(F.lit("date_to").alias("field"), normalize_date(F.when(ranged, F.substring_index("value", "..", -1)).otherwise(F.col("value")), end=True).alias("value")),
    )
    plain = F.array(F.struct(F.col("field"), F.col("value")))
    parsed = parsed.select("query_id", "group_no", "term_no", "kind", F.inline(F.when(F.col("field") == "date", ends).otherwise(plain)).alias("field", "value"))
    terms = parsed.unionByName(phrases).filter("value <> ''")
    stem = strip_suffix("value")
    if browser:
        stem = F.when(F.length(stem) >= 2, stem).otherwise(F.col("value"))
        # groups of exclusions and qualifiers only, in queries with phrases
        blocks = words.select("query_id", F.col("group_no").alias("block"), (kind == "term").alias("own")).groupBy("query_id", "block").agg(F.max("own").alias("own"))
        alone = blocks.filter("not own").select("query_id").distinct().join(phrases.filter("value <> ''").select("query_id").distinct(), "query_id").withColumn("alone", F.lit(True))
        terms = terms.join(alone, "query_id", "left").withColumn("kind", F.when(F.col("alone") & (F.col("kind") == "term"), "extra").otherwise(F.col("kind"))).drop("alone")
    initials = F.col("value").rlike("^[ㄱ-ㅎ]+$")
    forms = F.when((F.col("kind") == "term") & ~initials, F.array_distinct(F.array(F.col("value"), stem))).otherwise(F.array("value"))
    terms = terms.withColumn("variants", forms)
    if synonyms is None:
        return terms
    by_word = synonyms.groupBy(F.lower("word").alias("word")).agg(F.sort_array(F.collect_set(nospace_lower("variant"))).alias("more"))
    own, stemmed = by_word.alias("own"), by_word.alias("stemmed")
    none = F.array().cast("array<string>")
    more = F.array_distinct(F.concat("variants", F.coalesce("own.more", none), F.coalesce("stemmed.more", none)))
    return (
        terms.join(own, F.col("value") == F.col("own.word"), "left")
        .join(stemmed, stem == F.col("stemmed.word"), "left")
        .withColumn("variants", F.when(F.col("kind") == "term", more).otherwise(F.col("variants")))
        .select("query_id", "group_no", "term_no", "kind", "field", "value", "variants")
    )


def search_text(docs: DataFrame, fields: dict[str, float], key: str = "doc_id", initials: tuple[str, ...] = ()) -> DataFrame:
    """(key, field, weight, text): one row per non-empty searched field; with ``initials`` also one of their initials."""
    each = [F.struct(F.lit(name).alias("field"), F.lit(float(w)).alias("weight"), col(name).alias("text")) for name, w in fields.items()]
    for name in initials:
        text = F.when(F.length(name) <= INITIALS_LIMIT, choseong(name))
        each.append(F.struct(F.lit("initials:" + name).alias("field"), F.lit(float(fields.get(name, 0.0))).alias("weight"), text.alias("text")))
    return docs.select(key, F.inline(F.array(*each))).filter("text <> ''")


def _reader(forms: list[str]):
    """Function text -> numbers of the forms in it."""
    if len(forms) < MANY_FORMS:
        return lambda text: [i for i, f in enumerate(forms) if f in text]
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [i for i, f in enumerate(forms) if f in text]
    # short forms are found early in a text or nowhere near it; an automaton would stop at each of their hits
    short = [(i, f) for i, f in enumerate(forms) if len(f) < LONG_FORM]
    automaton = ahocorasick.Automaton()
    for i, f in enumerate(forms):
        if len(f) >= LONG_FORM:
            automaton.add_word(f, i)
    automaton.make_automaton()
    if not len(automaton):
        return lambda text: [i for i, f in short if f in text]
    return lambda text: sorted({i for _, i in automaton.iter(text)} | {i for i, f in short if f in text})


def _few_hits(texts: DataFrame, forms: list[str], key: str, counted: bool) -> DataFrame:
    """:func:`form_hits` as SQL expressions: each text is normalised once and asked for each form."""
    x, initials = F.col("x"), F.col("field").startswith("initials:")
    hit = lambda v: F.contains(x, F.lit(v)) & (initials if re.search(JAMO, v) else ~initials)
    n = lambda v: occurrences(x, F.lit(v)) if counted else F.lit(1).cast("long")
    row = "struct<variant:string,n:bigint>"
    found = [F.when(hit(v), F.struct(F.lit(v).alias("variant"), n(v).alias("n")).cast(row)) for v in forms]
    if counted:
        found.append(F.struct(F.lit(None).cast("string").alias("variant"), F.length(x).cast("long").alias("n")).cast(row))
    hits = F.array_compact(F.array(*found)) if found else F.array().cast(f"array<{row}>")
    norm = texts.select(key, "field", "weight", nospace_lower("text").alias("x"))
    return norm.select(F.inline(hits), key, "field", "weight").select("variant", key, "field", "weight", "n")


def form_hits(texts: DataFrame, variants: DataFrame, key: str = "doc_id", counted: bool = False) -> DataFrame:
    """(variant, key, field, weight, n) for each distinct ``variant`` that a field's text holds.

    With ``counted``, n is the number of occurrences that don't overlap, and each text adds a row with
    the variant null and its length. Variants of initials are compared with initials, others
    with the other fields. ``PASS_FORMS`` variants are looked for in one pass over the texts.
    """
    spark = texts.sparkSession
    distinct = variants.select("variant").distinct()
    few = [r["variant"] for r in distinct.limit(FEW_FORMS + 1).collect()]
    if len(few) <= FEW_FORMS:
        return _few_hits(texts, sorted(few), key, counted)
    passes = max(1, -(-distinct.count() // PASS_FORMS))
    kind = texts.schema[key].dataType.simpleString()
    out = None
    for p in range(passes):
        part = distinct if passes == 1 else distinct.filter(F.pmod(F.xxhash64("variant"), F.lit(passes)) == p)
        shared = spark.sparkContext.broadcast(sorted(r["variant"] for r in part.collect()))  # about PASS_FORMS short strings

        def scan(batches: Iterator[pd.DataFrame], shared=shared, first=p == 0):
            plain = [v for v in shared.value if not re.fullmatch("[ㄱ-ㅎ]+", v)]
            jamo = [v for v in shared.value if re.fullmatch("[ㄱ-ㅎ]+", v)]
            readers = {False: (plain, _reader(plain)), True: (jamo, _reader(jamo))}
            for pdf in batches:
                rows = []
                for k, field, weight, raw in zip(pdf[key], pdf["field"], pdf["weight"], pdf["text"]):
                    text = "".join(raw.split()).lower()
                    forms, read = readers[field.startswith("initials:")]
                    rows += [(forms[i], k, field, weight, text.count(forms[i]) if counted else 1) for i in read(text)]
                    if counted and first:
                        rows.append((None, k, field, weight, len(text)))
                yield pd.DataFrame(rows, columns=["variant", key, "field", "weight", "n"])

        found = texts.mapInPandas(scan, f"variant string, {key} {kind}, field string, weight double, n long")
        out = found if out is None else out.union(found)
    return out


#: Fields in which terms that mix syllables and initials are looked for.
MIXED_FIELDS = ("title", "requester", "details", "topic_tags")
#: A form of syllables or other characters and initials.
MIXED = "^(?=.*[ㄱ-ㅎ])(?=.*[^ㄱ-ㅎ]).+$"


def _mixed_reader(forms: list[str]):
    """Function text -> numbers of the mixed forms in it, in two stages.

    The initials of a form are looked for in the initials of the text, for all forms at once; only at
    the places found are the form's syllables compared with the text's.
    """
    table = {0xAC00 + i: INITIALS[i // PER_INITIAL] for i in range(len(INITIALS) * PER_INITIAL)}
    by_initials: dict[str, list[int]] = {}
    for i, f in enumerate(forms):
        by_initials.setdefault(f.translate(table), []).append(i)
    rough = list(by_initials)
    fixed = [[(j, c) for j, c in enumerate(f) if c not in INITIALS] for f in forms]
    read = _reader(rough)

    def found(text: str) -> list[int]:
        short, out = text.translate(table), []
        for r in read(short):
            open_forms, at = by_initials[rough[r]], short.find(rough[r])
            while at >= 0 and open_forms:
                hit = [i for i in open_forms if all(text[at + j] == c for j, c in fixed[i])]
                out += hit
                open_forms = [i for i in open_forms if i not in hit] if hit else open_forms
                at = short.find(rough[r], at + 1)
        return out

    return found


def mixed_hits(texts: DataFrame, variants: DataFrame, key: str = "doc_id") -> DataFrame:
    """(variant, key, field, weight, n) for each mixed ``variant`` in a field of ``MIXED_FIELDS``; n is 1.

    An initial stands for itself and for all syllables that begin with it. ``PASS_FORMS`` are looked for in a pass.
    """
    spark = texts.sparkSession
    distinct = cut(variants.select("variant").distinct())
    passes = max(1, -(-distinct.count() // PASS_FORMS))
    kind = texts.schema[key].dataType.simpleString()
    asked = texts.filter(F.col("field").isin(*MIXED_FIELDS))
    out = None
    for p in range(passes):
        shared = spark.sparkContext.broadcast(sorted(r["variant"] for r in distinct.filter(F.pmod(F.xxhash64("variant"), F.lit(passes)) == p).collect()))

        def scan(batches: Iterator[pd.DataFrame], shared=shared):
            forms = shared.value
            read = _mixed_reader(forms)
            for pdf in batches:
                rows = [(forms[i], k, field, weight, 1) for k, field, weight, raw in zip(pdf[key], pdf["field"], pdf["weight"], pdf["text"]) for i in read("".join(raw.split()).lower())]
                yield pd.DataFrame(rows, columns=["variant", key, "field", "weight", "n"])

        found = asked.mapInPandas(scan, f"variant string, {key} {kind}, field string, weight double, n long")
        out = found if out is None else out.union(found)
    return out


def term_hits(texts: DataFrame | TrigramIndex, terms: DataFrame, key: str = "doc_id", counted: bool = False, mixed: bool = False) -> DataFrame:
    """(query_id, group_no, term_no, kind, key, field, weight, n) where a variant is in a field's text, which is scanned or looked up.

    With ``mixed``, terms of syllables and initials are matched as :func:`mixed_hits` does, else as plain text.
    """
    variants = terms.select("query_id", "group_no", "term_no", "kind", F.posexplode("variants").alias("place", "variant")).filter("variant <> ''")
    variants = variants.groupBy("query_id", "group_no", "term_no", "kind", "variant").agg(F.min("place").alias("place"))
    both = (F.col("kind") == "term") & (F.col("place") == 0) & F.col("variant").rlike(MIXED)  # the term itself, not its stem
    some = variants.filter(both) if mixed else None
    plain = variants.filter(~both) if mixed else variants
    # what is looked up is written, so that branches of a plan don't each read the candidates
    hits = cut(texts.hits(plain, counted)) if isinstance(texts, TrigramIndex) else form_hits(texts, plain, key, counted)
    if mixed and some.limit(1).count():
        hits = hits.unionByName(mixed_hits(texts.texts() if isinstance(texts, TrigramIndex) else texts, some, key)).distinct()
    joined = hits.join(small(variants), "variant", "left" if counted else "inner")
    # several variants of one term count as one hit of a field; the sums of their counts are its count
    name = F.regexp_replace("field", "^initials:", "").alias("field")
    return joined.groupBy("query_id", "group_no", "term_no", "kind", key, name).agg(F.max("weight").alias("weight"), F.sum("n").alias("n"))


def qualified(found: DataFrame, docs: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """``found`` (query_id, key, …) without the rows that fail a qualifier of their query.

    Values of one field are ORed, fields are ANDed; a column that isn't there is empty and fails.
    Dates bound ``request_date``, whose empty value fails.
    """
    wanted = terms.filter("kind = 'field'").groupBy("query_id", "field").agg(F.collect_set("value").alias("__values"), F.max("value").alias("__last"))
    if not wanted.limit(1).count():
        return found
    have = [c for c in FIELD_COLUMNS if c in docs.columns]
    pairs = [x for c in have for x in (F.lit(c), nospace_lower(F.col(c).cast("string")))]
    day = F.coalesce(F.trim(F.col("request_date").cast("string")), F.lit("")) if "request_date" in docs.columns else F.lit("")
    held = docs.select(key, (F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(""))).alias("__held"), day.alias("__day"))
    asked = found.join(small(wanted), "query_id").join(held, key)
    actual = F.coalesce(F.try_element_at("__held", F.col("field")), F.lit(""))
    ok = (
        F.when(F.col("field") == "date_from", (F.col("__day") != "") & (F.col("__day") >= F.col("__last")))
        .when(F.col("field") == "date_to", (F.col("__day") != "") & (F.col("__day") <= F.col("__last")))
        .when(F.col("field").isin(*WHOLE_FIELDS), F.array_contains("__values", actual))
        .otherwise(F.exists("__values", lambda v: F.contains(actual, v)))
    )
    failed = asked.filter(~ok).select("query_id", key).distinct()
    return found.join(failed, ["query_id", key], "left_anti")


def batch_search(
    docs: DataFrame,
    queries: DataFrame,
    fields: dict[str, float],
    key: str = "doc_id",
    synonyms: DataFrame | None = None,
    k: int | None = None,
    initials: tuple[str, ...] = (),
    index: TrigramIndex | None = None,
    browser: bool = False,
) -> DataFrame:
    """(query_id, key, score) of every match; the ``k`` best of each query if given.

    A row matches if some group has all its terms, every phrase occurs in one field, no excluded
    word does, and every qualifier holds. A query of exclusions or qualifiers alone, or an empty
    one, lists every row that is left, with a score of 0. Score: each term hit, in whatever group,
    adds its field's weight, each phrase twice that; a field with weight 0 is searched but not scored.
    ``browser`` reads the queries by its grammar and matches mixed terms. With an ``index`` over the same fields the texts are read for candidates only; the rows are the same.
    """
    spark = docs.sparkSession
    every = cut(query_terms(queries, synonyms, browser))  # small, and used by every step below
    terms = every.filter("kind not in ('field', 'extra')")
    hits = term_hits(index or search_text(docs, fields, key, initials), terms, key, mixed=browser)
    need = terms.groupBy("query_id", "group_no", "kind").agg(F.count_distinct("term_no").alias("needed"))
    got = hits.groupBy("query_id", "group_no", "kind", key).agg(F.count_distinct("term_no").alias("got"), F.sum("weight").alias("weight"))
    whole = got.join(small(need), ["query_id", "group_no", "kind"])
    per_doc = whole.groupBy("query_id", key).agg(
        F.max((F.col("kind") == "term") & (F.col("got") == F.col("needed"))).alias("some_group"),
        F.max((F.col("kind") == "phrase") & (F.col("got") == F.col("needed"))).alias("all_phrases"),
        F.max(F.col("kind") == "not").alias("excluded"),
        F.sum(F.when(F.col("kind") == "term", F.col("weight")).when(F.col("kind") == "phrase", 2 * F.col("weight")).otherwise(0)).alias("score"),
    )
    kinds = queries.select("query_id").join(
        terms.groupBy("query_id").agg(F.max(F.col("kind") == "term").alias("has_terms"), F.max(F.col("kind") == "phrase").alias("has_phrases")), "query_id", "left"
    )
    kinds = kinds.select("query_id", F.coalesce("has_terms", F.lit(False)).alias("has_terms"), F.coalesce("has_phrases", F.lit(False)).alias("has_phrases"))
    found = (
        per_doc.join(small(kinds), "query_id")
        .filter((~F.col("has_terms") | F.col("some_group")) & (~F.col("has_phrases") | F.col("all_phrases")) & ~F.col("excluded"))
        .filter("has_terms or has_phrases")
        .select("query_id", key, F.round("score", 6).alias("score"))
    )
    listing = kinds.filter("not has_terms and not has_phrases").select("query_id")
    ids = [r["query_id"] for r in listing.limit(10_001).collect()]
    if len(ids) > 10_000:
        raise ValueError("more than 10,000 queries list the whole table; search them in parts")
    if ids:
        # the answer of such a query is the table itself, so it is as long as the table
        kind = queries.schema["query_id"].dataType
        listed = docs.select(F.explode(F.array(*[F.lit(i).cast(kind) for i in ids])).alias("query_id"), key, F.lit(0.0).alias("score"))
        out = per_doc.filter("excluded").select("query_id", key)
        found = found.unionByName(listed.join(out, ["query_id", key], "left_anti"))
    found = qualified(found, docs, every, key)
    return found if k is None else top_k(found, k, key)


def top_k(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The ``k`` best of each query; Spark limits each task's rows before they are dealt by query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, fields: dict[str, float], key: str = "doc_id", k1: float = 1.2, b: float = 0.75, index: TrigramIndex | None = None) -> DataFrame:
    """(query_id, key, score): BM25 over substring occurrences, weighted by field in the term frequency.

    Lengths are those of the compared texts; rows without any text count neither in the mean nor in N.
    """
    terms = cut(query_terms(queries).filter("kind = 'term'"))
    counted = term_hits(index or search_text(docs, fields, key), terms, key, counted=True)
    counted = counted.withColumn("query", F.col("query_id").isNotNull())
    tf = counted.filter("query").groupBy("query_id", "group_no", "term_no", key).agg(F.sum(F.col("weight") * F.col("n")).alias("tf"))
    sizes = counted.filter("not query").groupBy(key).agg(F.sum("n").alias("size"))
    totals = sizes.agg(F.count("*").alias("N"), F.avg("size").alias("mean"))
    df = tf.groupBy("query_id", "group_no", "term_no").agg(F.count("*").alias("df"))
    joined = tf.join(small(df), ["query_id", "group_no", "term_no"]).join(sizes, key).crossJoin(F.broadcast(totals))  # one row
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return joined.groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"))


def field_filter(rows: DataFrame, wanted: dict[str, list[str]], dates: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Values of one field are ORed, fields are ANDed; a column that isn't there fails. ``dates`` bound request_date."""
    tests = []
    for name, values in wanted.items():
        column = FIELDS.get(name, name)
        if column not in rows.columns:
            return rows.filter(F.lit(False))
        text = nospace_lower(F.col(column).cast("string"))
        norm = ["".join(v.split()).lower() for v in values]
        tests.append(text.isin(norm) if column in WHOLE_FIELDS else reduce(lambda a, b: a | b, [text.contains(v) for v in norm]))
    low, high = dates
    if low or high:
        day = F.trim(F.col("request_date").cast("string"))
        tests += [day != ""] + ([day >= low] if low else []) + ([day <= high] if high else [])
    return rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows


def department_filter(rows: DataFrame, value: str) -> DataFrame:
    """Department of a document, or its contact person where the department is unknown."""
    text = F.coalesce(F.nullif(F.trim("department"), F.lit("")), F.col("contact_person"), F.lit(""))
    return rows.filter(nospace_lower(text).contains("".join(value.split()).lower()))


def plan_filter(rows: DataFrame, groups: list[list[str]], fields: list[str], phrases: tuple[str, ...] = (), without: tuple[str, ...] = (), initials: tuple[str, ...] = ()) -> DataFrame:
    """One query as a filter: OR over groups of AND over terms; an empty plan lists everything.

    Terms of initials are compared with the initials of the ``initials`` fields. The normalised fields
    are columns of their own, so the filter is generated code.
    """
    norm = lambda t: "".join(t.split()).lower()

    if not (groups or phrases or without):
        return rows
    texts = {f"__n{i}": nospace_lower(f) for i, f in enumerate(fields)}
    either = lambda names, t: reduce(lambda x, y: x | y, [F.contains(n, F.lit(t)) for n in names]) if names else F.lit(False)
    short = {"__initials": choseong(F.concat_ws(" ", *initials))} if initials and any(re.search(JAMO, norm(t)) for g in groups for t in g) else {}
    term = lambda t: either(short, t) if re.search(JAMO, t) else either(texts, t)
    tests = [~either(texts, norm(w)) for w in without] + [either(texts, norm(p)) for p in phrases]
    if groups:
        tests.append(reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, [term(norm(t)) for t in g]) for g in groups]))
    return rows.withColumns(texts | short).filter(reduce(lambda x, y: x & y, tests)).drop(*texts, *short)


def initials_filter(rows: DataFrame, term: str, fields: list[str]) -> DataFrame:
    """Rows whose short fields, joined, contain the initials."""
    return rows.filter(choseong(F.concat_ws(" ", *fields)).contains(term))


def words_filter(rows: DataFrame, keyword: str, columns: list[str], limit: int | None = 500) -> DataFrame:
    """Every word must be in one of the columns, as typed; the older listing stops at ``limit``."""
    words = keyword.lower().split()
    for w in words:
        rows = rows.filter(reduce(lambda a, b: a | b, [F.lower(F.coalesce(col(c), F.lit(""))).contains(w) for c in columns]))
    return rows if limit is None else rows.limit(limit)


# Weights of a term, a phrase, initials and a mixed term by column; an exact title counts 60.
BROWSER_TERM = {"title": 35, "requester": 30, "seq_no": 30, "details": 25, "topic_tags": 18, "party": 15, "key_questions": 15, "note": 12, "table_summary": 10, "full_markdown": 8}
BROWSER_PHRASE = {"title": 50, "requester": 35, "details": 25, "full_markdown": 20}
BROWSER_INITIALS = {"title": 35, "requester": 30, "details": 25, "topic_tags": 18, "party": 15, "key_questions": 15, "note": 8}
BROWSER_MIXED = {"title": 40, "requester": 35, "details": 25, "topic_tags": 10}
EXACT_TITLE = 60


def browser_score(rows: DataFrame, groups: list[list[str]], phrases: tuple[str, ...] = (), columns: tuple[str, ...] | None = None) -> DataFrame:
    """Score of the best OR group whose terms all occur, plus that of the phrases, which must all occur.

    An exact title adds ``EXACT_TITLE`` instead of its weight. Terms of initials are compared with
    initials; terms that mix syllables and initials by pattern. Other rows are left out.
    """
    from scribelake.functions.text import hybrid_pattern

    have = columns or tuple(rows.columns)
    pick = lambda weights: {c: float(w) for c, w in weights.items() if c in have and c in rows.columns}
    either = lambda tests: reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
    total = lambda parts: reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0)
    used = sorted(set(pick(BROWSER_TERM)) | set(pick(BROWSER_PHRASE)) | set(pick(BROWSER_MIXED)))

    def score(n: Column) -> Column:
        def one(t: str):
            jamo, mixed = re.fullmatch("[ㄱ-ㅎ]+", t), re.search("[ㄱ-ㅎ]", t)
            weights = pick(BROWSER_INITIALS if jamo else BROWSER_MIXED if mixed else BROWSER_TERM)
            if jamo:
                hit = {c: F.contains(choseong(n[c]), F.lit(t)) for c in weights}
            elif mixed:
                hit = {c: n[c].rlike(hybrid_pattern(t)) for c in weights}
            else:
                hit = {c: F.contains(n[c], F.lit(t)) for c in weights}
            parts = [F.when(n[c] == t, float(EXACT_TITLE)).when(h, weights[c]).otherwise(0.0) if c == "title" and not mixed else F.when(h, weights[c]).otherwise(0.0) for c, h in hit.items()]
            return either(list(hit.values())), total(parts)

        norm = lambda t: "".join(t.split()).lower()
        best = []
        for g in groups:
            tests = [one(norm(t)) for t in g]
            best.append(F.when(reduce(lambda a, b: a & b, [x for x, _ in tests]), total([s for _, s in tests])))
        of_groups = (F.greatest(*best) if len(best) > 1 else best[0]) if best else F.lit(0.0)
        weights = pick(BROWSER_PHRASE)
        for p in map(norm, phrases):
            hit = {c: F.contains(n[c], F.lit(p)) for c in weights}
            of_groups = F.when(either([F.contains(n[c], F.lit(p)) for c in used]), of_groups + total([F.when(h, weights[c]).otherwise(0.0) for c, h in hit.items()]))
        return of_groups

    texts = F.struct(*[nospace_lower(c).alias(c) for c in used])
    return rows.withColumn("score", F.transform(F.array(texts), score)[0]).filter("score is not null")


def with_snippets(found: DataFrame, docs: DataFrame, needles: list[str], body: str, key: str = "doc_id") -> DataFrame:
    """Joins bodies only after the hits are chosen; a small result is broadcast, so bodies are not shuffled."""
    return docs.select(key, col(body).alias("__body")).join(small(cut(found)), key).withColumn("snippet", snippet("__body", needles)).drop("__body")


def agent_snippets(found: DataFrame, docs: DataFrame, query: str, body: str, key: str = "doc_id") -> DataFrame:
    """Snippet of the first query word of two characters or more that occurs, with its range."""
    return docs.select(key, col(body).alias("__body")).join(small(cut(found)), key).select(*found.columns, agent_snippet("__body", query).alias("s")).select(*found.columns, "s.*")


def query_log(searched: DataFrame, queries: DataFrame, mode: str = "all", runs: DataFrame | None = None) -> DataFrame:
    """One log row per non-empty query with its result count.

    ``runs`` (query_id, elapsed_ms, used_index, searched_at) tells how and when each was searched; those columns
    follow. A query without a run has them null.
    """
    counts = searched.groupBy("query_id").agg(F.count("*").alias("result_count"))
    rows = (
        queries.filter(F.trim("query") != "")
        .join(counts, "query_id", "left")
        .select("query_id", F.left("query", F.lit(300)).alias("query"), F.lit(mode).alias("mode"), F.coalesce("result_count", F.lit(0)).alias("result_count"))
    )
    if runs is None:
        return rows
    how = runs.select("query_id", F.col("elapsed_ms").cast("long").alias("elapsed_ms"), F.col("used_index").cast("boolean").alias("used_index"), F.date_trunc("second", "searched_at").alias("searched_at"))
    return rows.join(how, "query_id", "left")


def query_insights(log: DataFrame, since=None, popular: int = 10) -> DataFrame:
    """Reports on a query log (query, result_count, elapsed_ms, searched_at, used_index): report, query, n, value, mean_ms, index_hits, last_at.

    popular: the most used queries, value their uses; empty: those that most often found nothing, n and value how often,
    last_at the last time, newest first among equals; slow: the slowest runs, with mean and the runs that an index answered.
    """
    if since is not None:
        log = log.filter(F.col("searched_at") >= F.lit(since))
    zero = F.coalesce(F.col("result_count"), F.lit(0)) == 0
    indexed = F.count_if("used_index") if "used_index" in log.columns else F.lit(0).cast("long")
    per = log.groupBy("query").agg(
        F.count("*").alias("n"), F.count_if(zero).alias("zero"), F.max("elapsed_ms").cast("double").alias("slowest"), F.avg("elapsed_ms").alias("mean_ms"),
        indexed.alias("index_hits"), F.max("searched_at").alias("last_at"), F.max(F.when(zero, F.col("searched_at"))).alias("last_zero"),
    )

    def top(rows: DataFrame, name: str, n: str, value: str, last: str, order: list) -> DataFrame:
        shown = rows.orderBy(*order).limit(popular)
        return shown.select(F.lit(name).alias("report"), "query", F.col(n).alias("n"), F.col(value).cast("double").alias("value"), "mean_ms", "index_hits", F.col(last).alias("last_at"))

    return (
        top(per, "popular", "n", "n", "last_at", [F.desc("n"), "query"])
        .unionAll(top(per.filter("zero > 0"), "empty", "zero", "zero", "last_zero", [F.desc("zero"), F.desc("last_zero"), "query"]))
        .unionAll(top(per.filter("slowest is not null"), "slow", "n", "slowest", "last_at", [F.desc("slowest"), "query"]))
    )


def recent_queries(log: DataFrame, per_user: int = 8, user: str = "user_id", least: int = 1) -> DataFrame:
    """Newest distinct queries of each user, of ``least`` characters or more: user, query, rank."""
    last = log.filter(F.length(F.trim("query")) >= least).groupBy(user, "query").agg(F.max("searched_at").alias("t"))
    w = Window.partitionBy(user).orderBy(F.desc("t"), "query")
    return last.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_user).select(user, "query", "rank")


def federated(queries: DataFrame, sources: dict[str, tuple[DataFrame, str, dict[str, float], str]], k: int | None = None) -> DataFrame:
    """Search of several tables at once: (kind, query_id, key, title, score) in one shape.

    ``sources`` maps a kind to (table, key column, field weights, title column).
    """
    out = None
    for kind, (rows, key, fields, title) in sources.items():
        found = cut(batch_search(rows, queries, fields, key, k=k).select("query_id", key, "score"))
        named = rows.select(key, col(title).alias("title")).join(small(found), key)
        one = named.select(F.lit(kind).alias("kind"), "query_id", F.col(key).cast("string").alias("key"), "title", "score")
        out = one if out is None else out.unionByName(one)
    return out


def similar_answers(requests: DataFrame, docs: DataFrame, stop: list[str], fields: dict[str, float], k: int = 5, keywords: int = 4, index: TrigramIndex | None = None) -> DataFrame:
    """Past documents for each request: up to four keywords each, by keywords hit, then by score."""
    words = F.filter(F.split(F.lower(F.col("title")), r"[^\w가-힣]+"), lambda w: (F.length(w) >= 2) & ~w.isin(stop))
    chosen = requests.select("request_id", F.posexplode(F.slice(F.array_distinct(words), 1, keywords)).alias("term_no", "value"))
    terms = chosen.select(F.col("request_id").alias("query_id"), F.lit(0).alias("group_no"), "term_no", F.lit("term").alias("kind"), F.array(nospace_lower("value")).alias("variants"))
    hits = term_hits(index or search_text(docs, fields), terms)
    scored = hits.groupBy("query_id", "doc_id").agg(F.count_distinct("term_no").alias("hits"), F.sum("weight").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
