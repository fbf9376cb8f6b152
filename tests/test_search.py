import random
import re

import numpy as np
import pyarrow as pa
import pytest

from scribelake.operators import search, trigrams

DOCS = [
    ("D1", "접속 차단 현황", "김철수 의원", "본문 예산 자료"),
    ("D2", "보안 점검", "이영희 의원", "접속차단 기록과 통계"),
    ("D3", "예산 통계", "박민수", "다른 본문"),
    ("D4", "a", "b", None),
]
FIELDS = {"title": 50.0, "requester": 25.0, "body": 10.0}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id string, title string, requester string, body string")


CASES = {
    "접속차단": {"D1", "D2"},
    "접속차단 예산": {"D1"},
    "접속차단 OR 예산": {"D1", "D2", "D3"},
    "통계 -보안": {"D3"},
    '"차단 현황"': {"D1"},
    "통계를": {"D2", "D3"},
    "없는말": set(),
    "": {"D1", "D2", "D3", "D4"},
    "-예산": {"D2", "D4"},
    '"차단 현황" OR': {"D1"},
    "요구자:의원 예산": {"D1"},
    "의원:의원": {"D1", "D2"},
    "연도:2026 예산": set(),
    "모름:값": set(),
    "ㅂㅇ": {"D2"},
    "김철수 | 박민수": {"D1", "D3"},
    "예산 -예산": set(),
}


@pytest.mark.parametrize("forms, many, few", [(20_000, 400, 0), (3, 1, 0), (20_000, 400, 500)])
def test_golden_queries(spark, docs, monkeypatch, forms, many, few):
    """By Python workers with and without an automaton, and by SQL expressions."""
    monkeypatch.setattr(search, "PASS_FORMS", forms)
    monkeypatch.setattr(search, "FEW_FORMS", few)
    monkeypatch.setattr(search, "MANY_FORMS", many)
    asked = spark.createDataFrame(list(enumerate(CASES)), "query_id int, query string")
    got = search.batch_search(docs, asked, FIELDS, initials=("title", "requester")).collect()
    for i, (query, want) in enumerate(CASES.items()):
        assert {r.doc_id for r in got if r.query_id == i} == want, query


def test_synonyms(spark, docs):
    words = spark.createDataFrame([("차단막", "접속차단")], "word string, variant string")
    asked = spark.createDataFrame([(1, "차단막")], "query_id int, query string")
    assert {r.doc_id for r in search.batch_search(docs, asked, FIELDS, synonyms=words).collect()} == {"D1", "D2"}


def test_score_and_rank(spark, docs):
    asked = spark.createDataFrame([(1, "예산")], "query_id int, query string")
    got = search.batch_search(docs, asked, FIELDS, k=2).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [("D3", 50.0), ("D1", 10.0)]


def test_filters(spark, docs):
    assert {r.doc_id for r in search.initials_filter(docs, "ㄱㅊㅅ", ["requester"]).collect()} == {"D1"}
    assert {r.doc_id for r in search.plan_filter(docs, [], ["title"], without=("예산",)).collect()} == {"D1", "D2", "D4"}
    assert search.plan_filter(docs, [], ["title"]).count() == 4
    assert {r.doc_id for r in search.plan_filter(docs, [["ㅂㅇ"], ["통계", "본문"]], ["title", "body"], initials=("title",)).collect()} == {"D2", "D3"}
    assert search.field_filter(docs, {"year": ["2026"]}).count() == 0
    assert {r.doc_id for r in search.field_filter(docs, {"requester": ["의원"]}).collect()} == {"D1", "D2"}


def test_term_frequencies_count(spark):
    docs = spark.createDataFrame([("a", "가나 가나 가나"), ("b", "가나 다라 마바"), ("c", "다라 마바 사아")], "doc_id string, body string")
    asked = spark.createDataFrame([(1, "가나")], "query_id int, query string")
    got = {r.doc_id: r.score for r in search.bm25(docs, asked, {"body": 1.0}).collect()}
    assert set(got) == {"a", "b"} and got["a"] > got["b"] > 0


def test_browser_score(spark):
    docs = spark.createDataFrame([("a", "예산 현황", "김철수", "본문"), ("b", "현황", "예산실", "예산 본문"), ("c", "예산", "x", "")], "doc_id string, title string, requester string, full_markdown string")
    score = lambda *args: {r.doc_id: r.score for r in search.browser_score(docs, *args).collect()}
    assert score([["예산"]]) == {"a": 35.0, "b": 38.0, "c": 60.0}
    assert score([["예산", "현황"], ["본문"]]) == {"a": 70.0, "b": 98.0}
    assert score([["ㅇㅅ"]]) == {"a": 35.0, "b": 30.0, "c": 35.0} and score([["예ㅅ"]]) == {"a": 40.0, "b": 35.0, "c": 40.0}
    assert score([["예산"]], ("산 현",)) == {"a": 85.0}


def test_dates_of_queries(spark):
    rows = spark.createDataFrame([(1, "2026-01-05", "예산"), (2, "2026-02-28", "예산"), (3, "", "예산"), (4, "2025-12-31", "현황")], "ledger_id int, request_date string, title string")
    asked = ["기간:2026-01..2026-02 예산", "date:..2025", "일자:2026.2", "date:2026.."]
    got = search.batch_search(rows, spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), {"title": 50.0}, "ledger_id").collect()
    assert {i: {r.ledger_id for r in got if r.query_id == i} for i in range(4)} == {0: {1, 2}, 1: {4}, 2: {2}, 3: {1, 2}}


INITIALS = ("title", "requester")


def test_index_gives_the_rows_of_a_scan(spark, docs, tmp_path):
    asked = spark.createDataFrame(list(enumerate([*CASES, "차단 현황을", '"기록과 통계"', "접속차단기록과통계", "a", "예산 통계 OR ㅈㅅㅊㄷ"])), "query_id int, query string")
    index = trigrams.TrigramIndex.build(search.search_text(docs, FIELDS, initials=INITIALS), str(tmp_path / "index"), parts=3)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(search.batch_search(docs, asked, FIELDS, initials=INITIALS, index=index)) == key(search.batch_search(docs, asked, FIELDS, initials=INITIALS))
    index = trigrams.TrigramIndex.build(search.search_text(docs, FIELDS), str(tmp_path / "plain"), parts=3)
    assert key(search.bm25(docs, asked, FIELDS, index=index)) == key(search.bm25(docs, asked, FIELDS))


def test_index_against_plain_search(spark, tmp_path, monkeypatch):
    """Random texts over a small alphabet, so that grams are shared, repeated and astral, and forms overlap themselves."""
    rng, letters = random.Random(7), "abA \u3000\U0001F600가"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    forms = {"".join(rng.choice("ab\U0001F600가") for _ in range(rng.randint(1, 6))) for _ in range(150)}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, body string")
    index = trigrams.TrigramIndex.build(search.search_text(docs, {"body": 2.0}), str(tmp_path / "index"), parts=5)
    norm = ["".join(t.split()).lower() for t in texts]
    want = sorted((f, i, n.count(f)) for f in forms for i, n in enumerate(norm) if f in n)
    asked = spark.createDataFrame([(f,) for f in forms], "variant string")
    got = sorted((r.variant, r.doc_id, r.n) for r in index.hits(asked, counted=True).filter("variant is not null").collect())
    assert got == want
    monkeypatch.setattr(trigrams, "NAMED", 3)
    monkeypatch.setattr(trigrams, "RAREST", 1)
    assert sorted((r.variant, r.doc_id, r.n) for r in index.hits(asked, counted=True).filter("variant is not null").collect()) == want
    assert index.hits(asked.limit(0)).count() == 0


def test_candidates_read_few_partitions(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i:04d} common text") for i in range(400)], "doc_id int, body string")
    index = trigrams.TrigramIndex.build(search.search_text(docs, {"body": 1.0}), str(tmp_path / "index"), parts=16)
    hits = index.hits(spark.createDataFrame([("word0123",)], "variant string"))
    files = hits._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[\(?part#\d+ (=|IN \()", files) or re.search(r"PartitionFilters: \[isnotnull\(part#\d+\), \(part#\d+ = \d+\)", files), files
    assert [(r.variant, r.doc_id) for r in hits.collect()] == [("word0123", 123)]


def test_browser_grammar(spark):
    asked = ["통계를 OR 본문", "가를 x", "a|b", '"차단 현황" -x. | 예산', "x-y, -z!", "OR 통계", "요구자:김 통계"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = {}
    for r in search.query_terms(q, browser=True).collect():
        got.setdefault(r.query_id, set()).add((r.group_no, r.kind, r.value, tuple(sorted(r.variants))))
    assert got[0] == {(0, "term", "통계를", ("통계", "통계를")), (1, "term", "본문", ("본문",))}
    assert got[1] == {(0, "term", "가를", ("가를",)), (0, "term", "x", ("x",))}  # a stem of one character is none
    assert got[2] == {(0, "term", "a|b", ("a|b",))}
    assert {x[1:3] for x in got[3]} == {("phrase", "차단현황"), ("not", "x."), ("extra", "예산")}
    assert {x[1:3] for x in got[4]} == {("term", "x-y,"), ("not", "z!")}
    assert {x[1:3] for x in got[5]} == {("term", "or"), ("term", "통계")}
    assert {x[1:3] for x in got[6]} == {("field", "김"), ("term", "통계")}


def test_mixed_terms_equal_a_pattern_for_each_pair(spark, tmp_path, monkeypatch):
    """Random terms of syllables, initials and letters against random texts, by a scan and beside an index."""
    from scribelake.functions.text import PARTICLES, hybrid_pattern

    rng = random.Random(11)
    letters = "가각나낙다닥까a B"
    rows = [(i, *["".join(rng.choice(letters + "ㄱㄴ") for _ in range(rng.randint(0, 14))) for _ in range(2)]) for i in range(80)]
    terms = sorted({"".join(rng.choice("가나다까aㄱㄴㄷㄲ") for _ in range(rng.randint(2, 4))) for _ in range(120)})
    terms = [t for t in terms if re.search("[ㄱ-ㅎ]", t) and re.search("[^ㄱ-ㅎ]", t) and not any(t.endswith(p) for p in PARTICLES)]  # no stems
    docs = spark.createDataFrame(rows, "doc_id int, title string, body string")
    fields = {"title": 2.0, "body": 1.0}
    asked = spark.createDataFrame(list(enumerate(terms)), "query_id int, query string")
    plain = lambda t: re.compile("(?i)" + "".join(re.escape(x) if x else y for x, y in re.findall(r"\\Q(.*?)\\E|(\[[^]]*\])", hybrid_pattern(t))))
    want = sorted((q, i) for q, t in enumerate(terms) for i, title, _ in rows if plain(t).search("".join(title.split())))
    assert len(want) > 100
    for most in (48, 0):
        monkeypatch.setattr(search, "MANY_FORMS", most)
        got = sorted((r.query_id, r.doc_id) for r in search.batch_search(docs, asked, fields, browser=True).collect())
        assert got == want
    index = trigrams.TrigramIndex.build(search.search_text(docs, fields), str(tmp_path / "index"), parts=3)
    assert sorted((r.query_id, r.doc_id) for r in search.batch_search(docs, asked, fields, browser=True, index=index).collect()) == want


def test_index_has_lists_and_its_hits_are_read_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"thequickbrownfoxjumpsoverthelazydog{i:03d}") for i in range(500)], "doc_id int, body string")
    index = trigrams.TrigramIndex.build(search.search_text(docs, {"body": 1.0}), str(tmp_path / "index"), parts=2)
    assert index.postings().count() <= 4 * spark.read.parquet(str(tmp_path / "index" / "grams")).count()  # a row a gram and block, not a row a gram and text
    asked = spark.createDataFrame([(0, "lazydog quick"), (1, "dog499")], "query_id int, query string")
    found = search.bm25(docs, asked, {"body": 1.0}, index=index)
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()  # its branches share what was looked up
    assert found.groupBy("query_id").count().orderBy("query_id").collect() == [(0, 500), (1, 1)]


def test_lookups_in_passes_and_pieces(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc\U0001F600가") for _ in range(rng.randint(0, 30))) for _ in range(90)]
    forms = sorted({"".join(rng.choice("abc\U0001F600가") for _ in range(rng.randint(3, 5))) for _ in range(60)})
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, body string")
    index = trigrams.TrigramIndex.build(search.search_text(docs, {"body": 1.0}), str(tmp_path / "index"), parts=3)
    monkeypatch.setattr(search, "PASS_FORMS", 10)
    hits = index.hits(spark.createDataFrame([(f,) for f in forms], "variant string"))
    assert sorted((r.variant, r.doc_id) for r in hits.collect()) == sorted((f, i) for f in forms for i, t in enumerate(texts) if f in t)
    monkeypatch.setattr(trigrams, "GRAMS_AT_ONCE", 40)
    rows = [(i % 2, i // 20, i % 20, t) for i, t in sorted(enumerate(texts), key=lambda x: (x[0] % 2, x[0] // 20))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[s : s + 7]), (pa.int32(), pa.int64(), pa.int32(), pa.string()))], ["part", "block", "place", "text"]) for s in range(0, len(rows), 7)]
    pieces = [r for b in trigrams._postings(iter(batches)) for r in b.to_pylist()]
    code = lambda g: ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])
    got = sorted((r["gram"], r["part"], r["block"], int(p)) for r in pieces for p in np.frombuffer(r["places"], "<u2"))
    assert got == sorted((code(g), part, block, place) for part, block, place, t in rows for g in {t[i : i + 3] for i in range(len(t) - 2)})
    assert all(r["texts"] * 2 == len(r["places"]) for r in pieces)
