import datetime
import random
import re

from pyspark.sql import functions as F

from scribelake.functions import dates, metadata, text


def values(spark, column, rows, *names):
    names = names or ("c",)
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.coalesce(1).select(column).collect()]


# the cases of the masking rules, and texts that look like them
CASES = [
    "담당자010-1234-5678", "010.1234.5678", "x-010-1234-5678", "(010)1234-5678", "010)1234-5678", "010 1234 5678", "010\t1234\n5678", "010-1234-5678-1",
    "0110-123-4567", "01012345678", "1010-1234-5678", "주민번호900101-1234567", "900101 2234567", "900101.1234567", "900101-5234567",
    "-900101-1234567", "a900101-1234567", "9001011234567", "12345678901234",
    "abc@gov.kr", "a@b.co", "x.y@c@d.com", "@@a.com", "홍길동abc@gov.kr입니다", "-ab@x.org-", "ab@c.de@f.gh", "ab@c.com-x",
    "%a@b.cc", "ab@c.d", "mail:first.last+tag@sub.example.com.", "", "문의 010-9999-0000, kim@example.kr",
]


def plain_mask(t):
    """The rules as three plain patterns."""
    t = re.sub(r"(?<![\d-])(01[016789])[-.\s)]?(\d{3,4})[-.\s]?(\d{4})(?!\d)", r"\1-****-\3", t)
    t = re.sub(r"(?<![\d-])(\d{6})[-.\s]?([1-4])\d{6}(?!\d)", r"\1-\2******", t)
    short = lambda m: (m[1][0] + "*" if len(m[1]) <= 2 else m[1][:2] + "***") + "@" + m[2]
    return re.sub(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,})(?![A-Za-z0-9-])", short, t)


def test_masking(spark):
    rng = random.Random(20)
    rows = CASES + ["".join(rng.choice("0000111123456789-. )(@@aZ._%+가나\n\u3000") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    assert values(spark, text.mask_pii("c"), rows) == [plain_mask(t) for t in rows]
    assert values(spark, text.mask_pii("c"), [None]) == [""]


def test_nospace_lower(spark):
    assert values(spark, text.nospace_lower("c"), ["A　b C\x1cd\n", None]) == ["abcd", ""]


def test_strip_suffix(spark):
    assert values(spark, text.strip_suffix("c"), ["현황에서는", "자료를", "가을", "서울", "국회에서도", "부서에게는", "서류하고", "예산이나"]) == ["현황", "자료", "가을", "서울", "국회", "부서", "서류하고", "예산"]


def test_choseong(spark):
    assert values(spark, text.choseong("c"), ["예산 서A", "ㄱ"]) == ["ㅇㅅㅅa", "ㄱ"]
    assert re.search(text.hybrid_pattern("예ㅅ").replace("(?i)", "").replace("\\Q", "").replace("\\E", ""), "예산")


def test_positions_and_snippet(spark):
    many = "ab " * 500
    assert values(spark, text.match_positions("c", "ab"), ["xABab", "", None, many]) == [[1, 3], [], [], list(range(0, 1500, 3))]
    assert values(spark, text.earliest_snippet("c", ["zz", "nee dle"]), ["x" * 50 + "NEE  DLE tail"])[0].startswith("x" * 40 + "NEE  DLE")
    got = values(spark, text.agent_snippet("c", "a needle x2"), ["y" * 100 + "Needle" + "z" * 100, "none", None])
    assert [tuple(r) for r in got] == [("…" + "y" * 60 + "Needle" + "z" * 60 + "…", 40, 166, True), ("none", None, None, False), ("", None, None, False)]
    got = values(spark, text.agent_snippet("c", "needle", limit=100), [" " * 70 + "needle ", "x" * 101, " \u3000x ", "q" * 60 + "needle" + "q" * 60])
    assert [tuple(r) for r in got] == [("…needle", 10, 17, False), ("x" * 100 + "…", None, None, True), ("x…", None, None, True), ("q" * 60 + "needle" + "q" * 34 + "…", None, None, True)]
    assert text.highlight_terms('"a b" -no OR word year:2020 ㅇㅅ x') == ["a b", "word"]
    assert values(spark, text.snippet("c", ["needle"], 3), ["0123456789 Needle tail"]) == ["…89 Needle ta…"]
    assert values(spark, text.snippet("c", ["none"], 3, 4), ["0123456789"]) == ["0123"]


def test_csv_cell(spark):
    assert values(spark, text.csv_cell("c"), ["=1+1", "ok", "@x", None]) == ["'=1+1", "ok", "'@x", ""]


AS_OF = datetime.date(2026, 1, 10)


def test_ledger_dates(spark):
    want = {
        "2026-02-31": "2026-02-31", "2026.3.5": "2026-03-05", "26. 1. 7": "2026-01-07", "9. 14": "2026-09-14", "0914": "2026-09-14", "20260102": "2026-01-02", "260102": "2026-01-02", "미정": "미정",
        "2026년 3월 5일(목)": "2026-03-05", "991231": "991231", "2026.3.5(월요일)": "2026-03-05", "99.12.31": "99.12.31", "2026/9/10(수)": "2026-09-10", "0231": "0231", "251345": "251345", "2026-01-02 10:00": "2026-01-02",
        "13/45": "13/45", "2/3 (화)": "2026-02-03", "": "", "2026. 2. 30": "2026. 2. 30",
    }
    assert dict(zip(want, values(spark, dates.normalize_ledger_date("c", F.lit("2026"), AS_OF), [(x,) for x in want]))) == want
    assert values(spark, dates.strict_date("c", F.lit("2026"), AS_OF), [("2026-02-31",), ("",), ("9. 14",)]) == [None, "", "2026-09-14"]


def test_partial_dates(spark):
    rows = ["2026", "2026-02", "2026.2.3", "x", None, "2026-13", "26-4-"]
    assert values(spark, dates.normalize_date("c"), rows) == ["2026-01-01", "2026-02-01", "2026-02-03", "", "", "2026-13-01", "0026-04-01"]
    assert values(spark, dates.normalize_date("c", True), rows) == ["2026-12-31", "2026-02-28", "2026-02-03", "", "", "2026-13-28", "0026-04-30"]


def test_due_state(spark):
    rows = [("2025-12-31", "작성중"), ("2026-01-13", ""), ("", None), ("2026-02-30", "작성중"), ("2025-01-01", "제출"), ("2026-03-01", "작성중"), ("2026.1.5", ""), ("2026/1/12 (월)", ""), ("2026-1-5", None), ("1.5", "")]
    want = ["overdue", "soon", "none", "none", "done", "later", "overdue", "soon", "overdue", "none"]
    assert values(spark, dates.due_state("d", "s", AS_OF), rows, "d", "s") == want
    assert values(spark, dates.status_label("c"), ["", "제출", None]) == ["미제출", "제출", "미제출"] and values(spark, dates.status_class("c"), ["", "제출", "x"]) == ["open", "done", "working"]


def test_metadata(spark):
    names = [("20260105 자료.hwp", "", ""), ("x_260105.hwp", "", ""), ("x", "2024/", "2025. 3. 9 회의"), ("2월 국회 보고", "2024/a/", ""), ("x", "", "")]
    got = values(spark, metadata.document_date("n", "p", "b", AS_OF), names, "n", "p", "b")
    assert got == ["2026-01-05", "2026-01-05", "2025-03-09", "2024-02-01", ""]
    assert values(spark, metadata.document_year("n", "p", F.lit("")), names, "n", "p", "b") == ["2026", "2026", "2024", "2024", ""]
    asked = [("홍길동 의원 자료", "", ""), ("자료", "과방위/2024/", ""), ("자료", "", "김철수 의원실 귀중"), ("한겨레 김기자 기자 질의", "", ""), ("언론 질의", "", ""), ("자료", "a/", "없음")]
    got = [tuple(r) for r in values(spark, metadata.institution_and_requester("n", "p", "b"), asked, "n", "p", "b")]
    assert got == [("국회", "홍길동 의원"), ("국회 과방위", "과학기술정보상급감독기관"), ("국회", "김철수 의원"), ("언론/기자", "한겨레 (김기자 기자)"), ("언론/기자", "언론사 질의"), ("기타", "미분류")]
    assert values(spark, metadata.version_label("c", F.lit("a/참고자료/")), ["x 수정", "x 초안 수정", "x"]) == ["수정본", "초안", "참고자료"]
    assert values(spark, metadata.title_of("n", "p"), [("20240101_보고.hwp", "a/x.md"), ("보고.hwp.md", "2024_국감/보고.hwp.md")], "n", "p") == ["보고", "국감 (보고)"]
    assert values(spark, metadata.target_year("c"), ["a/250314 2023.hwp"]) == ["2025"] and values(spark, metadata.target_year("c", year_first=True), ["a/250314 2023.hwp"]) == ["2023"]
    assert values(spark, metadata.table_count("c"), ["<table><tr></table>\n| --- | --- |", "x", None]) == [2, 0, 0]
    assert values(spark, metadata.default_status("s", "d"), [("", ""), ("", "2026-01-01"), ("작성중", "")], "s", "d") == ["미제출", "완료", "작성중"]
    assert values(spark, metadata.topic_tags("c"), ["텔레그램과 AI", "없음", None]) == [["텔레그램", "인공지능/탐지"], [], []]
    body = "1. 접속차단 현황은?\n2) 참고 자료\n□ 조치는 했는가?\n□ 짧?\n| 3. 표 |\n(4) 접속차단 현황은?\n【질의 5】 예산\n【전담팀 홍길동】"
    assert values(spark, metadata.question_list("c"), [body]) == ["1. 접속차단 현황은?\n2. 조치는 했는가?\n3. 예산"]
    assert values(spark, metadata.contacts("c"), [body]) == ["질의 5 / 전담팀 홍길동"] and values(spark, metadata.departments("c"), [body]) == [["전담팀"]]
    first, many = "이것은 열다섯 글자보다 긴 답변의 줄입니다", ("긴 " * 200).strip()
    assert values(spark, metadata.answer_summary("c"), [f"○ 짧음\n- {first}\n□ {many}"]) == [f"{first} {many}"[:297] + "..."]


def plain_split(title, body):
    """The splitter as one plain loop over the lines, for documents of the test."""
    numbered, boxed, asked = map(re.compile, (metadata.NUMBERED, metadata.BOXED, metadata.ASKED))
    heads, table = [], False
    lines = body.splitlines()
    for i, line in enumerate(x.strip() for x in lines):
        table = table or "<table" in line.lower()
        if "</table" in line.lower():
            table = False
            continue
        m = numbered.match(line) or boxed.match(line)
        q = None if m else asked.match(line)
        name = (m[2] if m else q[1] if q else "").strip().replace("*", "")
        if not table and (m or q) and len(name) >= (2 if m else 4) and not name.startswith(metadata.NO_QUESTION) and not line.startswith(metadata.MARKUP):
            heads.append((i, ((m[1] if m else None) or "질의") + " " + name, name))
    out, seen = [], {}
    for (i, full, name), end in zip(heads, [h[0] for h in heads[1:]] + [len(lines)]):
        key, below = re.sub(r"[\s\d().\-_]", "", name), "\n".join(lines[i + 1 : end]).strip()
        item = (full, below if len(below) > 20 else "\n".join(lines[i:end]).strip(), len(below))
        if key and key in seen:
            old = out[seen[key]][2]
            if old <= 30 and len(below) > old:
                out[seen[key]] = item
            elif len(below) > 30 or old <= len(below):
                out.append(item)
            continue
        if key:
            seen[key] = len(out)
        out.append(item)
    return [(a, b) for a, b, _ in out] or [(title, body)]


def test_split_questions(spark):
    body = "머리\n1. 접속차단 현황\n짧음\n2. 접속차단 현황\n" + "긴 답변 " * 10 + "\n<table>\n3. 표 안\n</table>\n4. 다른 질의\n답"
    df = spark.createDataFrame([("D1", "제목", body, "2024"), ("D2", "제목2", "질문 없음", None), ("D3", "제목3", None, None)], "doc_id string, title string, full_markdown string, year string")
    got = {(r.doc_id, r.q_num): r for r in metadata.split_questions(df).collect()}
    assert [got["D1", i].question_title for i in (1, 2)] == ["2. 접속차단 현황", "4. 다른 질의"] and got["D1", 1].qa_id == "D1-Q1" and got["D1", 1].year == "2024"
    assert got["D1", 1].answer_markdown.startswith("긴 답변") and got["D1", 1].has_tables == "Y" and got["D1", 2].answer_markdown == "4. 다른 질의\n답"
    assert got["D2", 1].question_title == "제목2" and got["D3", 1].answer_markdown == "" and len(got) == 4


def test_split_equals_a_plain_loop_by_document(spark):
    rng = random.Random(5)
    line = ["1. 접속차단 현황", "2) 접속차단 현황", "질의 3. 예산", "(4) 참고", "**① 인력 현황**", "□ 질의 예산은", "□ 왜 늦었는가?", "□ 왜?", "<table>", "</table>", "| 5. 표 |", "짧은 답", "아주 긴 답변의 줄이 여기에 있다 " * 2, "", "가. 3 (1)", "[질의 7] 계획"]
    docs = [(f"D{i}", f"제목{i}", "\n".join(rng.choice(line) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    docs.append(("long", "t", "\n".join(f"{k % 90}. 질의 {'가나다라마'[k % 5] * (k % 7 + 1)}" if k % 3 == 0 else "답변 줄" for k in range(100_000))))
    df = spark.createDataFrame(docs, "doc_id string, title string, full_markdown string").repartition(3)
    by_group = df.groupBy("doc_id").applyInPandas(lambda pdf: _frame(pdf), "doc_id string, q_num int, question_title string, answer_markdown string")
    key = lambda rows: sorted((r.doc_id, r.q_num, r.question_title, r.answer_markdown) for r in rows)
    assert key(metadata.split_questions(df).collect()) == key(by_group.collect())


def _frame(pdf):
    import pandas as pd

    r = pdf.iloc[0]
    return pd.DataFrame([(r.doc_id, k, q, a) for k, (q, a) in enumerate(plain_split(r.title, r.full_markdown), 1)], columns=["doc_id", "q_num", "question_title", "answer_markdown"])


def test_years_inside_longer_numbers(spark):
    paths = ["d/12035.hwp", "d/20351.hwp", "12023x/a.hwp", "d/2023.hwp", "20230105 a.hwp", "a_202301.hwp", "x 2024 y/a.hwp", "a2024년.hwp"]
    assert values(spark, metadata.target_year("c"), paths) == ["미분류", "미분류", "미분류", "2023", "2023", "2023", "2024", "2024"]


def test_numbered_sources_have_no_year(spark, tmp_path):
    from scribelake.plans import corpus_queries

    spark.range(6000, 6030).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    plan = corpus_queries.layout_plan(spark, str(tmp_path)).collect()
    assert {r.source_path: r.move_to for r in plan} == {f"d/{n}.hwp": f"미분류/{n}.hwp.md" for n in range(2000, 2010) if n % 4}
