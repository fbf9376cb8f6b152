"""Sources: Markdown corpora, file listings, ledger extracts, JSON caches, identifier maps."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.functions.dates import normalize_ledger_date
from scribelake.functions.text import mask_pii, nonblank, source_header, strip_source_header

# Ledger fields and the headings they go by; the first that is there and not empty wins.
LEDGER_ALIASES = {
    "seq_no": ("연번", "순번", "No", "No."),
    "party": ("소속", "정당", "위원회", "소속정당", "소속위원회", "상임위"),
    "requester": ("의원", "요구자", "의원명", "요구의원", "의원/기관", "요구기관"),
    "aide": ("보좌관", "보좌진", "비서관"),
    "title": ("요구자료", "요구자료명", "제목", "건명", "자료명", "질의제목"),
    "details": ("세부내역", "세부요구내역", "세부내용", "내용", "상세내역"),
    "request_date": ("요구일", "접수일자", "요구일자", "접수일", "일자"),
    "deadline": ("마감일", "마감일자", "제출기한", "기한"),
    "submit_date": ("제출일", "제출일자", "완료일", "회신일"),
    "department": ("부서", "담당부서", "소관부서", "처리부서"),
    "status": ("제출", "제출여부", "진행상태", "상태"),
    "note": ("비고", "비고사항", "메모"),
    "request_type": ("요청형태", "요청구분", "형태", "구분"),
    "ledger_id": ("대장ID", "ledger_id", "관리번호"),
}


def markdown(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """path, source header, masked body of every Markdown file below ``path``."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("body"))
    return rows.select("path", "modified", source_header("body").alias("header"), mask_pii(strip_source_header("body")).alias("full_markdown"))


def file_listing(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("hwp", "hwpx", "xlsx", "pdf"), skip: str = r"/(?:\.|★|_backup)[^/]*/|/~\$") -> DataFrame:
    """path, modified and size of source files; contents are pruned from the scan."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return rows.filter(F.lower("path").rlike(r"\.(?:" + "|".join(extensions) + ")$")).filter(~F.col("path").rlike(skip))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def aliased(df: DataFrame, names: tuple[str, ...]) -> Column:
    """First non-empty of the columns that exist, whatever white space is around their headings."""
    there = {c.strip(): c for c in reversed(df.columns)}
    return F.coalesce(*[nonblank(F.col(f"`{there[n]}`").cast("string")) for n in names if n in there], F.lit(""))


def ledger_extracts(extracts: dict[str, DataFrame], aliases: dict[str, tuple[str, ...]] | None = None, as_of: datetime.date | None = None) -> DataFrame:
    """One table from an extract per year. Rows without number, title, details and requester are left out.

    With ``as_of``, dates are normalised with the year of their sheet.
    """
    parts = []
    for year, df in extracts.items():
        fields = {f: aliased(df, names) for f, names in (aliases or LEDGER_ALIASES).items()}
        if as_of:
            fields |= {f: normalize_ledger_date(fields[f], F.lit(year), as_of) for f in ("request_date", "deadline", "submit_date") if f in fields}
        parts.append(df.select(F.lit(year).alias("year"), *[c.alias(f) for f, c in fields.items()]))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.filter("seq_no <> '' or title <> '' or details <> '' or requester <> ''")


def read_ledger(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    return ledger_extracts({y: spark.read.csv(p, header=True) for y, p in paths.items()})


def json_cache(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The arrays of one JSON object as tables; ``schemas`` gives the struct of each."""
    whole = ", ".join(f"{k} array<struct<{v}>>" for k, v in schemas.items())
    raw = spark.read.schema(whole).option("multiLine", True).json(path)
    return {k: raw.select(F.inline(k)) for k in schemas}


def json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An older cache: a bare JSON list of rows."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def id_map(sources: list[DataFrame]) -> DataFrame:
    """(kind, value, old_id) from tables with parsed_md_path, original_path and content_hash; a later source wins."""
    parts = []
    for n, df in enumerate(sources):
        pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("path", "parsed_md_path"), ("source", "original_path"), ("hash", "content_hash"))])
        parts.append(df.select("doc_id", F.inline(pairs), F.lit(n).alias("n")))
    every = reduce(DataFrame.unionByName, parts).filter("coalesce(value, '') <> ''")
    return every.groupBy("kind", "value").agg(F.max_by("doc_id", F.struct("n", "doc_id")).alias("old_id"))


def synonyms(spark: SparkSession, words: dict[str, list[str]]) -> DataFrame:
    """(word, variant) rows of a dictionary, lower-case, the word itself included."""
    rows = [(w.lower(), v.lower()) for w, more in words.items() for v in dict.fromkeys([w, *more])]
    return spark.createDataFrame(rows, "word string, variant string").distinct()


def synonym_file(spark: SparkSession, path: str) -> DataFrame:
    """(word, variant) rows of a JSON file of lines ``{"word": ..., "variants": [...]}``; the word itself included."""
    raw = spark.read.schema("word string, variants array<string>").json(path)
    every = F.array_append(F.coalesce("variants", F.array().cast("array<string>")), F.col("word"))
    rows = raw.select("word", F.explode(every).alias("variant"))
    return rows.select(F.lower("word").alias("word"), F.lower("variant").alias("variant")).filter("word <> '' and variant <> ''").distinct()


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest (path, sha256) against files: missing, changed or same."""
    now = files.select("path", F.col("sha256").alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed").otherwise("same")
    return manifest.join(now, "path", "left").select("path", state.alias("state"))
