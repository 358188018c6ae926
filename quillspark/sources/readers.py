"""Sources: catalogue, ranking, selection, text folders, zipped texts, event logs, taxonomies. Schemas are fixed, never inferred."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.frames import sums_before

# Columns of the catalogue and of the selection.
CATALOGUE = ["作品ID", "作品名", "姓", "名", "文字遣い種別", "分類番号", "テキストファイルURL", "作品著作権フラグ"]
SELECTION = [*CATALOGUE[:-1], "順位スコア"]


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue's CSV (UTF-8 with a byte order mark); ids stay text, they have leading zeros."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    named = raw.toDF(*(c.lstrip("﻿") for c in raw.columns))
    return named.select(*(F.col(f"`{c}`").cast("string").alias(c) if c in named.columns else F.lit(None).cast("string").alias(c) for c in CATALOGUE))


def ranking(spark: SparkSession, path: str) -> DataFrame:
    """id, score, months, best_rank, title from the ranking's JSON."""
    schema = "works array<struct<id:string,score:long,months:long,best_rank:int,title:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("works").alias("w")).select("w.*")


def selection(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"`{c}` {'long' if c == SELECTION[-1] else 'string'}" for c in SELECTION)
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def corpus_folder(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's stem as a number), text: one row a file; files without a byte give none."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    return files.select(stem(F.input_file_name()).try_cast("long").alias("doc_id"), F.col("value").alias("text"))


def capped(docs: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """Documents in key order until the limit of bytes is reached (the one that crosses it is kept).

    A running sum over blocks of keys, then within the last block, so no task sees all rows.
    """
    sized = docs.withColumn("_n", F.octet_length("text").cast("long")).withColumn("_b", F.floor(F.col(key) / 4096))
    blocks = sized.groupBy("_b").agg(F.sum("_n").alias("_s"))
    blocks = sums_before(blocks, "_b", "_s", "_base").select("_b", "_base")
    w = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = sized.join(blocks, "_b").withColumn("_at", F.col("_base") + F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return out.where(F.col("_at") < limit).drop("_n", "_b", "_base", "_at")


def decoded(blob: bytes, *kinds: str) -> str:
    """The first of the encodings that fits; the last one with replacement characters. By default Windows' Shift-JIS, then UTF-8."""
    kinds = kinds or ("cp932", "utf-8")
    for kind in kinds[:-1]:
        try:
            return blob.decode(kind)
        except UnicodeDecodeError:
            pass
    return blob.decode(kinds[-1], "replace")


def web_pages(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """name (the file's stem), html: pages in UTF-8, else in Windows' Shift-JIS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decoded(x.as_py(), "utf-8", "cp932") for x in b.column("content")]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string())], ["path", "html"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(run, "path string, html string").select(stem(F.col("path")).alias("name"), "html")


def zipped_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text, problem: the first .txt member of each archive. Archives need a Python function, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, problem = None, None
                try:
                    with zipfile.ZipFile(io.BytesIO(b.column("content")[i].as_py())) as z:
                        member = next((n for n in z.namelist() if n.lower().endswith(".txt")), None)
                        text, problem = (decoded(z.read(member)), None) if member else (None, "no text")
                except zipfile.BadZipFile:
                    problem = "bad archive"
                yield pa.RecordBatch.from_arrays([b.column("path").slice(i, 1), pa.array([text], pa.string()), pa.array([problem], pa.string())], ["path", "text", "problem"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, text string, problem string").select(stem(F.col("path")).try_cast("long").alias("doc_id"), "text", "problem")


def works(spark: SparkSession, path: str) -> DataFrame:
    """Normalised works of works.json."""
    acc = ",".join(f"{k}:long" for k in "note ruby pipe trailing_ws title legend footer dash blank edge in out balance".split())
    work = f"id:string,title:string,author:string,kana:string,ndc:string,raw_chars:long,chars:long,lines:long,utf8:long,forms:struct<title:string,legend:string,footer:string>,acc:struct<{acc}>"
    return spark.read.schema(f"n long, works array<struct<{work}>>").option("multiLine", True).json(path).select(F.explode("works").alias("w")).select("w.*")


def probe_sample(spark: SparkSession, path: str) -> DataFrame:
    record = "id:string,title:string,author:string,kana:string,ndc:string,zip:long,raw_chars:long,body_chars:long,body_utf8:long"
    return spark.read.schema(f"seed long, cap long, pop long, selected long, n long, records array<struct<{record}>>").option("multiLine", True).json(path)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of JSON-lines logs; files are small, each is read as one text so that line numbers are those of the file."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.jsonl")
    rows = files.select(stem(F.input_file_name()).alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("p", "value"))
    return rows.select("file", (F.col("p") + 1).cast("long").alias("line"), "value")


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """code, category, category_name, name, definition."""
    schema = "categories map<string,string>, codes map<string,struct<category:string,name:string,definition:string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = raw.select("categories", F.explode("codes").alias("code", "c"))
    return rows.select("code", "c.category", F.try_element_at("categories", F.col("c.category")).alias("category_name"), "c.name", "c.definition")


def numstat(spark: SparkSession, path: str) -> DataFrame:
    """added, deleted, file of a change listing; binary files (-) count 0."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(parts) == 3)
    count = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(0))
    return rows.select(count(0).alias("added"), count(1).alias("deleted"), F.get(parts, F.lit(2)).alias("file"))


def index_table(spark: SparkSession, path: str, version: int) -> DataFrame:
    """An index table after its version has been checked; Parquet's footers and column pruning do the partial reads."""
    df = spark.read.parquet(path)
    found = df.select("format_version").distinct().limit(2).collect()
    if [r.format_version for r in found] != [version]:
        raise ValueError(f"format versions {[r.format_version for r in found]}, wanted {version}")
    return df


def diff_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, no, value of unified diffs, one text a file; operators.eventlog.added_lines takes them."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.diff")
    return files.select(stem(F.input_file_name()).alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("no", "value"))
