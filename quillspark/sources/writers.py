"""Sinks: selection with digest, texts, reports, metadata, shards, calibration, event append, star-schema CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.store import table
from quillspark.operators import eventlog

# Spelling kinds and genres of the user interface, with the default for others.
KANA = {"新字新仮名": 0, "新字旧仮名": 1, "旧字旧仮名": 2, "旧字新仮名": 3, "その他": 4}
GENRES = {"NDC 913": "小説", "NDC 914": "随筆", "NDC 911": "詩歌", "NDC K913": "児童", "NDC 915": "紀行", "NDC 912": "戯曲", "NDC 933": "英米文学", "NDC 953": "仏文学", "NDC 943": "独文学", "NDC 983": "露文学", "NDC 289": "伝記", "NDC 910": "日本文学"}


def digest(rows: DataFrame, columns: list[str], key: str) -> str:
    """SHA-256 over the digests of blocks of rows in key order: the same for the same rows, however they are spread."""
    line = F.concat_ws("\t", *(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\t"), F.lit(" ")) for c in columns))
    blocks = rows.select(F.floor(F.col(key).cast("long") / 4096).alias("b"), F.struct(F.col(key).cast("long").alias("k"), line.alias("x")).alias("r"))
    by = blocks.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]), "\n"), 256).alias("h"))
    whole = by.groupBy(F.floor(F.col("b") / 65536).alias("g")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda r: r["h"]), "\n"), 256).alias("h"))
    top = whole.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda r: r["h"]), "\n"), 256)).first()
    return top[0]


def selection(rows: DataFrame, path: str, columns: list[str], key: str) -> str:
    """Tab-separated rows in key order; returns the digest."""
    clean = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\t"), F.lit(" ")).alias(c) for c in columns]
    rows.orderBy(F.col(key).cast("long")).select(*clean).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    return digest(rows, columns, key)


def texts(rows: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """The whole set of texts anew: what the input lacks is gone afterwards."""
    rows.select(key, text).write.mode("overwrite").parquet(path)


def fetch_report(fetched: DataFrame, selected: int | None = None, raw: DataFrame | None = None, elapsed: float = 0.0) -> DataFrame:
    """selected, attempted, ok, failed, fails (id and problem), raw_files, raw_bytes, elapsed_sec and whether failures stay within two
    per cent. raw: all stored texts, without it the fetched ones. Failures are listed whole; they are few, or `within` is false."""
    bad = F.col("problem").isNotNull()
    listed = F.array_sort(F.collect_list(F.when(bad, F.struct("doc_id", "problem"))))
    out = fetched.agg(F.count("*").alias("attempted"), F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"), listed.alias("fails"))
    kept = (raw if raw is not None else fetched.where(~bad)).agg(F.count("*").alias("raw_files"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("raw_bytes"))
    whole = out.crossJoin(F.broadcast(kept))  # one row each
    total = F.col("attempted") if selected is None else F.lit(selected).cast("long")
    return whole.select(total.alias("selected"), *out.columns, *kept.columns, F.round(F.lit(float(elapsed)), 1).alias("elapsed_sec"), (F.col("failed") * 50 <= F.col("attempted")).alias("within"))


def author_name(surname: str = "姓", name: str = "名") -> Column:
    return F.concat(F.coalesce(F.col(surname), F.lit("")), F.coalesce(F.col(name), F.lit("")))


def class_code(column: str = "分類番号") -> Column:
    """The first of codes separated by slashes; the empty text without one."""
    return F.trim(F.get(F.split(F.coalesce(F.col(column), F.lit("")), "/"), F.lit(0)))


def works(normalized: DataFrame, excluded: DataFrame, path: str) -> None:
    """The works, in id order, and the excluded ones with their reasons, as JSON lines in two folders, and their number: a summary."""
    normalized.orderBy(F.col("id").cast("long")).write.mode("overwrite").json(f"{path}/works")
    excluded.select("id", "title", "reason").write.mode("overwrite").json(f"{path}/excluded")
    counts = normalized.agg(F.count("*").alias("n")).crossJoin(excluded.agg(F.count("*").alias("excluded")))  # one row each
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def coded(column: Column, table: dict, default) -> Column:
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(m, column), F.lit(default))


def metadata(works: DataFrame) -> DataFrame:
    """id, title, author, kana code, genre, chars."""
    return works.select(F.col("id").cast("long").alias("id"), "title", "author", coded(F.col("kana"), KANA, 4).alias("kana"), coded(F.col("ndc"), GENRES, "その他").alias("genre"), "chars")


def shards(planned: DataFrame, path: str, key: str = "doc_id") -> None:
    """A folder for each shard; rows of a shard meet in the tasks of its key, sorted."""
    planned.repartition("shard_id").sortWithinPartitions("shard_id", key).write.mode("overwrite").partitionBy("shard_id").parquet(path)


def calibration(ratios: DataFrame, probes: DataFrame, docs: DataFrame, old: Column) -> DataFrame:
    """One JSON document a rule: hits, ratios and probes, and in each the number of works and of those in the old spelling."""
    by = probes.groupBy("rule").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("form", F.struct("hits", "old"))))).alias("probes"))
    totals = docs.agg(F.count("*").alias("works"), F.count_if(old).alias("old_kana_works"))
    joined = ratios.join(by, "rule").crossJoin(F.broadcast(totals))  # one row
    return joined.select("rule", F.to_json(F.struct("works", "old_kana_works", "hits", "old_hits", "old_ratio", "old_ratio_pct", "probes")).alias("json"))


def ranking(ranked: DataFrame, path: str) -> None:
    """The ranking as JSON lines, best first."""
    ranked.orderBy(F.desc("score"), "id").write.mode("overwrite").json(path)


def append_events(rows: DataFrame, path: str, log: DataFrame | None = None) -> int:
    """Appends rows without errors as JSON lines; returns how many had errors and stayed out. With the log that is there already, rows
    that may not follow it stay out, too (see eventlog.append_errors)."""
    checked = eventlog.record_errors(rows)
    if log is not None:
        checked = eventlog.append_errors(checked, log).withColumn("errors", F.concat("errors", "refused")).drop("refused")
    checked = table(checked, "appended")
    bad = checked.where(F.size("errors") > 0).count()
    checked.where(F.size("errors") == 0).select("file", F.to_json(F.struct(*eventlog.ENVELOPE[:-1], F.parse_json("data").alias("data"))).alias("value")).write.mode("append").partitionBy("file").text(path)
    return bad


def star_schema(tables: dict[str, list[DataFrame]], path: str) -> None:
    """CSV with header and byte order mark; parts of a table are joined by name, missing columns are empty."""
    for name, parts in tables.items():
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.unionByName(more, allowMissingColumns=True)
        first, *rest = whole.columns
        whole.select(F.col(f"`{first}`").alias("﻿" + first), *(F.col(f"`{c}`") for c in rest)).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
