"""One corpus as an object: load, count, keywords in context, variants, shards; also as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import index, search, variants


class Corpus:
    """Documents (doc_id, text, metadata columns) with the queries of a concordance."""

    def __init__(self, docs: DataFrame):
        self.docs = docs

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Corpus:
        return cls(spark.read.parquet(path))

    def drop(self) -> None:
        self.docs.unpersist()

    def size(self) -> int:
        return self.docs.count()

    def count(self, pattern: str) -> int:
        return search.count_total(self.docs, pattern).first().hits

    def count_with_variants(self, word: str, risky: bool = False) -> DataFrame:
        """ord, form, ratio, base, hits of the word and its variants."""
        rows = variants.variant_rows(word, risky)
        table = self.docs.sparkSession.createDataFrame(rows, "ord int, form string, ratio int, base boolean")
        return table.join(F.broadcast(search.count_by_form(self.docs, [r[1] for r in rows]).drop("form")), "ord")  # at most 48 forms

    def kwic(self, pattern: str | list[str], width: int = search.WIDTH, max_rows: int | None = search.MAX_ROWS) -> DataFrame:
        return search.kwic(self.docs, pattern, width, max_rows)

    def variants(self, word: str, risky: bool = False) -> list[tuple[int, str, int, bool]]:
        return variants.variant_rows(word, risky)

    def shards(self, target: int = 6_000_000) -> DataFrame:
        return index.doc_offsets(index.shard_plan(self.docs.select("doc_id", F.octet_length("text").alias("bytes")), target))

    @staticmethod
    def format_version() -> int:
        return index.FORMAT_VERSION

    def views(self, prefix: str = "") -> None:
        """documents, and the rule tables, as temporary views for SQL."""
        spark = self.docs.sparkSession
        self.docs.createOrReplaceTempView(f"{prefix}documents")
        spark.createDataFrame([(r.old, r.new, r.medial, r.on, r.ratio) for r in variants.RULES], "old string, new string, medial boolean, on_by_default boolean, ratio int").createOrReplaceTempView(f"{prefix}rules")
        spark.createDataFrame(variants.LONG, "old string, new string").createOrReplaceTempView(f"{prefix}long_vowels")
