"""Corpus selection: population, first row of each id, capped selection, popularity ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(rows: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def population(rows: DataFrame, flag: Column, free: str, url: Column, suffix: str = ".zip") -> DataFrame:
    """Rows with the free flag and an address of the wanted kind; a missing address does not count."""
    return rows.where((flag == free) & F.endswith(F.coalesce(url, F.lit("")), F.lit(suffix)))


def select_capped(pop: DataFrame, cap: int, target: int, author: str = "author", score: str = "score", key: str = "id") -> DataFrame:
    """At most `cap` works of an author by score, then one more of each as a refill, until `target` are chosen.

    The greedy sweeps (ranked, unranked, ranked again, unranked again) choose what an author's row number and one global order
    choose. A null score means unranked. Ties go to the smaller key.
    """
    ranked = F.col(score).isNotNull()
    w = Window.partitionBy(author).orderBy(F.desc(ranked), F.desc(score), key)
    rows = pop.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap + 1)
    refill = F.col("rn") == cap + 1
    return rows.withColumn("refill", refill).orderBy(refill, F.desc(ranked), F.desc(score), key).limit(target)


def author_counts(selected: DataFrame, author: str = "author") -> DataFrame:
    return selected.groupBy(author).agg(F.count("*").alias("works"))


def scrape_entries(pages: DataFrame, pattern: str, html: str = "html", by: str = "page_id") -> DataFrame:
    """Entries of each page in order: rank from 1 and the pattern's two groups."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("b"))
    return pages.select(by, F.posexplode(found).alias("p", "e")).select(by, (F.col("p") + 1).alias("rank"), F.col("e.a").alias("entry"), F.col("e.b").alias("title"))


def ranking(entries: DataFrame, per_page: int = 500, month: str = "month") -> DataFrame:
    """id, score (sum of per_page + 1 - rank), months, best rank, first title; best score first, ties by id."""
    agg = entries.groupBy("id").agg(
        F.sum(F.lit(per_page + 1) - F.col("rank")).alias("score"),
        F.count("*").alias("months"),
        F.min("rank").alias("best_rank"),
        F.min_by("title", F.struct(month, "rank")).alias("title"),
    )
    return agg.orderBy(F.desc("score"), "id")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right lacks."""
    return left.join(right.select(key), key, "left_anti")


def capped_by_id(population: DataFrame, cap: int, author: str = "author", id_: str = "id") -> DataFrame:
    """The first `cap` works of each author by the text of their ids."""
    w = Window.partitionBy(author).orderBy(F.col(id_).cast("string"))
    return population.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def missing_top(ranked: DataFrame, population: DataFrame, selected: DataFrame, n: int = 100) -> DataFrame:
    """Of the n best of a ranking (id, score), those in the population that were not selected."""
    top = ranked.orderBy(F.desc("score"), "id").limit(n)
    return top.join(population.select("id"), "id", "left_semi").join(selected.select("id"), "id", "left_anti")


def size_statistics(works: DataFrame, text: str = "text") -> DataFrame:
    """works, mean and median of characters, UTF-8 bytes a character, and all bytes."""
    n = F.length(text)
    out = works.agg(F.count(text).alias("works"), F.avg(n).alias("mean"), F.median(n).alias("median"), F.sum(F.octet_length(text).cast("long")).alias("bytes"), F.sum(n).alias("chars"))
    return out.select("works", F.round("mean", 2).alias("mean_chars"), F.col("median").cast("double").alias("median_chars"), F.round(F.col("bytes") / F.col("chars"), 4).alias("bytes_per_char"), "bytes")


def sampled(works: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n works in the order of a hash of their ids: the same ones at each run, for estimates."""
    return works.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def thousands(number: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(number.cast("long"), 0)
