"""Search: exact overlapping substring counts, positions, extracts and keywords in context, by document, form and facet.

Matching is on raw text, case-sensitive, without normalisation. The empty pattern and patterns longer than a text match nothing.
Positions are 0-based byte offsets in the document. Documents never join: no occurrence spans two of them. Count queries build no
position arrays; a `contains` test comes before the costly work; everything up to the aggregates is a map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx

WIDTH, MAX_ROWS, PAGE_STOP = 30, 40, 400


def count_by_doc(docs: DataFrame, pattern: str, key: str = "doc_id") -> DataFrame:
    """Documents with occurrences and their numbers."""
    return docs.select(key, tx.count_overlapping(F.col("text"), pattern).alias("hits")).where("hits > 0")


def count_total(docs: DataFrame, pattern: str) -> DataFrame:
    return docs.agg(F.coalesce(F.sum(tx.count_overlapping(F.col("text"), pattern)), F.lit(0)).alias("hits"))


def _form_counts(forms: list[str]) -> Column:
    """An array of (ord, form, hits): all forms are counted in one pass over a document."""
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(f).alias("form"), tx.count_overlapping(F.col("text"), f).alias("hits")) for i, f in enumerate(forms)]
    return F.array(*rows)


def count_by_form(docs: DataFrame, forms: list[str], by: list[str] | None = None) -> DataFrame:
    """ord, form, hits (and the columns of `by`); forms without any hit stay with 0 when there is no `by`."""
    by = by or []
    sums = [F.coalesce(F.sum(tx.count_overlapping(F.col("text"), f)), F.lit(0)).alias(f"_{i}") for i, f in enumerate(forms)]
    total = docs.groupBy(*by).agg(*sums)
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(f).alias("form"), F.col(f"_{i}").alias("hits")) for i, f in enumerate(forms)))
    out = total.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    return out.where("hits > 0") if by else out


def locate(docs: DataFrame, pattern: str, chars: bool = False, key: str = "doc_id") -> DataFrame:
    """A row for each occurrence: document and offset."""
    return docs.where(F.contains("text", F.lit(pattern))).select(key, F.explode(tx.positions(F.col("text"), pattern, chars)).alias("pos"))


def extract(docs: DataFrame, start: int, size: int, key: str = "doc_id") -> DataFrame:
    return docs.select(key, tx.extract_bytes(F.col("text"), start, size).alias("bytes"))


def kwic(docs: DataFrame, forms: list[str] | str, width: int = WIDTH, max_rows: int | None = None, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """doc_id, pos, form, before, hit, after. Windows have at most `width` bytes, of whole characters, inside the document.

    The document is turned to bytes once; each hit cuts its windows out of them, and only the small rows are exploded.
    max_rows keeps, of each document partition key and form, the first rows by position.
    """
    forms = [forms] if isinstance(forms, str) else forms
    keep = keep or []
    if max_rows == 0 or not [f for f in forms if f]:
        forms = [f for f in forms if f] or ["\0"]
        docs = docs.where("false")
    b = F.col("_b")

    def hits(form: str) -> Column:
        size = len(form.encode())
        found = tx.positions(F.col("text"), form)
        found = F.slice(found, 1, max_rows) if max_rows else found
        return F.transform(found, lambda p: F.struct(p.alias("pos"), F.lit(form).alias("form"), tx.window_before(b, p, width).alias("before"), F.lit(form).alias("hit"), tx.window_after(b, p + size, width).alias("after")))

    some = F.lit(False)
    for f in forms:
        some = some | F.contains("text", F.lit(f))
    rows = docs.where(some).select(key, *keep, "text", F.encode("text", "UTF-8").alias("_b"))
    rows = rows.select(key, *keep, F.explode(F.flatten(F.array(*(hits(f) for f in forms)))).alias("h"))
    return rows.select(key, *keep, "h.*")


def kwic_top(docs: DataFrame, form: str, n: int, width: int = WIDTH) -> DataFrame:
    """The first n rows by document and position; a document brings at most n rows to the top-n."""
    return kwic(docs, form, width, n).orderBy("doc_id", "pos").limit(n)


def kwic_by_shard(docs: DataFrame, forms: list[str], shard: Column, max_rows: int = MAX_ROWS, width: int = WIDTH) -> DataFrame:
    """The first rows by (document, position) of each shard and form; documents give at most max_rows before the window."""
    w = Window.partitionBy("shard_id", "form").orderBy("doc_id", "pos")
    rows = kwic(docs.withColumn("shard_id", shard), forms, width, max_rows, keep=["shard_id"])
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_rows)


def within_budget(rows: DataFrame, forms: list[str], stop: int = PAGE_STOP) -> DataFrame:
    """Rows of forms in order as long as the forms before brought fewer than `stop` rows; a form that has begun stays whole."""
    order = F.create_map(*(F.lit(x) for i, f in enumerate(forms) for x in (f, i)))
    n = rows.groupBy("form").agg(F.count("*").alias("_n")).withColumn("_o", F.try_element_at(order, F.col("form")))
    w = Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as forms
    begun = n.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).where(F.col("_before") < stop)
    return rows.join(F.broadcast(begun.select("form")), "form", "left_semi")


def shards_with_hits(docs: DataFrame, forms: list[str], shard: Column) -> DataFrame:
    """shard_id, ord, form, hits of shards and forms that occur."""
    return count_by_form(docs.withColumn("shard_id", shard), forms, ["shard_id"])


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number` (from 0) by document, form and position. Sorting is global, so only top rows travel."""
    return rows.orderBy("doc_id", "form", "pos").offset(number * size).limit(size)


def with_metadata(rows: DataFrame, meta: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with metadata; works that metadata lacks keep defaults."""
    out = rows.join(meta, key, "left")
    return out.fillna({c: "(unknown)" for c, t in meta.dtypes if t == "string" and c != key})


def facet_filter(rows: DataFrame, **chosen: list | None) -> DataFrame:
    """Facets combine with AND; an empty or missing choice does not filter."""
    for name, values in chosen.items():
        if values:
            rows = rows.where(F.col(name).isin(list(values)))
    return rows


def facet_counts(counted: DataFrame, facet: str) -> DataFrame:
    """Documents and hits of each value, most hits first."""
    out = counted.groupBy(facet).agg(F.count("*").alias("docs"), F.sum("hits").alias("hits"))
    return out.orderBy(F.desc("hits"), facet)


def top_works(counted: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The n documents with most hits and their share of the largest, in rounded per cent."""
    top = counted.orderBy(F.desc("hits"), key).limit(n)
    most = F.max("hits").over(Window.partitionBy())
    return top.select(key, "hits", F.round(F.lit(100.0) * F.col("hits") / most).cast("long").alias("width_pct"))
