"""Markup removal with exact accounting: every removed character is counted under one heading.

The order is fixed: line ends, notes, ruby, pipes, line-end blanks, title and author, legend, footer, rules, blank runs, edges.
Everything is a projection. Stages work on the whole text, by multi-line patterns; only texts that hold a line which looks like a
rule or a footer are cut into arrays of lines for that stage. A null text stands for no line at all, the empty one for an empty line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as tx


@dataclass(frozen=True)
class Markup:
    """The patterns of a corpus. The defaults are fixed values of the Japanese plain-text library format."""

    note: str = "※?［＃[^］]*］"
    ruby: str = "《[^》]*》"
    pipe: str = "｜"
    rule: str = r"^-{20,}\s*$"
    legend: tuple[str, ...] = ("【", "：ルビ")
    footer: str = "^(?:底本|底本の親本)[：:]"
    footer_else: str = "^(?:青空文庫作成ファイル|入力|校正)[：:]"
    evidence: str = "^(?:入力|校正|青空文庫作成ファイル|ファイル作成)[：:]"


HEADINGS = ["note", "ruby", "pipe", "trailing_ws", "title", "legend", "footer", "dash", "blank", "edge"]


def newlines(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def strip_markup(text: Column, m: Markup = Markup()) -> Column:
    """Without notes, ruby and pipes."""
    return F.replace(F.regexp_replace(F.regexp_replace(text, m.note, ""), m.ruby, ""), F.lit(m.pipe), F.lit(""))


def _size(text: Column) -> Column:
    """Characters of a text's lines with a line end each; none for no line."""
    return F.coalesce(F.length(text) + 1, F.lit(0))


def _gone(before: str, after: str) -> Column:
    """Characters, with line ends, that a stage took away. Stages only take away, so as many bytes mean the same text."""
    same = F.octet_length(before).eqNullSafe(F.octet_length(after))
    return F.when(same, F.lit(0)).otherwise(_size(F.col(before)) - _size(F.col(after)))


def _lines(text: Column) -> Column:
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def _text(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def _first_line(text: Column) -> Column:
    """The first line that is not empty; the empty text without one."""
    return F.regexp_extract(text, r"\A\n*([^\n]+)", 1)


def _after_first_line(text: Column) -> Column:
    """What follows the first line that is not empty; null if that was the last line."""
    head = F.length(F.regexp_extract(text, r"\A\n*[^\n]+", 0))
    return F.when(head < F.length(text), text.substr(head + 2, F.length(text)))


def _has_line(text: Column, pattern: str) -> Column:
    """Whether a line may match: no text without it does."""
    return F.coalesce(text.rlike(f"(?md){pattern}"), F.lit(False))


def _first(lines: Column, test) -> Column:
    """1-based place of the first line for which test holds; 0 without one."""
    return F.coalesce(F.array_position(F.transform(lines, test), True), F.lit(0)).cast("int")


def _tail(lines: Column, start: Column) -> Column:
    return F.slice(lines, start, F.greatest(F.size(lines) - start + 1, F.lit(0)))


def normalize(docs: DataFrame, m: Markup = Markup(), title: str = "title", author: str = "author", text: str = "text") -> DataFrame:
    """docs with body, forms (title, legend, footer) and acc (a count for each heading, in, out, balance).

    Null texts count as empty, null titles and authors as absent. balance is 0 unless all lines go (one line end then counts twice).
    """
    col = F.col
    df = docs.withColumn("_t", newlines(F.coalesce(col(text), F.lit(""))))
    df = df.withColumn("_n", F.regexp_replace("_t", m.note, "")).withColumn("_r", F.regexp_replace("_n", m.ruby, "")).withColumn("_p", F.replace("_r", F.lit(m.pipe), F.lit("")))
    df = df.withColumn("_l0", tx.rstrip_lines(col("_p")))
    # title and author
    df = df.withColumn("_i", _first_line(col("_l0")))
    wanted = F.coalesce(col(title), F.lit(""))
    hit = (wanted != "") & (col("_i") != "") & (tx.flat(col("_i")) == tx.flat(wanted))
    df = df.withColumn("_hit", hit).withColumn("_rest", F.when(hit, _after_first_line(col("_l0"))))
    df = df.withColumn("_j", F.coalesce(_first_line(col("_rest")), F.lit("")))
    name = F.coalesce(col(author), F.lit(""))
    by = tx.flat(col("_j")).isin(tx.flat(name), tx.flat(F.reverse(name)))
    after = F.when(col("_j") != "", F.when(by, _after_first_line(col("_rest"))).otherwise(F.ltrim(col("_rest"), F.lit("\n"))))
    df = df.withColumn("_l1", F.when(col("_hit"), after).otherwise(col("_l0")))
    # legend between the first two rules
    df = df.withColumn("_x", F.when(_has_line(col("_l1"), m.rule), _lines(col("_l1"))))
    rules = F.filter(F.transform("_x", lambda x, i: F.when(x.rlike(m.rule), i)), lambda i: i.isNotNull())
    df = df.withColumn("_d", rules).withColumn("_a", F.get("_d", F.lit(0))).withColumn("_b", F.get("_d", F.lit(1)))
    block = F.array_join(F.slice("_x", col("_a") + 2, F.greatest(col("_b") - col("_a") - 1, F.lit(0))), "\n")
    told = F.lit(False)
    for mark in m.legend:
        told = told | F.contains(block, F.lit(mark))
    df = df.withColumn("_leg", F.coalesce(col("_b").isNotNull() & told, F.lit(False)))
    df = df.withColumn("_l2", F.when(col("_leg"), _text(_tail(col("_x"), col("_b") + 2))).otherwise(col("_l1")))
    # footer, only with evidence
    df = df.withColumn("_y", F.when(_has_line(col("_l2"), m.footer) | _has_line(col("_l2"), m.footer_else), _lines(col("_l2"))))
    head = _first(col("_y"), lambda x: x.rlike(m.footer))
    df = df.withColumn("_c", F.when(col("_y").isNull(), 0).when(head > 0, head).otherwise(_first(col("_y"), lambda x: x.rlike(m.footer_else))))
    proof = F.exists(_tail(col("_y"), F.greatest(col("_c"), F.lit(1))), lambda x: x.rlike(m.evidence))
    df = df.withColumn("_foot", F.when(col("_c") == 0, "none").when(proof, "footer").otherwise("refused"))
    df = df.withColumn("_l3", F.when(col("_foot") == "footer", _text(F.slice("_y", 1, col("_c") - 1))).otherwise(col("_l2")))
    plain = _text(F.filter(_lines(col("_l3")), lambda x: ~x.rlike(m.rule)))
    df = df.withColumn("_l4", F.when(_has_line(col("_l3"), m.rule), plain).otherwise(col("_l3")))
    df = df.withColumn("_joined", F.coalesce("_l4", F.lit(""))).withColumn("_short", F.when(F.contains("_joined", F.lit("\n\n\n")), F.regexp_replace("_joined", "\n{3,}", "\n\n")).otherwise(col("_joined"))).withColumn("_body", F.trim("_short", F.lit("\n")))
    size = F.length
    values = {
        "note": _gone("_t", "_n"),
        "ruby": _gone("_n", "_r"),
        "pipe": _gone("_r", "_p"),
        "trailing_ws": _gone("_p", "_l0"),
        "title": _gone("_l0", "_l1"),
        "legend": _gone("_l1", "_l2"),
        "footer": _gone("_l2", "_l3"),
        "dash": _gone("_l3", "_l4"),
        "blank": _gone("_joined", "_short"),
        "edge": _gone("_short", "_body"),
    }
    total = sum(values.values(), F.lit(0))
    acc = [v.cast("long").alias(k) for k, v in values.items()] + [size("_t").cast("long").alias("in"), size("_body").cast("long").alias("out"), (size("_t") - size("_body") - total).cast("long").alias("balance")]
    forms = F.struct(F.when(col("_hit"), "title+author").otherwise("none").alias("title"), F.when(col("_leg"), "legend").otherwise("none").alias("legend"), col("_foot").alias("footer"))
    # a filter on the result stays above it: pushed down, it would take along all the stages once for each mention of them
    stay = F.monotonically_increasing_id() >= 0
    df = df.withColumns({"body": F.when(stay, F.concat("_body", F.lit("\n"))), "forms": F.when(stay, forms), "acc": F.when(stay, F.struct(*acc))})
    return df.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("body", "forms", "acc")], "body", "forms", "acc")


def split_excluded(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Works with a footer that could be cut, and the others."""
    ok = F.col("forms.footer") == "footer"
    return normalized.where(ok), normalized.where(~ok)


def corpus_totals(normalized: DataFrame) -> DataFrame:
    return normalized.agg(
        F.count("*").alias("works"),
        F.sum("acc.in").alias("chars_in"),
        F.sum("acc.out").alias("chars_out"),
        F.round(F.sum("acc.out") / F.sum("acc.in"), 4).alias("retention"),
        F.count_if(F.col("forms.legend") == "none").alias("no_legend"),
        F.sum(F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit("")))).alias("lines"),
        F.sum(F.octet_length("body").cast("long")).alias("utf8"),
    )


def removal_totals(normalized: DataFrame) -> DataFrame:
    """heading, chars, share of all input."""
    sums = normalized.agg(F.sum("acc.in").alias("n"), *(F.sum(f"acc.{h}").alias(h) for h in HEADINGS))
    rows = F.array(*(F.struct(F.lit(h).alias("heading"), F.col(h).alias("chars")) for h in HEADINGS))
    return sums.select("n", F.explode(rows).alias("r")).select("r.heading", "r.chars", F.round(F.col("r.chars") / F.col("n"), 4).alias("share"))


def probe_size(text: Column, m: Markup = Markup()) -> Column:
    """The rough cut used for size estimates: header block, footer, markup and all blanks gone."""
    t = F.regexp_replace(newlines(text), r"(?s)\A.*?-{20,}\s*\n.*?-{20,}\s*\n", "")
    t = F.regexp_replace(t, f"(?s)\n{m.footer.lstrip('^')}.*\\z", "")
    return F.regexp_replace(strip_markup(t, m), "[ \t　]+", "")
