"""Spelling variants: rule-driven expansion of a query, ratios, counts over all forms."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FORMS = 48  # with the query itself
THRESHOLD = 70


@dataclass(frozen=True)
class Rule:
    """Replaces one occurrence of `old` at a time; a medial rule leaves the first character alone."""

    old: str
    new: str
    medial: bool = False
    on: bool = True
    ratio: int = 99


# Single-character rules in order: from, to, medial, on by default, measured ratio in per cent.
RULES = [
    Rule("い", "ゐ", False, True, 99),
    Rule("え", "ゑ", False, True, 89),
    Rule("じ", "ぢ", False, True, 89),
    Rule("ず", "づ", False, True, 80),
    Rule("う", "ふ", True, True, 96),
    Rule("お", "ほ", True, True, 77),
    Rule("わ", "は", True, True, 84),
    Rule("お", "を", False, False, 37),
    Rule("え", "へ", True, False, 15),
    Rule("か", "くわ", False, False, 5),
]
# Long vowels, from and to, in order.
LONG = [
    ("おう", "あう"), ("こう", "かう"), ("ごう", "がう"), ("そう", "さう"), ("ぞう", "ざう"), ("とう", "たう"), ("どう", "だう"),
    ("のう", "なう"), ("ほう", "はう"), ("ぼう", "ばう"), ("ぽう", "ぱう"), ("もう", "まう"), ("よう", "やう"), ("ろう", "らう"),
    ("きょう", "きやう"), ("ぎょう", "ぎやう"), ("しょう", "しやう"), ("じょう", "じやう"), ("ちょう", "ちやう"), ("にょう", "にやう"),
    ("ひょう", "ひやう"), ("びょう", "びやう"), ("ぴょう", "ぴやう"), ("みょう", "みやう"), ("りょう", "りやう"),
]


def substituted(word: str, rule: Rule) -> Iterable[str]:
    """One form for each non-overlapping occurrence of the rule's left side."""
    parts = word.split(rule.old)
    for k in range(1, len(parts)):
        head = rule.old.join(parts[:k])
        if head or not rule.medial:
            yield head + rule.new + rule.old.join(parts[k:])


def expand(word: str, risky: bool = False, rules: list[Rule] = RULES, long: list[tuple[str, str]] = LONG, limit: int = MAX_FORMS) -> list[str]:
    """Variants in the order found, without the word: two rounds of long vowels, then two of single rules on all forms so far."""
    if not word:
        return []
    forms = {word: None}

    def rounds(frontier: list[str], table: list[Rule]) -> None:
        for _ in range(2):
            fresh = []
            for form in (f for w in frontier for r in table for f in substituted(w, r)):
                if form not in forms and len(forms) < limit:
                    forms[form] = None
                    fresh.append(form)
            frontier = fresh

    rounds([word], [Rule(a, b) for a, b in long])
    rounds(list(forms), [r for r in rules if r.on or risky])
    return list(forms)[1:]


def ratio(form: str, word: str, rules: list[Rule] = RULES) -> int:
    """The least ratio of the single rules whose right side the form has and the word has not; 99 without any."""
    return min((r.ratio for r in rules if r.new in form and r.new not in word), default=99)


def variant_rows(word: str, risky: bool = False, rules: list[Rule] = RULES, long: list[tuple[str, str]] = LONG) -> list[tuple[int, str, int, bool]]:
    """(ord, form, ratio, base): the word itself comes first with ratio 100."""
    found = expand(word, risky, rules, long)
    return ([(0, word, 100, True)] if word else []) + [(i, f, ratio(f, word, rules), False) for i, f in enumerate(found, 1)]


def variant_table(spark: SparkSession, words: list[str], risky: bool = False, rules: list[Rule] = RULES, long: list[tuple[str, str]] = LONG) -> DataFrame:
    """word, ord, form, ratio, base for a list of query words."""
    rows = [(w, *r) for w in words for r in variant_rows(w, risky, rules, long)]
    return spark.createDataFrame(rows, "word string, ord int, form string, ratio int, base boolean")


def expand_column(df: DataFrame, word: str, risky: bool = False, rules: list[Rule] = RULES, long: list[tuple[str, str]] = LONG) -> DataFrame:
    """df with `forms`, the variants of each row's word. Order-dependent and bounded, so an Arrow-batched function."""
    @F.pandas_udf("array<string>")
    def forms(words: pd.Series) -> pd.Series:
        return words.map(lambda w: expand(w, risky, rules, long) if w else [])

    return df.withColumn("forms", forms(F.col(word)))


def gain(counts: DataFrame) -> DataFrame:
    """From (form, base, hits): hits of the word, of its variants, and the gain in per cent (0 without base hits)."""
    base = F.coalesce(F.sum(F.when(F.col("base"), F.col("hits"))), F.lit(0))
    extra = F.coalesce(F.sum(F.when(~F.col("base"), F.col("hits"))), F.lit(0))
    out = counts.agg(base.alias("base_hits"), extra.alias("extra_hits"))
    return out.withColumn("gain_pct", F.when(F.col("base_hits") > 0, F.round(100.0 * F.col("extra_hits") / F.col("base_hits"), 4)).otherwise(F.lit(0.0)))
