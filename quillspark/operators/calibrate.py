"""Calibration: how often the forms of each rule fall into documents with a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as tx

# Probe forms of each rule.
PROBES = {
    "い→ゐ": ["ゐる", "ゐない", "つひに"],
    "え→ゑ": ["こゑ", "すゑ"],
    "じ→ぢ": ["すぢ", "もみぢ", "はぢめ"],
    "ず→づ": ["しづか", "みづ", "つづみ"],
    "う→ふ(語中)": ["いふ", "おもふ", "さうらふ"],
    "お→ほ(語中)": ["なほ", "こほり", "とほい"],
    "わ→は(語中)": ["かはいい", "あはれ", "かはり"],
    "長音 こう→かう": ["かうして", "かういふ"],
    "長音 そう→さう": ["さうして", "さういふ", "さうだ"],
    "長音 よう→やう": ["やうな", "やうに", "やうす"],
    "長音 とう→たう": ["たうとう"],
    "長音 ちょう→ちやう": ["ちやうど"],
    "お→を": ["をもう", "をんな", "をとこ", "かをり"],
    "え→へ(語中)": ["こへ", "そへ"],
    "か→くわ": ["くわし", "くわじ"],
}


def probe_counts(docs: DataFrame, probes: dict[str, list[str]] | None, labelled: Column) -> DataFrame:
    """rule, form, hits, old: non-overlapping counts over all documents and over the labelled ones, in one pass. None: PROBES."""
    probes = PROBES if probes is None else probes
    forms = sorted({f for fs in probes.values() for f in fs})
    n = {f: tx.count_nonoverlapping(F.col("text"), f) for f in forms}
    sums = [F.coalesce(F.sum(n[f]), F.lit(0)).alias(f"n{i}") for i, f in enumerate(forms)]
    sums += [F.coalesce(F.sum(F.when(labelled, n[f])), F.lit(0)).alias(f"o{i}") for i, f in enumerate(forms)]
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(f).alias("form"), F.col(f"n{forms.index(f)}").alias("hits"), F.col(f"o{forms.index(f)}").alias("old")) for r, fs in probes.items() for f in fs]
    return docs.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def rule_ratios(counts: DataFrame) -> DataFrame:
    """rule, hits, old_hits, old_ratio (4 digits), old_ratio_pct (truncated); no hits give 0."""
    out = counts.groupBy("rule").agg(F.sum("hits").alias("hits"), F.sum("old").alias("old_hits"))
    r = F.coalesce(F.try_divide(F.col("old_hits"), F.col("hits")), F.lit(0.0))
    return out.select("rule", "hits", "old_hits", F.round(r, 4).alias("old_ratio"), F.floor(r * 100).cast("long").alias("old_ratio_pct"))


def gate(ratios: DataFrame, threshold: int = 70) -> DataFrame:
    """Rules with the decision whether they are on by default."""
    return ratios.withColumn("default_on", F.col("old_ratio_pct") >= threshold)
