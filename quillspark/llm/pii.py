"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select; DataFrame functions only.

Four kinds are exact and always kept (`email`, `ip`, `card`, `phone`: fixed patterns with checks, leftmost and not overlapping
within a kind). Beyond them, high-recall generators propose spans that may overlap: spelled-out mail addresses, national phone
numbers, social-security-like numbers, bank account numbers, IPv6 addresses. Boosted trees over format and context features score
each proposal; a proposal is selected if it reaches its kind's threshold, overlaps no exact span and no better proposal. The trees
are trained here on generated labelled snippets (TRAIN_SNIPPETS, a fixed bound), with the very expressions that compute the
features of documents, and become one Spark expression. Everything is a projection: no shuffle, no Python on the executors.

Positions are code points. A text's matches come from `regexp_extract_all`, the stretches between them from `split` with the same
pattern; running sums of both give the places. The patterns are possessive where that changes no match, so long runs neither
overflow the stack nor take quadratic time. Overlaps are found by one sweep over sorted spans: spans of a kind do not overlap, so a
span can only meet the last one of each kind. Contexts and unredacted stretches are cut from pieces of the text, not from its start.
All of it takes time in proportion to text and spans, but for sorting.

Defined cases: null and empty texts have no spans; a null id is kept; repeated rows give repeated results; an empty table gives an
empty result; equal starts are ordered by kind, then end; of overlapping proposals with equal scores the earlier, then longer, one
stays. Extra columns pass through `find_spans` and `redact`; `find_spans` replaces columns of the names it adds, `redact` keeps all.
"""

from __future__ import annotations

import json
import random
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import let

from .common import read

# The exact kinds, in the order that ties follow.
EXACT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What the generators propose.
PROPOSED = {
    "email_spelled": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?[\[(][Aa][Tt][\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(][Dd][Oo][Tt][\])] ?)[A-Za-z0-9-]++)++",
    "phone_national": r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{2,4}[ .-][0-9]{3,4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![A-Za-z0-9:])(?:(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![A-Za-z0-9:])",
}
KINDS = [*EXACT, *PROPOSED]
# Words before a span that speak for personal data, by group.
CONTEXT = {
    "call": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|reach|dial|telefon|téléphone|teléfono|whatsapp)",
    "identity": r"(?i)\b(?:ssn|social|security|identity|passport|taxpayer)",
    "account": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)",
    "contact": r"(?i)\b(?:mail|contact|write|address|host|server|ip)\b",
    "number": r"(?i)\b(?:isbn|version|order|invoice|page|pages|table|figure|score|range|section|part|model|ref|item)\b",
}
FEATURES = ["kind", "digits", "letters", "length", "separators", "groups", "paren", "before_word", "after_word", "spaced", *CONTEXT, "near_digits"]
TRAIN_SNIPPETS = 3000
PRECISION = 0.97
#: Spans in one step of a sum or sweep, and characters of a piece of text.
_CHUNK, _PIECE = 256, 1024
_SPAN = "struct<start:int,end:int,kind:int,hit:string>"


def _places(text: Column, pattern: str, kind: int, may: Column) -> tuple[Column, Column]:
    """The stretches between matches and the matches themselves."""
    empty = F.array().cast("array<string>")
    return F.when(may, F.split(text, pattern, -1)).otherwise(empty), F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty)


def _located(gaps: Column, hits: Column, kind: int) -> Column:
    """Spans of all matches: sums run within chunks of matches, then over chunks, so that many matches stay cheap."""

    def chunk(at: Column) -> Column:
        pairs = F.arrays_zip(F.slice(gaps, at, F.lit(_CHUNK)).alias("g"), F.slice(hits, at, F.lit(_CHUNK)).alias("h"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

        def step(a: Column, p: Column) -> Column:
            begin = a["at"] + F.length(p["g"])
            end = begin + F.coalesce(F.length(p["h"]), F.lit(0))
            return F.struct(end.alias("at"), F.when(p["h"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), p["h"].alias("hit"))))).alias("out"))

        return F.aggregate(pairs, start, step)

    chunks = F.transform(F.sequence(F.lit(1), F.size(gaps), F.lit(_CHUNK)), chunk)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
    moved = lambda a, c: F.transform(c["out"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), (s["end"] + a["at"]).alias("end"), s["kind"].alias("kind"), s["hit"].alias("hit")))
    whole = F.aggregate(chunks, start, lambda a, c: F.struct((a["at"] + c["at"]).alias("at"), F.concat(a["out"], F.array(moved(a, c))).alias("out")), lambda a: F.flatten(a["out"]))
    return F.when(F.size(hits) > 0, whole).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}+"), F.lit(0))


def _cut(pieces: Column, start: Column, size: Column) -> Column:
    """size characters from start (counted from 0), from the pieces that hold them."""
    first = (start / _PIECE).cast("int")
    at = start - first * _PIECE
    return F.substring(F.array_join(F.slice(pieces, first + 1, ((at + size) / _PIECE).cast("int") + 1), ""), at + 1, size)


def _undominated(spans: str, ahead) -> Column:
    """Of spans (start, kind, end, score, ...), sorted by start, those that overlap no span that is ahead of them.

    One pass that keeps the last span of each kind: earlier ones of that kind have ended. It collects the places of spans that lose.
    """
    numbered = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["score"].alias("score"), i.alias("at")))
    nothing = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("kind"), F.lit(-1).alias("end"), F.lit(0.0).alias("score"), F.lit(-1).alias("at"))

    def step(a: Column, s: Column) -> Column:
        met = F.filter(a["last"], lambda x: x["end"] > s["start"])
        lost = F.transform(met, lambda x: F.when(ahead(x, s), s["at"]).when(ahead(s, x), x["at"]).otherwise(F.lit(-1)))
        last = F.transform(a["last"], lambda x, k: F.when(k == s["kind"], s).otherwise(x))
        return F.struct(last.alias("last"), F.concat(a["out"], lost).alias("out"))

    def sweep(all_spans: Column) -> Column:
        def chunk(a: Column, at: Column) -> Column:
            start = F.struct(a["last"].alias("last"), F.array().cast("array<int>").alias("out"))
            done = F.aggregate(F.slice(all_spans, at, F.lit(_CHUNK)), start, step)
            return let(done, lambda d: F.struct(d["last"].alias("last"), F.concat(a["out"], F.array(d["out"])).alias("out")))

        start = F.struct(F.array_repeat(nothing, len(KINDS)).alias("last"), F.array().cast("array<array<int>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(all_spans), F.lit(_CHUNK)), start, chunk, lambda a: F.flatten(a["out"]))

    stay = F.array_except(F.sequence(F.lit(0), F.size(spans) - 1), let(numbered, sweep))
    return F.when(F.size(spans) > 1, F.transform(stay, lambda i: F.get(F.col(spans), i))).otherwise(F.col(spans))


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _ok(kind: str, s: Column) -> Column:
    return _valid(kind, s["hit"])


def _may() -> dict[str, Column]:
    text, digit = F.col("_t"), F.col("_digit")
    has = lambda x: F.contains(text, F.lit(x))
    plain = {"email": has("@"), "ip": digit, "card": digit, "phone": digit & has("+")}
    return plain | {"email_spelled": text.rlike(r"[Aa][Tt][\])]"), "phone_national": digit, "ssn": digit & has("-"), "iban": digit, "ipv6": (digit & has(":")) | has("::")}


def _matches(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """df with an array of located matches `_s_<kind>` for each pattern."""
    may = _may()
    df = df.withColumns({f"_{x}_{k}": c for k, p in patterns.items() for x, c in zip("gh", _places(F.col("_t"), p, 0, may[k]), strict=True)})
    df = df.withColumns({f"_s_{k}": _located(F.col(f"_g_{k}"), F.col(f"_h_{k}"), KINDS.index(k)) for k in patterns})
    return df.drop(*(f"_{x}_{k}" for k in patterns for x in "gh"))


def _features(span: Column) -> Column:
    hit, flag = span["hit"], lambda c: F.coalesce(c, F.lit(False)).cast("double")
    count = lambda pattern: F.length(F.regexp_replace(hit, pattern, "")).cast("double")
    before = F.get(span["around"], F.lit(0))
    after = F.get(span["around"], F.lit(1))
    values = [
        span["kind"].cast("double"),
        count("[^0-9]"),
        count("[^A-Za-z]"),
        F.length(hit).cast("double"),
        count("[A-Za-z0-9]"),
        F.size(F.regexp_extract_all(hit, F.lit("[A-Za-z0-9]+"), F.lit(0))).cast("double"),
        flag(F.contains(hit, F.lit("("))),
        flag(before.rlike(r"[\p{L}\p{N}_]$")),
        flag(after.rlike(r"^[\p{L}\p{N}_]")),
        flag(F.contains(hit, F.lit(" "))),
        *(flag(before.rlike(p)) for p in CONTEXT.values()),
        (F.length(F.regexp_replace(before, "[^0-9]", "")) + F.length(F.regexp_replace(after, "[^0-9]", ""))).cast("double"),
    ]
    return F.struct(*(v.alias(n) for v, n in zip(values, FEATURES, strict=True)))


def _proposals(df: DataFrame) -> DataFrame:
    """df with `_p`: proposals that overlap no exact span, each with its features. Needs _t, _digit and _exact."""
    df = _matches(df, PROPOSED)
    span = lambda s, score, hit: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(score).alias("score"), hit.alias("hit"))
    found = F.flatten(F.array(*(F.col(f"_s_{k}") for k in PROPOSED)))
    df = df.withColumn("_found", found).drop(*(f"_s_{k}" for k in PROPOSED))
    both = F.sort_array(F.concat(F.transform("_exact", lambda s: span(s, 1.0, F.lit(""))), F.transform("_found", lambda s: span(s, 0.0, s["hit"]))))
    df = df.withColumn("_both", F.when(F.size("_found") > 0, both).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,score:double,hit:string>>"))).drop("_found")
    df = df.withColumn("_free", F.filter(_undominated("_both", lambda x, y: x["score"] > y["score"]), lambda s: s["score"] == 0.0)).drop("_both")
    df = df.withColumn("_pieces", F.when(F.size("_free") > 0, _pieces(F.col("_t"))).otherwise(F.array().cast("array<string>")))
    lead = lambda s: F.least(F.lit(40), s["start"])
    around = lambda s: F.array(_cut(F.col("_pieces"), s["start"] - lead(s), lead(s)), _cut(F.col("_pieces"), s["end"], F.lit(20)))
    df = df.withColumn("_near", F.transform("_free", lambda s: F.struct(*(s[x].alias(x) for x in ("start", "kind", "end", "hit")), around(s).alias("around")))).drop("_free", "_pieces")
    return df.withColumn("_p", F.transform("_near", lambda s: F.struct(s.alias("s"), _features(s).alias("f")))).drop("_near")


def _exact(df: DataFrame) -> DataFrame:
    """df, which has _t, with _digit and _exact: the spans of the exact kinds, by start and kind."""
    df = _matches(df.withColumn("_digit", F.col("_t").rlike("[0-9]")), EXACT)
    kept = [F.filter(f"_s_{k}", partial(_ok, k)) for k in EXACT]
    spans = F.transform(F.flatten(F.array(*kept)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return df.withColumn("_exact", F.sort_array(spans)).drop(*(f"_s_{k}" for k in EXACT))


# --- training -------------------------------------------------------------------------------------------------------------


def snippets(n: int = TRAIN_SNIPPETS, seed: int = 11) -> list[dict]:
    """Generated sentences with one number or address each; k is the kind of personal data that it is."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))
    said = lambda k: " ".join(word() for _ in range(r.randint(1, k)))
    national = lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}"])
    hexa = lambda: f"{r.randrange(65536):x}"
    short = lambda: r.choice(["2001:db8::", "fe80::", "::", f"{hexa()}::", f"2001:db8:{hexa()}::", f"{hexa()}:{hexa()}:{hexa()}::"]) + ":".join(r.choice([hexa(), str(r.randint(1, 9))]) for _ in range(r.randint(1, 3)))
    yes = [
        ("phone_national", lambda: (r.choice(["call", "phone", "tel", "fax:", "mobile", "reach me at"]), national())),
        ("phone_national", lambda: (said(3), f"({d(3)}) {d(3)}-{d(4)}")),
        ("ssn", lambda: (r.choice(["ssn", "social security", "SSN:", "taxpayer"]), f"{d(3)}-{d(2)}-{d(4)}")),
        ("iban", lambda: (r.choice(["iban", "account", "bank account"]), f"{r.choice(['DE', 'FR', 'ES', 'GB'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}")),
        ("email_spelled", lambda: (r.choice(["mail", "contact", "write to", said(2)]), f"{word()}.{word()} [at] {word()} [dot] com")),
        ("email_spelled", lambda: (r.choice(["mail", said(2)]), f"{word()} (at) {word()}.org")),
        ("email_spelled", lambda: (r.choice(["mail", "write to", said(2)]), f"{word()} {r.choice(['[AT]', '(AT)', '[At]'])} {word()} {r.choice(['[DOT]', '(DOT)', '[Dot]'])} {r.choice(['com', 'org', 'COM'])}")),
        ("ipv6", lambda: (r.choice(["server", "host", said(2)]), ":".join(f"{r.randrange(65536):x}" for _ in range(8)))),
        ("ipv6", lambda: (r.choice(["server", "host", "address", said(2)]), short())),
    ]
    no = [
        lambda: (r.choice(["pages", "section", "score", "order", "invoice", "isbn", "version", "range"]), f"{d(3)}-{d(3)}-{d(4)}"),
        lambda: (r.choice(["isbn", "order", "part", "model", said(2)]), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (r.choice(["version", "table", said(2)]), f"{d(2)}.{d(2)}.{d(3)}"),
        lambda: (said(3), f"{d(3)} {d(3)} {d(3)}"),
        lambda: ("code " + d(4), f"{d(2)} {d(3)} {d(4)} {d(5)}"),
        lambda: (r.choice(["model", "ref", "item", said(2)]), f"{r.choice(['AB', 'XK', 'QT'])}{d(2)}{d(4)}{d(4)}"),
        lambda: ("at " + word(), f"{word()} (at) {r.randint(1, 9)} . {r.randint(10, 59)}"),
        lambda: (r.choice(["class", "scope", "see", said(2)]), "::".join("".join(r.choice("abcdef") for _ in range(r.randint(1, 4))) for _ in range(2))),
        lambda: ("time", ":".join(d(2) for _ in range(5))),
    ]
    out = []
    for _ in range(n):
        kind, make = r.choice(yes) if r.random() < 0.5 else ("none", r.choice(no))
        lead, hit = make()
        out.append({"t": f"{said(12)} {lead} {hit}{r.choice([' ', '. ', ', '])}{said(8)}", "k": kind})
    return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3) -> list:
    """Gradient-boosted trees for the log-loss: the prior's log odds, then nested (feature, threshold, low, high) or leaf values."""
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    out, f = [float(np.log(p0 / (1 - p0)))], np.full(len(y), np.log(p0 / (1 - p0)))
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 25))) for c in x.T]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        leaf = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
        if level == 0 or len(rows) < 20:
            return leaf
        best, total = (1e-6, None, None), g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for j, values in enumerate(cuts):
            for t in values:
                low = x[rows, j] <= t
                if not low.any() or low.all():
                    continue
                gl, hl = g[rows][low].sum(), h[rows][low].sum()
                gain = gl**2 / (hl + 1) + (g[rows].sum() - gl) ** 2 / (h[rows].sum() - hl + 1) - total
                if gain > best[0]:
                    best = (gain, j, float(t))
        if best[1] is None:
            return leaf
        low = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[low], g, h, level - 1), grow(rows[~low], g, h, level - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        out.append(tree)
        f = f + tree_values(tree, x)
    return out


def tree_values(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, t, low, high = tree
    return np.where(x[:, j] <= t, tree_values(low, x), tree_values(high, x))


def tree_column(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    j, t, low, high = tree
    return F.when(f[FEATURES[j]] <= F.lit(t), tree_column(low, f)).otherwise(tree_column(high, f))


_models: dict[str, dict] = {}


def fit(spark: SparkSession) -> dict:
    """Trees and a threshold for each proposed kind. The snippets' features are computed by Spark, once for a session."""
    app = spark.sparkContext.applicationId
    if app in _models:
        return _models[app]
    kind = "array<struct<t:string,k:string>>"
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(snippets())), kind)).alias("x")).select(F.col("x.t").alias("_t"), F.col("x.k").alias("k"))
    found = _proposals(_exact(rows)).select("k", F.explode("_p").alias("p")).select("k", F.array(*(F.col(f"p.f.{n}") for n in FEATURES)).alias("x")).collect()
    x, y = np.array([r.x for r in found], float), np.array([r.k == KINDS[int(r.x[0])] for r in found], float)
    fold = np.arange(len(y)) % 3 == 0
    trees = boost(x[~fold], y[~fold])
    score = trees[0] + sum(tree_values(t, x[fold]) for t in trees[1:])
    thresholds = {}
    for k in PROPOSED:
        mine = x[fold, 0] == KINDS.index(k)
        s, z = score[mine], y[fold][mine]
        fine = [float(t) for t in np.unique(s) if z[s >= t].mean() >= PRECISION]
        thresholds[k] = min(fine) if fine else float("inf")
    _models[app] = {"trees": trees, "thresholds": thresholds}
    return _models[app]


# --- application ----------------------------------------------------------------------------------------------------------


def _spanned(docs: DataFrame, model: dict | None, text: str) -> DataFrame:
    """_row (all columns of docs), _t (the text, never null), base_spans, spans."""
    model = model or fit(docs.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    df = _proposals(_exact(docs.select(row, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))))
    score = lambda f: sum((tree_column(t, f) for t in model["trees"][1:]), F.lit(model["trees"][0]))
    limits = F.array(*(F.lit(model["thresholds"].get(k, float("inf"))) for k in KINDS))
    scored = F.transform("_p", lambda p: F.struct(p["s"]["start"].alias("start"), p["s"]["kind"].alias("kind"), p["s"]["end"].alias("end"), score(p["f"]).alias("score")))
    df = df.withColumn("_scored", scored).drop("_p")
    df = df.withColumn("_fit", F.sort_array(F.filter("_scored", lambda p: p["score"] >= F.get(limits, p["kind"])))).drop("_scored")
    order = lambda x: F.struct(-x["score"], x["start"], -x["end"], x["kind"])
    df = df.withColumn("_best", _undominated("_fit", lambda x, y: order(x) < order(y)))
    more = F.transform("_best", lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))
    return df.select("_row", "_t", F.col("_exact").alias("base_spans"), F.sort_array(F.concat("_exact", more)).alias("spans"))


def find_spans(docs: DataFrame, model: dict | None = None, text: str = "text") -> DataFrame:
    """docs with `base_spans` and `spans`: arrays of (start, kind number, end), sorted; spans adds the selected proposals."""
    keep = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in ("base_spans", "spans")]
    return _spanned(docs, model, text).select(*keep, "base_spans", "spans")


def span_list(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: dict | None = None, text: str = "text") -> DataFrame:
    """docs with each stretch of overlapping spans in `text` replaced by its first kind in brackets, e.g. [EMAIL]."""
    df = _spanned(docs, model, text).withColumn("_pieces", F.when(F.size("spans") > 0, _pieces(F.col("_t"))))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    pieces, start = F.col("_pieces"), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = F.concat(a["out"], F.array(_cut(pieces, a["at"], s["start"] - a["at"]), F.get(names, s["kind"])))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

    def chunk(a: Column, i: Column) -> Column:
        done = F.aggregate(F.slice("spans", i, F.lit(_CHUNK)), F.struct(a["at"].alias("at"), F.array().cast("array<string>").alias("out")), step)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(a["out"], F.array(F.array_join(d["out"], ""))).alias("out")))

    whole = F.aggregate(F.sequence(F.lit(1), F.size("spans"), F.lit(_CHUNK)), start, chunk, lambda a: F.concat(F.array_join(a["out"], ""), _cut(pieces, a["at"], F.length("_t"))))
    df = df.withColumn("_clean", F.when(F.size("spans") > 0, whole).otherwise(F.col("_row")[text]))
    return df.select([(F.col("_clean") if c == text else F.col("_row")[c]).alias(c) for c in docs.columns])


def op2_pii(spark, sf_dir: str) -> DataFrame:
    df = find_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *(count(k) for k in EXACT), F.sha2(span_list("base_spans"), 256).alias("base_sha256"), span_list("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
