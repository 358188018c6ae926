"""Append-only event logs with retractions: effective rows, validation, facts, set comparison.

A log row has file, line, event, and data as JSON text. A `correction` voids one earlier row of its file, once, never another
correction. Rows are keyed by (file, line), so every step is an equi-join or a grouped aggregate by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENVELOPE = ["v", "ts", "project", "loop_id", "event", "data"]
# Required fields of each event and their JSON types.
REQUIRED = {
    "loop_start": {"goal": "string", "spec_refs": "array", "scaffold_version": "string", "agent": "string"},
    "stage_end": {"stage": "number", "stage_name": "string", "result": "string"},
    "test_run": {"command": "string", "passed": "number", "failed": "number"},
    "failure": {"code": "string", "severity": "string", "detected_stage": "number", "summary": "string", "resolution": "string"},
    "escalation": {"reason": "string", "question": "string"},
    "commit": {"sha": "string", "kind": "string"},
    "loop_end": {"outcome": "string", "failure_count": "number", "summary": "string"},
    "correction": {"supersedes": "number", "reason": "string"},
}
# Allowed values.
ALLOWED = {
    ("stage_end", "result"): ["pass", "fail", "skip"],
    ("loop_end", "outcome"): ["success", "partial", "aborted"],
    ("commit", "kind"): ["feat", "fix", "test", "docs", "refactor", "chore", "data", "spec"],
}


def parse(lines: DataFrame) -> DataFrame:
    """file, line, value (JSON text) to rows with the envelope's fields; blank lines and those that are no JSON object go."""
    schema = ", ".join(f"{k} string" for k in [*ENVELOPE, "_broken"])
    j = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_broken"})
    ok = lines.where(F.trim("value") != "").withColumn("j", j).where("j._broken is null")
    return ok.select("file", "line", *(F.col(f"j.{k}").alias(k) for k in ENVELOPE))


def field(name: str, data: str = "data") -> Column:
    return F.get_json_object(data, f"$.{name}")


def voids(rows: DataFrame) -> DataFrame:
    """file, line, target, problem of each correction; problem is null where it takes effect."""
    c = rows.where("event = 'correction'").select("file", "line", field("supersedes").try_cast("long").alias("target"))
    t = rows.select("file", F.col("line").alias("target"), F.col("event").alias("of"))
    first = F.row_number().over(Window.partitionBy("file", "target").orderBy("line"))
    met = c.join(t, ["file", "target"], "left")
    fair = F.col("of").isNotNull() & (F.col("target") < F.col("line")) & (F.col("of") != "correction")
    marked = met.withColumn("fair", F.coalesce(fair, F.lit(False)))
    marked = marked.withColumn("n", F.when(F.col("fair"), F.row_number().over(Window.partitionBy("file", "target", "fair").orderBy("line"))))
    problem = F.when(F.col("of").isNull() | (F.col("target") >= F.col("line")), "no earlier row").when(F.col("of") == "correction", "a correction").when(F.col("n") > 1, "already voided")
    return marked.select("file", "line", "target", problem.alias("problem"))


def effective(rows: DataFrame) -> DataFrame:
    """Rows that count: no corrections, nothing voided.

    A correction is sent to the line it names as well, so rows and what is said of them meet in one shuffle of (file, line), and
    the log is parsed once.
    """
    target = F.when(F.col("event") == "correction", field("supersedes").try_cast("long"))
    own, claim = F.struct(F.col("line").alias("to"), F.lit(None).cast("long").alias("by")), F.struct(target.alias("to"), F.col("line").alias("by"))
    sent = rows.withColumn("_at", F.explode(F.when(target.isNotNull(), F.array(own, claim)).otherwise(F.array(own))))
    last = F.max("_at.by").over(Window.partitionBy("file", "_at.to"))
    met = sent.withColumn("_last", last).where("_at.by is null and event != 'correction' and coalesce(_last <= line, true)")
    return met.select(*rows.columns)


def voided_counts(rows: DataFrame) -> DataFrame:
    gone = voids(rows).where("problem is null").select("file", F.col("target").alias("line"))
    return rows.join(gone, ["file", "line"], "left_semi").groupBy("event").agg(F.count("*").alias("voided"))


def record_errors(rows: DataFrame, codes: list[str] | None = None, severities: list[str] | None = None) -> DataFrame:
    """rows with `errors`: missing envelope fields, unknown events, missing or ill-typed data fields, values not allowed."""
    checks = [F.when(F.col(k).isNull(), F.lit(f"missing {k}")) for k in ENVELOPE]
    checks.append(F.when(~F.col("event").isin(list(REQUIRED)), F.lit("unknown event")))
    j = F.try_parse_json("data")
    for event, fields in REQUIRED.items():
        for name, kind in fields.items():
            schema = F.schema_of_variant(F.try_variant_get(j, f"$.{name}", "variant"))
            fits = {"string": schema == "STRING", "array": schema.startswith("ARRAY"), "number": schema == "BIGINT"}[kind]
            checks.append(F.when((F.col("event") == event) & ~F.coalesce(fits, F.lit(False)), F.lit(f"{event}.{name}")))
    for (event, name), values in ALLOWED.items():
        checks.append(F.when((F.col("event") == event) & ~field(name).isin(values), F.lit(f"{event}.{name} value")))
    if codes:
        checks.append(F.when((F.col("event") == "failure") & ~field("code").isin(codes), F.lit("unknown code")))
    if severities:
        checks.append(F.when((F.col("event") == "failure") & ~field("severity").isin(severities), F.lit("unknown severity")))
    return rows.withColumn("errors", F.array_compact(F.array(*checks)))


def file_errors(rows: DataFrame) -> DataFrame:
    """file, problem: order of time, first event, number of ends, rows after the end, declared failures."""
    real = effective(rows)
    back = rows.withColumn("before", F.lag("ts").over(Window.partitionBy("file").orderBy("line"))).where("before > ts").select("file", F.lit("time goes back").alias("problem"))
    by = real.groupBy("file").agg(
        F.min_by("event", "line").alias("first"),
        F.count_if(F.col("event") == "loop_end").alias("ends"),
        F.min(F.when(F.col("event") == "loop_end", F.col("line"))).alias("end_line"),
        F.max("line").alias("last"),
        F.count_if(F.col("event") == "failure").alias("failures"),
        F.max(F.when(F.col("event") == "loop_end", field("failure_count").try_cast("long"))).alias("declared"),
    )
    gone = voids(rows).where("problem is null").groupBy("file").agg(F.count("*").alias("slots"))
    after = real.join(by.select("file", "end_line"), "file").where("line > end_line").groupBy("file").agg(F.count("*").alias("after"))
    told = by.join(gone, "file", "left").join(after, "file", "left")
    problems = F.array_compact(F.array(
        F.when(F.col("first") != "loop_start", F.lit("does not begin with loop_start")),
        F.when(F.col("ends") > 1, F.lit("several ends")),
        F.when(F.coalesce("after", F.lit(0)) > F.coalesce("slots", F.lit(0)), F.lit("rows after the end")),
        F.when(F.col("declared") != F.col("failures"), F.lit("failure count differs")),
    ))
    return told.select("file", F.explode(problems).alias("problem")).union(back.distinct())


def loop_facts(rows: DataFrame) -> DataFrame:
    """A row for each (project, loop_id) of effective rows with times, goal, outcome, counts and the last test run."""
    is_ = lambda e: F.col("event") == e
    named = is_("loop_start") | is_("loop_end") | is_("test_run")
    rows = rows.withColumn("d", F.when(named, F.from_json("data", "goal string, outcome string, passed string, failed string")))
    at = F.when(is_("test_run"), F.struct("file", "line"))
    last = lambda name: F.max_by(F.when(is_("test_run"), F.col(f"d.{name}").try_cast("long")), at)
    return rows.groupBy("project", "loop_id").agg(
        F.max(F.when(is_("loop_start"), F.col("ts"))).alias("started_at"),
        F.max(F.when(is_("loop_end"), F.col("ts"))).alias("ended_at"),
        F.max(F.when(is_("loop_start"), F.col("d.goal"))).alias("goal"),
        F.max(F.when(is_("loop_end"), F.col("d.outcome"))).alias("outcome"),
        F.count_if(is_("failure")).alias("n_failures"),
        F.count_if(is_("commit")).alias("n_commits"),
        F.count_if(is_("test_run")).alias("n_test_runs"),
        last("passed").alias("last_tests_passed"),
        last("failed").alias("last_tests_failed"),
    )


def failure_facts(rows: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    names = ["code", "severity", "detected_stage", "introduced_stage", "summary", "resolution", "harness_ref"]
    out = rows.where("event = 'failure'").select("ts", "project", "loop_id", *(field(n).alias(n) for n in names))
    if taxonomy is not None:
        out = out.join(F.broadcast(taxonomy.select("code", "name")), "code", "left").fillna("?", ["name"])  # a fixed dimension of codes
    return out


def two_strike(failures: DataFrame) -> DataFrame:
    """code, total, needs_hc (seen twice), has_hc_ref; most frequent first."""
    out = failures.groupBy("code").agg(F.count("*").alias("total"), F.bool_or(F.col("harness_ref").isNotNull() & (F.col("harness_ref") != "")).alias("has_hc_ref"))
    return out.select("code", "total", (F.col("total") >= 2).alias("needs_hc"), "has_hc_ref").orderBy(F.desc("total"), "code")


def flattened(rows: DataFrame, fields: list[str], keep: list[str] = ()) -> DataFrame:
    """The columns to keep, the envelope and a data_ column for each field."""
    return rows.select(*keep, *ENVELOPE[:-1], *(field(f).alias(f"data_{f}") for f in fields))


def attribution(base: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """key, state: new (only now), residual (both), fixed (only before)."""
    b, c = base.select(key).distinct(), current.select(key).distinct()
    met = b.withColumn("b", F.lit(1)).join(c.withColumn("c", F.lit(1)), key, "full_outer")
    return met.select(key, F.when(F.col("b").isNull(), "new").when(F.col("c").isNull(), "fixed").otherwise("residual").alias("state"))


# Patterns of secrets that block, and of code that warns.
SECRETS = {
    "private key": r"-----BEGIN (RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----",
    "access key": r"AKIA[0-9A-Z]{16}",
    "written credential": r"(?i)\b(api[_-]?key|secret|token|password|passwd)\b\s*[=:]\s*['\"][^'\"]{8,}['\"]",
}
WARNINGS = {"eval": r"\beval\s*\(", "sql concatenation": r"(?i)(execute|cursor\.execute)\s*\(\s*[\"'].*%s.*[\"']\s*%"}


def secret_scan(lines: DataFrame, text: str = "text") -> DataFrame:
    """lines with the labels of the patterns found."""
    found = [F.when(F.col(text).rlike(p), F.lit(name)) for name, p in SECRETS.items()]
    warned = [F.when(F.col(text).rlike(p), F.lit(name)) for name, p in WARNINGS.items()]
    return lines.withColumn("block", F.array_compact(F.array(*found))).withColumn("warn", F.array_compact(F.array(*warned)))


def diff_gate(numstat: DataFrame, max_lines: int = 500, max_files: int = 30, exempt: list[str] = ()) -> DataFrame:
    """lines, files, ok: the size of a change (added, deleted, file) without exempt paths (shell patterns)."""
    out = numstat
    for glob in exempt:
        rx = "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if c in r".+()|^$[]{}\\" else c for c in glob)
        out = out.where(~F.col("file").rlike(f"^{rx}$"))
    total = out.agg(F.coalesce(F.sum(F.col("added") + F.col("deleted")), F.lit(0)).alias("lines"), F.count("*").alias("files"))
    return total.withColumn("ok", (F.col("lines") <= max_lines) & (F.col("files") <= max_files))


def key_values(pairs: Column, text_keys: list[str] = ()) -> Column:
    """A map of key=value strings to JSON texts: values that are JSON keep their type, all others, and those of text_keys, become JSON
    strings."""
    value = lambda p: F.substring(p, F.locate("=", p) + 1, F.length(p))
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    kept = lambda p: F.substring_index(p, "=", 1).isin(list(text_keys)) if text_keys else F.lit(False)
    typed = lambda p: F.coalesce(F.when(~kept(p), F.to_json(F.try_parse_json(value(p)))), quoted(value(p)))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), typed(p).alias("v"))))


def version_at_least(v: Column, *wanted: int) -> Column:
    parts = F.transform(F.split(v, r"\."), lambda x: x.try_cast("int"))
    return parts >= F.array(*(F.lit(x) for x in wanted))


def append_errors(new: DataFrame, log: DataFrame) -> DataFrame:
    """new (rows for files of log) with `refused`: why a row may not follow the log.

    A row must be of its file's project, unless it is a correction; a correction must name a row that counts; a file with an end takes
    only rows that replace voided ones of their event, one for each. Rows of new count in the order of their lines.
    """
    real = effective(log)
    project = real.groupBy("file").agg(F.min_by("project", "line").alias("_project"), F.bool_or(F.col("event") == "loop_end").alias("_ended"))
    end = log.where("event = 'loop_end'").groupBy("file").agg(F.max("line").alias("_end"))
    gone = voids(log).where("problem is null").select("file", F.col("target").alias("line"))
    voided = log.join(gone, ["file", "line"], "left_semi").groupBy("file", "event").agg(F.count("*").alias("_voided"))
    replaced = log.join(end, "file").where("line > _end").groupBy("file", "event").agg(F.count("*").alias("_replaced"))
    targets = real.select("file", F.col("line").alias("_target"), F.lit(True).alias("_counts"))
    earlier = F.row_number().over(Window.partitionBy("file", "event").orderBy("line")) - 1
    met = new.withColumn("_target", field("supersedes").try_cast("long")).withColumn("_earlier", earlier)
    met = met.join(project, "file", "left").join(voided, ["file", "event"], "left").join(replaced, ["file", "event"], "left").join(targets, ["file", "_target"], "left")
    correction = F.col("event") == "correction"
    slots = F.coalesce("_voided", F.lit(0)) - F.coalesce("_replaced", F.lit(0)) - F.col("_earlier")
    checks = [
        F.when(~correction & (F.col("_project") != F.col("project")), F.lit("another project")),
        F.when(correction & F.col("_counts").isNull(), F.lit("no row to correct")),
        F.when(~correction & F.coalesce("_ended", F.lit(False)) & (slots <= 0), F.lit("the loop has ended")),
    ]
    return met.withColumn("refused", F.array_compact(F.array(*checks))).select(*new.columns, "refused")


def added_lines(diff: DataFrame) -> DataFrame:
    """Rows file, no, value of unified diffs to path, line, text of each added line. A diff's rows meet by its file."""
    w = Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("value")
    path = F.last(F.when(F.startswith(v, F.lit("+++ b/")), v.substr(F.lit(7), F.length(v))), ignorenulls=True).over(w)
    hunk = F.sum(F.startswith(v, F.lit("@@")).cast("long")).over(w)
    start = F.last(F.when(F.startswith(v, F.lit("@@")), F.coalesce(F.regexp_extract(v, r"\+(\d+)", 1).try_cast("long"), F.lit(0))), ignorenulls=True).over(w)
    added = F.startswith(v, F.lit("+")) & ~F.startswith(v, F.lit("+++"))
    named = diff.select("file", "no", v, F.coalesce(path, F.lit("?")).alias("path"), hunk.alias("h"), F.coalesce(start, F.lit(0)).alias("s")).where(added)
    at = F.row_number().over(Window.partitionBy("file", "h").orderBy("no")) - 1
    return named.select("path", (F.col("s") + at).alias("line"), v.substr(F.lit(2), F.length(v)).alias("text"))


def top_files(numstat: DataFrame, n: int = 5) -> DataFrame:
    """The n files with the most changed lines; ties by name."""
    return numstat.select("file", (F.col("added") + F.col("deleted")).alias("lines")).orderBy(F.desc("lines"), "file").limit(n)
