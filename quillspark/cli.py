"""python -m quillspark.cli kwic|variants|shards|measure|fingerprint|log-validate|log-summary|log-export|log-append|gate ..."""

from __future__ import annotations

import argparse
import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark.api import Corpus
from quillspark.operators import eventlog, index
from quillspark.sources import readers, writers


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillspark")
    sub = p.add_subparsers(dest="what", required=True)
    k = sub.add_parser("kwic", help="first rows of a word in context")
    k.add_argument("corpus")
    k.add_argument("word")
    k.add_argument("n", type=int, nargs="?", default=10)
    v = sub.add_parser("variants", help="counts of a word and its variants")
    v.add_argument("corpus")
    v.add_argument("word")
    v.add_argument("--risky", action="store_true")
    s = sub.add_parser("shards", help="plan and manifest")
    s.add_argument("corpus")
    s.add_argument("target", type=int, nargs="?", default=6_000_000)
    m = sub.add_parser("measure", help="bytes, entropy, mean code length and estimated index size of a corpus")
    m.add_argument("corpus")
    sub.add_parser("fingerprint", help="hash of the index format")
    w = sub.add_parser("log-append", help="append one event to a loop's log")
    w.add_argument("logs")
    w.add_argument("loop")
    w.add_argument("event")
    w.add_argument("pairs", nargs="*", metavar="key=value")
    w.add_argument("--project", default="")
    w.add_argument("--ts", default="")
    g = sub.add_parser("gate", help="size and secrets of a change: a numstat listing and a folder of diffs")
    g.add_argument("numstat")
    g.add_argument("diffs")
    g.add_argument("--exempt", action="append", default=[])
    for name in ("log-validate", "log-summary", "log-export"):
        x = sub.add_parser(name)
        x.add_argument("logs")
        if name == "log-export":
            x.add_argument("out")
    a = p.parse_args(argv)
    if a.what == "fingerprint":
        print(index.fingerprint())
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.what == "kwic":
        Corpus.load(spark, a.corpus).kwic(a.word, max_rows=a.n).orderBy("doc_id", "pos").limit(a.n).show(a.n, False)
    elif a.what == "variants":
        Corpus.load(spark, a.corpus).count_with_variants(a.word, a.risky).orderBy("ord").show(50, False)
    elif a.what == "shards":
        index.manifest(Corpus.load(spark, a.corpus).shards(a.target)).orderBy("shard_id").show(1000, False)
    elif a.what == "measure":
        corpus = Corpus.load(spark, a.corpus)
        histogram = index.byte_histogram(corpus.docs).cache()
        size, mean = histogram.agg(F.sum("n")).first()[0] or 0, index.mean_code_length(index.code_table(histogram)).first().mean_bits or 0.0
        print(f"bytes {size:,}; bits a byte: entropy {index.entropy(histogram).first().h0}, code {mean}; index about {index.index_size(size, mean):,} bytes")
        print(f"longest walk to a sampled row: {index.whole_most_steps(corpus.docs).agg(F.max('steps')).first()[0]}")
    elif a.what == "gate":
        stat = readers.numstat(spark, a.numstat)
        total = eventlog.diff_gate(stat, exempt=a.exempt).first()
        found = eventlog.secret_scan(eventlog.added_lines(readers.diff_lines(spark, a.diffs)))
        print(f"{total.lines} lines in {total.files} files: {'ok' if total.ok else 'too large'}")
        if not total.ok:
            eventlog.top_files(stat).show(5, False)
        found.where("size(block) + size(warn) > 0").select("path", "line", "block", "warn").show(1000, False)
        return int(not total.ok or found.where("size(block) > 0").count() > 0)
    elif a.what == "log-append":
        text_keys = [k for k, kind in eventlog.REQUIRED.get(a.event, {}).items() if kind == "string"]
        pairs = spark.createDataFrame([(a.pairs,)], "p array<string>").select(eventlog.key_values(F.col("p"), text_keys).alias("m")).first().m
        folder, name = Path(a.logs), f"{a.loop}.jsonl"
        folder.mkdir(parents=True, exist_ok=True)
        log = eventlog.parse(readers.log_lines(spark, a.logs)).where(F.col("file") == a.loop)
        project = a.project or (log.orderBy("line").select("project").first() or [""])[0]
        data = "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {v}" for k, v in pairs.items()) + "}"
        record = {"v": "1.2", "ts": a.ts or datetime.now().astimezone().isoformat(timespec="seconds"), "project": project, "loop_id": a.loop, "event": a.event}
        row = spark.createDataFrame([(a.loop, 1 << 40, *record.values(), data)], f"file string, line long, {', '.join(f'{k} string' for k in eventlog.ENVELOPE)}")
        judged = eventlog.append_errors(eventlog.record_errors(row), log).first()
        if judged.errors or judged.refused:
            print("not appended: " + "; ".join([*judged.errors, *judged.refused]))
            return 1
        with open(folder / name, "a", encoding="utf-8") as f:
            f.write(json.dumps(record, ensure_ascii=False)[:-1] + f', "data": {data}}}\n')
    else:
        rows = eventlog.parse(readers.log_lines(spark, a.logs))
        real = eventlog.effective(rows)
        if a.what == "log-validate":
            bad = eventlog.record_errors(rows).where("size(errors) > 0").select("file", "line", "errors")
            files = eventlog.file_errors(rows)
            bad.show(1000, False)
            files.show(1000, False)
            return int(bad.count() + files.count() > 0)
        if a.what == "log-summary":
            eventlog.loop_facts(real).orderBy("project", "loop_id").show(1000, False)
        else:
            failures = eventlog.failure_facts(real)
            writers.star_schema({"fact_loops": [eventlog.loop_facts(real)], "fact_failures": [failures], "view_two_strike": [eventlog.two_strike(failures)]}, a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
