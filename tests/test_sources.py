import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import calibrate, eventlog, selection
from quillspark.sources import readers, writers


def test_catalogue_and_selection(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿作品ID,作品名,姓,名,文字遣い種別,分類番号,テキストファイルURL,作品著作権フラグ\n000001,あ,山,川,新字新仮名,NDC 913,http://x/a.zip,なし\n000002,い,山,川,新字旧仮名,NDC 911,http://x/b.zip,あり\n000003,う,海,空,その他,,,なし\n", encoding="utf-8")
    c = readers.catalogue(spark, str(tmp_path / "c.csv"))
    pop = selection.population(c, F.col("作品著作権フラグ"), "なし", F.col("テキストファイルURL"))
    assert [r["作品ID"] for r in pop.collect()] == ["000001"]
    rows = c.withColumn("順位スコア", F.lit(3))
    a = writers.selection(rows, str(tmp_path / "s"), readers.SELECTION, "作品ID")
    assert a == writers.digest(rows.repartition(7), readers.SELECTION, "作品ID")
    back = readers.selection(spark, str(tmp_path / "s"))
    assert sorted(r["順位スコア"] for r in back.collect()) == [3, 3, 3]


def test_greedy_selection_equals_sweeps(spark):
    import collections
    import random

    r = random.Random(1)
    for _ in range(3):
        pop = [(i, r.choice("ABCD"), r.choice([None, None, *range(5)])) for i in range(60)]
        cap, target = r.randint(1, 6), r.randint(5, 50)
        ranked = sorted((x for x in pop if x[2] is not None), key=lambda x: (-x[2], x[0]))
        rest = [x for x in pop if x[2] is None]
        got, n = [], collections.Counter()
        for rows, limit in ((ranked, cap), (rest, cap), (ranked, cap + 1), (rest, cap + 1)):
            for x in rows:
                if len(got) < target and x[0] not in got and n[x[1]] < limit:
                    n[x[1]] += 1
                    got.append(x[0])
        df = spark.createDataFrame(pop, "id long, author string, score int")
        assert [x.id for x in selection.select_capped(df, cap, target).collect()] == got


def test_texts_zips_and_caps(spark, tmp_path):
    for i, t in ((7, "a\nb"), (12, "日本"), (3, "")):
        (tmp_path / f"{i:06d}.txt").write_text(t, encoding="utf-8")
    d = readers.corpus_folder(spark, str(tmp_path))
    assert {r.doc_id: r.text for r in d.collect()} == {7: "a\nb", 12: "日本"}  # a file without a byte has no row
    assert sorted(r.doc_id for r in readers.capped(d, 3).collect()) == [7]
    with zipfile.ZipFile(tmp_path / "000005.zip", "w") as z:
        z.writestr("a.html", "x")
        z.writestr("a.txt", "吾輩".encode("cp932"))
    (tmp_path / "000006.zip").write_bytes(b"no archive")
    got = {r.doc_id: (r.text, r.problem) for r in readers.zipped_texts(spark, str(tmp_path)).collect()}
    assert got == {5: ("吾輩", None), 6: (None, "bad archive")}
    report = writers.fetch_report(readers.zipped_texts(spark, str(tmp_path))).first()
    assert (report.selected, report.attempted, report.failed, report.raw_files, report.within) == (2, 2, 1, 1, False)
    assert [(x.doc_id, x.problem) for x in report.fails] == [(6, "bad archive")]


def test_ranking_and_metadata(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"months": ["1"], "works": [{"id": "1", "score": 5, "months": 1, "best_rank": 2, "title": "t"}]}))
    assert readers.ranking(spark, str(tmp_path / "r.json")).first().score == 5
    works = spark.createDataFrame([("01", "t", "a", "旧字旧仮名", "NDC 911", 3), ("02", "u", "b", None, "?", 4)], "id string, title string, author string, kana string, ndc string, chars long")
    assert [tuple(r) for r in writers.metadata(works).orderBy("id").collect()] == [(1, "t", "a", 2, "詩歌", 3), (2, "u", "b", 4, "その他", 4)]


def log(spark, tmp_path, records, name="loop_001"):
    (tmp_path / f"{name}.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in records) + "\n")
    return eventlog.parse(readers.log_lines(spark, str(tmp_path)))


def rec(event, ts="2024-01-01T00:00:00+09:00", **data):
    return {"v": "1.2", "ts": ts, "project": "p", "loop_id": "loop_001", "event": event, "data": data}


def test_event_log(spark, tmp_path):
    rows = log(spark, tmp_path, [
        rec("loop_start", goal="g", spec_refs=[], scaffold_version="1", agent="a"), "", "{broken",
        rec("test_run", command="c", passed=3, failed=1), rec("failure", code="E1", severity="low", detected_stage=1, summary="s", resolution="r"),
        rec("correction", supersedes=5, reason="x"), rec("correction", supersedes=5, reason="again"), rec("correction", supersedes=99, reason="?"), rec("correction", supersedes=6, reason="?"),
        rec("failure", code="E1", severity="low", detected_stage=1, summary="s", resolution="r", harness_ref="HC-1"), rec("test_run", command="c", passed=4, failed=0),
        rec("commit", sha="1", kind="odd"), rec("loop_end", outcome="success", failure_count=2, summary="s"),
    ])
    assert rows.count() == 11
    assert {(r.line, r.problem) for r in eventlog.voids(rows).collect()} == {(6, None), (7, "already voided"), (8, "no earlier row"), (9, "a correction")}
    real = eventlog.effective(rows)
    assert sorted(r.line for r in real.collect()) == [1, 4, 10, 11, 12, 13]
    fact = eventlog.loop_facts(real).first()
    assert (fact.n_failures, fact.n_test_runs, fact.last_tests_passed, fact.outcome) == (1, 2, 4, "success")
    assert {r.problem for r in eventlog.file_errors(rows).collect()} == {"failure count differs"}
    errors = {r.line: r.errors for r in eventlog.record_errors(rows).where("size(errors) > 0").collect()}
    assert errors == {12: ["commit.kind value"]}
    strike = eventlog.two_strike(eventlog.failure_facts(real)).first()
    assert (strike.code, strike.total, strike.needs_hc, strike.has_hc_ref) == ("E1", 1, False, True)
    assert writers.append_events(rows, str(tmp_path / "out")) == 1


def test_calibration_arithmetic(spark):
    c = spark.createDataFrame([("a", "x", 58583, 58275), ("b", "y", 705, 36), ("c", "z", 0, 0)], "rule string, form string, hits long, old long")
    got = {r.rule: (r.old_ratio, r.old_ratio_pct, r.default_on) for r in calibrate.gate(calibrate.rule_ratios(c)).collect()}
    assert got == {"a": (0.9947, 99, True), "b": (0.0511, 5, False), "c": (0.0, 0, False)}
    works = spark.createDataFrame([(1, "old"), (2, "new"), (3, "old")], "id long, kana string")
    made = {r.rule: json.loads(r.json) for r in writers.calibration(calibrate.rule_ratios(c), c, works, F.col("kana") == "old").collect()}
    assert len(made) == 3 and made["a"]["works"] == 3 and made["a"]["old_kana_works"] == 2 and made["b"]["probes"]["y"] == {"hits": 705, "old": 36}


def test_append_guards(spark, tmp_path):
    start = rec("loop_start", goal="g", spec_refs=[], scaffold_version="1", agent="a")
    failed = rec("failure", code="E1", severity="low", detected_stage=1, summary="s", resolution="r")
    rows = log(spark, tmp_path, [start, failed, rec("loop_end", outcome="success", failure_count=1, summary="s"), rec("correction", supersedes=2, reason="x")])
    new = tmp_path / "new"
    new.mkdir()
    more = log(spark, new, [failed, failed, rec("commit", sha="1", kind="fix"), rec("correction", supersedes=2, reason="x"), rec("correction", supersedes=1, reason="x"), {**failed, "project": "q"}])
    got = {r.line: r.refused for r in eventlog.append_errors(more, rows).collect()}
    assert got == {1: [], 2: ["the loop has ended"], 3: ["the loop has ended"], 4: ["no row to correct"], 5: [], 6: ["another project", "the loop has ended"]}
    out = str(tmp_path / "out")
    assert writers.append_events(more, out, rows) == 4
    assert sorted(json.loads(r.value)["event"] for r in spark.read.text(out).collect()) == ["correction", "failure"]


def test_taxonomy_works_probe_and_index_table(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"categories": {"A": "first"}, "codes": {"E1": {"category": "A", "name": "n", "definition": "d"}, "E2": {"category": "?", "name": "m", "definition": "e"}}}))
    got = {r.code: (r.category_name, r.name) for r in readers.taxonomy(spark, str(tmp_path / "t.json")).collect()}
    assert got == {"E1": ("first", "n"), "E2": (None, "m")}
    work = {"id": "000001", "title": "t", "author": "a", "kana": "k", "ndc": "n", "raw_chars": 9, "chars": 5, "lines": 1, "utf8": 15, "forms": {"footer": "footer"}, "acc": {"note": 4}}
    (tmp_path / "w.json").write_text(json.dumps({"n": 1, "excluded": [], "works": [work]}))
    w = readers.works(spark, str(tmp_path / "w.json")).first()
    assert (w.id, w.forms.footer, w.acc.note, w.acc.ruby) == ("000001", "footer", 4, None)
    writers.works(readers.works(spark, str(tmp_path / "w.json")), spark.createDataFrame([("2", "u", "none")], "id string, title string, reason string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "summary")).first().asDict() == {"n": 1, "excluded": 1}
    assert spark.read.json(str(tmp_path / "out" / "works")).first().acc.note == 4
    (tmp_path / "p.json").write_text(json.dumps({"seed": 1, "cap": 2, "pop": 3, "selected": 2, "n": 1, "records": [{"id": "1", "zip": 5}], "fails": []}))
    assert readers.probe_sample(spark, str(tmp_path / "p.json")).first().records[0].zip == 5
    spark.createDataFrame([(1, 1)], "a int, format_version int").write.parquet(str(tmp_path / "x"))
    assert readers.index_table(spark, str(tmp_path / "x"), 1).count() == 1
    with pytest.raises(ValueError, match="format versions"):
        readers.index_table(spark, str(tmp_path / "x"), 2)


def test_pages_and_diffs_from_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("日本 é".encode())
    (tmp_path / "b.html").write_bytes("日本".encode("cp932"))
    assert {r.name: r.html for r in readers.web_pages(spark, str(tmp_path)).collect()} == {"a": "日本 é", "b": "日本"}
    (tmp_path / "c.diff").write_text("--- a/x\n+++ b/x\n@@ -1 +5,2 @@\n+one\n+two\n")
    rows = eventlog.added_lines(readers.diff_lines(spark, str(tmp_path))).collect()
    assert sorted(tuple(r) for r in rows) == [("x", 5, "one"), ("x", 6, "two")]
    (tmp_path / "n.txt").write_text("3\t1\tsrc/a\n-\t-\tbin\n")
    assert {tuple(r) for r in readers.numstat(spark, str(tmp_path / "n.txt")).collect()} == {(3, 1, "src/a"), (0, 0, "bin")}


def test_text_keys_and_probe(spark):
    df = spark.createDataFrame([(["sha=72817e6", "n=3"],)], "p array<string>")
    assert df.select(eventlog.key_values(F.col("p"), ["sha"]).alias("m")).first().m == {"sha": '"72817e6"', "n": "3"}
    t = "題\n" + "-" * 20 + "\n記号\n" + "-" * 20 + "\n本 文《ほんぶん》だ。\n底本：x\n"
    from quillspark.operators import normalize, selection

    df = spark.createDataFrame([(1, t), (2, "b"), (3, "c")], "id long, text string")
    assert df.where("id = 1").select(normalize.probe_size(F.col("text")).alias("t")).first().t == "本文だ。"
    assert selection.sampled(df, 2, 5).count() == 2 and selection.sampled(df, 2, 5).collect() == selection.sampled(df.repartition(3), 2, 5).collect()


def test_lines_lose_white_space_at_their_ends(spark):
    from quillspark.functions import text as tx

    t = "a \t\n\u3000 b\u3000\u2028\n" + " " * 200_000 + "x\n \n\x1c"
    assert spark.createDataFrame([(t,)], "t string").select(tx.rstrip_lines(F.col("t")).alias("t")).first().t == "\n".join(x.rstrip() for x in t.split("\n"))


def test_stream_windows_need_a_watermark(spark, sf):
    from quillspark.streaming import ingest

    s = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parquet*")
    q = ingest.windowed_events(s).writeStream.outputMode("append").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").columns == ["window", "event_type", "n", "value"]
