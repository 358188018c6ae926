import re

from quillspark.operators import normalize as n

TEXT = (
    "題名\r\n\r\n著者\r\n\r\n" + "-" * 30 + "\n【テキスト中の記号】\n《》：ルビ\n" + "-" * 30 + "\n\n\n"
    "吾輩《わがはい》は｜猫《ねこ》である。　\n［＃ここから］※［＃二の字点］\n" + "-" * 25 + "\n\n\n\n名前は無い。\n底本：「全集」\n入力：だれか\n"
)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, title string, author string")
    return {r.doc_id: r for r in n.normalize(df).collect()}


def test_fixture_accounting_and_idempotence(spark):
    got = run(spark, [(1, TEXT, "題名", "著者"), (2, TEXT, "別", "著者"), (3, "本文\n底本：x\n", "", ""), (4, None, None, None), (5, "題名\n\n者著\n本", "題名", "著者")])
    one = got[1]
    assert one.body == "吾輩は猫である。\n\n名前は無い。\n"
    assert one.forms.asDict() == {"title": "title+author", "legend": "legend", "footer": "footer"}
    assert one.acc.ruby == len("《わがはい》《ねこ》") + len("《》") and one.acc.pipe == 1
    for i in (1, 2, 3, 5):
        assert got[i].acc.balance == 0
        assert got[i].acc["in"] == got[i].acc.out + sum(got[i].acc[h] for h in n.HEADINGS)
    assert got[2].forms.title == "none" and got[3].forms.footer == "refused" and got[3].body == "本文\n底本：x\n"
    assert got[4].body == "\n" and got[5].body == "本\n"
    again = run(spark, [(1, one.body, "題名", "著者")])[1]
    assert again.body == one.body


def test_no_residue(spark):
    body = run(spark, [(1, TEXT, "題名", "著者")])[1].body
    assert not re.search("[《》｜]|［＃|^-{20,}", body, re.M)


def test_totals_and_split(spark):
    df = n.normalize(spark.createDataFrame([(1, TEXT, "題名", "著者"), (2, "x", "", "")], "doc_id long, text string, title string, author string"))
    ok, out = n.split_excluded(df)
    assert ok.count() == 1 and out.count() == 1
    assert n.corpus_totals(df).first().works == 2
    assert n.removal_totals(df).count() == len(n.HEADINGS)
