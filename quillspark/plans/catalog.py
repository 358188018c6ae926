"""Every query of the concordance engine on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import bits
from quillspark.functions import text as tx
from quillspark.functions.store import new_path
from quillspark.operators import calibrate, eventlog, index, normalize, search, selection, variants
from quillspark.operators.variants import Rule
from quillspark.sources import readers, writers
from quillspark.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents")


# --- SQL fragments: places of a pattern that cannot overlap itself, from the stretches between its occurrences -------------

WORD = "the"


def places(p: str, extra: str = "", source: str = "documents") -> str:
    n, b = len(p), len(p.encode())
    return f"""
  cut as (select doc_id, text{extra}, unnest(string_split(text, '{p}')) as piece, generate_subscripts(string_split(text, '{p}'), 1) as k, len(string_split(text, '{p}')) as n from {source} where contains(text, '{p}')),
  hit as (select doc_id, text{extra}, k, n, sum(strlen(piece) + {b}) over w - {b} as pos, sum(length(piece) + {n}) over w - {n} as cpos from cut window w as (partition by doc_id order by k rows unbounded preceding)),
  place as (select doc_id, text{extra}, cast(pos as bigint) as pos, cast(cpos as bigint) as cpos from hit where k < n)"""


def windows(p: str, width: int) -> str:
    n = len(p)
    longest = lambda s, side: f"{side}({s}, cast(list_max(list_filter(range(0, {width} + 1), lambda i: strlen({side}({s}, cast(i as bigint))) <= {width})) as bigint))"
    before = longest(f"substr(text, greatest(cpos - {width - 1}, 1), least({width}, cpos))", "right")
    after = longest(f"substr(text, cpos + {n} + 1, {width})", "left")
    return f"pos, '{p}' as form, {before} as before, '{p}' as hit, {after} as after"


OVERLAP = "thth"
OVERLAP_HITS = f"""with recursive f as (
  select doc_id, text, cast(instr(text, '{OVERLAP}') as bigint) as p from documents where contains(text, '{OVERLAP}')
  union all
  select doc_id, text, p + instr(substr(text, p + 1), '{OVERLAP}') from f where instr(substr(text, p + 1), '{OVERLAP}') > 0)"""


# --- counts ----------------------------------------------------------------------------------------------------------------


@query(f"select cast(sum((strlen(text) - strlen(replace(text, '{WORD}', ''))) / {len(WORD)}) as bigint) as hits from documents")
def count_total(spark, sf_dir):
    return search.count_total(docs(spark, sf_dir), WORD)


@query(f"select doc_id, cast((strlen(text) - strlen(replace(text, '{WORD}', ''))) / {len(WORD)} as bigint) as hits from documents where contains(text, '{WORD}')")
def count_by_doc(spark, sf_dir):
    return search.count_by_doc(docs(spark, sf_dir), WORD)


@query(f"{OVERLAP_HITS} select doc_id, count(*) as hits from f group by doc_id")
def count_overlapping(spark, sf_dir):
    return search.count_by_doc(docs(spark, sf_dir), OVERLAP)


@query(f"select doc_id, cast((strlen(text) - strlen(replace(text, '{OVERLAP}', ''))) / {len(OVERLAP)} as bigint) as hits from documents where contains(text, '{OVERLAP}')")
def count_nonoverlap(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.count_nonoverlapping(F.col("text"), OVERLAP).alias("hits")).where("hits > 0")


FORMS = ["the", "der", "que", "ón", "zzzz"]
VALUES_FORMS = ", ".join(f"({i}, '{f}')" for i, f in enumerate(FORMS))
FORM_HITS = "cast(coalesce(sum((strlen(text) - strlen(replace(text, form, ''))) / strlen(form)), 0) as bigint) as hits"


@query(f"select ord, form, {FORM_HITS} from documents, (values {VALUES_FORMS}) f(ord, form) group by all")
def count_by_form(spark, sf_dir):
    return search.count_by_form(docs(spark, sf_dir), FORMS)


@query(f"select * from (select source, ord, form, {FORM_HITS} from documents, (values {VALUES_FORMS}) f(ord, form) group by all) where hits > 0")
def count_by_form_and_source(spark, sf_dir):
    return search.count_by_form(docs(spark, sf_dir), FORMS, ["source"])


@query("select cast(0 as bigint) as hits")
def empty_pattern(spark, sf_dir):
    return search.count_total(docs(spark, sf_dir), "")


@query("select cast(0 as bigint) as hits")
def missing_pattern(spark, sf_dir):
    return search.count_total(docs(spark, sf_dir), "no such words anywhere, of any length")


# --- places ----------------------------------------------------------------------------------------------------------------


@query(f"with {places(WORD)} select doc_id, pos from place")
def locate_bytes(spark, sf_dir):
    return search.locate(docs(spark, sf_dir), WORD)


@query(f"with {places(WORD)} select doc_id, cpos as pos from place")
def locate_chars(spark, sf_dir):
    return search.locate(docs(spark, sf_dir), WORD, chars=True)


@query(f"{OVERLAP_HITS} select doc_id, cast(strlen(left(text, p - 1)) as bigint) as pos from f")
def locate_overlapping(spark, sf_dir):
    return search.locate(docs(spark, sf_dir), OVERLAP)


@query("select doc_id, substr(hex(encode(text)), 21, 80) as bytes from documents")
def extract_bytes(spark, sf_dir):
    return search.extract(docs(spark, sf_dir), 10, 40).select("doc_id", F.hex("bytes").alias("bytes"))


KWIC_WORD = "ción"


@query(f"with {places(KWIC_WORD)} select doc_id, {windows(KWIC_WORD, 30)} from place")
def kwic(spark, sf_dir):
    return search.kwic(docs(spark, sf_dir), KWIC_WORD)


@query(f"with {places(WORD)} select doc_id, {windows(WORD, 30)} from (select * from place order by doc_id, pos limit 50)")
def kwic_top_n(spark, sf_dir):
    return search.kwic_top(docs(spark, sf_dir), WORD, 50)


@query(f"with {places(WORD)} select doc_id, {windows(WORD, 30)} from (select * from place order by doc_id, pos limit 20 offset 40)")
def kwic_paged(spark, sf_dir):
    return search.page(search.kwic(docs(spark, sf_dir), WORD, max_rows=60), 2, 20)


@query(f"""with {places(WORD)}, r as (select *, cast(doc_id // 100 as bigint) as shard_id, row_number() over (partition by doc_id // 100 order by doc_id, pos) as rn from place)
select doc_id, shard_id, cast(rn as int) as rn, {windows(WORD, 30)} from r where rn <= 40""")
def kwic_per_shard(spark, sf_dir):
    return search.kwic_by_shard(docs(spark, sf_dir), [WORD], F.floor(F.col("doc_id") / 100))


@query(f"with {places('tionnt')} select doc_id, {windows('tionnt', 30)}, lang, source from place join (select doc_id, lang, source from documents) using (doc_id)")
def kwic_with_meta(spark, sf_dir):
    d = docs(spark, sf_dir)
    return search.with_metadata(search.kwic(d, "tionnt"), d.select("doc_id", "lang", "source"))


@query(f"with {places(KWIC_WORD, ', lang, source')} select doc_id, {windows(KWIC_WORD, 30)}, lang, source from place where lang in ('es', 'fr') and source in ('src1', 'src2', 'src3')")
def kwic_facet_filtered(spark, sf_dir):
    rows = search.kwic(search.facet_filter(docs(spark, sf_dir), lang=["es", "fr"], source=["src1", "src2", "src3"], toxic=[]), KWIC_WORD, keep=["lang", "source"])
    return rows


@query(f"select * from (select cast(doc_id // 100 as bigint) as shard_id, ord, form, {FORM_HITS} from documents, (values {VALUES_FORMS}) f(ord, form) group by all) where hits > 0")
def shards_with_hits(spark, sf_dir):
    return search.shards_with_hits(docs(spark, sf_dir), FORMS, F.floor(F.col("doc_id") / 100))


BUDGET_FORMS = ["tionnt", "ción", "sch"]


@query(f"with {places('tionnt')}, a as (select doc_id, {windows('tionnt', 30)} from place), {places('ción').replace('cut', 'cut1').replace('hit as', 'hit1 as').replace('from hit', 'from hit1').replace('place as', 'place1 as')}, b as (select doc_id, {windows('ción', 30)} from place1 where (select count(*) from place) < 400) select * from a union all select * from b")
def kwic_budget(spark, sf_dir):
    return search.within_budget(search.kwic(docs(spark, sf_dir), BUDGET_FORMS), BUDGET_FORMS).select("doc_id", "pos", "form", "before", "hit", "after")


# --- facets ----------------------------------------------------------------------------------------------------------------

COUNTED = f"(select doc_id, lang, source, cast((strlen(text) - strlen(replace(text, '{WORD}', ''))) / {len(WORD)} as bigint) as hits from documents where contains(text, '{WORD}'))"


def _counted(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "lang", "source", tx.count_overlapping(F.col("text"), WORD).alias("hits")).where("hits > 0")


@query(f"select doc_id, hits, cast(round(100.0 * hits / max(hits) over ()) as bigint) as width_pct from (select * from {COUNTED} order by hits desc, doc_id limit 8)")
def top_works(spark, sf_dir):
    return search.top_works(_counted(spark, sf_dir), 8)


@query(f"select lang, count(*) as docs, cast(sum(hits) as bigint) as hits from {COUNTED} group by lang")
def facet_lang(spark, sf_dir):
    return search.facet_counts(_counted(spark, sf_dir), "lang")


@query(f"select source, count(*) as docs, cast(sum(hits) as bigint) as hits from {COUNTED} group by source")
def facet_source(spark, sf_dir):
    return search.facet_counts(_counted(spark, sf_dir), "source")


@query(f"select coalesce(quality, -1) as quality, count(*) as docs, cast(sum(hits) as bigint) as hits from {COUNTED} left join labels using (doc_id) group by all")
def facet_label(spark, sf_dir):
    joined = _counted(spark, sf_dir).join(t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return search.facet_counts(joined.withColumn("quality", F.coalesce("quality", F.lit(-1))), "quality")


@query(f"select doc_id, hits, round(hits / sum(hits) over (), 6) as share from {COUNTED}")
def work_share_pct(spark, sf_dir):
    rows = _counted(spark, sf_dir).select("doc_id", "hits")
    total = rows.agg(F.sum("hits").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("doc_id", "hits", F.round(F.col("hits") / F.col("total"), 6).alias("share"))  # one row


# --- variants --------------------------------------------------------------------------------------------------------------

WORDS = ["あわれ", "ように", "しずか", "おもう", "そうして", "こえ", "いる", "ちょうど", "かし", "うた", "おと", "いう", "なお", "ん"]
# Expected forms and ratios, by default and with risky rules, derived by hand.
EXPECTED = {
    "あわれ": "あはれ 84",
    "ように": "やうに 99 よふに 96 やふに 96",
    "しずか": "しづか 80",
    "おもう": "おまう 99 おもふ 96 おまふ 96",
    "そうして": "さうして 99 そふして 96 さふして 96",
    "こえ": "こゑ 89",
    "いる": "ゐる 99",
    "ちょうど": "ちやうど 99 ちょふど 96 ちやふど 96",
    "いう": "ゐう 99 いふ 96 ゐふ 96",
    "なお": "なほ 77",
}
EXPECTED_RISKY = EXPECTED | {
    "しずか": "しづか 80 しずくわ 5 しづくわ 5 しずくは 84",
    "おもう": "おまう 99 おもふ 96 をもう 37 おまふ 96 をまう 37 をもふ 37 をまふ 37",
    "こえ": "こゑ 89 こへ 15",
    "かし": "くわし 5 くはし 84",
    "おと": "をと 37",
    "なお": "なほ 77 なを 37",
}


def _values(expected: dict[str, str]) -> list[tuple[str, int, str, int]]:
    rows = []
    for w in WORDS:
        parts = expected.get(w, "").split()
        rows += [(w, 0, w, 100)] + [(w, i + 1, parts[2 * i], int(parts[2 * i + 1])) for i in range(len(parts) // 2)]
    return rows


def _values_sql(rows) -> str:
    listed = ", ".join(f"('{w}', {o}, '{f}', {r})" for w, o, f, r in rows)
    return f"select word, cast(ord as int) as ord, form, cast(ratio as int) as ratio, ord = 0 as base from (values {listed}) v(word, ord, form, ratio)"


@query(_values_sql(_values(EXPECTED)))
def variant_expand(spark, sf_dir):
    return variants.variant_table(spark, WORDS)


@query(_values_sql(_values(EXPECTED_RISKY)))
def variant_expand_risky(spark, sf_dir):
    return variants.variant_table(spark, WORDS, risky=True)


@query(_values_sql([r for r in _values(EXPECTED_RISKY) if (r[0], r[2]) not in {(x[0], x[2]) for x in _values(EXPECTED)}]).replace("select word, cast(ord as int) as ord, form, cast(ratio as int) as ratio, ord = 0 as base", "select word, form"))
def variant_risky_diff(spark, sf_dir):
    every, usual = variants.variant_table(spark, WORDS, risky=True), variants.variant_table(spark, WORDS)
    return every.select("word", "form").exceptAll(usual.select("word", "form"))


LATIN = [Rule("é", "e", False, True, 80), Rule("è", "e", True, True, 60), Rule("ü", "u", False, False, 40)]
LATIN_FORMS = "(values (0, 'réè', 100, true), (1, 'reè', 60, false), (2, 'rée', 60, false), (3, 'ree', 60, false)) f(ord, form, ratio, base)"


def _latin(spark, sf_dir):
    rows = variants.variant_rows("réè", rules=LATIN, long=[])
    counted = search.count_by_form(docs(spark, sf_dir), [r[1] for r in rows])
    return counted.join(F.broadcast(spark.createDataFrame(rows, "ord int, form string, ratio int, base boolean").drop("form")), "ord")  # at most 48 forms


LATIN_COUNTS = f"(select cast(ord as int) as ord, form, {FORM_HITS}, cast(ratio as int) as ratio, base from documents, {LATIN_FORMS} group by all)"


@query(f"select * from {LATIN_COUNTS}")
def variant_count(spark, sf_dir):
    return _latin(spark, sf_dir)


@query(f"select cast(sum(hits) filter (base) as bigint) as base_hits, cast(sum(hits) filter (not base) as bigint) as extra_hits, round(100.0 * sum(hits) filter (not base) / sum(hits) filter (base), 4) as gain_pct from {LATIN_COUNTS}")
def variant_gain(spark, sf_dir):
    return variants.gain(_latin(spark, sf_dir))


@query(f"with {', '.join(places(f).replace('cut', f'cut{i}').replace('hit as', f'hit{i} as').replace('from hit', f'from hit{i}').replace('place as', f'place{i} as') for i, f in enumerate(['réè', 'reè', 'rée', 'ree']))} " + " union all ".join(f"select doc_id, {windows(f, 30)} from place{i}" for i, f in enumerate(["réè", "reè", "rée", "ree"])))
def variant_kwic(spark, sf_dir):
    return search.kwic(docs(spark, sf_dir), ["réè", *variants.expand("réè", rules=LATIN, long=[])])


# --- calibration -----------------------------------------------------------------------------------------------------------

PROBES = {"en": ["the", "ing", "tion"], "de": ["sch", "keit", "ung"], "es": ["ción", "que"], "none": ["zzzz"]}
PROBE_ROWS = ", ".join(f"('{r}', '{f}')" for r, fs in PROBES.items() for f in fs)
PROBE_COUNTS = f"""(select rule, form, cast(sum(n) as bigint) as hits, cast(sum(case when lang in ('de', 'es') then n else 0 end) as bigint) as old from
  (select rule, form, lang, (strlen(text) - strlen(replace(text, form, ''))) // strlen(form) as n from documents, (values {PROBE_ROWS}) p(rule, form)) group by rule, form)"""
RATIOS = f"(select rule, cast(sum(hits) as bigint) as hits, cast(sum(old) as bigint) as old_hits, coalesce(sum(old) / nullif(sum(hits), 0), 0.0) as r from {PROBE_COUNTS} group by rule)"


def _probed(spark, sf_dir):
    return calibrate.probe_counts(docs(spark, sf_dir), PROBES, F.col("lang").isin("de", "es"))


@query(f"select * from {PROBE_COUNTS}")
def calibrate_probes(spark, sf_dir):
    return _probed(spark, sf_dir)


DEFAULT_ROWS = ", ".join(f"('{r}', '{f}')" for r, fs in calibrate.PROBES.items() for f in fs)


@query(PROBE_COUNTS[1:-1].replace(PROBE_ROWS, DEFAULT_ROWS))
def calibrate_default_probes(spark, sf_dir):
    return calibrate.probe_counts(docs(spark, sf_dir), None, F.col("lang").isin("de", "es"))


@query(f"select rule, hits, old_hits, round(r, 4) as old_ratio, cast(floor(r * 100) as bigint) as old_ratio_pct from {RATIOS}")
def calibrate_rules(spark, sf_dir):
    return calibrate.rule_ratios(_probed(spark, sf_dir))


@query(f"select rule, hits, old_hits, round(r, 4) as old_ratio, cast(floor(r * 100) as bigint) as old_ratio_pct, floor(r * 100) >= 70 as default_on from {RATIOS}")
def calibrate_gate(spark, sf_dir):
    return calibrate.gate(calibrate.rule_ratios(_probed(spark, sf_dir)))


# --- selection -------------------------------------------------------------------------------------------------------------

FIRST_ORDERS = "(select o_custkey, o_orderkey, o_orderstatus, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1)"


@query(f"select * from {FIRST_ORDERS}")
def first_row_dedup(spark, sf_dir):
    return selection.first_of_each(t(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("select page_id, url from pages where contains(html, 'lang=\"en\"') and url like '%/'")
def population_filter(spark, sf_dir):
    flag = F.when(F.contains("html", F.lit('lang="en"')), "yes")
    return selection.population(t(spark, sf_dir, "pages"), flag, "yes", F.col("url"), "/").select("page_id", "url")


@query("select author, count(*) as works from (select o_custkey as author from orders where o_orderstatus = 'F') group by author")
def author_counts(spark, sf_dir):
    return selection.author_counts(t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "author"))


SELECTED = """(select * from (select author, id, score, rn from (
  select o_custkey as author, o_orderkey as id, case when o_orderstatus <> 'P' then o_totalprice end as score,
    row_number() over (partition by o_custkey order by o_orderstatus <> 'P' desc, case when o_orderstatus <> 'P' then o_totalprice end desc nulls last, o_orderkey) as rn from orders)
  where rn <= 4 order by rn = 4, score is not null desc, score desc nulls last, id limit 4000))"""


@query(f"select author, id, score, cast(rn as int) as rn, rn = 4 as refill from {SELECTED}")
def select_capped(spark, sf_dir):
    pop = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("author"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("score"))
    return selection.select_capped(pop, 3, 4000)


ENTRIES = "(select strftime(l_shipdate, '%Y-%m') as month, l_partkey as id, l_shipmode, rank from (select *, 'x' as l_shipmode, row_number() over (partition by strftime(l_shipdate, '%Y-%m') order by l_extendedprice desc, l_orderkey, l_linenumber) as rank from lineitem) where rank <= 500)"


@query(f"select id, cast(sum(501 - rank) as bigint) as score, count(*) as months, cast(min(rank) as int) as best_rank, arg_min(month, (month, rank)) as title from {ENTRIES} group by id")
def ranking_score(spark, sf_dir):
    from pyspark.sql import Window

    li = t(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_partkey").alias("id"), "l_extendedprice", "l_orderkey", "l_linenumber")
    w = Window.partitionBy("month").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    entries = li.withColumn("rank", F.row_number().over(w)).where("rank <= 500").withColumn("title", F.col("month"))
    return selection.ranking(entries)


LINK = r'<a href="(/[^"]*)">([^<]*)</a>'


@query(f"select page_id, cast(unnest(range(1, len(a) + 1)) as int) as rank, unnest(a) as entry, unnest(b) as title from (select page_id, regexp_extract_all(html, '{LINK}', 1) as a, regexp_extract_all(html, '{LINK}', 2) as b from pages)")
def html_ranking_scrape(spark, sf_dir):
    return selection.scrape_entries(t(spark, sf_dir, "pages"), LINK)


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def unlabelled_documents(spark, sf_dir):
    return selection.unmatched(docs(spark, sf_dir).select("doc_id"), t(spark, sf_dir, "labels"), "doc_id")


# --- normalisation ---------------------------------------------------------------------------------------------------------

LATIN_MARKUP = normalize.Markup(note=r"password=[^ \n]*", ruby=r"\(([^)\n]*)\)", pipe="|", rule=r"^-{20,}\s*$", footer="^(?:All rights|Licensed|This work)", footer_else="^(?:Copyright)", evidence="^(?:All rights|Licensed|This work)")
TITLE = "The and attion to thanedble the, anea. Eriner thanea."
STAGES = rf"""s0 as (select doc_id, text as t from documents),
  s1 as (select *, regexp_replace(t, 'password=[^ \n]*', '', 'g') as n from s0),
  s2 as (select *, regexp_replace(n, '\([^)\n]*\)', '', 'g') as r from s1),
  s3 as (select *, replace(r, '|', '') as p from s2),
  s4 as (select *, list_transform(string_split(p, chr(10)), lambda x: rtrim(x, ' ' || chr(9) || chr(160))) as l0 from s3),
  s5 as (select *, case when replace(l0[1], ' ', '') = '{TITLE.replace(' ', '')}' then l0[2:] else l0 end as l1 from s4),
  s6 as (select *, list_position(list_transform(l1, lambda x: regexp_matches(x, '^(All rights|Licensed|This work)')), true) as c from s5),
  s7 as (select *, case when c > 0 then l1[:c - 1] else l1 end as l3 from s6),
  s8 as (select *, array_to_string(l3, chr(10)) as joined from s7),
  s9 as (select *, regexp_replace(joined, '\n\n\n+', chr(10) || chr(10), 'g') as short from s8),
  s10 as (select *, trim(short, chr(10)) as body from s9)"""
SIZE = "cast(coalesce(list_sum(list_transform({0}, lambda x: length(x) + 1)), 0) as bigint)"
ACC_SQL = f"""select doc_id, length(t) - length(n) as note, length(n) - length(r) as ruby, length(r) - length(p) as pipe, length(p) + 1 - {SIZE.format('l0')} as trailing_ws,
  {SIZE.format('l0')} - {SIZE.format('l1')} as title, cast(0 as bigint) as legend, {SIZE.format('l1')} - {SIZE.format('l3')} as footer, cast(0 as bigint) as dash,
  length(joined) - length(short) as blank, length(short) - length(body) as edge, length(t) as "in", length(body) as out,
  case when len(l3) = 0 then -1 else 0 end as balance from s10"""


def _normalized(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text").withColumn("title", F.lit(TITLE)).withColumn("author", F.lit("nobody at all"))
    return normalize.normalize(d, LATIN_MARKUP)


@query(r"select doc_id, replace(regexp_replace(regexp_replace(text, 'password=[^ \n]*', '', 'g'), '\([^)\n]*\)', '', 'g'), '|', '') as text from documents")
def normalize_markup(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", normalize.strip_markup(F.col("text"), LATIN_MARKUP).alias("text"))


@query(f"with {STAGES} select doc_id, body || chr(10) as body, case when len(l1) < len(l0) then 'title+author' else 'none' end as title, 'none' as legend, case when c > 0 then 'footer' else 'none' end as footer from s10")
def normalize_lines(spark, sf_dir):
    return _normalized(spark, sf_dir).select("doc_id", "body", "forms.title", "forms.legend", "forms.footer")


@query(f"with {STAGES} select * replace (cast(balance as bigint) as balance) from ({ACC_SQL})")
def normalize_accounting(spark, sf_dir):
    return _normalized(spark, sf_dir).select("doc_id", "acc.*")


@query(f"with {STAGES} select count(*) as works, cast(sum(length(t)) as bigint) as chars_in, cast(sum(length(body)) as bigint) as chars_out, round(sum(length(body)) / sum(length(t)), 4) as retention, count(*) as no_legend, cast(sum(length(body) + 1 - length(replace(body, chr(10), ''))) as bigint) as lines, cast(sum(strlen(body) + 1) as bigint) as utf8 from s10")
def corpus_totals(spark, sf_dir):
    return normalize.corpus_totals(_normalized(spark, sf_dir))


@query(f"with {STAGES}, a as ({ACC_SQL}), u as (unpivot (select note, ruby, pipe, trailing_ws, title, legend, footer, dash, blank, edge from a) on columns(*) into name heading value v) select heading, cast(sum(v) as bigint) as chars, round(sum(v) / (select sum(\"in\") from a), 4) as share from u group by heading")
def removal_totals(spark, sf_dir):
    return normalize.removal_totals(_normalized(spark, sf_dir))


# --- shards and index ------------------------------------------------------------------------------------------------------

TARGET = 100_000
PLAN = f"""sizes as (select doc_id, cast(strlen(text) as bigint) as bytes, row_number() over (order by doc_id) as i from documents),
  plan as (select doc_id, bytes, i, bytes as filled, cast(0 as bigint) as shard_id from sizes where i = 1
    union all
    select s.doc_id, s.bytes, s.i, case when p.filled > 0 and p.filled + s.bytes > {TARGET} then s.bytes else p.filled + s.bytes end, p.shard_id + case when p.filled > 0 and p.filled + s.bytes > {TARGET} then 1 else 0 end
    from plan p join sizes s on s.i = p.i + 1)"""


def _planned(spark, sf_dir):
    return index.shard_plan(docs(spark, sf_dir).select("doc_id", F.octet_length("text").alias("bytes")), TARGET)


@query(f"with recursive {PLAN} select doc_id, bytes, shard_id from plan")
def shard_plan(spark, sf_dir):
    return _planned(spark, sf_dir)


@query(f"with recursive {PLAN} select doc_id, bytes, shard_id, cast(coalesce(sum(bytes) over (partition by shard_id order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as \"at\" from plan")
def doc_offsets(spark, sf_dir):
    return index.doc_offsets(_planned(spark, sf_dir))


@query(f"with recursive {PLAN} select shard_id, count(*) as docs, cast(sum(bytes) as bigint) as text, min(doc_id) as first_id, max(doc_id) as last_id, (select count(*) from plan) as works, cast((select sum(bytes) from plan) as bigint) as total_text, 1 as format_version from plan group by shard_id")
def manifest(spark, sf_dir):
    return index.manifest(_planned(spark, sf_dir))


@query(f"with recursive {PLAN}, o as (select shard_id, doc_id, bytes, coalesce(sum(bytes) over (partition by shard_id order by doc_id rows between unbounded preceding and 1 preceding), 0) as at_byte from plan), p as (select distinct shard_id, cast(unnest([0, 777, 50000, 99999]) as bigint) as pos from plan) select p.shard_id, pos, doc_id, cast(pos - at_byte as bigint) as pos_in_doc from p asof join o on p.shard_id = o.shard_id and p.pos >= o.at_byte where pos - at_byte < bytes")
def doc_of_position(spark, sf_dir):
    o = index.doc_offsets(_planned(spark, sf_dir))
    points = o.select("shard_id").distinct().select("shard_id", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 777, 50000, 99999)))).alias("pos"))
    return index.doc_of_position(points, o)


# The index columns of all texts, each text on its own.

# The SQL sorts suffixes by their first characters, and by the whole suffix only where these occur again in the same text.
SUFFIXES = """
cut as (select doc_id, row_number() over (order by doc_id) as t, text, unnest(range(1, length(text) + 2)) as pos from documents where text is not null),
headed as (select doc_id, t, text, pos, substr(text, pos, 48) as head from cut),
tied as (select doc_id, t, pos, head, if(pos = 1, '$', substr(text, pos - 1, 1)) as before, if(count(*) over (partition by t, head) > 1, substr(text, pos), null) as rest from headed),
suffix as (select doc_id, t, pos, before, row_number() over (partition by t order by head, rest) - 1 as row from tied)"""


def _texts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "text")


@query(f"with {SUFFIXES} select doc_id, row, pos from suffix")
def suffix_array(spark, sf_dir):
    return index.whole_suffix_array(_texts(spark, sf_dir))


@query(f"with {SUFFIXES} select doc_id, string_agg(before, '' order by row) as bwt, max(if(pos = 1, row, null)) as primary_row from suffix group by doc_id, t")
def bwt(spark, sf_dir):
    return index.whole_bwt(_texts(spark, sf_dir))


SYMBOLS = "(select doc_id, '' as symbol, 1 as n from documents where text is not null union all select doc_id, unnest(regexp_extract_all(text, '(?s).')), 1 from documents)"


@query(f"select doc_id, symbol, cast(n as bigint) as n, cast(coalesce(sum(n) over (partition by doc_id order by encode(symbol) rows between unbounded preceding and 1 preceding), 0) as bigint) as c from (select doc_id, symbol, sum(n) as n from {SYMBOLS} group by all)")
def c_table(spark, sf_dir):
    return index.whole_symbol_counts(_texts(spark, sf_dir))


@query(f"with {SUFFIXES} select doc_id, row, row_number() over (partition by t, if(pos = 1, null, before) order by row) - 1 as rank, coalesce(lag(row) over (partition by t order by pos), 0) as lf from suffix")
def lf_mapping(spark, sf_dir):
    return index.whole_lf_mapping(_texts(spark, sf_dir))


@query("select doc_id, text from documents where text is not null")
def inverse_bwt(spark, sf_dir):
    return index.whole_inverse_bwt(_texts(spark, sf_dir))


@query("select doc_id, cast((length(text) - length(replace(text, 'er', ''))) / 2 as bigint) as hits from documents where text is not null")
def backward_search_count(spark, sf_dir):
    return index.whole_backward_search(_texts(spark, sf_dir), "er")


@query(f"with {places('tionnt')} select doc_id, cpos as pos from place")
def backward_search_locate(spark, sf_dir):
    return index.whole_locate(_texts(spark, sf_dir), "tionnt")


@query("select doc_id, pos, substr(text, pos + 1, 1) as symbol from documents, (values (cast(0 as bigint)), (63), (64), (500), (4000)) v(pos) where pos < length(text)")
def bwt_access(spark, sf_dir):
    return index.whole_access(_texts(spark, sf_dir), [0, 63, 64, 500, 4000])


@query(f"with {SUFFIXES} select doc_id, row, pos from suffix where row % {index.SAMPLE} = 0")
def sa_sample(spark, sf_dir):
    return index.whole_suffix_array(_texts(spark, sf_dir), index.SAMPLE)


@query(f"with {SUFFIXES} select doc_id, pos - 1 as pos, row from suffix where (pos - 1) % {index.SAMPLE} = 0")
def isa_sample(spark, sf_dir):
    return index.whole_isa_sample(_texts(spark, sf_dir))


@query(f"with {SUFFIXES}, near as (select doc_id, t, pos - coalesce(max(if(row % {index.SAMPLE} = 0, pos, null)) over (partition by t order by pos), 0) as steps from suffix) select doc_id, max(steps) as steps from near group by doc_id, t")
def most_lf_steps(spark, sf_dir):
    return index.whole_most_steps(_texts(spark, sf_dir))


VOWELS = "aeiou"


@query(f"""select doc_id, i, cast(length(regexp_replace(left(text, i), '[^{VOWELS}]', '', 'g')) as bigint) as ones, contains('{VOWELS}', substr(text, i + 1, 1)) as bit
  from documents, (values (cast(0 as bigint)), (1), (63), (64), (65), (1000), (1023)) v(i) where i < length(text)""")
def bit_ranks(spark, sf_dir):
    places = F.array(*(F.lit(x).cast("long") for x in (0, 1, 63, 64, 65, 1000, 1023)))
    packed = _texts(spark, sf_dir).select("doc_id", F.length("text").alias("n"), bits.packed(bits.bits_of(F.col("text"), VOWELS)).alias("words"))
    at = lambda w: F.transform(F.filter(places, lambda i: i < F.col("n")), lambda i: F.struct(i.alias("i"), bits.rank1(w, i).alias("ones"), bits.bit_at(w, i).alias("bit")))
    return packed.select("doc_id", F.inline(tx.let(F.col("words"), at)))


HISTOGRAM = "(select cast(('0x' || h) as bigint) as byte, count(*) as n from (select unnest(regexp_extract_all(hex(encode(text)), '..')) as h from documents) group by 1)"


@query(f"select byte, n from {HISTOGRAM}")
def byte_histogram(spark, sf_dir):
    return index.byte_histogram(docs(spark, sf_dir))


@query(f"select round(sum(-(n / t) * log2(n / t)), 4) as h0 from (select n, sum(n) over () as t from {HISTOGRAM})")
def entropy_h0(spark, sf_dir):
    return index.entropy(index.byte_histogram(docs(spark, sf_dir)))


MERGES = f"""h as (select list_sort(list(cast(n as bigint))) as l, cast(0 as bigint) as bits from {HISTOGRAM}
    union all select list_sort(list_append(l[3:], l[1] + l[2])), bits + l[1] + l[2] from h where len(l) > 1)"""


@query(f"with recursive {MERGES} select round(max(bits) / (select sum(n) from {HISTOGRAM}), 4) as mean_bits from h")
def huffman_mean_len(spark, sf_dir):
    return index.mean_code_length(index.code_table(index.byte_histogram(docs(spark, sf_dir))))


RANGES = "(select distinct user_id, epoch_us(ts) // 1000000 as a, cast(3600 + value * 60 as bigint) as l from events)"


@query(f"""with m as (select *, case when a > max(a + l) over (partition by user_id order by a, l rows between unbounded preceding and 1 preceding) then 1 else 0 end as fresh from {RANGES}),
  i as (select *, sum(fresh) over (partition by user_id order by a, l rows unbounded preceding) as island from m)
select user_id, cast(min(a) as bigint) as "at", cast(max(a + l) - min(a) as bigint) as len from i group by user_id, island""")
def merge_ranges(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.round(3600 + F.col("value") * 60).cast("long").alias("len"))
    return index.merge_ranges(e, "user_id")


@query("select source as grp, not (bool_or(contains(text, 'ß')) and bool_or(contains(text, 'ñ'))) as skipped from documents group by source")
def symbol_pruning(spark, sf_dir):
    return index.prunable(index.symbol_sets(docs(spark, sf_dir), F.col("source")), "ßñ")


GRAM_WORD = "thanedble"


@query(f"select doc_id, cast((strlen(text) - strlen(replace(text, '{GRAM_WORD}', ''))) / {len(GRAM_WORD)} as bigint) as hits from documents where contains(text, '{GRAM_WORD}')")
def gram_index_lookup(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text")
    made = (spark.sparkContext.applicationId, sf_dir)
    if made not in _grams:  # built once for a session and table, as an index is
        _grams[made] = index.gram_index(d)
    found = index.gram_candidates(_grams[made], GRAM_WORD)
    return search.count_by_doc(d.join(found, "doc_id", "left_semi"), GRAM_WORD)


_grams: dict[tuple[str, str], DataFrame] = {}


# --- event logs ------------------------------------------------------------------------------------------------------------
# events as a log: a file for each user, a line for each event in order; errors void the line before them.

LINES = """(select user_id as file, row_number() over (partition by user_id order by ts, event_id) as line, event_type, ts, value, event_id from events)"""
LOG_SQL = f"""lines as (select file, line, ts, value, case event_type when 'error' then 'correction' when 'signup' then 'loop_start' when 'view' then 'test_run' when 'click' then 'failure' else 'loop_end' end as event from {LINES}),
  gone as (select file, line - 1 as line from lines c where event = 'correction' and exists (select 1 from lines x where x.file = c.file and x.line = c.line - 1 and x.event <> 'correction')),
  eff as (select * from lines where event <> 'correction' and (file, line) not in (select (file, line) from gone))"""


def _log(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    names = F.create_map(*(F.lit(x) for kv in {"error": "correction", "signup": "loop_start", "view": "test_run", "click": "failure", "purchase": "loop_end"}.items() for x in kv))
    e = t(spark, sf_dir, "events").withColumn("line", F.row_number().over(w).cast("long"))
    event = F.try_element_at(names, F.col("event_type"))
    data = F.struct(
        F.when(event == "correction", F.col("line") - 1).alias("supersedes"), F.when(event == "loop_start", "g").alias("goal"), F.when(event == "loop_end", "success").alias("outcome"),
        F.when(event == "test_run", F.floor("value")).alias("passed"), F.when(event == "test_run", F.lit(0)).alias("failed"), F.when(event == "failure", F.concat(F.lit("E"), F.floor(F.col("value")) % 7)).alias("code"),
        F.when((event == "failure") & (F.col("value") > 40), "HC-1").alias("harness_ref"),
    )
    text = F.to_json(F.struct(F.lit("1.2").alias("v"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.lit("p").alias("project"), F.col("user_id").cast("string").alias("loop_id"), event.alias("event"), data.alias("data")))
    return eventlog.parse(e.select(F.col("user_id").alias("file"), "line", text.alias("value")))


@query(f"with {LOG_SQL} select file, line, event from eff")
def log_effective(spark, sf_dir):
    return eventlog.effective(_log(spark, sf_dir)).select("file", "line", "event")


@query(f"with {LOG_SQL} select event, count(*) as voided from lines join gone using (file, line) group by event")
def log_voided(spark, sf_dir):
    return eventlog.voided_counts(_log(spark, sf_dir))


@query(f"""with {LOG_SQL} select 'p' as project, cast(file as varchar) as loop_id, count(*) filter (event = 'failure') as n_failures, count(*) filter (event = 'commit') as n_commits, count(*) filter (event = 'test_run') as n_test_runs,
  max(case event when 'loop_end' then 'success' end) as outcome, max(case event when 'loop_start' then 'g' end) as goal, cast(floor(arg_max(value, line) filter (event = 'test_run')) as bigint) as last_tests_passed from eff group by file""")
def log_facts(spark, sf_dir):
    return eventlog.loop_facts(eventlog.effective(_log(spark, sf_dir))).select("project", "loop_id", "n_failures", "n_commits", "n_test_runs", "outcome", "goal", "last_tests_passed")


@query(f"with {LOG_SQL} select 'E' || cast(cast(floor(value) as bigint) % 7 as varchar) as code, count(*) as total, count(*) >= 2 as needs_hc, bool_or(value > 40) as has_hc_ref from eff where event = 'failure' group by 1")
def log_two_strike(spark, sf_dir):
    return eventlog.two_strike(eventlog.failure_facts(eventlog.effective(_log(spark, sf_dir))))


@query(f"""with {LOG_SQL}, b as (select file, arg_min(event, line) as first, count(*) filter (event = 'loop_end') as ends, min(line) filter (event = 'loop_end') as end_line from eff group by file),
  a as (select file, count(*) as after from eff join b using (file) where line > end_line group by file), s as (select file, count(*) as slots from gone group by file)
select file, 'does not begin with loop_start' as problem from b where first <> 'loop_start' union all select file, 'several ends' from b where ends > 1 union all
select file, 'rows after the end' from b join a using (file) left join s using (file) where after > coalesce(slots, 0)""")
def log_validate(spark, sf_dir):
    return eventlog.file_errors(_log(spark, sf_dir))


@query("select user_id, case when b = 0 then 'new' when c = 0 then 'fixed' else 'residual' end as state from (select user_id, count(*) filter (event_type = 'click' and value > 30) as b, count(*) filter (event_type = 'view' and value > 30) as c from events group by user_id) where b + c > 0")
def set_attribution(spark, sf_dir):
    e = t(spark, sf_dir, "events").where("value > 30")
    return eventlog.attribution(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id")


@query(r"""select doc_id, regexp_matches(text, 'AKIA[0-9A-Z]{16}') as has_key, regexp_matches(text, '(?i)\b(api[_-]?key|secret|token|password|passwd)\b\s*[=:]\s*[''"][^''"]{8,}[''"]') as has_credential from documents
where regexp_matches(text, 'AKIA[0-9A-Z]{16}') or regexp_matches(text, '(?i)\b(api[_-]?key|secret|token|password|passwd)\b\s*[=:]\s*[''"][^''"]{8,}[''"]')""")
def secret_scan(spark, sf_dir):
    out = eventlog.secret_scan(docs(spark, sf_dir)).where(F.size("block") > 0)
    return out.select("doc_id", F.array_contains("block", "access key").alias("has_key"), F.array_contains("block", "written credential").alias("has_credential"))


@query("select cast(sum(l_linenumber + l_orderkey % 3) as bigint) as lines, count(*) as files, false as ok from lineitem where l_returnflag <> 'R'")
def diff_gate(spark, sf_dir):
    stat = t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("added"), (F.col("l_orderkey") % 3).alias("deleted"), F.concat(F.lit("src/"), "l_returnflag", F.lit(".txt")).alias("file"))
    return eventlog.diff_gate(stat, exempt=["src/R*"])


@query("""with l as (select user_id as file, row_number() over (partition by user_id order by event_id % 10, event_id) as line, ts from events)
select distinct file, 'time goes back' as problem from (select file, ts, lag(ts) over (partition by file order by line) as before from l) where before > ts""")
def log_time_order(spark, sf_dir):
    from pyspark.sql import Window

    e = t(spark, sf_dir, "events").withColumn("line", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_id") % 10, "event_id")).cast("long"))
    text = F.to_json(F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.lit("loop_start").alias("event")))
    rows = eventlog.parse(e.select(F.col("user_id").alias("file"), "line", text.alias("value")))
    return eventlog.file_errors(rows).where("problem = 'time goes back'")


@query("""select 'E' || cast(cast(floor(value) as bigint) % 7 as varchar) as code, coalesce(name, '?') as name, count(*) as n
from (select *, case event_type when 'click' then 1 end as f from events) left join (values ('E0', 'wrong result'), ('E3', 'slow')) x(c, name) on c = 'E' || cast(cast(floor(value) as bigint) % 7 as varchar) where f = 1
and (user_id, ts, event_id) not in (select user_id, ts, event_id from (select *, lead(event_type) over (partition by user_id order by ts, event_id) as next from events) where next = 'error') group by all""")
def log_failures_named(spark, sf_dir):
    names = spark.createDataFrame([("E0", "wrong result"), ("E3", "slow")], "code string, name string")
    return eventlog.failure_facts(eventlog.effective(_log(spark, sf_dir)), names).groupBy("code", "name").agg(F.count("*").alias("n"))


@query("select user_id as file, row_number() over (partition by user_id order by ts, event_id) as line, case when event_type = 'view' then cast(cast(floor(value) as bigint) as varchar) end as data_passed, case when event_type = 'signup' then 'g' end as data_goal from events")
def log_flattened(spark, sf_dir):
    rows = _log(spark, sf_dir)
    flat = eventlog.flattened(rows.select("file", "line", *eventlog.ENVELOPE), ["passed", "goal"], keep=["file", "line"])
    return flat.select("file", "line", "data_passed", "data_goal")


@query("select * from (values ('a=1', '1'), ('b=\"x\"', '\"x\"'), ('c=x y', '\"x y\"'), ('d=[1,true]', '[1,true]'), ('e=a=b', '\"a=b\"'), ('f=', '\"\"')) v(pair, json)")
def key_value_types(spark, sf_dir):
    pairs = spark.createDataFrame([("a=1",), ('b="x"',), ("c=x y",), ("d=[1,true]",), ("e=a=b",), ("f=",)], "pair string")
    return pairs.select("pair", F.element_at(F.map_values(eventlog.key_values(F.array("pair"))), 1).alias("json"))


@query("select * from (values ('1.2', true), ('1.10', true), ('1.1', false), ('0.9', false), ('2', true)) v(v, ok)")
def version_compare(spark, sf_dir):
    rows = spark.createDataFrame([("1.2",), ("1.10",), ("1.1",), ("0.9",), ("2",)], "v string")
    return rows.select("v", eventlog.version_at_least(F.col("v"), 1, 2).alias("ok"))


# the newest row of each log comes again: into another project, after the end, or as a correction of the row before it
@query(f"""with {LOG_SQL}, x as (select file, max(line) as line from lines group by file),
  ended as (select file, bool_or(event = 'loop_end') as ended from eff group by file), n as (select l.* from lines l join x using (file, line)),
  last_end as (select file, max(line) as e from lines where event = 'loop_end' group by file),
  v as (select file, event, count(*) as voided from lines join gone using (file, line) group by all), r as (select l.file, event, count(*) as replaced from lines l join last_end using (file) where l.line > e group by all)
select n.file, case when n.event = 'correction' and not exists (select 1 from eff where eff.file = n.file and eff.line = n.line - 1) then 'no row to correct'
  when n.event <> 'correction' and coalesce(ended, false) and coalesce(voided, 0) <= coalesce(replaced, 0) then 'the loop has ended' else '' end as refused
from n left join ended using (file) left join v on v.file = n.file and v.event = n.event left join r on r.file = n.file and r.event = n.event""")
def log_append_guards(spark, sf_dir):
    rows = _log(spark, sf_dir)
    new = rows.join(rows.groupBy("file").agg(F.max("line").alias("line")), ["file", "line"])
    return eventlog.append_errors(new.select(*rows.columns), rows).select("file", F.array_join("refused", ",").alias("refused"))


DIFF = ["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1,2 +10,3 @@ f", "+one", "-gone", "+two", "@@ -9 +40 @@", "+three", "diff --git a/y b/y", "--- a/y", "+++ b/y", "@@ -0,0 +1 @@", "+", "++more"]


@query("select path, cast(line as bigint) as line, text from (values ('x', 10, 'one'), ('x', 11, 'two'), ('x', 40, 'three'), ('y', 1, ''), ('y', 2, '+more')) v(path, line, text)")
def diff_added_lines(spark, sf_dir):
    return eventlog.added_lines(spark.createDataFrame([("d", i, v) for i, v in enumerate(DIFF)], "file string, no int, value string"))


@query("select 'p' || l_partkey as file, cast(sum(l_linenumber + l_orderkey % 3) as bigint) as lines from lineitem group by 1 order by lines desc, file limit 5")
def diff_top_files(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("p"), "l_partkey").alias("file")).agg(F.sum("l_linenumber").alias("added"), F.sum(F.col("l_orderkey") % 3).alias("deleted"))
    return eventlog.top_files(li)


# --- sources and sinks: written and read again -------------------------------------------------------------------------------


@query("select o_orderkey, o_custkey, o_orderstatus, replace(o_comment, chr(9), ' ') as o_comment from (select *, o_orderpriority as o_comment from orders) where o_orderstatus = 'F'")
def selection_round_trip(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").withColumn("o_comment", F.col("o_orderpriority"))
    path, columns = new_path(spark, "selection"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_comment"]
    writers.selection(rows, path, columns, "o_orderkey")
    return spark.read.schema("o_orderkey long, o_custkey long, o_orderstatus string, o_comment string").option("header", True).option("sep", "\t").csv(path)


@query("select doc_id, text from documents")
def texts_round_trip(spark, sf_dir):
    path = new_path(spark, "texts")
    writers.texts(docs(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("select doc_id, text from (select doc_id, text, sum(strlen(text)) over (order by doc_id rows between unbounded preceding and 1 preceding) as b from documents) where coalesce(b, 0) < 300000")
def capped_corpus(spark, sf_dir):
    return readers.capped(docs(spark, sf_dir).select("doc_id", "text"), 300_000)


@query(f"with recursive {PLAN} select shard_id, doc_id, bytes from plan")
def shards_round_trip(spark, sf_dir):
    path = new_path(spark, "shards")
    writers.shards(_planned(spark, sf_dir), path)
    return spark.read.parquet(path).select(F.col("shard_id").cast("long").alias("shard_id"), "doc_id", "bytes")


@query("select event_type as kind, cast(user_id as varchar) as user, cast(event_id as varchar) as event from events union all select 'all', null, cast(count(*) as varchar) from events")
def star_schema_round_trip(spark, sf_dir):
    path, e = new_path(spark, "star"), t(spark, sf_dir, "events")
    parts = [e.select(F.col("event_type").alias("kind"), F.col("user_id").alias("user"), F.col("event_id").alias("event")), e.agg(F.count("*").alias("event")).select(F.lit("all").alias("kind"), "event")]
    writers.star_schema({"facts": parts}, path)
    read = spark.read.option("header", True).csv(f"{path}/facts")
    return read.toDF(*(c.lstrip("\ufeff") for c in read.columns))


@query("select id, score, months, best_rank, title from (select id, sum(501 - rank) as score, count(*) as months, min(rank) as best_rank, arg_min(month, (month, rank)) as title from " + ENTRIES + " group by id)".replace("sum(501 - rank)", "cast(sum(501 - rank) as bigint)"))
def ranking_round_trip(spark, sf_dir):
    path = new_path(spark, "ranking")
    writers.ranking(ranking_score(spark, sf_dir), path)
    return spark.read.schema("id long, score long, months long, best_rank int, title string").json(path)


@query(f"select rule, (select count(*) from documents) as works, (select count(*) from documents where lang in ('de', 'es')) as old, hits, cast(floor(r * 100) as bigint) as pct from {RATIOS}")
def calibration_json(spark, sf_dir):
    probed = _probed(spark, sf_dir)
    made = writers.calibration(calibrate.rule_ratios(probed), probed, docs(spark, sf_dir), F.col("lang").isin("de", "es"))
    j = F.from_json("json", "works long, old_kana_works long, hits long, old_ratio_pct long")
    return made.select("rule", j.alias("j")).select("rule", "j.works", F.col("j.old_kana_works").alias("old"), "j.hits", F.col("j.old_ratio_pct").alias("pct"))


@query("select (select count(*) from documents) as selected, count(*) as attempted, count(*) filter (lang <> 'fr') as ok, count(*) filter (lang = 'fr') as failed, count(*) filter (lang <> 'fr') as raw_files, cast(sum(strlen(text)) filter (lang <> 'fr') as bigint) as raw_bytes, false as within from documents where lang is not null")
def fetch_report(spark, sf_dir):
    d = docs(spark, sf_dir)
    got = d.where("lang is not null").select("doc_id", F.when(F.col("lang") != "fr", F.col("text")).alias("text"), F.when(F.col("lang") == "fr", "no text").alias("problem"))
    return writers.fetch_report(got, d.count()).drop("fails", "elapsed_sec")


@query("select p_partkey as id, p_brand || p_type as author, trim(split_part(replace(p_type, ' ', ' / '), '/', 1)) as ndc from part")
def work_fields(spark, sf_dir):
    p = t(spark, sf_dir, "part").withColumn("codes", F.replace("p_type", F.lit(" "), F.lit(" / ")))
    return p.select(F.col("p_partkey").alias("id"), writers.author_name("p_brand", "p_type").alias("author"), writers.class_code("codes").alias("ndc"))


@query("select o_custkey as author, o_orderkey as id from (select *, row_number() over (partition by o_custkey order by cast(o_orderkey as varchar)) as n from orders) where n <= 3")
def select_capped_by_id(spark, sf_dir):
    return selection.capped_by_id(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("author"), F.col("o_orderkey").alias("id")), 3)


@query(f"select id, score from (select id, cast(sum(501 - rank) as bigint) as score from {ENTRIES} group by id order by score desc, id limit 100) where id in (select p_partkey from part where p_size > 10) and id not in (select p_partkey from part where p_size > 25)")
def top_ranked_missing(spark, sf_dir):
    p = t(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    return selection.missing_top(ranking_score(spark, sf_dir).select("id", "score"), p.where("p_size > 10"), p.where("p_size > 25"))


@query("select count(text) as works, round(avg(length(text)), 2) as mean_chars, median(length(text)) as median_chars, round(sum(strlen(text)) / sum(length(text)), 4) as bytes_per_char, cast(sum(strlen(text)) as bigint) as bytes from documents")
def size_statistics(spark, sf_dir):
    return selection.size_statistics(docs(spark, sf_dir))


@query("select doc_id, length(regexp_replace(replace(regexp_replace(regexp_replace(text, '※?［＃[^］]*］', '', 'g'), '《[^》]*》', '', 'g'), '｜', ''), '[ \t　]+', '', 'g')) as n from documents")
def probe_sizes(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.length(normalize.probe_size(F.col("text"))).cast("long").alias("n"))


@query("select lang, format('{:,}', count(*)) as works, format('{:,}', cast(sum(length(text)) as bigint)) as chars from documents group by lang")
def formatted_counts(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(selection.thousands(F.count("*")).alias("works"), selection.thousands(F.sum(F.length("text"))).alias("chars"))


# Works in the Japanese plain-text format and what is left of them, derived by hand.
JAPANESE = [
    (1, "題\n著者 名\n\n" + "-" * 55 + "\n【テキスト中に現れる記号について】\n《》：ルビ\n" + "-" * 55 + "\n\n吾輩《わがはい》は｜猫である。［＃改ページ］　\n\n\n\n終り\n\n底本：「本」\n入力：人\n", "題", "著者名", "吾輩は猫である。\n\n終り\n", "title+author", "legend", "footer", 0),
    (2, "題名\n\n本文。\n" + "-" * 30 + "\n続き。\n底本：「本」とあるだけ\n", "題名", "誰", "本文。\n続き。\n底本：「本」とあるだけ\n", "title+author", "none", "refused", 31),
    (3, "別の題\n本文\n\n入力：人\n校正：人\n", "題", "著者", "別の題\n本文\n", "none", "none", "footer", 0),
]
JAPANESE_SQL = ", ".join("({}, '{}', '{}', '{}', '{}', {})".format(i, body, a, b, c, dash) for i, _, _, _, body, a, b, c, dash in JAPANESE)


@query(f"select cast(doc_id as bigint) as doc_id, body, title, legend, footer, cast(dash as bigint) as dash from (values {JAPANESE_SQL}) v(doc_id, body, title, legend, footer, dash)")
def normalize_japanese(spark, sf_dir):
    rows = spark.createDataFrame([x[:4] for x in JAPANESE], "doc_id long, text string, title string, author string")
    return normalize.normalize(rows).select("doc_id", "body", "forms.title", "forms.legend", "forms.footer", "acc.dash")


@query(f"select cast(x as bigint) as n_bytes, cast(w * 8 + w // 8 * 4 + 8 * (x // 64 + 1) as bigint) as bytes from (select x, cast(ceil(x * 4.75 / 64) as bigint) as w from (values (0), (1000), (20000000)) v(x))")
def index_size(spark, sf_dir):
    return spark.createDataFrame([(n, index.index_size(n, 4.75)) for n in (0, 1000, 20_000_000)], "n_bytes long, bytes long")


# --- streaming -------------------------------------------------------------------------------------------------------------


@query(f"select source, count(*) as docs, cast(sum((strlen(text) - strlen(replace(text, '{WORD}', ''))) / {len(WORD)}) as bigint) as hits from documents group by source")
def stream_ingest_count(spark, sf_dir):
    return ingest.counts_by(spark, f"{sf_dir}/documents.parquet", WORD, "source")
