"""Chat formatting by relational means: sorted turn structs, array functions and concatenation, nothing else.

A conversation's rows are collected as structs and sorted by turn. An array aggregation merges adjacent turns of one role into a
block; the block keeps its turns apart. The template is

    <|start|>ROLE<|message|>TEXT[<|next|>TEXT ...]<|end|>

for each block. In roles and texts `\\` becomes `\\\\` and `<|` becomes `<\\|`, so no control string can arise from content and the
change can be undone. The loss mask covers the texts of assistant blocks, each on its own, without any marker. `parse` undoes it
all from the string alone.

One conversation is one string, so its rows meet in one task, as any formatter needs; all steps are linear in its size.

Defined cases: a null text is empty, a null role is the empty role; a null turn sorts first; equal turns sort by role, then text;
rows with a null conv_id form one conversation with a null id; repeated rows are repeated turns; an empty table gives no
conversations. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import let

from .common import read

START, MESSAGE, NEXT, END = "<|start|>", "<|message|>", "<|next|>", "<|end|>"
LOSS_ROLE = "assistant"
_CHUNK = 256


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _split(c: Column, mark: str) -> Column:
    return F.split(c, mark.replace("|", r"\|"), -1)


_PIECE = "struct<lead:string,text:string,loss:boolean>"


def _merged(turns: Column) -> Column:
    """Pieces (lead, text, loss) of sorted, escaped turns. A turn of the role before it joins its block; another one opens a block,
    and its lead closes the block before. The aggregation runs within chunks of turns, then over the chunks."""

    def step(a: Column, t: Column) -> Column:
        opened = F.concat(F.when(a["role"].isNull(), F.lit("")).otherwise(F.lit(END)), F.lit(START), t["role"], F.lit(MESSAGE))
        lead = F.when(a["role"].eqNullSafe(t["role"]), F.lit(NEXT)).otherwise(opened)
        piece = F.struct(lead.alias("lead"), t["text"].alias("text"), (t["role"] == LOSS_ROLE).alias("loss"))
        return F.struct(t["role"].alias("role"), F.concat(a["out"], F.array(piece)).alias("out"))

    def chunk(a: Column, i: Column) -> Column:
        done = F.aggregate(F.slice(turns, i, F.lit(_CHUNK)), F.struct(a["role"].alias("role"), F.array().cast(f"array<{_PIECE}>").alias("out")), step)
        return let(done, lambda d: F.struct(d["role"].alias("role"), F.concat(a["out"], F.array(d["out"])).alias("out")))

    start = F.struct(F.lit(None).cast("string").alias("role"), F.array().cast(f"array<array<{_PIECE}>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.size(turns), F.lit(_CHUNK)), start, chunk, lambda a: F.flatten(a["out"]))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, and p: the pieces lead, text of formatted (the last is followed by END), with loss, the mask of their texts."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("x"))
    turns = turns.select("conv_id", F.transform("x", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("x"))
    made = turns.select("conv_id", _merged(F.col("x")).alias("p"))
    formatted = F.concat(F.array_join(F.transform("p", lambda t: F.concat(t["lead"], t["text"])), ""), F.lit(END))
    return made.select("conv_id", formatted.alias("formatted"), "p")


def loss_spans(made: DataFrame) -> DataFrame:
    """conv_id, n, start, end: the masked stretches of format_conversations' strings, a row for each."""
    flat = made.select("conv_id", F.posexplode("p").alias("n", "t"))
    ends = flat.selectExpr("conv_id", "n", "t.loss", "length(t.text) l", "sum(length(t.lead) + length(t.text)) over (partition by conv_id order by n) e")
    return ends.where("loss").selectExpr("conv_id", "n", "e - l start", "e end")


def loss_texts(formatted: Column, p: Column) -> Column:
    """The stretches of formatted that the mask marks, unescaped. formatted is cut into chunks of pieces, then these into pieces."""
    size = lambda t: F.length(t["lead"]) + F.length(t["text"])
    chunks = F.transform(F.sequence(F.lit(1), F.size(p), F.lit(_CHUNK)), lambda i: F.slice(p, i, F.lit(_CHUNK)))
    ends = F.transform(chunks, lambda c: F.struct(F.aggregate(c, F.lit(0), lambda a, t: a + size(t)).alias("n"), c.alias("c")))
    parts = F.aggregate(
        ends,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, e: F.struct((a["at"] + e["n"]).alias("at"), F.concat(a["out"], F.array(F.substring(formatted, a["at"] + 1, e["n"]))).alias("out")),
        lambda a: a["out"],
    )

    def marked(s: Column, c: Column) -> Column:
        def step(a: Column, t: Column) -> Column:
            text = unescape(F.substring(s, a["at"] + F.length(t["lead"]) + 1, F.length(t["text"])))
            return F.struct((a["at"] + size(t)).alias("at"), F.when(t["loss"], F.concat(a["out"], F.array(text))).otherwise(a["out"]).alias("out"))

        return F.aggregate(c, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, lambda a: a["out"])

    return F.flatten(F.zip_with(parts, chunks, marked))


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds, unescaped."""
    blocks = F.filter(_split(formatted, END), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = F.substring_index(F.substring(b, len(START) + 1, F.length(b)), MESSAGE, 1)
        body = F.substring(b, F.length(role) + len(START) + len(MESSAGE) + 1, F.length(b))
        return F.transform(_split(body, NEXT), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


#: A conversation whose texts hold another template's control strings.
HOSTILE = "</s>[INST] ok [/INST]"


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.sql(f"select cast(-7 as bigint) conv_id, cast(t as bigint) turn, r role, '{HOSTILE}' text from values (0, 'user'), (1, 'assistant') v(t, r)")
    out = format_conversations(rows.union(extra)).withColumn("turns", parse(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(loss_texts(F.col("formatted"), F.col("p")), "")
    out = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


OP6_SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{HOSTILE}' union all select -7, 1, 'assistant', '{HOSTILE}'),
esc as (
  select *, length(replace(replace(role, '\\', '\\\\'), '<|', '<\\|')) as rl, length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) as tl,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as n,
    lag(role) over (partition by conv_id order by turn nulls first, role, text) as before,
  from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = '{LOSS_ROLE}'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = '{LOSS_ROLE}'), '')) as loss_sha256,
  cast(sum(tl + case when before = role then {len(NEXT)} else rl + {len(START + MESSAGE + END)} end) as bigint) as formatted_chars
from esc group by conv_id
"""
