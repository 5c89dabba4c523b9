"""Chat formatting in Spark expressions only.

A conversation's rows are collected as structs and sorted. Adjacent turns of one role are merged: the array of turns is cut where
the role changes, and each slice becomes one block under one header. The blocks make one string:

    <|ROLE|>\\n TEXT [<|next|> TEXT]... <|end|>\\n

Every `&`, `<` and `[` of a text is escaped, so neither our markers nor those of other templates (`</s>`, `[INST]`) can
occur inside one; unescaping gives the text back. The loss mask covers the assistant's texts, markers excluded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TEXT = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;")]
_ROLE = [*_TEXT, ("|", "&bar;"), (">", "&gt;"), ("\n", "&nl;")]
NEXT, END = "<|next|>", "<|end|>\n"


def _put(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _take(c: Column, pairs) -> Column:
    for a, b in reversed(pairs):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def escape(text: Column) -> Column:
    return _put(text, _TEXT)


def unescape(text: Column) -> Column:
    return _take(text, _TEXT)


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, n_turns, n_blocks (headers after merging) and `formatted`.

    Turns are ordered by number, then role and text, so ties and repeated rows have one order; a null number comes first.
    A null role or text is empty. A null id is a conversation of its own. An empty table gives an empty one.
    """
    rows = turns.select(F.col(conv).alias("_c"), F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")).alias("_s"))
    lists = rows.groupBy("_c").agg(F.sort_array(F.collect_list("_s")).alias("a"))
    # where runs of one role start; a run is one slice, so the work grows with the turns
    begins = F.filter(F.sequence(F.lit(0), F.size("a") - 1), lambda i: (i == 0) | (F.get("a", i - 1)["r"] != F.get("a", i)["r"]))
    lists = lists.withColumn("b", begins)
    merged = F.transform("b", lambda at, k: F.struct(F.get("a", at)["r"].alias("role"), F.slice("a", at + 1, F.coalesce(F.get("b", k + 1), F.size("a")) - at).alias("turns")))
    block = lambda m: F.concat(F.lit("<|"), _put(m["role"], _ROLE), F.lit("|>\n"), F.array_join(F.transform(m["turns"], lambda s: escape(s["x"])), NEXT), F.lit(END))
    return lists.select(F.col("_c").alias(conv), F.size("a").cast("long").alias("n_turns"), F.size("b").cast("long").alias("n_blocks"), F.array_join(F.transform(merged, block), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted conversation, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.struct(_take(F.regexp_extract(b, r"^<\|([^|]*)\|>\n", 1), _ROLE).alias("role"), F.split(F.regexp_replace(b, r"^<\|[^|]*\|>\n", ""), r"<\|next\|>", -1).alias("texts")))
    return F.flatten(F.transform(parts, lambda p: F.transform(p["texts"], lambda x: F.struct(p["role"].alias("role"), unescape(x).alias("text")))))


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What op3 returns, read back from the formatted text alone."""
    got = formatted.withColumn("t", read_back(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("t", lambda s: s["role"] == "assistant"), lambda s: s["text"]), "")
    turns = F.array_join(F.transform("t", lambda s: F.concat(s["role"], F.lit("\n"), s["text"], F.lit("\n"))), "")
    return got.select(
        conv, F.size("t").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks",
    )


def op3_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and the planted conversation -7, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    return digests(format_conversations(turns.unionByName(planted)))


OP3_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m as (select *, lag(role) over w as before, lead(role) over w as after from t window w as (partition by conv_id order by turn, role, text)),
e as (
  select *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') as body,
    case when before = role then '<|next|>' else '<|' || role || '|>' || chr(10) end as head,
    case when after = role then '' else '<|end|>' || chr(10) end as tail from m)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(head) + length(body) + length(tail))::bigint as formatted_chars,
  count(*) filter (where before is distinct from role)::bigint as n_blocks
from e group by conv_id
"""
