"""11 Chat formatting: every assistant turn becomes an example of its own, with all preceding turns as context and only that reply trainable.

Two tables. ``segments`` has one row a turn: the turn in the template's marks, control strings inside role and text escaped, and
where its trainable part lies (assistant turns only). ``examples`` has one row an assistant turn: its example number, how many turns and
characters of its conversation stand before it, and where its reply begins and ends in the conversation's formatted text. An example's context
is therefore a prefix of one text that all examples of the conversation share: output grows with the turns, not with their square,
however long a conversation is. ``expanded`` writes the texts out in full.

Only DataFrame functions. Turns are formatted where they lie, without a shuffle. Counts and characters before an assistant turn are running sums within
ranges of ``TURNS`` turn numbers plus the totals of the ranges before, so that a conversation with most of the rows is split.

Defined results: a conversation is the rows of one conv_id, null among them; turns go by turn, nulls first, then role, then the
first 32 characters of the text, then its digest; repeated rows are turns of their own; null role or text is empty; an assistant turn with an empty text is an example
with nothing to learn; a conversation without an assistant turn has segments and no example; an empty table gives empty tables; columns of other names are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import written

TURNS = 1024  # turn numbers of a range


@dataclass(frozen=True)
class Template:
    """The marks before a role, between role and text, and after a text. Each begins with ``<|`` and none holds a backslash."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    trainable: str = "assistant"


DEFAULT = Template()


def escaped(s: Column) -> Column:
    """s without any mark in it: a backslash before each backslash, and within each ``<|``."""
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)\\(.)", "$1")


def tie(text: Column) -> Column:
    """What orders rows of equal turn and role."""
    return F.concat(F.substring(text, 1, 32), F.lit("\x01"), F.md5(text.cast("binary")))


def segments(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, turn, role, tie, segment, chars (of the segment), loss_from and loss_chars (the trainable part within the segment; null: none)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head, body = F.concat(F.lit(template.turn), escaped(F.col("role")), F.lit(template.text)), escaped(F.col("text"))
    rows = rows.select("conv_id", "turn", "role", tie(F.col("text")).alias("tie"), head.alias("head"), body.alias("body"))
    reply = F.col("role") == template.trainable
    return rows.select(
        "conv_id", "turn", "role", "tie", F.concat("head", "body", F.lit(template.end)).alias("segment"), (F.length("head") + F.length("body") + len(template.end)).alias("chars"),
        F.when(reply, F.length("head")).alias("loss_from"), F.when(reply, F.length("body")).alias("loss_chars"))


def examples(segs: DataFrame) -> DataFrame:
    """conv_id, example (from 1), context_turns, context_chars, reply_from, reply_to: one row an assistant turn.

    The context is the first ``context_chars`` characters of the conversation's formatted text, the trainable part its characters from ``reply_from`` to before ``reply_to``."""
    own = segs.select("conv_id", "turn", "role", "tie", F.floor(F.col("turn") / TURNS).alias("range"), F.col("chars").cast("bigint").alias("chars"), "loss_from", "loss_chars", F.col("loss_from").isNotNull().cast("bigint").alias("one"))
    within = Window.partitionBy("conv_id", "range").orderBy(F.asc_nulls_first("turn"), "role", "tie").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"turns": F.count("chars"), "before": F.sum("chars"), "nth": F.sum("one")}
    part = own.withColumns({k: F.coalesce(c.over(within), F.lit(0)) for k, c in sums.items()}).where("one = 1")
    earlier = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("conv_id", "range").agg(F.count("*").alias("turns"), F.sum("chars").alias("before"), F.sum("one").alias("nth"))
    # a conversation of one range, the usual case, has nothing before: only those of several ranges are joined
    several = totals.withColumns({f"{k}_0": F.sum(k).over(earlier) for k in sums}).where("turns_0 > 0").select(F.col("conv_id").alias("c"), F.col("range").alias("r"), *[f"{k}_0" for k in sums])
    all_ = part.join(several, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("range").eqNullSafe(F.col("r")), "left")
    turns, before, nth = (F.col(k) + F.coalesce(F.col(f"{k}_0"), F.lit(0)) for k in sums)
    start = before + F.col("loss_from")
    return all_.select("conv_id", (nth + 1).alias("example"), turns.alias("context_turns"), before.alias("context_chars"), start.alias("reply_from"), (start + F.col("loss_chars")).alias("reply_to"))


def expanded(segs: DataFrame, which: DataFrame) -> DataFrame:
    """conv_id, example, context, reply, loss_from, loss_chars with whole texts, for the examples given; their size is that of all prefixes together."""
    order = F.array_sort(F.collect_list(F.struct("turn", "role", "tie", "segment", "loss_from", "loss_chars")))
    talks = segs.groupBy(F.col("conv_id").alias("c")).agg(order.alias("t"))
    at = which.join(talks, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("reply", F.element_at("t", (F.col("context_turns") + 1).cast("int")))
    context = F.array_join(F.slice(F.transform("t", lambda x: x["segment"]), 1, F.col("context_turns").cast("int")), "")
    return at.select("conv_id", "example", context.alias("context"), F.col("reply.segment").alias("reply"), F.col("reply.loss_from").alias("loss_from"), F.col("reply.loss_chars").alias("loss_chars"))


def formatted(conversations: DataFrame, template: Template = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """segments and examples as written tables."""
    segs = written(segments(conversations, template), "chat_segments")
    return segs, written(examples(segs), "chat_examples")


def read_back(segs: DataFrame, exs: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id and figures of each conversation from the two tables: its formatted text is put together, cut at the marks and unescaped; the trainable text is what the examples' masks cover.

    A digest takes one conversation's text as one value, so this reader (not the tables) needs a conversation to fit into a row."""
    turn = F.struct("turn", "role", "tie", "segment", "loss_from", "loss_chars")
    nothing = F.lit(None)
    rows = segs.select("conv_id", turn.alias("t"), nothing.cast("struct<n:bigint,size:bigint>").alias("e"))
    target = exs.select("conv_id", nothing.cast(rows.schema["t"].dataType).alias("t"), F.struct(F.col("context_turns").alias("n"), (F.col("reply_to") + len(template.end)).alias("size")).alias("e"))
    talks = rows.unionByName(target).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"), F.array_sort(F.collect_list("e")).alias("e"))
    masked = F.transform("e", lambda e: F.get(F.col("t"), e["n"].cast("int")))
    loss = F.array_join(F.transform(masked, lambda s: unescaped(F.substring(s["segment"], s["loss_from"] + 1, s["loss_chars"]))), "")
    text = F.array_join(F.transform("t", lambda s: s["segment"]), "")
    talks = talks.select("conv_id", text.alias("text"), loss.alias("loss"), F.size("e").alias("examples"), F.aggregate("e", F.lit(0).cast("bigint"), lambda a, e: a + e["size"]).alias("example_chars"))
    ends = F.slice(F.split("text", template.end.replace("|", "[|]")), 1, F.size(F.split("text", template.end.replace("|", "[|]"))) - 1)
    parts = F.transform(ends, lambda s: F.split(F.substring(s, F.lit(len(template.turn) + 1), F.length(s)), template.text.replace("|", "[|]"), 2))
    talks = talks.withColumn("parts", parts)
    lines = F.transform("parts", lambda p: F.concat(unescaped(p[0]), F.lit("\n"), unescaped(p[1]), F.lit("\n")))
    return talks.select(
        "conv_id", F.size("parts").cast("bigint").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("text").cast("bigint").alias("formatted_chars"), F.col("examples").cast("bigint").alias("examples"), "example_chars")


def formatted_and_read(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """All conversations, and conversation -1 of two turns that hold marks of another template, written and read back."""
    said = "</s>[INST] ok [/INST]"
    more = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(*formatted(conversations.select("conv_id", "turn", "role", "text").unionByName(more), template), template)


#: The same figures in SQL; escaping lengthens a text by a character for each backslash and each ``<|``.
SQL = """with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
   union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 f as (select *, '<|turn|>' || replace(replace(role, '\\', '\\\\'), '<|', '<\\|') || '<|text|>' || replace(replace(text, '\\', '\\\\'), '<|', '<\\|') || '<|end|>' as segment, substr(text, 1, 32) || chr(1) || md5(text) as tie from c),
 s as (select *, sum(length(segment)) over (partition by conv_id order by turn nulls first, role, tie rows unbounded preceding) as upto from f)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, tie)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, tie) filter (role = 'assistant'), '')) as loss_sha256,
 cast(sum(length(segment)) as bigint) as formatted_chars, count(*) filter (role = 'assistant') as examples, cast(coalesce(sum(upto) filter (role = 'assistant'), 0) as bigint) as example_chars
from s group by conv_id"""
