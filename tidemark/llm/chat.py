r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn reads ``<s>role\ntext</s>``. Every assistant turn becomes an example of its own: all turns before it as
context, then that reply, the only trainable span. Turns after the last reply (or all of a conversation without
one) come out as one more example without a trainable span, so the output holds every turn.

Control strings inside texts get a backslash behind their first character, and one more if they have some
already (``</s>`` to ``<\/s>``, ``<\/s>`` to ``<\\/s>``), which read_back() undoes. In roles, backslash and line feed
are written ``\b`` and ``\n`` first.

Turns are ordered by turn (null first), then role and text; null roles and texts are empty. A null conv_id is a
conversation of its own. The size of the examples grows with the square of a conversation's turns, as the
method has it; each is made from the conversation's turns when it is written, one at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load

#: <s> </s> [INST] [/INST] <<SYS>> <</SYS>>, with any number of backslashes behind the first character.
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _plain_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_conversations(turns: DataFrame, trainable: str = "assistant") -> DataFrame:
    """turns(conv_id, turn, role, text) to conv_id, example, text, loss_start, loss_end.

    example counts the turns the text holds; the loss span is in code points, end exclusive, null for none.
    """
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    marked = plain.select("conv_id", F.struct("turn", "role", "text", F.concat(F.lit("<s>"), _role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body")).alias("t"))
    convs = marked.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    convs = convs.select("conv_id", "turns", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit("</s>"))).alias("written"))
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("turns", i)["role"] == trainable) | (i == n))
    examples = convs.select("conv_id", "turns", "written", F.explode(ends).alias("example"))
    last = F.element_at("turns", F.col("example"))
    context = F.array_join(F.slice("written", F.lit(1), F.col("example") - 1), "")
    examples = examples.select("conv_id", "example", context.alias("context"), F.element_at("written", F.col("example")).alias("target"), last["head"].alias("head"), last["body"].alias("body"), (last["role"] == trainable).alias("trained"))
    start = F.length("context") + F.length("head")
    return examples.select(
        "conv_id",
        "example",
        F.concat("context", "target").alias("text"),
        F.when(F.col("trained"), start).alias("loss_start"),
        F.when(F.col("trained"), start + F.length("body")).alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Examples of format_conversations() to conv_id, turns (array of role and text), loss (the trained texts) and formatted_chars."""
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.expr("substring(text, loss_start + 1, loss_end - loss_start)")))
    read = examples.select("conv_id", "example", "text", loss.alias("loss"), F.length("text").cast("long").alias("chars"))
    whole = read.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"),
        F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    pieces = F.filter(F.split("text", "</s>"), lambda x: x != "")
    turns = F.transform(pieces, lambda x: F.struct(_plain_role(F.substring_index(F.substring(x, 4, 1 << 30), "\n", 1)).alias("role"), unescape(F.substring(x, F.instr(x, "\n") + 1, F.length(x))).alias("text")))
    return whole.select("conv_id", turns.alias("turns"), F.transform("losses", lambda x: x["loss"]).alias("loss"), "formatted_chars")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    read = read_back(format_conversations(turns.unionByName(added)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP4_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
             8 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) + length(role) - length(replace(replace(role, '\', ''), chr(10), ''))
               + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) AS size
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
