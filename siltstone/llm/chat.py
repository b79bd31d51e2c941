"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role
are folded into one block, and blocks are concatenated:

    <|start|>ROLE<|text|>TEXT<|next|>TEXT<|end|>

``<|next|>`` stands between the texts of merged turns, so that merging loses nothing.  Every
control string inside a role or text gets one more backslash after its first character
(``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``), which reading back takes away.

A conversation becomes one string and so must fit in one task; the number of conversations
and their order in the table do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings, those of the template and those that tokenizers reserve.
START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
CONTROLS = ("<|start|>", "<|text|>", "<|next|>", "<|end|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


@dataclass(frozen=True)
class Template:
    """Control strings (each beginning with ``<`` or ``[``) and the role whose texts are learned."""

    controls: tuple[str, ...] = CONTROLS
    learned: str = "assistant"

    @property
    def rest(self) -> str:
        quoted = sorted({c[1:] for c in self.controls}, key=lambda c: (-len(c), c))
        return "|".join("".join("\\" + x if x in "|[](){}.*+?^$\\/<>" and x not in "/<>" else x for x in c) for c in quoted)

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])(\\*)({self.rest})", r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])\\(\\*)({self.rest})", "$1$2$3")


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: ``conv`` and its sorted ``turns`` (role, text).

    Turns sort by number, nulls first, then role and text; null roles and texts count as
    empty.  Repeated rows stay.  A null id is one conversation.  Other columns are dropped.  A
    conversation is one row whatever its length, so it must fit in a task.  An empty table gives no rows.
    """
    parts = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = conversations.select(F.col(conv), parts.alias("t")).groupBy(conv).agg(F.array_sort(F.collect_list("t")).alias("t"))
    return rows.select(conv, F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("turns"))


def format_turns(rows: DataFrame, template: Template = Template(), column: str = "turns") -> DataFrame:
    """``rows`` with ``formatted`` and ``loss`` in place of ``turns``.

    ``loss`` lists the spans (start from 0, end; in code points of ``formatted``) of the
    learned role's texts, escaped, without any control string.  Own columns called ``formatted`` or
    ``loss`` are replaced; all others stay, and so do rows.  A conversation without turns is formatted as
    the empty one; a very long one is one string.  An empty table gives no rows.
    """
    block = "struct<role:string,texts:array<string>>"

    def fold(blocks: Column, t: Column) -> Column:
        last = F.element_at(blocks, -1)
        same = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1)).role == t.role)
        longer = F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(F.struct(t.role.alias("role"), F.concat(last.texts, F.array(t.text)).alias("texts"))))
        return F.when(same, longer).otherwise(F.concat(blocks, F.array(F.struct(t.role.alias("role"), F.array(t.text).alias("texts")))))

    blocks = F.aggregate(column, F.array().cast(f"array<{block}>"), fold)

    def pieces(b: Column) -> Column:
        """(string, learned) of a block, in order."""
        learned = b.role == template.learned
        texts = F.transform(b.texts, lambda x, i: F.array(F.struct(F.when(i > 0, NEXT).otherwise("").alias("s"), F.lit(False).alias("learned")), F.struct(template.escape(x).alias("s"), learned.alias("learned"))))
        head = F.array(F.struct(F.concat(F.lit(START), template.escape(b.role), F.lit(TEXT)).alias("s"), F.lit(False).alias("learned")))
        return F.concat(head, F.flatten(texts), F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("learned"))))

    out = rows.withColumn("__blocks", blocks).withColumn("__pieces", F.flatten(F.transform("__blocks", pieces)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def mark(state: Column, p: Column) -> Column:
        end = state["at"] + F.length(p.s)
        spans = F.when(p.learned, F.concat(state.spans, F.array(F.struct(state["at"].alias("start"), end.alias("end"))))).otherwise(state.spans)
        return F.struct(end.alias("at"), spans.alias("spans"))

    out = out.withColumn("formatted", F.array_join(F.transform("__pieces", lambda p: p.s), "")).withColumn("loss", F.aggregate("__pieces", zero, mark)["spans"])
    return out.drop("__blocks", "__pieces", column)


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    bar = lambda c: c.replace("|", r"\|")

    def texts(b: Column) -> Column:
        parts = F.split(F.substr(b, F.lit(len(START) + 1)), bar(TEXT), 2)
        role = template.unescape(parts[0])
        return F.transform(F.split(parts[1], bar(NEXT), -1), lambda x: F.struct(role.alias("role"), template.unescape(x).alias("text")))

    found = F.split(formatted, bar(END), -1)
    return F.flatten(F.transform(F.slice(found, 1, F.size(found) - 1), texts))


def learned_text(formatted: Column, loss: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda x: template.unescape(F.substr(formatted, x.start + 1, x.end - x.start))), "")


ORACLE_SQL = """
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    regexp_replace(role, '([<\\[])(\\\\*)(REST)', '\\1\\\\\\2\\3', 'g') AS r2,
    regexp_replace(text, '([<\\[])(\\\\*)(REST)', '\\1\\\\\\2\\3', 'g') AS t2,
    coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), FALSE) AS merged
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(t2) + CASE WHEN merged THEN 8 ELSE 24 + length(r2) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""".replace("REST", Template().rest)
