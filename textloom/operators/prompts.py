"""Prompts from blocks, history and question, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .collections import context

#: The parts of a prompt, and what begins a block of its context.
HEAD, CONTEXT_END, HISTORY, QUESTION, QUESTION_END = "【参考资料】", "===== 参考资料结束 =====", "【历史对话】", "【本次问题】", "===== 问题结束 ====="
TASK = "请基于上述参考资料回答「本次问题」。记得在每个事实后标注 [编号]。"
BLOCK = r"(?md)^\[(\d+)\]\s*来源：[^\n]*$"
ASKED = rf"(?s){QUESTION}\s*(.*?)\s*{QUESTION_END}"


def prompts(questions: DataFrame, blocks: DataFrame, histories: DataFrame | None = None) -> DataFrame:
    """query_id, prompt for questions(query_id, question), their blocks as `context` takes them, and histories(query_id, history); missing ones have their placeholders."""
    rows = questions.select("query_id", "question").join(context(blocks), "query_id", "left")
    rows = rows.withColumn("history", F.lit(None).cast("string")) if histories is None else rows.join(histories.select("query_id", "history"), "query_id", "left")
    part = lambda c, none: F.when(F.coalesce(c, F.lit("")) == "", none).otherwise(F.col(c))
    text = F.concat(F.lit(f"{HEAD}\n"), part("context", T.NO_CONTEXT), F.lit(f"\n{CONTEXT_END}\n\n{HISTORY}\n"), part("history", T.NO_HISTORY), F.lit(f"\n\n{QUESTION}\n"), F.coalesce("question", F.lit("")), F.lit(f"\n{QUESTION_END}\n\n{TASK}"))
    return rows.select("query_id", text.alias("prompt"))


def parsed(rows: DataFrame) -> DataFrame:
    """query_id, question, blocks(block, text) of rows(query_id, prompt).

    A line `[n] 来源：…` begins a block, wherever it stands; the context ends at
    its mark or the history's.  A prompt without blocks that doesn't say there
    are none is one block itself; without a question's marks the question is ''.
    """
    prompt = F.coalesce("prompt", F.lit(""))
    bodies = F.split(prompt, BLOCK)
    numbers = F.regexp_extract_all(prompt, F.lit(BLOCK), F.lit(1))
    ended = lambda t: F.substring_index(F.substring_index(t, CONTEXT_END, 1), HISTORY, 1)
    block = lambda n, t: F.struct(n.cast("int").alias("block"), T.strip(t).alias("text"))
    held = F.zip_with(numbers, F.slice(bodies, F.lit(2), F.size(numbers)), lambda n, t: block(n, ended(t)))
    whole = F.when(F.contains(prompt, F.lit(T.NO_CONTEXT)), F.slice(held, 1, 0)).otherwise(F.array(F.struct(F.lit(1).alias("block"), prompt.alias("text"))))
    return rows.select("query_id", T.strip(F.regexp_extract(prompt, ASKED, 1)).alias("question"), F.when(F.size(numbers) > 0, held).otherwise(whole).alias("blocks"))
