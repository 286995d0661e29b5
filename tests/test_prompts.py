"""Prompts there and back, counters of failures, listings in order."""

from textloom.functions import text as T
from textloom.operators import answers as A
from textloom.operators import collections as M
from textloom.operators import prompts as P
from textloom.plans import ingest


def parse(spark, *texts):
    rows = P.parsed(spark.createDataFrame(list(enumerate(texts)), "query_id int, prompt string")).orderBy("query_id").collect()
    return [(r.question, [(b.block, b.text) for b in r.blocks]) for r in rows]


def test_round_trip(spark):
    questions = spark.createDataFrame([(1, "how\nlong?"), (2, "nothing known")], "query_id int, question string")
    blocks = spark.createDataFrame([(1, 2, "b.md", None, " second\n\nwith [1] mark "), (1, 1, "a.md", 7, "first")], "query_id int, block int, source string, page int, text string")
    histories = spark.createDataFrame([(1, "用户：x\n助手：y")], "query_id int, history string")
    made = P.prompts(questions, blocks, histories)
    text = {r.query_id: r.prompt for r in made.collect()}
    assert text[1].startswith("【参考资料】\n[1] 来源：a.md | 第 7 页\nfirst\n\n[2] 来源：b.md\nsecond") and "助手：y" in text[1] and text[1].endswith("标注 [编号]。")
    assert T.NO_CONTEXT in text[2] and T.NO_HISTORY in text[2]
    got = {r.query_id: (r.question, [(b.block, b.text) for b in r.blocks]) for r in P.parsed(made).collect()}
    assert got == {1: ("how\nlong?", [(1, "first"), (2, "second\n\nwith [1] mark")]), 2: ("nothing known", [])}


def test_prompts_without_the_form(spark):
    got = parse(spark, "just some text", "", None, "[3] 来源：x\nbody\n【历史对话】\nold", "x [1] 来源：not at the line's begin", "[1]来源：a\n[2] 来源：b", "【本次问题】 q ===== 问题结束 =====")
    assert got[0] == ("", [(1, "just some text")]) and got[1] == got[2] == ("", [(1, "")])
    assert got[3] == ("", [(3, "body")]) and got[4][1][0][0] == 1 and got[5] == ("", [(1, ""), (2, "")])
    assert got[6][0] == "q"


def test_failures(spark):
    units = spark.createDataFrame([("a", "a.md", None), ("a", "a.md", None), ("b", "b.md", None), (None, "c.doc", "legacy .doc")], "doc_id string, source string, error string")
    chunks = spark.createDataFrame([("a",)], "doc_id string")
    assert {tuple(r) for r in ingest.failures(units, chunks).collect()} == {(None, "c.doc", "legacy .doc"), ("b", "b.md", "no chunks")}


def test_failed_cases_and_latency(spark):
    cases = spark.createDataFrame([(i, 1, True, 1.0, 1.0) for i in (1, 2, 3)], "query_id int, gold int, hit boolean, rr double, precision double")
    ranks = spark.createDataFrame([(i, 1, True, 1.0) for i in (1, 2, 3)], "query_id int, answer_rank int, answer_hit boolean, answer_rr double")
    answered = spark.createDataFrame([(i, False, True, True, False) for i in (1, 2, 3)] + [(4, True, False, False, True)], "query_id int, expect_refusal boolean, citation_hit boolean, keyword_hit boolean, refused boolean")
    named = spark.createDataFrame([(1, "q"), (2, "q"), (3, "q"), (4, "q")], "query_id int, question string")
    failed = spark.createDataFrame([(3, "timeout")], "query_id int, error string")
    latency = spark.createDataFrame([(1, 10), (2, 30), (3, 1000)], "query_id int, ms int")
    row = A.evaluation(cases, ranks, answered, named, failed, latency).first()
    assert (row.cases, row.errors, round(row.recall, 6), row.refusal_accuracy, row.avg_latency_ms) == (4, 1, 0.666667, 1.0, 20.0)
    assert A.evaluation(cases, ranks, answered, named).first().recall == 1.0


def test_listing_is_by_source(spark):
    chunks = spark.createDataFrame([("d1", 0, "z.md"), ("d2", 0, "a.md"), ("d2", 1, "b.md"), ("d3", 0, None)], "doc_id string, chunk_index int, source string")
    assert [(r.doc_id, r.chunks, r.source) for r in M.listing(chunks).collect()] == [("d3", 1, None), ("d2", 2, "a.md"), ("d1", 1, "z.md")]
