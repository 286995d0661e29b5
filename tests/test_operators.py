import io
import math
import time
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import answers as A
from textloom.operators import chunking as C
from textloom.operators import collections as M
from textloom.operators import search as S
from textloom.plans import ingest, qa
from textloom.sources import files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


def test_tokens(spark):
    assert one(spark, "年假", T.tokens) == ["年", "假", "年假"]
    assert one(spark, "A big 7 x Café_1", T.tokens) == ["big", "7", "caf", "_1"]
    assert one(spark, "", T.tokens) == []


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        (None, ""),
        ("a​b﻿", "ab"),
        ("１２，Ａ", "12,A"),
        ("exam-\nple", "example"),
        ("a\n•\nb", "a\n\nb"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("a\r\nb  c", "a\nb c"),
    ],
)
def test_normalize(spark, raw, clean):
    assert one(spark, raw, T.normalize) == clean


def test_small_functions(spark):
    assert one(spark, "  abcdef ", lambda c: T.truncate(c, 4)) == "abc…"
    assert one(spark, "年a", T.cjk_ratio) == 0.5
    assert one(spark, "..... ..... ..... .....", T.is_noise) is True
    assert [one(spark, n, T.safe_filename) for n in ("/x/a b?.md", "annual report.pdf", "../../etc/passwd", "年假 v1.md", "a/.", "/", "..")] == ["a_b_.md", "annual_report.pdf", "passwd", "年假_v1.md", "a", "unnamed", ".."]
    assert one(spark, "根据现有资料无法回答该问题。", T.is_refusal) is True
    assert one(spark, "第一句很长很长。短。第二句也很长很长！", T.sentences) == ["第一句很长很长。", "短。第二句也很长很长！"]
    assert one(spark, "abc!def!A long enough sentence.", T.sentences) == ["abc!def!A long enough sentence."]
    assert one(spark, "A long enough sentence! ab! c", T.sentences) == ["A long enough sentence!ab!c"]
    assert one(spark, "3.5 and 3.5, 7", T.numbers) == ["3.5", "7"]


@given(st.text(alphabet="ab。. \n", max_size=120))
@settings(max_examples=60, deadline=None)
def test_recursive_split_keeps_order_and_size(text):
    at = 0
    for chunk in C.split_text(text, 20, 5) if text.strip() else []:
        assert 0 < len(chunk) <= 20
        found = text.find(chunk, max(0, at))
        assert found >= 0
        at = found


def test_fusion(spark):
    dense = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id long, id long, score double, rank int")
    lexical = spark.createDataFrame([(1, 10, 5.0, 1), (1, 12, 4.0, 2), (2, 13, 3.0, 1)], "query_id long, id long, score double, rank int")
    out = {(r.query_id, r.id): r for r in S.fuse(dense, lexical).collect()}
    assert out[1, 10].final == pytest.approx(1.0)
    assert out[1, 10].position == 1
    assert out[1, 11].bm25_rank == -1
    assert [out[1, i].position for i in (11, 12)] == [2, 3]
    assert out[2, 13].final == 1.0  # a single list is wrapped


def test_length_score(spark):
    rows = spark.createDataFrame([(50,), (250,), (500,), (5000,)], "n int").select(S.length_score(F.col("n")).alias("s")).collect()
    assert [round(r.s, 6) for r in rows] == [0.2, 1.0, 1.0, 0.3]


def test_knn_blocks_and_nulls(spark, monkeypatch):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    monkeypatch.setattr(S, "BLOCK", 1)
    got = S.knn(rows, rows.where("vec_id in (0, 4)"), 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(0, 0), (0, 1), (4, 4), (4, 1)]


@pytest.mark.parametrize("block", [1, 100])
def test_dense_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "ROWS", 2)
    rows = [(f"d{i}", b, ((i * 7 + b * 3) % 11 - 3) / 10) for i in range(9) for b in range(6) if (i + b) % 3] + [("far", 99, 1.0), (None, 1, 1.0)]
    asks = [(q, b, (q + b) / 10) for q in (1, 2) for b in range(4)]
    got = {(r.query_id, r.id): (round(r.score, 9), r.rank) for r in S.dense(spark.createDataFrame(rows, "id string, bucket long, value double").repartition(3), spark.createDataFrame(asks, "id long, bucket long, value double"), 4).collect()}
    want = {}
    for q in (1, 2):
        mine = {b: v for x, b, v in asks if x == q}
        scores = {i: sum(v * mine[b] for x, b, v in rows if x == i and b in mine) for i, b, _ in rows if i and b in mine}
        order = sorted(scores, key=lambda i: (-round(min(1, max(0, scores[i])), 9), i))[:4]
        want |= {(q, i): (round(min(1, max(0, scores[i])), 9), n + 1) for n, i in enumerate(order)}
    assert got == want
    empty = spark.createDataFrame([], "id long, bucket long, value double")
    assert S.dense(empty, empty).count() == 0


def gate_of(spark, question, *texts):
    blocks = spark.createDataFrame([(1, i + 1, i, t) for i, t in enumerate(texts)], "query_id long, block int, id long, text string")
    asked = spark.createDataFrame([(1, question)], "query_id long, question string")
    found = A.evidence(blocks, asked)
    return A.gate(found, asked), found, blocks


def test_gate_and_answer(spark):
    gates, found, blocks = gate_of(spark, "annual leave days per year", "Annual leave is 15 days per year.\nAnother thing altogether here.", "Unrelated words only.")
    assert gates.first().passed
    out = A.answer(found, gates).first()
    assert not out.refused and "15 days" in out.answer and out.cited[0] == 1
    cited = A.citations(A.answer(found, gates), blocks).collect()
    assert 1 in [r.block for r in cited]
    gates, found, _ = gate_of(spark, "quantum chromodynamics lattice", "Annual leave is 15 days per year.")
    assert not gates.first().passed
    assert A.answer(found, gates).first().refused


@pytest.mark.parametrize("question", ["？！", "а б в", " "])
def test_gate_refuses_without_terms(spark, question):
    gates, found, _ = gate_of(spark, question, "Entirely unrelated sentence stands here.")
    assert found.first().score == 0.0
    assert not gates.first().passed
    out = A.answer(found, gates).first()
    assert out.refused and out.answer == T.NO_ANSWER


def test_rerank_takes_whole_numbers(spark):
    fused = spark.createDataFrame([(1, i, 0.5, i) for i in (1, 2)], "query_id long, id long, final double, position int")
    docs = spark.createDataFrame([(1, "leave of 15 days in all"), (2, "leave of 5 days in all.")], "id long, text string")
    asked = spark.createDataFrame([(1, "leave 5 days")], "query_id long, question string")
    rows = S.rerank(S.candidates(fused, docs), asked).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r["rank"])] == [2, 1]
    assert all(r.rerank == round(r.rerank, 4) and r.score == round(r.score, 4) for r in rows)


def test_bm25_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 1)
    monkeypatch.setattr(S, "ROWS", 2)
    monkeypatch.setattr(S, "PAIRS", 3)
    texts = {1: "aa bb aa", 2: "bb cc", 3: "", 4: None, 5: "dd dd dd aa", 6: "bb"}
    asks = {7: "aa dd aa", 8: "cc bb", 9: "zz"}
    held = S.index(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3))
    got = {(r.query_id, r.id): (round(r.score, 9), r["rank"]) for r in S.bm25(spark.createDataFrame(list(asks.items()), "query_id long, text string"), held, 3).collect()}
    split = {i: (t or "").split() or [""] for i, t in texts.items()}
    n, mean = len(split), sum(map(len, split.values())) / len(split)
    df = {w: sum(w in t for t in split.values()) for t in split.values() for w in t}
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    idf = {w: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, r in raw.items()}
    want = {}
    for q, ask in asks.items():
        score = {i: sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in ask.split() if w in idf) for i, t in split.items()}
        order = sorted((i for i in score if score[i] > 0), key=lambda i: (-round(score[i], 9), i))[:3]
        want |= {(q, i): (round(score[i], 9), at + 1) for at, i in enumerate(order)}
    assert got == want


def test_answer_path(spark):
    docs = spark.createDataFrame([(1, "Annual leave is 15 days per year for all staff.", "a.md"), (2, "Password length is 12 characters at least.", "b.md"), (3, None, "c.md")], "doc_id long, text string, source string")
    asked = spark.createDataFrame([(1, "\tannual leave days per year\n"), (2, "quantum chromodynamics lattice"), (3, " \n"), (4, None), (5, "？！")], "query_id long, text string")
    held = qa.corpus(docs)
    found = qa.hits(held, asked)
    kept = qa.ranked(held, asked, found)
    notes = {r.query_id: (r.note, r.kept) for r in qa.counters(asked, found, kept).collect()}
    assert notes[3] == notes[4] == ("empty_query", 0)
    assert notes[5] == ("no_hits", 0)
    assert notes[1][0] is None
    done = qa.answer(held, asked)
    rows = {r.query_id: r for r in done.answers.collect()}
    assert rows[1].answer.startswith(T.EXTRACTED + "\n- Annual leave is 15 days") and not rows[1].refused
    assert rows[2].answer == T.NO_ANSWER and rows[2].reason == "model_refused"
    assert rows[5].reason == "no_retrieval"
    cited = done.citations.orderBy("query_id", "n").collect()
    assert (cited[0].query_id, cited[0].n, cited[0].source, cited[0].page) == (1, 1, "a.md", None)
    assert cited[0].score > 0
    best = qa.retrieve(held, asked).where("query_id = 1 and rank = 1").first()
    assert qa.retrieve(held, asked, threshold=best.score + 0.01).where("query_id = 1").count() == 0
    only = qa.retrieve(held, asked, hybrid=False, where=F.col("source") == "b.md").where("query_id = 1").collect()
    assert {r.id for r in only} == {2}


def test_history(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a" * 201), (1, 3, "user", "q2"), (2, 0, "system", "only")], "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r.history for r in M.history(M.exchanges(turns)).collect()}
    assert got == {1: "用户：q1\n助手：" + "a" * 200 + "…\n用户：q2\n助手："}
    none = spark.createDataFrame([(3, 0, None, None)], "conv_id long, turn int, question string, answer string")
    assert M.history(none).first().history == T.NO_HISTORY


def test_evaluation_and_grid(spark, tmp_path):
    cases = spark.createDataFrame([(1, 1, True, 1.0, 0.2), (2, 0, False, 0.0, 0.0), (3, 0, False, 0.0, 0.0)], "query_id int, gold int, hit boolean, rr double, precision double")
    ranks = spark.createDataFrame([(1, 2, True, 0.5)], "query_id int, answer_rank int, answer_hit boolean, answer_rr double")
    answered = spark.createDataFrame([(1, False, True, False, False), (2, True, False, False, True), (3, True, False, False, False)], "query_id int, expect_refusal boolean, citation_hit boolean, keyword_hit boolean, refused boolean")
    named = spark.createDataFrame([(1, "q"), (2, "r"), (3, " ")], "query_id int, question string")
    out = A.evaluation(cases, ranks, answered, named)
    row = out.first()
    assert (row.cases, row.answerable, row.refusals, row.recall, row.answer_mrr, row.refusal_accuracy, row.errors, row.passed) == (3, 1, 2, 1.0, 0.5, 0.5, 1, False)
    A.save_reports(out, cases, str(tmp_path))
    assert "| recall | 1.0 |" in [r.value for r in spark.read.text(f"{tmp_path}/markdown").collect()]
    assert spark.read.json(f"{tmp_path}/cases").count() == 3
    gates = spark.createDataFrame([(1, 0.11, 0.0), (2, 0.09, 0.12)], "query_id int, corroborated double, lone double")
    gold = spark.createDataFrame([(1, 9)], "query_id int, id int")
    assert tuple(A.first_perfect(A.gate_grid(gates, gold)).first()) == (0.10, 0.13)


def test_inline_eval_set_and_collections(spark, tmp_path):
    rows = files.inline(spark.createDataFrame([(" １２ ", "s"), ("  ", "s")], "text string, source string")).collect()
    assert [(r.text, r.source_type, r.page) for r in rows] == [("12", "text", 1)]
    (tmp_path / "e.json").write_text('{"cases": [{"question": "q", "gold_source": "a.md", "gold_keywords": ["k"]}, {"question": "r", "expect_refusal": true}]}', encoding="utf-8")
    got = [(r.query_id, r.gold_sources, r.gold_keywords, r.expect_refusal) for r in files.eval_set(spark, str(tmp_path / "e.json")).collect()]
    assert got == [(0, ["a.md"], ["k"], False), (1, [], [], True)]
    root = str(tmp_path / "c")
    for name in ("b", "a"):
        M.write(spark.createDataFrame([("x", 1)], "chunk_id string, v int"), root, name)
    assert M.collections(spark, root) == ["a", "b"]
    assert (M.drop(spark, root, "a"), M.drop(spark, root, "a")) == (True, False)
    assert M.collections(spark, root) == ["b"]
    old = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "doc_id int, v string")
    assert tuple(M.removed(old, old.where("doc_id = 1").select("doc_id").distinct()).first()) == (2, 1)


def test_citation_fallback(spark):
    answers = spark.createDataFrame([(1, "see [9] and [9]", False), (2, "no", True)], "query_id long, answer string, refused boolean")
    blocks = spark.createDataFrame([(1, i, i * 10, "t") for i in range(1, 6)], "query_id long, block int, id long, text string")
    got = A.citations(answers, blocks).orderBy("block").collect()
    assert [(r.block, r.fallback) for r in got] == [(1, True), (2, True), (3, True)]


def test_greedy_near_dup(spark):
    same = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = spark.createDataFrame([("d", 0, same), ("d", 1, same), ("d", 2, "one two"), ("e", 0, same), ("d", 3, "")], "doc_id string, chunk_index long, text string")
    got = {(r.doc_id, r.chunk_index) for r in C.drop_near_chunks(rows).collect()}
    assert got == {("d", 0), ("d", 2), ("e", 0), ("d", 3)}


def test_upsert_delete(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, version int")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k long, v string, version int")
    assert {(r.k, r.v) for r in M.upsert(old, new, "k").collect()} == {(1, "a"), (2, "y"), (3, "z")}
    assert [r.k for r in M.delete(old, new.select("k"), "k").collect()] == [1]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("intro text\n# One\nbody\n## Two\nmore", encoding="utf-8")
    (tmp_path / "sub" / "g.txt").write_bytes("年假制度".encode("gbk"))
    (tmp_path / "x.exe").write_bytes(b"no")
    (tmp_path / "e.txt").write_bytes(b"  \n ")
    (tmp_path / "old.doc").write_bytes(b"\xd0\xcf")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    xml = f"<w:document {w}><w:body><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:tbl><w:tr>{cell('h1')}{cell('h2')}</w:tr><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl></w:body></w:document>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "d.docx").write_bytes(buffer.getvalue())
    rows = files.units(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    assert len(by["a.md"]) == 3
    assert by["g.txt"][0].text == "年假制度"
    assert by["x.exe"][0].error == "unsupported type"
    assert by["e.txt"][0].error == "empty document"
    assert by["old.doc"][0].error == "legacy .doc"
    assert by["d.docx"][0].text == "Para\n\n【表格 1】\n\nh1:a;h2:b"


def test_evidence_report_and_outcome(spark):
    named = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "gamma")], "query_id int, question string")
    found = A.evidence(spark.createDataFrame([(1, 1, "a", "alpha beta stand here"), (2, 1, "b", "nothing of the kind")], "query_id int, block int, id string, text string"), named)
    rows = {r.query_id: r for r in A.report(found, named).collect()}
    assert (rows[1].max_matched, rows[1].best_matched, rows[1].required, rows[1].gate_pass, rows[1].sentences) == (2, 2, 0.08, True, 1)
    assert (rows[2].max_matched, rows[2].required, rows[2].gate_pass) == (0, 0.15, False)
    assert (rows[3].best_score, rows[3].sentences, rows[3].gate_pass) == (0.0, 0, False)
    answers = spark.createDataFrame([(1, " fine "), (2, " "), (3, "x"), (4, T.REFUSALS[1]), (5, None)], "query_id int, answer string")
    hits = spark.createDataFrame([(1,), (1,), (2,), (4,), (5,)], "query_id int")
    got = {r.query_id: (r.answer, r.refused, r.reason) for r in A.outcome(answers, hits).collect()}
    assert got == {1: ("fine", False, None), 2: (T.NO_ANSWER, True, "empty_output"), 3: (T.NO_ANSWER, True, "no_retrieval"), 4: (T.REFUSALS[1], True, "model_refused"), 5: (T.NO_ANSWER, True, "empty_output")}


def test_answer_metrics(spark):
    cases = spark.createDataFrame([(1, "a.md", ["5天", "Paid"], False), (2, "", [], True), (3, "b.md", ["zzz"], False)], "query_id int, gold_source string, gold_keywords array<string>, expect_refusal boolean")
    blocks = spark.createDataFrame([(1, 1, "5 天"), (1, 2, "PAID 5 天"), (3, 1, None)], "query_id int, block int, text string")
    assert {r.query_id: (r.answer_rank, r.answer_rr) for r in A.answer_hits(blocks, cases).collect()} == {1: (2, 0.5), 2: (0, 0.0), 3: (0, 0.0)}
    answers = spark.createDataFrame([(1, "15天", False), (2, "-", True), (3, None, True)], "query_id int, answer string, refused boolean")
    cited = spark.createDataFrame([(1, "a.md"), (1, "a.md"), (3, "a.md")], "query_id int, source string")
    assert tuple(A.answer_summary(A.answer_cases(answers, cited, cases)).first()) == (0.5, 0.5, 1.0)


def test_document_chunks(spark):
    units = spark.createDataFrame([("d", 1, "first page " * 4, "s"), ("d", 2, "  ", "s"), ("d", 3, "third page " * 4, "s"), ("d", 4, "*** *** *** *** ***", "s"), ("e", 1, None, "s")], "doc_id string, page int, text string, source string")
    rows = ingest.chunks_of(units, 60, 0).orderBy("chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.page) for r in rows] == [("d", 0, 1), ("d", 1, 3)]
    assert len({r.chunk_id for r in rows}) == 2


def test_page_gaps(spark):
    pages = spark.createDataFrame([("d", 1, 0, 5), ("d", 2, 7, 9)], "doc_id string, page int, begin long, end long")
    at = spark.createDataFrame([("d", n) for n in (0, 4, 5, 7, 7, 20)] + [("e", 3)], "doc_id string, at long")
    assert sorted(tuple(r) for r in M.page_lookup(at, pages).collect()) == [("d", 0, 1), ("d", 4, 1), ("d", 5, 2), ("d", 7, 2), ("d", 7, 2), ("d", 20, 2), ("e", 3, 1)]


def test_collection_versions(spark, tmp_path):
    assert M.scan(spark, str(tmp_path), "c") is None
    M.write(spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int"), str(tmp_path), "c")
    M.write(spark.createDataFrame([("b", 2), ("c", 2), ("c", 2)], "chunk_id string, v int"), str(tmp_path), "c")
    assert sorted(tuple(r) for r in M.scan(spark, str(tmp_path), "c").collect()) == [("a", 1), ("b", 2), ("c", 2)]
    assert M.scan(spark, str(tmp_path), "c", 1).count() == 1
    assert M.versions(spark, str(tmp_path), "c") == [1, 2]
