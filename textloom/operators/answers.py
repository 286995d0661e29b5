"""Evidence, the gate, extractive answers, citations and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .search import coverage, number_share, phrase_share, term_weights, total_length

#: Thresholds of the evidence gate and bounds of an answer.
CORROBORATED, LONE, TERMS, SENTENCES, PER_BLOCK, CHARS, LINE = 0.08, 0.15, 2, 4, 2, 900, 220


def evidence(blocks: DataFrame, questions: DataFrame) -> DataFrame:
    """Scored sentences of blocks(query_id, block, id, text) for questions(query_id, question), stripped.

    query_id, block, id, at, sentence, score, key, matched: coverage of the
    question's terms (idf of its own blocks), phrases and numbers; `key` ranks
    short sentences lower but leaves the gate's score alone.
    """
    text = F.coalesce("text", F.lit(""))
    asked = questions.select("query_id", T.content_terms(T.tokens(F.col("question"))).alias("terms"), T.phrases(F.col("question"), (2, 3, 4), 30, False).alias("phrases"), T.numbers(F.col("question")).alias("numbers"))
    asked = asked.withColumn("letters", total_length(F.col("phrases")))
    asked = term_weights(blocks.withColumn("tokens", T.tokens(text)), "query_id", "tokens", asked)
    s = F.col("sentence")
    rows = blocks.select("query_id", "block", "id", F.posexplode_outer(T.sentences(text)).alias("at", "sentence")).withColumn("solid", T.effective_length(s)).where("solid >= 4")  # none for null
    rows = rows.withColumn("tokens", T.tokens(s)).join(asked, "query_id").withColumn("matched", F.array_intersect("terms", "tokens"))
    rows = rows.withColumn("score", 0.55 * coverage(F.col("matched")) + 0.25 * phrase_share(F.col("phrases"), s, F.col("letters")) + 0.20 * number_share(F.col("numbers"), s, 0.3))
    key = F.when(F.col("solid") < 8, F.greatest(F.lit(0.0), F.col("score") - 0.5)).otherwise(F.col("score"))
    return rows.select("query_id", "block", "id", "at", "sentence", "score", key.alias("key"), F.size("matched").alias("matched"))


def gate(found: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, best, corroborated, lone, passed; a question without sentences doesn't pass."""
    best = lambda keep: F.coalesce(F.max(F.when(keep, F.col("score"))), F.lit(0.0))
    out = found.groupBy("query_id").agg(best(F.lit(True)).alias("best"), best(F.col("matched") >= TERMS).alias("corroborated"), best(F.col("matched") < TERMS).alias("lone"))
    zero = {"best": 0.0, "corroborated": 0.0, "lone": 0.0}
    return questions.select("query_id").join(out, "query_id", "left").fillna(zero).withColumn("passed", (F.col("corroborated") >= CORROBORATED) | (F.col("lone") >= LONE))


def answer(found: DataFrame, gates: DataFrame) -> DataFrame:
    """query_id, answer, refused, cited: the best sentences in reading order, or a refusal."""
    first = Window.partitionBy("query_id").orderBy(F.round("key", 9).desc(), "block", "at")
    picked = found.join(gates.where("passed").select("query_id"), "query_id", "left_semi").withColumn("n", F.row_number().over(first)).where(F.col("n") <= SENTENCES)
    own = Window.partitionBy("query_id", "block").orderBy("at")
    picked = picked.withColumn("of", F.row_number().over(own)).where(F.col("of") <= PER_BLOCK)
    ended = F.when(F.col("sentence").rlike("[。！？；.!?;]$"), F.col("sentence")).otherwise(F.concat("sentence", F.lit("。")))
    picked = picked.withColumn("line", F.concat(F.lit("- "), F.left(ended, F.lit(LINE)), F.lit("["), F.col("block").cast("string"), F.lit("]")))
    so_far = Window.partitionBy("query_id").orderBy("block", "at")
    picked = picked.withColumn("used", F.sum(F.length("line")).over(so_far)).where(F.col("used") <= CHARS)  # sums only grow, so the first overflow ends it
    lines = picked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("l"))
    out = gates.join(lines, "query_id", "left")
    text = F.when(F.col("l").isNull(), F.lit(T.NO_ANSWER)).otherwise(F.concat(F.lit(T.EXTRACTED + "\n"), F.array_join(F.col("l.line"), "\n")))
    return out.select("query_id", text.alias("answer"), F.col("l").isNull().alias("refused"), F.coalesce(F.array_distinct("l.block"), F.array().cast("array<int>")).alias("cited"))


def citations(answers: DataFrame, blocks: DataFrame, fallback: int = 3, most: int = 180) -> DataFrame:
    """query_id, n, block, id, source, page, score, snippet, fallback: the blocks that an answer names as [n], in its order; none named: the first ones; refused: none.

    blocks(query_id, block, id, text) may have source, page and score.
    """
    extra = {"source": F.lit(None).cast("string"), "page": F.lit(None).cast("int"), "score": F.lit(0.0)}
    blocks = blocks.select("query_id", "block", "id", "text", *(F.col(c) if c in blocks.columns else none.alias(c) for c, none in extra.items()))
    marks = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[([0-9]{1,2})\]"), F.lit(1)), lambda m: m.cast("int")))
    rows = answers.where("not refused").select("query_id", marks.alias("marks")).join(blocks, "query_id")
    by = Window.partitionBy("query_id")
    place = F.array_position("marks", F.col("block"))
    rows = rows.withColumn("place", place).withColumn("any", F.max(F.col("place") > 0).over(by)).where((F.col("place") > 0) | (~F.col("any") & (F.col("block") <= fallback)))
    n = F.row_number().over(by.orderBy("place", "block"))
    return rows.select("query_id", n.alias("n"), "block", "id", F.coalesce("source", F.lit("未知来源")).alias("source"), "page", F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"), T.truncate(F.col("text"), most).alias("snippet"), (~F.col("any")).alias("fallback"))


def metrics(hits: DataFrame, gold: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """One row per question: gold rank, reciprocal rank, hit, precision; gold(query_id, id)."""
    rows = hits.where(F.col("rank") <= k).join(gold.withColumn("right", F.lit(1)), ["query_id", "id"], "left")
    found = rows.groupBy("query_id").agg(F.min(F.when(F.col("right") == 1, F.col("rank"))).alias("first"), F.count("right").alias("right"), F.count("*").alias("got"))
    wanted = gold.groupBy("query_id").agg(F.count("*").alias("gold"))
    out = questions.select("query_id").join(wanted, "query_id", "left").join(found, "query_id", "left")
    return out.select("query_id", F.coalesce("gold", F.lit(0)).alias("gold"), F.col("first").isNotNull().alias("hit"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.coalesce(F.col("right") / F.greatest("got", F.lit(1)), F.lit(0.0)).alias("precision"))


def summarise(cases: DataFrame) -> DataFrame:
    """Means over answerable questions (those with gold); 0 for none."""
    able = F.col("gold") > 0
    mean = lambda c, keep: F.coalesce(F.avg(F.when(keep, c.cast("double"))), F.lit(0.0))
    return cases.agg(F.count("*").alias("cases"), F.count(F.when(able, 1)).alias("answerable"), mean(F.col("hit"), able).alias("recall"), mean(F.col("rr"), able).alias("mrr"), mean(F.col("precision"), able).alias("precision"))


def gate_grid(gates: DataFrame, gold: DataFrame, corroborated: tuple[float, ...] = (0.08, 0.10, 0.12), lone: tuple[float, ...] = (0.12, 0.13, 0.14, 0.15, 0.18)) -> DataFrame:
    """Share of answerable and of other questions that pass, for each pair of thresholds (15 rows)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("corroborated_at"), F.lit(x).alias("lone_at")) for c in corroborated for x in lone)))
    rows = gates.join(gold.select("query_id").distinct().withColumn("able", F.lit(True)), "query_id", "left").withColumn("p", pairs).select("*", "p.*")
    ok = ((F.col("corroborated") >= F.col("corroborated_at")) | (F.col("lone") >= F.col("lone_at"))).cast("double")
    return rows.groupBy("corroborated_at", "lone_at").agg(F.coalesce(F.avg(F.when(F.col("able"), ok)), F.lit(0.0)).alias("answerable_pass"), F.coalesce(F.avg(F.when(F.col("able").isNull(), ok)), F.lit(0.0)).alias("refusal_pass"))


def first_perfect(grid: DataFrame) -> DataFrame:
    """The first pair of thresholds, in ascending order, that lets all answerable questions pass and no other; no row if there is none."""
    return grid.where("answerable_pass = 1 and refusal_pass = 0").orderBy("corroborated_at", "lone_at").limit(1).select("corroborated_at", "lone_at")


def report(found: DataFrame, questions: DataFrame) -> DataFrame:
    """The gate's evidence per question: best score and its matches, most matches, both branches, the threshold that applied, sentences."""
    first = F.struct(F.round("score", 9).alias("s"), F.round("key", 9).alias("k"), (-F.col("block")).alias("b"), (-F.col("at")).alias("a"))
    out = found.groupBy("query_id").agg(F.max_by("matched", first).alias("best_matched"), F.max("matched").alias("max_matched"), F.count("*").alias("sentences"))
    rows = gate(found, questions).join(out, "query_id", "left").fillna(0, ["best_matched", "max_matched", "sentences"])
    required = F.when(F.col("corroborated") >= CORROBORATED, CORROBORATED).otherwise(LONE)
    shown = (F.round(c, 4).alias(f"{c}_score") for c in ("best", "corroborated", "lone"))
    return rows.select("query_id", *shown, "best_matched", "max_matched", required.alias("required"), F.col("passed").alias("gate_pass"), "sentences")


def outcome(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, answer, refused, reason for answers(query_id, answer): no_retrieval without hits, empty_output, model_refused, else null."""
    got = hits.select("query_id").distinct().withColumn("got", F.lit(True))
    text = T.strip(F.coalesce("answer", F.lit("")))
    reason = F.when(F.col("got").isNull(), "no_retrieval").when(text == "", "empty_output").when(T.is_refusal(text), "model_refused")
    rows = answers.join(got, "query_id", "left").withColumn("reason", reason)
    return rows.select("query_id", F.when(F.col("reason").isin("no_retrieval", "empty_output"), T.NO_ANSWER).otherwise(text).alias("answer"), F.col("reason").isNotNull().alias("refused"), "reason")


def answer_hits(blocks: DataFrame, cases: DataFrame) -> DataFrame:
    """query_id, answer_rank, answer_hit, answer_rr: the first block with all keywords of cases(query_id, gold_keywords), white space and case aside."""
    fold = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s", ""))
    words = F.filter(F.transform("gold_keywords", fold), lambda w: w != "")
    rows = cases.select("query_id", words.alias("words")).where(F.size("words") > 0).join(blocks.withColumn("folded", fold(F.col("text"))), "query_id")
    first = rows.where(F.forall("words", lambda w: F.contains(F.col("folded"), w))).groupBy("query_id").agg(F.min("block").alias("answer_rank"))
    out = cases.select("query_id").join(first, "query_id", "left")
    return out.select("query_id", F.coalesce("answer_rank", F.lit(0)).alias("answer_rank"), F.col("answer_rank").isNotNull().alias("answer_hit"), F.coalesce(1 / F.col("answer_rank"), F.lit(0.0)).alias("answer_rr"))


def answer_cases(answers: DataFrame, cited: DataFrame, cases: DataFrame) -> DataFrame:
    """query_id, expect_refusal, citation_hit, keyword_hit, refused for cases(query_id, gold_source, gold_keywords, expect_refusal).

    cited(query_id, source); a citation counts for the single gold source, a
    keyword if any of them stands in the answer as it is.
    """
    right = cited.join(cases.select("query_id", "gold_source"), "query_id").where("gold_source <> '' and source = gold_source").select("query_id").distinct().withColumn("right", F.lit(True))
    rows = cases.join(answers.select("query_id", "answer", "refused"), "query_id", "left").join(right, "query_id", "left")
    word = F.exists("gold_keywords", lambda w: F.contains(F.coalesce("answer", F.lit("")), w))
    return rows.select("query_id", "expect_refusal", F.col("right").isNotNull().alias("citation_hit"), F.coalesce(word, F.lit(False)).alias("keyword_hit"), F.coalesce("refused", F.lit(False)).alias("refused"))


def answer_summary(rows: DataFrame) -> DataFrame:
    """Citation accuracy and keyword hit rate of answerable cases, refusal accuracy of the others; 0 for none."""
    mean = lambda c, keep: F.coalesce(F.avg(F.when(keep, F.col(c).cast("double"))), F.lit(0.0)).alias
    able = ~F.col("expect_refusal")
    return rows.agg(mean("citation_hit", able)("citation_accuracy"), mean("keyword_hit", able)("keyword_hit_rate"), mean("refused", ~able)("refusal_accuracy"))


#: Recall and refusal accuracy below which an evaluation fails.
LEAST = {"recall": 0.6, "refusal_accuracy": 0.6}


def evaluation(cases: DataFrame, ranks: DataFrame, answered: DataFrame, questions: DataFrame, failed: DataFrame | None = None, latency: DataFrame | None = None) -> DataFrame:
    """One row with every measure of an evaluation, and whether it passes LEAST.

    cases of `metrics`, ranks of `answer_hits`, answered of `answer_cases`, and
    questions(query_id, question), the blank ones of which are errors, as are
    those in failed(query_id, error): they count as misses and stop nothing.
    latency(query_id, ms) adds avg_latency_ms, over cases without errors.
    """
    rows = answered.join(cases, "query_id", "left").join(ranks, "query_id", "left").join(questions.select("query_id", (T.strip(F.coalesce("question", F.lit(""))) == "").alias("error")), "query_id", "left")
    if failed is not None:
        rows = rows.join(failed.select("query_id", F.lit(True).alias("failed")).distinct(), "query_id", "left").withColumn("error", F.coalesce("error", F.lit(False)) | F.coalesce("failed", F.lit(False)))
        missed = {c: F.when(~F.col("error"), F.col(c)) for c in ("hit", "precision", "rr", "answer_hit", "answer_rr", "citation_hit", "keyword_hit", "refused")}
        rows = rows.withColumns(missed)
    extra = []
    if latency is not None:
        rows = rows.join(latency.groupBy("query_id").agg(F.sum("ms").alias("ms")), "query_id", "left")
        extra = [F.coalesce(F.avg(F.when(~F.coalesce("error", F.lit(False)), F.col("ms").cast("double"))), F.lit(0.0)).alias("avg_latency_ms")]
    able = ~F.col("expect_refusal")
    mean = lambda c, keep: F.coalesce(F.avg(F.when(keep, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))), F.lit(0.0))
    names = {"hit": "recall", "precision": "precision", "rr": "mrr", "answer_hit": "answer_hit", "answer_rr": "answer_mrr", "citation_hit": "citation_accuracy", "keyword_hit": "keyword_hit_rate"}
    out = rows.agg(F.count("*").alias("cases"), F.count(F.when(able, 1)).alias("answerable"), F.count(F.when(~able, 1)).alias("refusals"), *(mean(c, able).alias(name) for c, name in names.items()), mean("refused", ~able).alias("refusal_accuracy"), F.count(F.when(F.col("error"), 1)).alias("errors"), *extra)
    passed = (F.col("recall") >= LEAST["recall"]) & ((F.col("refusals") == 0) | (F.col("refusal_accuracy") >= LEAST["refusal_accuracy"]))
    return out.withColumn("passed", passed)


def save_reports(summary: DataFrame, cases: DataFrame, path: str) -> None:
    """`summary` and `cases` as JSON lines below `path`, and the summary as a Markdown table."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    cases.write.mode("overwrite").json(f"{path}/cases")
    lines = F.concat(F.lit("| measure | value |\n|---|---|\n"), F.array_join(F.array(*(F.concat(F.lit(f"| {c} | "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(" |")) for c in summary.columns)), "\n"))
    summary.select(lines.alias("value")).write.mode("overwrite").text(f"{path}/markdown")


def separation(scores: DataFrame) -> DataFrame:
    """min, mean and max of scores(able, score) for answerable and other cases, and the gap between them (0 stands in for a missing class)."""
    of = lambda f, able: f(F.when(F.col("able") == able, F.col("score")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    shown = [zero(of(f, able)).alias(f"{name}_{f.__name__}") for name, able in (("answerable", True), ("refusal", False)) for f in (F.min, F.avg, F.max)]
    return scores.agg(*shown, (zero(of(F.min, True)) - zero(of(F.max, False))).alias("gap"))
