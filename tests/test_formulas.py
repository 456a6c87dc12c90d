"""Formulas at their breakpoints, with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sievelake.functions import keyed_random as R
from sievelake.functions import text as X
from sievelake.operators import budget, hardness, relevance, retrieval, stability
from sievelake.operators import statistics as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize(
    "tokens, cap, want",
    [(0, 100, 0.0), (49, 100, 0.735), (50, 100, 0.7), (60, 100, 0.8), (70, 100, 0.9), (100, 100, 1.0), (250, 100, 1.0), (5, 0, 0.0)],
)
def test_budget_success(spark, tokens, cap, want):
    assert one(spark, budget.success_probability(F.lit(tokens), F.lit(cap))) == pytest.approx(want)


@pytest.mark.parametrize("recall, want", [(0.0, 0.0), (0.3, 0.3), (0.5, 0.5), (0.65, 0.7), (0.8, 0.98), (1.0, 1.0)])
def test_recall_success(spark, recall, want):
    assert one(spark, relevance.success_probability(F.lit(recall))) == pytest.approx(want)


@pytest.mark.parametrize(
    "chars, h, strategy, want",
    [(5001, 1.0, "heavy", 1.0), (5000, 1.0, "heavy", 0.5), (2001, 0.5, "fast", 0.8), (2000, 0.5, "fast", 0.5), (9000, 0.0, "fixed", 0.9)],
)
def test_adaptive_success(spark, chars, h, strategy, want):
    assert one(spark, hardness.success_probability(F.lit(chars), F.lit(h), F.lit(strategy))) == pytest.approx(want)


def test_hardness(spark):
    h = lambda q: one(spark, hardness.hardness(F.lit(q), 0.5))
    assert h("How to optimize database queries?") == pytest.approx(0.5 / 3 + 0.3 * 5 / 20 + 0.1)
    assert h("") == pytest.approx(0.1)
    assert h(" ".join(hardness.HARD_WORDS * 3)) == pytest.approx(0.5 * 10 / 11 + 0.3 + 0.1)
    assert one(spark, hardness.hardness_class(F.lit(0.5))) == "hard"
    assert one(spark, hardness.plan(F.lit(0.49))).topk == 5 and one(spark, hardness.plan(F.lit(0.5))).topk == 20


@pytest.mark.parametrize("n, p50, p99", [(1, 0, 0), (2, 1, 1), (100, 50, 99), (300, 150, 297)])
def test_percentile_places(spark, n, p50, p99):
    df = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    r = S.percentiles(df, "v", ["g"]).collect()[0]
    assert (r.p50, r.p99) == (p50, p99)


def test_bins_are_right_closed(spark):
    edges = S.edges(-1.0, 0.1, 24)
    rows = [(x,) for e in edges for x in (e - 1e-9, e, e + 1e-9)] + [(None,), (5.0,)]
    df = spark.createDataFrame(rows, "v double")
    for r in df.select("v", S.bin_of(F.col("v"), -1.0, 0.1, 24).alias("b")).collect():
        want = next((i for i in range(24) if r.v is not None and edges[i] < r.v <= edges[i + 1]), None)
        assert r.b == want


def test_evaluate_without_gold(spark):
    tasks = spark.createDataFrame([("a", 5), ("b", 5)], "task_id string, topk int")
    hits = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("b", 5, 1)], "task_id string, topk int, doc_id bigint")
    gold = spark.createDataFrame([("a", 2), ("a", 9)], "task_id string, doc_id bigint")
    got = {r.task_id: r for r in relevance.evaluate(tasks, hits, gold, ["task_id", "topk"]).collect()}
    assert (got["a"].recall, got["a"].precision, got["a"].f1) == (0.5, 0.5, 0.5)
    assert (got["b"].recall, got["b"].precision, got["b"].f1, got["b"].overlap, got["b"].gold_count) == (0, 0, 0, 0, 0)


def test_text_functions(spark):
    assert one(spark, X.count_tokens(F.lit("abcde"))) == 2
    assert one(spark, X.count_tokens(F.lit("abc, 12345!"), "pieces")) == 5
    assert one(spark, X.count_tokens(F.lit("abcde"), "unknown")) == 2
    assert one(spark, X.truncate(F.lit("abcdefgh"), F.lit(1))) == "abcd"
    assert one(spark, X.truncate(F.lit("a b c"), F.lit(2), "pieces")) == "a b"
    with pytest.raises(ValueError):
        X.truncate(F.lit("a"), F.lit(1), "unknown")
    assert one(spark, X.word_set(F.lit("  The the cte? cte"))) == ["the", "cte?", "cte"]
    assert one(spark, X.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0


def test_keyed_draws_do_not_depend_on_partitions(spark):
    draw = lambda df: {r.id: (r.u, r.g) for r in df.select("id", R.uniform(1, F.col("id")).alias("u"), R.gaussian(1, F.col("id")).alias("g")).collect()}
    a, b = draw(spark.range(500)), draw(spark.range(500).repartition(7))
    assert a == b and all(0 <= u < 1 for u, _ in a.values())
    mean = sum(g for _, g in a.values()) / 500
    assert abs(mean) < 0.2 and 0.8 < sum(g * g for _, g in a.values()) / 500 < 1.2


def test_top_k_matches_sql_expressions_and_ties(spark):
    pool = spark.createDataFrame([(i, [float(i // 2), 0.0]) for i in range(20)] + [(99, None), (None, [0.0, 0.0])], "doc_id bigint, embedding array<float>")
    asked = spark.createDataFrame([("a", [0.0, 0.0], 0), ("b", [9.0, 1.0], None), ("c", None, None)], "task_id string, query_vector array<float>, own bigint")
    got = [(r.task_id, r["rank"], r.doc_id, r.dist) for r in retrieval.top_k(asked, pool, 3, exclude="own").orderBy("task_id", "rank").collect()]
    assert got == [("a", 1, 1, 0.0), ("a", 2, 2, 1.0), ("a", 3, 3, 1.0), ("b", 1, 18, 1.0), ("b", 2, 19, 1.0), ("b", 3, 16, 2.0)]
    cells = pool.crossJoin(asked.where("task_id = 'a'")).where("doc_id = 4").select(retrieval.squared_l2(F.col("embedding"), F.col("query_vector")).alias("d"))
    assert cells.collect()[0].d == 4.0
    assert retrieval.top_k(asked.limit(0), pool, 3).collect() == []
    assert retrieval.top_k(asked, pool.limit(0), 3).collect() == []
    assert retrieval.top_k(asked, pool, 500).where("task_id = 'a'").count() == 20


def test_queries_go_in_blocks(spark, monkeypatch):
    pool = spark.createDataFrame([(i, [float(i)]) for i in range(9)], "doc_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(f"t{i}", [float(i)]) for i in range(9)], "task_id string, query_vector array<float>")
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 16)
    assert {(r.task_id, r.doc_id) for r in retrieval.top_k(asked, pool, 1).collect()} == {(f"t{i}", i) for i in range(9)}


def test_single_run_is_stable(spark):
    runs = spark.createDataFrame([("t", 0, "a b", "Response_1", 3)], "task_id string, run_id int, context string, output string, token_cost bigint")
    r = stability.stability(runs, ["task_id"]).collect()[0]
    assert (r.context_stability, r.output_stability, r.cost_cv) == (1.0, 1.0, 0.0)


def test_search_equals_all_distances(spark):
    import random

    rng = random.Random(3)
    pool = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(3000)]
    pool += [(3000 + i, pool[i % 7][1]) for i in range(60)]  # ties
    asked = [(i, [rng.gauss(0, 1) for _ in range(8)], i) for i in range(40)] + [(100 + i, pool[i][1], i) for i in range(7)]
    frame = spark.createDataFrame(pool, "doc_id bigint, embedding array<double>").repartition(5)
    got = {(r.q, r["rank"], r.doc_id) for r in retrieval.top_k(spark.createDataFrame(asked, "q bigint, query_vector array<double>, own bigint"), frame, 12, key="q", exclude="own").collect()}
    want = set()
    for q, v, own in asked:
        ranked = sorted((round(sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), 11), i) for i, e in pool if i != own)[:12]
        want |= {(q, n, i) for n, (_, i) in enumerate(ranked, 1)}
    assert got == want


def test_gold_equals_all_pairs(spark):
    import random

    rng = random.Random(9)
    words = ["the", "of", "and"] * 6 + [f"w{i}" for i in range(40)]
    asked = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(40)] + [(90, ""), (91, None)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(200)] + [(900, ""), (901, None)]
    got = {(r.task_id, r.doc_id, r.overlap) for r in relevance.gold(spark.createDataFrame(asked, "task_id int, query string"), spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    want = set()
    for t, q in asked:
        for i, text in docs:
            a, b = set((q or "").split()), set((text or "").split()[:20])
            if a & b and (len(a & b) >= 3 or len(a & b) / len(a | b) > 0.15):
                want.add((t, i, len(a & b)))
    assert got == want
