import pytest
from pyspark.sql import functions as F

from siltstone.operators import artifacts, decontamination, distribution, diversity, evaluation, planning, quality, ranking, reference, selection
from siltstone.operators.views import conversation_examples

ITEM = "the quick brown fox jumps over the lazy dog near the river"


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("b", 0, "unrelated words that nobody says in any text"), ("b", 1, ITEM), ("c", 0, ITEM), ("c", 1, "!!!"), ("d", 0, "lazy dog")], "benchmark string, item_index long, text string")


def verdict_of(spark, bench, text):
    ex = spark.createDataFrame([("x", text)], "id string, text string")
    found = decontamination.evidence(ex, bench)
    v = decontamination.verdicts(ex, found).first()
    return v["verdict"], v["flags"], sorted((r["benchmark"], r["method"], r["item_index"]) for r in found.collect())


def test_ladder_and_policy(spark, bench):
    assert verdict_of(spark, bench, ITEM.upper() + "!") == ("block", ["b", "c", "d"], [("b", "exact", 1), ("c", "exact", 0), ("d", "substring", 0)])
    assert verdict_of(spark, bench, f"before {ITEM} after") == ("block", ["b", "c", "d"], [("b", "ngram", 1), ("c", "ngram", 0), ("d", "substring", 0)])
    assert verdict_of(spark, bench, "a very lazy dog.") == ("review", ["d"], [("d", "substring", 0)])
    assert verdict_of(spark, bench, "clean words only") == ("clean", [], [])
    assert verdict_of(spark, bench, "") == ("clean", [], [])
    # cut inside the first and last word: grams miss, the substring is there
    assert verdict_of(spark, spark.createDataFrame([("e", 3, "ick brown fox jum")], bench.schema), "the quick brown fox jumps")[2] == [("e", "substring", 3)]
    assert verdict_of(spark, spark.createDataFrame([("e", 3, "ick brown fox jumps ov")], bench.schema), "the quick brown fox jumps over")[2] == [("e", "substring", 3)]


def test_contaminated_rows_go_and_review_stays(spark):
    rows = spark.createDataFrame([(1, "block", []), (2, "review", ["b"]), (3, "", ["b"]), (4, None, []), (5, "clean", ["b"])], "id int, verdict string, flags array<string>")
    assert [r["id"] for r in decontamination.without_contaminated(rows).orderBy("id").collect()] == [2, 4, 5]


def test_vector_ranks(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "id int, embedding array<double>")
    b = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.96, 0.04]), (2, [0.0, 1.0])], "item_index int, embedding array<double>")
    assert [(r["item_index"], r["match_rank"]) for r in decontamination.vector_top_k(q, b, 2, 0.8).orderBy("match_rank").collect()] == [(0, 1), (1, 2)]
    assert reference.semantic_overlap(q, b).first()[0] == 1.0
    assert reference.semantic_overlap(q.where("false"), b).first()[0] == 0.0


def examples(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, user string, assistant string, topic string, overall double")


def test_scores_and_report(spark):
    long = "a good long answer of more than twelve words which says quite a lot indeed"
    rows = quality.scored(examples(spark, ("Hi", "Short.", "t", 9.0), ("what is this thing", long, None, 9.0), ("what is this thing", long.upper(), "t", None)).withColumn("judge_issues", F.lit(None).cast("array<string>")))
    assert [r["quality_score"] for r in rows.orderBy("id").collect()] == [7.0, 9.0, 5.0]
    s = quality.pass_rate(quality.summary(rows)).first()
    assert (s["total"], s["passed"], s["failed"]) == (3, 1, 2)
    assert quality.duplicate_stats(rows).first().asDict() == {"groups": 1, "members": 2}
    assert {r["topic"]: (r["easy"], r["medium"], r["hard"]) for r in quality.topic_heatmap(rows).collect()} == {"t": (2, 0, 0), "unknown": (0, 0, 1)}
    assert [r["id"] for r in selection.first_of_pairs(rows).orderBy("id").collect()] == [0, 1]
    empty = rows.where("false")
    assert quality.summary(empty).first()["avg_score"] == 0.0 and not quality.usable_gate(quality.summary(empty).withColumn("hits", F.lit(0))).first()["usable"]


def test_diversity(spark):
    rows = examples(spark, ("", "a b c d", "", 1.0), ("", "a b c e", "", 1.0), ("", "x", "", 1.0), ("", "y", "", 1.0))
    # one pair at 2/3, four at 1 (a short one on one side), the pair of short ones left out
    assert diversity.mean_gram_distance(rows).first()[0] == pytest.approx((2 / 3 + 4) / 5)
    assert diversity.mean_gram_distance(rows.limit(1)).first()[0] == 1.0
    assert diversity.mean_gram_distance(rows.where("false")).first()[0] == 1.0
    assert diversity.lexical_diversity(rows.where("false")).first()["lexical_diversity"] == 0.0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "id int, embedding array<double>")
    assert diversity.mean_vector_distance(v).first()[0] == pytest.approx(2 / 3)
    assert diversity.sample(rows, 2).count() == 2


def test_distributions(spark):
    c = lambda *rows: spark.createDataFrame(list(rows), "key string, n long")
    assert distribution.total_variation(c(("a", 4), ("b", 2)), c(("a", 1), ("c", 1))).first()[0] == pytest.approx(0.5)
    assert distribution.total_variation(c(), c(("a", 1))).first()[0] == 0.5
    assert {r["key"]: r["gap"] for r in distribution.planned_gaps(c(("a", 4), ("b", 2)), c(("a", 1), ("b", 3))).collect()} == {"a": 3, "b": 0}
    rows = spark.createDataFrame([("", "s"), (None, ""), ("k", None)], "cluster_id string, seed_cluster_id string")
    assert {r["key"] for r in distribution.accepted_by_cluster(rows).collect()} == {"s", "general__medium__concise", "k"}


def clusters(spark):
    return spark.createDataFrame(
        [("a", 0, "billing", "hard", "concise", "hard", 4, 4), ("b", 0, "billing", "easy", "detailed", "easy", 2, 2), ("c", 1, "account", "easy", "concise", "easy", 1, 1)],
        "cluster_id string, semantic_cluster int, topic string, complexity string, style string, difficulty string, seed_count long, target_examples long",
    )


def test_planning(spark):
    c = clusters(spark)
    none = spark.createDataFrame([], "key string, n long")
    edges = planning.neighbor_edges(planning.cluster_vectors(c), 2)
    assert edges.groupBy("src").count().where("count = 2").count() == 3
    order = [r["cluster_id"] for r in planning.prioritized(c, edges, none).orderBy("place").collect()]
    assert order[0] == "a"
    slots = planning.plan_slots(planning.allocated(planning.prioritized(c, edges, none)))
    counts = {r["cluster_id"]: r["count"] for r in slots.groupBy("cluster_id").count().collect()}
    assert all(counts[k] >= n for k, n in {"a": 4, "b": 2, "c": 1}.items())
    full = spark.createDataFrame([("a", 4), ("b", 2), ("c", 1)], "key string, n long")
    assert planning.prioritized(c, edges, full).count() == 0
    focus = planning.allocated(planning.prioritized(c, edges, full, ["b"])).first()
    assert (focus["cluster_id"], focus["allocation"]) == ("b", 0)
    status = distribution.status(c, edges, full).first()
    assert status["divergence"] == 0 and status["graph_coverage"] > 0 and status["match_score"] > 90
    assert planning.fallback_plan(c.select("topic").distinct()).count() == 18


def test_targets_can_starve_late_clusters(spark):
    p = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1), ("d", 1)], "cluster_id string, seed_count long")
    got = lambda n: [r["target_examples"] for r in planning.with_targets(p, n).orderBy(F.desc("seed_count"), "cluster_id").collect()]
    assert got(2) == [1, 1, 0, 0] and got(100) == [42, 42, 8, 8] and got(5) == [2, 2, 1, 0]


def test_leader_clusters_and_topics(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.14]), (3, [0.0, 1.0])], "id int, embedding array<double>")
    assert [r["semantic_cluster"] for r in planning.leader_clusters(v).orderBy("id").collect()] == [0, 0, 1]
    tree = spark.createDataFrame([("r", [("x", ["1", "2"]), ("y", ["3"])])], "root string, branches array<struct<name:string,leaves:array<string>>>")
    assert [r["topic"] for r in planning.topic_leaves(tree).orderBy("i", "j").collect()] == ["x — 1", "x — 2", "y — 3"]


def test_selection(spark):
    rows = examples(spark, *[(f"q {i}", f"a {i}", "t", float(s)) for i, s in enumerate((8.0, 9.0, 4.0, 9.0))]).withColumn("quality_score", F.col("overall")).withColumn("quality_issues", F.array())
    assert [r["id"] for r in selection.keep_best(rows, 2, 7.0).collect()] == [1, 3]
    assert [r["id"] for r in selection.keep_best(rows, 2).collect()] == [0, 1]
    parts = {r["id"]: (r["bucket"], r["rejection_reasons"]) for r in selection.split(rows, rows.where("id = 1"), 7.0).collect()}
    assert parts[1] == ("accepted", []) and parts[2] == ("rejected", ["below_min_quality:7.0"]) and parts[0] == ("rejected", ["not_selected"])
    seeds = rows.where("id = 0")
    again = rows.unionByName(rows.where("id = 1").withColumn("id", F.lit(9).cast("long")).withColumn("user", F.lit("Q   1")))
    assert [r["id"] for r in selection.new_pairs(again, seeds).orderBy("id").collect()] == [1, 2, 3]
    old = rows.where("id = 2").withColumn("quality_score", F.lit(6.5))
    assert selection.resumed(rows, old).where("id = 2").first()["quality_score"] == 6.5
    risky = examples(spark, ("q", "I can refund it", "t", 1.0), ("q", "I can", "t", 1.0), ("q", "no", "t", 1.0)).withColumn("source", F.lit("generated")).withColumn("reviewed", F.lit(False))
    assert [r["id"] for r in selection.riskiest(risky, 5).collect()] == [0, 1]
    assert {r["id"]: r["reviewed"] for r in selection.curated(risky, 1).collect()} == {0: True, 1: False, 2: False}


def test_sorting(spark):
    rows = spark.createDataFrame([(1, 7.2, "zeta", ["b"]), (2, 9.1, "alpha", ["c"]), (3, None, "Beta", ["a"])], "id int, quality_score double, topic string, rejection_reasons array<string>")
    order = lambda by: [r["id"] for r in artifacts.inspect_place(rows, by).orderBy("place").collect()]
    assert order("score") == [2, 1, 3] and order("topic") == [2, 3, 1] and order("reason") == [3, 1, 2] and order("other") == [1, 2, 3]


def test_evaluation(spark):
    f1 = lambda p, r: spark.range(1).select(evaluation.token_f1(F.lit(p), F.lit(r))).first()[0]
    assert f1("a b b", "b b c") == pytest.approx(2 / 3) and f1("", "a") == 0 and f1("a", "b") == 0
    p = spark.createDataFrame([(i * 10, f"p{i}") for i in range(25)], "ord long, text string")
    h = spark.createDataFrame([(i, f"p{i}", "") for i in range(40)], "ord long, assistant string, topic string")
    pairs = evaluation.positional(p, h)
    assert pairs.count() == 25 and pairs.where("p_text != h_assistant").count() == 0
    m = {r["topic"]: r["avg_f1"] for r in evaluation.holdout_metrics(evaluation.prediction_scores(pairs, "p_text", "h_assistant", "h_topic")).collect()}
    assert m == {"unknown": 1.0, "all topics": 1.0}
    xy = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0)], "x double, y double, k double")
    assert evaluation.correlation(xy, "x", "y").first()["correlation"] == pytest.approx(1.0)
    assert evaluation.correlation(xy, "x", "k").first()["correlation"] is None
    assert evaluation.correlation(xy.limit(1), "x", "y").first()["correlation"] is None
    runs = spark.createDataFrame([(71.0, 0.1, 0.2, 0.0), (82.9, 0.2, 0.1, 0.0), (50.0, None, None, None)], "match double, uplift_f1 double, uplift_success double, uplift_passed double")
    v = evaluation.metric_validation(runs).first()
    assert (v["runs"], v["corr_uplift_f1"], v["corr_uplift_success"], v["corr_uplift_passed"]) == (2, 1.0, -1.0, None)


def test_positional_keeps_all_rows_however_ranges_are_coalesced(spark, tmp_path):
    wide = F.concat(F.lit("p"), F.col("id").cast("string"), F.lit(" "), F.repeat(F.sha2(F.col("id").cast("string"), 512), 4))
    spark.range(200_000, numPartitions=8).select((F.col("id") * 3).alias("ord"), wide.alias("text")).write.parquet(f"{tmp_path}/p")
    spark.range(200_000, numPartitions=8).select(F.col("id").alias("ord"), wide.alias("assistant")).write.parquet(f"{tmp_path}/h")
    p, h = spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/h")
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = evaluation.positional(p, h).agg(F.count(F.lit(1)), F.max("place"), F.count_distinct("place"), F.count_if(F.col("p_text") != F.col("h_assistant"))).first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tuple(got) == (200_000, 200_000, 200_000, 0)


def test_ranking(spark):
    rows = spark.createDataFrame([("a", "ok", 9.0, 0.9, 1.0), ("b", "ok", 8.0, 1.0, 2.0), ("c", "failed", 10.0, 1.0, 9.0)], "model string, status string, avg_quality_score double, pass_rate double, examples_per_second double")
    assert [(r["model"], r["composite"]) for r in ranking.ranked_models(rows).orderBy("place").collect()] == [("a", 0.5), ("b", 0.5)]
    history = spark.createDataFrame([("p", "m", True, n, float(t), n) for n, t in ((10, 1), (20, 4), (1000, 1))], "provider string, model string, has_seeds boolean, examples long, minutes double, updated_at long")
    assert ranking.eta_minutes(history, "p", "m", True, 10, 2).first()["middle"] == 2.0
    recs = spark.createDataFrame([(1, "customer_support", "x"), (2, "it_support_desk", "y")], "ord int, domain string, model string")
    assert ranking.recommended(recs, "it_desk").first()["model"] == "y"
    assert ranking.recommended(recs, "cooking").count() == 0


def test_conversations(spark):
    rows = spark.createDataFrame([(1, 2, "assistant", "late"), (1, 0, "user", "u"), (1, 1, "assistant", "first"), (2, 0, "user", "only")], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: (r["user"], r["assistant"]) for r in conversation_examples(rows).collect()} == {1: ("u", "first"), 2: ("only", "")}
