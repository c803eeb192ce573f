import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.operators import assembly, ranking
from siltstone.plans import reports
from siltstone.sources import benchmarks, runs


def pairs(spark):
    return spark.createDataFrame([(1, "u", "I will check it", "generated"), (2, "u", "", "generated"), (3, "u", "I will check it", "seed")], "id int, user string, assistant string, source string")


def test_records_and_stamps(spark):
    rows = assembly.chat_records(pairs(spark), "be kind")
    assert [len(r["messages"]) for r in rows.collect()] == [3, 3]
    final = assembly.final_dataset(rows.where("id = 3"), rows.where("id = 1")).orderBy("part").collect()
    assert [(r["source"], r["seed_example"]) for r in final] == [("seed", True), ("generated", False)]
    assert assembly.non_seed_pool(assembly.final_dataset(rows, rows.where("false"))).count() == 2
    got = {r["id"]: (r["assistant"], r["support_style_sanitized"]) for r in assembly.softened(pairs(spark)).collect()}
    assert got == {1: ("Support can check it", True), 2: ("", False), 3: ("I will check it", False)}


def test_multiturn_and_seeds(spark):
    extra = "array<struct<user:string,assistant:string>>"
    rows = spark.createDataFrame([(1, [("a", "b"), (" ", "c"), ("d", "e"), ("f", "g")]), (2, [("", "x")])], f"id int, extra {extra}").withColumn("messages", F.array(assembly.message("user", F.lit("u")), assembly.message("assistant", F.lit("v"))))
    got = assembly.multiturn(rows, 2).collect()
    assert [(r["id"], r["num_turns"], r["messages"][-1]["content"]) for r in got] == [(1, 3, "e")]
    plan = spark.createDataFrame([("a", 1), ("b", 2)], "cluster_id string, slot int")
    seeds = spark.createDataFrame([("a", "s1"), ("c", "s2")], "cluster_id string, seed string")
    assert sorted((r["slot"], r["seed"]) for r in assembly.seeds_of_clusters(plan, seeds).collect()) == [(1, "s1"), (2, "s1"), (2, "s2")]


def test_bundle_and_history(spark, tmp_path):
    rows = assembly.chat_records(pairs(spark)).withColumn("ord", F.col("id"))
    bundle = reports.hub_bundle(rows, {"summary": {"total": 2}}, str(tmp_path), "set")
    assert "n<1K" in (bundle / "README.md").read_text()
    assert "dataset_metadata.json" in reports.publish_manifest(str(bundle), "me/set")["files"]
    assert runs.companion(str(bundle), "summary.json") == {"summary": {"total": 2}} and runs.companion(str(bundle), "none.json") is None
    path, schema = str(tmp_path / "history"), "run long, updated_at long"
    assert runs.history(spark, path, schema).count() == 0
    for n in range(3):
        runs.append_history(spark.createDataFrame([(n, n)], schema), path)
    assert [r["run"] for r in ranking.latest(runs.history(spark, path, schema), 2).collect()] == [2, 1]
    assert ranking.candidate_models(["b-coder", "a", "c"], "c", 2) == ["c", "a"] and ranking.candidate_models(["a", "b"], None, 1, wanted=["b", "z"]) == ["b"]
    one = benchmarks.cached_corpus(spark, None, str(tmp_path / "cache"), ("arc",))
    assert one.count() == 8 and len(list((tmp_path / "cache").iterdir())) == 1
    benchmarks.cached_corpus(spark, None, str(tmp_path / "cache"), ("arc",))
    assert len(list((tmp_path / "cache").iterdir())) == 1


def test_reports_of_uplift_and_validation(spark, tmp_path):
    from siltstone.operators import evaluation
    from siltstone.plans import effects

    holdout = spark.createDataFrame([(i, f"q{i}", f"the answer number {i} is here", "t") for i in range(6)], "id long, user string, assistant string, topic string")

    def model(batch):
        if 3 in list(batch["id"]):
            raise ValueError("no answer")
        return pd.DataFrame({"id": batch["id"], "prediction": [f"the answer number {i} is here" for i in batch["id"]]})

    score = lambda m: evaluation.prediction_scores(effects.predicted(holdout, m), "prediction", "assistant", "topic")
    rows = {r["id"]: r["prediction"] for r in effects.predicted(holdout.coalesce(1), model).collect()}
    assert rows[3] == "" and all(rows[i] for i in (0, 1, 2, 4, 5))
    empty = lambda batch: pd.DataFrame({"id": batch["id"], "prediction": ""})
    found = reports.uplift_report(score(empty), score(model), "base", "tuned", "holdout.jsonl")
    assert found["uplift"]["avg_success"] == pytest.approx(5 / 6, abs=1e-4) and found["base"]["avg_f1"] == 0
    runs_ = spark.createDataFrame([(1.0, 0.1, 0.2, 0.3), (2.0, 0.2, 0.4, 0.1), (3.0, None, 0.1, 0.1)], "match double, uplift_f1 double, uplift_success double, uplift_passed double")
    assert reports.validation_report(runs_)["runs"] == 2 and reports.validation_report(runs_)["corr_uplift_f1"] == 1.0
    (tmp_path / "h.jsonl").write_text("{}")
    bundle = reports.proof_bundle(found, str(tmp_path), "my set", "m", str(tmp_path / "h.jsonl"))
    assert {p.name for p in bundle.iterdir()} >= {"proof_summary.json", "proof_summary.md", "rubric.json", "h.jsonl", "finetune.sh", "evaluate.sh"}


def test_provenance_estimates_and_trees(spark):
    items, sources = benchmarks.corpus(spark, "/nowhere", ("arc", "gsm8k"))
    got = {r["benchmark"]: (r["source"], r["samples"]) for r in benchmarks.provenance(items, sources).collect()}
    assert got == {"arc": ("signatures", 8), "gsm8k": ("signatures", 10)} and benchmarks.provenance(items, sources).where("error is null").count() == 0
    assert ranking.rough_eta("ollama", "qwen-72b", 100, True) == (8, 15) and ranking.rough_eta("openai", "x", 10, False) == (1, 2)
    assert ranking.rounded_eta(spark.createDataFrame([(0.2, 0.9)], "low double, high double")).first().asDict() == {"low": 1, "high": 2}
