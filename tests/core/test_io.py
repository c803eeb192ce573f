import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.config import Config, Generation
from siltstone.plans import effects
from siltstone.plans.engine import Engine
from siltstone.sources import benchmarks, jsonl, runs, writers
from siltstone.streaming.scoring import score_stream

RECORDS = [
    {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "how do I reset it"}, {"role": "assistant", "content": "press the button"}], "metadata": {"topic": "reset"}, "quality_score": 8.5},
    {"user": "u2", "assistant": "a2"},
    {"instruction": "do", "input": "with this", "output": "done"},
    {"instruction": "do", "output": "done too"},
    {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"from": "odd", "value": "o"}]},
    {"messages": [{"role": "user", "content": "alone"}], "user": "u", "assistant": "a"},
    {"messages": [{"role": "tool", "content": "t"}, {"role": "user", "content": "x"}]},
    {"other": 1},
    [1, 2],
    7,
]


@pytest.fixture
def lines(tmp_path):
    path = tmp_path / "in" / "rows.jsonl"
    path.parent.mkdir()
    path.write_text("\n".join([*map(json.dumps, RECORDS), "", "  ", "{broken", '{"messages": null, "user": "n", "assistant": "m"}']) + "\n")
    return str(path)


def test_dialects(spark, lines):
    rows = jsonl.read_examples(spark, lines, keep_scores=True).orderBy("ord").collect()
    assert [(r["user"], r["assistant"]) for r in rows][:5] == [("how do I reset it", "press the button"), ("u2", "a2"), ("do\n\nwith this", "done"), ("do", "done too"), ("h", "g")]
    assert len(rows) == 5  # a record whose messages are null is dropped: its key is there
    assert rows[0]["quality_score"] == 8.5 and rows[1]["quality_score"] is None
    assert rows[4]["messages"][2]["role"] == "user"
    meta = jsonl.read_examples(spark, lines).orderBy("ord").select(jsonl.metadata_field("topic")).first()[0]
    assert meta == "reset"


@pytest.mark.parametrize("kind", ["jsonl", "sharegpt", "chatml"])
def test_export_round_trips(spark, lines, tmp_path, kind):
    rows = jsonl.read_examples(spark, lines)
    path = writers.export(rows, kind, str(tmp_path), "my set/x")
    assert path.endswith(f"my_set_x_{kind}")
    back = spark.read.text(path).count()
    assert back == rows.count()
    if kind != "chatml":
        again = jsonl.read_examples(spark, path)
        assert sorted((r["user"], r["assistant"]) for r in again.collect()) == sorted((r["user"], r["assistant"]) for r in rows.collect())
    with pytest.raises(ValueError):
        writers.export(rows, "parrot", str(tmp_path), "x")


def test_alpaca_array_csv_and_artifacts(spark, lines, tmp_path):
    rows = jsonl.read_examples(spark, lines)
    whole = json.loads(writers.alpaca_array(writers.format_lines(rows, "alpaca")))
    assert whole[0] == {"instruction": "how do I reset it", "input": "", "output": "press the button"}
    flat = spark.createDataFrame([(1, ["a", "b"], "accepted"), (2, [], "rejected")], "id int, tags array<string>, bucket string")
    writers.csv(flat, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("id").first()["tags"] == "a | b"
    writers.artifacts(flat, str(tmp_path / "art"))
    assert sorted(p.name for p in (tmp_path / "art").glob("bucket=*")) == ["bucket=accepted", "bucket=rejected"]
    assert writers.report(flat.where("id = 1"), str(tmp_path / "r"))["id"] == 1 and (tmp_path / "r.md").exists()
    assert [writers.size_category(n) for n in (99, 999, 10**6)] == ["n<1K", "1K<n<10K", "n>1M"]


def test_latest_artifacts_and_runs(spark, tmp_path):
    for name, age in (("old", 100), ("new", 0)):
        for bucket in runs.BUCKETS:
            p = tmp_path / f"{name}_{bucket}.jsonl"
            p.write_text("{}\n")
            os.utime(p, (p.stat().st_mtime - age,) * 2)
    assert {r["path"].rsplit("/", 1)[1] for r in runs.latest_artifacts(spark, str(tmp_path)).collect()} == {f"new_{b}.jsonl" for b in runs.BUCKETS}
    for run in ("r1", "r2"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "b_eval_summary.json").write_text(json.dumps({"score": 2.0}))
        (tmp_path / run / "a_eval_summary.json").write_text(json.dumps({"score": 1.0}))
    assert {(r["run"], r["score"]) for r in runs.run_table(spark, str(tmp_path), "_eval_summary.json", "score double").collect()} == {("r1", 1.0), ("r2", 1.0)}


def test_benchmark_corpus(spark, tmp_path):
    spark.createDataFrame([(0, "q", ["x", ""]), (1, "", [])], "ord int, question string, choices array<string>").write.parquet(str(tmp_path / "mmlu.parquet"))
    items, sources = benchmarks.corpus(spark, str(tmp_path), ("mmlu", "arc"))
    assert sources["mmlu"] == "table" and sources["arc"].startswith("signatures")
    assert {(r["benchmark"], r["text"]) for r in items.where("benchmark = 'mmlu'").collect()} == {("mmlu", "q x")}
    assert {k: len(v) for k, v in benchmarks.SIGNATURES.items()} == {"mmlu": 10, "gsm8k": 10, "humaneval": 10, "arc": 8, "hellaswag": 5}


def test_config_round_trip(tmp_path):
    path = str(tmp_path / "c.yaml")
    Config().to_yaml(path)
    assert Config.from_yaml(path) == Config() == Config.from_yaml(str(tmp_path / "none.yaml"))


def test_engine(spark, lines, tmp_path):
    engine = Engine(spark, judge=effects.constant_judge(9.5), generator=effects.template_writer("A long answer about {topic} for slot {slot} by {persona} at {difficulty} with enough words to pass the rules"))
    audited = engine.audit(engine.read(lines))
    assert audited.count() >= 5 and audited.where("verdict != 'clean'").count() == 0
    report = engine.report(audited).first()
    assert report["passed"] + report["failed"] == report["total"] and report["hits"] == 0
    seeds = audited.select("id", "user", "assistant", "topic")
    grown = engine.expand(seeds, str(tmp_path / "rounds"))
    assert grown.count() == engine.config.generation.num_examples
    assert grown.select("id").distinct().count() == grown.count()


def test_failing_judges_are_marked(spark):
    def broken(batch):
        raise RuntimeError("no")

    rows = spark.createDataFrame([(1, "u", "a")], "id int, user string, assistant string")
    got = effects.judged(rows, broken).first()
    assert got["overall"] is None and got["judge_issues"] == ["llm_scoring_failed"]


def counting(path, judge):
    """A judge that notes the rows it sees in a file of its own process."""

    def count(batch):
        with open(f"{path}/{os.getpid()}", "a") as f:
            f.writelines(f"{i}\n" for i in batch["id"])
        return judge(batch)

    return count


def seen(path):
    return sorted(line for p in path.iterdir() for line in p.read_text().split())


def test_a_judge_sees_each_row_once(spark, lines, tmp_path):
    (tmp_path / "seen").mkdir()
    engine = Engine(spark, judge=counting(str(tmp_path / "seen"), effects.constant_judge(9.5)))
    audited = engine.audit(engine.read(lines))
    audited.collect()
    engine.report(audited).collect()
    assert seen(tmp_path / "seen") == sorted(r["id"] for r in audited.collect())
    (tmp_path / "rounds").mkdir()
    writer = effects.template_writer("A long answer about {topic} for slot {slot} by {persona} at {difficulty} with enough words to pass the rules")
    engine = Engine(spark, judge=counting(str(tmp_path / "rounds"), effects.constant_judge(9.5)), generator=writer)
    grown = engine.expand(audited.select("id", "user", "assistant", "topic"), str(tmp_path / "out"))
    ids = seen(tmp_path / "rounds")
    assert len(ids) == len(set(ids)) >= grown.count() > 0
    assert engine.rounds[-1]["accepted_total"] == grown.count() and set(engine.rounds[-1]) >= {"divergence", "gap_ratio", "focus"}


def test_a_bad_row_costs_no_other(spark):
    def moody(batch):
        if "bad" in list(batch["user"]):
            raise ValueError("cannot read it")
        return pd.DataFrame({"id": batch["id"], "overall": 8.0, "judge_issues": [["short"]] * len(batch), "has_pii": True, "accuracy": 7.0})

    rows = spark.createDataFrame([(i, "bad" if i == 3 else "u", "a") for i in range(8)], "id int, user string, assistant string").coalesce(1)
    got = {r["id"]: (r["overall"], r["judge_issues"], r["quality_details"]) for r in effects.judged(rows, moody).collect()}
    assert got.pop(3) == (None, ["llm_scoring_failed"], {})
    assert set(got) == {0, 1, 2, 4, 5, 6, 7} and all(v == (8.0, ["short", "pii_detected"], {"accuracy": 7.0}) for v in got.values())
    told = effects.applied(rows, lambda b: moody(b)[["id", "overall"]], "id int, overall double", 1, failed=lambda one: one[["id"]].assign(overall=-1.0))
    assert sorted((r["id"], r["overall"]) for r in told.collect()) == [(i, -1.0 if i == 3 else 8.0) for i in range(8)]


def test_rounds_focus_on_the_clusters_that_lag(spark, tmp_path):
    """Half of the generated rows are too short to pass, so a second round has a focus."""
    seeds = spark.createDataFrame([(i, f"a question {i} about it", "an answer", f"t{i % 5}") for i in range(20)], "id int, user string, assistant string, topic string")

    def lazy(batch):
        out = effects.template_writer("A long answer about {topic} for slot {slot} by {persona} at {difficulty} with enough words to pass the rules")(batch)
        out.loc[out["slot"] % 2 == 0, "assistant"] = "no"
        return out

    config = Config(generation=Generation(num_examples=30, focus_strategy="soft", max_rounds=2))
    engine = Engine(spark, config, effects.constant_judge(8.0), lazy)
    grown = engine.expand(seeds, str(tmp_path))
    assert [r["focus"] == [] for r in engine.rounds] == [True, False] and len(engine.rounds[1]["focus"]) == 3
    assert grown.count() == engine.rounds[-1]["accepted_total"] and grown.select("pipeline_stage").distinct().count() == 1


def test_stream_resumes(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.jsonl").write_text(json.dumps({"user": f"question {n} about it", "assistant": "an answer"}) + "\n")
        score_stream(spark, folder, out, check, effects.constant_judge(8.0)).awaitTermination(120)
        assert spark.read.parquet(out).count() == n + 1
    assert spark.read.parquet(out).agg(F.max("quality_score")).first()[0] == 6.5


def chat(user, assistant):
    return json.dumps({"messages": [{"role": "user", "content": user}, {"role": "assistant", "content": assistant}]})


def test_repeated_lines_are_rows_of_their_own(spark, tmp_path):
    """As many audited rows as lines, equal verdicts for equal lines, no confidence beyond 1."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    near = "so then alpha beta gamma delta epsilon zeta eta theta iota and nothing else at all here"
    path = tmp_path / "in" / "rows.jsonl"
    path.parent.mkdir()
    path.write_text("\n".join([chat("a question of some words", near)] * 3 + [chat("another question", f"well {item} indeed")] * 2 + [chat("one more", "a short answer that is clean")]) + "\n")
    bench = spark.createDataFrame([("b", 0, item)], "benchmark string, item_index long, text string")
    engine = Engine(spark)
    rows = engine.read(str(path))
    audited = engine.audit(rows, bench)
    got = audited.select("user", "verdict", "confidence", "content_id", "id").collect()
    assert len(got) == 6 and len({r["id"] for r in got}) == 6 and len({r["content_id"] for r in got}) == 3
    assert {(r["user"], r["verdict"]) for r in got} == {("a question of some words", "clean"), ("another question", "block"), ("one more", "clean")}
    assert all(r["confidence"] <= 1 for r in got)
    report = engine.report(audited).first()
    assert report["total"] == 6
    engine.config = Config()
    with pytest.raises(ValueError, match="id repeats"):
        engine.audit(rows.withColumn("id", rows["content_id"]), bench)


def test_stream_scores_repeated_lines_once_each(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([chat("same", "the same answer")] * 3) + "\n")
    run = lambda: score_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), effects.constant_judge()).awaitTermination(60)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    (tmp_path / "in" / "b.jsonl").write_text("\n".join([chat("same", "the same answer")] * 2) + "\n")
    run()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 5 and rows.select("id").distinct().count() == 5
