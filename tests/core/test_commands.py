"""Commands, waves of generation, kept benchmark texts and recommendations, presets."""

import json

import pandas as pd
from pyspark.sql import functions as F

from siltstone.__main__ import main
from siltstone.config import Config, Model
from siltstone.operators import reference
from siltstone.operators.views import document_examples
from siltstone.plans import effects, reports
from siltstone.sources import benchmarks, runs

SLOTS = "cluster_id string, topic string, slot int"
SCHEMA = "slot int, user string, error string"


def write(batch: pd.DataFrame) -> pd.DataFrame:
    """A generator: an answer of some words for each slot."""
    rows = batch.to_dict("records")
    return pd.DataFrame({
        "cluster_id": batch["cluster_id"], "topic": batch["topic"], "slot": batch["slot"], "error": None,
        "user": [f"What about case {r['slot']} of {r['topic']} in general?" for r in rows],
        "assistant": [f"In case {r['slot']} you open the settings, choose {r['topic']} and confirm that all of it is what you want before you go on." for r in rows],
    })


def lines(path, n, topic):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps({"user": f"How do I fix number {i} of my orders?", "assistant": f"Open order {i}, choose the repair that you need and confirm it with the button below the list.", "metadata": {"topic": topic}}) + "\n" for i in range(n)))
    return str(path)


def test_commands_that_generate_compare_and_bundle(spark, tmp_path):
    seeds, out = lines(tmp_path / "in" / "seeds.jsonl", 4, "orders"), str(tmp_path)
    config = tmp_path / "c.yaml"
    config.write_text("generation: {num_examples: 6, batch_size: 2, max_rounds: 2}\n")
    common = ["--config", str(config), "--out", out, "--generator", "tests.core.test_commands:write"]
    main(["generate", seeds, "--name", "made", *common])
    assert spark.read.text(f"{out}/made_jsonl").count() == 6
    main(["run", seeds, "--name", "whole", *common])
    summary = json.loads((tmp_path / "whole_summary.json").read_text())
    assert summary["summary"]["total"] == 6 and summary["rounds"] >= 1
    showcase = json.loads((tmp_path / "whole_showcase.json").read_text())
    assert showcase["metrics"]["total"] == 6 and set(showcase["minutes"]) == {"generate", "audit and export"}
    other = lines(tmp_path / "in" / "other.jsonl", 5, "orders")
    main(["match", seeds, "--reference", other, "--name", "m", *common])
    assert json.loads((tmp_path / "m_match.json").read_text())["exact_overlap"] == 1.0
    main(["proof", seeds, "--holdout", other, "--base-model", "small", "--name", "p", *common])
    job = json.loads((tmp_path / "p_proof" / "training_job.json").read_text())
    assert job["examples"] == 4 and job["status"] == "planned" and (tmp_path / "p_proof" / "other.jsonl").exists()
    main(["publish", seeds, "--repo-id", "me/set", "--name", "pub", *common])
    plan = json.loads((tmp_path / "pub_publish.json").read_text())
    assert plan["repo_id"] == "me/set" and plan["files"]


def test_waves_ask_for_what_is_missing_and_give_up(spark, tmp_path):
    slots = lambda at, n: spark.range(at + 1, at + n + 1).select(F.col("id").cast("int").alias("slot"))

    def halves(batch):
        return pd.DataFrame({"slot": batch["slot"], "user": "u", "error": ["bad" if s % 2 else None for s in batch["slot"]]})

    got = effects.in_waves(slots, halves, SCHEMA, 8, str(tmp_path / "a"), "error IS NULL")
    asked = sorted(r["slot"] for r in got.collect())
    assert got.where("error IS NULL").count() >= 8 and asked == list(range(1, len(asked) + 1)) and len(asked) < 24

    def never(batch):
        return pd.DataFrame({"slot": batch["slot"], "user": "", "error": "bad"})

    got = effects.in_waves(slots, never, SCHEMA, 5, str(tmp_path / "b"), "error IS NULL", most_empty=2)
    assert sorted(r["slot"] for r in got.collect()) == list(range(1, 11))  # two waves, then it gives up
    assert effects.in_waves(slots, never, SCHEMA, 0, str(tmp_path / "c"), "error IS NULL").count() == 0


def test_benchmark_texts_are_kept(spark, tmp_path):
    folder, cache = tmp_path / "f", str(tmp_path / "cache")
    folder.mkdir()
    (folder / "gsm8k.jsonl").write_text("\n".join(json.dumps({"question": f"question {i}?"}) for i in range(5)) + "\n")
    (folder / "hellaswag.json").write_text(json.dumps({"ctx": "a context", "endings": ["one", "two"]}) + "\n")
    names = ("gsm8k", "hellaswag", "arc")
    read = lambda limit=200: benchmarks.corpus(spark, str(folder), names, limit, cache)
    rows, sources = read()
    assert sources["gsm8k"] == sources["hellaswag"] == "table" and sources["arc"].startswith("signatures (")
    first = sorted(tuple(r) for r in rows.collect())
    assert ("hellaswag", 0, "a context one two") in first
    (folder / "gsm8k.jsonl").unlink()
    rows, sources = read()
    assert sources["gsm8k"] == "cache" and sorted(tuple(r) for r in rows.collect()) == first
    assert read(3)[1]["gsm8k"].startswith("signatures (")  # kept for another limit


def test_recommendations_by_domain(spark, tmp_path):
    path = str(tmp_path / "r")
    assert runs.recommended_model(spark, path, "E-commerce support") is None
    best = lambda model: {"model": model, "benchmark_score": 0.9, "pass_rate": 1.0}
    assert runs.recommend(spark, path, "E-commerce support", best("a"), 1)
    assert runs.recommend(spark, path, "Medical notes", best("b"), 2)
    assert not runs.recommend(spark, path, " ", best("c"), 3) and not runs.recommend(spark, path, "x", {"model": ""}, 3)
    assert runs.recommended_model(spark, path, "e commerce SUPPORT") == "a"
    assert runs.recommended_model(spark, path, "notes of a doctor") == "b"
    assert runs.recommended_model(spark, path, "cooking") is None
    assert runs.recommend(spark, path, "Medical notes", best("d"), 4)
    assert runs.recommended_model(spark, path, "Medical notes") == "d" and runs.recommendations(spark, path).count() == 2


def test_presets(tmp_path):
    assert Model.of("openai").api_base == "https://api.openai.com/v1" and Model.of("nobody").provider == "ollama"
    path = tmp_path / "c.yaml"
    path.write_text("model: {provider: vllm, temperature: 0.1, other: 1}\n")
    c = Config.from_yaml(str(path))
    assert c.model == Model.of("vllm", temperature=0.1) and Config.from_yaml(str(tmp_path / "none")) == Config()
    c.to_yaml(str(path))
    assert Config.from_yaml(str(path)) == c


def test_near_overlap_of_near_copies_is_the_best_one(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:i], f"x{i % 7}", *words[i + 1 :]]) for i in range(60)] + [" ".join(words), "short one", "", None]
    rows = document_examples(spark.createDataFrame([(i, t, None, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    gen, ref = rows.where("topic <> 's1'"), rows.where("topic = 's1'")
    got = {r["id"]: round(r["likeness"], 9) for r in reference.near_overlap(gen, ref).collect()}

    def grams(t):
        w = (t or "").split()
        return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} or ({" ".join(w)} if w else set())

    want = {}
    for i, t in enumerate(texts):
        best = max((len(grams(t) & grams(o)) / len(grams(t) | grams(o)) for j, o in enumerate(texts) if j % 3 == 1 and grams(t) | grams(o)), default=0)
        if i % 3 != 1 and best >= 0.75:
            want[i] = round(best, 9)
    assert got == want


def test_benchmark_report(spark):
    ranked = spark.createDataFrame([("m2", 0.5, 2), ("m1", 0.91239, 1)], "model string, composite double, place int")
    found = reports.benchmark_report(ranked)
    assert found["recommended"] == "m1" and found["models"]["m1"]["composite"] == 0.9124
