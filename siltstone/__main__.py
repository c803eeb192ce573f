"""python -m siltstone COMMAND PATH: thin commands over the engine.

audit, export, compare, inspect, uplift and validate read what is there. generate and run
need a generator, ``--generator package.module:function``, which is called on pandas
batches; ``--judge`` names a judge likewise. match compares with a reference; proof and
publish write bundles and plans, and send nothing.
"""

from __future__ import annotations

import argparse
import importlib
import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.operators import artifacts, evaluation
from siltstone.plans import reports
from siltstone.plans.engine import Engine
from siltstone.sources import jsonl, runs, writers

METRICS = "match double, uplift_f1 double, uplift_success double, uplift_passed double"


def scored_against(engine: Engine, predictions: str, holdout: str) -> DataFrame:
    """Predictions (the answers of a JSONL file) against the holdout's answers, by place."""
    own, theirs = engine.read(predictions), engine.read(holdout)
    pairs = evaluation.positional(own.select("ord", "assistant"), theirs.select("ord", "assistant", "topic"))
    return evaluation.prediction_scores(pairs, "p_assistant", "h_assistant", "h_topic")


def named(path: str | None):
    """The function that ``package.module:function`` names."""
    if path is None:
        return None
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def generate(engine: Engine, seeds: str, out: str, name: str) -> DataFrame:
    """Candidates from a file of seeds, exported; their topics are the seeds' own."""
    made = engine.expand(engine.read(seeds).select("id", "user", "assistant", "topic"), f"{out}/{name}_rounds")
    messages = F.array(*[F.struct(F.lit(role).alias("role"), F.col(role).alias("content")) for role in ("user", "assistant")])
    return made.withColumn("messages", messages).withColumn("ord", F.col("id"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="siltstone")
    p.add_argument("command", choices=("audit", "export", "compare", "inspect", "uplift", "validate", "generate", "run", "match", "proof", "publish"))
    p.add_argument("path", help="examples; of generate and run the seeds, of uplift the holdout, of validate a folder of runs")
    p.add_argument("--generator", help="package.module:function, on pandas batches of slots")
    p.add_argument("--judge", help="package.module:function, on pandas batches of examples")
    p.add_argument("--holdout", help="examples that a proof is measured on")
    p.add_argument("--base-model", default="base")
    p.add_argument("--trainer", default="trainer")
    p.add_argument("--repo-id", default="")
    p.add_argument("--config", default="siltstone.yaml")
    p.add_argument("--reference", help="examples to compare with")
    p.add_argument("--base", help="the base model's answers to the holdout")
    p.add_argument("--tuned", help="the tuned model's")
    p.add_argument("--sort", default="score", choices=("score", "topic", "reason"))
    p.add_argument("--format", default="jsonl")
    p.add_argument("--out", default="./output")
    p.add_argument("--name")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    engine = Engine(spark, Config.from_yaml(args.config), named(args.judge), named(args.generator))
    name = args.name or jsonl.dataset_name(args.path)
    if args.command == "export":
        print(writers.export(engine.read(args.path), args.format, args.out, name))
    elif args.command == "inspect":
        rows = jsonl.with_ids(jsonl.read_examples(spark, args.path, keep_scores=True))
        rows = rows.withColumn("topic", jsonl.metadata_field("topic")).withColumn("rejection_reasons", F.array().cast("array<string>"))
        placed = artifacts.inspect_place(rows, args.sort)
        sheet = artifacts.csv_rows(artifacts.preview(placed)).join(placed.select("id", "place"), "id").orderBy("place").drop("place")
        writers.csv(sheet, f"{args.out}/{name}_sheet")
    elif args.command == "uplift":
        found = reports.uplift_report(scored_against(engine, args.base, args.path), scored_against(engine, args.tuned, args.path), args.base, args.tuned, args.path)
        reports.write_summary(found, f"{args.out}/{name}_uplift", name)
    elif args.command == "generate":
        print(writers.export(generate(engine, args.path, args.out, name), args.format, args.out, name))
    elif args.command == "run":
        start = time.monotonic()
        made = generate(engine, args.path, args.out, name)
        between = time.monotonic()
        audited = engine.audit(made.select("id", "ord", "messages", "user", "assistant", "topic"))
        kept = engine.clean(audited)
        path = writers.export(kept, args.format, args.out, name)
        found = reports.eval_summary(kept, engine.report(kept), rounds=engine.rounds)
        seconds = {"generate": between - start, "audit and export": time.monotonic() - between}
        reports.write_summary(found, f"{args.out}/{name}_summary", name)
        reports.write_summary(reports.showcase_report(found, seconds), f"{args.out}/{name}_showcase", name)
        print(path)
    elif args.command == "match":
        audited, other = engine.audit(engine.read(args.path)), engine.audit(engine.read(args.reference))
        reports.write_summary(reports.match_report(audited, other), f"{args.out}/{name}_match", name)
    elif args.command == "proof":
        rows = engine.audit(engine.read(args.path))
        other = engine.audit(engine.read(args.reference)) if args.reference else None
        found = reports.eval_summary(rows, engine.report(rows), other)
        folder = reports.proof_bundle(found, args.out, name, args.base_model, args.holdout, args.trainer)
        reports.write_summary(reports.training_job(args.path, args.base_model, args.trainer, rows), str(folder / "training_job"), name)
        print(folder)
    elif args.command == "publish":
        audited = engine.audit(engine.read(args.path))
        kept = engine.clean(audited)
        bundle = reports.hub_bundle(kept, reports.eval_summary(kept, engine.report(kept)), args.out, name)
        plan = reports.publish_manifest(str(bundle), args.repo_id or name)
        Path(args.out, f"{name}_publish.json").write_text(json.dumps(plan, indent=2))
        print(json.dumps(plan))
    elif args.command == "validate":
        found = reports.validation_report(runs.run_table(spark, args.path, "_run.json", METRICS))
        print(json.dumps(found))
    else:
        audited = engine.audit(engine.read(args.path))
        other = engine.audit(engine.read(args.reference)) if args.reference else None
        reports.write_summary(reports.eval_summary(audited, engine.report(audited), other), f"{args.out}/{name}_summary", name)


if __name__ == "__main__":
    main()
