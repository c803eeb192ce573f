"""Reports and bundles on the driver, from one-row and top-k results."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import evaluation, quality, reference
from siltstone.sources import writers


def eval_summary(audited: DataFrame, report: DataFrame, other: DataFrame | None = None, baseline: DataFrame | None = None, status: dict | None = None, rounds: list[dict] = ()) -> dict:
    """The report row, the five most frequent issues (of equals the first by name), the
    comparison with a reference set, and the changes against a baseline report.

    ``status`` is a row of :func:`distribution.status`; with a reference set too, the
    summary says how far the two scores agree. ``rounds`` are those of an expansion.
    """
    out = {"summary": report.first().asDict(), "rounds": len(rounds)}
    top = quality.issue_counts(audited).orderBy(F.desc("n"), "issue").limit(5)
    out["top_issues"] = {r["issue"]: r["n"] for r in top.collect()}
    if status:
        out["distribution"] = dict(status)
    if other is not None:
        out["reference_comparison"] = reference.alignment(audited, other).first().asDict()
    if other is not None and status:
        match, aligned, graph = status["match_score"], out["reference_comparison"]["alignment_score"], status["graph_coverage"]
        out["distribution_validation"] = {
            "status": "reference_calibrated", "match_score": match, "alignment_score": aligned, "graph_coverage": round(100 * graph, 2),
            "calibration_error": round(abs(match - aligned), 4), "validated_score": round(0.45 * match + 0.45 * aligned + 10 * graph, 2),
        }
    if baseline is not None:
        out["baseline_comparison"] = reference.baseline_deltas(report, baseline, ["avg_score", "pass_rate"]).first().asDict()
    return out


METRICS = ("avg_success", "avg_passed", "avg_f1", "avg_empathy")


def uplift_report(base: DataFrame, tuned: DataFrame, base_model: str, tuned_model: str, holdout: str) -> dict:
    """Two models' scored predictions on one holdout (see :func:`evaluation.prediction_scores`)
    as metrics of each, over all topics, and the differences."""
    one = lambda rows: evaluation.holdout_metrics(rows).where("topic = 'all topics'").first()
    b, t = one(base), one(tuned)
    sides = {name: {m: round(row[m] or 0.0, 4) for m in METRICS} for name, row in (("base", b), ("tuned", t))}
    return {"base_model": base_model, "tuned_model": tuned_model, "holdout": holdout, **sides, "uplift": {m: round((t[m] or 0.0) - (b[m] or 0.0), 4) for m in METRICS}}


def validation_report(runs: DataFrame) -> dict:
    """Whether the match score tells uplift, over runs (match, uplift_f1, uplift_success, uplift_passed)."""
    return {k: v if v is None or isinstance(v, int) else round(v, 4) for k, v in evaluation.metric_validation(runs).first().asDict().items()}


DIMENSIONS = ("task success", "policy", "completeness", "escalation", "tone", "no hallucination")


def proof_bundle(found: dict, folder: str, name: str, base_model: str, holdout: str | None = None, trainer: str = "trainer") -> Path:
    """A folder to check an uplift with: the summary, a rubric, the holdout's lines, and two
    scripts that say what to run and do nothing else."""
    out = Path(folder) / f"{name.replace(' ', '_').replace('/', '_')}_proof"
    out.mkdir(parents=True, exist_ok=True)
    write_summary(found, str(out / "proof_summary"), name)
    (out / "rubric.json").write_text(json.dumps({"dimensions": list(DIMENSIONS), "scale": "1-5"}, indent=2))
    lines = Path(holdout) if holdout else None
    if lines and lines.is_file():
        (out / lines.name).write_text(lines.read_text())
    say = lambda text: f"#!/usr/bin/env bash\nset -eu\necho {json.dumps(text)}\n"
    scripts = {"finetune.sh": f"{trainer}: train {base_model} on {name}", "evaluate.sh": f"score {base_model} and the tuned model on {lines.name if lines else 'a holdout'} by rubric.json"}
    for file, text in scripts.items():
        (out / file).write_text(say(text))
        (out / file).chmod(0o755)
    return out


def benchmark_report(ranked: DataFrame) -> dict:
    """The models of a comparison in order, and the one that is recommended (see
    :func:`ranking.ranked_models`): a row for each model."""
    rows = [{k: round(v, 4) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in ranked.orderBy("place").collect()]
    return {"recommended": rows[0]["model"] if rows else None, "models": {r["model"]: r for r in rows}}


def showcase_report(found: dict, seconds: dict[str, float] | None = None) -> dict:
    """The headline numbers of a run's summary, and how long its stages took."""
    head = {k: found["summary"][k] for k in ("total", "passed", "average", "hits", "diversity", "lexical_diversity") if k in found["summary"]}
    return {"metrics": head, "minutes": {k: round(v / 60, 2) for k, v in (seconds or {}).items()}, "top_issues": found.get("top_issues", {})}


def training_job(path: str, base_model: str, trainer: str, rows: DataFrame, epochs: int = 3) -> dict:
    """What a fine-tuning run would be given: a plan only, nothing is started."""
    return {"base_model": base_model, "trainer": trainer, "train_file": path, "examples": rows.count(), "epochs": epochs, "status": "planned"}


def match_report(generated: DataFrame, reference_rows: DataFrame) -> dict:
    """How a set's topics, styles and levels match a reference's, and the overlap with it."""
    aligned = reference.alignment(generated, reference_rows).first().asDict()
    return {k: round(v, 4) if isinstance(v, float) else v for k, v in aligned.items()}


def markdown(found: dict, title: str, level: int = 1) -> str:
    lines = [f"{'#' * level} {title}", ""]
    for k, v in found.items():
        lines += [markdown(v, k.replace("_", " "), level + 1)] if isinstance(v, dict) else [f"- {k}: {v}"]
    return "\n".join(lines) + "\n"


def write_summary(found: dict, path: str, title: str) -> None:
    Path(path).with_suffix(".json").write_text(json.dumps(found, indent=2, default=str, ensure_ascii=False))
    Path(path).with_suffix(".md").write_text(markdown(found, title))


def hub_bundle(rows: DataFrame, found: dict, folder: str, name: str, tags: tuple[str, ...] = ("synthetic",)) -> Path:
    """A folder to publish: training lines, summary, metadata, and a card with a header."""
    out = Path(folder) / name
    out.mkdir(parents=True, exist_ok=True)
    writers.export(rows, "jsonl", str(out), "train")
    n = rows.count()
    write_summary(found, str(out / "eval_summary"), name)
    (out / "dataset_metadata.json").write_text(json.dumps({"name": name, "rows": n, "tags": list(tags)}, indent=2))
    header = "\n".join(["---", f"pretty_name: {name}", "size_categories:", f"- {writers.size_category(n)}", "tags:", *[f"- {t}" for t in tags], "---"])
    (out / "README.md").write_text(f"{header}\n\n{markdown(found, name)}")
    return out


def publish_manifest(bundle: str, repo_id: str, private: bool = True) -> dict:
    """What an upload would send: a plan only, nothing is sent."""
    files = sorted(str(p.relative_to(bundle)) for p in Path(bundle).rglob("*") if p.is_file() and not p.name.startswith((".", "_")))
    return {"repo_id": repo_id, "private": private, "files": files}
