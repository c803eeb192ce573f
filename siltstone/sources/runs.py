"""Artifacts of runs: the latest group of a folder, and run summaries."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import domain_key
from siltstone.operators import ranking
from siltstone.sources.versions import Versions

BUCKETS = ("candidates", "accepted", "rejected")


def latest_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """bucket, path of the group (base name) of the folder that was changed last."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder).select("path", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    pattern = rf"^(.*)_({'|'.join(BUCKETS)})\.jsonl$"
    groups = files.where(F.regexp_like(name, F.lit(pattern))).select("path", "modificationTime", F.regexp_extract(name, pattern, 1).alias("base"), F.regexp_extract(name, pattern, 2).alias("bucket"))
    last = groups.agg(F.max_by("base", F.struct("modificationTime", "base")).alias("base"))
    return groups.join(F.broadcast(last), "base").select("bucket", "path")


def run_table(spark: SparkSession, folder: str, suffix: str, schema: str) -> DataFrame:
    """run, and the fields of each run folder's first file (by name) with the suffix."""
    files = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").json(folder)
    parts = F.split(F.col("_metadata.file_path"), "/")
    named = files.select("*", F.element_at(parts, -2).alias("run"), F.element_at(parts, -1).alias("file"))
    first = named.groupBy("run").agg(F.min("file").alias("file"))
    return named.join(first, ["run", "file"]).drop("file")


def run_metrics(summaries: DataFrame, uplifts: DataFrame) -> DataFrame:
    """Runs that have both a summary and an uplift."""
    return summaries.join(uplifts, "run")


def companion(folder: str, suffix: str) -> dict | None:
    """The first JSON file (by name) with the suffix in a driver-side folder that can be read."""
    for path in sorted(Path(folder).glob(f"*{suffix}")):
        try:
            return json.loads(path.read_text())
        except (OSError, ValueError):
            continue
    return None


def history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A run history; empty where there is none yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


RECOMMENDATION = "domain string, title string, model string, benchmark_score double, avg_quality_score double, pass_rate double, examples_per_second double, updated_at long, ord long"


def recommendations(spark: SparkSession, path: str) -> DataFrame:
    """The models recommended by domain key; empty where there are none, or none that can be read."""
    table = Versions(spark, path)
    try:
        return table.read() if table.exists() else spark.createDataFrame([], RECOMMENDATION)
    except AnalysisException:
        return spark.createDataFrame([], RECOMMENDATION)


def recommend(spark: SparkSession, path: str, title: str, result: dict, updated_at: int) -> bool:
    """Keeps a result (model and its scores) as the recommendation of a domain, in the place
    of an earlier one. Without a domain or a model nothing is kept."""
    if not title.strip() or not str(result.get("model") or "").strip():
        return False
    known = recommendations(spark, path)
    names = [c.split()[0] for c in RECOMMENDATION.split(", ")]
    last = known.agg(F.coalesce(F.max("ord"), F.lit(-1)) + 1).first()[0]
    row = {**{k: result.get(k) for k in names}, "title": title.strip(), "model": str(result["model"]).strip(), "updated_at": updated_at, "ord": last}
    new = spark.createDataFrame([tuple(row[n] for n in names)], RECOMMENDATION).withColumn("domain", domain_key(F.lit(title)))
    # a domain keeps its place in the order
    new = new.join(known.select("domain", F.col("ord").alias("place")), "domain", "left").withColumn("ord", F.coalesce("place", "ord")).select(names)
    Versions(spark, path).replace(known.select(names).join(new.select("domain"), "domain", "left_anti").unionByName(new))
    return True


def recommended_model(spark: SparkSession, path: str, title: str) -> str | None:
    """The model kept for a domain, or for the one that shares most words with it."""
    if not title.strip():
        return None
    key = spark.range(1).select(domain_key(F.lit(title))).first()[0]
    row = ranking.recommended(recommendations(spark, path).where(F.trim("model") != ""), key).first()
    return row["model"] if row else None


def append_history(rows: DataFrame, path: str) -> None:
    """Adds rows to a history; ``ranking.latest`` reads the last ones. ``versions.remember``
    keeps the last ones only."""
    rows.write.mode("append").json(path)
