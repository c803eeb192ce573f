"""The engine: audit, filter, expand, compare and export, as plans over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.operators import decontamination as decon
from siltstone.operators import distribution, diversity, planning, quality, selection
from siltstone.plans.effects import Batch, constant_judge, in_waves, judged
from siltstone.plans.sizes import stored, with_unique
from siltstone.sources import benchmarks, jsonl, writers

MADE = "cluster_id string, topic string, slot int, user string, assistant string, error string"


def made_by(generator: Batch) -> Batch:
    """The generator with its reply's columns in order, those it lacks being empty."""
    columns = [c.split()[0] for c in MADE.split(", ")]
    return lambda batch: generator(batch).reindex(columns=columns)


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None, judge: Batch | None = None, generator: Batch | None = None):
        self.spark, self.config = spark, config or Config()
        self.judge, self.generator = judge or constant_judge(), generator

    def read(self, path: str, keep_scores: bool = False) -> DataFrame:
        """The examples of a file or folder. Lines that repeat have ids of their own, and
        share a content_id."""
        rows = jsonl.with_ids(jsonl.read_examples(self.spark, path, keep_scores))
        return rows.withColumn("topic", F.coalesce(jsonl.metadata_field("topic"), F.lit("unknown")))

    def audit(self, examples: DataFrame, bench: DataFrame | None = None, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """Scores, issues, verdict and flags for every example.

        What the judge says is stored before it is used, since it may be an external
        service: it sees each row once. ``vectors`` as in :func:`decon.evidence`. Ids
        that repeat are an error, since scores and verdicts are joined by them.
        """
        examples = stored(with_unique(examples, "id"))
        if bench is None:
            bench, _ = benchmarks.corpus(self.spark, None, self.config.decontamination.benchmarks)
        return self.verdicts(judged(examples, self.judge), bench, F.concat_ws(" ", "user", "assistant"), vectors).persist()

    def verdicts(self, judged_: DataFrame, bench: DataFrame, text: Column, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """Examples with what a judge said (overall, judge_issues), scored, with the verdict
        on ``text``."""
        c = self.config.decontamination
        rows = stored(quality.scored(judged_))
        texts = rows.select("id", text.alias("text"))
        found = decon.evidence(texts, bench, c.method, c.gram, c.threshold, vectors, c.top_k)
        return rows.join(decon.verdicts(rows, found, c.hard_fail, c.review, c.review_threshold), "id")

    def report(self, audited: DataFrame) -> DataFrame:
        """One row of headline metrics."""
        one = quality.pass_rate(quality.summary(audited, self.config.quality.min_score))
        hits = audited.agg(F.count_if(F.size("flags") > 0).alias("hits"))
        lexical = diversity.lexical_diversity(audited).select("lexical_diversity")
        spread = diversity.mean_gram_distance(diversity.sample(audited))
        return quality.usable_gate(one.join(hits).join(quality.duplicate_stats(audited)).join(lexical).join(spread))

    def clean(self, audited: DataFrame, min_quality: float | None = None) -> DataFrame:
        """Without contamination, and with scores of ``min_quality`` (None: the setting) at least."""
        least = self.config.quality.min_score if min_quality is None else min_quality
        return quality.at_least(decon.without_contaminated(audited), least)

    def plan(self, seeds: DataFrame, accepted: DataFrame | None = None, focus: list[str] = ()) -> DataFrame:
        """Slots to generate, from seeds (id, user, assistant, topic) and accepted rows."""
        g = self.config.generation
        clusters, edges, have = self._planned(seeds, accepted)
        return planning.plan_slots(planning.allocated(planning.prioritized(clusters, edges, have, focus, g.max_active_clusters, g.saturation_threshold, g.long_tail_boost, g.distance_weight, g.semantic_focus_top_k)))

    def _planned(self, seeds: DataFrame, accepted: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Clusters with targets, their edges, and (key, n) of what is accepted."""
        g = self.config.generation
        rows = stored(planning.with_tokens(planning.with_cluster(seeds)).drop("user", "assistant"))  # each text is read once
        clusters = stored(planning.with_targets(planning.seed_profile(rows), g.num_examples))
        edges = stored(planning.neighbor_edges(stored(planning.cluster_vectors(clusters, rows)), g.neighbor_k))
        have = distribution.counts_by(accepted, F.col("cluster_id")) if accepted is not None else self.spark.createDataFrame([], "key string, n long")
        return clusters, edges, have

    def _focus(self, clusters: DataFrame, edges: DataFrame, have: DataFrame) -> list[str]:
        """The first clusters by priority: focus_top_k of them, one more if the strategy is soft."""
        g = self.config.generation
        first = planning.prioritized(clusters, edges, have, (), g.max_active_clusters, g.saturation_threshold, g.long_tail_boost, g.distance_weight, g.semantic_focus_top_k)
        n = g.focus_top_k + (1 if g.focus_strategy == "soft" else 0)
        return [r["cluster_id"] for r in first.orderBy("place").limit(n).select("cluster_id").collect()]

    def expand(self, seeds: DataFrame, folder: str) -> DataFrame:
        """Rounds of planning, generation, dedup, scoring and selection, up to the target.

        Within a round slots are asked for in waves, until as many replies are good as
        were wanted or ``max_empty_waves`` waves brought none.
        After a round the status of the distribution is added to ``self.rounds``, and the
        next round is for the clusters that lag most (``focus_strategy``: strict takes
        focus_top_k of them, soft one more). It ends when the target is reached, nothing
        was kept, or no gap is left and the divergence is within ``max_divergence``.
        Candidates and their scores are written under ``folder`` and read again, so that
        a model sees each row once and lineage stays short. Slots whose generation fails
        stay there as rows with an error.
        """
        if self.generator is None:
            raise ValueError("expanding needs a generator")
        g, accepted, focus = self.config.generation, None, []
        failed = lambda one: one[["cluster_id", "topic", "slot"]].assign(user="", assistant="", error="generation failed")
        self.rounds: list[dict] = []
        for round_ in range(g.max_rounds):
            done = accepted.count() if accepted is not None else 0
            asked = max(g.num_examples - done, g.batch_size)
            plan = stored(self.plan(seeds, accepted, focus))
            path = f"{folder}/round-{round_}"
            slots = lambda at, n, plan=plan: planning.cycled(plan, at + n).where(F.col("slot") > at)
            good = "error IS NULL AND coalesce(user, '') <> '' AND coalesce(assistant, '') <> ''"
            made = in_waves(slots, made_by(self.generator), MADE, asked, f"{path}-waves", good, g.max_empty_waves, retries=g.max_retries, failed=failed, batch_size=g.batch_size)
            made.withColumn("id", F.concat_ws("-", F.lit(f"r{round_}"), "cluster_id", "slot")).write.mode("overwrite").parquet(path)
            candidates = selection.new_pairs(self.spark.read.parquet(path).where(good), seeds, *([accepted] if accepted is not None else []))
            audited = quality.scored(judged(candidates, self.judge)).withColumn("pipeline_stage", F.lit("audited"))
            audited.write.mode("overwrite").parquet(f"{path}-scored")
            audited = self.spark.read.parquet(f"{path}-scored")
            best = selection.keep_best(audited, g.num_examples - done, self.config.quality.min_score)
            selection.split(audited, best, self.config.quality.min_score).write.mode("overwrite").parquet(f"{path}-split")
            kept = self.spark.read.parquet(f"{path}-split").where("bucket = 'accepted'")
            n = kept.count()
            if n:
                accepted = kept if accepted is None else accepted.unionByName(kept)
            clusters, edges, have = self._planned(seeds, accepted)
            status = distribution.status(clusters, edges, have, g.saturation_threshold).first().asDict()
            self.rounds.append({"round": round_ + 1, "requested": asked, "accepted_total": done + n, "accepted": n, "focus": focus, **status})
            if not n or done + n >= g.num_examples or (not status["gap_ratio"] and status["divergence"] <= g.max_divergence):
                break
            focus = self._focus(clusters, edges, have)
        if accepted is None:
            return quality.scored(judged(seeds, self.judge)).where("false")
        return accepted.withColumn("pipeline_stage", F.lit("finalized"))

    def export(self, rows: DataFrame, name: str) -> str:
        e = self.config.export
        return writers.export(rows, e.format, e.output_dir, name, e.include_metadata)

    def run(self, seed_path: str, name: str) -> dict:
        """Reads, audits, filters, reports and exports a file of examples."""
        audited = self.audit(self.read(seed_path))
        kept = self.clean(audited)
        path = self.export(kept, name)
        found = self.report(kept).first().asDict()
        audited.unpersist()
        return {"path": path, **found}
