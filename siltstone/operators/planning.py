"""Planning of generation: clusters of seeds, their graph, priorities and slots.

Cluster tables have one row per combination of topic, complexity and style: a small
dimension, whatever the number of examples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.classify import complexity, persona, planner_style
from siltstone.functions.text import identifier_slug
from siltstone.functions.vectors import clamped_cosine, first_tokens, token_lengths
from siltstone.operators.ranges import numbered
from siltstone.operators.distribution import semantic_status

DIFFICULTIES = ("easy", "medium", "hard")
PERSONAS = ("beginner", "expert", "skeptic")
CLUSTER_SIMILARITY = 0.82
NEIGHBORS = 3
MAX_ACTIVE = 12


def with_cluster(seeds: DataFrame, semantic: str | None = None) -> DataFrame:
    """Adds complexity, style, semantic_cluster and cluster_id; given ids are kept."""
    number = F.lit(0) if semantic is None else F.col(semantic)
    out = (
        seeds.withColumn("complexity", complexity(F.col("user"), F.col("assistant")))
        .withColumn("style", planner_style(F.col("assistant")))
        .withColumn("semantic_cluster", number)
    )
    label = F.concat_ws("__", identifier_slug(F.col("topic")), F.concat(F.lit("c"), F.col("semantic_cluster").cast("string")), "complexity", "style")
    return out.withColumn("cluster_id", F.coalesce(F.col("seed_cluster_id"), label) if "seed_cluster_id" in seeds.columns else label)


def with_tokens(seeds: DataFrame) -> DataFrame:
    """Adds tokens: what :func:`cluster_vectors` needs of user and assistant."""
    return seeds.withColumn("tokens", first_tokens(F.concat_ws(" ", "user", "assistant")))


def seed_profile(clustered: DataFrame) -> DataFrame:
    """One row per cluster with its seed_count."""
    return clustered.groupBy("cluster_id").agg(
        F.min("semantic_cluster").alias("semantic_cluster"), F.min("topic").alias("topic"), F.min("complexity").alias("complexity"), F.min("style").alias("style"), F.count(F.lit(1)).alias("seed_count")
    ).withColumn("difficulty", F.col("complexity"))


def with_targets(profile: DataFrame, budget: int) -> DataFrame:
    """Adds target_examples: each cluster, largest first, gets its rounded share (half to
    even), one at least, as far as the budget goes; the last gets what remains.

    What a cluster gets is its wish cut to what is left: the running sum of wishes,
    cut to the budget, less the same before it.
    """
    order = Window.orderBy(F.desc("seed_count"), "cluster_id")
    whole = Window.partitionBy()
    wish = F.greatest(F.lit(1), F.bround(budget * F.col("seed_count") / F.sum("seed_count").over(whole))).cast("long")
    ranked = profile.withColumn("place", F.row_number().over(order)).withColumn("wish", wish).withColumn("clusters", F.count(F.lit(1)).over(whole))
    ranked = ranked.withColumn("upto", F.least(F.lit(budget), F.sum("wish").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    before = F.least(F.lit(budget), F.coalesce(F.sum("wish").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got = F.when(F.col("place") == F.col("clusters"), budget - before).otherwise(F.col("upto") - before)
    return ranked.withColumn("target_examples", got.cast("long")).drop("wish", "clusters", "upto", "place")


def leader_clusters(vectors: DataFrame, threshold: float = CLUSTER_SIMILARITY) -> DataFrame:
    """id, semantic_cluster by one ordered pass over (id, embedding): a vector joins the
    best centroid that is near enough, which moves to the mean, or leads a new cluster.

    The pass is sequential by definition, and meant for seeds: a few thousand rows.
    """
    def one_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        centroids, counts, out = [], [], []
        for v in (np.asarray(x, float) for x in rows.sort_values("id")["embedding"]):
            likeness = [float(v @ c) for c in centroids]
            best = int(np.argmax(likeness)) if likeness else -1
            if best >= 0 and likeness[best] >= threshold:
                mean = (centroids[best] * counts[best] + v) / (counts[best] + 1)
                centroids[best] = mean / max(np.linalg.norm(mean), 1e-12)
                counts[best] += 1
            else:
                best = len(centroids)
                centroids.append(v)
                counts.append(1)
            out.append(best)
        yield pd.DataFrame({"id": rows.sort_values("id")["id"].to_numpy(), "semantic_cluster": out})

    return vectors.select("id", "embedding").coalesce(1).mapInPandas(one_pass, f"id {dict(vectors.dtypes)['id']}, semantic_cluster int")


def cluster_vectors(clusters: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Lexical stand-in vectors of clusters, from topic, style and difficulty, and the
    texts of their ``seeds`` (cluster_id, and tokens or user and assistant) if given.

    Of each text the first sorted distinct tokens are enough, since no others can be
    among the cluster's first.
    """
    named = clusters.withColumn("words", first_tokens(F.concat_ws(" ", "topic", "style", "difficulty")))
    if seeds is not None:
        seeds = seeds if "tokens" in seeds.columns else with_tokens(seeds)
        texts = seeds.select("cluster_id", F.explode("tokens").alias("token")).distinct()
        own = texts.groupBy("cluster_id").agg(F.collect_set("token").alias("seed words"))
        named = named.join(own, "cluster_id", "left").withColumn("words", F.concat("words", F.coalesce("seed words", F.array().cast("array<string>")))).drop("seed words")
    return named.withColumn("vector", token_lengths(F.col("words"))).drop("words")


def neighbor_edges(vectors: DataFrame, k: int = NEIGHBORS) -> DataFrame:
    """src, dst, similarity, distance, rank: each cluster's k nearest others, similarity
    and distance rounded to 4 first, of equals the first by id."""
    a = vectors.select(F.col("cluster_id").alias("src"), F.col("vector").alias("x"))
    b = vectors.select(F.col("cluster_id").alias("dst"), F.col("vector").alias("y"))
    pairs = a.join(b, F.col("src") != F.col("dst")).select("src", "dst", F.round(clamped_cosine(F.col("x"), F.col("y")), 4).alias("similarity"))
    pairs = pairs.withColumn("distance", F.round(1 - F.col("similarity"), 4))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def upper_median(column: str):
    """The middle value, the upper one of two: an aggregate of how often each value occurs,
    so that tasks combine theirs."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


def prioritized(clusters: DataFrame, edges: DataFrame, accepted: DataFrame, focus: list[str] = (), max_active: int = MAX_ACTIVE, saturation: float = 1.05, long_tail: float = 0.35, weight: float = 0.6, top_k: int = 3) -> DataFrame:
    """Clusters with gap, priority and bonus, best first; the active ones only, unless
    there is a focus, in which case all of that."""
    state = clusters.join(accepted.select(F.col("key").alias("cluster_id"), F.col("n").alias("accepted")), "cluster_id", "left").na.fill(0, ["accepted"])
    state = state.withColumn("gap", F.greatest(F.col("target_examples") - F.col("accepted"), F.lit(0))).withColumn("floor_target", F.greatest("target_examples", F.lit(1)))
    semantic = semantic_status(clusters, accepted).select(
        F.col("semantic_cluster").alias("sc"), F.col("gap").alias("semantic_gap"), (F.col("gap") / F.greatest("target", F.lit(1))).alias("semantic_ratio")
    )
    theirs = state.select(F.col("cluster_id").alias("dst"), (F.col("gap") / F.col("floor_target")).alias("their_ratio"))
    frontier = edges.join(theirs, "dst").groupBy(F.col("src").alias("cluster_id")).agg(F.sum(F.col("similarity") * F.col("their_ratio")).alias("frontier"))
    median = clusters.agg(upper_median("seed_count").alias("median"))
    joined = state.join(semantic, state["semantic_cluster"].cast("string") == semantic["sc"]).drop("sc").join(frontier, "cluster_id", "left").na.fill(0.0, ["frontier"]).join(F.broadcast(median))
    wanted = F.col("cluster_id").isin(*focus) if focus else F.col("gap") > 0
    saturated = F.col("accepted") / F.col("floor_target")
    tail = F.when(F.col("seed_count") <= F.greatest(F.lit(1), F.col("median")), F.lit(long_tail)).otherwise(F.lit(0.0))
    pull = F.col("frontier") * weight
    priority = F.col("gap") + F.col("semantic_ratio") + pull + tail - F.greatest(F.lit(0.0), saturated - saturation) * 2.0
    bonus = F.least(F.lit(2), F.greatest(F.lit(0), F.bround(F.col("semantic_ratio") * top_k + pull + tail).cast("int")))
    earns = (F.col("semantic_gap") > 0) & (F.col("gap") > 0) & (saturated < saturation)
    out = joined.where(wanted).withColumn("priority", F.round(priority, 4)).withColumn("bonus", F.when(earns, bonus).otherwise(F.lit(0)))
    place = F.row_number().over(Window.orderBy(F.desc("priority"), F.desc("target_examples"), "cluster_id"))
    ranked = out.withColumn("place", place).drop("median", "floor_target")
    return ranked if focus else ranked.where(F.col("place") <= max_active)


def allocated(priorities: DataFrame) -> DataFrame:
    """Adds allocation. Giving slots one at a time to the cluster with the largest need
    fills every gap exactly, so the outcome is gap plus bonus; nothing if no gap is left."""
    any_gap = F.sum("gap").over(Window.partitionBy()) > 0
    return priorities.withColumn("allocation", F.when(any_gap, F.col("gap") + F.col("bonus")).otherwise(F.lit(0)))


def plan_slots(allocation: DataFrame) -> DataFrame:
    """One row per slot: cluster_id, topic, style, persona, difficulty, slot."""
    slots = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("allocation")).cast("int"))).alias("slot")
    return allocation.select("cluster_id", "topic", "style", persona(F.col("style"), F.col("difficulty")).alias("persona"), "difficulty", slots)


def cycled(slots: DataFrame, n: int) -> DataFrame:
    """The plan's slots in order, again from the start until there are ``n``."""
    places = numbered(slots, F.col("cluster_id"), F.col("slot"))
    have = max(1, places.count())
    turns = F.explode(F.sequence(F.lit(0), F.lit(-(-n // have) - 1))).alias("turn")
    return places.select("*", turns).withColumn("slot", (F.col("turn") * have + F.col("place")).cast("int")).where(F.col("slot") <= n).drop("turn", "place")


def fallback_plan(topics: DataFrame, seed: int = 42) -> DataFrame:
    """Every topic with every persona and difficulty, in an order drawn by hash."""
    options = topics.select("topic", F.explode(F.array(*[F.lit(p) for p in PERSONAS])).alias("persona")).select("*", F.explode(F.array(*[F.lit(d) for d in DIFFICULTIES])).alias("difficulty"))
    return options.withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64("topic", "persona", "difficulty", F.lit(seed)))))


TREE = "struct<root:string,branches:array<struct<name:string,leaves:array<string>>>>"


def topic_trees(replies: DataFrame) -> DataFrame:
    """domain, root, branches of (domain, tree), the tree being a model's reply. One
    without branches is replaced: the domain as its one branch, with two leaves."""
    basic = F.array(F.struct(F.col("domain").alias("name"), F.array(F.concat("domain", F.lit(" basics")), F.concat("domain", F.lit(" advanced"))).alias("leaves")))
    given = F.col("tree.branches")
    return replies.select("domain", F.when(given.isNull(), F.col("domain")).otherwise(F.coalesce("tree.root", "domain")).alias("root"), F.coalesce(given, basic).alias("branches"))


def topic_counts(trees: DataFrame) -> DataFrame:
    """root, branches, leaves: how many of each a tree has."""
    leaves = F.aggregate("branches", F.lit(0), lambda acc, b: acc + F.size(F.coalesce(b["leaves"], F.array().cast("array<string>"))))
    return trees.select("root", F.size("branches").alias("branches"), leaves.alias("leaves"))


def topic_batches(leaves: DataFrame, target: int, batch_size: int) -> DataFrame:
    """Adds examples to (root, i, j, topic): how many to ask for of each topic, in order,
    evenly, a batch at most, until the target is asked for; topics beyond it go."""
    whole = Window.partitionBy("root")
    share = F.greatest(F.lit(1), F.floor(F.lit(target) / F.count(F.lit(1)).over(whole)))
    size = F.least(share, F.lit(batch_size))
    place = F.row_number().over(Window.partitionBy("root").orderBy("i", "j"))  # a tree's leaves: some hundreds
    planned = leaves.withColumn("size", size).withColumn("before", (place - 1) * F.col("size"))
    return planned.withColumn("examples", F.least("size", target - F.col("before")).cast("int")).where("examples > 0").drop("size", "before")


def topic_leaves(trees: DataFrame) -> DataFrame:
    """root, place, topic: trees (root, branches) flattened to 'branch — leaf', in order."""
    branches = trees.select("root", F.posexplode("branches").alias("i", "b"))
    return branches.select("root", "i", F.col("b.name").alias("name"), F.posexplode("b.leaves").alias("j", "leaf")).select("root", "i", "j", F.concat_ws(" — ", "name", "leaf").alias("topic"))
