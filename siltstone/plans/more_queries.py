"""More of the library's operators as queries, each with DuckDB SQL, beside ``catalog``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.functions import text, vectors
from siltstone.operators import artifacts, assembly, diversity, distribution, evaluation, planning, quality, ranking, reference, selection
from siltstone.operators.views import document_examples, table
from siltstone.plans import catalog
from siltstone.plans.catalog import CLUSTERS, DECON, EX_CONV, EX_DOC, F1, GRAPH, ORACLE, SCORED, STATUS, _accepted, _clusters, _messages, _r, _scored_pairs, convs, evidence, query, scored_docs, seed_rows
from siltstone.plans.sizes import shared_folder, stored
from siltstone.sources import jsonl, runs, writers

# ---- sources and exports


@query("""SELECT conv_id AS id, md5('{"messages":[' || string_agg('{"role":"' || role || '","content":' || to_json(coalesce(text, '')) || '}', ',' ORDER BY turn) || ']}') AS line_md5
FROM conversations GROUP BY conv_id""")
def export_openai(spark, d):
    return _messages(spark, d).select("id", F.md5(writers.openai(F.col("messages"))).alias("line_md5"))


@query("""WITH t AS (SELECT conv_id, count(*) AS n, coalesce(arg_min(coalesce(text, ''), turn) FILTER (WHERE role = 'user'), '') AS "user",
  coalesce(arg_min(coalesce(text, ''), turn) FILTER (WHERE role = 'assistant'), '') AS assistant FROM conversations GROUP BY conv_id)
SELECT n AS turns, md5("user") AS user_md5, md5(assistant) AS assistant_md5, count(*) AS conversations FROM t WHERE n >= 2 GROUP BY ALL""")
def jsonl_round_trip(spark, d):
    """Conversations written as JSON lines to a folder of the run, and read again."""
    path = writers.export(_messages(spark, d).withColumn("ord", F.col("id")), "jsonl", f"{shared_folder(spark)}/export-{uuid.uuid4().hex}", "conversations")
    rows = jsonl.read_examples(spark, path)
    return rows.groupBy(F.size("messages").cast("long").alias("turns"), F.md5("user").alias("user_md5"), F.md5("assistant").alias("assistant_md5")).agg(F.count(F.lit(1)).alias("conversations"))


@query(rf"""SELECT p_partkey AS id, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'general') AS identifier,
  coalesce(nullif(rtrim(substr(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_'), 1, 64), '_'), ''), 'dataset') AS file,
  replace(replace(p_name, ' ', '_'), '/', '_') AS label,
  coalesce(nullif(array_to_string(list_filter(regexp_split_to_array(lower(p_name), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), '_'), ''), 'general') AS domain FROM part""")
def slugs(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.identifier_slug(name).alias("identifier"), text.file_slug(name).alias("file"), text.label_slug(name).alias("label"), text.domain_key(name).alias("domain"))


PREVIEWS = f"""{SCORED}, {DECON.lstrip()},
evs AS (
  SELECT id, list(benchmark || ':' || method || ':' || round(confidence, 4)::VARCHAR ORDER BY benchmark, method, item_index) AS evidence,
         list_distinct(list(method)) AS methods, list_sort(list_distinct(list(benchmark))) AS flags FROM ev GROUP BY id)"""


def _previews(spark, d):
    found = evidence(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("benchmark", "method", "item_index", F.round("confidence", 4).alias("confidence")))).alias("evidence"), F.array_sort(F.collect_set("benchmark")).alias("flags"))
    none = F.array().cast("array<struct<benchmark:string,method:string,item_index:bigint,confidence:double>>")
    rows = scored_docs(spark, d).select("id", "quality_score", "user", "assistant", "topic").join(found, "id", "left")
    return artifacts.preview(rows.withColumn("evidence", F.coalesce("evidence", none)))


@query(f"""WITH {PREVIEWS} SELECT id, quality_score, topic, md5(trim("user")) AS user_md5, md5(trim(assistant)) AS assistant_md5, coalesce(array_to_string(flags, ','), '') AS flags,
  coalesce(array_to_string(list_sort(methods), ','), '') AS methods, coalesce(array_to_string(evidence, ','), '') AS evidence FROM scored LEFT JOIN evs USING (id)""")
def artifact_previews(spark, d):
    rows = _previews(spark, d)
    return rows.select("id", "quality_score", "topic", F.md5("user").alias("user_md5"), F.md5("assistant").alias("assistant_md5"), F.array_join("flags", ",").alias("flags"), F.array_join(F.array_sort("methods"), ",").alias("methods"), F.array_join("evidence", ",").alias("evidence"))


@query(f"""WITH {PREVIEWS} SELECT id, quality_score, NULL::VARCHAR AS selection_decision, topic, NULL::VARCHAR AS persona, NULL::VARCHAR AS difficulty, '' AS rejection_reasons,
  coalesce(array_to_string(flags, ' | '), '') AS flags, coalesce(array_to_string(list_sort(methods), ' | '), '') AS methods, coalesce(array_to_string(evidence, ' | '), '') AS evidence,
  md5(trim("user")) AS "user", md5(trim(assistant)) AS assistant FROM scored LEFT JOIN evs USING (id)""")
def artifact_sheet(spark, d):
    rows = artifacts.csv_rows(_previews(spark, d).withColumn("methods", F.array_sort("methods")))
    return rows.withColumn("user", F.md5("user")).withColumn("assistant", F.md5("assistant"))


# ---- assembly and selection


@query(f"""WITH {EX_DOC} SELECT id FROM ex_doc WHERE coalesce(topic <> 'src0', true)""")
def non_seed_pool(spark, d):
    rows = document_examples(table(spark, d, "documents")).withColumn("seed_example", F.col("topic") == "src0")
    return assembly.non_seed_pool(rows).select("id")


@query(f"""WITH {EX_DOC} SELECT CASE WHEN topic = 'src0' THEN 'seed' ELSE 'generated' END AS source, topic = 'src0' AS seed_example,
  CASE WHEN topic = 'src0' THEN 'seed_file' ELSE 'synthetic' END AS generation_source, count(*) AS n, min(id) AS first, max(id) AS last FROM (SELECT * REPLACE (coalesce(topic, 'general') AS topic) FROM ex_doc) GROUP BY ALL""")
def final_dataset(spark, d):
    rows = catalog.topical(document_examples(table(spark, d, "documents")))
    whole = assembly.final_dataset(rows.where("topic = 'src0'"), rows.where("topic <> 'src0'"))
    return whole.groupBy("source", "seed_example", "generation_source").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query(f"""WITH {EX_CONV} SELECT id, 3 AS messages, md5('be kind' || "user" || assistant) AS texts_md5 FROM ex_conv WHERE "user" <> '' AND assistant <> ''""")
def chat_records(spark, d):
    rows = assembly.chat_records(convs(spark, d), "be kind")
    return rows.select("id", F.size("messages").alias("messages"), F.md5(F.array_join(F.col("messages.content"), "")).alias("texts_md5"))


@query("""WITH p AS (
  SELECT conv_id, turn // 2 AS pair, coalesce(min(text) FILTER (WHERE turn % 2 = 0), '') AS u, coalesce(min(text) FILTER (WHERE turn % 2 = 1), '') AS a
  FROM conversations WHERE turn >= 2 GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pair) AS i FROM p WHERE trim(u) <> '' AND trim(a) <> '')
SELECT conv_id AS id, 1 + count(*)::INT AS num_turns, md5(string_agg(u || a, '' ORDER BY pair)) AS texts_md5 FROM g WHERE i <= 2 GROUP BY conv_id""")
def multiturn_records(spark, d):
    """Later turns as the pairs to append, two of them at most."""
    c = table(spark, d, "conversations").where("turn >= 2")
    side = lambda odd: F.coalesce(F.min(F.when(F.col("turn") % 2 == odd, F.col("text"))), F.lit(""))
    pairs = c.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("pair")).agg(side(0).alias("user"), side(1).alias("assistant"))
    extra = pairs.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pair", "user", "assistant"))), lambda x: F.struct(x["user"].alias("user"), x["assistant"].alias("assistant"))).alias("extra"))
    rows = extra.withColumn("messages", F.array(assembly.message("user", F.lit("")), assembly.message("assistant", F.lit(""))))
    return assembly.multiturn(rows, 2).select(F.col("conv_id").alias("id"), "num_turns", F.md5(F.array_join(F.col("messages.content"), "")).alias("texts_md5"))


@query(f"""WITH {catalog._SQL_ANSWERS}, s AS (SELECT id, id % 2 = 0 AS g, a, {catalog._sql_soften('a')} AS b FROM ans)
SELECT id, md5(CASE WHEN g THEN b ELSE a END) AS text_md5, g AS support_style_sanitized FROM s""")
def softened_records(spark, d):
    rows = catalog._answers(spark, d).withColumn("source", F.when(F.col("id") % 2 == 0, "generated").otherwise("seed"))
    return assembly.softened(rows).select("id", F.md5("assistant").alias("text_md5"), "support_style_sanitized")


@query(f"""WITH {catalog._SQL_ANSWERS}, r AS (SELECT id, a, ({catalog._RISK_SQL})::INT AS risk FROM ans),
top AS (SELECT id FROM r WHERE risk > 0 ORDER BY risk DESC, id DESC LIMIT 20)
SELECT id, id IN (SELECT id FROM top) AS reviewed, md5(CASE WHEN id IN (SELECT id FROM top) THEN {catalog._sql_literals(catalog._sql_patterns(catalog._sql_soften('a'), catalog.rewrite.TARGETED), catalog.rewrite.LAST)} ELSE a END) AS text_md5 FROM r""")
def curated_records(spark, d):
    return selection.curated(catalog._answers(spark, d), 20).select("id", "reviewed", F.md5("assistant").alias("text_md5"))


@query(f"""WITH {SCORED}, keyed AS (SELECT id, quality_score, substr("user", 1, 80) || chr(1) || substr(assistant, 1, 80) AS k FROM scored),
old AS (SELECT k, arg_max(quality_score + 1, id) AS s FROM keyed WHERE id % 2 = 0 GROUP BY k)
SELECT id, coalesce(s, quality_score) AS quality_score FROM keyed LEFT JOIN old USING (k)""")
def resume_scores(spark, d):
    """Rows with an even id stand for an earlier run, whose scores were higher by one."""
    rows = scored_docs(spark, d)
    earlier = rows.where(F.col("id") % 2 == 0).withColumn("quality_score", F.col("quality_score") + 1)
    return selection.resumed(rows, earlier).select("id", "quality_score")


@query(f"""WITH {SCORED} SELECT id, row_number() OVER (ORDER BY lower(coalesce(topic, '')), id)::INT AS place FROM scored""")
def inspect_by_topic(spark, d):
    return artifacts.inspect_place(scored_docs(spark, d), "topic").select("id", F.col("place").cast("int").alias("place"))


@query(f"""WITH {SCORED} SELECT id, row_number() OVER (ORDER BY lower(array_to_string(quality_issues, ',')), id)::INT AS place FROM scored""")
def inspect_by_reason(spark, d):
    return artifacts.inspect_place(scored_docs(spark, d).withColumn("rejection_reasons", F.col("quality_issues")), "reason").select("id", F.col("place").cast("int").alias("place"))


# ---- distributions and planning


@query("""SELECT coalesce(nullif(source, ''), nullif(lang, ''), 'general__medium__concise') AS key, count(*) AS n FROM documents GROUP BY 1""")
def accepted_clusters(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("cluster_id"), F.col("lang").alias("seed_cluster_id"))
    return distribution.accepted_by_cluster(rows)


@query(f"""WITH {CLUSTERS} SELECT cluster_id AS key, target_examples AS planned, accepted AS actual, gap FROM st""")
def planned_gaps(spark, d):
    rows = seed_rows(spark, d, tokens=False)
    planned = _clusters(rows).select(F.col("cluster_id").alias("key"), F.col("target_examples").alias("n"))
    return distribution.planned_gaps(planned, _accepted(spark, d, rows))


@query(f"""WITH {CLUSTERS} SELECT '0' AS semantic_cluster, target::BIGINT AS target, generated::BIGINT AS generated, sgap::BIGINT AS gap FROM sem""")
def semantic_status(spark, d):
    rows = seed_rows(spark, d, tokens=False)
    return distribution.semantic_status(_clusters(rows), _accepted(spark, d, rows))


@query(f"WITH {STATUS} SELECT graph_coverage FROM cover")
def graph_coverage(spark, d):
    return distribution.graph_coverage(*catalog._planned(spark, d))


@query(f"WITH {GRAPH} SELECT cluster_id, array_to_string(v, ',') AS vector FROM vec")
def cluster_vectors(spark, d):
    seeds = seed_rows(spark, d)
    rows = planning.cluster_vectors(_clusters(seeds), seeds)
    return rows.select("cluster_id", F.array_join(F.transform("vector", lambda x: x.cast("string")), ",").alias("vector"))


@query(f"""SELECT round(0.45::DOUBLE * s.match_score + 0.45::DOUBLE * a.alignment_score + 10 * s.graph_coverage, 2) AS validated_score, round(abs(s.match_score - a.alignment_score), 4) AS calibration_error
FROM ({ORACLE['distribution_status']}) s, ({ORACLE['reference_alignment'].replace(', 4) AS alignment_score', ', 12) AS alignment_score')}) a""")
def distribution_validation(spark, d):
    status = stored(catalog.distribution_status(spark, d))  # one row, used twice
    return reference.validation(status, reference.alignment(*catalog.sides(spark, d)), status).select("validated_score", "calibration_error")


@query("""SELECT topic, persona, difficulty FROM (SELECT DISTINCT coalesce(source, 'general') AS topic FROM documents), (SELECT unnest(['beginner', 'expert', 'skeptic']) AS persona), (SELECT unnest(['easy', 'medium', 'hard']) AS difficulty)""")
def fallback_plan(spark, d):
    topics = table(spark, d, "documents").select(F.coalesce("source", F.lit("general")).alias("topic")).distinct()
    return planning.fallback_plan(topics).select("topic", "persona", "difficulty")


def _trees(spark, d):
    """Regions as domains, their nations as branches, and the nations' keys as leaves; the
    first region's reply has no branches."""
    nations = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name"), F.array(F.concat(F.lit("a"), "n_nationkey"), F.concat(F.lit("b"), "n_nationkey")).alias("leaves")))).alias("branches"))
    regions = table(spark, d, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return planning.topic_trees(regions.select(F.col("r_name").alias("domain"), F.when(F.col("r_regionkey") > 0, F.struct(F.col("r_name").alias("root"), "branches")).alias("tree")))


TREES = """
WITH b AS (
  SELECT r_name AS root, n_name AS name, ['a' || n_nationkey, 'b' || n_nationkey] AS leaves FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey > 0
  UNION ALL SELECT r_name, r_name, [r_name || ' basics', r_name || ' advanced'] FROM region WHERE r_regionkey = 0)"""


@query(TREES + "SELECT root, name || ' — ' || unnest(leaves) AS topic FROM b")
def topic_leaves(spark, d):
    return planning.topic_leaves(_trees(spark, d)).select("root", "topic")


@query(TREES + "SELECT root, count(*)::INT AS branches, sum(len(leaves))::INT AS leaves FROM b GROUP BY root")
def topic_tree_counts(spark, d):
    return planning.topic_counts(_trees(spark, d))


@query(f"""WITH {EX_DOC}, {catalog.PRIORITY.replace(EX_DOC, '').lstrip(', ').lstrip(',')},
p AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) % 2 = 0 AS known, place FROM best),
plan AS (SELECT CASE WHEN known THEN cluster_id ELSE 'none of them' || place END AS cluster_id, place FROM p),
seeds AS (SELECT cluster_id, id FROM k WHERE id % 100 = 0)
SELECT place::INT AS place, id FROM plan JOIN seeds USING (cluster_id)
UNION ALL SELECT place::INT, id FROM (SELECT place FROM plan ANTI JOIN seeds USING (cluster_id)), seeds""")
def seeds_of_clusters(spark, d):
    """A small table of seeds (every hundredth row), and a plan of which half the clusters have none."""
    rows = seed_rows(spark, d)
    named = catalog._priorities(spark, d, rows).select("cluster_id", "place").withColumn("n", F.expr("row_number() OVER (ORDER BY cluster_id)"))
    plan = named.withColumn("cluster_id", F.when(F.col("n") % 2 == 0, F.col("cluster_id")).otherwise(F.concat(F.lit("none of them"), "place"))).drop("n")
    seeds = rows.where(F.col("id") % 100 == 0).select("cluster_id", "id")
    return assembly.seeds_of_clusters(plan, seeds).select("place", "id")


# ---- evaluation, runs, statistics


@query(F1 + """, t AS (SELECT topic, avg(f1) AS f, avg(success) AS s, avg(passed) AS p FROM m GROUP BY topic)
SELECT round(b.f - a.f, 4) AS avg_f1_uplift, round(b.s - a.s, 4) AS avg_success_uplift, round(b.p - a.p, 4) AS avg_passed_uplift FROM t a, t b WHERE a.topic = '0' AND b.topic = '1'""")
def uplift_metrics(spark, d):
    """Two topics of the holdout stand for the base and the tuned model."""
    metrics = evaluation.holdout_metrics(_scored_pairs(spark, d)).cache()
    return evaluation.uplift(metrics.where("topic = '0'"), metrics.where("topic = '1'"), ["avg_f1", "avg_success", "avg_passed"])


RUNS = """
WITH r AS (
  SELECT s_nationkey AS run, avg(s_acctbal)::DOUBLE AS match, max(s_acctbal)::DOUBLE AS f, min(s_acctbal)::DOUBLE AS s, count(*)::DOUBLE AS p FROM supplier GROUP BY 1),
k AS (SELECT * FROM r WHERE run % 7 <> 0)"""


def _runs(spark, d):
    """Nations stand for runs: a summary of each, and an uplift of those whose key isn't divisible by seven."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("run"))
    balance = F.col("s_acctbal").cast("double")
    summaries = s.agg(F.avg(balance).alias("match"))
    uplifts = s.agg(F.max(balance).alias("uplift_f1"), F.min(balance).alias("uplift_success"), F.count(F.lit(1)).cast("double").alias("uplift_passed")).where(F.col("run") % 7 != 0)
    return summaries, uplifts


@query(RUNS + "SELECT run, round(match, 6) AS match, round(f, 6) AS uplift_f1, round(s, 6) AS uplift_success, p AS uplift_passed FROM k")
def run_metrics(spark, d):
    return runs.run_metrics(*_runs(spark, d)).select("run", _r("match"), _r("uplift_f1"), _r("uplift_success"), "uplift_passed")


@query(RUNS + """SELECT count(*) AS runs, round(avg(match), 6) AS avg_match, round(avg(f), 6) AS avg_uplift_f1, round(corr(match, f), 4) AS corr_uplift_f1, round(avg(s), 6) AS avg_uplift_success,
  round(corr(match, s), 4) AS corr_uplift_success, round(avg(p), 6) AS avg_uplift_passed, round(corr(match, p), 4) AS corr_uplift_passed FROM k""")
def metric_validation(spark, d):
    """Runs without an uplift don't count."""
    summaries, uplifts = _runs(spark, d)
    found = evaluation.metric_validation(summaries.join(uplifts, "run", "left"))
    averages = [c for c in found.columns if c.startswith("avg_")]
    return found.select("runs", *[_r(c) for c in averages], *[c for c in found.columns if c.startswith("corr_")])


@query("""WITH r AS (SELECT o_orderkey AS run, o_orderdate AS updated_at FROM orders) SELECT run FROM r ORDER BY updated_at DESC, run DESC LIMIT 200""")
def history_latest(spark, d):
    history = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("updated_at"))
    return ranking.latest(history, 200).select("run")


@query("""WITH r AS (SELECT p_partkey AS ord, lower(replace(p_name, ' ', '_')) AS domain FROM part),
s AS (SELECT *, CASE WHEN domain = 'hot_red_gear' THEN 99 ELSE len(list_intersect(string_split(domain, '_'), ['hot', 'red', 'gear'])) END AS shared FROM r)
SELECT ord, domain FROM s WHERE shared > 0 ORDER BY shared DESC, ord LIMIT 1""")
def model_recommendation(spark, d):
    recs = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("domain"))
    return ranking.recommended(recs, "hot_red_gear").select("ord", "domain")


@query("""WITH n AS (SELECT o_orderkey % 500 + 1 AS examples, o_totalprice::DOUBLE AS s FROM orders ORDER BY abs(o_orderkey % 500 + 1 - 250), o_orderkey DESC LIMIT 5),
e AS (SELECT examples, 'generate' AS stage, s / 100 AS seconds FROM n UNION ALL SELECT examples, 'score', s / 50 FROM n)
SELECT stage, greatest(1, round_even(list_sort(list(seconds / 60 * 250 / examples))[count(*) // 2 + 1], 0)::BIGINT) AS minutes FROM e GROUP BY stage""")
def stage_estimates(spark, d):
    price = F.col("o_totalprice").cast("double")
    history = table(spark, d, "orders").select((F.col("o_orderkey") % 500 + 1).alias("examples"), "o_orderkey", F.create_map(F.lit("generate"), price / 100, F.lit("score"), price / 50).alias("stages"))
    near = history.orderBy(F.abs(F.col("examples") - 250), F.desc("o_orderkey")).limit(5)
    return ranking.stage_minutes(near, 250)


@query(f"WITH {SCORED} SELECT min(quality_score) AS lowest, max(quality_score) AS highest, round(avg(quality_score), 6) AS average FROM scored")
def score_spread(spark, d):
    return quality.score_spread(scored_docs(spark, d)).select("lowest", "highest", _r("average"))


@query("WITH t AS (SELECT count(*) AS n FROM conversations GROUP BY conv_id) SELECT count(*) AS conversations, min(n) AS fewest, max(n) AS most, round(avg(n), 6) AS average FROM t")
def turn_stats(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("num_turns"))
    return quality.turn_stats(turns).select("conversations", "fewest", "most", _r("average"))


@query("""WITH v AS (SELECT vec_id AS id, [x::DOUBLE for x in embedding] AS v FROM embeddings)
SELECT a.id, round(greatest(0, least(1, list_dot_product(a.v[:8], b.v[:8]) / sqrt(list_dot_product(a.v[:8], a.v[:8]) * list_dot_product(b.v[:8], b.v[:8])))), 6) AS cosine FROM v a JOIN v b ON b.id = a.id + 1""")
def vector_cosines(spark, d):
    """Each vector's first eight places with the next one: sides of different lengths are cut."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    nearby = v.select((F.col("id") - 1).alias("id"), F.slice("v", 1, 8).alias("w"))
    return v.join(nearby, "id").select("id", F.round(vectors.clamped_cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


@query(f"WITH {EX_DOC} SELECT id FROM ex_doc WHERE trim(assistant) <> '' ORDER BY id LIMIT 200")
def embeddable_texts(spark, d):
    """The sample that a model is asked for; its size is the feature."""
    return diversity.embeddable(document_examples(table(spark, d, "documents")), 200).select("id")


@query(f"WITH {SCORED}, u AS (SELECT unnest(quality_issues) AS issue FROM scored), c AS (SELECT issue, count(*) AS n FROM u GROUP BY 1) SELECT string_agg(issue || '=' || n, ',' ORDER BY issue) AS counts FROM c")
def issue_map(spark, d):
    one = quality.count_map(quality.issue_counts(scored_docs(spark, d)), "issue")
    return one.select(F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query(TREES + """, l AS (SELECT root, name || ' — ' || unnest(leaves) AS topic FROM b),
p AS (SELECT *, least(greatest(1, 15 // count(*) OVER (PARTITION BY root)), 5) AS size, row_number() OVER (PARTITION BY root ORDER BY topic) - 1 AS place FROM l)
SELECT root, sum(least(size, 15 - place * size))::BIGINT AS examples, count(*) AS topics FROM p WHERE place * size < 15 GROUP BY root""")
def topic_batches(spark, d):
    """Fifteen examples of each tree, five at most at a time."""
    plan = planning.topic_batches(planning.topic_leaves(_trees(spark, d)), 15, 5)
    return plan.groupBy("root").agg(F.sum("examples").alias("examples"), F.count(F.lit(1)).alias("topics"))


@query(f"WITH {EX_DOC} SELECT count(*) AS n FROM (SELECT id FROM ex_doc ORDER BY id LIMIT 50)")
def diversity_sample(spark, d):
    """How many rows the sample drawn by hash has: its size is the feature."""
    return diversity.sample(document_examples(table(spark, d, "documents"))).agg(F.count(F.lit(1)).alias("n"))
