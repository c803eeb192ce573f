"""Indexes, stores, draws, streams and rewrites as queries, each with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.functions import replies
from siltstone.operators import decontamination as decon
from siltstone.operators import diversity, draws, leaders, selection, vector_index
from siltstone.operators.views import benchmark_items, document_examples, table
from siltstone.plans import embedding
from siltstone.plans.catalog import EX_DOC, SCORED, VECTORS, VERDICT, _r, docs, pairnorm, query, searched, toks, vectors
from siltstone.plans.catalog import bench as bench_of
from siltstone.plans.engine import Engine
from siltstone.plans.sizes import shared_folder
from siltstone.sources.versions import Versions, remember, remembered
from siltstone.streaming import stateful


def folder(spark, name: str) -> str:
    """A new folder of this run, under the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- vectors


@query(f"WITH {VECTORS} SELECT id, item_index, round(similarity, 6) AS similarity, match_rank::INT AS match_rank FROM ranked WHERE match_rank <= 5")
def index_topk(spark, d):
    """From an index of all vectors on shared files; exact."""
    queries, items = searched(spark, d)
    path = folder(spark, "vector-index")
    vector_index.build(items, path)
    return vector_index.search(queries, path, 5, others=True).withColumn("similarity", _r("similarity"))


LETTERS = ", ".join(f"length(t) - length(replace(t, '{chr(c)}', ''))" for c in range(97, 123))
LETTER_EVIDENCE = f"""
dv AS (SELECT doc_id AS id, list_transform([{LETTERS}], lambda x: x::DOUBLE) AS v FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)),
bv AS (SELECT 'b' || (item_id % 5) AS benchmark, list_transform([{LETTERS}], lambda x: x::DOUBLE) AS v FROM (SELECT item_id, lower(text) AS t FROM benchmark)),
sims AS (SELECT id, benchmark, list_dot_product(dv.v, bv.v) / greatest(sqrt(list_dot_product(dv.v, dv.v)) * sqrt(list_dot_product(bv.v, bv.v)), 1e-12) AS s FROM dv, bv),
best AS (SELECT id, max(s) AS confidence FROM sims GROUP BY id)"""


@query(f"WITH {LETTER_EVIDENCE} SELECT d.doc_id AS id, CASE WHEN confidence >= 0.98 THEN 'review' ELSE 'clean' END AS verdict, CASE WHEN confidence >= 0.98 THEN round(confidence, 4) ELSE 0.0 END AS confidence FROM documents d JOIN best ON d.doc_id = best.id")
def text_vector_verdicts(spark, d):
    """Verdicts by vectors that a model makes of the texts themselves: a stand-in that counts
    letters, each different text once, in a store of this run."""
    store = embedding.VectorStore(spark, folder(spark, "vector-store"), "letters", embedding.letters, "documents and benchmark")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = embedding.text_evidence(rows, benchmark_items(table(spark, d, "benchmark")), store, folder(spark, "bench-index"), threshold=0.98)
    return decon.verdicts(rows, found).select("id", "verdict", "confidence")


@query("""WITH RECURSIVE v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS place, [x::DOUBLE for x in embedding] AS v FROM embeddings),
near AS (SELECT b.place, a.place AS earlier, list_dot_product(a.v, b.v) AS s FROM v a JOIN v b ON a.place < b.place AND list_dot_product(a.v, b.v) >= 0.3),
before AS (SELECT v.place, coalesce(list(earlier) FILTER (WHERE earlier IS NOT NULL), []) AS earlier FROM v LEFT JOIN near USING (place) GROUP BY v.place),
walk(n, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT n + 1, CASE WHEN len(list_intersect(leaders, earlier)) > 0 THEN leaders ELSE list_append(leaders, n + 1) END FROM walk JOIN before ON place = n + 1),
led AS (SELECT unnest(leaders) AS leader FROM (SELECT leaders FROM walk ORDER BY n DESC LIMIT 1)),
best AS (SELECT near.place, arg_max(earlier, (s, -earlier)) AS leader, max(s) AS similarity FROM near JOIN led ON earlier = leader WHERE near.place NOT IN (SELECT leader FROM led) GROUP BY near.place
  UNION ALL SELECT leader, leader, 1.0 FROM led),
numbered AS (SELECT leader, row_number() OVER (ORDER BY leader) - 1 AS semantic_cluster FROM led)
SELECT v.id, l.id AS leader_id, semantic_cluster, round(similarity, 6) AS similarity FROM best JOIN v USING (place) JOIN v l ON l.place = best.leader JOIN numbered ON numbered.leader = best.leader""")
def leader_clusters(spark, d):
    """Clusters of all vectors by the pass over them in order; the test vectors are unrelated,
    so the threshold is low."""
    return leaders.leader_clusters(vectors(spark, d), 0.3).withColumn("similarity", _r("similarity"))


# ---- draws and diversity


@query("""SELECT coalesce(source, 'unknown') AS topic, place, id FROM (SELECT doc_id AS id, source, row_number() OVER (PARTITION BY coalesce(source, 'unknown') ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents) WHERE place <= 3""")
def seeds_per_prompt(spark, d):
    """Three seeds for the prompt of each topic."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("unknown")).alias("topic"))
    return draws.drawn(rows, 3, "topic").select(F.col("group").alias("topic"), "place", "id")


@query("""SELECT id, row_number() OVER (ORDER BY md5('7:' || id), id) AS place FROM (SELECT conv_id AS id FROM conversations GROUP BY conv_id HAVING count(*) >= 3) QUALIFY place <= 40""")
def multiturn_draw(spark, d):
    """Forty conversations of several turns, as a pool to write more of."""
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count(F.lit(1)).alias("turns")).where("turns >= 3")
    return draws.drawn(rows, 40, seed=7).select("id", "place")


def _hash_sql(i: int) -> str:
    a, b = diversity.coefficients()[i]
    return f"SELECT id, {i} AS i, min(({a} * x + {b}) % {diversity.PRIME}) AS v FROM numbers GROUP BY id"


HEX = " + ".join(f"(strpos('0123456789abcdef', m[{i + 1}]) - 1) * {16 ** (6 - i)}" for i in range(7))
TRIGRAMS = f"""SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram
  FROM (SELECT doc_id AS id, {toks("lower(text)")} AS w FROM documents)"""


@query(f"""WITH grams AS ({TRIGRAMS}), numbers AS (SELECT id, ({HEX})::BIGINT AS x FROM (SELECT id, md5(gram) AS m FROM grams)),
least AS ({' UNION ALL '.join(map(_hash_sql, range(diversity.FUNCTIONS)))}),
likeness AS (SELECT i, sum(c * (c - 1) / 2) AS s FROM (SELECT i, v, count(*) AS c FROM least GROUP BY i, v) GROUP BY i),
sizes AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM documents) - (SELECT count(DISTINCT id) FROM grams) AS e)
SELECT round(1 - avg(s) / any_value((n * (n - 1) - e * (e - 1)) / 2), 9) AS diversity, round(stddev_samp(s) / sqrt({diversity.FUNCTIONS}) / any_value((n * (n - 1) - e * (e - 1)) / 2), 9) AS standard_error FROM likeness, sizes""")
def estimated_diversity(spark, d):
    """Of all pairs of documents, by the collisions of least hashes; the error beside it."""
    one = diversity.estimated_gram_distance(document_examples(table(spark, d, "documents")))
    return one.select(F.round("diversity", 9).alias("diversity"), F.round("standard_error", 9).alias("standard_error"))


# ---- repeated rows, rewrites, streams


@query(f"""WITH {SCORED}, {VERDICT.lstrip()}
SELECT id, quality_score, verdict, round(confidence, 6) AS confidence, 2::BIGINT AS copies FROM scored JOIN verdicts USING (id)""")
def audit_repeats(spark, d):
    """Every document twice, with ids of their own: each is audited as a row, both alike."""
    rows = docs(spark, d)
    twice = rows.withColumn("doc", F.col("id")).withColumn("id", F.concat(F.col("id").cast("string"), F.lit("-1")))
    twice = twice.union(rows.withColumn("doc", F.col("id")).withColumn("id", F.concat(F.col("id").cast("string"), F.lit("-2"))))
    engine = Engine(spark)
    judged = twice.select("doc", "id", "user", "assistant", "topic", "overall", "judge_issues", "lang")
    # the documents' labels stand for the judge
    audited = engine.verdicts(judged, bench_of(spark, d), F.col("assistant"))
    found = audited.groupBy("doc").agg(F.count(F.lit(1)).alias("copies"), F.min("quality_score").alias("quality_score"), F.max("quality_score").alias("q2"), F.min("verdict").alias("verdict"), F.max("verdict").alias("v2"), F.min("confidence").alias("confidence"), F.max("confidence").alias("c2"))
    same = F.col("quality_score").eqNullSafe(F.col("q2")) & (F.col("verdict") == F.col("v2")) & (F.col("confidence") == F.col("c2"))
    return found.where(same).select(F.col("doc").alias("id"), "quality_score", "verdict", F.round("confidence", 6).alias("confidence"), "copies")


@query(f"""WITH {EX_DOC}, k AS (SELECT id, {pairnorm('"user"')} AS u, {pairnorm('assistant')} AS a FROM ex_doc) SELECT min(id) AS id FROM k GROUP BY u, a""")
def rewritten_distinct(spark, d):
    """A table rewritten in place without its repeated pairs, then read."""
    rows = Versions(spark, folder(spark, "rewritten"))
    rows.replace(document_examples(table(spark, d, "documents")).select("id", "user", "assistant"))
    rows.rewrite(lambda old: old.join(selection.first_of_pairs(old), "id", "left_semi"))
    return rows.read().select("id")


@query("""SELECT id, minutes FROM (SELECT o_orderkey AS id, o_totalprice / 10000 AS minutes FROM orders ORDER BY o_orderkey DESC LIMIT 200)""")
def history_compacted(spark, d):
    """A history of orders, added to in parts: its last 200 stay."""
    path = folder(spark, "history")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 10000).alias("minutes"))
    for part in range(3):
        remember(rows.where(F.col("id") % 3 == part), path, "id")
    return remembered(spark, path, "id long, minutes double")


@query("""WITH c AS (SELECT conv_id AS id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS u, coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant'), '') AS a FROM conversations GROUP BY conv_id)
SELECT min(id) AS id FROM c GROUP BY """ + pairnorm("u") + ", " + pairnorm("a"))
def stream_first_pairs(spark, d):
    """The first of equal conversations, from a stream of files that is stopped and started again."""
    from siltstone.plans.catalog import convs

    where = folder(spark, "stream")
    rows = convs(spark, d).select("id", "user", "assistant")
    for part in range(2):
        rows.where(F.col("id") % 2 == part).write.mode("append").parquet(f"{where}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{where}/in")
        stateful.run(stateful.first_pairs(stream), f"{where}/out", f"{where}/checkpoint").awaitTermination()
    return stateful.settled(spark.read.parquet(f"{where}/out")).select("id")


@query("""SELECT coalesce(o_orderpriority, '') AS every, count(*) AS n, round(avg(o_totalprice), 4) AS average FROM orders GROUP BY ALL""")
def stream_progress(spark, d):
    """The running average of a stream's rows after its last round."""
    where = folder(spark, "stream")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("topic"), F.col("o_totalprice").alias("quality_score"), F.col("o_orderkey").alias("id"))
    for part in range(2):
        rows.where(F.col("id") % 2 == part).write.mode("append").parquet(f"{where}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{where}/in")
        stateful.run(stateful.progress(stream, "topic"), f"{where}/out", f"{where}/checkpoint").awaitTermination()
    return stateful.latest(spark.read.parquet(f"{where}/out")).select("every", "n", F.round("average", 4).alias("average"))


# ---- replies


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 5 = 3 THEN 'none' ELSE coalesce(source, 'general') END AS topic, CASE WHEN doc_id % 5 IN (3, 4) THEN -1 ELSE n_chars END AS size,
  CASE WHEN doc_id % 5 = 3 THEN '' ELSE md5(substr(coalesce(text, ''), 1, 300)) END AS text_md5, CASE WHEN doc_id % 5 = 3 THEN 'no JSON' WHEN doc_id % 5 = 4 THEN 'missing: size' END AS problem FROM documents""")
def typed_replies(spark, d):
    """Replies as a model might write them, made from the documents: fenced, with talk around
    them, raw line breaks in strings, commas too many, closers too few, fields that lack."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("general")).alias("topic"), "n_chars", F.substring(F.coalesce("text", F.lit("")), 1, 300).alias("text"))
    string = F.concat(F.lit('"'), F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))  # line breaks stay raw
    fields = F.concat(F.lit('{"topic": "'), F.col("topic"), F.lit('", "text": '), string)
    size = F.concat(F.lit(', "size": '), F.col("n_chars").cast("string"))
    kind = F.col("doc_id") % 5
    reply = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), fields, size, F.lit("}\n```")))
        .when(kind == 1, F.concat(F.lit("Here you are: "), fields, size, F.lit(" , }  Good luck!")))
        .when(kind == 2, F.concat(fields, size, F.lit(', "tags": [1, 2')))
        .when(kind == 3, F.lit("I can't do that."))
        .otherwise(F.concat(fields, F.lit(', "size": "large", }')))
    )
    read = replies.typed(F.col("reply"), {"topic": ("string", "none"), "size": ("bigint", -1), "text": ("string", None)})
    found = rows.withColumn("reply", reply).withColumn("x", read)
    text_md5 = F.when(F.col("x.text").isNull(), "").otherwise(F.md5("x.text"))
    # the text has no default: that it lacks is told by a reply without JSON only
    return found.select(F.col("doc_id").alias("id"), "x.topic", "x.size", text_md5.alias("text_md5"), "x.problem")
