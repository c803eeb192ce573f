"""The library's operators as queries over the test tables, each with DuckDB SQL.

All run over whole tables and whole texts. Limits are there only where they are the
feature: top-k reports, samples of fixed size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import classify, rewrite, text
from siltstone.operators import artifacts, distribution, diversity, evaluation, planning, quality, ranking, reference, selection
from siltstone.operators import decontamination as decon
from siltstone.operators.views import benchmark_items, conversation_examples, document_examples, table
from siltstone.plans.sizes import stored
from siltstone.sources import writers

MIN_SCORE = 7.5


def docs(spark: SparkSession, d: str) -> DataFrame:
    return document_examples(table(spark, d, "documents"), table(spark, d, "labels"))


def topical(rows: DataFrame) -> DataFrame:
    """Rows without a topic are of the topic "general"."""
    return rows.withColumn("topic", F.coalesce("topic", F.lit("general")))


def scored_docs(spark: SparkSession, d: str) -> DataFrame:
    return quality.scored(docs(spark, d))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def bench(spark: SparkSession, d: str) -> DataFrame:
    return benchmark_items(table(spark, d, "benchmark"))


def convs(spark: SparkSession, d: str) -> DataFrame:
    return conversation_examples(table(spark, d, "conversations")).withColumnRenamed("conv_id", "id")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return decon.evidence(texts(spark, d), bench(spark, d))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return decon.verdicts(texts(spark, d), evidence(spark, d))


# ---- SQL parts


def norm(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({x}), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g')"


def toks(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({x}, ''), '\s+'), lambda w: w <> '')"


def pairnorm(x: str) -> str:
    return f"array_to_string({toks(f'lower({x})')}, ' ')"


def nwords(x: str) -> str:
    return f"len({toks(x)})"


def gram_rows(source: str, key: str, words_: str, n: int) -> str:
    """SQL for (key, gram) rows, by neighbours in order: linear in the words."""
    parts = " || ' ' || ".join(["w", *(f"lead(w, {i}) OVER o" for i in range(1, n))])
    return f"""SELECT DISTINCT {key}, gram FROM (
    SELECT {key}, {parts} AS gram FROM (SELECT {key}, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT {key}, {words_} AS w FROM {source}))
    WINDOW o AS (PARTITION BY {key} ORDER BY i)) WHERE gram IS NOT NULL"""


def any_of(x: str, marks) -> str:
    return "(" + " OR ".join("contains(" + x + ", '" + m.replace("'", "''") + "')" for m in marks) + ")"


EX_DOC = """
ex_doc AS (
  SELECT d.doc_id AS id, split_part(coalesce(text, ''), chr(10), 1) AS "user", coalesce(text, '') AS assistant, source AS topic, lang,
         CASE quality WHEN 1 THEN 9.0::DOUBLE WHEN 0 THEN 6.0 ELSE 5.0 END AS overall, coalesce(toxic = 1, false) AS toxic
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

EX_CONV = """
ex_conv AS (
  SELECT conv_id AS id, coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS "user",
         coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant'), '') AS assistant
  FROM conversations GROUP BY conv_id)"""

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
ISSUES = f"""list_filter([
  CASE WHEN {nwords('"user"')} < 3 THEN 'user_too_short' END,
  CASE WHEN {nwords('assistant')} < 12 THEN 'assistant_too_short' END,
  CASE WHEN {nwords('assistant')} > 450 THEN 'assistant_too_long' END,
  CASE WHEN {_STRIP.format('"user"')} = {_STRIP.format('assistant')} THEN 'answer_copies_prompt' END,
  CASE WHEN {any_of('lower(assistant)', classify.PLACEHOLDERS)} THEN 'placeholder_content' END,
  CASE WHEN {any_of('lower(assistant)', classify.WEAK)} THEN 'weak_answer' END], lambda x: x IS NOT NULL)"""
PENALTY = "list_sum([CASE x " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in classify.PENALTIES.items()) + " ELSE 0.5 END::DOUBLE for x in issues])"

SCORED = f"""{EX_DOC},
ruled AS (SELECT *, {ISSUES} AS issues FROM ex_doc),
scored AS (
  SELECT *, greatest(1.0, overall - coalesce({PENALTY}, 0)) AS quality_score,
         list_sort(list_distinct(list_concat(issues, CASE WHEN toxic THEN ['toxic_content'] ELSE [] END))) AS quality_issues
  FROM ruled)"""

DIFFICULTY = f"""CASE WHEN {nwords('"user"')} <= 8 AND {nwords('assistant')} <= 40 AND quality_score < 7.5 THEN 'easy'
  WHEN {nwords('"user"')} >= 20 OR {nwords('assistant')} >= 120 OR quality_score >= 8.5 THEN 'hard' ELSE 'medium' END"""
COMPLEXITY = f"""CASE WHEN {nwords('"user"')} + {nwords('assistant')} >= 80 OR {nwords('"user"')} >= 22 OR {nwords('assistant')} >= 55 THEN 'hard'
  WHEN {nwords('"user"')} + {nwords('assistant')} >= 35 OR {nwords('"user"')} >= 10 OR {nwords('assistant')} >= 24 THEN 'medium' ELSE 'easy' END"""
STYLE_A = f"""CASE WHEN {any_of('lower(assistant)', classify.STEPS)} THEN 'procedural'
  WHEN {nwords('assistant')} >= 50 OR length(assistant) - length(replace(assistant, '.', '')) >= 3 THEN 'detailed' ELSE 'concise' END"""
STYLE_B = f"""CASE WHEN {any_of('lower(assistant)', classify.NUMBERED)} THEN 'procedural' WHEN {nwords('assistant')} <= 25 THEN 'concise'
  WHEN {any_of('lower(assistant)', classify.EMPATHETIC)} THEN 'empathetic' WHEN {nwords('assistant')} >= 90 THEN 'detailed' ELSE 'balanced' END"""

DECON = f"""
items AS (SELECT 'b' || (item_id % 5) AS benchmark, item_id AS item_index, {norm('text')} AS n FROM benchmark),
norms AS (SELECT doc_id AS id, {norm('text')} AS n FROM documents),
igrams AS (
  SELECT *, count(*) OVER (PARTITION BY benchmark, item_index) AS item_grams
  FROM ({gram_rows('items', 'benchmark, item_index', toks('n'), 5)})),
dgrams AS ({gram_rows('norms', 'id', toks('n'), 5)}),
hits AS (
  SELECT id, benchmark, item_index, item_grams, count(*) AS overlap FROM dgrams JOIN igrams USING (gram)
  GROUP BY ALL HAVING count(*) / item_grams >= 0.85),
firsts AS (
  SELECT id, benchmark, min(item_index) AS item_index, arg_min(overlap / item_grams, item_index) AS confidence
  FROM hits GROUP BY id, benchmark),
exacts AS (
  SELECT id, benchmark, min(item_index) AS item_index FROM norms JOIN items ON trim(items.n) <> '' AND md5(norms.n) = md5(items.n) GROUP BY id, benchmark),
subs AS (
  SELECT id, benchmark, min(item_index) AS item_index FROM norms JOIN items ON trim(items.n) <> '' AND contains(norms.n, items.n)
  GROUP BY id, benchmark),
ev AS (
  SELECT id, benchmark, item_index, 'exact' AS method, 1.0::DOUBLE AS confidence FROM exacts
  UNION ALL SELECT id, benchmark, item_index, 'ngram', confidence FROM firsts ANTI JOIN exacts USING (id, benchmark)
  UNION ALL SELECT id, benchmark, item_index, 'substring', 0.99 FROM subs ANTI JOIN exacts USING (id, benchmark) ANTI JOIN firsts USING (id, benchmark))"""

VERDICT = f"""{DECON},
per AS (
  SELECT id, benchmark, count(DISTINCT method) AS methods, bool_or(method IN ('exact', 'ngram')) AS hard,
         bool_or(method IN ('substring', 'embedding') AND confidence >= 0.92) AS review, max(confidence) AS confidence FROM ev GROUP BY id, benchmark),
pid AS (
  SELECT id, bool_or(hard OR methods > 1) AS block, bool_or(review) AS review, max(confidence) AS confidence,
         string_agg(benchmark, ',' ORDER BY benchmark) AS flags FROM per GROUP BY id),
verdicts AS (
  SELECT id, CASE WHEN block THEN 'block' WHEN review THEN 'review' ELSE 'clean' END AS verdict,
         coalesce(round(confidence, 4), 0.0) AS confidence, coalesce(flags, '') AS flags
  FROM norms LEFT JOIN pid USING (id))"""


def _r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- decontamination


@query(f"WITH {DECON} SELECT id, benchmark, item_index, item_grams::INT AS item_grams, overlap FROM hits")
def decon_ngram_hits(spark, d):
    return decon.ngram_hits(texts(spark, d), bench(spark, d)).select("id", "benchmark", "item_index", "item_grams", "overlap")


@query(f"WITH {DECON} SELECT id, benchmark, item_index, round(confidence, 6) AS confidence FROM firsts")
def decon_ngram_first_match(spark, d):
    return decon.first_matches(decon.ngram_hits(texts(spark, d), bench(spark, d))).withColumn("confidence", _r("confidence"))


@query(f"WITH {DECON} SELECT id, benchmark, item_index FROM subs")
def decon_substring(spark, d):
    return decon.substring_hits(texts(spark, d), bench(spark, d)).groupBy("id", "benchmark").agg(F.min("item_index").alias("item_index"))


@query(f"WITH {DECON} SELECT id, benchmark, item_index FROM ev WHERE method = 'substring'")
def decon_substring_only(spark, d):
    return evidence(spark, d).where(F.col("method") == "substring").select("id", "benchmark", "item_index")


@query(f"""WITH {DECON.replace('FROM documents)', "FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark))")}
SELECT id, benchmark, item_index FROM exacts""")
def decon_exact_hash(spark, d):
    planted = table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("id"), "text")
    return decon.exact_hits(texts(spark, d).union(planted), bench(spark, d))


@query(f"WITH {DECON} SELECT id, benchmark, item_index, method, round(confidence, 6) AS confidence FROM ev")
def decon_evidence(spark, d):
    return evidence(spark, d).withColumn("confidence", _r("confidence"))


@query(f"WITH {VERDICT} SELECT id, verdict, round(confidence, 6) AS confidence, flags FROM verdicts")
def decon_verdict(spark, d):
    return verdicts(spark, d).select("id", "verdict", _r("confidence"), F.array_join("flags", ",").alias("flags"))


@query(f"WITH {VERDICT} SELECT id FROM verdicts WHERE verdict <> 'block'")
def decon_clean_filter(spark, d):
    return decon.without_contaminated(verdicts(spark, d)).select("id")


@query(f"""WITH {VERDICT}, flagged AS (SELECT ev.* FROM ev)
SELECT 'verdict' AS kind, verdict AS name, count(*) AS n FROM verdicts GROUP BY verdict
UNION ALL SELECT 'method', method, count(*) FROM flagged GROUP BY method
UNION ALL SELECT 'benchmark_method', benchmark || ':' || method, count(*) FROM flagged GROUP BY 2""")
def decon_rollup(spark, d):
    found = evidence(spark, d)
    return quality.contamination_rollup(decon.verdicts(texts(spark, d), found), found)


@query(f"WITH {DECON} SELECT id, benchmark, item_index, method FROM ev ORDER BY id, benchmark, method, item_index LIMIT 10")
def decon_evidence_samples(spark, d):
    return quality.evidence_samples(evidence(spark, d)).select("id", "benchmark", "item_index", "method")


@query(f"WITH {DECON} SELECT benchmark, count(DISTINCT id) AS n FROM ev GROUP BY benchmark")
def decon_flag_counts(spark, d):
    return evidence(spark, d).groupBy("benchmark").agg(F.count_distinct("id").alias("n"))


VECTORS = """
q AS (SELECT vec_id AS id, [x::DOUBLE for x in embedding] AS q FROM embeddings WHERE vec_id % 100 = 0),
b AS (SELECT vec_id AS item_index, [x::DOUBLE for x in embedding] AS b FROM embeddings),
sims AS (SELECT id, item_index, list_dot_product(q, b) AS similarity FROM q, b WHERE id <> item_index),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, item_index DESC) AS match_rank FROM sims)
"""


def vectors(spark, d, name="id"):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias(name), "embedding")


def searched(spark, d):
    """Every vector whose id is divisible by 100, to be looked for among all others."""
    return vectors(spark, d).where(F.col("id") % 100 == 0), vectors(spark, d, "item_index")


@query(f"WITH {VECTORS} SELECT id, item_index, round(similarity, 6) AS similarity, match_rank::INT AS match_rank FROM ranked WHERE match_rank <= 3")
def embed_topk(spark, d):
    return decon.vector_top_k(*searched(spark, d), others=True).withColumn("similarity", _r("similarity"))


@query(f"WITH {VECTORS} SELECT count(*) FILTER (WHERE similarity >= 0.88) / count(*) AS semantic_overlap FROM ranked WHERE match_rank = 1")
def embed_semantic_overlap(spark, d):
    return reference.semantic_overlap(*searched(spark, d), others=True)


VECTOR_EVIDENCE = """
q AS (SELECT vec_id AS id, [x::DOUBLE for x in embedding] AS q FROM embeddings WHERE vec_id % 100 <> 0),
b AS (SELECT 'b' || (vec_id // 100 % 3) AS benchmark, vec_id AS item_index, [x::DOUBLE for x in embedding] AS b FROM embeddings WHERE vec_id % 100 = 0),
sims AS (SELECT id, benchmark, item_index, list_dot_product(q, b) AS similarity FROM q, b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, benchmark DESC, item_index DESC) AS match_rank FROM sims),
ev AS (SELECT id, benchmark, item_index, 'embedding' AS method, round(similarity, 4) AS confidence, match_rank FROM ranked WHERE match_rank <= 3 AND similarity >= 0.3)"""


def contaminated(spark, d):
    """Vectors of examples, and those whose id is divisible by 100 as three benchmarks' items."""
    v = table(spark, d, "embeddings")
    items = v.where(F.col("vec_id") % 100 == 0).select(F.concat(F.lit("b"), F.floor(F.col("vec_id") / 100) % 3).alias("benchmark"), F.col("vec_id").alias("item_index"), "embedding")
    return v.where(F.col("vec_id") % 100 != 0).select(F.col("vec_id").alias("id"), "embedding"), items


@query(f"WITH {VECTOR_EVIDENCE} SELECT id, benchmark, item_index, confidence, match_rank::INT AS match_rank FROM ev")
def decon_embedding_evidence(spark, d):
    """The test vectors are unrelated, so the threshold is lower than the usual one."""
    return decon.vector_evidence(*contaminated(spark, d), threshold=0.3).drop("method")


@query(f"""WITH {VECTOR_EVIDENCE}, pid AS (SELECT id, max(confidence) AS c, bool_or(confidence >= 0.4) AS review, string_agg(DISTINCT benchmark, ',' ORDER BY benchmark) AS flags FROM ev GROUP BY id)
SELECT id, CASE WHEN review THEN 'review' ELSE 'clean' END AS verdict, coalesce(c, 0.0) AS confidence, coalesce(flags, '') AS flags FROM q LEFT JOIN pid USING (id)""")
def decon_embedding_verdict(spark, d):
    """Review by vectors, with thresholds for the unrelated test vectors."""
    examples, items = contaminated(spark, d)
    found = decon.evidence(examples, items, "embedding", threshold=0.3, vectors=(examples, items))
    return decon.verdicts(examples, found, review_threshold=0.4).select("id", "verdict", "confidence", F.array_join("flags", ",").alias("flags"))


@query("""WITH v AS (SELECT unnest([x::DOUBLE for x in embedding]) AS x, unnest(range(1, len(embedding) + 1)) AS place FROM embeddings),
s AS (SELECT place, sum(x) AS s, sum(x * x) AS q FROM v GROUP BY place)
SELECT round(1 - (sum(s * s) - sum(q)) / 2 / ((SELECT count(*) FROM embeddings) * ((SELECT count(*) FROM embeddings) - 1) / 2), 6) AS embedding_diversity FROM s""")
def embed_mean_distance(spark, d):
    return diversity.mean_vector_distance(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")).select(_r("embedding_diversity"))


# ---- examples, rules, scores


@query(f'WITH {EX_CONV} SELECT id, "user", assistant FROM ex_conv')
def conv_pairs(spark, d):
    return convs(spark, d).select("id", "user", "assistant")


@query(f"WITH {EX_CONV}, r AS (SELECT id, {ISSUES} AS issues FROM ex_conv) SELECT id, array_to_string(issues, ',') AS issues, coalesce({PENALTY}, 0) AS penalty FROM r")
def rule_issues(spark, d):
    issues = classify.rule_issues(F.col("user"), F.col("assistant"))
    return convs(spark, d).withColumn("i", issues).select("id", F.array_join("i", ",").alias("issues"), classify.rule_penalty(F.col("i")).alias("penalty"))


@query(f"WITH {SCORED} SELECT id, quality_score, array_to_string(quality_issues, ',') AS issues FROM scored")
def score_merge(spark, d):
    return scored_docs(spark, d).select("id", "quality_score", F.array_join("quality_issues", ",").alias("issues"))


@query(f"WITH {SCORED} SELECT id FROM scored WHERE quality_score >= {MIN_SCORE}")
def quality_filter(spark, d):
    return quality.at_least(scored_docs(spark, d), MIN_SCORE).select("id")


@query(f"WITH {SCORED} SELECT floor(quality_score)::INT || '-' || (floor(quality_score)::INT + 1) AS bucket, count(*) AS n FROM scored GROUP BY 1")
def score_histogram(spark, d):
    return quality.score_histogram(scored_docs(spark, d))


@query(f"""WITH {SCORED}, {DECON.lstrip()},
s AS (SELECT count(*) AS total, count(*) FILTER (WHERE quality_score >= {MIN_SCORE}) AS passed, avg(quality_score) AS a, avg({nwords('"user"')}) AS u, avg({nwords('assistant')}) AS w FROM scored),
h AS (SELECT count(DISTINCT id) AS hits FROM ev)
SELECT total, passed, total - passed AS failed, round(a, 6) AS avg_score, round(u, 6) AS avg_user_length, round(w, 6) AS avg_assistant_length,
       round(passed / greatest(total, 1), 6) AS pass_rate, hits, (passed = total AND a >= 7.5 AND hits = 0 AND total > 0) AS usable FROM s, h""")
def pass_fail_summary(spark, d):
    hits = evidence(spark, d).agg(F.count_distinct("id").alias("hits"))
    one = quality.usable_gate(quality.pass_rate(quality.summary(scored_docs(spark, d), MIN_SCORE)).join(hits))
    return one.select("total", "passed", "failed", _r("avg_score"), _r("avg_user_length"), _r("avg_assistant_length"), _r("pass_rate"), "hits", "usable")


@query(f"WITH {SCORED} SELECT {DIFFICULTY} AS difficulty, count(*) AS n FROM scored GROUP BY 1")
def difficulty_counts(spark, d):
    return quality.difficulty_counts(scored_docs(spark, d))


@query(f"""WITH {SCORED}, g AS (SELECT coalesce(topic, 'unknown') AS topic, {DIFFICULTY} AS x FROM scored)
SELECT topic, count(*) FILTER (WHERE x = 'easy') AS easy, count(*) FILTER (WHERE x = 'medium') AS medium, count(*) FILTER (WHERE x = 'hard') AS hard FROM g GROUP BY topic""")
def topic_heatmap(spark, d):
    return quality.topic_heatmap(scored_docs(spark, d))


@query("SELECT coalesce(source, 'unknown') AS topic, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, min(doc_id) LIMIT 20")
def topic_topk(spark, d):
    return quality.topic_counts(document_examples(table(spark, d, "documents"))).select("topic", "n")


@query(f"WITH {SCORED} SELECT unnest(quality_issues) AS issue, count(*) AS n FROM scored GROUP BY 1")
def issue_counts(spark, d):
    return quality.issue_counts(scored_docs(spark, d))


@query(f"""WITH {EX_DOC}, g AS (SELECT count(*) AS n FROM ex_doc GROUP BY {pairnorm('"user"')}, {pairnorm('assistant')} HAVING count(*) > 1)
SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS members FROM g""")
def duplicate_groups(spark, d):
    return quality.duplicate_stats(document_examples(table(spark, d, "documents")))


@query(f"""WITH {EX_DOC} SELECT min(id) AS id FROM ex_doc GROUP BY {pairnorm('"user"')}, {pairnorm('assistant')}""")
def first_wins_dedup(spark, d):
    return selection.first_of_pairs(document_examples(table(spark, d, "documents")))


@query(f"""WITH {EX_DOC}, k AS (SELECT id, lang, topic, {pairnorm('"user"')} AS u, {pairnorm('assistant')} AS a FROM ex_doc),
c AS (SELECT min(id) AS id, u, a FROM k WHERE topic <> 'src0' GROUP BY u, a)
SELECT id FROM c ANTI JOIN (SELECT u, a FROM k WHERE topic = 'src0') s USING (u, a)""")
def seed_antijoin(spark, d):
    rows = document_examples(table(spark, d, "documents"))
    return selection.new_pairs(rows.where(F.col("topic") != "src0"), rows.where(F.col("topic") == "src0")).select("id")


@query(f"""WITH w AS (SELECT unnest({toks('lower(text)')}) AS w FROM documents)
SELECT count(DISTINCT w) AS "distinct", count(*) AS total, round(count(DISTINCT w) / greatest(count(*), 1), 6) AS lexical_diversity FROM w""")
def lexical_diversity(spark, d):
    one = diversity.lexical_diversity(document_examples(table(spark, d, "documents")))
    return one.select("distinct", "total", _r("lexical_diversity"))


@query(f"""WITH d AS (SELECT * FROM documents ORDER BY doc_id LIMIT 50),
g AS ({gram_rows('d', 'doc_id', toks('lower(text)'), 3)}),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT coalesce(sum(i / (a.n + b.n - i)), 0) AS likeness FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y),
e AS (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM n) AS e FROM d)
SELECT round(1 - likeness / ((n * (n - 1) - e * (e - 1)) / 2), 6) AS diversity FROM l, e""")
def pairwise_diversity(spark, d):
    """The sample is the feature: the first 50 rows, here by id so that SQL can say it."""
    rows = diversity.sample(document_examples(table(spark, d, "documents")), 50, None)
    return diversity.mean_gram_distance(rows).select(_r("diversity"))


@query(f"""WITH {SCORED} SELECT id, topic, round(avg(quality_score) OVER (PARTITION BY topic ORDER BY id ROWS UNBOUNDED PRECEDING), 6) AS average_so_far FROM scored""")
def progress_average(spark, d):
    return quality.running_average(scored_docs(spark, d), "topic").select("id", "topic", _r("average_so_far"))


# ---- classifiers


@query(f"WITH {EX_CONV} SELECT id, {COMPLEXITY} AS complexity, {STYLE_A} AS planner_style, {STYLE_B} AS evaluator_style FROM ex_conv")
def styles_complexity(spark, d):
    u, a = F.col("user"), F.col("assistant")
    return convs(spark, d).select("id", classify.complexity(u, a).alias("complexity"), classify.planner_style(a).alias("planner_style"), classify.evaluator_style(a).alias("evaluator_style"))


@query(
    f"""WITH {EX_CONV}, t AS (SELECT id, lower("user" || ' ' || assistant) AS x FROM ex_conv)
SELECT id, CASE {" ".join(f"WHEN {any_of('x', marks)} THEN '{name}'" for name, marks in classify.TOPIC_WORDS.items())} ELSE 'general' END AS topic FROM t"""
)
def topic_inference(spark, d):
    return convs(spark, d).select("id", classify.topic(F.col("user"), F.col("assistant")).alias("topic"))


@query(f"""WITH {EX_CONV}, t AS (SELECT id, {pairnorm('assistant')} AS x FROM ex_conv)
SELECT id, round(least(1.0, ({" + ".join(f"contains(x, '{m}')::INT" for m in classify.EMPATHY_MARKERS)}) / 3), 6) AS empathy FROM t""")
def empathy_scores(spark, d):
    return convs(spark, d).select("id", F.round(classify.empathy(F.col("assistant")), 6).alias("empathy"))


# ---- distributions and comparison


@query(f"""WITH {EX_DOC}, a AS (SELECT lang AS key, count(*) AS n FROM ex_doc WHERE topic = 'src0' GROUP BY 1), b AS (SELECT lang AS key, count(*) AS n FROM ex_doc WHERE topic <> 'src0' GROUP BY 1),
t AS (SELECT (SELECT sum(n) FROM a) AS ta, (SELECT sum(n) FROM b) AS tb)
SELECT round(coalesce(sum(abs(coalesce(a.n / ta, 0) - coalesce(b.n / tb, 0))) / 2, 0), 6) AS tvd FROM a FULL JOIN b USING (key), t""")
def language_tvd(spark, d):
    rows = document_examples(table(spark, d, "documents"))
    side = lambda test: distribution.counts_by(rows.where(test), F.col("lang"))
    return distribution.total_variation(side(F.col("topic") == "src0"), side(F.col("topic") != "src0")).select(_r("tvd"))


@query(f"""WITH {EX_DOC}, c AS (SELECT id, topic, {COMPLEXITY} AS complexity, {STYLE_A} AS style FROM (SELECT * REPLACE (coalesce(topic, 'general') AS topic) FROM ex_doc))
SELECT trim(regexp_replace(lower(topic), '[^a-z0-9]+', '_', 'g'), '_') || '__c0__' || complexity || '__' || style AS cluster_id, count(*) AS seed_count FROM c GROUP BY 1""")
def cluster_distribution(spark, d):
    rows = topical(document_examples(table(spark, d, "documents")))
    return planning.seed_profile(planning.with_cluster(rows)).select("cluster_id", "seed_count")


def sides(spark, d):
    """English documents against the others, those of no known language among them."""
    rows = scored_docs(spark, d)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    return rows.where(english), rows.where(~english)


@query(f"""WITH {EX_DOC}, k AS (SELECT id, topic, {pairnorm('"user"')} AS u, {pairnorm('assistant')} AS a FROM ex_doc)
SELECT id FROM k SEMI JOIN (SELECT u, a FROM k WHERE topic = 'src1') r USING (u, a) WHERE topic IS DISTINCT FROM 'src1'""")
def reference_overlap_exact(spark, d):
    rows = topical(document_examples(table(spark, d, "documents")))
    return reference.exact_overlap(rows.where(F.col("topic") != "src1"), rows.where(F.col("topic") == "src1"))


@query(f"""WITH {EX_DOC}, k AS (SELECT id, topic, {toks('lower(assistant)')} AS w FROM ex_doc),
g AS (SELECT id, topic, array_to_string(w, ' ') AS gram FROM k WHERE len(w) BETWEEN 1 AND 2
      UNION ALL {gram_rows('k', 'id, topic', 'w', 3)}),
f AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM g),
p AS (SELECT a.id, a.n, b.id AS id2, b.n AS m, count(*) AS i FROM f a JOIN f b USING (gram)
      WHERE a.topic IS DISTINCT FROM 'src1' AND b.topic = 'src1' AND least(a.n, b.n) >= 0.75 * greatest(a.n, b.n) GROUP BY ALL),
best AS (SELECT id, max(i / (n + m - i)) AS likeness FROM p GROUP BY id)
SELECT id, round(likeness, 6) AS likeness FROM best WHERE likeness >= 0.75""")
def reference_overlap_near(spark, d):
    rows = topical(document_examples(table(spark, d, "documents")))
    return reference.near_overlap(rows.where(F.col("topic") != "src1"), rows.where(F.col("topic") == "src1")).select("id", _r("likeness"))


_DIST = "(SELECT coalesce(sum(abs(coalesce(a.n / ta, 0) - coalesce(b.n / tb, 0))) / 2, 0) FROM (SELECT {0} AS key, count(*) AS n FROM gen GROUP BY 1) a FULL JOIN (SELECT {0} AS key, count(*) AS n FROM ref GROUP BY 1) b USING (key), t)"


@query(f"""WITH {SCORED}, gen AS (SELECT * FROM scored WHERE lang = 'en'), ref AS (SELECT * FROM scored WHERE lang IS DISTINCT FROM 'en'),
t AS (SELECT (SELECT count(*) FROM gen) AS ta, (SELECT count(*) FROM ref) AS tb),
gt AS (SELECT coalesce(topic, 'unknown') AS topic FROM gen GROUP BY 1 ORDER BY count(*) DESC, min(id) LIMIT 20),
rt AS (SELECT coalesce(topic, 'unknown') AS topic FROM ref GROUP BY 1 ORDER BY count(*) DESC, min(id) LIMIT 20),
m AS (SELECT {_DIST.format(STYLE_B)} AS sd, {_DIST.format("coalesce(topic, 'unknown')")} AS cd, {_DIST.format(DIFFICULTY)} AS dd,
  (SELECT count(*) FROM gt SEMI JOIN rt USING (topic)) / greatest((SELECT count(*) FROM rt), 1) AS ov,
  (SELECT count(*) FROM gt ANTI JOIN rt USING (topic)) / greatest((SELECT count(*) FROM gt), 1) AS nov,
  (SELECT count(*) FROM (SELECT {pairnorm('"user"')} AS u, {pairnorm('assistant')} AS a FROM gen) g SEMI JOIN (SELECT {pairnorm('"user"')} AS u, {pairnorm('assistant')} AS a FROM ref) r USING (u, a))
    / greatest((SELECT count(*) FROM gen), 1) AS ex)
SELECT round(sd, 6) AS style_distance, round(cd, 6) AS cluster_distance, round(dd, 6) AS difficulty_distance, round(ov, 6) AS topic_overlap, round(nov, 6) AS topic_novelty,
  round(ex, 6) AS exact_overlap, round(100 * greatest(0, 1 - least(1, .23 * sd + .23 * cd + .18 * dd + .18 * (1 - ov) + .10 * nov + .08 * ex)), 4) AS alignment_score FROM m""")
def reference_alignment(spark, d):
    one = reference.alignment(*sides(spark, d))
    return one.select(*[_r(c) for c in ("style_distance", "cluster_distance", "difficulty_distance", "topic_overlap", "topic_novelty", "exact_overlap")], _r("alignment_score", 4))


@query(f"""WITH {SCORED}, s AS (SELECT lang = 'en' AS g, avg(quality_score) AS a, count(*) FILTER (WHERE quality_score >= 7.5) / count(*) AS p FROM scored GROUP BY 1)
SELECT round(x.a - y.a, 4) AS avg_score_delta, round(x.p - y.p, 4) AS pass_rate_delta FROM s x, s y WHERE x.g AND NOT y.g""")
def baseline_comparison(spark, d):
    gen, ref = (quality.pass_rate(quality.summary(rows)) for rows in sides(spark, d))
    return reference.baseline_deltas(gen, ref, ["avg_score", "pass_rate"])


# ---- evaluation


def turn_pairs(spark, d):
    """The second turn of a conversation as a prediction of its first answer, by place."""
    c = table(spark, d, "conversations").where(F.col("role") == "assistant")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text"), convs(spark, d).select(F.col("id").alias("ord"), "assistant", (F.col("id") % 3).cast("string").alias("topic"))


F1 = f"""
WITH {EX_CONV},
p AS (SELECT row_number() OVER (ORDER BY conv_id * 1000 + turn) AS place, text AS p FROM conversations WHERE role = 'assistant'),
h AS (SELECT row_number() OVER (ORDER BY id) AS place, id, assistant AS h, (id % 3)::VARCHAR AS topic FROM ex_conv),
z AS (SELECT place, id, topic, p AS prediction, {toks(pairnorm('p'))} AS p, {toks(pairnorm('h'))} AS h, {nwords('p')} AS np, {nwords('h')} AS nh FROM p JOIN h USING (place)),
sh AS (SELECT *, coalesce(list_sum([least(len(list_filter(p, lambda w: w = x)), len(list_filter(h, lambda w: w = x))) for x in list_distinct(p)]), 0) AS s FROM z),
f AS (SELECT *, CASE WHEN s > 0 THEN 2.0::DOUBLE * s / (len(p) + len(h)) ELSE 0 END AS f1, least(np / greatest(nh, 1), nh / greatest(np, 1)) AS ratio FROM sh),
m AS (SELECT *, CASE WHEN f1 >= .6 THEN 1.0 WHEN f1 >= .4 THEN .5 ELSE 0.0 END AS success, (f1 >= .45 AND ratio >= .55)::INT AS passed FROM f)
"""


def _scored_pairs(spark, d):
    pairs = evaluation.positional(*turn_pairs(spark, d))
    return evaluation.prediction_scores(pairs, "p_text", "h_assistant", "h_topic")


@query(F1 + "SELECT place::BIGINT AS place, id, round(f1, 6) AS f1, round(ratio, 6) AS ratio, success::DOUBLE AS success, passed FROM m")
def token_f1(spark, d):
    return _scored_pairs(spark, d).select(F.col("place").cast("bigint").alias("place"), F.col("h_ord").alias("id"), _r("f1"), _r("ratio"), "success", "passed")


@query(F1 + """SELECT topic, count(*) AS n, round(avg(f1), 6) AS avg_f1, round(avg(success), 6) AS avg_success, round(avg(passed), 6) AS avg_passed FROM m GROUP BY topic
UNION ALL SELECT 'all topics', count(*), round(avg(f1), 6), round(avg(success), 6), round(avg(passed), 6) FROM m""")
def holdout_metrics(spark, d):
    return evaluation.holdout_metrics(_scored_pairs(spark, d)).select("topic", "n", _r("avg_f1"), _r("avg_success"), _r("avg_passed"))


@query("SELECT count(*) AS n, round(corr(quality::DOUBLE, n_chars::DOUBLE), 6) AS correlation FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL")
def metric_correlation(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return evaluation.correlation(rows, "quality", "n_chars").select("n", _r("correlation"))


@query(f"""WITH {SCORED}, m AS (SELECT topic AS model, avg(quality_score) AS q, count(*) FILTER (WHERE quality_score >= 7.5) / count(*) AS p, avg({nwords('assistant')}) AS s FROM scored WHERE topic IS NOT NULL GROUP BY 1),
x AS (SELECT model, q, p, s, min(q) OVER () AS q0, max(q) OVER () AS q1, min(p) OVER () AS p0, max(p) OVER () AS p1, min(s) OVER () AS s0, max(s) OVER () AS s1 FROM m)
SELECT model, round(.5 * CASE WHEN q1 - q0 < 1e-9 THEN 1 ELSE (q - q0) / (q1 - q0) END + .35 * CASE WHEN p1 - p0 < 1e-9 THEN 1 ELSE (p - p0) / (p1 - p0) END
  + .15 * CASE WHEN s1 - s0 < 1e-9 THEN 1 ELSE (s - s0) / (s1 - s0) END, 4) AS composite FROM x""")
def model_ranking(spark, d):
    rows = scored_docs(spark, d).where(F.col("topic").isNotNull()).groupBy(F.col("topic").alias("model")).agg(
        F.avg("quality_score").alias("avg_quality_score"), (F.count_if(F.col("quality_score") >= MIN_SCORE) / F.count(F.lit(1))).alias("pass_rate"), F.avg(text.word_count(F.col("assistant"))).alias("examples_per_second")
    )
    return ranking.ranked_models(rows.withColumn("status", F.lit("ok"))).select("model", "composite")


# ---- planning

CLUSTERS = f"""{EX_DOC},
k AS (
  SELECT id, overall, topic, "user", assistant, {COMPLEXITY} AS complexity, {STYLE_A} AS style,
         trim(regexp_replace(lower(topic), '[^a-z0-9]+', '_', 'g'), '_') || '__c0__' || {COMPLEXITY} || '__' || {STYLE_A} AS cluster_id
  FROM (SELECT * REPLACE (coalesce(topic, 'general') AS topic) FROM ex_doc)),
prof AS (SELECT cluster_id, min(topic) AS topic, min(complexity) AS difficulty, min(style) AS style, count(*) AS seed_count FROM k GROUP BY 1),
wished AS (
  SELECT *, (SELECT 2 * count(*) FROM k) AS b, count(*) OVER () AS clusters, row_number() OVER (ORDER BY seed_count DESC, cluster_id) AS place,
         greatest(1, round_even((SELECT 2 * count(*) FROM k) * seed_count / sum(seed_count) OVER (), 0))::BIGINT AS wish FROM prof),
filled AS (
  SELECT *, least(b, sum(wish) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING)) AS upto,
         least(b, coalesce(sum(wish) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM wished),
clusters AS (SELECT cluster_id, topic, difficulty, style, seed_count, (CASE WHEN place = clusters THEN b ELSE upto END - before)::BIGINT AS target_examples FROM filled),
acc AS (SELECT cluster_id, count(*) AS n FROM k WHERE overall = 9 GROUP BY 1),
st AS (
  SELECT c.*, coalesce(n, 0) AS accepted, greatest(target_examples - coalesce(n, 0), 0) AS gap, greatest(target_examples, 1) AS floor_target
  FROM clusters c LEFT JOIN acc USING (cluster_id)),
sem AS (SELECT sum(target_examples) AS target, sum(accepted) AS generated, greatest(sum(target_examples) - sum(accepted), 0) AS sgap FROM st)"""

GRAPH = rf"""{CLUSTERS},
texts AS (SELECT cluster_id, "user" || ' ' || assistant AS x FROM k UNION ALL SELECT cluster_id, topic || ' ' || style || ' ' || difficulty FROM clusters),
tok AS (SELECT DISTINCT cluster_id, t FROM (SELECT cluster_id, unnest(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}_]+')) AS t FROM texts)),
vec AS (
  SELECT cluster_id, list(length(t)::DOUBLE ORDER BY t) AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY t) AS i FROM tok) WHERE i <= 24 GROUP BY 1),
duo AS (
  SELECT a.cluster_id AS src, b.cluster_id AS dst, a.v[:least(len(a.v), len(b.v))] AS x, b.v[:least(len(a.v), len(b.v))] AS y
  FROM vec a, vec b WHERE a.cluster_id <> b.cluster_id),
sim AS (
  SELECT src, dst, round(greatest(0, least(1, list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))))), 4) AS similarity FROM duo),
edges AS (
  SELECT * FROM (SELECT *, round(1 - similarity, 4) AS distance, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM sim) WHERE rank <= 3)"""

PRIORITY = f"""{GRAPH},
fr AS (SELECT src AS cluster_id, sum(similarity * (gap / floor_target)) AS frontier FROM edges JOIN st ON dst = st.cluster_id GROUP BY 1),
med AS (SELECT list_sort(list(seed_count))[count(*) // 2 + 1] AS m FROM clusters),
pr AS (
  SELECT st.*, sgap, sgap / greatest(target, 1) AS ratio, 0.6::DOUBLE * coalesce(frontier, 0) AS pull, accepted / floor_target AS full_,
         CASE WHEN seed_count <= greatest(1, m) THEN 0.35::DOUBLE ELSE 0 END AS tail
  FROM st LEFT JOIN fr USING (cluster_id), sem, med WHERE gap > 0),
scored_pr AS (
  SELECT *, round(gap + ratio + pull + tail - greatest(0, full_ - 1.05::DOUBLE) * 2, 4) AS priority,
         CASE WHEN sgap > 0 AND gap > 0 AND full_ < 1.05::DOUBLE THEN least(2, greatest(0, round_even(ratio * 3 + pull + tail, 0)::INT)) ELSE 0 END AS bonus FROM pr),
best AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY priority DESC, target_examples DESC, cluster_id) AS place FROM scored_pr) WHERE place <= 12)"""

STATUS = f"""{GRAPH},
tv AS (
  SELECT sum(abs(target_examples / (SELECT sum(target_examples) FROM clusters) - accepted / greatest((SELECT sum(n) FROM acc), 1))) / 2 AS tvd,
         sum(gap) / sum(target_examples) AS gap_ratio, count(*) FILTER (WHERE n / floor_target > 1.05::DOUBLE) AS oversaturated
  FROM st LEFT JOIN acc USING (cluster_id)),
direct AS (SELECT cluster_id, target_examples, least(1.0::DOUBLE, accepted / floor_target) AS own FROM st),
near AS (SELECT src AS cluster_id, max(similarity * own) AS near FROM edges JOIN direct ON dst = direct.cluster_id GROUP BY 1),
cover AS (
  SELECT round(sum(least(1.0::DOUBLE, 0.8::DOUBLE * own + 0.2::DOUBLE * coalesce(near, 0)) * target_examples) / sum(target_examples), 4) AS graph_coverage
  FROM direct LEFT JOIN near USING (cluster_id) WHERE target_examples > 0),
parts AS (
  SELECT round(tvd, 4) AS divergence, round(gap_ratio, 4) AS gap_ratio, round(least(target, generated) / target, 4) AS semantic_coverage, graph_coverage, oversaturated FROM tv, sem, cover)"""


def seed_rows(spark, d, tokens=True):
    """The documents' ids, clusters and, if asked for, tokens: each text is read and
    classified once, for all that a query makes of the clusters."""
    rows = planning.with_cluster(topical(document_examples(table(spark, d, "documents"))))
    rows = planning.with_tokens(rows) if tokens else rows
    return stored(rows.drop("user", "assistant", "lang"))


def _clusters(rows):
    """The plan asks for twice as many examples as there are seeds. A small table, read several times."""
    return stored(planning.with_targets(planning.seed_profile(rows), 2 * rows.count()))


def _edges(rows, clusters):
    return stored(planning.neighbor_edges(stored(planning.cluster_vectors(clusters, rows))))


def _accepted(spark, d, rows):
    """Rows of labelled quality stand for accepted ones."""
    good = table(spark, d, "labels").where(F.col("quality") == 1).select(F.col("doc_id").alias("id"))
    return stored(distribution.counts_by(rows.select("id", "cluster_id").join(good, "id"), F.col("cluster_id")))


def _planned(spark, d, rows=None):
    """Clusters, their edges and what is accepted, from one table of rows."""
    rows = seed_rows(spark, d) if rows is None else rows
    c = _clusters(rows)
    return c, _edges(rows, c), _accepted(spark, d, rows)


def _priorities(spark, d, rows=None):
    return planning.prioritized(*_planned(spark, d, rows))


@query(f"WITH {CLUSTERS} SELECT cluster_id, seed_count, target_examples FROM clusters")
def cluster_targets(spark, d):
    return _clusters(seed_rows(spark, d, tokens=False)).select("cluster_id", "seed_count", "target_examples")


@query(f"WITH {GRAPH} SELECT src, dst, similarity, distance, rank::INT AS rank FROM edges")
def graph_neighbors(spark, d):
    rows = seed_rows(spark, d)
    return _edges(rows, _clusters(rows))


@query(f"WITH {PRIORITY} SELECT cluster_id, gap, priority, bonus::INT AS bonus, place::INT AS place FROM best")
def cluster_priority(spark, d):
    return _priorities(spark, d).select("cluster_id", "gap", "priority", "bonus", "place")


@query(f"""WITH {PRIORITY}, slots AS (SELECT *, unnest(generate_series(1, greatest(1, gap + bonus))) AS slot FROM best)
SELECT cluster_id, topic, style, difficulty, slot::INT AS slot,
       CASE WHEN difficulty = 'hard' THEN 'expert' WHEN style = 'concise' THEN 'beginner' WHEN style = 'detailed' THEN 'skeptic' ELSE 'general' END AS persona FROM slots""")
def plan_slots(spark, d):
    return planning.plan_slots(planning.allocated(_priorities(spark, d)))


@query(f"""WITH {STATUS} SELECT *, round(100 * greatest(0, 1 - least(1, 0.5::DOUBLE * divergence + 0.3::DOUBLE * gap_ratio + 0.1::DOUBLE * (1 - semantic_coverage) + 0.1::DOUBLE * (1 - graph_coverage))), 2) AS match_score FROM parts""")
def distribution_status(spark, d):
    return distribution.status(*_planned(spark, d))


# ---- rewriting, selection, inspection

PHRASES = ["I will check this right away", "I am reviewing your order", "We can refund it within 2 business days", "Let me see if I can help right now", "I’ll ship it in 3 days"]


def _answers(spark, d):
    """Conversations whose answers begin with one of a few risky phrases, by id."""
    options = F.array(*[F.lit(p) for p in PHRASES])
    spoken = F.concat(F.get(options, (F.col("id") % len(PHRASES)).cast("int")), F.lit(". "), F.col("assistant"))
    return convs(spark, d).withColumn("assistant", spoken).withColumn("source", F.lit("generated")).withColumn("reviewed", F.lit(False))


_SQL_ANSWERS = f"""{EX_CONV}, ans AS (SELECT id, ([{", ".join("'" + p + "'" for p in PHRASES)}])[id % {len(PHRASES)} + 1] || '. ' || assistant AS a FROM ex_conv)"""
_RISK_SQL = " + ".join("len(regexp_extract_all(a, '(?i)" + p.replace("'", "''") + "'))" for p in rewrite.RISKS)


def _sql_patterns(x: str, rules) -> str:
    for p, to in rules:
        x = f"regexp_replace({x}, '(?i){p.replace(chr(39), chr(39) * 2)}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return x


def _sql_literals(x: str, rules) -> str:
    for old, new in rules:
        x = "replace(" + x + ", '" + old.replace("'", "''") + "', '" + new.replace("'", "''") + "')"
    return x


def _sql_soften(x: str) -> str:
    return _sql_literals(_sql_patterns(_sql_literals(_sql_patterns(x, rewrite.ACTIONS), rewrite.PHRASES), rewrite.TIMES), rewrite.AWKWARD)


@query(f"WITH {_SQL_ANSWERS} SELECT id, md5({_sql_soften('a')}) AS softened, ({_RISK_SQL})::INT AS risk FROM ans")
def soften_answers(spark, d):
    a = F.col("assistant")
    return _answers(spark, d).select("id", F.md5(rewrite.soften(a)).alias("softened"), rewrite.risk(a).alias("risk"))


@query(f"WITH {_SQL_ANSWERS} SELECT id, {_sql_literals(_sql_patterns(_sql_soften('a'), rewrite.TARGETED), rewrite.LAST)} AS reviewed FROM ans")
def review_answers(spark, d):
    return _answers(spark, d).select("id", rewrite.review(F.col("assistant")).alias("reviewed"))


@query(f"WITH {_SQL_ANSWERS}, r AS (SELECT id, ({_RISK_SQL})::INT AS risk FROM ans) SELECT id, risk FROM r WHERE risk > 0 ORDER BY risk DESC, id DESC LIMIT 20")
def risk_topn(spark, d):
    return selection.riskiest(_answers(spark, d), 20).select("id", "risk")


@query(f"""WITH {SCORED}, best AS (SELECT id FROM scored WHERE quality_score >= 7.5 ORDER BY quality_score DESC, id LIMIT 100)
SELECT id, CASE WHEN b THEN 'accepted' ELSE 'rejected' END AS bucket,
  CASE WHEN b THEN '' WHEN len(r) > 0 THEN array_to_string(r, ',') ELSE 'not_selected' END AS reasons
FROM (SELECT id, id IN (SELECT id FROM best) AS b,
             list_sort(list_distinct(list_concat(quality_issues, CASE WHEN quality_score < 7.5 THEN ['below_min_quality:7.5'] ELSE [] END))) AS r FROM scored)""")
def artifact_split(spark, d):
    rows = scored_docs(spark, d)
    parts = selection.split(rows, selection.keep_best(rows, 100, MIN_SCORE), MIN_SCORE)
    return parts.select("id", "bucket", F.array_join("rejection_reasons", ",").alias("reasons"))


@query(f"""WITH {SCORED}, best AS (SELECT id FROM scored WHERE quality_score >= 7.5 ORDER BY quality_score DESC, id LIMIT 100),
r AS (SELECT id, list_distinct(list_concat(quality_issues, CASE WHEN quality_score < 7.5 THEN ['below_min_quality:7.5'] ELSE [] END)) AS r FROM scored WHERE id NOT IN (SELECT id FROM best)),
u AS (SELECT id, unnest(CASE WHEN len(r) > 0 THEN r ELSE ['not_selected'] END) AS reason FROM r)
SELECT reason, count(*) AS n FROM u GROUP BY reason ORDER BY n DESC, min(id) LIMIT 3""")
def rejection_reasons(spark, d):
    rows = scored_docs(spark, d)
    parts = selection.split(rows, selection.keep_best(rows, 100, MIN_SCORE), MIN_SCORE)
    return selection.rejection_summary(parts).select("reason", "n")


@query(f"WITH {SCORED}, b AS (SELECT id, quality_score FROM scored ORDER BY quality_score DESC, id) SELECT id, quality_score FROM b WHERE quality_score >= 7.5 ORDER BY quality_score DESC, id LIMIT 50")
def keep_best(spark, d):
    return selection.keep_best(scored_docs(spark, d), 50, MIN_SCORE).select("id", "quality_score")


@query(f"WITH {SCORED} SELECT id, row_number() OVER (ORDER BY quality_score DESC, id)::INT AS place FROM (SELECT id, quality_score FROM scored WHERE quality_score >= 7.5)")
def inspect_sort(spark, d):
    return artifacts.inspect_place(quality.at_least(scored_docs(spark, d)), "score").select("id", "place")


@query(rf"""WITH {EX_CONV}, t AS (SELECT id, array_to_string({toks('assistant')}, ' ') AS x FROM ex_conv)
SELECT id, CASE WHEN length(x) > 140 THEN substr(x, 1, 137) || '...' ELSE x END AS preview FROM t""")
def preview_texts(spark, d):
    return convs(spark, d).select("id", text.truncate(F.col("assistant")).alias("preview"))


# ---- exports

_TURNS = "FROM conversations GROUP BY conv_id"


def _messages(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))).alias("t"))
    return turns.select(F.col("conv_id").alias("id"), F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


@query(f"SELECT conv_id AS id, string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text {_TURNS}")
def export_chatml(spark, d):
    return _messages(spark, d).select("id", writers.chatml_text(F.col("messages")).alias("text"))


@query(f"""SELECT conv_id AS id, md5('{{"conversations":[' || string_agg('{{"from":"' || CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END
  || '","value":' || to_json(coalesce(text, '')) || '}}', ',' ORDER BY turn) || ']}}') AS line_md5 {_TURNS}""")
def export_sharegpt(spark, d):
    return _messages(spark, d).select("id", F.md5(writers.sharegpt(F.col("messages"))).alias("line_md5"))


@query(f"""WITH {EX_CONV} SELECT id, md5('{{"instruction":' || to_json("user") || ',"input":"","output":' || to_json(assistant) || '}}') AS line_md5 FROM ex_conv""")
def export_alpaca(spark, d):
    return convs(spark, d).select("id", F.md5(writers.alpaca(F.col("user"), F.col("assistant"))).alias("line_md5"))


@query(f"""SELECT conv_id AS id, coalesce(string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY turn) FILTER (WHERE trim(coalesce(text, '')) <> ''), '') AS text {_TURNS}""")
def chat_rendering(spark, d):
    return _messages(spark, d).select("id", writers.chat_text(F.col("messages")).alias("text"))


@query("""WITH near AS (
  SELECT o_totalprice::DOUBLE / 10000 * 250 / (o_orderkey % 500 + 1) AS m FROM orders ORDER BY abs(o_orderkey % 500 + 1 - 250), o_orderkey DESC LIMIT 5),
mid AS (SELECT list_sort(list(m))[count(*) // 2 + 1] AS middle FROM near)
SELECT middle * 0.85::DOUBLE AS low, middle, middle * 1.2::DOUBLE AS high FROM mid""")
def eta_history(spark, d):
    history = table(spark, d, "orders").select(
        F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit(True).alias("has_seeds"), (F.col("o_orderkey") % 500 + 1).alias("examples"), (F.col("o_totalprice") / 10000).cast("double").alias("minutes"), F.col("o_orderkey").alias("updated_at")
    )
    return ranking.eta_minutes(history, "p", "m", True, 250)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The audit: score, issues and contamination verdict of every document, filtered."""
    found = verdicts(spark, d)
    return decon.without_contaminated(scored_docs(spark, d).join(found, "id")).select("id", "quality_score", F.array_join("quality_issues", ",").alias("issues"), "verdict", F.round("confidence", 6).alias("confidence"))


QUERIES["audit"] = flagship
ORACLE["audit"] = f"""WITH {SCORED}, {VERDICT.lstrip()}
SELECT id, quality_score, array_to_string(quality_issues, ',') AS issues, verdict, round(confidence, 6) AS confidence
FROM scored JOIN verdicts USING (id) WHERE verdict <> 'block'"""
