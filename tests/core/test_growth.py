"""What is shuffled, stored and read doesn't grow beyond what a result needs."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from siltstone.functions import text
from siltstone.operators import diversity, reference
from siltstone.operators.views import document_examples
from siltstone.plans import catalog


def test_near_overlap_shuffles_grams_of_texts_that_can_be_alike(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    # likenesses of 1, 42/72 and, twice, 50/61; the others share no gram
    near = [" ".join(words), " ".join([*words[:44], *[f"y{i}" for i in range(14)]]), " ".join([*words[:52], *[f"z{i}" for i in range(3)]])]
    other = [" ".join(f"t{i} {n}" for n in range(40)) for i in range(300)]
    gen = document_examples(spark.createDataFrame([(i, t, None, "g") for i, t in enumerate([*near, near[2], *other])], "doc_id long, text string, lang string, source string"))
    ref = document_examples(spark.createDataFrame([(i, t, None, "r") for i, t in enumerate([" ".join(words), *[x.replace("t", "u") for x in other]])], "doc_id long, text string, lang string, source string"))
    sizes, keep = [], reference.stored

    def watched(df):
        out = keep(df)
        if "g" in df.columns and "id" not in df.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(reference, "stored", watched)
    got = {r["id"]: round(r["likeness"], 6) for r in reference.near_overlap(gen, ref).collect()}
    assert got == {0: 1.0, 2: round(50 / 61, 6), 3: round(50 / 61, 6)}
    assert sizes and max(sizes) < 20


@pytest.mark.parametrize("name", ["graph_neighbors", "cluster_priority", "seeds_of_clusters", "graph_coverage", "distribution_status", "planned_gaps", "cluster_vectors"])
def test_texts_are_classified_once_for_clusters(spark, sf_dir, monkeypatch, name):
    read, plain = [], catalog.table

    def watched(spark, d, table):
        read.append(table)
        return plain(spark, d, table)

    monkeypatch.setattr(catalog, "table", watched)
    out = __spark_entry__.queries()[name](spark, sf_dir)
    assert read.count("documents") == 1
    assert "FileScan" not in out._jdf.queryExecution().executedPlan().toString()


def test_validation_reads_no_text_again(spark, sf_dir):
    out = __spark_entry__.queries()["distribution_validation"](spark, sf_dir)
    assert "FileScan" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [0, 1, 3, 5])
def test_capped_word_counts(spark, most):
    texts = ["", " ", "a", " a ", "a b", " a b", "a b ", "  a\u00a0b  c ", "a b c d e", " a b c d e f ", "a\nb c\td e f g h", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.word_count(F.col("t")).alias("n"), text.word_count(F.col("t"), most).alias("m")).collect()
    assert all(r["m"] == r["n"] if r["n"] <= most else r["m"] > most for r in rows)


def test_estimated_diversity_hashes_each_text_once(spark):
    schema = "id long, assistant string"
    rows = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h"), (4, "x"), (5, None)], schema)
    out = diversity.estimated_gram_distance(rows)
    # ten pairs but that of the two without grams; one is equal
    assert tuple(out.first()) == (1 - 1 / 9, 0.0)
    assert out._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    assert tuple(diversity.estimated_gram_distance(rows.where("id > 3")).first()) == (1.0, 0.0)
    assert tuple(diversity.estimated_gram_distance(rows.where("false")).first()) == (1.0, 0.0)
