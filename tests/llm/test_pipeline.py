"""The pipeline's stages, each against a plain version on its own input."""

import re

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from siltstone.llm import mixing, quality, sentencepieces, simhash
from tests.llm.helpers import SCHEMA, awkward


def body(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def near(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1") <= 4


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    passed = {r["doc_id"] for r in quality.scores(docs, model).where(F.col("score") >= quality.THRESHOLD).collect()}
    assert {r["doc_id"] for r in good.collect()} == passed and good.columns == docs.columns

    exact = stages["exact_dedup"](spark, docs, sf_dir)
    first = {}
    for r in docs.orderBy("doc_id").collect():
        first.setdefault(body(r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(first.values()) and exact.columns == docs.columns

    kept = stages["near_dedup"](spark, docs, sf_dir)
    rows = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in docs.orderBy("doc_id").collect()]
    root = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, a in rows:
            for j, b in rows:
                if root[j] < root[i] and near(a, b):
                    root[i], changed = root[j], True
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in root.items() if i == r) and kept.columns == docs.columns

    mix = stages["mixing"](spark, docs, sf_dir)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(docs).collect()}
    assert {r["doc_id"]: r["count"] for r in mix.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}

    tokens = stages["sentencepiece"](spark, docs, sf_dir)
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.model_path(None))
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.collect()} == {r["doc_id"]: len(library.encode(r["text"] or "")) for r in docs.collect()}


def test_run_chains_the_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(got) == key(docs)


def test_stages_take_awkward_tables(spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, awkward(spark), sf_dir).count() > 0
        assert stage(spark, spark.createDataFrame([], SCHEMA), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, awkward(spark), sf_dir).columns == awkward(spark).columns


def test_dedup_stages_keep_one_row_of_repeats_and_null_ids(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    docs = awkward(spark)
    docs = docs.union(docs)
    rows = docs.collect()
    exact = [body(r["text"]) for r in stages["exact_dedup"](spark, docs, sf_dir).collect()]
    assert sorted(exact) == sorted({body(r["text"]) for r in rows})
    near_rows = stages["near_dedup"](spark, docs, sf_dir).collect()
    prints = {simhash.fingerprint(r["text"]) for r in rows}
    assert not any(a < b and near(a, b) for a in prints for b in prints)
    assert sorted(simhash.fingerprint(r["text"]) for r in near_rows) == sorted(prints)

    text = "one of two texts that differ by nothing but the white space in them"
    loose = spark.createDataFrame([(None, text, *[None] * 9), (None, text.replace(" ", "  "), *[None] * 9), (None, text, *[None] * 9)], SCHEMA)
    assert stages["exact_dedup"](spark, loose, sf_dir).count() == 1
    assert stages["near_dedup"](spark, loose, sf_dir).count() == 1
