"""The vector index, the store of vectors by content, and leader clusters."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import decontamination as decon
from siltstone.operators import leaders, vector_index
from siltstone.plans import embedding


def table(spark, v, key="id"):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"{key} long, embedding array<double>")


def clustered(n, dims=8, centers=12, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centers, dims))
    v = c[rng.integers(0, centers, n)] + rng.normal(size=(n, dims)) * spread
    return v / np.linalg.norm(v, axis=1)[:, None]


def ranked(df):
    return sorted((r["id"], r["match_rank"], r["item_index"], round(r["similarity"], 9)) for r in df.collect())


@pytest.mark.parametrize("lists", [1, 7, 30])
@pytest.mark.parametrize("others", [False, True])
def test_index_search_is_exact(spark, tmp_path, lists, others):
    """Also with copies (ties), a list that holds a third of all rows, and vectors of any length."""
    v = clustered(400)
    v[:130] = v[0]
    v[140:150] *= 3
    items, queries = table(spark, v, "item_index"), table(spark, v).where("id % 9 = 0")
    vector_index.build(items, str(tmp_path / "i"), lists=lists, block=50)
    got = vector_index.search(queries, str(tmp_path / "i"), 4, others=others, block=10)
    assert ranked(got) == ranked(decon.vector_top_k(queries, items, 4, others=others))
    some = vector_index.search(queries, str(tmp_path / "i"), 4, 0.99, others=others)
    assert ranked(some) == ranked(decon.vector_top_k(queries, items, 4, 0.99, others=others))


def test_index_reads_some_lists_and_is_reread(spark, tmp_path):
    v = clustered(600, centers=25, spread=0.01)
    path = str(tmp_path / "i")
    vector_index.build(table(spark, v, "item_index"), path, lists=25)
    before = sorted(os.listdir(path))
    queries = table(spark, v).where("id < 60")
    one = vector_index.lists_read(queries, path, k=1).first()
    assert one["queries"] == 60 and one["lists"] <= 25 and one["share"] < 0.5
    vector_index.search(queries, path).collect()
    assert sorted(os.listdir(path)) == before
    vector_index.build(table(spark, v[:0], "item_index"), str(tmp_path / "none"))
    assert vector_index.search(queries, str(tmp_path / "none")).collect() == []
    with pytest.raises(ValueError):
        vector_index.search(queries, str(tmp_path / "missing"))


def counting(log):
    """A model that notes the texts it is shown in files, since workers are other processes."""

    def model():
        embed = embedding.letters()

        def noted(texts):
            with open(f"{log}/{os.getpid()}", "a") as f:
                f.writelines(t.replace("\n", " ") + "\n" for t in texts)
            return embed(texts)

        return noted

    return model


def shown(log):
    return sorted(line for f in os.listdir(log) for line in open(f"{log}/{f}").read().splitlines())


def test_each_text_is_embedded_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = spark.createDataFrame([(i, f"text number {'abcdefg'[i % 7]}") for i in range(50)] + [(60, None), (61, "")], "id long, text string").repartition(4)
    store = lambda **o: embedding.VectorStore(spark, str(tmp_path / "s"), o.pop("name", "m1"), counting(str(log)), **o)
    first = store().vectors(rows)
    assert first.count() == 52 and first.where("embedding is null").count() == 0
    assert len(shown(log)) == 8
    more = rows.union(spark.createDataFrame([(70, "text number z"), (71, "text number z")], rows.schema))
    assert store().vectors(more).count() == 54
    assert shown(log) == sorted({r["text"] or "" for r in more.collect()})
    assert not store(scope="another").valid() and store().valid()
    assert store(name="m2").vectors(rows).count() == 52
    assert len(shown(log)) == 9 + 8 and not store().valid()


def test_evidence_from_texts(spark, tmp_path):
    bench = spark.createDataFrame([("b1", 0, "zebra quiz jumps"), ("b2", 5, "an ordinary sentence of words")], "benchmark string, item_index long, text string")
    rows = spark.createDataFrame([(1, "Jumps, quiz: zebra!"), (2, "xxxx yyyy"), (3, None)], "id long, text string")
    log = tmp_path / "log"
    log.mkdir()
    store = embedding.VectorStore(spark, str(tmp_path / "s"), "m", counting(str(log)))
    run = lambda b: embedding.text_evidence(rows, b, store, str(tmp_path / "i"), threshold=0.95)
    found = run(bench).collect()
    assert [(r["id"], r["benchmark"], r["item_index"], r["method"], r["confidence"]) for r in found] == [(1, "b1", 0, "embedding", 1.0)]
    examples = rows.select("id")
    assert {r["id"]: r["verdict"] for r in decon.verdicts(examples, run(bench)).collect()} == {1: "review", 2: "clean", 3: "clean"}
    n = len(shown(log))
    assert n == 5 and run(bench).count() == 1 and len(shown(log)) == n  # nothing is embedded or built again
    other = bench.union(spark.createDataFrame([("b2", 6, "xxxxyyyy")], bench.schema))
    assert {r["id"] for r in run(other).collect()} == {1, 2} and len(shown(log)) == n + 1


def sequential(v, threshold):
    """(leader, cluster) of each row by the pass itself."""
    led, out = [], []
    for i, x in enumerate(v):
        likeness = [float(x @ v[j]) for j in led]
        best = int(np.argmax(likeness)) if likeness else -1
        if best < 0 or likeness[best] < threshold:
            led.append(i)
            best = len(led) - 1
        out.append((led[best], best))
    return out


@pytest.mark.parametrize(("block", "threshold"), [(2048, 0.9), (7, 0.9), (1, 0.97), (3, -1.0), (50, 2.0)])
def test_leaders_are_those_of_the_sequential_pass(spark, block, threshold):
    v = clustered(120, centers=15, spread=0.15)
    v[40:80] = v[3]
    rows = spark.createDataFrame([(f"r{i:04d}", x.tolist()) for i, x in enumerate(v)] + [("zz", None)], "id string, embedding array<double>")
    got = {r["id"]: (r["leader_id"], r["semantic_cluster"]) for r in leaders.leader_clusters(rows.repartition(5), threshold, block).collect()}
    assert got == {f"r{i:04d}": (f"r{j:04d}", c) for i, (j, c) in enumerate(sequential(v, threshold))}


def test_no_rows_no_clusters(spark):
    assert leaders.leader_clusters(table(spark, np.zeros((0, 3))), 0.9).collect() == []
