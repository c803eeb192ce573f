"""Key filters, draws, estimated diversity, typed replies and versioned tables."""

import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import jsonrepair, replies
from siltstone.operators import decontamination as decon
from siltstone.operators import diversity, draws, keyfilter
from siltstone.sources.versions import Conflict, Versions, remember, remembered


def test_filter_knows_all_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    own = spark.range(60_000).select("id", F.xxhash64("id").alias("h"))
    kept = keyfilter.known(own, "h", keys, 20_000)
    assert kept.columns == ["id", "h"]
    assert kept.where("id < 20000").count() == 20_000
    assert kept.where("id >= 20000").count() < 40_000 * 0.04
    assert keyfilter.known(own, "h", keys, 20_000, most=1).where("id < 20000").count() == 20_000
    assert keyfilter.known(own, "h", keys.limit(0), 0).count() == 0


def test_lookups_shuffle_about_the_hits(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randint(0, 3000)}"
    bench = spark.createDataFrame([(f"b{i % 3}", i, " ".join(word() for _ in range(12))) for i in range(60)], "benchmark string, item_index long, text string")
    items = [r["text"] for r in bench.collect()]
    texts = [" ".join([word() for _ in range(80)] + ([items[i % 60]] if i % 4 == 0 else [])) for i in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    prepared = decon.prepared(bench)
    as_set = lambda df: sorted(tuple(r) for r in df.collect())
    assert as_set(decon.lookups(rows, prepared, most_rows=0)) == as_set(decon.lookups(rows, prepared))
    index = decon.indexed(prepared)
    everything = sum(1 + len({*zip(w, w[1:], w[2:])}) + len({*zip(w, w[1:], w[2:], w[3:], w[4:])}) for w in map(str.split, texts))
    passed = decon.looked_up(rows, index, most_rows=0)
    hits = passed.join(index, ["rule", "key"], "left_semi")
    assert as_set(hits.select("id", "rule", "key")) == as_set(decon.looked_up(rows, index))  # looked up in tasks: the hits alone
    assert hits.count() <= passed.count() <= hits.count() + 0.04 * everything


@pytest.mark.parametrize("held", [1, 100_000])
def test_draws_are_the_least_hashes(spark, monkeypatch, held):
    """A hot group, a group smaller than the draw, rows without a group or id, repeats."""
    monkeypatch.setattr(draws, "HELD", held)
    rows = [(i, "hot" if i % 3 else f"g{i % 21}") for i in range(900)] + [(1000, None), (1001, None), (None, "hot"), (5, "hot"), (5, "hot"), (2000, "lone")]
    df = spark.createDataFrame(rows, "id long, topic string").repartition(7)
    want = {}
    for i, g in set(rows):
        if i is not None:
            want.setdefault(g, []).append((hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    want = {(g, n + 1, i, h) for g, x in want.items() for n, (h, i) in enumerate(sorted(x)[:3])}
    assert {tuple(r) for r in draws.drawn(df, 3, "topic").collect()} == want
    whole = [r["id"] for r in draws.drawn(df, 10).orderBy("place").collect()]
    assert whole == [i for _, i in sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i in {i for i, _ in rows if i is not None})[:10]]


def test_estimated_distance_is_near_the_exact_one(spark):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 40)}" for _ in range(60)]
    texts = [" ".join(base[: rng.randint(10, 60)] + [f"v{rng.randint(0, 30)}" for _ in range(rng.randint(0, 20))]) for _ in range(120)] + ["", None, "two words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, assistant string")
    exact = diversity.mean_gram_distance(rows).first()[0]
    got = diversity.estimated_gram_distance(rows).first()
    assert 0 < got["standard_error"] < 0.05 and abs(got["diversity"] - exact) < 4 * got["standard_error"] + 1e-6
    assert diversity.estimated_gram_distance(rows.limit(1)).first()["diversity"] == 1.0
    same = spark.createDataFrame([(i, "all the same words here") for i in range(5)], rows.schema)
    assert diversity.estimated_gram_distance(same).first()["diversity"] == 0.0


BROKEN = [
    None, "", "no json here", "7", "[1, 2]", '{"a": 1, "b": "x"}', '```json\n{"a": 1, "b": "x",}\n```', 'Sure! {"a": 2, "b": "two\nlines, ]\t"} Bye.', '{"a": 3, "b": "q", "c": [1, 2,',
    '{"a": "no number", "b": "y"}', '﻿{"a": 4, "b": "comma , ] stays" , }', '{"b": "only"}', 'text [1, {"a": 5}, ] more', '{"a": 6, "b": "esc \\" quote, }"', '{"a": 8, "b": "bell \x07"}',
]


def test_replies_are_typed_rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(BROKEN)], "i long, t string")
    got = {r["i"]: r["x"] for r in df.select("i", replies.typed(F.col("t"), {"a": ("int", -1), "b": ("string", "?")}).alias("x")).collect()}
    for i, t in enumerate(BROKEN):
        text = jsonrepair.first_json(t)
        v = None if text is None else json.loads(text)
        problem = "no JSON" if text is None else "no object" if not isinstance(v, dict) else None
        v = v if isinstance(v, dict) else {}
        a = v.get("a") if isinstance(v.get("a"), int) else None
        lacking = [n for n, x in (("a", a), ("b", v.get("b"))) if x is None]
        assert got[i]["a"] == (-1 if a is None else a) and got[i]["b"] == v.get("b", "?"), t
        assert got[i]["problem"] == (problem or ("missing: " + ",".join(lacking) if lacking else None)), t


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet='{}[]", :\\\n\tab1', max_size=25), min_size=40, max_size=40))
def test_repair_equals_the_character_scan(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for r in df.select("t", replies.repaired(F.col("t")).alias("x")).collect():
        assert r["x"] == jsonrepair.repaired(r["t"]), r["t"]


def test_versions_replace_append_rewrite(spark, tmp_path):
    path = str(tmp_path / "t")
    numbers = lambda df: sorted(r[0] for r in df.collect())
    table = Versions(spark, path)
    assert not table.exists()
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(spark.range(5).toDF("n"), {"made": "for a"})
    old = table.read()
    table.append(spark.range(5, 8).toDF("n"))
    assert numbers(table.read()) == list(range(8)) and table.meta == {"made": "for a"}
    table.rewrite(lambda rows: rows.where("n % 2 = 0"))  # of the rows that it replaces
    assert numbers(table.read()) == [0, 2, 4, 6]
    assert numbers(old) == list(range(5))  # still named by a version that is kept
    table.rewrite(lambda rows: rows)
    table.rewrite(lambda rows: rows)
    assert numbers(table.read()) == [0, 2, 4, 6]
    assert len(list((tmp_path / "t" / "commits").glob("0*"))) == 2


def test_a_crash_or_another_writer_leaves_one_whole_version(spark, tmp_path):
    path = str(tmp_path / "t")
    table = Versions(spark, path)
    table.replace(spark.range(3).toDF("n"))

    def fails(batches):
        raise RuntimeError("lost")
        yield

    with pytest.raises(Exception, match="lost"):
        table.rewrite(lambda rows: rows.mapInPandas(fails, "n long"))
    assert table.read().count() == 3
    (tmp_path / "t" / "commits" / "000000000002").write_text('{"folders": ["da')  # died while it committed
    assert table.read().count() == 3

    def meanwhile(rows):
        Versions(spark, path).replace(spark.range(9).toDF("n"))
        return rows

    with pytest.raises(Conflict):
        table.rewrite(meanwhile)
    assert table.read().count() == 9


def test_history_keeps_the_last(spark, tmp_path):
    path, schema = str(tmp_path / "h"), "updated_at long, minutes double"
    assert remembered(spark, path, schema).count() == 0
    for k in range(3):
        remember(spark.createDataFrame([(100 * k + i, 1.0) for i in range(100)], schema), path, most=150)
    assert sorted(r["updated_at"] for r in remembered(spark, path, schema).collect()) == list(range(150, 300))
