"""op13_suffix_dedup against a plain version that counts every window, and its parts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import suffixes
from tests.llm.helpers import awkward, empty

NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def plain(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t) + 1)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def result(df, **options):
    return [tuple(r) for r in suffixes.without_repeats(df, text=False, **options).select(NAMES).collect()]


def alike(a, b):
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_query_equals_plain_version(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = plain(rows, 200)
    alike([tuple(r[c] for c in NAMES) for r in suffixes.op13_suffix_dedup(spark, sf_dir).collect()], expected)
    assert any(r[2] for r in expected)


def corpus(seed, n=60):
    """Texts of shared passages, cut and altered, of one letter, periodic, with zero bytes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcé日\0", k=rng.randint(1, 5)))
    shared = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(6)]
    texts = [None, "", "a" * 19, "a" * 20, "b" * 300, "ab" * 200, "abc" * 7, "x" * 21, "y" * 20 + "z" + "y" * 20]
    for _ in range(n):
        part = rng.choice(shared)
        i, j = sorted(rng.sample(range(len(part) + 1), 2)) if len(part) > 2 else (0, 1)
        texts.append(" ".join(word() for _ in range(rng.randint(0, 12))) + part[i:j] + " ".join(word() for _ in range(rng.randint(0, 12))))
    texts += [texts[-1]] * 7 + [shared[0]] * 3
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"often": 3, "shard": 300, "run": 50}), (3, {"often": 1, "shard": 60, "run": 20}), (4, {"shard": 1})])
def test_equals_plain_version(spark, seed, options):
    """Also with frequent keys in many shards, whose windows are merged in many ranges."""
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    alike(result(df, length=20, gram=7, **options), plain(rows, 20))


def test_awkward_rows(spark, monkeypatch):
    df = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    alike(result(df), plain(rows, 200))
    monkeypatch.setattr(suffixes, "BROADCAST_BYTES", 0)
    alike(result(df), plain(rows, 200))
    assert result(empty(spark)) == []


def test_spans_and_kept_bytes(spark):
    text = "".join(random.Random(9).choices("abcdefgh", k=500))
    df = spark.createDataFrame([(1, "head" + text[:250] + "tail"), (2, text[:250]), (3, text[300:])], "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in suffixes.without_repeats(df).collect()}
    assert got == {1: ([(4, 254)], b"headtail"), 2: ([(0, 250)], b""), 3: ([], text[300:].encode())}


bytes_ = st.one_of(st.binary(max_size=60), st.lists(st.sampled_from([0, 1, 97]), max_size=120).map(bytes), st.integers(1, 90).map(lambda n: b"a" * n))


@settings(max_examples=400, deadline=None)
@given(bytes_.filter(len))
def test_suffix_array_and_prefixes(data):
    array = np.frombuffer(data, np.uint8)
    order, place = suffixes.suffix_array(array)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    assert place[order].tolist() == list(range(len(data)))
    shared = suffixes.common_prefixes(array, order, place).tolist()
    for k in range(1, len(data)):
        a, b = data[order[k - 1] :], data[order[k] :]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert shared[k] == n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(1, 20))
def test_sliding(values, width):
    x = np.array(values, np.uint64)
    if len(values) >= width:
        assert suffixes.sliding(x, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]
        assert suffixes.sliding(x, width, False).tolist() == [max(values[i : i + width]) for i in range(len(values) - width + 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 90), min_size=1, max_size=12), st.integers(30, 80))
def test_each_window_is_in_one_piece(lengths, most):
    starts = np.cumsum(lengths) - lengths
    found = sorted(int(a + s) for a, b, first, last in suffixes.pieces(np.array(lengths), 20, most) for f, l in zip(first, last) for s in range(f, l) if a + s + 20 <= b)
    assert found == [s + i for s, n in zip(starts.tolist(), lengths) for i in range(n - 19)]


def test_runs_merge_by_binary_search():
    rng = random.Random(4)
    names = [rng.randbytes(16) for _ in range(40)]
    runs, count, where = [], Counter(), {}
    for r in range(7):
        own = sorted(rng.sample(names, 15))
        places = np.zeros(15, suffixes.PLACE)
        places["at"], places["open"] = [r * 100 + i for i in range(15)], [rng.random() < 0.7 for _ in own]
        count.update(own)
        where |= {r * 100 + i: (d, places["open"][i]) for i, d in enumerate(own)}
        runs.append((np.array(own, "S16"), places))
    found = suffixes.merged_runs(runs)["at"].tolist()
    assert sorted(found) == sorted(at for at, (d, is_open) in where.items() if is_open and count[d] > 1)


@pytest.mark.parametrize("most", [30, 77, 1000])
def test_keys_don_t_depend_on_the_pieces(most):
    """Of long texts that are cut, and of short ones together: each window's key is its own."""
    rng = np.random.default_rng(2)
    lengths = np.array([400, 5, 20, 0, 19, 130, 64, 700])
    data = rng.integers(97, 100, lengths.sum()).astype(np.uint8)
    starts = np.cumsum(lengths) - lengths
    found = {}
    for a, b, first, last in suffixes.pieces(lengths, 20, most):
        _, at, keys = suffixes.window_keys(data[a:b], first, last, 20, 7)
        found |= dict(zip((at + a).tolist(), keys.tolist()))
    want = {}
    for s, n in zip(starts.tolist(), lengths.tolist()):
        for i in range(s, s + n - 19):
            want[i] = int(suffixes.gram_hashes(data[i : i + 20], 7).min())
    assert found == want
