"""op11_spelling against a plain version: every pair of words is compared."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import spelling
from tests.llm.helpers import awkward, empty


def plain_counts(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_counts(rows)
    near = {w: [x for x in words if x != w and one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def found(df):
    rows = [tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_plain_version(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.op11_spelling(spark, sf_dir).collect()}
    expected = plain_variants(rows)
    assert got == expected
    assert any(r[1] for r in expected) and any(r[1] != r[2] for r in expected if r[1])


def test_chains_ties_and_repeats(spark):
    """colour <- color <- colr chains, words of one letter, edits at every place, ties."""
    base = {"colour": 64, "color": 30, "colorr": 14, "colorrr": 5, "aaaaa": 3, "aaaaaa": 9, "aaaaaaa": 30, "abababab": 12, "babababa": 4, "ababababa": 5, "xolour": 64, "cÃlour": 3, "colouré": 3, "strasse": 8, "straße": 8, "strase": 3, "÷×÷×÷": 4, "÷×÷×÷×": 9}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(base.items())] + [(None, "colour Colour COLOUR"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == plain_variants(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abcé", min_size=5, max_size=8), min_size=2, max_size=14, unique=True))
def test_words_one_edit_apart_share_a_key(words):
    grams = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    order = {g: i for i, g in enumerate(sorted(grams, key=lambda g: (grams[g], g)))}
    keys = {w: spelling.keys_of(w, order) for w in words}
    for a in words:
        for b in words:
            if a != b and one_edit(a, b) and len(a) <= len(b):
                assert set(keys[a][0]) & set(keys[b][1]), (a, b)


def test_a_word_has_six_keys_at_most():
    order = {"aa": 0}
    shorter, longer = spelling.keys_of("a" * 50_000, order)
    assert len(longer) == 2 and len(shorter) == 4


@pytest.mark.parametrize("flush", [1, 400_000])
def test_awkward_rows(spark, monkeypatch, flush):
    monkeypatch.setattr(spelling, "FLUSH", flush)
    df = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = {tuple(r) for r in spelling.word_counts(df).where("n >= 3").collect()}
    assert got == set(plain_counts(rows).items())
    assert found(df) == plain_variants(rows)
    assert spelling.variants(empty(spark)).collect() == []
