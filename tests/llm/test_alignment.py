"""op12_alignment against a plain version: sets of ends, links one by one."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import alignment
from tests.llm.helpers import awkward, empty

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
LETTERS = alignment.byte_letters()
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain_groups(text):
    if not text:
        return []
    raw = (" " + text).encode()
    a = [(i, bytes(LETTERS[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return []
    sides = []
    for tokens in (a, b):
        end, placed = 0, []
        for i, x in tokens:
            end += len(x)
            placed.append((end, i))
        sides.append(placed)
    cuts = sorted({e for e, _ in sides[0]} & {e for e, _ in sides[1]})
    out, at = [], [0, 0]
    for cut in cuts:
        group = []
        for k, side in enumerate(sides):
            stop = at[k]
            while stop < len(side) and side[stop][0] <= cut:
                stop += 1
            group.append([i for _, i in side[at[k] : stop]])
            at[k] = stop
        out.append(tuple(group))
    return out


def plain_rows(rows):
    of_doc = [(doc_id, plain_groups(text)) for doc_id, text in rows]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in of_doc]
    count = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, groups), own in zip(of_doc, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values()),
            sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


def by_text(rows):
    return sorted(map(str, rows))


MIXED = ["<|endoftext|> is text", "a▁b", "tabs\tand\n\nlines   with  blanks ", " leads", "日本語テキスト and русский", "\U0001f468‍\U0001f469‍\U0001f467 joined", "x" * 300, "é" * 40, "ß ﬁ ǆ ﷺ", "\x00\x01", "नमस्ते दुनिया", "ꟊ Ꟶ 𞤀 ᲀ ֏"]


def test_query_equals_plain_version(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r[c] for c in NAMES) for r in alignment.op12_alignment(spark, sf_dir).collect()]
    assert by_text(got) == by_text(plain_rows(rows))


@pytest.mark.parametrize(("small", "block"), [(alignment.SMALL, alignment.BLOCK), (0, 500)])
def test_awkward_rows(spark, small, block):
    """By a broadcast of the pairs' table, and brought to the blocks, in blocks of a few texts."""
    df = awkward(spark).union(spark.createDataFrame([(50 + i, t, None, None, None, 1, "k", "r", 0.5, "f", "b") for i, t in enumerate(MIXED)], awkward(spark).schema))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = [tuple(r) for r in alignment.aligned(df, small=small, block=block).select(NAMES).collect()]
    assert by_text(got) == by_text(plain_rows(rows))
    assert alignment.aligned(empty(spark), small=small).collect() == []


def test_links_in_slices_are_the_same():
    rng = np.random.default_rng(3)
    a_group, b_group = (np.sort(rng.integers(0, 9, n)) for n in (40, 50))
    a_group[:9], b_group[:9] = 0, 0
    a_group, b_group = (np.unique(g, return_inverse=True)[1] for g in (np.sort(np.append(a_group, range(9))), np.sort(np.append(b_group, range(9)))))
    a, b, doc = rng.integers(0, 5, len(a_group)), rng.integers(0, 5, len(b_group)), a_group // 3
    expected = Counter(int(d) << 32 | int(x) << 16 | int(y) for x, g, d in zip(a, a_group, doc) for y, h in zip(b, b_group) if g == h)
    for most in (1, 7, 10_000):
        keys, times = alignment.linked(a, b, a_group, b_group, doc, most)
        assert dict(zip(keys.tolist(), times.tolist())) == expected and (np.diff(keys) > 0).all()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F, blacklist_categories=("Cs",)), max_size=80))
def test_both_libraries_of_a_agree_on_latin_texts(text):
    v = alignment.vocabularies(None, None, None)
    assert v.fast.encode_ordinary(" " + text) == A.encode(" " + text, add_special_tokens=False).ids


def test_blocks_are_cut_by_bytes(spark):
    df = spark.createDataFrame([(i, "word " * 200) for i in range(30)], "doc_id long, text string").coalesce(1)
    assert alignment.blocks(df, most=5000).count() == 6
