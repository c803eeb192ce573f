"""Operators with Arrow functions: SimHash, media, languages, tokens, quality, URLs."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import components, langid, media, quality, sentencepieces, simhash, urls
from tests.llm.helpers import TEXTS, awkward, empty


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_spark_hashes_shingles_as_xxh64(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("über uns"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("über uns".encode(), 42)


@pytest.mark.parametrize("text", [t for t in TEXTS if t is None or len(t) < 1000] + ["A b C", "É é x y z"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def plain_roots(values):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("bucket", [64, 3])
def test_links_lose_no_component(spark, bucket):
    """Chains of near fingerprints and a dense ball, by pairs and by shared neighbours."""
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(150)}
    for base in list(values)[:25]:
        for _ in range(8):
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                base ^= 1 << bit
            values.add(base)
    ball = rng.getrandbits(64)
    values |= {ball ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(60)}
    values = [simhash.signed(v) for v in values]
    classes = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = simhash.links(classes, bucket=bucket)
    assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 4 for r in edges.collect())
    found = {v: v for v in values} | {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert found == plain_roots(values)
    thin = simhash.thinned(edges)
    assert found == {v: v for v in values} | {r["node"]: r["root"] for r in components.components(thin).collect()}
    assert thin.count() <= edges.count()


def test_fingerprints_and_components_of_a_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs}
    roots = plain_roots(sorted({simhash.signed(v) for v in prints.values()}))
    least = {}
    for i, v in sorted(prints.items()):
        least.setdefault(roots[simhash.signed(v)], i)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op3_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{v:016x}", least[roots[simhash.signed(v)]]) for i, v in prints.items()}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (500, 501)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components.components(edges).collect()} == {(i, 0) for i in range(301)} | {(500, 500), (501, 500)}


def test_near_duplicates_of_awkward_and_empty_tables(spark):
    rows = simhash.near_duplicates(awkward(spark)).collect()
    assert len(rows) == len(TEXTS) + 3
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {0}
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4)} == {3}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def png():
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00\x12\xff\x00\x34\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"


@pytest.mark.parametrize("kind,data", [("image/png", png()), ("image/gif", GIF), ("image/jpeg", JPEG), ("image/bmp", BMP), ("audio/wav", media.to_wav(b"abc"))])
def test_sniffing_and_carving(spark, kind, data):
    inside = b"RIFF GIF89a BM " + data + b" tail " + data
    rows = [(1, data, "text/plain", "x"), (2, inside, "application/zip", "y"), (3, data[:-1], "text/plain", "z"), (4, None, "a/b", None), (5, b"", None, None)]
    found = {r["n"]: r for r in media.sniffed(spark.createDataFrame(rows, "n long, content binary, declared string, carved string")).collect()}
    assert found[1]["media_type"] == kind and found[1]["carved"] == []
    assert found[2]["media_type"] == "application/zip" and [(c["kind"], bytes(c["bytes"])) for c in found[2]["carved"]] == [(kind, data)] * 2
    assert found[3]["media_type"] == "text/plain" and found[4]["media_type"] == "a/b" and found[5]["media_type"] is None


def test_stored_texts(spark):
    rows = media.stored_texts(awkward(spark)).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        if r["doc_id"] is not None:
            data = (TEXTS[r["doc_id"]] or "").encode()
            size = max(64, -(-len(data) // 64) * 64)
            payload = data + b"\0" * (size - len(data))
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert (r["media_bytes"], r["media_sha256"]) == (size + 44, hashlib.sha256(media.to_wav(payload)).hexdigest())
    assert media.stored_texts(empty(spark)).count() == 0


def test_stored_media_are_read_back(spark, tmp_path):
    """What the query digests is what lies in the files: another file there changes its result."""
    docs = spark.createDataFrame([(1, "RIFF and GIF89a, BM"), (2, "x" * 64)], "doc_id long, text string")
    first = {r["doc_id"]: r for r in media.stored_texts(docs, f"{tmp_path}/media").collect()}
    column = spark.read.parquet(f"{tmp_path}/media")
    found = {r["doc_id"]: r for r in media.sniffed(column).collect()}
    assert {r["declared"] for r in column.collect()} == {media.DECLARED} and {r["media_type"] for r in found.values()} == {"audio/wav"}
    assert all(first[i]["media_sha256"] == hashlib.sha256(r["content"]).hexdigest() for i, r in found.items())


def plain_viterbi(scores, penalty):
    best, paths = list(scores[0]), [[k] for k in range(len(scores[0]))]
    for row in scores[1:]:
        moves = [max((best[j] - penalty * (j != k), j == k, -j) for j in range(len(row))) for k in range(len(row))]
        paths = [[*paths[-m[2]], k] for k, m in enumerate(moves)]
        best = [m[0] + row[k] for k, m in enumerate(moves)]
    return max(best)


def test_viterbi_is_optimal():
    rng = np.random.default_rng(3)
    lengths = np.array([30, 12, 12, 1, 0])
    scores = rng.normal(0, 3, (lengths.sum(), 4)).astype(np.float32)
    path, at = langid.viterbi(scores, lengths, 2.5), 0
    for n in lengths:
        own, p = scores[at : at + n], path[at : at + n]
        if n:
            got = sum(own[i, p[i]] for i in range(n)) - 2.5 * (p[1:] != p[:-1]).sum()
            assert got == pytest.approx(plain_viterbi(own.tolist(), 2.5), abs=1e-3)
        at += n


def test_language_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs.where(~langid.is_held_out(F.col("doc_id"))))
    held = langid.identify(docs.where(langid.is_held_out(F.col("doc_id"))), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    de, en = (docs.where((F.col("lang") == x) & (F.col("n_chars") > 800)).orderBy("doc_id").first()["text"][:600] for x in ("de", "en"))
    mixed = spark.createDataFrame([(1, f"{de} {en}"), (2, "1234 !!"), (3, None), (4, "日本"), (5, "² ½ Ⅷ _")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(mixed, model).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["de", "en"]
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[5]["lang_pred"] == "und" and got[4]["lang_pred"] in model.languages
    assert len(langid.identify(awkward(spark), model).collect()) == len(TEXTS) + 3
    assert langid.identify(empty(spark), model).count() == 0
    nothing = langid.train(empty(spark))
    assert {r["lang_pred"] for r in langid.identify(awkward(spark), nothing).collect()} == {"und"}


MODEL = sentencepieces.model_path(None)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
PIECES = sentencepieces.Pieces(MODEL)


@settings(max_examples=150, deadline=None, derandomize=True)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" ▁\n\tabeintsüß日ﬁ", max_size=60)))
def test_ids_equal_the_library(text):
    assert sentencepieces.numbers(PIECES.encode(text)) == LIBRARY.encode(text)
    PIECES.check()


@given(st.text(alphabet="abcdetionsh▁", max_size=90))
def test_short_and_long_agendas_agree(text):
    if text:
        assert sentencepieces.merged_short(text, PIECES.ranks) == sentencepieces.merged_long(text, PIECES.ranks)


def test_encoded(spark):
    rows = sentencepieces.encoded(awkward(spark)).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        if r["doc_id"] is not None:
            ids = LIBRARY.encode(TEXTS[r["doc_id"]] or "")
            assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == LIBRARY.decode(ids)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sentencepieces.encoded(empty(spark)).count() == 0


def test_segments_are_forgotten_and_met_again():
    pieces = sentencepieces.Pieces(MODEL, limit=20)
    for i in range(200):
        text = f"word{i % 50} and other{i % 7} ﬁ日本 {i}"
        assert pieces.encode(text) == ",".join(map(str, LIBRARY.encode(text)))
        pieces.check()
        assert len(pieces) + len(pieces.older) <= 60


def test_a_wrong_id_fails_the_check():
    pieces = sentencepieces.Pieces(MODEL)
    pieces.encode("hello there")
    pieces["▁hello"] = "1"
    with pytest.raises(ValueError, match="'▁hello'"):
        pieces.check()


def test_a_mark_alone_may_be_the_only_new_segment():
    pieces = sentencepieces.Pieces(MODEL)
    for text in ("a5", "5"):
        assert pieces.encode(text) == ",".join(map(str, LIBRARY.encode(text)))
        pieces.check()


def test_small_batches_with_forgetting_raise_nothing():
    rng = random.Random(11)
    pieces = sentencepieces.Pieces(MODEL, limit=8)
    for _ in range(10_000):
        for _ in range(rng.randint(1, 2)):
            text = "".join(rng.choices(" ▁\n\tab5ieß日ﬁ.", k=rng.randint(0, 4)))
            assert sentencepieces.numbers(pieces.encode(text)) == LIBRARY.encode(text)
        pieces.check()
        if rng.random() < 0.1:
            pieces.clear()
            pieces.older = {}


def test_held_out_rows_and_predictions_of_the_queries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    crc = lambda i: zlib.crc32(str(i).encode())
    langs = {r["lang"] for r in docs if r["lang"] is not None and crc(r["doc_id"]) % 3 != 1}
    got = langid.op5_langid(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 and r["lang_pred"] in langs | {"und"} for r in got)
    got = quality.op8_quality(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_sum_of_squares_equals_the_pairs():
    rng = np.random.default_rng(0)
    size = quality.WORDS + len(quality.STATS)
    model = quality.Model(np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)), 0.1, rng.normal(0, 0.1, size), rng.normal(0, 0.1, (size, quality.FACTORS)))
    row = quality.features("some words, some more words | here", 10, quality.Buckets())
    x = {**dict(zip(row[0].tolist(), row[1])), **{quality.WORDS + i: v for i, v in enumerate(np.clip(row[2], -5, 5) / 4)}}
    pairs = sum(x[i] * x[j] * float(model.factors[i] @ model.factors[j]) for i in x for j in x if i < j)
    z = 0.1 + sum(v * model.weights[i] for i, v in x.items()) + pairs
    assert quality.scored(model, [row])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    held = quality.scores(docs, model).join(labels, "doc_id").where(quality.is_held_out(F.col("doc_id"))).toPandas()
    good = held["quality"] == 1
    assert ((held["score"] >= 0.7) == good).mean() > 0.9 and (held["score"] >= 0.7)[good].mean() > 0.97
    assert quality.accepted(docs, model).count() == quality.scores(docs, model).where(F.col("score") >= 0.7).count()
    assert len(quality.scores(awkward(spark), model).collect()) == len(TEXTS) + 3
    assert quality.scores(empty(spark), model).count() == 0
    none = quality.train(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    assert {round(r["score"], 2) for r in quality.scores(awkward(spark), none).collect()} == {0.5}


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(6000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = keys.where("hash(key) % 5 = 0")
    levels = urls.cascade(listed, keys, bits_per_key=3)
    assert len(levels) > 2
    rows = urls.hashed(keys).toPandas()
    own = {r["key"] for r in listed.collect()}
    flat = [rows[c].to_numpy().view(np.uint64) for c in ("h1", "h2")]
    assert {k for k, x in zip(rows["key"], urls.decide(levels, *flat)) if x} == own
    assert urls.cascade(listed.where("false"), keys) == []


URLS = [
    ("https://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
    ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://com/de/a", "com", "/de/a", "com/de/", "block"),
    ("http://x.com?y=/de/", "x.com", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("http:///de/", "", "/de/", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u[0], 1) for i, u in enumerate(URLS)], "page_id long, url string, host int")
    rules = spark.createDataFrame([*urls.RULES], "verdict string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(pages, rules).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert urls.judged(pages.where("false"), rules).count() == 0
    assert {r["verdict"] for r in urls.judged(pages, rules.where("false")).collect()} == {"allow"}


def test_written_ids_of_pieces_and_of_their_bytes():
    assert PIECES.written["the"] == str(PIECES.ids["the"])
    assert PIECES.written["\U0001f9ff"] == ",".join(str(PIECES.bytes[b]) for b in "\U0001f9ff".encode())
    assert "\U0001f9ff" not in PIECES.written  # a table of the vocabulary alone, whatever comes
    assert sentencepieces.merged_short("", PIECES.ranks) == []
