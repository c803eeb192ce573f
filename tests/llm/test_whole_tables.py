"""op1_pii, op4_media and op7_sentencepiece over a whole table, against plain versions."""

import hashlib
import os
import re
import zlib

import public_tokenizers
import sentencepiece
from tests.llm.test_native import luhn, plain_spans

from siltstone.llm import media, pii, sentencepieces


def rows_of(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_op1_pii(spark, sf_dir):
    texts, got = rows_of(spark, sf_dir), pii.op1_pii(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x.split(":")[0] == k for x in base.split(",")) for k in pii.KINDS]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        for kind, start, end in (x.split(":") for x in r["spans"].split(",") if x):
            if kind == "card":
                assert luhn(re.sub("[^0-9]", "", texts[r["doc_id"]][int(start) : int(end)]))


def test_op4_media(spark, sf_dir, tmp_path):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    stored_media = lambda: {x for x in os.listdir(shared) if x.startswith("media-")}
    before = stored_media()
    texts, got = rows_of(spark, sf_dir), media.op4_media(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        stored = media.to_wav(payload)
        assert r["media_bytes"] == len(stored) and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
    assert stored_media() == before


def test_op7_sentencepiece(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts, got = rows_of(spark, sf_dir), sentencepieces.op7_sentencepiece(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
