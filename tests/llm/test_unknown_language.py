"""The pipeline's language stage on text of languages never learned, and on junk."""

import base64
import random

import pytest

import corpus_pipeline

UNKNOWN = {
    "ru": "Каждый человек имеет право на жизнь и свободу и на личную неприкосновенность",
    "zh": "人人生而自由在尊严和权利上一律平等他们赋有理性和良心",
    "ja": "すべての人間は生まれながらにして自由でありかつ尊厳と権利とについて平等である",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
    "sw": "Watu wote wamezaliwa huru hadhi na haki zao ni sawa",
    "base64": base64.b64encode(random.Random(0).randbytes(300)).decode(),
    "hex": random.Random(0).randbytes(200).hex(),
    "keys": "asdf qwer zxcv hjkl " * 10,
    "a": "a",
}


@pytest.fixture(scope="module")
def learned(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_unknown_text_goes_and_known_text_stays(spark, learned, sf):
    rows = [(-i, t, k) for i, (k, t) in enumerate(UNKNOWN.items(), 1)]
    odd = spark.createDataFrame([(d, t, None, None, len(t)) for d, t, _ in rows], learned.select("doc_id", "text", "lang", "source", "n_chars").schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, learned.select(odd.columns).unionByName(odd), sf).select("doc_id").collect()}
    assert [k for d, _, k in rows if d in kept] == []
    known = {r["doc_id"] for r in learned.where("text rlike '\\\\p{L}' and lang is not null").select("doc_id").collect()}
    assert len(known - kept) <= len(known) // 500
