"""The registered queries that SQL cannot express, row by row against the libraries and loops they follow."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_rows import by_patterns
from tokenizers import Tokenizer

from sievelight.llm import personal
from sievelight.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_op4_bpe(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    got = QUERIES["op4_bpe"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False)))


def test_op9_personal(spark, texts):
    got = QUERIES["op9_personal"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        want = by_patterns(texts[r.doc_id].text or "")
        counts = tuple(sum(k == kind for *_, k in want) for kind in personal.BASE)
        line = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) == (counts, sha(line))
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_op8_language(spark, texts):
    got = QUERIES["op8_language"](spark, SMALL).collect()
    assert len(got) == len(texts) and {"doc_id", "held_out", "lang_pred", "score"} <= set(got[0].asDict())
    learned = {r.lang for r in texts.values() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    told = [r for r in got if r.held_out]
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id].text or "")) and r.lang_pred in learned | {"und"}
    assert sum(r.lang_pred == texts[r.doc_id].lang for r in told) / len(told) > 0.9


def test_op1_importance(spark, texts):
    got = QUERIES["op1_importance"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    kept = [r for r in got if r.kept]
    assert 0 < len(kept) < len(got) and min(r.sort_key for r in kept) >= max(r.sort_key for r in got if not r.kept)


def test_added_kinds_are_found():
    """Every address, account number, secret and url that is planted with a cue is found whole, in plain prose."""
    rng = random.Random(8)
    marks = personal.automaton()
    planted = [("DE89 3704 0044 0532 0130 00", "iban", "IBAN {}"), ("GB82 WEST 1234 5698 7654 32", "iban", "to {}"),
               ("12345678", "account", "account no. {}"), ("abcdef1234", "secret", "password={}"), ("https://x.org/a?b=1", "url", "see {}")]
    found = total = 0
    for _ in range(300):
        value, kind, cue = rng.choice(planted)
        before, after = (" ".join(rng.choice(["the", "of", "and", "said", "Mr"]) for _ in range(rng.randint(0, 8))) for _ in range(2))
        text = f"{before} {cue.format(value)}{rng.choice([' ', ', ', '. ', chr(10)])}{after}"
        total += 1
        found += (value, kind) in [(text[a:b], k) for a, b, k in personal.find(text, marks)]
    assert found / total > 0.97
