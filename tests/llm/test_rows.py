"""Operators that treat each row by itself: sharding, BPE, personal data, language."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from llm_rows import CLASHING, LONG, frame, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievelight.llm import bpe, language, personal, sharding

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def claimed(shards, size):
    """The table by the definition: turn by turn down each shard's preference list."""
    def number(x):
        return int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    likes = {s: [(number(s + "/offset") + j * (number(s + "/skip") % (size - 1) + 1)) % size for j in range(size)] for s in shards}
    owner = {}
    while len(owner) < size:
        for i, s in enumerate(shards):
            free = [x for x in likes[s] if x not in owner]
            if free:
                owner[free[0]] = i
    return [owner[x] for x in range(size)]


def test_lookup_table():
    for n in (1, 2, 7, 13):
        shards = [f"s{i}" for i in range(n)]
        got = sharding.lookup_table(shards, 61)
        assert got == claimed(shards, 61)
        counts = np.bincount(got)
        assert counts.max() - counts.min() <= 1
    fewer, more = sharding.lookup_table([f"s{i}" for i in range(20)]), sharding.lookup_table([f"s{i}" for i in range(21)])
    moved = sum(a != b for a, b in zip(fewer, more, strict=True)) / len(more)
    assert moved < 0.12
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(["a"], 60)
    with pytest.raises(ValueError, match="distinct"):
        sharding.lookup_table(["a", "a"], 61)


def test_place(spark, messy_rows, tmp_path):
    docs = frame(spark, messy_rows)
    shards = ["a", "b", "c"]
    placed = sharding.place(docs, F.col("doc_id"), shards, 61)
    assert set(CLASHING) - {"slot", "shard"} < set(placed.columns) and {"_slot", "_shard"} < set(placed.columns)
    table = sharding.lookup_table(shards, 61)
    rows = placed.collect()
    assert len(rows) == len(messy_rows)
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 61
        assert (r.slot, r.shard) == (slot, shards[table[slot]])
    assert sharding.place(docs.limit(0), F.col("doc_id"), shards, 61).count() == 0
    sharding.write_shards(placed.select("doc_id", "shard"), str(tmp_path / "out"), files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(messy_rows)


def test_bpe_equals_the_library(spark, messy_rows):
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(1)
    letters = "aAbeiost  \n\t'’.,!?é̀ÉßİΣσςﬁ漢字가½²٣١_-<|> \xa0\u0085\x1c😀👍🏽ǅ"
    texts = ["", "  ", "a" * 3000, "the" * 500, "it's I'LL WE'RE <|endoftext|>a<|startoftext|> b", "ΑΣ ΑΣΑ Σ"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    rows = [*messy_rows, *enumerate(texts, 100)]
    got = bpe.decode(bpe.encode(frame(spark, rows).withColumn("n", F.monotonically_increasing_id()), VOCABULARY, id_column="text", decoded=True),
                     VOCABULARY, decoded="again").collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == r.again == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(frame(spark, rows[:0]), VOCABULARY).count() == 0
    with pytest.raises(KeyError):
        bpe.Vocabulary(open(VOCABULARY, encoding="utf-8").read()).decode([10**9])


def by_patterns(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                fine = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == "card":
                fine = 14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            else:
                fine = kind == "email" or 10 <= len(digits) <= 15
            if fine:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], personal.KINDS.index(s[2])))


def test_personal_base_patterns(spark, messy_rows):
    rng = random.Random(2)
    marks = personal.automaton()
    for letters, n in (("aB12345 0055..--@@+()_%\né,", 6000), ("12.", 4000), ("4 -", 2000), ("a.@b+", 4000), ("+1 (2).3", 4000)):
        for _ in range(n):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 70)))
            assert [s for s in personal.find(text, marks) if s[2] in personal.BASE] == by_patterns(text), text
    found = personal.find_personal(frame(spark, [*messy_rows, (90, "wrïte to a.b@c.org"), (91, "9" * 200_000)])).collect()
    assert len(found) == len(messy_rows) + 2
    spans = {r.doc_id: [(s.start, s.stop, s.kind) for s in r.found] for r in found}
    assert spans[90] == [(9, 18, "email")] and spans[91] == spans[30] == spans[31] == []
    assert personal.find_personal(frame(spark, [])).count() == 0


def test_personal_cues():
    marks = personal.automaton()
    text = "see https://u:pw@x.org/a?b=1). IBAN: DE89 3704 0044 0532 0130 00 or account no. 12345678 password=abcdef1234"
    assert [(text[a:b], k) for a, b, k in personal.find(text, marks)] == [
        ("https://u:pw@x.org/a?b=1", "url"), ("pw@x.org", "email"), ("DE89 3704 0044 0532 0130 00", "iban"), ("12345678", "account"),
        ("abcdef1234", "secret")]
    assert personal.find("IBAN: DE88 3704 0044 0532 0130 00, accountant 12345678", marks) == []


def test_personal_iban_before_capitals_and_digits():
    marks = personal.automaton()
    german, french, norse = "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606", "NO9386011117947"
    for iban in (german, german.replace(" ", ""), french, norse):
        for before in ("IBAN: ", "iban ", "Pay to ", "", "("):
            for after in (" BIC COBADEFF", " Please pay", " 1234 5678 9012", " A", ") X", " " + german[:9], " and more", "", "."):
                text = before + iban + after
                spans = [(text[a:b], k) for a, b, k in personal.find(text, marks) if k == "iban"]
                assert spans == [(iban, "iban")], text
    assert [text for text in (german + "7", german.replace("89", "88"), "X" + german, "0" + german, german[:-1] + " BIC X")
            if any(k == "iban" for *_, k in personal.find(text, marks))] == []
    two = f"IBAN {german} {french} BIC"
    assert [two[a:b] for a, b, k in personal.find(two, marks) if k == "iban"] == [german, french]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language.identify(docs, keep=["doc_id", "lang"]).where(language.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in told) / len(told) > 0.98
    assert all(0 <= r.lang_score <= 1 for r in told)
    assert sum(r.accepted for r in told) / len(told) > 0.98


def test_language_model_by_hand(spark):
    """Probabilities of every symbol after any context sum to one."""
    rng = random.Random(3)
    docs = frame(spark, [(i, prose(rng, 40), "xy"[i % 2]) for i in range(12)])
    model = language.train_model(docs)
    assert model.langs == ["x", "y"]
    alphabet = sorted({c for r in docs.collect() for c in r.text.lower()}) + ["q"]
    for context in ("ta", "no", "é l", "zzz"):
        total = np.zeros(2)
        for c in alphabet:
            grams = language.Grams([context + c])
            total += np.exp2(model.score(grams, grams.at[-1:])[0])
        # One place is left for symbols never seen.
        assert np.allclose(total, 1, atol=1e-3)


def test_language_keeps_every_gram_apart(spark, monkeypatch):
    """Counts, contexts and back-offs of a big alphabet by plain dictionaries, over many ranges and a small cache."""
    monkeypatch.setattr(language, "RANGE_ROWS", 5000)
    monkeypatch.setattr(language, "CACHE_BYTES", 100_000)
    rng = random.Random(13)
    rows = [(i, "".join(chr(0x4e00 + int(20000 * rng.random() ** 3)) for _ in range(rng.choice([1, 700]))), "xy"[i % 2]) for i in range(60)]
    model = language.train_model(frame(spark, rows))
    assert model.bits > 3 and model.n_bytes > language.CACHE_BYTES
    pad = "\0" * (language.ORDER - 1)
    seen = {x: [{} for _ in range(language.ORDER + 1)] for x in "xy"}
    for _, text, lang in rows:
        for i in range(len(text)):
            g = (pad + text)[i:i + language.ORDER]
            seen[lang][language.ORDER][g] = seen[lang][language.ORDER].get(g, 0) + 1
    for grams in seen.values():
        for k in range(language.ORDER - 1, 0, -1):
            for g in grams[k + 1]:
                grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1
    even = 1 / (len({*seen["x"][1], *seen["y"][1]}) + 1)
    rules = {}
    for lang, grams in seen.items():
        for k in range(1, language.ORDER + 1):
            once, twice = (sum(n == m for n in grams[k].values()) for m in (1, 2))
            of = {}
            for g, n in grams[k].items():
                total, kinds = of.get(g[:-1], (0, 0))
                of[g[:-1]] = total + n, kinds + 1
            rules[lang, k] = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9), of

    def chance(lang, g):
        if not g:
            return even
        discount, of = rules[lang, len(g)]
        total, kinds = of.get(g[:-1], (0, 0))
        lower = chance(lang, g[1:])
        return (max(seen[lang][len(g)].get(g, 0) - discount, 0) + discount * kinds * lower) / total if total else lower

    for text in (rows[1][1], rows[2][1], rows[3][1][:40] + rows[4][1][:40], "q"):
        grams = language.Grams([text])
        want = [[chance(x, (pad + text)[i:i + language.ORDER]) for x in "xy"] for i in range(len(text))]
        assert np.allclose(model.score(grams, grams.at), np.log2(want), atol=1e-4)


def test_language_messy(spark, messy_rows):
    docs = frame(spark, messy_rows)
    rows = language.identify(docs).collect()
    assert len(rows) == len(messy_rows) and "_lang_pred" in rows[0].asDict()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and r.accepted <= letters
    empty = language.identify(docs.limit(0))
    assert empty.count() == 0
    untaught = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}
    assert len(LONG) > 100_000
