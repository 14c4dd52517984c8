"""License notices, the conversation trie and collocations, against loops over small inputs."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_rows import LONG, frame, prose
from pyspark.sql import functions as F

from sievelight.llm import collocations, licenses, trie
from sievelight.llm.queries import ORACLES, QUERIES

LOWER = {i: i + 32 for i in range(65, 91)}
SMALL = "/root/testdata/sf0.001"


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def licenses_by_loops(text, phrases, notices, bound):
    words = license_words(text)
    places, base, labels, score = [], set(), set(), 0.0
    for phrase, label in phrases:
        p = license_words(phrase)
        found = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += found
        if found:
            base.add(label)
            labels.add(label)
            score = 1.0
    for notice, label in notices:
        t = set(license_words(notice))
        width = 8
        while width < len(license_words(notice)):
            width *= 2
        for s in range(0, len(words), width):
            share = len(t & set(words[s:s + 2 * width])) / len(t)
            if 100 * len(t & set(words[s:s + 2 * width])) >= bound * len(t):
                labels.add(label)
                score = max(score, share)
    return (len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels), round(score, 9))


@pytest.mark.parametrize("bound", [60, 85, 100])
def test_licenses_by_loops(spark, messy_rows, bound):
    rng = random.Random(31)
    notices = [n for n, _ in licenses.NOTICES]
    rows = list(messy_rows)
    for i in range(100, 180):
        said = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice([rng.choice(notices), rng.choice([p for p, _ in licenses.PHRASES]), prose(rng, 30)]).split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(["the", "Xx", "license", "UNDER"])
            said.append(" ".join(words))
        rows.append((i, rng.choice([". ", "\n", " ", "—"]).join(said)))
    rows += [(200, LONG + " under the MIT-license " + LONG + "cc BY nc"), (201, "under the mit license under the mit license"), rows[40], rows[40]]
    got = licenses.scan_licenses(frame(spark, rows), bound=bound).collect()
    want = sorted(repr((r[0], r[1], licenses_by_loops(r[1], licenses.PHRASES, licenses.NOTICES, bound))) for r in rows)
    have = sorted(repr((r.doc_id, r.text, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)))) for r in got)
    assert have == want
    assert sum("gpl-3" in r.labels for r in got) > 5
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_licenses_of_other_templates(spark, messy_rows):
    docs = frame(spark, [*messy_rows, (50, "a b a b a b a"), (51, "b a b")])
    got = {r.doc_id: r for r in licenses.scan_licenses(docs, ["doc_id"], phrases=[("a b a", "x")], notices=[]).where("doc_id >= 50").collect()}
    assert (got[50].n_base, got[50].first_word, got[50].last_word) == (3, 0, 4) and got[51].n_base == 0
    assert licenses.scan_licenses(docs, ["doc_id"], phrases=[], notices=[]).where("score > 0 OR size(labels) > 0").count() == 0
    blocks = licenses.template_blocks(docs.select("doc_id", "text"), phrases=[], notices=[("a b", "y")])
    assert {(r.doc_id, r.first, r.last, r.share) for r in blocks.collect()} == {(50, 0, 6, 1.0), (51, 0, 2, 1.0)}


def trie_by_loops(convs):
    """Nodes of conversations given as {id: [(role, text), ...]}."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for p, ids in members.items():
        under = [q for q in members if q[:len(p)] == p]
        inner = {q[:-1] for q in under if q}
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), sum(1 for q in under if len(q) == len(p) + 1),
                    sum(1 for q in under if q not in inner), sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q),
                    hashlib.sha256(",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(p)).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed):
    rng = random.Random(seed)
    turns = [("user", "hi"), ("assistant", "hi"), ("", "é" * 5), ("user", ""), ("user", "long " * 9), ("a", "b"), ("ab", "")]
    rows = []
    for c in [*range(0, 40), *range(95, 130), 200, 299, 305, 1000, -3, -100, -207]:
        for t in range(rng.randint(1, 7)):
            role, text = rng.choice(turns[:rng.choice([2, 7])])
            rows.append((c, t, role or None, text or None))
    rows += [(7, None, "user", "first"), (None, 0, "user", "nobody's"), (8, 1, None, None), rows[3], rows[3]]
    rows += [(c, 0, "user", "same") for c in range(2000, 2700)] + [(500, t, "user", str(t)) for t in range(300)]
    return rows


def rebuilt_by_loops(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, (role or "", text or "")))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


@pytest.mark.parametrize("shard_turns", [1, 7, 60, 400_000])
def test_trie_by_loops(spark, shard_turns, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 50)
    rows = conversations(shard_turns)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, n_convs int")
    got = trie.prefix_trie(trie.rebuilt(trie.sequences(table)), shard_turns=shard_turns)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == trie_by_loops(rebuilt_by_loops(rows))


def test_trie_of_nothing(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.rebuilt(trie.sequences(table))).count() == 0
    # A conversation whose turns are all replaced and whose base is absent is the root alone.
    alone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5)
    table = spark.createDataFrame([(alone, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in trie.prefix_trie(trie.rebuilt(trie.sequences(table))).collect()] == [
        (alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_search_tree_is_balanced():
    tree = trie.Tree()
    for i in trie.medians(1000):
        tree.insert([i], [1])

    def height(v):
        return 0 if v < 0 else 1 + max(height(tree.low[v]), height(tree.high[v]))
    assert height(tree.next[0]) == 10 and sorted(trie.medians(17)) == list(range(17))


def collocations_by_loops(rows, top, least, subsumed):
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts[lang if lang is not None else "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        chosen = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [f[q] for q in f if len(q) == 3 and len(p) == 2 and f[q] >= least and p in (q[:2], q[1:])]
            if any(100 * b >= subsumed * a for b in longer):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            chosen.append((-score, -a, " ".join(p).encode(), left, right))
        n = sum(c for p, c in f.items() if len(p) == 1)
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(chosen)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("top", "least", "flush"), [(2000, 10, 2_000_000), (7, 3, 50), (40, 1, 200)])
def test_collocations_by_loops(spark, messy_rows, monkeypatch, top, least, flush):
    monkeypatch.setattr(collocations, "FLUSH_WORDS", flush)
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 5000)
    monkeypatch.setattr(collocations, "BLOCK", 7)
    rng = random.Random(41)
    some = ["New", "york", "City", "die", "ß", "É", "é", "a", "b", "x\x00y", "=", "(c)"]
    rows = [(r[0], r[1], (*r, "en", "s")[2]) for r in messy_rows if r[0] != 34]
    for i in range(100, 250):
        rows.append((i, "".join(rng.choice(some) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "?"]) for _ in range(rng.randint(0, 60))),
                     rng.choice(["en", "de", None, "und"])))
    got = collocations.collocations(frame(spark, rows), top=top, least=least)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == collocations_by_loops(rows, top, least, 50)
    assert collocations.collocations(frame(spark, [])).count() == 0


def test_scores_are_exact(spark):
    rng = random.Random(42)
    rows = []
    for _ in range(300):
        a = rng.randint(10, 10 ** rng.randint(2, 14))
        rows.append((a, rng.randint(a, 10 ** 15), rng.randint(a, 10 ** 15)))
    rows += [(10 ** 15, 10 ** 15, 10 ** 15), (9_999_999_999_999, 9_999_999_999_999, 10 ** 13)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("*", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r.s == 1_000_000 * r.a * r.a // (r.l * r.r) for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("name", ["op11_licenses", "op12_conversation_trie", "op13_collocations"])
def test_mining_queries_against_sql(spark, name):
    import oracle
    assert oracle.compare(spark, oracle.duck(SMALL), QUERIES[name], ORACLES[name], SMALL) is None
