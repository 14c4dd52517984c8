"""Line dedup, decontamination, the Jaccard join and suffix arrays against loops."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import oracle
import pytest
from llm_rows import frame, prose
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import decontaminate, groups, jaccard, linededup, suffix
from sievelight.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def edited(rng, line, edits=1):
    for _ in range(edits):
        i = rng.randint(0, len(line))
        line = rng.choice([line[:i] + rng.choice("xé ") + line[i:], line[:i] + line[i + 1:], line[:i] + rng.choice("yß") + line[i + 1:]])
    return line


def test_line_dedup_by_brute_force(spark, messy_rows):
    rng = random.Random(8)
    seeds = [prose(rng, n) for n in (4, 5, 9, 20, 20, 45)] + ["x" * 63 + "y", "ab" * 32, "z" * 130]
    rows = [r for r in messy_rows if r[0] not in (33, 34)]
    for i in range(100, 160):
        rows.append((i, "\n".join(rng.choice(["  ", ""]) + edited(rng, rng.choice(seeds), rng.choice([0, 1, 1, 2, 3])) for _ in range(rng.randint(1, 5)))))
    got = linededup.drop_lines(frame(spark, rows)).collect()
    assert len(got) == len(rows) and "_removed" in got[0].asDict()

    def at(doc, n):
        return (doc is None, doc or 0, n)

    places = [(at(d, n), line.strip(linededup.SPACE)) for d, t, *_ in rows for n, line in enumerate((t or "").split("\n")) if line.strip(linededup.SPACE)]
    first = {}
    for p, line in places:
        first[line] = min(first.get(line, p), p)
    near = {a for a, p in first.items() for b, q in first.items()
            if q < p and len(a) >= 20 and len(b) >= 20 and a != b and within_one_edit(a, b)}
    assert len(near) > 20
    texts = {}
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        gone = [n for n, x in enumerate(lines) if x.strip(linededup.SPACE)
                and (at(d, n) > first[x.strip(linededup.SPACE)] or x.strip(linededup.SPACE) in near)]
        texts.setdefault(d, []).append((gone, None if t is None else "\n".join(x for n, x in enumerate(lines) if n not in gone)))
    for r in got:
        assert (r.removed, r.text) in texts[r.doc_id]
    assert linededup.drop_lines(frame(spark, [])).count() == 0


def test_long_lines_in_every_region(spark):
    """One edit anywhere in lines of several regions is found; two edits are not."""
    rng = random.Random(9)
    rows, near = [], []
    for k, size in enumerate((127, 128, 129, 200, 1000)):
        line = "".join(rng.choice("abcdefg ") for _ in range(size)).strip() + "q"
        rows.append((k, line))
        for i in (0, 1, 62, 63, 64, 65, 126, 127, size // 2, len(line) - 2, len(line) - 1):
            i = min(i, len(line) - 1)
            for other in (line[:i] + "w" + line[i:], line[:i] + line[i + 1:], line[:i] + "w" + line[i + 1:]):
                near.append((100 * (k + 1) + len(near), other))
        rows.append((50 + k, "w" + line[:size // 2] + "w" + line[size // 2:]))
    got = {r.doc_id: r.removed for r in linededup.drop_lines(frame(spark, rows + near)).collect()}
    assert all(got[i] == [0] for i, _ in near if _.strip() == _)
    assert all(got[i] == [] for i in range(5)) and all(got[50 + i] == [] for i in range(5))


@pytest.mark.parametrize("few", [True, False])
def test_line_dedup_equals_sql(spark, monkeypatch, few):
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 10**6 if few else 0)
    assert oracle.compare(spark, oracle.duck(SMALL), QUERIES["op3_line_dedup"], ORACLES["op3_line_dedup"], SMALL) is None


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_decontaminate_by_brute_force(spark, messy_rows):
    rng = random.Random(10)
    items = [(i, prose(rng, rng.choice([1, 2, 5, 9, 10, 11, 30]))) for i in range(25)]
    items += [(3, items[5][1]), (None, "the null item has ten words of its own so there"), (90, None), (91, ""), (92, "to to to to to to to to to to to"), (93, items[7][1])]
    rows = list(messy_rows)
    for i in range(100, 140):
        item = rng.choice(items)[1] or "none"
        words = item.upper().split()
        a = rng.randint(0, len(words))
        rows.append((i, prose(rng, rng.randint(0, 12)) + " " + ", ".join(words[a:a + rng.choice([9, 10, 30])]) + "! " + prose(rng, 5)))
    rows += [(200, "To! " * 40), (201, "É".join(["to"] * 12))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, rows), benchmark).collect()
    assert len(got) == len(rows) and "_items" in got[0].asDict()
    windows = {}
    for i, text in items:
        w = plain_words(text)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a:a + 10]), set()).add("" if i is None else str(i))
    want = {}
    for i, text, *_ in rows:
        w, hit, found = plain_words(text), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if tuple(w[a:a + size]) in windows:
                    hit.update(range(a, a + size))
                    found |= windows[tuple(w[a:a + size])]
        want.setdefault(i, []).append((len(w), len(hit), len(found), sorted(found), bool(hit)))
    assert sum(x[0][4] for x in want.values()) > 15
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) in want[r.doc_id]
    assert not any(r.contaminated for r in decontaminate.contaminated(frame(spark, rows[:30]), benchmark.limit(0)).collect())
    assert decontaminate.contaminated(frame(spark, []), benchmark).count() == 0


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    near = item.replace("beta ", "beta so very ")
    docs = frame(spark, [(1, item), (2, near), (3, "alpha " + "x " * 40 + item.split(" ", 1)[1]), (4, "the " * 50)])
    windows = decontaminate.plan_windows(decontaminate.test_windows(spark.createDataFrame([(1, item)], "item_id long, text string")), docs)
    postings = decontaminate.index_postings(docs, windows)
    got = {r.doc_id: r.least_shift for r in decontaminate.proximity_matches(postings, windows, 5).collect()}
    chosen = windows.first()
    cut = {"alpha", "beta"} & {chosen.w1, chosen.w2}
    assert got[1] == 0 and got[2] == (2 if len(cut) == 1 else 0) and 4 not in got


def test_decontaminate_equals_sql(spark):
    assert oracle.compare(spark, oracle.duck(SMALL), QUERIES["op5_decontaminate"], ORACLES["op5_decontaminate"], SMALL) is None


def test_components(spark):
    rng = random.Random(11)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1080)] + [(None, 3), (4, None), (5, 5)]
    got = {r.node: r.component for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent}


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near_texts(rng, n):
    """Texts in families: copies, and copies with some words changed, dropped or doubled."""
    out = []
    for i in range(n):
        if not out or rng.random() < 0.2:
            out.append(prose(rng, rng.choice([1, 2, 3, 4, 8, 11, 13, 25, 60, 61, 250])))
            continue
        words = rng.choice(out[-12:]).split(" ")
        for _ in range(rng.choice([0, 1, 1, 1, 2, 4])):
            k = rng.randrange(len(words))
            words[k:k + rng.randint(0, 1)] = [rng.choice(["new", "ta", "x"])] * rng.randint(0, 1)
            words = words or ["x"]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("size", "bound", "piece"), [(3, 90, 512), (3, 90, 3), (5, 80, 4), (1, 50, 512)])
def test_jaccard_by_brute_force(spark, messy_rows, monkeypatch, size, bound, piece):
    monkeypatch.setattr(jaccard, "SLICE", piece)
    rng = random.Random(12)
    rows = [*messy_rows, *((1000 - i, t) for i, t in enumerate(near_texts(rng, 150)))]
    got = jaccard.link_groups(frame(spark, rows), size, bound, keep=["doc_id"] if piece == 3 else None).collect()
    assert len(got) == len(rows) if piece == 3 else len(got) >= len(rows)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, size)) for i, t, *_ in rows if i is not None]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= bound * len(a | b) and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert len({x for x in parent if find(x) != x}) > 20
    for r in got:
        assert r.component_id == (None if r.doc_id is None else find(r.doc_id))
    counts = {}
    for i, t, *_ in rows:
        counts.setdefault(i, set()).add(len(shingles(t, size)))
    assert all(r.n_shingles in counts[r.doc_id] for r in got)
    assert jaccard.link_groups(frame(spark, [])).count() == 0


def test_tiles_hold_every_link():
    """Sets at the bound share a tile, for many sizes and the worst spread of differences."""
    rng = np.random.default_rng(13)
    for bound in (50, 80, 90, 95):
        for n in [*range(1, 60), 99, 100, 101, 350, 1000]:
            a = rng.integers(1, 1 << 63, n, dtype=np.uint64)
            most = int(n * (100 - bound) / (100 + bound) * 2)
            for gone in {0, most // 2, most}:
                for new in {0, most - gone}:
                    b = np.unique(np.concatenate([a[gone:], rng.integers(1, 1 << 63, new, dtype=np.uint64)]))
                    s = np.unique(a)
                    if len(b) and jaccard.similar(s, b, bound):
                        width = jaccard.width_of(min(len(s), len(b)))
                        one = jaccard.folded(jaccard.bitmap(s, jaccard.width_of(len(s))), width)
                        assert (one == jaccard.bitmap(s, width)).all()
                        assert jaccard.may_link(np.array([len(s)]), one[None], len(b), jaccard.bitmap(b, width), bound)[0]
                        assert np.intersect1d(jaccard.tile_keys(s, bound), jaccard.tile_keys(b, bound)).size


def test_suffix_array():
    rng = random.Random(14)
    for _ in range(400):
        n, depth = rng.randint(1, 80), rng.randint(1, 60)
        symbols = np.array([rng.randint(0, 3) for _ in range(n)] + [0], np.int16)
        array = suffix.suffix_array(symbols, depth)
        heads = [tuple(symbols[i:i + depth]) + (0,) * (depth - len(symbols[i:i + depth])) for i in array]
        upto = [h[:h.index(0)] if 0 in h else h for h in heads]
        assert sorted(array) == list(range(n + 1)) and upto == sorted(upto)
        common = suffix.common_prefixes(array, symbols, depth)
        for k in range(1, len(array)):
            same = next((i for i, (x, y) in enumerate(zip(heads[k - 1], heads[k], strict=True)) if x != y), depth)
            assert common[k] == same


def test_suffix_array_of_wanted_places_only():
    rng = random.Random(16)
    for _ in range(300):
        n, depth = rng.randint(1, 80), rng.randint(1, 60)
        symbols = np.array([rng.randint(0, 3) for _ in range(n)] + [0], np.int16)
        wanted = np.array([rng.random() < 0.3 for _ in range(n + 1)])
        some = suffix.suffix_array(symbols, depth, wanted)
        heads = [tuple(symbols[i:i + depth]) + (0,) * (depth - len(symbols[i:i + depth])) for i in some]
        upto = [h[:h.index(0)] if 0 in h else h for h in heads]
        assert set(np.flatnonzero(wanted)) <= set(some) and len(set(some)) == len(some) and upto == sorted(upto)


def test_anchors_without_a_common_window_are_left_out(spark):
    """What reaches the suffix arrays follows what documents have in common, not the short phrases that all of them hold."""
    rng = random.Random(17)
    phrase, passage = "a phrase that many texts hold", "".join(rng.choice("abcdefghij ") for _ in range(60))

    def opened(common: str) -> DataFrame:
        noise = lambda: "".join(chr(rng.randint(0x430, 0x44f)) for _ in range(60))
        docs = spark.createDataFrame([(i, noise() + common + noise()) for i in range(40)], "doc_id long, text string")
        marks = suffix.repeated_anchors(suffix.anchor_blocks(docs, 4, 50), 50).withColumn("hot", F.lit(False))
        return suffix.open_surroundings(suffix.compressed(docs), marks, 50)

    assert opened(phrase).count() == 0
    got = opened(passage).collect()
    assert {r.doc_id for r in got} == set(range(40))
    # Only what the ranges of common windows reach into, not always the whole surrounding of 84 bytes.
    assert min(len(r.bytes) for r in got) < 84


def test_equal_pieces_are_folded():
    order = np.array([5, 3, 3, 9, suffix.NO_ID])
    assert suffix.folded([b"x", b"x", b"x", b"y", b"y"], order).tolist() == [True, False, False, False, True]


@pytest.mark.parametrize("hot", [50_000, 3])
def test_repeated_bytes_by_brute_force(spark, messy_rows, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(15)
    passages = [prose(rng, n) for n in (8, 10, 12, 40, 100)] + ["a" * 70, "ab" * 40, "x" * 49, "é" * 30]
    rows = [r for r in messy_rows if r[0] not in (33, 34)]
    for i in range(100, 170):
        rows.append((i, "".join(rng.choice([prose(rng, rng.randint(0, 6)), rng.choice(passages)[rng.randint(0, 9):], rng.choice(passages)]) for _ in range(rng.randint(1, 5)))))
    got = suffix.repeated_bytes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    length, seen = 50, {}
    ordered = [(suffix.NO_ID if i is None else i, i, (t or "").encode()) for i, t, *_ in rows]
    for order, _, text in sorted(ordered, key=lambda r: r[0]):
        for a in range(len(text) - length + 1):
            seen.setdefault(text[a:a + length], order)
    want = {}
    for order, i, text in ordered:
        gone = np.zeros(len(text) + 2, bool)
        for a in range(len(text) - length + 1):
            if seen[text[a:a + length]] < order:
                gone[a + 1:a + 1 + length] = True
        edges = np.flatnonzero(np.diff(gone))
        kept = bytes(b for b, g in zip(text, gone[1:-1], strict=True) if not g)
        want.setdefault(i, []).append((len(text), [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True)], kept))
    assert sum(bool(x[0][1]) for x in want.values()) > 30
    for r in got:
        assert (r.n_bytes, [(s.begin, s.end) for s in r.removed], bytes(r.kept)) in want[r.doc_id]
    assert suffix.repeated_bytes(frame(spark, [])).count() == 0


def test_repeated_bytes_of_long_texts(spark, messy_rows):
    rows = [r for r in messy_rows if r[0] in (33, 34)]
    got = {r.doc_id: r for r in suffix.repeated_bytes(frame(spark, rows)).collect()}
    assert got[33].removed == [] and [(s.begin, s.end) for s in got[34].removed] == [(0, len(rows[0][1]))] and bytes(got[34].kept) == b"x"


def test_queries_return_their_columns(spark):
    want = {
        "op7_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op10_suffix": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
        "op5_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    }
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    for name, columns in want.items():
        got = QUERIES[name](spark, SMALL)
        assert dict(got.dtypes) == columns and got.count() == len(docs)
    digest = {r.doc_id: r for r in QUERIES["op10_suffix"](spark, SMALL).where(F.col("n_removed") == 0).collect()}
    assert digest and all(digest[d].kept_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for d, t in docs if d in digest)
