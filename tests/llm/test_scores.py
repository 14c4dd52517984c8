"""Importance resampling and quality rules."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import oracle
import pyarrow as pa
from llm_rows import frame, prose
from pyspark.sql import functions as F

from sievelight.llm import importance, quality
from sievelight.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_kth_largest(spark):
    rng = random.Random(4)
    values = [rng.choice([rng.randint(-10**12, 10**12), rng.randint(-3, 3)]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 700, 1500, 3000):
        assert importance.kth_largest(df, "v", k) == ordered[k - 1]
    assert importance.kth_largest(df, "v", 0) is importance.kth_largest(df, "v", 3001) is None


def test_importance_weights_by_hand(spark):
    """Log-weights from plain dictionaries over buckets, one text at a time."""
    rng = random.Random(5)
    docs = [(i, prose(rng, 30)) for i in range(30)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i == 4)) for i in range(20)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in importance.resample(frame(spark, docs), labels).collect()}
    target = {i for i in range(20) if i % 3 and i != 4}
    grams = {i: importance.grams(pa.RecordBatch.from_pydict({"text": [t]}))[1].tolist() for i, t in docs}
    everything, good = {}, {}
    for i, g in grams.items():
        for b in g:
            everything[b] = everything.get(b, 0) + 1
            good[b] = good.get(b, 0) + (i in target)
    share, prior = sum(good.values()) / sum(everything.values()), importance.PRIOR
    for i, g in grams.items():
        assert got[i].n_grams == len(g) == 2 * 30 - 1
        want = 0.0
        for b in g:
            n, t = everything[b] - g.count(b), good[b] - g.count(b) * (i in target)
            want += math.log((t + prior * share) / (n + prior) / share) + (1 - share) / share * n / (n + prior) ** 2 / 2
        assert math.isclose(got[i].log_weight, want, abs_tol=1e-9)
    k = int(30 * len(target) / 20)
    keys = sorted((r.sort_key for r in got.values()), reverse=True)
    assert {i for i, r in got.items() if r.kept} == {i for i, r in got.items() if r.sort_key >= keys[k - 1]}


def test_gumbel_is_gumbel(spark):
    noise = np.array([r[0] for r in spark.range(20000).select(importance.gumbel("id")).collect()])
    assert abs(noise.mean() - np.euler_gamma) < 0.03 and abs(noise.std() - math.pi / math.sqrt(6)) < 0.03


def test_importance_messy(spark, messy_rows):
    docs = frame(spark, messy_rows)
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, None), (2, 0, 1), (None, 1, 0), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = importance.resample(docs, labels).collect()
    assert len(rows) == len(messy_rows)
    assert {r.log_weight for r in rows if r.doc_id in (30, 31, 32)} == {0.0}
    assert all(r.kept for r in importance.resample(docs, labels.limit(0)).collect())
    assert importance.resample(docs.limit(0), labels).count() == 0


def test_importance_tells_junk(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    told = QUERIES["op1_importance"](spark, "/root/testdata/sf0.01").join(labels, "doc_id")
    shares = {r.quality: r.share for r in told.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert shares[0] < 0.2 and shares[1] > 0.75


def repeated(words):
    seen, gone = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            gone.update(p + j for p in at for j in range(8))
    return len(gone)


def test_quality_counts(spark, messy_rows):
    rng = random.Random(6)
    rows = [*messy_rows, *((100 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in range(60))]
    rows += [(200, "a # b\n\n a # b\na # b\nc"), (201, "x " * 30)]
    got = quality.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.setdefault(i, []).append((len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
                                       len(lines) - len(set(lines)), repeated(words)))
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in want[r.doc_id]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge(frame(spark, [])).count() == 0


def test_quality_fences_adapt(spark):
    """A source of tables keeps its symbols, while one text full of them fails in a source of prose."""
    rng = random.Random(7)
    rows = [(i, prose(rng, 60), "en", "prose") for i in range(300)]
    rows += [(1000 + i, " | ".join(prose(rng, 2) for _ in range(30)), "en", "tables") for i in range(300)]
    rows += [(5000, " | ".join(prose(rng, 2) for _ in range(30)), "en", "prose")]
    kept = {r.doc_id: r.kept for r in quality.judge(frame(spark, rows)).collect()}
    assert not kept[5000] and sum(kept[i] for i in range(300)) == 300 and sum(kept[1000 + i] for i in range(300)) == 300


def test_repeaters_fail_in_a_clean_source_only(spark):
    """A quarter of repeated words, or half the lines, is too much where others have none and common where most have it."""
    rng = random.Random(17)

    def repeater():
        phrase = prose(rng, 9)
        return " ".join([prose(rng, 27), phrase, prose(rng, 27), phrase])

    def lines():
        return "\n".join([prose(rng, 12), *[prose(rng, 3)] * 4, prose(rng, 12), prose(rng, 12)])

    rows = [(i, prose(rng, 72), "en", "clean") for i in range(300)]
    rows += [(1000 + i, repeater(), "en", "songs") for i in range(300)] + [(2000 + i, lines(), "en", "lists") for i in range(300)]
    rows += [(5000, repeater(), "en", "clean"), (5001, lines(), "en", "clean")]
    kept = {r.doc_id: r.kept for r in quality.judge(frame(spark, rows)).collect()}
    assert not kept[5000] and not kept[5001]
    assert all(sum(kept[a + i] for i in range(300)) >= 297 for a in (0, 1000, 2000))


def test_quality_equals_sql(spark):
    assert oracle.compare(spark, oracle.duck(SMALL), QUERIES["op2_quality"], ORACLES["op2_quality"], SMALL) is None
