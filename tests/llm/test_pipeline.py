"""Every stage of the corpus pipeline against loops over its own input."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from llm_rows import prose
from pyspark.sql import functions as F
from test_repeats import near_texts, plain_words, shingles
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from sievelight.llm.tables import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and a benchmark, and the tables after each stage."""
    rng = random.Random(21)
    near = near_texts(rng, 80)
    item = " ".join(max(near, key=len).split()[:14])
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(near)]
    rows += [(200 + i, prose(rng, 30) + "\n" + line, "en", "s", 0) for i, line in enumerate([prose(rng, 12)] * 4)]
    rows += [(301, None, "en", None, None), (302, "", None, "s", 0),
             (303, "?! 12", "en", "s", 5), (None, prose(rng, 40), "en", "s", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    tables = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], folder), name))
    return folder, [[r.asDict() for r in t.collect()] for t in tables]


def test_stages(spark, corpus):
    folder, (docs, known, lined, single, clean, coded) = corpus
    columns = {"doc_id", "text", "lang", "source", "n_chars"}
    assert all(set(r) == columns for t in (docs, known, lined, single, clean) for r in t)
    gone = {r["doc_id"] for r in docs} - {r["doc_id"] for r in known}
    assert gone >= {301, 302, 303} and len(gone) < 0.15 * len(docs)

    by_id = {r["doc_id"]: r for r in lined}
    assert all(r["n_chars"] == len(r["text"]) for r in lined)
    for r in known:
        kept = by_id[r["doc_id"]]["text"].split("\n") if r["doc_id"] in by_id else []
        assert set(kept) <= set(r["text"].split("\n"))
    every = [x for r in lined for x in r["text"].split("\n") if x]
    assert len(every) == len(set(every)) and set(every) <= {x for r in known for x in r["text"].split("\n")}

    left = {r["doc_id"] for r in single}
    sets = [(r["doc_id"], shingles(r["text"], 5)) for r in lined if r["doc_id"] is not None]
    group = {i: i for i, _ in sets}
    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert left == {None} | set(group.values())

    terms = plain_words(spark.read.parquet(f"{folder}/benchmark.parquet").first().text)
    windows = {tuple(terms[a:a + 10]) for a in range(len(terms) - 9)}
    for r in single:
        w = plain_words(r["text"])
        assert (r["doc_id"] in {x["doc_id"] for x in clean}) != any(tuple(w[a:a + 10]) in windows for a in range(len(w)))
    assert 0 < len(clean) < len(single)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    texts = {r["doc_id"]: r["text"] for r in clean}
    assert len(coded) == len(clean)
    for r in coded:
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)


def test_near_copies_of_scattered_changes_go(spark):
    """The stage against all pairs at five words and 0.8, with copies that three words and 0.9 do not link."""
    rng = random.Random(22)
    texts = []
    for n_words in (120, 200, 300):
        words = prose(rng, n_words).split(" ")
        texts.append(" ".join(words))
        for changes in range(1, n_words // 30 + 1):
            copy = list(words)
            for k in range(changes):
                copy[10 + k * (n_words - 20) // changes] = f"changed{k}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()}

    def left(size, bound):
        sets = [shingles(t, size) for t in texts]
        group = list(range(len(sets)))
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if 100 * len(x & y) >= bound * len(x | y):
                    low, high = sorted((group[i], group[j]))
                    group = [low if g == high else g for g in group]
        return set(group)

    assert got == left(5, 80)
    assert len(got) < len(left(3, 90))


def test_stages_leave_columns_of_any_name_alone(spark, corpus):
    """Documents with a column of every name that an operator makes: nothing crashes and no value changes."""
    folder, _ = corpus
    names = ["accepted", "_lang", "_kept", "_learn", "lang_pred", "lang_score", "lang_bits", "n_lines", "removed", "_gone_id", "_gone_version", "version",
             "n_shingles", "component_id", "component", "low", "star", "n_words", "n_hit", "n_items", "items", "contaminated", "_places", "_place_id", "_told",
             "_hits", "ids", "decoded", "_rest", "_", "key", "h1", "first", "line"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")) if i % 2 else F.col("doc_id").cast("int") + i)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name)
        rows = docs.collect()
        assert docs.columns[5:] == names and len(rows) > 20
        for r in rows:
            for i, c in enumerate(names):
                want = None if r.doc_id is None else f"{c}-{r.doc_id}" if i % 2 else r.doc_id + i
                assert r[c] == want, (name, c)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_run_equals_the_stages(spark, corpus):
    folder, tables = corpus
    got = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    key = lambda r: str(r["doc_id"])
    assert sorted(got, key=key) == sorted(tables[-1], key=key)


def test_empty_documents(spark, corpus, tmp_path):
    folder, _ = corpus
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        assert docs.count() == 0


def test_entry_registers_one_query_per_operator():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5
