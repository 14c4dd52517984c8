"""Data selection by importance resampling on hashed n-grams.

Two bag-of-n-grams models share one hashed space: one of the target texts, one of
all texts. The log-weight of a text is the sum, over its words and word pairs,
of the log-ratio of the two. Gumbel noise from a hash of the id is added, and the
``k`` largest sums are kept: a sample without replacement in proportion to the weights.

A bucket's ratio is ``((target + p * s) / (all + p)) / s`` with ``s`` the target's
share of all n-grams, so a rare bucket stays near one; a text's own counts are
taken out of both models first. Models have ``2 ** BUCKET_BITS`` cells whatever the
corpus holds, and every text is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.packed import LOWER, chunks, mix, span_hashes, text_bytes, words
from sievelight.llm.tables import written

BUCKET_BITS = 18
PRIOR = 8.0
TARGET_SAMPLE = 20_000
SEED = 7
KEY_SCALE = 1 << 20


def grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Owner and bucket of every word and of every pair of neighbouring words, letters A to Z lowered."""
    data, at = text_bytes(batch.column("text"))
    data = LOWER[data]
    starts, ends, before = words(data, at)
    h = span_hashes(data, starts, ends)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(before))
    pair = owner[1:] == owner[:-1]
    both = mix(h[:-1] * np.uint64(3) + h[1:])[pair]
    shift = np.uint64(64 - BUCKET_BITS)
    return np.concatenate([owner, owner[1:][pair]]), (np.concatenate([h, both]) >> shift).astype(np.int64)


def count_buckets(docs: DataFrame) -> DataFrame:
    """Counts over ``docs(text, is_target)``: bucket, n_all, n_target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in chunks(batches):
            owner, bucket = grams(batch)
            target = batch.column("is_target").to_numpy(zero_copy_only=False).astype(bool)[owner]
            n[0] += np.bincount(bucket, minlength=1 << BUCKET_BITS)
            n[1] += np.bincount(bucket[target], minlength=1 << BUCKET_BITS)
        seen = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[0][seen]), pa.array(n[1][seen])],
                                         ["bucket", "n_all", "n_target"])

    rows = docs.select("text", "is_target").mapInArrow(run, "bucket int, n_all long, n_target long")
    return rows.groupBy("bucket").agg(F.sum("n_all").alias("n_all"), F.sum("n_target").alias("n_target"))


def weigh(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``doc_id, n_grams, log_weight`` of every row of ``docs(doc_id, text, is_target)``.

    ``counts`` has one row per bucket at most, so it fits the driver by its parameter.
    """
    got = counts.toPandas()
    cells = np.zeros((2, 1 << BUCKET_BITS))
    cells[:, got["bucket"]] = got[["n_all", "n_target"]].to_numpy().T
    total = cells.sum(1)
    share = total[1] / total[0] if total[0] else 0.0
    shared = docs.sparkSession.sparkContext.broadcast((cells, share))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (everything, target), share = shared.value
        for batch in chunks(batches):
            owner, bucket = grams(batch)
            key, own = np.unique(owner << BUCKET_BITS | bucket, return_counts=True)
            owner, bucket = key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1)
            mine = own * batch.column("is_target").to_numpy(zero_copy_only=False).astype(bool)[owner]
            ratio = np.zeros(len(key))
            if share:
                n = everything[bucket] - own
                # The second term makes up for the logarithm of a small count being low on average.
                ratio = np.log((target[bucket] - mine + PRIOR * share) / (n + PRIOR) / share)
                ratio += (1 - share) / share * n / (n + PRIOR) ** 2 / 2
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.bincount(owner, own, batch.num_rows).astype(np.int64)),
                pa.array(np.bincount(owner, own * ratio, batch.num_rows))], ["doc_id", "n_grams", "log_weight"])

    return docs.select("doc_id", "text", "is_target").mapInArrow(run, f"doc_id {id_type}, n_grams long, log_weight double")


def gumbel(id_column: str, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on the id and the seed alone."""
    even = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_column), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(even))


def kth_largest(df: DataFrame, value: str, k: int) -> int | None:
    """The ``k``-th largest of a long column, by ever finer histograms of at most 4,096 bars; None if there are fewer."""
    low, high, n = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if not 0 < k <= n:
        return None
    while low < high:
        step = -(-(high - low + 1) // 4096)
        bar = F.floor((F.col(value) - F.lit(low)) / F.lit(step)) if step == 1 else F.expr(f"({value} - {low}L) div {step}L")
        bars = df.where(F.col(value).between(low, high)).groupBy(bar.alias("bar")).count().orderBy(F.desc("bar")).collect()
        for b, count in bars:
            if k <= count:
                low, high = low + b * step, min(high, low + (b + 1) * step - 1)
                break
            k -= count
    return low


def resample(docs: DataFrame, labels: DataFrame, keep_share: float | None = None, seed: int = SEED) -> DataFrame:
    """``doc_id, n_grams, log_weight, sort_key, kept`` for every row of ``docs``.

    The target texts are those labelled good and not toxic; the model of them is
    fitted on ``TARGET_SAMPLE`` of them at most, drawn by a hash of the id. ``k`` is
    ``keep_share`` of all rows, by default the share of target texts among the labelled.
    Rows that tie with the ``k``-th are kept. Without labels all weights are 0 and all rows are
    kept. A null or empty text has weight 0; repeated rows are weighed alike, with the same noise;
    a null id draws the noise of the seed alone and is never a target. Other columns are not read.
    """
    target = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()
    good = labels.where(target).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(TARGET_SAMPLE)
    n_good, n_labelled = labels.agg(F.count(F.when(target, 1)), F.count("quality")).first()
    if keep_share is None:
        keep_share = n_good / n_labelled if n_labelled else 1.0
    # At most TARGET_SAMPLE ids.
    good = written(good.select(F.col("doc_id").alias("_target")), "targets")
    rows = docs.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("_target"), "left").select(
        "doc_id", "text", F.col("_target").isNotNull().alias("is_target"))
    # The sum keeps its sign and 20 binary places as a long, which histograms cut exactly.
    noisy = F.col("log_weight") + gumbel("doc_id", seed)
    scored = written(weigh(rows, count_buckets(rows)).withColumn("sort_key", noisy).withColumn(
        "_key", F.floor(F.col("sort_key") * KEY_SCALE)), "weights")
    least = kth_largest(scored, "_key", int(keep_share * scored.count()))
    kept = F.lit(False) if least is None else F.col("_key") >= least
    return scored.select("doc_id", "n_grams", "log_weight", "sort_key", kept.alias("kept"))
