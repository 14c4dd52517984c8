"""Benchmark passages in documents, by a distributed positional inverted index.

The corpus frequency of every benchmark term orders the terms of each test window
from rare to common. The index holds the postings (term, document, position) of the
terms that lead a window. The lists of a window's two rarest terms are shifted by
their offsets and intersected; what is left is compared word by word with the
text. Windows that share the two terms at one distance share a probe. The benchmark side
is joined as tables: Catalyst broadcasts them while they are small and shuffles
beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.tables import free_name, written

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Words of a text with A to Z lowered (and no other letter); null has none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.char_length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(low, SEPARATORS), "")


def test_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: ``terms`` and ``items``, the sorted ids (as text) of the items that hold them.

    An item with fewer words is one window; one without words has none. A null id counts as empty text.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w"))
    starts = items.where(F.size("w") > 0).select("item", "w", F.explode(F.sequence(
        F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))).alias("at"))
    return starts.select("item", F.slice("w", F.col("at"), size).alias("terms")).groupBy("terms").agg(
        F.array_sort(F.collect_set("item")).alias("items"))


def plan_windows(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """``windows`` whose terms all occur in ``docs``, with their rarest term ``w1`` at ``o1`` and the next, ``w2`` at ``o2``."""
    numbered = windows.withColumn("window", F.xxhash64("terms"))
    terms = numbered.select("window", F.posexplode("terms").alias("offset", "term"))
    vocabulary = written(terms.select("term").distinct(), "vocabulary")
    seen = docs.select(F.explode(words_of(F.col("text"))).alias("term")).join(vocabulary, "term", "left_semi")
    frequency = written(seen.groupBy("term").count(), "frequency")
    ranked = terms.join(frequency, "term", "left").groupBy("window").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "term", "offset"))).alias("r"))
    first = F.col("r")[0]
    other = F.filter("r", lambda x: x["term"] != first["term"])
    second = F.when(F.size(other) > 0, other[0])
    chosen = ranked.where(first["n"] > 0).select(
        "window", first["term"].alias("w1"), first["offset"].alias("o1"), second["term"].alias("w2"), second["offset"].alias("o2"))
    return numbered.join(chosen, "window").withColumn("gap", F.col("o2") - F.col("o1"))


def index_postings(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The inverted index: postings ``(term, doc_id, version, position)`` of the terms that lead a window."""
    leading = written(windows.select(F.explode(F.array("w1", "w2")).alias("term")).where("term IS NOT NULL").distinct(), "leading")
    rows = docs.select("doc_id", version("text").alias("version"), F.posexplode(words_of(F.col("text"))).alias("position", "term"))
    return written(rows.join(leading, "term").select("term", "doc_id", "version", "position"), "postings")


def version(text: str) -> Column:
    """Tells apart rows that share an id."""
    return F.xxhash64(text)


def _probes(postings: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    probe = F.xxhash64("w1", "w2", "gap").alias("probe")
    probes = written(windows.select(probe, "w1", "w2", "gap").distinct(), "probes")
    key = ["probe", "doc_id", "version"]
    led = postings.join(probes, F.col("term") == F.col("w1")).select(*key, "position", "w2", "gap")
    follow = postings.join(probes, F.col("term") == F.col("w2")).select(*key, "position", "gap")
    return led, follow, windows.withColumn("probe", probe)


def phrase_candidates(postings: DataFrame, windows: DataFrame) -> DataFrame:
    """Places where the two rarest terms of a window stand at their distance: doc_id, version, start, terms, items."""
    led, follow, windows = _probes(postings, windows)
    key = ["probe", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "version"]
    alone = led.where("w2 IS NULL").select("probe", "doc_id", "version", "position")
    pairs = led.where("w2 IS NOT NULL").select(*key, "doc_id", "position")
    shifted = follow.select(*key, (F.col("position") - F.col("gap")).alias("position"))
    both = pairs.join(shifted, ["probe", "_id", "version", "position"], "left_semi")
    found = alone.unionByName(both.select("probe", "doc_id", "version", "position"))
    return found.join(windows, "probe").select(
        "doc_id", "version", (F.col("position") - F.col("o1")).alias("start"), "terms", "items").where("start >= 0").distinct()


def proximity_matches(postings: DataFrame, windows: DataFrame, slack: int = 5) -> DataFrame:
    """Documents where a window's two rarest terms stand within ``slack`` words of their distance: doc_id, version, terms, least_shift."""
    led, follow, windows = _probes(postings, windows)
    cell = F.floor(F.col("position") / (slack + 1)).cast("long")
    near = led.where("w2 IS NOT NULL").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).alias("a").join(
        follow.withColumn("position", F.col("position") - F.col("gap")).withColumn("cell", cell).alias("b"),
        F.expr("a.probe = b.probe AND a.doc_id <=> b.doc_id AND a.version = b.version AND a.cell = b.cell"))
    shift = F.abs(F.col("a.position") - F.col("b.position"))
    least = near.where(shift <= slack).groupBy("a.probe", "a.doc_id", "a.version").agg(F.min(shift).alias("least_shift"))
    return least.join(windows, "probe").select("doc_id", "version", "terms", "least_shift")


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, size: int = WINDOW) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_words``, ``n_hit``, ``n_items``, ``items`` and ``contaminated``.

    A word is hit if it lies in an occurrence of a window; ``items`` are the sorted ids of the items that
    have occurring windows. A null or empty text has no words; an empty benchmark hits nothing. Rows
    that repeat are judged alike. Columns of ``docs`` with a clashing name move under a leading underscore.
    """
    for name in ("n_words", "n_hit", "n_items", "items", "contaminated"):
        if name in docs.columns:
            docs = docs.withColumnRenamed(name, free_name(docs, name))
    kept = keep or docs.columns
    rows = docs.select("doc_id", "text")
    windows = written(plan_windows(test_windows(benchmark, size), rows), "windows")
    found = phrase_candidates(index_postings(rows, windows), windows)
    places = written(found.groupBy("doc_id", "version").agg(
        F.collect_list(F.struct("start", "terms", "items")).alias("_places")), "places")
    places = places.select(F.col("doc_id").alias("_place_id"), F.col("version").alias("_place_version"), "_places")
    joined = docs.join(places, F.col("doc_id").eqNullSafe(F.col("_place_id")) & (version("text") == F.col("_place_version")), "left")
    words = words_of(F.col("text"))

    def compared(w: Column) -> Column:
        return F.filter("_places", lambda p: F.slice(w, p["start"] + 1, F.size(p["terms"])) == p["terms"])

    hits = F.transform(F.array(words), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.when(F.col("_places").isNotNull(), compared(w)).alias("hits")))[0]
    told = joined.select(*kept, hits.alias("_told")).select(*kept, "_told.n_words", F.coalesce(
        "_told.hits", F.array().cast("array<struct<start: int, terms: array<string>, items: array<string>>>")).alias("_hits"))
    covered = F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.sequence(h["start"], h["start"] + F.size(h["terms"]) - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.col("_hits.items"))))
    return told.select(
        *kept, "n_words", F.size(covered).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        items.alias("items"), (F.size("_hits") > 0).alias("contaminated"))
