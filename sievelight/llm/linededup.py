"""Near-duplicate lines by a deletion-neighbourhood join, with an edit bound of one.

Two lines are within one edit exactly if they share a variant with at most one
character deleted (at the same place, where both lose one). All variants of a line
are hashed, equal hashes meet in one group, and the group's earliest line reaches
each member: groups are folded to their least position, so no pairs are listed. The
match is then verified by edit distance.

Emitting the variants of every line would cost a row per character. Three
exact sieves come before: equal lines are folded to their first place; by
the pigeonhole a line within one edit of another shares its first or its last
part with it; and the edit lies within one region of ``REGION`` characters, with
everything around it equal. Only regions that another line shares emit variants.
None of the sieves loses a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.tables import free_name, written

MIN_CHARS = 20
REGION = 64
BROADCAST_LINES = 500_000
SPACE = " \t\n\x0b\f\r"


def version(text: str = "text") -> Column:
    """Tells apart rows that share an id."""
    return F.xxhash64(text)


def place(id_column: str = "doc_id", line: str = "line_no") -> Column:
    """Sort key of a line's place: by id with null last, then by line."""
    return F.struct(F.col(id_column).isNull().alias("late"), F.col(id_column).alias("id"), F.col(line).alias("line"))


def lines_of(docs: DataFrame) -> DataFrame:
    """Lines with a word, without the white space around them: doc_id, version, line_no, line, and a hash of 128 bits."""
    rows = docs.select("doc_id", version().alias("version"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.btrim(F.col("line"), F.lit(SPACE))).where("line <> ''")
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _part_keys() -> list[Column]:
    """Hashes of the first and last part of a line, for its own length and, where that differs, for one character less."""
    size = F.char_length("line")
    part, shorter = F.floor(size / 8) * 4, F.floor((size - 1) / 8) * 4
    long_enough = size >= MIN_CHARS

    def first(n: Column) -> Column:
        return F.xxhash64(F.lit("first"), F.left(F.col("line"), n.cast("int")))

    def last(n: Column) -> Column:
        return F.xxhash64(F.lit("last"), F.right(F.col("line"), n.cast("int")))

    both = long_enough & (part != shorter)
    return [F.when(long_enough, first(part)), F.when(long_enough, last(part)), F.when(both, first(shorter)), F.when(both, last(shorter))]


def _regions(lines: DataFrame) -> DataFrame:
    """Regions of each line in two roles: as the line is, and as the longer line that loses a character in the region."""
    size = F.char_length("line")
    roles = F.array(*[F.struct(F.lit(extra).alias("extra"), F.sequence(
        F.lit(0), F.floor((size - 1 - extra) / REGION).cast("int")).alias("at")) for extra in (0, 1)])
    each = lines.withColumn("_role", F.explode(roles)).withColumn("at", F.explode("_role.at")).withColumn("extra", F.col("_role.extra"))
    begin = F.col("at") * REGION
    end = begin + REGION + F.col("extra")
    around = F.xxhash64("at", F.left(F.col("line"), begin), F.substring(F.col("line"), end + 1, size))
    return each.select("h1", "h2", "first", "extra", around.alias("around"), F.substring(F.col("line"), begin + 1, REGION + F.col("extra")).alias("region"))


def _variants(regions: DataFrame) -> DataFrame:
    """Hashed variants: kind 0 is the region itself, 1 the longer line less a character, 2 a character less at a stated place."""
    size = F.char_length("region")
    cut = regions.withColumn("cut", F.explode(F.sequence(F.when(F.col("extra") == 0, F.lit(0)).otherwise(F.lit(1)), size)))
    rest = F.concat(F.left(F.col("region"), F.col("cut") - 1), F.substring(F.col("region"), F.col("cut") + 1, size))
    whole = F.col("cut") == 0
    kind = F.when(whole, 0).when(F.col("extra") == 1, 1).otherwise(2)
    key = F.xxhash64("around", F.when(whole, F.col("region")).otherwise(rest), F.when(kind == 2, F.col("cut")).otherwise(-1), F.when(kind == 2, size).otherwise(-1))
    return cut.select("h1", "h2", "first", kind.alias("kind"), key.alias("key"))


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Lines ``(h1, h2)`` that lie within one edit of an earlier different line.

    ``distinct`` has each line once: h1, h2, its first place, its part keys.
    """
    parts = distinct.select("h1", "h2", F.explode(F.array_compact(F.array("k0", "k1", "k2", "k3"))).alias("key"))
    shared = parts.groupBy("key").agg(F.min("h1").alias("_low"), F.max("h1").alias("_high")).where("_low < _high").select("key")
    ids = parts.join(shared, "key", "left_semi").select("h1", "h2").distinct()
    candidates = written(distinct.select("h1", "h2", "first").join(ids, ["h1", "h2"], "left_semi"), "line-candidates")
    few = candidates.count() <= BROADCAST_LINES
    found = lines_of(docs).withColumn("first", place())
    texts = written(found.join(F.broadcast(candidates) if few else candidates, ["h1", "h2", "first"]).select(
        "h1", "h2", "first", "line"), "line-texts")

    regions = _regions(texts)
    shared = regions.groupBy("around").agg(F.min("h1").alias("_low"), F.max("h1").alias("_high")).where("_low < _high").select("around")
    variants = _variants(regions.join(shared, "around", "left_semi"))
    groups = variants.groupBy("key").agg(
        *[F.min(F.when(F.col("kind") == k, F.col("first"))).alias(f"f{k}") for k in range(3)],
        F.min("h1").alias("_low"), F.max("h1").alias("_high")).where("_low < _high")
    reach = F.when(F.col("kind") == 0, F.col("f1")).when(F.col("kind") == 1, F.col("f0")).otherwise(F.col("f2"))
    met = variants.join(groups, "key").select("h1", "h2", "first", reach.alias("near")).where("near < first")
    met = met.groupBy("h1", "h2").agg(F.min("near").alias("near"))
    earlier = texts.select(F.col("first").alias("near"), F.col("line").alias("_earlier"))
    checked = met.join(texts, ["h1", "h2"]).join(earlier, "near")
    return checked.where(F.levenshtein("line", "_earlier", 1).between(0, 1)).select("h1", "h2").distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, version, removed``: the numbers of the lines that go, for documents that lose any."""
    first, last, first_less, last_less = _part_keys()
    found = lines_of(docs)
    occurrences = written(found.select("doc_id", "version", "line_no", "h1", "h2", first.alias("k0"), last.alias("k1"),
                                       first_less.alias("k2"), last_less.alias("k3")), "lines")
    distinct = written(occurrences.groupBy("h1", "h2").agg(
        F.min(place()).alias("first"), F.count("*").alias("n"), *[F.max(k).alias(k) for k in ("k0", "k1", "k2", "k3")]), "distinct-lines")
    near = written(near_lines(docs, distinct).withColumn("near", F.lit(True)), "near-lines")
    known = distinct.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left").where("n > 1 OR near")
    gone = occurrences.select("doc_id", "version", "line_no", "h1", "h2").join(known, ["h1", "h2"]).where(
        F.coalesce("near", F.lit(False)) | (place() > F.col("first")))
    return gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines removed that equal, or lie within one edit of, an earlier line; plus ``n_lines`` and ``removed``.

    Earlier is by id (null last), then by line number, whatever the order of rows. Lines are compared without
    the white space around them; those shorter than ``MIN_CHARS`` go only when equal, and lines without a word always stay.
    Rows that share an id count as one document: only a line of an earlier document or an
    earlier number of their own counts, and repeated rows get the same result. A null text stays null. Columns
    that clash with a new name move under a leading underscore.
    """
    for name in ("n_lines", "removed"):
        if name in docs.columns:
            docs = docs.withColumnRenamed(name, free_name(docs, name))
    gone = removed_lines(docs.select("doc_id", "text")).select(
        F.col("doc_id").alias("_gone_id"), F.col("version").alias("_gone_version"), "removed")
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (version() == F.col("_gone_version")), "left")

    def kept(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
        return F.array_join(F.transform(numbers, lambda i: lines[i]), "\n")

    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.transform(F.array(F.split("text", "\n")), kept)[0])
    n_lines = F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0))
    others = [c for c in docs.columns if c != "text"]
    out = joined.select(*others, text.alias("text"), n_lines.cast("long").alias("n_lines"),
                        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    return out.select(*docs.columns, "n_lines", "removed")
