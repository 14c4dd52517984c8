"""Quality rules whose limits adapt to each language and source.

Every measure is counted in the plan from the whole text. Its quantile sketch is
a histogram over values cut to six significant binary digits, so a quantile is
off by at most 1/32 of its value; sketches merge by adding counts, which gives the
sketch of a language, and of everything, from those of its sources. The limits of
a group are Tukey fences around its quartiles, moved out to its 99th (and 1st) percentile and three steps of
the sketch where that lies further out, as in groups where most texts have none of what is measured. There
is no fixed limit: what fails in a clean source may pass in one full of it. Limits are joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.tables import written

# Measures, and whether low values fail too.
MEASURES = {
    "symbols": False,  # symbols per 1,000 words
    "word_length": True,  # characters per 100 words
    "dup_lines": False,  # repeated lines per 1,000 lines
    "repeats": False,  # words in repeated windows per 1,000 words
}
FENCE = 3
GROUP_ROWS = 200
WINDOW = 8
SPACE = r"[\x20\x09-\x0D]"


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), then)[0]


def _shifted(array: Column, by: int) -> Column:
    return F.slice(array, by + 1, F.size(array))


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def repeat_words(words: Column) -> Column:
    """Words inside windows of eight that stand in the text twice or more, by 64-bit hashes of the windows."""

    def hashes(words: Column) -> Column:
        one = F.transform(words, lambda w: F.xxhash64(w))

        def doubled(array: Column, by: int) -> Column:
            return bind(array, lambda a: F.zip_with(a, _shifted(a, by), lambda x, y: F.xxhash64(x, y)))

        return F.slice(doubled(doubled(doubled(one, 1), 2), 4), 1, F.size(words) - (WINDOW - 1))

    def covered(starts: Column) -> Column:
        steps = F.zip_with(starts, _shifted(starts, 1), lambda p, q: F.least(F.coalesce(q - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda total, n: total + n)

    def starts(ordered: Column) -> Column:
        same = F.zip_with(ordered, _shifted(ordered, 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        either = bind(same, lambda s: F.zip_with(s, F.concat(F.array(F.lit(False)), F.slice(s, 1, F.size(s) - 1)), lambda a, b: a | b))
        return F.array_sort(F.filter(F.zip_with(ordered, either, lambda w, r: F.when(r, w["i"])), lambda i: i.isNotNull()))

    def count(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) < F.size(found), bind(bind(ordered, starts), covered)).otherwise(0)

    return F.when(F.size(words) >= WINDOW, bind(hashes(words), count)).otherwise(0).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the counts of the whole text; null has no words."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    counts = bind(words_of(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(w).alias("n_repeat_words")))
    rest = [c for c in docs.columns if c != text]
    return docs.select(
        *rest, counts.alias("_counts"), dup.alias("_lines"),
        F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
    ).select(*rest, "_counts.*", "n_symbols", F.col("_lines.n").cast("long").alias("n_lines"),
             F.col("_lines.dup").cast("long").alias("n_dup_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def rates() -> dict[str, Column]:
    """The adaptive measures as whole numbers; null where there is nothing to measure."""
    def share(part: str, of: str, scale: int) -> Column:
        return F.expr(f"CASE WHEN {of} > 0 THEN {part} * {scale} DIV {of} END")

    return {"symbols": share("n_symbols", "n_words", 1000), "word_length": share("word_chars", "n_words", 100),
            "dup_lines": share("n_dup_lines", "n_lines", 1000), "repeats": share("n_repeat_words", "n_words", 1000)}


def sketches(rows: DataFrame, groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Mergeable sketches: rows of (groups, measure, value, n) with values cut to six binary digits."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), c.alias("value")) for m, c in rates().items()])
    each = rows.select(*groups, F.explode(pairs).alias("_pair")).select(*groups, "_pair.*").where("value IS NOT NULL")
    cut = F.expr("shiftleft(shiftright(value, greatest(length(bin(value)) - 6, 0)), greatest(length(bin(value)) - 6, 0))")
    return each.groupBy(*groups, "measure", cut.alias("value")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Lowest and highest allowed value of each measure for each pair of groups.

    A pair with fewer than ``GROUP_ROWS`` rows takes the fences of its first group,
    and those of everything where that is small too.
    """
    first, second = groups
    by_pair = sketch.withColumn("_level", F.lit(0))
    by_first = sketch.groupBy(first, "measure", "value").agg(F.sum("n").alias("n")).select(
        first, F.lit(None).cast(sketch.schema[second].dataType).alias(second), "measure", "value", "n", F.lit(1).alias("_level"))
    by_all = sketch.groupBy("measure", "value").agg(F.sum("n").alias("n")).select(
        F.lit(None).cast(sketch.schema[first].dataType).alias(first), F.lit(None).cast(sketch.schema[second].dataType).alias(second),
        "measure", "value", "n", F.lit(2).alias("_level"))
    every = by_pair.unionByName(by_first).unionByName(by_all)
    key = ["_level", first, second, "measure"]
    whole = Window.partitionBy(*key)
    upto = whole.orderBy("value")
    ranked = every.withColumn("_upto", F.sum("n").over(upto)).withColumn("_total", F.sum("n").over(whole))

    def quantile(hundredths: int) -> Column:
        return F.min(F.when(F.col("_upto") * 100 >= F.col("_total") * hundredths, F.col("value")))

    quartiles = ranked.groupBy(*key).agg(*[quantile(q).alias(f"q{q}") for q in (1, 25, 75, 99)], F.max("_total").alias("rows"))
    spread = (F.col("q75") - F.col("q25")) * FENCE

    def steps(value: str) -> Column:
        """Three steps of the sketch at a value: a 32nd of it, or one."""
        return F.greatest(F.expr(f"{value} DIV 32"), F.lit(1)) * FENCE

    both = F.col("measure").isin([m for m, two in MEASURES.items() if two])
    fenced = quartiles.select(
        *key, "rows", F.when(both, F.least(F.col("q25") - spread, F.col("q1") - steps("q1"))).otherwise(0).alias("low"),
        F.greatest(F.col("q75") + spread, F.col("q99") + steps("q99")).alias("high"))
    pairs = fenced.where("_level = 0").drop("_level").alias("p")
    firsts = fenced.where("_level = 1").alias("f")
    alls = fenced.where("_level = 2").alias("a")
    joined = pairs.join(firsts, F.col(f"p.{first}").eqNullSafe(F.col(f"f.{first}")) & (F.col("p.measure") == F.col("f.measure")))
    joined = joined.join(alls, F.col("p.measure") == F.col("a.measure"))

    def pick(name: str) -> Column:
        return (F.when(F.col("p.rows") >= GROUP_ROWS, F.col(f"p.{name}")).when(F.col("f.rows") >= GROUP_ROWS, F.col(f"f.{name}"))
                .otherwise(F.col(f"a.{name}")))

    chosen = joined.select(f"p.{first}", f"p.{second}", "p.measure", pick("low").alias("low"), pick("high").alias("high"))
    return chosen.groupBy(first, second).agg(*[
        F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("low", "high")])


def judge(docs: DataFrame, groups: tuple[str, str] = ("lang", "source"), id_column: str = "doc_id") -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every row of ``docs``.

    A row is kept if it passes the base rules and every measure lies within the
    fences of its language and source. The fences come from rows that pass the base
    rules; a group without such rows has none, and all its rows have failed. Null groups are groups of their own. A
    null or empty text fails. Rows that repeat are judged alike, each counted. Columns
    other than the id, the groups and the text are not read.
    """
    first, second = groups
    rows = written(measured(docs.select(id_column, *groups, "text")).withColumn("base_failed", base_failed()), "measures")
    limits = written(fences(sketches(rows.where(~F.col("base_failed")), groups), groups), "fences").alias("l")
    on = F.col(f"r.{first}").eqNullSafe(F.col(f"l.{first}")) & F.col(f"r.{second}").eqNullSafe(F.col(f"l.{second}"))
    within = F.lit(True)
    for name, rate in rates().items():
        within &= F.coalesce(rate.between(F.col(f"{name}_low"), F.col(f"{name}_high")), F.lit(True))
    return rows.alias("r").join(limits, on, "left").select(
        f"r.{id_column}", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & within).alias("kept"))
