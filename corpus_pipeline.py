"""From raw documents to token ids: five stages, each a written table that the next one reads."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import bpe, decontaminate, jaccard, language, linededup
from sievelight.llm.tables import table, written

# The stages learn from the corpus and fold it, which SQL over the tables does not express.
ORACLE_SQL = None

# Near-duplicates by five-word shingles; the three words and 90 of op7_jaccard are that query's contract only.
NEAR_SHINGLE = 5
NEAR_BOUND = 80  # hundredths
REST = "_rest"


def packed(docs: DataFrame, *beside: str) -> DataFrame:
    """``doc_id``, ``text`` and the columns ``beside``, with all other columns in one struct, so that no name of an operator meets theirs."""
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")]
    return docs.select("doc_id", "text", *beside, F.struct(*others).alias(REST))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``docs``."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(REST)[c].alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the models accept.

    Null, empty and letterless texts have none and go. Each row is judged by itself, so repeated rows stay or go together, with
    a null id too. Ties between languages go to the first by name. Other columns, whatever their names, stay as they are.
    """
    return unpacked(language.identify(packed(docs, "lang")).where("accepted"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; one that loses all its words goes.

    Earlier is by id (null last), then by line. Null and empty texts lose nothing and stay. Repeated rows
    get the same text. Only ``n_chars``, if there, is counted again; other columns stay as they are.
    """
    done = linededup.drop_lines(packed(docs))
    emptied = (F.size("removed") > 0) & (F.btrim(F.col("text"), F.lit(linededup.SPACE)) == "")
    done = unpacked(done.where(~F.coalesce(emptied, F.lit(False))), docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates, and all documents outside groups.

    Rows that share the kept id stay, rows without an id or without words are in no group and stay. Other columns stay as they are.
    """
    groups = jaccard.link_groups(docs.select("doc_id", "text"), size=NEAR_SHINGLE, bound=NEAR_BOUND, keep=["doc_id"])
    copies = written(groups.where("component_id <> doc_id").select("doc_id").distinct(), "group-copies")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Texts without words have none and stay, all documents do where the benchmark is empty. Repeated rows stay or go together. Other
    columns stay as they are.
    """
    told = decontaminate.contaminated(packed(docs), table(spark, sf_dir, "benchmark"))
    return unpacked(told.where("NOT contaminated"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document as little-endian unsigned 32-bit integers, with digests of them and of the text they give back.

    A null text counts as empty and has no ids. One row for each document, repeated or not, in the columns named here only.
    """
    done = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
