"""Keyword, field and template edits, checked on ``documents`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.functions.capture import capture_context
from sievelight.operators import metadata as M
from sievelight.plans.registry import query, table


def _words(spark, sf):
    """Every document's words as its keyword list, whole texts."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return table(spark, sf, "documents").select("doc_id", "lang", "source", words.alias("keywords"))


@query("add_keywords", r"""
WITH w AS (SELECT doc_id, source, lang, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS kw FROM documents),
n AS (SELECT doc_id, kw, list_transform(kw, lambda x: replace(lower(x), 'ß', 'ss')) AS folds,
  [upper(source), lang, 'The', 'the', 'STRASSE'] AS inc FROM w),
m AS (SELECT *, list_transform(inc, lambda x: replace(lower(x), 'ß', 'ss')) AS fi FROM n)
SELECT doc_id, md5(array_to_string(kw || list_filter(inc, lambda x, i: NOT list_contains(folds, fi[i]) AND list_position(fi, fi[i]) = i), ' ')) AS keywords
FROM m""")
def add_keywords(spark, sf):
    incoming = F.array(F.upper("source"), F.concat(F.lit(" "), F.col("lang")), F.lit("The"), F.lit("the\u0007"),
                       F.lit("STRASSE"), F.lit("  "))
    return _words(spark, sf).select(
        "doc_id", F.md5(F.array_join(M.add_keywords(F.col("keywords"), incoming), " ")).alias("keywords"))


@query("remove_keyword", r"""
SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '' AND x <> 'the'), ' ')) AS keywords
FROM documents""")
def remove_keyword(spark, sf):
    return _words(spark, sf).select(
        "doc_id", F.md5(F.array_join(M.remove_keyword(F.col("keywords"), "the"), " ")).alias("keywords"))


@query("keyword_coverage", r"""
WITH w AS (SELECT lang, doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS kw FROM documents),
e AS (SELECT lang, doc_id, unnest(kw) AS keyword, unnest(range(len(kw))) AS spot FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY lang, keyword ORDER BY doc_id, spot) AS rn, count(*) OVER (PARTITION BY lang, keyword) AS n FROM e)
SELECT f.lang, keyword, n, total, doc_id AS first_row, spot AS first_at
FROM f JOIN (SELECT lang, count(*) AS total FROM documents GROUP BY lang) t ON t.lang = f.lang WHERE rn = 1""")
def keyword_coverage(spark, sf):
    rows = M.keyword_coverage(_words(spark, sf), F.col("keywords"), "doc_id", "doc_id", ["lang"])
    return rows.withColumn("first_at", F.col("first_at").cast("bigint"))


@query("field_summary", """
WITH f AS (SELECT c_nationkey, 'segment' AS field, CASE WHEN c_nationkey % 4 = 0 THEN 'ONE' ELSE c_mktsegment END AS value FROM customer
 UNION ALL SELECT c_nationkey, 'sign', CASE WHEN c_acctbal >= 0 THEN 'pos' END FROM customer
 UNION ALL SELECT c_nationkey, 'unset', NULL FROM customer),
g AS (SELECT c_nationkey, field, count(DISTINCT coalesce(value, chr(1))) > 1 AS mixed, min(value) AS low, count(*) AS "rows" FROM f GROUP BY ALL)
SELECT c_nationkey, field, CASE WHEN NOT mixed THEN low END AS value, mixed, "rows" FROM g""")
def field_summary(spark, sf):
    batch = table(spark, sf, "customer").select(
        "c_nationkey", F.when(F.col("c_nationkey") % 4 == 0, "ONE").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_acctbal") >= 0, "pos").alias("sign"), F.lit(None).cast("string").alias("unset"))
    return M.field_summary(batch, ["segment", "sign", "unset"], ["c_nationkey"])


def _customer_iptc(spark, sf):
    rows = table(spark, sf, "customer")
    ctx = capture_context(F.lit("2026:07:25 17:41:23"), F.lit(None).cast("timestamp"),
                          F.concat(F.col("c_name"), F.lit(".arw")), F.col("c_mktsegment"))
    return rows.select(
        "c_custkey", "c_nationkey", ctx.alias("context"), F.col("c_mktsegment").alias("city"),
        F.col("c_name").alias("headline"), F.lit(None).cast("string").alias("title"),
        F.array(F.initcap("c_mktsegment")).alias("keywords"))


@query("apply_template", """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS seq,
  count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_custkey, c_mktsegment AS city, CAST(NULL AS VARCHAR) AS headline,
  c_name || ' #' || lpad(CAST(seq AS VARCHAR), CAST(length(CAST(n AS VARCHAR)) AS INTEGER), '0') AS title,
  upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || CASE WHEN c_mktsegment <> 'BUILDING' THEN '|building' ELSE '' END || '|2026-07-25' AS keywords
FROM c""")
def apply_template(spark, sf):
    out = M.apply_template(_customer_iptc(spark, sf), {"title": " {filename} #{seq}\u0007", "headline": "  "},
                           ["building", "{date}"], ["c_nationkey"], ["c_custkey"])
    return out.select("c_custkey", "city", "headline", "title", F.array_join("keywords", "|").alias("keywords"))


@query("edit_fields", """
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'Old Town' ELSE c_mktsegment END AS city,
 CASE WHEN c_acctbal > 0 THEN NULL ELSE c_name END AS headline FROM customer""")
def edit_fields(spark, sf):
    rows = _customer_iptc(spark, sf)
    batch = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey")
    rows = M.edit_fields(rows, batch, ["c_custkey"], "city", " Old\u0007 Town ")
    rows = M.edit_fields(rows, batch, ["c_custkey"], "city", " \u0007 ")
    return M.edit_fields(rows, batch, ["c_custkey"], "headline", None).select("c_custkey", "city", "headline")


@query("revert_batch", "SELECT c_custkey, c_mktsegment AS city, c_name AS headline FROM customer")
def revert_batch(spark, sf):
    before = _customer_iptc(spark, sf)
    after = before.withColumns({"city": F.when(F.col("c_nationkey") < 10, "X").otherwise(F.col("city")),
                                "headline": F.when(F.col("c_nationkey") >= 10, F.col("headline"))})
    snapshot = before.where("c_nationkey < 10")
    return M.revert_batch(after, snapshot, ["c_custkey"], ["city", "headline"]).select("c_custkey", "city", "headline")
