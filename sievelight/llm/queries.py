"""One query per operator over its whole table, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import bpe, collocations, decontaminate, importance, jaccard, language, licenses, linededup, personal, quality, sharding, suffix, trie
from sievelight.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


SHARDS = [f"shard-{i:03d}" for i in range(64)]


@query("op6_sharding", f"""
    SELECT doc_id, CAST(slot AS INTEGER) AS slot, (list_value({", ".join(repr(s) for s in SHARDS)}))[owner[slot + 1] + 1] AS shard
    FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} AS slot
          FROM documents),
         (SELECT CAST(string_split('{",".join(map(str, sharding.lookup_table(SHARDS)))}', ',') AS INTEGER[]) AS owner)""")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), SHARDS)


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return done.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op9_personal")
def op9_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(*personal.BASE))

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, personal.BASE),
        F.sha2(personal.spans_text(base).cast("binary"), 256).alias("base_sha256"),
        personal.spans_text(F.col("found")).alias("spans"))


@query("op8_language")
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, keep=["doc_id"]).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_bits", "accepted")


@query("op1_importance")
def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_RATES = {"symbols": "n_symbols * 1000 // n_words", "word_length": "word_chars * 100 // n_words",
          "dup_lines": "CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines END", "repeats": "n_repeat_words * 1000 // n_words"}
_LEVELS = {0: ("lang", "source"), 1: ("lang", "NULL"), 2: ("NULL", "NULL")}


@query("op2_quality", r"""
    WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 7], chr(31))) AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
    dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS n FROM win) WHERE n > 1),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY doc_id),
    ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
    m AS (SELECT t.doc_id, t.lang, t.source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                 len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines,
                 len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
          FROM t JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
    v AS (""" + " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {sql} AS v FROM b WHERE NOT base_failed"
                                   for m, sql in _RATES.items()) + """),
    c AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS v
          FROM v WHERE v IS NOT NULL),
    lv AS (""" + " UNION ALL ".join(f"SELECT {i} AS level, {a} AS lang, {s} AS source, measure, v FROM c" for i, (a, s) in _LEVELS.items()) + f"""),
    l AS (SELECT level, lang, source, measure, count(*) AS n, list_sort(list(v)) AS v FROM lv GROUP BY ALL),
    f AS (SELECT *, v[(n + 3) // 4] AS q25, v[(3 * n + 3) // 4] AS q75, v[(n + 99) // 100] AS q1, v[(99 * n + 99) // 100] AS q99 FROM l),
    h AS (SELECT *, CASE WHEN measure = 'word_length' THEN least(q25 - 3 * (q75 - q25), q1 - 3 * greatest(q1 // 32, 1)) ELSE 0 END AS low,
                 greatest(q75 + 3 * (q75 - q25), q99 + 3 * greatest(q99 // 32, 1)) AS high FROM f),
    lim AS (SELECT p.lang, p.source, p.measure,
                   CASE WHEN p.n >= {quality.GROUP_ROWS} THEN p.low WHEN q.n >= {quality.GROUP_ROWS} THEN q.low ELSE r.low END AS low,
                   CASE WHEN p.n >= {quality.GROUP_ROWS} THEN p.high WHEN q.n >= {quality.GROUP_ROWS} THEN q.high ELSE r.high END AS high
            FROM h p JOIN h q ON q.level = 1 AND p.lang IS NOT DISTINCT FROM q.lang AND p.measure = q.measure
            JOIN h r ON r.level = 2 AND r.measure = p.measure WHERE p.level = 0),
    bad AS (""" + " UNION ".join(
        f"SELECT doc_id FROM b JOIN lim ON lim.measure = '{m}' AND b.lang IS NOT DISTINCT FROM lim.lang "
        f"AND b.source IS NOT DISTINCT FROM lim.source WHERE n_words > 0 AND NOT ({sql}) BETWEEN low AND high" for m, sql in _RATES.items()) + """)
    SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b""")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


@query("op5_decontaminate", r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    win AS (SELECT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS t
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    g AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM win))),
    hit AS (SELECT DISTINCT g.doc_id, g.i, g.k, win.item_id FROM g JOIN win USING (k, t)),
    n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
           FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
    SELECT w.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return told.select("doc_id", "n_words", "n_hit", "n_items",
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op3_line_dedup", r"""
    WITH ln AS (SELECT doc_id, i - 1 AS n, string_split(text, chr(10))[i] AS raw, trim(string_split(text, chr(10))[i], e' \t\n\x0b\f\r') AS l
                FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    d AS (SELECT l, min(struct_pack(d := doc_id, n := n)) AS p FROM ln WHERE l <> '' GROUP BY l),
    c AS (SELECT a.l, b.p FROM d a JOIN d b ON left(a.l, (length(a.l) - 1) // 2) = left(b.l, (length(a.l) - 1) // 2)
          WHERE length(a.l) >= 20 AND length(b.l) >= 20 AND abs(length(a.l) - length(b.l)) <= 1 AND b.p < a.p AND levenshtein(a.l, b.l) <= 1
          UNION ALL
          SELECT a.l, b.p FROM d a JOIN d b ON right(a.l, (length(a.l) - 1) // 2) = right(b.l, (length(a.l) - 1) // 2)
          WHERE length(a.l) >= 20 AND length(b.l) >= 20 AND abs(length(a.l) - length(b.l)) <= 1 AND b.p < a.p AND levenshtein(a.l, b.l) <= 1),
    k AS (SELECT ln.doc_id, ln.n, ln.raw, ln.l <> '' AND (struct_pack(d := ln.doc_id, n := ln.n) > d.p OR ln.l IN (SELECT l FROM c)) AS gone
          FROM ln LEFT JOIN d USING (l))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(gone, FALSE)) AS n_removed,
           sha256(coalesce(string_agg(raw, chr(10) ORDER BY n) FILTER (WHERE NOT coalesce(gone, FALSE)), '')) AS kept_sha256
    FROM k GROUP BY doc_id""")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op7_jaccard")
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_groups(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op10_suffix")
def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.repeated_bytes(table(spark, sf_dir, "documents"))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    return done.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


_TEMPLATES = ", ".join(f"('{label}', {exact}, '{text}')" for exact, some in ((True, licenses.PHRASES), (False, licenses.NOTICES)) for text, label in some)


@query("op11_licenses", r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS (SELECT label, exact, string_split(words, ' ') AS p FROM (VALUES """ + _TEMPLATES + r""") AS v(label, exact, words)),
    u AS (SELECT *, CAST(greatest(8, pow(2, ceil(log2(len(p))))) AS BIGINT) AS width, len(list_distinct(p)) AS size FROM t),
    b AS (SELECT *, w[s + 1:s + 2 * width] AS span FROM (SELECT *, unnest(range(0, len(w), width)) AS s FROM w, u)),
    m AS (SELECT *, len(list_intersect(list_distinct(p), span)) AS common FROM b),
    h AS (SELECT *, CASE WHEN exact THEN list_transform(list_filter(range(0, width), lambda i: span[i + 1:i + len(p)] = p), lambda i: i + s) END AS places
          FROM m WHERE 100 * common >= (CASE WHEN exact THEN 100 ELSE """ + str(licenses.BOUND) + r""" END) * size),
    r AS (SELECT doc_id, coalesce(sum(len(places)), 0) AS n_base, min(list_min(places)) AS first_word, max(list_max(places)) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact) AS base_labels,
                 string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(common / size) AS score
          FROM h WHERE NOT exact OR len(places) > 0 GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, coalesce(score, 0) AS score
    FROM w LEFT JOIN r USING (doc_id)""")
def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = licenses.scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return told.withColumn("base_labels", F.array_join("base_labels", ",")).withColumn("labels", F.array_join("labels", ","))


@query("op13_collocations", rf"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
    g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f
          FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS v(k)) GROUP BY ALL),
    n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS s FROM g WHERE k > 1 AND f >= {collocations.LEAST}),
    cut AS (SELECT c.*, j, array_to_string(s[1:j], ' ') AS left_part, array_to_string(s[j + 1:], ' ') AS right_part
            FROM c, (VALUES (1), (2)) AS v(j) WHERE j < k),
    sc AS (SELECT cut.lang, cut.g, cut.k, a, s, j, x.f AS l, y.f AS r, CAST(a AS HUGEINT) * a * 1000000 // (CAST(x.f AS HUGEINT) * y.f) AS score
           FROM cut JOIN g x ON x.lang = cut.lang AND x.g = left_part JOIN g y ON y.lang = cut.lang AND y.g = right_part),
    best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
    held AS (SELECT lang, array_to_string(s[i:i + 1], ' ') AS g, max(a) AS longer FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, best.g) AS rank, best.g AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
    FROM best LEFT JOIN held USING (lang, g) JOIN n USING (lang)
    WHERE longer IS NULL OR 100 * longer < {collocations.SUBSUMED} * a
    QUALIFY rank <= {collocations.TOP}""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_conversation_trie", r"""
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, list(struct_pack(k := md5(strlen(role) || ':' || role || text), n := length(text)) ORDER BY i) AS s FROM t GROUP BY conv_id),
    h AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                    lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
                    4294967295) % 6 AS h FROM c),
    r AS (SELECT h.conv_id, list_concat(coalesce(b.s[1:h], []), h.s[h + 1:]) AS s FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
    k AS (SELECT conv_id, list_transform(s, lambda x: x.k) AS k, s FROM r),
    p AS (SELECT conv_id, d, array_to_string(k[1:d], ',') AS p, array_to_string(k[1:d - 1], ',') AS up, s[d].n AS n, d = len(s) AS ends
          FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM k)),
    n AS (SELECT p, d, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(min(n), 0) AS saved,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY p, d),
    ch AS (SELECT up AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
    f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (p)),
    a AS (SELECT array_to_string(l[1:d], ',') AS p, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
          FROM (SELECT CASE WHEN d = 0 THEN [] ELSE string_split(p, ',') END AS l, saved, n_children, unnest(range(0, d + 1)) AS d FROM f) GROUP BY 1)
    SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
    FROM f JOIN a USING (p) LEFT JOIN n u ON f.d > 0 AND u.p = f.up""")
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(trie.sequences(table(spark, sf_dir, "conversations"))))
