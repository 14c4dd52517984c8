"""Connected components of a table of links, and joins to groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.tables import written

ROWS_PER_SALT = 1_000_000


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, row_id: list[str]) -> DataFrame:
    """``rows`` joined with ``groups``, one row per ``keys``, whose column ``count`` tells how many rows each has.

    A group of more than ``ROWS_PER_SALT`` rows is repeated once per such part, and its rows spread over the parts by a hash
    of ``row_id``. Such groups number at most one per ``ROWS_PER_SALT`` rows, which bounds what is broadcast.
    """
    salts = F.ceil(F.col(count) / ROWS_PER_SALT).cast("int")
    hot = groups.where(F.col(count) > ROWS_PER_SALT).select(*keys, salts.alias("_salts"))
    spread = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*row_id), F.coalesce("_salts", F.lit(1))).cast("int"))
    repeated = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return spread.drop("_salts").join(repeated, [*keys, "_salt"]).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its smallest node.

    Each round hangs every node below the smallest node among its neighbours
    and their roots, so the depth of the trees at least halves; a round is a
    written table. Smallest values are combined before the shuffle and a node with very many
    links is looked up in parts. Null ends take no part.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    root = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component"), F.count("*").alias("degree")), "roots")
    next_to = both.withColumnRenamed("b", "node")
    while True:
        # The smallest root next to each node, passed to its root as well, then one jump.
        near = spread_join(next_to, root, ["node"], "degree", ["a"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        known = root.join(near, "node").withColumn("near", F.least("near", "component"))
        lower = known.select("node", "near").unionByName(known.select(F.col("component").alias("node"), "near"))
        lower = lower.groupBy("node").agg(F.min("near").alias("near"))
        old = root.select("node", F.col("component").alias("_old"), "degree")
        jump = lower.select(F.col("node").alias("near"), F.col("near").alias("_jump"))
        step = lower.join(old, "node").join(jump, "near", "left").select(
            "node", F.least("near", F.coalesce("_jump", "near")).alias("component"), "degree", "_old")
        step = written(step, "roots")
        root = step.select("node", "component", "degree")
        if step.where("component <> _old").isEmpty():
            return root.select("node", "component")
