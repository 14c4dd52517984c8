"""Similarity join of texts by the Jaccard index of their word n-grams, exact at its bound.

Sets are cut by size into bands, and a set that may link to a smaller one of the band
below stands in that band too. In a band the hash range is cut into more parts
than two linked sets can differ in shingles: a tile is a band and the content of one part. A set that can differ
from its partners in ``d`` shingles agrees with each of them in all its filled parts but ``d``, so it stands in the
tiles of its ``d + 1`` largest parts only, ties by content. That order is the same for both sets, and of the parts in which they agree the
largest is among those of both. A set of ``d`` filled parts or fewer (a small one, by chance) stands in
the tiles of its first shingles as well, of which two linked sets must share one.

Each set is compared with the smallest id it meets in any tile. That links most families whole. Tiles of
one smallest id make one group, where each set stands once. Groups that still hold two or more components
are compared inside: every set outside the group's largest component with every set of another component, slice by slice.

Each set has a hashed bitmap of four bits a shingle or more. ``|A| - |bits of A not in B|`` bounds the overlap from
above; only pairs that pass are listed, and intersected as sorted arrays. Groups are compared by bitmaps alone, which are
a sixteenth of the sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.groups import components, spread_join
from sievelight.llm.packed import LOWER, chunks, mix, signed, span_hashes, text_bytes, words
from sievelight.llm.tables import free_name, written

SHINGLE = 3
BOUND = 90  # hundredths
LEAST_BITS = 512
SLICE = 512  # sets of a group that are compared in one task with as many others,
SLICE_SHINGLES = 1 << 20  # or fewer, if they have more shingles than this
PARTS = 1.2  # parts of a band for each one that linked sets need


def shingle_sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and where each text begins (one more at the end)."""
    data, at = text_bytes(batch.column("text"))
    starts, ends, before = words(LOWER[data], at)
    h = span_hashes(LOWER[data], starts, ends)
    counts = np.diff(before)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(counts)), n)
    at_word = np.arange(n.sum()) - first[owner] + before[:-1][owner]
    length = np.minimum(counts, size)[owner]
    total = np.zeros(len(owner), np.uint64)
    for k in range(size):
        more = k < length
        total[more] = mix(total[more] * np.uint64(5) + h[at_word[more] + k])
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (total[1:] != total[:-1])
    owner, total = owner[new], total[new]
    return total, np.searchsorted(owner, np.arange(len(counts) + 1))


def band_edge(band: int, bound: int) -> float:
    """Smallest size of a band; bands are three bound-ratios wide."""
    return (100 / bound) ** (3 * band)


def band_of(n: int, bound: int) -> int:
    band = max(0, int(np.log(n) / np.log(100 / bound) / 3) - 1)
    while band_edge(band + 1, bound) <= n:
        band += 1
    return band


def parts_of(band: int, bound: int) -> int:
    """Parts of a band: ``PARTS`` times the shingles by which its largest sets and their partners can differ."""
    return int(PARTS * (most_different(int(band_edge(band + 1, bound)), bound) + 1))


def most_different(n: int, bound: int) -> int:
    """Shingles by which a set of ``n`` and one that it links to can differ."""
    return n * (100 - bound) // bound


def tile_keys(hashes: np.ndarray, bound: int) -> np.ndarray:
    """Keys of the tiles of one set in each band where it stands, see the module's docstring."""
    n = len(hashes)
    band = band_of(n, bound)
    bands = [band, band - 1] if band and n * bound < 100 * band_edge(band, bound) + 1 else [band]
    differ = most_different(n, bound)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    out = []
    for b in bands:
        parts = parts_of(b, bound)
        # A part is a range of the hash space, so its content is a slice of the sorted set.
        cuts = np.searchsorted(hashes, (np.arange(1, parts) * (2.0 ** 64 / parts)).astype(np.uint64))
        edges = np.concatenate([[0], cuts, [n]])
        size = np.diff(edges)
        filled = np.flatnonzero(size)
        content = mix((sums[edges[1:]] - sums[edges[:-1]] + size.astype(np.uint64))[filled])
        largest = np.lexsort((content, size[filled]))[-(differ + 1):]
        out.append(mix(content[largest] * np.uint64(3) + mix(filled[largest].astype(np.uint64) + np.uint64(1_000_003 * (b + 1)))))
        if len(filled) <= differ:
            first = hashes[:n - -(-n * bound // 100) + 1]
            out.append(mix(first * np.uint64(5) + mix(np.full(1, 1_000_003 * (b + 1) - 1, np.uint64))))
    return np.concatenate(out)


def _per_text(docs: DataFrame, size: int, columns: str, values: Callable[[list[np.ndarray], np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """``doc_id`` and what ``values`` makes of the shingle sets of each batch of texts (the sets, all hashes, where each begins)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, at = shingle_sets(batch, size)
            sets = [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *values(sets, hashes, at)], names)

    return docs.mapInArrow(run, f"doc_id {id_type}, {columns}")


def set_sums(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, c1, c2``: each row's set size and a 128-bit hash of its set."""
    def values(sets: list[np.ndarray], hashes: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        sums = np.zeros((2, len(hashes) + 1), np.uint64)
        np.cumsum(mix(hashes), out=sums[0, 1:])
        np.cumsum(mix(hashes + np.uint64(77)), out=sums[1, 1:])
        return [pa.array(np.diff(at)), *(pa.array(signed(mix(s[at[1:]] - s[at[:-1]]))) for s in sums)]

    return _per_text(docs, size, "n_shingles long, c1 long, c2 long", values)


def tiles(docs: DataFrame, size: int, bound: int) -> DataFrame:
    """``doc_id, key``: the tiles of each row."""
    def values(sets: list[np.ndarray], hashes: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        return [pa.array([signed(tile_keys(s, bound)) if len(s) else np.zeros(0, np.int64) for s in sets], pa.list_(pa.int64()))]

    return _per_text(docs, size, "keys array<long>", values).select("doc_id", F.explode("keys").alias("key"))


def width_of(n: int) -> int:
    """Bits of the bitmap of a set: a power of two, four for each shingle or more."""
    return max(LEAST_BITS, 1 << int(4 * n - 1).bit_length())


def bitmap(hashes: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, np.uint8)
    bits[(hashes >> np.uint64(20)) % np.uint64(width)] = 1
    return np.packbits(bits)


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap as it would be with fewer bits."""
    return np.bitwise_or.reduce(bits.reshape(-1, width // 8), axis=0)


def similar(a: np.ndarray, b: np.ndarray, bound: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
    return 100 * common >= bound * (len(a) + len(b) - common)


def may_link(sizes: np.ndarray, maps: np.ndarray, size: int, one: np.ndarray, bound: int) -> np.ndarray:
    """Whether sets may link to one set, by sizes and by the bits each has that the other lacks."""
    most = np.minimum(sizes - np.bitwise_count(maps & ~one).sum(1), size - np.bitwise_count(one & ~maps).sum(1))
    return 100 * most >= bound * (sizes + size - most)


def near_pairs(ids: list, sizes: np.ndarray, maps: list[np.ndarray], loose: np.ndarray, group: np.ndarray, bound: int) -> list[tuple]:
    """Pairs of a loose row and one that is not loose, of different groups, that sizes and bitmaps do not keep apart."""
    order = np.argsort(sizes, kind="stable")
    sizes, loose, group = sizes[order], loose[order], group[order]
    width = min((len(m) * 8 for m in maps), default=LEAST_BITS)
    maps = np.stack([folded(maps[i], width) for i in order]) if len(order) else np.zeros((0, width // 8), np.uint8)
    out = []
    for i in np.flatnonzero(loose):
        begin = int(np.searchsorted(sizes, -(-sizes[i] * bound // 100), "left"))
        end = int(np.searchsorted(sizes, sizes[i] * 100 // bound, "right"))
        near = begin + np.flatnonzero(~loose[begin:end] & (group[begin:end] != group[i]))
        near = near[may_link(sizes[near], maps[near], int(sizes[i]), maps[i], bound)]
        out += [(ids[order[i]], ids[order[j]]) for j in near]
    return out


def meetings(keyed: DataFrame) -> DataFrame:
    """``doc_id, low``: each id of ``keyed`` (``key, doc_id``) with the smallest ids, ``low``, of the tiles where it is not the smallest.

    Keys are dealt once and their rows come in order, so a tile is never held as a whole.
    """
    low = F.first("doc_id").over(Window.partitionBy("key").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return keyed.select("doc_id", low.alias("low")).where("doc_id <> low").distinct()


def _set(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x, np.int64).view(np.uint64) for x in column.to_numpy(zero_copy_only=False)]


def set_table(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``shingles`` and ``bits`` of the rows of ``docs`` that ``wanted`` names, with all columns of ``wanted``."""
    types = [(f.name, f.dataType.simpleString()) for f in wanted.schema.fields]
    names = [name for name, _ in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, at = shingle_sets(batch, size)
            sets = [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in names), pa.array([signed(s) for s in sets], pa.list_(pa.int64())),
                pa.array([bitmap(s, width_of(len(s))).tobytes() for s in sets], pa.binary())], [*names, "shingles", "bits"])

    # A merge join at every size: the texts are dealt once, and a large corpus costs in proportion what a small one does.
    rows = docs.join(wanted.hint("merge"), "doc_id").select(*names, "text")
    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in types) + ", shingles array<long>, bits binary")


def compared(pairs: DataFrame, bound: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets ``shingles`` and ``other`` link: by bitmaps, then by intersection of the sorted arrays."""
    id_type = pairs.schema["a"].dataType.simpleString()

    def linked(a: np.ndarray, b: np.ndarray) -> bool:
        width = width_of(min(len(a), len(b)))
        return bool(may_link(np.array([len(a)]), bitmap(a, width)[None], len(b), bitmap(b, width), bound)[0]) and similar(a, b, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(_set(batch.column("shingles")), _set(batch.column("other")), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([linked(a, b) for a, b in both], pa.bool_()))

    return pairs.select("a", "b", "shingles", "other").mapInArrow(run, f"a {id_type}, b {id_type}")


def star_links(sets: DataFrame, bound: int) -> DataFrame:
    """Links ``(a, b)`` between each row of ``sets`` and the row whose id is its ``star``."""
    centre = sets.where("centre").select(F.col("doc_id").alias("b"), F.col("shingles").alias("other"))
    own = sets.where("NOT centre").select(F.col("doc_id").alias("a"), F.col("star").alias("b"), "shingles")
    return compared(own.join(centre, "b"), bound)


def open_groups(placed: DataFrame) -> DataFrame:
    """``low, main, parts, homes`` of the groups of ``placed`` (``low, doc_id, n, component``) that hold two components or more.

    ``main`` is the group's largest component. A group of the same sets as another is left out.
    """
    counted = placed.groupBy("low", "component").agg(
        F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("sign"))
    group = counted.groupBy("low").agg(
        F.max(F.struct("rows", "component")).alias("most"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("sign").alias("sign"),
        F.count("*").alias("components")).where("components > 1")
    group = group.groupBy("sign", "rows", "n").agg(F.min("low").alias("low"), F.first("most").alias("most"))
    loose = F.col("rows") - F.col("most.rows")
    slices = F.greatest(F.ceil(F.col("rows") / SLICE), F.ceil(F.col("n") / SLICE_SHINGLES))
    return group.select("low", F.col("most.component").alias("main"), slices.alias("parts"), F.ceil(slices * loose / F.col("rows")).alias("homes"))


def group_pairs(placed: DataFrame, opened: DataFrame, sets: DataFrame, bound: int) -> DataFrame:
    """Pairs ``(a, b)`` of different components of an open group that sizes and bitmaps do not keep apart."""
    id_type = placed.schema["doc_id"].dataType.simpleString()
    inside = placed.join(opened, "low").join(sets.where("own").select("doc_id", F.size("shingles").alias("size"), "bits"), "doc_id")
    row = ["low", "doc_id", "component", "size", "bits"]
    right = inside.select(*row, F.lit(False).alias("loose"), F.pmod(F.xxhash64("doc_id"), "parts").alias("part"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.col("homes") - 1)).alias("home"))
    left = inside.where("component <> main").select(
        *row, F.lit(True).alias("loose"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("doc_id"), "homes").alias("home"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        maps = [np.frombuffer(b, np.uint8) for b in frame["bits"]]
        found = near_pairs(list(frame["doc_id"]), frame["size"].to_numpy(np.int64), maps, frame["loose"].to_numpy(bool),
                           pd.factorize(frame["component"])[0], bound)
        return pd.DataFrame(found, columns=["a", "b"])

    found = left.unionByName(right).groupBy("low", "home", "part").applyInPandas(compare, f"a {id_type}, b {id_type}")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def set_links(docs: DataFrame, keyed: DataFrame, size: int, bound: int) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all links between the rows of ``docs`` whose tile ``keyed`` tells."""
    meets = written(meetings(keyed), "meetings")
    lows = meets.select(F.col("low").alias("doc_id")).distinct()
    stars = meets.groupBy("doc_id").agg(F.min("low").alias("star"))
    # A set's own row: that with its star, or for one that is the smallest of all its tiles the row as a centre.
    centres = lows.join(stars, "doc_id", "left").select("doc_id", F.col("doc_id").alias("star"), F.lit(True).alias("centre"), F.isnull("star").alias("own"))
    wanted = written(stars.select("doc_id", "star", F.lit(False).alias("centre"), F.lit(True).alias("own")).unionByName(centres), "stars")
    sets = written(set_table(docs, wanted, size), "sets")
    direct = written(star_links(sets, bound), "direct")
    known = components(direct).withColumnRenamed("node", "doc_id")
    own = sets.where("own").groupBy("doc_id").agg(F.max(F.size("shingles")).alias("n"))
    where = own.join(known, "doc_id", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    members = meets.unionByName(meets.select(F.col("low").alias("doc_id"), "low").distinct())
    placed = written(members.join(where, "doc_id"), "placed")
    pairs = written(group_pairs(placed, written(open_groups(placed), "open-groups"), sets, bound), "near-pairs")
    arrays = sets.where("own").select("doc_id", "shingles")
    both = pairs.join(arrays.withColumnRenamed("doc_id", "a"), "a").join(
        arrays.select(F.col("doc_id").alias("b"), F.col("shingles").alias("other")), "b")
    return direct.unionByName(compared(both, bound))


def link_groups(docs: DataFrame, size: int = SHINGLE, bound: int = BOUND, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Sets are the distinct ``size``-word shingles of the text, letters A to Z lowered; a shorter text is
    one shingle, and a null text or one without words has none and links with nothing. Rows that share an id are one node, linked by each
    of their texts. A row without an id takes part in no link and has a null component. Columns
    that clash with a new name move under a leading underscore.
    """
    for name in ("n_shingles", "component_id"):
        if name in docs.columns:
            docs = docs.withColumnRenamed(name, free_name(docs, name))
    rows = docs.select("doc_id", "text")
    cut = written(set_sums(rows, size), "set-sums")
    real = cut.where("doc_id IS NOT NULL AND n_shingles > 0")
    # Equal sets are folded to their smallest id, which alone stands in tiles.
    copies = real.groupBy("c1", "c2").agg(F.min("doc_id").alias("same"), F.max("doc_id").alias("_high"), F.count("*").alias("_rows")).where("same < _high").drop("_high")
    copied = spread_join(real.select("doc_id", "c1", "c2"), copies, ["c1", "c2"], "_rows", ["doc_id"])
    copied = written(copied.where("doc_id <> same").select("doc_id", "c1", "c2", "same"), "copies")
    own = real.select("doc_id", "c1", "c2").join(copied, ["doc_id", "c1", "c2"], "left_anti").select("doc_id").distinct()
    gone = written(copied.select("doc_id").distinct().join(own, "doc_id", "left_anti"), "gone")
    single = rows.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti")
    near = set_links(rows, tiles(single, size, bound), size, bound)
    # A copy has the set of its smallest id, so one link stands for all of it.
    all_links = near.unionByName(copied.select(F.col("doc_id").alias("a"), F.col("same").alias("b")))
    found = written(components(all_links), "components").select(F.col("node").alias("doc_id"), F.col("component"))
    if keep == ["doc_id"]:
        out = cut.select("doc_id", "n_shingles").join(found, "doc_id", "left")
        return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    sizes = cut.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")).join(found, "doc_id", "left")
    kept = keep or docs.columns
    sizes = sizes.select(F.col("doc_id").alias("_node"), "n_shingles", "component")
    return docs.join(sizes, F.col("doc_id").eqNullSafe(F.col("_node")), "left").select(
        *kept, "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
