"""Phrases of two and three words that stand together more often than their parts would, by stripes.

A task reads texts and counts, for every prefix of two words, the words that follow it: a stripe. The end of a piece
follows too, so a stripe's total is the number of places of its prefix. Stripes of one task are merged before they are sent,
then dealt by a hash of their prefix and merged entry by entry. The merged stripe of ``x y`` gives the counts of ``x y z``
(its extensions), that of ``x y`` (its total) and the largest extension, which may subsume ``x y``. Totals of the stripes that
begin with ``x`` are the stripe of ``x``, and their sum counts ``x``.

A word is a 64-bit hash of its language and letters while it is counted; each bucket keeps the letters
of its words, and phrases get them back at the end. Two words of a table of ``n`` different ones meet with probability ``n * n / 2**65``.

A prefix is one bucket's, but its stripe comes to it merged per task, so a word pair that fills a third of
the corpus brings one entry per task and next word. Common words are not keys of any group before their rows are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.packed import LOWER, chunks, mix, signed, span_hashes, text_bytes, words
from sievelight.llm.tables import written

LEAST = 10
SUBSUMED = 50  # hundredths
TOP = 2000
FLUSH_WORDS = 2_000_000  # words whose stripes a task holds before it sends them
BUCKET_BYTES = 16 << 20  # bytes of text per bucket of stripes
BLOCK = 256  # entries per row of a sent stripe
SALTS = 64

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATOR = BREAK.copy()
SEPARATOR[[0x20, 0x09]] = True
END = np.uint64(0)

_STRIPES = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("x", pa.list_(pa.int64())), ("y", pa.list_(pa.int64())), ("z", pa.list_(pa.int64())),
                      ("n", pa.list_(pa.int64())), ("word", pa.list_(pa.int64())), ("letters", pa.list_(pa.binary()))])
_STRIPE_COLUMNS = "bucket long, lang string, x array<long>, y array<long>, z array<long>, n array<long>, word array<long>, letters array<binary>"
_MERGED = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("n", pa.int64()),
                     ("more", pa.int64()), ("letters", pa.string())])
_MERGED_COLUMNS = "kind string, lang string, x long, y long, z long, n long, more long, letters string"


def followers(data: np.ndarray, at: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word with the two that follow it in its piece (``END`` where there is none), and where it stands in ``data``."""
    starts, ends, _ = words(data, at, SEPARATOR)
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return none, none, none, starts, ends
    x = np.maximum(mix(span_hashes(data, starts, ends) ^ np.uint64(seed)), np.uint64(1))
    breaks = np.concatenate([[0], np.cumsum(BREAK[data])])
    text = np.searchsorted(at, starts, "right")
    joined = np.zeros(len(x) + 1, bool)  # whether the next word belongs to the same piece
    joined[:-2] = (breaks[ends[:-1]] == breaks[starts[1:]]) & (text[:-1] == text[1:])
    y = np.where(joined[:-1], np.append(x[1:], END), END)
    z = np.where(joined[:-1] & joined[1:], np.append(y[1:], END), END)
    return x, y, z, starts, ends


def merged(x: np.ndarray, y: np.ndarray, z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries in the order of (x, y, z), equal ones added."""
    order = np.lexsort((z, y, x))
    x, y, z, n = x[order], y[order], z[order], n[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
    at = np.flatnonzero(new)
    return x[at], y[at], z[at], np.add.reduceat(n, at) if len(at) else n


def bucket_of(x: np.ndarray, y: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(x * np.uint64(3) + mix(y)) % np.uint64(buckets)).astype(np.int64)


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(signed(values) if values.dtype == np.uint64 else values))


def _cuts(bucket: np.ndarray) -> np.ndarray:
    """Where sorted entries are cut into rows: at each new bucket and after every ``BLOCK`` entries."""
    edge = np.flatnonzero(np.diff(bucket)) + 1
    begin = np.concatenate([[0], edge])
    since = np.arange(len(bucket)) - np.repeat(begin, np.diff(np.append(begin, len(bucket))))
    return np.append(np.flatnonzero(since % BLOCK == 0), len(bucket))


class Stripes:
    """The stripes of one language that a task holds."""

    def __init__(self, lang: str, buckets: int):
        self.lang, self.buckets = lang, buckets
        self.seed = int(span_hashes(np.frombuffer(lang.encode() + b" ", np.uint8), np.array([0]), np.array([len(lang.encode()) + 1]))[0])
        self.entries: list[tuple] = []
        self.spelled: dict[int, bytes] = {}
        self.size = 0

    def add(self, data: np.ndarray, at: np.ndarray) -> None:
        data = LOWER[data]
        x, y, z, starts, ends = followers(data, at, self.seed)
        if len(x):
            self.entries.append(merged(x, y, z, np.ones(len(x), np.int64)))
            self.size += len(x)
            raw = data.tobytes()
            known, first = np.unique(x, return_index=True)
            for word, a, b in zip(known.tolist(), starts[first].tolist(), ends[first].tolist(), strict=True):
                if word not in self.spelled:
                    self.spelled[word] = raw[a:b]

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Everything held, as rows of at most ``BLOCK`` entries of one bucket; then nothing is held."""
        if not self.entries:
            return
        x, y, z, n = merged(*(np.concatenate(part) for part in zip(*self.entries, strict=True)))
        bucket = bucket_of(x, y, self.buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = _cuts(bucket[order])
        x, y, z, n, bucket = x[order], y[order], z[order], n[order], bucket[order][cuts[:-1]]
        lang = pa.array([self.lang] * len(bucket))
        yield from pa.Table.from_arrays([
            pa.array(bucket), lang, _lists(x, cuts), _lists(y, cuts), _lists(z, cuts), _lists(n, cuts),
            pa.nulls(len(bucket), pa.list_(pa.int64())), pa.nulls(len(bucket), pa.list_(pa.binary()))], schema=_STRIPES).to_batches(64)
        word = np.array(list(self.spelled), np.uint64)
        home = bucket_of(word, word, self.buckets)
        order = np.argsort(home, kind="stable")
        cuts = _cuts(home[order])
        letters = pa.array(list(self.spelled.values()), pa.binary()).take(pa.array(order))
        none = pa.nulls(len(cuts) - 1, pa.list_(pa.int64()))
        yield from pa.Table.from_arrays([
            pa.array(home[order][cuts[:-1]]), pa.array([self.lang] * (len(cuts) - 1)), none, none, none, none, _lists(word[order], cuts),
            pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), letters)], schema=_STRIPES).to_batches(64)
        self.entries, self.spelled, self.size = [], {}, 0


def stripes(docs: DataFrame, buckets: int) -> DataFrame:
    """Stripes of ``docs (lang, text)``, merged per task and cut into rows of one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Stripes] = {}
        for batch in chunks(batches):
            langs = batch.column("lang")
            for lang in langs.unique().to_pylist():
                own = held.setdefault(lang, Stripes(lang, buckets))
                own.add(*text_bytes(batch.column("text").filter(pa.compute.equal(langs, lang))))
            if sum(s.size for s in held.values()) >= FLUSH_WORDS:
                for own in held.values():
                    yield from own.rows()
        for own in held.values():
            yield from own.rows()

    return docs.mapInArrow(run, _STRIPE_COLUMNS)


def _rows(kind: str, lang: str, size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * size), pa.array([lang] * size), *(columns.get(f.name, pa.nulls(size, f.type)) for f in list(_MERGED)[2:])], schema=_MERGED)


def read_off(lang: str, x: np.ndarray, y: np.ndarray, z: np.ndarray, n: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """What the merged stripes of a bucket tell: counts of words and, from ``least`` places up, of phrases of two and three words."""
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(n, at)
    longest = np.maximum.reduceat(np.where((z != END) & (n >= least), n, 0), at)
    first = np.flatnonzero(np.concatenate([[True], x[at][1:] != x[at][:-1]]))
    counted = np.add.reduceat(total, first)
    yield _rows("word", lang, len(first), x=pa.array(signed(x[at][first])), n=pa.array(counted))
    two = (total >= least) & (y[at] != END)
    yield _rows("two", lang, int(two.sum()), x=pa.array(signed(x[at][two])), y=pa.array(signed(y[at][two])), n=pa.array(total[two]),
                more=pa.array(longest[two]))
    three = (n >= least) & (z != END)
    whole = np.repeat(total, np.diff(np.append(at, len(x))))
    yield _rows("three", lang, int(three.sum()), x=pa.array(signed(x[three])), y=pa.array(signed(y[three])), z=pa.array(signed(z[three])),
                n=pa.array(n[three]), more=pa.array(whole[three]))


def merge(parts: DataFrame, least: int) -> DataFrame:
    """Stripes of each bucket merged entry by entry, as rows of words (``x, n``), of two words (``x, y, n``, ``more``: the
    largest extension), of three words (``x, y, z, n``, ``more``: the total of ``x y``), and of letters (``x``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple] = []
        size = 0
        spelled: dict[int, bytes] = {}

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                yield from read_off(key[1], *merged(*(np.concatenate(part) for part in zip(*held, strict=True))), least)
            if spelled:
                yield _rows("letters", key[1], len(spelled), x=pa.array(list(spelled), pa.int64()),
                            letters=pa.array([w.decode("utf-8", "replace") for w in spelled.values()]))

        for batch in batches:
            own = pa.Table.from_batches([batch])
            keys = list(zip(batch.column("bucket").to_pylist(), batch.column("lang").to_pylist(), strict=True))
            begins = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            for a, b in zip(begins, [*begins[1:], len(keys)], strict=True):
                if keys[a] != key:
                    yield from done()
                    key, held, size, spelled = keys[a], [], 0, {}
                part = own.slice(a, b - a).combine_chunks()
                one = [part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("x", "y", "z", "n")]
                if len(one[0]):
                    held.append((*(v.astype(np.int64).view(np.uint64) for v in one[:3]), one[3].astype(np.int64)))
                    size += len(one[0])
                    if len(held) > 1 and size > 2 * len(held[0][0]) + FLUSH_WORDS:
                        # Fold what came since, so that memory is that of the distinct entries.
                        held = [merged(*(np.concatenate(p) for p in zip(*held, strict=True)))]
                        size = len(held[0][0])
                spelled.update(zip(part.column("word").combine_chunks().flatten().to_pylist(),
                                   part.column("letters").combine_chunks().flatten().to_pylist(), strict=True))
        yield from done()

    return parts.repartition("bucket").sortWithinPartitions("bucket", "lang").mapInArrow(run, _MERGED_COLUMNS)


def with_counts(phrases: DataFrame, column: str, name: str, counts: DataFrame, common: DataFrame) -> DataFrame:
    """``phrases`` with the count of the word in ``column``. ``common`` are the words that count more than a thousandth of all
    words, a thousand at most: they go to every task, so that no other key of the join holds more rows than that share."""
    known = phrases.join(F.broadcast(common.select(F.col("x").alias(column), F.col("n").alias("_n"))), column, "left")
    rest = known.where("_n IS NULL").drop("_n").join(counts.select(F.col("x").alias(column), F.col("n").alias(name)), column)
    return known.where("_n IS NOT NULL").withColumnRenamed("_n", name).unionByName(rest)


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """``floor(1000000 * a * a / (l * r))`` in whole numbers of up to 38 digits, right for counts below 10**16."""
    def wide(c: Column) -> Column:
        return c.cast("decimal(16,0)")

    scaled = (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", scaled.cast("decimal(38,0)"), (wide(l) * wide(r)).cast("decimal(38,0)")).cast("long")


def candidates(merged_rows: DataFrame) -> DataFrame:
    """Phrases of two or three words with ``lang``, hashes ``x, y, z`` (``z`` null for two), ``a``, ``l``, ``r``, ``score`` and ``longer``,
    the largest count among longer candidates that hold the phrase."""
    counts = written(merged_rows.where("kind = 'word'").groupBy("x").agg(F.sum("n").alias("n")), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.where(F.col("n") * 1000 > total)
    two = merged_rows.where("kind = 'two'").select("lang", "x", "y", F.col("n").alias("a"), "more")
    three = merged_rows.where("kind = 'three'").select("lang", "x", "y", "z", F.col("n").alias("a"), F.col("more").alias("l2"))
    before = three.groupBy(F.col("y").alias("x"), F.col("z").alias("y")).agg(F.max("a").alias("before"))
    pairs = two.join(before, ["x", "y"], "left").withColumn("longer", F.greatest("more", F.coalesce("before", F.lit(0))))
    pairs = with_counts(with_counts(pairs, "x", "l", counts, common), "y", "r", counts, common)
    pairs = pairs.select("lang", "x", "y", F.lit(None).cast("long").alias("z"), "a", "l", "r", score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "longer")
    rests = two.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("r1"))
    triples = with_counts(with_counts(three.join(rests, ["y", "z"]), "x", "l1", counts, common), "z", "r2", counts, common)
    triples = triples.withColumn("s1", score(F.col("a"), F.col("l1"), F.col("r1"))).withColumn("s2", score(F.col("a"), F.col("l2"), F.col("r2")))
    later = F.col("s2") < F.col("s1")
    triples = triples.select("lang", "x", "y", "z", "a", F.when(later, F.col("l2")).otherwise(F.col("l1")).alias("l"),
                             F.when(later, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"), F.lit(0).cast("long").alias("longer"))
    return pairs.unionByName(triples)


def spelled(phrases: DataFrame, merged_rows: DataFrame) -> DataFrame:
    """``phrases`` with their words as text in ``phrase``."""
    letters = merged_rows.where("kind = 'letters'").groupBy(F.col("x").alias("word")).agg(F.first("letters").alias("letters"))
    key = ["lang", "x", "y", "z"]
    each = phrases.select(*key, F.posexplode(F.array("x", "y", "z")).alias("at", "word")).where("word IS NOT NULL").join(letters, "word")
    whole = each.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letters"))), lambda w: w["letters"]), " ").alias("phrase"))
    return phrases.alias("p").join(whole.alias("w"), F.expr("p.x = w.x AND p.y = w.y AND p.z <=> w.z")).select("p.*", "w.phrase")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, subsumed: int = SUBSUMED) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its two parts at the cut of the lowest score, ``n`` the words of the
    language. Candidates have ``least`` places; one that a longer candidate holds in ``subsumed`` hundredths of its places or more is left out.
    Order: score and ``a`` falling, then the phrase by its bytes.
    A null language is ``und``; a null or empty text has no words; rows that repeat count each, whatever their ids, and very
    long texts are counted whole. Equal scores at the last rank are settled by the phrase. A
    language without candidates, and an empty table, give no rows. Only ``lang`` and ``text`` are read, so other columns cannot clash.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    merged_rows = written(merge(stripes(rows, 1 + size // BUCKET_BYTES), least), "stripes")
    total = merged_rows.where("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("n"))
    good = written(candidates(merged_rows).where(F.col("longer") * 100 < F.col("a") * subsumed).drop("longer"), "phrases")
    order = [F.col("score").desc(), F.col("a").desc()]
    # The best of each salt of a language hold the best of the language; ties at the end stay until phrases are spelled.
    salted = good.withColumn("_rank", F.rank().over(Window.partitionBy("lang", F.pmod(F.xxhash64("x", "y", "z"), F.lit(SALTS))).orderBy(*order)))
    best = salted.where(F.col("_rank") <= top).withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(*order)))
    named = spelled(written(best.where(F.col("_rank") <= top).drop("_rank"), "best-phrases"), merged_rows)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.encode("phrase", "UTF-8")))
    ranked = named.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
