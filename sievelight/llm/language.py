"""Language identification by interpolated Kneser-Ney character models, one per language.

Spark counts every character n-gram of the training texts by the n-gram itself, and
computes discounts, totals, back-offs and interpolated probabilities by grouping
and joining on n-grams, contexts and suffixes. The models are Parquet files in the
shared folder, one folder per order and range of 64-bit n-gram hashes; beside each
hash stands its log-probability in every language. They grow with the corpus. A task looks up the
different n-grams of many texts range by range and holds ``CACHE_BYTES`` of ranges, so neither the
driver nor a task holds more of a model than that. A text gets the language whose
model gives it the lowest cross-entropy per character. Rejection is calibrated on the training
texts: a text whose cross-entropy lies beyond nearly all training texts of that
language, or whose languages are not told apart, is not accepted.
"""

from __future__ import annotations

import unicodedata
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.packed import CHUNK_BYTES, chunks, mix, signed
from sievelight.llm.tables import free_name, written
from sievelight.session import shared_folder
from sievelight.sources.jobs import ship_package
from sievelight.sources.places import place_of

ORDER = 4
RANGE_ROWS = 1_000_000  # of all orders
CACHE_BYTES = 256 << 20
FLUSH_ROWS = 400_000
GRAM_BYTES = CHUNK_BYTES // 2  # of text whose n-grams a task holds at once
CONFIDENCE_CHARS = 20
REJECT_SHARE = 0.001
REJECT_PLACE = 0.5
UNKNOWN = "und"
_PAD = "\U0010ffff"
_STEP = 0x9E3779B97F4A7C15


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Code point to its symbol (letters and marks stay, all else is a space), and whether it is a letter."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    kind = np.array(kinds)
    symbol = np.where((kind == "L") | (kind == "M"), np.arange(0x110000), 32).astype(np.uint32)
    symbol[ord(_PAD)] = 0
    return symbol, kind == "L"


_tables: list[tuple[np.ndarray, np.ndarray]] = []


class Grams:
    """Hashed n-grams of a list of texts: ``ids[k][i]`` is the n-gram of length ``k`` that ends at symbol ``i``."""

    def __init__(self, texts: list[str]) -> None:
        if not _tables:
            _tables.append(_letters())
        symbols, letters = _tables[0]
        low = [t.lower() for t in texts]
        pad = _PAD * (ORDER - 1)
        points = np.frombuffer((pad + pad.join(low)).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in low]) + (ORDER - 1)
        owner = np.repeat(np.arange(len(texts)), size)
        begins = np.cumsum(size) - size
        real = np.ones(len(points), bool)
        for k in range(ORDER - 1):
            real[begins + k] = False
        self.letters = np.bincount(owner[letters[points]], minlength=len(texts))
        symbol = symbols[points]
        space = symbol == 32
        keep = np.ones(len(points), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        symbol, self.owner = symbol[keep].astype(np.uint64), owner[keep]
        self.at = np.flatnonzero(real[keep])
        self.symbol = symbol.astype(np.uint32)
        self.ids = [np.zeros(len(symbol), np.uint64)]
        h, power = np.zeros(len(symbol), np.uint64), 1
        for k in range(1, ORDER + 1):
            h[k - 1:] += symbol[: len(symbol) - k + 1] * np.uint64(power)
            power = power * _STEP % (1 << 64)
            self.ids.append(mix(h + np.uint64(k)))


def gram_ids(grams: list[str]) -> np.ndarray:
    """The hashes in ``Grams.ids`` of n-grams that all have the same length."""
    k = len(grams[0]) if grams else 0
    if not k:
        return np.zeros(len(grams), np.uint64)
    symbols = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, k).astype(np.uint64)
    symbols[symbols == ord(_PAD)] = 0
    h, power = np.zeros(len(grams), np.uint64), 1
    for j in range(k):
        h += symbols[:, k - 1 - j] * np.uint64(power)
        power = power * _STEP % (1 << 64)
    return mix(h + np.uint64(k))


def _combined(keys: np.ndarray, counts: np.ndarray, tags: np.ndarray, symbols: np.ndarray):
    unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return unique, np.bincount(inverse, counts).astype(np.int64), tags[first], symbols[first]


def count_grams(train: DataFrame) -> DataFrame:
    """Counts of every n-gram of the highest order of ``train(text, lang)``: lang, gram, n. Those of lower orders are their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        held: list[tuple] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                _, n, tags, symbols = _combined(*map(np.concatenate, zip(*held, strict=True)))
                # Arrow ends a string at its first zero, so padding keeps its own code point.
                symbols[symbols == 0] = ord(_PAD)
                grams = np.ascontiguousarray(symbols).view(f"<U{ORDER}").ravel()
                yield pa.RecordBatch.from_arrays([pa.array(list(langs), pa.string()).take(pa.array(tags)), pa.array(grams, pa.string()), pa.array(n)],
                                                 ["lang", "gram", "n"])
            held.clear()

        for batch in chunks(batches, limit=GRAM_BYTES):
            tags = np.array([langs.setdefault(x, len(langs)) for x in batch.column("lang").to_pylist()], np.int64)
            grams = Grams(batch.column("text").to_pylist())
            at = grams.at
            if not len(at):
                continue
            tag = tags[grams.owner[at]]
            symbols = np.stack([grams.symbol[at - j] for j in range(ORDER - 1, -1, -1)], axis=1)
            held.append(_combined(mix(grams.ids[ORDER][at] + tag.astype(np.uint64) * np.uint64(_STEP)), np.ones(len(at)), tag, symbols))
            rows += len(held[-1][0])
            if rows > FLUSH_ROWS:
                yield from flush()
                rows = 0
        yield from flush()

    rows = train.select("text", "lang").mapInArrow(run, "lang string, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


_parts: OrderedDict[tuple, tuple[np.ndarray, np.ndarray]] = OrderedDict()  # ranges held by this process, the last used at the end


@dataclass
class Model:
    """Where the files of the models lie: tables 1 to ``ORDER`` have n-grams, ``ORDER`` + k the contexts of order k and their back-offs."""

    langs: list[str]
    folder: str
    bits: int  # of a hash that name its range
    n_bytes: int
    even: float

    def part(self, table: int, place: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of a range and their logarithms in every language."""
        key = (self.folder, table, place)
        if key in _parts:
            _parts.move_to_end(key)
            return _parts[key]
        store, inner = place_of(f"{self.folder}/table={table}/place={place}")
        ids, logs = np.zeros(0, np.uint64), np.zeros((0, len(self.langs)), np.float32)
        if store.get_file_info(inner).type != fs.FileType.NotFound:
            got = pq.read_table(inner, filesystem=store, partitioning=None, columns=["id", "logs"]).combine_chunks()
            ids = got["id"].to_numpy().view(np.uint64)
            logs = got["logs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(self.langs))
            order = np.argsort(ids)
            ids, logs = ids[order], logs[order]
        _parts[key] = ids, logs
        held = sum(i.nbytes + x.nbytes for i, x in _parts.values())
        while held > CACHE_BYTES and len(_parts) > 1:
            i, x = _parts.popitem(last=False)[1]
            held -= i.nbytes + x.nbytes
        return ids, logs

    def find(self, table: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of hashes, zero where there are none, and whether there are."""
        unique, inverse = np.unique(wanted, return_inverse=True)
        logs, seen = np.zeros((len(unique), len(self.langs)), np.float32), np.zeros(len(unique), bool)
        places = unique >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(unique), np.uint64)
        starts = np.flatnonzero(np.diff(places.astype(np.int64), prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(unique)], strict=True):
            ids, values = self.part(table, int(places[start]))
            if len(ids):
                at = np.minimum(np.searchsorted(ids, unique[start:end]), len(ids) - 1)
                seen[start:end] = ids[at] == unique[start:end]
                logs[start:end] = np.where(seen[start:end, None], values[at], 0)
        return logs[inverse], seen[inverse]

    def score(self, grams: Grams, at: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Log2-probability of each symbol in each language given the ``k - 1`` symbols before it."""
        if k == 0:
            return np.full((len(at), len(self.langs)), self.even, np.float32)
        out, seen = self.find(k, grams.ids[k][at])
        lost = at[~seen]
        if len(lost):
            out[~seen] = self.score(grams, lost, k - 1) + self.find(ORDER + k, grams.ids[k - 1][lost - 1])[0]
        return out


def _wide(langs: list[str], value: str) -> Column:
    """An array with the sum of a column in each language."""
    return F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col(value))), F.lit(0)) for x in langs])


def build_model(counts: DataFrame) -> Model | None:
    """The models from counted n-grams, written range by range. None without any."""
    spark = counts.sparkSession
    table = {ORDER: written(counts, "grams")}
    for k in range(ORDER - 1, 0, -1):
        # Lower orders count the different symbols that an n-gram follows.
        ends = table[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
        table[k] = written(ends, "grams")
    stats = {k: t.groupBy("lang").agg(F.count("*").alias("all"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
             .collect() for k, t in table.items()}
    langs = sorted(r.lang for r in stats[1])
    if not langs:
        return None
    even = -float(np.log2(table[1].select("gram").distinct().count() + 1))
    last, files = None, []
    for k in range(1, ORDER + 1):
        of = {r.lang: r.once / max(r.once + 2 * r.twice, 1) if r.once else 0.5 for r in stats[k]}
        discount = F.array(*[F.lit(float(np.clip(of[x], 0.1, 0.9))) for x in langs])
        totals = table[k].groupBy("lang", F.left("gram", F.lit(k - 1)).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        contexts = totals.groupBy("context").agg(_wide(langs, "total").alias("total"), _wide(langs, "kinds").alias("kinds"))
        lost = F.zip_with(discount, "kinds", lambda d, n: d * n)
        backoff = F.zip_with(lost, "total", lambda x, n: F.when(n > 0, x / F.greatest(n, F.lit(1))).otherwise(1.0))
        contexts = written(contexts.select("context", "total", backoff.alias("backoff")), "contexts")
        files.append(contexts.select(F.lit(ORDER + k).alias("table"), F.col("context").alias("gram"), F.col("backoff").alias("chance")))
        # Every n-gram has one context and one suffix, whichever language it was seen in.
        wide = table[k].groupBy("gram").agg(_wide(langs, "n").alias("n")).withColumns({
            "context": F.left("gram", F.lit(k - 1)), "suffix": F.substring("gram", 2, k - 1) if k > 1 else F.lit("")})
        # The one context of order 1 is a single row.
        rows = wide.join(F.broadcast(contexts) if k == 1 else contexts, "context")
        if last is None:
            rows = rows.withColumn("lower", F.array_repeat(F.lit(2.0 ** even), len(langs)))
        else:
            rows = rows.join(last.select(F.col("gram").alias("suffix"), F.col("chance").alias("lower")), "suffix")
        own = F.zip_with(F.zip_with("n", discount, lambda n, d: F.when(n > 0, n - d).otherwise(0.0)), "total",
                         lambda x, n: x / F.greatest(n, F.lit(1)))
        chance = F.zip_with(own, F.zip_with("backoff", "lower", lambda b, c: b * c), lambda x, y: x + y)
        last = written(rows.select("gram", chance.alias("chance")), "chances")
        files.append(last.select(F.lit(k).alias("table"), "gram", "chance"))
    n_rows = sum(r["all"] for rows in stats.values() for r in rows)
    bits = max(0, int(n_rows // RANGE_ROWS).bit_length())
    folder = shared_folder(spark, "llm-language-model")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("gram").to_pylist()
            size = np.array([len(g) for g in grams])
            ids = np.zeros(len(grams), np.uint64)
            for k in np.unique(size):
                ids[size == k] = gram_ids([g for g in grams if len(g) == k])
            places = (ids >> np.uint64(64 - bits) if bits else np.zeros(len(ids), np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("table"), pa.array(places), pa.array(signed(ids)), batch.column("logs")],
                                             ["table", "place", "id", "logs"])

    every = files[0]
    for more in files[1:]:
        every = every.unionByName(more)
    every = every.select("table", "gram", F.transform("chance", lambda c: F.log2(c).cast("float")).alias("logs"))
    every = every.mapInArrow(hashed, "table int, place long, id long, logs array<float>")
    every.repartition("table", "place").write.partitionBy("table", "place").parquet(folder)
    return Model(langs, folder, bits, n_rows * (8 + 4 * len(langs)), even)


def train_model(train: DataFrame) -> Model | None:
    """Models from ``train(text, lang)``; rows without a text or a language teach nothing."""
    ship_package(train.sparkSession)
    return build_model(count_grams(train.where(F.col("text").isNotNull() & F.col("lang").isNotNull())))


def predict(df: DataFrame, model: Model | None, text_column: str = "text", prefix: str = "lang_",
            keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with predicted language, score and bits per symbol.

    Null, empty and letterless texts get ``und``, score 0 and null bits, as does every text when there
    is no model. Ties go to the first language by name. Repeated rows and null
    ids pass as they are; columns that clash with a new name move under a leading underscore.
    """
    names = [prefix + "pred", prefix + "score", prefix + "bits"]
    for name in names:
        if name in df.columns:
            df = df.withColumnRenamed(name, free_name(df, name))
    kept = keep or [c for c in df.columns]
    rows = df if text_column in kept else df.select(*kept, text_column)
    ship_package(df.sparkSession)
    # Where not all ranges are held at once, more texts share a look at each.
    limit = GRAM_BYTES if model is None or model.n_bytes <= CACHE_BYTES else 4 * CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_column, limit):
            texts = [t or "" for t in batch.column(text_column).to_pylist()]
            lang, score, bits = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if model:
                grams = Grams(texts)
                owner = grams.owner[grams.at]
                logs = np.zeros((len(texts), len(model.langs)))
                if len(owner):
                    first = np.flatnonzero(np.diff(owner, prepend=-1))
                    logs[owner[first]] = np.add.reduceat(model.score(grams, grams.at), first, axis=0, dtype=np.float64)
                cost = -logs / np.maximum(np.bincount(owner, minlength=len(texts)), 1)[:, None]
                best = cost.argmin(1)
                low = cost[np.arange(len(texts)), best]
                sure = 1 / np.exp2(-CONFIDENCE_CHARS * (cost - low[:, None])).sum(1)
                for i in np.flatnonzero(grams.letters):
                    lang[i], score[i], bits[i] = model.langs[best[i]], float(sure[i]), float(low[i])
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *names])

    schema = df.select(*kept).schema
    for name, kind in zip(names, ("string", "double", "double"), strict=True):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def accepted(predicted: DataFrame, trained: Column, model: Model | None, prefix: str = "lang_",
             name: str = "accepted") -> DataFrame:
    """``predicted`` with whether the prediction stands.

    The limit of a language lies ``REJECT_PLACE`` of the way from the cross-entropy that all but
    ``REJECT_SHARE`` of its training texts keep to that of evenly drawn symbols; a score hardly
    above chance is rejected too. ``predicted`` should be a written table: it is read twice.
    """
    even = -model.even if model else 0.0
    chance = 1.2 / len(model.langs) if model and len(model.langs) > 1 else 0.0
    if name in predicted.columns:
        predicted = predicted.withColumnRenamed(name, free_name(predicted, name))
    pred, score, bits = (prefix + c for c in ("pred", "score", "bits"))
    of, kept = free_name(predicted, "_lang"), free_name(predicted, "_kept")
    limits = predicted.where(trained & (F.col(pred) != UNKNOWN)).groupBy(F.col(pred).alias(of)).agg(
        F.percentile_approx(bits, 1 - REJECT_SHARE, 10000).alias(kept))
    limit = F.col(kept) + F.greatest(F.lit(even) - F.col(kept), F.lit(0)) * REJECT_PLACE
    # One row per learned language.
    out = predicted.join(F.broadcast(limits), F.col(pred) == F.col(of), "left")
    fine = (F.col(bits) <= F.coalesce(limit, F.lit(even))) & (F.col(score) > chance)
    return out.select(*predicted.columns, F.coalesce(fine, F.lit(False)).alias(name))


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a row is kept out of training: CRC-32 of its id as text is 2 modulo 4; a null id counts as empty."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Train on the documents not held out, predict all, and calibrate the rejection: a written table and its limits.

    Texts without a language teach nothing, neither the models nor the limits. Columns of ``docs`` with the name of
    a new one move under a leading underscore.
    """
    learn = free_name(docs, "_learn")
    docs = docs.withColumn(learn, ~held_out() & F.col("lang").isNotNull())
    model = train_model(docs.where(learn))
    told = written(predict(docs, model, keep=[*keep, learn] if keep else None), "language")
    return accepted(told, F.col(learn), model).drop(learn)
