"""Removal of byte strings that an earlier document holds, with suffix arrays sorted in two stages.

Every window of ``length`` bytes picks the least hash among its ``GRAM``-byte strings as
its anchor, so equal windows meet at equal anchors. Around an anchor lies its surrounding: all windows
that can hold it. Equal surroundings are folded to the earliest document; the
later ones are covered whole. Of those that differ around one anchor, hashes of pieces that
whole ranges of windows hold tell which windows can be in another document at all; only their bytes go to a
suffix array: only the suffixes smaller than their successors are sorted
directly, the others follow by one scan of the buckets, and adjacent common
prefixes tell which windows are equal. Surroundings of an anchor that more than
``HOT`` of them share are compared by window in a combined aggregate instead, so no task holds them together.

Spark moves anchors by hash in packed blocks, and texts by id once. Every result
carries a hash of its bytes and is applied only where the bytes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.packed import CHUNK_BYTES, chunks, hashes_between, mix, powers, running_hashes, signed, span_hashes, text_bytes
from sievelight.llm.tables import written

LENGTH = 50
GRAM = 16
PIECES = 4  # ranges of the windows around an anchor
HOT = 50_000
BUCKET_BYTES = 32 << 20  # bytes of text whose anchors meet in one group
SORT_BYTES = 2 << 20
NO_ID = np.iinfo(np.int64).max
LOW48 = np.uint64((1 << 48) - 1)
PACK = 7  # symbols of nine bits in a word


def suffix_types(symbols: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one is."""
    n = len(symbols)
    differs = np.flatnonzero(symbols[:-1] != symbols[1:])
    small = np.ones(n, bool)
    if len(differs):
        # Equal symbols up to a change are all smaller or all larger.
        small[: differs[-1] + 1] = np.repeat(symbols[differs] < symbols[differs + 1], np.diff(differs, prepend=-1))
    return small


def packed_words(symbols: np.ndarray) -> np.ndarray:
    """The ``PACK`` symbols from each place as one number."""
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(PACK, np.int64)])
    word = np.zeros(len(symbols), np.int64)
    for k in range(PACK):
        word = (word << 9) | padded[k: k + len(symbols)]
    return word


def sort_direct(starts: np.ndarray, word: np.ndarray, depth: int, digest: np.ndarray) -> np.ndarray:
    """Suffixes at ``starts`` by their first ``depth`` symbols at least; only ties are compared further.

    ``digest`` hashes those symbols of each suffix, so that a tie of equal ones ends at once, in any order.
    """
    order = starts[np.argsort(word[starts])]
    todo, group = np.arange(len(order)), np.zeros(len(order), np.int64)
    for step in range(0, depth, PACK):
        at = order[todo] + step
        key = np.where(at < len(word), word[np.minimum(at, len(word) - 1)], 0)
        if step:
            turn = np.lexsort((key, group))
            order[todo] = order[todo][turn]
            key, group = key[turn], group[turn]
        first = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(key, prepend=key[:1]) != 0))
        seen = digest[order[todo]]
        open_tie = np.minimum.reduceat(seen, first) != np.maximum.reduceat(seen, first) if len(first) else np.zeros(0, bool)
        size = np.diff(np.append(first, len(key)))
        keep = np.repeat(open_tie, size)
        group, todo = np.repeat(np.arange(len(first)), size)[keep], todo[keep]
        if not len(todo):
            break
    return order


def suffix_array(symbols: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` symbols, or of those up to a 0; the last symbol must be 0.

    With ``wanted`` (a flag for each symbol) only of those and of what their order follows from.
    """
    small = suffix_types(symbols)
    stops = np.flatnonzero(symbols == 0)
    if wanted is None:
        starts = np.flatnonzero(small)
    else:
        # The order of a larger suffix follows from the next smaller one.
        every = np.flatnonzero(small)
        before = np.append(0, np.cumsum(wanted))
        starts = every[before[every + 1] > before[np.append(0, every[:-1] + 1)]]
    ends = np.minimum(starts + depth, np.repeat(stops, np.diff(stops, prepend=-1))[starts] + 1)
    digest = np.zeros(len(symbols), np.uint64)
    # As bytes: 256, the byte FF plus one, is in no UTF-8 text.
    digest[starts] = span_hashes(symbols.astype(np.uint8), starts, ends) + (ends - starts).astype(np.uint64)
    direct = sort_direct(starts, packed_words(symbols), depth, digest)
    top = int(symbols.max()) + 1
    ends = np.searchsorted(symbols[direct], np.arange(top + 1))
    waiting: list[list[np.ndarray]] = [[] for _ in range(top)]
    out = []
    for c in range(top):
        front = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(front):
            bucket.append(front)
            before = front[front > 0] - 1
            front = before[~small[before] & (symbols[before] == c)]
        bucket.append(direct[ends[c]: ends[c + 1]])
        bucket = np.concatenate(bucket)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~small[before] & (symbols[before] > c)]
        if len(before):
            first = symbols[before]
            turn = np.argsort(first, kind="stable")
            before, first = before[turn], first[turn]
            cut = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(before, cut):
                waiting[symbols[part[0]]].append(part)
        waiting[c] = []
    return np.concatenate(out)


def common_prefixes(array: np.ndarray, symbols: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in the array, up to ``depth``."""
    word = packed_words(np.concatenate([symbols, np.zeros(depth + PACK, symbols.dtype)]))
    out = np.zeros(len(array), np.int64)
    todo = np.arange(1, len(array))
    for step in range(0, depth, PACK):
        differ = word[array[todo] + step] ^ word[array[todo - 1] + step]
        there = differ != 0
        here, differ = todo[there], differ[there]
        out[here] = step
        for k in range(PACK):
            out[here] += differ >> (9 * (PACK - 1 - k)) == 0
        todo = todo[~there]
        if not len(todo):
            break
    out[todo] = depth
    return np.minimum(out, depth)


def earlier_windows(texts: list[bytes], order: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of bytes covered by windows that a text of lower ``order`` holds too: text, begin, end and hash of each."""
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbols = data.astype(np.int16) + 1
    stops = np.cumsum(size + 1) - 1
    symbols[stops] = 0
    owner = np.repeat(np.arange(len(texts)), size + 1)
    # Equal windows stay neighbours when suffixes too short for one are left out.
    whole = stops[owner] - np.arange(len(data)) >= length
    array = suffix_array(symbols, length, whole)
    array = array[whole[array]]
    text = owner[array]
    none = np.zeros(0, np.int64)
    if not len(array):
        return none, none, none, none
    first = np.flatnonzero(common_prefixes(array, symbols, length) < length)
    least = np.repeat(np.minimum.reduceat(order[text], first), np.diff(np.append(first, len(array))))
    hit = np.sort(array[least < order[text]])
    text = owner[hit]
    first = np.flatnonzero((np.diff(hit, prepend=-2) != 1) | (np.diff(text, prepend=-1) != 0))
    last = np.append(first[1:], len(hit)) - 1
    if not len(hit):
        return none, none, none, none
    text, begin, end = text[first], hit[first], hit[last] + length
    base = (stops - size)[text]
    return text, begin - base, end - base, signed(span_hashes(data, begin, end))


def anchors(sums: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all windows of all texts, and the hashes of their strings; ``sums`` from ``running_hashes``."""
    width = length - GRAM + 1
    n = len(sums) - 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # ``hashes_between`` of all places, without picking them one by one.
    h = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n + 1, up=False)[: n - GRAM + 1] + np.uint64(GRAM))
    # Upper half the hash, lower half the place: the least is the leftmost of the least hashes.
    least = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span:])
    inside = np.zeros(n + 1, np.int64)
    for sign, edge in ((1, at[:-1]), (-1, np.maximum(at[1:] - length + 1, at[:-1]))):
        np.add.at(inside, edge, sign)
    picked = (least[np.cumsum(inside)[: len(least)] > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    picked = picked[np.diff(picked, prepend=-1) != 0]
    return picked, h[picked]


def surroundings(places: np.ndarray, begin, end, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all windows that can hold the anchors, inside their texts."""
    return np.maximum(places - (length - GRAM), begin), np.minimum(places + length, end)


def surrounding_hashes(sums, places, low, high) -> np.ndarray:
    return (hashes_between(sums, low, high) ^ mix((places - low).astype(np.uint64))) & LOW48


def window_ranges(length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start, seen from the anchor, of each of ``PIECES`` ranges of the windows that can hold it."""
    cuts = np.arange(PIECES + 1) * (length - GRAM + 1) // PIECES - (length - GRAM)
    return cuts[:-1], cuts[1:] - 1


def piece_hashes(sums, places, begin, end, length: int) -> list[np.ndarray]:
    """For each range of windows a short hash of the bytes that all of them hold.

    Windows are equal only where these are. At the edge of a text, where a range has no window, the bytes are fewer and mean nothing.
    """
    return [hashes_between(sums, np.maximum(places + last, begin), np.minimum(places + first + length, end)).astype(np.uint16)
            for first, last in zip(*window_ranges(length), strict=True)]


def shared_pieces(h: np.ndarray, ids: np.ndarray, pieces: list[np.ndarray]) -> np.ndarray:
    """Which piece of which row another document has at the same anchor."""
    out = np.zeros((len(pieces), len(h)), bool)
    for row, piece in zip(out, pieces, strict=True):
        turn = np.lexsort((piece, h))
        first = np.flatnonzero(_changes(h[turn]) | _changes(piece[turn]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        row[turn] = (np.minimum.reduceat(ids[turn], first) < np.maximum.reduceat(ids[turn], first))[of] if len(h) else False
    return out


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a value is another than the one before; the first is."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy()


def _id_array(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def _pack(parts: list[np.ndarray]) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(p).tobytes() for p in parts), 1)


def _six(values: np.ndarray) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _from_six(raw: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = raw.reshape(n, 6)
    return out.reshape(-1).view("<u8")


def anchor_blocks(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """All anchors as packed blocks, ``bucket`` by hash: columns of hash, surrounding, id step, place, and the hash of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def blocks() -> pa.RecordBatch:
            h, g, ids, p, *pieces = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            turn = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[turn], np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                t = turn[cuts[b]: cuts[b + 1]]
                if len(t):
                    steps = np.diff(ids[t].view(np.uint64), prepend=np.uint64(0))
                    # Planes of one byte each compress where the high bytes are zero.
                    planes = [x.astype(kind).view(np.uint8).reshape(len(t), -1).T for x, kind in ((steps, "<u8"), (p[t], "<u4"))]
                    rows.append((b, len(t), _pack([_six(h[t]), _six(g[t]), *planes, *[x[t] for x in pieces]])))
            number, n, packed = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())],
                                              ["bucket", "n", "block"])

        count = 0
        for batch in chunks(batches):
            data, at = text_bytes(batch.column("text"))
            sums = running_hashes(data)
            places, h = anchors(sums, at, length)
            owner = np.searchsorted(at, places, "right") - 1
            low, high = surroundings(places, at[owner], at[owner + 1], length)
            g = surrounding_hashes(sums, places, low, high)
            held.append((h & LOW48, g, _ids(batch.column("doc_id"))[owner], places - at[owner],
                         *piece_hashes(sums, places, at[owner], at[owner + 1], length)))
            count += len(places)
            if count > 2_000_000:
                yield blocks()
                count = 0
        if held and count:
            yield blocks()

    return docs.mapInArrow(run, "bucket int, n long, block binary")


def _unpack(n: int, block: bytes) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(zstandard.decompress(block), np.uint8)
    h, g, steps, p, pieces = np.split(raw, [6 * n, 12 * n, 20 * n, 24 * n])
    ids = np.cumsum(np.ascontiguousarray(steps.reshape(8, n).T).reshape(-1).view("<u8"), dtype=np.uint64).view(np.int64)
    places = np.ascontiguousarray(p.reshape(4, n).T).reshape(-1).view("<u4").astype(np.int64)
    return _from_six(h, n), _from_six(g, n), ids, places, *np.frombuffer(pieces.tobytes(), "<u2").reshape(PIECES, n)


def repeated_anchors(blocks: DataFrame, length: int) -> DataFrame:
    """Anchors that several documents hold: doc_id, place, around (hash of the surrounding), covered, and for the open ones anchor, first, last.

    ``covered`` anchors have the surrounding of an earlier document. The others are the earliest of their
    surrounding, and come only where another document can have a window of theirs: such windows lie within the bytes from ``first`` to ``last``,
    seen from the place.
    """
    begins, ends = window_ranges(length)

    def run(table: pa.Table) -> pa.Table:
        h, g, ids, p, *pieces = map(np.concatenate, zip(*[_unpack(n, b) for n, b in zip(
            table.column("n").to_pylist(), table.column("block").to_pylist(), strict=True)], strict=True))
        turn = np.argsort(h)
        new = _changes(h[turn])
        turn = turn[~(new & np.append(new[1:], True))]  # most anchors come once
        turn = turn[np.lexsort((ids[turn], g[turn], h[turn]))]
        h, g, ids, p, *pieces = (x[turn] for x in (h, g, ids, p, *pieces))
        new_h = _changes(h)
        new_g = new_h | _changes(g)
        of_h, of_g = np.cumsum(new_h) - 1, np.cumsum(new_g) - 1
        first_g, first_h = np.flatnonzero(new_g), np.flatnonzero(new_h)
        covered = ids > ids[first_g][of_g]
        several = np.bincount(of_h[first_g])[of_h] > 1 if len(h) else covered
        least, most = (np.minimum.reduceat(ids, first_h)[of_h], np.maximum.reduceat(ids, first_h)[of_h]) if len(h) else (ids, ids)
        left = np.flatnonzero(~covered & several & (least < most))
        shared = shared_pieces(h[left], ids[left], [x[left] for x in pieces])
        open_, shared = left[shared.any(0)], shared[:, shared.any(0)]
        done = np.flatnonzero(covered)
        keep = np.concatenate([done, open_])
        low, high = begins[shared.argmax(0)], ends[PIECES - 1 - shared[::-1].argmax(0)] + length
        unset = np.arange(len(keep)) < len(done)

        def only_open(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.array(np.concatenate([np.zeros(len(done), values.dtype), values]), kind, mask=unset)

        return pa.table({"doc_id": _id_array(ids[keep]), "place": p[keep], "around": signed(g[keep]), "covered": unset,
                         "anchor": only_open(signed(h[open_]), pa.int64()), "first": only_open(low, pa.int32()), "last": only_open(high, pa.int32())})

    return blocks.groupBy("bucket").applyInArrow(
        run, "doc_id long, place long, around long, covered boolean, anchor long, first int, last int")


def compressed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3)
        for batch in chunks(batches):
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pack.compress(t) for t in texts], pa.binary())], ["doc_id", "packed"])

    return docs.mapInArrow(run, "doc_id long, packed binary")


def _rows(batches: Iterator[pa.RecordBatch], limit: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, limit):
            yield batch.slice(start, limit)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices with about ``CHUNK_BYTES`` of text: the rows, their texts' bytes each with a zero behind, and where each begins (one more at the end)."""
    for batch in batches:
        texts, size, start = [], 0, 0
        for i, packed in enumerate(batch.column("packed").to_pylist()):
            texts.append(zstandard.decompress(packed))
            size += len(texts[-1])
            if size >= CHUNK_BYTES or i + 1 == batch.num_rows:
                at = np.cumsum([0, *(len(t) + 1 for t in texts)])
                yield batch.slice(start, len(texts)), np.frombuffer(b"\0".join(texts) + b"\0", np.uint8), at
                texts, size, start = [], 0, i + 1


def _marks(column: pa.Array, fields: list[str]) -> tuple[np.ndarray, ...]:
    """The row and the fields of each struct in a list-of-structs column."""
    lists = column.cast(pa.large_list(column.type.value_type))
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    return row, *(flat.field(f).to_numpy(zero_copy_only=False) for f in fields)


def _agreeing(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, places: np.ndarray, around: np.ndarray, length: int):
    """Bounds of the surroundings of the places in the texts from ``begin`` to ``end``, and which of them the text has."""
    fits = places + GRAM <= end
    places = np.where(fits, places, begin)
    low, high = surroundings(places, begin, end, length)
    return low, high, fits & (surrounding_hashes(sums, places, low, high) == around.view(np.uint64))


def open_surroundings(packed: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """Bytes of surroundings whose windows an earlier document can have: doc_id, anchor, hot, low, bytes."""
    lists = marks.where("NOT covered").groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list(F.struct("place", "around", "anchor", "hot", "first", "last")).alias("marks"))
    joined = packed.join(lists, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "packed", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in _opened(batches):
            row, place, around, anchor, hot, first, last = _marks(batch.column("marks"), ["place", "around", "anchor", "hot", "first", "last"])
            begin, end = at[row], at[row + 1] - 1
            _, _, fine = _agreeing(running_hashes(data), begin, end, begin + place, around, length)
            row, place, anchor, hot, begin, end = (x[fine] for x in (row, place, anchor, hot, begin, end))
            low, high = np.maximum(begin + place + first[fine], begin), np.minimum(begin + place + last[fine], end)
            blob = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [_id_array(_ids(batch.column("doc_id"))[row]), pa.array(anchor, pa.int64()), pa.array(hot, pa.bool_()), pa.array(low - begin, pa.int64()),
                 pa.array([blob[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())],
                ["doc_id", "anchor", "hot", "low", "bytes"])

    return joined.mapInArrow(run, "doc_id long, anchor long, hot boolean, low long, bytes binary")


def folded(texts: list[bytes], order: np.ndarray) -> np.ndarray:
    """Which texts an earlier document has as they are."""
    earliest: dict[bytes, int] = {}
    for text, d in zip(texts, order.tolist(), strict=True):
        if d < earliest.get(text, d + 1):
            earliest[text] = d
    return np.array([earliest[t] for t in texts], np.int64) < order


def sorted_matches(around: DataFrame, buckets: int, length: int) -> DataFrame:
    """Covered runs ``doc_id, low, high, hash`` by suffix arrays over the surroundings of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: list = []
        low: list = []
        texts: list[bytes] = []
        anchor: list = []
        total = 0

        def matched(n: int) -> pa.RecordBatch:
            order, lows = np.array([NO_ID if d is None else d for d in doc[:n]], np.int64), np.array(low[:n], np.int64)
            later = folded(texts[:n], order)
            data, at = text_bytes(pa.array([texts[i] for i in np.flatnonzero(later)], pa.binary()))
            left = np.flatnonzero(~later)
            t, begin, end, digest = earlier_windows([texts[i] for i in left], order[left], length)
            t = left[t]
            runs = ((order[later], lows[later], lows[later] + np.diff(at), signed(span_hashes(data, at[:-1], at[1:]))),
                    (order[t], lows[t] + begin, lows[t] + end, digest))
            ids, *rest = map(np.concatenate, zip(*runs, strict=True))
            out = pa.RecordBatch.from_arrays([_id_array(ids), *map(pa.array, rest)], ["doc_id", "low", "high", "hash"])
            for held in (doc, low, texts, anchor):
                del held[:n]
            return out

        for batch in batches:
            for d, a, lo, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "anchor", "low", "bytes")], strict=True):
                if total > SORT_BYTES and a != anchor[-1]:
                    yield matched(len(doc))
                    total = 0
                doc.append(d), anchor.append(a), low.append(lo), texts.append(text)
                total += len(text)
        if doc:
            yield matched(len(doc))

    rows = around.where("NOT hot").repartition(buckets, "anchor").sortWithinPartitions("anchor")
    return rows.select("doc_id", "anchor", "low", "bytes").mapInArrow(run, "doc_id long, low long, high long, hash long")


def counted_matches(around: DataFrame, length: int) -> DataFrame:
    """The same runs for anchors with very many surroundings: each window's earliest document, combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows(batches, 4096):
            data, at = text_bytes(batch.column("bytes"))
            n = np.maximum(np.diff(at) - length + 1, 0)
            owner = np.repeat(np.arange(len(n)), n)
            place = np.arange(n.sum()) - (np.cumsum(n) - n)[owner]
            begin = at[owner] + place
            ids, lows = _ids(batch.column("doc_id"))[owner], batch.column("low").to_numpy()[owner] + place
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lows), pa.array(lows + length),
                                              pa.array(signed(span_hashes(data, begin, begin + length)))], ["doc_id", "low", "high", "hash"])

    windows = around.where("hot").select("doc_id", "low", "bytes").mapInArrow(run, "doc_id long, low long, high long, hash long")
    first = windows.groupBy("hash").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last")
    later = windows.join(first, "hash").where("doc_id > _first")
    return later.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "low", "high", "hash")


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``removed`` (begin and end of maximal runs) and ``kept`` (the bytes left) of every row.

    A byte goes if a string of ``length`` bytes around it also starts in a row with a smaller
    integer id; strings are judged on the input and never cross rows. A row without an id counts as
    the last; rows that share an id are not earlier than each other. A null text has no bytes. Other columns are not read.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A bucket's share of the anchors stays the same whatever the corpus holds.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + size // BUCKET_BYTES)
    marks = written(repeated_anchors(anchor_blocks(docs, buckets, length), length), "anchors")
    hot = written(marks.where("NOT covered").groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), "hot-anchors")
    marks = marks.join(hot.withColumn("hot", F.lit(True)), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    packed = compressed(docs)
    around = open_surroundings(packed, marks, length)
    runs = sorted_matches(around, buckets, length)
    if not hot.isEmpty():
        runs = runs.unionByName(counted_matches(around, length))
    whole = marks.where("covered").groupBy("doc_id").agg(F.collect_list(F.struct("place", "around")).alias("whole"))
    parts = runs.groupBy("doc_id").agg(F.collect_list(F.struct("low", "high", "hash")).alias("parts"))
    told = whole.select(F.col("doc_id").alias("_a"), "whole")
    also = parts.select(F.col("doc_id").alias("_b"), "parts")
    joined = packed.join(told, F.col("doc_id").eqNullSafe(F.col("_a")), "left").join(
        also, F.col("doc_id").eqNullSafe(F.col("_b")), "left").select("doc_id", "packed", "whole", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in _opened(batches):
            sums = running_hashes(data)
            row, place, around = _marks(batch.column("whole"), ["place", "around"])
            begins, ends, fine = _agreeing(sums, at[row], at[row + 1] - 1, at[row] + place, around, length)
            begins, ends = begins[fine], ends[fine]
            row, low, high, digest = _marks(batch.column("parts"), ["low", "high", "hash"])
            low, high = at[row] + low, at[row] + high
            inside = high < at[row + 1]
            low, high, digest = low[inside], high[inside], digest[inside]
            same = signed(hashes_between(sums, low, high)) == digest
            begins, ends = np.concatenate([begins, low[same]]), np.concatenate([ends, high[same]])
            # A surrounding shorter than a window, at the edge of a short text, holds none.
            long_enough = ends - begins >= length
            begins, ends = begins[long_enough], ends[long_enough]
            # The zero behind each text keeps the runs of two texts apart.
            gone = np.cumsum(np.bincount(begins, minlength=len(data)) - np.bincount(ends, minlength=len(data))) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            begins, ends = edge[::2], edge[1::2]
            row = np.searchsorted(at, begins, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(begins - at[row]), pa.array(ends - at[row])], ["begin", "end"])
            stays = ~gone
            stays[at[1:] - 1] = False
            kept = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [
                None, pa.py_buffer(np.append(0, np.cumsum(stays))[at].astype(np.int64)), pa.py_buffer(data[stays])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at) - 1), pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, at), pa.int32()), spans),
                 kept.cast(pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<begin: long, end: long>>, kept binary")
