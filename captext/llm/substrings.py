"""Exact repeats of long byte strings by a sparse suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from captext.llm.columns import set_aside
from captext.session import cut

#: Text bytes planned for a partition.
PARTITION_BYTES = 16 << 20
#: Bytes of a suffix by which it is found, or a fifth of the string's length if that is less.
LEAD = 20
#: Bytes that are scanned together; longer texts are scanned in overlapping stretches.
STRETCH = 1 << 17
_R = np.uint64(0x9E3779B97F4A7C15)


class Shape:
    """Lengths for repeats of `least` bytes: leads of `lead`, `window` of them in a string, contexts of `left` + `least` bytes."""

    def __init__(self, least: int) -> None:
        if not 8 <= least <= 255:
            raise ValueError("least must be between 8 and 255")
        self.least, self.lead = least, min(LEAD, max(4, least // 5))
        self.window = least - self.lead + 1
        self.left = self.window - 1
        self.context = self.left + least
        self.pad = -self.context % 8


def _slide(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every `width` neighbours of x."""
    step = 1
    while 2 * step <= width:
        x = op(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def _grams(x: np.ndarray, width: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of every `width` neighbours of x."""
    out, done, power, factor = None, 0, x, _R
    bits = width
    size = 1
    while bits:
        if bits & 1:
            out = power if out is None else out[: len(x) - done - size + 1] * factor + power[done : len(x) - size + 1]
            done += size
        bits >>= 1
        if bits:
            power = power[: len(power) - size] * factor + power[size:]
            with np.errstate(over="ignore"):
                factor = factor * factor
            size *= 2
    out = out ^ (out >> np.uint64(32))
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def _words_hash(words: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of 64-bit words, by sums of products of their halves."""
    keys = np.random.default_rng(5).integers(0, 1 << 63, words.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    x = words + keys
    x ^= x >> np.uint64(29)
    x *= keys[::-1]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    h = x.sum(1) + salt.astype(np.uint64) * _R
    return h ^ (h >> np.uint64(31))


def anchors(texts: list[bytes], shape: Shape) -> tuple[np.ndarray, ...]:
    """(text number, place, left bytes, right bytes, lead hash, context hash) of each text's anchors.

    In every string of `least` bytes the lead with the smallest hash is an
    anchor, so equal strings have an anchor at the same place in them. Its
    context is all that strings around it can hold: `left` bytes before and
    `least` from it on, as far as the text goes.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, int, int]] = []
    held = 0
    overlap = 2 * shape.left + shape.least
    for i, t in enumerate(texts):
        if len(t) < shape.least:
            continue
        a = 0
        while True:
            b = min(len(t), a + STRETCH + overlap)
            group.append((i, a, b, len(t)))
            held += b - a
            if held >= STRETCH:
                parts.append(_scan(texts, group, shape))
                group, held = [], 0
            if b == len(t):
                break
            a += STRETCH
    if group:
        parts.append(_scan(texts, group, shape))
    if not parts:
        return tuple(np.empty(0, kind) for kind in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    out = [np.concatenate(x) for x in zip(*parts, strict=True)]
    _, first = np.unique(np.stack((out[0], out[1])), axis=1, return_index=True) if any(len(t) > STRETCH for t in texts) else (None, slice(None))
    return tuple(x[first] for x in out)


def _scan(texts: list[bytes], group: list[tuple[int, int, int, int]], shape: Shape) -> tuple[np.ndarray, ...]:
    gap = bytes(shape.context + shape.pad)
    pieces, starts, at = [], [], 0
    for i, a, b, _ in group:
        pieces += (gap, texts[i][a:b])
        starts.append(at + len(gap))
        at += len(gap) + b - a
    raw = np.frombuffer(b"".join((*pieces, gap)), np.uint8)
    h = _grams(raw.astype(np.uint64) + np.uint64(1), shape.lead)
    inside, strings = np.zeros(len(h), bool), np.zeros(len(h) - shape.window + 1, bool)
    for s, (_, a, b, _) in zip(starts, group, strict=True):
        inside[s : s + b - a - shape.lead + 1] = True
        strings[s : s + b - a - shape.least + 1] = True
    h[~inside] = ~np.uint64(0)
    low = _slide(h, shape.window, np.minimum)
    low[~strings] = 0
    high = _slide(np.concatenate((np.zeros(shape.left, np.uint64), low, np.zeros(shape.left, np.uint64))), shape.window, np.maximum)
    q = np.flatnonzero(inside & (high == h))
    which = np.searchsorted(starts, q, side="right") - 1
    facts = np.array(group, np.int64)[which]
    begin = np.array(starts, np.int64)[which]
    place = q - begin + facts[:, 1]
    left, right = np.minimum(shape.left, place), np.minimum(shape.least, facts[:, 3] - place)
    # A stretch of a longer text knows only the contexts that lie inside it.
    known = (q - left >= begin) & (q - begin + right <= facts[:, 2] - facts[:, 1])
    q, place, left, right, facts = q[known], place[known], left[known], right[known], facts[known]
    view = np.lib.stride_tricks.sliding_window_view(raw, shape.context + shape.pad)
    context = view[q - shape.left]
    if shape.pad:
        context[:, -shape.pad :] = 0
    return facts[:, 0], place, left, right, h[q], _words_hash(context.view(np.uint64), left * 256 + right)


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes in order, and how many bytes each shares with the one before it (0 first).

    Multikey quicksort with characters of eight bytes: rows are parted by one
    word, and only runs of equal ones go on to the next word.
    """
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    opens = np.concatenate(([True], words[order[1:], 0] != words[order[:-1], 0]))[:n]
    for k in range(1, words.shape[1]):
        tied = ~opens
        tied[:-1] |= ~opens[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        run, own = np.cumsum(opens)[at], order[at]
        own = own[np.lexsort((words[own, k], run))]
        order[at] = own
        opens[at[1:]] |= (run[1:] == run[:-1]) & (words[own[1:], k] != words[own[:-1], k])
    shared = np.zeros(n, np.int64)
    for a in range(1, n, 8192):
        differ = rows[order[a : a + 8192]] != rows[order[a - 1 : min(n, a + 8192) - 1]]
        shared[a : a + 8192] = np.where(differ.any(1), differ.argmax(1), width)
    return order, shared


def twins(before: np.ndarray, after: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks (row, o) of two kinds for the string that starts o bytes before a row's suffix: it equals that of an earlier row; it is
    the first of its like here, but rows in other buckets may have it too.

    before: the bytes before each suffix, nearest first, `left` of them true ones;
    after: the suffix, as long as a string, `right` of it true. Rows stand in the
    order of their places. Both sides are sorted once; rows share their last o
    bytes before and first ones after exactly where no smaller shared length lies
    between them in the orders, so that two class numbers stand for a string. Other
    buckets hold suffixes below the first or above the last here, so only strings
    that share all of their suffix with one of these two can be there.
    """
    n, least = after.shape
    window = before.shape[1] + 1
    twin, outside = np.zeros((n, window), bool), np.zeros((n, window), bool)
    sides = [multikey_sort(x) for x in (before, after)]
    number = np.empty((2, n), np.int64)
    for o in range(window):
        able = np.flatnonzero((left >= o) & (right >= least - o))
        if not len(able):
            continue
        for side, (order, shared), length in zip(number, sides, (o, least - o), strict=True):
            side[order] = np.cumsum(shared < length)
        ends = number[1, able]
        value = ends * (n + 1) + number[0, able]
        rank = np.argsort(value, kind="stable")
        again = np.concatenate(([False], value[rank[1:]] == value[rank[:-1]]))
        twin[able[rank[again]], o] = True
        edge = (ends == number[1, sides[1][0][0]]) | (ends == number[1, sides[1][0][-1]])
        outside[able, o] = edge & ~twin[able, o]
    return twin, outside


def _join_ranges(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [a, b) of each key merged where they touch; sorted."""
    order = np.lexsort((a, key))
    key, a, b = key[order], a[order], b[order]
    if not len(key):
        return key, a, b
    # The furthest end so far, started anew at each key.
    opens = np.concatenate(([True], key[1:] != key[:-1]))
    number = np.cumsum(opens)
    reach = np.maximum.accumulate(b + number * (1 << 42)) - number * (1 << 42)
    new = opens.copy()
    new[1:] |= a[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return key[first], a[first], reach[np.append(first[1:], len(key)) - 1]


ANCHOR = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("ord", "<i8"), ("pos", "<i8")])
MARK = "ord long, kind byte, a long, b long"
#: A string's hash and where it starts.
EDGE = np.dtype([("high", "<u8"), ("low", "<u8"), ("ord", "<i8"), ("a", "<i8")])


def repeat_spans(docs: DataFrame, least: int = 100) -> DataFrame:
    """docs with `_row_spans`, the maximal runs [a, b) of bytes to remove from each text's UTF-8, and `_row_order`.

    A byte goes if a string of `least` bytes over it starts earlier too: in a
    row with a smaller doc_id, or earlier in the same text. Null texts are empty.
    Rows that share a doc_id, or have none, stand in the order of doc_id (null
    first), then of a hash of the text.

    A suffix is kept at each anchor (see anchors()). Tasks drop suffixes whose
    whole context they saw earlier; the others meet by their lead's hash, and
    later copies of a context are settled there (equal lead and context hashes,
    128 bits, stand for equal bytes). Where one lead has several contexts, these
    suffixes are fetched with the bytes before them and range-partitioned by
    sampled splitters, so that a common lead is parted by what follows it. A bucket
    sorts by multikey quicksort and finds equal strings by neighbours' shared
    lengths, see twins(). Of strings that reach over a bucket's border the first
    ones of all buckets meet by their 128-bit hash, and the earliest stays.
    """
    shape = Shape(least)
    text = F.coalesce(F.col("text"), F.lit(""))
    frame = docs.withColumn("text", text).withColumn("doc_id", F.col("doc_id").cast("long"))
    size = frame.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PARTITION_BYTES))
    unclear = frame.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count()
    if unclear:
        ordered = cut(frame.withColumn("_row_hash", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "_row_hash").sortWithinPartitions("doc_id", "_row_hash"))
        frame = ordered.drop("_row_hash").withColumn("_row_order", F.monotonically_increasing_id())
    else:
        frame = frame.withColumn("_row_order", F.col("doc_id"))
    frame = frame.repartition(parts, "_row_order")

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in rows:
            ords = batch.column("_row_order").to_numpy()
            which, place, left, right, key, ctx = anchors(batch.column("text").cast(pa.large_binary()).to_pylist(), shape)
            rec = np.empty(len(key), ANCHOR)
            rec["key"], rec["ctx"], rec["ord"] = key, ctx, ords[which]
            rec["pos"] = place << 16 | left << 8 | right
            found.append(rec)
        rec = np.concatenate(found) if found else np.empty(0, ANCHOR)
        rec = rec[np.lexsort((rec["pos"], rec["ord"], rec["ctx"], rec["key"]))]
        same = (rec["key"][1:] == rec["key"][:-1]) & (rec["ctx"][1:] == rec["ctx"][:-1])
        later = np.concatenate((np.zeros(min(1, len(rec)), bool), same))
        key, a, b = _ranges(rec[later])
        spread = (key % parts).astype(np.int32)
        for p in np.unique(spread):
            own = spread == p
            yield _packed(int(p), 1, np.stack((key[own], a[own], b[own]), 1).astype("<i8").tobytes())
        rec = rec[~later]
        target = (rec["key"] % np.uint64(parts)).astype(np.int32)
        order = np.argsort(target, kind="stable")
        rec, target = rec[order], target[order]
        cuts = np.searchsorted(target, np.arange(parts + 1))
        for p in range(parts):
            if cuts[p] < cuts[p + 1]:
                own = rec[cuts[p] : cuts[p + 1]]
                yield _packed(p, 0, b"".join(own[c].tobytes() for c in ANCHOR.names))

    def _ranges(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, left, right = rec["pos"] >> 16, rec["pos"] >> 8 & 255, rec["pos"] & 255
        full = left + right >= shape.least
        return _join_ranges(rec["ord"][full], (place - left)[full], (place + right)[full])

    def settle(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in rows:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if kind:
                    m = np.frombuffer(blob, "<i8").reshape(-1, 3)
                    yield _marks(m[:, 0], 0, m[:, 1], m[:, 2])
                else:
                    n = len(blob) // ANCHOR.itemsize
                    rec = np.empty(n, ANCHOR)
                    for k, c in enumerate(ANCHOR.names):
                        rec[c] = np.frombuffer(blob, ANCHOR[c], n, 8 * n * k)
                    found.append(rec)
        if not found:
            return
        rec = np.concatenate(found)
        del found
        rec = rec[np.lexsort((rec["pos"], rec["ord"], rec["ctx"], rec["key"]))]
        new_key = np.concatenate(([True], rec["key"][1:] != rec["key"][:-1]))
        new_ctx = new_key.copy()
        new_ctx[1:] |= rec["ctx"][1:] != rec["ctx"][:-1]
        key, a, b = _ranges(rec[~new_ctx])
        yield _marks(key, 0, a, b)
        group = np.cumsum(new_key) - 1
        several = np.bincount(group, new_ctx) > 1
        ask = rec[new_ctx & several[group]]
        yield _marks(ask["ord"], 1, ask["pos"], np.zeros(len(ask), np.int64))

    def fetch(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            after, before, ords, places = [], [], [], []
            for o, t, marks in zip(batch.column("_row_order").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("_row_marks"), strict=True):
                values = marks.values
                for pos in values.field("a").filter(pc.equal(values.field("kind"), 1)).to_pylist():
                    q, left, right = pos >> 16, pos >> 8 & 255, pos & 255
                    after.append(t[q : q + right] + bytes(shape.least - right))
                    before.append(t[q - left : q][::-1] + bytes(shape.left - left))
                    ords.append(o)
                    places.append(pos)
            yield pa.RecordBatch.from_arrays([pa.array(after, pa.binary()), pa.array(before, pa.binary()), pa.array(ords, pa.int64()), pa.array(places, pa.int64())], ["after", "before", "ord", "pos"])

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(rows))
        n = table.num_rows
        if not n:
            return
        ords, pos = table.column("ord").to_numpy(), table.column("pos").to_numpy()
        order = np.lexsort((pos, ords))
        ords, pos = ords[order], pos[order]
        after, before = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8).reshape(n, -1)[order] for c in ("after", "before"))
        twin, outside = twins(before, after, pos >> 8 & 255, pos & 255)
        row, o = np.nonzero(twin)
        place = (pos >> 16)[row] - o
        key, a, b = _join_ranges(ords[row], place, place + shape.least)
        yield from _dealt(0, key % parts, np.stack((key, a, b), 1).astype("<i8"))
        row, o = np.nonzero(outside)
        for k in range(0, len(row), 200_000):
            i, j = row[k : k + 200_000], o[k : k + 200_000]
            found = np.empty(len(i), EDGE)
            strings = (xxh3_128_digest(before[x, :y][::-1].tobytes() + after[x, : shape.least - y].tobytes()) for x, y in zip(i.tolist(), j.tolist(), strict=True))
            found["high"], found["low"] = np.frombuffer(b"".join(strings), "<u8").reshape(-1, 2).T
            found["ord"], found["a"] = ords[i], (pos >> 16)[i] - j
            yield from _dealt(1, found["high"] % np.uint64(parts), found)

    def across(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, EDGE)]
        for batch in rows:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if kind:
                    held.append(np.frombuffer(blob, EDGE))
                else:
                    m = np.frombuffer(blob, "<i8").reshape(-1, 3)
                    yield _marks(m[:, 0], 0, m[:, 1], m[:, 2])
        rest = np.concatenate(held)
        rest = rest[np.lexsort((rest["a"], rest["ord"], rest["low"], rest["high"]))]
        opens = np.concatenate(([True], (rest["high"][1:] != rest["high"][:-1]) | (rest["low"][1:] != rest["low"][:-1])))[: len(rest)]
        first = rest[np.flatnonzero(opens)[np.cumsum(opens) - 1]] if len(rest) else rest
        # A string of one byte over and over has several anchors, so that its first place may stand there twice.
        later = rest[(rest["ord"] != first["ord"]) | (rest["a"] != first["a"])]
        yield _marks(later["ord"], 0, later["a"], later["a"] + shape.least)

    # Every branch takes the same columns, so that one exchange of the texts serves them all.
    packed = frame.mapInArrow(find, "part int, kind byte, rows binary").repartitionById(parts, F.col("part"))
    settled = packed.mapInArrow(settle, MARK).repartition(parts, "ord")
    marks = settled.groupBy("ord").agg(F.collect_list(F.struct("kind", "a", "b")).alias("_row_marks"))
    asked = frame.join(marks.hint("shuffle_hash").withColumnRenamed("ord", "_row_mark"), F.col("_row_order") == F.col("_row_mark"))
    contexts = asked.mapInArrow(fetch, "after binary, before binary, ord long, pos long").repartitionByRange(parts, "after", "before")
    edges = contexts.mapInArrow(compare, "part int, kind byte, rows binary").repartitionById(parts, F.col("part"))
    found = edges.mapInArrow(across, MARK)
    more = found.repartition(parts, "ord").groupBy("ord").agg(F.collect_list(F.struct("kind", "a", "b")).alias("_row_more"))
    both = frame.join(marks.hint("shuffle_hash").withColumnRenamed("ord", "_row_mark"), F.col("_row_order") == F.col("_row_mark"), "left")
    both = both.join(more.hint("shuffle_hash").withColumnRenamed("ord", "_row_other"), F.col("_row_order") == F.col("_row_other"), "left")
    ranges = F.concat(F.coalesce("_row_marks", F.array().cast("array<struct<kind:tinyint,a:bigint,b:bigint>>")), F.coalesce("_row_more", F.array().cast("array<struct<kind:tinyint,a:bigint,b:bigint>>")))
    spans = F.array_sort(F.transform(F.filter(ranges, lambda x: x["kind"] == 0), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))
    return both.select(*docs.columns, "_row_order", spans.alias("_row_spans"))


def _packed(part: int, kind: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int8()), pa.array([blob], pa.binary())], ["part", "kind", "rows"])


def _marks(ords: np.ndarray, kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ords.astype(np.int64)), pa.array(np.full(len(ords), kind, np.int8)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["ord", "kind", "a", "b"])


def _dealt(kind: int, part: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of each part in one blob."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part, rows = part[order].astype(np.int64), rows[order]
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    for a, b in zip(starts, np.append(starts[1:], len(part)), strict=True):
        yield _packed(int(part[a]), kind, rows[a:b].tobytes())


def _merged(column: pa.Array) -> list[list[tuple[int, int]]]:
    """Each row's sorted ranges, merged where they touch."""
    offsets = column.offsets.to_numpy()
    a, b = (column.values.field(c).to_numpy() for c in ("a", "b"))
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    key, a, b = _join_ranges(row, a[offsets[0] : offsets[-1]], b[offsets[0] : offsets[-1]])
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
    for k, x, y in zip(key.tolist(), a.tolist(), b.tolist(), strict=True):
        out[k].append((x, y))
    return out


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def repeats_removed(docs: DataFrame, least: int = 100) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (hexadecimal, of the bytes left). See repeat_spans()."""

    def digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n, removed, spans, sha = [], [], [], []
            for t, own in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), _merged(batch.column("_row_spans")), strict=True):
                t = t or b""
                n.append(len(t))
                removed.append(sum(b - a for a, b in own))
                spans.append(len(own))
                sha.append(hashlib.sha256(_kept(t, own)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeat_spans(docs.select("doc_id", "text"), least).select("doc_id", "text", "_row_spans").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, least: int = 100) -> DataFrame:
    """docs with the repeated spans cut out of text, as far as they hold whole characters; n_chars follows where there is one."""

    def trim(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = []
            for t, own in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), _merged(batch.column("_row_spans")), strict=True):
                whole = []
                for a, b in own:
                    while a < b and t[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(t) and t[b] & 0xC0 == 0x80:
                        b -= 1
                    whole.append((a, b))
                texts.append(_kept(t, whole))
            at = batch.schema.get_field_index("text")
            kind = batch.schema.field("text").type
            out = batch.set_column(at, "text", pa.array(texts, pa.binary()).cast(kind))
            yield out.drop_columns(["_row_spans", "_row_order"])

    plain, restored = set_aside(docs, "doc_id", "text", "n_chars")
    schema = plain.withColumn("text", F.col("text").cast("string")).withColumn("doc_id", F.col("doc_id").cast("long")).schema
    out = repeat_spans(plain, least).mapInArrow(trim, schema)
    return restored(out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out)
