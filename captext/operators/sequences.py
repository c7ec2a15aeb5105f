"""Operators over ordered rows of a stream: changes, stability, islands, retention."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captext.functions.text import growth_tail, normalise_key, token_overlap
from captext.operators.scan import changes, islands


def per_stream(*order: str, key: str = "stream_id"):
    return Window.partitionBy(key).orderBy(*order)


def text_changes(rows: DataFrame) -> DataFrame:
    """changed (the key differs from the one before) and last_text, the text where it last changed."""
    w = per_stream("seq")
    key = normalise_key(F.col("text"))
    changed = F.coalesce(F.lag(key).over(w) != key, F.lit(True))
    return rows.withColumn("changed", changed).withColumn("last_text", F.last(F.when(F.col("changed"), F.col("text")), ignorenulls=True).over(w))


def frame_difference(frames: DataFrame) -> DataFrame:
    """diff, the mean absolute difference to the frame before, and moved (> 2) and cut (> 30)."""
    w = per_stream("seq")
    before = F.lag("luma").over(w)
    mean = F.aggregate(F.zip_with("luma", before, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("luma")
    return frames.withColumn("diff", F.when(before.isNotNull(), mean)).withColumn("moved", F.coalesce(F.col("diff") > 2, F.lit(True))).withColumn("cut", F.coalesce(F.col("diff") > 30, F.lit(False)))


def text_delta(rows: DataFrame) -> DataFrame:
    """delta: what follows the text before where it is a prefix, else the whole text; tail: the words that are new."""
    w = per_stream("seq")
    now, old = F.trim("text"), F.trim(F.lag("text").over(w))
    grown = (F.length(old) > 0) & F.startswith(now, old)
    return rows.withColumn("delta", F.when(grown, F.trim(F.substr(now, F.length(old) + 1))).otherwise(now)).withColumn("tail", growth_tail(F.lag("text").over(w), F.col("text")))


def stable_runs(rows: DataFrame, least: int = 2) -> DataFrame:
    """Runs of equal keys of `least` polls or more: stream_id, run, key, n, first_seq."""
    w = per_stream("seq")
    keyed = rows.withColumn("key", normalise_key(F.col("text")))
    flagged = keyed.withColumn("_new", F.coalesce((F.lag("key").over(w) != F.col("key")).cast("int"), F.lit(1)))
    runs = flagged.withColumn("run", F.sum("_new").over(w)).groupBy("stream_id", "run", "key").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return runs.where(F.col("n") >= least)


def repeats_last(rows: DataFrame, above: float = 0.7) -> DataFrame:
    return rows.withColumn("repeat", token_overlap(F.lag("text").over(per_stream("seq")), F.col("text")) > above)


def heard_before(rows: DataFrame, above: float = 0.6, memory: int = 16) -> DataFrame:
    """own: the text shares more than `above` of its words with one of the last `memory` of its stream."""
    held = F.collect_list("text").over(per_stream("seq").rowsBetween(-memory, -1))
    return rows.withColumn("_held", held).withColumn("own", F.exists("_held", lambda x: token_overlap(x, F.col("text")) > above)).drop("_held")


def _framed(boxes: DataFrame, run, *columns: str, schema: str) -> DataFrame:
    """What run(keys, firsts, fields) makes of batches of whole frames: their ids, the number of each box' frame and the boxes' columns, NaN for a null number."""

    def batches(given):
        for batch in given:
            held = batch.column("held")
            of = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False))
            fields = dict(zip(columns, held.flatten().flatten(), strict=True))
            yield run(batch.column("frame_id"), of, {c: v if pa.types.is_string(v.type) else v.to_numpy(zero_copy_only=False) for c, v in fields.items()})

    return boxes.groupBy("frame_id").agg(F.collect_list(F.struct(*columns)).alias("held")).mapInArrow(batches, schema)


def _nulls_first(values: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(values), -np.inf, values)


def _near(of: np.ndarray, height: np.ndarray, n: int) -> np.ndarray:
    """For each of n frames max(8, 0.6 median height)."""
    known = ~np.isnan(height)
    order = np.lexsort((height[known], of[known]))
    size = np.bincount(of[known], minlength=n)
    first = np.cumsum(size) - size
    tall, some = np.zeros(n), size > 0
    sorted_height = height[known][order]
    tall[some] = (sorted_height[(first + (size - 1) // 2)[some]] + sorted_height[(first + size // 2)[some]]) / 2
    return np.maximum(8.0, 0.6 * tall)


def _read(keys, of: np.ndarray, row: np.ndarray, x: dict) -> pa.RecordBatch:
    """frame_id, n_rows and text of frames whose boxes are in rows, counted over all frames."""
    order = np.lexsort((x["pos"], _nulls_first(x["x0"]), row))
    texts = x["text"].take(pa.array(order)).to_pylist()
    first = np.flatnonzero(np.diff(row[order], prepend=-1))
    lines = [" ".join(w for w in texts[a:b] if w is not None) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(texts)], strict=True)]
    sizes = np.bincount(of[order][first], minlength=len(keys))
    ends = np.cumsum(sizes).tolist()
    text = ["\n".join(lines[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return pa.RecordBatch.from_arrays([keys, pa.array(sizes), pa.array(text, pa.string())], ["frame_id", "n_rows", "text"])


_READ = {"schema": "frame_id long, n_rows long, text string"}


def reading_order(boxes: DataFrame) -> DataFrame:
    """frame_id and text: boxes in rows by the gap of their middles (max(8, 0.6 median height)), left to right. A frame is held in memory."""

    def run(keys, of, x):
        middle = (x["y0"] + x["y1"]) / 2
        order = np.lexsort((x["pos"], _nulls_first(x["x0"]), _nulls_first(middle), of))
        near = _near(of, x["y1"] - x["y0"], len(keys))[of[order]]
        gap = np.diff(middle[order], prepend=np.nan)
        new = (np.diff(of[order], prepend=-1) != 0) | ~(gap <= near)
        row = np.empty(len(of), np.int64)
        row[order] = np.cumsum(new)
        return _read(keys, of, row, x)

    return _framed(boxes.where("frame_id IS NOT NULL"), run, "x0", "y0", "y1", "pos", "text", **_READ)


def reading_order_exact(boxes: DataFrame) -> DataFrame:
    """reading_order() with rows by the running mean of their middles: a box, from the top down, joins the first row that it is near to."""

    def run(keys, of, x):
        middle = (x["y0"] + x["y1"]) / 2
        order = np.lexsort((x["pos"], x["x0"], middle, of))
        limits = _near(of, x["y1"] - x["y0"], len(keys)).tolist()
        made, last, start, sums, counts = [], -1, 0, [], []
        ranks = []

        def close():
            # Rows by their mean, in the order in which they began where it is equal.
            at = {r: i for i, r in enumerate(sorted(range(len(sums)), key=lambda r: sums[r] / counts[r]))}
            ranks.extend(start + at[r] for r in made)

        for frame, m in zip(of[order].tolist(), middle[order].tolist(), strict=True):
            if frame != last:
                close()
                start += len(sums)
                made, last, sums, counts, near = [], frame, [], [], limits[frame]
            r = next((r for r in range(len(sums)) if abs(sums[r] / counts[r] - m) <= near), None)
            if r is None:
                r = len(sums)
                sums.append(0.0)
                counts.append(0)
            sums[r] += m
            counts[r] += 1
            made.append(r)
        close()
        row = np.empty(len(of), np.int64)
        row[order] = ranks
        return _read(keys, of, row, x)

    return _framed(boxes, run, "x0", "y0", "y1", "pos", "text", **_READ)


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches over edges (a, b)."""
    root = np.arange(n)
    while (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root != root[root]).any():
            root = root[root]
    return root


def merge_boxes(boxes: DataFrame) -> DataFrame:
    """frame_id, the merged rectangles and their number of boxes; boxes (pos is theirs in the frame) merge that overlap in height and are near in width, transitively.

    A frame is held in memory; from the top down, a box meets those that start before its end.
    """

    def run(keys, of, x):
        x0, y0, x1, y1 = (x[c] for c in ("x0", "y0", "x1", "y1"))
        same, node = np.unique(np.stack((of, x["pos"].astype(np.int64)), 1), axis=0, return_inverse=True)
        order = np.lexsort((_nulls_first(y0), of))
        height = y1 - y0
        # How far below a box' end one may start: for boxes that end before they start.
        slack = 0.55 * max(0.0, -np.nanmin(height)) if (height < 0).any() else 0.0
        at, step, edges = np.flatnonzero(keys.is_valid().to_numpy(zero_copy_only=False)[of[order]]), 0, []
        while len(at):
            step += 1
            at = at[at + step < len(order)]
            i, j = order[at], order[at + step]
            on = (of[i] == of[j]) & ~(y0[j] > y1[i] + slack)
            at, i, j = at[on], i[on], j[on]
            over = np.fmin(y1[i], y1[j]) - np.fmax(y0[i], y0[j]) >= 0.55 * np.fmin(height[i], height[j])
            near = np.fmax(x0[i], x0[j]) - np.fmin(x1[i], x1[j]) <= 0.55 * np.fmax(height[i], height[j])
            edges.append(np.stack((node[i], node[j]), 1)[over & near])
        a, b = np.concatenate(edges).T if edges else np.zeros((2, 0), np.int64)
        root = _joined(len(same), a, b)[node]
        order = np.argsort(root, kind="stable")
        first = np.flatnonzero(np.diff(root[order], prepend=-1))
        key, pos = same[root[order][first]].T
        sides = [f.reduceat(c[order], first) for f, c in ((np.fmin, x0), (np.fmin, y0), (np.fmax, x1), (np.fmax, y1))]
        counts = np.diff(np.append(first, len(order)))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(key)), pa.array(pos.astype(np.int32)), *(pa.array(c, from_pandas=True) for c in sides), pa.array(counts)], ["frame_id", "box", "x0", "y0", "x1", "y1", "n"])

    return _framed(boxes.where("pos IS NOT NULL"), run, "x0", "y0", "x1", "y1", "pos", schema="frame_id long, box int, x0 double, y0 double, x1 double, y1 double, n long")


def name_lines(rows: DataFrame) -> DataFrame:
    """Lines that are a short capitalised word just before a line of three words or more."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    after = F.size(F.filter(F.split(F.lead("line").over(w), " "), lambda x: x != ""))
    return rows.withColumn("after", after).where(F.col("line").rlike(r"^\p{Lu}[\p{L}]{1,14}[.:]?$") & (F.col("after") >= 3)).select("doc_id", "line_no", "line")


def speakers(boxes: DataFrame) -> DataFrame:
    """frame_id, name and pos of who speaks in a frame: the first box from the top whose text looks like a name just above what is said.

    A name has one to three capitalised words of 20 characters in all, no digit or
    code mark, and no mark at its end; the next box below it has three words and 12
    characters or more, is longer and starts within twice the name's height.
    """
    w = Window.partitionBy("frame_id").orderBy("y0", "x0", "pos")
    said = F.trim("text")
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    rows = boxes.withColumns({"_next": F.trim(F.lead("text").over(w)), "_top": F.lead("y0").over(w)})
    name = said.rlike(r"^\p{Lu}[^\s\d{}\[\]<>=_/\\|]*( \p{Lu}[^\s\d{}\[\]<>=_/\\|]*){0,2}$") & (F.length(said) <= 20) & ~said.rlike(r"[.,!?:;…]$")
    below = (words(F.col("_next")) >= 3) & (F.length("_next") >= 12) & (F.length("_next") > F.length(said)) & (F.col("_top") > F.col("y0")) & (F.col("_top") - F.col("y1") <= 2 * (F.col("y1") - F.col("y0")))
    found = rows.where(name & below)
    return found.groupBy("frame_id").agg(F.min_by(F.struct("text", "pos"), F.struct("y0", "x0", "pos")).alias("_x")).select("frame_id", F.trim("_x.text").alias("name"), "_x.pos")


def without_speakers(boxes: DataFrame, found: DataFrame) -> DataFrame:
    """boxes but those of the names."""
    return boxes.join(found.select("frame_id", "pos"), ["frame_id", "pos"], "left_anti")


def without_tiles(boxes: DataFrame, near: float = 20.0) -> DataFrame:
    """Boxes but those with the text of one less than `near` above it in the frame."""
    w = Window.partitionBy("frame_id", "text").orderBy("y0", "x0", "pos")
    return boxes.withColumn("_gap", F.col("y0") - F.lag("y0").over(w)).where("_gap IS NULL OR _gap >= " + str(near)).drop("_gap")


def bands(rows: DataFrame, key: str, order: str, on: Column, few_keys: bool = False) -> DataFrame:
    """Runs of consecutive rows that are on: key, first, last, n. Where keys are few and large, `few_keys` scans by ranges instead of a window a key."""
    if few_keys:
        return islands(rows, key, [order], on)
    w = Window.partitionBy(key).orderBy(order)
    picked = rows.withColumn("_n", F.row_number().over(w)).where(on)
    return picked.withColumn("_run", F.col("_n") - F.row_number().over(w)).groupBy(key, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def band_groups(runs: DataFrame, key: str, least: float = 5.0, factor: float = 1.7) -> DataFrame:
    """Runs of bands() joined where their gap is at most max(least, round(factor * the key's median gap)): key, first, last, n (rows), runs."""
    w = Window.partitionBy(key).orderBy("first")
    gaps = runs.withColumn("_gap", F.col("first") - F.lag("last").over(w) - 1)
    limit = gaps.groupBy(key).agg(F.greatest(F.lit(least), F.bround(factor * F.percentile("_gap", 0.5))).alias("_limit"))
    joined = gaps.join(limit, key).withColumn("_new", F.coalesce((F.col("_gap") > F.col("_limit")).cast("int"), F.lit(1)))
    numbered = joined.withColumn("_group", F.sum("_new").over(w))
    return numbered.groupBy(key, "_group").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.count("*").alias("runs")).drop("_group")


def lowest_group(groups: DataFrame, key: str, below: Column) -> DataFrame:
    """Of each key the last of the groups that start where `below` holds: key, first, last, n."""
    return groups.where(below).groupBy(key).agg(F.max_by(F.struct("first", "last", "n"), "first").alias("_x")).select(key, "_x.*")


def service_state(latency: Column) -> Column:
    """fast up to 1.5 s, slow up to 4 s, else offline."""
    return F.when(latency <= 1.5, "fast").when(latency <= 4, "slow").otherwise("offline")


def service_states(probes: DataFrame) -> DataFrame:
    """Transitions of each service by ts and id, with the state before. Services are few, so their rows are scanned by ranges."""
    return changes(probes.withColumn("state", service_state(F.col("latency"))), "service", ["ts", "id"], F.col("state"))


def retain(items: DataFrame, key: str, order: str, size: str | None = None, most: int = 60, budget: int | None = None) -> DataFrame:
    """The newest `most` rows of each key, with nth, and while their sizes fit the budget, with held.

    The number is cut first, which Spark does within partitions, so that sizes are
    summed over `most` rows of a key only.
    """
    w = Window.partitionBy(key).orderBy(F.desc(order))
    newest = items.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    return newest if budget is None else newest.withColumn("held", F.sum(size).over(Window.partitionBy(key).orderBy("nth"))).where(F.col("held") <= budget)


def newest(rows: DataFrame, *order: str, most: int) -> DataFrame:
    """The newest `most` rows of a whole table."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(most)


def pick_targets(rows: DataFrame, tick: str, ident: str, focused: Column, hinted: Column, denied: Column, volume: str = "volume", least: float = 0.001) -> DataFrame:
    """Of each tick the audible row that is not denied: a focused one first, then a hinted one, then the loudest; kind is 2, 1 or 0."""
    kind = F.when(focused, 2).when(hinted, 1).otherwise(0)
    heard = rows.where(~denied & (F.col(volume) > least)).withColumn("kind", kind)
    return heard.groupBy(tick).agg(F.max_by(ident, F.struct("kind", volume, -F.col(ident))).alias(ident), F.max("kind").alias("kind"))


def backlog(rows: DataFrame, drain: float = 1.0, most: float = 30.0) -> DataFrame:
    """queued: seconds that came in so far less what `drain` seconds a second took out; over counts the rows beyond `most`."""
    w = per_stream("t0", "seq")
    came = F.sum((F.col("t1") - F.col("t0")) / 1000).over(w)
    passed = (F.col("t0") - F.min("t0").over(Window.partitionBy("stream_id"))) / 1000 * drain
    return rows.withColumn("queued", F.greatest(came - passed, F.lit(0.0))).withColumn("over", F.col("queued") > most)


def append_new(rows: DataFrame, memory: int = 10) -> DataFrame:
    """Rows whose text none of the last `memory` of the stream contains."""
    held = F.collect_list("text").over(per_stream("seq").rowsBetween(-memory, -1))
    return rows.withColumn("_held", held).where(~F.exists("_held", lambda x: F.contains(x, F.col("text")))).drop("_held")
