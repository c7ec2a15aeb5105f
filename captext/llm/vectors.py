"""Embedding near-duplicates: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captext.operators.components import connected_components
from captext.session import cut

#: Vectors planned for a cell, and cells at most: their centres (32 MB of 64 numbers each) go to every task.
CELL = 2_000
MOST_CELLS = 1 << 16
#: Vectors for each centre that it is fitted on, and centres fitted at once; more are fitted in two levels.
FIT = 40
FITTED = 512
#: Rows on a side of one product.
BLOCK = 2_048
#: A vector also visits cells whose centre is at most so much further than its own, in degrees.
MARGIN = 8.0


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Unit centres of the unit rows of x; an empty centre starts again at a random row."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1)
        lost = norms < 1e-9
        sums[lost], norms[lost] = x[rng.integers(0, len(x), int(lost.sum()))], 1.0
        centres = sums / norms[:, None]
    return centres


def _unit(column: pa.Array, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    return x / np.linalg.norm(x, axis=1)[:, None]


def near_vectors(rows: DataFrame, least: float = 0.98, margin: float = MARGIN) -> DataFrame:
    """Per row of rows (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label (not null) link where their cosine in double precision
    is at least `least`; null or zero vectors, and ones with a null or non-finite
    component, link with nothing. Vectors of different lengths don't link. Equal
    vectors are one point with a count. n_links counts other vectors linked
    directly, component_id is the smallest vec_id reachable and kept marks it.

    Cells grow with the points, one for CELL of them. Their centres are fitted on
    FIT points each, taken by hash; beyond FITTED cells in two levels, the second
    in a task for each centre of the first. Every point goes to the cell of its
    nearest centre and visits cells up to `margin` degrees further (180: all
    cells, an exact search). A pair is counted once: in the cell of the smaller
    id where the other visits it, else in the other's. Large cells are cut into
    blocks of BLOCK rows that meet block by block. Links stay in their task, which
    emits a count and a parent for each row.
    """
    finite = F.expr("size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    fit = F.coalesce(finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = rows.withColumn("embedding", F.when(fit, F.col("embedding").cast("array<double>"))).withColumn("label", F.when(fit, F.col("label")))
    points = cut(rows.where("embedding IS NOT NULL").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    parts = []
    for (width,) in points.select(F.size("embedding")).distinct().orderBy(F.size("embedding")).collect():
        parts.append(_linked_points(points.where(F.size("embedding") == width), width, least, margin))
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    met = parts[0]
    for part in parts[1:]:
        met = met.union(part)
    met = cut(met)
    found = connected_components(met.select("id", "parent"), "id", "parent")
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    groups = points.join(links, "id", "left").join(found, F.col("id") == F.col("node"), "left")
    groups = groups.select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(groups, (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def fitted_centres(points: DataFrame, width: int) -> np.ndarray:
    """Unit centres of the cells of points (id, embedding of `width` numbers), a row each; not more than points."""
    n = points.count()
    cells = int(min(MOST_CELLS, max(1, -(-n // CELL))))
    top = cells if cells <= FITTED else int(np.ceil(np.sqrt(cells)))

    def some(share: float) -> DataFrame:
        return points.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))).select("embedding")

    # A threshold on the hash gives about as many as are wanted, from every partition alike.
    x = _unit(some(max(FIT * top, 1000) / max(1, n)).toArrow().column("embedding").combine_chunks(), width)
    centres = spherical_kmeans(x, top) if len(x) else np.eye(1, width)
    if top == cells:
        return centres
    each = -(-cells // top)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_nearest(_unit(batch.column("embedding"), width), centres)), batch.column("embedding")], ["top", "embedding"])

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["embedding"].to_numpy())
        x = x[np.lexsort(x.T)]
        own = spherical_kmeans(x / np.linalg.norm(x, axis=1)[:, None], each)
        return pd.DataFrame({"centre": list(own)})

    found = some(FIT * cells / n).mapInArrow(assign, "top int, embedding array<double>").groupBy("top").applyInPandas(split, "centre array<double>").toArrow()
    x = _unit(found.column("centre").combine_chunks(), width)
    return x[np.lexsort(x.T)]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    rows = max(16, (1 << 23) // len(centres))
    return np.concatenate([np.argmax(x[k : k + rows] @ centres.T, 1) for k in range(0, len(x), rows)]).astype(np.int32)


def _linked_points(points: DataFrame, width: int, least: float, margin: float) -> DataFrame:
    """id, links and parent of the points (one vector length) that have links, a row for each block they meet in."""
    centres = fitted_centres(points, width)
    cells = len(centres)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = int(max(16, min(4096, (1 << 23) // cells)))
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                x = _unit(part.column("embedding"), width)
                close = np.clip(x @ centres.T, -1, 1)
                home = close.argmax(1)
                reach = np.degrees(np.arccos(close[np.arange(len(x)), home])) + margin
                goes = close >= np.where(reach >= 180, -2.0, np.cos(np.radians(np.minimum(reach, 180))))[:, None]
                goes[np.arange(len(x)), home] = True
                row, at = np.nonzero(goes)
                starts = np.searchsorted(row, np.arange(len(x) + 1))
                take = pa.array(row)
                vectors = pa.array([v.tobytes() for v in x], pa.binary())
                visits = pa.array([at[a:b].astype("<i4").tobytes() for a, b in zip(starts, starts[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("label").take(take), pa.array(at.astype(np.int32)), pa.array(home[row].astype(np.int32)), part.column("id").take(take), part.column("n").take(take), vectors.take(take), visits.take(take)], ["label", "cell", "home", "id", "n", "vector", "visits"])

    placed = cut(points.select("label", "id", "n", "embedding").mapInArrow(visit, "label string, cell int, home int, id long, n long, vector binary, visits binary"))
    blocks = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    numbered = placed.join(blocks, ["label", "cell"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Block i meets block j >= i: each row goes to the tasks of all pairs that its block is in.
    meet = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        ids, home, n, own = (frame[c].to_numpy() for c in ("id", "home", "n", "own"))
        x = np.frombuffer(b"".join(frame["vector"]), float).reshape(-1, width)
        visits = [np.frombuffer(v, "<i4") for v in frame["visits"]]
        visited = np.concatenate([i * cells + v.astype(np.int64) for i, v in enumerate(visits)])
        cell = frame["cell"].iat[0]
        a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
        if frame["i"].iat[0] != frame["j"].iat[0]:
            cross = own[a] != own[b]
            a, b = a[cross], b[cross]
        # a has the smaller id: its cell counts the pair, else the other's cell where b doesn't visit a's.
        asked = b * cells + home[a]
        there = visited[np.minimum(np.searchsorted(visited, asked), len(visited) - 1)] == asked
        good = (home[a] == cell) | ((home[b] == cell) & ~there)
        a, b = a[good], b[good]
        links = np.bincount(a, n[b], len(ids)) + np.bincount(b, n[a], len(ids))
        labels, before = ids.copy(), None
        while before is None or (labels != before).any():
            before = labels.copy()
            np.minimum.at(labels, a, before[b])
            np.minimum.at(labels, b, before[a])
        some = links > 0
        return pd.DataFrame({"id": ids[some], "links": links[some].astype(np.int64), "parent": labels[some]})

    return meet.groupBy("label", "cell", "i", "j").applyInPandas(compare, "id long, links long, parent long")
