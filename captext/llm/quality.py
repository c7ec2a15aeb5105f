"""Quality scores: random Fourier features, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captext.llm.textstats import ratios, text_counts
from captext.session import cut

#: Random features, the kernel's width in standard deviations, the ridge, and bins of scores for the calibration.
FEATURES = 192
WIDTH = 2.5
RIDGE = 0.3
BINS = 400
FOLDS = 5
#: Labelled rows whose normal equations one task sums.
TASK_ROWS = 50_000


def fold() -> Column:
    """crc32 of doc_id as text, modulo FOLDS; rows of fold 0 are held out."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


class Fourier:
    """cos(w x + b) features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack((np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))))


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: means of x and rising means of y in blocks of weight n, with one more row at prior in each."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, n, strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    m = np.array(blocks)
    return m[:, 0] / m[:, 2], np.maximum.accumulate((m[:, 1] + prior) / (m[:, 2] + 1))


def normal_equations(rows: DataFrame, names: list[str], features: Fourier) -> dict[int, np.ndarray]:
    """For each fold the sum of z' [z y] over its rows: tasks sum their rows, then each matrix row is summed by key."""
    size = FEATURES + 1
    parts = max(1, -(-rows.count() // TASK_ROWS))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for k, own in frame.groupby("fold"):
                z = features(own[names].to_numpy(float))
                add = z.T @ np.hstack((z, own["quality"].to_numpy(float)[:, None]))
                sums[k] = sums[k] + add if k in sums else add
        for k, m in sums.items():
            yield pd.DataFrame({"fold": k, "line": range(size), "sums": list(m)})

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(frame["sums"].to_numpy())
        return pd.DataFrame({"fold": frame["fold"].iloc[:1], "line": frame["line"].iloc[:1], "sums": [m[np.lexsort(m.T[::-1])].sum(0)]})

    kind = "fold int, line int, sums array<double>"
    summed = rows.repartition(parts, F.xxhash64("doc_id")).mapInPandas(partial, kind).groupBy("fold", "line").applyInPandas(total, kind).toPandas()
    return {int(k): np.stack(own.sort_values("line")["sums"].to_numpy()) for k, own in summed.groupby("fold")}


def solve(sums: np.ndarray) -> np.ndarray:
    size = FEATURES + 1
    ridge = RIDGE * np.eye(size)
    ridge[-1, -1] = 1e-6
    return np.linalg.solve(sums[:, :size] + ridge, sums[:, size])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher: quality 1 likelier), predicted.

    docs needs doc_id and text (null: empty), labels doc_id and quality. Only
    labels of folds 1 to 4 are learned from; a score depends on the text alone.
    Ridge scores of each fold by the other folds' sums give the calibration.
    Without labels all scores are 0.5, with one kind of label they are near it.
    The driver holds one matrix a fold and BINS sums; rows stay in Spark.
    """
    stats = ratios()
    names = list(stats)
    rows = cut(text_counts(docs)).withColumns(stats).withColumn("fold", fold()).select("doc_id", "fold", *names)
    known = labels.where("quality IN (0, 1)").select(F.col("doc_id").alias("_id"), "quality")
    learn = cut(rows.where("fold > 0").join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "fold", *names, "quality"))
    facts = learn.agg(F.count("*"), *(F.avg(c) for c in names), *(F.stddev_pop(c) for c in names)).first()
    out = "doc_id long, held_out boolean, score double, predicted int"
    if not facts[0]:
        return rows.select("doc_id", (F.col("fold") == 0).alias("held_out"), F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))
    moments = np.array(facts[1:], float)
    features = Fourier(moments[: len(names)], np.maximum(moments[len(names) :], 1e-6))
    sums = normal_equations(learn, names, features)
    whole = sum(sums.values())
    final = solve(whole)
    others = {k: solve(whole - m) if len(sums) > 1 else final for k, m in sums.items()}

    def unseen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            z = features(frame[names].to_numpy(float))
            raw = np.einsum("ij,ij->i", z, np.stack([others[k] for k in frame["fold"]]))
            yield pd.DataFrame({"bin": np.clip(np.floor(raw * BINS / 2 + BINS / 4), 0, BINS - 1).astype(np.int32), "raw": raw, "quality": frame["quality"].to_numpy(float)})

    bins = learn.mapInPandas(unseen, "bin int, raw double, quality double").groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("quality").alias("quality"), F.count("*").alias("n")).orderBy("bin").toPandas()
    n = bins["n"].to_numpy(float)
    prior = float((bins["quality"] * n).sum() / n.sum())
    at, level = isotonic(bins["raw"].to_numpy(), bins["quality"].to_numpy(), n, prior)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            s = np.clip(np.interp(features(frame[names].to_numpy(float)) @ final, at, level), 0, 1)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["fold"] == 0, "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return rows.mapInPandas(score, out)
