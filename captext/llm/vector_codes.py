"""Vector code compression: product codes whose distances are gathers from per-dimension value dictionaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captext.session import scratch

#: Units of a component.
SCALE = 256
#: Numbers of one block of vectors in a task, and the largest distance, sum or product that a 64-bit integer may hold.
BLOCK = 1 << 20
MOST = 2**62
#: Components further from zero count as so far: sums of 2 ** 60 of them fit 38 digits.
FURTHEST = 2**62
LARGEST = 2**63 - 1

HEX = np.array([f"{i:02x}" for i in range(256)], "S2")


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite doubles, in 64 bits where their distances have room there, else as Python integers of at most FURTHEST."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if not values.size or np.abs(scaled).max() * 2 < (MOST / max(1, values.shape[-1])) ** 0.5:
        return scaled.astype(np.int64)
    return np.array([floor(max(-FURTHEST, min(FURTHEST, x))) for x in scaled.ravel().tolist()], object).reshape(values.shape)


def dictionary(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct integers of a dimension, ascending, and each row's index among them."""
    if column.dtype == object or not len(column) or (span := int(column.max()) - (low := int(column.min()))) > 8 * len(column) + 1024:
        return np.unique(column, return_inverse=True)
    seen = np.zeros(span + 1, bool)
    seen[column - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[column - low]


def part_distances(codes: list[np.ndarray], tables: list[np.ndarray], part: int, each: int) -> np.ndarray:
    """Squared distances of all rows' `part` to its entries: a gather for each of its dimensions, added up."""
    total = tables[part * each][codes[part * each]]
    for j in range(part * each + 1, (part + 1) * each):
        total += tables[j][codes[j]]
    return total


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the first of several) of each part of each row of x, and the sum of the distances.

    books: (parts, entries, numbers of a part). Each dimension's dictionary is
    tabulated against that dimension of all entries once; rows only look up.
    """
    parts, entries, each = books.shape
    near, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), x.dtype)
    for p in range(parts):
        codes, tables = {}, {}
        for j in range(p * each, (p + 1) * each):
            values, codes[j] = dictionary(x[:, j])
            tables[j] = (values[:, None] - books[p, :, j - p * each][None, :]) ** 2
            if tables[j].dtype != object and tables[j].size and int(tables[j].max()) * each < 2**31:
                tables[j] = tables[j].astype(np.int32)
        if len({t.dtype for t in tables.values()}) > 1:
            tables = {j: t.astype(np.int64) if t.dtype != object else t for j, t in tables.items()}
        if each:
            far = part_distances(codes, tables, p, each)
            near[:, p] = far.argmin(1)
            error += np.take_along_axis(far, near[:, p : p + 1], 1)[:, 0].astype(x.dtype)
    return near, error


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their vectors as integers, padded with zeros to `width`."""
    size = max(1, BLOCK // max(1, width))
    for start in range(0, batch.num_rows, size):
        some = batch.slice(start, size)
        vectors = some.column("vector")
        lengths = np.diff(vectors.offsets.to_numpy())
        values = np.zeros((some.num_rows, width))
        values[np.arange(width)[None, :] < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        yield some, whole_numbers(values)


def _same_kind(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as Python integers where one of them is, or where a difference could leave 64 bits."""
    kinds = object in (x.dtype, books.dtype) or (x.size and books.size and (int(np.abs(x).max()) + int(np.abs(books).max())) ** 2 * x.shape[1] >= MOST)
    return (x.astype(object), books.astype(object)) if kinds else (x, books)


def kept_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id (long), label, vector (doubles): rows whose vector isn't null and has no null or non-finite component."""
    fine = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    return rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(vector).cast("array<double>").alias("vector"))


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The codebooks to start from: the parts of the `entries` rows of least vec_id (then of least vector; null ids last)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).toArrow()
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    each = -(-width // parts)
    vectors = [x for batch in first.to_batches() for _, some in _blocks(batch, each * parts) for x in some]
    books = np.stack(vectors) if vectors else np.zeros((0, each * parts), np.int64)
    return books.reshape(len(vectors), parts, each).transpose(1, 0, 2)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after a round: each entry the floor of the mean of the parts nearest to it; unused ones stay.

    Tasks add up their own parts, so a row for each entry and task is shuffled, and
    one for each entry reaches the driver.
    """
    parts, entries, each = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, each), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, x in _blocks(batch, parts * each):
                x, own = _same_kind(x, books)
                near, _ = assign(x, own)
                for p in range(parts):
                    counts[p] += np.bincount(near[:, p], minlength=entries)
                    part = x[:, p * each : (p + 1) * each]
                    if x.dtype != object and int(np.abs(part).max(initial=0)) * len(x) < 2**53:
                        # Sums below 2 ** 53 are whole in doubles.
                        for j in range(each):
                            sums[p, :, j] += np.bincount(near[:, p], part[:, j], entries).astype(np.int64).astype(object)
                    else:
                        np.add.at(sums[p], near[:, p], part.astype(object))
        used = np.argwhere(counts)
        rows = [(int(p), int(e), int(counts[p, e]), [str(s) for s in sums[p, e]]) for p, e in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.string()))],
            ["part", "entry", "n", "sums"],
        )

    made = rows.select("vector").mapInArrow(run, "part int, entry int, n long, sums array<string>")
    made = made.select("part", "entry", "n", F.posexplode("sums").alias("at", "sum"))
    totals = made.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    new = books.astype(object)
    for r in totals.collect():
        new[r["part"], r["entry"], r["at"]] = int(r["sum"]) // r["n"]
    return new.astype(np.int64) if books.dtype != object else new


def books_text(books: np.ndarray) -> str:
    """All components in decimal digits by part, entry and position, joined by commas."""
    return ",".join(str(x) for x in books.ravel().tolist())


def vector_codes(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, vector: str = "embedding") -> DataFrame:
    """Per kept row of rows (vec_id, a list of numbers, label): vec_id, code, error, label_error, codebooks_sha256.

    Components become floor(256 * x) and vectors `parts` equal parts. Each part has a
    codebook, at first that part of the rows of least vec_id, which `rounds` rounds
    move to the floor of the mean of what is nearest (squared Euclidean distance,
    ties to the lower index). code is the index of the nearest entry in two
    hexadecimal digits for each part, error the sum of their distances, label_error
    the error of all rows with that label (nulls are one label).

    Rows whose vector is null or has a null or non-finite component are left out.
    Vectors of several lengths, or not of `parts` equal parts, are padded with zeros
    to the next length that all fit. Repeated rows each count; a null vec_id comes
    last. Components count as FURTHEST from zero at most, errors beyond a long as the
    largest long. An empty table gives an empty
    one. entries is at most 256. Other columns are not read.
    """
    spark = rows.sparkSession
    kept = kept_vectors(rows, vector)
    books = first_books(kept, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = refined(kept, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in _blocks(batch, books.shape[0] * books.shape[2]):
                near, error = assign(*_same_kind(x, books))
                digits = np.ascontiguousarray(HEX[near]).view(f"S{2 * books.shape[0]}")[:, 0]
                longs = pa.array(error if error.dtype != object else [min(e, LARGEST) for e in error.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array(digits.astype(str)), longs], ["vec_id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    path = scratch(spark, "codes")
    kept.mapInArrow(run, f"vec_id long, label {label}, code string, error long").write.parquet(path)
    coded = spark.read.parquet(path)
    path = scratch(spark, "errors")
    coded.groupBy("label").agg(_long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error")).write.parquet(path)
    sums = spark.read.parquet(path).withColumnRenamed("label", "_l")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_l")))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _long(total: Column) -> Column:
    return F.least(total, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")


_ROUND = """, p{n} AS (SELECT k, part, min(d * 1000 + entry) AS best FROM (SELECT x.k, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{n} c USING (part, pos) GROUP BY ALL) GROUP BY ALL)"""
_MEAN = """, c{m} AS (SELECT part, entry, pos, CASE WHEN n > 0 THEN CAST((s - ((s % n) + n) % n) // n AS BIGINT) ELSE v END AS v
  FROM (SELECT c.part, c.entry, c.pos, any_value(c.v) AS v, count(x.v) AS n, CAST(sum(x.v) AS HUGEINT) AS s FROM c{n} c LEFT JOIN p{n} p ON p.part = c.part AND p.best % 1000 = c.entry LEFT JOIN x ON x.k = p.k AND x.part = c.part AND x.pos = c.pos GROUP BY ALL))"""

#: DuckDB SQL with the same rows, for vectors of one length that `parts` divides.
SQL = (
    """WITH e AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS k, vec_id, label, embedding, len(embedding) // 16 AS each FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  x AS MATERIALIZED (SELECT k, CAST(floor(256.0 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v, (generate_subscripts(embedding, 1) - 1) // each AS part, (generate_subscripts(embedding, 1) - 1) % each AS pos FROM e),
  c0 AS (SELECT part, k AS entry, pos, v FROM x WHERE k < 64)"""
    + "".join(_ROUND.format(n=n) + _MEAN.format(n=n, m=n + 1) for n in (0, 1))
    + _ROUND.format(n=2)
    + """, r AS (SELECT k, string_agg(printf('%02x', best % 1000), '' ORDER BY part) AS code, CAST(sum(best // 1000) AS BIGINT) AS error FROM p2 GROUP BY k)
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(v, ',' ORDER BY part, entry, pos)) FROM c2) AS codebooks_sha256 FROM e JOIN r USING (k)"""
)
