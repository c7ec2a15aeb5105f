"""op12 against a plain version and its SQL; nulls, ties, repeats, lengths, large components."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from captext.llm.vector_codes import FURTHEST, LARGEST, SQL, assign, dictionary, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, _l int"


def plain(rows, parts, entries, rounds):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    each = -(-width // parts)
    whole = lambda x: max(-FURTHEST, min(FURTHEST, math.floor(Fraction(x) * 256)))
    cut = [[tuple([whole(x) for x in v + [0.0] * (parts * each - len(v))][p * each : (p + 1) * each]) for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, v: min((far(v, e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        own = [[near(p, c[p])[1] for p in range(parts)] for c in cut]
        new = []
        for p in range(parts):
            groups = [[c[p] for c, o in zip(cut, own, strict=True) if o[p] == e] for e in range(len(books[p]))]
            new.append([tuple(sum(x) // len(g) for x in zip(*g, strict=True)) if g else old for g, old in zip(groups, books[p], strict=True)])
        books = new
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = lambda label: sum(min(e, LARGEST) for e, k in zip(errors, kept, strict=True) if k[2] == label)
    return sorted(((k[0], "".join(f"{i:02x}" for _, i in f), min(e, LARGEST), min(total(k[2]), LARGEST), digest) for k, f, e in zip(kept, found, errors, strict=True)), key=str)


def held(spark, rows, parts, entries, rounds=2):
    frame = spark.createDataFrame([(*r, None, 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, vector_codes(frame, parts, entries, rounds).collect()), key=str)


def some(n, width, scale=1.0, seed=0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.normal(0, scale, width)], None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(n)]


ODD = [(900, None, 1), (901, [1.0, None] * 4, 1), (902, [float("nan")] * 8, 2), (903, [float("inf")] * 8, None), (904, [0.0] * 8, None), (904, [0.0] * 8, None), (None, [-0.001] * 8, 7), (None, [0.5] * 8, 7)]


@pytest.mark.parametrize("parts,entries,rounds", [(4, 8, 2), (8, 64, 2), (2, 3, 0), (1, 5, 3)])
def test_against_plain(spark, parts, entries, rounds):
    rows = some(60, 8) + ODD
    assert held(spark, rows, parts, entries, rounds) == plain(rows, parts, entries, rounds)


def test_ties_and_repeats(spark):
    rows = [(i, [float(x)] * 4, 1) for i, x in enumerate([0, 0, 1, 1, 0.5, 0.5, 0.5, 0, 1])]
    found = held(spark, rows, 2, 4)
    assert found == plain(rows, 2, 4, 2)


@pytest.mark.parametrize("scale", [1e5, 1e12, 1e300])
def test_large_components(spark, scale):
    rows = some(20, 4, scale) + [(100, [0.25, -0.25, 1e-300, -1e-300], 1)]
    assert held(spark, rows, 2, 4) == plain(rows, 2, 4, 2)


def test_lengths_and_empty(spark):
    rows = [(1, [0.1, 0.2, 0.3], 1), (2, [], 1), (3, [0.5], None), (4, [0.1, 0.2, 0.3, 0.4, 0.5], 2)]
    assert held(spark, rows, 2, 2) == plain(rows, 2, 2, 2)
    assert held(spark, [(1, [], 1), (2, [], 2)], 2, 2) == plain([(1, [], 1), (2, [], 2)], 2, 2, 2)
    assert held(spark, [], 16, 64) == []
    assert held(spark, ODD[:4], 16, 64) == []


def test_dictionaries_are_exact():
    rng = np.random.default_rng(1)
    for column in (rng.integers(-5, 5, 100), rng.integers(-(10**12), 10**12, 100), np.array([2**70, -(2**70), 3], object), np.zeros(0, np.int64)):
        values, codes = dictionary(column)
        assert (values[codes] == column).all() and sorted(set(column.tolist())) == values.tolist()
    x, books = rng.integers(-300, 300, (200, 6)), rng.integers(-300, 300, (3, 7, 2))
    near, error = assign(x, books)
    far = ((x.reshape(200, 3, 1, 2) - books[None]) ** 2).sum(-1)
    assert (near == far.argmin(2)).all() and (error == far.min(2).sum(1)).all()


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    found = vector_codes(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({SQL})").fetchall())
