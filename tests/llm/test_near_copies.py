"""Groups of near copies against a plain version that compares all pairs."""

from __future__ import annotations

import random

from captext.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_groups(texts, least=0.8):
    """doc_id -> smallest doc_id that links of `least` or more reach."""
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    for a in sorted(texts):
        for b in texts:
            if a < b and root[a] != root[b] and similar(sets[a], sets[b]) >= least:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(n)]


def groups(spark, texts):
    return {r.doc_id: r.component_id for r in simhash.near_copy_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}


def crowd(rng, copies=1):
    """200 documents with some 70 % of a template each, and after them the template with near copies of it."""
    parts = [words(rng, 25) for _ in range(20)]
    made = {}
    for d in range(200):
        kept = set(rng.sample(range(20), 14))
        made[d] = " ".join(w for k, part in enumerate(parts) for w in (part if k in kept else words(rng, 25)))
    whole = [w for part in parts for w in part]
    made[200] = " ".join(whole)
    for d in range(copies):
        at = rng.randrange(20, 480)
        made[201 + d] = " ".join([*whole[:at], *words(rng, 3), *whole[at + 3 :]])
    return made


def test_copies_within_a_crowd(spark):
    texts = crowd(random.Random(7), 5)
    got = groups(spark, texts)
    assert got == plain_groups(texts) and {got[d] for d in range(200, 206)} == {200}


def test_blocks_of_a_common_key(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    texts = crowd(random.Random(8), 5)
    assert groups(spark, texts) == plain_groups(texts)


def test_links_near_the_threshold(spark):
    """Pairs of 1,996 shingles from 0.77 to 0.83 link from 0.8 on and not below, and so do those of a few words."""
    rng, texts = random.Random(9), {}
    for k in range(37, 52):
        own = words(rng, 2000)
        other = list(own)
        for at in rng.sample(range(2, 199), k):
            other[at * 10] = words(rng, 1)[0]
        texts |= {2 * k: " ".join(own), 2 * k + 1: " ".join(other)}
    for n in range(5, 25):
        own = words(rng, n)
        texts |= {1000 + 3 * n: " ".join(own), 1001 + 3 * n: " ".join([*own, "more"]), 1002 + 3 * n: " ".join([*own[1:], "end"])}
    alike = [similar(shingles(texts[2 * k]), shingles(texts[2 * k + 1])) for k in range(37, 52)]
    assert 0.76 < min(alike) < 0.8 < max(alike) < 0.84
    assert groups(spark, texts) == plain_groups(texts)


def test_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert groups(spark, texts) == plain_groups(texts)


def test_sketches_keep_pairs_at_the_threshold():
    """2,000 pairs of sets at 0.80 to 0.82: no sketch discards one, and each has a key in common."""
    import numpy as np

    rng = np.random.default_rng(4)
    for size in (20, 60, 200, 2000):
        for _ in range(500):
            share = rng.uniform(0.8, 0.82)
            both = int(np.ceil(2 * size * share / (1 + share)))
            h = rng.integers(0, 2**64, 2 * size - both, dtype=np.uint64)
            (x, kx), (y, ky) = simhash.sketch(h[:size]), simhash.sketch(np.concatenate((h[:both], h[size:])))
            x, y = (np.frombuffer(v, "<u2").reshape(1, -1) for v in (x, y))
            assert simhash._likely(x, y, 0.8)[0] and simhash._may_be(simhash.shortened(x), simhash.shortened(y), 0.8, size, np.array([size]))[0] and (kx == ky).any()


def test_short_sketches_count_what_whole_ones_count():
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**16, (50, simhash.SLOTS)).astype("<u2") | 1
    x[rng.random(x.shape) < 0.3] = 0
    short = simhash.shortened(x)
    assert (simhash._ones(short) == (x > 0).sum(1)).all()
    assert (simhash._ones(short[0] ^ short) == ((np.where(x > 0, x % 15 + 1, 0)) != np.where(x[0] > 0, x[0] % 15 + 1, 0)).sum(1)).all()


def test_exploded_rows_are_not_broadcast(spark):
    # Spark sizes an exploded table as if each array had one element, so that it took 32 or 33 times 10 MB for small.
    firsts = spark.range(20).selectExpr("id", "array(id, 7L, 8L) AS keys")
    points = spark.range(20).selectExpr("id", "shiftleft(1L, cast(id AS int)) AS fp")
    for made, n in ((simhash.under_shared_keys(firsts), 42), (simhash.close_pairs(points), 190)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.count() == n
