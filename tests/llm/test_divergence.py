"""op13 against a plain version and its SQL; nulls, ties, slices and tiles."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from captext.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(docs, least_docs=10, top=10):
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        words = [w.translate(LOWER) for w in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = []
    for lang in {k[0] for k in counts}:
        kept = sorted(t for t, n in df[lang].items() if n >= least_docs)
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        price = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * len(kept))
        total = {s: sum(c[t] for t in kept) for s, c in groups.items()}
        p = {s: [price(c[t], total[s]) for t in kept] for s, c in groups.items()}
        all_n = sum(total.values())
        q = [price(sum(c[t] for c in groups.values()), all_n) for t in kept]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pairs = [(sum(map(f, p[s], p[o])), o) for o in groups if o != s]
            terms = [(f(a, b), t) for t, a, b in zip(kept, p[s], q, strict=True) if c[t] > 0 and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def held(spark, docs, **options):
    frame = spark.createDataFrame([(*d, i, "x", 1) for i, d in enumerate(docs)], "lang string, source string, text string, doc_id long, term string, n int")
    return sorted(map(tuple, D.source_divergence(frame, **options).collect()))


def corpus(sources=5, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["Ärger", "été", "中文", "ЖУК"]
    docs = [(lang, f"s{s}", " ".join(words[min(int(x), 83)] for x in rng.gamma(1 + s / 3, 12, rng.integers(5, 60)))) for lang in ("en", "de", None) for s in range(sources) for _ in range(12)]
    return docs + [("en", None, None), ("en", "", "WAA waa-waa 3waa"), ("fr", "only", "lonely words"), ("es", "a", None), ("es", "b", "x"), ("en", "s1", "Long " * 50000), ("en", "empty", " 123 ")]


@pytest.mark.parametrize("cut", [(4096, 8), (7, 2)])
def test_against_plain(spark, monkeypatch, cut):
    monkeypatch.setattr(D, "SLICE", cut[0])
    monkeypatch.setattr(D, "TILE", cut[1])
    docs = corpus()
    assert held(spark, docs) == plain(docs)
    assert held(spark, docs + docs, least_docs=3, top=2) == plain(docs + docs, 3, 2)


def test_tasks_hand_on_what_they_hold(spark):
    docs = spark.createDataFrame([("en", "a", "x y z x"), ("en", "a", "x q")] * 3, "lang string, source string, text string")
    want = Counter({"x": 9, "y": 3, "z": 3, "q": 3}), Counter({"x": 6, "y": 3, "z": 3, "q": 3})
    found = D.counted_terms(docs).collect()
    assert (sum((Counter({r.term: r.n}) for r in found), Counter()), sum((Counter({r.term: r.df}) for r in found), Counter())) == want


def test_nothing_kept_and_empty(spark):
    docs = [("en", "a", "x y"), ("en", "b", "z"), ("de", None, None)]
    assert held(spark, docs) == plain(docs) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert held(spark, []) == []


def test_prices():
    total = 9 * 10**15
    counts = np.array([0, 1, 5 * 10**14, total - 2])
    assert D.price(counts, total).tolist() == [1 + 10**9 * (c + 2) // total for c in counts.tolist()]
    rng = np.random.default_rng(2)
    for _ in range(30):
        one, two = (np.sort(rng.choice(50, rng.integers(0, 30), False)) for _ in range(2))
        p, q = rng.integers(1, 10**9, len(one)), rng.integers(1, 10**9, len(two))
        full = lambda ids, x, other: [dict(zip(ids.tolist(), x.tolist(), strict=True)).get(t, other) for t in range(50)]
        want = sum((x - y) ** 2 // (x + y) for x, y in zip(full(one, p, 77), full(two, q, 99), strict=True))
        assert D.merged_price((one, p, 77), (two, q, 99), 50) == want


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    found = D.source_divergence(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(D.SQL).fetchall())
