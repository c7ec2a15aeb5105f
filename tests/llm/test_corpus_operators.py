"""The corpus operators against plain versions on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from captext.llm import language, mixing, packing, quality, rules, sharding, simhash, substrings, tokens, vectors

SF = "/root/testdata/sf0.001"
BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.orderBy("doc_id").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BYTES)


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_repair_round_trip():
    rng = np.random.default_rng(0)
    for _ in range(20):
        ids = rng.integers(0, 6, int(rng.integers(1, 3000))).astype(np.uint16)
        last = rng.random(len(ids)) < 0.02
        last[-1] = True
        symbols, ends, made = tokens.repair(ids, last, 10, 500, least=2)
        flat, stops = tokens.expansions(made, 10)
        lengths = np.diff(stops)[symbols]
        assert (np.concatenate([flat[stops[s] : stops[s + 1]] for s in symbols]) == ids).all()
        assert (np.flatnonzero(last) + 1 == np.cumsum(lengths)[ends]).all()


def test_tokens(spark, docs, texts, tokenizer, tmp_path):
    path = str(tmp_path / "ids")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.token_shards(docs, BYTES, 2, path).collect()}
    start = 0
    every = {}
    for doc, text in texts.items():
        every[doc] = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert got[doc] == (start, len(every[doc]), crc(every[doc]))
        start += len(every[doc])
    for row in tokens.read_tokens(spark, path).collect():
        row = row.asDict()
        for k in (0, len(row["doc_ids"]) // 2):
            ids = every[row["doc_ids"][k]]
            a, b = len(ids) // 3, len(ids) // 3 + 5
            assert tokens.decode_slice(row, k, a, b).tolist() == ids[a:b]


def test_uneven_white_space(tokenizer):
    import pyarrow as pa

    from captext.llm.encode import Encoder

    enc = Encoder(BYTES)
    some = ["", None, "a  b", " a", "a ", "a  b", "a b\n c", "it's, 'quoted'. x1y2 ... end!!", "<|endoftext|> x", "x <|endoftext|> y", "a<|endoftext|>b c", "the cat\nthe cat. the", "naïve—café ☃☃ 12,000.50|"]
    for text, ids in zip(some, enc(pa.array(some)), strict=True):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_packing(docs, texts, tokenizer):
    rows = packing.pack(docs, BYTES).collect()
    pieces, bins = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
        bins[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 0], 0
        for k in range(len(pieces[doc])):
            r = pieces[doc][k]
            assert (r.start, r.ids_crc32) == (at, crc(ids[at : at + r.length]))
            assert k == 0 or r.length == 2048
            at += r.length
        assert at == len(ids)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.03 * sum(r.length for r in rows) / 2048 + 1


def test_mixing(docs, texts):
    sizes = {d: len(simhash_words(t)) for d, t in texts.items()}
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = mixing.mix(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(3)).collect()}
    total, got = Counter(), Counter()
    for r in rows:
        assert r.size == sizes[r.doc_id] and r.taken <= 2 * r.size and again[r.doc_id] == r.taken
        total[source[r.doc_id]] += r.size
        got[source[r.doc_id]] += r.taken
    # The level at which weights fill up to twice each source's size, by halving.
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total))}
    low, high = 0.0, 2.0 * sum(total.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * n, level * weight[s]) for s, n in total.items()) < 1.5 * sum(total.values()) else (low, level)
    goal = {s: min(2 * n, level * weight[s]) for s, n in total.items()}
    most = max(sizes.values())
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == total[s] and abs(r.target - goal[s]) < 1e-6 and abs(got[s] - goal[s]) <= most / 2


def test_pivotal_keeps_probabilities():
    size, p = np.array([5.0, 9, 2, 7, 4, 4]), np.array([0.3, 0.5, 0.7, 0.2, 0.9, 0.4])
    runs = np.array([mixing.pivotal(size, p, np.random.default_rng(k))[0] for k in range(4000)])
    assert np.allclose((runs * size).sum(1), (p * size).sum()) and np.abs(runs.mean(0) - p).max() < 0.03


def simhash_words(text: str) -> list[bytes]:
    return text.encode().split()


def removed(rows: dict[int, str], least: int) -> dict:
    seen, out = set(), {}
    for doc, text in sorted(rows.items()):
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - least + 1):
            if b[i : i + least] in seen:
                gone[i : i + least] = True
            seen.add(b[i : i + least])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[doc] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def test_substrings(docs, texts):
    got = {r.doc_id: tuple(r)[1:] for r in substrings.repeats_removed(docs).collect()}
    assert got == removed(texts, 100)


def test_substrings_over_partitions(spark, monkeypatch):
    random.seed(3)
    base = ["".join(random.choice("ab é\n") for _ in range(300)) for _ in range(6)]
    rows = {i: "".join(random.choice(base)[random.randrange(200) :][: random.randrange(250)] for _ in range(random.randrange(5))) for i in range(80)}
    rows |= {200: "q" * 900, 201: base[0] * 3, 202: (base[1] + base[2]) * 300}
    monkeypatch.setattr(substrings, "PARTITION_BYTES", 40_000)
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    for least in (100, 40):
        assert {r.doc_id: tuple(r)[1:] for r in substrings.repeats_removed(table, least).collect()} == removed(rows, least)


def test_a_common_lead_over_many_buckets(spark, monkeypatch):
    """One passage of 30 to 150 bytes in every document, with bytes of few kinds around it, parted by many splitters."""
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefgh ", k=150))
    rows = {}
    for i in range(150):
        a = rng.randrange(60)
        own = lambda: "".join(rng.choices("xy", k=rng.choice((3, 7, 120))))
        rows[i] = own() + passage[a : a + rng.choice((30, 60, 90))] + own()
    monkeypatch.setattr(substrings, "PARTITION_BYTES", 1_000)
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in substrings.repeats_removed(table, 40).collect()} == removed(rows, 40)


def test_multikey_sort():
    rng = np.random.default_rng(5)
    for width in (8, 13, 40):
        rows = rng.integers(0, 2, (300, width)).astype(np.uint8)
        rows[100:200] = rows[:100]
        rows[200:] = rows[0]
        rows[250:, width // 2 :] = 1
        order, shared = substrings.multikey_sort(rows)
        made = [rows[i].tobytes() for i in order]
        assert made == sorted(r.tobytes() for r in rows) and shared[0] == 0
        for a, b, n in zip(made, made[1:], shared[1:], strict=False):
            assert a[:n] == b[:n] and (n == width or a[n] != b[n])


def test_without_repeats_keeps_characters(spark):
    passage = "".join(random.Random(0).choices("éàüßñ", k=150))
    table = spark.createDataFrame([(0, passage + " one", "x"), (1, "two " + passage, "y")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.text for r in substrings.without_repeats(table).collect()}
    assert got == {0: passage + " one", 1: "two "}


def plain_fingerprint(text: str) -> int:
    w = [x.decode() for x in text.encode().lower().split()]
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(xxh64_intdigest(p, 42) >> b & 1 for p in parts) > len(parts)) if parts else 0


def test_simhash(docs, texts):
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    rows = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    assert {d: f"{f:016x}" for d, f in fps.items()} == {d: r.fingerprint for d, r in rows.items()}
    least = {d: d for d in fps}
    for _ in range(20):
        least = {d: min(least[e] for e in fps if (fps[d] ^ fps[e]).bit_count() <= 2) for d in fps}
    assert least == {d: r.component_id for d, r in rows.items()}


def test_close_pairs_lose_none(spark):
    random.seed(1)
    points = {random.getrandbits(64) for _ in range(60)}
    for f in list(points):
        for _ in range(4):
            points.add(f ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) if random.random() < 0.7 else f ^ (1 << random.randrange(64)))
    points |= {0, 1, 3, (1 << 64) - 1, (1 << 64) - 2}
    order = sorted(points)
    table = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(order)], "id long, fp long")
    got = {tuple(sorted((r.a, r.b))) for r in simhash.close_pairs(table).collect()}
    assert got == {(i, j) for i in range(len(order)) for j in range(i + 1, len(order)) if (order[i] ^ order[j]).bit_count() <= 2}


def test_near_copies(docs, texts):
    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {d: shingles(t) for d, t in texts.items()}
    group = {r.doc_id: r.component_id for r in simhash.near_copy_groups(docs).collect()}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            alike = both / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0
            if alike >= 0.85:
                assert group[a] == group[b]


def test_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    more = rows.limit(40).selectExpr("vec_id + 100000 AS vec_id", "transform(embedding, (e, i) -> cast(e + 0.01 * sin(i + vec_id) AS float)) AS embedding", "label")
    both = rows.select("vec_id", "embedding", "label").union(more).union(rows.limit(5).selectExpr("vec_id + 200000", "embedding", "label"))
    table = both.toPandas()
    got = vectors.near_vectors(both).toPandas().set_index("vec_id")
    found = true = 0
    for _, own in table.groupby("label"):
        x = np.stack(own["embedding"]).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        links = (x @ x.T >= 0.98).sum(1) - 1
        true, found = true + links.sum(), found + got.loc[own["vec_id"], "n_links"].sum()
        assert (got.loc[own["vec_id"], "n_links"].to_numpy() <= links).all()
    assert true > 40 and found >= 0.9 * true
    exact = vectors.near_vectors(both, margin=180.0).toPandas()
    assert exact["n_links"].sum() == true and (exact["kept"] == (exact["vec_id"] == exact["component_id"])).all()


def test_centres_in_two_levels(spark, monkeypatch):
    """Many cells, fitted in two levels, still find the links of the exact search."""
    monkeypatch.setattr(vectors, "CELL", 8)
    monkeypatch.setattr(vectors, "FITTED", 8)
    rng = np.random.default_rng(8)
    heads = rng.normal(size=(60, 16))
    x = heads[rng.integers(0, 60, 800)] + rng.normal(0, 0.05, (800, 16))
    table = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int")
    unit = np.array([r.embedding for r in table.orderBy("vec_id").collect()], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = (unit @ unit.T >= 0.98).sum(1) - 1
    got = np.array([r.n_links for r in vectors.near_vectors(table).orderBy("vec_id").collect()])
    assert (got <= links).all() and got.sum() >= 0.9 * links.sum() > 900
    exact = np.array([r.n_links for r in vectors.near_vectors(table, margin=180.0).orderBy("vec_id").collect()])
    assert (exact == links).all()


def test_vector_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in np.array([1.0, 0, 0, 0]) + rng.normal(0, 0.01, 4)], 1) for i in range(100)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.n_links for r in got} == {99} and {r.component_id for r in got} == {0}


def test_sharding(spark):
    """Bytes are near equal, equal texts stay together, and so do the rows of a leaf's values."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    copied = docs.where("doc_id % 7 = 0").select((docs.doc_id + 10_000_000).alias("doc_id"), "text", docs.source.alias("lang"), docs.lang.alias("source"))
    both = docs.union(copied).persist()
    texts = {r.doc_id: (r.text or "").encode() for r in both.collect()}
    rows = sharding.kd_shards(both, 8).collect()
    size, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        b = texts[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 8, zlib.crc32(b), "bytes", None)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[b].add(r.shard)
    assert set(size) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(size.values()) / 8
    n = Counter(texts.values())
    assert all(len(g) == 1 for b, g in groups.items() if n[b] * (len(b) + 8) <= sharding.WHOLE * share)
    assert max(size.values()) - min(size.values()) <= 0.15 * share


def test_sharding_of_one_hot_text(spark):
    """A text with two thirds of all bytes is spread over the shards."""
    rows = [(i, "same words " * 20 if i % 3 else f"{i} own " * 30, "en", "s") for i in range(3000)]
    got = Counter()
    for r in sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8).collect():
        got[r.shard] += r.size
    assert len(got) == 8 and max(got.values()) <= 1.05 * min(got.values())


def test_first_cut_is_at_the_widest(spark):
    """Sizes vary as much as ever, languages only: two shards part by the size; where all sizes are one, by the language in order."""
    rows = [(i, "w " * (1 + i % 50), f"l{i % 4}", "s") for i in range(2000)]
    schema = "doc_id long, text string, lang string, source string"
    by_size = {r.doc_id: r.shard for r in sharding.kd_shards(spark.createDataFrame(rows, schema), 2).collect()}
    assert max(i % 50 for i, s in by_size.items() if s == 0) <= min(i % 50 for i, s in by_size.items() if s == 1)
    even = spark.createDataFrame([(i, f"{i:06d}", lang, "s") for i, _, lang, _ in rows], schema)
    assert {(i % 4, r) for i, r in ((r.doc_id, r.shard) for r in sharding.kd_shards(even, 2).collect())} == {(0, 0), (1, 0), (2, 1), (3, 1)}


def test_rules(docs, texts, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in rules.quality_rules(docs, labels).collect()}
    for doc, text in texts.items():
        w = text.encode().split()
        seen = defaultdict(list)
        for i in range(len(w) - 2):
            seen[tuple(w[i : i + 3])].append(i)
        repeat = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
        lines = [x for x in text.encode().split(b"\n") if x.split()]
        r = got[doc]
        assert (r.n_words, r.n_dup_lines, r.n_repeat_words) == (len(w), len(lines) - len(set(lines)), len(repeat))
        assert r.n_symbols == sum(text.count(c) for c in "#*$%&|<>") and r.word_chars == sum(len(x.decode()) for x in w)
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w)) and not (r.base_failed and r.kept)
    known = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(known[d], r.kept) for d, r in got.items() if d in known and not r.base_failed]
    assert all(kept for good, kept in judged if good == 1)


def test_rule_verdicts(spark):
    """The learned list, applied by hand to statistics counted by hand, gives the verdicts; it finds low quality on held-out rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    x = {}
    for r in docs.collect():
        t = (r.text or "").encode()
        w = t.split()
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        repeat = len({i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)})
        lines = [y for y in t.split(b"\n") if y.split()]
        n, per = len(w), lambda a, b: a / max(1, b)
        base = n < 50 or 100 * repeat > 50 * n
        x[r.doc_id] = base, {
            "log_words": np.log1p(n), "mean_chars": per(sum(len(y.decode()) for y in w), n), "symbol_share": per(sum(t.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), n), "dup_line_share": per(len(lines) - len(set(lines)), len(lines)),
            "repeat_share": per(repeat, n), "upper_share": per(len(re.findall(rb"[A-Z]", t)), len(t)), "digit_share": per(len(re.findall(rb"[0-9]", t)), len(t)), "mark_share": per(len(re.findall(rb"[.,;:?]", t)), n), "shout_share": per(t.count(b"!"), n), "bar_share": per(t.count(b"|"), n),
            "same_share": per(sum(a == b for a, b in zip(w, w[1:], strict=False)), n), "distinct_share": per(len(set(w)), n),
        }
    from pyspark.sql import functions as F

    order = [r.doc_id for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h")).orderBy("h", "doc_id").collect() if r.doc_id in known and known[r.doc_id] in (0, 1) and not x[r.doc_id][0]]
    learned = rules.learn_rules({k: np.array([x[d][1][k] for d in order]) for k in x[order[0]][1]}, np.array([known[d] == 0 for d in order]))
    assert learned
    hit = lambda v: any(all(v[c.stat] >= c.cut if c.above else v[c.stat] <= c.cut for c in rule) for rule in learned)
    got = {r.doc_id: r.kept for r in rules.quality_rules(docs, labels).collect()}
    assert got == {d: not base and not hit(v) for d, (base, v) in x.items()}
    low = [got[d] for d in order if known[d] == 0]
    good = [got[d] for d in order if known[d] == 1]
    assert np.mean(good) > 0.97 and np.mean(low) < 0.5


def test_rules_cover():
    rng = np.random.default_rng(2)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["a"] > 0.4))
    learned = rules.learn_rules(x, bad)
    hit = np.zeros(900, bool)
    for rule in learned:
        hit |= rules.covered(rule, x)
    assert (hit == bad).mean() > 0.95


def test_quality(docs, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.quality_scores(more, labels).collect() if r.held_out and r.doc_id in known]
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    good, low = ([r.score for r in rows if known[r.doc_id] == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in low]) > 0.95
    changed = labels.withColumn("quality", labels.quality * 0).where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").unionByName(labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    assert {(r.doc_id, round(r.score, 9)) for r in quality.quality_scores(more, changed).collect()} == {(r.doc_id, round(r.score, 9)) for r in quality.quality_scores(more, labels).collect()}


def test_quality_scores_by_hand(spark):
    """Scores by one matrix over all rows, and a plain pooling of violators, are the operator's."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from captext.llm.textstats import ratios, text_counts

    stats = text_counts(docs).withColumns(ratios()).toPandas().set_index("doc_id")[list(ratios())]
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    fold = {d: zlib.crc32(str(d).encode()) % 5 for d in stats.index}
    train = [d for d in stats.index if d in known and fold[d]]
    x, y, k = stats.loc[train].to_numpy(float), np.array([known[d] for d in train], float), np.array([fold[d] for d in train])
    features = quality.Fourier(x.mean(0), np.maximum(x.std(0), 1e-6))
    z = features(x)
    ridge = np.diag([quality.RIDGE] * (z.shape[1] - 1) + [1e-6])
    fit = lambda rows: np.linalg.solve(z[rows].T @ z[rows] + ridge, z[rows].T @ y[rows])
    raw = np.zeros(len(y))
    for f in set(k.tolist()):
        raw[k == f] = z[k == f] @ fit(k != f)
    bins = np.clip(np.floor(raw * quality.BINS / 2 + quality.BINS / 4), 0, quality.BINS - 1)
    blocks = [[raw[bins == b].sum(), y[bins == b].sum(), float((bins == b).sum())] for b in np.unique(bins)]
    i = 0
    while i < len(blocks) - 1:
        a, b = blocks[i], blocks[i + 1]
        if a[1] / a[2] >= b[1] / b[2]:
            blocks[i : i + 2] = [[p + q for p, q in zip(a, b, strict=True)]]
            i = max(0, i - 1)
        else:
            i += 1
    at, level = [a / n for a, _, n in blocks], np.maximum.accumulate([(b + y.mean()) / (n + 1) for _, b, n in blocks])
    want = np.clip(np.interp(features(stats.to_numpy(float)) @ fit(k > 0), at, level), 0, 1)
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert np.allclose([got[d] for d in stats.index], want, atol=1e-6)


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0.0, 1, 0, 1, 1]), np.ones(5), 0.5)
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()


def test_language_sums_all_segmentations():
    number = language.pieces(PIECES)
    prob = np.random.default_rng(0).random((len(number) + 1, 2)) * 1e-3
    prob[-1] = 1e-6

    def brute(word: str) -> np.ndarray:
        text = "▁" + word
        ways = [np.zeros(2) for _ in text] + [np.ones(2)]
        for a in range(len(text) - 1, -1, -1):
            for b in range(a + 1, min(len(text), a + language.LONGEST) + 1):
                k = number.get(text[a:b], -1 if b == a + 1 else None)
                if k is not None:
                    ways[a] = ways[a] + prob[k] * ways[b]
        return np.log(ways[0])

    words = ["the", "nation", "a", "ß", "x" * 40, "theandtherefore" * 4, "a" * 31, "b" * 32, "中", "unknownß" * 9]
    forward = language.Forward(prob, number)
    assert np.allclose(forward.scores(words), [brute(w) for w in words])
    uses = forward.uses(words, np.ones((len(words), 2)))
    for piece in ("the", "a", "on"):
        moved = prob.copy()
        moved[number[piece]] *= 1 + 1e-6
        assert np.allclose(uses[number[piece]], (language.Forward(moved, number).scores(words) - forward.scores(words)).sum(0) / 1e-6, atol=1e-4)


def test_language(docs):
    known = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.detect_language(docs, PIECES).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([known[r.doc_id] == r.lang_pred for r in held]) > 0.95


def test_no_clear_language_goes(spark, docs):
    """Of clean documents all stay; null, letterless, unlearned and evenly mixed texts go."""
    by = {lang: [r.text for r in docs.where(docs.lang == lang).limit(3).collect()] for lang in ("en", "de")}
    mixed = " ".join(w for pair in zip(by["en"][0].split()[:40], by["de"][0].split()[:40], strict=True) for w in pair)
    more = [(-1, None), (-2, "12 - 34"), (-3, "中文和日文之间没有空格" * 20), (-4, "Привет мир и все остальные")]
    table = docs.unionByName(spark.createDataFrame([(i, t, None, "x", 0) for i, t in more], docs.schema))
    kept = {r.doc_id for r in language.known_language(table, PIECES).collect()}
    assert kept == {r.doc_id for r in docs.collect()}
    rows = {r.doc_id: r for r in language.detect_language(table.unionByName(spark.createDataFrame([(-5, mixed, None, "x", 0)], docs.schema)), PIECES).collect()}
    assert rows[-5].score < min(r.score for d, r in rows.items() if d >= 0)


def test_language_scores_by_hand(docs):
    """Every document's score by plain sums over plain words, from the pieces learned in Spark."""
    number = language.pieces(PIECES)
    langs, prob = language.learn(docs.where(language.fold() > 0), number)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.detect_language(docs, PIECES).collect()}
    known = {}

    def word_sums(word):
        if word not in known:
            text = "▁" + word
            ways = [np.ones(len(langs))] + [np.zeros(len(langs)) for _ in text]
            for b in range(1, len(text) + 1):
                for a in range(max(0, b - language.LONGEST), b):
                    k = number.get(text[a:b], -1 if b == a + 1 else None)
                    if k is not None:
                        ways[b] = ways[b] + ways[a] * prob[k]
            known[word] = np.log(ways[-1])
        return known[word]

    for r in docs.limit(60).collect():
        words = re.findall(r"[^\W\d_]+", r.text.lower())
        total = sum(map(word_sums, words)) / len(words)
        best = int(total.argmax())
        assert got[r.doc_id][0] == langs[best] and got[r.doc_id][1] == pytest.approx(1 / np.exp(total - total[best]).sum())
