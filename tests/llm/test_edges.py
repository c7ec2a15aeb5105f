"""Every operator on empty tables, nulls, repeated rows and extra columns with clashing names."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from captext.llm import language, mixing, packing, quality, rules, sharding, simhash, substrings, tokens, vectors

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, start long, _ord long, fp long, sequence_id long, shard int"
LONG = "all work and no play makes jack a dull boy\n" * 3000
ROWS = [
    (0, "the quick brown fox jumps over the lazy dog and runs away from the old grey house", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog and runs away from the old grey house", "en", "b"),
    (1, "the quick brown fox jumps over the lazy dog and runs away from the old grey house", "en", "b"),
    (2, None, None, None),
    (3, "", "de", ""),
    (4, " \n\t ", "de", "a"),
    (5, LONG, "en", "a"),
    (6, "der schnelle braune Fuchs springt  über den faulen Hund \n und läuft davon", "de", None),
    (7, "中文 и русский 🙂 <|endoftext|>", None, "b"),
    (None, "no id here", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, 7, 7, 7, 7, 7, 7) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, 0), (5, 0, 1), (6, 1, None), (3, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


RUNS = {
    "tokens": lambda d, labels: tokens.token_shards(d, BYTES),
    "quality": lambda d, labels: quality.quality_scores(d, labels),
    "packing": lambda d, labels: packing.pack(d, BYTES),
    "mixing": lambda d, labels: mixing.mix(d),
    "substrings": lambda d, labels: substrings.repeats_removed(d),
    "simhash": lambda d, labels: simhash.simhash_groups(d),
    "near copies": lambda d, labels: simhash.near_copy_groups(d),
    "sharding": lambda d, labels: sharding.kd_shards(d, 3),
    "rules": lambda d, labels: rules.quality_rules(d, labels),
    "language": lambda d, labels: language.detect_language(d, PIECES),
    "known language": lambda d, labels: language.known_language(d, PIECES),
    "mixed": lambda d, labels: mixing.mixed_documents(d),
    "without repeats": lambda d, labels: substrings.without_repeats(d),
    "first of groups": lambda d, labels: simhash.first_of_groups(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(none, labels, name):
    assert RUNS[name](none, labels).count() == 0


@pytest.mark.parametrize("name", ["tokens", "quality", "mixing", "substrings", "simhash", "sharding", "rules", "language"])
def test_every_row_is_answered(docs, labels, name):
    assert RUNS[name](docs, labels).count() == len(ROWS)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(end):
    t = Tokenizer.from_file(BYTES)
    return [(d, [*t.encode(x or "", add_special_tokens=False).ids, end]) for d, x, _, _ in ROWS]


def test_token_values(docs):
    """Null ids come first, repeated rows follow each other, the name of an added token is that token."""
    want = sorted(encoded(2), key=lambda x: (x[0] is not None, x[0] or 0))
    assert want[-1][1].count(50256) == 1
    starts = np.cumsum([0, *(len(ids) for _, ids in want)])[:-1].tolist()
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.token_shards(docs, BYTES).collect())
    assert got == [(s, d, len(ids), crc(ids)) for s, (d, ids) in zip(starts, want, strict=True)]


def test_packing_values(docs):
    want, bins = Counter(), defaultdict(list)
    for d, ids in encoded(0):
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want.update((d, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    rows = packing.pack(docs, BYTES).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all([o for o, _ in sorted(b)] == np.cumsum([0, *(n for _, n in sorted(b))])[:-1].tolist() and sum(n for _, n in b) <= 2048 for b in bins.values())


def test_group_values(docs):
    """Wordless texts are one group, copies another; a row without a doc_id is in none and stays."""
    groups = Counter((r.doc_id, r.component_id) for r in simhash.near_copy_groups(docs).collect())
    assert groups == Counter({(0, 0): 1, (1, 0): 2, (2, 2): 1, (3, 2): 1, (4, 2): 1, (5, 5): 1, (6, 6): 1, (7, 7): 1})
    kept = simhash.first_of_groups(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([0, 2, 5, 6, 7, None])
    hashes = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert {(2, "0" * 16, 2), (3, "0" * 16, 2), (4, "0" * 16, 2)} <= hashes


def test_language_values(docs):
    kept = language.known_language(docs, PIECES)
    assert kept.columns == docs.columns and not {2, 3, 4} & {r.doc_id for r in kept.collect()}
    rows = [r for r in language.detect_language(docs, PIECES).collect() if r.doc_id in (2, 3, 4)]
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_mix_values(docs):
    """Each row stands as often as its copies say, with its other columns, whatever their names."""
    taken = Counter()
    for r in mixing.copies(docs).collect():
        taken[r.doc_id] += r.copies
        assert r.target <= 2 * r.source_size
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns and Counter(r.doc_id for r in rows.collect()) == +taken
    assert {(r.part, r.start, r.shard) for r in rows.collect()} == {(7, 7, 7)}
    clash = docs.withColumnRenamed("part", "nth").withColumnRenamed("start", "copies").withColumnRenamed("_ord", "lot").withColumnRenamed("fp", "of")
    assert Counter(r.doc_id for r in mixing.mixed_documents(clash).collect()) == +taken


def test_repeat_values(docs):
    """Only the long text repeats itself over 100 bytes: one period and what a string of 100 bytes needs beyond it stay."""
    line = "all work and no play makes jack a dull boy\n"
    rows = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in substrings.repeats_removed(docs).collect()}
    assert (5, len(LONG), len(LONG) - len(line), 1) in rows and all(n == 0 for d, _, n, _ in rows if d != 5)
    clash = docs.withColumnRenamed("part", "_row_order").withColumnRenamed("start", "_row_spans")
    out = {r.doc_id: r for r in substrings.without_repeats(clash).collect()}
    assert (out[5].text, out[5].n_chars) == (line, len(line)) and out[5]._row_order == 7 and out[0].n_chars == len(ROWS[0][1])


def test_quality_and_rule_values(docs, labels):
    scores = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert scores[2].score == scores[3].score and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scores.values())
    rows = {r.doc_id: r for r in rules.quality_rules(docs, labels).collect()}
    n = 10 * 3000
    assert tuple(rows[5])[1:7] == (n, 33 * 3000, 0, 2999, n, True) and tuple(rows[2])[1:6] == tuple(rows[4])[1:6] == (0, 0, 0, 0, 0)
    assert tuple(rows[7])[1:5] == (5, 24, 4, 0) and not any(r.kept for r in rows.values())


def test_shard_values(docs):
    rows = sharding.kd_shards(docs, 3).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    shard = {r.doc_id: r.shard for r in rows}
    assert shard[0] == shard[1] and shard[2] == shard[3] and {r.size for r in rows if r.doc_id == 2} == {8}


def test_no_labels(docs, labels):
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.kept for r in rules.quality_rules(docs, labels.limit(0)).where("NOT base_failed").collect()} <= {True}


def test_one_kind_of_label(docs, labels):
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(docs, labels.where("quality = 1")).collect())


def test_undetermined(docs):
    found = {(r.doc_id, r.lang_pred) for r in language.detect_language(docs, PIECES).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= found


def test_vectors(spark):
    nan, inf = float("nan"), math.inf
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, [0.0, 0.0], 1), (6, None, 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [0.0, 1.0], 1), (11, [], 1), (12, [1.0], 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cell string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(table).collect()}
    assert got[0] == (2, 0, True) and got[1] == (2, 0, False) and got[2] == (2, 0, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_texts_of_marks_have_no_language(spark, docs):
    """Marks, emoji with a variation selector and digits aren't letters; marks behind letters belong to them."""
    texts = {100: "❤️", 101: "\u0301\u0302", 102: "👍🏽 ❤️ 12 !", 103: "\u0301the cafe\u0301 is open and the dog runs away"}
    rows = spark.createDataFrame([(d, t, None, None, 1, 1, 1, 1, 1, 1, 1) for d, t in texts.items()], SCHEMA).union(docs)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.detect_language(rows, PIECES).collect() if r.doc_id in texts}
    assert found[100] == found[101] == found[102] == ("und", 0.0) and found[103][0] != "und"
    assert {r.doc_id for r in language.known_language(rows, PIECES).collect()} & {100, 101, 102} == set()
    words, stops = language.words_of(__import__("pyarrow").array([texts[103], "a\u0301b", None]))
    assert words.to_pylist() == ["the", "cafe\u0301", "is", "open", "and", "the", "dog", "runs", "away", "a\u0301b"] and stops.tolist() == [0, 9, 10, 10]


def test_ties(spark, labels):
    """Equal texts have equal scores; documents of one size are mixed alike in every run."""
    rows = [(i, "the same few words in every text", "en", f"s{i % 3}", *[1] * 7) for i in range(90)]
    a, b = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)
    assert len({r.score for r in quality.quality_scores(a, labels).collect()}) == 1
    mixed = [sorted((r.doc_id, r.taken) for r in mixing.mix(x).collect()) for x in (a, b)]
    assert mixed[0] == mixed[1] and {t for _, t in mixed[0]} <= {0, 7, 14}


def test_targets_of_many_sources(spark):
    """Targets by weight in code-point order, null last, with the excess shared again, against a plain version."""
    rng = np.random.default_rng(8)
    names = [f"{c}{i}" for i in range(40) for c in "aZé中"] + [None]
    sizes = {s: int(x) for s, x in zip(names, rng.pareto(0.5, len(names)) * 100, strict=True)} | {"a0": 0}
    order = [*sorted((s for s in sizes if s is not None), key=str.encode), None]
    weight, out = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}
    while True:
        rest = [s for s in order if s not in out]
        left, total = 1.5 * sum(sizes.values()) - sum(out.values()), sum(weight[s] for s in rest)
        above = [s for s in rest if left * weight[s] / total > 2 * sizes[s]]
        if not above:
            break
        out |= {s: 2.0 * sizes[s] for s in above}
    out |= {s: left * weight[s] / total for s in rest}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    assert set(got) == set(out) and all(math.isclose(got[s], out[s], abs_tol=1e-6) for s in out)
