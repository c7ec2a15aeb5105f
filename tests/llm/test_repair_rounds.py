"""Re-Pair goes on until no pair is left that a round would replace."""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq

from captext.llm import tokens
from captext.llm.encode import Encoder


def test_long_repeats_become_one_rule():
    rng = np.random.default_rng(3)
    passage = rng.permutation(50_000)[:64].astype(np.uint16)
    held = [passage] * 40
    row = tokens._shard(0, 0, list(range(40)), held, 50_257)
    assert max(np.frombuffer(row["lengths"], "<u4")) > 16 and sum(row["doc_symbols"]) <= 40 * 4
    assert all((ids == passage).all() for _, ids in tokens.decoded(row))


def test_rules_beyond_two_bytes():
    rng = np.random.default_rng(4)
    ids = np.tile(rng.permutation(50_000).astype(np.uint16), 26)
    row = tokens._shard(0, 0, [7], [ids], 50_257)
    (doc, made), = tokens.decoded(row)
    assert row["width"] == 4 and doc == 7 and (made == ids).all() and max(np.frombuffer(row["lengths"], "<u4")) > 1000
    assert (tokens.decode_slice(row, 0, 49_990, 50_010) == ids[49_990:50_010]).all()


def without_overlap(symbols, ends):
    found, before = Counter(), {}
    for i in range(len(symbols) - 1):
        pair = (symbols[i], symbols[i + 1])
        if not ends[i] and before.get(pair) != i - 1:
            before[pair] = i
            found[pair] += 1
    return found


def test_no_pair_is_left():
    rng = np.random.default_rng(7)
    for kinds, least in ((2, 2), (3, 24), (6, 3), (50, 2), (1, 2)):
        ids = rng.integers(0, kinds, 2500).astype(np.uint16)
        last = rng.random(len(ids)) < 0.02
        last[-1] = True
        symbols, ends, rules = tokens.repair(ids, last, 60, 10_000, least)
        flat, stops = tokens.expansions(rules, 60)
        assert (np.concatenate([flat[stops[s] : stops[s + 1]] for s in symbols]) == ids).all()
        assert (tokens.rule_lengths(rules, 60) == np.diff(stops)[60:]).all()
        assert max(without_overlap(symbols.tolist(), ends).values(), default=0) < least


def test_stored_bytes_of_shipped_settings():
    """Documents of sf0.01 take less than 0.8 of what their ids take in two bytes each, rules and lengths included."""
    texts = [r["text"] or "" for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pylist()]
    ids = Encoder(public_tokenizers.path("byte_bpe_50k.json"))(pa.array(texts))
    row = tokens._shard(0, 0, list(range(len(ids))), ids, 50_257)
    stored = sum(len(row[c]) for c in ("rules", "lengths", "symbols"))
    assert stored < 0.8 * 2 * row["n_ids"]
    assert max(np.frombuffer(row["lengths"], "<u4")) > 16
