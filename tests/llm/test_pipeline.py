"""The stages of the pipeline against what each has to do, and run() against them."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from captext.llm.registry import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, made = docs.columns, None, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "pack":
            assert docs.columns == columns
        made[name] = docs.collect()
        if name == "language":
            before = {r.doc_id: r.text for r in made[name]}
            assert len(before) > 190
    kept = {r.doc_id: r.text for r in made["near_copies"]}
    assert len(set(kept.values())) == len(kept) and set(kept) <= set(before)
    # Each text that went has an equal or similar one with a smaller doc_id, first copies stay.
    firsts = {}
    for doc in sorted(before):
        firsts.setdefault(before[doc], doc)
    assert len(kept) >= 0.95 * len(firsts) and set(kept) <= set(firsts.values())
    cut = {r.doc_id: r.text for r in made["repeats"]}
    assert set(cut) == set(kept) and all(len(cut[d]) <= len(kept[d]) for d in kept)
    assert all(r.n_chars == len(r.text) for r in made["repeats"])
    times = Counter(r.doc_id for r in made["mix"])
    assert set(times) <= set(cut) and max(times.values()) <= 2 and all(r.text == cut[r.doc_id] for r in made["mix"])
    assert Counter(r.doc_id for r in made["pack"] if r.piece == 0) == times
    assert corpus_pipeline.run(spark, SF).count() == len(made["pack"])


def test_registered():
    names = list(queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
