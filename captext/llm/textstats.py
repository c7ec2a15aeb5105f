"""Counts over whole texts, and ratios of them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bytes", "n_upper", "n_digits", "n_marks", "n_shouts", "n_bars", "n_same", "n_distinct")


def repeated(ids: np.ndarray, size: int) -> int:
    """Positions of word numbers (below size) inside a 3-word window that occurs twice or more."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-2] * size + ids[1:-1]
    if size > 1 << 21:  # three numbers don't fit one of 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    key = pairs * size + ids[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    at = np.searchsorted(twice, key)
    hit = twice[np.minimum(at, len(twice) - 1)] == key
    inside = np.zeros(len(ids), bool)
    for shift in range(3):
        inside[shift : len(key) + shift] |= hit
    return int(inside.sum())


def counts(text: bytes, n_chars: int) -> tuple[int, ...]:
    """The COUNTS of one text in UTF-8."""
    words = text.split()
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    spaces = sum(text.count(SPACES[i : i + 1]) for i in range(len(SPACES)))
    lines = text.split(b"\n") if words else []
    filled = [x for x in lines if x.strip()]
    raw = np.frombuffer(text, np.uint8)
    bars = text.count(b"|")
    return (
        len(words),
        n_chars - spaces,
        sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))),
        len(filled) - len(set(filled)),
        repeated(ids, len(number)),
        len(filled),
        len(text),
        int(((raw >= 65) & (raw <= 90)).sum()),
        int(((raw >= 48) & (raw <= 57)).sum()),
        sum(text.count(m) for m in (b".", b",", b";", b":", b"?")),
        text.count(b"!"),
        bars,
        int((ids[1:] == ids[:-1]).sum()),
        len(number),
    )


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the COUNTS (long) of every whole text; a null text counts as empty.

    Words are what ASCII white space parts. n_dup_lines: lines with a word that
    equal an earlier one; n_repeat_words: words in 3-word windows found twice or
    more, the first included; n_same: words equal to the one before.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column("text").cast(pa.large_string())
            chars = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            found = [counts(t or b"", n) for t, n in zip(texts.cast(pa.large_binary()).to_pylist(), chars, strict=True)]
            columns = np.array(found, np.int64).reshape(-1, len(COUNTS)).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in columns)], ["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def ratios() -> dict[str, Column]:
    """Statistics of a text_counts row that don't grow with the text, but for its length's logarithm."""
    per = lambda name, by: F.col(name) / F.greatest(F.lit(1), F.col(by))
    return {
        "log_words": F.log1p(F.col("n_words")),
        "mean_chars": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "n_bytes"),
        "digit_share": per("n_digits", "n_bytes"),
        "mark_share": per("n_marks", "n_words"),
        "shout_share": per("n_shouts", "n_words"),
        "bar_share": per("n_bars", "n_words"),
        "same_share": per("n_same", "n_words"),
        "distinct_share": per("n_distinct", "n_words"),
    }
