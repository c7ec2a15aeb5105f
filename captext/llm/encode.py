"""Token ids of whole texts by a public tokenizer, with a bounded cache of words."""

from __future__ import annotations

import json
import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers before it forgets those that it met least.
WORDS_HELD = 500_000

#: White space next to a space, or at either end: such a text is encoded in one piece.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
UNEVEN = f"^{WHITE}|{WHITE}$|{WHITE} | {WHITE}"

#: Marks that stand alone after a word's letters.
MARKS = ".,;:!?|"

_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; it stays from task to task."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]


class Encoder:
    """Encodes lists of texts into arrays of ids; none are added at the ends.

    Byte-level tokenizers split before every single space, so a word keeps its
    ids wherever it stands; those of a worker's words are remembered. Other
    tokenizers, and texts with uneven white space or the name of an added token
    (which has an id of its own), are encoded in one piece.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = made.get("pre_tokenizer") or {}
        self.by_word = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not made.get("normalizer")
        self.added = [t["content"] for t in made.get("added_tokens") or []]
        self.opens = np.zeros(size, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.opens[i] = piece[:1] == "Ġ"
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = defaultdict(count().__next__)
        self.uses = np.zeros(0, np.int64)
        self.flat = np.empty(0, self.dtype)
        self.ends = np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Drop the words met once, then those met twice and so on, until half of WORDS_HELD are left."""
        least = 2
        while (keep := np.flatnonzero(self.uses >= least)).size > WORDS_HELD // 2:
            least *= 2
        words = list(self.index)
        self.index = defaultdict(count(len(keep)).__next__, {words[i]: k for k, i in enumerate(keep.tolist())})
        self.flat, self.ends = gather(self.flat, self.ends, keep)
        self.uses = self.uses[keep] // 2

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """An array of ids for each text; null and empty texts have none."""
        out: list[np.ndarray] = [np.empty(0, self.dtype)] * len(texts)
        texts = texts.cast(pa.large_string())
        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        even = pc.and_(some, pc.fill_null(pc.invert(pc.match_substring_regex(texts, UNEVEN)), False)) if self.by_word else pa.array([False] * len(texts))
        for name in self.added:
            even = pc.and_(even, pc.fill_null(pc.invert(pc.match_substring(texts, name)), False))
        rest = pc.and_(some, pc.invert(even))
        for i, ids in zip(np.flatnonzero(rest), self.whole(texts.filter(rest).to_pylist()), strict=True):
            out[i] = ids
        at = np.flatnonzero(even)
        if not len(at):
            return out
        if len(self.index) > WORDS_HELD:
            self._forget()
        words = pc.split_pattern(texts.filter(even), " ")
        opens = words.offsets.to_numpy()
        words = words.flatten()
        distinct = words.dictionary_encode()
        known, look = len(self.index), self.index.__getitem__
        firsts = [w + " " for w in words.take(pa.array(opens[:-1])).to_pylist()]  # without a space before; no word holds one
        first = np.fromiter(map(look, firsts), np.int64, len(firsts))
        number = np.fromiter(map(look, distinct.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(distinct.dictionary))
        self._learn(list(islice(reversed(self.index), len(self.index) - known))[::-1])
        index = number[distinct.indices.to_numpy()]
        index[opens[:-1]] = first
        used = np.bincount(index, minlength=len(self.index))
        used[: len(self.uses)] += self.uses
        self.uses = used
        ids, ends = gather(self.flat, self.ends, index)
        stops = ends[opens]
        for i, a, b in zip(at.tolist(), stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            out[i] = ids[a:b]
        return out

    def _learn(self, words: list[str]) -> None:
        """Append the ids of new words; those after a space are encoded together, one that none stands before (it ends in a space) alone.

        Marks after a word's last letter or digit, and a single line break between
        other characters, form pieces of their own: such a word's ids are those of
        its parts, which are known already or new in their turn.
        """
        if not words:
            return
        known, get = len(self.ends) - 1, self.index.get
        inner: dict[str, int] = {}
        heads: dict[str, int] = {}
        parts: list[int] = []
        counts: list[int] = []

        def add(body: str, first: bool) -> int:
            """Put down the parts of a word without line breaks: a known word's number, or one beyond, even for inner and odd for head parts."""
            stem = body.rstrip(MARKS)
            cut = stem != body and stem[-1:].isalnum()
            own = stem if cut else body
            k = get(own + " " if first else own, known)
            new = heads if first else inner
            parts.append(k if k < known else known + 2 * new.setdefault(own, len(new)) + first)
            if cut:
                parts.append(known + 2 * heads.setdefault(body[len(stem) :], len(heads)) + 1)
            return 1 + cut

        for w in words:
            first = w[-1] == " "
            body = w[:-1] if first else w
            lines = body.split("\n") if "\n" in body else None
            if lines is None:
                counts.append(add(body, first))
            elif all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                n = add(lines[0], first)
                for x in lines[1:]:
                    parts.append(known + 2 * heads.setdefault("\n", len(heads)) + 1)
                    n += 1 + add(x, True)
                counts.append(n)
            else:
                new = heads if first else inner
                parts.append(known + 2 * new.setdefault(body, len(new)) + first)
                counts.append(1)
        stems = list(inner)
        tails = self.whole([" " + " ".join(stems[k : k + 512]) for k in range(0, len(stems), 512)])
        alone = self.whole(list(heads))
        n = sum(map(len, tails))
        flat = np.concatenate((self.flat, *tails, *alone))
        opens = np.flatnonzero(self.opens[flat[len(self.flat) : len(self.flat) + n]])
        ends = np.concatenate((self.ends[:-1], self.ends[-1] + np.concatenate((opens, [n], n + np.cumsum([len(h) for h in alone], dtype=np.int64)))))
        index = np.array(parts, np.int64)
        beyond = index - known
        index = np.where(beyond < 0, index, known + beyond // 2 + np.where(beyond % 2 == 1, len(stems), 0))
        new, stops = gather(flat, ends, index)
        self.flat = np.concatenate((self.flat, new))
        self.ends = np.concatenate((self.ends, self.ends[-1] + stops[np.cumsum(counts)]))


def gather(flat: np.ndarray, ends: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts flat[ends[i]:ends[i + 1]] for each i of index in a row, and where they end (0 first)."""
    lengths = ends[index + 1] - ends[index]
    stops = np.concatenate(([0], np.cumsum(lengths)))
    at = np.repeat(ends[index] - stops[:-1], lengths)
    at += np.arange(stops[-1])
    return flat[at], stops


def batches(rows: Iterator, encode: Encoder, most: int = 1 << 22) -> Iterator[tuple]:
    """Arrow batches cut so that one call encodes one text or about `most` bytes at most: (batch, its ids)."""
    for batch in rows:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes) - sizes) // most
        for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(group)) + 1):
            if len(part):
                own = batch.slice(part[0], len(part))
                yield own, encode(own.column("text"))
