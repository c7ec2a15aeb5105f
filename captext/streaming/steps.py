"""Order-dependent logic of one key: what a step makes of a row, and of time that passes without one.

A step is a small machine over a state of its own type. fold.py drives it, on
tables and on streams alike, in event time: `row` for each row in order, `fire`
when the moment that `due` names has come before the next row, `end` when nothing
comes any more. A state that equals a new one is not kept, so every step names a
moment at which it forgets.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np

from captext.functions.text import CYRILLIC_LOOKALIKE, LATIN_LOOKALIKE, LOOKALIKE_DIGITS, LOOKALIKE_LETTERS
from captext.operators.fusion import common_run

#: Milliseconds of silence after which a key starts anew.
FORGET = 600_000


class Step:
    """The parts that a step may leave out."""

    #: Columns of the rows that it emits.
    schema = "stream_id long, seq long, text string"

    def start(self) -> object:
        raise NotImplementedError

    def row(self, state, row) -> list[tuple]:
        raise NotImplementedError

    def due(self, state) -> int | None:
        return None

    def fire(self, key, state, now: int) -> list[tuple]:
        return []

    def end(self, key, state) -> list[tuple]:
        return []


def plain_text(text: str) -> str:
    """Lower case, white space squeezed, marks at the end gone."""
    return " ".join(text.lower().split()).rstrip(".,!?:;- ")


@dataclass
class Heard:
    texts: dict[str, int] = field(default_factory=dict)
    last: str = ""
    at: int = 0


class TextChanges(Step):
    """Texts that are new.

    Texts of less than `shortest` characters are noise. A text is known if it was
    seen within `ttl` ms; else if its common run with the last text is above
    `alike`, and the longer of both is the last one from then on; else if one seen
    within `ttl` contains it or is part of it. A known text keeps what it matched
    fresh. Each text has its own end, at which a timer drops it.
    """

    def __init__(self, ttl: int = 1000, alike: float = 0.85, shortest: int = 4, forget: int = FORGET):
        self.ttl, self.alike, self.shortest, self.forget = ttl, alike, shortest, forget

    def start(self) -> Heard:
        return Heard()

    def row(self, state: Heard, row) -> list[tuple]:
        text = plain_text(row.text)
        if len(text) < self.shortest:
            return []
        state.at = row.t
        match = text if text in state.texts else None
        if match is None and state.last and common_run(text, state.last, self.alike) > self.alike:
            if len(text) > len(state.last):
                state.last, state.texts[text] = text, row.t
            return []
        match = match or next((old for old in state.texts if text in old or old in text), None)
        state.texts[match or text] = row.t
        if match:
            return []
        state.last = text
        return [(row.stream_id, row.seq, row.text)]

    def due(self, state: Heard) -> int | None:
        if state.texts:
            return min(state.texts.values()) + self.ttl + 1
        return state.at + self.forget if state.last else None

    def fire(self, key, state: Heard, now: int) -> list[tuple]:
        state.texts = {k: t for k, t in state.texts.items() if now - t <= self.ttl}
        if now - state.at >= self.forget:
            state.last, state.at = "", 0
        return []


@dataclass
class Lines:
    said: list[str] = field(default_factory=list)
    seen: dict[str, None] = field(default_factory=dict)
    at: int = 0


class MaturingLines(Step):
    """Lines of captures once they are stable.

    A line is held against every said line and against every line of the capture
    before. relations() tells what holds between two lines: one that is the SAME as a
    said one is known, one that GREW from a said one gives the words behind those
    that it begins with, one that is RELATED to a seen one has matured. The last
    `memory` said lines are kept.
    """

    def __init__(self, memory: int = 80, alike: float = 0.75, grown: float = 1.15, forget: int = FORGET):
        self.memory, self.alike, self.grown, self.forget = memory, alike, grown, forget
        self.digits = str.maketrans(LOOKALIKE_LETTERS, LOOKALIKE_DIGITS)

    def start(self) -> Lines:
        return Lines()

    def bare(self, text: str) -> str:
        """Letters, digits and underscores in lower case, look-alike letters as digits, all else one space."""
        return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split()).translate(self.digits)

    def relations(self, line: str, old: str) -> set[str]:
        run, short, long = common_run(line, old, self.alike), min(len(line), len(old)), max(len(line), len(old))
        inside = line in old or old in line
        grew = len(line) > self.grown * len(old)
        rules = {
            "GREW": grew and (run > self.alike or (len(old) >= 8 and old in line)),
            "SAME": not grew and (run > self.alike or (inside and short >= 15)),
            "RELATED": run > self.alike or (inside and short >= 5 and long <= 3 * short),
        }
        return {name for name, holds in rules.items() if holds}

    def row(self, state: Lines, row) -> list[tuple]:
        lines = [(bare, line.strip()) for line in row.text.split("\n") if (bare := self.bare(line))]
        said, out = state.said, []
        fresh: dict[str, None] = {}
        for bare, line in lines:
            to_said = [(old, self.relations(bare, old)) for old in said]
            if any("SAME" in names for _, names in to_said):
                continue
            root = next((old for old, names in reversed(to_said) if "GREW" in names), None)
            if root is None and not any("RELATED" in self.relations(bare, old) for old in state.seen):
                continue
            words = self.tail(line, root) if root else line
            if words:
                fresh[bare] = None
                out.append((row.stream_id, row.seq, words))
        state.said = [*said, *fresh][-self.memory :]
        state.seen, state.at = {bare: None for bare, _ in lines}, row.t
        return out

    def tail(self, line: str, root: str) -> str:
        """The words of line behind those that it shares with root at its start."""
        old, words = root.split(), line.split()
        shared = [self.bare(w) == o for w, o in zip(words, old, strict=False)]
        return " ".join(words[shared.index(False) if False in shared else len(shared) :])

    def due(self, state: Lines) -> int | None:
        return state.at + self.forget if state.said or state.seen else None

    def fire(self, key, state: Lines, now: int) -> list[tuple]:
        state.said, state.seen, state.at = [], {}, 0
        return []


@dataclass
class Words:
    words: list[str] = field(default_factory=list)
    at: int = 0
    seq: int = 0


class Chunks(Step):
    """Words at a comma or full stop after `least` of them, beyond `most`, after `idle` ms with two or more, and whatever is left after `forget` ms or at the end.

    `idle` ends a chunk while nothing comes: a timer does it, not the next row.
    """

    def __init__(self, idle: int = 5000, least: int = 3, most: int = 15, forget: int = FORGET):
        self.idle, self.least, self.most, self.forget = idle, least, most, forget

    def start(self) -> Words:
        return Words()

    def row(self, state: Words, row) -> list[tuple]:
        out = []
        state.at, state.seq = row.t, row.seq
        for w in row.text.split():
            state.words.append(w)
            if (w[-1] in ",." and len(state.words) >= self.least) or len(state.words) > self.most:
                out += self.flushed(row.stream_id, state)
        if not state.words:
            state.at = state.seq = 0
        return out

    def flushed(self, key, state: Words) -> list[tuple]:
        words, state.words = state.words, []
        return [(key, state.seq, " ".join(words))] if words else []

    def due(self, state: Words) -> int | None:
        return state.at + (self.idle if len(state.words) > 1 else self.forget) if state.words else None

    def fire(self, key, state: Words, now: int) -> list[tuple]:
        return self.end(key, state)

    def end(self, key, state: Words) -> list[tuple]:
        out = self.flushed(key, state)
        state.at = state.seq = 0
        return out


@dataclass
class Buffer:
    held: list[str] = field(default_factory=list)
    at: int = 0


class NewTexts(Step):
    """Texts that aren't among the last `memory` emitted."""

    def __init__(self, memory: int = 20, forget: int = FORGET):
        self.memory, self.forget = memory, forget

    def start(self) -> Buffer:
        return Buffer()

    def row(self, state: Buffer, row) -> list[tuple]:
        text, state.at = " ".join(row.text.lower().split()), row.t
        if text in state.held:
            return []
        state.held = [*state.held, text][-self.memory :]
        return [(row.stream_id, row.seq, row.text)]

    def due(self, state: Buffer) -> int | None:
        return state.at + self.forget if state.held else None

    def fire(self, key, state: Buffer, now: int) -> list[tuple]:
        state.held, state.at = [], 0
        return []


@dataclass
class Piece:
    start: int | None = None
    stop: int = 0
    seq: int = 0
    last: int | None = None


class Cuts(Step):
    """Pieces (t0, t1) of speech, with the seq of the last row in them.

    A piece ends `pause` ms after its last row's end, by a timer, where it is `least`
    ms long and the last cut was `gap` ms before; at `most` ms in any case; and the
    rest after `forget` ms or at the end.
    """

    schema = "stream_id long, seq long, t0 long, t1 long"

    def __init__(self, pause: int = 260, least: int = 1100, most: int = 8000, gap: int = 700, forget: int = FORGET):
        self.pause, self.least, self.most, self.gap, self.forget = pause, least, most, gap, forget

    def start(self) -> Piece:
        return Piece()

    def row(self, state: Piece, row) -> list[tuple]:
        if state.start is None:
            state.start, state.stop = row.t0, row.t0
        state.stop, state.seq = max(state.stop, row.t1), row.seq
        cuts = range(state.start + self.most, state.stop + 1, self.most)
        out = [(row.stream_id, row.seq, t - self.most, t) for t in cuts]
        if out:
            state.start = state.last = out[-1][3]
        return out

    def long_enough(self, state: Piece) -> bool:
        return state.stop - state.start >= self.least and (state.last is None or state.stop - state.last >= self.gap)

    def due(self, state: Piece) -> int | None:
        if state.start is not None:
            return state.stop + (self.pause if self.long_enough(state) else self.forget)
        return None if state.last is None else state.last + self.forget

    def fire(self, key, state: Piece, now: int) -> list[tuple]:
        forgotten = now - max(state.stop, state.last or 0) >= self.forget
        out = self.end(key, state)
        if forgotten:
            state.last = None
        return out

    def end(self, key, state: Piece) -> list[tuple]:
        out = [(key, state.seq, state.start, state.stop)] if state.start is not None and state.stop > state.start else []
        if out:
            state.last = state.stop
        state.start, state.stop, state.seq = None, 0, 0
        return out


@dataclass
class Taken:
    until: int | None = None


class Admissions(Step):
    """Rows (seq, t) that come `gap` ms after the last one taken or later, and not while that one keeps busy (its `busy` ms, where rows have that column)."""

    schema = "stream_id long, seq long, t long"

    def __init__(self, gap: int = 1000):
        self.gap = gap

    def start(self) -> Taken:
        return Taken()

    def row(self, state: Taken, row) -> list[tuple]:
        if state.until is not None:
            return []
        state.until = row.t + max(self.gap, getattr(row, "busy", 0) or 0)
        return [(row.stream_id, row.seq, row.t)]

    def due(self, state: Taken) -> int | None:
        return state.until

    def fire(self, key, state: Taken, now: int) -> list[tuple]:
        state.until = None
        return []


@dataclass
class Baseline:
    luma: object = None


class Movement(Step):
    """diff and moved of frames against a baseline frame that moves only with a difference above `above`; the middle is left out."""

    schema = "stream_id int, seq long, diff double, moved boolean"

    def __init__(self, above: float = 8.0):
        self.above = above

    def start(self) -> Baseline:
        return Baseline()

    def row(self, state: Baseline, row) -> list[tuple]:
        luma = np.array(row.luma, float).reshape(8, 8).copy()
        luma[2:6, 2:6] = 0
        diff = 255.0 if state.luma is None else float(np.abs(luma - state.luma).sum() / 48)
        if moved := diff > self.above:
            state.luma = luma
        return [(row.stream_id, row.seq, round(diff, 3), moved)]


@dataclass
class Merged:
    tail: str = ""


class WindowMerge(Step):
    """What a window adds beyond the longest run that its first `most` characters share with the last `most` so far.

    Letters are canonical (lower case, Cyrillic look-alikes as Latin). Runs start
    within the window's first `reach` characters and have `least` or more; of the
    longest the first counts. Where a length is shared, so is every shorter one.
    """

    def __init__(self, most: int = 48, reach: int = 24, least: int = 4):
        self.most, self.reach, self.least = most, reach, least
        self.table = str.maketrans(CYRILLIC_LOOKALIKE, LATIN_LOOKALIKE)

    def start(self) -> Merged:
        return Merged()

    def canonical(self, text: str) -> str:
        return "".join(c.lower()[:1] for c in text.translate(self.table))

    def row(self, state: Merged, row) -> list[tuple]:
        tail, head = self.canonical(state.tail), self.canonical(row.text[: self.most])

        def place(n: int) -> int:
            """Where the first shared run of n characters starts, -1 for none."""
            return next((k for k in range(min(self.reach, len(head) - n + 1)) if head[k : k + n] in tail), -1)

        lengths = range(self.least, min(len(head), len(tail)) + 1)
        longest = bisect_left(lengths, True, key=lambda n: place(n) < 0) - 1
        end = place(lengths[longest]) + lengths[longest] if longest >= 0 else 0
        state.tail = (state.tail + row.text[end:])[-self.most :]
        return [(row.stream_id, row.seq, row.text[end:])]
