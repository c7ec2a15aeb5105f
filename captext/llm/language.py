"""Language identification by unigram pieces, all segmentations summed."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captext.session import cut

#: Documents of each language that are learned from, about; taken by a hash of doc_id.
LEARN_DOCS = 2_000
ROUNDS = 2
FOLDS = 5
#: Longest piece, and characters of a word after which the sums are scaled anew.
LONGEST = 16
SPAN = 32
#: Words whose scores a task remembers before it starts afresh.
WORDS_HELD = 300_000
#: Share of every language's probability that all pieces have alike, seen or not, and the probability of an unknown character.
UNSEEN = 0.002
UNKNOWN = 1e-6
#: Least log probability of a letter, on average, of a text in a learned language.
LEAST_LETTER = -9.0
UNDETERMINED = "und"


def pieces(path: str) -> dict[str, int]:
    """The plain pieces of a sentencepiece model that hold letters only, a word's start marked; numbered."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i)
            if len(piece) <= LONGEST and (piece.lstrip("▁").isalpha() or piece == "▁"):
                found.setdefault(piece.lower(), len(found))
    return found


def lattice(words: list[str], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of all words' segmentations: word, start, end, piece (-1: one unknown character), and the words' lengths."""
    w, s, e, p = [], [], [], []
    lengths = np.zeros(len(words), np.int64)
    get = number.get
    for i, word in enumerate(words):
        text = "▁" + word
        m = lengths[i] = len(text)
        for a in range(m):
            for b in range(a + 1, min(m, a + LONGEST) + 1):
                k = get(text[a:b])
                if k is None:
                    if b > a + 1:
                        continue
                    k = -1
                w.append(i)
                s.append(a)
                e.append(b)
                p.append(k)
    return (*(np.array(x, np.int64) for x in (w, s, e, p)), lengths)


class Forward:
    """Sums over all segmentations of words, for all languages at once.

    prob: a row for each piece, the last for an unknown character; a column for
    each language. A word's sums are divided by their own value at every SPAN-th
    character, so that none underflows, however long the word; pieces across such
    a place take the ratio of the two scales.
    """

    def __init__(self, prob: np.ndarray, number: dict[str, int]) -> None:
        self.prob, self.number = prob, number

    def _lattice(self, words: list[str]):
        word, start, end, piece, lengths = lattice(words, self.number)
        base = np.concatenate(([0], np.cumsum(lengths + 1)))
        order = np.argsort(end, kind="stable")
        return word, base[word] + start, base[word] + end, piece, lengths, base, end, order

    def _alpha(self, made) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward sums by node, and the logarithm of each node's scale."""
        word, a, b, piece, lengths, base, end, order = made
        alpha = np.zeros((base[-1], self.prob.shape[1]))
        scale = np.zeros_like(alpha)
        alpha[base[:-1]] = 1.0
        far = (end - (b - a)) // SPAN < (end - 1) // SPAN  # from a stretch before that of the character before the end
        bounds = np.searchsorted(end[order], np.arange(1, (lengths.max() if len(lengths) else 0) + 2))
        for k in range(len(bounds) - 1):
            at = order[bounds[k] : bounds[k + 1]]
            if not len(at):
                continue
            # All these edges end at place k + 1 of their words; the scale is that of the place before.
            here = scale[b[at] - 1]
            value = alpha[a[at]] * self.prob[piece[at]]
            if far[at].any():
                value *= np.exp(scale[a[at]] - here)
            if (np.diff(b[at]) >= 0).all():
                nodes, first = np.unique(b[at], return_index=True)
                alpha[nodes] = np.add.reduceat(value, first)
            else:
                nodes = np.unique(b[at])
                np.add.at(alpha, b[at], value)
            scale[nodes] = scale[nodes - 1]
            if (k + 1) % SPAN == 0:
                total = np.maximum(alpha[nodes], 1e-300)
                scale[nodes] += np.log(total)
                alpha[nodes] = 1.0
        return alpha, scale

    def scores(self, words: list[str]) -> np.ndarray:
        """log P(word | language): a row for each word."""
        if not words:
            return np.zeros((0, self.prob.shape[1]))
        made = self._lattice(words)
        alpha, scale = self._alpha(made)
        ends = made[5][1:] - 1
        return np.log(np.maximum(alpha[ends], 1e-300)) + scale[ends]

    def uses(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (a row, the last the unknown one) in words with weights by language."""
        made = self._lattice(words)
        word, a, b, piece, lengths, base, end, order = made
        alpha, scale = self._alpha(made)
        # Backward sums over the word's probability, times the forward scale: an edge's share is alpha * step * beta.
        beta = np.zeros_like(alpha)
        last = base[1:] - 1
        beta[last] = 1 / np.maximum(alpha[last], 1e-300)
        step = self.prob[piece]
        far = (scale[a] != scale[b]).any(1)
        step[far] *= np.exp(scale[a[far]] - scale[b[far]])
        start = end - (b - a)
        back = np.argsort(-start, kind="stable")
        bounds = np.searchsorted(-start[back], -np.arange(lengths.max() if len(lengths) else 0, -1, -1), side="left")
        bounds = np.append(bounds, len(back))
        for k in range(len(bounds) - 1):
            at = back[bounds[k] : bounds[k + 1]]
            np.add.at(beta, a[at], step[at] * beta[b[at]])
        share = alpha[a] * step * beta[b]
        out = np.zeros(self.prob.shape)
        np.add.at(out, piece, share * weights[word])
        return out


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The lower-case words of texts in a row, as a dictionary array, and where each text's begin (and the end).

    A word begins with a letter, and has letters and marks: marks behind anything else are none.
    """
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"^\p{M}+|[^\p{L}\p{M}]+\p{M}*", " ")
    split = pc.split_pattern(plain, " ")
    opens, words = split.offsets.to_numpy(), split.flatten()
    some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    stops = np.concatenate(([0], np.cumsum(some)))[opens]
    return words.filter(pa.array(some)).dictionary_encode(), stops


def fold() -> Column:
    """crc32 of doc_id as text, modulo FOLDS; rows of fold 0 are held out."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def learn(docs: DataFrame, number: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (a row for each piece, then the unknown one) from labelled docs.

    Each language gives about LEARN_DOCS documents, whole. Words are counted by
    language in Spark; each of ROUNDS rounds of expectation-maximisation sums
    expected uses by task, then by piece. The driver holds the vocabulary's sums.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in docs.where("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(number) + 1, 0))
    place = {name: i for i, name in enumerate(langs)}
    limits = F.create_map(*(x for name in langs for x in (F.lit(name), F.lit(int(min(1.0, LEARN_DOCS / sizes[name]) * (1 << 30))))))

    def tokens(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            words, stops = words_of(batch.column("text"))
            which = np.repeat([place[x] for x in batch.column("lang").to_pylist()], np.diff(stops))
            key, n = np.unique(which.astype(np.int64) << 40 | words.indices.to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key >> 40).astype(np.int32)), words.dictionary.take(pa.array(key & ((1 << 40) - 1))).cast(pa.string()), pa.array(n)], ["lang", "word", "n"])

    sample = known.where(F.col("h") < limits[F.col("lang")]).select("lang", "text")
    counts = sample.mapInArrow(tokens, "lang int, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    prob = np.full((len(number) + 1, len(langs)), 1.0 / len(number))
    prob[-1] = UNKNOWN
    for _ in range(ROUNDS):
        now = prob

        def expect(rows: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            forward = Forward(now, number)
            out = np.zeros(now.shape)
            for batch in rows:
                words = batch.column("word").to_pylist()
                weights = np.zeros((len(words), len(langs)))
                weights[np.arange(len(words)), batch.column("lang").to_numpy()] = batch.column("n").to_numpy()
                out += forward.uses(words, weights)
            piece, lang = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(out[piece, lang])], ["piece", "lang", "uses"])

        summed = counts.mapInArrow(expect, "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.zeros(prob.shape)
        uses[summed["piece"], summed["lang"]] = summed["uses"]
        uses[-1] = 0
        prob = (1 - UNSEEN) * uses / np.maximum(uses.sum(0), 1e-300) + UNSEEN / len(number)
        prob[-1] = UNKNOWN
    return langs, prob


class Detector:
    """Languages and scores of Arrow batches of texts; a task remembers its words' scores."""

    def __init__(self, langs: list[str], prob: np.ndarray, number: dict[str, int]) -> None:
        self.langs, self.forward = langs, Forward(prob, number)
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = defaultdict(count().__next__)
        self.table = np.zeros((0, len(self.langs)))

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, and whether its letters are likely ones of that language."""
        n, wide = len(texts), len(self.langs)
        words, stops = words_of(texts)
        filled = np.diff(stops) > 0
        if not wide:
            return [UNDETERMINED] * n, np.zeros(n), np.zeros(n, bool)
        if len(self.index) > WORDS_HELD:
            self._reset()
        index = self.index
        known = len(index)
        at = np.fromiter(map(index.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(words.dictionary))
        new = list(islice(reversed(index), len(index) - known))[::-1]
        table = self.table = np.concatenate((self.table, *(self.forward.scores(new[k : k + 5_000]) for k in range(0, len(new), 5_000))))
        total = np.zeros((n, wide))
        if filled.any():
            total[filled] = np.add.reduceat(table[at[words.indices.to_numpy()]], stops[:-1][filled])
        mean = total / np.maximum(np.diff(stops), 1)[:, None]
        score = np.where(filled, 1 / np.exp(mean - mean.max(1, keepdims=True)).sum(1), 0.0)
        letters = np.zeros(n)
        if filled.any():
            letters[filled] = np.add.reduceat(pc.utf8_length(words.dictionary).to_numpy()[words.indices.to_numpy()], stops[:-1][filled])
        likely = filled & (total.max(1) >= LEAST_LETTER * letters)
        return [self.langs[b] if f else UNDETERMINED for b, f in zip(total.argmax(1), filled, strict=True)], score, likely


def _cut_batches(rows: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` text bytes, one row at least."""
    for batch in rows:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes) - sizes) // most
        for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(group)) + 1):
            if len(part):
                yield batch.slice(part[0], len(part))


def detect_language(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    docs needs doc_id, text and lang; only folds 1 to 4 are learned from. A word
    is a run of letters in lower case; a text's score is the sum over its words
    of log P(word | language), each the sum over all segmentations into pieces of
    the vocabulary. lang_pred is the language of the greatest sum, the first by
    name where they tie. score is its posterior for the mean over the words, so
    that it tells how clear the language is whatever the length; a text in letters
    that no language has gets an equal share. `und` with score 0 if the text is
    null or has no letter, or no language was learned.
    """
    number = pieces(vocabulary)
    detector = (*learn(docs.where(fold() > 0), number), number)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detect = Detector(*detector)
        for own in _cut_batches(rows):
            name, score, _ = detect(own.column("text"))
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("held_out"), pa.array(name, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, vocabulary: str, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose language is found with a score of `least` or more, in likely letters. See detect_language()."""
    number = pieces(vocabulary)
    detector = (*learn(docs.where(fold() > 0), number), number)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detect = Detector(*detector)
        for own in _cut_batches(rows):
            name, score, likely = detect(own.column("text"))
            yield own.filter(pa.array((score >= least) & likely & (np.array(name) != UNDETERMINED)))

    return docs.mapInArrow(run, docs.schema)
