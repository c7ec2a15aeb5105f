"""Lexicons and the joins that look words up in them.

Vocabulary first: distinct tokens are far fewer than tokens, so candidates are
made for distinct words and joined back by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captext.functions import text as T
from captext.session import cut


def build_lexicon(tokens: DataFrame, least: int = 3, seeds: DataFrame | None = None, seed_weight: int = 5) -> DataFrame:
    """word and freq of lower-case letter tokens found `least` times; each seed word counts seed_weight more."""
    distinct = tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("token").rlike(r"^\p{L}+$"))
    counted = distinct.groupBy(F.lower("token").alias("word")).agg(F.sum("n").alias("freq"))
    if seeds is not None:
        counted = counted.unionByName(seeds.select("word", F.lit(seed_weight).cast("long").alias("freq"))).groupBy("word").agg(F.sum("freq").alias("freq"))
    return counted.where(F.col("freq") >= least)


#: Rows of a table up to which it becomes a literal map in the plan.
MOST_LITERALS = 100


def _literals(table: DataFrame) -> dict[str, str] | None:
    """src and dst of a table of MOST_LITERALS rows at most, None for a larger one."""
    held = table.select("src", "dst").limit(MOST_LITERALS + 1).collect()
    return {r["src"]: r["dst"] for r in held if r["src"] is not None and r["dst"] is not None} if len(held) <= MOST_LITERALS else None


def with_answers(docs: DataFrame, words: Column, table: DataFrame, key: str, out: str) -> DataFrame:
    """docs with `out`, a map from those of the array `words` that `table` (src, distinct; dst) knows.

    A table of MOST_LITERALS rows at most is a literal, so that no row moves. For a
    larger one the distinct words of each row meet it, and those found come back as
    one map a row; docs then needs one row a key.
    """
    if (held := _literals(table)) is not None:
        return docs.withColumn(out, T.literal_map(held))
    asked = docs.select(key, F.explode(F.array_distinct(words)).alias("src"))
    found = asked.join(table.select("src", "dst"), "src").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("src", "dst"))).alias(out))
    return docs.join(found, key, "left").withColumn(out, F.coalesce(out, T.literal_map({})))


def _tokens(text: str) -> Column:
    return F.filter(F.split(text, r"[ \n]+"), lambda w: w != "")


def translate_words(docs: DataFrame, glossary: DataFrame, least: float = 0.3, key: str = "doc_id", text: str = "text", keep: str | None = None) -> DataFrame:
    """Texts looked up word by word; key, n, n_found, text, which is empty where fewer than `least` were found, and the given text as `keep`.

    glossary: src (distinct, lower case) and dst. Words that it lacks pass; texts
    without a word are left out.
    """
    docs = docs.select(key, *([F.col(text).alias(keep)] if keep else []), _tokens(text).alias("_w"))
    docs = with_answers(docs, F.transform("_w", F.lower), glossary, key, "_known").where(F.size("_w") > 0)
    docs = docs.withColumn("_dst", F.transform("_w", lambda w: F.col("_known")[F.lower(w)]))
    put = F.array_join(F.zip_with("_w", "_dst", lambda w, d: F.coalesce(d, w)), " ")
    n, found = F.size("_w").cast("long"), F.size(F.filter("_dst", lambda d: d.isNotNull())).cast("long")
    return docs.select(key, *([keep] if keep else []), n.alias("n"), found.alias("n_found"), F.when(found >= n * least, put).otherwise(F.lit("")).alias("text"))


def correct_tokens(tokens: DataFrame, fixes: DataFrame) -> DataFrame:
    """tokens with `fixed`, the right form of a known wrong one in any case, else the token."""
    return tokens.withColumn("wrong", F.lower("token")).join(fixes, "wrong", "left").withColumn("fixed", F.coalesce("right", "token")).drop("wrong", "right")


def phrase_hits(tokens: DataFrame, phrases: DataFrame, key: str = "doc_id") -> DataFrame:
    """Two-word phrases found from left to right without overlap: key, pos, src, dst."""
    w = Window.partitionBy(key).orderBy("pos")
    pairs = tokens.withColumn("src", F.concat_ws(" ", F.lower("token"), F.lower(F.lead("token").over(w))))
    return _apart(pairs.join(phrases, "src"), key)


def phrase_hits_in_texts(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """phrase_hits of the tokens of explode_tokens; docs has one row a key. Pairs are made inside a row and meet a table of MOST_LITERALS rows at most where they are, so that only hits are dealt out then."""
    every = F.filter(F.transform(F.split(text, r"[ \n]+"), lambda w, i: F.struct(i.alias("pos"), w.alias("token"))), lambda x: x["token"] != "")
    # Of the token that no other follows a pair is itself, as in phrase_hits.
    pair = lambda x, next: F.struct(x["pos"].alias("pos"), F.concat_ws(" ", F.lower(x["token"]), F.lower(next["token"])).alias("src"))
    pairs = docs.select(key, every.alias("_x")).select(key, F.inline(F.zip_with("_x", F.slice("_x", F.lit(2), F.greatest(F.size("_x") - 1, F.lit(0))), pair)))
    few = _literals(phrases) is not None
    return _apart(pairs.join(F.broadcast(phrases) if few else phrases, "src"), key)


def _apart(hits: DataFrame, key: str) -> DataFrame:
    """Every other hit of those at neighbouring places."""
    island = F.col("pos") - F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    ranked = hits.withColumn("island", island).withColumn("nth", F.row_number().over(Window.partitionBy(key, "island").orderBy("pos")))
    return ranked.where("nth % 2 = 1").select(key, "pos", "src", "dst")


#: Words that a language without articles has no word for.
ARTICLES = ("a", "an", "the")


def translate_phrases(lines: DataFrame, phrases: DataFrame, glossary: DataFrame, keys: list[str], text: str = "line", longest: int = 6, contractions: dict[str, str] | None = None) -> DataFrame:
    """keys and text of lines, translated by phrases first.

    Contractions are spelled out word by word. A line that is a phrase as a whole
    takes its answer; else at each place from the left the longest phrase of two to
    `longest` words is put, or the word's own answer, nothing for an article, and
    other words pass. phrases and glossary: src (lower case, distinct), dst.
    """
    spelled = T.literal_map(contractions or {})
    raw = T.words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}'\s]+", " "))
    lines = lines.select(*keys, T.words(F.array_join(F.transform(raw, lambda w: F.regexp_replace(F.coalesce(spelled[w], w), "'", "")), " ")).alias("_w"))
    whole = F.array_join("_w", " ")
    held, singles = _literals(phrases), _literals(glossary)
    lines = lines.where(F.size("_w") > 0).withColumn("_id", F.struct(*keys))
    if held is None:
        grams = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(longest)), lambda n: F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))).otherwise(F.array())))
        lines = with_answers(lines, F.concat(grams, F.array(whole)), phrases, "_id", "_phrases")
    if singles is None:
        lines = with_answers(lines, F.col("_w"), glossary, "_id", "_words")

    def put(batches):
        for texts, own, words in batches:
            out = []
            for i, line in enumerate(texts.to_pylist()):
                answers = dict(own[i].as_py() or ()) if held is None else held
                out.append(_put_phrases(line, answers, dict(words[i].as_py() or ()) if singles is None else singles, longest, firsts if firsts is not None else _firsts(answers)))
            yield pa.array(out, pa.string())

    firsts = None if held is None else _firsts(held)
    # A table that is a literal is held by the function, and its column empty.
    none = F.lit(None).cast("map<string, string>")
    found = F.arrow_udf(T._typed(put, 3), "string")(whole, F.col("_phrases") if held is None else none, F.col("_words") if singles is None else none)
    return lines.select(*keys, found.alias("text"))


def _firsts(phrases: dict[str, str]) -> set[str]:
    return {p.split(" ", 1)[0] for p in phrases}


def _put_phrases(line: str, phrases: dict[str, str], singles: dict[str, str], longest: int, firsts: set[str]) -> str:
    """The words of a line, parted by single spaces, in their answers; firsts: the first words of phrases."""
    if phrases.get(line) is not None:
        return phrases[line]
    words, out, at = line.split(" "), [], 0
    while at < len(words):
        word, n = words[at], 1
        if word in firsts:
            n = next((n for n in range(min(longest, len(words) - at), 1, -1) if phrases.get(" ".join(words[at : at + n])) is not None), 1)
        if n > 1:
            said = phrases[" ".join(words[at : at + n])]
        elif (said := singles.get(word)) is None:
            said = "" if word in ARTICLES else word
        if said:
            out.append(said)
        at += n
    return " ".join(out)


#: Length up to which known words are found by what deletions leave of them; longer ones by their pieces, which have seven letters or so there.
SHORT = 20
#: The same for more than two edits, where words have more of such keys.
SHORT_FAR = 8


def _short(distance: int) -> int:
    return SHORT if distance <= 2 else SHORT_FAR


def deletions(word: str, depth: int) -> set[str]:
    """The word and all that is left of it after up to `depth` letters go."""
    found = last = {word}
    for _ in range(depth):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found = found | last
    return found


def pieces(length: int, distance: int) -> list[tuple[int, int]]:
    """Start and end of distance + 1 pieces of a word; `distance` edits leave one of them whole."""
    n = distance + 1
    return [(i * length // n, (i + 1) * length // n) for i in range(n)]


def index_keys(word: str, distance: int) -> set[str]:
    """Keys under which a known word stands: its deletions, or where it is longer than SHORT its pieces with their place."""
    if len(word) <= _short(distance):
        return deletions(word, distance)
    return {f"{len(word)} {i} {word[a:b]}" for i, (a, b) in enumerate(pieces(len(word), distance))}


def lookup_keys(word: str, distance: int) -> set[str]:
    """Keys of which a word has one in common with every known word within `distance` edits.

    A piece of the known word stands in this one at most `distance` letters off its place.
    """
    short = _short(distance)
    found = deletions(word, distance) if len(word) - distance <= short else set()
    for length in range(max(short + 1, len(word) - distance), len(word) + distance + 1):
        for i, (a, b) in enumerate(pieces(length, distance)):
            found |= {f"{length} {i} {word[at : at + b - a]}" for at in range(max(0, a - distance), min(len(word) - (b - a), a + distance) + 1)}
    return found


def _keyed(words: DataFrame, column: str, keys, distance: int) -> DataFrame:
    """The columns of words and key (a hash), a row for each key of the word in `column`."""
    from xxhash import xxh64_intdigest

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            made, ends = [], [0]
            for word in batch.column(column).to_pylist():
                made += map(xxh64_intdigest, keys(word, distance))
                ends.append(len(made))
            hashes = pa.array(np.array(made, np.uint64).view(np.int64))
            yield batch.append_column("key", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hashes))

    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInArrow(run, f"{given}, key array<long>").select(*words.columns, F.explode("key").alias("key"))


def fuzzy_lexicon(words: DataFrame, lexicon: DataFrame, distance: int = 2) -> DataFrame:
    """For each word (lower case) not in the lexicon its best entry within an edit distance: word, best, dist.

    Known words are indexed by what deletions leave of them, so that only words a
    few edits apart meet; those of more than SHORT letters by distance + 1 pieces,
    of which one at least is whole within the distance, as they would have some n
    squared keys. Words that meet are measured at once. Nearest first, then most
    frequent, then by name.
    """
    unknown = words.select("word").where("word IS NOT NULL").distinct().join(lexicon.select("word"), "word", "left_anti")
    known = lexicon.select(F.col("word").alias("best"), "freq").where("best IS NOT NULL")
    pairs = _keyed(unknown, "word", lookup_keys, distance).join(_keyed(known, "best", index_keys, distance), "key")
    pairs = pairs.where(F.abs(F.length("word") - F.length("best")) <= distance)
    near = pairs.withColumn("dist", F.levenshtein("word", "best", distance)).where("dist >= 0")
    return near.groupBy("word").agg(F.min(F.struct("dist", -F.col("freq"), "best")).alias("x")).select("word", "x.best", "x.dist")


#: Letters that recognition takes for each other.
CONFUSED = ("ao", "ec", "il", "nh", "uv", "rn", "tf", "gq", "mn", "bd")


def confusion_candidates(word: str, mates: dict[str, str]) -> dict[str, int]:
    """Words one edit away with their highest weight: a confused letter 2, a letter before its mate dropped 2, any letter dropped 0, a mate added 1."""
    found: dict[str, int] = {}

    def put(candidate: str, weight: int) -> None:
        if found.get(candidate, -1) < weight:
            found[candidate] = weight

    for i, letter in enumerate(word):
        before, after, near = word[:i], word[i + 1 :], mates.get(letter, "")
        for m in near:
            put(before + m + after, 2)
            put(before + letter + m + after, 1)
        put(before + after, 2 if after and after[0] in near else 0)
    return found


def _mates() -> dict[str, str]:
    out: dict[str, str] = {}
    for a, b in CONFUSED:
        out[a] = out.get(a, "") + b
        out[b] = out.get(b, "") + a
    return dict(sorted(out.items()))


def confusion_correct(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word and best for unknown words of four letters or more: the heaviest candidate, ties by strictly higher frequency; none if still tied."""
    unknown = words.select("word").where("length(word) >= 4").distinct().join(lexicon.select("word"), "word", "left_anti")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mates = _mates()
        for batch in rows:
            candidates, weights, ends = [], [], [0]
            for word in batch.column(0).to_pylist():
                found = confusion_candidates(word, mates)
                candidates += found
                weights += found.values()
                ends.append(len(candidates))
            both = pa.StructArray.from_arrays([pa.array(candidates, pa.string()), pa.array(weights, pa.int32())], ["candidate", "weight"])
            yield batch.append_column("c", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both))

    made = unknown.mapInArrow(run, "word string, c array<struct<candidate: string, weight: int>>").select("word", F.inline("c"))
    known = made.join(lexicon.withColumnRenamed("word", "candidate"), "candidate")
    w = Window.partitionBy("word").orderBy(F.desc("weight"), F.desc("freq"))
    ranked = known.withColumn("r", F.rank().over(w)).where("r = 1")
    return ranked.groupBy("word").agg(F.count("*").alias("ties"), F.min("candidate").alias("best")).where("ties = 1").select("word", "best")


def _edges(words: DataFrame, lexicon: DataFrame, longest: int) -> DataFrame:
    """word and edges: places and lengths of lexicon words inside it. A word has as many as it has substrings at most."""
    parts = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")).select("word", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("at") + 1))).alias("n"))
    parts = parts.withColumn("piece", F.expr("substr(word, at, n)"))
    found = parts.join(lexicon.select(F.col("word").alias("piece"), "often"), "piece")
    return found.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("at", "n", "often"))).alias("edges"))


#: Bits of a sieve for each of its words, hashes of a word, and bits at most (16 MB).
SIEVE_BITS, SIEVE_HASHES, MOST_BITS = 24, 5, 1 << 27
_ODD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, stirred."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """Hashes of all pieces of a batch of words, from sums over their letters."""

    def __init__(self, words: list[str]) -> None:
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.sizes)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        #: Letters of the word from each place on.
        self.left = np.repeat(self.ends, self.sizes) - np.arange(len(letters))
        powers = np.full(len(letters), _ODD, np.uint64)
        back = np.full(len(letters), pow(_ODD, -1, 1 << 64), np.uint64)
        powers[:1] = back[:1] = 1
        self.back = np.cumprod(back)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((letters + np.uint64(1)) * np.cumprod(powers), dtype=np.uint64)))

    def hashes(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return _mixed((self.sums[at + n] - self.sums[at]) * self.back[at])


def _places(hashes: np.ndarray, often: bool, bits: int) -> Iterator[np.ndarray]:
    """The sieve's bits of words: of those known, or those known as frequent."""
    other = _mixed(hashes + np.uint64(2 if often else 1)) | np.uint64(1)
    for k in range(SIEVE_HASHES):
        yield (hashes + np.uint64(k) * other) & np.uint64(bits - 1)


def _sieve(lexicon: DataFrame) -> np.ndarray:
    """Bytes with the bits of the lexicon's words, of bounded size: it passes all of them and few others."""
    n = lexicon.count()
    bits = 1 << 15
    while bits < min(MOST_BITS, SIEVE_BITS * n):
        bits *= 2

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            own = Pieces(batch.column("word").to_pylist())
            some = np.flatnonzero(own.sizes)
            hashes = own.hashes((own.ends - own.sizes)[some], own.sizes[some])
            frequent = hashes[batch.column("often").to_numpy(zero_copy_only=False)[some].astype(bool)]
            for found in (*_places(hashes, False, bits), *_places(frequent, True, bits)):
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64) + 1)], ["bit"])

    found = lexicon.mapInArrow(run, "bit long").groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("held")).collect()
    out = np.zeros((bits >> 15, 4096), np.uint8)
    for r in found:
        out[r["bucket"] - 1] = np.frombuffer(r["held"], np.uint8)
    return out.reshape(-1)


def _passed(sieve: np.ndarray, hashes: np.ndarray, often: bool) -> np.ndarray:
    """Which of the hashes have all their bits in the sieve."""
    at = np.arange(len(hashes))
    for k in range(SIEVE_HASHES):
        other = _mixed(hashes[at] + np.uint64(2 if often else 1)) | np.uint64(1)
        place = (hashes[at] + np.uint64(k) * other) & np.uint64(len(sieve) * 8 - 1)
        at = at[(sieve[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(hashes), bool)
    out[at] = True
    return out


def _taken_apart(words: DataFrame, lexicon: DataFrame, longest: int, parts, exact) -> DataFrame:
    """word and parts, the best that `parts` makes of the pieces that pass the lexicon's sieve, or of the true ones where one that it chose isn't known.

    What passes holds all true pieces at their true cost or less. So a best choice
    that is true is the best of the true ones too, and only its own pieces meet the
    lexicon, not all of a word's. Few words have a wrong one: those go to `exact`.

    lexicon: word and often, cut. parts(word, edges as (place, length, often) from the
    last place): pieces and whether each is frequent, NULL where it needs no lexicon.
    """
    sieve = _sieve(lexicon)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(0).to_pylist()
            own = Pieces(texts)
            places, lengths, frequent = [], [], []
            for n in range(1, longest + 1):
                at = np.flatnonzero(own.left >= n)
                hashes = own.hashes(at, n)
                good = _passed(sieve, hashes, False)
                places.append(at[good])
                lengths.append(np.full(len(places[-1]), n))
                frequent.append(_passed(sieve, hashes[good], True))
            place, length, often = map(np.concatenate, (places, lengths, frequent))
            order = np.argsort(-place, kind="stable")
            place, length, often = place[order], length[order], often[order]
            starts = own.ends - own.sizes
            firsts = np.searchsorted(-place, -own.ends, side="right")
            lasts = np.searchsorted(-place, -starts, side="right")
            made = []
            for word, start, a, b in zip(texts, starts.tolist(), firsts.tolist(), lasts.tolist(), strict=True):
                made.append(parts(word, zip((place[a:b] - start).tolist(), length[a:b].tolist(), often[a:b].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.list_(pa.string())), pa.array([m[1] for m in made], pa.list_(pa.bool_()))], ["word", "parts", "often"])

    made = cut(words.mapInArrow(run, "word string, parts array<string>, often array<boolean>").where("size(parts) > 0"))
    chosen = made.select("word", F.explode(F.arrays_zip("parts", "often")).alias("x")).select("word", F.col("x.parts").alias("piece"), F.col("x.often").alias("often")).where("often IS NOT NULL")
    wrong = cut(chosen.join(lexicon.select(F.col("word").alias("piece"), "often"), ["piece", "often"], "left_anti").select("word").distinct())
    right = made.join(wrong, "word", "left_anti").select("word", F.array_join("parts", " ").alias("parts"))
    return right.unionByName(exact(wrong, lexicon))


def _cheapest(word: str, edges) -> tuple[list[str], list[bool]]:
    """The pieces of the cheapest split and whether each is frequent; none if there is no split in two or more."""
    # The rest of a word from each place on: cost, words, and the first one's length (negative, so that more is less).
    best: list[tuple[int, int, int, bool] | None] = [None] * len(word) + [(0, 0, 0, False)]
    for a, n, often in edges:
        rest = best[a + n]
        # The word itself is unknown, also where it passes a sieve.
        if rest is not None and n < len(word):
            made = (rest[0] + 1 + 2 * max(0, 3 - n) - 2 * often, rest[1] + 1, -n, often)
            if best[a] is None or made < best[a]:
                best[a] = made
    pieces, frequent, at = [], [], 0
    while best[0] is not None and at < len(word):
        pieces.append(word[at : at - best[at][2]])
        frequent.append(best[at][3])
        at -= best[at][2]
    return (pieces, frequent) if len(pieces) > 1 else ([], [])


def split_glued(words: DataFrame, lexicon: DataFrame, frequent: int = 20, least: int = 6, longest: int = 20) -> DataFrame:
    """word and parts for unknown words of `least` letters or more that known words make up.

    A part costs 1 + 2 max(0, 3 - length), 2 less if it is frequent; the cheapest
    split wins, then the one of fewer words, then the one whose first parts are
    longer. The work for a word grows with its letters times `longest`.
    """
    known = cut(lexicon.where("word IS NOT NULL").groupBy("word").agg(F.max(F.col("freq") >= frequent).alias("often")))
    unknown = words.select("word").distinct().where(F.length("word") >= least).join(known.select("word"), "word", "left_anti")

    def exact(rest: DataFrame, known: DataFrame) -> DataFrame:
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                out = []
                for word, edges in zip(batch.column("word").to_pylist(), batch.column("edges").to_pylist(), strict=True):
                    out.append(" ".join(_cheapest(word, ((e["at"] - 1, e["n"], e["often"]) for e in reversed(edges)))[0]) or None)
                kept = batch.select(["word"]).append_column("parts", pa.array(out, pa.string()))
                yield kept.filter(pa.array([x is not None for x in out]))

        return _edges(rest, known, longest).mapInArrow(run, "word string, parts string")

    return _taken_apart(unknown, known, longest, _cheapest, exact)


def _furthest(word: str, edges) -> tuple[list[str], list[bool | None]]:
    """From the left the longest piece at each place, else one letter, which needs no lexicon."""
    far = [1] * len(word)
    for a, n, _ in edges:
        far[a] = max(far[a], n)
    pieces, at = [], 0
    while at < len(word):
        pieces.append(word[at : at + far[at]])
        at += far[at]
    return pieces, [False if len(p) > 1 else None for p in pieces]


def longest_match(words: DataFrame, lexicon: DataFrame, longest: int = 20) -> DataFrame:
    """word and parts: from the left the longest known word, else one letter."""
    known = cut(lexicon.where("word IS NOT NULL").select("word", F.lit(False).alias("often")).distinct())
    words = words.select("word").where("length(word) > 0").distinct()

    def exact(rest: DataFrame, known: DataFrame) -> DataFrame:
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                both = zip(batch.column("word").to_pylist(), batch.column("edges").to_pylist(), strict=True)
                out = [" ".join(_furthest(word, ((e["at"] - 1, e["n"], False) for e in edges or ()))[0]) for word, edges in both]
                yield batch.select(["word"]).append_column("parts", pa.array(out, pa.string()))

        return rest.join(_edges(rest, known, longest), "word", "left").mapInArrow(run, "word string, parts string")

    return _taken_apart(words, known, longest, _furthest, exact)


def lexicon_union(*sources: DataFrame) -> DataFrame:
    """src and dst of dictionaries, an earlier one first."""
    tagged = [s.select("src", "dst", F.lit(i).alias("priority")) for i, s in enumerate(sources)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    return both.groupBy("src").agg(F.min_by("dst", F.struct("priority", "dst")).alias("dst"))


def correct_spelling(docs: DataFrame, lexicon: DataFrame, distance: int = 2, least: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each unknown Latin word of `least` letters or more in its best known form within the distance, its case kept.

    Words with a hyphen or an apostrophe inside stay. docs has one row a key.
    """
    word = r"((?<![\p{L}\p{N}'-])[A-Za-z]{%d,}(?![\p{L}\p{N}'-]))" % least
    asked = docs.select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(word), 1), F.lower))).alias("word"))
    best = fuzzy_lexicon(asked.select("word"), lexicon, distance).select("word", "best")
    found = asked.join(best, "word").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "best"))).alias("_known"))
    put = T.put_known(F.col(text), "LN", "'-", F.col("_known"))
    return docs.join(found, key, "left").withColumn(text, put).drop("_known")


#: Letters that may have a sound: their table is a literal in the plan.
MOST_SOUNDS = 1000


def transcribe(words: DataFrame, sounds: DataFrame, after: dict[str, str], consonants: str) -> DataFrame:
    """word and sounds: each letter's sound (c, sound), or the one that `after` has for it behind a consonant; other letters stay."""
    held = sounds.select("c", "sound").limit(MOST_SOUNDS + 1).collect()
    if len(held) > MOST_SOUNDS:
        raise ValueError(f"more than {MOST_SOUNDS} letters with a sound")
    known, behind = T.literal_map({r["c"]: r["sound"] for r in held}), T.literal_map(after)
    letter = lambda i: F.substr("word", i, F.lit(1))
    one = lambda i: F.coalesce(F.when((i > 1) & F.contains(F.lit(consonants), letter(i - 1)), behind[letter(i)]), known[letter(i)], letter(i))
    return words.select("word", F.array_join(F.transform(F.sequence(F.lit(1), F.length("word")), one), "").alias("sounds"))
