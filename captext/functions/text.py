"""Text functions over Columns. NULL in, NULL out; what isn't a Plain function or one of known words, scripts or ramps stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

CYRILLIC = "[А-Яа-яЁё]"
LATIN = "[A-Za-z]"
#: The digit that each look-alike letter stands for.
LOOKALIKE_LETTERS, LOOKALIKE_DIGITS = "liosbgze", "11058923"
#: Latin letters and the Cyrillic ones drawn alike, the other way round, and Ukrainian letters in Russian.
HOMOGLYPH_LATIN, HOMOGLYPH_CYRILLIC = "aceopxyABCEHKMOPTXYUuiI", "асеорхуАВСЕНКМОРТХУУуіІ"
CYRILLIC_LOOKALIKE, LATIN_LOOKALIKE = "асеорхуАВСЕНКМОРТХУіІїЇєЄґҐёЁ", "aceopxyABCEHKMOPTXYiIiIeEgGeE"
UKRAINIAN, RUSSIAN = "ІіЇїЄє", "ИиЫыЕе"
#: Any letter of the Cyrillic blocks.
CYRILLIC_BLOCK = r"[\x{0400}-\x{052F}]"
#: Letters of one script without a look-alike in the other.
SURE_LATIN = "[bdfghjklmnqrstvwzDFGJLNQRSVWZ]"
SURE_CYRILLIC = "[бвгджзийклмнптфцчшщъыьэюяБГДЖЗИЙЛПУФЦЧШЩЪЫЬЭЮЯёЁ]"


def n_matches(text: Column, pattern: str) -> Column:
    """How often a pattern matches. For a class of characters what is left when the others go at once is measured, as Spark counts by an array of all matches."""
    if re.fullmatch(r"(?!\[\^\^)\[(?:[^\[\]\\&]|\\.)+\]|\\[pP]\{\w+\}", pattern):
        others = rf"[^{pattern}]" if pattern[0] == "\\" else f"[{pattern[2:]}" if pattern[1] == "^" else f"[^{pattern[1:]}"
        return F.length(F.regexp_replace(text, F.lit(others + "+"), F.lit("")))
    return F.regexp_count(text, F.lit(pattern))


def words(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(text, r"[ \t\n]+"), lambda w: w != "")


def normalise_key(text: Column) -> Column:
    """Lower case, punctuation to spaces, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", " "), r"\s+", " "))


def lookalike_key(text: Column) -> Column:
    """normalise_key with letters that look like digits as those digits."""
    return F.translate(normalise_key(text), LOOKALIKE_LETTERS, LOOKALIKE_DIGITS)


def join_hyphens(text: Column) -> Column:
    """A word that a hyphen and a line break part is joined."""
    return F.regexp_replace(text, r"(\p{L})-[ \t]*\n[ \t]*(\p{L})", "$1$2")


class Plain:
    """A function of texts in Python as one of Columns; make() gives it in a worker. Several can be done in one go, see in_turn()."""

    def __init__(self, make: Callable[[], Callable[[str], str]], says: str = "") -> None:
        self.make, self.__doc__ = make, says

    def __call__(self, text: Column) -> Column:
        import pyarrow as pa

        make = self.make

        def run(batches):
            change = make()
            for texts in batches:
                yield pa.array([None if t is None else change(t) for t in texts.to_pylist()], pa.string())

        return F.arrow_udf(_typed(run), "string")(text)


def in_turn(text: Column, steps: list[tuple[str, Plain]]) -> Column:
    """`text` after all steps, and `changed`, the names of those that changed it; none for a NULL text."""
    import pyarrow as pa

    makers = [(name, step.make) for name, step in steps]

    def run(batches):
        changes = [(name, make()) for name, make in makers]
        for texts in batches:
            out, names, ends = [], [], [0]
            for t in texts.to_pylist():
                if t is not None:
                    for name, change in changes:
                        after = change(t)
                        if after != t:
                            names.append(name)
                            t = after
                out.append(t)
                ends.append(len(names))
            changed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()))
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), changed], ["text", "changed"])

    return F.arrow_udf(_typed(run), "struct<text: string, changed: array<string>>")(text)


def _joined_hyphens() -> Callable[[str], str]:
    broken = re.compile(r"-[ \t]*\n[ \t]*")

    def change(t: str) -> str:
        out, last, used = [], 0, 0
        for m in broken.finditer(t):
            a, b = m.span()
            # A letter that ended one match doesn't begin the next.
            if a > used and b < len(t) and t[a - 1].isalpha() and t[b].isalpha():
                out.append(t[last:a])
                last, used = b, b + 1
        return "".join([*out, t[last:]]) if out else t

    return change


hyphens_joined = Plain(_joined_hyphens, "join_hyphens() in Python.")


def _spaced() -> Callable[[str], str]:
    # White space is that of Java's patterns.
    breaks, dots = re.compile(r" +\n *|\n +"), re.compile(r"\.{3,}")
    marks, opens = re.compile(r"[ \t\n\x0b\f\r]+([,.!?;:])"), re.compile(r"([(\[«])[ \t\n\x0b\f\r]+")

    def change(t: str) -> str:
        t = t.replace("\t", " ")
        while "  " in t:
            t = t.replace("  ", " ")
        if " \n" in t or "\n " in t:
            t = breaks.sub("\n", t)
        if "..." in t:
            t = dots.sub("…", t)
        return opens.sub(r"\1", marks.sub(r"\1", t)).strip(" ")

    return change


normalise_space = Plain(_spaced, "Single spaces, none around line breaks or before marks, dots as an ellipsis.")


def trim_decimals(text: Column, comma: bool = False) -> Column:
    """Zeros that end a decimal fraction go; with `comma` also after a decimal comma."""
    mark = "[.,]" if comma else r"\."
    text = F.regexp_replace(text, rf"\b(\d+){mark}0+\b", "$1")
    return F.regexp_replace(text, rf"\b(\d+{mark}\d*[1-9])0+\b", "$1")


def letters_between_digits(text: Column) -> Column:
    """I, l and | between digits are 1, O is 0."""
    return F.regexp_replace(F.regexp_replace(text, r"(\d)[Il|](\d)", "$11$2"), r"(\d)[OoОо](\d)", "$10$2")


def strip_edges(text: Column) -> Column:
    return F.regexp_replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.!?…]+$", "")


def reattach_marks(text: Column) -> Column:
    """Marks that start a token belong to the word before."""
    return F.regexp_replace(text, r"([\p{L}\p{N}]) ([,.!?:;]+)([\p{L}\p{N}])", "$1$2 $3")


def pause_dots(line: Column) -> Column:
    """A line of three long words or more without marks gets a dot after each word of more than five letters but the last."""

    def dotted(w: Column) -> Column:
        mean = F.length(F.array_join(w["all"], "")) / w["n"]
        put = F.transform(w["all"], lambda x, i: F.when((F.length(x) > 5) & (i < w["n"] - 1), F.concat(x, F.lit("."))).otherwise(x))
        return F.when(line.rlike(r"[.,!?;:…]") | (w["n"] < 3) | (mean < 5), line).otherwise(F.array_join(put, " "))

    # One struct an array, so that the words are made once a line.
    made = F.transform(F.array(words(line)), lambda x: F.struct(x.alias("all"), F.size(x).alias("n")))
    return F.transform(made, dotted)[0]


def sentences(text: Column) -> Column:
    """Sentences with their end marks; line breaks end one too."""
    found = F.regexp_extract_all(text, F.lit(r"([^.!?…\n]+[.!?…]*)"), 1)
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def phrases(text: Column, most: int = 80) -> Column:
    """Sentences parted by white space after an end mark or an empty line; those beyond `most` characters at commas too."""
    parts = _trimmed(F.split(F.regexp_replace(text, r"([.!?])\s+|\n{2,}", "$1\x01"), "\x01"))
    commas = lambda s: F.split(F.regexp_replace(s, r"(,)\s+", "$1\x01"), "\x01")
    return F.flatten(F.transform(parts, lambda s: F.when(F.length(s) > most, _trimmed(commas(s))).otherwise(F.array(s))))


def ended_sentences(text: Column) -> Column:
    """Sentences that run on over line breaks up to their end marks; what follows the last mark is one too."""
    return _trimmed(F.regexp_extract_all(text, F.lit(r"([^.!?…]*[.!?…]+|[^.!?…]+$)"), 1))


def chunks(text: Column, most: int = 200) -> Column:
    """Structs (chunk, kind): sentences and lines joined up to `most` characters; an end mark closes a chunk.

    A part longer than `most` is a chunk of its own. kind is question if the last
    part has a question mark (the whole chunk if a line or the length closed it),
    else exclamation if it has such a mark, else statement.
    """
    parts = _trimmed(F.split(F.regexp_replace(text, r"([.!?…])\s+|\n+", "$1\x01"), "\x01"))
    kind = lambda s: F.when(s.contains("?"), "question").when(s.contains("!"), "exclamation").otherwise("statement")
    one = lambda chunk, of: F.array(F.struct(chunk.alias("chunk"), kind(of).alias("kind")))
    none = F.expr("cast(array() AS array<struct<chunk: string, kind: string>>)")

    def step(state: Column, part: Column) -> Column:
        full = (state["held"] != "") & (F.length(state["held"]) + F.length(part) > most)
        done = F.when(full, F.concat(state["done"], one(state["held"], state["held"]))).otherwise(state["done"])
        held = F.when(full | (state["held"] == ""), part).otherwise(F.concat(state["held"], F.lit(" "), part))
        closed = part.rlike(r"[.!?…]$")
        return F.struct(F.when(closed, F.concat(done, one(held, part))).otherwise(done).alias("done"), F.when(closed, "").otherwise(held).alias("held"))

    start = F.struct(none.alias("done"), F.lit("").alias("held"))
    return F.aggregate(parts, start, step, lambda state: F.when(state["held"] != "", F.concat(state["done"], one(state["held"], state["held"]))).otherwise(state["done"]))


def sentence_type(sentence: Column) -> Column:
    return F.when(sentence.rlike(r"\?\s*$"), "question").when(sentence.rlike(r"!\s*$"), "exclamation").otherwise("statement")


def script_runs(text: Column) -> Column:
    """Runs of Cyrillic and of Latin letters; what is neither joins the run on its left."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"({CYRILLIC}[^A-Za-z]*|{LATIN}[^А-Яа-яЁё]*)"), 1), lambda s: F.struct(F.when(s.rlike(CYRILLIC), "ru").otherwise("en").alias("lang"), F.trim(s).alias("run")))


def speaker(line: Column) -> Column:
    """The name in `name: text`, `name> text`, `[name] text` or `(name) text`; NULL if there is none."""
    found = [F.regexp_extract(line, p, 1) for p in (r"^\s*\[([^\]\[]{1,30})\]\s*\S", r"^\s*\(([^()]{1,30})\)\s*\S", r"^\s*([\p{L}\p{N}_ ]{1,30})\s*[:>]\s*\S")]
    return F.coalesce(*(F.when(f != "", F.trim(f)) for f in found))


def pause_marks(text: Column) -> Column:
    """A pause in milliseconds after marks."""
    for pattern, to in ((r"(\.\.\.|…)", "$1<600>"), (r"([.!?])( |\n|$)", "$1<500>$2"), (r"([;:])( |\n|$)", "$1<300>$2"), (r"(,)( |\n|$)", "$1<200>$2")):
        text = F.regexp_replace(text, pattern, to)
    return text


def is_valid_text(text: Column) -> Column:
    """Recognised text worth keeping: letters, few digits and symbols, no date or time, not only scraps."""
    t = F.trim(F.coalesce(text, F.lit("")))
    letters = n_matches(t, r"\p{L}")
    special = n_matches(t, r"[^\p{L}\p{N}\s.,!?\-:;'\"()]")
    return (
        (F.length(t) >= 3) & ~t.contains("�") & (letters > 0) & (n_matches(t, r"\p{Nd}") <= letters)
        & ~t.rlike(r"\d{4}[-/.]\d{2}[-/.]\d{2}") & ~t.rlike(r"\d{1,2}:\d{2}") & (special <= letters * 0.4) & F.exists(words(t), lambda w: F.length(w) > 2)
    )


def is_utterance(line: Column, min_words: int = 1) -> Column:
    t = normalise_key(F.coalesce(line, F.lit("")))
    w = words(t)
    short = F.size(F.filter(w, lambda x: F.length(x) <= 1))
    return (F.length(t) >= 3) & F.size(w).between(min_words, 24) & (short <= F.size(w) * 0.45) & (n_matches(t, r"\p{L}") >= 3)


def garbage_rule(line: Column) -> Column:
    """The first rule that marks a recognised line as garbage, NULL if none does."""

    def rule(x: Column) -> Column:
        s, letters, cyrillic, latin, w = x["s"], x["letters"], x["cyrillic"], x["latin"], x["w"]
        noisy = F.size(F.filter(w, lambda y: y.rlike(r"[~_{}\[\]\\]") | (n_matches(y, r"[^\p{L}\p{N}_]") > 1)))
        return (
            F.when(F.length(s) <= 2, "short")
            .when((letters < 2) & (F.length(s) <= 5), "few_letters")
            .when((letters < 4) & (n_matches(s, r"[|~`{}<>\[\]\\^_]") > letters), "junk")
            .when(s.rlike(r"[\x{3040}-\x{30FF}]"), "kana")
            .when(s.rlike(r"[\x{0600}-\x{06FF}]"), "arabic")
            .when(s.rlike(r"[\x{4E00}-\x{9FFF}]"), "han")
            .when((cyrillic > 0) & (latin > 0) & (letters >= 3) & (F.abs(cyrillic - latin) <= 2), "mixed")
            .when(s.rlike(rf"{CYRILLIC}\d{CYRILLIC}"), "digit_inside")
            .when(s.rlike(rf"\d{CYRILLIC}\d"), "letter_inside")
            .when(s.rlike(r"[^\p{L}\p{N}\s]") & F.transform(F.array(noisy), lambda k: (k > 0) & (k >= F.size(w) * 0.5))[0], "noisy_words")
            .when((letters < 3) & s.rlike(r"[\x{1F300}-\x{1FAFF}]"), "emoji")
        )

    # One struct an array, so that the counts are made once a line.
    s = F.trim(line)
    made = F.struct(s.alias("s"), n_matches(s, r"\p{L}").alias("letters"), n_matches(s, CYRILLIC).alias("cyrillic"), n_matches(s, "[a-z]").alias("latin"), words(s).alias("w"))
    return F.transform(F.array(made), rule)[0]


def strip_icon(line: Column) -> Column:
    """A line without a single letter (or letter and dot) that an icon left before it."""
    return F.regexp_replace(F.trim(line), r"^[B-HJ-Zb-hj-z]\.? +(\S{2})", "$1")


def keep_good_tokens(line: Column) -> Column:
    """Tokens with a Cyrillic or Latin letter, or of marks and digits only."""
    return F.array_join(F.filter(words(line), lambda w: w.rlike("[А-Яа-яЁёA-Za-z]") | w.rlike(r"^[.,!?;:\-'\"()—–…/0-9]+$")), " ")


def acceptable_script(text: Column) -> Column:
    """Every word, without marks at its ends, has letters only, or letters of both scripts."""
    bare = F.transform(words(text), lambda w: F.regexp_replace(w, r"^[.,!?;:—–-]+|[.,!?;:—–-]+$", ""))
    good = lambda w: (w == "") | w.rlike("^([А-Яа-яЁё]+|[A-Za-z]+)$") | (w.rlike(CYRILLIC) & w.rlike(LATIN))
    return (F.length(text) > 0) & F.forall(bare, good)


def keep_script(text: Column, letters: str) -> Column:
    """Only the characters of a class, digits and marks; the text itself if nothing else is left."""
    kept = F.trim(F.regexp_replace(text, rf"[^{letters}0-9 .,!?;:\-'\"()—–\n]+", ""))
    # An array of it, so that it is made once a text.
    return F.transform(F.array(kept), lambda k: F.when(F.length(k) > 0, k).otherwise(F.trim(text)))[0]


def strip_log_noise(line: Column) -> Column:
    """A log line without its time, level, module and number; NULL if it is Cyrillic or has no two Latin letters in a row."""
    s = F.trim(line)
    for p in (r"^\d{1,2}[-/]\d{1,2}\s+\d{1,2}:\d{2}(:\d{2})?[.,]?\d*\s*", r"^\d{1,2}:\d{2}(:\d{2})?[.,]?\d*\s*", r"^\[?(INFO|DEBUG|ERROR|WARNING|TRACE)\]?\s*", r"^[a-z_]+\s*-\s*", r"^[-\d]+\s*"):
        s = F.regexp_replace(s, p, "")
    return F.when(~line.rlike(CYRILLIC) & s.rlike("[A-Za-z]{2,}"), F.trim(s))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b\[[0-9;?]*[A-Za-z]", "")


def script_share(text: Column, letters: str) -> Column:
    """Share of a class among the letters; 0 without a letter."""
    n = n_matches(text, r"\p{L}")
    return F.when(n > 0, n_matches(text, letters) / n).otherwise(F.lit(0.0))


#: Words that vote where no letter decides: English ones, and Russian ones in Latin letters.
ENGLISH = ("the", "and", "of", "to", "is", "in", "that", "it", "for", "with", "you", "this")
RUSSIAN_IN_LATIN = ("privet", "spasibo", "net", "kak", "chto", "eto", "kto", "gde", "ty", "vy")


def detect_language(text: Column) -> Column:
    """Language by ordered rules: script, then marks, then a vote of known words, English where it is even."""
    low = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)
    votes = lambda known: F.size(F.filter(low, lambda w: w.isin(*known)))
    return (
        F.when(text.rlike(CYRILLIC), "ru")
        .when(text.rlike(r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"), "ja")
        .when(text.rlike("[äöüßÄÖÜ]"), "de")
        .when(text.rlike("[àâçéèêëïîôùûÿœæ]"), "fr")
        .when(F.size(low) == 0, "auto")
        .when(votes(RUSSIAN_IN_LATIN) > votes(ENGLISH), "ru")
        .otherwise("en")
    )


def long_enough(text: Column, shortest: int = 3, letters: int = 2) -> Column:
    """Whether a line has `shortest` characters and `letters` letters."""
    return (F.length(text) >= shortest) & (n_matches(text, r"\p{L}") >= letters)


def main_script(text: Column, share: float = 0.3) -> Column:
    """ru where more than `share` of the letters are Cyrillic, else en."""
    return F.when(n_matches(text, r"[\x{0400}-\x{04FF}]") > n_matches(text, r"\p{L}") * share, "ru").otherwise("en")


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words over the larger set; 0 if either has none."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)) for c in (a, b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(F.lit(0.0))


def _run(letter: str, sure: str) -> str:
    """Two letters or more with a sure one among them."""
    return f"({letter}+{sure}{letter}*|{sure}{letter}+)"


#: A Latin and a Cyrillic run that touch, and the other way round.
GLUED = (_run(LATIN, SURE_LATIN) + _run(CYRILLIC_BLOCK, SURE_CYRILLIC), _run(CYRILLIC_BLOCK, SURE_CYRILLIC) + _run(LATIN, SURE_LATIN))


#: Answers that a task keeps while it repairs tokens.
KEPT = 200_000


def _repair(tie: str | None):
    """repair_homoglyphs() of one token, with the last answers kept."""
    from functools import lru_cache

    of = lambda pattern: re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), pattern))
    # Of letters named twice the first counts.
    table = lambda a, b: str.maketrans(dict(reversed(list(zip(a, b, strict=True)))))
    latin, cyrillic, sure_latin, sure_cyrillic = of(LATIN), of(CYRILLIC_BLOCK), of(SURE_LATIN), of(SURE_CYRILLIC)
    runs = re.compile(f"{latin.pattern}+|{cyrillic.pattern}+|.", re.DOTALL)
    to_latin, to_cyrillic, russian = table(CYRILLIC_LOOKALIKE, LATIN_LOOKALIKE), table(HOMOGLYPH_LATIN, HOMOGLYPH_CYRILLIC), table(UKRAINIAN, RUSSIAN)

    @lru_cache(KEPT)
    def repair(token: str) -> str:
        if not cyrillic.search(token):
            return token
        if sure_latin.search(token) and sure_cyrillic.search(token):
            # GLUED run by run, as its patterns go back and forth over a long one.
            parts, last = [], None
            for run in runs.findall(token):
                script = None if len(run) < 2 else "en" if sure_latin.search(run) else "ru" if sure_cyrillic.search(run) else None
                parts += [" ", run] if script and last and script != last else [run]
                last = script
            if " " in parts and (parted := "".join(parts)) != token:
                return parted.translate(russian)
        lead = len(sure_cyrillic.findall(token)) - len(sure_latin.findall(token))
        if not lead and not sure_latin.search(token):
            lead = len(cyrillic.findall(token)) - len(latin.findall(token))
        if lead > 0 or (lead == 0 and tie == "ru"):
            return token.translate(to_cyrillic).translate(russian)
        return token.translate(to_latin) if lead < 0 or tie == "en" else token

    return repair


def repair_homoglyphs(token: Column, tie: str | None = None) -> Column:
    """A token in the script that most of its letters without look-alikes have.

    Words of both scripts that a lost space glued together are parted. Where no
    letter is sure, all letters vote; where both scripts have as many, the token
    stays, or takes `tie` ("ru" or "en"). Ukrainian letters become Russian ones.
    """
    import pyarrow as pa

    def run(batches):
        repair = _repair(tie)
        for tokens in batches:
            distinct = tokens.dictionary_encode()
            answers = pa.array([None if t is None else repair(t) for t in distinct.dictionary.to_pylist()], pa.string())
            yield answers.take(distinct.indices)

    return F.arrow_udf(_typed(run), "string")(token)


def scripts_repaired(tie: str | None = None) -> Plain:
    """Every run that isn't white space repaired as by repair_homoglyphs(); white space stays."""

    def make() -> Callable[[str], str]:
        repair = _repair(tie)
        letter, white = re.compile("[\u0400-\u052f]"), re.compile(r"[ \t\n\x0b\f\r]")

        def change(t: str) -> str:
            # Only runs with a Cyrillic letter can change.
            out, last = [], 0
            while m := letter.search(t, last):
                a = m.start()
                while a > last and t[a - 1] not in " \t\n\x0b\f\r":
                    a -= 1
                b = e.start() if (e := white.search(t, m.end())) else len(t)
                out += (t[last:a], repair(t[a:b]))
                last = b
            return "".join([*out, t[last:]]) if out else t

        return change

    return Plain(make)


def repair_scripts(text: Column, tie: str | None = None) -> Column:
    """text with every run that isn't white space repaired as by repair_homoglyphs(); white space stays."""
    return scripts_repaired(tie)(text)


def _typed(run, columns: int = 1):
    """run with the annotations that make it a function of batches of so many columns."""
    from collections.abc import Iterator

    import pyarrow as pa

    run.__annotations__ = {"batches": Iterator[pa.Array if columns == 1 else tuple[(pa.Array,) * columns]], "return": Iterator[pa.Array]}
    return run


def restore_case(like: Column, word: Column) -> Column:
    """word in capitals, or with a capital first letter, as `like` is."""
    return F.when((F.length(like) > 1) & (F.upper(like) == like) & (F.lower(like) != like), F.upper(word)).when(F.substring(like, 1, 1) != F.lower(F.substring(like, 1, 1)), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1000))).otherwise(word)


def _cased(like: str, word: str) -> str:
    """restore_case() of two strings."""
    if len(like) > 1 and like.upper() == like and like.lower() != like:
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1] != like[:1].lower() else word


@cache
def _runs(kinds: str, others: str, all_runs: bool) -> tuple[re.Pattern, re.Pattern]:
    """Runs of characters of the general categories (first letters) `kinds` or of `others`, and with all_runs those between them: a quick pattern for texts of 16-bit characters, and one for all."""
    import unicodedata

    inside = [chr(i) for i in range(0x110000) if unicodedata.category(chr(i))[0] in kinds or chr(i) in others]

    def of(chars: list[str]) -> re.Pattern:
        ranges: list[list[str]] = []
        for c in chars:
            if ranges and ord(c) == ord(ranges[-1][1]) + 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        named = "".join(f"\\U{ord(a):08x}-\\U{ord(b):08x}" for a, b in ranges)
        return re.compile(f"[{named}]+|[^{named}]+" if all_runs else f"[{named}]+")

    return of([c for c in inside if c <= "\uffff"]), of(inside)


_WIDE = re.compile("[\U00010000-\U0010ffff]")


def runs_of(text: str, kinds: str, others: str = "", all_runs: bool = True) -> list[str]:
    """The runs of a text of characters of the categories `kinds` or of `others`, and with all_runs those of all the rest, which make up the text with them."""
    narrow, every = _runs(kinds, others, all_runs)
    return (every if _WIDE.search(text) else narrow).findall(text)


def distinct_words(text: Column, least: int) -> Column:
    """The distinct runs of `least` letters or more of a text in lower case."""
    import pyarrow as pa

    def run(batches):
        for texts in batches:
            found, ends = [], [0]
            for t in texts.to_pylist():
                if t is not None:
                    # Most tokens are a word as a whole.
                    tokens = dict.fromkeys(t.lower().split())
                    held = {w: None for w in tokens if len(w) >= least and w.isalpha()}
                    held |= {w: None for w in runs_of(" ".join([w for w in tokens if len(w) > least and not w.isalpha()]), "L", all_runs=False) if len(w) >= least}
                    found += held
                ends.append(len(found))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.string()))

    return F.arrow_udf(_typed(run), "array<string>")(text)


def _put_found(text: str, found: list[tuple[int, int]], put: Callable[[str], str]) -> str:
    """text with what stands at places that don't overlap replaced."""
    out, last = [], 0
    for a, b in sorted(found):
        out += (text[last:a], put(text[a:b]))
        last = b
    return "".join([*out, text[last:]]) if out else text


def _places_of(words: Iterable[str], text: str, low: str, inside: Callable[[str], bool]) -> list[tuple[int, int]]:
    """Where the runs of characters that are `inside` are one of the words; low is the text in lower case, character by character."""
    found = []
    for word in words:
        at = low.find(word) if word else -1
        while at >= 0:
            end = at + len(word)
            if not (at and inside(text[at - 1])) and not (end < len(text) and inside(text[end])) and all(map(inside, text[at:end])):
                found.append((at, end))
            at = low.find(word, at + 1)
    return found


#: Words up to which each is sought in a text by itself.
FEW_WORDS = 8


def _put_runs(text: str, kinds: str, others: str, held: dict[str, str]) -> str:
    def put(run: str) -> str:
        known = held.get(run.lower())
        return run if known is None else _cased(run, known)

    # No run holds a space, and most tokens are a run as a whole.
    tokens = text.split(" ")
    changed = {}
    for token in set(tokens):
        after = put(token) if token.isalpha() else "".join(map(put, runs_of(token, kinds, others)))
        if after != token:
            changed[token] = after
    return " ".join([changed.get(w, w) for w in tokens]) if changed else text


def put_known(text: Column, kinds: str, others: str, known: Column) -> Column:
    """text with each of its runs_of() that the map `known` has in lower case replaced, case restored; the text itself where known is NULL. kinds has "L"; no run holds a space.

    A map of Spark is searched entry by entry, so a row's runs meet a dictionary in an Arrow function, which also makes them:
    as an array they take several times the text.
    """
    import pyarrow as pa

    def run(batches):
        for texts, tables in batches:
            out = []
            for t, table in zip(texts.to_pylist(), tables, strict=True):
                if t is not None and table.is_valid:
                    t = _put_runs(t, kinds, others, {w: put for w, put in table.as_py() if put is not None})
                out.append(t)
            yield pa.array(out, pa.string())

    return F.arrow_udf(_typed(run, 2), "string")(text, known)


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(x for pair in sorted(pairs.items()) for x in (F.lit(pair[0]), F.lit(pair[1])))) if pairs else F.expr("cast(map() AS map<string, string>)")


def words_fixed(fixes: dict[str, str], compounds: dict[str, str] | None = None) -> Plain:
    """Runs of Latin letters in their right form, in any case, which stays; before that, compounds that recognition tore apart, longest first."""

    def make() -> Callable[[str], str]:
        from functools import lru_cache

        apart = sorted((compounds or {}).items(), key=lambda x: (-len(x[0]), x[0]))
        run_of = re.compile("[A-Za-z]+")
        letters = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")

        @lru_cache(KEPT)
        def fixed(word: str) -> str:
            put = fixes.get(word.lower())
            return word if put is None else _cased(word, put)

        def change(t: str) -> str:
            for wrong, right in apart:
                t = t.replace(wrong, right) if wrong else t
            if len(fixes) <= FEW_WORDS and len(low := t.lower()) == len(t):
                return _put_found(t, _places_of(fixes, t, low, letters.__contains__), fixed)
            return run_of.sub(lambda m: fixed(m[0]), t)

        return change

    return Plain(make)


def fix_words(text: Column, fixes: dict[str, str], compounds: dict[str, str] | None = None) -> Column:
    """See words_fixed()."""
    return words_fixed(fixes, compounds)(text)


def _kept_tokens() -> Callable[[str], str]:
    from functools import lru_cache

    # Tokens, or parts of them, without a letter.
    bare = re.compile(r"[^ \t\nА-Яа-яЁёA-Za-z]+")
    # As in Java's patterns a token may end with a line's end.
    marks = re.compile(r"[.,!?;:\-'\"()—–…/0-9]+[\r\u0085\u2028\u2029]?\Z")

    def change(t: str) -> str:
        out, last = [], 0
        for m in bare.finditer(t):
            a, b = m.span()
            if (a == 0 or t[a - 1] in " \t\n") and t[b : b + 1] in ("", " ", "\t", "\n") and not good(m[0]):
                out.append(t[last:a])
                last = b
        t = "".join([*out, t[last:]]).replace("\t", " ")
        while "  " in t:
            t = t.replace("  ", " ")
        return t.replace(" \n", "\n").replace("\n ", "\n").strip(" ")

    @lru_cache(KEPT)
    def good(word: str) -> bool:
        return bool(marks.match(word))

    return change


keep_tokens = Plain(_kept_tokens, "keep_good_tokens line by line.")


def lower_inner_capitals(token: Column) -> Column:
    """Capitals inside a word are lowered unless all letters are capitals or it is Latin camel case."""
    rest = F.substring(token, 2, 1000)
    camel = token.rlike("^[a-z]+[A-Z][a-z]+|^[A-Z][a-z]+[A-Z][a-z]+")
    capital = (F.upper(token) == token) | camel
    return F.when(capital, token).otherwise(F.concat(F.substring(token, 1, 1), F.lower(rest)))


def longest_ramp(token: Column) -> Column:
    """Characters of the longest strictly rising run of code points."""
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    points = F.transform(letters, F.ascii)
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(-1).alias("last"))

    def step(state: Column, point: Column) -> Column:
        run = F.when(point > state["last"], state["run"] + 1).otherwise(F.lit(1))
        return F.struct(run.alias("run"), F.greatest(state["best"], run).alias("best"), point.alias("last"))

    return F.aggregate(points, start, step, lambda state: state["best"])


def is_ramp(token: Column, letters: int = 8, rising: int = 10) -> Column:
    """A token of `letters` characters or more with `rising` code points in a row that each exceed the last: a decoder that slid along its table."""
    return (F.length(token) >= letters) & (longest_ramp(token) >= rising)


#: What separates tokens for ramps: white space and marks.
RAMP_BREAKS = r"""[\s,.\-!?;:"'()\[\]{}<>+/=…—–%№]+"""


def has_ramp(text: Column, letters: int = 8, rising: int = 10) -> Column:
    """Some token between RAMP_BREAKS is_ramp()."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        breaks = re.compile(RAMP_BREAKS, re.ASCII)

        def rises(text: str) -> Iterable[str]:
            """Rising runs of `rising` characters or more."""
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            ends = np.concatenate(([0], np.flatnonzero(codes[1:] <= codes[:-1]) + 1, [len(codes)]))
            some = np.flatnonzero(np.diff(ends) >= rising)
            return (text[ends[i] : ends[i + 1]] for i in some.tolist())

        def ramp(text: str) -> bool:
            if not any(len(w) >= rising for run in rises(text) for w in breaks.split(run)):
                return False
            return letters <= rising or any(len(w) >= letters and any(rises(w)) for w in breaks.split(text))

        for texts in batches:
            yield pa.array([None if t is None else ramp(t) for t in texts.to_pylist()], pa.bool_())

    return F.arrow_udf(_typed(run), "boolean")(text)


def common_words(a: Column, b: Column) -> Column:
    """How many words two texts share at their start."""
    x, y = words(a), words(b)
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(F.transform(same, lambda s: s.cast("int")), F.lit(0))
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(x), F.size(y)).cast("bigint")).cast("int")


def growth_tail(before: Column, now: Column) -> Column:
    """The words of now after those it shares with before at the start."""
    w = words(now)
    n = common_words(F.coalesce(before, F.lit("")), now)
    return F.array_join(F.slice(w, n + 1, F.greatest(F.size(w) - n, F.lit(0))), " ")


def strip_isolated_latin(text: Column) -> Column:
    """Up to three Latin letters that stand alone between Cyrillic words go."""
    return F.regexp_replace(text, r"(?<=[А-Яа-яЁё]) +[A-Za-z]{1,3}(?= +[А-Яа-яЁё])", "")


def keep_script_words(line: Column, letters: str) -> Column:
    """Of a line with a letter of the class its words that aren't Latin letters only; NULL for a line without one."""
    return F.when(line.rlike(f"[{letters}]"), F.array_join(F.filter(words(line), lambda w: w.rlike("[^A-Za-z]")), " "))


def failure_mark(text: Column) -> Column:
    """An answer in brackets: `failed` (it says so), `refused` (any other), NULL for none."""
    return F.when(text.rlike(r"^\s*\[.*failed.*\]\s*$"), "failed").when(text.rlike(r"^\s*\[.*\]\s*$"), "refused")


def untranslated(text: Column, target: str | Column = "ru") -> Column:
    """For a Cyrillic target: a lower-case Latin word is left."""
    return (F.lit(target) if isinstance(target, str) else target).isin("ru", "uk") & text.rlike(r"(^|[^A-Za-z])[a-z]{2,}($|[^A-Za-z])")


def translation_faults(text: Column, result: Column, leftovers: bool = True) -> dict[str, Column]:
    """Of a translation: empty, leftover (an ASCII word of three letters or more), same (over half of the words), thin (under 0.4 of the words)."""
    a, b = F.array_distinct(words(F.lower(text))), F.array_distinct(words(F.lower(result)))
    n, m = F.size(words(text)), F.size(words(result))
    return {
        "empty": F.trim(result) == "",
        "leftover": F.exists(words(result), lambda w: w.rlike("^[A-Za-z]{3,}$")) if leftovers else F.lit(False),
        "same": F.size(F.array_intersect(a, b)) > F.size(a) * 0.5,
        "thin": m < n * 0.4,
    }


def time_text(seconds: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss` of seconds since 1970."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")
