"""Spoken forms: what is read in place of abbreviations, units, ranges, drawn-out spellings and symbols, by language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations as they are written, and what is read for them.
ABBREVIATIONS = {
    "en": {"Dr.": "doctor", "Mr.": "mister", "Mrs.": "missis", "St.": "saint", "etc.": "and so on", "e.g.": "for example", "i.e.": "that is", "vs.": "versus", "approx.": "about", "No.": "number"},
    "de": {"Dr.": "Doktor", "Hr.": "Herr", "Fr.": "Frau", "z.B.": "zum Beispiel", "usw.": "und so weiter", "d.h.": "das heißt", "ca.": "etwa", "bzw.": "beziehungsweise", "Nr.": "Nummer", "Str.": "Straße"},
    "fr": {"Dr.": "docteur", "M.": "monsieur", "Mme.": "madame", "etc.": "et cetera", "p.ex.": "par exemple", "env.": "environ", "av.": "avenue", "St.": "saint"},
    "es": {"Dr.": "doctor", "Sr.": "señor", "Sra.": "señora", "etc.": "etcétera", "p.ej.": "por ejemplo", "aprox.": "aproximadamente", "Ud.": "usted", "pág.": "página"},
    "ru": {"т.д.": "так далее", "т.п.": "тому подобное", "т.е.": "то есть", "т.к.": "так как", "вкл.": "включить", "выкл.": "выключить", "стр.": "страница", "др.": "другие"},
}
#: Units behind a number.
UNITS = {
    "en": {"km": "kilometres", "cm": "centimetres", "mm": "millimetres", "kg": "kilograms", "mg": "milligrams", "ml": "millilitres", "min": "minutes", "sec": "seconds", "hrs": "hours", "mph": "miles an hour", "%": "percent"},
    "de": {"km": "Kilometer", "cm": "Zentimeter", "mm": "Millimeter", "kg": "Kilogramm", "mg": "Milligramm", "ml": "Milliliter", "Min": "Minuten", "Sek": "Sekunden", "Std": "Stunden", "%": "Prozent"},
    "fr": {"km": "kilomètres", "cm": "centimètres", "mm": "millimètres", "kg": "kilogrammes", "mg": "milligrammes", "ml": "millilitres", "min": "minutes", "sec": "secondes", "%": "pour cent"},
    "es": {"km": "kilómetros", "cm": "centímetros", "mm": "milímetros", "kg": "kilogramos", "mg": "miligramos", "ml": "mililitros", "min": "minutos", "seg": "segundos", "%": "por ciento"},
    "ru": {"км": "километров", "см": "сантиметров", "мм": "миллиметров", "кг": "килограмм", "мл": "миллилитров", "мин": "минут", "сек": "секунд", "г": "грамм", "%": "процентов"},
}
#: What stands between the ends of a range, and letters that are drawn out in exclamations.
BETWEEN = {"en": "to", "de": "bis", "fr": "à", "es": "a", "ru": "до"}
DRAWN_OUT = {"en": "hm ah oh", "de": "hm ah oh", "fr": "hm ah oh", "es": "hm ah ay", "ru": "хм ах ох"}

#: A place where no word goes on, in letters of any script. Spark and DuckDB agree on it, unlike on \\b.
FRONT, BACK = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
#: What FRONT finds before a match without taking it, for Spark: also there a match's last character is not the one before the next.
#: Java looks back by whole characters beyond U+FFFF only where the class names one.
START = "(?:^|(?<![\\p{L}\\p{N}_\U0001d400])(?!\\G))"


def _rules(lang: str, abbreviations: dict[str, str] | None = None, units: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
    """spoken_rules() with characters that stand in every match of a pattern."""
    import re

    short = ABBREVIATIONS[lang] | (abbreviations or {})
    rules = [(r"(\d)\s*[-–—]\s*(\d)", rf"$1 {BETWEEN[lang]} $2", "")]
    for key in sorted(short, key=lambda k: (-len(k), k)):
        first = key[0]
        either = f"[{first.upper()}{first.lower()}]" if first.upper() != first.lower() else re.escape(first)
        rules.append((FRONT + either + re.escape(key[1:]), f"$1{short[key]}", key[1:]))
    more = UNITS[lang] | (units or {})
    for key in sorted(more, key=lambda k: (-len(k), k)):
        rules.append((rf"(\d) ?{re.escape(key)}{BACK}", f"$1 {more[key]}$2", key))
    for word in DRAWN_OUT[lang].split():
        a, b = word
        rules.append((rf"{FRONT}([{a.upper()}{a}]){b}{{2,}}", f"$1$2{b}", 2 * b))
    return [*rules, (r"[|*#_~<>]+", " ", ""), (r"\s{2,}", " ", "")]


def spoken_rules(lang: str, abbreviations: dict[str, str] | None = None, units: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """Patterns and what replaces them for a language, in the order in which they apply; given tables are added to its own."""
    return [(pattern, to) for pattern, to, _ in _rules(lang, abbreviations, units)]


def _once(text: Column, put) -> Column:
    def one(x: Column) -> Column:
        return put(x)

    return F.transform(F.array(text), one)[0]


def spoken_form(text: Column, lang: str | Column = "en", **tables: dict[str, dict[str, str]]) -> Column:
    """text as it is read aloud, by the rules of its language; English where there are none for it.

    lang may be a column. tables: `abbreviations` and `units` by language, added to the fixed ones.
    """
    known = sorted(BETWEEN)
    own = lambda name, code: tables.get(name, {}).get(code)

    def read(code: str) -> Column:
        out = text
        for pattern, to, sure in _rules(code, own("abbreviations", code), own("units", code)):
            if pattern.startswith(FRONT):
                body = pattern[len(FRONT) :]
                pattern, to = f"(?={body}){START}{body}", to[2:].replace("$2", "$1")
            # A pattern is only tried where its characters stand; an array of the text, so that it is made once.
            put = lambda x, pattern=pattern, to=to, sure=sure: F.when(F.contains(x, F.lit(sure)), F.regexp_replace(x, pattern, to)).otherwise(x)
            out = _once(out, put) if sure else F.regexp_replace(out, pattern, to)
        return F.trim(out)

    if isinstance(lang, str):
        return read(lang if lang in known else "en")
    out = read("en")
    for code in known:
        if code != "en":
            out = F.when(F.coalesce(lang, F.lit("")) == code, read(code)).otherwise(out)
    return out
