"""Names, teams and seasons as comparable keys; everything stays in Spark expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that have no decomposed form and their plain spelling.
SPECIAL_LETTERS = {
    "ø": "o",
    "Ø": "O",
    "ð": "d",
    "Ð": "D",
    "ł": "l",
    "Ł": "L",
    "ı": "i",
    "æ": "ae",
    "Æ": "AE",
    "þ": "th",
    "Þ": "Th",
    "ß": "ss",
}

# Club names that differ between the sources.
TEAM_ALIASES = {
    "ac milan": "milan",
    "as roma": "roma",
    "hellas verona": "verona",
    "inter milan": "inter",
    "internazionale": "inter",
    "ssc napoli": "napoli",
}

# Club prefixes dropped when clubs are compared.
CLUB_PREFIXES = ("ac", "as", "fc", "ss", "ssc")

# Patterns of list names and of seasons.
TRAILING_INITIAL = r"(?:^|\s)([A-Za-z])\.$"
LEADING_INITIALS = r"^(?:[A-Za-z]\.\s*)+"
TRAILING_HINTS = r"^(.*?)\s+([A-Za-z]{1,3}(?:\.[A-Za-z]{1,3})*\.)$"
SEASON = r"(?i)(?:Stagione[_ -])?(20\d{2})[_ -](\d{2,4})"


def _ranges(codes: Iterable[int], gap: int = 1) -> str:
    """A character class of the code points; gaps below ``gap`` are covered as well."""
    ranges: list[list[int]] = []
    for code in sorted(codes):
        if ranges and code - ranges[-1][1] <= gap:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges) + "]"


def _vanishes(letter: str) -> bool:
    return all(map(unicodedata.combining, unicodedata.normalize("NFKD", letter)))


#: Every character that is made of combining marks alone; these disappear from a decomposed name.
COMBINING_MARKS = _ranges(code for code in range(0x300, sys.maxunicode + 1) if _vanishes(chr(code)))


def _plain_spellings() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition holds plain letters or digits.

    The first table maps to one character, the second to several.
    """
    one: dict[str, str] = {}
    several: dict[str, str] = {}
    for code in range(0x80, sys.maxunicode + 1):
        letter = chr(code)
        if not unicodedata.decomposition(letter):
            continue
        decomposed = unicodedata.normalize("NFKD", letter)
        spelling = "".join(part for part in decomposed if not unicodedata.combining(part))
        if not any(part in SPECIAL_LETTERS or part.isascii() and part.isalnum() for part in spelling):
            continue
        if len(spelling) == 1:
            one[letter] = spelling
        else:
            several[letter] = spelling
    return one, several


ONE_LETTER, SEVERAL_LETTERS = _plain_spellings()


#: Covers the letters with several; a wide class that is cheap to test.
MAYBE_SEVERAL = _ranges(map(ord, SEVERAL_LETTERS), gap=64)


def normalize_name(value: Column) -> Column:
    """Lower case ASCII words separated by single blanks.

    Combining marks go, accented letters lose their accent, the special letters get their plain
    spelling and every other run of characters becomes one blank.
    """
    # One literal that folds to a map keeps the expression small for the optimizer.
    listed = ";".join(f"{letter}={text}" for letter, text in SEVERAL_LETTERS.items())
    table = F.str_to_map(F.lit(listed), F.lit(";"), F.lit("="))
    spelled_out = F.array_join(
        F.transform(F.split(value, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""
    )
    plain = F.when(value.rlike(MAYBE_SEVERAL), spelled_out).otherwise(value)
    plain = F.translate(plain, "".join(ONE_LETTER), "".join(ONE_LETTER.values()))
    # The class of all marks is long; the first of them is U+0300, and most texts stay below.
    plain = F.when(value.rlike("[^\\x00-\\x{2ff}]"), F.regexp_replace(plain, COMBINING_MARKS, "")).otherwise(plain)
    single = {letter: text for letter, text in SPECIAL_LETTERS.items() if len(text) == 1}
    plain = F.translate(plain, "".join(single), "".join(single.values()))
    for letter, spelling in SPECIAL_LETTERS.items():
        if len(spelling) > 1:
            plain = F.replace(plain, F.lit(letter), F.lit(spelling))
    # Most names are plain ASCII already and skip all of that.
    plain = F.when(value.rlike("[^\\x00-\\x7f]"), plain).otherwise(value)
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


def normalize_team(value: Column, aliases: Mapping[str, str] = TEAM_ALIASES) -> Column:
    name = normalize_name(value)
    table = F.create_map(*[F.lit(item) for pair in aliases.items() for item in pair])
    return F.coalesce(F.try_element_at(table, name), name)


def trailing_initial(value: Column) -> Column:
    """The initial that ends a list name (``Martinez L.`` gives ``l``), else null."""
    found = F.regexp_extract(F.trim(value), TRAILING_INITIAL, 1)
    return F.nullif(F.lower(found), F.lit(""))


def without_initials(value: Column) -> Column:
    """Normalised provider name without its leading initials."""
    return normalize_name(F.regexp_replace(F.trim(value), LEADING_INITIALS, ""))


def list_stem(value: Column) -> Column:
    """Normalised list name without its trailing abbreviation."""
    trimmed = F.trim(value)
    return normalize_name(
        F.when(trimmed.rlike(TRAILING_HINTS), F.regexp_extract(trimmed, TRAILING_HINTS, 1)).otherwise(
            trimmed
        )
    )


def list_hints(value: Column) -> Column:
    """Lower-case parts of the trailing abbreviation; empty when there is none."""
    found = F.lower(F.regexp_extract(F.trim(value), TRAILING_HINTS, 2))
    return F.filter(F.split(found, r"\."), lambda part: part != "")


def search_stem(value: Column) -> Column:
    """Key for a profile search; null below four characters."""
    stem = list_stem(value)
    return F.when(F.length(stem) >= 4, stem)


def club_key(value: Column) -> Column:
    """Club name without its legal prefix, letters and digits only."""
    lowered = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    prefix = "^(?:" + "|".join(CLUB_PREFIXES) + ") "
    return F.regexp_replace(F.regexp_replace(lowered, prefix, ""), r"[^\p{L}\p{N}]+", "")


def words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda word: word != "")


def season_key(start: Column, end: Column) -> Column:
    """``YYYY/YY`` for consecutive years, else null."""
    short = F.when(end < 100, end).otherwise(end % 100)
    return F.when(
        short == (start + 1) % 100,
        F.concat(start.cast("string"), F.lit("/"), F.lpad(short.cast("string"), 2, "0")),
    )


def season_start(season: Column) -> Column:
    return F.split_part(season, F.lit("/"), F.lit(1)).cast("int")


def season_in_text(value: Column) -> Column:
    """Season named in a file name or title, null if there is none or it is not consecutive."""
    start = F.regexp_extract(value, SEASON, 1)
    end = F.regexp_extract(value, SEASON, 2)
    return F.when(start != "", season_key(start.try_cast("int"), end.try_cast("int")))
