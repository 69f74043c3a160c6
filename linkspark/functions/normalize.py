"""String normalisers, splitters and mergers: Column -> Column, composed by name."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Normalizer = Callable[[Column], Column]

# Letters and digits that are confused in scanned or typed text.
LOWER_LETTERS, LOWER_DIGITS = "olzqsg", "012459"
UPPER_LETTERS, UPPER_DIGITS = "OLZASGB", "0124568"
# German letters in ASCII.
UMLAUTS = {"ä": "ae", "Ä": "AE", "ö": "oe", "Ö": "OE", "ü": "ue", "Ü": "UE", "ß": "ss"}


def accents() -> tuple[str, str]:
    """Latin letters that decompose, and their base letters; a base of l has its stroke dropped too."""
    pairs = {"Ł": "L", "ł": "l"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        d = unicodedata.normalize("NFD", chr(code))
        if len(d) > 1 and len(base := "".join(c for c in d if not unicodedata.combining(c))) == 1:
            pairs[chr(code)] = pairs.get(base, base)
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = accents()


def lower(c: Column) -> Column:
    return F.lower(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def trim(c: Column) -> Column:
    """Without characters up to U+0020 at either end."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+", ""), r"[\x00-\x20]+$", "")


def substring(start: int, end: int) -> Normalizer:
    """Code points start to end - 1; the end is clamped, and a start beyond the text gives an empty one."""
    return lambda c: F.substring(c, start + 1, max(0, end - start))


def replace_pattern(pattern: str, by: str = "") -> Normalizer:
    return lambda c: F.regexp_replace(c, pattern, by)


whitespace_removed = replace_pattern(r"\s+")
punctuation_removed = replace_pattern(r"\p{Punct}")
special_removed = replace_pattern(r"\W")
digits_removed = replace_pattern(r"[0-9]")
digits_only = replace_pattern(r"[^0-9]")


def accents_removed(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}+", "")


def replace_all(pairs: dict[str, str]) -> Normalizer:
    """Literal replacements one after the other."""
    return lambda c: reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), pairs.items(), c)


umlauts_spelled = replace_all(UMLAUTS)


def replace_characters(pairs: dict[str, str]) -> Normalizer:
    """Characters by strings, in one pass."""
    if all(len(v) == 1 for v in pairs.values()):
        return lambda c: F.translate(c, "".join(pairs), "".join(pairs.values()))
    table = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return lambda c: F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def letters_to_digits_lower(c: Column) -> Column:
    return F.translate(c, LOWER_LETTERS, LOWER_DIGITS)


def letters_to_digits_upper(c: Column) -> Column:
    return F.translate(c, UPPER_LETTERS, UPPER_DIGITS)


def digits_to_letters_lower(c: Column) -> Column:
    return F.translate(c, LOWER_DIGITS, LOWER_LETTERS)


def digits_to_letters_upper(c: Column) -> Column:
    return F.translate(c, UPPER_DIGITS, UPPER_LETTERS)


def map_contained(pairs: dict[str, str]) -> Normalizer:
    """The value of the first key that the text holds, in any case; else the text."""

    def run(c: Column) -> Column:
        out = c
        for k, v in reversed(pairs.items()):
            out = F.when(F.lower(c).contains(k.lower()), F.lit(v)).otherwise(out)
        return out

    return run


def gender(c: Column) -> Column:
    """mal, fem or oth for the usual spellings, in any case; else the text."""
    x = F.lower(trim(c))
    return F.when(x.isin("m", "male", "mal"), F.lit("mal")).when(x.isin("f", "female", "fem"), F.lit("fem")).when(x.isin("o", "other", "oth"), F.lit("oth")).otherwise(c)


null_removed = map_contained({"null": ""})


def chain(*steps: Normalizer) -> Normalizer:
    return lambda c: reduce(lambda x, f: f(x), steps, c)


#: Names: lower case, digits read as letters, no punctuation, accents, umlauts or white space.
standard_string = chain(lower, digits_to_letters_lower, punctuation_removed, accents_removed, umlauts_spelled, whitespace_removed)
#: Numbers: letters read as digits, then digits only.
standard_number = chain(letters_to_digits_lower, letters_to_digits_upper, digits_only)
#: What the encoding service applies to fields of the kinds TEXT and NUMERIC.
service_text = chain(trim, upper, accents_removed, special_removed, substring(0, 20))
service_number = chain(trim, digits_only)

NORMALIZERS: dict[str, Normalizer] = {
    "lower": lower, "upper": upper, "trim": trim, "whitespace": whitespace_removed, "punctuation": punctuation_removed, "special": special_removed,
    "digits": digits_removed, "non_digits": digits_only, "accents": accents_removed, "umlauts": umlauts_spelled,
    "letters_to_digits_lower": letters_to_digits_lower, "letters_to_digits_upper": letters_to_digits_upper,
    "digits_to_letters_lower": digits_to_letters_lower, "digits_to_letters_upper": digits_to_letters_upper, "gender": gender, "null": null_removed,
    "standard_string": standard_string, "standard_number": standard_number, "service_text": service_text, "service_number": service_number,
}


def merge(columns: Sequence[Column | str], separator: str = "") -> Column:
    """Columns as one string; nulls count as empty."""
    return F.concat_ws(separator, *(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns))


SEPARATORS = {"simple": "", "blank": " ", "dot": ".", "slash": "/"}
PATTERNS = {"blank": " ", "comma": ",", "dot": r"\.", "hyphen": "-", "punctuation": r"\p{Punct}"}


def split_parts(c: Column, pattern: str, parts: int) -> list[Column]:
    """`parts` columns; the last keeps the rest, missing ones are empty."""
    s = F.split(c, pattern, parts)
    return [F.coalesce(F.get(s, F.lit(i)), F.lit("")) for i in range(parts)]


def split_at(c: Column, place: int) -> list[Column]:
    return [F.substring(c, 1, place), F.when(F.char_length(c) > place, F.substring(c, place + 1, 2**31 - 1)).otherwise(F.lit(""))]


def title_case(c: Column) -> Column:
    """Blanks between the words of an UpperCamelCase name."""
    return F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", " ")


def hex_of(c: Column) -> Column:
    return F.lower(F.hex(F.encode(c, "UTF-8")))


def base64_of(c: Column) -> Column:
    return F.base64(F.encode(c, "UTF-8"))


def joined(c: Column, separator: str = "") -> Column:
    return F.array_join(c, separator)
