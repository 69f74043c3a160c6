"""Phonetic codes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters and their digits in Refined Soundex.
LETTERS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01360240043788015936020505"


def refined_soundex(c: Column) -> Column:
    """The first letter and the digits of all letters A to Z, equal neighbours once; other characters are left out."""
    s = F.regexp_replace(F.upper(c), "[^A-Z]", "")
    return F.concat(F.substring(s, 1, 1), F.regexp_replace(F.translate(s, LETTERS, DIGITS), r"(.)\1+", "$1"))
