"""Slugs, entity normal form and template filling."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossblock.functions.values import as_column

# Symbols that become words, and what counts as white space besides \s.
SYMBOL_WORDS = {"+": " plus ", "#": " sharp ", "&": " and "}
SPACE = r"[\s\x1c-\x1f]"
WIDE_SPACE = r"(?U)[\s\x1c-\x1f]"


@F.arrow_udf(T.StringType())
def ascii_fold(texts: pa.Array) -> pa.Array:
    """Compatibility decomposition without anything outside ASCII (Spark has no builtin)."""
    return pc.replace_substring_regex(pc.utf8_normalize(texts, "NFKD"), r"[^\x00-\x7F]+", "")


def strip(text: str | Column) -> Column:
    """Trim white space of any kind, not only blanks."""
    return F.regexp_replace(as_column(text), f"^{WIDE_SPACE}+|{WIDE_SPACE}+$", "")


def is_blank(text: str | Column) -> Column:
    return F.length(strip(text)) == 0


def with_words(text: str | Column) -> Column:
    out = as_column(text)
    for symbol, spoken in SYMBOL_WORDS.items():
        out = F.replace(out, F.lit(symbol), F.lit(spoken))
    return out


def slugify(text: str | Column) -> Column:
    """Lower-case ASCII identifier with hyphens between runs of letters and digits."""
    hyphens = F.regexp_replace(F.lower(ascii_fold(with_words(text))), "[^a-z0-9]+", "-")
    return F.btrim(hyphens, F.lit("-"))


def normalize_entity(text: str | Column) -> Column:
    """Case and accents removed, white space collapsed: one form per entity."""
    folded = F.lower(ascii_fold(strip(text)))
    return F.trim(F.regexp_replace(folded, f"{SPACE}+", " "))


def fill_template(template: str | Column, subject_phrase: str | Column) -> Column:
    return F.replace(as_column(template), F.lit("{s}"), as_column(subject_phrase))


def first_line(text: str | Column) -> Column:
    """First line of a generated answer, trimmed."""
    return strip(F.substring_index(as_column(text), "\n", 1))
