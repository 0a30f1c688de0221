"""Text functions as Spark columns, and their driver-side twins for single queries."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}]+"
# The function words that mark a query as prose.
STOP_WORDS = (
    "the a an that for of to in on by with based its and or when how what which using alongside across into at is are be from as this it instead rather "
    "than before after without not should must only your"
).split()


def _accents() -> tuple[str, str]:
    """Lower-case letters that decompose to one ASCII letter and marks, and those letters."""
    pairs = []
    for code in range(0xC0, 0x250):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(m) for m in parts[1:]):
            pairs.append((c, parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accents()


def tokens(text: Column) -> Column:
    """Query tokens in order: runs of letters, digits and ``_``, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def index_terms(text: Column) -> Column:
    """Index terms in order: ``_`` separates, accents are folded."""
    return F.regexp_extract_all(F.translate(F.lower(text), _ACCENTED, _PLAIN), F.lit(TERM), F.lit(0))


def first_line(text: Column) -> Column:
    """The first line that is not blank, trimmed; '' if there is none."""
    return F.regexp_replace(F.regexp_extract(text, r"^\s*(\S[^\n]*)", 1), r"\s+$", "")


def is_identifier(token: Column) -> Column:
    """``_`` or ``::``; or an upper-case letter inside and any lower-case one; or two or more bytes, all upper case or digits."""
    inner_upper = token.rlike(r"^.[\s\S]*\p{Lu}") & token.rlike(r"\p{Ll}")
    capitals = (F.octet_length(token) > 1) & token.rlike(r"^[\p{Lu}0-9]+$")
    return token.contains("_") | token.contains("::") | inner_upper | capitals


def bare_tokens(query: Column) -> Column:
    """White-space tokens with non-alphanumerics trimmed at both ends; empty ones are dropped."""
    return F.filter(F.transform(F.split(F.trim(query), r"\s+"), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda t: t != "")


def query_class(query: Column) -> Column:
    """'natural' or 'symbol'."""
    own = bare_tokens(query)
    stop = F.size(F.filter(own, lambda t: F.lower(t).isin(STOP_WORDS)))
    identifiers = F.size(F.filter(own, is_identifier))
    natural = (stop >= 2) | (~((identifiers >= 1) & (stop == 0)) & (F.size(own) >= 6) & (stop >= 1))
    return F.when(natural, "natural").otherwise("symbol")


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle."""
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("bigint")


def raw_tokens(text: Column) -> Column:
    """Tokens with their case kept."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
