"""Column expressions for text: missing values, blanks, labels, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\").replace("'", "\\'") + "'"


def is_missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


# Fixed value: all signs that are blanks in Unicode, as a pattern's (?U)\s has them.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Strip every kind of Unicode blank, tabs and line ends included; no pattern runs over the text."""
    return F.trim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def match_key(c: Column) -> Column:
    """Comparison form of an identity value; NULL when nothing is left."""
    return F.when(strip(c) != "", match_text(c))


def match_text(c: Column) -> Column:
    """The same with an empty text where nothing is left, for places that tell it from others more cheaply."""
    return F.lower(squeeze(c))


def conflict_key(c: Column) -> Column:
    """Comparison form of a value when sources are checked against each other."""
    return F.lower(strip(c))


def label(c: Column) -> Column:
    """Comparison form of a column or field label."""
    return F.lower(squeeze(F.translate(c, "_-", "  ")))


def exact_label(c: Column) -> Column:
    """Form for exact name and alias matches; inner blanks count, outer ones do not."""
    return F.lower(strip(F.translate(c, "_-", "  ")))


def tokens(*cols: Column) -> Column:
    """Distinct lower-case words of the given texts, split on blank, ``_``, ``-`` and ``/``."""
    text = F.lower(F.concat_ws(" ", *cols))
    parts = F.split(F.translate(text, "_-/", "   "), r"(?U)\s+")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def meaningful_text(c: Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def meaningful_map(c: Column) -> Column:
    """A map counts when it has entries and every key and value says something."""
    says = F.map_filter(c, lambda k, v: ~(meaningful_text(k) & meaningful_text(v)))
    return F.coalesce((F.size(c) > 0) & (F.size(says) == 0), F.lit(False))


def meaningful_list(c: Column) -> Column:
    return F.coalesce((F.size(c) > 0) & F.forall(c, meaningful_text), F.lit(False))


# One JSON string, and one of blanks only between the signs that can stand around a string; texts come without blanks outside of strings.
_JSON_STRING = r'"(?:[^"\\]|\\.)*"'
_JSON_BLANK = r'(?U)(?:^|[\[{,:])"(?:\s|\\[tnrf]|\\u(?:000[9a-dA-D]|001[c-fC-F]|0085|00[aA]0))*"(?:[,:\]}]|$)'


def meaningful_value(c: Column) -> Column:
    """A VARIANT says something if nothing in it, at any depth, is null, a blank text or key, or an empty list or map.

    It is read as its JSON text, so the depth does not matter and nothing is unpacked.
    """
    text = F.to_json(c)
    bare = F.regexp_replace(text, _JSON_STRING, "s")
    return F.coalesce(~text.rlike(_JSON_BLANK) & ~bare.rlike(r"null|\{\}|\[\]"), F.lit(False))
