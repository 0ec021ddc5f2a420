"""Value standardisation as native column expressions with errors kept as data.

A standardiser takes the current value and returns the new value, an error column (or
``None`` when it cannot fail) and the kind of the new value. Nothing raises at run time;
wrong parameters raise ``StepError`` while the expression is built.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcemeld.functions.text import filled, squeeze, strip
from sourcemeld.settings import SAY_NO_BOOLEAN, SAY_NO_DATE, SAY_NO_DATETIME, SAY_NO_NUMBER

TEXT, LONG, DOUBLE, BOOLEAN, ARRAY = "text", "long", "double", "boolean", "array"


class StepError(ValueError):
    pass


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str = TEXT


@dataclass(frozen=True)
class Outcome:
    col: Column
    kind: str
    error: Column | None = None


Standardiser = Callable[..., Outcome]
REGISTRY: dict[str, Standardiser] = {}


def standardiser(name: str) -> Callable[[Standardiser], Standardiser]:
    """Register a named step; callers may add their own the same way."""

    def add(fn: Standardiser) -> Standardiser:
        REGISTRY[name] = fn
        return fn

    return add


def as_text(value: Value) -> Column:
    """Canonical text of a value: plain numbers, true/false, JSON for arrays."""
    c = value.col
    if value.kind == TEXT:
        return c
    if value.kind == DOUBLE:
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        shown = c.cast("string")  # the shortest text that gives the same double
        plain = F.regexp_replace(shown.try_cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
        large = shown.try_cast("decimal(38,0)").cast("string")
        return F.coalesce(
            F.when(whole, c.try_cast("bigint").cast("string")).when((F.abs(c) >= 1e-3) & (F.abs(c) < 1e15), plain).when(F.abs(c) >= 1e15, large), shown
        )
    if value.kind == ARRAY:
        return F.to_json(c)
    return c.cast("string")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.coalesce(c, F.lit("")), F.lit("'"))


def _message(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix + " "), _quoted(c))


def _on_text(value: Value, fn: Callable[[Column], Column]) -> Outcome:
    """Text functions leave values of other kinds alone."""
    return Outcome(fn(value.col) if value.kind == TEXT else value.col, value.kind)


@standardiser("trim")
def trim(value: Value) -> Outcome:
    return _on_text(value, strip)


@standardiser("collapse_whitespace")
def collapse_whitespace(value: Value) -> Outcome:
    return _on_text(value, squeeze)


@standardiser("lowercase")
def lowercase(value: Value) -> Outcome:
    return _on_text(value, F.lower)


@standardiser("uppercase")
def uppercase(value: Value) -> Outcome:
    return _on_text(value, F.upper)


@standardiser("normalize_name")
def normalize_name(value: Value) -> Outcome:
    return _on_text(value, squeeze)


@standardiser("normalize_email")
def normalize_email(value: Value) -> Outcome:
    return _on_text(value, lambda c: F.lower(strip(c)))


@standardiser("normalize_phone")
def normalize_phone(value: Value) -> Outcome:
    return Outcome(F.regexp_replace(as_text(value), r"(?U)\D", ""), TEXT)


# Fixed value: the first signed number in a text.
NUMBER = r"(-?\d+(?:\.\d+)?)"


def _number_text(value: Value) -> Column:
    return F.regexp_extract(F.replace(as_text(value), F.lit(","), F.lit("")), NUMBER, 1)


def _number_outcome(value: Value, number: Column, kind: str) -> Outcome:
    text = as_text(value)
    some = F.coalesce(_number_text(value), F.lit("")) != ""
    problem = F.when(some, _message("Number out of range in", text)).otherwise(_message(SAY_NO_NUMBER, text))
    return Outcome(number, kind, F.when(filled(text) & number.isNull(), problem))


@standardiser("extract_number")
def extract_number(value: Value) -> Outcome:
    return _number_outcome(value, _number_text(value).try_cast("double"), DOUBLE)


@standardiser("normalize_integer")
def normalize_integer(value: Value) -> Outcome:
    """The whole part of the first number: truncation towards zero, exact for 64 bits."""
    whole = F.regexp_extract(_number_text(value), r"^(-?\d+)", 1)
    return _number_outcome(value, whole.try_cast("bigint"), LONG)


@standardiser("normalize_decimal")
def normalize_decimal(value: Value, decimals: int = 2) -> Outcome:
    """Rounded half up in decimal arithmetic."""
    try:
        places = int(decimals)
    except (TypeError, ValueError) as exc:
        raise StepError(f"decimals must be a whole number, not {decimals!r}") from exc
    if not -18 <= places <= 18:
        raise StepError("decimals must lie between -18 and 18")
    text = _number_text(value)
    # Rounded once, from as many digits as 38 hold beside the whole part.
    exact = F.coalesce(*[F.round(text.try_cast(f"decimal(38,{scale})"), places).cast("double") for scale in (30, 25, 20, 10, 0) if scale > places or scale == 0])
    return _number_outcome(value, exact, DOUBLE)


# Date directives and the pattern letters that mean the same.
DIRECTIVES = {
    "%d": "d", "%m": "M", "%Y": "yyyy", "%y": "yy", "%H": "H", "%I": "h", "%M": "m", "%S": "s",
    "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%p": "a", "%j": "D",
}
PADDED = {
    "%d": "dd", "%m": "MM", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%j": "DDD",
}
NAMED = ("%b", "%B", "%p")


def date_pattern(fmt: str, padded: bool) -> str:
    """Pattern of a ``%d/%m/%Y`` style format; output and adjacent digits use full width."""
    if not fmt:
        raise StepError("a date format must not be empty")
    parts = re.findall(r"%.|[^%]+|%$", fmt)
    out = []
    for i, part in enumerate(parts):
        if part == "%%":
            out.append("%")
        elif part.startswith("%"):
            if part not in DIRECTIVES:
                raise StepError(f"date directive {part} is not supported")
            near = [p for p in parts[max(0, i - 1) : i + 2] if p is not part]
            glued = any(p in DIRECTIVES and p not in NAMED for p in near)
            out.append(PADDED.get(part, DIRECTIVES[part]) if padded or glued else DIRECTIVES[part])
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m.group(0)}'", part.replace("'", "''")))
    return "".join(out)


@standardiser("parse_date")
def parse_date(value: Value, input_format: str, output_format: str = "%Y-%m-%d") -> Outcome:
    text = as_text(value)
    parsed = F.try_to_timestamp(strip(text), F.lit(date_pattern(input_format, padded=False)))
    if "%y" in input_format:
        parsed = F.when(F.year(parsed) > 2068, F.add_months(parsed, -1200).cast("timestamp")).otherwise(parsed)
    shown = F.date_format(parsed, date_pattern(output_format, padded=True))
    error = F.concat(F.lit("date "), _quoted(text), F.lit(f" does not match format '{input_format}'"))
    return Outcome(shown, TEXT, F.when(filled(text) & parsed.isNull(), error))


# Month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_WORD = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?"
    r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
CLOCK = r"[t ]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?: ?[ap]m)?) ?(?:z|utc|[+-]\d{2}:?\d{2})?$"
# Date shapes and their year-first form; "?" marks an open order of day and month.
DATE_SHAPES = (
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "?$3-$1-$2"),
    (r"^(\d{1,2})-(\d{1,2})-([0-5]\d|6[0-8])$", "?20$3-$1-$2"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{2})$", "?19$3-$1-$2"),
    (rf"^{MONTH_WORD}\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})$", "$3-$1-$2"),
    (rf"^(\d{{1,2}})(?:st|nd|rd|th)?[ -]{MONTH_WORD}\.?,?[ -](\d{{4}})$", "$3-$2-$1"),
    (r"-([a-z]{3})[a-z]*-", "-$1-"),
)


# The shapes that most dates have, and a row of months in which a name's place tells its number.
PLAIN_DATE = r"^(?:\d{4}(?:-\d{1,2}-|[/.]\d{1,2}[/.])\d{1,2}|\d{1,2}(?:-\d{1,2}-|[/.]\d{1,2}[/.])\d{4})$"
SHORT_MONTH_DATE = r"^[A-Za-z]{3} \d{1,2},? \d{4}$"
MONTH_ROW = "-" + "-".join(MONTHS) + "-"


def _iso_dates(text: Column, day_first: bool) -> tuple[Column, Column]:
    """Read a date in any of the known shapes: (date, clock text).

    The most frequent shapes are cut at their separators after one test; all others are rewritten.
    """
    t = strip(text)
    part = F.translate(t, "/.", "--")
    first, last = F.substring_index(part, "-", 1), F.substring_index(part, "-", -1)
    middle = F.substring_index(F.substring_index(part, "-", 2), "-", -1)
    day_month, month_day = (F.concat_ws("-", last, *order).try_cast("date") for order in ((middle, first), (first, middle)))
    plain = F.coalesce(day_month, month_day) if day_first else F.coalesce(month_day, day_month)
    plain = F.when(F.length(first) == 4, part.try_cast("date")).otherwise(plain)
    place = F.position(F.concat(F.lit("-"), F.lower(F.substring(t, 1, 3)), F.lit("-")), F.lit(MONTH_ROW))
    day = F.replace(F.substring_index(F.substring_index(t, " ", 2), " ", -1), F.lit(","), F.lit(""))
    month = F.when(place > 0, ((place + 3) / 4).cast("int").cast("string"))
    named = F.concat(F.substring_index(t, " ", -1), F.lit("-"), month, F.lit("-"), day).try_cast("date")
    date, clock = _rewritten_dates(text, day_first)
    is_plain, is_named = t.rlike(PLAIN_DATE), t.rlike(SHORT_MONTH_DATE)
    return F.when(is_plain, plain).when(is_named, named).otherwise(date), clock


def _rewritten_dates(text: Column, day_first: bool) -> tuple[Column, Column]:
    """The same for all shapes.

    Each shape is rewritten to year-month-day by one replacement, so a value is parsed by a
    cast and no parser is tried in vain. Year-first text is never read day-first.
    """
    t = F.lower(squeeze(text))
    s = F.regexp_replace(F.regexp_replace(t, CLOCK, ""), r"(\d)[/.](\d{1,2})[/.](\d)", "$1-$2-$3")
    for shape, year_first in DATE_SHAPES:
        s = F.regexp_replace(s, shape, year_first)
    for number, month in enumerate(MONTHS, start=1):
        s = F.replace(s, F.lit(f"-{month}-"), F.lit(f"-{number}-"))

    def read(order: str) -> Column:
        ordered = F.regexp_replace(s, r"^\?(\d{4})-(\d{1,2})-(\d{1,2})$", order)
        return F.regexp_extract(ordered, r"^(\d{4}-\d{1,2}-\d{1,2})$", 1).try_cast("date")

    day_month, month_day = read("$1-$3-$2"), read("$1-$2-$3")
    date = F.coalesce(day_month, month_day) if day_first else F.coalesce(month_day, day_month)
    return date, F.regexp_extract(t, CLOCK, 1)


@standardiser("parse_date_auto")
def parse_date_auto(value: Value, output_format: str = "%Y-%m-%d") -> Outcome:
    """Day before month unless the text starts with the year; month first where only that fits."""
    text = as_text(value)
    date, _ = _iso_dates(text, day_first=True)
    shown = (
        date.cast("string") if output_format == "%Y-%m-%d" else F.date_format(date, date_pattern(output_format, True))
    )
    return Outcome(shown, TEXT, F.when(filled(text) & date.isNull(), _message(SAY_NO_DATE, text)))


@standardiser("parse_datetime_auto")
def parse_datetime_auto(value: Value, output_format: str = "%Y-%m-%dT%H:%M:%S") -> Outcome:
    """Month before day; a zone suffix is dropped, the clock is kept as written."""
    text = as_text(value)
    date, clock = _iso_dates(text, day_first=False)
    half = F.regexp_extract(clock, r"([ap])m$", 1)
    hour = F.regexp_extract(clock, r"^(\d{1,2})", 1).try_cast("int")
    hour = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
    rest = F.regexp_extract(clock, r"^\d{1,2}(:\d{2}(?::\d{2}(?:\.\d+)?)?)", 1)
    moment = F.when(clock == "", date.cast("timestamp_ntz")).otherwise(
        F.concat(date.cast("string"), F.lit(" "), hour.cast("string"), rest).try_cast("timestamp_ntz")
    )
    shown = F.date_format(moment, date_pattern(output_format, padded=True))
    return Outcome(shown, TEXT, F.when(filled(text) & moment.isNull(), _message(SAY_NO_DATETIME, text)))


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


@standardiser("map_value")
def map_value(value: Value, mapping: dict) -> Outcome:
    """Exact trimmed key first, then without case; anything else is ``unmapped_value``."""
    if not isinstance(mapping, dict):
        raise StepError("mapping must be a dictionary")
    exact = {str(k): str(v) for k, v in mapping.items() if v is not None}
    if not exact:
        return Outcome(F.lit(None).cast("string"), TEXT, F.lit("unmapped_value"))
    folded = {k.strip().lower(): v for k, v in exact.items()}
    key = strip(as_text(value))
    found = F.coalesce(
        F.try_element_at(literal_map(exact), key), F.try_element_at(literal_map(folded), F.lower(key))
    )
    return Outcome(found, TEXT, F.when(found.isNull(), F.lit("unmapped_value")))


def _literal_regex(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


@standardiser("split")
def split(value: Value, separator: str = ",") -> Outcome:
    if not separator:
        raise StepError("separator must not be empty")
    text = as_text(value)
    parts = F.filter(F.transform(F.split(text, _literal_regex(separator)), strip), lambda p: p != "")
    return Outcome(F.when(filled(text), parts).otherwise(F.array().cast("array<string>")), ARRAY)


@standardiser("join")
def join(value: Value, separator: str = ", ") -> Outcome:
    if value.kind != ARRAY:
        text = as_text(value)
        return Outcome(
            F.when(~filled(text) | text.isNull(), F.lit("")), TEXT,
            F.when(filled(text), F.lit("join expects an array/list value")),
        )
    kept = F.filter(F.transform(value.col, strip), lambda p: p != "")
    return Outcome(F.coalesce(F.array_join(kept, separator), F.lit("")), TEXT)


# Words read as true and as false.
TRUE_WORDS = ("true", "yes", "y", "1", "active", "enabled", "working")
FALSE_WORDS = ("false", "no", "n", "0", "inactive", "disabled", "left")


@standardiser("normalize_boolean")
def normalize_boolean(value: Value, true_values=None, false_values=None) -> Outcome:
    if value.kind == BOOLEAN:
        return Outcome(value.col, BOOLEAN)
    word = F.lower(strip(as_text(value)))
    yes = [str(w).lower() for w in (true_values or TRUE_WORDS)]
    no = [str(w).lower() for w in (false_values or FALSE_WORDS)]
    flag = F.when(word.isin(yes), F.lit(True)).when(word.isin(no), F.lit(False))
    return Outcome(flag, BOOLEAN, F.when(flag.isNull(), _message(SAY_NO_BOOLEAN, as_text(value))))


# Other spellings of step parameters, tried in this order.
PARAMETER_ALIASES = {
    "parse_date": {"input_format": ("format", "date_format", "inputFormat"), "output_format": ("outputFormat",)},
    "parse_date_auto": {"output_format": ("outputFormat",)},
    "parse_datetime_auto": {"output_format": ("outputFormat",)},
    "normalize_decimal": {"decimals": ("precision",)},
}


def standardise(value: Value, operation: str, params: dict | None = None) -> Outcome:
    """Apply one named step. Unknown names and wrong parameters raise ``StepError``."""
    if operation not in REGISTRY:
        raise StepError(f"no step is called {operation!r}")
    given = dict(params or {})
    for name, spellings in PARAMETER_ALIASES.get(operation, {}).items():
        spelling = next((s for s in spellings if s in given), None)
        if name not in given and spelling:
            given[name] = given.pop(spelling)
    try:
        return REGISTRY[operation](value, **given)
    except TypeError as exc:
        raise StepError(f"{operation} does not take these parameters: {exc}") from exc
