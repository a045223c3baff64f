"""Month arithmetic and tolerant date parsing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spreadsheet's day zero, and the serials of about the first and last
# day a nanosecond timestamp can hold.
SERIAL_ZERO = "1899-12-30"
SERIAL_RANGE = (-81_000, 132_000)

# Each shape of date text and its parts as year, month, day. A text is read by the first
# shape it has; day first comes before month first.
ISO = r"^\d{4}[-/]\d{1,2}(?:[-/]\d{1,2}(?:[ T]\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?)?)?$"
CLOCK = r"((?: \d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?)?)$"
MONTH_WORD = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    "|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
STEMS = "janfebmaraprmayjunjulaugsepoctnovdec"
COMPACT = r"^((?:19|20)\d{2})(\d{2})(\d{2})$"
DAY_FIRST = r"^(\d{1,2})[-/.](0?[1-9]|1[0-2])[-/.](\d{4})" + CLOCK
MONTH_FIRST = r"^(0?[1-9]|1[0-2])[-/.](\d{1,2})[-/.](\d{4})" + CLOCK
DAY_NAMED = r"(?i)^(\d{1,2})[ -]" + MONTH_WORD + r"[ -](\d{4})" + CLOCK
NAMED_DAY = r"(?i)^" + MONTH_WORD + r" (\d{1,2})(?:, ?| )(\d{4})" + CLOCK
NAMED_MONTH = r"(?i)^" + MONTH_WORD + r"[ -](\d{4})$"
SERIAL = r"^-?\d+(?:\.\d*)?$"
YEAR_ALONE = r"^(?:19|20)\d{2}$"
ZONE = r"(:\d{2}(?:\.\d+)?) ?(?:Z|UTC|[+-]\d{2}:?\d{2})$"
HALF_DAY = r"(?i)^(.*[ T])(\d{1,2})(:\d{2}(?::\d{2}(?:\.\d+)?)?) ?([ap])\.?m\.?$"
# what stands before a year of two digits, which is 1969 to 2068
SHORT_YEAR = (
    r"(?i)^(\d{1,2}[-/.]\d{1,2}[-/.]|\d{1,2}[ -]" + MONTH_WORD + r"[ -]|" + MONTH_WORD + r"[-'])"
)
FIRST_YEAR, LAST_YEAR = 1678, 2261


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(c) -> Column:
    """First day of the month as a date; null stays null."""
    return F.trunc(_col(c).cast("date"), "MM")


def _month_number(text: Column, shape: str, group: int) -> Column:
    stem = F.lower(F.substring(F.regexp_extract(text, shape, group), 1, 3))
    return ((F.instr(F.lit(STEMS), stem) + 2) / 3).cast("int").cast("string")


def _iso_text(text: Column) -> Column:
    """The text as year-month-day by its shape; null for an unknown shape."""

    def named(shape: str, word: int, year: int, day: int | None) -> Column:
        month = _month_number(text, shape, word)
        last = F.regexp_extract(text, shape, day) if day else F.lit("1")
        parts = [F.regexp_extract(text, shape, year), month, last]
        clock = F.regexp_extract(text, shape, 4) if day else F.lit("")
        return F.concat(F.concat_ws("-", *parts), clock)

    return (
        F.when(text.rlike(YEAR_ALONE), F.concat(text, F.lit("-01-01")))
        .when(text.rlike(ISO), F.translate(text, "/", "-"))
        .when(text.rlike(DAY_FIRST), F.regexp_replace(text, DAY_FIRST, "$3-$2-$1$4"))
        .when(text.rlike(MONTH_FIRST), F.regexp_replace(text, MONTH_FIRST, "$3-$1-$2$4"))
        .when(text.rlike(DAY_NAMED), named(DAY_NAMED, 2, 3, 1))
        .when(text.rlike(NAMED_DAY), named(NAMED_DAY, 1, 3, 2))
        .when(text.rlike(NAMED_MONTH), named(NAMED_MONTH, 1, 2, None))
        .when(text.rlike(COMPACT), F.regexp_replace(text, COMPACT, "$1-$2-$3"))
    )


def _plain(text: Column) -> Column:
    """The text with dashes, a 24-hour clock, no zone (the clock stays as written) and a full year."""
    text = F.regexp_replace(text, ZONE, "$1")
    hour = F.regexp_extract(text, HALF_DAY, 2).try_cast("int") % 12
    late = F.when(F.lower(F.regexp_extract(text, HALF_DAY, 4)) == "p", 12).otherwise(0)
    clock = F.concat(
        F.regexp_extract(text, HALF_DAY, 1), F.lpad((hour + late).cast("string"), 2, "0"),
        F.regexp_extract(text, HALF_DAY, 3),
    )
    text = F.when(text.rlike(HALF_DAY), clock).otherwise(text)
    text = F.regexp_replace(text, r"^(\d{4})\.(\d{1,2})\.(\d{1,2})(?!\d)", "$1-$2-$3")
    text = F.regexp_replace(text, r"(?i)^(" + MONTH_WORD + r")'(\d{2})$", "$1-$3")
    for digits, century in (("[0-5][0-9]|6[0-8]", "20"), ("69|[7-9][0-9]", "19")):
        text = F.regexp_replace(text, SHORT_YEAR + f"({digits})(?![0-9])", "$1" + century + "$4")
    return text


def _in_range(iso: Column) -> Column:
    year = F.substring(iso, 1, 4).cast("int")
    return F.when(year.between(FIRST_YEAR, LAST_YEAR), iso).try_cast("timestamp")


def parse_date_text(c) -> Column:
    """Date text to timestamp: ISO, day first, month first, named months; else null.

    A text's shape decides how it is read, so no format is tried by failing at it.
    """
    text = F.trim(_col(c))
    # the rarer shapes are rewritten first, once, and only where no usual shape fits
    odd = F.transform(F.array(_plain(text)), lambda t: _in_range(_iso_text(t)))
    return F.coalesce(_in_range(_iso_text(text)), F.when(text.rlike(r"\d"), F.get(odd, 0)))


def parse_mixed_date(c) -> Column:
    """A cell holding ISO text, a day serial, day-first text or named-month text.

    Serials count days since 1899-12-30, but four digits from 1900 to 2099 are a year; values that
    no rule reads become null.
    """
    text = F.trim(_col(c).cast("string"))
    serial = F.when(text.rlike(SERIAL) & ~text.rlike(YEAR_ALONE), text.try_cast("double"))
    day = F.date_add(F.lit(SERIAL_ZERO).cast("date"), F.floor(serial).cast("int"))
    clock = F.round((serial - F.floor(serial)) * 86400).cast("int")
    # Added without a time zone, so a day is 86400 seconds everywhere.
    cell = F.timestamp_add("SECOND", clock, day.cast("timestamp_ntz")).cast("timestamp")
    from_serial = F.when(serial.between(*SERIAL_RANGE), cell)
    return F.coalesce(from_serial, parse_date_text(text))


def parse_month(c) -> Column:
    """Month text (`MMM yyyy` or any general form) to the first of its month."""
    return month_start(parse_date_text(c))


def month_label(c) -> Column:
    return F.date_format(_col(c), "MMM yyyy")


def month_iso(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def months_inclusive(start, end) -> Column:
    """Number of calendar months from the month of `start` to the month of `end`."""
    s, e = _col(start), _col(end)
    return ((F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s) + 1).cast("bigint")
