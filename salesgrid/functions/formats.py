"""Number formats and wording bands, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(x: Column, places: int) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{places}f", x.cast("double")))


def grouped(x: Column) -> Column:
    """Whole number with thousands separators."""
    return F.when(x.isNotNull(), F.format_string("%,.0f", x.cast("double")))


def k_m(c) -> Column:
    """1.2M, 3.4K or 56."""
    x = _col(c)
    return (
        F.when(F.abs(x) >= 1_000_000, F.concat(fixed(x / 1_000_000, 1), F.lit("M")))
        .when(F.abs(x) >= 1_000, F.concat(fixed(x / 1_000, 1), F.lit("K")))
        .when(x.isNotNull(), fixed(x, 0))
    )


def rupees(c) -> Column:
    """₹1.23Cr (ten millions), ₹4.56L (hundred thousands) or ₹7,890; NA for null."""
    x = _col(c)
    return (
        F.when(F.abs(x) >= 10_000_000, F.concat(F.lit("₹"), fixed(x / 10_000_000, 2), F.lit("Cr")))
        .when(F.abs(x) >= 100_000, F.concat(F.lit("₹"), fixed(x / 100_000, 2), F.lit("L")))
        .when(x.isNotNull(), F.concat(F.lit("₹"), grouped(x)))
        .otherwise("NA")
    )


def pct(c, places: int = 1) -> Column:
    """A fraction as a percentage."""
    return F.concat(fixed(_col(c) * 100, places), F.lit("%"))


def signed_pct(c, places: int = 2) -> Column:
    """A fraction as a percentage with + where it is positive; NA for null."""
    x = _col(c)
    sign = F.when(x > 0, "+").otherwise("")
    return F.when(x.isNull() | F.isnan(x), "NA").otherwise(F.concat(sign, pct(x, places)))


def points(c) -> Column:
    """Fractions (up to 1) become percentages; larger numbers already are."""
    x = _col(c)
    return F.when(F.abs(x) <= 1, x * 100).otherwise(x)


def share_pct(c) -> Column:
    text = F.concat(fixed(points(c), 1), F.lit("%"))
    return F.when(text == "-0.0%", "0.0%").otherwise(text)


def crore(c) -> Column:
    """₹12.34 Cr, without trailing `.00`."""
    return F.concat(F.lit("₹"), F.regexp_replace(fixed(_col(c), 2), r"\.00$", ""), F.lit(" Cr"))


def period_text(c) -> Column:
    """`2001-01..2001-10 (YTD)` style text as `Jan–Oct 2001 (YTD)`."""
    period = _col(c)
    shape = F.lit(r"(\d{4})-(\d{2})")
    years = F.regexp_extract_all(period, shape, 1)
    months = F.regexp_extract_all(period, shape, 2)
    names = F.array(*[F.lit(m) for m in MONTHS])

    def month(at: Column) -> Column:
        return F.get(names, F.element_at(months, at).try_cast("int") - 1)

    first, last = F.lit(1), F.lit(-1)
    y1, y2 = F.try_element_at(years, first), F.try_element_at(years, last)
    one = F.concat(month(first), F.lit(" "), y1)
    same = F.concat(month(first), F.lit("–"), month(last), F.lit(" "), y1)
    across = F.concat(one, F.lit("–"), month(last), F.lit(" "), y2)
    text = F.when(F.size(years) == 1, one).when(y1 == y2, same).otherwise(across)
    ytd = F.when(F.upper(period).contains("YTD"), " (YTD)").otherwise("")
    return F.when(F.size(years) == 0, period).otherwise(F.concat(text, ytd))


# Lower bounds (in percent or points) of each band and its words.
GROWTH_BANDS = (
    (15, ("surged", "jumped", "climbed sharply")),
    (8, ("grew", "expanded", "picked up")),
    (3, ("inched up", "ticked up", "nudged higher")),
    (-3, ("was flat", "held steady", "was unchanged")),
    (-8, ("softened", "eased", "dipped")),
    (-15, ("declined", "fell", "contracted")),
    (None, ("contracted", "slid", "dropped")),
)
SHARE_BANDS = (
    (50, ("dominates with {} share", "commands {} share", "tops the market at {}")),
    (35, ("leads with {} share", "holds {} share", "is the front-runner at {}")),
    (28, ("holds {} share", "maintains {} share")),
    (22, ("has a narrow lead at {}", "edges ahead at {}", "keeps a slight edge at {}")),
    (None, ("has {} share",)),
)
EDGE_BANDS = (
    (2, ("is neck-and-neck with",)),
    (5, ("has a narrow lead over", "edges past")),
    (10, ("leads over",)),
    (None, ("is well ahead of",)),
)


def choose(options, pick: Column) -> Column:
    """One of the options by `pick` modulo their number; only the chosen one is built."""
    options = [F.lit(o) if isinstance(o, str) else o for o in options]
    if len(options) == 1:
        return options[0]
    at = F.pmod(pick, F.lit(len(options)))
    out = F.when(at == 0, options[0])
    for i, option in enumerate(options[1:-1], start=1):
        out = out.when(at == i, option)
    return out.otherwise(options[-1])


def _fill(text: str, value: Column) -> Column:
    before, after = text.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def growth_words(percent: Column, pick: Column) -> Column:
    """A verb for a growth in percent. The three lower bands exclude their bound."""
    out = None
    for bound, words in GROWTH_BANDS:
        option = choose(words, pick)
        if bound is None:
            return out.otherwise(option)
        test = percent >= bound if bound > 0 else percent > bound
        out = F.when(test, option) if out is None else out.when(test, option)
    return out


def share_phrase(share: Column, pick: Column) -> Column:
    p, text = points(share), share_pct(share)
    out = F.when(p.isNull(), "has share")
    for bound, words in SHARE_BANDS:
        option = choose([_fill(w, text) for w in words], pick)
        out = out.otherwise(option) if bound is None else out.when(p >= bound, option)
    return out


def pair_edge(a: Column, b: Column, pick: Column) -> Column:
    gap = F.abs(points(a) - points(b))
    out = F.when(gap.isNull(), "vs")
    for bound, words in EDGE_BANDS:
        option = choose(words, pick)
        out = out.otherwise(option) if bound is None else out.when(gap < bound, option)
    return out


def pick_of(*keys, salt: str = "") -> Column:
    """A stable number per key for choosing wordings (no random state)."""
    return F.xxhash64(F.lit(salt), *[_col(k) for k in keys])
