"""From tables of questions to query intents: word tests, extracts and brand look-ups.

All rules are column expressions over whole texts; one row in, one row out, except the
brand look-up, which joins on normalised names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesgrid.functions.sums import same_keys

FILTER_DIMS = ("category", "market", "channel", "brand")
DEFAULT_TOP = 10

# The words that decide each field.
CHART_WORDS = r"\b(trends?|over time|time ?series|line charts?|charts?)\b"
TABLE_WORDS = r"\b(top|bottom|tables?|rank(s|ed|ing)?)\b"
TEXT_WORDS = r"\b(explain(s|ed)?|insights?|summary)\b"
UNIT_WORDS = r"\bunits?\b"
YOY_WORDS = r"\byoy\b"
MOM_WORDS = r"\b(mom|m/m|month over month|monthly change)\b"
MAT_WORDS = r"\b(mat(\s?-?(20)?\d{2})?|moving annual total|last 12|last twelve)\b"
YTD_WORDS = r"\b(ytd|year to date|year-to-date)\b"
EXTREME_WORDS = r"\b(top|bottom)\b"
BY_BRAND = r"\bby\s+brands?\b"
TOP_BRANDS = r"\btop(\s+\d+)?\s+brands?\b"
TOP_NUMBER = r"\btop\s+(\d+)"
MONTH_YEAR = (
    r"\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\W*(\d{4})\b"
)
MONTH_STEMS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# A bare filter value ends before the next key, a time phrase or a month with its year.
VALUE_END = (
    r"^(category|market|channel|brand)$|\s+\b(category|market|channel|brand)\b.*$"
    r"|(^|\s+)\b(from|between|in|for|by|over|last|ytd|mat|top|yoy|mom"
    r"|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\W*\d{4})\b.*$"
)
BARE_VALUE = r"([a-z0-9#][a-z0-9#\s\-&]*)"
BRAND_LIST = r"\bbrands?(?:\s*[:\-]\s*|\s+)([a-z0-9 #_/,&+\-]+)"
LIST_SPLIT = r"\s*(?:,|&|\+|\band\b|\bvs\b|\bversus\b)\s*"
MAT_YEAR = r"\bmat[\s\-]?((?:20)?\d{2})\b"
COMPARE_WORDS = r"\b(compare|vs|versus|comparison)\b"
TOTAL_WORDS = r"(?i)\b(total|overall|aggregate|grand\s*total|sum|cumulative|combined|net\s+sales)\b"
TREND_WORDS = (
    r"(?i)\b(trend|over\s+time|month[-\s]*wise|monthly|line\s*chart|last\s+\d+\s+months)\b"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squash(c) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "")


def _non_empty(c: Column) -> Column:
    return F.when(c != "", c)


def has(text: Column, words: str, *stems: str) -> Column:
    """Does the pattern occur? Plain searches for its stems spare most texts the pattern."""
    found = text.contains(stems[0])
    for stem in stems[1:]:
        found = found | text.contains(stem)
    return found & text.rlike(words)


def month_of(text: Column, which: int) -> Column:
    """`YYYY-MM` of the n-th month-year mention, null if there is none."""
    names = F.regexp_extract_all(text, F.lit(MONTH_YEAR), 1)
    years = F.regexp_extract_all(text, F.lit(MONTH_YEAR), 2)
    stems = F.array(*[F.lit(m) for m in MONTH_STEMS])
    number = F.array_position(stems, F.substring(F.get(names, which - 1), 1, 3))
    month = F.concat(F.get(years, which - 1), F.lit("-"), F.lpad(number.cast("string"), 2, "0"))
    return F.when(text.rlike(r"\d{4}"), month)


def filter_value(text: Column, dim: str) -> Column:
    """The value after `dim:` or `dim=`, quoted or bare; null if there is none."""
    quoted = [
        F.regexp_extract(text, dim + r"\s*[:=]\s*" + shape, 1)
        for shape in ('"([^"]+)"', "'([^']+)'")
    ]
    bare = F.regexp_extract(text, dim + r"\s*[:=]\s*" + BARE_VALUE, 1)
    bare = F.regexp_replace(bare, VALUE_END, "")
    found = [_non_empty(F.trim(c)) for c in (*quoted, bare)]
    # Most questions have no filter: a plain search for the key spares them the patterns.
    keyed = text.contains(dim) & (text.contains(":") | text.contains("="))
    return F.when(keyed, F.coalesce(*found))


def extract_intents(questions: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the intent of every question: task, measures, dims, filters, time, top-n, flags.

    A question without chart or text words is a Top-N (of 10 unless it says how many).
    Year-to-date wins over moving annual total; both win over written-out months.
    """
    t = F.lower(F.col(text_col))
    by_brand = has(t, BY_BRAND, "brand")
    filters = {d: filter_value(t, d) for d in FILTER_DIMS}
    task = (
        F.when(has(t, CHART_WORDS, "trend", "time", "chart"), "chart")
        .when(has(t, TABLE_WORDS, "top", "bottom", "table", "rank"), "topn")
        .when(has(t, TEXT_WORDS, "explain", "insight", "summary"), "text")
        .otherwise("topn")
    )
    unit, yoy = has(t, UNIT_WORDS, "unit"), has(t, YOY_WORDS, "yoy")
    mom = has(t, MOM_WORDS, "mom", "m/m", "month")
    yoy_rank = yoy & t.rlike(EXTREME_WORDS)
    base = F.when(unit, "unit_sales").otherwise("value_sales")
    growth = F.when(yoy, F.when(unit, "unit_yoy").otherwise("value_yoy"))
    number = F.when(t.contains("top"), _non_empty(F.regexp_extract(t, TOP_NUMBER, 1)))
    number = number.try_cast("int")
    mode = F.when(has(t, YTD_WORDS, "ytd", "year"), "YTD").when(
        has(t, MAT_WORDS, "mat", "moving", "last"), "MAT"
    )
    start, end = month_of(t, 1), month_of(t, 2)
    written = mode.isNull() & end.isNotNull()
    sort_by = (
        F.when(yoy_rank, "value_yoy")
        .when(number.isNotNull(), "value_sales")
        .when(yoy, "value_yoy")
        .when(mom, "value_mom")
    )
    out = questions.withColumns(
        {
            "task": task,
            "measures": F.array_compact(F.array(base, growth)),
            "by_brand": by_brand,
            "top_n": F.coalesce(number, F.lit(DEFAULT_TOP)).cast("bigint"),
            "sort_by": sort_by,
            "sort_order": F.lit("desc"),
            "is_yoy": yoy,
            "mom": mom,
            "mode": mode,
            "range_start": F.when(written, start),
            "range_end": F.when(written, end),
            **{f"filter_{d}": c for d, c in filters.items()},
        }
    )
    wants_brand = by_brand | yoy_rank | has(t, TOP_BRANDS, "top")
    fixed_brand = F.col("filter_brand").isNotNull() & ~F.col("by_brand")
    dims = F.array_compact(
        F.array(
            F.when((F.col("task") != "topn") & ~yoy_rank, F.lit("date")),
            F.when(wants_brand & ~fixed_brand, F.lit("brand")),
        )
    )
    return out.withColumn("dims", dims).withColumn(
        "has_brand_filter", F.col("filter_brand").isNotNull()
    )


def mat_years(c) -> Column:
    """Years named as `mat24`, `mat 2024` or `mat-2024`, each once, in order."""
    found = F.regexp_extract_all(F.lower(_col(c)), F.lit(MAT_YEAR), 1)
    years = found.cast("array<int>")
    return F.array_distinct(F.transform(years, lambda y: F.when(y < 100, y + 2000).otherwise(y)))


def extract_mat_years(questions: DataFrame, text_col: str = "text") -> DataFrame:
    """Add `mat_years` and whether the question compares moving annual totals."""
    t = F.lower(F.col(text_col))
    out = questions.withColumn("mat_years", mat_years(text_col))
    compares = has(t, MAT_WORDS, "mat", "moving", "last") & (t.rlike(COMPARE_WORDS) | (F.size("mat_years") >= 2))
    return out.withColumn("is_mat_compare", compares)


def calc_mode(questions: DataFrame, text_col: str = "text") -> DataFrame:
    """Add `calc_mode`: total if the question asks for one and for no trend."""
    t = F.col(text_col)
    total, trend = t.rlike(TOTAL_WORDS), t.rlike(TREND_WORDS)
    mode = F.when(total & ~trend, "total").when(trend, "trend").otherwise("other")
    return questions.withColumn("calc_mode", mode)


def explicit_brands(c) -> Column:
    """Items, in lower case, of the lists written after `brand` or `brands`."""
    lists = F.regexp_extract_all(F.lower(_col(c)), F.lit(BRAND_LIST), 1)
    items = F.flatten(F.transform(lists, lambda s: F.split(s, LIST_SPLIT)))
    return F.filter(items, lambda s: squash(s) != "")


def match_brands(questions: DataFrame, brands: DataFrame, text_col: str = "text") -> DataFrame:
    """Add `brands`: the known brands that each question names, sorted.

    Each distinct text is looked up once and its brands are joined back to every row, so rows that
    repeat keep their place.

    A written list ("brands: Alpha, Beta sales") is looked up item by item, by the words that an
    item begins with. Without one, every
    brand counts that is written in the text as whole words, however they are joined: the
    text is cut into words, runs of at most as many words as the longest name has are joined to
    the names, so no question meets every brand and `Brand#1` is not found in `Brand#12`.
    Brands whose normalised names are equal are all named.
    """
    words = F.regexp_extract_all(F.lower("brand"), F.lit("[a-z0-9]+"), 0)
    named = brands.select("brand", squash("brand").alias("__name"), F.size(words).alias("__n"))
    named = named.filter("__name <> ''").distinct()
    longest = named.agg(F.max("__n").alias("n")).scalar()
    base = questions.select(text_col).distinct().select(
        text_col, explicit_brands(text_col).alias("__items"),
        F.regexp_extract_all(F.lower(text_col), F.lit("[a-z0-9]+"), 0).alias("__words"),
    )
    widths = F.sequence(F.lit(1), F.coalesce(longest, F.lit(1)))
    items = base.filter(F.size("__items") > 0).select(text_col, F.explode("__items").alias("__item"))
    begun = items.select(
        text_col, F.regexp_extract_all("__item", F.lit("[a-z0-9]+"), 0).alias("__words"), F.explode(widths).alias("__len")
    )
    listed = begun.select(text_col, F.array_join(F.slice("__words", F.lit(1), F.col("__len")), "").alias("__name"))
    scanned = base.filter(F.size("__items") == 0).select(
        text_col, "__words", F.explode(widths).alias("__len")
    )
    runs = F.transform(
        F.sequence(F.lit(1), F.size("__words") - F.col("__len") + 1),
        lambda at: F.array_join(F.slice("__words", at, F.col("__len")), ""),
    )
    scanned = scanned.filter(F.size("__words") >= F.col("__len")).select(
        text_col, F.explode(F.array_distinct(runs)).alias("__name")
    )
    hits = listed.unionByName(scanned).join(named.select("__name", "brand"), "__name")
    found = hits.groupBy(text_col).agg(F.array_sort(F.collect_set("brand")).alias("brands"))
    out = same_keys(questions, found, [text_col], "left")
    return out.withColumn("brands", F.coalesce("brands", F.array().cast("array<string>")))
