"""Answer one intent: MAT comparison, year on year, month on month, Top-N or total."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import DataFrame

from salesgrid.operators import agg, compare
from salesgrid.operators.filters import apply_filters, safe_numeric_fill
from salesgrid.operators.questions import COMPARE_WORDS, MAT_WORDS, MAT_YEAR, extract_intents, match_brands
from salesgrid.operators.windows import MonthWindow, hull, last_month, resolve_window, with_prev_year

BRAND_SPLIT = re.compile(r"\s*(?:,|&|\+|\band\b)\s*", re.IGNORECASE)


@dataclass(frozen=True)
class Intent:
    task: str = "topn"
    measure: str = "value_sales"
    dims: tuple = ()
    filters: dict = field(default_factory=dict)
    mode: str | None = None
    start: str | None = None
    end: str | None = None
    top_n: int = 5
    sort_by: str | None = None
    is_yoy: bool = False
    mom: bool = False
    brand_group: bool = False
    text: str = ""


def _mat_years(text: str) -> list[int]:
    years = [int(y) for y in re.findall(MAT_YEAR, text)]
    return list(dict.fromkeys(y + 2000 if y < 100 else y for y in years))


def previous_month(as_of: str) -> tuple[int, int]:
    day = date.fromisoformat(as_of)
    return (day.year, day.month - 1) if day.month > 1 else (day.year - 1, 12)


def settle_brands(intent: Intent) -> Intent:
    """Split a written brand list; a single brand does not restrict a brand grouping."""
    filters = dict(intent.filters)
    brands, group = filters.get("brand"), intent.brand_group
    if isinstance(brands, str):
        parts = [p for p in BRAND_SPLIT.split(brands.strip()) if p]
        if len(parts) > 1:
            filters["brand"], group = parts, True
    many = filters.get("brand")
    if group and many is not None and (isinstance(many, str) or len(many) <= 1):
        del filters["brand"]
    return replace(intent, filters=filters, brand_group=group)


def free_dims(intent: Intent) -> list[str]:
    """The dims to group by: no date, no filtered dims, brand only when grouped."""
    grouped = intent.brand_group
    dims = [d for d in intent.dims if d != "date"]
    dims = [d for d in dims if d not in intent.filters or (grouped and d == "brand")]
    return dims if grouped else [d for d in dims if d != "brand"]


def compared_years(intent: Intent, as_of: str) -> list[int]:
    """The years whose MATs the text asks to compare, newest default first; none if it asks for no MATs."""
    text = intent.text.lower()
    years = _mat_years(text)
    if re.search(MAT_WORDS, text) and (re.search(COMPARE_WORDS, text) or len(years) >= 2):
        year = previous_month(as_of)[0]
        return years or [year, year - 1]
    return []


def months_read(intent: Intent, as_of: str, months: DataFrame) -> MonthWindow:
    """The span of months that `answer` reads for an intent: hand it to the scan of the fact."""
    years = compared_years(intent, as_of)
    if years:
        spans = compare.mat_windows(years, previous_month(as_of)[1], last_month(months))
        return hull(*[w for _, w in spans])
    window = resolve_window(months, intent.mode, as_of, intent.start, intent.end)
    return with_prev_year(window) if intent.is_yoy else window


def answer(df: DataFrame, intent: Intent, as_of: str, months: DataFrame | None = None) -> DataFrame:
    """The intent's result over fact rows or sales lines.

    `months` is a cheaper frame with the same `date` range, used to resolve windows.
    """
    months = df if months is None else months
    intent = settle_brands(intent)
    base = apply_filters(df, intent.filters)
    dims, years = free_dims(intent), compared_years(intent, as_of)
    if years:
        month = previous_month(as_of)[1]
        out = compare.mat_compare(base, years, month, dims, intent.measure, last_month(months))
        return safe_numeric_fill(out)
    window = resolve_window(months, intent.mode, as_of, intent.start, intent.end)
    if intent.is_yoy:
        ranked = intent.task == "topn" or intent.sort_by in ("value_yoy", "unit_yoy")
        n = intent.top_n if ranked else None
        return safe_numeric_fill(compare.yoy(base, dims, intent.measure, window, n))
    if intent.mom or intent.sort_by == "value_mom":
        if intent.task == "topn" and dims:
            out = compare.mom_top_n(base, dims, intent.measure, window, intent.top_n)
        else:
            out = compare.mom(base, dims, intent.measure, window)
        return safe_numeric_fill(out)
    inside = base.filter(window.has("date"))
    if intent.task == "topn":
        out = agg.top_n_or_total(
            inside, intent.dims, intent.measure, intent.top_n, intent.filters, intent.brand_group
        )
    else:
        out = agg.total(
            inside, intent.measure, intent.dims, intent.filters, intent.task, intent.brand_group
        )
    return safe_numeric_fill(out)


def parse_question(spark, text: str) -> Intent:
    """The intent of one question, by the same rules as for tables of questions."""
    one = spark.createDataFrame([(text,)], "text string")
    row = extract_intents(one).first()
    filters = {
        d: row[f"filter_{d}"]
        for d in ("category", "market", "channel", "brand")
        if row[f"filter_{d}"]
    }
    return Intent(
        task=row["task"], measure=row["measures"][0], dims=tuple(row["dims"]), filters=filters,
        mode=row["mode"], start=row["range_start"], end=row["range_end"], top_n=row["top_n"],
        sort_by=row["sort_by"], is_yoy=row["is_yoy"], mom=row["mom"], brand_group=row["by_brand"],
        text=text,
    )


def with_named_brands(intent: Intent, brands: DataFrame) -> Intent:
    """Brands that the text names (of the column `brand`) become its filter, several also its grouping.

    A written `brand:` filter stays as it is.
    """
    if "brand" in intent.filters:
        return intent
    one = brands.sparkSession.createDataFrame([(0, intent.text)], "question_id int, text string")
    named = match_brands(one, brands).first()["brands"]  # bounded by the words of one question
    if not named:
        return intent
    several = len(named) > 1
    dims = intent.dims if not several or "brand" in intent.dims else (*intent.dims, "brand")
    return replace(
        intent, filters={**intent.filters, "brand": list(named) if several else named[0]}, dims=dims,
        brand_group=intent.brand_group or several,
    )


def ask(
    df: DataFrame, text: str, as_of: str, months: DataFrame | None = None, brands: DataFrame | None = None
) -> DataFrame:
    """The answer to one question. `brands` is a table of the known names (column `brand`), by
    default those of the fact."""
    intent = parse_question(df.sparkSession, text)
    if "brand" in df.columns:
        intent = with_named_brands(intent, df.select("brand").distinct() if brands is None else brands)
    return answer(df, intent, as_of, months)

