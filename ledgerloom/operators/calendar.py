"""Days that move: floating holidays, and what days of the year do to spending inside a quarter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nth(year: Column, month: int, day: str, n: int) -> Column:
    """The n-th weekday of a month; the last one for n = -1."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n > 0:
        return F.date_add(F.next_day(F.date_sub(first, 1), day), 7 * (n - 1))
    return F.date_sub(F.next_day(F.last_day(first), day), 7)


def super_bowl(year: Column) -> Column:
    """The second Sunday of February since 2022, the first one before."""
    return F.when(year >= 2022, nth(year, 2, "Sun", 2)).otherwise(nth(year, 2, "Sun", 1))


#: Factors of days by kind of spending. Fixed values.
RETAIL = {"thanksgiving": 0.35, "black_friday": 1.9, "12-25": 0.1, "12-24": 1.3} | {f"12-{d}": 1.25 for d in range(15, 24)}
RESTAURANT = {"thanksgiving": 0.55, "12-25": 0.35, "07-04": 0.9}
FACTORS = {
    "retail": RETAIL, "restaurant": RESTAURANT, "pizza": RESTAURANT | {"super_bowl": 1.6}, "dinner": RESTAURANT | {"02-14": 1.35, "mothers_day": 1.4},
    "weekend": RETAIL | {"labor_weekend": 1.3, "memorial_weekend": 1.3},
}


def holiday_factor(date: Column, kind: str) -> Column:
    """The product of the factors of what a date is."""
    y = F.year(date)
    thanksgiving = nth(y, 11, "Thu", 4)
    upto = lambda day: date.between(F.date_sub(day, 2), day)
    named = {
        "thanksgiving": date == thanksgiving, "black_friday": date == F.date_add(thanksgiving, 1), "super_bowl": date == super_bowl(y), "mothers_day": date == nth(y, 5, "Sun", 2),
        "labor_weekend": upto(nth(y, 9, "Mon", 1)), "memorial_weekend": upto(nth(y, 5, "Mon", -1)),
    }
    out = F.lit(1.0)
    for what, factor in FACTORS[kind].items():
        is_it = named[what] if what in named else F.date_format(date, "MM-dd") == what
        out = out * F.when(is_it, factor).otherwise(1.0)
    return out
