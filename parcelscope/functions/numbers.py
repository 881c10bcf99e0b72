"""Money and number expressions.

On the price paths a zero counts as missing, so ``present`` turns it into NULL before
any ``coalesce``. Rounding is half-even throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from parcelscope import vocab

_DOLLARS = r"\$\s*([\d,]+(?:\.\d+)?)\s*([mMkK])?"


def present(value: Column) -> Column:
    return F.nullif(value, F.lit(0))


def whole(value: Column) -> Column:
    """Half-even rounding to a whole number (bigint)."""
    return F.bround(value.cast("double")).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression that uses it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding to ``digits`` places of the exact binary value.

    The scaled product can land on a tie only because it was itself rounded. Splitting
    the value in two halves gives the product's exact error, which breaks such ties.
    """
    scale = float(10**digits)

    def near(x: Column) -> Column:
        y = x * scale
        high = x * 134217729.0 - (x * 134217729.0 - x)  # upper half of the mantissa (2**27 + 1)
        error = (high * scale - y) + (x - high) * scale
        floor = F.floor(y)
        even = F.rint(y) + 0.0  # as bround to a whole number, without its detour over decimals; no negative zero
        up = F.when(error > 0, floor + 1).when(error < 0, floor).otherwise(even)
        return F.when(y - floor == 0.5, up).otherwise(even) / scale

    return let(value.cast("double"), near)


def ask_price(exact: Column, low: Column, high: Column) -> Column:
    """Exact price, else the midpoint, else whichever bound is known."""
    lo, hi = present(low.cast("double")), present(high.cast("double"))
    return F.coalesce(present(exact.cast("double")), (lo + hi) / 2.0, lo, hi)


def midpoint(low: Column, high: Column) -> Column:
    return ask_price(F.lit(None), low, high)


def effective_price(sold: Column, low: Column, high: Column, display: Column) -> Column:
    return F.coalesce(
        present(sold.cast("double")), midpoint(low, high), display_price(display)
    )


def display_price(text: Column, min_amount: float = 1000) -> Column:
    """Mean of every dollar amount in a guide text (m/k suffixes, small ones dropped)."""

    def amount(number: Column, suffix: Column) -> Column:
        unit = F.when(F.lower(suffix) == "m", 1e6).when(F.lower(suffix) == "k", 1e3).otherwise(1.0)
        return F.regexp_replace(number, ",", "").try_cast("double") * unit

    def found(group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(_DOLLARS), F.lit(group))

    def mean(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
        return F.when(F.size(values) > 0, total / F.size(values))

    return let(F.filter(F.zip_with(found(1), found(2), amount), lambda v: v >= min_amount), mean)


def first_amount(text: Column, min_amount: int = 10_000) -> Column:
    """First number run of a text, accepted only from ``min_amount`` up."""
    digits = F.regexp_replace(F.regexp_extract(text, r"\d[\d,]*", 0), ",", "")
    amount = digits.try_cast("bigint")
    return F.when(amount >= min_amount, amount)


def sold_price(sold: Column, display: Column) -> Column:
    return F.coalesce(present(sold.cast("double")), display_price(display))


def as_int(value: Column) -> Column:
    """Truncating whole-number cast of a number, NULL on failure."""
    return value.try_cast("double").try_cast("bigint")


def per_bed(price: Column, beds: Column) -> Column:
    b = beds.try_cast("double")
    return F.when((b > 0) & present(price).isNotNull(), F.bround(price.cast("double") / b))


def bed_delta(a: Column, b: Column) -> Column:
    return F.abs(a.try_cast("double") - b.try_cast("double"))


def bed_match(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    return F.coalesce(bed_delta(a, b) <= tolerance, F.lit(False))


def transfer_duty(price: Column, bands=vocab.TAX_BANDS) -> Column:
    """Progressive duty: base of the band plus its rate on the part above its floor."""
    p = price.cast("double")
    duty = None
    for floor, ceiling, base, rate in bands:
        owed = base + (p - floor) * rate
        hit = p > 0 if ceiling is None else (p > 0) & (p <= ceiling)
        duty = F.when(hit, owed) if duty is None else duty.when(hit, owed)
    return F.bround(duty)


def cash_to_buy(price: Column) -> Column:
    return F.bround(price * 0.10) + F.coalesce(transfer_duty(price), F.lit(0.0))


def cash_to_rent(weekly: Column) -> Column:
    return weekly * 6


def affordability(median: Column, budget: Column) -> Column:
    """1 up to 80% of budget, 0 from 130%, a straight ramp between."""
    ratio = present(median) / present(budget)
    ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (ratio - 0.8) / 0.5))
    # least and greatest skip NULLs, so a missing ratio must not reach the ramp
    return F.when(ratio <= 0.8, 1.0).when(ratio >= 1.3, 0.0).when(ratio.isNotNull(), ramp)


def array_median(values: Column) -> Column:
    """Exact median of a short array of numbers."""
    s = F.sort_array(values)
    n = F.size(s)
    mid = (
        F.element_at(s, F.floor((n + 1) / 2).cast("int"))
        + F.element_at(s, F.floor((n + 2) / 2).cast("int"))
    ) / 2.0
    return F.when(n > 0, mid)


def best_point(point: Column, low: Column, high: Column) -> Column:
    return F.coalesce(point, (low + high) / 2.0, low, high).cast("double")


def half_spread(low: Column, high: Column) -> Column:
    return (high - low) / 2.0
