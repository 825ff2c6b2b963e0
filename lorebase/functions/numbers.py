"""Times and numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_time(c: Column) -> Column:
    """Timestamp of an ISO 8601 text, null where it can't be read."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.replace(c, F.lit("Z"), F.lit("+00:00")).try_cast("timestamp"))


def minute_stem(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HHmm")


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def kilobytes(size: Column) -> Column:
    return F.bround(size / F.lit(1024.0), 1)


def index_percentile(values: Column, share: float) -> Column:
    """The element at ``floor(n * share)`` of the ascending values (neither interpolated nor a discrete percentile)."""
    ordered = F.array_sort(values)
    return F.try_element_at(ordered, (F.floor(F.size(ordered) * F.lit(share)) + 1).cast("int"))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


# fixed values: dollars per million tokens (input, output, cache write, cache read) by model prefix; first match counts
PRICES = (("harrow-lite", 0.80, 4.0, 1.0, 0.08), ("harrow", 3.0, 15.0, 3.75, 0.30), ("mallow", 15.0, 75.0, 18.75, 1.50))
DEFAULT_PRICE = (3.0, 15.0, 3.75, 0.30)


def price_of(model: Column, part: int, prices=PRICES, default=DEFAULT_PRICE) -> Column:
    """Price of a model by its prefix; ``part`` 0..3."""
    out = None
    for prefix, *p in prices:
        out = (F.when if out is None else out.when)(model.startswith(prefix), F.lit(p[part]))
    return out.otherwise(F.lit(default[part])) if out is not None else F.lit(default[part])


def cost(model: Column, parts: list[Column], prices=PRICES, default=DEFAULT_PRICE) -> Column:
    """Dollars of (input, output, cache write, cache read) tokens; nulls are 0. ``prices``: as PRICES, by prefix."""
    total = F.lit(0.0)
    for i, p in enumerate(parts):
        total = total + F.coalesce(p, F.lit(0)) * price_of(model, i, prices, default)
    return total / 1_000_000
