"""Calendar expressions: business month ends and the first tradable month end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def business_month_end(day: Column) -> Column:
    """Last Monday-to-Friday of the month; holidays are not known."""
    last = F.last_day(day)
    return F.date_sub(last, F.greatest(F.weekday(last) - 4, F.lit(0)))


def business_day_before(day: Column) -> Column:
    """The weekday before a weekday."""
    return F.date_sub(day, F.when(F.weekday(day) == 0, 3).otherwise(1))


def formation_month_end(filed: Column) -> Column:
    """First month end at least one business day after the filing date."""
    usable = filed <= business_day_before(business_month_end(filed))
    # A filing on a weekend after the last business day belongs to the next month already.
    return F.when(usable, F.last_day(filed)).otherwise(F.last_day(F.add_months(filed, 1)))
