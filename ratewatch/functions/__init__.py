"""Column functions that the jobs share; bad input gives null, never an error."""

from ratewatch.functions.scalars import (  # noqa: F401
    any_keyword,
    day_first_date,
    decimal_number,
    guarded_ratio,
    is_true,
    iso_instant,
    map_value,
    money,
    percent_change,
    prefix,
    published_at,
    signed,
    split_once,
    tidy,
)
