"""Calendar and clock operators. Timestamps without a zone are read as UTC; strings that are no time raise or give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.registry import Need, OperatorError, declare

UNITS = {"days": 86_400e6, "hours": 3_600e6, "minutes": 60e6, "seconds": 1e6}


def moment(df: DataFrame, column: str) -> Column:
    """The column as a timestamp."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c
    if isinstance(kind, T.StringType):
        return c.try_cast("timestamp_ntz")
    raise OperatorError(f"{column!r} is not a time")


def micros(c: Column) -> Column:
    """Microseconds since 1970, the wall clock read as UTC whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


_PARTS = {
    "extract_year": F.year, "extract_month": F.month, "extract_day": F.dayofmonth, "extract_hour": F.hour, "extract_minute": F.minute, "extract_second": F.second,
    "extract_quarter": F.quarter, "extract_dayofweek": F.weekday, "is_weekend": lambda t: F.coalesce(F.weekday(t) >= 5, F.lit(False)).cast("int"),
    "is_month_start": lambda t: (F.dayofmonth(t) == 1).cast("int"), "is_month_end": lambda t: (F.to_date(t) == F.last_day(t)).cast("int"),
    "is_business_hour": lambda t: (F.hour(t).between(9, 17) & (F.weekday(t) < 5)).cast("int"),
}


def _time(columns: list[str]) -> Column:
    """moment() of a column whose type was checked before."""
    return F.col(f"`{columns[0]}`").try_cast("timestamp_ntz")


def _is_time(df: DataFrame, columns: list[str]) -> None:
    moment(df, columns[0])


def _part(name: str, rule) -> None:
    declare("datetime", name, lambda columns, s: rule(_time(columns)), check=_is_time)


for _name, _rule in _PARTS.items():
    _part(_name, _rule)


def _unit(unit: str) -> float:
    if unit not in UNITS:
        raise OperatorError(f"unknown unit {unit!r}")
    return UNITS[unit]


def _given(when: str) -> Column:
    return micros(F.lit(when).cast("timestamp_ntz"))


def _since(columns: list[str], s: dict, reference_date: str | None = None, unit: str = "days") -> Column:
    return (micros(_time(columns)) - (F.lit(s["reference"]) if reference_date is None else _given(reference_date))) / F.lit(_unit(unit))


def _until(columns: list[str], s: dict, event_date: str, unit: str = "days") -> Column:
    return (_given(event_date) - micros(_time(columns))) / F.lit(_unit(unit))


def _wave(columns: list[str], s: dict, part: str = "month", wave: str = "sin") -> Column:
    t = _time(columns)
    value, period = {"month": (F.month(t), 12), "dayofweek": (F.weekday(t), 7)}[part]
    return {"sin": F.sin, "cos": F.cos}[wave](F.lit(6.283185307179586) * value / F.lit(float(period)))


def _since_needs(columns: list[str], reference_date: str | None = None, unit: str = "days") -> Need:
    _unit(unit)
    return Need({"reference": F.min(micros(_time(columns)))} if reference_date is None else {})


def _until_needs(columns: list[str], event_date: str, unit: str = "days") -> Need:
    _unit(unit)
    return Need()


# time_since_reference: time since a reference, by default the earliest time of the fitted table.
declare("datetime", "time_since_reference", _since, _since_needs, _is_time)
# time_to_event: time until a given event.
declare("datetime", "time_to_event", _until, _until_needs, _is_time)
# cyclic: sine or cosine of the month (period 12) or of the day of the week (period 7).
declare("datetime", "cyclic", _wave, check=_is_time, label=lambda columns, part="month", wave="sin": f"{part}_{wave}({columns[0]})")
