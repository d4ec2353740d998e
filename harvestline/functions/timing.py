"""Time parameters and time columns.

`as_of` is always an argument. It is turned into a literal of the compared column's
own timestamp type, so the comparison needs no cast and reaches the parquet scan.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resolve(as_of: datetime | None) -> datetime:
    """`as_of` as naive UTC; the clock only where none is given."""
    if as_of is None:
        return datetime.now(timezone.utc).replace(tzinfo=None)
    if as_of.tzinfo is not None:
        return as_of.astimezone(timezone.utc).replace(tzinfo=None)
    return as_of


def instant(value: datetime, kind: T.DataType | None = None) -> Column:
    """Literal timestamp; `kind` is the type of the column it is compared with."""
    name = "timestamp" if isinstance(kind, T.TimestampType) else "timestamp_ntz"
    text = resolve(value).isoformat(sep=" ")
    if name == "timestamp":
        text += " UTC"
    return F.lit(text).cast(name)


def instant_like(df: DataFrame, column: str, value: datetime) -> Column:
    return instant(value, df.schema[column].dataType)


def since(df: DataFrame, column: str, as_of: datetime, *, strict: bool = False,
          **span: float) -> Column:
    """`column` lies within the last `span` before `as_of` (hours=, minutes=, days=)."""
    bound = instant_like(df, column, resolve(as_of) - timedelta(**span))
    return F.col(column) > bound if strict else F.col(column) >= bound


def until(df: DataFrame, column: str, as_of: datetime, **span: float) -> Column:
    """`column` is not newer than `as_of` less `span`."""
    return F.col(column) <= instant_like(df, column, resolve(as_of) - timedelta(**span))


def period_ym(ts: Column) -> Column:
    """Budget period of a timestamp, `YYYY-MM`."""
    return F.date_format(ts, "yyyy-MM")


def needed_by(start: Column, lead_days: Column, default_days: int = 7) -> Column:
    """Delivery date; an unknown or zero lead time counts as a week."""
    days = F.coalesce(F.nullif(lead_days, F.lit(0)), F.lit(default_days)).cast("int")
    return F.date_add(start.cast("date"), days)


def ingest_ts(df: DataFrame, name: str = "ingest_ts") -> DataFrame:
    """Stamp rows with the processing time."""
    return df.withColumn(name, F.current_timestamp())
