"""New versions of mutable tables: keyed upserts, partial updates, appended log rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestline import schemas
from harvestline.functions import text, timing
from harvestline.operators import quality


def dim_upsert(current: DataFrame, incoming: DataFrame, key: str | Sequence[str], *,
               check: bool = True) -> DataFrame:
    """Matched keys take the incoming row whole, new keys are added.

    A repeated key in `incoming` has no defined winner and is refused.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if check:
        quality.assert_unique(incoming, keys, "upsert")
    return current.join(incoming.select(*keys), keys, "left_anti").unionByName(
        incoming.select(*current.columns))


def state_update(current: DataFrame, delta: DataFrame, key: str, columns: Sequence[str], *,
                 overwrite_null: bool = False, check: bool = True) -> DataFrame:
    """Replace `columns` in the rows `delta` names; other rows and columns stay.

    By default a NULL in `delta` leaves the old value; `overwrite_null` writes it. A key
    that `delta` repeats has no defined winner and is refused.
    """
    if check:
        quality.assert_unique(delta, [key], "state update")
    marked = delta.select(
        key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = current.join(marked, key, "left")

    def value(name: str) -> Column:
        if name not in columns:
            return F.col(name)
        if overwrite_null:
            new = F.when(F.col("_hit"), F.col(f"_new_{name}")).otherwise(F.col(name))
        else:
            new = F.coalesce(f"_new_{name}", name)
        return new.alias(name)

    return joined.select(*[value(c) for c in current.columns])


def run_log(rows: DataFrame, agent: str, started: datetime, *, input_ref: Column,
            output_ref: Column, status: Column | None = None, error: Column | None = None,
            prompt_tokens: Column | None = None, output_tokens: Column | None = None,
            finished: datetime | None = None) -> DataFrame:
    """One audit row per processed row, in the shape of `agent_runs`."""
    kind = schemas.STATE["agent_runs"]["started_ts"].dataType
    return rows.select(
        text.stable_id("RUN", F.lit(agent), input_ref, F.lit(started.isoformat())).alias("run_id"),
        timing.instant(started, kind).alias("started_ts"),
        timing.instant(finished or started, kind).alias("finished_ts"),
        F.lit(agent).alias("agent_name"),
        input_ref.cast("string").alias("input_ref"),
        output_ref.cast("string").alias("output_ref"),
        (F.lit(0) if prompt_tokens is None else prompt_tokens).cast("int").alias("prompt_tokens"),
        (F.lit(0) if output_tokens is None else output_tokens).cast("int").alias("output_tokens"),
        (F.lit("OK") if status is None else status).alias("status"),
        (F.lit(None) if error is None else error).cast("string").alias("error_msg"),
    )


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Per-column values for NULLs; a default of the wrong type raises, none is skipped."""
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in defaults.items()
    })
