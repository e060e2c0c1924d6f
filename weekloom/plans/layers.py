"""The layer tables as chains of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weekloom.operators.clean import (
    contains_text,
    drop_columns,
    exclude_types,
    flag_period,
    flag_promo,
    keep_items,
    run_steps,
)
from weekloom.operators.weekly import (
    fill_gaps,
    min_weeks,
    silver_rollup,
    silver_rows,
    sort_by_volume,
    weekly_rollup,
)
from weekloom.settings import (
    DROPPED_COLUMNS,
    EXCLUDED_TYPES,
    FLAGGED_PERIOD,
    MIN_WEEKS_GOLD,
    MIN_WEEKS_TRAINING,
)
from weekloom.sources.tables import write_parquet
from weekloom.spec import DEFAULT, SeriesSpec


def silver(sales: DataFrame, retailers: DataFrame | None = None) -> DataFrame:
    return silver_rollup(sales, retailers)


def weekly_gold(
    silver_table: DataFrame,
    types=EXCLUDED_TYPES,
    site_text: str | None = None,
    items=None,
    period=FLAGGED_PERIOD,
    weeks: int = MIN_WEEKS_GOLD,
    ordered: bool = True,
    count_rows: bool = False,
    output: str | None = None,
    compression: str = "snappy",
    spec: SeriesSpec = DEFAULT,
):
    """Cleaned, gap-free weekly table from silver rows, daily or single ones.

    ``ordered`` adds the final global sort, which only a reader of the result needs. With ``count_rows`` the row
    counts after each step are returned as well, to be read after an action on the result.
    """
    steps = [
        (exclude_types, [types]),
        flag_promo,
        (drop_columns, [DROPPED_COLUMNS]),
        (flag_period, [period]),
    ]
    if site_text is not None:
        steps.append((contains_text, [spec.keys[0], site_text]))
    if items is not None:
        steps.append((keep_items, [items, spec.keys[-1]]))
    steps += [
        (weekly_rollup, [spec]),
        (fill_gaps, [period, spec]),
        (min_weeks, [weeks, spec]),
    ]
    if ordered:
        steps.append((sort_by_volume, [spec]))
    table, observed = run_steps(silver_table, steps, count_rows)
    if output is not None:
        write_parquet(table, output, compression)
        table = table.sparkSession.read.schema(table.schema).parquet(output)
    return (table, observed) if count_rows else table


def weekly_gold_from_sales(sales: DataFrame, retailers: DataFrame | None = None, **options):
    """``weekly_gold`` without a stored silver table.

    Weekly sums of single sales equal weekly sums of daily sums, so the shuffle of the daily rollup is saved.
    """
    return weekly_gold(silver_rows(sales, retailers), **options)


def training_gold(gold: DataFrame, weeks: int = MIN_WEEKS_TRAINING, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return min_weeks(gold, weeks, spec)
