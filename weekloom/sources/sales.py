"""Raw sales tables: reading, date and type repair, load checks.

A loaded table has the columns ``series_id STRING, ds DATE, value DOUBLE, category STRING``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.params import SalesColumns
from weekloom.sources.workbook import read_workbooks, workbook_files

LOADED_COLUMNS = ("series_id", "ds", "value", "category")

# Date layouts tried in turn, and the day zero of spreadsheet serial dates.
DATE_LAYOUTS = ("d-M-yyyy", "yyyy-M-d", "d/M/yyyy", "yyyy-M-d H:m:s")
SERIAL_DAY_ZERO = "1899-12-30"


def read_raw(spark: SparkSession, path: str, fmt: str | None = None, sheet: str | None = None) -> DataFrame:
    """Read Parquet, ORC, CSV or workbooks (the latter two all text, header row) as they are.

    The format follows the suffix. ``sheet`` names a workbook's sheet, * all; else the first is read.
    """
    fmt = fmt or (path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path else "parquet")
    if fmt not in ("parquet", "orc", "csv", "xlsx"):
        raise ValueError(f"unsupported format {fmt!r}: parquet, orc, csv and xlsx are read")
    if fmt == "xlsx":
        workbook_files(path)  # a missing file is told here, not from inside a job
        return read_workbooks(spark, path, sheet)
    reader = spark.read.option("header", "true") if fmt == "csv" else spark.read
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in (err.getCondition() or ""):
            raise FileNotFoundError(f"no dataset at {path}") from err
        raise


def validate_columns(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; found {list(df.columns)}")
    return df


def mixed_date(text: Column, strict: bool = True) -> Column:
    """A DATE from day-first text, ISO text or a spreadsheet serial number.

    Text that fits none of them gives an error at run time when ``strict``, else NULL.
    """
    text = F.trim(text)
    parsed = F.coalesce(
        *[F.try_to_timestamp(text, F.lit(layout)).cast("date") for layout in DATE_LAYOUTS],
        F.date_add(F.lit(SERIAL_DAY_ZERO).cast("date"), text.try_cast("int")),
    )
    if not strict:
        return parsed
    message = F.concat(F.lit("not a date: "), text)
    return F.when(parsed.isNull() & text.isNotNull(), F.raise_error(message)).otherwise(parsed)


def parse_mixed_dates(df: DataFrame, column: str, strict: bool = True) -> DataFrame:
    """Replace ``column`` by a DATE, whatever encoding it came in."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumn(column, mixed_date(F.col(column), strict))
    return df.withColumn(column, F.col(column).cast("date"))


def cast_target(df: DataFrame, column: str) -> DataFrame:
    """Force the target to DOUBLE; text that is not a number is an error, NaN is a missing value."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumn(column, _nan_to_null(F.col(column).cast("double")))
    number = F.col(column).try_cast("double")
    bad = number.isNull() & F.col(column).isNotNull()
    message = F.concat(F.lit("not a number: "), F.col(column))
    checked = F.when(bad, F.raise_error(message)).otherwise(number)
    return df.withColumn(column, _nan_to_null(checked))


def _nan_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(float("nan")))


def series_key(*columns: str) -> Column:
    """One series name out of one or several group columns."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def scan_sales(
    spark: SparkSession,
    path: str,
    columns: SalesColumns | None = None,
    fmt: str | None = None,
    strict_dates: bool = True,
    sheet: str | None = None,
) -> DataFrame:
    """Load a raw sales table: check the columns, repair dates, type the target."""
    columns = columns or SalesColumns()
    raw = validate_columns(read_raw(spark, path, fmt, sheet), columns.required)
    typed = cast_target(parse_mixed_dates(raw, columns.date_col, strict_dates), columns.target_col)
    return typed.select(
        series_key(*columns.groups).alias("series_id"),
        F.col(columns.date_col).alias("ds"),
        F.col(columns.target_col).alias("value"),
        F.col(columns.category_col).cast("string").alias("category"),
    )


def null_audit(df: DataFrame, columns: tuple[str, ...] = LOADED_COLUMNS) -> DataFrame:
    """Rows ``(column_name, n_null)``, all columns counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, n_null)")


def dataset_profile(sales: DataFrame) -> DataFrame:
    """Rows, distinct series, distinct dates and date span of a loaded table.

    Rows collapse to one per series and day first, on the map side, so the distinct counts work on
    at most series x days rows however many raw rows share a key.
    """
    daily = sales.groupBy("series_id", "ds").agg(F.count("*").alias("n"))
    return daily.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count_distinct("series_id").alias("n_series"),
        F.count_distinct("ds").alias("n_dates"),
        F.min("ds").alias("first_date"),
        F.max("ds").alias("last_date"),
    )
