"""Sinks: workbook, patterns, issues, refinement, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import fixed
from lexmill.operators import quality, refine


def workbook_sheet(wb: DataFrame) -> DataFrame:
    """The 22 columns under the names of the sheet, in their order."""
    return wb.select(*[F.col(n).cast(t).alias(sheet) for n, sheet, t in fixed.WORKBOOK])


def write_sheet(df: DataFrame, path: str) -> None:
    """One spreadsheet; needs an optional writer. A table with more rows than a sheet can hold is refused, as it has to pass the driver."""
    if df.limit(fixed.SHEET_ROWS + 1).count() > fixed.SHEET_ROWS:
        raise ValueError(f"more than {fixed.SHEET_ROWS} rows don't fit a sheet")
    try:
        df.toPandas().to_excel(path, index=False)
    except (ImportError, ModuleNotFoundError) as error:
        raise RuntimeError(f"no writer of Excel files is installed, {path} can't be written") from error


def write_workbook(wb: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The sheet as ``fmt``: any format of Spark, csv with a header, or xlsx in one file."""
    if fmt == "xlsx":
        write_sheet(workbook_sheet(wb), path)
        return
    out = workbook_sheet(wb).write.mode("overwrite")
    if fmt == "csv":
        out.option("header", True).csv(path)
    else:
        out.format(fmt).save(path)


def write_patterns(top: DataFrame, path: str) -> None:
    """All patterns, then one folder for each length and one for each category."""
    flat = top.withColumn("pos_pattern", F.array_join("pos_pattern", " -> ")) if "pos_pattern" in top.columns else top
    flat.write.mode("overwrite").parquet(f"{path}/all")
    flat.write.mode("overwrite").partitionBy("length").parquet(f"{path}/by_length")
    flat.filter(F.length("category") < 30).write.mode("overwrite").partitionBy("category").parquet(f"{path}/by_category")


def write_issues(wb: DataFrame, path: str, context_issues: DataFrame | None = None, accuracy_issues: DataFrame | None = None) -> None:
    """The issue sheet: 15 columns under their names."""
    quality.issue_sheet(quality.issue_table(wb, context_issues, accuracy_issues)).write.mode("overwrite").parquet(path)


def write_refinement(detail: DataFrame, path: str, columns: list[str], usage: DataFrame | None = None) -> None:
    """Four outputs in folders of ``path``: the refined rows, the detail, before and after, and the text report."""
    detail.select(*columns).write.mode("overwrite").parquet(f"{path}/refined")
    detail.write.mode("overwrite").parquet(f"{path}/detail")
    refine.comparison(detail).write.mode("overwrite").parquet(f"{path}/before_after")
    report = refine.report(refine.statistics(detail), usage)
    detail.sparkSession.createDataFrame([(report,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of one column."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
