"""Writers for cleaned feeds, result tables, JSON reports and models."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None,
                mode: str = "overwrite") -> None:
    """Write a table; Parquet partitioned by ``year_month`` enables partition pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_outputs(tables: dict, path: str, fmt: str = "csv") -> list:
    """Write each named result table to ``path/<name>``; returns the names."""
    for name, df in tables.items():
        write_table(df, f"{path.rstrip('/')}/{name}", fmt=fmt)
    return list(tables)


def write_report(df: DataFrame, path: str) -> None:
    """Write a one-row (nested) report as JSON, one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def export_report(df: DataFrame, path: str, name: str, day: _dt.date | None = None,
                  columns: dict | None = None) -> str:
    """CSV export with display names and a date stamp: ``<path>/<name>_<yyyyMMdd>``."""
    day = day or _dt.date.today()
    if columns:
        df = df.select([df[c].alias(a) for c, a in columns.items()])
    target = f"{path.rstrip('/')}/{name}_{day.strftime('%Y%m%d')}"
    df.write.mode("overwrite").option("header", True).csv(target)
    return target


def save_models(path: str, kmeans_model=None, tables: dict | None = None) -> None:
    """Persist the k-means model (MLlib writer) and parameter tables (scaler,
    forest nodes, feature list) as Parquet under ``path``."""
    if kmeans_model is not None:
        kmeans_model.write().overwrite().save(f"{path.rstrip('/')}/kmeans")
    for name, df in (tables or {}).items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
