"""Exports: CSV, one folder per report frame, text and HTML reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradescope.functions.text import html_escape


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_frames(frames: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """Each frame under ``root/<name>``; names that differ only in case are refused."""
    folded = [name.lower() for name in frames]
    if len(set(folded)) < len(folded):
        raise ValueError(f"frame names would share a folder: {sorted(frames)}")
    for name, df in frames.items():
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(f"{root.rstrip('/')}/{name}")


def _in_one_file(lines: DataFrame) -> DataFrame:
    # A report has a few dozen lines; a shuffle, unlike coalesce, keeps the work before it parallel.
    return lines.repartition(1).sortWithinPartitions("seq").select("line")


def write_text(lines: DataFrame, path: str) -> None:
    """``lines`` has columns seq and line; all of it goes through one task, so only for reports."""
    _in_one_file(lines).write.mode("overwrite").text(path)


def html_lines(lines: DataFrame) -> DataFrame:
    """The report lines escaped inside a ``pre`` block; pass staged lines, they are read twice."""
    edges = lines.agg(F.min("seq").alias("first"), F.max("seq").alias("last"))

    def at(edge: str, tags: str) -> Column:
        here = F.col("seq") == edges.select(edge).scalar()
        return F.when(here, F.lit(tags)).otherwise(F.lit(""))

    head, tail = at("first", "<html><body><pre>"), at("last", "</pre></body></html>")
    return lines.select("seq", F.concat(head, html_escape("line"), tail).alias("line"))


def write_html(lines: DataFrame, path: str) -> None:
    _in_one_file(html_lines(lines)).write.mode("overwrite").text(path)
