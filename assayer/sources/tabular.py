"""Tabular files as DataFrames of text, with literal column names and optional row numbers.

CSV and TSV are read as text throughout: no inference pass, no type that depends on where a file is
split. Parquet keeps its types. ``row_index`` is the zero-based place of a row in its file, or over all
files of a folder in the order of their paths.
"""

from __future__ import annotations

import csv
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.values import na_to_null, quoted

SEPARATORS = {".csv": ",", ".tsv": "\t"}
SHEETS = (".xlsx", ".xls")
ROW_INDEX = "row_index"


def suffix(path: str) -> str:
    return PurePosixPath(str(path)).suffix.lower()


def distinct_names(cells: list[str]) -> list[str]:
    """Header cells stripped; repeated names get ``.1``, ``.2`` and so on, blank ones ``Unnamed: i``."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, cell in enumerate(cells):
        name = base = (cell or "").strip() or f"Unnamed: {i}"
        while name in seen:
            seen[base] += 1
            name = f"{base}.{seen[base]}"
        seen[name] = 0
        out.append(name)
    return out


def open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether any line ends within a quoted cell, so that the next one belongs to the same row.

    The first such line of a file has an odd number of quotes. One pass over the text, ended by a find.
    """
    lines = spark.read.text(path)
    return bool(lines.filter((F.length("value") - F.length(F.translate("value", '"', ""))) % 2 == 1).limit(1).collect())


def read_delimited(spark: SparkSession, path: str, separator: str = ",", row_index: bool = False, multi_line: bool | None = None) -> DataFrame:
    """A delimited text file, or a folder of files alike, each with a header line: quoted cells, blanks after separators skipped, NA texts as NULL.

    Rows with too few cells end in NULLs; a row with a cell too many fails the query that reads it (a
    surplus blank cell is let pass). With ``row_index`` the rows are numbered in file order. ``multi_line``
    allows newlines in quoted cells, at the price of one task a file; None looks for them first, at the
    price of one more pass over the text.
    """
    if multi_line is None:
        multi_line = open_quotes(spark, path)
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"No header line in {path}")
    header = next(csv.reader([first[0][0].lstrip("\ufeff")], delimiter=separator, skipinitialspace=True))
    names = distinct_names(header)
    plain = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names) + 1)])
    reader = spark.read.schema(plain).option("sep", separator).option("header", True).option("enforceSchema", True)
    df = reader.option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("mode", "PERMISSIVE").option("multiLine", multi_line).csv(path)
    surplus = F.col(f"_c{len(names)}")
    whole = F.when(surplus.isNull(), True).otherwise(F.raise_error(F.concat(F.lit(f"A row of {path} has more than {len(names)} cells; the first too many is "), surplus)).cast("boolean"))
    cells = [na_to_null(F.col(f"_c{i}")).alias(n) for i, n in enumerate(names)]
    if not row_index:
        return df.filter(whole).select(*cells)
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("__split")
    return number_rows(df.select(split, F.monotonically_increasing_id().alias("__at"), whole.alias("__whole"), *cells).filter("__whole").drop("__whole"))


def number_rows(df: DataFrame) -> DataFrame:
    """``row_index`` from ``__split`` (file and start) and ``__at``, which increases by one within a split.

    Exact counts per split, in the order of files and starts, shift each split's own count. The window
    is over one row a split.
    """
    counts = df.groupBy("__split").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__split", (before - F.col("__first")).alias("__off"))
    return df.join(offsets, "__split").withColumn(ROW_INDEX, F.col("__off") + F.col("__at")).drop("__split", "__off", "__at")


def read_sheet(spark: SparkSession, path: str, row_index: bool = False) -> DataFrame:
    """The first sheet of a spreadsheet, read on the driver (spreadsheets are small), as text."""
    import pandas as pd

    try:
        frame = pd.read_excel(path, sheet_name=0, dtype=object, header=None)
    except ImportError as e:
        raise ValueError(f"Reading {suffix(path)} files needs an optional package: {e}") from e
    names = distinct_names([str(c) if c is not None else "" for c in frame.iloc[0]])
    rows = [[None if pd.isna(c) else str(c) for c in row] + [i] for i, row in enumerate(frame.iloc[1:].itertuples(index=False))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(ROW_INDEX, T.LongType())])
    df = spark.createDataFrame(rows, schema)
    df = df.select(*[na_to_null(quoted(n)).alias(n) for n in names], ROW_INDEX)
    return df if row_index else df.drop(ROW_INDEX)


def read_tabular(spark: SparkSession, path: str, row_index: bool = False) -> DataFrame:
    """A dataset by its suffix: .csv, .tsv, .xlsx, .xls or .parquet. Other suffixes raise ValueError."""
    kind = suffix(path)
    if kind in SEPARATORS:
        return read_delimited(spark, path, SEPARATORS[kind], row_index)
    if kind in SHEETS:
        return read_sheet(spark, path, row_index)
    if kind == ".parquet":
        df = spark.read.parquet(path)
        df = df.toDF(*distinct_names(df.columns))
        if not row_index or ROW_INDEX in df.columns:
            return df
        if len(spark.read.parquet(path).inputFiles()) == 1:
            return df.withColumn(ROW_INDEX, F.col("_metadata.row_index"))
        placed = spark.read.parquet(path).select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("start")).alias("__split"), F.col("_metadata.row_index").alias("__at"))
        return number_rows(placed.toDF(*df.columns, "__split", "__at"))
    raise ValueError(f"Unsupported dataset format: {kind or path}")
