"""Scans of untidy files into raw rows: ordinal, row (a map of texts) and problem.

``problem`` is NULL or the reason why a row can't be mapped: malformed_json, ragged_row, empty_row
or repeated_header, the first that holds.
"""

from __future__ import annotations

import csv
import io
from functools import reduce
from operator import and_
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSON, JSONL, TABLES = (".json",), (".jsonl", ".ndjson"), (".csv", ".tsv")
ROWS = "array<map<string,string>>"
#: Where the column ``row`` says which names all of its rows have.
NAMES = "names"


def suffix(path: str) -> str:
    return PurePosixPath(path).suffix.casefold()


def sniff(path: str) -> bool:
    """Whether the suffix is one that can be read."""
    return suffix(path) in (*JSON, *JSONL, *TABLES)


def delimiter_of(path: str) -> str:
    return "\t" if suffix(path) == ".tsv" else ","


def header_of(spark: SparkSession, path: str, delimiter: str | None = None) -> list[str]:
    """The cells of the first line, without a byte order mark; a file without a line has none."""
    first = spark.read.text(path).limit(1).collect()
    cells = next(csv.reader(io.StringIO(first[0][0].lstrip("﻿")), delimiter=delimiter or delimiter_of(path)), []) if first else []
    return cells


def _problem(row: Column, before: Column) -> Column:
    filled = F.map_filter(row, lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "")
    repeated = F.size(F.map_filter(filled, lambda k, v: F.trim(k) != F.trim(v))) == 0
    return F.coalesce(before, F.when(F.size(filled) == 0, "empty_row").when(repeated, "repeated_header"))


def named(row: Column, names: list[str]) -> Column:
    """The column ``row``, whose rows all have just these names."""
    return row.alias("row", metadata={NAMES: names})


def names_of(rows: DataFrame) -> list[str] | None:
    """The names that all rows have, if the table tells."""
    return rows.schema["row"].metadata.get(NAMES)


def broken_cells(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell of a file goes on in another line: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_table(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A CSV or TSV file with a header; all cells are texts, short rows are padded with NULL.

    Files without line breaks in cells are split among tasks; others are read by one task each.

    One column more than the header has is read: a row that fills it, or that has just as many
    cells, is ragged.
    """
    names = header_of(spark, path, delimiter)
    columns = [f"c{k}" for k in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "over", "short"]])
    options = {
        "sep": delimiter or delimiter_of(path),
        "header": True,
        "quote": '"',
        "escape": '"',
        "multiLine": broken_cells(spark, path),
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "short",
        "encoding": "UTF-8",
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }
    rows = spark.read.schema(schema).options(**options).csv(path)
    pairs = {n: c for n, c in zip(names, columns, strict=True)}
    row = F.create_map(*(x for n, c in pairs.items() for x in (F.lit(n), F.col(c)))) if pairs else F.create_map().cast("map<string,string>")
    ragged = F.when(F.col("over").isNotNull() | F.col("short").isNull(), "ragged_row")
    cells = {n: F.coalesce(F.trim(c), F.lit("")) for n, c in pairs.items()}
    empty = reduce(and_, (c == "" for c in cells.values()), F.lit(True))
    repeated = reduce(and_, ((c == "") | (c == n.strip(" ")) for n, c in cells.items()), F.lit(True))
    problem = F.coalesce(ragged, F.when(empty, "empty_row").when(repeated, "repeated_header"))
    return rows.select(F.monotonically_increasing_id().alias("ordinal"), named(row, list(pairs)), problem.alias("problem"))


def read_json_lines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """One object per line; blank lines are ignored, bad ones marked, or raised with ``strict``."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ordinal"), F.col("value")).filter(F.trim("value") != "")
    row = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    good = F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{")
    found = lines.select("ordinal", F.when(good, row).alias("row"), F.when(~good, "malformed_json").alias("before"))
    if strict:
        bad = found.filter("before is not null").limit(1).collect()
        if bad:
            raise ValueError(f"{path}: a line is no JSON object")
    return found.select("ordinal", "row", _problem(F.coalesce("row", F.create_map().cast("map<string,string>")), F.col("before")).alias("problem"))


def from_array(df: DataFrame, column: str) -> DataFrame:
    """Raw rows of an array of maps."""
    rows = df.select(F.posexplode(column).alias("ordinal", "row"))
    return rows.select(F.col("ordinal").cast("long").alias("ordinal"), "row", _problem(F.col("row"), F.lit(None).cast("string")).alias("problem"))


def from_dataframe(df: DataFrame) -> DataFrame:
    """Raw rows of any table: its cells as texts, arrays and structs as JSON."""

    def text(f: T.StructField) -> Column:
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        return F.to_json(f"`{f.name}`") if nested else F.col(f"`{f.name}`").cast("string")

    row = F.create_map(*(x for f in df.schema for x in (F.lit(f.name), text(f))))
    found = df.select(F.monotonically_increasing_id().alias("ordinal"), row.alias("row"))
    return found.select("ordinal", "row", _problem(F.col("row"), F.lit(None).cast("string")).alias("problem"))


def read_corpus_object(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, str | None]]:
    """The tables and the provenance of a JSON corpus; a bare array is posts."""
    whole = spark.read.text(path, wholetext=True)
    kind = whole.select(F.substring(F.ltrim("value"), 1, 1).alias("k")).first()["k"]
    if kind == "[":
        body = whole.select(F.from_json("value", ROWS).alias("posts"), F.lit(None).cast(ROWS).alias("accounts"), F.lit(None).cast(ROWS).alias("labels"))
        return {n: from_array(body, n) for n in ("posts", "accounts", "labels")}, {}
    if kind != "{":
        raise ValueError(f"{path}: an object or an array is expected at the top level")
    schema = f"struct<source:string,collected_at:string,posts:{ROWS},accounts:{ROWS},labels:{ROWS}>"
    body = whole.select(F.from_json("value", schema).alias("c")).select("c.*")
    told = body.select("source", "collected_at").first().asDict()
    return {n: from_array(body, n) for n in ("posts", "accounts", "labels")}, told


def read_any(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Raw rows of a file of records in any of the formats; a JSON file must hold an array."""
    kind = suffix(path)
    if kind in JSON:
        tables, told = read_corpus_object(spark, path)
        if told:
            raise ValueError(f"{path}: a JSON array of records is expected")
        return tables["posts"]
    if kind in JSONL:
        return read_json_lines(spark, path, strict)
    if kind in TABLES:
        return read_table(spark, path)
    raise ValueError(f"unsupported file type {kind!r}; expected .json, .jsonl, .csv or .tsv")
