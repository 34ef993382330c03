"""Annotation files: ids with classes, with or without a header."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.corpus import LABEL_ROWS, conformed
from cadence.sources.raw import suffix

#: Class names in use (fixed values); one followed by an underscore and more is the same class.
AUTOMATED = ("bot", "bots", "spambot", "social_spambot", "traditional_spambot", "fake_follower", "fakefollower", "self_declared")
ORGANIC = ("human", "humans", "genuine", "genuine_account", "real", "verified")
HEADER = ("user_id", "userid", "id", "label", "class", "account_id")


class UnknownClassError(ValueError):
    """A class that is not known, or a number whose meaning was not declared."""


def normalised_class(raw: Column, convention: str | None) -> Column:
    """automated, organic, or NULL for a class that must not fall through."""
    name = F.translate(F.lower(F.trim(raw)), "- ", "__")
    out = F.when(name.isin(*AUTOMATED), "automated").when(name.isin(*ORGANIC), "organic")
    if convention is not None:
        one = "automated" if convention == "1_is_bot" else "organic"
        out = F.when(name == "1", one).when(name == "0", "organic" if one == "automated" else "automated").otherwise(out)
    for prefix, label in [(p, "automated") for p in AUTOMATED] + [(p, "organic") for p in ORGANIC]:
        out = F.coalesce(out, F.when(name.startswith(f"{prefix}_"), label))
    return out


def read_labels(
    spark: SparkSession,
    path: str,
    *,
    dataset: str,
    method: str = "human_annotation",
    platform: str = "twitter",
    numeric_convention: str | None = None,
    delimiter: str | None = None,
    id_column: str | None = None,
    class_column: str | None = None,
) -> DataFrame:
    """Labels of an annotation file; unknown classes and rows of one cell raise."""
    if numeric_convention not in (None, "1_is_bot", "0_is_bot"):
        raise ValueError("numeric_convention is 1_is_bot, 0_is_bot or None")
    separator = delimiter or ("," if suffix(path) == ".csv" else "\t")
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^﻿", "").alias("value"))
    first = lines.orderBy("at").limit(1).collect()
    if not first:
        return spark.createDataFrame([], LABEL_ROWS)
    head = [x.strip().casefold() for x in next(csv.reader(io.StringIO(first[0]["value"]), delimiter=separator), [])]
    width = max(2, len(head))
    cells = F.from_csv("value", ", ".join(f"c{k} string" for k in range(width)), {"sep": separator, "quote": '"', "escape": '"'})
    rows = lines.select("at", F.array(*(cells[f"c{k}"] for k in range(width))).alias("c"))
    named = bool(id_column or class_column or set(head) & set(HEADER))
    where = {"id": 0, "class": 1}
    if named:
        for key, wanted in (("id", (id_column or "user_id").casefold()), ("class", (class_column or "label").casefold())):
            where[key] = head.index(wanted) if wanted in head else where[key]
        for wanted in (id_column, class_column):
            if wanted and wanted.casefold() not in head:
                raise ValueError(f"{path}: there is no column {wanted}")
        rows = rows.filter(F.col("at") != first[0]["at"])
    account, raw = F.trim(F.get("c", where["id"])), F.trim(F.get("c", where["class"]))
    filled = F.exists("c", lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    rows = rows.filter(filled).select("at", account.alias("account_id"), raw.alias("raw"))
    rows = rows.withColumn("label", normalised_class(F.col("raw"), numeric_convention))
    short = rows.filter("raw is null").limit(1).collect()
    if short:
        raise ValueError(f"{path}: two columns at least are expected")
    rows = rows.filter(F.coalesce("account_id", F.lit("")) != "")
    unknown = rows.filter("label is null").limit(1).collect()
    if unknown:
        raise UnknownClassError(f"{path}: class {unknown[0]['raw']!r} is not known" + (", or needs numeric_convention" if unknown[0]["raw"] in ("0", "1") else ""))
    found = rows.select("account_id", F.lit(platform).alias("platform"), "label", F.lit(dataset).alias("dataset"), F.lit(method).alias("method"), F.concat(F.lit("source class: "), "raw").alias("notes"))
    return conformed(found, LABEL_ROWS)
