"""Writing corpora and feature tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.corpus import ORDINAL, Corpus


def write_corpus(corpus: Corpus, path: str) -> str:
    """The tables as Parquet below ``path``, with their provenance."""
    for name in ("accounts", "posts", "labels"):
        getattr(corpus, name).write.mode("overwrite").parquet(f"{path}/{name}")
    told = [(corpus.source, corpus.collected_at, list(corpus.notes))]
    corpus.spark.createDataFrame(told, "source string, collected_at string, notes array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/provenance")
    return path


def read_corpus(spark: SparkSession, path: str) -> Corpus:
    told = spark.read.parquet(f"{path}/provenance").first()
    return Corpus(*(spark.read.parquet(f"{path}/{n}") for n in ("accounts", "posts", "labels")), told["source"], told["collected_at"], tuple(told["notes"]))


#: Rows that one JSON object may hold, since the driver writes it.
MOST_JSON_ROWS = 2_000_000


def write_corpus_json(corpus: Corpus, path: str) -> str:
    """A small corpus as one JSON object that ``NativeAdapter.load`` reads again; a large one raises."""

    def rows(df: DataFrame, order: list[str]) -> list[dict]:
        if df.limit(MOST_JSON_ROWS + 1).count() > MOST_JSON_ROWS:
            raise ValueError(f"a JSON corpus holds {MOST_JSON_ROWS} rows of a kind at most; use write_corpus")
        plain = df.drop(ORDINAL)
        texts = plain.orderBy(*order).select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("j")).toLocalIterator()
        return [json.loads(r["j"]) for r in texts]

    body = {
        "source": corpus.source,
        "collected_at": corpus.collected_at,
        "accounts": rows(corpus.accounts, ["account_id"]),
        "posts": rows(corpus.posts, ["created_at", "post_id"]),
        "labels": rows(corpus.labels, ["account_id", "dataset"]),
    }
    with open(path, "w", encoding="utf-8") as file:
        json.dump(body, file, ensure_ascii=False, indent=1)
    return path


def write_features(features: DataFrame, path: str, kind: str = "csv") -> str:
    """The feature table by account, for analysts only."""
    ordered = features.orderBy("account_id")
    (ordered.write.mode("overwrite").option("header", True).csv if kind == "csv" else ordered.write.mode("overwrite").parquet)(path)
    return path
