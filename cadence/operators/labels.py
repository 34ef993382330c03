"""Labels: coverage, attachment, and the training frame."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.corpus import ORDINAL, Corpus, last_wins, numbered

#: Limits for warnings (fixed values).
FEW, UNMATCHED = 0.05, 0.5
UNLABELLED, OUTSIDE, UNMEASURED = "unlabelled", "outside_task", "no_measurable_features"


@dataclass(frozen=True)
class TrainingTask:
    """Which labels are positive and which negative; none is both."""

    name: str = "automation"
    positive: frozenset[str] = frozenset({"automated"})
    negative: frozenset[str] = frozenset({"organic"})

    def __post_init__(self) -> None:
        if both := self.positive & self.negative:
            raise ValueError(f"labels on both sides: {', '.join(sorted(both))}")
        if not self.positive or not self.negative:
            raise ValueError("either side needs a label")

    def side(self, label: Column) -> Column:
        return F.when(label.isin(*self.positive), 1).when(label.isin(*self.negative), 0)


@dataclass(frozen=True)
class LabelCoverage:
    n_labels: int
    n_matched: int
    n_unmatched: int
    n_unlabelled_accounts: int
    by_label: dict[str, int]
    datasets: tuple[str, ...]
    warnings: tuple[str, ...] = field(default=())

    @property
    def match_rate(self) -> float | None:
        return self.n_matched / self.n_labels if self.n_labels else None

    def as_dict(self) -> dict:
        """The document of a coverage."""
        names = ("n_labels", "n_matched", "n_unmatched", "n_unlabelled_accounts", "match_rate")
        return {n: getattr(self, n) for n in names} | {"counts": dict(self.by_label), "minority_share": self.minority_share, "datasets": list(self.datasets), "warnings": list(self.warnings)}

    @property
    def minority_share(self) -> float | None:
        total = sum(self.by_label.values())
        return min(self.by_label.values()) / total if total else None


def coverage_table(known: DataFrame, labels: DataFrame) -> DataFrame:
    """label, n and n_matched of labels against the known accounts."""
    hit = labels.join(known.select("account_id").distinct().withColumn("_hit", F.lit(1)), "account_id", "left")
    return hit.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("n_matched"))


def label_coverage(corpus: Corpus, labels: DataFrame | None = None) -> LabelCoverage:
    labels = corpus.labels if labels is None else labels
    known = corpus.spine()
    rows = coverage_table(known, labels).collect()
    n, matched = sum(r["n"] for r in rows), sum(r["n_matched"] for r in rows)
    unlabelled = known.join(labels.select("account_id"), "account_id", "left_anti").count()
    by_label = {r["label"]: r["n_matched"] for r in sorted(rows, key=lambda r: r["label"]) if r["n_matched"]}
    datasets = tuple(r["dataset"] for r in labels.select("dataset").distinct().orderBy("dataset").collect())
    found = LabelCoverage(n, matched, n - matched, unlabelled, by_label, datasets)
    warnings = []
    if len(by_label) == 1:
        warnings.append(f"only the class {next(iter(by_label))} occurs, so nothing can be learned")
    elif found.minority_share is not None and found.minority_share < FEW:
        warnings.append(f"the smallest class is {found.minority_share:.1%} of the matched labels")
    if found.match_rate is not None and found.match_rate < UNMATCHED:
        warnings.append(f"only {found.match_rate:.1%} of the labels belong to an account of the corpus")
    if len(datasets) > 1:
        warnings.append(f"labels of {len(datasets)} datasets are mixed, and their classes need not mean the same")
    return replace(found, warnings=tuple(warnings))


def attach_labels(corpus: Corpus, labels: DataFrame, *, replace_existing: bool = False) -> tuple[Corpus, LabelCoverage]:
    """The corpus with the labels of its accounts; the last record of (account, dataset) wins.

    Labels keep their ordinals, so the last one of an account is known across datasets too.

    Coverage is that of the labels offered, whatever is kept of them.
    """
    offered = numbered(labels)
    if not replace_existing:
        known = numbered(corpus.labels)
        most = known.agg(F.max(ORDINAL)).first()[0]
        offered = known.unionByName(offered.withColumn(ORDINAL, F.col(ORDINAL) + F.lit(0 if most is None else most + 1)), allowMissingColumns=True)
    kept = last_wins(offered.join(corpus.spine(), "account_id", "left_semi"), ["account_id", "dataset"], keep=True)
    return replace(corpus, labels=kept), label_coverage(corpus, labels)


def training_rows(features: DataFrame, labels: DataFrame, names: list[str], task: TrainingTask = TrainingTask()) -> DataFrame:
    """Features with label, target and status: NULL where a row can be learned from, else why not.

    Of several labels of an account the last one counts: by ordinal, or as the table is read.
    """
    last = last_wins(numbered(labels).select("account_id", "label", ORDINAL), ["account_id"])
    rows = features.join(last, "account_id", "left").withColumn("target", task.side(F.col("label")))
    measured = F.coalesce(*(F.col(c) for c in names)).isNotNull()
    status = F.when(F.col("label").isNull(), UNLABELLED).when(F.col("target").isNull(), OUTSIDE).when(~measured, UNMEASURED)
    return rows.withColumn("status", status)


def measurable(features: DataFrame, names: list[str]) -> tuple[list[str], list[str]]:
    """Feature columns that some row has, and those that none has."""
    row = features.agg(*(F.count(c).alias(c) for c in names)).first()
    return [c for c in names if row[c]], [c for c in names if not row[c]]
