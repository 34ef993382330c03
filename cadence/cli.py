"""Command line: analyse, labels, train, inspect, docs."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from cadence.operators import account, temporal
from cadence.operators.coordination import CoordinationConfig, window_sensitivity
from cadence.operators.ensemble import SCORE_CAVEAT, AutomationEnsemble, EnsembleConfig
from cadence.operators.features import catalogue
from cadence.operators.labels import attach_labels
from cadence.operators.metrics import histogram, probability_summary
from cadence.operators.temporal import TemporalConfig
from cadence.report.build import all_features, build_report, registry, to_html, to_json
from cadence.sources.adapters import ArchiveAdapter, LoadResult, NativeAdapter
from cadence.sources.annotations import read_labels
from cadence.sources.inspect import inspect_file, render_profile
from cadence.sources.mapping import ACCOUNT_ALIASES, POST_ALIASES, MappingConfig
from cadence.sources.sinks import write_corpus_json, write_features


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cadence")
    commands = top.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyse")
    a.add_argument("posts")
    a.add_argument("--accounts")
    a.add_argument("--adapter", choices=["native", "io-archive"], default="native")
    for flag in ("html", "json", "features", "salt"):
        a.add_argument(f"--{flag}")
    a.add_argument("--platform", default="generic")
    a.add_argument("--assume-timezone", type=float)
    a.add_argument("--date-order", choices=["dmy", "mdy"])
    a.add_argument("--window", type=float, default=15.0, help="minutes")
    a.add_argument("--min-edge-weight", type=int, default=2)
    a.add_argument("--permutations", type=int, default=0)
    a.add_argument("--min-posts", type=int, default=20)
    a.add_argument("--max-candidate-pairs", type=int, default=5_000_000)
    a.add_argument("--window-sweep", type=float, nargs="*", default=[], help="minutes")
    a.add_argument("--title", default="Cadence analysis")
    for flag in ("no-pseudonyms", "no-examples", "strict"):
        a.add_argument(f"--{flag}", action="store_true")
    for name in ("labels", "train"):
        p = commands.add_parser(name)
        p.add_argument("corpus")
        p.add_argument("annotations")
        p.add_argument("--accounts")
        p.add_argument("--dataset", required=True)
        p.add_argument("--numeric-convention", choices=["1_is_bot", "0_is_bot"])
        if name == "labels":
            p.add_argument("--out")
        else:
            p.add_argument("--calibration", choices=["isotonic", "sigmoid"], default="isotonic")
            p.add_argument("--folds", type=int, default=5)
            p.add_argument("--min-per-class", type=int, default=25)
            p.add_argument("--card")
            p.add_argument("--distribution")
    i = commands.add_parser("inspect")
    i.add_argument("path")
    i.add_argument("--kind", choices=["posts", "accounts"], default="posts")
    i.add_argument("--rows", type=int, default=2000)
    i.add_argument("--alias", action="append", default=[], metavar="COLUMN=FIELD")
    i.add_argument("--assume-timezone", type=float)
    i.add_argument("--date-order", choices=["dmy", "mdy"])
    i.add_argument("--json")
    commands.add_parser("docs").add_argument("--out")
    return top


def _put(text: str, path: str | None) -> None:
    if path:
        with open(path, "w", encoding="utf-8") as file:
            file.write(text)
    else:
        print(text)


def _analyse(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.adapter == "io-archive":
        loaded = ArchiveAdapter(args.title, date_order=args.date_order, strict=args.strict).load_takedown(spark, args.posts, args.accounts)
    else:
        loaded = _loaded(spark, MappingConfig(args.platform, args.assume_timezone, args.date_order, strict=args.strict), args.posts, args.accounts)
    config = CoordinationConfig(window_seconds=60 * args.window, min_edge_weight=args.min_edge_weight, max_candidate_pairs=args.max_candidate_pairs)
    document, features = build_report(
        loaded.corpus,
        coordination_config=config,
        temporal_config=TemporalConfig(min_posts=args.min_posts),
        ingest_report=loaded.report(),
        permutations=args.permutations,
        pseudonymise=not args.no_pseudonyms,
        salt=args.salt,
        include_examples=not args.no_examples,
        title=args.title,
    )
    if args.window_sweep:
        document["window_sweep"] = window_sensitivity(loaded.corpus, [60 * w for w in args.window_sweep], config).to_dict("records")
    if args.features:
        write_features(features, args.features)
    if args.html:
        to_html(document, args.html)
    text = to_json(document, args.json)
    if not args.json and not args.html:
        print(text)
    return 0


def _loaded(spark: SparkSession, config: MappingConfig, posts: str, accounts: str | None) -> LoadResult:
    """One file may be a JSON corpus; posts with a file of accounts are tables."""
    adapter = NativeAdapter(config)
    return adapter.load_tables(spark, posts, accounts) if accounts else adapter.load(spark, posts)


def _labelled(spark: SparkSession, args: argparse.Namespace):
    corpus = _loaded(spark, MappingConfig(), args.corpus, args.accounts).corpus
    offered = read_labels(spark, args.annotations, dataset=args.dataset, numeric_convention=args.numeric_convention)
    return attach_labels(corpus, offered)


def _labels(spark: SparkSession, args: argparse.Namespace) -> int:
    corpus, coverage = _labelled(spark, args)
    print(json.dumps(coverage.as_dict(), indent=2))
    if args.out:
        write_corpus_json(corpus, args.out)
    return 0


def _train(spark: SparkSession, args: argparse.Namespace) -> int:
    corpus, _ = _labelled(spark, args)
    features = all_features(corpus, account.AccountConfig(), temporal.TemporalConfig())
    model = AutomationEnsemble(EnsembleConfig(args.calibration, args.folds, min_per_class=args.min_per_class)).fit(features, corpus.labels)
    _put(json.dumps(model.card, indent=2, default=str), args.card)
    if args.distribution:
        found = model.predict_proba(features).cache()
        row = probability_summary(found).first()
        body = {"n": row["n"], "quantiles": {k: row[k] for k in ("p10", "median", "p90")}, "mean_spread": row["mean_spread"], "histogram": [r["n"] for r in histogram(found).orderBy("bin").collect()], "caveat": SCORE_CAVEAT}
        _put(json.dumps(body, indent=2), args.distribution)
    return 0


def _inspect(spark: SparkSession, args: argparse.Namespace) -> int:
    extra: dict[str, tuple[str, ...]] = {}
    for pair in args.alias:
        column, equals, name = pair.partition("=")
        if not (column and equals and name):
            raise SystemExit(f"--alias {pair}: COLUMN=FIELD is expected")
        extra[name] = (*extra.get(name, ()), column.casefold())
    base = POST_ALIASES if args.kind == "posts" else ACCOUNT_ALIASES
    aliases = {k: (*base.get(k, ()), *extra.get(k, ())) for k in {**base, **extra}}
    config = MappingConfig(assume_offset_hours=args.assume_timezone, date_order=args.date_order, **{"post_aliases" if args.kind == "posts" else "account_aliases": aliases})
    profile = inspect_file(spark, args.path, kind=args.kind, rows=args.rows, config=config)
    print(render_profile(profile))
    if args.json:
        _put(json.dumps(profile.as_dict(), indent=2, default=str), args.json)
    return 0 if profile.usable else 1


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "docs":
        _put(catalogue(registry()), args.out)
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return {"analyse": _analyse, "labels": _labels, "train": _train, "inspect": _inspect}[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
