"""The report: aggregates, parameters and caveats; no verdict on, or score of, an account leaves it."""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import DataFrame

from cadence.operators import account, coordination, temporal
from cadence.operators.features import FeatureRegistry
from cadence.report.privacy import Pseudonymiser
from cadence.report.summary import cluster_cards, round_half_even, summarise_features

CAVEATS = (
    coordination.CAVEAT,
    "Features describe behaviour; none of them says who or what is behind an account.",
    "Quantiles cover the accounts for which a feature could be measured; see its coverage.",
)
CARD_CAVEAT = "A cluster is a set of accounts that coincide; it is no proof that anybody directs them."
NO_NULL = "No null model was run, so how many edges chance would give is not known."
NAMED = "Pseudonyms are off: the report names accounts and must not be published."


def all_features(corpus, account_config=None, temporal_config=None, result: coordination.CoordinationResult | None = None) -> DataFrame:
    """Every account with the features of all families."""
    families = [account.AccountExtractor(account_config or account.AccountConfig()).extract(corpus), temporal.TemporalExtractor(temporal_config or temporal.TemporalConfig()).extract(corpus)]
    if result is not None:
        families.append(coordination.features(result))
    out = corpus.spine()
    for f in families:
        out = out.join(f, "account_id", "left")
    return out


def registry() -> FeatureRegistry:
    return FeatureRegistry.from_extractors((account.AccountExtractor(), temporal.TemporalExtractor(), coordination.CoordinationExtractor()))


def build_report(
    corpus,
    *,
    coordination_config: coordination.CoordinationConfig = coordination.CoordinationConfig(),
    temporal_config: temporal.TemporalConfig = temporal.TemporalConfig(),
    account_config: account.AccountConfig = account.AccountConfig(),
    ingest_report=None,
    permutations: int = 0,
    pseudonymise: bool = True,
    salt: str | None = None,
    include_examples: bool = True,
    title: str = "Cadence analysis",
) -> tuple[dict, DataFrame]:
    """(document, features): what may be published, and the table for the analyst."""
    result = coordination.detect(corpus, coordination_config, permutations=permutations)
    features = all_features(corpus, account_config, temporal_config, result).cache()
    names = Pseudonymiser(salt, pseudonymise)
    stats = result.stats().first().asDict()
    null = coordination.null_summary(result.null_model, stats["edges"]) if result.null_model is not None else None
    profile = temporal.profiles(corpus.posts, temporal_config)
    # Only members of reported clusters reach the driver, not the accounts of the corpus.
    cards = []
    for row in cluster_cards(result.clusters, result.clustered_accounts(), features, profile).orderBy("cluster_id").collect():
        card = {k: round_half_even(v) if isinstance(v, float) else v for k, v in row.asDict(recursive=True).items() if k not in ("members", "community", "examples")}
        card["members"] = [names(m) for m in row["members"]]
        card["total_pairs"] = card.pop("total_weight")
        card["caveat"] = CARD_CAVEAT
        if include_examples:
            # The ids of two posts, not their texts: these can be searched for and so tell who wrote them.
            card["example_post_pairs"] = [[e["earlier"], e["later"]] for e in row["examples"] or () if e]
        cards.append(card)
    summary = corpus.summary().first().asDict()
    specs = registry()
    quantiles = [{k: round_half_even(v) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in summarise_features(features, specs.names).orderBy("feature").collect()]
    document = {
        "title": title,
        "corpus": summary | {"source": corpus.source, "collected_at": corpus.collected_at},
        "ingest": None if ingest_report is None else ingest_report.__dict__,
        "parameters": {"coordination": coordination_config.as_dict(), "temporal": temporal_config.as_dict(), "account": account_config.as_dict()},
        "features": quantiles,
        "coordination": stats | {"null_model": null},
        "clusters": cards,
        "caveats": [*CAVEATS, *([] if null else [NO_NULL]), *([] if pseudonymise else [NAMED])],
    }
    return document, features


def to_json(document: dict, path: str | None = None, indent: int = 2) -> str:
    text = json.dumps(document, indent=indent, default=str, ensure_ascii=False)
    if path:
        with open(path, "w", encoding="utf-8") as file:
            file.write(text)
    return text


def format_number(value: float | int | None) -> str:
    """A dash for nothing, 0 as it is, three significant digits when large or small, else two decimals."""
    if value is None:
        return "–"
    if value == 0:
        return "0"
    if isinstance(value, int) and abs(value) < 1000:
        return str(value)
    return f"{value:.3g}" if abs(value) >= 1000 or abs(value) < 0.01 else f"{value:.2f}"


def sparkline(counts: list[int], width: int = 120, height: int = 24) -> str:
    """Bars of counts as inline SVG."""
    if not counts or not max(counts):
        return ""
    step, top = width / len(counts), max(counts)
    bars = "".join(f'<rect x="{k * step:.1f}" y="{height - height * c / top:.1f}" width="{step * 0.8:.1f}" height="{height * c / top:.1f}"/>' for k, c in enumerate(counts))
    return f'<svg width="{width}" height="{height}" role="img" aria-label="posts by hour">{bars}</svg>'


def to_html(document: dict, path: str | None = None) -> str:
    """A page that needs nothing else; caveats come first and all texts are escaped."""

    def table(rows: list[dict]) -> str:
        if not rows:
            return "<p>none</p>"
        head = "".join(f"<th>{escape(str(k))}</th>" for k in rows[0])
        body = "".join("<tr>" + "".join(f"<td>{cell(k, v)}</td>" for k, v in r.items()) + "</tr>" for r in rows)
        return f"<table><tr>{head}</tr>{body}</table>"

    def cell(name: str, value: object) -> str:
        if name == "hours" and isinstance(value, list):
            return sparkline(value)
        if isinstance(value, list):
            return "<br>".join(escape(str(x)) for x in value)
        return escape(format_number(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value))

    parts = [
        f"<h1>{escape(document['title'])}</h1>",
        "<ul>" + "".join(f"<li>{escape(c)}</li>" for c in document["caveats"]) + "</ul>",
        "<h2>Corpus</h2>" + table([document["corpus"]]),
        "<h2>Coordination</h2>" + table([{k: v for k, v in document["coordination"].items() if k != "null_model"}]),
        "<h2>Null model</h2>" + table([document["coordination"]["null_model"]] if document["coordination"]["null_model"] else []),
        "<h2>Clusters</h2>" + table(document["clusters"]),
        "<h2>Features</h2>" + table(document["features"]),
        f"<h2>Parameters</h2><pre>{escape(json.dumps(document['parameters'], indent=1, default=str))}</pre>",
    ]
    page = f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{escape(document["title"])}</title><style>body{{font-family:sans-serif;max-width:70em;margin:2em auto}}td,th{{border:1px solid #ccc;padding:.2em .5em}}table{{border-collapse:collapse}}</style><body>{"".join(parts)}</body></html>'
    if path:
        with open(path, "w", encoding="utf-8") as file:
            file.write(page)
    return page
