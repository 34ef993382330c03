"""Reports over a planted corpus: nothing raw leaves, and documents are complete."""

import json

from cadence.report.build import build_report, format_number, registry, sparkline, to_html, to_json
from cadence.report.privacy import Pseudonymiser
from cadence.sources.sinks import read_corpus, write_corpus
from tests.test_coordination import coordinated, posts


def test_report_hides_accounts_and_keeps_parameters(spark, tmp_path):
    corpus = read_corpus(spark, write_corpus(posts(spark, coordinated()), str(tmp_path / "corpus")))
    document, features = build_report(corpus, permutations=2, salt="pepper")
    text, page = to_json(document), to_html(document)
    assert "acct0" not in text and "acct0" not in page and "acct_" in text
    assert json.loads(text)["parameters"]["coordination"]["window_seconds"] == 900.0
    assert document["clusters"][0]["size"] == 4 and len(document["clusters"][0]["members"]) == 4
    assert sum(document["clusters"][0]["hours"]) == 12
    assert features.count() == 9 and set(registry().names) <= set(features.columns)
    assert len(registry()) == 22


def test_pseudonyms_and_numbers():
    names = Pseudonymiser("salt")
    assert names("a") == names("a") != names("b") and names.resolve(names("a")) == "a" and len(names) == 2
    assert Pseudonymiser(enabled=False)("a") == "a"
    assert [format_number(x) for x in (None, 0, 0.5, 12345.6, 0.0012)] == ["–", "0", "0.50", "1.23e+04", "0.0012"]
    assert sparkline([]) == "" and "<svg" in sparkline([1, 2])
