"""The command line, from files to documents."""

import json

import pytest

from cadence import cli
from cadence.sources import annotations
from cadence.sources.adapters import NativeAdapter


@pytest.fixture
def corpus(tmp_path):
    posts = [{"post_id": f"p{k}", "account_id": f"a{k % 60}", "created_at": f"2024-03-{1 + k % 28:02d}T{k % 24:02d}:00:00Z", "text": f"text {k}"} for k in range(120)]
    accounts = [{"account_id": f"a{k}", "handle": f"user{'9' * (k % 2 * 6)}x{k}", "followers_count": k, "following_count": 60 - k, "post_count": k} for k in range(60)]
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps({"source": "test", "collected_at": "2024-05-01T00:00:00Z", "posts": posts, "accounts": accounts}))
    return str(path)


def test_labels_are_written_so_that_train_reads_them(spark, tmp_path, corpus, capsys):
    marks = tmp_path / "marks.csv"
    marks.write_text("user_id,label\n" + "".join(f"a{k},{'bot' if k % 2 else 'human'}\n" for k in range(60)) + "zz,bot\n")
    out = str(tmp_path / "labelled.json")
    assert cli.main(["labels", corpus, str(marks), "--dataset", "d", "--out", out]) == 0
    told = json.loads(capsys.readouterr().out)
    assert (told["n_labels"], told["n_matched"], told["n_unmatched"], told["counts"]) == (61, 60, 1, {"automated": 30, "organic": 30})
    again = NativeAdapter().load(spark, out).corpus
    assert again.labels.count() == 60 and again.source == "test" and again.posts.count() == 120
    card, scores = str(tmp_path / "card.json"), str(tmp_path / "scores.json")
    assert cli.main(["train", out, str(marks), "--dataset", "e", "--calibration", "sigmoid", "--folds", "2", "--card", card, "--distribution", scores]) == 0
    with open(card) as file:
        card = json.load(file)
    assert card["n_train"] == 60 and card["datasets"] == ["d", "e"] and card["version"] and card["trained_at"] and card["label_methods"]
    with open(scores) as file:
        scores = json.load(file)
    assert scores["n"] == sum(scores["histogram"]) == 60 and scores["caveat"] and set(scores["quantiles"]) == {"p10", "median", "p90"}


def test_inspect_and_docs(spark, tmp_path, capsys):
    path = tmp_path / "p.csv"
    path.write_text("num,who,created_at\n1,a,2024-03-01T00:00:00Z\n")
    assert cli.main(["inspect", str(path)]) == 1
    assert cli.main(["inspect", str(path), "--alias", "num=post_id", "--alias", "who=account_id"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["inspect", str(path), "--alias", "num"])
    capsys.readouterr()
    assert cli.main(["docs"]) == 0 and "acct_age_days" in capsys.readouterr().out


def test_wide_annotation_files(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("user_id," + ",".join(f"x{k}" for k in range(40)) + ",label\nu1," + ",".join(["bot"] * 40) + ",human\n")
    assert annotations.read_labels(spark, str(path), dataset="d").first()["label"] == "organic"
    with pytest.raises(ValueError):
        annotations.read_labels(spark, str(path), dataset="d", class_column="missing")
