"""Reading untidy files: what is kept, what is refused, and why."""

import json

import pytest

from cadence.sources import adapters, annotations, raw
from cadence.sources.mapping import MappingConfig


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_typed_posts_and_lists(spark, tmp_path):
    path = put(tmp_path, "posts.csv", '﻿post_id,account_id,created_at,text,kind,hashtags,mood\np1,a1,2024-03-01T12:00:00Z,"one, two",original,uno|dos,glad\np2,a2,2024-03-01T14:00:00+02:00,x,reply,,\n')
    result = adapters.NativeAdapter().load(spark, path)
    p1, p2 = result.corpus.posts.orderBy("post_id").collect()
    assert p1["text"] == "one, two" and p1["hashtags"] == ["uno", "dos"] and p1["extra"] == {"mood": "glad"}
    assert p1["created_at"] == p2["created_at"] and p2["kind"] == "reply" and p2["hashtags"] == []
    assert result.report().n_posts == 2 and result.report().n_skipped == 0


def test_every_refused_row_is_counted(spark, tmp_path):
    rows = [
        "1,a,2024-03-01T12:00:00Z,ok",
        "2,a,not a date,x",
        "3,a,2024-03-01 12:00:00,x",
        ",a,2024-03-01T12:00:00Z,x",
        "4,a,3/4/2024 10:00,x",
        "1.2E+17,a,2024-03-01T12:00:00Z,x",
        "5,a,2024-03-01T12:00:00Z,x,y",
        ",,,",
        "post_id,account_id,created_at,text",
        "6,a",
    ]
    path = put(tmp_path, "bad.csv", "post_id,account_id,created_at,text\n" + "\n".join(rows) + "\n")
    report = adapters.NativeAdapter().load(spark, path).report()
    assert report.n_posts == 1
    assert report.skip_reasons == {
        "post:ValueError": 2,
        "post:naive_timestamp": 1,
        "post:post_id:string_type": 1,
        "post:ambiguous_date": 1,
        "post:corrupted_identifier": 1,
        "post:ragged_row": 1,
        "post:empty_row": 1,
        "post:repeated_header": 1,
    }
    assert any("refused" in w for w in report.warnings)
    declared = adapters.NativeAdapter(MappingConfig(assume_offset_hours=0, date_order="dmy")).load(spark, path).report()
    assert declared.n_posts == 3 and "post:ambiguous_date" not in declared.skip_reasons
    with pytest.raises(adapters.RejectedRowError):
        adapters.NativeAdapter(MappingConfig(strict=True)).load(spark, path)


def test_aliases_json_lines_and_malformed_lines(spark, tmp_path):
    lines = [json.dumps({"tweetid": 7, "userid": "u", "tweet_time": 1709294400, "tweet_text": "t", "retweet_count": "17.0", "hashtags": ["a", " b "]}), "{broken", "", json.dumps({"id": "x", "post_id": "y", "user": "u", "date": 1709294400000, "likes": -1})]
    result = adapters.NativeAdapter().load(spark, put(tmp_path, "p.jsonl", "\n".join(lines)))
    (row,) = result.corpus.posts.collect()
    assert (row["post_id"], row["repost_count"], row["hashtags"], row["text"]) == ("7", 17, ["a", "b"], "t")
    assert result.report().skip_reasons == {"post:malformed_json": 1, "post:like_count:greater_than_equal": 1}


def test_accounts_and_labels(spark, tmp_path):
    posts = put(tmp_path, "p.csv", "id,author,timestamp\n1,a,2024-03-01T12:00:00Z\n2,zz,2024-03-01T12:00:00Z\n")
    accounts = put(tmp_path, "a.csv", "account_id,handle,created_at,followers,following,verified\na,@@name ,2020-01-01T00:00:00Z,10,x,Yes\nb,,,,,\n")
    labels = put(tmp_path, "l.jsonl", '{"account_id":"a","label":"organic","dataset":"d","confidence":0.5}\n{"account_id":"b","label":"robot","dataset":"d"}\n{"account_id":"b","label":"organic","dataset":"d","what":"1"}')
    result = adapters.NativeAdapter().load_tables(spark, posts, accounts, labels)
    a = result.corpus.accounts.orderBy("account_id").first()
    assert (a["handle"], a["followers_count"], a["following_count"], a["verified"]) == ("name", 10, None, True)
    report = result.report()
    assert report.skip_reasons == {"label:label:enum": 1, "label:what:extra_forbidden": 1}
    assert any("1 post(s)" in w for w in report.warnings)
    assert result.corpus.source == "p.csv+a.csv"


def test_json_corpus_keeps_provenance(spark, tmp_path):
    body = {"source": "origin", "collected_at": "2024-05-01T00:00:00Z", "posts": [{"post_id": "1", "account_id": "a", "created_at": "2024-03-01T00:00:00Z"}], "accounts": [{"account_id": "a"}], "labels": []}
    corpus = adapters.NativeAdapter().load(spark, put(tmp_path, "c.json", json.dumps(body))).corpus
    assert (corpus.source, corpus.collected_at, corpus.posts.count(), corpus.accounts.count()) == ("origin", "2024-05-01T00:00:00Z", 1, 1)
    assert adapters.NativeAdapter().load(spark, put(tmp_path, "b.json", json.dumps(body["posts"]))).corpus.posts.count() == 1
    with pytest.raises(ValueError):
        adapters.NativeAdapter().load(spark, put(tmp_path, "n.json", "3"))
    with pytest.raises(ValueError):
        raw.read_any(spark, "x.parquet")


def test_archive_roles_profiles_and_labels(spark, tmp_path):
    text = "tweetid,userid,tweet_time,tweet_text,is_retweet,in_reply_to_tweetid,quoted_tweet_tweetid,hashtags,user_screen_name,follower_count,account_creation_date\n"
    text += "1,u1,2015-01-01 10:00,a,False,,,\"['x','y']\",first,3.0,2014-01-01\n2,u1,2015-01-01 11:00,b,True,9,,[],second,4,2014-01-01\n3,u2,2015-01-01 12:00,c,false,9,8,,n,,2014-01-01\n4,u2,2015-01-01 12:00,c,,,8,,n,,2014-01-01\n"
    result = adapters.ArchiveAdapter("set").load_takedown(spark, put(tmp_path, "x_tweets.csv", text))
    kinds = [r["kind"] for r in result.corpus.posts.orderBy("post_id").collect()]
    assert kinds == ["original", "repost", "reply", "quote"]
    u1 = result.corpus.accounts.orderBy("account_id").first()
    assert (u1["handle"], u1["followers_count"]) == ("first", 3)
    assert result.corpus.posts.orderBy("post_id").first()["hashtags"] == ["x", "y"]
    assert {r["label"] for r in result.corpus.labels.collect()} == {"info_operation"} and result.corpus.labels.count() == 2


def test_annotations(spark, tmp_path):
    plain = put(tmp_path, "a.tsv", "u1\tbot\nu2\thuman\n\t\nu3\tsocial-spambot_1\n")
    got = {r["account_id"]: r["label"] for r in annotations.read_labels(spark, plain, dataset="d").collect()}
    assert got == {"u1": "automated", "u2": "organic", "u3": "automated"}
    numeric = put(tmp_path, "n.tsv", "u1\t1\n")
    with pytest.raises(annotations.UnknownClassError):
        annotations.read_labels(spark, numeric, dataset="d")
    assert annotations.read_labels(spark, numeric, dataset="d", numeric_convention="0_is_bot").first()["label"] == "organic"
    headed = put(tmp_path, "h.csv", "label,user_id\ngenuine account,u9\n")
    assert annotations.read_labels(spark, headed, dataset="d").first()["account_id"] == "u9"


def test_registry():
    registry = adapters.AdapterRegistry((adapters.ArchiveAdapter("d"), adapters.NativeAdapter()))
    assert registry.detect("/x/iran_tweets.csv").name == "io-archive" and registry.detect("p.jsonl").name == "native"
    assert registry.detect("p.parquet") is None and registry.names == ("io-archive", "native")
    with pytest.raises(ValueError):
        registry.register(adapters.NativeAdapter())


def test_a_filter_on_the_reason_does_not_copy_the_fields(spark, tmp_path):
    """Each mention of a field in a filter that was moved down read the whole row again."""
    from cadence.plans import ingest_queries

    spark.range(46).selectExpr("id AS event_id", "id % 5 AS user_id", "'view' AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    for query in (ingest_queries.ingest_posts, ingest_queries.ingest_post_rejects):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("map_entries(") == 1
    reasons = {r["reason"]: r["n"] for r in ingest_queries.ingest_post_rejects(spark, str(tmp_path)).collect()}
    assert reasons["post:ValueError"] == 4 and sum(reasons.values()) == 16


def test_a_report_counts_every_table_and_the_orphans(spark):
    rows = spark.createDataFrame([("1", "a", "2024-01-01T00:00:00Z"), ("2", "b", "2024-01-01T00:00:00Z"), ("3", "b", "2024-01-01T00:00:00Z"), ("4", "a", "never")], "id string, author string, created string")
    accounts = spark.createDataFrame([("a", "x"), ("c", "y"), ("a", "z")], "id string, handle string")
    told = adapters.NativeAdapter().from_records(spark, "t", raw.from_dataframe(rows), raw.from_dataframe(accounts)).report()
    assert (told.n_posts, told.n_accounts, told.n_skipped) == (3, 3, 1)
    assert told.warnings[0].startswith("2 post(s)")


def test_names_that_all_rows_have_are_resolved_before_any_row(spark, tmp_path):
    """A row's names are not searched, and the typed rows are those of a search."""
    from pyspark.sql import functions as F

    from cadence.sources.mapping import account_rows, label_rows, post_rows

    head = ' id ,Author,tweetid,userid,user_id,created_at,time,label,dataset,confidence,mood,extra,likes,kind,Is_Retweet,bio,followers\n'
    lines = [
        '1,a,9,b,c,,2024-03-01T12:00:00Z,organic,d,0.5,glad,"{""mood"":""x"",""k"":""v""}",3,,TRUE,me,4',
        ',,9,b,c,2024-3-1 4:05,,robot,d,1.5, ,,-1,reply,,,-2',
        '2,a,,,,03/04/2024 10:00,x,organic,,,sad,no,x,other,,,y',
        ',,,,,,,,,,,,,,,,',
        '4,a,,,,2024-13-45 10:00,,organic,d,,,,,,,,',
    ]
    found = raw.read_table(spark, put(tmp_path, "odd.csv", head + "\n".join(lines) + "\n"))
    plain = found.select("ordinal", F.col("row").alias("row", metadata={}), "problem")
    assert raw.names_of(found) and raw.names_of(plain) is None
    for config in (MappingConfig("twitter", 0.0, "dmy"), MappingConfig("twitter", 0.0, "dmy", post_row_transform=adapters.archive_role, post_row_sets=("kind",))):
        for rows in (post_rows, account_rows, label_rows):
            fixed, searched = rows(found, config), rows(plain, config)
            assert fixed.schema.simpleString() == searched.schema.simpleString()
            assert fixed.orderBy("ordinal").collect() == searched.orderBy("ordinal").collect()
            assert "map_entries" not in fixed._jdf.queryExecution().optimizedPlan().toString()


def test_a_timestamp_before_a_line_break_keeps_its_zone(spark):
    from pyspark.sql import functions as F

    from cadence.functions.timestamps import parsed

    texts = ["2024-03-01T12:00:00Z\n", "2024-03-01T14:00:00+02:00", "20240301T120000Z", "2024/3/1 12:00:00", "1/3/2024 12:00", "Fri Mar 01 12:00:00 +0000 2024", "2024-03-01 12:00", "2024-3-1 12:00"]
    at, _ = parsed(F.col("t"), 0, "dmy")
    assert {r["m"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_micros(at).alias("m")).collect()} == {1709294400000000}
