import pytest
from pyspark.sql import functions as F

import seamline as s
from seamline import schema
from seamline.functions.paths import match_path
from tests.conftest import rows

DOCUMENTS = [
    ("alpha", """{"service": "alpha", "provides": {"http": [
        {"method": "GET", "path": "/things/{thing_id}", "handler": "get_thing", "line": 22}],
        "topics_published": [{"topic": "thing.made", "schema": "Thing", "publisher": "make", "line": 42},
          {"topic": "thing.made", "schema": null, "publisher": "again", "line": 43},
          {"topic": "thing.lost", "publisher": "lose", "line": 1}]}}"""),
    ("beta", """{"service": "beta", "consumes": {"http": [
        {"target": "wrong", "method": "GET", "path": "/things/{id}", "caller": "call", "line": 9},
        {"target": "alpha", "method": "POST", "path": "/things/{id}", "caller": "post", "line": 10}],
        "topics_subscribed": [{"topic": "thing.made", "handler": "on_thing", "line": 17},
          {"topic": "thing.dead", "handler": null}]}}"""),
    ("empty", '{"service": "empty"}'),
]


@pytest.fixture(scope="module")
def facts(spark):
    raw = spark.createDataFrame(DOCUMENTS, "repo STRING, document STRING")
    return s.documents_to_facts(raw).drop("repo").cache()


def asked(spark, *texts, name="question"):
    return spark.createDataFrame([(t,) for t in texts], f"{name} STRING")


def test_endpoint_impact_ignores_target_and_parameter_names(spark, facts):
    got = s.endpoint_impact(facts, asked(spark, "get /things/{x}", "GET", "GET /none"))
    assert rows(got, "question", "role", "service", "target", "location") == [
        ("get /things/{x}", "consumer", "beta", "wrong", "call:9"),
        ("get /things/{x}", "provider", "alpha", None, "get_thing:22"),
    ]


def test_endpoint_counts_keep_unanswered_questions(spark, facts):
    services = spark.createDataFrame(
        [("alpha", "backend"), ("gamma", "backend"), ("delta", "frontend")], schema.DIM_SERVICES
    )
    questions = asked(spark, "GET /things/{x}", "DELETE /things/{x}", "nonsense")
    assert rows(s.endpoint_counts(facts, questions, services), "question", "providers", "consumers", "unindexed") == [
        ("DELETE /things/{x}", 0, 0, 2), ("GET /things/{x}", 1, 1, 0),
    ]
    unindexed = s.unindexed_services(facts, services).collect()
    assert [r.service for r in unindexed] == ["delta", "gamma"]


def test_topic_impact(spark, facts):
    got = s.topic_impact(facts, asked(spark, "thing.made", "thing.made", "no", name="topic"))
    assert rows(got, "role", "service", "place", "schema", "line") == [
        ("publisher", "alpha", "again", None, 43),
        ("publisher", "alpha", "make", "Thing", 42),
        ("subscriber", "beta", "on_thing", None, 17),
    ]
    counts = s.topic_counts(facts, asked(spark, "thing.made", "no", name="topic"))
    assert rows(counts, "topic", "publishers", "subscribers") == [("no", 0, 0), ("thing.made", 2, 1)]


def test_orphans(facts):
    assert rows(s.orphan_topics(facts, "publisher"), "topic", "service", "sites") == [("thing.lost", "alpha", 1)]
    assert rows(s.orphan_topics(facts, "subscriber"), "topic", "service", "sites") == [("thing.dead", "beta", 1)]
    assert rows(s.subscriptions_without_handler(facts), "service", "topic") == [("beta", "thing.dead")]
    assert not s.no_orphans(facts)


def test_no_orphans(facts):
    clean = facts.filter("topic IS NULL OR topic = 'thing.made'")
    assert s.no_orphans(clean)


def test_status_and_discovery_are_sorted_and_keep_empty_services(facts):
    got = [tuple(r) for r in s.status(facts).collect()]
    assert got == [
        ("alpha", 1, 0, 3, 0, 0, 0), ("beta", 0, 2, 0, 2, 0, 0), ("empty", 0, 0, 0, 0, 0, 0),
    ]
    assert [r.service for r in s.discover_services(facts).collect()] == ["alpha", "beta", "empty"]


def test_one_endpoint_with_a_third_of_all_calls(spark):
    calls = spark.range(30000).select(
        F.lit("web").alias("service"), F.lit(schema.HTTP_CONSUMERS).alias("section"),
        F.lit(None).cast(schema.ORD).alias("ord"), F.lit("GET").alias("method"),
        F.when(F.col("id") % 3 == 0, "/hot/{a}").otherwise(F.concat(F.lit("/p/"), "id")).alias("path"),
        F.lit(None).cast("string").alias("handler"), F.lit("t").alias("target"),
        F.lit("c").alias("caller"), F.col("id").cast("int").alias("line"),
    ).withColumn("norm_path", match_path(F.col("path")))
    questions = spark.range(30000).selectExpr("concat('GET /p/', id) AS question").unionByName(
        asked(spark, "GET /hot/{b}")
    )
    assert s.endpoint_impact(calls, questions).count() == 30000
    top = s.endpoint_counts(calls, questions).orderBy(F.desc("consumers")).first()
    assert (top.question, top.consumers) == ("GET /hot/{b}", 10000)
