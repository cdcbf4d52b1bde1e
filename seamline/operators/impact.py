"""Questions over the facts of all services.

Every question comes as a table, so one job answers any number of them.  The
facts are the large side everywhere: they are filtered to the columns and section
needed, and counted per key before anything is shuffled for a report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline import schema
from seamline.functions.paths import location, match_path, question_method, question_path

_ENDPOINT = ["method", "norm_path"]


def section(facts: DataFrame, name: str) -> DataFrame:
    """One kind of fact, with only its own columns."""
    columns = ["service", "ord", *schema.SECTIONS[name]]
    if name in (schema.HTTP_PROVIDERS, schema.HTTP_CONSUMERS):
        columns.append("norm_path")
    return facts.filter(F.col("section") == name).select(*columns)


def endpoint_questions(questions: DataFrame) -> DataFrame:
    """Parse ``question`` (``"METHOD /path"``); ``valid`` is false if it is not two parts."""
    text = F.col("question")
    path = question_path(text)
    return questions.select(
        "question",
        question_method(text).alias("method"),
        path.alias("path"),
        match_path(path).alias("norm_path"),
        path.isNotNull().alias("valid"),
    )


def _endpoint_facts(facts: DataFrame) -> DataFrame:
    """Providers and consumers in one frame, read in one scan."""
    is_provider = F.col("section") == schema.HTTP_PROVIDERS
    return facts.filter(
        F.col("section").isin(schema.HTTP_PROVIDERS, schema.HTTP_CONSUMERS)
    ).select(
        *_ENDPOINT,
        F.when(is_provider, "provider").otherwise("consumer").alias("role"),
        "service",
        "target",
        F.when(is_provider, F.col("handler")).otherwise(F.col("caller")).alias("place"),
        "line",
        "ord",
    )


def endpoint_impact(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """Who serves and who calls each asked endpoint, one row per place.

    A consumer's ``target`` is shown but not compared.  The join is an inner one
    with the questions distinct on the key, so a popular endpoint can be split.
    Endpoints nobody serves or calls are in ``endpoint_counts``.
    """
    asked = endpoint_questions(questions).filter("valid").select("question", *_ENDPOINT).distinct()
    return (
        _endpoint_facts(facts)
        .join(asked, _ENDPOINT)
        .select(
            "question", "role", "service", "target", "place", "line",
            location(F.col("place"), F.col("line")).alias("location"),
            "ord",
        )
    )


def endpoint_counts(facts: DataFrame, questions: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Number of providers and consumers of each asked endpoint, zeros included.

    With the table of known services, ``unindexed`` counts those without a
    contract wherever no consumer was found: their calls would be invisible.
    """
    counted = _endpoint_facts(facts).groupBy(*_ENDPOINT).agg(
        F.count_if(F.col("role") == "provider").alias("providers"),
        F.count_if(F.col("role") == "consumer").alias("consumers"),
    )
    asked = endpoint_questions(questions).filter("valid").select("question", *_ENDPOINT).distinct()
    out = asked.join(counted, _ENDPOINT, "left").select(
        "question",
        F.coalesce("providers", F.lit(0)).alias("providers"),
        F.coalesce("consumers", F.lit(0)).alias("consumers"),
    )
    if services is None:
        return out
    missing = unindexed_services(facts, services).agg(F.count("*")).scalar()
    return out.withColumn("unindexed", F.when(F.col("consumers") == 0, missing).otherwise(F.lit(0)))


def discover_services(facts: DataFrame) -> DataFrame:
    """Names of the services that have a contract, sorted."""
    return facts.select("service").distinct().orderBy("service")


def unindexed_services(facts: DataFrame, services: DataFrame) -> DataFrame:
    """Known services without a contract, sorted."""
    indexed = facts.select("service").distinct()
    known = services.select("service").distinct()
    return known.join(indexed, "service", "left_anti").orderBy("service")


def _topic_facts(facts: DataFrame) -> DataFrame:
    is_publisher = F.col("section") == schema.TOPICS_PUBLISHED
    return facts.filter(
        F.col("section").isin(schema.TOPICS_PUBLISHED, schema.TOPICS_SUBSCRIBED)
    ).select(
        "topic",
        F.when(is_publisher, "publisher").otherwise("subscriber").alias("role"),
        "service",
        F.when(is_publisher, F.col("publisher")).otherwise(F.col("handler")).alias("place"),
        "schema",
        "line",
        "ord",
    )


def topic_impact(facts: DataFrame, topics: DataFrame) -> DataFrame:
    """Who publishes and who subscribes each asked ``topic``, one row per place."""
    return (
        _topic_facts(facts)
        .join(topics.select("topic").distinct(), "topic")
        .select(
            "topic", "role", "service", "place", "schema", "line",
            location(F.col("place"), F.col("line")).alias("location"),
            "ord",
        )
    )


def topic_counts(facts: DataFrame, topics: DataFrame) -> DataFrame:
    """Number of publishers and subscribers of each asked topic, zeros included."""
    counted = _topic_facts(facts).groupBy("topic").agg(
        F.count_if(F.col("role") == "publisher").alias("publishers"),
        F.count_if(F.col("role") == "subscriber").alias("subscribers"),
    )
    return topics.select("topic").distinct().join(counted, "topic", "left").na.fill(
        0, ["publishers", "subscribers"]
    )


def orphan_topics(facts: DataFrame, role: str) -> DataFrame:
    """Topics only published (``role='publisher'``) or only subscribed.

    ``(topic, service, sites)``: a service's sites are counted instead of listing
    its name once per site, which keeps a topic with very many sites short.
    Both sides come from one scan and one count per (topic, service).
    """
    per_service = (
        _topic_facts(facts)
        .groupBy("topic", "service", "role")
        .agg(F.count("*").alias("sites"))
    )
    other = per_service.filter(F.col("role") != role).select("topic").distinct()
    return (
        per_service.filter(F.col("role") == role)
        .join(other, "topic", "left_anti")
        .select("topic", "service", "sites")
        .orderBy("topic", "service")
    )


def subscriptions_without_handler(facts: DataFrame) -> DataFrame:
    """Subscriptions nobody handles, one row per subscription."""
    return section(facts, schema.TOPICS_SUBSCRIBED).filter("handler IS NULL").select(
        "service", "topic", "line", "ord"
    )


def orphan_check(facts: DataFrame) -> DataFrame:
    """One row: how many topics are only published, how many only subscribed, how many
    subscriptions nobody handles, and ``clean`` if there are none of these."""
    is_publisher, is_subscriber = F.col("role") == "publisher", F.col("role") == "subscriber"
    per_topic = _topic_facts(facts).groupBy("topic").agg(
        F.bool_or(is_publisher).alias("published"),
        F.bool_or(is_subscriber).alias("subscribed"),
        F.count_if(is_subscriber & F.col("place").isNull()).alias("unhandled"),
    )
    counted = per_topic.agg(
        F.count_if(F.col("published") & ~F.col("subscribed")).alias("published_only"),
        F.count_if(F.col("subscribed") & ~F.col("published")).alias("subscribed_only"),
        F.coalesce(F.sum("unhandled"), F.lit(0)).alias("unhandled"),
    )
    return counted.withColumn("clean", (F.col("published_only") + F.col("subscribed_only") + F.col("unhandled")) == 0)


def no_orphans(facts: DataFrame) -> bool:
    """True if no topic is orphaned and every subscription has a handler."""
    return orphan_check(facts).first()["clean"]


def status(facts: DataFrame) -> DataFrame:
    """Six counts per service, sorted; a service with an empty contract has zeros."""
    counts = {
        "providers": schema.HTTP_PROVIDERS,
        "consumers": schema.HTTP_CONSUMERS,
        "publishes": schema.TOPICS_PUBLISHED,
        "subscribes": schema.TOPICS_SUBSCRIBED,
        "schemas": schema.EVENT_SCHEMAS,
        "warnings": schema.EXTRACTION_WARNINGS,
    }
    return facts.groupBy("service").agg(
        *[F.count_if(F.col("section") == name).alias(label) for label, name in counts.items()]
    ).orderBy("service")
