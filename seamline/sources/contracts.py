"""Contracts as a table: one long table of facts, one directory per repository."""

from __future__ import annotations

import sys
import time
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seamline import fixed, schema
from seamline.functions.paths import match_path, ord_key
from seamline.operators.validate import violations, whole_number
from seamline.plans.staging import numbered, small, stage
from seamline.schema import FACTS, SECTIONS, struct_type
from seamline.sources.files import file_location, open_location

# Ship the writer with the task: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tagged(rows: DataFrame, section: str) -> DataFrame:
    """Give the rows of one section the columns of the long table, and keep ``repo``."""
    have = set(rows.columns)
    columns = [F.col("repo")] if "repo" in have else []
    for field in struct_type(FACTS).fields:
        if field.name == "section":
            value = F.lit(section)
        elif field.name in have:
            value = F.col(field.name)
        else:
            value = F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return rows.select(*columns)


def header(services: DataFrame) -> DataFrame:
    """A row per service, so that a service without facts still has a contract."""
    return tagged(services.select("service").distinct(), schema.SERVICE)


def _stored(*partitions: str) -> StructType:
    schema_ = struct_type(FACTS)
    for name in partitions:
        schema_ = schema_.add(name, "string")
    return schema_


def save_contracts(facts: DataFrame, root: str) -> None:
    """Replace the contracts of the services in ``facts``; leave all others alone.

    Facts go to a folder of their own, named by a version that ascends with time; one row
    per repository in ``commits`` then makes them the ones that count.  Readers take each
    repository's last committed version, so that a job that dies on the way leaves the
    contracts as they were.  A service without a ``repo`` is its own repository.
    Rebalancing brings a repository's rows together but splits those of a very large one,
    so that many tasks write it.  Within a task rows are sorted by section, which lets
    readers skip what they do not ask for.
    """
    spark = facts.sparkSession
    repo = F.coalesce("repo", "service") if "repo" in facts.columns else F.col("service")
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    written = f"{root.rstrip('/')}/facts/version={version}"
    (
        facts.withColumn("repo", repo)
        .hint("rebalance", F.col("repo"))
        .sortWithinPartitions("repo", "section")
        .write.partitionBy("repo")
        .parquet(written)
    )
    saved = spark.read.schema(_stored("repo")).parquet(written).select("repo").distinct()
    saved.select(F.lit(version).alias("version"), "repo").coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/commits")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """``(version, repo)``: the version of each repository that counts."""
    commits = spark.read.schema("version STRING, repo STRING").parquet(f"{root.rstrip('/')}/commits")
    return commits.groupBy("repo").agg(F.max("version").alias("version")).select("version", "repo")


def stored_contracts(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame:
    """The facts that count of all repositories, or of one, with ``repo``."""
    stored, current = spark.read.schema(_stored("version", "repo")).parquet(f"{root.rstrip('/')}/facts"), committed(spark, root)
    if repo is not None:
        stored, current = stored.filter(F.col("repo") == repo), current.filter(F.col("repo") == repo)
    return stored.join(small(current), ["version", "repo"], "left_semi").drop("version")


def drop_old_versions(spark: SparkSession, root: str) -> None:
    """Delete folders of versions that no repository needs; not while others save contracts."""
    path = f"{root.rstrip('/')}/facts"
    needed = {f"version={row.version}" for row in committed(spark, root).select("version").distinct().toLocalIterator()}
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in fs.listStatus(folder):
        if entry.getPath().getName().startswith("version=") and entry.getPath().getName() not in needed:
            fs.delete(entry.getPath(), True)


def load_contracts(spark: SparkSession, root: str) -> DataFrame:
    """All facts.  If two repositories claim a service, the last one counts."""
    return last_repository(stored_contracts(spark, root))


def last_repository(stored: DataFrame) -> DataFrame:
    """Keep, for each service, the facts of the last repository that has it.

    The header rows, one per repository, tell which repositories lost a service.
    Those are few, so dropping their facts moves nothing else.
    """
    claims = stored.filter(F.col("section") == schema.SERVICE).select("service", "repo").distinct()
    last = claims.groupBy("service").agg(F.max("repo").alias("last"))
    lost = claims.join(last, "service").filter("repo != last").select("service", "repo")
    return stored.join(small(lost), ["service", "repo"], "left_anti").drop("repo")


def load_documents(spark: SparkSession, root: str, name: str = "contracts.json") -> DataFrame:
    """All facts of the valid documents ``<root>/<repo>/<name>``; of two repositories that
    claim a service the last one counts.

    The facts are staged, so that the texts are read and parsed once.
    """
    found = documents_to_facts(read_documents(spark, root, name))
    return last_repository(stage(found, "document-facts", "section"))


def load_one(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """Facts of one repository; only its directories are read."""
    return stored_contracts(spark, root, repo).drop("repo")


def discover_repositories(spark: SparkSession, root: str) -> DataFrame:
    """Names of the repositories that hold a contract, sorted."""
    return committed(spark, root).select("repo").orderBy("repo")


def _placed(facts: DataFrame) -> DataFrame:
    """Facts with ``position``, their place in the service's document."""
    sections = F.array(*[F.lit(name) for name in (schema.SERVICE, *SECTIONS)])
    named = dict.fromkeys(c for columns in SECTIONS.values() for c in columns)
    order = [F.array_position(sections, F.col("section")), F.col("ord"), F.struct(*[c for c in facts.columns if c in named])]
    return numbered(facts, ["service"], order, "position")


def with_positions(facts: DataFrame) -> DataFrame:
    """Facts with ``position``, their place in the service's document, and ``item``, that in their list.

    Facts of one place are in the order of their columns.
    """
    placed = _placed(facts)
    first = placed.groupBy("service", "section").agg(F.min("position").alias("begin"))
    listed = placed.join(small(first), ["service", "section"])
    return listed.withColumn("item", F.col("position") - F.col("begin")).select(*facts.columns, "position", "item")


def document_items(facts: DataFrame) -> DataFrame:
    """The contract documents, one row per list item: ``(service, location, ord, item)``.

    Items carry their documented fields in order, nulls included.  A document of
    any size is a sorted set of rows; none has to fit in one.
    """
    location: Column = F.lit("")
    for name in SECTIONS:
        location = F.when(F.col("section") == name, F.lit(schema.DOCUMENT_PATHS[name])).otherwise(location)
    return facts.select("service", location.alias("location"), "ord", _item().alias("item"))


def _item() -> Column:
    """A fact as JSON: its section's fields in order, nulls included."""
    item = F.to_json(F.struct(F.col("service"), F.lit(fixed.EXTRACTOR_VERSION).alias("extractor_version")))
    for name, columns in SECTIONS.items():
        fields = F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})
        item = F.when(F.col("section") == name, fields).otherwise(item)
    return item


def show_contract(facts: DataFrame, service: str) -> DataFrame:
    """One service's document in order, as JSON items."""
    order = list(schema.DOCUMENT_PATHS.values())
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("location"))
    return (
        document_items(facts.filter(F.col("service") == service))
        .orderBy(place, "ord")
        .select("service", "location", "item")
    )


# What stands between two lists of a nested document, in their order, and after the last.
_BETWEEN = (
    '],"topics_published":[', ']},"consumes":{"http":[', '],"topics_subscribed":[', ']},"event_schemas":[',
    '],"_extraction_warnings":[', "]}",
)
_ITEMS_A_PART = 1000


def document_parts(facts: DataFrame) -> DataFrame:
    """Nested contract documents as JSON, ``(repo, part, text)``; the texts of a document joined make it.

    Every row knows its place in its list and which lists come before and after, so that it
    can write its own part of the document, the brackets included; a part is so many rows
    that follow each other.  No document is held or passed through one task.  A service
    without facts has a document of empty lists.
    """
    repo = F.coalesce("repo", "service") if "repo" in facts.columns else F.col("service")
    owners = facts.select("service", repo.alias("repo")).groupBy("service").agg(F.max("repo").alias("repo"))
    plain = facts.drop("repo").filter(F.col("section") != schema.SERVICE)
    placed = _placed(plain.unionByName(header(facts)))
    rank = F.array_position(F.array(*[F.lit(name) for name in SECTIONS]), F.col("section"))  # 0: the header
    counts = placed.groupBy("service", "section").agg(F.count("*").alias("n"), F.min("position").alias("begin")).withColumn("rank", rank)
    of_service = Window.partitionBy("service").orderBy("rank")
    lists = counts.select(
        "service", "section", "rank", "begin",
        F.greatest(F.coalesce(F.lag("rank").over(of_service), F.lit(1)), F.lit(1)).alias("prior"),
        F.when(F.lead("rank").over(of_service).isNull(), F.col("n")).alias("ends"),
    )
    between = F.array(*[F.lit(text) for text in _BETWEEN])
    here = F.greatest("rank", F.lit(1))
    lead = F.when(F.col("item") > 0, ",").otherwise(F.array_join(F.slice(between, F.col("prior"), here - F.col("prior")), ""))
    tail = F.when(
        F.col("item") == F.col("ends") - 1, F.array_join(F.slice(between, here, len(_BETWEEN) - here + 1), "")
    ).otherwise("")
    # All that is known of a list comes by one join, as the facts are many.
    listed = placed.join(small(lists.join(owners, "service")), ["service", "section"])
    items = listed.withColumn("item", F.col("position") - F.col("begin"))
    opening = F.concat(
        F.regexp_replace(_item(), r"\}\z", ""), F.lit(',"provides":{"http":['), tail
    )
    text = F.when(F.col("section") == schema.SERVICE, opening).otherwise(F.concat(lead, _item(), tail))
    part = F.floor(F.col("position") / _ITEMS_A_PART).alias("part")
    pieces = items.select("repo", part, "position", text.alias("text")).groupBy("repo", "part")
    joined = pieces.agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("rows"))
    return joined.select("repo", "part", F.array_join("rows.text", "").alias("text"))


def write_documents(facts: DataFrame, root: str, name: str = "contracts.json") -> None:
    """Write each repository's nested document to ``<root>/<repo>/<name>``.

    A task holds one part at a time.  A document takes its name when it is complete, in
    place of an earlier one.
    """
    location = file_location(facts.sparkSession, root)
    parts = document_parts(facts).repartition("repo").sortWithinPartitions("repo", "part")

    def write(batches):
        fs, base = open_location(location)
        at, file, places = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["repo"] != at:
                    if file:
                        file.close()
                        fs.move(*places)
                    at, folder = row["repo"], f"{base}/{row['repo']}"
                    fs.create_dir(folder, recursive=True)
                    places = f"{folder}/.{name}-{uuid.uuid4().hex}", f"{folder}/{name}"
                    file = fs.open_output_stream(places[0])
                file.write(row["text"].encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])
        if file:
            file.close()
            fs.move(*places)

    parts.mapInArrow(write, "n LONG").write.format("noop").mode("overwrite").save()


def documents_to_facts(documents: DataFrame) -> DataFrame:
    """Facts of the valid ones of ``documents(repo, document)``, JSON texts.

    Returns the long table with ``repo``; see ``last_repository``.  Unknown fields
    are ignored and missing lists are empty.  ``contract_violations`` tells what is
    wrong with the documents left out.
    """
    # As the element of a list: a filter of rows would parse the text wherever it reads the result.
    valid = F.filter(F.array(F.try_parse_json("document")), lambda d: F.size(violations(d)) == 0)
    parsed = documents.select("repo", F.explode(valid).alias("d"))

    def items(section: str) -> Column:
        found = F.try_variant_get("d", f"$.{schema.DOCUMENT_PATHS[section]}", "array<variant>")
        return F.transform(
            F.coalesce(found, F.array().cast("array<variant>")),
            lambda item, pos: F.struct(
                F.lit(section).alias("section"), pos.alias("pos"), item.alias("item")
            ),
        )

    head = F.array(F.struct(
        F.lit(schema.SERVICE).alias("section"), F.lit(0).alias("pos"), F.col("d").alias("item")
    ))
    rows = parsed.select(
        "repo",
        F.try_variant_get("d", "$.service", "string").alias("service"),
        F.explode(F.concat(head, *[items(s) for s in SECTIONS])).alias("e"),
    )
    # An item's fields are taken from it at once; the head's are none.
    texts = [f.name for f in struct_type(FACTS).fields if f.dataType.simpleString() == "string" and f.name not in ("service", "section", "norm_path")]
    wanted = ", ".join(f"{name}: string" for name in [*texts, "event_schema"])
    is_head = F.col("e.section") == schema.SERVICE
    rows = rows.select(
        "repo", "service", "e",
        F.when(~is_head, F.try_variant_get("e.item", "$", f"struct<{wanted}>")).alias("text"),
        F.when(~is_head, F.try_variant_get("e.item", "$.line", "variant")).alias("line"),
        F.when(~is_head, F.try_variant_get("e.item", "$.schema", "variant").isNull()).alias("named_otherwise"),
    )

    def field(name: str) -> Column:
        if name == "line":
            return whole_number(F.col("line"))
        if name == "schema":  # either name is accepted; the first counts, null or not
            return F.when(F.col("named_otherwise"), F.col("text.event_schema")).otherwise(F.col("text.schema"))
        return F.col(f"text.{name}")

    given = {
        "service": F.col("service"),
        "section": F.col("e.section"),
        "ord": ord_key(0, F.array().cast("array<string>"), F.col("e.pos")),
        "norm_path": match_path(field("path")),
    }
    return rows.select("repo", *[
        (given[f.name] if f.name in given else field(f.name)).cast(f.dataType).alias(f.name)
        for f in struct_type(FACTS).fields
    ])


def read_documents(spark: SparkSession, root: str, name: str = "contracts.json") -> DataFrame:
    """``(repo, document)`` from ``<root>/<repo>/<name>``, whole texts."""
    text = spark.read.text(f"{root.rstrip('/')}/*/{name}", wholetext=True)
    repo = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return text.select(F.url_decode(repo).alias("repo"), F.col("value").alias("document"))
