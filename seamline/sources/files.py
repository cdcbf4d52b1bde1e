"""Source files as a table, and the rules for which of them are looked at."""

from __future__ import annotations

import os
import re
import sys
from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions.paths import file_name
from seamline.plans.staging import small, stage
from seamline.schema import SOURCE_FILES

# Ship the readers with the task: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TEXT = pa.schema([(name, pa.string()) for name in ("service", "path", "content", "reason")])

# Up to so many service names are broadcast, so that texts need not be shuffled.
_MANY_SERVICES = 1_000_000
_DIRS_A_TASK, _FILES_A_TASK, _MOST_TASKS = 64, 256, 20_000
_ENTRY = "service STRING, path STRING, is_dir BOOLEAN"
_READ = SOURCE_FILES + ", reason STRING"


def file_location(spark: SparkSession, root: str) -> str:
    """``root`` as tasks open it: a path without a scheme is one of the default file system."""
    if "://" not in root and not root.startswith("file:"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        root = root if default.startswith("file:") else default.rstrip("/") + "/" + root.lstrip("/")
    return re.sub(r"\A(s3a|s3n)://", "s3://", re.sub(r"\Afile:/+", "/", root)).rstrip("/")


def open_location(location: str) -> tuple[FileSystem, str]:
    """The file system of a location, and its path there."""
    return FileSystem.from_uri(location) if "://" in location else (LocalFileSystem(), location)


def _spread(rows: DataFrame, a_task: int) -> DataFrame:
    """Deal staged rows out by file, so many to a task."""
    tasks = min(-(-rows.count() // a_task), _MOST_TASKS)
    return rows.repartition(max(tasks, 1), "service", "path")


def read_source_files(
    spark: SparkSession, root: str, suffixes: tuple[str, ...] = (), skip_dirs: tuple[str, ...] = ()
) -> DataFrame:
    """``source_files`` from a directory that holds one directory per service.

    Spark's own file sources pass over names that start with ``_`` or ``.``, and
    ``__init__.py`` matters here, so tasks list and read the files themselves.  The texts
    are staged, so that the many small files are opened once.  A file that could not be
    read has no ``content`` but a ``reason``, of which extraction makes a warning.
    """
    location = file_location(spark, root)
    listed = list_files(spark, location, suffixes, skip_dirs)
    return stage(read_listed(listed, location), "source-files")


def list_files(
    spark: SparkSession, location: str, suffixes: tuple[str, ...] = (), skip_dirs: tuple[str, ...] = ()
) -> DataFrame:
    """``(service, path)`` of the files below each service's directory.

    The directories found on one level are a table, dealt out over as many tasks as it
    needs, and these list the next level; so one service with most of the directories
    is listed by all tasks.  There are as many rounds as levels.  Links to directories
    are not followed below a service, so that no file is listed twice.
    """

    def entries(batches):
        fs, base = open_location(location)
        for batch in batches:
            for service, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = "/".join(part for part in (base, service, path) if part)
                rows = []
                for entry in fs.get_file_info(FileSelector(start)):
                    name = entry.base_name
                    below = f"{path}/{name}" if path else name
                    if service is None:
                        rows += [(name, "", True)] * (entry.type == FileType.Directory)
                    elif entry.type == FileType.Directory:
                        linked = isinstance(fs, LocalFileSystem) and os.path.islink(entry.path)
                        rows += [(service, below, True)] * (name not in skip_dirs and not linked)
                    elif name.endswith(suffixes or ("",)):
                        rows.append((service, below, False))
                for k in range(0, len(rows), 10_000):
                    columns = zip(*rows[k : k + 10_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_()))],
                        ["service", "path", "is_dir"],
                    )

    frontier, levels = spark.createDataFrame([(None, "")], "service STRING, path STRING"), []
    while not levels or not levels[-1].filter("is_dir").isEmpty():
        if levels:
            frontier = _spread(levels[-1].filter("is_dir").select("service", "path"), _DIRS_A_TASK)
        levels.append(stage(frontier.mapInArrow(entries, _ENTRY), "source-level", "is_dir"))
    return reduce(DataFrame.unionAll, levels).filter("NOT is_dir").select("service", "path")


def read_listed(listed: DataFrame, location: str) -> DataFrame:
    """``(service, path, content, reason)`` of listed files, by one pass over them.

    A file that is gone, or may not be read, has no content but a reason.  Any other
    failure is raised, so that Spark tries the task again rather than lose a file.
    """

    def contents(batches):
        fs, base = open_location(location)
        for batch in batches:
            for row in batch.to_pylist():
                row |= {"content": None, "reason": None}
                try:
                    with fs.open_input_stream(f"{base}/{row['service']}/{row['path']}") as file:
                        text = file.read().decode("utf-8", "replace")
                    row["content"] = text.replace("\r\n", "\n").replace("\r", "\n")
                except (FileNotFoundError, PermissionError) as error:
                    row["reason"] = "no such file" if isinstance(error, FileNotFoundError) else "permission denied"
                yield pa.RecordBatch.from_pylist([row], schema=_TEXT)

    return _spread(listed, _FILES_A_TASK).mapInArrow(contents, _READ)


def unreadable(files: DataFrame) -> DataFrame:
    """``(service, file, reason)`` of the files that could not be read."""
    if "reason" not in files.columns:
        files = files.withColumn("reason", F.lit(None).cast("string"))
    return files.filter("reason IS NOT NULL").select("service", F.col("path").alias("file"), "reason")


def app_roots(files: DataFrame) -> DataFrame:
    """``(service, app_root)``: what to strip from the service's paths.

    The service directory itself if it holds ``app/``; else the directory of the
    same name inside it, if that holds ``app/``; else the service directory.
    """
    nested = F.concat(F.col("service"), F.lit("/"))
    return files.groupBy("service").agg(
        F.when(F.bool_or(F.startswith("path", F.lit(fixed.APP_DIR))), F.lit(""))
        .when(
            F.bool_or(F.startswith("path", F.concat(nested, F.lit(fixed.APP_DIR)))),
            F.first(nested),
        )
        .otherwise(F.lit(""))
        .alias("app_root")
    )


def at_app_root(files: DataFrame) -> DataFrame:
    """Files below their service's application root, paths relative to it."""
    # Written first: the roots are counted, and joined in several places.
    nested = stage(app_roots(files.select("service", "path")).filter("app_root != ''"), "app-roots")
    inside = files.join(small(nested, _MANY_SERVICES), "service", "left").filter(
        F.col("app_root").isNull() | F.startswith("path", F.col("app_root"))
    )
    return inside.select(
        "service",
        F.substr("path", F.coalesce(F.length("app_root"), F.lit(0)) + 1).alias("path"),
        "content",
        *[c for c in files.columns if c == "reason"],
    )


def python_files(files: DataFrame) -> DataFrame:
    """Back-end sources: ``app/**/*.py``."""
    return files.filter(
        F.startswith("path", F.lit(fixed.APP_DIR)) & F.endswith("path", F.lit(".py"))
    )


def is_private(path: str = "path"):
    """File name starts with an underscore."""
    return F.startswith(file_name(F.col(path)), F.lit("_"))


def in_routes() -> Column:
    """Files scanned for routes: no private ones, but packages' ``__init__.py``."""
    return ~is_private() | (file_name(F.col("path")) == "__init__.py")


def route_files(nodes: DataFrame) -> DataFrame:
    return nodes.filter(in_routes())


def in_clients() -> Column:
    """Files scanned for HTTP clients."""
    return F.startswith("path", F.lit(fixed.CLIENT_DIR)) & ~is_private() & F.col("has_client")


def client_files(nodes: DataFrame) -> DataFrame:
    return nodes.filter(in_clients())


def frontend_files(files: DataFrame) -> DataFrame:
    """Front-end sources: known extensions, outside build and vendor directories."""
    parts = F.split("path", "/", -1)
    name = file_name(F.col("path"))
    # A leading dot starts a hidden name, not an extension; "a." has none.
    extension = F.regexp_extract(name, r"\A.+(\.[^.]+)\z", 1)
    skipped = F.array(*[F.lit(d) for d in fixed.FRONTEND_SKIPPED_DIRS])
    return files.filter(
        extension.isin(fixed.FRONTEND_EXTENSIONS) & ~F.arrays_overlap(parts, skipped)
    )


def of_kind(files: DataFrame, services: DataFrame, kind: str) -> DataFrame:
    """Files of the services of one kind; a service not listed is a back end."""
    frontends = small(services.filter(F.col("kind") == "frontend"), _MANY_SERVICES)
    return files.join(frontends, "service", "left_semi" if kind == "frontend" else "left_anti")
