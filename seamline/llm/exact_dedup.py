"""Exact copies, found by length, then by a hash of the beginning, then by a full hash.

Texts are equal if they are identical once A-Z are in lower case; a null is an empty
text.  Each level reads more of fewer texts:

1. one scan takes the length and a hash of the first characters of every text and
   counts them with map-side aggregation: a text alone in its length or its beginning
   is settled,
2. a second scan hashes the whole text of the rows that are left.  Which rows these are
   is told by a set of at most 2 ** 18 buckets, the only thing broadcast; a row that
   shares a bucket by chance is hashed and then found to be alone,
3. rows of equal length and hash form a group.  Only numbers and hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.frames import _quoted, hidden, lowered, small_enough
from seamline.plans.staging import stage

PREFIX_CHARS = 64
BUCKETS = 1 << 18  # bounds the broadcast to 2 MB, whatever the input
_LENGTH, _BUCKET, _FULL = "__copy_length", "__copy_bucket", "__copy_full"


def _keyed(df: DataFrame, text_col: str) -> DataFrame:
    text = lowered(F.col(_quoted(text_col)).cast("string"))
    prefix = F.xxhash64(F.substring(text, 1, PREFIX_CHARS), F.octet_length(text))
    return df.withColumns({
        _LENGTH: F.octet_length(text),
        _BUCKET: F.pmod(prefix, F.lit(BUCKETS)),
        "__copy_prefix": prefix,
    })


def _shared_buckets(keyed: DataFrame) -> DataFrame:
    """The buckets with texts that share their length and beginning; of bounded size, stored."""
    shared = (
        keyed.groupBy(_LENGTH, "__copy_prefix", _BUCKET)
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select(_BUCKET)
        .distinct()
    )
    return F.broadcast(stage(shared, "copy-buckets").withColumn("left", F.lit(True)))


def _full_hash(text: str):
    return F.unhex(F.sha2(lowered(F.col(_quoted(text)).cast("string")), 256))


def copy_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False
) -> DataFrame:
    """One row per row of ``df``: its id, ``keep_id``, ``group_size``, ``kept``, ``full_hash``, ``bucket``.

    Of equal texts the row with the largest id stays; of rows with that same id, one of
    them.  Null ids count as smallest.  Null and empty texts are copies of each other.
    ``full_hash`` is the SHA-256 of the lowered text, null where the text was settled
    without it unless ``digest_all``.  Other columns are not read.  An empty table gives
    an empty result.  A group of any size is counted before it is shuffled.
    """
    chosen = df.select(F.col(_quoted(id_col)).alias("id"), F.col(_quoted(text_col)).cast("string").alias("text"))
    keyed = _keyed(chosen, "text")
    left = _shared_buckets(keyed)
    full = _full_hash("text")
    hashed = keyed.join(left, _BUCKET, "left").select(
        "id",
        F.monotonically_increasing_id().alias("row"),
        _LENGTH,
        _BUCKET,
        F.coalesce("left", F.lit(False)).alias("left"),
        (full if digest_all else F.when(F.col("left"), full)).alias("full_hash"),
    )
    hashed = stage(hashed, "copy-hashes")
    groups = (
        hashed.filter("left")
        .groupBy(_LENGTH, "full_hash")
        .agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("first"))
        .filter("n > 1")
    )
    return hashed.join(groups, [_LENGTH, "full_hash"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("first.row") == F.col("row"))).alias("kept"),
        "full_hash", F.col(_BUCKET).alias("bucket"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns whatever their names, less those that ``copy_groups`` drops.

    Rows are matched by id and full hash, and only texts that share their length and
    beginning with another are hashed in full.  The dropped ids are broadcast if they are
    few, else joined by shuffling.  Rows equal in id and text are told apart by nothing;
    one of them stays.
    """
    own, row_id, text = hidden(df, id_col, text_col)
    found = copy_groups(own, row_id, text).filter("group_size > 1")
    found = found.groupBy(F.col(row_id).alias("__id"), F.col("full_hash").alias("__full")).agg(
        F.max("kept").alias("kept"), F.count("*").alias("n"), F.max("bucket").alias("bucket")
    )
    found = stage(found, "copies-found")
    dropped, twice = found.filter("NOT kept"), found.filter("kept AND n > 1")
    key = F.col("__id").eqNullSafe(F.col(row_id)) & (F.col("__full") == F.col(_FULL))
    hint = F.broadcast if small_enough(dropped, 64) else (lambda t: t)
    buckets = stage(found.select("bucket").distinct(), "copies-buckets")
    near = F.broadcast(buckets.select(F.col("bucket").alias(_BUCKET), F.lit(True).alias("__near")))
    keyed = _keyed(own, text).join(near, _BUCKET, "left")
    rest = keyed.withColumn(_FULL, F.when(F.col("__near"), _full_hash(text))).join(hint(dropped), key, "left_anti")
    if not twice.isEmpty():
        one = rest.join(twice, key, "left_semi").dropDuplicates([row_id, _FULL])
        rest = rest.join(twice, key, "left_anti").unionByName(one)
    return rest.select(*own.columns).toDF(*df.columns)
