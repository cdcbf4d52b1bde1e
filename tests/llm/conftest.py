"""Small tables with every awkward case the operators define a result for."""

import random
import re

import pytest

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return (text or "").translate(LOWER)


def awkward_rows():
    """Nulls in every column, empty, very long and equal texts, repeated rows and ids."""
    rnd = random.Random(7)
    pool = [f"w{n}" for n in range(400)]
    text = lambda n: " ".join(rnd.choice(pool) for _ in range(n))
    base = text(200)
    near = base.split(" ")
    near[50] = "other"
    long = text(3000) + " " + "x" * 5000
    rows = [
        (1, None, None, None, None), (2, "", "en", "", 0), (3, " \n\t ", "en", "a", 4),
        (4, base, "en", "a", 1), (5, base.upper(), "en", "b", 1), (6, " ".join(near), "en", "b", 1),
        (7, base, "en", None, 1), (7, base, "en", None, 1), (7, text(30), "en", "a", 1),
        (None, text(40), "en", "a", 1), (None, base, "en", "c", 1), (8, long, "fr", "c", 1),
        (9, "one two", "en", "a", 1), (10, "One  two", "en", "a", 1), (11, "one two three", "en", "a", 1),
        (12, "a b c d e f g a b c d e\nsame line\nsame line\n\nsame line #$|", "en", "é", 1),
        (13, "naïve café 日本語 🙂 <|endoftext|> it's 12,345.67  end", "fr", "é", 1),
    ]
    rows += [(n, text(rnd.randint(5, 120)), "en", rnd.choice("abc"), 1) for n in range(20, 60)]
    rows += [(n, base + " " + text(3), "en", "a", 1) for n in range(60, 100)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(awkward):
    """Extra columns whose names an operator may want for itself."""
    from pyspark.sql import functions as F

    names = ("id key n kept size hash taken target bucket unit row n_words n_tokens failed_bits tokens "
             "keep_id group_size component_id n_shingles score held_out slot shard full_hash "
             "__m __copy_full __copy_bucket __mix __mix_key __mix_copy __key __row_key __slot own0 own3").split()
    return awkward.withColumns({name: F.lit("extra") for name in names})


def plain(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
