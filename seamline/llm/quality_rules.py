"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document.  The ledger keeps what was measured
and one bit for each rule that failed.  A policy is a versioned set of rules; applying
one, comparing two, or asking what a rule alone rejects reads the bits, not the texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm import textbuf
from seamline.llm.frames import _quoted, hidden, text_column

WINDOW = 5
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, "
    "n_repeat_words long"
)
# A rule's place is its bit; new rules are added at the end so that stored bits stay valid.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("long_words", "word_chars > 100 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("symbols", "n_symbols > n_words"),
    ("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    ("many_words", "n_words > 1000000"),
    ("some_symbols", "10 * n_symbols > n_words"),
    ("short_mean_word", "2 * word_chars < 5 * n_words"),
    ("some_repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines"),
)
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "base": BASE,
    "v1": BASE + ("long_words", "short_words", "symbols"),
    "v2": BASE + ("long_words", "short_words", "symbols", "repeated_lines"),
    "v3": BASE + ("long_words", "some_symbols", "short_mean_word", "some_repeated_lines"),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_CODE_POINT = (np.arange(256) & 0xC0) != 0x80


def mask(policy: str) -> int:
    """The bits of the rules of a policy."""
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def _repeats(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks values found twice or more in their text, and all but one of each."""
    key = textbuf.mix(hashes ^ textbuf.mix(text.astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    found, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    later[order[1:][same]] = True
    return found, later


def measure(texts: pa.Array) -> dict:
    """The measures of each text; a null counts as empty."""
    data, offsets = textbuf.buffers(texts)
    starts, ends, n_words = textbuf.spans(data, offsets)
    in_word = ~textbuf._SPACE[data]
    words = textbuf.hash_spans(data, starts, ends)
    hashes, places, n_windows = textbuf.windows(words, n_words, WINDOW)
    repeated, _ = _repeats(hashes, textbuf.of_text(n_windows))
    covered = np.zeros(len(words) + 1, np.int32)
    covered[places[repeated]] += 1
    covered[places[repeated] + WINDOW] -= 1
    covered = np.cumsum(covered[:-1]) > 0
    first_word = np.concatenate([[0], np.cumsum(n_words)])

    starts, ends, n = textbuf.spans(data, offsets, _NEWLINE)
    total = np.concatenate([[0], np.cumsum(in_word)])
    wordy = total[ends] > total[starts]
    text = textbuf.of_text(n)[wordy]
    _, later = _repeats(textbuf.hash_spans(data, starts[wordy], ends[wordy]), text)
    return {
        "n_words": n_words,
        "word_chars": textbuf.sums(in_word & _CODE_POINT[data], offsets),
        "n_symbols": textbuf.sums(_SYMBOL[data], offsets),
        "n_lines": np.bincount(text, minlength=len(n)),
        "n_dup_lines": np.bincount(text[later], minlength=len(n)),
        "n_repeat_words": textbuf.sums(covered, first_word),
    }


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, the measures, and ``failed_bits``.

    A null or empty text measures 0 everywhere and fails ``few_words``.  Repeated rows
    and repeated ids each keep their own ledger row; a null id stays null.  Columns
    other than the id and the text are not read, whatever their names.  An empty table
    gives an empty ledger.  Texts are measured where they are read: no shuffle.
    """
    rows = df.select(
        F.col(_quoted(id_col)).alias(id_col), text_column(measure, MEASURES)(F.col(_quoted(text_col))).alias("__m")
    )
    return rows.select(_quoted(id_col), "__m.*").withColumn("failed_bits", _failed_bits())


def _failed_bits(measures: str = "") -> Column:
    """The bits of the rules that fail; ``measures`` names the struct that holds the measures."""
    bits = F.lit(0)
    for bit, (_, rule) in enumerate(RULES):
        bits = bits + F.when(F.expr(re.sub(r"\b(?=n_|word_)", measures, rule)), F.lit(1 << bit)).otherwise(0)
    return bits.cast("long")


def keep(df: DataFrame, policy: str, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns whatever their names, that no rule of the policy fails.  No shuffle."""
    own, text = hidden(df, text_col)
    measured = own.withColumn("__m", text_column(measure, MEASURES)(F.col(text)))
    failed = _failed_bits("__m.").bitwiseAND(F.lit(mask(policy)))
    return measured.filter(failed == 0).drop("__m").toDF(*df.columns)


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents it fails, those that no other rule of the
    policy fails, and those kept if the rule were left out.

    Counts each pattern of bits first (at most 2 ** rules rows), so the ledger is read
    once and no row is held for each document and rule.
    """
    patterns = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(
        F.count("*").alias("n")
    )
    names = [name for name, _ in RULES]
    listed = F.array(
        *(
            F.struct(F.lit(rule).alias("rule"), F.lit(1 << names.index(rule)).cast("long").alias("bit"))
            for rule in POLICIES[policy]
        )
    )
    by_rule = patterns.select("bits", "n", F.explode(listed).alias("r")).select("bits", "n", "r.*")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return by_rule.groupBy("rule", "bit").agg(
        count(has).alias("failed"),
        count(alone).alias("failed_alone"),
        count(alone | (F.col("bits") == 0)).alias("kept_without"),
    )


def rule_profile(rows: DataFrame, by: str) -> DataFrame:
    """For each value of a column: rules that failed anywhere, and everywhere."""
    return rows.groupBy(by).agg(
        F.bit_or("failed_bits").alias("failed_somewhere"),
        F.bit_and("failed_bits").alias("failed_everywhere"),
        F.count("*").alias("n"),
    )
