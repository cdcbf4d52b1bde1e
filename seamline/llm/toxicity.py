"""Toxicity by two Kneser-Ney models of words, one of toxic texts and one of ordinary ones.

Both models discount their bigrams and back off to discounted class counts of the word,
and these to the same continuation counts: in how many contexts of either class the word
was seen.  The discounts are alike as rates: the larger class has the larger one, so that
what is rare is discounted in both.  A rare expression thus weighs alike in both unless a class really has it.  A
text's score is a logistic function of the difference of the two log-likelihoods a word,
and of what words that are far likelier in toxic texts add to it, divided by the number of
words and by its root.  It is fitted, and the discount chosen among
``DISCOUNTS``, on labelled rows that the models have not seen.

The models are fitted on a bounded sample: of each class the labelled rows with the
smallest hash, at most ``sample`` rows and ``SAMPLE_BYTES`` of text; a text that does not
fit into what is left of these is passed over.  All n-grams of the sample, those seen
once too, are sent to all tasks; the bytes bound how many these can be.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm import textbuf
from seamline.llm.frames import _quoted, text_column
from seamline.plans.staging import stage

SAMPLE = 12000
SAMPLE_BYTES = 8 << 20  # of each class
DISCOUNTS = (0.5, 1.5, 6)  # of the smaller class
SURPLUS = 2.0  # the log-ratio of a word beyond which it speaks for toxicity by itself
FIT_FIFTHS = 4  # of five parts of the sample; the rest sets the logistic function
_U = np.uint64
_START = _U(0x5EED)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = textbuf.buffers(texts)
    data = textbuf.lower(data)
    starts, ends, counts = textbuf.spans(data, offsets)
    return textbuf.hash_spans(data, starts, ends), counts


def _contexts(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The word before each word; a mark at the beginning of a text."""
    before = np.concatenate([[_START], words[:-1]]) if len(words) else words
    begins = np.cumsum(counts) - counts
    before[begins[counts > 0]] = _START
    return before


def _bigram(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return textbuf.mix(context * _U(0x9E3779B97F4A7C15) ^ word)


def _count(batches):
    """Bigrams of labelled texts with their counts in ordinary and in toxic ones."""
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        words, counts = _words(batch.column(1))
        context = _contexts(words, counts)
        key = _bigram(context, words)
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        of_toxic = np.bincount(place, np.repeat(toxic, counts), len(first)).astype(np.int64)
        n = np.bincount(place, minlength=len(first))
        yield pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (context[first].view(np.int64), words[first].view(np.int64), n - of_toxic, of_toxic)],
            names=["context", "word", "ordinary", "toxic"],
        )


def _column(rows: pa.Table, name: str, kind=float) -> np.ndarray:
    values = rows.column(name).to_numpy()
    return values.view(_U) if kind is _U else values.astype(kind)


@dataclass
class Models:
    """Both models as sorted arrays; in their last dimension 0 is ordinary, 1 toxic.

    Counts travel, probabilities are made where they are used.  Of models that differ in
    their discount the counts are the same arrays.
    """

    words: np.ndarray
    counts: np.ndarray  # of the words
    contexts: np.ndarray  # distinct words before each word, of either class
    total: np.ndarray  # how often each word is a context
    bigrams: np.ndarray
    seen: np.ndarray  # counts of the bigrams
    tokens: np.ndarray
    n_pairs: float
    n_words: float
    discount: np.ndarray
    taken: np.ndarray  # what the discount takes off the bigrams after each word
    mass: np.ndarray  # what it leaves, of one, to the shared counts
    weights: np.ndarray | None = None

    def _shared(self, contexts):
        return self.mass * ((contexts + 0.5) / (self.n_pairs + 0.5 * (self.n_words + 1)))

    def _word(self, at: np.ndarray) -> np.ndarray:
        """Probabilities of words by their place, one beyond the last if unknown."""
        known = at < len(self.words)
        out = np.repeat(self._shared(0.0)[None], len(at), 0)
        own = np.maximum(self.counts[at[known]] - self.discount, 0) / np.maximum(self.tokens, 1)
        out[known] = own + self._shared(self.contexts[at[known], None])
        return out

    def _backoff(self, at: np.ndarray) -> np.ndarray:
        """What is left for the word alone after a word."""
        known = at < len(self.words)
        out = np.ones((len(at), 2))
        total = self.total[at[known]]
        out[known] = np.where(total > 0, self.taken[at[known]] / np.maximum(total, 1), 1.0)
        return out

    @classmethod
    def fit(cls, bigrams: DataFrame) -> list[Models]:
        """From distinct ``bigrams(context, word, ordinary, toxic)``, stored; one for each discount."""
        sides = ("ordinary", "toxic")
        tokens = np.array([float(n or 0) for n in bigrams.agg(*(F.sum(s) for s in sides)).first()])
        larger = np.maximum(tokens, 1) / max(tokens.min(), 1)
        discounts = [d * larger for d in DISCOUNTS]
        taken = lambda side, d: F.sum(F.least(F.col(side), F.lit(float(d))))
        every = [(side, k, d[i]) for k, d in enumerate(discounts) for i, side in enumerate(sides)]
        by_word = bigrams.groupBy("word").agg(*(F.sum(s).alias(s) for s in sides), F.count("*").alias("contexts"))
        by_word = stage(by_word, "toxic-words")
        by_context = bigrams.groupBy(F.col("context").alias("word")).agg(
            *(F.sum(s).alias(f"{s}_n") for s in sides), *(taken(s, d).alias(f"{s}_{k}") for s, k, d in every)
        )
        totals = by_word.agg(F.count("*"), F.sum("contexts"), *(taken(s, d) for s, _, d in every)).first()
        n_words, n_pairs, *masses = (float(v or 0) for v in totals)

        words = by_word.join(by_context, "word", "left").fillna(0).toArrow()
        words = words.take(pa.array(np.argsort(_column(words, "word", _U))))
        pairs = bigrams.select("context", "word", *sides).toArrow()
        key = _bigram(_column(pairs, "context", _U), _column(pairs, "word", _U))
        order = np.argsort(key)
        both = lambda table, *names: np.stack([_column(table, name, np.int32) for name in names], 1)
        alike = (
            _column(words, "word", _U), both(words, *sides), _column(words, "contexts", np.int32),
            both(words, *(f"{s}_n" for s in sides)), key[order], both(pairs, *sides)[order], tokens, n_pairs, n_words,
        )
        found = []
        for k, (d, mass) in enumerate(zip(discounts, np.array(masses).reshape(-1, 2))):
            mass = np.where(tokens > 0, mass / np.maximum(tokens, 1), 1.0)
            found.append(cls(*alike, d, np.stack([_column(words, f"{s}_{k}") for s in sides], 1), mass))
        return found

    def features(self, texts: pa.Array) -> np.ndarray:
        """Of each text: toxic less ordinary log-likelihood a word, and the sum of what
        single words have beyond ``SURPLUS``, a word and a root of a word."""
        words, counts = _words(texts)
        n = np.maximum(counts, 1)
        found = np.zeros((len(counts), 4))
        found[:, 3] = 1
        if not len(words) or not len(self.words):
            return found
        distinct, place = np.unique(words, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
        at = np.where(self.words[at] == distinct, at, len(self.words))
        unigram, backoff, at = self._word(at)[place], self._backoff(at)[place], at[place]
        before = np.concatenate([[len(self.words)], at[:-1]])
        backoff = np.concatenate([np.ones((1, 2)), backoff[:-1]])
        begins = (np.cumsum(counts) - counts)[counts > 0]
        before[begins], backoff[begins] = len(self.words), 1.0
        p = backoff * unigram
        both = np.flatnonzero((at < len(self.words)) & (before < len(self.words)))
        if len(both) and len(self.bigrams):
            key = _bigram(words[both - 1], words[both])
            seen = np.minimum(np.searchsorted(self.bigrams, key), len(self.bigrams) - 1)
            hit = self.bigrams[seen] == key
            both, seen = both[hit], seen[hit]
            p[both] += np.maximum(self.seen[seen] - self.discount, 0) / np.maximum(self.total[before[both]], 1)
        text = textbuf.of_text(counts)
        found[:, 0] = np.bincount(text, np.log(p[:, 1] / p[:, 0]), len(counts)) / n
        surplus = np.maximum(np.log(unigram[:, 1] / unigram[:, 0]) - SURPLUS, 0)
        found[:, 2] = np.bincount(text, surplus, len(counts)) / np.sqrt(n)
        found[:, 1] = found[:, 2] / np.sqrt(n)
        return found

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a slight ridge, by Newton's steps."""
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - y) + 1e-3 * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(weights))
        weights = weights - np.linalg.solve(curve, gradient)
    return weights


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Models:
    """Both models from ``labels(id, toxic)``: rows that are not held out and not null.

    Of an id with several labels the highest counts.  Without labels of a class every
    text scores as that class's share says.
    """
    id_ = F.col(_quoted(id_col))
    given = labels.filter(F.col("toxic").isNotNull() & id_.isNotNull() & ~_held_out(id_))
    given = given.groupBy(id_.alias("id")).agg(F.max("toxic").alias("toxic")).withColumn("hash", F.xxhash64(F.col("id"), F.lit(6)))
    given = stage(given, "toxic-labels")
    shares = dict(given.groupBy("toxic").count().collect())
    chosen = [given.filter(F.col("toxic") == side).orderBy("hash", "id").limit(sample) for side in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # 2 * sample rows at most
    texts = docs.select(id_.alias("id"), F.coalesce(F.col(_quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(_within(texts.join(chosen, "id"))), "id")
    texts = texts.select((F.col("toxic") == 1).alias("toxic"), "text", (F.pmod("hash", F.lit(5)) < FIT_FIFTHS).alias("fits"))
    texts = stage(texts, "toxic-texts")
    counted = texts.filter("fits").select("toxic", "text").mapInArrow(_count, "context long, word long, ordinary long, toxic long")
    counted = counted.groupBy("context", "word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    candidates = Models.fit(stage(counted, "toxic-bigrams"))

    def measure(batches):
        for batch in batches:
            x = np.stack([m.features(batch.column(1)) for m in candidates], 1).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))],
                names=["toxic", "x"],
            )

    rest = texts.filter("NOT fits").select("toxic", "text").mapInArrow(measure, "toxic boolean, x array<double>").collect()
    y = np.array([r.toxic for r in rest], float)  # a fifth of the sample
    x = np.array([r.x for r in rest], float).reshape(len(y), len(candidates), 4)
    best, least = candidates[0], np.inf
    for k, models in enumerate(candidates):
        models.weights = _logistic(x[:, k], y)
        margin = np.clip(x[:, k] @ models.weights, -30, 30)
        loss = float(np.log1p(np.exp(np.where(y > 0, -margin, margin))).sum())
        if loss < least:
            best, least = models, loss
    # The sample may hold the classes in other parts than the labels do.
    taken = [min(shares.get(side, 0), sample) + 1 for side in (0, 1)]
    best.weights[-1] += np.log((shares.get(1, 0) + 1) / (shares.get(0, 0) + 1) * taken[0] / taken[1])
    return best


def _within(texts: DataFrame) -> DataFrame:
    """``id, toxic, hash`` of the texts of each class, by hash, whose bytes fit into the sample."""
    sizes = texts.groupBy("id", "toxic", "hash").agg(F.sum(F.octet_length("text").cast("long")).alias("size"))
    so_far = F.sum("size").over(Window.partitionBy("toxic").orderBy("hash", "id"))  # 2 * sample rows at most
    fitting = sizes.filter(F.col("size") <= SAMPLE_BYTES).withColumn("bytes", so_far)
    return stage(fitting.filter(F.col("bytes") <= SAMPLE_BYTES).select("id", "toxic", "hash"), "toxic-sample")


def _held_out(id_):
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """One row per row of ``docs``: its id, ``held_out``, ``score``, ``predicted``.

    ``score`` is between 0 and 1, for empty and null texts too, which score by the share
    of the classes.  A null id counts as empty.  Repeated rows score alike.  Nothing but
    the text enters a score.  An empty table gives an empty result.
    """
    models = fit(docs, labels, id_col, text_col, sample)
    scored = text_column(lambda texts: {"score": models.score(texts)}, "score double")
    id_ = F.col(_quoted(id_col))
    rows = docs.select(id_.alias(id_col), _held_out(id_).alias("held_out"), scored(F.col(_quoted(text_col)))["score"].alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
