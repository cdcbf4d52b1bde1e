"""Scores of texts under a hidden Markov language model.

Words are lower-cased; a text ends in an end token.  The model has ``STATES`` states.
A state emits a symbol: one of the most frequent words (those of at least one in
``SYMBOLS`` tokens, so at most that many), a class of words by their last letters, or the
end.  A word of a class has its smoothed share of the class's count, so that the states
describe a bounded table while every word's count is used.  Baum-Welch: each pass runs
the scaled forward and backward recursions over all training texts, sums the expected
counts over partitions, and re-estimates.  The forward recursion gives the likelihood of
a whole text; long texts are cut into stretches whose transfer matrices are multiplied,
which changes nothing but the order of the products.

Word counts are summed by hash ranges.  Words of at least one in ``FREQUENT`` tokens are
sent to all tasks (12 MB at most, whatever the input); the counts of the rest are looked
up by sending the words, packed, to the range that holds their counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm import textbuf
from seamline.llm.frames import _quoted
from seamline.llm.packed import pack, range_cuts, unpack
from seamline.plans.staging import shared_dir, stage

STATES = 8
PASSES = 4
SYMBOLS = 8192
CLASSES = 4096
FREQUENT = 1 << 20
PRIOR = 500.0  # tokens of the overall distribution that each state is given
UNIT_TOKENS = 1 << 20
UNIT_DOCS = 1 << 16
STRETCH = 1024
CHUNK = 1 << 18
BUCKETS_PER_PARTITION = 4
_END = SYMBOLS + CLASSES
_N_SYMBOLS = _END + 1
_U = np.uint64
_CLASS = _U(CLASSES - 1)
_ROWS = "bucket long, unit long, kind int, n long, data binary, more binary"
_DOCS, _SYMBOL, _RARE, _VOCAB = 0, 1, 2, 3
_DOC = "unit long, place long, id long"


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word whose low bits are its class, and each text's word count."""
    data, offsets = textbuf.buffers(texts)
    data = textbuf.lower(data)
    starts, ends, counts = textbuf.spans(data, offsets)
    last = np.zeros(len(ends), _U)
    for k in range(1, 4):
        at = ends - k
        letter = np.where(at >= starts, data[np.maximum(at, 0)] if len(data) else 0, 0)
        last |= letter.astype(_U) << _U(8 * (k - 1))
    return textbuf.hash_spans(data, starts, ends) & ~_CLASS | textbuf.mix(last + _U(1)) & _CLASS, counts


def _units(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, ids, held-out marks, word counts and words of a few million words at a time."""
    unit = TaskContext.get().partitionId() << 24
    held: list[tuple] = []
    words = docs = 0
    for batch in batches:
        for piece in textbuf.slices(batch, "text"):
            for start in range(0, piece.num_rows, UNIT_DOCS):
                part = piece.slice(start, UNIT_DOCS)
                keys, counts = word_keys(part.column(2))
                if held and (words + len(keys) > UNIT_TOKENS or docs + len(counts) > UNIT_DOCS):
                    yield unit, *(np.concatenate(c) for c in zip(*held))
                    unit, held, words, docs = unit + 1, [], 0, 0
                ids = part.column(0).to_numpy(zero_copy_only=False)
                held.append((ids, part.column(1).to_numpy(zero_copy_only=False), counts, keys))
                words, docs = words + len(keys), docs + len(counts)
    if held:
        yield unit, *(np.concatenate(c) for c in zip(*held))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    names = ["bucket", "unit", "kind", "n", "data", "more"]
    columns = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _count_units(buckets: int):
    """Training words of each unit with their counts, by hash range; and their totals."""

    def run(batches):
        for unit, _, held_out, counts, keys in _units(batches):
            train = ~held_out.astype(bool)
            words, n = np.unique(keys[np.repeat(train, counts)], return_counts=True)
            cuts = range_cuts(words, buckets)
            rows = [
                (b, unit, _VOCAB, int(cuts[b + 1] - cuts[b]), pack(words[cuts[b] : cuts[b + 1]]),
                 n[cuts[b] : cuts[b + 1]].astype("<i8").tobytes())
                for b in np.flatnonzero(np.diff(cuts)).tolist()
            ]
            ends = np.array([train.sum()], "<i8").tobytes()
            yield _batch([*rows, (unit % buckets, unit, _DOCS, 0, b"", ends)])

    return run


def _sum_range(table: pa.Table) -> pa.Table:
    """One row of all words of a range with their counts; ends are passed on."""
    words, counts, ends, bucket = [], [], 0, 0
    for b, kind, n, data, more in zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "n", "data", "more"))):
        bucket = b
        if kind == _DOCS:
            ends += int(np.frombuffer(more, "<i8")[0])
        else:
            words.append(unpack(data, n))
            counts.append(np.frombuffer(more, "<i8"))
    every, place = np.unique(np.concatenate([np.zeros(0, _U), *words]), return_inverse=True)
    total = np.bincount(place, np.concatenate([np.zeros(0), *counts]), len(every)).astype("<i8")
    return pa.Table.from_batches([_batch([(bucket, ends, _VOCAB, len(every), pack(every), total.tobytes())])])


def vocabulary(texts: DataFrame) -> DataFrame:
    """Counts of the training words of ``texts(id, held_out, text)``, a row for each hash range.

    ``unit`` of a row holds the number of training texts seen there.  Stored.
    """
    buckets = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_PER_PARTITION
    packed = texts.mapInArrow(_count_units(buckets), _ROWS)
    return stage(packed.groupBy("bucket").applyInArrow(_sum_range, _ROWS), "hmm-words"), buckets


class Counts:
    """Totals of the vocabulary, and its frequent words; of bounded size."""

    def __init__(self, vocab: DataFrame):
        def by_class(batches):
            for batch in batches:
                n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
                for size, data, more in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5))):
                    kind = (unpack(data, size) & _CLASS).astype(np.int64)
                    n += np.bincount(kind, np.frombuffer(more, "<i8"), CLASSES).astype(np.int64)
                    v += np.bincount(kind, minlength=CLASSES)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(v)], names=["c", "n", "v"])

        classes = vocab.mapInArrow(by_class, "c long, n long, v long").groupBy("c").agg(F.sum("n"), F.sum("v"))
        self.class_tokens, self.class_words = np.zeros(CLASSES), np.zeros(CLASSES)
        for c, n, v in classes.collect():  # CLASSES rows
            self.class_tokens[c], self.class_words[c] = n, v
        self.ends = vocab.agg(F.sum("unit")).first()[0] or 0
        self.tokens = int(self.class_tokens.sum()) + self.ends
        self.distinct = int(self.class_words.sum()) + (self.ends > 0)
        least = max(1, -(-self.tokens // FREQUENT))

        def frequent(batches):
            for batch in batches:
                rows = []
                for size, data, more in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5))):
                    n = np.frombuffer(more, "<i8")
                    words = unpack(data, size)[n >= least]
                    rows.append((0, 0, _VOCAB, len(words), pack(words), n[n >= least].tobytes()))
                yield _batch(rows)

        found = vocab.mapInArrow(frequent, _ROWS).select("n", "data", "more").collect()  # FREQUENT words at most
        self.words = np.concatenate([np.zeros(0, _U), *(unpack(bytes(r.data), r.n) for r in found)])
        self.counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r.more, "<i8") for r in found)])
        order = np.argsort(self.words)
        self.words, self.counts = self.words[order], self.counts[order]
        # Words with a symbol of their own leave their class.
        own = self.counts >= max(1, -(-self.tokens // SYMBOLS))
        self.symbol = np.where(own, np.cumsum(own) - 1, SYMBOLS + (self.words & _CLASS).astype(np.int64))
        self.n_own = int(own.sum())
        kind = (self.words[own] & _CLASS).astype(np.int64)
        self.class_tokens -= np.bincount(kind, self.counts[own], CLASSES)
        self.class_words -= np.bincount(kind, minlength=CLASSES)
        self.class_weight = self.class_tokens + 0.1 * (self.class_words + 1)
        weight = np.zeros(_N_SYMBOLS)
        weight[: self.n_own] = self.counts[own] + 0.1
        weight[SYMBOLS:_END] = self.class_weight
        weight[_END] = self.ends + 0.1
        self.overall = weight / weight.sum()

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    def inside(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log share of words without their own symbol in their classes."""
        return np.log10((counts + 0.1) / self.class_weight[(words & _CLASS).astype(np.int64)])


def _look_up(counts: Counts, buckets: int):
    """Per unit: its texts with what frequent words give, its symbols, its rare words."""

    def run(batches):
        for unit, ids, held_out, n_words, keys in _units(batches):
            n_docs = len(n_words)
            doc = np.repeat(np.arange(n_docs), n_words)
            words, place = np.unique(keys, return_inverse=True)
            at = np.minimum(np.searchsorted(counts.words, words), max(len(counts.words) - 1, 0))
            frequent = counts.words[at] == words if len(counts.words) else np.zeros(len(words), bool)
            base, inside, symbol = np.zeros(len(words)), np.zeros(len(words)), SYMBOLS + (words & _CLASS).astype(np.int64)
            base[frequent] = counts.base(counts.counts[at[frequent]])
            symbol[frequent] = counts.symbol[at[frequent]]
            shared = frequent & (symbol >= SYMBOLS)
            inside[shared] = counts.inside(words[shared], counts.counts[at[shared]])
            known = frequent[place]
            docs = np.stack([
                np.bincount(doc, base[place], n_docs), np.bincount(doc, inside[place], n_docs),
                np.bincount(doc, known, n_docs), n_words.astype(float), held_out.astype(float),
            ])
            symbols = symbol[place].astype("<u2")
            stops = np.cumsum(n_words) + np.arange(n_docs)  # places of the end tokens
            whole = np.full(len(symbols) + n_docs, _END, "<u2")
            inner = np.ones(len(whole), bool)
            inner[stops] = False
            whole[inner] = symbols
            head = np.concatenate([n_words + 1, held_out.astype(np.int64)]).astype("<i8").tobytes()
            has_id = np.array([i is not None and i == i for i in ids.tolist()], bool)
            plain = np.where(has_id, ids, 0).astype("<i8")
            rows = [
                (0, unit, _DOCS, n_docs, docs.tobytes(), plain.tobytes() + has_id.tobytes()),
                (0, unit, _SYMBOL, n_docs, whole.tobytes(), head),
            ]
            # Rare words: each with its texts and how often it is in them.
            pair, times = np.unique(place[~known] * n_docs + doc[~known], return_counts=True)
            rare, first = np.unique(pair // max(n_docs, 1), return_index=True)
            runs = np.diff(np.append(first, len(pair)))
            cuts = range_cuts(words[rare], buckets)
            in_text = (pair % max(n_docs, 1)).astype("<u2")
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[b], cuts[b + 1])
                entry = slice(first[cuts[b]], first[cuts[b + 1] - 1] + runs[cuts[b + 1] - 1])
                more = runs[part].astype("<u4").tobytes() + times[entry].astype("<u4").tobytes() + in_text[entry].tobytes()
                rows.append((b, unit, _RARE, int(cuts[b + 1] - cuts[b]), pack(words[rare[part]]), more))
            yield _batch(rows)

    return run


def _rare_sums(counts: Counts):
    """The counts of rare words, summed for each text of a unit."""
    base_of, inside_of = counts.base, counts.inside

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("unit", "kind", "n", "data", "more"))))
        words = known = None
        for _, kind, n, data, more in rows:
            if kind == _VOCAB:
                words, known = unpack(data, n), np.frombuffer(more, "<i8")
        out = []
        for unit, kind, n, data, more in rows:
            if kind != _RARE:
                continue
            mine = unpack(data, n)
            c = np.zeros(n, np.int64)
            if words is not None and len(words):
                at = np.minimum(np.searchsorted(words, mine), len(words) - 1)
                c = np.where(words[at] == mine, known[at], 0)
            runs = np.frombuffer(more, "<u4", n).astype(np.int64)
            total = int(runs.sum())
            times = np.frombuffer(more, "<u4", total, 4 * n).astype(float)
            text = np.frombuffer(more, "<u2", total, 4 * n + 4 * total).astype(np.int64)
            texts, place = np.unique(text, return_inverse=True)
            sums = [
                np.bincount(place, times * np.repeat(v, runs), len(texts)).astype("<f8").tobytes()
                for v in (base_of(c), inside_of(mine, c), (c > 0).astype(float))
            ]
            out.append((0, unit, _RARE, len(texts), texts.astype("<u2").tobytes(), b"".join(sums)))
        return pa.Table.from_batches([_batch(out)])

    return run


_TEXT_SUMS = "unit long, place long, id long, n_words long, held_out boolean, base double, inside double, n_known long"


def _unit_sums(table: pa.Table) -> pa.Table:
    """One row for each text of a unit: sums over all its words."""
    sums, unit = None, 0
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "unit", "n", "data", "more"))), key=lambda r: r[0])
    for kind, unit, n, data, more in rows:
        if kind == _DOCS:
            sums = np.frombuffer(data, float).reshape(5, n).copy()
            ids = np.frombuffer(more, "<i8", n)
            has_id = np.frombuffer(more, bool, n, 8 * n)
        else:
            at = np.frombuffer(data, "<u2")
            sums[:3, at] += np.frombuffer(more, "<f8").reshape(3, n)
    n = sums.shape[1]
    return pa.table({
        "unit": np.full(n, unit), "place": np.arange(n), "id": pa.array(ids, mask=~has_id),
        "n_words": sums[3].astype(np.int64), "held_out": sums[4] > 0, "base": sums[0], "inside": sums[1],
        "n_known": np.rint(sums[2]).astype(np.int64),
    })


class Model:
    """Initial, transition and emission probabilities."""

    def __init__(self, initial: np.ndarray, transition: np.ndarray, emission: np.ndarray):
        self.initial, self.transition, self.emission = initial, transition, emission

    @classmethod
    def start(cls, overall: np.ndarray) -> Model:
        """States that stay, with the overall emissions disturbed at random, always alike."""
        noise = np.exp(np.random.default_rng(1).normal(size=(len(overall), STATES)))
        noise[overall.argmax()] = 1.0
        emission = overall[:, None] * noise
        transition = np.full((STATES, STATES), 0.05 / (STATES - 1))
        np.fill_diagonal(transition, 0.95)
        return cls(np.full(STATES, 1 / STATES), transition, emission / emission.sum(0))

    @classmethod
    def estimate(cls, sums: np.ndarray, overall: np.ndarray) -> Model:
        """From expected counts: symbols, then transitions, then initial states."""
        emission = sums[:_N_SYMBOLS] + PRIOR * overall[:, None]
        transition = sums[_N_SYMBOLS : _N_SYMBOLS + STATES] + 1.0 / STATES
        initial = sums[_N_SYMBOLS + STATES] + 1.0 / STATES
        return cls(initial / initial.sum(), transition / transition.sum(1, keepdims=True), emission / emission.sum(0))

    def stretches(self, symbols: np.ndarray, lengths: np.ndarray) -> Stretches:
        return Stretches(self, symbols, lengths)


class Stretches:
    """The forward and backward recursions over some texts, side by side.

    Texts are cut into stretches of at most ``STRETCH`` symbols.  A first sweep
    multiplies the transfer matrices of all stretches but the first of each text; with
    these the states at the borders follow, and all stretches run at once.
    """

    def __init__(self, model: Model, symbols: np.ndarray, lengths: np.ndarray):
        self.m = model
        pieces = -(-lengths // STRETCH)
        self.text = np.repeat(np.arange(len(lengths)), pieces)
        number = np.arange(len(self.text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(lengths) - lengths, pieces) + number * STRETCH
        length = np.minimum(np.repeat(lengths, pieces) - number * STRETCH, STRETCH)
        order = np.argsort(-length, kind="stable")
        self.text, self.number, self.length = self.text[order], number[order], length[order]
        self.n_texts = len(lengths)
        self.active = np.searchsorted(-self.length, -np.arange(self.length[0]), side="left") if len(order) else np.zeros(0, int)
        # Symbols in the order of the steps: all first ones, all second ones, ...
        starts = start[order]
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        self.symbols = symbols[np.concatenate([starts[:n] + t for t, n in enumerate(self.active)])] if len(order) else symbols[:0]
        self.b = model.emission[self.symbols]
        # Stretches of the same text, one after the other.
        by_place = np.lexsort((self.number, self.text))
        follows = self.text[by_place][1:] == self.text[by_place][:-1]
        self.links = list(zip(by_place[:-1][follows].tolist(), by_place[1:][follows].tolist()))
        self.enter = np.tile(model.initial, (len(order), 1))
        self.leave = np.ones((len(order), STATES))
        self.before = np.zeros((len(order), STATES))
        if self.links:
            self._transfer()

    def _step(self, t: int) -> slice:
        return slice(self.at[t], self.at[t + 1])

    def _transfer(self) -> None:
        later = np.flatnonzero(self.number > 0)
        products = np.empty((len(later), STATES, STATES))
        place = np.full(len(self.number), -1)
        place[later] = np.arange(len(later))
        active = np.searchsorted(later, self.active)  # later ones among the first n
        now = products
        now[:] = np.eye(STATES)
        for t in range(len(self.active)):
            n = active[t]
            if not n:
                break
            moved = (now[:n] @ self.m.transition) * self.b[self.at[t] + later[:n]][:, None, :]
            now[:n] = moved / moved.sum((1, 2), keepdims=True)
        # Forward over the borders needs the first stretch's own end.
        first = {a for a, _ in self.links if self.number[a] == 0}
        ends = self._forward_ends(np.array(sorted(first)))
        for a, b in self.links:
            self.before[b] = ends[a]
            self.enter[b] = ends[a] @ self.m.transition
            end = ends[a] @ products[place[b]]
            ends[b] = end / end.sum()
        for a, b in reversed(self.links):
            back = products[place[b]] @ self.leave[b]
            self.leave[a] = back / (ends[a] @ back)

    def _forward_ends(self, chosen: np.ndarray) -> dict[int, np.ndarray]:
        """States at the end of some first stretches, all of full length."""
        state = np.tile(self.m.initial, (len(chosen), 1))
        for t in range(STRETCH):
            if t:
                state = state @ self.m.transition
            state = state * self.b[self.at[t] + chosen]
            state /= state.sum(1, keepdims=True)
        return dict(zip(chosen.tolist(), state))

    def forward(self) -> np.ndarray:
        """Natural log-likelihood of each text; keeps the scaled states."""
        self.alpha, self.scale = np.empty_like(self.b), np.empty(len(self.b))
        state = self.enter
        for t, n in enumerate(self.active):
            part = self._step(t)
            state = (state[:n] @ self.m.transition if t else state) * self.b[part]
            total = state.sum(1)
            state = state / total[:, None]
            self.alpha[part], self.scale[part] = state, total
        which = np.concatenate([self.text[:n] for n in self.active]) if len(self.active) else self.text
        return np.bincount(which, np.log(self.scale), self.n_texts)

    def expected(self) -> np.ndarray:
        """Expected counts of symbols, transitions and initial states, by state."""
        sums = np.zeros((_N_SYMBOLS + STATES + 1, STATES))
        beta = np.empty_like(self.b)
        moves = np.zeros((STATES, STATES))
        ahead = None  # b * beta / scale of the step after
        for t in range(len(self.active) - 1, -1, -1):
            part, n = self._step(t), self.active[t]
            state = self.leave[:n].copy()
            if ahead is not None and len(ahead):
                state[: len(ahead)] = ahead @ self.m.transition.T
                moves += self.alpha[part][: len(ahead)].T @ ahead
            beta[part] = state
            ahead = self.b[part] * state / self.scale[part][:, None]
        gamma = self.alpha * beta
        if len(self.active):
            moves += self.before.T @ (ahead * (self.number > 0)[:, None])
            sums[_N_SYMBOLS + STATES] = gamma[: self.active[0]][self.number == 0].sum(0)
        for k in range(STATES):
            sums[:_N_SYMBOLS, k] = np.bincount(self.symbols, gamma[:, k], _N_SYMBOLS)
        sums[_N_SYMBOLS : _N_SYMBOLS + STATES] = moves * self.m.transition
        return sums


def _chunks(symbols: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> Iterator[tuple]:
    """Chosen texts, some hundred thousand symbols at a time."""
    starts = np.cumsum(lengths) - lengths
    chosen = np.flatnonzero(chosen)
    ends = np.cumsum(lengths[chosen])
    k = 0
    while k < len(chosen):
        base = ends[k] - lengths[chosen[k]]
        stop = max(int(np.searchsorted(ends, base + CHUNK, side="right")), k + 1)
        part = chosen[k:stop]
        yield part, np.concatenate([symbols[starts[i] : starts[i] + lengths[i]] for i in part]), lengths[part]
        k = stop


def _symbols_of(batch: pa.RecordBatch, row: int) -> tuple:
    unit, n = batch.column("unit")[row].as_py(), batch.column("n")[row].as_py()
    head = np.frombuffer(batch.column("more")[row].as_py(), "<i8").reshape(2, n)
    return unit, np.frombuffer(batch.column("data")[row].as_py(), "<u2"), head[0], head[1] > 0


def _expectation(model: Model):
    def run(batches):
        sums = np.zeros((_N_SYMBOLS + STATES + 1, STATES))
        for batch in batches:
            for row in range(batch.num_rows):
                _, symbols, lengths, held_out = _symbols_of(batch, row)
                for _, part, of in _chunks(symbols, lengths, ~held_out):
                    run_ = model.stretches(part, of)
                    run_.forward()
                    sums += run_.expected()
        some = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), *(pa.array(sums[some, k]) for k in range(STATES))],
            names=["row", *(f"s{k}" for k in range(STATES))],
        )

    return run


def train(symbols: DataFrame, counts: Counts, passes: int = PASSES) -> Model:
    """Baum-Welch over all training texts of the stored units.

    A task sends one row for each symbol, Spark sums them by symbol, and the driver gets
    the table of the model, whose size does not depend on the input.
    """
    model = Model.start(counts.overall)
    columns = [f"s{k}" for k in range(STATES)]
    for _ in range(passes):
        found = symbols.mapInArrow(_expectation(model), "row long, " + ", ".join(f"{c} double" for c in columns))
        sums = np.zeros((_N_SYMBOLS + STATES + 1, STATES))
        for row in found.groupBy("row").agg(*(F.sum(c) for c in columns)).collect():
            sums[row[0]] = row[1:]
        model = Model.estimate(sums, counts.overall)
    return model


def _likelihoods(model: Model):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                unit, symbols, lengths, _ = _symbols_of(batch, row)
                found = np.zeros(len(lengths))
                for texts, part, of in _chunks(symbols, lengths, np.ones(len(lengths), bool)):
                    found[texts] = model.stretches(part, of).forward()
                places = np.arange(len(lengths))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(lengths), unit)), pa.array(places), pa.array(found / np.log(10))],
                    names=["unit", "place", "hidden"],
                )

    return run


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", passes: int = PASSES) -> DataFrame:
    """One row per row of ``df``: its id, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` and ``score``, base 10.

    The id is a number.  The model learns from the rows whose crc32 of the id, as text,
    is not divisible by ten; a null id counts as empty and is held out.  A null or empty
    text is an end token only.  Repeated rows are scored alike and counted each.  A word
    not seen in training has the share that its class, or the base, keeps for one.  An
    empty table gives an empty result; without training rows the model is the overall
    distribution of nothing, and scores are finite.  Other columns are not read.
    """
    spark = df.sparkSession
    id_ = F.col(_quoted(id_col)).cast("long")
    code = F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary"))
    texts = df.select(
        id_.alias("id"), (F.pmod(code, F.lit(10)) == 0).alias("held_out"),
        F.coalesce(F.col(_quoted(text_col)).cast("string"), F.lit("")).alias("text"),
    )
    vocab, buckets = vocabulary(texts)
    counts = Counts(vocab)
    path = f"{shared_dir(spark)}/hmm-units-{uuid.uuid4().hex}"
    texts.mapInArrow(_look_up(counts, buckets), _ROWS).write.partitionBy("kind").parquet(path)
    kinds = ", ".join(c for c in _ROWS.split(", "))
    units = lambda kind: spark.read.schema(kinds).parquet(path).filter(F.col("kind") == kind).select(
        "bucket", "unit", "kind", "n", "data", "more"
    )
    rare = units(_RARE).unionByName(vocab).groupBy("bucket").applyInArrow(_rare_sums(counts), _ROWS)
    sums = rare.unionByName(units(_DOCS)).groupBy("unit").applyInArrow(_unit_sums, _TEXT_SUMS)
    model = train(units(_SYMBOL), counts, passes)
    hidden = units(_SYMBOL).mapInArrow(_likelihoods(model), "unit long, place long, hidden double")
    end = float(counts.base(np.array([counts.ends]))[0])
    return sums.join(hidden, ["unit", "place"]).select(
        F.col("id").alias(id_col),
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + int(counts.ends > 0)).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(end)).alias("base_score"),
        (F.col("hidden") + F.col("inside")).alias("score"),
    )
