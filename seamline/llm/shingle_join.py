"""Documents linked by the Jaccard similarity of their word shingles, exactly.

A document is the set of its distinct runs of five words, as 48-bit hashes.  (Two
given documents of 1,000 shingles share a hash by chance with probability 4e-9.)  Two
link when the intersection is at least ``percent`` hundredths of the union.  The order
of shingles is by how many documents have them, rarest first.

* **Rare shingles, singles.**  Linked documents share at least ``percent`` of the larger
  set, so the first shingle they share stands among the first n - ceil(percent * n) + 1
  of both.  Those of them in 2 to ``RARE`` documents are signatures.
* **Frequent shingles, pairs.**  If that first shared shingle is frequent, so are all
  they share.  Then a document has at least ``percent`` frequent shingles, and its
  prefix is extended over all of them: each shingle that only one of the two has parts
  at most one pair of neighbours, so of neighbouring pairs in the order they share at
  least 3 s - 1 - f1 - f2, with s shingles shared of f1 and f2 frequent ones.  Of the
  pairs in the order of their hashes, those that must hold a shared one are signatures.

Documents that share a signature are candidates and are verified on the whole sets.
Families of many copies are never expanded into all pairs: members of a signature are
verified against one of them first; only members of different components that are left
are compared with each other, after a bound on how much they differ: a bitmap keeps the
parity of the hashes in each place, so that common shingles cancel out.

How the sets move.  A task sorts the shingles of a few million words and sends them in
hash ranges, packed (6 bytes each).  What is in one document only stays there; the rest
goes back, with its frequency, to the unit it came from.  A shingle that many documents
of a unit have is sent once with a count.  So no group grows with a hot shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm import textbuf
from seamline.llm.components import components
from seamline.llm.frames import _quoted, hidden, small_enough
from seamline.llm.packed import pack, range_cuts, unpack
from seamline.plans.staging import stage

WORDS = 5
PERCENT = 75
RARE = 32
UNIT_TOKENS = 1 << 20  # shingles in a unit, of 8 bytes
UNIT_DOCS = 1 << 16  # a document's number in its unit has 16 bits
LOCAL = 64  # documents of a unit; a shingle in more is sent as a count
BUCKETS_PER_PARTITION = 8
PIVOT_ROUNDS = 1
SKETCH_LONGS = 16
_U = np.uint64
_DOC = _U(16)

_PACKED = "bucket long, unit long, kind int, n int, data binary"
_SHARED = "unit long, kind int, n int, data binary, more binary"
_ANALYSED = (
    "key long, n long, set_a long, set_b long, mean_df double, sigs array<long>, "
    "shared array<long>, sketch array<long>"
)
# kinds of packed rows
_KEYS, _COUNTS, _DOCS, _MANY = 0, 1, 2, 3


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values hash << 16 | number of the text, and each text's count."""
    data, offsets = textbuf.buffers(texts)
    data = textbuf.lower(data)
    starts, ends, counts = textbuf.spans(data, offsets)
    words = textbuf.hash_spans(data, starts, ends)
    hashes, _, n = textbuf.windows(words, counts, WORDS)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    hashes = np.concatenate([hashes, textbuf.short_sequences(words, counts, WORDS)[short]])
    docs = np.concatenate([textbuf.of_text(n), short]).astype(_U)
    keys = np.sort((hashes >> _DOC) << _DOC | docs)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    sizes = np.bincount((keys & _U(0xFFFF)).astype(np.int64), minlength=len(texts))
    return keys, sizes


def _set_hash(keys: np.ndarray, n_docs: int) -> list[np.ndarray]:
    """Two sums over each document's hashes that tell sets apart."""
    docs = (keys & _U(0xFFFF)).astype(np.int64)
    order = np.argsort(docs, kind="stable")
    ends = np.cumsum(np.bincount(docs, minlength=n_docs))
    found = []
    for salt in (_U(0x1234567), _U(0x89ABCDE)):
        total = np.zeros(len(keys) + 1, _U)
        np.cumsum(textbuf.mix((keys[order] >> _DOC) * _U(0x9E3779B97F4A7C15) + salt), out=total[1:])
        found.append((total[ends] - total[np.concatenate([[0], ends[:-1]])]).view(np.int64))
    return found


def _unit_rows(unit: int, keys: np.ndarray, row_keys: np.ndarray, sizes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """What a unit sends: its documents, and its shingles by hash range."""
    rows: list[tuple] = []
    set_a, set_b = _set_hash(keys, len(sizes))
    docs = np.stack([row_keys, sizes.astype(np.int64), set_a, set_b])
    rows.append((buckets + unit % buckets, unit, _DOCS, len(sizes), docs.tobytes()))
    token = keys >> _DOC
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(keys) else np.zeros(0, np.int64)
    run = np.diff(np.append(first, len(keys)))
    many = run > LOCAL
    if many.any():
        is_many = np.repeat(many, run)
        rows.append((buckets + unit % buckets, unit, _MANY, int(is_many.sum()), pack(keys[is_many])))
        counted = token[first[many]], run[many].astype(np.int64)
        keys = keys[~is_many]
    cuts = range_cuts(keys >> _DOC, buckets, 48)
    for bucket in np.flatnonzero(np.diff(cuts)):
        part = keys[cuts[bucket] : cuts[bucket + 1]]
        rows.append((int(bucket), unit, _KEYS, len(part), pack(part)))
    if many.any():
        cuts = range_cuts(counted[0], buckets, 48)
        for bucket in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[bucket], cuts[bucket + 1])
            data = counted[0][part].tobytes() + counted[1][part].tobytes()
            rows.append((int(bucket), unit, _COUNTS, len(counted[0][part]), data))
    names = ("bucket", "unit", "kind", "n", "data")
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), types)], names=list(names)
    )


def _units(buckets: int):
    """Turns batches of ``key, text`` into packed rows of units."""

    def run(batches):
        unit = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        tokens = docs = 0
        for batch in batches:
            for part in textbuf.slices(batch, "text"):
                for start in range(0, part.num_rows, UNIT_DOCS):
                    piece = part.slice(start, UNIT_DOCS)
                    keys, sizes = shingles(piece.column(1))
                    if held and (tokens + len(keys) > UNIT_TOKENS or docs + len(sizes) > UNIT_DOCS):
                        yield _unit(unit, held, buckets)
                        unit, held, tokens, docs = unit + 1, [], 0, 0
                    held.append((keys + _U(docs), piece.column(0).to_numpy(zero_copy_only=False), sizes))
                    tokens, docs = tokens + len(keys), docs + len(sizes)
        if held:
            yield _unit(unit, held, buckets)
        held = []
        textbuf.release()

    return run


def _unit(unit: int, held: list[tuple], buckets: int) -> pa.RecordBatch:
    keys = np.sort(np.concatenate([k for k, _, _ in held]))
    row_keys = np.concatenate([r for _, r, _ in held]).astype(np.int64)
    return _unit_rows(unit, keys, row_keys, np.concatenate([s for _, _, s in held]), buckets)


def _count_range(table: pa.Table) -> pa.Table:
    """Shingles of one hash range that are in more than one document, by unit."""
    out: list[tuple] = []
    rows = [r for r in zip(*(table.column(c).to_pylist() for c in ("unit", "kind", "n", "data")))]
    tokens, counts = [], []
    for unit, kind, n, data in rows:
        if kind == _KEYS:
            tokens.append(unpack(data, n) >> _DOC)
            counts.append(np.ones(n, np.int64))
        elif kind == _COUNTS:
            tokens.append(np.frombuffer(data, _U, n))
            counts.append(np.frombuffer(data, np.int64, n, 8 * n))
        else:
            out.append((unit, kind, n, data, b""))
    if tokens:
        every = np.concatenate(tokens)
        order = np.argsort(every)
        ordered = every[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        df = np.add.reduceat(np.concatenate(counts)[order], first)
        frequency = np.empty(len(every), np.int64)
        frequency[order] = np.repeat(df, np.diff(np.append(first, len(every))))
        at = 0
        for unit, kind, n, data in rows:
            if kind not in (_KEYS, _COUNTS):
                continue
            df = frequency[at : at + n]
            at += n
            shared = df > 1
            if not shared.any():
                continue
            values = unpack(data, n) if kind == _KEYS else np.frombuffer(data, _U, n)
            more = np.minimum(df[shared], 0xFFFFFFFF).astype("<u4").tobytes()
            out.append((unit, kind, int(shared.sum()), pack(values[shared]), more))
    textbuf.release()
    columns = list(zip(*out)) if out else [()] * 5
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.Table.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], names=["unit", "kind", "n", "data", "more"]
    )


def signatures(n: int, tokens: np.ndarray, df: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set of ``n`` shingles, of which ``tokens`` are shared, with ``df``.

    ``tokens`` come in the order by frequency, then value.
    """
    least = -(-percent * n // 100)
    if len(tokens) < least:
        return np.zeros(0, _U)
    frequent = df > RARE
    prefix = n - least + 1 - (n - len(tokens))
    singles = textbuf.mix(tokens[:prefix][~frequent[:prefix]] * _U(3) + _U(1))
    often = tokens[frequent]
    if len(often) < max(least, 2):
        return singles
    pairs = np.sort(textbuf.mix(often[:-1] * _U(0xD6E8FEB86659FD93) + textbuf.mix(often[1:] + _U(7))))
    # 3 s - 1 - f1 - f2 with s >= p / (1 + p) * (n1 + n2), f2 <= n2 and n2 >= p * n1
    p = percent / 100
    shared = 3 * p / (1 + p) * (1 + p) * n - p * n - 1 - len(often)
    needed = max(1, int(np.ceil(shared - 1e-9)))
    return np.concatenate([singles, pairs[: len(pairs) - needed + 1]])


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the number of shingles in each of 64 * SKETCH_LONGS places."""
    place = (textbuf.mix(tokens + _U(11)) % _U(64 * SKETCH_LONGS)).astype(np.int64)
    odd = np.bincount(place, minlength=64 * SKETCH_LONGS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _analyse(percent: int):
    def run(table: pa.Table) -> pa.Table:
        keys, dfs, many_keys = [], [], None
        many_df: dict = {}
        for kind, n, data, more in zip(*(table.column(c).to_pylist() for c in ("kind", "n", "data", "more"))):
            if kind == _DOCS:
                row_keys, sizes, set_a, set_b = np.frombuffer(data, np.int64).reshape(4, n)
            elif kind == _MANY:
                many_keys = unpack(data, n)
            elif kind == _COUNTS:
                many_df.update(zip(unpack(data, n).tolist(), np.frombuffer(more, "<u4").tolist()))
            else:
                keys.append(unpack(data, n))
                dfs.append(np.frombuffer(more, "<u4").astype(np.int64))
        if many_keys is not None:
            tokens, place = np.unique(many_keys >> _DOC, return_inverse=True)
            keys.append(many_keys)
            dfs.append(np.array([many_df[t] for t in tokens.tolist()], np.int64)[place])
        n_docs = len(row_keys)
        key = np.concatenate(keys) if keys else np.zeros(0, _U)
        df = np.concatenate(dfs) if dfs else np.zeros(0, np.int64)
        doc = (key & _U(0xFFFF)).astype(np.int64)
        order = np.lexsort((key, df, doc))
        key, df = key[order] >> _DOC, df[order]
        ends = np.cumsum(np.bincount(doc, minlength=n_docs))
        begins = np.concatenate([[0], ends[:-1]])
        sigs, shared, sketches, mean = [], [], [], np.zeros(n_docs)
        for k in range(n_docs):
            part = slice(begins[k], ends[k])
            found = signatures(int(sizes[k]), key[part], df[part], percent) if sizes[k] else []
            sigs.append(np.asarray(found, _U).view(np.int64))
            wanted = len(found) > 0
            shared.append(key[part].view(np.int64) if wanted else np.zeros(0, np.int64))
            sketches.append(sketch(key[part]) if wanted else np.zeros(0, np.int64))
            mean[k] = df[part].sum() / sizes[k] if wanted else 0.0
        lists = lambda parts: pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()),
            pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64()),
        )
        return pa.Table.from_arrays(
            [pa.array(c) for c in (row_keys, sizes, set_a, set_b, mean)] + [lists(sigs), lists(shared), lists(sketches)],
            names=["key", "n", "set_a", "set_b", "mean_df", "sigs", "shared", "sketch"],
        )

    return run


def sets(df: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For each row of ``df(key, text)``: size and hash of its set, signatures, and the
    shingles it shares with other documents if it has signatures.  Stored."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_PER_PARTITION
    packed = df.select("key", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_units(buckets), _PACKED)
    counted = packed.groupBy("bucket").applyInArrow(_count_range, _SHARED)
    return stage(counted.groupBy("unit").applyInArrow(_analyse(percent), _ANALYSED), "shingle-sets")


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that link, by the size of the intersection."""
    side = lambda c: nodes.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("shared").alias(f"s_{c}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    return joined.filter(F.lit(100) * both >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def _by_size(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow a link."""
    return pairs.filter(F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))


def _split_postings(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings with their component, of signatures that hold several components."""
    labelled = postings.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    several = labelled.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    return labelled.join(several.filter("x <> y").select("sig"), "sig", "left_semi")


def links(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between the rows of ``sets`` that hold the components together.

    Rows of equal sets are linked to the least of them; all others are verified.
    """
    equal = found.filter("n > 0").groupBy("n", "set_a", "set_b").agg(F.min("key").alias("least"))
    same = (
        found.filter("n > 0")
        .select("key", "n", "set_a", "set_b")
        .join(equal, ["n", "set_a", "set_b"])
        .filter("key <> least")
        .select(F.col("least").alias("a"), F.col("key").alias("b"))
        .distinct()
    )
    same = stage(same, "shingle-equal")
    candidates = found.filter("size(sigs) > 0").join(same.select(F.col("b").alias("key")), "key", "left_anti")
    nodes = stage(candidates.dropDuplicates(["key"]), "shingle-nodes")
    postings = nodes.select("key", "n", "mean_df", F.explode("sigs").alias("sig"))
    lone = postings.groupBy("sig").agg(F.count("*").alias("c")).filter("c > 1").select("sig")
    postings = stage(postings.join(lone, "sig", "left_semi"), "shingle-postings")

    # Against the member whose shingles are the most common: of a family, its original.
    middle = postings.groupBy("sig").agg(F.max(F.struct("mean_df", "key", "n")).alias("m"))
    star = postings.join(middle, "sig").filter(F.col("key") != F.col("m.key")).select(
        F.least("key", F.col("m.key")).alias("a"), F.greatest("key", F.col("m.key")).alias("b"),
        F.col("n").alias("n_a"), F.col("m.n").alias("n_b"),
    )
    tried = stage(_by_size(star, percent).select("a", "b").distinct(), "shingle-tried")
    edges = stage(_verified(tried, nodes, percent), "shingle-links")
    labels = stage(components(edges), "shingle-labels")
    left = stage(_split_postings(postings, labels), "shingle-left")

    # What is left over, against some member of the largest component of each signature.
    for turn in range(PIVOT_ROUNDS):
        if left.isEmpty():
            return same.union(edges)
        by_component = left.groupBy("sig", "component").agg(
            F.count("*").alias("c"),
            F.min(F.struct(F.xxhash64("key", "sig", F.lit(turn)).alias("h"), "key", "n")).alias("m"),
        )
        largest = by_component.groupBy("sig").agg(F.max(F.struct("c", "component", "m")).alias("l"))
        tries = left.join(largest, "sig").filter(F.col("component") != F.col("l.component")).select(
            F.least("key", F.col("l.m.key")).alias("a"), F.greatest("key", F.col("l.m.key")).alias("b"),
            F.col("n").alias("n_a"), F.col("l.m.n").alias("n_b"),
        )
        fresh = _by_size(tries, percent).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        fresh = stage(fresh, "shingle-tried")
        more = stage(_verified(fresh, nodes, percent), "shingle-links")
        tried, edges = tried.union(fresh), edges.union(more)
        labels = stage(components(edges), "shingle-labels")
        left = stage(_split_postings(left.drop("component"), labels), "shingle-left")

    # All pairs of different components that share a signature and may differ little enough.
    sketched = nodes.select("key", (F.col("n") - F.size("shared")).alias("alone"), "sketch")
    left = left.join(sketched, "key")
    side = lambda c: left.select(
        "sig", *(F.col(old).alias(f"{new}_{c}") for old, new in (
            ("key", "k"), ("n", "n"), ("component", "c"), ("alone", "alone"), ("sketch", "sketch")
        ))
    )
    differ = sum(
        (F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH_LONGS)),
        F.col("alone_a") + F.col("alone_b"),
    )
    near = F.lit(100 + percent) * differ <= F.lit(100 - percent) * (F.col("n_a") + F.col("n_b"))
    apart = (F.col("k_a") < F.col("k_b")) & (F.col("c_a") != F.col("c_b"))
    one, two = side("a"), side("b")
    both = one.join(two, (one["sig"] == two["sig"]) & apart & near)
    rest = both.select(F.col("k_a").alias("a"), F.col("k_b").alias("b")).distinct()
    rest = stage(rest.join(tried, ["a", "b"], "left_anti"), "shingle-tried")
    return same.union(edges).union(_verified(rest, nodes, percent))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """One row per row of ``df``: its id, ``n_shingles``, ``component_id``, ``row_key``
    and ``component_key``.

    ``component_id`` is the least id reachable by links, the row's own included; null
    ids count as largest.  A text of one to four words is one shingle; a text without
    words, or null, has none and is linked with nothing.  Rows equal in id and text are
    the same node; equal texts with other ids are linked.  ``row_key`` is a hash of id
    and text.  Other columns are not read.  An empty table gives an empty result.
    ``percent`` must be at least 70: below, sets of few and frequent shingles can link
    without a signature in common.
    """
    if not 70 <= percent <= 100:
        raise ValueError("percent must be from 70 to 100")
    chosen = df.select(
        F.col(_quoted(id_col)).alias("id"),
        F.col(_quoted(text_col)).cast("string").alias("text"),
    ).withColumn("key", row_key(F.col("id"), F.col("text")))
    ids = chosen.select("key", "id")
    found = sets(chosen.select("key", "text"), percent)
    labels = stage(components(links(found, percent)), "shingle-labels")
    sizes = found.groupBy("key").agg(F.max("n").alias("n_shingles"))
    rows = stage(
        ids.join(sizes, "key")
        .join(labels.withColumnRenamed("node", "key"), "key", "left")
        .select("key", "id", "n_shingles", F.coalesce("component", "key").alias("component")),
        "shingle-rows",
    )
    least = rows.groupBy("component").agg(F.min("id").alias("component_id"))
    return rows.join(least, "component").select(
        F.col("id").alias(id_col), "n_shingles", "component_id",
        F.col("key").alias("row_key"), F.col("component").alias("component_key"),
    )


def row_key(id_, text):
    return F.xxhash64(id_, text)


def keep_one(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """The rows of ``df``, all columns whatever their names, with one row of each group of linked rows.

    The row with the least id stays, of several such the one with the least key; rows
    without words all stay.  The keys dropped are broadcast if few, else joined by
    shuffling.
    """
    columns = df.columns
    df, id_col, text_col = hidden(df, id_col, text_col)
    found = near_duplicates(df, id_col, text_col, percent).filter("n_shingles > 0")
    found = found.select("row_key", F.col(id_col).alias("id"), "component_key")
    found = stage(found, "shingle-found")
    first = found.groupBy("component_key").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "row_key")).alias("first")
    )
    marked = found.join(first, "component_key").select(
        F.col("row_key").alias("__key"), (F.col("row_key") == F.col("first.row_key")).alias("stays")
    )
    marked = stage(marked.groupBy("__key").agg(F.max("stays").alias("stays"), F.count("*").alias("c")), "shingle-marked")
    dropped, twice = marked.filter("NOT stays").select("__key"), marked.filter("stays AND c > 1").select("__key")
    keyed = df.withColumn("__row_key", row_key(F.col(_quoted(id_col)), F.col(_quoted(text_col)).cast("string")))
    same = F.col("__row_key") == F.col("__key")
    hint = F.broadcast if small_enough(dropped, 16) else (lambda t: t)
    rest = keyed.join(hint(dropped), same, "left_anti")
    if not twice.isEmpty():
        one = rest.join(twice, same, "left_semi").dropDuplicates(["__row_key"])
        rest = rest.join(twice, same, "left_anti").unionByName(one)
    return rest.drop("__row_key").toDF(*columns)
