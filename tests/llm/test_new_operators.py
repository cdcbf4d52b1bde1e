"""Token alignment, packing and conversation repair against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seamline.llm import auction, conversations, packing, perfect_hash, token_alignment
from seamline.llm.pair_index_bpe import byte_letters
from tests.llm.conftest import awkward_rows
from tests.llm.test_operators import odd_texts

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HOSTILE = [
    "x" * 20000 + "yy", "日本語" * 2000, "a\r\nb\r\n c\r", "a　 b　　c", "a\x85 b\xa0 c", "a\x00b \x00", " " * 5000,
    "it's <s> <unk> <0x41>", "😀😀 𝒳", "▁a b", "\n", " ", "ab" * 3000,
]


# ------------------------------------------------------------ 11 alignment


def plain_alignment(rows):
    """Rows as ``align`` gives them, and the counts of all pairs, token by token."""
    a_of, b_of = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_of.encode_special_tokens = True
    value = {letter: b for b, letter in byte_letters().items()}

    def b_piece(k):
        piece = b_of.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    documents, counts = [], collections.Counter()
    for name, text in rows:
        groups = []
        if text:
            a, b = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)
            a_bytes, b_bytes = [bytes(value[c] for c in a_of.id_to_token(k)) for k in a], [b_piece(k) for k in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a_ends, b_ends = (list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes))
                at = [0, 0]
                for end in sorted(set(a_ends) & set(b_ends)):
                    to = [a_ends.index(end, at[0]) + 1, b_ends.index(end, at[1]) + 1]
                    groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
                    at = to
        links = collections.Counter(pair for x, y in groups for pair in itertools.product(x, y))
        counts.update(links.keys())
        documents.append((name, groups, links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for name, groups, links in documents:
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            name, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), links.total(),
            sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()),
            hashlib.sha256(written.encode()).hexdigest() if written else "",
        ))
    return sorted(out, key=repr), counts


@pytest.mark.parametrize("fan_in, block", [(1024, 8 << 20), (2, 3000)])
def test_alignment_against_a_plain_version(spark, awkward, clashing, monkeypatch, fan_in, block):
    monkeypatch.setattr(token_alignment, "FAN_IN", fan_in)
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", block)
    texts = HOSTILE + odd_texts()[::4]
    rows = [*enumerate(texts), (None, None), (None, ""), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected, counts = plain_alignment(rows)
    assert sorted(map(tuple, token_alignment.align(df, BYTES, PIECES).collect()), key=repr) == expected
    found = token_alignment.pair_counts(df, BYTES, PIECES).collect()
    assert {(r.a_id, r.b_id): r.n_documents for r in found} == counts and len(found) == len(counts)


def test_alignment_of_awkward_and_empty_tables(awkward, clashing, empty):
    expected, _ = plain_alignment([r[:2] for r in awkward_rows()])
    for df in (awkward, clashing):
        found = token_alignment.align(df, BYTES, PIECES, groups=True)
        rows = found.collect()
        assert sorted((tuple(r)[:-1] for r in rows), key=repr) == expected
        assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in rows)
    assert token_alignment.align(empty, BYTES, PIECES).count() == 0
    assert token_alignment.pair_counts(empty, BYTES, PIECES).count() == 0


def test_perfect_hash_is_minimal_and_survives_storage():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rnd.integers(0, 1 << 44, n)).astype(np.uint64)
        made = perfect_hash.PerfectHash.from_bytes(perfect_hash.PerfectHash.of(keys).to_bytes())
        assert sorted(made.numbers(keys).tolist()) == list(range(len(keys)))
        assert len(made.bits) <= 6 * len(keys) + 64


def test_pair_codes_are_reversible_and_a_wrong_key_is_refused():
    pairs = token_alignment.Pairs(50257, 32000)
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(0, 50257, 10000), rnd.integers(0, 32000, 10000)
    codes = pairs.code(a, b)
    assert codes.max() < 1 << pairs.bits
    back = pairs.tokens(codes)
    assert (back[0] == a).all() and (back[1] == b).all()
    keys = np.unique(codes)[::2].astype(np.uint64)
    index = perfect_hash.PerfectHash.of(keys)
    kept = np.zeros(len(keys), np.uint64)
    kept[index.numbers(keys)] = keys
    part = token_alignment._Slice({"hash": index.to_bytes(), "keys": kept.tobytes()})
    assert (kept[part.numbers(keys)] == keys).all()
    with pytest.raises(RuntimeError):
        part.numbers(np.unique(codes)[1::2].astype(np.uint64))


# ------------------------------------------------------------ 12 packing


def plain_ids(text):
    library = plain_ids.library = getattr(plain_ids, "library", None) or Tokenizer.from_file(BYTES)
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.mark.parametrize("window", [1024, 7, 64])
def test_pieces_and_sequences(spark, window):
    rows = [*enumerate(HOSTILE + odd_texts()[::5]), (None, None), (3, HOSTILE[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pieces = packing.pack_pieces(df, BYTES, window=window).collect()
    sequences = {r.sequence_id: r for r in packing.pack_sequences(df, BYTES, window=window, pad_id=9).collect()}
    documents = collections.Counter((name, plain_ids(text).tobytes()) for name, text in rows)
    last = max(sequences)
    assert sorted(sequences) == list(range(last + 1))
    found, begun = collections.defaultdict(list), {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        ids = np.frombuffer(sequences[p.sequence_id].ids, "<u4")
        part = ids[p.offset : p.offset + p.length].tobytes()
        assert zlib.crc32(part) == p.ids_crc32 and p.offset == begun.get(p.sequence_id, 0)
        begun[p.sequence_id] = p.offset + p.length
        place = p.sequence_id * window + p.offset
        found[place - p.start, p.doc_id, p.doc_tokens].append((p.start, part))
    for (_, name, n), parts in found.items():
        ids = b"".join(part for _, part in sorted(parts))
        assert len(ids) == 4 * n
        documents[name, ids] -= 1
    assert not any(documents.values())
    for k, sequence in sequences.items():
        n, ids = begun[k], np.frombuffer(sequence.ids, "<u4")
        assert n == sequence.n_tokens and (n == window or k == last)
        assert sequence.n_padding == (0 if n & (n - 1) == 0 else window - n) == len(ids) - n
        assert (ids[n:] == 9).all()


def test_packing_of_awkward_and_empty_tables(awkward, clashing, empty):
    expected = sorted(((i, len(plain_ids(t))) for i, t, *_ in awkward_rows()), key=repr)
    for df in (awkward, clashing):
        pieces = packing.pack_pieces(df, BYTES)
        assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        rows = pieces.collect()
        assert sorted(((r.doc_id, r.doc_tokens) for r in rows if r.start == 0), key=repr) == expected
        assert sum(r.length for r in rows) == sum(n for _, n in expected)
    assert packing.pack_pieces(empty, BYTES).count() == 0 and packing.pack_sequences(empty, BYTES).count() == 0


# ------------------------------------------------------------ 13 conversations

AFTER = (2, 2, 3, 2)
KEEPS = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}


def every_way(codes):
    """The cheapest edits and the least of their letters, by trying all."""
    best = None

    def go(row, state, cost, letters, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if row == len(codes) and state in (0, 3):
            best = min(best or (cost, letters), (cost, letters))
        if inserted < 3:
            go(row, AFTER[state], cost + 2, letters + "I", inserted + 1)
        if row < len(codes):
            role, late, gone = codes[row] & 3, codes[row] >> 2 & 1, codes[row] >> 3
            go(row + 1, state, cost + 3, letters + "D", 0)
            if not gone:
                go(row + 1, AFTER[state], cost + 2 + late, letters + "R", 0)
                if (state, role) in KEEPS:
                    go(row + 1, role, cost + late, letters + "K", 0)

    go(0, 0, 0, "", 0)
    return best


def test_auction_finds_the_least_cheapest_edits_whole_and_in_parts():
    rnd = random.Random(1)
    for _ in range(1500):
        codes = [rnd.randint(0, 15) for _ in range(rnd.randint(0, 6))]
        table = auction.prices(codes)
        letters, _ = auction.trace(codes, table, auction.START)
        assert (table[0][auction.START], letters) == every_way(codes)
        for here, below, code in zip(table, table[1:], codes):  # no arc is cheaper than the prices say
            for state in range(4):
                assert here[state] <= 3 + below[state] and here[state] <= 2 + here[AFTER[state]]
                assert code & 8 or here[state] <= 2 + (code >> 2 & 1) + below[AFTER[state]]
        cut = rnd.randint(0, len(codes))
        rest = auction.prices(codes[cut:])
        assert auction.before(auction.passage(codes[:cut]), rest[0]) == table[0]
        first, state = auction.trace(codes[:cut], auction.prices(codes[:cut], rest[0]), auction.START, last=False)
        assert first + auction.trace(codes[cut:], rest, state)[0] == letters


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_ = (" " if v is None else v for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_costs(codes):
    """What is left to pay at every node, by going over the rows from the last until nothing changes."""
    costs = [[0, 4, 2, 0]]
    for role, late, gone in reversed(codes):
        below, here = costs[0], [10**9] * 4
        for state in [0, 1, 2, 3] * 6:
            ways = [3 + below[state], 2 + here[AFTER[state]]]
            if not gone:
                ways += [2 + late + below[AFTER[state]]] + [late + below[role]] * ((state, role) in KEEPS)
            here[state] = min(ways)
        costs.insert(0, here)
    return costs


def plain_audit(original, rows):
    names, out = {2: "user", 3: "assistant"}, []
    for conv in {r[0] for r in original}:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, codes, faults = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not visible else 1 if (role, text) in seen else 2 if visible[-1] not in ".!?" else None
            if fault is not None:
                faults[fault] += 1
            seen.add((role, text))
            codes.append((" sua".find(role[:1] or "?") if role[:1] in "sua" else 0, int(fault == 2), fault in (0, 1)))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        costs, letters, made, state, k = plain_costs(codes), "", [], 0, 0
        while k < len(codes) or state in (1, 2):
            role, late, gone = codes[k] if k < len(codes) else (0, 0, True)
            here, below = costs[k][state], costs[k + 1] if k < len(codes) else [10**9] * 4
            if here == 3 + below[state]:
                step, k = "D", k + 1
            elif here == 2 + costs[k][AFTER[state]]:
                step, state = "I", AFTER[state]
                made.append(names[state] + ":")
            elif not gone and (state, role) in KEEPS and here == late + below[role]:
                made.append(own[k][2] + ":" + own[k][3])
                step, state, k = "K", role, k + 1
            else:
                state = AFTER[state]
                made.append(names[state] + ":" + own[k][3])
                step, k = "R", k + 1
            letters += step
        out.append((conv, gaps, *faults, illegal, costs[0][0], letters, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=repr)


def talk():
    rnd = random.Random(4)
    texts = ["a.", "b", "c!", "hello there.", "  ", "\t", None, "", "x? ", "é.", "no end", "word " * 2000]
    roles = ["user", "assistant", "system", "u", "s2", "tool", "", None, "User"]
    rows = [
        (conv, rnd.choice([t, t, t, None, t + 3, rnd.randint(-2, 9)]), rnd.choice(roles), rnd.choice(texts))
        for conv in [None, *range(50)] for t in range(rnd.randint(1, 9))
    ]
    rows += [
        (1000, t if t % 5 else None, rnd.choice(["user", "assistant", "assistant", "user", "system"]), rnd.choice([*texts, *[f"t{t}.", f"t{t}"] * 5]))
        for t in range(500)
    ]
    return rows + rows[:20]


TALK = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("window", [1024, 16, 1])
def test_conversations_against_a_plain_version(spark, monkeypatch, window):
    """A conversation over many windows is settled like one in a single window."""
    monkeypatch.setattr(conversations, "WINDOW", window)
    rows = talk()
    df = spark.createDataFrame(rows, TALK).repartition(3)
    damaged = conversations.damage(df)
    assert sorted(map(tuple, damaged.collect()), key=repr) == sorted(plain_damage(rows), key=repr)
    expected = plain_audit(rows, plain_damage(rows))
    assert sorted(map(tuple, conversations.audit(df, damaged).collect()), key=repr) == expected
    found = conversations.repair(damaged, "conv").repaired().orderBy("conv", "at", "sub").collect()
    for conv in {r.conv for r in found}:
        own = [r for r in found if r.conv == conv]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own))
        digest = hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest()
        assert digest == next(e[-1] for e in expected if e[0] == conv)


def test_conversations_with_clashing_columns_and_none(spark):
    rows = talk()[:60]
    df = spark.createDataFrame(rows, TALK)
    expected = plain_audit(rows, plain_damage(rows))
    more = df.withColumns({c: F.lit("extra") for c in "conv at code window digest first kind copy again passage audit cost n".split()})
    assert sorted(map(tuple, conversations.audit(more, conversations.damage(more)).collect()), key=repr) == expected
    none = spark.createDataFrame([], TALK)
    assert conversations.audit(none, conversations.damage(none)).count() == 0
    lost = spark.createDataFrame([(k, t, "user", "x.") for k in range(30) for t in range(2)], TALK)
    some = conversations.audit(lost, lost.limit(0).toDF("conv", "turn", "role", "text")).collect()
    assert {tuple(r)[1:] for r in some} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(some) == 30
