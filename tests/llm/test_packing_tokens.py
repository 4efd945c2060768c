"""Operators 1 and 2: against brute force, and every odd case."""

import io
import random
import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm import packing, rans, tokens

LONG = "word " * 30_000
TEXTS = [(1, "a b c"), (2, None), (3, ""), (4, LONG), (5, "same text"), (5, "same text"), (None, "no id"), (7, "x" * 5000), (8, "  two  blanks \n\n and lines\t"), (9, "é漢 <|endoftext|> don't 3.14,")]
SCHEMA = "doc_id BIGINT, text STRING, ids STRING, sequence_id STRING, offset STRING, length STRING, piece STRING"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash", "clash") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", *" \t\n\r\x0b\x0cab'sTt.,9_-|<>", *map(chr, (0x1C, 0x85, 0xA0, 0xE9, 0xBD, 0xB2, 0x301, 0x6F22, 0x2003, 0x200B, 0x3000, 0x1F642))]), max_size=60).map("".join))
def test_chunks_give_the_ids_of_the_whole_text(text):
    enc = tokens.encoder(tokens.vocabulary())
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == untouched().encode(text, add_special_tokens=False).ids


@cache
def untouched():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary())


def test_special_tokens_are_those_of_the_library():
    enc = tokens.encoder(tokens.vocabulary())
    for text in ("hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b <|endoftext|", "don't <|endoftext|>\n\n  x"):
        ids = np.frombuffer(enc.encode([text])[0], "<u4").tolist()
        assert ids == untouched().encode(text, add_special_tokens=False).ids and (50256 in ids) == ("<|endoftext|>" in text)


def naive_best_fit(counts, capacity):
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [k for k in range(len(bins)) if bins[k] >= length]
            if fits:
                bins[min(fits, key=lambda k: bins[k])] -= length
            else:
                bins.append(capacity - length)
    return len(bins)


def test_plan_equals_best_fit_over_items():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([10, 64, 1024])
        counts = {}
        for _ in range(rng.randint(0, 120)):
            k = rng.randint(1, capacity)
            counts[k] = counts.get(k, 0) + rng.randint(1, 5)
        slots, bins = packing.plan_slots(counts, capacity)
        assert bins == naive_best_fit(counts, capacity)
        placed = {}
        for length, a, b, first, each, at in slots:
            for r in range(a, b):
                placed.setdefault(first + (r - a) // each, []).append((at + (r - a) % each * length, length))
        for items in placed.values():
            end = 0
            for at, length in sorted(items):
                assert at == end
                end += length
            assert end <= capacity
        assert len(placed) == bins


def test_pack_documents(spark, docs, plain):
    rows = packing.pack_documents(docs, path=tokens.vocabulary(), capacity=64).collect()
    want = []
    for i, t in TEXTS:
        ids = plain(t)
        first = len(ids) if len(ids) <= 64 else (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids), 64), len(ids)] if first < len(ids) else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        end = 0
        for at, n in sorted(items):
            assert at == end
            end += n
        assert end <= 64
    counts = {}
    for w in want:
        counts[w[3]] = counts.get(w[3], 0) + 1
    assert len(by) == naive_best_fit(counts, 64)


def test_pack_odd_lengths_and_sequences(spark):
    df = spark.createDataFrame([(1, 5, b"a"), (2, None, b"b"), (3, 0, b"c"), (4, 99, b"d"), (5, 5, b"e")], "k INT, length BIGINT, offset BINARY")
    got = {r.k: (r.sequence_id, r.offset) for r in packing.pack(df, capacity=10, order=["k"]).collect()}
    assert got[2] == got[3] == got[4] == (None, None) and sorted([got[1], got[5]]) == [(0, 0), (0, 5)]
    assert packing.pack(df.limit(0), capacity=10, order=["k"]).count() == 0
    cut = packing.pieces(spark.createDataFrame([(1, np.arange(10, dtype="<u4").tobytes())], "doc_id INT, ids BINARY"), capacity=4)
    placed = packing.pack(cut, capacity=8, order=["doc_id", "piece"])
    flat = np.concatenate([np.frombuffer(r.ids, "<u4") for r in packing.sequences(placed).collect()])
    assert sorted(flat.tolist()) == list(range(10))
    assert [len(r.ids) // 4 for r in cut.orderBy("piece").collect()] == [2, 4, 4]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60_000), min_size=1, max_size=3000))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    values, n = np.unique(ids, return_counts=True)
    table = rans.Table.of(dict(zip(values.tolist(), n.tolist())))
    assert int(table.freq.sum()) == 1 << rans.BITS
    block = rans.encode_block(ids, rans.Table.parse(table.to_bytes()))
    assert (rans.Decoder(table).block(block) == ids).all()


def test_checkpoints_checksums_and_size():
    ids = (np.random.default_rng(0).zipf(1.4, 1 << 20) % 50_000).astype(np.uint32)
    values, n = np.unique(ids, return_counts=True)
    table = rans.Table.of(dict(zip(values.tolist(), n.tolist())))
    block = rans.encode_block(ids, table)
    p = n / n.sum()
    assert len(block) * 8 < 1.1 * -(p * np.log2(p)).sum() * len(ids)
    decoder = rans.Decoder(table)
    at = rans.EVERY * rans.LANES
    assert (decoder.block(block, mark=1, rows=5) == ids[at : at + 5 * rans.LANES]).all()
    for k in (rans.BLOCK.size + 3, len(block) - 1):
        bad = bytearray(block)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            decoder.block(bytes(bad))


def test_files_of_documents_over_many_blocks(monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_IDS", 100)
    rng = np.random.default_rng(1)
    docs = [(None, np.empty(0, np.uint32)), (1, rng.integers(0, 50, 730).astype(np.uint32)), (2, np.array([7], np.uint32)), (9, rng.integers(0, 50, 270).astype(np.uint32))]
    table = rans.Table.of({k: 1 for k in range(50)})
    out = io.BytesIO()
    w = rans.ShardWriter(out, table)
    for d in docs:
        w.add(*d)
    w.close()
    read = list(rans.read_documents(io.BytesIO(out.getvalue()), len(out.getvalue()), table))
    assert [(d, np.concatenate([*p, np.empty(0, np.uint32)]).tolist()) for d, p in read] == [(d, x.tolist()) for d, x in docs]


@pytest.mark.parametrize("shard_ids", [(50, 50), (10**9, 10**9)])
def test_token_files(spark, docs, plain, shard_ids):
    folder, manifest = rans.token_files(docs, path=tokens.vocabulary(), shard_ids=shard_ids)
    got = rans.read_files(spark, folder, manifest).collect()
    order = sorted(((i, plain(t)) for i, t in TEXTS), key=lambda x: -1 if x[0] is None else x[0])
    want, start = [], 0
    for i, ids in order:
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    if shard_ids[0] == 50:
        assert manifest.count() > 1
    folder, manifest = rans.token_files(docs.limit(0), path=tokens.vocabulary())
    assert rans.read_files(spark, folder, manifest).count() == 0
