"""Operators 4, 7 and 8: against brute force, and every odd case."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm import chunks, fingerprints, simhash

LONG = "alpha beta " * 20_000
CLASH = "fp STRING, component_id STRING, digest STRING, removed STRING, n_chars BIGINT"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", 0) for i, t in rows], "doc_id BIGINT, text STRING, " + CLASH)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def naive_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(ids, fps, distance):
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                parent[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(fps))]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_fingerprint_by_its_definition(text):
    assert simhash.fingerprint(text) == naive_fingerprint(text)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(150)]
    for i in range(150, 330):
        words = rng.choice(rows)[1].split()
        if words and rng.random() < 0.7:
            words[rng.randrange(len(words))] = "edit"
        rows.append((i, " ".join(words)))
    rows += [(None, rows[3][1]), (None, prose(rng, 50)), (7, rows[7][1]), (900, None), (901, ""), (902, LONG), (903, "A b"), (904, "a B")]
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    fps = [naive_fingerprint(t) for _, t in rows]
    want = naive_components([i for i, _ in rows], fps, 3)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    assert got == {(i, signed(f), c) for (i, _), f, c in zip(rows, fps, want)}
    assert simhash.near_duplicates(frame(spark, rows)).count() == len(rows)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("split", [20_000, 5])
def test_links_connect_all_that_all_pairs_connect(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "LEAF_SPLIT", split)
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(seeds.tolist())
    for f in seeds[:40].tolist():  # balls of near fingerprints, and chains
        for _ in range(12):
            f ^= 1 << int(rng.integers(64))
            if rng.random() < 0.5:
                f ^= 1 << int(rng.integers(64))
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp BIGINT")
    found = simhash.links(df, leaf_rows=16).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in found)
    label = {r.node: r.label for r in simhash.components(spark.createDataFrame([(r.a, r.b) for r in found], "a BIGINT, b BIGINT")).collect()}
    ids = [f - (1 << 64) if f >> 63 else f for f in fps]
    assert [label.get(i, i) for i in ids] == naive_components(ids, fps, 3)


def test_full_leaves_get_trees_of_their_own(spark, monkeypatch):
    """A first tree of few leaves, chunks of a few rows, several rounds; one half is the same in many rows, so that no tree parts them."""
    for name, value in {"SAMPLE": 32, "LEAF_FULL": 2, "LEAF_SAMPLE": 40, "LEAF_CHUNK": 50, "SUB_DEPTH": 2, "LEAF_SPLIT": 60}.items():
        monkeypatch.setattr(simhash, name, value)
    rounds = []
    plain = simhash.split
    monkeypatch.setattr(simhash, "split", lambda *a: rounds.append(a[1].count()) or plain(*a))
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    fps = set(seeds.tolist()) | {(int(f) << 32 | 77) & (1 << 64) - 1 for f in seeds[:90]}
    for f in list(fps):
        for _ in range(4):
            for bit in rng.integers(64, size=rng.integers(1, 4)).tolist():
                f ^= 1 << bit
            fps.add(f)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp BIGINT")
    found = simhash.links(df, leaf_rows=16).collect()
    assert len(rounds) >= 2 and all(rounds)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in found)
    label = {r.node: r.label for r in simhash.components(spark.createDataFrame([(r.a, r.b) for r in found], "a BIGINT, b BIGINT")).collect()}
    assert [label.get(i, i) for i in signed] == naive_components(signed, [f & (1 << 64) - 1 for f in signed], 3)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a BIGINT, b BIGINT")
    label = {r.node: r.label for r in simhash.components(edges).collect()}
    assert {label[k] for k in range(1, 201)} == {0} and label[501] == 500
    assert simhash.components(edges.limit(0)).count() == 0


def naive_ends(data):
    h, start, ends = 0, 0, []
    for k, b in enumerate(data):
        h = (2 * h + int(chunks.GEAR[b])) & 0xFFFFFFFF
        if k + 1 - start > chunks.MOST:
            start += chunks.MOST
            ends.append(start)
        if h >> (32 - chunks.CUT_BITS) == 0 and k + 1 - start >= chunks.LEAST:
            start = k + 1
            ends.append(start)
    while len(data) - start > chunks.MOST:
        start += chunks.MOST
        ends.append(start)
    return ends + ([len(data)] if start < len(data) else [])


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=1500))
def test_cuts_by_the_rolling_hash(data):
    assert chunks.chunk_ends(data) == naive_ends(data)


def test_substring_dedup(spark):
    rng = random.Random(6)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 80)) for i in range(20)]
    rows += [(30 + i, prose(rng, rng.randint(10, 40)) + " " + passage + " " + prose(rng, 30)) for i in range(6)]
    rows += [(50, rows[0][1]), (51, "é" + rows[1][1]), (60, None), (61, ""), (62, LONG), (None, rows[2][1]), (8, rows[8][1])]
    got = {}
    for r in chunks.deduplicate(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    texts = dict(rows)
    for i in range(20):
        assert got[i][0].text == texts[i] and got[i][0].removed == []
    assert len(got[8]) == 2 and {r.text for r in got[8]} == {texts[8]}
    assert got[30][0].text == texts[30]
    for i in range(31, 36):
        (r,) = got[i]
        (gone,) = r.removed
        cut = texts[i][gone.first : gone.end]
        assert cut in passage and len(cut) > 0.5 * len(passage) and r.text == texts[i][: gone.first] + texts[i][gone.end :] and r.n_chars == len(r.text)
        assert cut.split()[5:25] == [w for w in cut.split()][5:25]
    assert got[50][0].text == "" and len(got[None][0].text) < 20 and got[60][0].text is None and got[60][0].n_chars is None and got[61][0].text == ""
    assert len(got[51][0].text) < len(texts[51]) / 2
    assert chunks.deduplicate(frame(spark, [])).count() == 0


def test_fingerprints(spark):
    rng = random.Random(7)
    rows = [(i * 3, prose(rng, rng.randint(0, 30)) + "Éx") for i in range(60)]
    rows += [(200, "Same  Text\n"), (201, "same text"), (202, "ＳＡＭＥ text"), (203, None), (204, ""), (205, LONG), (None, "no id"), (206, "abc"), (206, "abc")]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    order = sorted(((i, t or "") for i, t in rows), key=key)
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        new = t[: len(t) - q] + after[:q]
        same = lambda a, b: float(fingerprints.canonical(a) == fingerprints.canonical(b))
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprints.digest(fingerprints.canonical(t)), fingerprints.digest(fingerprints.canonical(new)), same(t, new), same(t, after)))
    old, fingerprints.RANGE_ROWS = fingerprints.RANGE_ROWS, (5, 5)
    try:
        got = [tuple(r)[:7] for r in fingerprints.fingerprints(frame(spark, rows)).collect()]
    finally:
        fingerprints.RANGE_ROWS = old
    s = lambda r: tuple(map(str, r))
    assert sorted(got, key=s) == sorted(want, key=s)
    by = {r[0]: r[3] for r in got}
    assert by[200] == by[201] == by[202] and by[203] == by[204]
    assert fingerprints.fingerprints(frame(spark, [])).count() == 0
    (one,) = fingerprints.fingerprints(frame(spark, [(1, "abcdefgh")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_equal_digests_of_unequal_texts_are_told_apart(spark, monkeypatch):
    df = frame(spark, [(1, "one"), (2, "two"), (None, "two"), (None, "six"), (4, "three")])
    monkeypatch.setattr(fingerprints, "digest", lambda form: "d" if len(form) == 3 else "e")
    import inspect

    assert "groupBy(\"digest\", \"form\")" in inspect.getsource(fingerprints.same_bytes)
    forms = fingerprints.same_bytes(df, spark.createDataFrame([("d",), ("ffffffff0",)], "digest STRING"))
    assert sorted((r.form, r.number) for r in forms.collect()) == [("one", 0), ("six", 1), ("two", 2)]


def test_many_rows_without_an_id(spark):
    """As many null and repeated ids as others: each text is a document of its own, and no row is lost."""
    rng = random.Random(9)
    passage = prose(rng, 80)
    rows = [(None, f"{prose(rng, 20)} {passage} {prose(rng, 20)}") for _ in range(30)] + [(2**63 - 1, prose(rng, 60)), (5, passage), (6, prose(rng, 30))] + [(7, prose(rng, 40)) for _ in range(30)]
    got = chunks.deduplicate(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    nulls = [r for r in got if r.doc_id is None]
    assert len(nulls) == 30 and all(len(r.removed) == 1 and r.n_chars == len(r.text) for r in nulls)
    assert all(not r.removed for r in got if r.doc_id is not None)
    alone = chunks.deduplicate(frame(spark, rows[:30])).collect()
    assert sorted(len(r.removed) for r in alone) == [0] + [1] * 29
    old, fingerprints.RANGE_ROWS = fingerprints.RANGE_ROWS, (4, 4)
    try:
        prints = fingerprints.fingerprints(frame(spark, rows)).collect()
    finally:
        fingerprints.RANGE_ROWS = old
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    edits = [fingerprints.edited(t, order[(k + 1) % len(order)][1]) for k, (_, t) in enumerate(order)]
    assert sorted(r.edited_sha256 for r in prints) == sorted(hashlib.sha256(e.encode()).hexdigest() for e in edits)
