"""The stages one by one: columns, and decisions that take effect."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import pytest

from quadrille.llm import chunks, packing, quality, queries
from tests.llm.test_dedup import naive_components, naive_fingerprint, prose


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        out = spark.createDataFrame(out.toPandas(), out.schema)
        seen[name], docs = out, out
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality"].collect()}
    assert all(q == 1 for d, q in labels.items() if d in kept) and all(d in kept for d, q in labels.items() if q == 1)
    near = seen["near_duplicates"]
    assert 0 < near.count() < seen["quality"].count() and near.select("text").distinct().count() == near.count()
    assert seen["passages"].count() <= near.count() and seen["passages"].where("n_chars <> length(text)").count() == 0
    assert seen["mixing"].groupBy("doc_id").count().where("count > 3").count() == 0
    packed = seen["packing"]
    assert packed.groupBy("doc_id").count().count() == seen["mixing"].select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0
    assert packing.plan_slots({}, 1024) == ([], 0)


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame([], docs.schema)


SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="module")
def crawl():
    """(doc_id, text, lang, source, n_chars): copies, near copies, rows without an id, repeated ids and rows, shared passages, empty texts."""
    rng = random.Random(11)
    rows = [[k, prose(rng, rng.randint(30, 120)), rng.choice("ab"), rng.choice(["s", "t", None])] for k in range(90)]
    shared = prose(rng, 70)
    for k in (3, 8, 21, 40):
        rows[k][1] = prose(rng, 40) + " " + shared + " " + prose(rng, 40)
    for k in range(90, 150):
        words = rng.choice(rows[:90])[1].split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "edit"
        rows.append([None if k % 4 == 0 else k, " ".join(words), rng.choice("ab"), rng.choice(["s", "t"])])
    lonely = prose(rng, 60)
    rows += [[None, lonely, "a", "s"]] * 3 + [[None, lonely, "b", "s"], [150, None, "a", "s"], [151, "", "a", None], [None, "", "b", "t"]]
    rows += [list(rows[5]), list(rows[5]), [5, rows[6][1], "a", "s"], [7, prose(rng, 50), "b", "t"]]
    rng.shuffle(rows)
    return [(i, t, g, s, len(t or "")) for i, t, g, s in rows]


def collected(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_quality_against_plain_python(spark, crawl):
    docs = spark.createDataFrame(crawl, SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)], "doc_id BIGINT, quality INT")
    model = quality.fit(docs, labels)
    score = [float(model.evidence(np.array([quality.features(r[1])]))[0]) for r in crawl]
    p = [1 / (1 + np.exp(-(e + model.base))) for e in score]
    groups = defaultdict(list)
    for k, r in enumerate(crawl):
        for key in ((), (r[3],), (r[3], r[2])):
            groups[key].append(k)
    mean = {key: sum(p[k] for k in of) / len(of) for key, of in groups.items()}

    def strength(keys, towards):
        n, m, t = (np.array([f(key) for key in keys]) for f in (lambda key: len(groups[key]), mean.get, towards))
        return n, m, t

    hosts, paths = [g for g in groups if len(g) == 1], [g for g in groups if len(g) == 2]
    n, m, t = strength(hosts, lambda key: mean[()])
    spread, noise = (n * (m - t) ** 2).sum() / n.sum(), (t * (1 - t)).sum() / n.sum()
    host_k = max(2.0, min(1e4, (t * (1 - t)).mean() / max(spread - noise, 1e-6) - 1))
    whole = {key: (len(groups[key]) * mean[key] + host_k * mean[()]) / (len(groups[key]) + host_k) for key in hosts}
    n, m, t = strength(paths, lambda key: whole[key[:1]])
    spread, noise = (n * (m - t) ** 2).sum() / n.sum(), (t * (1 - t)).sum() / n.sum()
    path_k = max(2.0, min(1e4, (t * (1 - t)).mean() / max(spread - noise, 1e-6) - 1))
    want = []
    for k, r in enumerate(crawl):
        others = lambda key: [p[j] for j in groups[key] if j != k]  # noqa: B023, E731
        of_host = (sum(others((r[3],))) + host_k * np.mean(others(()))) / (len(others((r[3],))) + host_k)
        of_path = (sum(others((r[3], r[2]))) + path_k * of_host) / (len(others((r[3], r[2]))) + path_k)
        want.append((r, 1 / (1 + np.exp(-(score[k] + np.log(of_path / (1 - of_path)))))))
    got = sorted((tuple(r)[:5], r.posterior, r.kept) for r in quality.judge(docs, labels).select("doc_id", "text", "lang", "source", "n_chars", "posterior", "kept").collect() if r.doc_id is not None)
    want = sorted((r, q, q >= 0.5) for r, q in want if r[0] is not None)
    assert [g[0] for g in got] == [w[0] for w in want] and [g[2] for g in got] == [w[2] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-9)


def test_near_duplicates_against_plain_python(spark, sf, crawl):
    out = collected(corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(crawl, SCHEMA), sf))
    number = naive_components(range(len(crawl)), [naive_fingerprint(r[1]) for r in crawl], 3)
    groups = defaultdict(list)
    for n, r in zip(number, crawl, strict=True):
        groups[n].append(r)
    assert sum(out.values()) == len(groups)
    for rows in groups.values():
        ids = [r[0] for r in rows if r[0] is not None]
        stays = [r for r in rows if r[0] == (min(ids) if ids else None)]
        kept = [r for r in set(rows) if out[r]]
        assert len(kept) == 1 and out[kept[0]] == 1 and kept[0] in stays


def test_passages_against_plain_python(spark, sf, crawl):
    out = collected(corpus_pipeline.passage_stage(spark, spark.createDataFrame(crawl, SCHEMA), sf))
    owner, number = {}, hashes(spark, crawl)
    who = lambda r: (0, r[0]) if r[0] is not None else (1, number[r[1]])
    for r in crawl:
        for _, _, digest in chunks.chunks_of((r[1] or "").encode()):
            owner[digest] = min(owner.get(digest, (2, 0)), who(r))
    want = Counter()
    for r in crawl:
        old = {d for _, _, d in chunks.chunks_of((r[1] or "").encode()) if owner[d] < who(r)}
        text, seen, data, run, keep = r[1], set(), (r[1] or "").encode(), [], []
        for a, b, d in [*chunks.chunks_of(data), (len(data), len(data), None)]:
            if d is not None and (d in old or d in seen):
                run.append((a, b))
            else:
                if run and len(data[run[0][0] : run[-1][1]].split()) < chunks.MIN_WORDS:
                    keep.append(data[run[0][0] : run[-1][1]])
                keep.append(data[a:b])
                run = []
            seen.add(d)
        new = None if text is None else b"".join(keep).decode()
        if new == text or new.strip():
            want[(r[0], new, r[2], r[3], None if new is None else len(new))] += 1
    assert out == want


def hashes(spark, rows):
    return {r.t: r.h for r in spark.createDataFrame([(r[1],) for r in rows], "t STRING").selectExpr("t", "xxhash64(t) AS h").distinct().collect()}


def test_mixture_and_packing_against_their_plans(spark, sf, crawl):
    ids = {}
    docs = [(k, *r[1:]) for k, r in enumerate(crawl)]
    documents = pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841  read by the SQL
    want = {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, CASE WHEN size = 0 THEN -1 ELSE taken // size END FROM ({queries.oracle_sql()['op6_mixing']})").fetchall()}
    mixed = corpus_pipeline.mixing_stage(spark, spark.createDataFrame(docs, SCHEMA), sf)
    out = collected(mixed)
    for r in docs:
        ids[r[0]] = out[r]
        assert want[r[0]] in (-1, out[r])
    assert sum(ids.values()) == sum(out.values())
    packed = corpus_pipeline.packing_stage(spark, spark.createDataFrame(mixed.toPandas(), SCHEMA), sf).collect()
    used = defaultdict(list)
    for r in packed:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    bins = []
    for length in sorted((r.length for r in packed), reverse=True):  # best fit, longest first, over pieces
        fits = [k for k, free in enumerate(bins) if free >= length]
        if fits:
            bins[min(fits, key=bins.__getitem__)] -= length
        else:
            bins.append(1024 - length)
    assert len(used) <= len(bins)
