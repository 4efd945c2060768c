"""Operator 3, a quality classifier with hierarchical empirical Bayes.

A logistic regression over a document's own features (pairs of character classes, repetition of words, word pairs and lines)
is fitted on the driver on at most `most` labelled rows, chosen by a hash of their ids: a documented bound. Every document
of the corpus is then scored; sums of the scores by host and by path within a host, over all documents, give posteriors:
the strength of each prior comes from the spread of the groups' means (method of moments), so that a host with few documents
takes the corpus's mean and a path with few the host's. A document's verdict adds its own evidence and the log odds of its
path, host and corpus without it: its own score is taken out of their sums, so that it counts once.

Cases: null and empty texts have features of their own (all zero) and are judged like others; a null host or path is a group
like any other; a table without labels, or with labels of one kind, is judged by the prior alone and loses nothing; an
empty table gives no rows; repeated rows are judged alike; other columns are kept by judge() and clash with nothing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import hash_sample, own, staged

#: Labelled rows that the fit uses at most.
FIT_ROWS = 20_000
#: A document is rejected if its probability of being good is below this.
KEEP_FROM = 0.5
CLASSES = 12
_CLASS = np.full(256, 10, np.uint8)  # control characters
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"!?;:", b"'\"()[]{}-", b"#*$%&|<>@^~=+_\\/`")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 11
WIDTH = CLASSES * CLASSES + 5


def features(text: str | None) -> np.ndarray:
    out = np.zeros(WIDTH)
    data = (text or "").encode("utf-8", "surrogatepass")
    if len(data) > 1:
        kinds = _CLASS[np.frombuffer(data, np.uint8)]
        pairs = np.bincount(kinds[:-1] * np.uint8(CLASSES) + kinds[1:], minlength=CLASSES * CLASSES)
        out[: CLASSES * CLASSES] = np.sqrt(pairs / pairs.sum())
    words = data.split()
    n = len(words)
    if n > 1:
        out[-5] = np.log(len(set(words))) / np.log(n)
        out[-4] = len(set(zip(words, words[1:], strict=False))) / (n - 1)
        out[-3] = np.log(n) / 10
    lines = data.split(b"\n")
    out[-2] = 1 - len(set(lines)) / len(lines)
    out[-1] = len(max(words, key=len, default=b"")) > 40
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    base: float  # log odds of the sample

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 3.0, rounds: int = 40) -> Model:
        if len(y) == 0 or y.min() == y.max():
            return Model(np.zeros(WIDTH), np.zeros(WIDTH), np.ones(WIDTH), 0.0, 0.0)
        mean, scale = x.mean(0), x.std(0) + 1e-3
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (y - p) - penalty * w
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, g)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        return Model(w[:-1], mean, scale, float(w[-1]), float(np.log(rate / (1 - rate))))

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good against bad; the sample's base rate is taken out."""
        return np.clip((x - self.mean) / self.scale @ self.weights + self.bias - self.base, -30, 30)


def fit(df: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = FIT_ROWS) -> Model:
    """On at most `most` labelled rows; only their features come to the driver."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("__label"))
    chosen = hash_sample(chosen, "__id", most)  # 12 bytes a row: a proven bound for the broadcast

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([features(t).tolist() for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))], ["label", "x"])

    rows = df.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id").select("__text", F.col("__label").cast("int"))
    got = sorted((r.label, list(r.x)) for r in rows.mapInArrow(run, "label INT, x ARRAY<DOUBLE>").toLocalIterator())
    return Model.fit(np.array([g[1] for g in got]).reshape(-1, WIDTH), np.array([g[0] for g in got], float))


def with_evidence(df: DataFrame, model: Model, keep: list[str], *, text: str = "text", out: str) -> DataFrame:
    """The columns `keep` of df and `out`, the evidence of the whole text."""
    rows = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = np.array([features(t) for t in part.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(part.columns[: len(keep)], arrow, strict=False)), pa.array(model.evidence(x))], schema=arrow)

    return rows.mapInArrow(run, schema)


def _good(evidence: Column, base: float) -> Column:
    return 1 / (1 + F.exp(-(evidence + F.lit(base))))


def _strength(groups: DataFrame, mean: Column, towards: Column) -> Column:
    """Pseudo-documents of a prior: m (1 - m) over the spread of the groups' means beyond their own noise, less one."""
    n, m = F.col("n"), F.col("s") / F.col("n")
    spread = F.sum(n * (m - towards) * (m - towards)) / F.sum(n)
    noise = F.sum(mean * (1 - mean)) / F.sum(n)
    return F.greatest(F.lit(2.0), F.least(F.lit(1e4), F.avg(mean * (1 - mean)) / F.greatest(spread - noise, F.lit(1e-6)) - 1))


def posteriors(scores: DataFrame, base: float, *, host: str, path: str, evidence: str) -> DataFrame:
    """h, p, host_posterior, path_posterior, from all rows of `scores`: grouped sums, then shrinkage from the corpus to hosts to paths.

    Also what leaves a document out: rows and sums of the path (n, s), of the host (host_n, host_s), of the corpus (all_n, all_s), and the strengths of both priors (host_k, path_k)."""
    p = _good(F.col(evidence), base)
    paths = staged(scores.groupBy(F.col(host).alias("h"), F.col(path).alias("p")).agg(F.count("*").alias("n"), F.sum(p).alias("s")), "paths")
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    all_n, all_s = paths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0.0))).first()
    m = F.lit(all_s / all_n if all_n else 0.5)
    k = hosts.agg(_strength(hosts, m, m)).first()[0] or 2.0
    hosts = hosts.select(F.col("h").alias("hh"), F.col("n").alias("host_n"), F.col("s").alias("host_s"), F.lit(k).alias("host_k"), ((F.col("s") + k * m) / (F.col("n") + k)).alias("host_posterior"))
    paths = paths.join(hosts, F.col("h").eqNullSafe(F.col("hh"))).drop("hh")
    k = paths.agg(_strength(paths, F.col("host_posterior"), F.col("host_posterior"))).first()[0] or 2.0
    path = (F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)
    return paths.select("h", "p", "host_posterior", path.alias("path_posterior"), "n", "s", "host_n", "host_s", "host_k", F.lit(k).alias("path_k"), F.lit(all_n).cast("bigint").alias("all_n"), F.lit(float(all_s)).alias("all_s"))


def without_own(own_p: Column, g: Column) -> tuple[Column, Column]:
    """Posteriors of host and path, `g` a row of posteriors(), without a document whose probability is own_p. A corpus of nothing else has 0.5."""
    rest = lambda s: F.greatest(s - own_p, F.lit(0.0))  # noqa: E731  sums are rounded
    m = F.when(g["all_n"] > 1, F.least(rest(g["all_s"]) / (g["all_n"] - 1), F.lit(1.0))).otherwise(0.5)
    of_host = (rest(g["host_s"]) + g["host_k"] * m) / (g["host_n"] - 1 + g["host_k"])
    of_path = (rest(g["s"]) + g["path_k"] * of_host) / (g["n"] - 1 + g["path_k"])
    inside = lambda x: F.greatest(F.least(x, F.lit(1 - 1e-9)), F.lit(1e-9))
    return inside(of_host), inside(of_path)


def judge(df: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", keep_from: float = KEEP_FROM, most: int = FIT_ROWS, columns: list[str] | None = None) -> DataFrame:
    """`columns` of df (all unless told) with evidence, host_posterior, path_posterior, posterior and kept; columns of df with those names are replaced.

    Texts aren't shuffled: the corpus is scored once for the groups' sums and once more where its rows are needed."""
    model = fit(df, labels, doc_id=doc_id, text=text, label=label, most=most)
    names = ["evidence", "host_posterior", "path_posterior", "posterior", "kept"]
    columns = [c for c in (df.columns if columns is None else columns) if c not in names]
    e, h, p = own("evidence", "host", "path")
    df = df.withColumns({h: F.col(host), p: F.col(path)})
    slim = text not in columns
    scored = with_evidence(df, model, [*columns, h, p], text=text, out=e)
    scores = staged(scored if slim else with_evidence(df, model, [h, p], text=text, out=e), "scores")
    groups = staged(posteriors(scores, model.base, host=h, path=p, evidence=e), "posteriors")
    h2, p2, g = own("h", "p", "group")
    groups = groups.select(F.col("h").alias(h2), F.col("p").alias(p2), F.struct(*(c for c in groups.columns if c not in ("h", "p"))).alias(g))
    judged = (scores if slim else scored).join(groups, F.col(h).eqNullSafe(F.col(h2)) & F.col(p).eqNullSafe(F.col(p2)))
    of_host, of_path = without_own(_good(F.col(e), model.base), F.col(g))
    posterior = 1 / (1 + F.exp(-(F.col(e) + F.log(of_path / (1 - of_path)))))
    return judged.select(*columns, F.col(e).alias("evidence"), of_host.alias("host_posterior"), of_path.alias("path_posterior"), posterior.alias("posterior"), (posterior >= keep_from).alias("kept"))
