"""Operator 7, SimHash near-duplicates by vantage-point trees.

Fingerprints within 3 of 64 differing bits differ in at most one bit of their first or of their second half. So each half
has a tree of its own, searched with radius 1: a node holds a vantage point and a distance, children lie within or beyond
it. Distances in halves are spread more widely against a radius of 1 than whole ones against 3, so that far more branches
are pruned by the triangle bounds. The trees are fitted on the driver, on a bounded sample of distinct fingerprints. Every
distinct fingerprint then goes to its own leaf, and as a visitor to each leaf across a boundary that lies within the radius;
a leaf's task compares whole fingerprints (exactly, all pairs that can link meet in some leaf) and returns the links that
its own union-find needs, never all pairs of a group. Components come from rounds of stars over staged tables.

The sample's trees have a bounded number of leaves. Leaves with more than LEAF_FULL times the rows aimed at get a tree of their
own, fitted by a task on a bounded sample of that leaf's rows, and their rows and visitors go on to its leaves, for at most
ROUNDS rounds. What no tree can part (equal halves) and is over LEAF_SPLIT rows is dealt in blocks, each of which all of the
leaf's rows visit.

Equal fingerprints are one row throughout. Nothing but the sample and the first trees reaches the driver.

Cases: null and wordless texts have fingerprint zero, linked like any other; null ids are carried, and a component's id is
its smallest id that isn't null; repeated rows stay; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import hash_sample, own, staged

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Distinct fingerprints that fit the trees; vantage points tried for a node; rows of a leaf aimed at; rows of a leaf's block.
SAMPLE, TRIES, LEAF_ROWS, LEAF_SPLIT = 16_384, 12, 1024, 20_000
#: A leaf is split again beyond this many times the rows aimed at; its rows that fit its tree; rows that a task routes by it; depth of that tree; rounds.
LEAF_FULL, LEAF_SAMPLE, LEAF_CHUNK, SUB_DEPTH, ROUNDS = 8, 2_048, 200_000, 10, 4
_HALF = np.uint64(0xFFFFFFFF)
_ROUTED, _TREE = "leaf BIGINT, half INT, fp BIGINT, home BOOLEAN", "leaf BIGINT, point ARRAY<BIGINT>, within ARRAY<BIGINT>, near ARRAY<BIGINT>, far ARRAY<BIGINT>"


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
        hash64 = xxhash.xxh64_intdigest
        h = np.array([hash64(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, row: Column | None = None) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer; with `row`, a 64-bit number of the caller's for each row, also row."""
    names = ["doc_id", "fp"] if row is None else ["doc_id", "fp", "row"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], names)

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), text, *([] if row is None else [row.cast("bigint").alias("row")]))
    return rows.mapInArrow(run, ", ".join(f"{n} BIGINT" for n in names))


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays: vantage point, distance that is still within, and children (a leaf k is ~k)."""

    point: np.ndarray
    within: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, depth: int, radius: int, seed: int = 7) -> Tree:
        rng = np.random.default_rng(seed)
        point, within, near, far, leaves = [], [], [], [], 0

        def grow(rows: np.ndarray, left: int) -> int:
            nonlocal leaves
            best = None
            if left and len(rows) >= 8:
                for v in rng.choice(rows, min(TRIES, len(rows)), replace=False):
                    d = np.bitwise_count(rows ^ v)
                    share = np.cumsum(np.bincount(d, minlength=66)) / len(rows)
                    for m in np.flatnonzero((share >= 0.25) & (share <= 0.75)):
                        both = share[min(65, m + radius)] - (share[m - radius] if m >= radius else 0.0)  # of queries that go on to both sides
                        cost = (1 + both) * max(share[m], 1 - share[m])
                        if best is None or cost < best[0]:
                            best = (cost, v, m, d)
            if best is None:
                leaves += 1
                return ~(leaves - 1)
            _, v, m, d = best
            k = len(point)
            point.append(v)
            within.append(m)
            near.append(0)
            far.append(0)
            near[k] = grow(rows[d <= m], left - 1)
            far[k] = grow(rows[d > m], left - 1)
            return k

        grow(sample, depth)
        return Tree(np.array(point, np.uint64), np.array(within, np.int64), np.array(near, np.int64), np.array(far, np.int64))

    def route(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, leaf and whether it is the row's own, for each leaf that may hold something within the radius and each own one."""
        rows, node, home = np.arange(len(x)), np.full(len(x), 0 if len(self.point) else -1), np.ones(len(x), bool)
        out = []
        while len(rows):
            done = node < 0
            out.append((rows[done], ~node[done], home[done]))
            rows, node, home = rows[~done], node[~done], home[~done]
            d = np.bitwise_count(x[rows] ^ self.point[node]).astype(np.int64)
            m = self.within[node]
            near, far = d - radius <= m, d + radius > m
            own = d <= m
            rows, node, home = np.concatenate([rows[near], rows[far]]), np.concatenate([self.near[node[near]], self.far[node[far]]]), np.concatenate([(home & own)[near], (home & ~own)[far]])
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (rows, node, home)


def leaf_links(homes: np.ndarray, visitors: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among homes and between visitors and homes that connect what all such links connect; at most one for each row."""
    every = np.concatenate([homes, visitors])
    parent = np.arange(len(every))

    def roots(k: np.ndarray) -> np.ndarray:
        up = parent[k]
        while (more := parent[up] != up).any():
            up[more] = parent[up[more]]
        return up

    a, b = [], []
    step = max(1, 4_000_000 // max(1, len(homes)))
    for at in range(0, len(every), step):
        part = every[at : at + step]
        close = np.bitwise_count(part[:, None] ^ homes[None, :]) <= distance
        linked = np.flatnonzero(close.sum(axis=1) > (np.arange(at, at + len(part)) < len(homes)))
        for k in linked.tolist():
            own = at + k
            with_ = np.flatnonzero(close[k])
            up = roots(with_)
            first, where = np.unique(up, return_index=True)
            mine = int(roots(np.array([own]))[0])
            for r, w in zip(first.tolist(), where.tolist(), strict=True):
                if r != mine:
                    a.append(own)
                    b.append(int(with_[w]))
                    parent[max(r, mine)] = min(r, mine)
                    mine = min(r, mine)
    return every[a], every[b]


def _homes(routed: DataFrame) -> DataFrame:
    return routed.groupBy("leaf").agg(F.count(F.when(F.col("home"), 1)).alias("homes"))


def split(routed: DataFrame, full: DataFrame, radius: int, leaf_rows: int) -> tuple[DataFrame, DataFrame]:
    """routed's rows of leaves that stay as they are, and those of the leaves in `full` (leaf, homes; staged) in the leaves of a tree for each of them (staged).

    A leaf's tree is fitted on about LEAF_SAMPLE of its rows. Rows meet their leaf's tree in chunks of about LEAF_CHUNK, so that a
    task's part is bounded, whatever the leaf's size. Leaves whose sample no tree can part stay."""

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        fp = np.sort(table.column("fp").to_numpy().astype(np.int64)).view(np.uint64)
        half, homes = int(table.column("half")[0].as_py()), int(table.column("homes")[0].as_py())
        depth = min(SUB_DEPTH, int(np.ceil(np.log2(homes / leaf_rows))))
        tree = Tree.fit(np.unique((fp >> np.uint64(32 * half)) & _HALF), depth, radius)
        values = [tree.point.view(np.int64), tree.within, tree.near, tree.far]
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), **{n: pa.array([v], pa.list_(pa.int64())) for n, v in zip(("point", "within", "near", "far"), values, strict=True)}})

    def route(key: tuple, rows: pa.Table, trees: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows
        arrays = {n: np.array(trees.column(n)[0].as_py(), np.int64) for n in ("point", "within", "near", "far")}
        tree = Tree(arrays["point"].view(np.uint64), arrays["within"], arrays["near"], arrays["far"])
        fp, half = rows.column("fp").to_numpy().astype(np.int64).view(np.uint64), int(rows.column("half")[0].as_py())
        inside = rows.column("home").to_numpy(zero_copy_only=False).astype(bool)
        row, leaf, home = tree.route((fp >> np.uint64(32 * half)) & _HALF, radius)
        own = np.zeros(len(fp), np.int64)
        own[row[home]] = leaf[home]
        keep = home | ~inside[row] | (leaf > own[row])  # visitors from outside go wherever something near may be
        row, leaf, home = row[keep], leaf[keep], home[keep]
        new = (key[0].as_py() << SUB_DEPTH) + leaf
        return pa.table({"leaf": pa.array(new), "half": pa.array(np.full(len(row), half, np.int32)), "fp": pa.array(fp[row].view(np.int64)), "home": pa.array(home & inside[row])})

    sampled = routed.where("home").join(full, "leaf").where(F.pmod(F.xxhash64("fp"), F.lit(1 << 32)).cast("double") * F.col("homes") < float(LEAF_SAMPLE << 32))
    trees = staged(sampled.select("leaf", "half", "fp", "homes").groupBy("leaf").applyInArrow(fit, _TREE).where(F.size("point") > 0), "trees")
    sizes = staged(routed.join(trees.select("leaf"), "leaf", "left_semi").groupBy("leaf").agg((F.floor(F.count("*") / LEAF_CHUNK) + 1).cast("int").alias("chunks")), "sizes")
    rows = routed.join(sizes, "leaf").withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")).drop("chunks")
    copies = trees.join(sizes, "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    moved = rows.groupBy("leaf", "chunk").cogroup(copies.groupBy("leaf", "chunk")).applyInArrow(route, _ROUTED)
    return routed.join(trees.select("leaf"), "leaf", "left_anti").select("leaf", "half", "fp", "home"), staged(moved, "routed")


def links(distinct: DataFrame, *, distance: int = DISTANCE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """distinct: fp, each once, staged. Returns a, b: enough links within the distance to connect all that are connected by such links."""
    rows = distinct.count()
    radius = distance // 2
    depth = max(0, min(16, int(np.ceil(np.log2(max(1, rows) / leaf_rows)))))
    sample = np.array([r.fp for r in hash_sample(distinct.select("fp"), "fp", SAMPLE).collect()], np.int64).view(np.uint64)
    trees = [Tree.fit(np.unique((sample >> np.uint64(shift)) & _HALF), depth, radius) for shift in (0, 32)]

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for k, tree in enumerate(trees):
                row, leaf, home = tree.route((fp >> np.uint64(32 * k)) & _HALF, radius)
                own = np.zeros(len(fp), np.int64)
                own[row[home]] = leaf[home]
                keep = home | (leaf > own[row])  # of two leaves that visit each other one is enough
                half = np.full(int(keep.sum()), k, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(2 * leaf[keep] + k), pa.array(half), pa.array(fp[row[keep]].view(np.int64)), pa.array(home[keep])], ["leaf", "half", "fp", "home"])

    routed = staged(distinct.select("fp").mapInArrow(route, _ROUTED), "routed")
    done = []
    for _ in range(ROUNDS):
        full = staged(_homes(routed).where(F.col("homes") > LEAF_FULL * leaf_rows), "full")
        if full.isEmpty():
            break
        rest, routed = split(routed, full, radius, leaf_rows)
        done.append(rest)
    for k, rest in enumerate([*done, routed]):
        rest = rest.withColumn("level", F.lit(k))
        every = rest if k == 0 else every.unionAll(rest)
    blocks = every.groupBy("level", "leaf").agg((F.floor(F.count(F.when(F.col("home"), 1)) / LEAF_SPLIT) + 1).cast("int").alias("blocks"))
    big = blocks.where("blocks > 1")
    every = every.join(big, ["level", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = every.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("home", F.col("home") & (F.col("block") == mine))

    def compare(table: pa.Table) -> pa.Table:
        fp, home = table.column("fp").to_numpy().astype(np.int64).view(np.uint64), table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(fp, kind="stable")
        fp, home = fp[order], home[order]
        a, b = leaf_links(fp[home], fp[~home], distance)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return dealt.select("level", "leaf", "block", "fp", "home").groupBy("level", "leaf", "block").applyInArrow(compare, "a BIGINT, b BIGINT")


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE, row: Column | None = None) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the component) of every row; with `row` also row and component (a number of the component, even where no row of it has an id)."""
    prints = staged(fingerprints(df, doc_id=doc_id, text=text, shingle=shingle, row=row), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    label = components(links(distinct.select("fp"), distance=distance)).select(F.col("node").alias("fp"), "label")
    labelled = staged(distinct.join(label, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "labelled")
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of = labelled.join(ids, "label").select("fp", "component_id", F.col("label").alias("component"))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id", *([] if row is None else ["row", "component"]))


def one_of_each(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """df with one row of each component: of its smallest doc_id, or where no row has an id any; among several rows of that id the one with the smallest hash of all columns.

    Rows that are the same in all columns are first told from others by that hash and counted; those few that stay and occur again go through an aggregate of their own."""
    key, same, times = own("row", "doc_id", "times")
    hashed = F.xxhash64(*(F.col(c) for c in df.columns))
    found = staged(near_duplicates(df, doc_id=doc_id, text=text, distance=distance, shingle=shingle, row=hashed), "near")
    each = found.groupBy("component", "doc_id", "row").agg(F.count("*").alias("n"))
    first = each.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n")).alias("s"))
    first = staged(first.select(F.col("s.doc_id").alias(same), F.col("s.row").alias(key), F.col("s.n").alias(times)), "first")
    many = first.where(F.col(times) > 1)
    at = (hashed == F.col(key)) & F.col(doc_id).cast("bigint").eqNullSafe(F.col(same))
    once = df.join(first.where(F.col(times) == 1), at, "left_semi")
    if many.isEmpty():
        return once
    again = df.join(many, at).drop(same, times)
    values = [F.first(c).alias(c) for c in df.columns]
    return once.unionAll(again.groupBy(key, F.col(doc_id).alias(same)).agg(*values).select(*df.columns))


def hex_digits(fp_column: str = "fp"):  # noqa: ANN201
    return F.lpad(F.lower(F.hex(fp_column)), 16, "0")


