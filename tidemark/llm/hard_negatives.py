"""Hard negatives for anchors and positives, by bit-sliced integer products.

Components are integers. A block of rows is cut into bit planes, and the products with a block of anchors are summed
plane by plane, the most significant first. What the planes below can still add lies in an interval known from the
anchor alone, so each plane narrows every pair's score; a pair is dropped once its interval cannot reach the anchor's
k-th best lower bound (positives), or no positive's window or its third best certain member (negatives). Only pairs
that survive all planes have exact scores, and of those the first are taken.

Rows and anchors meet in blocks (each row block with each anchor block, one task a pair of blocks), where only the
first few rows of each anchor are sent on. No task holds more than a block of either side.

Rows whose id, label or vector is null, or with a null or non-finite component, take no part. Shorter vectors count as
filled up with zeros. Equal rows count once; rows of the anchor's own id are neither its positives nor negatives; rows
that share an id are rows of their own, and so are anchors that do. Higher scores come first, ties by smaller id and
then by a hash of the row. Scores that need more than 64 bits raise an error. A positive score below zero has no
negatives, and zero only those of score zero. Empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import load, materialize

_FOUND = "anchor_id long, anchor_key long, other_id long, other_key long, score long"
_MINED = "anchor_id long, anchor_key long, positive_id long, positive_key long, positive_score long, other_id long, other_key long, score long"
#: Anchors that go through the planes together, and the share of pairs from which on pairs are listed.
_SLICE, _SPARSE = 128, 1 / 8
_NEVER = np.iinfo(np.int64).min


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of an Arrow list column as rows of integers, shorter ones filled up with zeros."""
    arrays = column.combine_chunks()
    sizes = np.diff(arrays.offsets.to_numpy())
    flat = arrays.flatten().to_numpy().astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _even(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def bit_planes(rows: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Planes of zeros and ones in two's complement, the most significant first, and the weight of each."""
    bits = max(int(rows.max(initial=0)).bit_length(), int(-1 - rows.min(initial=-1)).bit_length()) + 1
    planes = [(rows >> b & 1).astype(np.float64) for b in range(bits - 1, -1, -1)]
    return planes, [-(1 << bits - 1)] + [1 << b for b in range(bits - 2, -1, -1)]


def kth_best(group: np.ndarray, value: np.ndarray, k: int, groups: int) -> np.ndarray:
    """The k-th largest value of each group; where there are fewer, the least number."""
    out = np.full(groups, _NEVER)
    order = np.lexsort((-value, group))
    at = np.flatnonzero(_rank(group[order]) == k - 1)
    out[group[order][at]] = value[order][at]
    return out


def _rank(sorted_groups: np.ndarray) -> np.ndarray:
    n = len(sorted_groups)
    new = np.ones(n, bool)
    new[1:] = sorted_groups[1:] != sorted_groups[:-1]
    first = np.flatnonzero(new)
    return np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))


class Bounded:
    """Pairs of some anchors with all rows of a block, and between which bounds their products lie."""

    def __init__(self, anchors: np.ndarray, planes: list[np.ndarray], weights: list[int], alive: np.ndarray):
        self.anchors, self.planes, self.weights = anchors, planes, weights
        self.plus, self.minus = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
        self.alive, self.sums = alive, np.zeros(alive.shape, np.int64)
        self.i = self.j = self.s = None
        self.left = 0

    def run(self, may: callable, keep: callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and score of the pairs that pass all planes.

        may(low, high) judges all pairs of anchors by rows; keep(i, low, high) the pairs listed.
        """
        factors = self.anchors.astype(np.float64)
        for plane, weight in zip(self.planes, self.weights):
            self.left = abs(weight) - 1
            if self.i is None:
                self.sums += weight * (factors @ plane.T).astype(np.int64)
                self.alive &= may(self.sums + (self.left * self.minus)[:, None], self.sums + (self.left * self.plus)[:, None])
                if self.alive.mean() <= _SPARSE:
                    self._list()
            else:
                for lo in range(0, len(self.i), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    self.s[part] += weight * np.einsum("ij,ij->i", factors[self.i[part]], plane[self.j[part]]).astype(np.int64)
            if self.i is not None:
                self._drop(keep)
        if self.i is None:
            self._list()
            self._drop(keep)
        return self.i, self.j, self.s

    def _list(self) -> None:
        self.i, self.j = np.nonzero(self.alive)
        self.s = self.sums[self.i, self.j]
        self.sums = self.alive = None

    def _drop(self, keep) -> None:
        good = keep(self.i, self.s + self.left * self.minus[self.i], self.s + self.left * self.plus[self.i])
        self.i, self.j, self.s = self.i[good], self.j[good], self.s[good]


def _fitting(anchors: np.ndarray, rows: np.ndarray) -> None:
    """Partial sums and bounds stay exact: one plane's in doubles, all of them in 64 bits."""
    widest = int(np.abs(anchors).sum(1, dtype=np.float64).max(initial=0)) + 1
    largest = 1 << max(int(rows.max(initial=0)).bit_length(), int(-1 - rows.min(initial=-1)).bit_length()) + 1
    if widest >= 1 << 53 or widest * largest >= 1 << 62:
        raise OverflowError("products of these vectors do not fit 64 bits")


def _cell(row_table: pa.Table, anchor_table: pa.Table):
    rows, anchors = _even(_matrix(row_table["vector"]), _matrix(anchor_table["vector"]))
    _fitting(anchors, rows)
    ids = [t[c].to_numpy() for t in (row_table, anchor_table) for c in ("id", "key", "label")]
    return rows, anchors, *ids


def _nearest(k: int):
    """In a pair of blocks: each anchor's first k rows of its own label."""

    def nearest(row_table: pa.Table, anchor_table: pa.Table) -> pa.Table:
        out = []
        if row_table.num_rows and anchor_table.num_rows:
            rows, anchors, ids, keys, labels, a_ids, a_keys, a_labels = _cell(row_table, anchor_table)
            for label in np.unique(a_labels):
                mine, own = np.flatnonzero(labels == label), np.flatnonzero(a_labels == label)
                if not len(mine):
                    continue
                planes, weights = bit_planes(rows[mine])
                for lo in range(0, len(own), _SLICE):
                    some = own[lo : lo + _SLICE]
                    pairs = Bounded(anchors[some], planes, weights, a_ids[some, None] != ids[None, mine])

                    def may(low, high, pairs=pairs):
                        if low.shape[1] <= k:
                            return np.ones(low.shape, bool)
                        known = np.where(pairs.alive, low, _NEVER)
                        return high >= np.partition(known, -k, axis=1)[:, -k, None]

                    i, j, s = pairs.run(may, lambda i, low, high, n=len(some): high >= kth_best(i, low, k, n)[i])
                    i, j = some[i], mine[j]
                    order = np.lexsort((keys[j], ids[j], -s, i))
                    order = order[_rank(i[order]) < k]
                    i, j, s = i[order], j[order], s[order]
                    out.append((a_ids[i], a_keys[i], ids[j], keys[j], s))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["anchor_id", "anchor_key", "other_id", "other_key", "score"])

    return nearest


def _windows(tables: pa.Table) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """Least and largest score of a negative of each anchor's positives; positives that allow none have an empty window."""
    lists = tables["positives"].to_pylist()
    width = max(len(x) for x in lists)
    low, high = np.full((len(lists), width), np.iinfo(np.int64).max), np.full((len(lists), width), _NEVER)
    for i, positives in enumerate(lists):
        for w, p in enumerate(positives):
            # 50 p <= 100 n <= 95 p
            low[i, w], high[i, w] = -(-p["score"] // 2), 19 * p["score"] // 20
    return low, high, lists


def _hard(k: int):
    """In a pair of blocks: for each anchor and positive, the first k rows of another label in the positive's window."""

    def hard(row_table: pa.Table, anchor_table: pa.Table) -> pa.Table:
        out = []
        if row_table.num_rows and anchor_table.num_rows:
            rows, anchors, ids, keys, labels, a_ids, a_keys, a_labels = _cell(row_table, anchor_table)
            planes, weights = bit_planes(rows)
            least, most, positives = _windows(anchor_table)
            for lo in range(0, len(anchors), _SLICE):
                some = np.arange(lo, min(lo + _SLICE, len(anchors)))
                low_w, high_w = least[some], most[some]
                bottom, top = low_w.min(1)[:, None], high_w.max(1)[:, None]
                pairs = Bounded(anchors[some], planes, weights, (a_labels[some, None] != labels[None]) & (a_ids[some, None] != ids[None]))

                def keep(i, low, high, low_w=low_w, high_w=high_w):
                    good = np.zeros(len(i), bool)
                    for w in range(low_w.shape[1]):
                        a, b = low_w[i, w], high_w[i, w]
                        sure = (low >= a) & (high <= b)
                        good |= (high >= a) & (low <= b) & (high >= kth_best(i[sure], low[sure], k, len(low_w))[i])
                    return good

                i, j, s = pairs.run(lambda low, high, a=bottom, b=top: (high >= a) & (low <= b), keep)
                for w in range(low_w.shape[1]):
                    fit = np.flatnonzero((s >= low_w[i, w]) & (s <= high_w[i, w]))
                    order = fit[np.lexsort((keys[j[fit]], ids[j[fit]], -s[fit], i[fit]))]
                    for t in order[_rank(i[order]) < k].tolist():
                        a, p = some[i[t]], positives[some[i[t]]][w]
                        out.append((a_ids[a], a_keys[a], p["id"], p["key"], p["score"], ids[j[t]], keys[j[t]], s[t]))
        names = ["anchor_id", "anchor_key", "positive_id", "positive_key", "positive_score", "other_id", "other_key", "score"]
        cols = list(zip(*out)) or [()] * 8
        return pa.table([pa.array(c, pa.int64()) for c in cols], names)

    return hard


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id", "other_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 3, row_block: int = 4096, anchor_block: int = 2048) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for rows(id long, label, vector array<long>).

    is_anchor is a SQL condition over id and label. ``row_block`` and ``anchor_block`` bound what a task holds.
    """
    known = "id is not null and label is not null and vector is not null and forall(vector, x -> x is not null)"
    clean = rows.select("id", F.col("label").cast("long"), "vector").where(known).withColumn("key", F.xxhash64("label", "vector"))
    clean = materialize(clean.dropDuplicates(["id", "label", "vector"]), "vectors")
    anchors = clean.where(is_anchor)
    row_blocks, anchor_blocks = max(1, -(-clean.count() // row_block)), max(1, -(-anchors.count() // anchor_block))
    block = lambda n: F.pmod(F.xxhash64("id", "key"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = clean.withColumn("row_block", block(row_blocks)).withColumn("anchor_block", each(anchor_blocks))
    cells = placed.groupBy("row_block", "anchor_block")

    def meeting(some: DataFrame):
        some = some.select(*[F.col(c).alias(c) for c in some.columns])  # columns of its own, as both sides stem from one table
        return some.withColumn("anchor_block", block(anchor_blocks)).withColumn("row_block", each(row_blocks)).groupBy("row_block", "anchor_block")

    near = _first(cells.cogroup(meeting(anchors)).applyInArrow(_nearest(positives), _FOUND), ["anchor_id", "anchor_key"], positives)
    chosen = near.groupBy("anchor_id", "anchor_key").agg(F.collect_list(F.struct(F.col("other_id").alias("id"), F.col("other_key").alias("key"), "score")).alias("positives"))
    chosen = chosen.withColumnsRenamed({"anchor_id": "id", "anchor_key": "key"})
    asking = anchors.join(chosen, ["id", "key"]).select("id", "label", "vector", "key", "positives")
    mined = cells.cogroup(meeting(asking)).applyInArrow(_hard(negatives), _MINED)
    best = _first(mined, ["anchor_id", "anchor_key", "positive_id", "positive_key"], negatives)
    return best.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def integers(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """id, label and vector of floor(scale * component); rows with a null or non-finite component are left out."""
    finite = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return embeddings.where(finite).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(load(spark, sf_dir, "embeddings"))
    moved = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, "id % 50 = 0")


OP12_SQL = """
WITH e AS MATERIALIZED (
    SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
    FROM e a JOIN e r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, p.other_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other_id AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n USING (anchor_id)
WHERE NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER w <= 3
"""
