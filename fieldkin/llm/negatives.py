"""Hard-negative mining: scores of an anchor's neighbour in a spanning tree bound its own."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldkin.llm.common import LAST_ID, table
from fieldkin.session import keep

#: Anchors are rows with an identifier divisible by this.
EVERY = 100
POSITIVES, NEGATIVES = 5, 5
#: A negative scores between these percentages of its positive.
LOW, HIGH = 80, 100
#: A component becomes the whole part of so many times it.
SCALE = 256
#: Anchors of one tree, anchors and candidates that meet in one task, and candidates
#: that are bounded at a time.
TREE, BLOCK, SLOT, ROWS = 1_024, 1 << 15, 1 << 18, 1_024
#: Whole numbers that doubles hold exactly.
EXACT = float(1 << 53)
_LEAST = np.iinfo(np.int64).min


def spanning_tree(vectors: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Levels of nodes, each node's parent, and the length of the edge to it.

    A minimum spanning tree grown from the first vector; the root is its own parent.
    """
    count = len(vectors)
    squares = np.einsum("ij,ij->i", vectors, vectors)
    parent, edge = np.zeros(count, np.int64), np.full(count, np.inf)
    depth = np.zeros(count, np.int64)
    open_ = np.ones(count, bool)
    edge[0] = 0
    node = 0
    for _ in range(count - 1):
        open_[node] = False
        apart = squares + squares[node] - 2 * (vectors @ vectors[node])
        nearer = open_ & (apart < edge)
        edge[nearer] = np.maximum(apart[nearer], 0)
        parent[nearer] = node
        node = int(np.argmin(np.where(open_, edge, np.inf)))
        depth[node] = depth[parent[node]] + 1
    # Rounding never makes an edge shorter than it is.
    lengths = np.sqrt(edge + squares.max(initial=0) * 1e-12) if count else edge
    levels = [np.flatnonzero(depth == x) for x in range(int(depth.max(initial=0)) + 1)]
    return levels, parent, lengths


class Tree:
    """Anchors of one label, their windows, and the best rows found in each so far."""

    def __init__(self, rows, ids, label, vectors, scores: list[list[int]] | None, most: int, low: int, high: int):
        self.rows, self.ids, self.label, self.whole = rows, ids, label, vectors
        self.vectors = vectors.astype(np.float64)
        self.largest = float(np.abs(self.vectors).max(initial=0))
        self.levels, self.parent, self.lengths = spanning_tree(self.vectors)
        # Without scores to stay near, there is one window that ends nowhere.
        width = 1 if scores is None else max(map(len, scores), default=0)
        self.low = np.full((len(rows), width), _LEAST if scores is None else LAST_ID)
        self.high = np.full((len(rows), width), LAST_ID if scores is None else _LEAST)
        for node, listed in enumerate(scores or ()):
            for k, score in enumerate(listed):
                self.low[node, k], self.high[node, k] = -(-low * score // 100), high * score // 100
        self.most = most
        self.found: dict[str, np.ndarray] = {x: np.zeros(0, np.int64) for x in ("place", "score", "id", "row")}

    def meet(self, ids, rows, vectors, norms, largest) -> None:
        """Bound all candidates along the tree, and score those that may fall in a window."""
        exact = self.vectors.shape[1] * self.largest * largest < EXACT
        doubles = vectors.astype(np.float64)
        low = np.full((len(self.rows), len(ids)), -np.inf)
        high = np.full(low.shape, np.inf)
        hits: list[tuple] = []
        for depth, nodes in enumerate(self.levels):
            if depth:
                above = self.parent[nodes]
                slack = self.lengths[nodes, None] * norms[None, :] * (1 + 1e-9) + 1e-6
                slack += (np.abs(low[above]) + np.abs(high[above])) * 1e-15
                low[nodes], high[nodes] = low[above] - slack, high[above] + slack
            wanted = np.zeros((len(nodes), len(ids)), bool)
            for k in range(self.low.shape[1]):
                wanted |= (high[nodes] >= self.low[nodes, k, None]) & (low[nodes] <= self.high[nodes, k, None])
            if not wanted.any():
                continue
            if wanted.mean() > 0.25:
                scores = self.vectors[nodes] @ doubles.T if exact else self.whole[nodes] @ vectors.T
                low[nodes] = high[nodes] = scores
                at, which = None, None
            else:
                at, which = np.nonzero(wanted)
                pair = (self.vectors[nodes[at]], doubles[which]) if exact else (self.whole[nodes[at]], vectors[which])
                scores = np.einsum("ij,ij->i", *pair)
                low[nodes[at], which] = high[nodes[at], which] = scores
            for k in range(self.low.shape[1]):
                if at is None:
                    hit = (scores >= self.low[nodes, k, None]) & (scores <= self.high[nodes, k, None])
                    enough = self.most + 1  # the anchor itself may be one of them
                    if hit.sum() > 4 * enough * len(nodes) and len(ids) > enough:
                        least = np.partition(np.where(hit, scores, _LEAST), -enough, axis=1)[:, -enough, None]
                        hit &= scores >= least
                    x, y = np.nonzero(hit)
                    hits.append((nodes[x] * self.low.shape[1] + k, scores[x, y], y))
                else:
                    hit = (scores >= self.low[nodes[at], k]) & (scores <= self.high[nodes[at], k])
                    hits.append((nodes[at[hit]] * self.low.shape[1] + k, scores[hit], which[hit]))
        self._add(hits, ids, rows)

    def _add(self, hits: list[tuple], ids: np.ndarray, rows: np.ndarray) -> None:
        if not hits or not sum(len(x[0]) for x in hits):
            return
        place, score, which = (np.concatenate([x[n] for x in hits]).astype(np.int64) for n in range(3))
        other = rows[which] != self.rows[place // self.low.shape[1]]  # not the anchor itself
        new = {"place": place[other], "score": score[other], "id": ids[which[other]], "row": rows[which[other]]}
        every = {x: np.concatenate([self.found[x], new[x]]) for x in new}
        order = np.lexsort((every["row"], every["id"], -every["score"], every["place"]))
        place = every["place"][order]
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))[: len(place)]
        rank = np.arange(len(place)) - np.repeat(starts, np.diff(np.append(starts, len(place))))
        order = order[rank < self.most]
        self.found = {x: v[order] for x, v in every.items()}
        # A full window is worth entering with its last score only.
        full = rank == self.most - 1
        last = every["score"][np.lexsort((every["row"], every["id"], -every["score"], every["place"]))][full]
        self.low.ravel()[place[full]] = np.maximum(self.low.ravel()[place[full]], last)


def _matrix(column: pa.Array, width: int | None) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros, longer ones cut at ``width``."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0)) if width is None else width
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    for at, (start, length) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
        out[at, : min(length, width)] = values[start : start + min(length, width)]
    return out


def _met(same: bool, most: int, low: int, high: int):
    """Best candidates of each anchor of a block: of its own label, or of all others."""
    def trees(parts: list[pa.RecordBatch]) -> list[Tree]:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        rows, ids, labels = (whole.column(x).to_numpy() for x in ("row", "id", "label"))
        vectors = _matrix(whole.column("vector"), None)
        scores = None if same else whole.column("scores").to_pylist()
        # Like anchors side by side: by label, then by the signs of the leading components.
        signs = (vectors[:, :24] > 0) @ (1 << np.arange(min(24, vectors.shape[1]), dtype=np.int64))
        order = np.lexsort((rows, signs, labels))
        cuts = np.flatnonzero(np.diff(labels[order])) + 1
        out = []
        for part in np.split(order, cuts):
            for at in range(0, len(part), TREE):
                one = part[at : at + TREE]
                out.append(Tree(rows[one], ids[one], int(labels[one[0]]), vectors[one],
                                None if same else [scores[x] for x in one], most, low, high))
        return out

    def results(found: list[Tree]) -> Iterator[pa.RecordBatch]:
        for tree in found:
            width = tree.low.shape[1]
            node, k = tree.found["place"] // max(width, 1), tree.found["place"] % max(width, 1)
            columns = [tree.rows[node], tree.ids[node], k, *(tree.found[x] for x in ("id", "row", "score"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in columns], ["anchor_row", "anchor_id", "place", "id", "row", "score"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, anchors, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, slot, kind = (batch.column(x).to_numpy() for x in ("block", "slot", "kind"))
            changes = np.flatnonzero((np.diff(block) != 0) | (np.diff(slot) != 0) | (np.diff(kind) != 0)) + 1
            bounds = [0, *changes.tolist(), batch.num_rows]
            for start, end in zip(bounds[:-1], bounds[1:], strict=True):
                if group != (block[start], slot[start]):
                    yield from results(held or [])
                    group, anchors, held = (block[start], slot[start]), [], None
                part = batch.slice(start, end - start)
                if kind[start] == 0:
                    anchors.append(part)
                    continue
                if held is None:
                    held, anchors = trees(anchors) if anchors else [], []
                for at in range(0, part.num_rows if held else 0, ROWS):
                    _meet(held, part.slice(at, ROWS), same)
        yield from results(held or [])
    return met


def _meet(trees: list[Tree], part: pa.RecordBatch, same: bool) -> None:
    rows, ids, labels = (part.column(x).to_numpy() for x in ("row", "id", "label"))
    vectors = _matrix(part.column("vector"), trees[0].whole.shape[1])
    doubles = vectors.astype(np.float64)
    norms, largest = np.sqrt(np.einsum("ij,ij->i", doubles, doubles)), float(np.abs(doubles).max(initial=0))
    for tree in trees:
        chosen = (labels == tree.label) == same
        if chosen.any():
            tree.meet(ids[chosen], rows[chosen], vectors[chosen], norms[chosen], largest)


def _grid(anchors: DataFrame, candidates: DataFrame, blocks: int, slots: int) -> DataFrame:
    """Every block of anchors beside every slot of candidates, anchors first.

    Anchors are repeated once per slot and candidates once per block, so both sides
    grow with the root of the pairs that they make.
    """
    def place(count: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(count)).cast("int")

    def all_of(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    columns = ["row", "id", "label", "vector"]
    left = anchors.select(*columns, "scores", F.lit(0).alias("kind"), place(blocks, 1).alias("block")).withColumn("slot", all_of(slots))
    right = candidates.select(*columns, F.lit(None).cast("array<long>").alias("scores"), F.lit(1).alias("kind"),
                              place(slots, 2).alias("slot")).withColumn("block", all_of(blocks))
    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.unionByName(right).repartition(parts, "block", "slot").sortWithinPartitions("block", "slot", "kind")


def hard_negatives(data: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
                   label_column: str = "label", every: int = EVERY, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """Rows of other labels that score nearly as high as an anchor's best rows of its own.

    Components become whole numbers, ``floor(scale * x)``, and scores are inner
    products of those; they have to fit in 64 bits. Anchors are the rows whose
    identifier is divisible by ``every``. An anchor's positives are its ``positives``
    best other rows of its label; for each, the ``negatives`` best rows of other
    labels are returned that score from ``low`` to ``high`` per cent of it.

    Rows with a null label, a null vector, or a null or non-finite component take no
    part. Vectors of unequal length are compared as if zeros followed the shorter.
    Ties go to the smaller identifier, a missing one last, then to the earlier row;
    repeated rows are rows of their own. An empty table gives no rows.

    Anchors of one label form spanning trees. The inner product of a candidate with an
    anchor differs from that with the anchor's parent by at most the length of their
    edge times the candidate's norm, so bounds go down the tree, and only candidates
    whose bounds meet a window are scored; a scored candidate's bounds are its score.
    Every row meets every anchor in blocks; a task holds one block of anchors and
    reads its candidates past it.

    Columns: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``.
    """
    spark = data.sparkSession
    vector = F.col(vector_column)
    usable = F.col(label_column).isNotNull() & vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = keep(
        data.withColumn("__llm_row", F.monotonically_increasing_id()).where(usable).select(
            F.col("__llm_row").alias("row"),
            F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID)).alias("id"),
            F.col(label_column).cast("long").alias("label"),
            F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("vector"),
            F.coalesce(F.col(id_column) % every == 0, F.lit(False)).alias("anchor"),
        ), "vectors")
    sizes = rows.agg(F.count("*"), F.count_if("anchor")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(math.ceil(sizes[1] / BLOCK), 1)
    slots = max(math.ceil(sizes[0] / SLOT), min(math.ceil(sizes[0] / ROWS), 2 * parts), 1)
    schema = "anchor_row long, anchor_id long, place long, id long, row long, score long"
    best = ["anchor_row", "place"]

    def first(found: DataFrame, most: int) -> DataFrame:
        order = W.partitionBy(*best).orderBy(F.desc("score"), "id", "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    anchors = rows.where("anchor")
    near = _grid(anchors.withColumn("scores", F.lit(None).cast("array<long>")), rows, blocks, slots).mapInArrow(
        _met(True, positives, low, high), schema)
    listed = keep(
        first(near, positives).groupBy("anchor_row").agg(
            F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("own")), "positives")
    asked = anchors.join(listed, anchors["row"] == listed["anchor_row"]).drop("anchor_row").withColumn(
        "scores", F.transform("own", lambda x: x["score"]))
    hard = first(_grid(asked, rows, blocks, slots).mapInArrow(_met(False, negatives, low, high), schema), negatives)

    def id_of(value: Column) -> Column:
        return F.when(value != LAST_ID, value)

    own = F.get("own", F.col("place").cast("int"))
    return hard.join(listed, "anchor_row").select(
        "anchor_id", id_of(own["id"]).alias("positive_id"), "rank", id_of(F.col("id")).alias("negative_id"),
        own["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, directory: str) -> DataFrame:
    """Hard negatives of every hundredth vector; each seventh row has the next label."""
    data = table(spark, directory, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(data.withColumn("label", moved))


OP12_SQL = f"""
WITH vectors AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
scored AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM vectors a JOIN vectors r ON a.id <> r.id WHERE a.id % {EVERY} = 0),
positives AS (
  SELECT anchor_id, id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, p.id AS positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id))::INTEGER AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}
"""
