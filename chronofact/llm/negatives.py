"""Hard-negative mining by branch and bound over ball trees.

Vectors are cut into blocks by label, each small enough for a task, and every block has a ball tree of its own. A ball of centre c and
radius r holds inner products with a query q between q.c - |q| r and q.c + |q| r, so a node is left out when that interval misses the window
of scores asked for, or when its upper end lies strictly beneath the query's current k-th score. All queries of a block of queries go
down a tree together, as one matrix, and each of them takes the child of the greater bound first.

Queries meet every block that can hold answers for them, a block of queries at a time; each pair of blocks keeps k rows for a query, and
only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.llm.text import named
from chronofact.session import stored

#: Numbers in a block of vectors and of queries at most, unless LEAST rows have more; rows at most; rows of a leaf.
BLOCK_NUMBERS, BLOCK_ROWS, QUERY_ROWS, LEAST, LEAF = 2**20, 2048, 8192, 64, 32
#: Doubles hold integers exactly below this.
EXACT = 2.0**53
LONG = 2**63 - 1


def quantized(values: list, width: int) -> np.ndarray:
    """Rows of floor(256 x) as doubles; shorter vectors end in zeros."""
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return np.floor(256 * out)


class Tree:
    """A ball tree over the rows of x, halved at the median along the line between two far rows. Nodes are tuples of centre, radius, the
    least and greatest label, and either rows or two children."""

    def __init__(self, x: np.ndarray, labels: np.ndarray) -> None:
        self.x, self.labels = x, labels
        self.root = self._node(np.arange(len(x)))

    def _node(self, rows: np.ndarray) -> tuple:
        x = self.x[rows]
        centre = x.mean(axis=0)
        far = ((x - centre) ** 2).sum(axis=1)
        own = self.labels[rows]
        head = (centre, float(np.sqrt(far.max())), own.min(), own.max())
        if len(rows) <= LEAF or not far.max():
            return (*head, rows, None)
        a = x[far.argmax()]
        b = x[((x - a) ** 2).sum(axis=1).argmax()]
        order = np.argsort(x @ (b - a), kind="stable")
        half = len(rows) // 2
        return (*head, None, (self._node(np.sort(rows[order[:half]])), self._node(np.sort(rows[order[half:]]))))


class Search:
    """The first k rows of a tree for each query: the greatest scores from low to high, ties by the row's place.

    queries: vectors; of, low, high: for each asked window, its query and its bounds (integers as doubles, or infinite); labels: of the
    queries; same: whether rows have the query's label, or any other; skip: for each query, the row that is the query itself, or -1."""

    def __init__(self, tree: Tree, queries: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, labels: np.ndarray, same: bool, skip: np.ndarray, k: int) -> None:
        self.tree, self.q, self.of, self.low, self.high, self.labels, self.same, self.skip, self.k = tree, queries, of, low, high, labels, same, skip, k
        self.norm = np.sqrt((queries**2).sum(axis=1))
        self.score = np.full((len(of), k), -np.inf)
        self.row = np.full((len(of), k), -1)
        self.visited = 0
        self._down(tree.root, np.arange(len(of)))

    def _bounds(self, node: tuple, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that a row of the node can have, a little wider than rounding makes necessary."""
        of = self.of[asked]
        middle, reach = self.q[of] @ node[0], self.norm[of] * node[1]
        slack = 1e-9 * (np.abs(middle) + reach + self.norm[of] * np.sqrt((node[0] ** 2).sum())) + 1e-6
        return middle - reach - slack, middle + reach + slack

    def _open(self, node: tuple, asked: np.ndarray) -> np.ndarray:
        """Of the asked windows, those that a row of the node can still enter."""
        own = self.labels[self.of[asked]]
        fits = (own >= node[2]) & (own <= node[3]) if self.same else (own != node[2]) | (own != node[3])
        asked = asked[fits]
        least, most = self._bounds(node, asked)
        most = np.minimum(most, self.high[asked])
        return asked[(most >= self.low[asked]) & (least <= self.high[asked]) & (most >= self.score[asked, -1])]

    def _down(self, node: tuple, asked: np.ndarray) -> None:
        asked = self._open(node, asked)
        if not len(asked):
            return
        if node[5] is None:
            self._scan(node[4], asked)
            return
        left, right = node[5]
        first = self._bounds(left, asked)[1] >= self._bounds(right, asked)[1]
        self._down(left, asked[first])
        self._down(right, asked)
        self._down(left, asked[~first])

    def _scan(self, rows: np.ndarray, asked: np.ndarray) -> None:
        self.visited += len(rows) * len(asked)
        queries, back = np.unique(self.of[asked], return_inverse=True)
        score = self.q[queries] @ self.tree.x[rows].T
        alike = self.labels[queries][:, None] == self.tree.labels[rows][None, :]
        score[(alike != self.same) | (self.skip[queries][:, None] == rows[None, :])] = -np.inf
        score = score[back]
        score[(score < self.low[asked][:, None]) | (score > self.high[asked][:, None])] = -np.inf
        every = np.hstack([self.score[asked], score])
        place = np.hstack([self.row[asked], np.broadcast_to(rows, score.shape)])
        best = np.lexsort((place, -every), axis=1)[:, : self.k]
        self.score[asked], self.row[asked] = np.take_along_axis(every, best, 1), np.take_along_axis(place, best, 1)


def _by_hand(x: np.ndarray, labels: np.ndarray, q: np.ndarray, label: int, low, high, same: bool, skip: int, k: int) -> list[tuple[int, int]]:
    """The same for one window in whole numbers of any size, cut to longs: for vectors whose scores doubles can't hold."""
    own = [int(v) for v in q]
    scored = [(max(-LONG, min(LONG, -sum(a * int(b) for a, b in zip(own, x[i])))), i) for i in np.flatnonzero((labels == label) == same) if i != skip]
    return [(-s, i) for s, i in sorted(scored) if low <= -s <= high][:k]


def _windows(asked: pd.DataFrame, share: tuple[int, int, int] | None) -> tuple[np.ndarray, list, list, list]:
    """For each asked window its query, the positive's row and the bounds: all scores, or of * low <= by * score <= of * high."""
    if share is None:
        return np.arange(len(asked)), [-1] * len(asked), [-np.inf] * len(asked), [np.inf] * len(asked)
    of, positive, low, high = [], [], [], []
    for i, (rows, scores) in enumerate(zip(asked["positives"], asked["scores"])):
        for r, s in zip(rows, scores):
            of.append(i)
            positive.append(int(r))
            low.append(-((-share[0] * int(s)) // share[2]))
            high.append((share[1] * int(s)) // share[2])
    return np.array(of, dtype=int), positive, low, high


def _answers(same: bool, k: int, share: tuple[int, int, int] | None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What a task does with a block of vectors and a block of queries: anchor, positive (rows), id, row, score."""

    def answer(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"anchor": [], "positive": [], "id": [], "row": [], "score": []}).astype("int64")
        none["id"] = none["id"].astype("Int64")
        if block.empty or asked.empty:
            return none
        block = block.sort_values(["vec_id", "row"], na_position="last", ignore_index=True)  # places are the order of ties
        width = max(map(len, [*block["v"], *asked["v"]]))
        x, q = quantized(block["v"], width), quantized(asked["v"], width)
        labels, own = block["label"].to_numpy("int64"), asked["label"].to_numpy("int64")
        place = dict(zip(block["row"], range(len(block))))
        skip = np.array([place.get(r, -1) for r in asked["row"]])
        of, positive, low, high = _windows(asked, share)
        found = []
        if np.sqrt((x**2).sum(axis=1).max()) * np.sqrt((q**2).sum(axis=1).max()) < EXACT:
            done = Search(Tree(x, labels), q, of, np.array(low, dtype=float), np.array(high, dtype=float), own, same, skip, k)
            at, nth = np.nonzero(done.score > -np.inf)
            found = [(i, done.row[i, j], int(done.score[i, j])) for i, j in zip(at, nth)]
        else:
            for i, a in enumerate(of):
                found += [(i, r, s) for s, r in _by_hand(x, labels, q[a], own[a], low[i], high[i], same, skip[a], k)]
        if not found:
            return none
        window, rows, score = (np.array(c) for c in zip(*found))
        anchors = asked["row"].to_numpy()[of[window]]
        ids = block["vec_id"].astype("Int64").to_numpy()[rows]
        return pd.DataFrame({"anchor": anchors, "positive": np.array(positive)[window], "id": pd.array(ids, dtype="Int64"), "row": block["row"].to_numpy()[rows], "score": score})

    return answer


def usable(vectors: DataFrame) -> Column:
    """Rows that take part: a label, and a vector of finite components (also after the factor 256)."""
    return F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x * 256) < F.lit(float("inf")), F.lit(False)))


def blocks(vectors: DataFrame) -> DataFrame:
    """block, row, vec_id, label, v: rows in ranges of labels, written once so that a row's number holds."""
    spark = vectors.sparkSession
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    rows = max(LEAST, min(BLOCK_ROWS, BLOCK_NUMBERS // max(width or 1, 1)))
    cut = vectors.withColumn("_mix", F.xxhash64("vec_id", "v")).repartitionByRange(max(1, -(-n // rows)), "label", "_mix").drop("_mix")
    return stored(spark, cut.withColumn("block", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "vectors")


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(cut: DataFrame, queries: DataFrame, same: bool, k: int, share: tuple[int, int, int] | None = None) -> DataFrame:
    """anchor, positive, id, row, score, rank: the first k rows of cut (see blocks) for each query (row, label, v), or for each of the scores
    of its positives (arrays positives, scores) in the share (low, high, by) of it."""
    n, width = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    ranges = cut.groupBy("block").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    last = cut.agg(F.max("block")).first()[0]
    groups = max(1, -(-n // max(LEAST, min(QUERY_ROWS, 4 * BLOCK_NUMBERS // max(width or 1, 1)))))
    own = F.col("label")
    fits = own.between(F.col("least"), F.col("most")) if same else (own != F.col("least")) | (own != F.col("most"))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last or 0)))).join(ranges, "block").where(fits).drop("least", "most")
    whole = cut.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    tasks = (last or 0) + 1
    asked = asked.toDF(*asked.columns)  # columns of their own, as queries come from cut too
    pairs = whole.repartition(tasks * groups, "block", "part").groupBy("block", "part").cogroup(asked.repartition(tasks * groups, "block", "part").groupBy("block", "part"))
    found = pairs.applyInPandas(_answers(same, k, share), "anchor long, positive long, id long, row long, score long")
    return _first(found, ["anchor"] if share is None else ["anchor", "positive"], k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, share: tuple[int, int, int] = (30, 90, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from vectors (vec_id, label, embedding).

    Scores are inner products of vectors of whole numbers, floor(256 x); greater ones come first, of equal ones the lesser vec_id (a null one
    last). anchors: a condition on vec_id and label. An anchor's positives are its first `positives` other rows of the same label; for each of
    them come the first `negatives` rows of other labels with low * positive <= by * score <= high * positive, share being low, high, by.

    Rows with a null label, a null vector, or a component that is null or not finite (also after the factor) take no part. An empty vector
    has score 0 with all; of two vectors of unequal length the shorter ends in zeros. A row that repeats is a row of its own: it can be the
    positive of its copy, and as an anchor it has results of its own. Anchors without positives, and positives without rows in their window
    (such as all of negative score), give no rows. Scores beyond a long count as the greatest or
    least long, in order, windows and results. Other columns are ignored. An empty table gives an empty result."""
    spark = vectors.sparkSession
    rows = named(vectors, "vec_id", "label", "embedding").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    cut = blocks(rows.where(usable(rows)))
    asked = cut.where(anchors).select("row", "vec_id", "label", "v")
    near = stored(spark, search(cut, asked.drop("vec_id"), True, positives), "positives")
    given = near.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("row", "score")).alias("p"))  # a handful of each anchor
    given = given.select("row", F.col("p.row").alias("positives"), F.col("p.score").alias("scores"))
    far = search(cut, asked.drop("vec_id").join(given, "row"), False, negatives, share)
    pair = near.select("anchor", F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = far.select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(pair, ["anchor", "positive"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
