"""Clusters of differing density, by a hierarchy of density levels instead of one reach.

After Campello, Moulavi and Sander (2013).  The core distance of a row is the distance within which ``min_pts`` rows
lie, itself included; two rows are joined at the largest of their core distances and their distance.  Rows joined at
lower and lower density form a tree.  A part with at least ``min_size`` rows is a cluster as long as it loses only
smaller parts, and ends where it falls into two or more parts of that size, or into none.  Of a cluster and the
clusters below it, those that hold together longer (stability: rows times inverse distance) are the result.

Three steps, none of which holds the rows in one place.  Links: the index of balls ships vectors in reach, and the
reach doubles; tasks return only minimum spanning forests between the parts joined so far.  Parts: Borůvka rounds on
written tables, in which every part of under ``min_size`` rows goes to its nearest other part.  Tree: what is left
are parts that are clusters, at most rows / ``min_size`` of them; one task orders their links, and rows find
their cluster by joins with its table of ancestors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.graph import components, spanning_forest, stars_of_task
from reviewloom.operators.vector_blocks import GROUP_ROWS, Rows, build_index, gaps, in_reach, matrix, over_reach
from reviewloom.session import materialise

BLOCK = 1024  # rows handled at a time inside a task
#: Distances are rounded to these places, so that they do not depend on how rows are dealt to tasks, and are no less than
#: ``LEAST``.  Unit vectors are no more than ``MOST`` apart; a core distance above the reach is ``UNKNOWN``.
PLACES, LEAST, MOST, UNKNOWN = 7, 1e-6, 2.0, 9.0
#: Rows of the sample that the first reach is taken from.
SAMPLE_ROWS = 2048

_EDGE = "a long, b long, w double"


def minimum_forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of a minimum spanning forest; of equal weights those of smaller nodes come first."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a, w))
    a, b, w = a[order], b[order], w[order]
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    left, kept = np.flatnonzero(x != y), []
    while len(left):
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, x[left], left)
        np.minimum.at(best, y[left], left)
        new = np.unique(best[best < len(a)])
        kept.append(new)
        root = np.arange(len(nodes))
        node, low = spanning_forest(x[new], y[new])
        root[node] = low
        x, y = root[x], root[y]
        left = left[x[left] != y[left]]
    rows = np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
    return a[rows], b[rows], w[rows]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(np.round(gaps(a, b), PLACES), LEAST)


def _per_row(rows: Rows, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.asarray(b[name], kind) for b in rows.blocks])


def _lowest_by(w: np.ndarray, labels: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """The lowest entry of ``w`` for every label of an axis, and the labels."""
    order = np.argsort(labels, kind="stable")
    starts = np.flatnonzero(np.diff(labels[order], prepend=labels[order[0]] - 1))
    if len(starts) == len(labels):
        return np.take(w, order, axis=axis), labels[order]
    return np.minimum.reduceat(np.take(w, order, axis=axis), starts, axis=axis), labels[order][starts]


class Links:
    """A forest of lowest links that grows.  New links are held back until they are as many as the forest."""

    def __init__(self):
        self.forest = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        self.new: list[tuple] = []
        self.held = 0
        self._settle()

    def _settle(self) -> None:
        a, b, w = self.forest
        self.nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = codes[: len(a)], codes[len(a) :]
        self.tree = np.arange(len(self.nodes))
        node, low = spanning_forest(x, y)
        self.tree[node] = low
        self.most = np.zeros(len(self.nodes))  # the greatest weight of each tree
        np.maximum.at(self.most, self.tree[x], w)

    def add(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        self.new.append((a, b, w))
        self.held += len(a)
        if self.held > max(1 << 14, len(self.forest[0])):
            self.joined()

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.held:
            self.forest = minimum_forest(*(np.concatenate(c) for c in zip(self.forest, *self.new, strict=True)))
            self.new, self.held = [], 0
            self._settle()
        return self.forest

    def known(self, part: int, others: np.ndarray, most: float) -> np.ndarray:
        """The weights of the links from ``part`` to ``others``, ``most`` where there is none."""
        a, b, w = self.forest
        here = (a == part) | (b == part)
        other, w = np.where(a[here] == part, b[here], a[here]), w[here]
        if not len(other):
            return np.full(len(others), most)
        order = np.argsort(other)
        at = order[np.minimum(np.searchsorted(other, others, sorter=order), len(order) - 1)]
        return np.where(other[at] == others, w[at], most)

    def useful(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whether each link of weight ``w`` from a part of ``x`` to that of a column can be in the forest: it is not if
        another link to the column's part and the tree that holds both ends of these two are all lower."""
        at = np.minimum(np.searchsorted(self.nodes, x), max(0, len(self.nodes) - 1))
        inside = self.nodes[at] == x if len(self.nodes) else np.zeros(len(x), bool)
        tree = np.where(inside, self.tree[at] if len(self.nodes) else 0, -1 - np.arange(len(x)))  # else a tree by itself
        most = np.where(inside, self.most[np.maximum(tree, 0)] if len(self.nodes) else 0.0, 0.0)
        lowest, trees = _lowest_by(w, tree, 0)
        return w <= np.maximum(lowest[np.searchsorted(trees, tree)], most[:, None])


def first_reach(points: DataFrame) -> float:
    """A reach to begin with, under most distances of nearest rows in a sample; it sets the number of passes and not the
    result."""
    some = points.select(F.xxhash64("unit").alias("h"), "id", "unit").orderBy("h", "id").limit(SAMPLE_ROWS)
    unit = matrix(some.select("unit").toArrow().combine_chunks().column("unit").chunk(0))
    gap = gaps(unit, unit)
    np.fill_diagonal(gap, MOST)
    return float(np.clip(np.quantile(gap.min(axis=1), 0.25), 1e-3, 0.5))


def joined_levels(points: DataFrame, n_points: int, min_pts: int, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, n, core) and links (a, b, w) that join them as all pairs of rows would.

    ``points`` are distinct vectors (id, n, unit).  A pass with the reach r finds the core distances up to r, a second one
    links the parts joined so far at weights up to r.  The reach doubles until the rows outside the largest part are
    fewer than ``min_size`` and can make no cluster.  Links name a part by its smallest row.
    """
    spark = points.sparkSession
    reach = first_reach(points)
    group_rows = min(GROUP_ROWS, max(256, n_points // (4 * spark.sparkContext.defaultParallelism)))
    index = build_index(points, n_points, BLOCK, reach, group_rows)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, n = (np.frombuffer(row[c], "<i8") for c in ("ids", "n"))
                fixed = [np.full(len(ids), row[c]) for c in ("block", "home")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, n, *fixed, np.arange(len(ids)))], ["id", "n", "block", "home", "pos"])

    rows = index.blocks.select("ids", "n", "block", "home").mapInArrow(listed, "id long, n long, block long, home long, pos long")
    state = materialise(rows.select("*", F.lit(UNKNOWN).alias("core"), F.col("id").alias("part")), "rows")
    total = state.agg(F.sum("n")).first()[0]
    links = None
    while True:
        unknown = state.filter(F.col("core") == UNKNOWN).select(F.col("home").alias("want")).distinct()
        found = _core_distances(index, reach, min_pts, unknown, None if links is None else state)
        cores = materialise(found, "cores").withColumnRenamed("core", "found")
        state = state.join(cores, "id", "left").withColumn("core", F.least("core", F.coalesce("found", F.lit(UNKNOWN)))).drop("found")
        state = materialise(state, "rows")
        new = materialise(_links(index, reach, state), "links")
        links = new if links is None else links.unionByName(new)
        # stars first, so that long ways within a task take no rounds
        roots = components(new.select("a", "b").mapInArrow(stars_of_task, "node long, root long").toDF("a", "b"), "parts")
        state = state.join(roots, F.col("part") == F.col("node"), "left").withColumn("part", F.coalesce("root", "part")).drop("node", "root")
        state = materialise(state, "rows")
        largest = state.groupBy("part").agg(F.sum("n").alias("size")).agg(F.max("size")).first()[0]
        if total - largest < min_size or reach >= MOST:
            return state.select("id", "n", "core"), links
        reach = min(2 * reach, MOST)


def _lists(state: DataFrame, *columns: str) -> DataFrame:
    """The columns of the rows of each block, in order."""
    places = F.array_sort(F.collect_list(F.struct("pos", *columns)))  # the rows of one block, BLOCK at most
    return state.groupBy("block").agg(places.alias("row")).select("block", *[F.col(f"row.{c}").alias(c) for c in columns])


def _core_distances(index, reach: float, min_pts: int, wanted: DataFrame, state: DataFrame | None) -> DataFrame:
    """(id, core) of the rows in the groups ``wanted`` whose core distance is at most ``reach`` and not known by ``state``."""
    extra, all_open = None if state is None else _lists(state, "core"), state is None

    def begin(own: Rows) -> dict:
        shape = len(own.ids), min_pts
        open_ = np.ones(len(own.ids), bool) if all_open else _per_row(own, "core", float) == UNKNOWN
        return {"gap": np.full(shape, UNKNOWN), "n": np.ones(shape, np.int64), "open": open_}

    def meet(state: dict, at: int, strip: Rows, others: Rows) -> None:
        rows = np.flatnonzero(state["open"][at : at + len(strip.ids)])
        for a in range(0, len(others.ids) if len(rows) else 0, BLOCK):
            most = np.minimum(state["gap"][at + rows].max(axis=1), reach)
            near = in_reach(strip.unit[rows], others.unit[a : a + BLOCK], most[:, None])
            some = rows[near.any(axis=1)]
            if not len(some):
                continue
            here = at + some
            gap = np.hstack([state["gap"][here], _distances(strip.unit[some], others.unit[a : a + BLOCK])])
            n = np.hstack([state["n"][here], np.broadcast_to(others.n[a : a + BLOCK], (len(some), gap.shape[1] - min_pts))])
            near = np.argpartition(gap, min_pts - 1, axis=1)[:, :min_pts]
            state["gap"][here], state["n"][here] = np.take_along_axis(gap, near, 1), np.take_along_axis(n, near, 1)

    def end(state: dict, own: Rows) -> pa.RecordBatch:
        order = np.argsort(state["gap"], axis=1)
        gap, n = np.take_along_axis(state["gap"], order, 1), np.take_along_axis(state["n"], order, 1)
        core = gap[np.arange(len(gap)), (np.cumsum(n, axis=1) >= min_pts).argmax(axis=1)]
        found = (core <= reach) & state["open"]
        return pa.RecordBatch.from_arrays([pa.array(own.ids[found]), pa.array(core[found])], ["id", "core"])

    return over_reach(index, reach, "id long, core double", begin, meet, end, extra, wanted=wanted)


def _links(index, reach: float, state: DataFrame) -> DataFrame:
    """Forests of the lowest links up to ``reach`` between different parts, one for each group of the index."""

    def begin(own: Rows) -> dict:
        return {"core": _per_row(own, "core", float), "part": _per_row(own, "part", np.int64), "links": Links()}

    def meet(state: dict, at: int, strip: Rows, others: Rows) -> None:
        part, core = _per_row(others, "part", np.int64), _per_row(others, "core", float)
        own_part, own_core = (state[c][at : at + len(strip.ids)] for c in ("part", "core"))
        mine = own_core <= reach
        # the group of smaller number takes the links between two groups
        theirs = np.flatnonzero((core <= reach) & (others.home >= strip.home[0]))
        if not mine.any() or not len(theirs):
            return
        labels, times = np.unique(own_part[mine], return_counts=True)
        main = labels[times.argmax()]  # rows of the strip's largest part meet other parts only
        for rows, columns in ((mine & (own_part == main), theirs[part[theirs] != main]), (mine & (own_part != main), theirs)):
            rows = np.flatnonzero(rows)
            for a in range(0, len(columns) if len(rows) else 0, BLOCK):
                some = columns[a : a + BLOCK]
                most = np.full(len(some), reach)
                if own_part[rows[0]] == main:
                    most = state["links"].known(main, part[some], reach)
                near = in_reach(strip.unit[rows], others.unit[some], most) & (own_part[rows][:, None] != part[some])
                x, y = rows[near.any(axis=1)], some[near.any(axis=0)]
                if len(x):
                    join(state["links"], own_part[x], own_core[x], strip.unit[x], part[y], core[y], others.unit[y])

    def join(links: Links, x: np.ndarray, x_core: np.ndarray, x_unit: np.ndarray, y: np.ndarray, y_core: np.ndarray, y_unit: np.ndarray) -> None:
        w = np.maximum(np.maximum(_distances(x_unit, y_unit), x_core[:, None]), y_core)
        w, x = _lowest_by(w, x, 0)
        w, y = _lowest_by(w, y, 1)
        w[x[:, None] == y] = np.inf
        i, j = np.nonzero((w <= reach) & links.useful(w, x))
        links.add(x[i], y[j], w[i, j])

    def end(state: dict, own: Rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in state["links"].joined()], ["a", "b", "w"])

    return over_reach(index, reach, _EDGE, begin, meet, end, _lists(state, "core", "part"))


def _between(links: DataFrame) -> DataFrame:
    """The lowest link of every two parts."""
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").filter("a <> b")
    return pairs.groupBy("a", "b").agg(F.min("w").alias("w"))


def contracted(rows: DataFrame, links: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Rows as (id, n, part, w): joined to the part at weight w; and the links between parts.

    Borůvka rounds.  The next part that a part is joined with is across its lowest link, at weight v.  A part with fewer
    than ``min_size`` rows joined below v goes there, and its rows are joined to the new part at v or at their later
    weight.  Along a way of such steps weights fall, so each part reaches the end of its way at its own v.  Parts left
    at the end have ``min_size`` rows before they are joined with others, or no link.
    """
    rows = materialise(rows.select("id", "n", F.col("id").alias("part"), F.col("core").alias("w")), "joined")
    links = materialise(_between(links), "between")
    while True:
        both = links.select("a", "b", "w").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        lowest = both.groupBy("a").agg(F.min(F.struct("w", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))).alias("m"))
        lowest = lowest.select("a", F.when(F.col("a") == F.col("m.x"), F.col("m.y")).otherwise(F.col("m.x")).alias("to"), F.col("m.w").alias("v"))
        lowest = materialise(lowest, "lowest")
        large = rows.join(lowest, F.col("part") == F.col("a")).filter("w < v").groupBy("a").agg(F.sum("n").alias("size"))
        steps = materialise(lowest.join(large.filter(F.col("size") >= min_size), "a", "left_anti"), "steps")
        if steps.isEmpty():
            return rows, links
        # of two parts that go to each other the smaller stays
        back = steps.select(F.col("a").alias("to"), F.col("to").alias("a"), F.lit(True).alias("mutual"))
        steps = steps.join(back, ["a", "to"], "left").filter("mutual is null or a > to").select("a", "to", "v")
        while True:
            steps = materialise(steps, "steps")
            onward = steps.select(F.col("a").alias("to"), F.col("to").alias("further"))
            further = steps.join(onward, "to", "left")
            if further.filter("further is not null").isEmpty():
                break
            steps = further.select("a", F.coalesce("further", "to").alias("to"), "v")
        moved = rows.join(steps, F.col("part") == F.col("a"), "left")
        rows = materialise(moved.select("id", "n", F.coalesce("to", "part").alias("part"), F.greatest("w", "v").alias("w")), "joined")
        for end in ("a", "b"):
            ways = steps.select(F.col("a").alias("from"), "to")
            links = links.join(ways, F.col(end) == F.col("from"), "left").withColumn(end, F.coalesce("to", end)).drop("from", "to")
        links = materialise(_between(links), "between")


def _whole(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(list(batches))
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _forest_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    for batch in batches:
        forest = minimum_forest(*(np.append(old, batch.column(i).to_numpy()) for i, old in enumerate(forest)))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in forest], ["a", "b", "w"])


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The clusters over the parts (a = b, w: where they have the least size) and their links, with their ancestors at
    steps of 1, 2, 4, ... and the weight up to which a row stays below these."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    edges = _whole(batches)
    a, b, w = edges["a"], edges["b"], edges["w"]
    leaf = a == b
    label = np.sort(a[leaf])
    low = w[leaf][np.argsort(a[leaf])].tolist()
    parent, up = [-1] * len(label), [np.inf] * len(label)
    forest = minimum_forest(np.searchsorted(label, a[~leaf]), np.searchsorted(label, b[~leaf]), w[~leaf])
    above = list(range(len(label)))  # links of leaves, to the leaf that stands for their cluster

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    cluster = list(range(len(label)))
    weights = np.unique(forest[2])
    bounds = np.searchsorted(forest[2], np.append(weights, np.inf))
    for weight, i, j in zip(weights.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        ends = np.append(forest[0][i:j], forest[1][i:j]).tolist()
        before = {top(x) for x in ends}
        for x, y in zip(forest[0][i:j].tolist(), forest[1][i:j].tolist(), strict=True):
            x, y = top(x), top(y)
            above[max(x, y)] = min(x, y)
        made: dict[int, int] = {}
        for x in sorted(before):
            root = top(x)
            if root not in made:
                made[root] = len(low)
                low.append(weight)
                up.append(np.inf)
                parent.append(-1)
            parent[cluster[x]], up[cluster[x]] = made[root], weight
        for root, number in made.items():
            cluster[root] = number
    jump, limit = np.array(parent), np.array(up)
    jump = np.where(jump < 0, np.arange(len(jump)), jump)
    jumps, limits = [jump], [limit]
    while not np.array_equal(jump[jump], jump):
        limit, jump = np.maximum(limit, limit[jump]), jump[jump]
        jumps.append(jump)
        limits.append(limit)
    labels = pa.array(label.tolist() + [None] * (len(low) - len(label)), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(low))), labels, pa.array(parent, pa.int64()), pa.array(low, pa.float64()), pa.array(up, pa.float64()),
         pa.array(np.stack(jumps, axis=1).tolist(), pa.list_(pa.int64())), pa.array(np.stack(limits, axis=1).tolist(), pa.list_(pa.float64()))],
        ["cluster", "label", "parent", "low", "up", "jumps", "limits"],
    )


def _selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, chosen): the most stable clusters, each cluster with the chosen one that holds it; never the whole."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = _whole(batches)
    at = {c: i for i, c in enumerate(t["cluster"].tolist())}
    order = np.lexsort((t["cluster"], t["low"])).tolist()  # what lies below comes first
    total, below, best = t["size"].astype(float), np.zeros(len(order)), np.zeros(len(order))
    chosen = np.zeros(len(order), bool)
    for i in order:
        stable = t["mass"][i] + (total[i] - t["size"][i]) / t["low"][i] - total[i] / t["up"][i]
        chosen[i] = t["parent"][i] >= 0 and stable >= below[i]
        best[i] = max(stable, below[i])
        if t["parent"][i] >= 0:
            up = at[t["parent"][i]]
            total[up] += total[i]
            below[up] += best[i]
    holder = np.full(len(order), -1)
    for i in reversed(order):
        held = holder[at[t["parent"][i]]] if t["parent"][i] >= 0 else -1
        holder[i] = held if held >= 0 else t["cluster"][i] if chosen[i] else -1
    yield pa.RecordBatch.from_arrays([pa.array(t["cluster"]), pa.array(holder)], ["cluster", "chosen"])


def stable_clusters(rows: DataFrame, links: DataFrame, min_size: int) -> DataFrame:
    """(id, n, chosen) of the rows in the most stable clusters, from ``contracted``."""
    # the first min_size rows of a part, few even where it is hot
    by_weight = Window.partitionBy("part").orderBy("w", "id")
    first = rows.withColumn("place", F.row_number().over(by_weight)).filter(F.col("place") <= min_size)
    first = first.withColumn("size", F.sum("n").over(by_weight.rowsBetween(Window.unboundedPreceding, 0)))
    leaves = first.filter(F.col("size") >= min_size).groupBy("part").agg(F.min("w").alias("w"))
    forest = links
    tasks = links.sparkSession.sparkContext.defaultParallelism
    for tasks in (tasks, math.isqrt(tasks), 1):  # at most a row for each part, and parts have min_size rows
        forest = forest.repartition(tasks).mapInArrow(_forest_of_task, _EDGE)
    nodes = leaves.select(F.col("part").alias("a"), F.col("part").alias("b"), "w")
    tree = nodes.unionByName(forest).repartition(1).mapInArrow(
        _tree, "cluster long, label long, parent long, low double, up double, jumps array<long>, limits array<double>"
    )
    tree = materialise(tree, "tree")
    steps = tree.agg(F.max(F.size("jumps"))).first()[0] or 0
    placed = rows.join(tree.filter("label is not null").select(F.col("label").alias("part"), "cluster"), "part").select("id", "n", "w", "cluster")
    for step in reversed(range(steps)):
        jump = tree.select("cluster", F.col("jumps")[step].alias("jump"), F.col("limits")[step].alias("limit"))
        placed = placed.join(jump, "cluster").select("id", "n", "w", F.when(F.col("w") >= F.col("limit"), F.col("jump")).otherwise(F.col("cluster")).alias("cluster"))
    placed = materialise(placed, "placed")
    mass = placed.join(tree.select("cluster", "low"), "cluster").select("cluster", "n", (F.col("n") / F.greatest("w", "low")).cast("decimal(28,9)").alias("m"))
    sums = mass.groupBy("cluster").agg(F.sum("n").alias("size"), F.sum("m").cast("double").alias("mass"))
    known = tree.select("cluster", "parent", "low", "up").join(sums, "cluster", "left").na.fill(0, ["size"]).na.fill(0.0, ["mass"])
    selected = materialise(known.repartition(1).mapInArrow(_selected, "cluster long, chosen long"), "selected")
    return placed.join(selected.filter("chosen >= 0"), "cluster").select("id", "n", "chosen")
