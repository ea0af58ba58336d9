"""Scaling, principal components, k-means, silhouettes, and both projections with their clusters: over complete cases, joined back by key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from tarn.sources.shared import materialize, release

SEED = 42
#: Columns up to which covariances are plain aggregates, and distances are taken column by column; rows of a task of a fit; rows of a block of
#: distances; values of a table that a task holds as a whole (64 MB).
FEW, ROWS_A_TASK, BLOCK, TASK_HOLDS = 8, 20_000, 1024, 8_000_000
#: Columns up to which a fit's steps go by boxes of points; points of a box of the lowest level, of a fit and of distances; points from which on distances
#: of two columns at most go by boxes; a box's nodes along a side, and how many of its radii two boxes that meet by nodes are apart.
BOXED, FIT_LEAF, LEAF, MANY, NODES, APART = 4, 128, 384, 20_000, 12, 1.0


def scaled(df: DataFrame, columns: list[str], suffix: str = "_scaled") -> DataFrame:
    """Complete cases of columns with (x - mean) / population deviation; a deviation of 0 counts as 1. One aggregate row is joined back."""
    rows = df.na.drop(subset=columns)
    moments = rows.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = rows.join(F.broadcast(moments), F.lit(True), "left")  # one row
    return out.withColumns({f"{c}{suffix}": (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}).drop(*moments.columns)


def covariances(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, covariance) of all pairs a <= b (population). Few columns are one aggregate; of many, each partition sums its products, and sums of one
    number a pair are added up."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    rows = df.na.drop(subset=columns).select(*[F.col(c).cast("double") for c in columns])
    if len(columns) <= FEW:
        row = rows.agg(*[F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs])
        cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("covariance")) for a, b in pairs])
        return row.select(F.inline(cells))
    means = rows.agg(*[F.avg(c) for c in columns]).first()  # one row
    mean, size = np.array([x or 0.0 for x in means]), len(columns)

    def products(batches):
        total, n = np.zeros((size, size)), 0
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - mean
            total, n = total + x.T @ x, n + len(x)
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j]), pa.array(np.full(len(i), n))], names=["i", "j", "x", "n"])

    sums = rows.mapInArrow(products, "i bigint, j bigint, x double, n bigint").groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    names = F.array(*map(F.lit, columns))
    return sums.select(F.get(names, F.col("i").cast("int")).alias("a"), F.get(names, F.col("j").cast("int")).alias("b"), F.try_divide("x", "n").alias("covariance"))


def principal_components(df: DataFrame, columns: list[str], n: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Components (columns x n) of scaled columns, each with its largest loading positive, and the share of variance of each. Only the
    covariance matrix comes to the driver."""
    size = len(columns)
    cov = np.zeros((size, size))
    at = {f"{c}_scaled": i for i, c in enumerate(columns)}
    for r in covariances(scaled(df, columns), list(at)).collect():
        cov[at[r.a], at[r.b]] = cov[at[r.b], at[r.a]] = r.covariance or 0.0
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:n]
    pc = vectors[:, order]
    largest = np.abs(pc).round(9).argmax(axis=0)  # the first of equal ones
    pc = pc * np.where(pc[largest, np.arange(len(order))] < 0, -1.0, 1.0)
    return pc, values[order] / max(values.sum(), 1e-300)


def pca_coordinates(df: DataFrame, columns: list[str], key: list[str], prefix: str = "pca", least: int = 4) -> tuple[DataFrame, DataFrame]:
    """(coordinates, loadings). Coordinates: key with prefix_x and prefix_y, and NULL umap columns (no projection of that kind is computed);
    incomplete rows, and all rows where fewer than `least` are complete, have nulls. Loadings: pc, feature, loading, explained_variance_ratio."""
    spark = df.sparkSession
    empty = {f"{prefix}_{a}": F.lit(None).cast("double") for a in ("x", "y")}
    nulls = {f"umap_{a}": F.lit(None).cast("double") for a in ("x", "y")}
    if df.na.drop(subset=columns).limit(least).count() < least:
        return df.select(*key).withColumns(empty | nulls), spark.createDataFrame([], "pc string, feature string, loading double, explained_variance_ratio double")
    pc, share = principal_components(df, columns)
    dot = lambda k: sum((F.col(f"{c}_scaled") * float(pc[i, k]) for i, c in enumerate(columns[1:], 1)), F.col(f"{columns[0]}_scaled") * float(pc[0, k]))
    coords = scaled(df, columns).select(*key, dot(0).alias(f"{prefix}_x"), dot(1).alias(f"{prefix}_y"))
    rows = [(f"PC{k + 1}", c, float(pc[i, k]), float(share[k])) for k in range(pc.shape[1]) for i, c in enumerate(columns)]
    loadings = spark.createDataFrame(rows, "pc string, feature string, loading double, explained_variance_ratio double")
    return df.select(*key).join(coords, key, "left").withColumns(nulls), loadings


def loadings_by_component(loadings: DataFrame) -> DataFrame:
    """One row a component: explained percentage and a map of rounded loadings."""
    return loadings.groupBy("pc").agg(F.round(100 * F.first("explained_variance_ratio"), 1).alias("explained_pct"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", F.round("loading", 3))))).alias("loadings"))


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([batch[c].to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(np.float64)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(1)[None], 0.0)


class _Boxes:
    """Weighted points in a balanced tree of boxes: each level halves the boxes of the one before across their widest sides, so level l has 2**l boxes of
    equally many points each. The points that fill the last box up repeat one and weigh nothing."""

    def __init__(self, x: np.ndarray, many: np.ndarray, leaf: int):
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / leaf))))
        self.size = -(-len(x) // 2**self.depth)
        more, d = self.size * 2**self.depth - len(x), x.shape[1]
        self.at = np.concatenate([np.arange(len(x)), np.full(more, len(x) - 1)])
        self.x, self.many = x[self.at], np.concatenate([many, np.zeros(more)])
        for level in range(self.depth):
            part = self.x.reshape(2**level, -1, d)
            side = (part.max(1) - part.min(1)).argmax(1)
            order = np.argpartition(part[np.arange(len(part)), :, side], part.shape[1] // 2, axis=1)
            self.x = np.take_along_axis(part, order[..., None], 1).reshape(-1, d)
            self.many, self.at = (np.take_along_axis(v.reshape(len(part), -1), order, 1).ravel() for v in (self.many, self.at))
        self.leaves = self.x.reshape(-1, self.size, d)
        self.low, self.high = [self.leaves.min(1)], [self.leaves.max(1)]
        for _ in range(self.depth):
            self.low.insert(0, self.low[0].reshape(-1, 2, d).min(1))
            self.high.insert(0, self.high[0].reshape(-1, 2, d).max(1))

    def with_moments(self) -> _Boxes:
        """Of each box the sums of its points, their number and their squares' sum."""
        x = self.leaves
        each = np.concatenate([x, np.ones((*x.shape[:2], 1)), (x * x).sum(2, keepdims=True)], axis=2)
        self.moments = [np.matmul(self.many.reshape(len(x), 1, -1), each)[:, 0]]
        for _ in range(self.depth):
            self.moments.insert(0, self.moments[0].reshape(-1, 2, self.moments[0].shape[1]).sum(1))
        return self

    def sums(self, centres: np.ndarray) -> np.ndarray:
        """_sums of all points. A box that is nearer to one centre than to any other, at its corner farthest that way too, counts as a whole; of the others of
        the lowest level each point is compared."""
        total, d = np.zeros((len(centres), centres.shape[1] + 2)), centres.shape[1]
        boxes, could = np.zeros(1, dtype=np.int64), np.ones((1, len(centres)), dtype=bool)
        for level in range(self.depth + 1):
            low, high = self.low[level][boxes], self.high[level][boxes]
            near = np.where(could, _squares((low + high) / 2, centres), np.inf).argmin(1)
            best = centres[near][:, None]
            corner = np.where(centres[None] > best, high[:, None], low[:, None])
            other, own = ((corner - centres[None]) ** 2).sum(2), ((corner - best) ** 2).sum(2)
            could &= other - own <= 1e-9 * (1.0 + other)  # equal ones but for rounding go on
            could[np.arange(len(boxes)), near] = True
            whole = could.sum(1) == 1
            for k in range(len(centres)):
                total[k] += self.moments[level][boxes[whole & (near == k)]].sum(0)
            boxes, could = boxes[~whole], could[~whole]
            if level < self.depth:
                boxes, could = (2 * boxes[:, None] + np.arange(2)).ravel(), np.repeat(could, 2, axis=0)
        total[:, -1] += total[:, -2] * (centres * centres).sum(1) - 2.0 * (total[:, :d] * centres).sum(1)
        if len(boxes):
            x = self.leaves[boxes].reshape(-1, d)
            total += _sums(x, self.many.reshape(-1, self.size)[boxes].ravel(), _squares(x, centres))
        return total


def _polynomials(u: np.ndarray) -> np.ndarray:
    """Of numbers in [-1, 1] the values of the NODES polynomials that are 1 at one Chebyshev node and 0 at the others."""
    q, angle = np.arange(1, NODES), (np.arange(NODES) + 0.5) * np.pi / NODES
    return (1.0 + 2.0 * np.cos(np.arccos(np.clip(u, -1.0, 1.0))[..., None] * q) @ np.cos(angle[:, None] * q).T) / NODES


def _distances_by_boxes(tree: _Boxes, groups: np.ndarray, width: int, own: range):
    """Pairs (leaf, sums of its points' distances to the points of each group) for the leaves of `own`; groups has a column of numbers of groups, or -1, a clustering,
    in the tree's order. For points of one column or two.

    Boxes that are near meet point by point. Boxes whose gap is more than APART radii of the larger one meet by their nodes: a distance is there a smooth function
    of either end, and the polynomials through NODES x NODES nodes of both boxes give it. No point is left out; at 760,640 points no sum differed from the one over
    all pairs by more than 5e-12 of it (96 points compared)."""
    p, size, depth = NODES, tree.size, tree.depth
    nodes = np.cos((np.arange(p) + 0.5) * np.pi / p)
    plane = lambda v: v if v.shape[-1] == 2 else np.concatenate([v, np.zeros((*v.shape[:-1], 1))], axis=-1)
    low, high = [plane(v) for v in tree.low], [plane(v) for v in tree.high]
    middle, half = [(a + b) / 2 for a, b in zip(low, high)], [(b - a) / 2 for a, b in zip(low, high)]
    radius = [np.sqrt((h * h).sum(1)) for h in half]
    leaves, many, groups = plane(tree.leaves), tree.many.reshape(-1, size), groups.reshape(-1, size, groups.shape[1])

    def within(x, box, level):  # polynomials of points by their box; a side of no length has all its nodes in one place
        h = half[level][box]
        return _polynomials((x - middle[level][box][:, None]) / np.where(h > 0, h, 1.0)[:, None])

    def weights(boxes):
        of, n = groups[boxes].reshape(-1, groups.shape[2]), many[boxes].ravel()
        out = np.zeros((len(of), width))
        for c in range(of.shape[1]):
            at = np.flatnonzero(of[:, c] >= 0)
            out[at, of[at, c]] = n[at]
        return out

    # weights at the nodes: of the lowest boxes from their points, of the others from their two halves
    charge = [np.empty((0,))] * depth + [np.empty((len(leaves), p * p, width))]
    for i in range(len(leaves)):
        e = within(leaves[i : i + 1], slice(i, i + 1), depth)[0]
        charge[depth][i] = (e[:, 0, :, None] * e[:, 1, None, :]).reshape(size, p * p).T @ weights(slice(i, i + 1))
    up = [np.empty((0,))] * (depth + 1)
    for level in range(depth, 0, -1):
        of = np.arange(2**level) // 2
        e = within(middle[level][:, None] + half[level][:, None] * nodes[None, :, None], of, level - 1)
        up[level] = e = e.swapaxes(1, 2)  # box, side, its node, the larger box's node
        made = np.matmul(e[:, 0].swapaxes(1, 2), charge[level].reshape(-1, p, p * width)).reshape(-1, p, p, width)
        charge[level - 1] = np.matmul(e[:, 1].swapaxes(1, 2)[:, None], made).reshape(-1, 2, p * p, width).sum(1)

    # pairs of boxes, from the highest down; by box of `own` those that meet by nodes, and the near ones of the lowest level
    a, b, got = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), {}
    for level in range(depth + 1):
        first, last = own.start >> (depth - level), (own.stop - 1) >> (depth - level)
        keep = (a >= first) & (a <= last)
        a, b = a[keep], b[keep]
        gap = np.sqrt(((middle[level][a] - middle[level][b]) ** 2).sum(1)) - radius[level][a] - radius[level][b]
        apart = gap > APART * np.maximum(radius[level][a], radius[level][b])
        sums = {}
        order = np.argsort(a[apart], kind="stable")
        fa, fb = a[apart][order], b[apart][order]
        starts = np.flatnonzero(np.r_[True, fa[1:] != fa[:-1]]) if len(fa) else np.empty(0, dtype=np.int64)
        for i, j in zip(starts, np.r_[starts[1:], len(fa)]):
            here, there = middle[level][fa[i]] + half[level][fa[i]] * nodes[:, None], middle[level][fb[i:j], None] + half[level][fb[i:j], None] * nodes[:, None]
            dx, dy = ((here[:, None, None, c] - there[None, :, :, c]) ** 2 for c in (0, 1))  # own node, box, its node
            far = np.sqrt(dx[:, None, :, :, None] + dy[None, :, :, None, :]).reshape(p * p, -1)
            sums[int(fa[i])] = far @ charge[level][fb[i:j]].reshape(-1, width)
        down = {}
        for box in range(first, last + 1):
            at_nodes = sums.get(box)
            if box // 2 in got:
                e = up[level][box]
                from_above = np.matmul(e[1], np.matmul(e[0], got[box // 2].reshape(p, p * width)).reshape(p, p, width)).reshape(p * p, width)
                at_nodes = from_above if at_nodes is None else at_nodes + from_above
            if at_nodes is not None:
                down[box] = at_nodes
        got, a, b = down, a[~apart], b[~apart]
        if level < depth:
            a, b = np.repeat(2 * a, 4) + np.tile([0, 0, 1, 1], len(a)), np.repeat(2 * b, 4) + np.tile([0, 1, 0, 1], len(b))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    alike = (groups == groups[:, :1]).all((1, 2))  # a leaf of one group each: its distances are added up once for all clusterings
    unit, one, two = np.zeros((len(leaves), width)), np.empty((size, size)), np.empty((size, size))
    for c in range(groups.shape[2]):
        at = np.flatnonzero(alike & (groups[:, 0, c] >= 0))
        unit[at, groups[at, 0, c]] = 1.0
    for leaf in own:
        x, out = leaves[leaf], np.zeros((size, width))
        near = b[np.searchsorted(a, leaf) : np.searchsorted(a, leaf, side="right")]
        sums = np.zeros((size, len(near)))
        for i, other in enumerate(near):
            for c, far in enumerate((one, two)):
                np.subtract(x[:, None, c], leaves[other][None, :, c], out=far)
                np.multiply(far, far, out=far)
            far = np.sqrt(np.add(one, two, out=one), out=one)
            if alike[other]:
                sums[:, i] = far @ many[other]
            else:
                out += far @ weights(slice(other, other + 1))
        out += sums @ unit[near]
        if leaf in got:
            e = within(x[None], slice(leaf, leaf + 1), depth)[0]
            out += (e[:, 0, :, None] * e[:, 1, None, :]).reshape(size, p * p) @ got[leaf]
        yield leaf, out


def _times(row: np.ndarray, weight: np.ndarray, draw: int, seed: int) -> np.ndarray:
    """Exponential times of rows by their hashes, at rates of their weights: the least is that of a row drawn by weight."""
    with np.errstate(over="ignore"):
        h = row ^ (np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(draw + 1) * np.uint64(0xD1B54A32D192ED03))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 0.5
    with np.errstate(divide="ignore"):
        return np.where(weight > 0, -np.log(u / 2.0**53) / weight, np.inf)


def _first_centres(data: DataFrame, columns: list[str], most: int, starts: int, seed: int) -> list[np.ndarray]:
    """`most` first centres of each start by k-means++ over all rows: the next centre is drawn by squared distance to those there are. The draws are the
    least of exponential times, which depend on the row's columns and the start only, so the rows' order and places change nothing. All starts draw in the
    same pass; the first k centres are a start's for k clusters."""
    drawn = [np.empty((0, len(columns))) for _ in range(starts)]
    for turn in range(most):
        there = [d.copy() for d in drawn]

        def draw(batches, there=there, turn=turn):
            best: list = [(np.inf, None)] * starts
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch, columns)
                row, many = batch["__hash"].to_numpy(zero_copy_only=False).astype(np.uint64), batch["__n"].to_numpy(zero_copy_only=False)
                for s in range(starts):
                    time = _times(row, many * _squares(x, there[s]).min(1) if turn else many, turn * starts + s, seed)
                    i = int(time.argmin())
                    if best[s][1] is None or time[i] < best[s][0]:
                        best[s] = (float(time[i]), x[i])
            rows = [(s, t, v.tolist()) for s, (t, v) in enumerate(best) if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.list_(pa.float64())))], names=["s", "t", "v"])

        got = data.mapInArrow(draw, "s int, t double, v array<double>").groupBy("s").agg(F.min_by("v", F.struct("t", "v")).alias("v")).collect()  # a row a start
        for r in got:
            drawn[r.s] = np.vstack([drawn[r.s], np.array(r.v)])
    return drawn


def _sums(x: np.ndarray, many: np.ndarray, far: np.ndarray) -> np.ndarray:
    """A row a centre: the sums of its rows (those it is nearest to, each counting as `many`), their number and their squared distances."""
    of, rows = far.argmin(1), np.arange(len(x))
    one = np.zeros((far.shape[1], len(x)))
    one[of, rows] = many
    return one @ np.column_stack([x, np.ones(len(x)), far[rows, of]])


def _moved(centres: np.ndarray, total: np.ndarray, before: float, tolerance: float) -> tuple[np.ndarray, float, bool]:
    """(Means of the rows by centre, the step's cost, whether it was the last one.) A centre without rows stays."""
    n, cost = total[:, -2:-1], float(total[:, -1].sum())
    moved = np.where(n > 0, total[:, :-2] / np.maximum(n, 1.0), centres)
    return moved, cost, bool(((moved - centres) ** 2).sum() <= tolerance or cost >= before)


def _in_tasks(data: DataFrame, tasks: int, run, kinds: str) -> DataFrame:
    """run(task's number, all rows of data as a table) of each task, in a partition of its own."""

    def each(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            yield from run(got[0]["__task"][0].as_py(), pa.Table.from_batches(got)).to_batches()

    return data.withColumn("__task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, "__task").mapInArrow(each, kinds)


def _lloyd_in_tasks(data: DataFrame, columns: list[str], deal: list[list[int]], first, until: list[tuple[float, int | None]]) -> tuple[list[np.ndarray], list[float]]:
    """_lloyd for tables that a task holds: the sets of centres are dealt to tasks, each of which has all rows and makes all steps of its sets, to each tolerance
    of `until` (with its most steps) in turn; costs are those at the first. first(numbers, rows, how often each counts, hashes): the sets of these numbers as they begin."""

    def run(task, t):
        order = np.argsort(t["__hash"].to_numpy(), kind="stable")
        x, many = np.stack([t[c].to_numpy() for c in columns], axis=1).astype(np.float64)[order], t["__n"].to_numpy()[order]
        begun, made = first(deal[task], x, many, t["__hash"].to_numpy()[order].astype(np.uint64)), []
        sums = _Boxes(x, many, FIT_LEAF).with_moments().sums if len(columns) <= BOXED else lambda c: _sums(x, many, _squares(x, c))
        for i, c in begun.items():
            costs = []
            for tolerance, most in until:
                cost, last, step = np.inf, False, 0
                while not last and (most is None or step < most):
                    c, cost, last = _moved(c, sums(c), cost, tolerance)
                    step += 1
                costs.append(cost)
            made.append((i, c.ravel().tolist(), costs[0]))
        return pa.table({"i": pa.array([m[0] for m in made], pa.int32()), "v": pa.array([m[1] for m in made], pa.list_(pa.float64())), "cost": pa.array([m[2] for m in made], pa.float64())})

    got = {r.i: r for r in _in_tasks(data, len(deal), run, "i int, v array<double>, cost double").collect()}  # a row a set
    return [np.array(got[i].v).reshape(-1, len(columns)) for i in range(len(got))], [got[i].cost for i in range(len(got))]


def _drawn(ks: list[int], starts: int, seed: int):
    """For _lloyd_in_tasks: sets drawn as _first_centres does, those of each k in the order of starts."""

    def first(numbers, x, many, row):
        made = {}
        for s in sorted({i % starts for i in numbers}):
            own = [i for i in numbers if i % starts == s]
            there, least = np.empty((0, x.shape[1])), np.ones(len(x))
            for turn in range(max(ks[i // starts] for i in own)):
                there = np.vstack([there, x[int(_times(row, many * least, turn * starts + s, seed).argmin())]])
                far = _squares(x, there[-1:])[:, 0]
                least = np.minimum(least, far) if turn else far
            made |= {i: there[: ks[i // starts]] for i in own}
        return made

    return first


def _lloyd(data: DataFrame, columns: list[str], sets: list[np.ndarray], tolerance: float, most: int | None) -> tuple[list[np.ndarray], list[float]]:
    """Several sets of centres, moved to the means of their rows until a step moves them by `tolerance` (summed squares) at most or costs no less than the one before, or `most`
    steps; all sets in the same pass over the rows. (Centres, cost of the last pass by set.)"""
    sets, cost, open_, step = [c.copy() for c in sets], [np.inf] * len(sets), list(range(len(sets))), 0
    while open_ and (most is None or step < most):
        now = {i: sets[i] for i in open_}

        def sums(batches, now=now):
            total = {i: np.zeros((len(c), c.shape[1] + 2)) for i, c in now.items()}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch, columns)
                every, ends = _squares(x, np.vstack(list(now.values()))), np.cumsum([len(c) for c in now.values()])
                for (i, c), end in zip(now.items(), ends):
                    total[i] += _sums(x, batch["__n"].to_numpy(zero_copy_only=False), every[:, end - len(c) : end])
            rows = [(i, j, row.tolist()) for i, t in total.items() for j, row in enumerate(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.float64())))], names=["i", "j", "v"])

        # a row a centre and task comes to the driver
        parts = sorted(data.mapInArrow(sums, "i int, j int, v array<double>").collect(), key=lambda r: (r.i, r.j, r.v))
        total = {i: np.zeros((len(sets[i]), len(columns) + 2)) for i in open_}
        for r in parts:
            total[r.i][r.j] += r.v
        for i, t in total.items():
            sets[i], cost[i], last = _moved(sets[i], t, cost[i], tolerance)
            if last:
                open_.remove(i)
        step += 1
    return sets, cost


def _fitted(df: DataFrame, columns: list[str], ks: list[int], starts: int, seed: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(scaled complete rows, centres by k). Equal rows are one point that counts as often. Of each k several starts run to scikit-learn's tolerance (1e-4, 300 steps), and the best by cost goes on
    until its centres stand still, so each row's cluster is the one of the nearest mean."""
    made = [f"{c}_scaled" for c in columns]
    data = materialize(scaled(df, columns), "kmeans")
    points = data.groupBy(*made).agg(F.count("*").cast("double").alias("__n"), F.min(F.xxhash64(*sorted(columns))).alias("__hash"))
    points = materialize(points, "points")
    n = points.count()
    held, boxed, until = 0 < n * len(made) <= TASK_HOLDS, len(made) <= BOXED, [(1e-4, 300), (1e-18, None)]
    if held:  # steps by boxes are so short that all starts go on to the end
        deal = [[i * starts + s for i in range(len(ks))] for s in range(starts)]
        sets, cost = _lloyd_in_tasks(points, made, deal, _drawn(ks, starts, seed), until if boxed else until[:1])
    else:
        slim = points.coalesce(1 + n // ROWS_A_TASK)  # small tables in few tasks: a fit is many short jobs
        drawn = _first_centres(slim, made, max(ks), starts, seed)
        sets, cost = _lloyd(slim, made, [d[:k] for k in ks for d in drawn], *until[0])
    settled = [sets[min(range(i * starts, (i + 1) * starts), key=lambda j: cost[j])] for i in range(len(ks))]
    if held and not boxed:
        best = settled
        settled, _ = _lloyd_in_tasks(points, made, [[i] for i in range(len(ks))], lambda numbers, *_: {i: best[i] for i in numbers}, until[1:])
    elif not held:
        settled, _ = _lloyd(slim, made, settled, *until[1])
    release(points)
    return data, {k: c[np.argsort(-c[:, 0], kind="stable")] for k, c in zip(ks, settled)}


def _assigned(data: DataFrame, columns: list[str], centres: dict[str, np.ndarray]) -> DataFrame:
    """data with a column of the nearest centre's number for each set of centres."""
    made = [f"{c}_scaled" for c in columns]

    def assign(batches):
        for batch in batches:
            x = _matrix(batch, made)
            of = [pa.array(_squares(x, c).argmin(1).astype(np.int32)) for c in centres.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *of], names=[*batch.schema.names, *centres])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema.fields)
    return data.mapInArrow(assign, ", ".join([kinds, *[f"`{n}` int" for n in centres]]))


def kmeans(df: DataFrame, columns: list[str], k: int, starts: int = 10, seed: int = SEED) -> DataFrame:
    """Complete cases with `cluster`: the best of several seeded starts by cost, run until no row changes. Ids follow the centres along the first column,
    highest first, so they mean the same from fit to fit."""
    data, centres = _fitted(df, columns, [k], starts, seed)
    return _assigned(data.drop("cluster"), columns, {"cluster": centres[k]})


def _silhouettes(df: DataFrame, columns: list[str], clusters: list[str]) -> dict[str, float]:
    """The exact mean Euclidean silhouette of each of several clusterings of the same rows. Equal rows of equal clusters are one point that counts as often.
    Every part of the points meets every part, once for all clusterings, and keeps sums of distances by cluster only; many points of one column or two, which
    a task holds, meet by boxes (_distances_by_boxes)."""
    points = df.groupBy(*columns, *clusters).agg(F.count("*").cast("double").alias("__n")).withColumn("__id", F.monotonically_increasing_id())
    points = materialize(points, "points")
    sizes = {c: {r[0]: r.n for r in points.where(F.col(c).isNotNull()).groupBy(c).agg(F.sum("__n").alias("n")).collect()} for c in clusters}  # a row a cluster
    number = {c: {label: i for i, label in enumerate(sorted(sizes[c]))} for c in clusters}
    size = {c: np.array([sizes[c][label] for label in number[c]]) for c in clusters}
    ends = dict(zip(clusters, np.cumsum([len(size[c]) for c in clusters])))
    width, n = int(max(ends.values(), default=0)), points.count()
    if not width:
        return {c: 0.0 if n else None for c in clusters}
    numbers = lambda t, c: pc.fill_null(pc.index_in(t[c], pa.array(list(number[c]), t[c].type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def score(sums, many, of_each):
        made = []
        for c, of in zip(clusters, of_each):
            far, rows = sums[:, ends[c] - len(size[c]) : ends[c]], np.arange(len(of))
            with np.errstate(divide="ignore", invalid="ignore"):
                own = np.where(size[c][of] > 1, far[rows, of] / (size[c][of] - 1), np.nan)
                rest = far / size[c]
                rest[rows, of] = np.inf
                other = rest.min(1, initial=np.inf)
                s = (other - own) / np.maximum(own, other)
            made.append(float((np.where(np.isfinite(s) & (of >= 0), s, 0.0) * many).sum()))
        return [*made, float(many.sum())]

    labels = [f"m{i}" for i in range(len(clusters))]
    scored = ", ".join(f"{m} double" for m in [*labels, "n"])
    means = [(F.sum(m) / F.sum("n")).alias(m) for m in labels]
    if n >= MANY and len(columns) <= 2 and n * len(columns) <= TASK_HOLDS:
        tasks = max(1, min(32, points.sparkSession.sparkContext.defaultParallelism))

        def share(task, t):
            order = np.argsort(t["__id"].to_numpy())
            tree = _Boxes(np.stack([t[c].to_numpy() for c in columns], axis=1).astype(np.float64)[order], t["__n"].to_numpy()[order], LEAF)
            of = np.stack([numbers(t, c)[order] for c in clusters], axis=1)[tree.at]
            groups = np.where(of >= 0, of + np.array([ends[c] - len(size[c]) for c in clusters]), -1)
            leaves, at = len(tree.leaves), tree.size
            own, total = range(task * leaves // tasks, (task + 1) * leaves // tasks), np.zeros(len(clusters) + 1)
            if own:
                for leaf, sums in _distances_by_boxes(tree, groups, width, own):
                    here = slice(leaf * at, leaf * at + at)
                    total += score(sums, tree.many[here], of[here].T)
            return pa.table({m: pa.array([x]) for m, x in zip([*labels, "n"], total)})

        row = _in_tasks(points, tasks, share, scored).agg(*means).first()  # one row
        release(points)
        return dict(zip(clusters, row))
    parts = max(1, min(4, n // 1000), 1 + n // min(50_000, max(10_000, 640_000 // len(columns))))

    def dealt(mine, others):
        part = points.withColumn(mine, F.pmod(F.xxhash64("__id"), F.lit(parts)).cast("int"))
        return part.withColumn(others, F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("__i", "__j")

    def meet(x, y):
        a, b = (np.stack([t[c].to_numpy() for c in columns], axis=1).astype(np.float64) for t in (x, y))
        many = y["__n"].to_numpy()
        weights = np.zeros((len(b), width))
        for c in clusters:
            of = numbers(y, c)
            at = np.flatnonzero(of >= 0)
            weights[at, ends[c] - len(size[c]) + of[at]] = many[at]
        out = np.zeros((len(a), width))
        for i in range(0, len(a), BLOCK):
            p = a[i : i + BLOCK]
            for j in range(0, len(b), BLOCK):
                q = b[j : j + BLOCK]
                if len(columns) <= FEW:
                    far = sum((p[:, k, None] - q[None, :, k]) ** 2 for k in range(len(columns)))
                else:  # a product; what rounding leaves of equal points' distance goes
                    far = _squares(p, q)
                    far[far < 1e-13 * (p * p).sum(1)[:, None]] = 0.0
                out[i : i + BLOCK] += np.sqrt(far) @ weights[j : j + BLOCK]
        return pa.table({"__id": x["__id"], **{f"s{k}": out[:, k] for k in range(width)}})

    kinds = ", ".join(f"s{k} double" for k in range(width))
    got = dealt("__i", "__j").cogroup(dealt("__j", "__i")).applyInArrow(meet, f"__id bigint, {kinds}")
    got = got.groupBy("__id").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)]).join(points.select("__id", "__n", *clusters), "__id")

    def scores(batches):
        for batch in batches:
            sums = np.stack([batch[f"s{k}"].to_numpy() for k in range(width)], axis=1)
            made = score(sums, batch["__n"].to_numpy(), [numbers(batch, c) for c in clusters])
            yield pa.RecordBatch.from_arrays([pa.array([m]) for m in made], names=[*labels, "n"])

    row = got.mapInArrow(scores, scored).agg(*means).first()  # one row
    release(points)
    return dict(zip(clusters, row))


def silhouette(df: DataFrame, columns: list[str], cluster: str = "cluster", key: str = "id", most: int | None = None) -> DataFrame:
    """One row: the exact mean Euclidean silhouette. The measure compares every point with all points (equal rows are one point), so its time grows with the
    square of their number; a caller may refuse tables of more than `most` rows. A cluster of one row counts 0."""
    if most is not None and (n := df.count()) > most:
        raise ValueError(f"an exact silhouette of {n} rows; at most {most} are compared with one another")
    return df.sparkSession.createDataFrame([(_silhouettes(df, columns, [cluster])[cluster],)], "silhouette double")


def _selected(df: DataFrame, columns: list[str], ks: range, starts: int, seed: int = SEED) -> tuple[int, dict[int, float], DataFrame | None]:
    """(k, silhouette by k, rows with the `cluster` of that k): the first k of highest silhouette. All k are fitted in the same passes over the rows, and all
    their silhouettes come of one comparison of the points."""
    n = df.na.drop(subset=columns).count()
    fits = [k for k in ks if 2 <= k <= n - 1]
    if not fits:
        return (2 if n > 2 else min(ks)), {}, None
    data, centres = _fitted(df, columns, fits, starts, seed)
    names = {k: f"__k{k}" for k in fits}
    rows = materialize(_assigned(data, columns, {names[k]: centres[k] for k in fits}), "clusters")
    got = _silhouettes(rows, [f"{c}_scaled" for c in columns], list(names.values()))
    by = {k: got[names[k]] for k in fits}
    k = max(fits, key=lambda k: (by[k], -k))
    return k, by, rows.withColumn("cluster", F.col(names[k])).drop(*names.values())


def select_k(df: DataFrame, columns: list[str], ks: range, key: str = "id", starts: int = 10) -> tuple[int, dict[int, float]]:
    """(k, silhouette by k): the first k of highest silhouette among those below the number of complete rows; 2, or the least k, where none fits."""
    return _selected(df, columns, ks, starts)[:2]


def both_projections(features: DataFrame, columns: dict[str, list[str]], key: list[str], position: str, meta: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(coordinates, loadings) of several projections (name: its feature columns) of one position's rows: key, meta, pca_x_{name}, pca_y_{name} and null
    umap columns side by side, joined by key; loadings with position and projection."""
    out, loadings = features.select(*key, *[m for m in meta if m not in key]), None
    for name, of in columns.items():
        coords, loads = pca_coordinates(features, of, key)
        out = out.join(coords.withColumnsRenamed({f"{kind}_{a}": f"{kind}_{a}_{name}" for kind in ("pca", "umap") for a in "xy"}), key, "left")
        loads = loads.select(F.lit(position).alias("position"), F.lit(name).alias("projection"), "*")
        loadings = loads if loadings is None else loadings.unionByName(loads)
    return out, loadings


def clustered(features: DataFrame, coords: DataFrame, columns: dict[str, list[str]], ks: range, key: list[str], position: str, starts: int = 10, name: str = "name", birth_year: str = "birth_year") -> tuple[DataFrame, DataFrame]:
    """(coordinates with cluster_id_{projection}, summary). For each projection k is chosen by silhouette; incomplete rows have no cluster, and a projection of
    fewer than four complete rows none at all. Summary: position, projection, cluster_id, k, silhouette, n_members, median_birth_year, examples."""
    out, summary = coords, None
    for projection, of in columns.items():
        rows = materialize(features.na.drop(subset=of).withColumn("__id", F.concat_ws("\x1f", *key)), "clustered")
        column = f"cluster_id_{projection}"
        if rows.limit(4).count() < 4:
            out = out.withColumn(column, F.lit(None).cast("int"))
            continue
        k, by, got = _selected(rows, of, ks, starts)
        got = (materialize(kmeans(rows, of, k, starts), "clustered") if got is None else got).select(*rows.columns, "cluster")
        out = out.join(got.select(*key, F.col("cluster").alias(column)), key, "left")
        part = cluster_summary(got, name=name, birth_year=birth_year, order="__id").select(
            F.lit(position).alias("position"), F.lit(projection).alias("projection"), F.col("cluster").alias("cluster_id"), F.lit(k).alias("k"), F.lit(float(by.get(k, 0.0))).alias("silhouette"), "n_members", "median_birth_year", "examples"
        )
        summary = part if summary is None else summary.unionByName(part)
    return out, summary


def cluster_summary(df: DataFrame, cluster: str = "cluster", birth_year: str = "birth_year", name: str = "name", order: str = "id", n: int = 5) -> DataFrame:
    """By cluster: members, median birth year, and the first n names in the given order. The names come from a part's own first n, so no task
    orders a whole cluster."""
    rows = df.where(F.col(cluster).isNotNull())
    spread = rows.withColumn("__part", F.pmod(F.xxhash64(order), F.lit(64)))
    rank = F.row_number().over(W.partitionBy(cluster, "__part").orderBy(order))
    few = spread.select(cluster, "__part", order, F.col(name).alias("__name")).withColumn("__rank", rank).where(F.col("__rank") <= n)
    names = few.groupBy(cluster).agg(F.slice(F.array_sort(F.collect_list(F.struct(order, "__name"))), 1, n).alias("x"))
    made = rows.groupBy(cluster).agg(F.count("*").alias("n_members"), F.median(birth_year).alias("median_birth_year"))
    return made.join(names, cluster).select(cluster, "n_members", "median_birth_year", F.concat_ws(", ", F.transform("x", lambda v: v["__name"])).alias("examples"))
