"""Small models for audits: logistic regression, isolation forest, boosted trees, elbows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, balanced: bool = False, steps: int = 15, weight: np.ndarray | None = None) -> np.ndarray:
    """Newton steps for L2-penalised logistic regression with a free intercept; logits are clipped at 30."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.ones(len(y)) if weight is None else weight.astype(float)
    if balanced and 0 < y.sum() < len(y):
        w = w * np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    penalty = np.eye(a.shape[1]) / c
    penalty[0, 0] = 1e-9
    beta = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        beta = beta + np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (w * (y - p)) - penalty @ beta)
    return beta


def probability(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -30, 30)))


def leave_one_out(x: np.ndarray, y: np.ndarray, c: float = 1.0, balanced: bool = False, tolerance: float = 1e-9) -> np.ndarray:
    """Held-out probability of each row. Where a bound proves that the fit without a row follows from the fit on all
    rows to within ``tolerance`` of its logit, it is taken from there, else the row is fitted anew; memory stays
    linear in rows, and so does time on large tables."""
    out, done = _left_out(x, y, c, balanced, tolerance)
    for i in np.flatnonzero(~done):
        keep = np.arange(len(y)) != i
        out[i] = probability(logistic(x[keep], y[keep], c, balanced), x[i : i + 1])[0]
    return out


def _left_out(x: np.ndarray, y: np.ndarray, c: float, balanced: bool, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Held-out probabilities, and which of them are within the tolerance.

    The gradient over all rows is expanded to third order about its own optimum, in coordinates in which its Hessian is
    the identity; the row's own part is exact. The fourth derivative of a row's loss's gradient is 1/8 at most, which
    bounds what the expansion leaves out.
    """
    out, done = np.full(len(y), np.nan), np.zeros(len(y), bool)
    a = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-9, *[1 / c] * x.shape[1]])
    for label in (0, 1):
        held, n, ones = np.flatnonzero((y == 1) == label), len(y) - 1, int((y == 1).sum()) - label
        if not len(held) or not 0 < ones < n:
            continue
        w = np.where(y == 1, n / (2 * ones), n / (2 * (n - ones))) if balanced else np.ones(len(y))
        beta = logistic(x, y, c, weight=w)
        m = a @ beta
        if not np.abs(m).max() < 29:  # logits are clipped at 30
            continue
        p = 1 / (1 + np.exp(-m))
        v = p * (1 - p)
        try:
            root = np.linalg.cholesky((a * (w * v)[:, None]).T @ a + penalty)
        except np.linalg.LinAlgError:
            continue
        b = np.linalg.solve(root, a.T).T
        off = b.T @ (w * (p - y)) + np.linalg.solve(root, penalty @ beta)
        d = b.shape[1]
        squares = (b[:, :, None] * b[:, None, :]).reshape(len(b), d * d)
        third = (squares.T @ (b * (w * v * (1 - 2 * p))[:, None])).reshape(d, d, d)
        fourth = (squares.T @ (squares * (w * v * (1 - 6 * p + 6 * p * p))[:, None])).reshape(d, d, d, d)
        size = np.sqrt((b * b).sum(1))
        rest = (w * size**5).sum() / (24 * 8)
        for at in range(0, len(held), 4096):
            rows = held[at : at + 4096]
            own, step = b[rows], np.zeros((len(rows), d))
            for _ in range(12):
                q = 1 / (1 + np.exp(-(m[rows] + (own * step).sum(1))))
                cubic = np.einsum("abcd,nc,nd->nab", fourth, step, step, optimize=True)
                square = np.einsum("abc,nc->nab", third, step)
                miss = step + off + ((square / 2 + cubic / 6) @ step[:, :, None])[:, :, 0] - (w[rows] * (q - y[rows]))[:, None] * own
                slope = np.eye(d) + square + cubic / 2 - (w[rows] * q * (1 - q))[:, None, None] * own[:, :, None] * own[:, None, :]
                step = step - np.linalg.solve(slope, miss[:, :, None])[:, :, 0]
                if not np.abs(miss).max() > 1e-12:
                    break
            length = np.sqrt((step * step).sum(1))
            # a slope of over 1/2 along the way from the root of the expansion to the true one turns a miss into twice as much
            firm = (w[rows] * size[rows] ** 2 / 4 < 0.25) & (length * size.max() < 0.2)
            out[rows] = 1 / (1 + np.exp(-(m[rows] + (own * step).sum(1))))
            done[rows] = firm & (2 * (rest * length**4 + np.abs(miss).max(1) * d) * size[rows] < tolerance)
    return out, done


def rank_auc(score: np.ndarray, y: np.ndarray) -> float:
    """AUC with ties at half; nan for one class."""
    n1, n0 = int((y == 1).sum()), int((y != 1).sum())
    if not n1 or not n0:
        return math.nan
    ranks = pd.Series(score).rank().to_numpy()
    return float((ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


def matrix(pdf: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
    """Median-imputed, standardised columns."""
    x = pdf[list(names)].to_numpy(float)
    med = np.array([np.nanmedian(col) if np.isfinite(col).any() else 0.0 for col in x.T])
    x = np.where(np.isfinite(x), x, med)
    sd = x.std(0)
    return (x - x.mean(0)) / np.where(sd < 1e-12, 1, sd)


def loo_table(df: DataFrame, keys: Sequence[str], row: str, label: str, names: Sequence[str], balanced: bool = False) -> DataFrame:
    """``score``: leave-one-out probability of every row of each (small) group."""
    kinds = dict(df.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row)
        y = pdf[label].to_numpy()
        return pd.DataFrame({**{k: pdf[k].values for k in keys}, row: pdf[row].values, label: y, "score": leave_one_out(matrix(pdf, names), y, balanced=balanced)})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{row} {kinds[row]}", f"{label} {kinds[label]}", "score double"])
    return df.select(*keys, row, label, *names).groupBy(*keys).applyInPandas(one, schema)


def _combination(n: int, k: int, place: int) -> list[int]:
    """The ``place``-th of the combinations of ``k`` of ``n``, in lexical order."""
    out, low = [], 0
    for left in range(k, 0, -1):
        while (under := math.comb(n - low - 1, left - 1)) <= place:
            place -= under
            low += 1
        out.append(low)
        low += 1
    return out


def combos(df: DataFrame, row: str, label: str, names: Sequence[str], most: int = 5) -> DataFrame:
    """AUC of leave-one-out logistic regression for every combination of up to ``most`` columns.

    The table of datasets is small by nature (one row per dataset, the listed
    columns); it travels with the tasks and the combinations, told by their places, are what is spread.
    """
    spark = df.sparkSession
    table = df.select(row, label, *names).orderBy(row).toPandas()
    y, columns = table[label].to_numpy(), [matrix(table, [n])[:, 0] for n in names]
    sizes = [math.comb(len(names), k) for k in range(1, most + 1)]

    def run(batches):
        for pdf in batches:
            out = []
            for place in pdf["id"]:
                k = 1
                while place >= sizes[k - 1]:
                    place -= sizes[k - 1]
                    k += 1
                pick = _combination(len(names), k, int(place))
                out.append((k, "+".join(names[i] for i in pick), rank_auc(leave_one_out(np.column_stack([columns[i] for i in pick]), y, balanced=True), y)))
            yield pd.DataFrame(out, columns=["k", "combo", "auc"])

    parts = max(1, min(sum(sizes), 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, sum(sizes), 1, parts).mapInPandas(run, "k int, combo string, auc double")


def top_of(df: DataFrame, keys: Sequence[str], value: str, n: int, tie: str) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), tie))).where(F.col("place") <= n)


class Forest:
    """Isolation forest whose splits come from seeds, so that trees can be built anywhere."""

    def __init__(self, trees: int = 200, sample: int = 256, seed: int = 0):
        self.trees, self.sample, self.seed = trees, sample, seed

    def fit(self, x: np.ndarray) -> Forest:
        n = min(self.sample, len(x))
        self.limit, self.norm = math.ceil(math.log2(max(n, 2))), _path(n)
        self.roots = []
        for t in range(self.trees):
            rng = np.random.default_rng([self.seed, t])
            self.roots.append(self._grow(x[rng.choice(len(x), n, replace=False)], 0, rng))
        return self

    def _grow(self, x: np.ndarray, depth: int, rng: np.random.Generator):
        open_ = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 and depth < self.limit else []
        if not len(open_):
            return depth + _path(len(x))
        j = int(rng.choice(open_))
        cut = rng.uniform(x[:, j].min(), x[:, j].max())
        left = x[:, j] < cut
        return j, cut, self._grow(x[left], depth + 1, rng), self._grow(x[~left], depth + 1, rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Higher is more anomalous, in (0, 1)."""
        total = np.zeros(len(x))
        for root in self.roots:
            self._walk(root, x, np.arange(len(x)), total)
        return 2.0 ** (-total / max(1, len(self.roots)) / max(self.norm, 1e-12))

    def _walk(self, node, x: np.ndarray, rows: np.ndarray, total: np.ndarray) -> None:
        if not isinstance(node, tuple):
            total[rows] += node
            return
        j, cut, left, right = node
        goes = x[rows, j] < cut
        if goes.any():
            self._walk(left, x, rows[goes], total)
        if not goes.all():
            self._walk(right, x, rows[~goes], total)


def _path(n: int) -> float:
    """Mean depth of an unsuccessful search in a tree of n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class BoostedTrees:
    """Gradient-boosted trees on histograms for small tables: logistic loss, Newton leaves, nulls go left.

    Each round sees a seeded share of the rows and of the columns; a leaf holds at least ``least_weight`` of
    the loss's second derivative.
    """

    def __init__(self, rounds: int = 150, depth: int = 3, rate: float = 0.06, l2: float = 1.0, bins: int = 32, rows: float = 0.85, columns: float = 0.7, least_weight: float = 2.0, seed: int = 0):
        self.rounds, self.depth, self.rate, self.l2, self.bins = rounds, depth, rate, l2, bins
        self.rows, self.columns, self.least_weight, self.seed = rows, columns, least_weight, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        filled = np.where(np.isfinite(x), x, -np.inf)
        self.cuts = [np.unique(np.quantile(c[np.isfinite(c)], np.linspace(0, 1, self.bins + 1)[1:-1])) if np.isfinite(c).any() else np.zeros(0) for c in filled.T]
        codes = np.column_stack([np.searchsorted(cut, c, side="left") for cut, c in zip(self.cuts, filled.T, strict=True)])
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = math.log(rate / (1 - rate)), []
        self.gain = np.zeros(x.shape[1])
        margin = np.full(len(y), self.base)
        n, d = codes.shape
        for t in range(self.rounds):
            p, draw = 1 / (1 + np.exp(-margin)), np.random.default_rng([self.seed, t])
            seen = np.sort(draw.permutation(n)[: max(1, round(n * self.rows))])
            self._open = np.sort(draw.permutation(d)[: max(1, round(d * self.columns))])
            tree = self._grow(codes, p - y, p * (1 - p), seen, 0)
            self.trees.append(tree)
            margin += self.rate * _leaf_values(tree, codes)
        return self

    def _grow(self, codes, g, h, rows, depth):
        value = -g[rows].sum() / (h[rows].sum() + self.l2)
        best = (1e-9, None, None)
        if depth < self.depth and len(rows) >= 4:
            parent = g[rows].sum() ** 2 / (h[rows].sum() + self.l2)
            for j in self._open:
                k = codes[rows, j]
                gs, hs = np.bincount(k, g[rows], self.bins + 1).cumsum(), np.bincount(k, h[rows], self.bins + 1).cumsum()
                gain = gs**2 / (hs + self.l2) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + self.l2) - parent
                gain[(hs < self.least_weight) | (hs[-1] - hs < self.least_weight)] = -1
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), j, at)
        if best[1] is None:
            return {"value": value, "cover": float(h[rows].sum())}
        gain, j, at = best
        self.gain[j] += gain
        left = codes[rows, j] <= at
        return {"value": value, "cover": float(h[rows].sum()), "j": j, "at": at, "left": self._grow(codes, g, h, rows[left], depth + 1), "right": self._grow(codes, g, h, rows[~left], depth + 1)}

    def codes(self, x: np.ndarray) -> np.ndarray:
        filled = np.where(np.isfinite(x), x, -np.inf)
        return np.column_stack([np.searchsorted(cut, c, side="left") for cut, c in zip(self.cuts, filled.T, strict=True)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes = self.codes(x)
        return self.base + self.rate * sum((_leaf_values(t, codes) for t in self.trees), np.zeros(len(x)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Shapley values of each row's margin under path-dependent expectations, exact over the
        features of each tree (at most 2**depth - 1 of them); rows sum to margin less the mean."""
        codes = self.codes(x)
        out = np.zeros(x.shape)
        for tree in self.trees:
            used = sorted(_features(tree))
            m = len(used)
            if not m:
                continue
            value = {s: _expected(tree, codes, {used[i] for i in range(m) if s >> i & 1}) for s in range(1 << m)}
            for i, j in enumerate(used):
                for s in range(1 << m):
                    if not s >> i & 1:
                        k = bin(s).count("1")
                        out[:, j] += self.rate * math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * (value[s | 1 << i] - value[s])
        return out


def _leaf_values(node: dict, codes: np.ndarray) -> np.ndarray:
    if "j" not in node:
        return np.full(len(codes), node["value"])
    return np.where(codes[:, node["j"]] <= node["at"], _leaf_values(node["left"], codes), _leaf_values(node["right"], codes))


def _features(node: dict) -> set[int]:
    return set() if "j" not in node else {node["j"]} | _features(node["left"]) | _features(node["right"])


def _expected(node: dict, codes: np.ndarray, known: set[int]) -> np.ndarray:
    if "j" not in node:
        return np.full(len(codes), node["value"])
    left, right = _expected(node["left"], codes, known), _expected(node["right"], codes, known)
    if node["j"] in known:
        return np.where(codes[:, node["j"]] <= node["at"], left, right)
    share = node["left"]["cover"] / max(node["cover"], 1e-12)
    return share * left + (1 - share) * right


def elbow_table(curves: DataFrame, keys: Sequence[str], k: str = "k", value: str = "value") -> DataFrame:
    """``k_star``: the count farthest above the chord of its curve on a log2 axis, the smallest of equals; of
    fewer than three points, or a flat curve, the best."""
    every = Window.partitionBy(*keys)
    x = F.log2(F.col(k).cast("double"))
    scaled = curves.withColumn("_x", F.try_divide(x - F.min(x).over(every), F.max(x).over(every) - F.min(x).over(every))).withColumn("_y", F.try_divide(F.col(value) - F.min(value).over(every), F.max(value).over(every) - F.min(value).over(every))).withColumn("_n", F.count("*").over(every))
    first, last = F.min_by("_y", F.col(k)).over(every), F.max_by("_y", F.col(k)).over(every)
    above = scaled.withColumn("_above", F.round(F.when((F.col("_n") >= 3) & F.col("_y").isNotNull(), F.col("_y") - (first + (last - first) * F.col("_x"))).otherwise(F.col(value)), 12))
    return above.groupBy(*keys).agg(F.max_by(k, F.struct("_above", -F.col(k))).alias("k_star"))
