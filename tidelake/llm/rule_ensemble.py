"""Quality classifier: a sparse rule ensemble.

Boosted shallow trees over statistics of the texts are grown on labelled rows; the paths
of their nodes become conjunctive rules; a lasso logistic regression weighs the rules,
most to zero; what remains is compiled into one Spark column expression. Only the
labelled sample, at most max_rows rows of numbers, reaches the driver.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Statistics of a text, in the order statistics() returns them.
STATS = (
    "log_words", "word_length", "distinct_words", "top_word", "repeated_neighbours", "symbols", "marks",
    "digits", "capitals", "punctuation", "non_ascii", "words_a_line", "repeated_lines", "short_words",
    "long_words", "distinct_pairs",
)
MAX_ROWS = 12_000


def statistics(text: bytes | None) -> tuple[float, ...]:
    """STATS of one whole text; null is as the empty text, whose statistics are all 0."""
    text = text or b""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return (0.0,) * len(STATS)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    without = lambda chars: size - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    letters = upper + without(b"abcdefghijklmnopqrstuvwxyz")
    neighbours = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
    return (
        float(np.log1p(n)), float(lengths.mean()), len(counts) / n, max(counts.values()) / n, neighbours / n,
        without(b"#*$%&|<>@^~=_{}[]\\") / size, without(b"!?") / size, without(b"0123456789") / size, upper / max(1, letters),
        without(b".,;:") / n, (size - len(text.decode("utf-8", "replace"))) / size,
        n / len(lines), 1 - len(set(lines)) / len(lines), float((lengths <= 2).mean()), float((lengths >= 12).mean()), pairs,
    )


def statistics_column(text: Column) -> Column:
    """STATS of a text column as a struct of doubles."""

    @arrow_udf(", ".join(f"{s} double" for s in STATS))
    def text_statistics(texts):
        import pyarrow as pa

        rows = [statistics(x.as_buffer().to_pybytes() if x.is_valid else None) for x in texts]
        table = np.array(rows, np.float64).reshape(-1, len(STATS))
        return pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(STATS))], names=list(STATS))

    return text_statistics(text)


#: A condition is (statistic, is_greater, threshold): x > threshold or x <= threshold.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class Ensemble:
    """intercept + sum of weights of the rules that hold, through the logistic function."""

    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self, stats: str) -> Column:
        """The score, 0 to 1, as an expression over a struct column of statistics."""
        terms = [F.lit(self.intercept)]
        for rule, weight in zip(self.rules, self.weights):
            holds = None
            for name, greater, at in rule:
                x = F.col(f"{stats}.{name}")
                c = x > F.lit(at) if greater else x <= F.lit(at)
                holds = c if holds is None else holds & c
            terms.append(F.when(holds, F.lit(weight)).otherwise(F.lit(0.0)))
        while len(terms) > 1:  # a balanced sum keeps the expression shallow
            terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + ([terms[-1]] if len(terms) % 2 else [])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same over an array of statistics, for tests and for fitting."""
        held = _holds(x, self.rules)
        return 1 / (1 + np.exp(-(self.intercept + held @ np.array(self.weights, np.float64))))


def _holds(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), bool)
    for j, rule in enumerate(rules):
        for name, greater, at in rule:
            v = x[:, STATS.index(name)]
            out[:, j] &= (v > at) if greater else (v <= at)
    return out.astype(np.float64)


def _grow(codes, cuts, grad, hess, rows, depth, least, path, found, pred):
    """One regression tree on binned statistics; adds the path of each node to found and leaf values to pred."""
    if path:
        found.append(path)
    best = None
    if depth and len(rows) >= 2 * least:
        g, h = grad[rows], hess[rows]
        parent = g.sum() ** 2 / (h.sum() + 1)
        for f in range(codes.shape[1]):
            c, bins = codes[rows, f], len(cuts[f]) + 1
            gl, hl, nl = (np.cumsum(np.bincount(c, w, bins))[:-1] for w in (g, h, None))
            ok = (nl >= least) & (len(rows) - nl >= least)
            if ok.any():
                gain = np.where(ok, gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - parent, -np.inf)
                k = int(gain.argmax())
                if best is None or gain[k] > best[0]:
                    best = (gain[k], f, k)
    if best is None or best[0] < 1e-6:
        pred[rows] = -grad[rows].sum() / (hess[rows].sum() + 1)
        return
    _, f, k = best
    left = codes[rows, f] <= k
    for side, greater in ((rows[left], False), (rows[~left], True)):
        _grow(codes, cuts, grad, hess, side, depth - 1, least, (*path, (STATS[f], greater, float(cuts[f][k]))), found, pred)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, seed: int = 7) -> list[Rule]:
    """Paths of all nodes of boosted trees; each distinct set of rows once."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 48))) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    found: list[Rule] = []
    margin = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        part = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        pred = np.zeros(len(y))
        mine: list[Rule] = []
        _grow(codes, cuts, p - y, p * (1 - p), part, depth, max(5, len(y) // 500), (), mine, pred)
        found += mine
        leaves = [r for r in mine if len(r) == depth or not any(len(q) > len(r) and q[: len(r)] == r for q in mine)]
        for r, held in zip(leaves, _holds(x, leaves).T.astype(bool)):
            margin[held] += rate * -(p - y)[held].sum() / ((p * (1 - p))[held].sum() + 1)
    kept, seen = [], set()
    for r, held in zip(found, _holds(x, found).T.astype(bool)) if found else []:
        if 0 < held.sum() < len(y) and (mark := np.packbits(held).tobytes()) not in seen:
            seen |= {mark, np.packbits(~held).tobytes()}
            kept.append(r)
    return kept


def _lasso(x, y, strength, start, steps):
    """Proximal gradient (FISTA) for logistic loss + strength * |weights|; the intercept is free."""
    a = np.hstack([np.ones((len(x), 1)), x])
    v = np.ones(a.shape[1])
    for _ in range(12):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * np.linalg.norm(a @ v) ** 2 / len(y) * 1.05 + 1e-9)
    w, z, t = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        g = a.T @ (1 / (1 + np.exp(-(a @ z))) - y) / len(y)
        new = z - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * strength, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, z, t = new, new + (t - 1) / t2 * (new - w), t2
    return w


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ensemble:
    """An ensemble for labels 0 and 1. Without both labels its score is constant: their mean, or 0.5 for no rows."""
    y = y.astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        mean = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Ensemble(float(np.log(mean / (1 - mean))))
    rules = tree_rules(x, y, seed=seed)
    held = _holds(x, rules)
    scale = np.maximum(held.std(axis=0), 0.02)
    base = held.mean(axis=0)
    z = (held - base) / scale
    check = np.random.default_rng(seed + 1).random(len(y)) < 0.25
    if y[~check].min() == y[~check].max():
        check[:] = False
    top = np.abs(z.T @ (y - y.mean())).max() / len(y)
    best, w = (np.inf, top), np.zeros(z.shape[1] + 1)
    for strength in top * np.array([0.1, 0.03, 0.01, 0.003, 0.001]):
        w = _lasso(z[~check], y[~check], strength, w, 120)
        if not check.any():
            best = (0.0, strength)
            continue
        m = w[0] + z[check] @ w[1:]
        loss = float(np.mean(np.logaddexp(0, m) - y[check] * m))
        if loss < best[0]:
            best = (loss, strength)
    w = _lasso(z, y, best[1], w, 250)
    use = np.flatnonzero(np.abs(w[1:]) > 1e-4)
    weights = w[1:][use] / scale[use]
    return Ensemble(float(w[0] - base[use] @ weights), [rules[i] for i in use], [float(v) for v in weights])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Ensemble:
    """Fit on the labelled rows of docs.

    Of labels (one row or more for an id; null ids and labels are ignored) the max_rows
    rows with the smallest hash of the id are used: a fixed sample with a size that
    doesn't grow with the input. Only their texts are read for statistics.
    """
    sample = (
        labels.select(F.col(id_col).alias("__id"), F.col(label).alias("__y"))
        .filter("__id is not null and __y is not null")
        .orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_rows)
    )
    rows = (
        docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")
        .select("__id", "__y", statistics_column(F.col("__text")).alias("s")).select("__id", "__y", "s.*").toPandas()
    )
    rows = rows.sort_values(list(rows.columns))
    return fit(rows[list(STATS)].to_numpy(np.float64).reshape(-1, len(STATS)), rows["__y"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Ensemble, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score, 0 to 1. Null and empty texts are scored by their statistics, all 0. Rows and columns stay."""
    return docs.withColumn("__stats", statistics_column(F.col(text_col))).withColumn(out, model.column("__stats")).drop("__stats")


def held_out(id_col: str) -> Column:
    """True for a third of the ids, from which no label is learnt; null ids: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
