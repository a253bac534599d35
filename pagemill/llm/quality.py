"""Quality classifier: a sparse rule ensemble compiled to Spark column expressions.

Each document is reduced to a dozen statistics by built-in functions. On a bounded sample of
labelled rows (SAMPLE at most, those of least hashed id) shallow trees are grown on boosted
residuals; every path in a tree is a rule, a conjunction of bounds on statistics; a logistic
regression with an L1 penalty keeps few of them. The kept rules become one column
expression, so scoring is a projection without Python.

Defined results: null and empty texts have all-zero statistics and a score like any other;
statistics without a value are zero; with fewer than two labels to learn from, the score is
the share of label 1 (one half without any); repeated rows repeat their result; labels that
are null are not learnt from, and of two different ones the larger counts; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored

#: Labelled rows to learn from at most: the documented bound of the sample.
SAMPLE = 20_000
#: Trees, their depth, rows in a leaf at least, share of a tree's fit that is kept, cut points tried for a statistic.
TREES, DEPTH, LEAF_ROWS, RATE, CUTS = 24, 3, 10, 0.3, 32
#: L1 penalty as a share of the smallest one that drops every rule, and rounds of the fit.
PENALTY, STEPS = 0.01, 600
#: Score from which a document is predicted to have label 1.
THRESHOLD = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name; all are zero for null and empty texts."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, n_words = F.length(whole), F.size(words)
    share = lambda part, of: F.coalesce(part / F.nullif(of, F.lit(0)), F.lit(0.0)).cast("double")
    rest = F.translate(whole, "abcdefghijklmnopqrstuvwxyz ", "")  # most of a text goes in one pass, what follows reads the rest
    left = lambda chars: F.length(rest) - F.length(F.translate(rest, chars, ""))
    return {
        "log_chars": F.log1p(n.cast("double")),
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": share(n, n_words),
        "distinct_words": share(F.size(F.array_distinct(words)), n_words),
        "symbols": share(left("#$%&*@^~<>{}[]\\=+_"), n),
        "bars": share(left("|"), n),
        "digits": share(left("0123456789"), n),
        "stops": share(left(".,;:!?"), n),
        "lines": share(left("\n"), n_words),
        "capitals": share(left("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n),
        "bytes": share(F.octet_length(whole), n),
        "short_words": share(F.size(F.filter(words, lambda w: F.length(w) <= 3)), n_words),
    }


Rule = tuple[tuple[int, float, bool], ...]  # (statistic, bound, above): x > bound if above, else x <= bound


def _grow(x: np.ndarray, target: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, path: Rule, found: list[Rule], fit: np.ndarray) -> None:
    """A least-squares tree on the rows; found gets every path, fit the leaf means."""
    best = None
    if depth and len(rows) >= 2 * LEAF_ROWS:
        y, total = target[rows], target[rows].sum()
        for k, bounds in enumerate(cuts):
            if not len(bounds):
                continue
            place = np.searchsorted(bounds, x[rows, k], "left")  # x <= bounds[i] for place <= i
            count = np.cumsum(np.bincount(place, minlength=len(bounds) + 1))[:-1]
            below = np.cumsum(np.bincount(place, y, len(bounds) + 1))[:-1]
            fits = (count >= LEAF_ROWS) & (len(rows) - count >= LEAF_ROWS)
            if fits.any():
                gain = np.where(fits, below**2 / np.maximum(count, 1) + (total - below) ** 2 / np.maximum(len(rows) - count, 1), -np.inf)
                i = int(gain.argmax())
                if best is None or gain[i] > best[0]:
                    best = (gain[i], k, float(bounds[i]))
        if best and best[0] <= total**2 / len(rows) + 1e-9:
            best = None
    if best is None:
        fit[rows] = target[rows].mean() if len(rows) else 0
        return
    _, k, bound = best
    above = x[rows, k] > bound
    for side, some in ((False, rows[~above]), (True, rows[above])):
        longer = (*path, (k, bound, side))
        found.append(longer)
        _grow(x, target, some, cuts, depth - 1, longer, found, fit)


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Distinct rules of boosted trees; each tree sees a different half of the rows."""
    rng = np.random.default_rng(0)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")) for k in range(x.shape[1])]
    base = np.clip(y.mean(), 0.01, 0.99)
    margin, rules = np.full(len(y), np.log(base / (1 - base))), []
    for _ in range(TREES):
        residual, fit, found = y - 1 / (1 + np.exp(-margin)), np.zeros(len(y)), []
        rows = np.sort(rng.choice(len(y), max(len(y) // 2, min(len(y), 4 * LEAF_ROWS)), replace=False))
        _grow(x, residual, rows, cuts, DEPTH, (), found, fit)
        rules += found
        if not found:
            break
        margin += RATE * 4 * fit
    return list(dict.fromkeys(tuple(sorted(rule)) for rule in rules))


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, k] > bound) == above for k, bound, above in rule])


def lasso_logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights by accelerated proximal gradient on centred columns."""
    mean = z.mean(axis=0)
    c = z - mean
    step = 4 * len(y) / max(np.linalg.norm(c, 2) ** 2, 1e-9)
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias, weight = np.log(base / (1 - base)), np.zeros(z.shape[1])
    penalty = PENALTY * np.abs(c.T @ (y - y.mean())).max(initial=0) / len(y)
    ahead, momentum = weight, 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(c @ ahead + bias))) - y
        bias -= error.mean()
        moved = ahead - step * (c.T @ error) / len(y)
        fresh = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, weight, momentum = fresh + (momentum - 1) / after * (fresh - weight), fresh, after
    return float(bias - mean @ weight), weight


@dataclass
class RuleModel:
    names: list[str]
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """Probability of label 1 from columns of statistics."""
        margin = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for k, bound, above in rule:
                holds = holds & ((F.col(self.names[k]) > bound) if above else (F.col(self.names[k]) <= bound))
            margin = margin + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    if len(np.unique(y)) < 2:
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return RuleModel(names, float(np.log(share / (1 - share))), [])
    rules = grow_rules(x, y)
    if not rules:
        share = y.mean()
        return RuleModel(names, float(np.log(share / (1 - share))), [])
    bias, weights = lasso_logistic(np.stack([applies(r, x) for r in rules], axis=1).astype(float), y)
    return RuleModel(names, bias, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6])


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, learnt (may be learnt from), score, predicted. learn is a condition on key."""
    stats = statistics(F.col(text))
    names = list(stats)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learnt"), *(c.alias(n) for n, c in stats.items()))
    rows = stored(rows, "statistics")
    marked = labels.filter(F.col(label).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.max(label).cast("double").alias("label"))
    # the sample is chosen among the labels alone, by hash buckets that hold a few times `sample` rows in all
    known = rows.filter("learnt").join(marked, "doc_id").withColumn("place", F.xxhash64("doc_id"))
    n = known.count()
    if n > sample:
        bound = -(2**63) + int(2**64 * min(1.0, 1.2 * sample / n))
        known = known.filter(F.col("place") <= bound).orderBy("place", "doc_id", *names).limit(sample)
    data = known.select("doc_id", *names, "label").orderBy("doc_id", *names).toPandas()
    model = fit_rules(data[names].to_numpy(float), data["label"].to_numpy(float), names)
    return rows.select("doc_id", "learnt", model.score().alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
