"""Quality classifier: a sparse rule ensemble over text statistics, scored by Spark column expressions.

Statistics of a text are built-in Spark functions. A bounded sample of labelled rows is collected; small regression trees are grown on
it by gradient boosting, each path from a root becomes a conjunctive rule, and a logistic model with lasso penalty keeps few of the rules.
The model is then a sum of weighted conditions, compiled into one column expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.durable import as_id

#: Labelled rows used to fit, those with the least hashes of their ids.
FIT_ROWS = 20_000
TREES, DEPTH, LASSO = 40, 3, 2e-3
THRESHOLD = 0.7

#: Per-text counts; ratios are taken against the number of words or characters.
_PER_WORD = {
    "repeated": r"(?<!\S)(\S++)(?=\s++\1(?!\S))",
    "bars": r"(?<!\S)\|(?!\S)",
    "symbols": r"[#&%$*<>=_~^{}\[\]\\]{2,}",
    "shouts": r"!{2,}",
    "ends": r"[.!?](?!\S)",
    "numbers": r"(?<!\S)[0-9]++",
}
_PER_CHAR = {"upper": r"\p{Lu}", "digits": r"[0-9]", "lines": r"\n"}


def counts(text: Column) -> dict[str, Column]:
    """What statistics are taken from, name to column. A null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    return {"chars": F.length(text).cast("double"), "words": count(r"\S++")} | {k: count(p) for k, p in (_PER_WORD | _PER_CHAR).items()}


def ratios(found: dict[str, Column]) -> dict[str, Column]:
    """Statistics of counts, name to column. No ratio is ever null."""
    chars, words = found["chars"], found["words"]
    out = {"chars": chars, "words": words, "word_length": chars / F.greatest(words, F.lit(1.0))}
    out |= {k: found[k] / F.greatest(words, F.lit(1.0)) for k in _PER_WORD}
    return out | {k: found[k] / F.greatest(chars, F.lit(1.0)) for k in _PER_CHAR}


def statistics(text: Column) -> dict[str, Column]:
    return ratios(counts(text))


def given(values: dict[str, Column], use: Callable[[dict[str, Column]], Column]) -> Column:
    """What use() makes of values that stand in the expression once, however often it names them: no plan into which the column is moved repeats them."""
    one = F.array(F.struct(*(c.alias(k) for k, c in values.items())))
    return F.transform(one, lambda s: use({k: s[k] for k in values}))[0]


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, greater, bound) that must all hold, and a weight."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, stats: dict[str, Column]) -> Column:
        """The probability of label 1."""
        total = F.lit(self.intercept)
        for r in self.rules:
            met = F.lit(True)
            for name, greater, bound in r.conditions:
                met = met & ((stats[name] > bound) if greater else (stats[name] <= bound))
            total = total + F.when(met, F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _split(x: np.ndarray, g: np.ndarray, least: int) -> tuple[float, int, float]:
    """(gain, statistic, bound) of the best split of residuals g by squared error."""
    best = (1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(g[order])
        n = np.arange(1, len(v))
        gain = s[:-1] ** 2 / n + (s[-1] - s[:-1]) ** 2 / (len(v) - n) - s[-1] ** 2 / len(v)
        gain[(v[1:] <= v[:-1]) | (n < least) | (len(v) - n < least)] = -1
        at = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and gain[at] > best[0]:
            best = (float(gain[at]), f, float((v[at] + v[at + 1]) / 2))
    return best


def _grow(x: np.ndarray, g: np.ndarray, rows: np.ndarray, path: tuple, depth: int, out: np.ndarray, paths: list, least: int) -> None:
    gain, f, bound = _split(x[rows], g[rows], least) if depth and len(rows) >= 2 * least else (0, -1, 0)
    if f < 0:
        out[rows] = g[rows].mean() if len(rows) else 0
        return
    high = x[rows, f] > bound
    for greater, part in ((False, rows[~high]), (True, rows[high])):
        paths.append((*path, (f, greater, bound)))
        _grow(x, g, part, paths[-1], depth - 1, out, paths, least)


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 7) -> RuleEnsemble:
    """Fits to rows of statistics x and labels y (0 or 1). Without both labels the score is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return RuleEnsemble(base, ())
    random, margin, paths = np.random.default_rng(seed), np.full(len(y), base), []
    least = max(2, len(y) // 500)
    for _ in range(trees):
        g = y - 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(random.random(len(y)) < 0.5)
        columns = np.sort(random.choice(len(names), max(2, 2 * len(names) // 3), replace=False))
        step, found = np.zeros(len(y)), []
        _grow(x[:, columns], g, rows, (), depth, step, found, least)
        paths += [tuple((int(columns[f]), up, b) for f, up, b in p) for p in found]
        margin += step
    paths = sorted(set(paths))
    seen: dict[bytes, int] = {}  # of rules that hold for the same rows the first, held as bits
    for k, p in enumerate(paths):
        met = np.ones(len(y), bool)
        for f, greater, bound in p:
            met &= (x[:, f] > bound) if greater else (x[:, f] <= bound)
        if met.any() and not met.all():
            seen.setdefault(np.packbits(met).tobytes(), k)
    unique = list(seen.values())
    m = np.empty((len(y), len(unique)), np.float32)  # zeros and ones
    for j, bits in enumerate(seen):
        m[:, j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(y))
    del seen
    if not unique:
        return RuleEnsemble(base, ())
    w, b, z, zb, t = np.zeros(m.shape[1]), base, np.zeros(m.shape[1]), base, 1.0
    rate = 4 / (np.linalg.norm(m[: min(len(m), 4000)], 2) ** 2 * len(m) / min(len(m), 4000) / len(m) + 1)
    for _ in range(600):  # proximal gradient steps with momentum
        e = 1 / (1 + np.exp(-(m @ z.astype(np.float32) + zb))) - y
        new = z - rate * (e.astype(np.float32) @ m) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * lasso, 0)
        nb, nt = zb - rate * e.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return RuleEnsemble(float(b), tuple(Rule(tuple((names[f], up, bd) for f, up, bd in paths[unique[k]]), float(w[k])) for k in np.flatnonzero(w)))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> RuleEnsemble:
    """Learns from at most fit_rows labelled rows with crc32(id) mod 4 other than 2. Rows with null id or label, or labels other than 0 and 1, are left out."""
    chosen = labels.select(as_id(F.col(f"`{id_col}`")).alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    chosen = chosen.where(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2).orderBy(F.xxhash64("id"), "id", "y").limit(fit_rows)
    texts = docs.select(as_id(F.col(f"`{id_col}`")).alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id")
    stats = statistics(F.col("text"))
    rows = texts.select("y", "id", *(c.alias(k) for k, c in stats.items())).orderBy("id", "y", *stats).limit(fit_rows).toArrow()
    x = np.stack([rows.column(k).to_numpy() for k in stats], 1).astype(np.float64)
    y = rows.column("y").to_numpy().astype(np.float64)
    del rows
    return fit_rules(x, y, list(stats))


def score_quality(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of docs with held_out, score and predicted added (columns of these names are replaced).

    Null and empty texts get a score too. Input columns of any other name stay as they are. A null id counts as not held out. Labels, language, source and id are no inputs of a score.
    """
    names = ["held_out", "score", "predicted"]
    held = F.coalesce(F.crc32(as_id(F.col(f"`{id_col}`")).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    score = given(counts(F.col(f"`{text_col}`")), lambda n: given(ratios(n), model.score))
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return docs.select(*rest, held.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
