"""Quality by a sparse rule ensemble (operator 8).

Shallow boosted trees are grown on statistics of the labelled texts; every path
from a root to a node is a conjunctive rule ``stat <= a AND other > b ...``. A
logistic model with an L1 penalty keeps few of the rules, and those are compiled
into one Spark column expression over the statistics' columns.

The statistics of all texts come from one vectorised pass inside tasks. Only the
statistics of the bounded training sample reach the driver, where the trees and
the penalised weights are fitted.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import held_out, labelled_sample
from .wordhash import Words, rolling, slices, text_bytes

STATS = ["log_words", "word_length", "longest_word", "sign_share", "exclaim_share", "digit_share", "upper_share",
         "lower_share", "other_byte_share", "repeat_share", "distinct_share", "window_repeat_share", "line_share",
         "stop_share", "comma_share", "bar_share", "odd_end_share"]


def _set(chars: str) -> np.ndarray:
    hit = np.zeros(256, dtype=np.float64)
    hit[[ord(c) for c in chars]] = 1
    return hit


_UPPER, _LOWER = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set("abcdefghijklmnopqrstuvwxyz")
_DIGIT, _SIGN = _set("0123456789"), _set("#$%&*+/<=>@[\\]^_`{|}~")
_HIGH = np.r_[np.zeros(128), np.ones(128)]
_ODD_END = _set("#$%&*+/<=>@[\\^_`{|~!")


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of ``STATS`` for each text (all zero without words)."""
    w = Words(data, offs)
    many = np.diff(w.first)
    out = np.zeros((len(many), len(STATS)))
    if not len(w):
        return out
    words = np.maximum(many, 1)
    bytes_ = np.maximum(np.diff(offs), 1)

    def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0.0, np.cumsum(values)][first])

    def share(hit: np.ndarray) -> np.ndarray:
        return per_text(hit[data], offs) / bytes_

    lens = (w.end - w.start).astype(np.float64)
    text = np.repeat(np.arange(len(many)), many)
    h = w.hashes()
    same = np.r_[False, (h[1:] == h[:-1]) & (text[1:] == text[:-1])]
    order = np.lexsort((h, text))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])]
    distinct = np.bincount(text[order][new], minlength=len(many))
    at, owner = w.windows(5)
    if len(at):
        g = rolling(h, 5, 4)[at]
        order = np.lexsort((g, owner))
        new = np.r_[True, (g[order][1:] != g[order][:-1]) | (owner[order][1:] != owner[order][:-1])]
        windows = np.maximum(np.bincount(owner, minlength=len(many)), 1)
        repeated = np.where(many >= 5, 1 - np.bincount(owner[order][new], minlength=len(many)) / windows, 0.0)
    else:
        repeated = np.zeros(len(many))
    longest = np.zeros(len(many))
    some = many > 0
    longest[some] = np.maximum.reduceat(lens, w.first[:-1][some])
    letters = np.maximum(per_text(_UPPER[data] + _LOWER[data], offs), 1)
    found = {
        "log_words": np.log1p(many), "word_length": per_text(lens, w.first) / words, "longest_word": np.log1p(longest),
        "sign_share": share(_SIGN), "exclaim_share": share(_set("!")), "digit_share": share(_DIGIT),
        "upper_share": per_text(_UPPER[data], offs) / letters, "lower_share": share(_LOWER),
        "other_byte_share": share(_HIGH), "repeat_share": per_text(same.astype(float), w.first) / words,
        "distinct_share": distinct / words, "window_repeat_share": repeated,
        "line_share": per_text(_set("\n")[data], offs) / words, "stop_share": per_text(_set(".")[data], offs) / words,
        "comma_share": per_text(_set(",")[data], offs) / words, "bar_share": per_text(_set("|")[data], offs) / words,
        "odd_end_share": per_text(_ODD_END[data[w.end - 1]], w.first) / words,
    }
    for k, name in enumerate(STATS):
        out[:, k] = np.where(some, found[name], 0.0)
    return out


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs = text_bytes(b.column(0))
        for i, j in slices(offs):
            s = statistics(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), *[pa.array(c) for c in s.T]], ["rest", *STATS])


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``rest`` (struct of all columns of ``docs``) and a column for each of ``STATS``."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*docs.columns).alias("rest"))
    return rows.mapInArrow(_stat_batches, f"rest {rows.schema['rest'].dataType.simpleString()}, "
                           + ", ".join(f"{c} double" for c in STATS))


# ---------------------------------------------------------------- fitting (bounded rows, on the driver)
class Rule(NamedTuple):
    """All of ``(stat, above, limit)`` hold: ``stat > limit`` or else ``stat <= limit``."""
    terms: tuple[tuple[str, bool, float], ...]
    weight: float


class RuleModel(NamedTuple):
    intercept: float
    rules: list[Rule]


def _grow(codes: np.ndarray, rows: np.ndarray, residual: np.ndarray, hess: np.ndarray, bins: int, depth: int,
          path: tuple, paths: list, value: np.ndarray) -> None:
    """Split ``rows`` where the second-order gain is largest; leaves write their step to ``value``."""
    g, h = residual[rows].sum(), hess[rows].sum()
    best = (1e-3, -1, -1)
    if depth and len(rows) >= 40:
        for f in range(codes.shape[1]):
            c = codes[rows, f]
            gl = np.cumsum(np.bincount(c, residual[rows], bins))[:-1]
            hl = np.cumsum(np.bincount(c, hess[rows], bins))[:-1]
            nl = np.cumsum(np.bincount(c, minlength=bins))[:-1]
            gain = gl ** 2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g ** 2 / (h + 1)
            gain[(nl < 20) | (len(rows) - nl < 20)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
    if best[1] < 0:
        value[rows] = g / (h + 1)
        return
    _, f, k = best
    left = codes[rows, f] <= k
    for side, part in ((False, rows[left]), (True, rows[~left])):
        here = path + ((f, side, k),)
        paths.append(here)
        _grow(codes, part, residual, hess, bins, depth - 1, here, paths, value)


def _simplify(path: tuple) -> tuple:
    """One tightest limit for each statistic and side."""
    tight: dict[tuple[int, bool], int] = {}
    for f, side, k in path:
        tight[f, side] = max(k, tight.get((f, side), k)) if side else min(k, tight.get((f, side), k))
    return tuple(sorted((f, side, k) for (f, side), k in tight.items()))


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, w: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic weights (intercept first, not penalised) by accelerated proximal gradient steps."""
    n = len(y)
    step = 4 * n / max(np.linalg.norm(x, 2) ** 2, 1e-9)
    z, t = w.copy(), 1.0
    for _ in range(steps):
        grad = x.T @ (1 / (1 + np.exp(-np.clip(x @ z, -30, 30))) - y) / n
        new = z - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t1 * (new - w)
        w, t = new, t1
    return w


def fit_rules(stats: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 48,
              rate: float = 0.2) -> RuleModel:
    """Rules and weights from rows of statistics; the penalty is chosen on a fifth of the rows."""
    share = float(np.mean(y)) if len(y) else 0.0
    if not 0 < share < 1:
        return RuleModel(30.0 if share else -30.0, [])
    limits = [np.unique(np.quantile(stats[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(stats.shape[1])]
    codes = np.stack([np.searchsorted(limits[f], stats[:, f], "left") for f in range(stats.shape[1])], axis=1)
    score = np.full(len(y), np.log(share / (1 - share)))
    start, paths = float(score[0]), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        value = np.zeros(len(y))
        _grow(codes, np.arange(len(y)), y - p, p * (1 - p), bins, depth, (), paths, value)
        score += rate * value
    rules = list(dict.fromkeys(_simplify(p) for p in paths))
    hit = np.ones((len(y), len(rules)), dtype=bool)
    for k, rule in enumerate(rules):
        for f, side, c in rule:
            hit[:, k] &= (codes[:, f] > c) == side
    _, first = np.unique(hit, axis=1, return_index=True)       # rules that hold for the same rows are one
    first = np.sort(first[(hit[:, first].mean(axis=0) > 0) & (hit[:, first].mean(axis=0) < 1)])
    rules, hit = [rules[k] for k in first], hit[:, first]
    spread = np.maximum(hit.std(axis=0), 0.05)
    x = np.c_[np.ones(len(y)), (hit - hit.mean(axis=0)) / spread]
    test = np.arange(len(y)) % 5 == 4
    w, best = np.r_[start, np.zeros(len(rules))], (np.inf, 0.01)
    for penalty in (0.03, 0.01, 0.003, 0.001):
        w = _lasso(x[~test], y[~test], penalty, w, 200)
        p = np.clip(1 / (1 + np.exp(-np.clip(x[test] @ w, -30, 30))), 1e-6, 1 - 1e-6)
        loss = -np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))
        best = min(best, (float(loss), penalty))
    w = _lasso(x, y, best[1], w)
    kept = [Rule(tuple((STATS[f], side, float(limits[f][c])) for f, side, c in rule), float(v / s))
            for rule, v, s in zip(rules, w[1:], spread) if abs(v) > 1e-4]
    shift = sum(v * m / s for v, m, s in zip(w[1:], hit.mean(axis=0), spread) if abs(v) > 1e-4)
    return RuleModel(float(w[0] - shift), kept)


def rule_column(model: RuleModel) -> Column:
    """The model as a column expression over ``STATS``: a score from 0 to 1."""
    logit = F.lit(model.intercept)
    for rule in model.rules:
        hold = F.lit(True)
        for stat, above, limit in rule.terms:
            hold = hold & ((F.col(stat) > limit) if above else (F.col(stat) <= limit))
        logit = logit + F.when(hold, F.lit(rule.weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-logit))


def train(spark, docs: DataFrame, sf_dir: str) -> RuleModel:
    """Fit on the labelled rows of ``docs`` outside the held-out fold (a bounded sample)."""
    from ..session import read_table
    sample = labelled_sample(docs, read_table(spark, sf_dir, "labels"), "quality")
    rows = with_statistics(sample).select(F.col("rest.label").alias("label"), F.xxhash64("rest.text").alias("key"), *STATS)
    table = sorted(tuple(r) for r in rows.collect())        # at most MAX_ROWS rows of numbers, in a fixed order
    y = np.array([r[0] for r in table], dtype=float)
    order = np.argsort([r[1] for r in table], kind="stable")
    stats = np.array([r[2:] for r in table], dtype=float).reshape(-1, len(STATS))
    return fit_rules(stats[order], y[order])


def score_quality(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``rest`` (struct of all columns of ``docs``), ``score`` (0 to 1), ``predicted``.

    Null, empty and wordless texts have all statistics 0 and the score of that.
    Whole texts count; repeated rows are scored alike; an empty table gives an empty result.
    """
    return (with_statistics(docs, text_col).select("rest", rule_column(model).alias("score"))
            .select("rest", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    from ..session import read_table
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, train(spark, docs, sf_dir))
    return out.select(F.col("rest.doc_id").alias("doc_id"), held_out("rest.doc_id").alias("held_out"), "score", "predicted")
