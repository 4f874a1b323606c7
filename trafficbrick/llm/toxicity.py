"""Toxic passages by maximum-scoring segment search (operator 2).

* Every word (lower-cased run of letters) scores the log-odds of occurring in
  toxic against clean texts under an informative Dirichlet prior (the words' shares in all
  training texts), kept where it is significant. A word without a significant
  score of its own takes that of its longest beginning (7 to 3 letters) that has
  one. Each token also costs a fixed ``drift``, so that a neutral stretch loses.
* A linear-time scan finds all disjoint maximal-scoring segments of a text.
* Scores are calibrated as extreme values: with ``q`` the shares of the net scores that the
  tokens of clean texts get in the scan, ``lam`` the root of ``sum q exp(lam * s) = 1``
  and ``K`` fitted on the segments of clean texts, a segment of score S in n tokens has E-value ``K * n * exp(-lam * S)``.
  A passage is significant below ``max_e``. The evidence of a text is the sum of
  ``-log E`` over its significant passages; a logistic curve fitted on the
  training rows turns it into a score.

Word, token and segment counts over the training rows run as Spark aggregates; no text and no
segment reaches the driver.
"""

from __future__ import annotations

from functools import partial
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import LETTER, classes, lower, parts, run_sums
from .sampling import labelled_sample
from .wordhash import mix

PREFIXES = (7, 6, 5, 4, 3)
PRIOR_SHARE = 0.1       # weight of the prior, as a share of all counts
MIN_Z = 3.5
MIN_ODDS = 1.0
DRIFT = 0.05


class ToxicModel(NamedTuple):
    keys: np.ndarray        # sorted hashes of the words that score
    scores: np.ndarray
    drift: float
    lam: float
    log_k: float
    weights: tuple[float, float, float]     # intercept, evidence, best segment
    max_e: float


def _words(part) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys and character range of every word of a part.

    The keys are those of the whole word and of its first 7, 6, ... 3 letters
    (0 where the word has no more letters than that).
    """
    inside = classes()[part.points] == LETTER
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[part.offsets] = True
    n = len(inside)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    total, place = run_sums(lower()[part.points], start, stop)
    lens = stop - start
    keys = [mix(total[place + lens] - total[place] + lens.astype(np.uint64))]
    for k in PREFIXES:
        longer = lens > k
        head = mix(total[place + np.minimum(lens, k)] - total[place] + np.uint64(k << 32))
        keys.append(np.where(longer, head, np.uint64(0)))
    return keys, start, stop


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) -> (key, texts of label 1, texts of label 0)."""
    for b in batches:
        label = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for part in parts(b.column(0)):
            units, start, _ = _words(part)
            if not len(start):
                continue
            row = np.searchsorted(part.offsets, start, "right") - 1 + part.lo
            keys, row = np.concatenate(units), np.tile(row, len(units))
            order = np.lexsort((row, keys))
            keys, row = keys[order], row[order]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])]     # once for each text
            uniq, back = np.unique(keys[new], return_inverse=True)
            toxic = label[row[new]]
            pos = np.bincount(back[toxic], minlength=len(uniq))
            neg = np.bincount(back[~toxic], minlength=len(uniq))
            yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(pos), pa.array(neg)],
                                             ["key", "pos", "neg"])


def segments(place: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments of a sequence where ``place`` holds tokens of
    positive net score ``score`` and other tokens their (negative) ones.

    ``score`` are net values at ``place``; tokens between cost ``drift`` each,
    or more where ``score`` is negative. Linear time: a stack of candidates with
    the running sums left (L) and right (R) of each.
    """
    found: list[list[float]] = []       # L, R, first, last
    total, last = 0.0, -1
    for p, s in zip(place.tolist(), score.tolist()):
        total -= drift * (p - last - 1)
        last = p
        if s <= 0:
            total += s
            continue
        now = [total, total + s, p, p]
        total += s
        while found:
            k = len(found) - 1
            while k >= 0 and found[k][0] >= now[0]:
                k -= 1
            if k < 0 or found[k][1] >= now[1]:
                break
            now = [found[k][0], now[1], found[k][2], now[3]]
            del found[k:]
        found.append(now)
    return [(r - left, int(a), int(b)) for left, r, a, b in found]


def _which(units: list[np.ndarray], model: ToxicModel) -> np.ndarray:
    """The number of the model's word that each word scores as: the whole word if it is one,
    else its longest beginning that is (-1: none)."""
    which = np.full(len(units[0]), -1, dtype=np.int64)
    if len(model.keys):
        for keys in units:
            at = np.minimum(np.searchsorted(model.keys, keys), len(model.keys) - 1)
            new = (model.keys[at] == keys) & (which < 0)
            which[new] = at[new]
    return which


def _lookup(units: list[np.ndarray], model: ToxicModel) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that score, and their net scores."""
    which = _which(units, model)
    place = np.flatnonzero(which >= 0)
    return place, model.scores[which[place]] - model.drift


def _evidence(found: list[tuple[float, int, int]], n: int, model: ToxicModel) -> tuple[float, float, list]:
    """Evidence, best segment's -log E (0 at least), and the significant segments."""
    total = best = 0.0
    kept = []
    for s, a, b in found:
        minus_log_e = model.lam * s - model.log_k - np.log(max(n, 1))
        best = max(best, minus_log_e, model.lam * s / 10)
        if minus_log_e > -np.log(model.max_e):
            total += minus_log_e
            kept.append((s, a, b))
    return total, best, kept


def _score_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(text, rest) -> rest and evidence, best, passages (struct of first and last character, score)."""
    m: ToxicModel = model.value
    for b in batches:
        evidence, best = np.zeros(b.num_rows), np.zeros(b.num_rows)
        passages: list[list] = [[] for _ in range(b.num_rows)]
        long_row: tuple[int, int, int] = (-1, 0, 0)     # row, words and characters seen of a long text
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> None:
            row, n, _ = long_row
            if row >= 0 and held:
                place, net, lo, hi = (np.concatenate(x) for x in zip(*held))
                take(row, n, place, net, lo, hi)
            held.clear()

        def take(row, n, place, net, lo, hi) -> None:
            found = segments(place, net, m.drift)
            evidence[row], best[row], kept = _evidence(found, n, m)
            spans = dict(zip(place.tolist(), zip(lo.tolist(), hi.tolist())))
            passages[row] = [{"first": spans[x][0], "last": spans[y][1], "score": s} for s, x, y in kept]

        for part in parts(b.column(0)):
            units, start, stop = _words(part)
            place, net = _lookup(units, m)
            if part.hi - part.lo == 1:      # maybe one stretch of a long text
                if long_row[0] != part.lo:
                    close()
                    long_row = (part.lo, 0, 0)
                held.append((place + long_row[1], net, start[place] + long_row[2], stop[place] + long_row[2]))
                long_row = (part.lo, long_row[1] + len(start), long_row[2] + len(part.points))
                continue
            close()
            long_row = (-1, 0, 0)
            first = np.searchsorted(start, part.offsets)
            cuts = np.searchsorted(place, first)
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                x = slice(cuts[r], cuts[r + 1])
                base = part.offsets[r]
                take(part.lo + r, first[r + 1] - first[r], place[x] - first[r], net[x], start[place[x]] - base,
                     stop[place[x]] - base)
        close()
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(evidence), pa.array(best), pa.array(passages, kind)],
                                         ["rest", "evidence", "best", "passages"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic fit by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _lambda(share: np.ndarray, net: np.ndarray) -> float:
    """The positive root of ``sum(share * exp(lam * net)) = 1`` (1.0 where there is none below 20)."""
    if not (net > 0).any() or (share * net).sum() >= 0:
        return 1.0
    lo, hi = 1e-6, 20.0
    for _ in range(100):
        mid = (lo + hi) / 2
        if (share * np.exp(mid * net)).sum() > 1:
            hi = mid
        else:
            lo = mid
    return lo


def _token_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(text) -> (which, n): how many tokens score as word number ``which`` of the model (-1: none do)."""
    m: ToxicModel = model.value
    for b in batches:
        many = np.zeros(len(m.keys) + 1, dtype=np.int64)
        for part in parts(b.column(0)):
            units, start, _ = _words(part)
            which = _which(units, m)
            many += np.bincount(which + 1, minlength=len(many))
        found = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(found - 1), pa.array(many[found])], ["which", "n"])


def fit(sample: DataFrame, text_col: str = "text", label_col: str = "label", max_e: float = 1.0) -> ToxicModel:
    """A model from rows of text and 0/1 label (a bounded table).

    What reaches the driver: the significant words (each occurs in several texts), a count of clean
    tokens for each of them, two numbers about the segments of clean texts, and three of each row. Without rows of
    both labels nothing scores, and every score is the share of label 1 (0 without rows, as for an empty table).
    Null texts count as empty.
    """
    spark = sample.sparkSession
    rows = sample.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label"))
    counts = (rows.mapInArrow(_count_batches, "key bigint, pos bigint, neg bigint").where("key != 0")
                  .groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    n = counts.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("neg")).first()
    share = rows.agg(F.avg("label").alias("y")).first().y or 0.0
    weight = PRIOR_SHARE * (n.pos + n.neg)
    prior = F.lit(PRIOR_SHARE) * (F.col("pos") + F.col("neg"))
    odds = lambda c, total: F.log((F.col(c) + prior) / (F.lit(total + weight) - F.col(c) - prior))
    z = F.col("odds") / F.sqrt(1 / (F.col("pos") + prior) + 1 / (F.col("neg") + prior))
    top = (counts.withColumn("odds", odds("pos", n.pos) - odds("neg", n.neg)).withColumn("z", z)
                 .where((F.abs("z") >= MIN_Z) & (F.abs("odds") >= MIN_ODDS)).select("key", "odds").collect())
    top.sort(key=lambda r: r.key & (1 << 64) - 1)
    keys = np.array([r.key for r in top], dtype=np.int64).view(np.uint64)
    scores = np.array([r.odds for r in top])
    model = ToxicModel(keys, scores, DRIFT, 1.0, 0.0, (0.0, 0.0, 0.0), max_e)
    # the tokens that the scan of clean texts meets, by the score each really gets
    clean = rows.where(F.col("label") == 0).select("text")
    held = spark.sparkContext.broadcast(model)
    tokens = {r.which: r.n for r in clean.mapInArrow(partial(_token_batches, model=held), "which bigint, n bigint")
                                         .groupBy("which").agg(F.sum("n").alias("n")).collect()}
    total = sum(tokens.values())
    # half a token more for each word, as one that clean texts have not shown may still occur in them
    q = np.array([tokens.get(-1, 0)] + [tokens.get(k, 0) + 0.5 for k in range(len(keys))])
    model = model._replace(lam=_lambda(q / max(q.sum(), 1), np.r_[0.0, scores] - DRIFT))
    # K: as many segments of clean texts above the median as the formula expects
    found = (score_segments(spark, clean.withColumn("rest", F.lit(0)), model._replace(max_e=np.inf))
             .select(F.explode("passages.score").alias("s")))
    level = found.agg(F.percentile_approx("s", 0.5, F.lit(10_000)).alias("m")).first().m
    if level is not None and total:
        above = found.where(F.col("s") >= level).count()
        model = model._replace(log_k=float(np.log(above / total) + model.lam * level))
    pairs = (score_segments(spark, rows.select("text", F.col("label").alias("rest")), model)
             .select("rest", "evidence", "best").collect())
    if not pairs or not 0 < share < 1:
        odds0 = np.log(share / (1 - share)) if 0 < share < 1 else (30.0 if share else -30.0)
        return model._replace(weights=(float(odds0), 0.0, 0.0))
    y, x = np.array([p[0] for p in pairs], dtype=float), np.log1p(np.array([p[1:] for p in pairs]))
    return model._replace(weights=tuple(map(float, _logistic(x, y))))


def score_segments(spark, rows: DataFrame, model: ToxicModel) -> DataFrame:
    """``rows`` (text, rest) -> rest, evidence, best, passages."""
    held = spark.sparkContext.broadcast(model)
    return rows.select("text", "rest").mapInArrow(
        partial(_score_batches, model=held),
        f"rest {rows.schema['rest'].dataType.simpleString()}, evidence double, best double, "
        "passages array<struct<first: bigint, last: bigint, score: double>>")


def score_toxicity(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """``rest`` (struct of all columns of ``docs``), ``score`` (0 to 1), ``predicted``,
    and the significant ``passages`` (characters first..last, segment score).

    Null, empty and wordless texts have no passage and the score of none. Long
    texts are scanned whole. Repeated rows are scored alike; an empty table gives an empty result.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*docs.columns).alias("rest"))
    a, b, c = model.weights
    logit = F.lit(a) + F.lit(b) * F.log1p("evidence") + F.lit(c) * F.log1p("best")
    return (score_segments(docs.sparkSession, rows, model)
            .select("rest", (1 / (1 + F.exp(-logit))).alias("score"), "passages")
            .select("rest", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages"))


def train(spark, docs: DataFrame, sf_dir: str) -> ToxicModel:
    """Fit on the labelled rows of ``docs`` outside the held-out fold."""
    from ..session import read_table
    return fit(labelled_sample(docs, read_table(spark, sf_dir, "labels"), "toxic"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    from ..session import read_table
    from .sampling import held_out
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, train(spark, docs, sf_dir))
    return out.select(F.col("rest.doc_id").alias("doc_id"), held_out("rest.doc_id").alias("held_out"),
                      "score", "predicted", F.col("passages"))
