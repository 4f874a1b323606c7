"""Language identification by a bidirectional gated recurrent network over bytes (operator 12).

The network reads a text's UTF-8 bytes in blocks of ``BLOCK``, once forwards and once
backwards. In each direction a gated recurrent unit of ``HIDDEN`` states (update gate
``z``, reset gate ``r``, candidate ``c``) takes the byte's row of an input table and the
state before it; the two states at a byte give the probabilities of the languages *at
that byte*, so every position has a label. A document's probabilities are the mean of
those at its letters, over the whole text.

Training. The network is trained in numpy by backpropagation through time on a bounded
sample: of each language the ``ROWS`` rows of the smallest id hashes outside the held-out
fold, and of each the ``PIECES`` blocks spread evenly over the text. The sample lies in
``SHARDS`` shards; in each round every shard goes through its blocks in a Spark task
(Adam, batches of ``BATCH``), and the driver averages the shards' parameters: ``ROUNDS``
times about 100 KB a shard, whatever the table. The number of shards is fixed, so the
network does not depend on the cluster.

Labelling needs no shuffle: a task takes a slice of texts, cuts it into blocks and runs
them side by side. Blocks are sorted by length, so no step works on padding.
"""

from __future__ import annotations

import unicodedata
from functools import partial
from typing import Iterator, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written
from .wordhash import slices, splitmix, text_bytes

BLOCK = 96
HIDDEN = 16
ROWS = 800          # sampled rows of a language, the bound of the training sample
PIECES = 4          # blocks of each
SHARDS = 8
ROUNDS = 4
BATCH = 64
STEPS = 25          # batches of a shard in each round at least: few blocks are gone through again
RATE = 0.02
ABREAST = 2048      # blocks that a task runs side by side
UNKNOWN = "und"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Network(NamedTuple):
    """``langs`` and one array for each kind of weight; the first axis is the direction (forwards, backwards)."""
    langs: list[str]
    table: np.ndarray       # 2 x 3 x 256 x H: what a byte adds to z, r and c
    state: np.ndarray       # 2 x 3 x H x H: what the state before adds
    bias: np.ndarray        # 2 x H: of the state's part of c
    out: np.ndarray         # 2 x H x languages
    prior: np.ndarray       # languages

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.state, self.bias, self.out, self.prior]


def fresh_network(langs: list[str], hidden: int = HIDDEN) -> Network:
    """A network with fixed small weights."""
    def spread(seed: int, scale: float, *shape: int) -> np.ndarray:
        x = splitmix(int(np.prod(shape)), seed).astype(np.float64) / 2.0 ** 63 - 1
        return (x * scale).astype(np.float32).reshape(shape)

    scale = hidden ** -0.5
    return Network(langs, spread(61, scale, 2, 3, 256, hidden), spread(62, scale, 2, 3, hidden, hidden),
                   np.zeros((2, hidden), np.float32), spread(63, scale, 2, hidden, len(langs)), np.zeros(len(langs), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, through tanh."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place, over the last axis."""
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


class Blocks(NamedTuple):
    """Blocks of texts by falling length: their bytes (step by step) and lengths."""
    steps: np.ndarray       # steps x blocks
    alive: list[int]        # blocks that reach each step
    text: np.ndarray        # each block's text


def cut_blocks(offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of the blocks of some texts, by falling length."""
    lens = np.diff(offs)
    many = -(-lens // size)
    text = np.repeat(np.arange(len(lens)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start = offs[:-1][text] + nth * size
    length = np.minimum(size, offs[1:][text] - start)
    order = np.argsort(-length, kind="stable")
    return start[order], length[order], text[order]


def lay_out(data: np.ndarray, start: np.ndarray, length: np.ndarray, text: np.ndarray) -> Blocks:
    size = int(length[0])
    steps = data[np.minimum(start + np.arange(size)[:, None], len(data) - 1)]
    alive = np.searchsorted(-length, -np.arange(size), "left")
    return Blocks(steps, alive.tolist(), text)


def _states(net: Network, side: int, blocks: Blocks, keep: bool) -> tuple[np.ndarray, list]:
    """Every step's states in one direction (steps x blocks x H); with ``keep``, what the way back needs."""
    tz, tr, tc = net.table[side]
    uz, ur, uc = net.state[side]
    bias = net.bias[side]
    steps, n = blocks.steps.shape
    out = np.zeros((steps, n, len(uz)), dtype=np.float32)
    held: list = [None] * steps
    h = np.zeros((n, len(uz)), dtype=np.float32)
    for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
        m = blocks.alive[t]
        x, before = blocks.steps[t, :m], h[:m]
        z, r = tz[x], tr[x]
        z += before @ uz
        r += before @ ur
        _sigmoid(z)
        _sigmoid(r)
        inner = before @ uc
        inner += bias
        c = tc[x]
        c += r * inner
        np.tanh(c, out=c)
        now = out[t, :m]
        np.subtract(before, c, out=now)
        now *= z
        now += c
        if keep:
            held[t] = (before.copy(), z, r, c, inner)
        h = out[t]      # blocks that end later start from zeros when going backwards
    return out, held


def probabilities(net: Network, blocks: Blocks, keep: bool = False) -> tuple[np.ndarray, list]:
    """The languages' probabilities at every byte: steps x blocks x languages."""
    logits, kept = None, []
    for side in (0, 1):
        states, held = _states(net, side, blocks, keep)
        part = states.reshape(-1, states.shape[2]) @ net.out[side]
        logits = part + net.prior if logits is None else logits + part
        kept.append((states, held) if keep else None)
        del states, held
    return _softmax(logits.reshape(*blocks.steps.shape, -1)), kept


class Reader:
    """The network laid out for labelling: halved where sigmoids are taken through tanh."""

    def __init__(self, net: Network):
        half = np.array([0.5, 0.5, 1.0], dtype=np.float32)
        self.table = net.table * half[:, None, None]
        self.state = net.state * 0.5
        self.bias = net.bias * 0.5
        self.out = np.ascontiguousarray(net.out.transpose(0, 2, 1))
        self.prior = net.prior[:, None]

    def _steps(self, side: int, blocks: Blocks) -> Iterator[tuple[int, np.ndarray]]:
        """Each step and the states of the blocks that reach it, in the order of ``side``."""
        (tz, tr, tc), u, bias = self.table[side], self.state[side], self.bias[side]
        steps, n = blocks.steps.shape
        h = np.zeros((n, len(bias)), dtype=np.float32)
        room = np.empty((3, *h.shape), dtype=np.float32)
        spare = np.empty_like(room)
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            m = blocks.alive[t]
            x, now, gates, add = blocks.steps[t, :m], h[:m], room[:, :m], spare[:, :m]
            for k, rows in enumerate((tz, tr, tc)):
                np.take(rows, x, axis=0, out=gates[k], mode="clip")
                np.matmul(now, u[k], out=add[k])
            z, r, c = gates
            inner = add[2]
            inner += bias
            z += add[0]
            r += add[1]
            np.tanh(z, out=z)
            np.tanh(r, out=r)
            r += 1          # r * inner, both doubled and halved
            r *= inner
            c += r
            np.tanh(c, out=c)
            z += 1
            now -= c
            z *= now
            z *= 0.5
            np.add(c, z, out=now)
            yield t, now

    def label(self, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
        """Languages x blocks: the sum of probabilities at letters, and the letters labelled with each."""
        steps, n = blocks.steps.shape
        langs = len(self.prior)
        ahead = np.empty((steps, langs, n), dtype=np.float32)
        for t, now in self._steps(0, blocks):
            np.matmul(self.out[0], now.T, out=ahead[t, :, :len(now)])
        mass = np.zeros((langs, n), dtype=np.float32)
        labelled = np.zeros((langs, n), dtype=np.int32)
        for t, now in self._steps(1, blocks):
            p = self.out[1] @ now.T
            p += ahead[t, :, :len(now)]
            p += self.prior
            top = p.max(axis=0)
            letter = _LETTER[blocks.steps[t, :len(now)]]
            free = letter.copy()
            for k in range(langs):      # the first of equals
                own = free & (p[k] == top)
                free &= ~own
                labelled[k, :len(now)] += own
            p -= top
            np.exp(p, out=p)
            p *= letter / p.sum(axis=0)
            mass[:, :len(now)] += p
        return mass, labelled


def gradients(net: Network, blocks: Blocks, lang: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of the blocks' languages at every letter, and its gradient by the
    weights (backpropagation through time)."""
    p, kept = probabilities(net, blocks, keep=True)
    steps, n, _ = p.shape
    weight = np.zeros((steps, n), dtype=np.float32)
    for t, m in enumerate(blocks.alive):
        weight[t, :m] = _LETTER[blocks.steps[t, :m]]
    total = max(float(weight.sum()), 1.0)
    own = lang[blocks.text]
    loss = -float((np.log(p[:, np.arange(n), own] + 1e-9) * weight).sum()) / total
    p[:, np.arange(n), own] -= 1
    p *= (weight / total)[:, :, None]
    flat = p.reshape(-1, p.shape[2])
    grads = [np.zeros_like(w) for w in net.weights()]
    g_table, g_state, g_bias, g_out, g_prior = grads
    g_prior += flat.sum(axis=0)
    order = np.argsort(blocks.steps.ravel(), kind="stable")
    found, heads = np.unique(blocks.steps.ravel()[order], return_index=True)
    for side in (0, 1):
        states, held = kept[side]
        g_out[side] = states.reshape(-1, states.shape[2]).T @ flat
        arrive = (flat @ net.out[side].T).reshape(states.shape)
        uz, ur, uc = net.state[side]
        back = np.zeros(states.shape[1:], dtype=np.float32)
        moved = np.zeros((3, *states.shape), dtype=states.dtype)
        for t in range(steps - 1, -1, -1) if side == 0 else range(steps):
            m = blocks.alive[t]
            before, z, r, c, inner = held[t]
            d = arrive[t, :m] + back[:m]
            dz = d * (before - c) * z * (1 - z)
            dc = d * (1 - z) * (1 - c * c)
            dr = dc * inner * r * (1 - r)
            di = dc * r
            for k, g in enumerate((dz, dr, dc)):
                moved[k, t, :m] = g
            g_state[side, 0] += before.T @ dz
            g_state[side, 1] += before.T @ dr
            g_state[side, 2] += before.T @ di
            g_bias[side] += di.sum(axis=0)
            now = np.zeros_like(back)
            now[:m] = d * z + dz @ uz.T + dr @ ur.T + di @ uc.T
            back = now
        g_table[side][:, found] = np.add.reduceat(moved.reshape(3, -1, moved.shape[3])[:, order], heads, axis=1)
    return loss, grads


class Adam(NamedTuple):
    """Moments of the gradients, and how many there were."""
    first: list[np.ndarray]
    second: list[np.ndarray]
    done: int


def _epoch(net: Network, adam: Adam, data: np.ndarray, offs: np.ndarray, lang: np.ndarray, batch: int, rate: float) -> tuple[Network, Adam, float]:
    """One pass over the blocks of a shard (each text is one block)."""
    first, second, done = [w.copy() for w in adam.first], [w.copy() for w in adam.second], adam.done
    weights, losses = [w.copy() for w in net.weights()], []
    for at in range(0, len(offs) - 1, batch):
        end = min(at + batch, len(offs) - 1)
        start, length, text = cut_blocks(offs[at:end + 1], BLOCK)
        if not len(start):
            continue
        net = Network(net.langs, *weights)
        loss, grads = gradients(net, lay_out(data, start, length, text), lang[at:end])
        losses.append(loss)
        done += 1
        for w, g, m, v in zip(weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9 ** done)) / (np.sqrt(v / (1 - 0.99 ** done)) + 1e-7)
    return Network(net.langs, *weights), Adam(first, second, done), float(np.mean(losses)) if losses else 0.0


def _shard_trainer(net: Network, adam: Adam, batch: int, rate: float, turn: int):
    """A function that trains on one shard, in an order of the round."""
    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf["key"].to_numpy().astype(np.uint64) * np.uint64(2 * turn + 1) + np.uint64(turn), kind="stable")
        order = np.resize(order, max(len(order), STEPS * batch))
        pieces = [bytes(x) for x in pdf["piece"].iloc[order]]
        lang = pdf["label"].to_numpy()[order]
        offs = np.r_[0, np.cumsum([len(x) for x in pieces])]
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        own, moments, loss = _epoch(net, adam, data, offs, lang, batch, rate)
        rows = [np.concatenate([x.ravel() for x in xs]).astype(np.float32).tobytes() for xs in (own.weights(), moments.first, moments.second)]
        return pd.DataFrame([(*rows, moments.done, loss)], columns=["weights", "first", "second", "done", "loss"])

    return train


def _unpack(raw: list[bytes], like: list[np.ndarray]) -> list[np.ndarray]:
    """The mean of some packed sets of arrays shaped as ``like``."""
    flat = np.mean([np.frombuffer(x, dtype=np.float32) for x in raw], axis=0, dtype=np.float64).astype(np.float32)
    cuts = np.cumsum([w.size for w in like])[:-1]
    return [x.reshape(w.shape).copy() for x, w in zip(np.split(flat, cuts), like)]


def held_out(id_col: str) -> Column:
    """Rows that no network is trained on: CRC-32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def training_pieces(docs: DataFrame, rows: int = ROWS, pieces: int = PIECES) -> DataFrame:
    """``shard, key, label, lang, piece`` (bytes of one block) of at most ``rows`` rows of each
    language, the smallest id hashes outside the held-out fold; written once.

    Rows without id, text or language take no part, nor do texts without a character.
    """
    fine = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out("doc_id"))
    key = F.xxhash64("doc_id")
    least = lambda *by: F.row_number().over(Window.partitionBy("lang").orderBy(*by)) <= rows
    # ids alone are ranked (each task keeps ``rows`` of a language), their texts are looked up
    ids = fine.select("doc_id", "lang", key.alias("key")).withColumn("n", least("key")).where("n").select("doc_id").distinct()
    found = (fine.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id")
                 .withColumn("key", F.xxhash64("doc_id", "text")).withColumn("n", least(F.xxhash64("doc_id"), "key")).where("n"))
    n = F.length("text")
    start = lambda k: (F.floor(n * k / pieces) + 1).cast("int")
    cut = F.array(*[F.substring("text", start(k), F.lit(BLOCK)) for k in range(pieces)])
    some = (found.select("lang", "key", F.posexplode(F.array_distinct(cut)).alias("k", "piece"))
                 .select("lang", F.xxhash64("key", "k").alias("key"), F.substring(F.col("piece").cast("binary"), 1, BLOCK).alias("piece"))
                 .withColumn("shard", F.pmod("key", F.lit(SHARDS)).cast("int")))
    return written(some, "language-pieces")


def train_network(docs: DataFrame, rows: int = ROWS, pieces: int = PIECES, rounds: int = ROUNDS, batch: int = BATCH, rate: float = RATE) -> Network:
    """Train on ``doc_id, text, lang`` of ``docs``; the languages are the values of ``lang`` there.

    Without a row to learn from, the network knows no language.
    """
    sample = training_pieces(docs.select("doc_id", "text", "lang"), rows, pieces)
    langs = sorted(r.lang for r in sample.select("lang").distinct().collect())
    net = fresh_network(langs)
    if len(langs) < 2:
        return net
    label = F.create_map(*[x for k, v in enumerate(langs) for x in (F.lit(v), F.lit(k))])[F.col("lang")]
    shards = sample.select("shard", "key", "piece", label.alias("label")).repartition(SHARDS, "shard")
    adam = Adam([np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()], 0)
    for turn in range(rounds):
        step = _shard_trainer(net, adam, batch, rate * 0.5 ** (4 * turn / rounds), turn)
        done = (shards.groupBy("shard").applyInPandas(step, "weights binary, first binary, second binary, done long, loss double")
                      .collect())        # one row a shard
        done = sorted(done, key=lambda r: bytes(r.weights))
        like = net.weights()
        net = Network(langs, *_unpack([r.weights for r in done], like))
        adam = Adam(_unpack([r.first for r in done], like), _unpack([r.second for r in done], like), max(r.done for r in done))
    return net


def _has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts have a Unicode letter."""
    plain = np.r_[0, np.cumsum(_LETTER[data] & (data < 0x80))]
    high = np.r_[0, np.cumsum(data >= 0x80)]
    has = plain[offs[1:]] > plain[offs[:-1]]
    for k in np.flatnonzero(~has & (high[offs[1:]] > high[offs[:-1]])):
        text = data[offs[k]:offs[k + 1]].tobytes().decode()
        has[k] = any(unicodedata.category(c)[0] == "L" for c in text)
    return has


def _label_batches(batches: Iterator[pa.RecordBatch], net: Network, abreast: int) -> Iterator[pa.RecordBatch]:
    """(rest, text) -> rest, lang_pred, score, probs (by language), labelled (bytes by language)."""
    n_langs, reader = len(net.langs), Reader(net)
    names = np.array([*net.langs, UNKNOWN], dtype=object)
    for b in batches:
        data, offs = text_bytes(b.column(1))
        for i, j in slices(offs):
            own, part = offs[i:j + 1] - offs[i], data[offs[i]:offs[j]]
            mass, labelled = np.zeros((n_langs, j - i)), np.zeros((n_langs, j - i), dtype=np.int64)
            start, length, text = cut_blocks(own, BLOCK)
            for at in range(0, len(start) if n_langs > 1 else 0, abreast):
                sel = slice(at, at + abreast)
                blocks = lay_out(part, start[sel], length[sel], text[sel])
                for total, found in zip((mass, labelled), reader.label(blocks)):
                    for k in range(n_langs):
                        total[k] += np.bincount(blocks.text, found[k], j - i).astype(total.dtype)
            if n_langs == 1:        # one language to learn: all letters are of it
                letters = np.r_[0, np.cumsum(_LETTER[part])]
                labelled[0] = letters[own[1:]] - letters[own[:-1]]
                mass[0] = labelled[0]
            weight = labelled.sum(axis=0)
            probs = (mass / np.maximum(weight, 1)).T
            known = _has_letter(part, own) & (weight > 0)
            pick = np.where(known, probs.argmax(axis=1) if n_langs else 0, n_langs)
            score = np.where(known, probs.max(axis=1) if n_langs else 0.0, 0.0)
            cuts = pa.array(np.arange(0, (j - i + 1) * n_langs, n_langs, dtype=np.int32) if n_langs else np.zeros(j - i + 1, np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), pa.array(names[pick], pa.string()), pa.array(np.clip(score, 0.0, 1.0)),
                 pa.ListArray.from_arrays(cuts, pa.array(probs.ravel())), pa.ListArray.from_arrays(cuts, pa.array(labelled.T.ravel()))],
                ["rest", "lang_pred", "score", "probs", "labelled"])


def identify(docs: DataFrame, net: Network, text_col: str = "text", abreast: int = ABREAST) -> DataFrame:
    """The language of every whole text.

    Returns ``rest`` (a struct of all columns of ``docs`` but the text), ``lang_pred``,
    ``score`` (its mean probability over the text's letters), ``probs`` (that of each of
    ``net.langs``) and ``labelled`` (how many letter bytes are labelled with each). One
    row for each row of ``docs``; no other column is looked at.

    Null, empty and letterless texts: ``und``, score 0, zeros. Ties go to the first
    language. Long texts are read in blocks like others; memory follows the longest text of
    a task. Repeated rows get the same. A network that knows no language says ``und``
    of all; one that knows a single one, that. An empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select((F.struct(*rest) if rest else F.struct(F.lit(None).cast("string").alias("none"))).alias("rest"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_label_batches, net=net, abreast=abreast),
                           f"rest {rows.schema['rest'].dataType.simpleString()}, lang_pred string, score double, "
                           "probs array<double>, labelled array<bigint>")


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    from ..session import read_table
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), train_network(docs))
    return out.select(F.col("rest.doc_id").alias("doc_id"), F.coalesce(held_out("rest.doc_id"), F.lit(False)).alias("held_out"),
                      "lang_pred", "score")
