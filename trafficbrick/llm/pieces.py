"""SentencePiece encoding with N-best segmentation, and decoding (operator 4).

A text is normalised as the model's own rules say (a dummy blank first, blanks
written as U+2581), and every piece is an edge of a lattice over its characters,
weighted by the model's score. The best segmentation is the path of the highest
sum. A forward Viterbi pass gives the best score of every prefix; a backward
A-star search from the end of the lattice uses those scores as exact heuristics,
so paths come out in order of score and the search opens little more than they
hold.

Where two neighbouring characters stand side by side in no piece at all (a letter
and a blank after it, say), every path passes between them. The lattice falls
apart there into *words*: each is searched alone, and the N best of the whole text
are the N best sums of the words' alternatives. Only the N - 1 words whose second choice costs least can differ in
those, so a forward and a backward pass give every word's best path and the cost
of its second, and the A-star search runs for the words that can matter. Both passes go
through the distinct words of one length together, in numpy steps over their places.
"""

from __future__ import annotations

import functools
import heapq
import re
import sys
from functools import partial
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import parts, run_hashes

BLANK = "▁"
PENALTY = 10.0      # of a character without a piece, below the lowest score
KEPT_SEARCHES = 10_000   # N-best lists held by a task
SLICE = 1 << 18          # ids put out at a time
PART = 1 << 20           # bytes of text whose words are looked up together
COMMON = 191             # characters with a column of their own in the piece tree
FEW = 4                  # words of one length that are worth a common search
NBEST = 4


class Model:
    """Pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if sp.normalize("ａ  b") != f"{BLANK}ａ{BLANK}{BLANK}b":
            raise ValueError("only models that write blanks as U+2581 and change nothing else are supported")
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {self.names[i]: (i, sp.get_score(i)) for i in plain}
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.pieces) or len(self.bytes) != 256:
            raise ValueError("the model needs byte pieces, and no piece with a blank inside")
        pairs = {p[k:k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.pairs = np.array(sorted(ord(x[0]) << 32 | ord(x[1]) for x in pairs), dtype=np.uint64)
        # every beginning of a piece: its id and score if it is a piece itself, else None
        self.table: dict[str, tuple[int, float] | None] = {p[:k]: None for p in self.pieces for k in range(1, len(p))}
        self.table.update(self.pieces)
        self.unknown = min((s for s in (v for _, v in self.pieces.values()) if s > -1e8), default=0.0) - PENALTY
        back = {i: b for b, i in self.bytes.items()}
        self.raw = [bytes([back[i]]) if i in back else b"" if i < n and (sp.is_control(i) or sp.is_unknown(i))
                    else self.names[i].replace(BLANK, " ").encode() for i in range(n)]
        self._grow_tree()
        self.searched: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}

    def _grow_tree(self) -> None:
        """The beginnings of pieces as a tree of numbered nodes (0: none, 1: the root), a row of children each."""
        number = {"": 1} | {p: k for k, p in enumerate(self.table, 2)}
        self.score = np.full(len(number) + 1, -np.inf)
        self.piece = np.full(len(number) + 1, -1, dtype=np.int32)
        used: dict[str, int] = {}
        for p in self.table:
            used[p[-1]] = used.get(p[-1], 0) + 1
        common = sorted(used, key=lambda c: (-used[c], c))[:COMMON]
        self.column = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
        self.column[[ord(c) for c in common]] = np.arange(1, len(common) + 1)
        self.child = np.zeros((len(number) + 1, len(common) + 1), dtype=np.min_scalar_type(len(number)))
        rare = {}
        for p, found in self.table.items():
            node, above, last = number[p], number[p[:-1]], ord(p[-1])
            if self.column[last]:
                self.child[above, self.column[last]] = node
            else:
                rare[above << 21 | last] = node
            if found:
                self.piece[node], self.score[node] = found
        self.rare = np.array(sorted(rare), dtype=np.int64)
        self.rare_child = np.array([rare[k] for k in self.rare.tolist()], dtype=self.child.dtype)

    def _down(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The children of some nodes by characters (0: none)."""
        column = self.column[char]
        out = self.child[node, column]
        odd = np.flatnonzero(column == 0)
        if len(odd) and len(self.rare):
            key = node[odd].astype(np.int64) << 21 | char[odd].astype(np.int64)
            at = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
            out[odd] = np.where(self.rare[at] == key, self.rare_child[at], 0)
        return out

    def best_of_words(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``best`` of the words ``points[start:end]``: all ids in a row, how many each has, scores and losses.

        Words of one length go through the lattice together, one numpy step for each start and length of an edge.
        """
        lens = end - start
        size = np.zeros(len(start), dtype=np.int64)
        score, loss = np.zeros(len(start)), np.zeros(len(start))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(lens, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(lens[order]) > 0, True])
        alone = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            n = int(lens[order[a]])
            step = max(FEW, (1 << 19) // (n + 1))
            for lo in range(a, b, step):
                some = order[lo:min(lo + step, b)]
                if len(some) < FEW:
                    alone += some.tolist()
                    continue
                chars = points[start[some] + np.arange(n)[:, None]]
                first = self._down(np.ones(n * len(some), dtype=np.int64), chars.ravel()).reshape(chars.shape)
                plain = np.isfinite(self.score[first]).all(axis=0)
                alone += some[~plain].tolist()
                if plain.any():
                    own = some[plain]
                    ids, size[own], score[own], loss[own] = self._search(chars[:, plain], first[:, plain])
                    found.append((own, ids))
        for k in alone:
            raw, score[k], loss[k] = self.best(points[start[k]:end[k]].tobytes().decode("utf-32-le"))
            size[k] = len(raw) // 4
            found.append((np.array([k]), np.frombuffer(raw, dtype="<i4")))
        base = np.cumsum(size) - size
        pool = np.zeros(int(size.sum()), dtype=np.int32)
        for own, ids in found:
            many = size[own]
            pool[np.arange(len(ids)) + np.repeat(base[own] - (np.cumsum(many) - many), many)] = ids
        return pool, size, score, loss

    def _search(self, chars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``best_of_words`` of words of one length (a column each) of characters that are pieces; ``first`` their nodes."""
        n, many = chars.shape
        ahead = np.full((n + 1, many), -np.inf)
        ahead[0] = 0
        come, last = np.zeros((n + 1, many), dtype=np.int32), np.zeros((n + 1, many), dtype=np.int32)
        edges = []
        for i in range(n):
            who, node = np.arange(many), first[i]
            for j in range(i + 1, n + 1):
                own = self.score[node]
                real = np.flatnonzero(np.isfinite(own))
                if len(real):
                    w, v = who[real], own[real]
                    edges.append((i, j, w, v))
                    v = ahead[i, w] + v
                    more = v > ahead[j, w]
                    w = w[more]
                    ahead[j, w], come[j, w], last[j, w] = v[more], i, self.piece[node[real[more]]]
                if j == n:
                    break
                node = self._down(node, chars[j, who])
                live = np.flatnonzero(node)
                if not len(live):
                    break
                who, node = who[live], node[live]
        behind = np.full((n + 1, many), -np.inf)
        behind[n] = 0
        for i, j, w, v in reversed(edges):
            behind[i, w] = np.maximum(behind[i, w], v + behind[j, w])
        taken = np.full((n + 1, many), -1, dtype=np.int32)      # the start of the best path's edge that ends here
        who, at = np.arange(many), np.full(many, n)
        while len(who):
            back = come[at, who]
            taken[at, who] = back
            who, at = who[back > 0], back[back > 0]
        second = np.full(many, -np.inf)
        for i, j, w, v in edges:
            other = taken[j, w] != i
            w, v = w[other], v[other]
            second[w] = np.maximum(second[w], ahead[i, w] + v + behind[j, w])
        on = (taken >= 0).T
        return last.T[on], on.sum(axis=1), ahead[n], ahead[n] - second

    def edges(self, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end, the edges that arrive: start, score, ids."""
        n, pieces, get = len(word), self.pieces, self.table.get
        into: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, n + 1):
                found = get(word[i:j], False)
                if found is False:
                    break
                if found:
                    into[j].append((i, found[1], (found[0],)))
            if word[i] not in pieces:
                into[i + 1].append((i, self.unknown, tuple(self.bytes[b] for b in word[i].encode())))
        return into

    def nbest(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` segmentations of the highest scores (all, if fewer), best first."""
        found = self.searched.get((word, n))
        if found is not None:
            return found
        into = self.edges(word)
        best = [0.0] * (len(word) + 1)
        for j in range(1, len(word) + 1):
            best[j] = max(best[i] + s for i, s, _ in into[j])
        out, count = [], 0
        heap = [(-best[len(word)], 0, len(word), 0.0, None)]
        while heap and len(out) < n:
            _, _, j, behind, path = heapq.heappop(heap)
            if j == 0:
                ids: list[int] = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((behind, tuple(ids)))
                continue
            for i, s, ids in into[j]:
                count += 1
                heapq.heappush(heap, (-(best[i] + behind + s), count, i, behind + s, (ids, path)))
        if len(out) > 1 and out[0][0] - out[1][0] < 1e-6:      # of equals, the one that best() takes comes first
            own = tuple(np.frombuffer(self.best(word)[0], dtype="<i4").tolist())
            out = [(out[0][0], own), *[x for x in out if x[1] != own]][:n]
        if len(self.searched) >= KEPT_SEARCHES:
            self.searched.clear()
        if len(word) <= 64:
            self.searched[word, n] = out
        return out

    def best(self, word: str) -> tuple[bytes, float, float]:
        """Ids (little-endian 32-bit) and score of the best path, and how much less the
        second best scores (infinite without one): the best path through any edge
        that the best one does not take."""
        n, pieces, get = len(word), self.pieces, self.table.get
        ahead, come = [0.0] + [-np.inf] * n, [(0, ())] * (n + 1)
        edges = []
        for i in range(n):
            score = ahead[i]
            for j in range(i + 1, n + 1):
                found = get(word[i:j], False)
                if found is False:
                    break
                if found:
                    own = found[1]
                    edges.append((i, j, own))
                    if score + own > ahead[j]:
                        ahead[j], come[j] = score + own, (i, (found[0],))
            if word[i] not in pieces:
                edges.append((i, i + 1, self.unknown))
                if score + self.unknown > ahead[i + 1]:
                    ahead[i + 1], come[i + 1] = score + self.unknown, (i, tuple(self.bytes[b] for b in word[i].encode()))
        behind = [-np.inf] * n + [0.0]
        for i, j, score in reversed(edges):
            if score + behind[j] > behind[i]:
                behind[i] = score + behind[j]
        path, ids, j = set(), [], n
        while j:
            i, own = come[j]
            path.add((i, j))
            ids.append(own)
            j = i
        second = max((ahead[i] + score + behind[j] for i, j, score in edges if (i, j) not in path), default=-np.inf)
        flat = [x for own in reversed(ids) for x in own]
        return np.array(flat, dtype="<i4").tobytes(), ahead[n], ahead[n] - second

    def totals(self, total: float, words: list[str], n: int) -> tuple[list[float], list[list[tuple[int, tuple[int, ...]]]]]:
        """The ``n`` best scores of a text whose best is ``total``, from the (at most
        ``n - 1``) words with the cheapest second choice, and what each changes."""
        choices: list[tuple[float, tuple]] = [(0.0, ())]
        for k, word in enumerate(words):
            found = self.nbest(word, n)
            top = found[0][0]
            choices = heapq.nsmallest(n, [(c + top - s, w + ((k, ids),) if m else w) for c, w in choices
                                          for m, (s, ids) in enumerate(found)], key=lambda x: x[0])
        return [total - c for c, _ in choices], [list(w) for _, w in choices]

    def heads(self, points: np.ndarray) -> np.ndarray:
        """Mask of the characters that start a word (the first does)."""
        head = np.ones(len(points), dtype=bool)
        pair = points[:-1].astype(np.uint64) << np.uint64(32) | points[1:].astype(np.uint64)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        head[1:] = self.pairs[at] != pair
        return head

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        whole = BLANK + text.replace(" ", BLANK)
        start = np.flatnonzero(self.heads(np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32))).tolist()
        return [whole[a:b] for a, b in zip(start, [*start[1:], len(whole)])]

    def encode(self, text: str, n: int) -> tuple[list[int], list[float], list[list[tuple[int, tuple[int, ...]]]]]:
        """Ids of the best segmentation, the scores of the ``n`` best, and for each of
        those the words (by place) that it segments otherwise, with their ids."""
        words = self.words(text)
        found = [self.best(w) for w in words]
        ids = np.frombuffer(b"".join(f[0] for f in found), dtype="<i4").tolist()
        if not words:
            return [], [], []
        order = [k for _, k in heapq.nsmallest(n - 1, [(f[2], k) for k, f in enumerate(found) if f[2] < np.inf])]
        scores, changes = self.totals(sum(f[1] for f in found), [words[k] for k in order], n)
        return ids, scores, [[(order[k], own) for k, own in change] for change in changes]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw.removeprefix(b" ").decode(errors="replace")


@functools.lru_cache(maxsize=2)
def model_of(path: str) -> Model:
    return Model(path)


class Lists:
    """A list column in the making: all values in a row, and where each list ends."""

    def __init__(self):
        self.values: list = []
        self.ends = [0]

    def add(self, values) -> None:
        self.values.extend(values)
        self.ends.append(len(self.values))

    def array(self, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.array(self.values, kind))


class Changes:
    """The column of changes in the making: lists (ranks) of lists of place, size and ids."""

    def __init__(self):
        self.at: list[int] = []
        self.size: list[int] = []
        self.ids, self.ranks, self.rows = Lists(), [0], [0]

    def add(self, ranks: list[list[tuple[int, int, tuple[int, ...]]]]) -> None:
        for rank in ranks:
            for at, size, ids in rank:
                self.at.append(at)
                self.size.append(size)
                self.ids.add(ids)
            self.ranks.append(len(self.at))
        self.rows.append(len(self.ranks) - 1)

    def array(self) -> pa.Array:
        one = pa.StructArray.from_arrays([pa.array(self.at, pa.int64()), pa.array(self.size, pa.int32()), self.ids.array(pa.int32())],
                                         ["at", "size", "ids"])
        each = pa.ListArray.from_arrays(pa.array(self.ranks, pa.int32()), one)
        return pa.ListArray.from_arrays(pa.array(self.rows, pa.int32()), each)


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, n: int) -> Iterator[pa.RecordBatch]:
    """(text, rest) -> rest, ids, nbest_scores, changes; words are looked up once for each part of a batch."""
    m = model_of(path)
    for b in batches:
        total = np.zeros(b.num_rows)
        cheap: list[list[tuple[float, str, int, int]]] = [[] for _ in range(b.num_rows)]     # loss, word, place and number of its ids
        seen = np.zeros(b.num_rows, dtype=np.int64)
        ids: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
        before = -1
        for part in parts(b.column(0), PART):
            points = np.where(part.points == 0x20, np.uint32(ord(BLANK)), part.points)
            # the dummy blank before each text (not before the next stretch of a long one)
            rows = np.flatnonzero(np.diff(part.offsets))
            fresh = rows if part.lo != before or part.hi - part.lo > 1 else rows[:0]
            before = part.hi - 1
            shift = np.zeros(part.hi - part.lo + 1, dtype=np.int64)
            shift[fresh + 1] = 1
            points = np.insert(points, part.offsets[fresh], np.uint32(ord(BLANK)))
            offsets = part.offsets + np.cumsum(shift)
            if not len(points):
                continue
            head = m.heads(points)
            head[offsets[:-1][np.diff(offsets) > 0]] = True
            start = np.flatnonzero(head)
            end = np.r_[start[1:], len(points)]
            text = points.tobytes().decode("utf-32-le")
            keys, where, back = np.unique(run_hashes(points, start, end), return_index=True, return_inverse=True)
            pool, size, scores, losses = m.best_of_words(points, start[where], end[where])
            base = np.cumsum(size) - size
            score, loss = scores[back], losses[back]
            many = size[back]
            at = np.r_[0, np.cumsum(many)]
            flat = pool[np.arange(at[-1]) + np.repeat(base[back] - at[:-1], many)]
            row = np.searchsorted(offsets, start, "right") - 1
            total[part.lo:part.hi] += np.bincount(row, score, part.hi - part.lo)
            cuts = at[np.searchsorted(start, offsets)]
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                ids[part.lo + r].append(flat[cuts[r]:cuts[r + 1]])
            order = np.lexsort((loss, row))
            order = order[loss[order] < np.inf]
            first = np.searchsorted(row[order], row[order], "left")
            for k in order[np.arange(len(order)) - first < n - 1].tolist():
                r = part.lo + row[k]
                cheap[r].append((float(loss[k]), text[start[k]:end[k]], int(seen[r] + at[k] - cuts[row[k]]), int(many[k])))
            seen[part.lo:part.hi] += np.diff(cuts)
        sums_of, changes = Lists(), Changes()
        for r in range(b.num_rows):
            few = heapq.nsmallest(n - 1, cheap[r], key=lambda x: x[0])
            sums, ranks = m.totals(total[r], [x[1] for x in few], n) if ids[r] else ([], [])
            sums_of.add(sums)
            changes.add([[(few[k][2], few[k][3], own) for k, own in sorted(rank, key=lambda x: few[x[0]][2])] for rank in ranks])
        scores, changed = sums_of.array(pa.float64()), changes.array()
        whole = [np.concatenate(x) if x else np.zeros(0, dtype="<i4") for x in ids]
        lens = np.cumsum([len(x) for x in whole])
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(lens, (lens[lo - 1] if lo else 0) + SLICE, "right")))
            ends = np.r_[0, np.cumsum([len(x) for x in whole[lo:hi]])].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(whole[lo:hi]))),
                 scores.slice(lo, hi - lo), changed.slice(lo, hi - lo)],
                ["rest", "ids", "nbest_scores", "changes"])
            lo = hi


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = model_of(path)
    pool = np.frombuffer(b"".join(m.raw), dtype=np.uint8)
    size = np.array([len(x) for x in m.raw], dtype=np.int64)
    base = np.cumsum(size) - size
    for b in batches:
        lens = np.asarray(pc.fill_null(pc.list_value_length(b.column(0)), 0), dtype=np.int64)
        flat = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        null = np.asarray(b.column(0).is_null())
        cum = np.cumsum(lens)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(cum, (cum[lo - 1] if lo else 0) + SLICE, "right")))
            ids = flat[cum[lo] - lens[lo]:cum[hi - 1]]
            many = size[ids]
            at = np.r_[0, np.cumsum(many)]
            raw = pool[np.arange(at[-1]) + np.repeat(base[ids] - at[:-1], many)].tobytes()
            ends = at[np.r_[0, np.cumsum(lens[lo:hi])]].tolist()
            text = [None if null[lo + k] else raw[x:y].removeprefix(b" ").decode(errors="replace")
                    for k, (x, y) in enumerate(zip(ends, ends[1:]))]
            yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), pa.array(text, pa.string())], ["rest", "text"])
            lo = hi


def encode(docs: DataFrame, path: str, text_col: str = "text", nbest: int = NBEST) -> DataFrame:
    """``rest`` (struct of all columns of ``docs``), ``ids`` of the best segmentation,
    ``nbest_scores`` (descending; fewer than ``nbest`` where the text has fewer segmentations)
    and ``changes``: for each of those scores, what its segmentation has in place of ``ids``
    (``size`` ids from the 0-based place ``at`` on give way to ``ids``; ascending, none for
    the best). ``alternative`` puts them in.

    Null or empty text: no ids, no scores, no changes. Characters without a piece become
    their UTF-8 byte pieces. Repeated rows are encoded alike.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*docs.columns).alias("rest"))
    return rows.mapInArrow(partial(_encode_batches, path=path, n=nbest),
                           f"rest {rows.schema['rest'].dataType.simpleString()}, ids array<int>, nbest_scores array<double>, "
                           "changes array<array<struct<at: bigint, size: int, ids: array<int>>>>")


def alternative(ids: Column, change: Column) -> Column:
    """The ids of one segmentation: ``ids`` with the places of ``change`` (an entry of ``changes``) replaced."""
    def step(done: Column, c: Column) -> Column:
        upto = c["at"].cast("int")
        return F.struct(F.concat(done["out"], F.slice(ids, done["next"] + 1, upto - done["next"]), c["ids"]).alias("out"),
                        (upto + c["size"]).alias("next"))

    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("next"))
    return F.aggregate(change, start, step,
                       lambda done: F.concat(done["out"], F.slice(ids, done["next"] + 1, F.size(ids) - done["next"])))


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``rest`` (struct of all columns of ``rows`` but the ids) and the ``text`` of its ids (null: null).

    U+2581 of a text comes back as a blank, as in the library.
    """
    rest = [c for c in rows.columns if c != ids_col]
    kept = rows.select(F.col(ids_col).alias("ids"), F.struct(*rest).alias("rest"))
    return kept.mapInArrow(partial(_decode_batches, path=path),
                           f"rest {kept.schema['rest'].dataType.simpleString()}, text string")


def op4_sentencepiece_nbest(spark, sf_dir: str) -> DataFrame:
    """Every document's best pieces, the scores of its four best segmentations the hash
    of the ids of each, and the round trip of the best."""
    from ..session import read_table
    from .token_counts import tokenizer_path
    path = tokenizer_path("piece_bpe_32k.model")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode(docs, path).select(
        F.col("rest.doc_id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"), "nbest_scores",
        F.transform("changes", lambda c: F.xxhash64(alternative(F.col("ids"), c))).alias("nbest_hashes"), "ids",
        F.xxhash64(F.translate(F.coalesce("rest.text", F.lit("")), BLANK, " ")).alias("want"))
    back = decode(done, path)
    return back.select("rest.doc_id", "rest.n_pieces", "rest.ids_hash", "rest.nbest_scores", "rest.nbest_hashes",
                       (F.xxhash64("text") == F.col("rest.want")).alias("round_trip"))
