"""Heavy-flow candidates per cell (E4-E6, E8), top-k (G1) and the report.

Three ways to name a cell's heavy flow:

* ``dominant_flow`` (E6, default) -- the exact heaviest (src, dst) flow of the
  cell. Two declarative aggregations, both partially aggregated; order-free.
* ``vote_hitters`` (E4) -- the weighted Boyer-Moore vote in packet order, for
  parity with a sequential monitor. Packets are sorted within cell
  partitions and streamed through the fold in constant memory; a cell too large
  for a task is folded in chunks of time, which are stitched exactly.
* ``vote_merged`` (E5) -- the mergeable form: one candidate and count per task
  and cell, merged by built-in aggregates. Any flow holding more than half of its
  cell's weight is returned; packets are neither ordered nor shuffled.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addr import ip_to_string
from ..functions.timecols import micros_to_wallclock, wallclock_micros
from ..functions.timefmt import format_count
from ..session import scratch_path
from . import keys as K
from .summary import WINDOW_COLS
from .votefold import GROUP, PACKET, PARTIAL, RESULT, fold_batches, partial_votes

# Total order of packets inside a cell (sequence numbers alone are not unique).
ORDER_COLS = ["ts", "seq", "src_ip", "dst_ip", "w", "sport", "dport"]


# ---------------------------------------------------------------- E6 exact
def flow_sums(binned: DataFrame, *more: str) -> DataFrame:
    """Per-flow weight with the ports (packed) of the flow's first packet; ``more`` columns follow from the flow."""
    first = K.first_packet_key(wallclock_micros(F.col("ts")), F.col("seq"))
    return (binned.groupBy(*WINDOW_COLS, "cell", "src_ip", "dst_ip", *more)
                  .agg(F.sum("w").alias("bytes"),
                       F.min_by(K.pack_ports(F.col("sport"), F.col("dport")), first).alias("pp")))


def pick_dominant(flows: DataFrame, keys=("cell",), weight: str = "bytes") -> DataFrame:
    """Heaviest flow per ``keys`` (ties: smaller src, then dst) -- hash aggregation
    on a packed key, see :mod:`trafficbrick.operators.keys`."""
    f = flows.withColumn("rk", K.heavy_key(F.col(weight), F.col("src_ip"), F.col("dst_ip")))
    g = (f.groupBy(*WINDOW_COLS, *keys)
          .agg(F.max("rk").alias("rk"), F.max_by("src_ip", "rk").alias("src_ip"),
               F.max_by("dst_ip", "rk").alias("dst_ip"), F.max_by("pp", "rk").alias("pp"),
               F.max_by(weight, "rk").alias("fb"), F.sum(weight).alias("cell_bytes")))
    return g.select(*WINDOW_COLS, *keys, "src_ip", "dst_ip", K.sport_of(F.col("pp")).alias("sport"),
                    K.dport_of(F.col("pp")).alias("dport"), F.col("fb").cast("bigint").alias("flow_bytes"),
                    "cell_bytes")


def dominant_flow(binned: DataFrame) -> DataFrame:
    """Exact heaviest flow of every cell (E6); source 0 never names a flow."""
    return pick_dominant(flow_sums(binned.where(F.col("src_ip") != 0)))


# ---------------------------------------------------------------- E4 ordered vote
CHUNKS = 256                # chunks of a cell that holds all packets
CHUNK_ROWS = 1_000_000      # and the fewest packets that make one
ROUNDS = 8
_VOTE = ["src_ip", "dst_ip", "sport", "dport", "count"]


def _folded(keyed: DataFrame, starts: dict | None = None) -> DataFrame:
    """Fold the packets of each (window, cell, chunk) in order: constant memory, no pre-pass."""
    ordered = (keyed.repartition(*WINDOW_COLS, "cell", "chunk")
                    .sortWithinPartitions(*WINDOW_COLS, "cell", "chunk", *ORDER_COLS))
    return (ordered.select(*GROUP, *PACKET).mapInArrow(partial(fold_batches, starts=starts or {}), RESULT))


def hot_cells(binned: DataFrame, chunk_rows: int | None = None) -> DataFrame | None:
    """``window_start, cell, bounds``: cells of more than ``chunk_rows`` packets and the times
    (microseconds) at which their packets are cut into chunks of about that many; None without one.

    By default a chunk holds at least 1/256 of all packets, which bounds the cells by 256
    and the times by 512, whatever the table: small enough to broadcast.
    """
    sizes = binned.groupBy(*WINDOW_COLS, "cell").agg(F.count(F.lit(1)).alias("n"))
    if chunk_rows is None:
        r = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("top")).first()
        chunk_rows = max(CHUNK_ROWS, (r.n or 0) // CHUNKS)
        if (r.top or 0) <= chunk_rows:
            return None
    hot = sizes.where(F.col("n") > chunk_rows).select("window_start", "cell", F.ceil(F.col("n") / chunk_rows).cast("int").alias("m"))
    some = binned.join(F.broadcast(hot), ["window_start", "cell"]).select("window_start", "cell", "m", wallclock_micros(F.col("ts")).alias("us"))
    shares = [k / CHUNKS for k in range(1, CHUNKS)]
    cuts = (some.groupBy("window_start", "cell").agg(F.percentile_approx("us", shares, F.lit(10_000)).alias("q"), F.first("m").alias("m"))
                .select("window_start", "cell", F.array_distinct(F.transform(
                    F.sequence(F.lit(1), F.least(F.col("m") - 1, F.lit(CHUNKS - 1))),
                    lambda k: F.col("q")[F.floor(k * CHUNKS / F.least(F.col("m"), F.lit(CHUNKS))).cast("int") - 1])).alias("bounds")))
    rows = cuts.collect()       # at most 256 by default
    return binned.sparkSession.createDataFrame(rows, cuts.schema) if rows else None


def vote_hitters(binned: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Weighted majority vote per cell in packet order.

    Output ``window, cell, src_ip, dst_ip, sport, dport, count``; cells whose
    final candidate has source 0 (the "empty" encoding) are dropped. The ports
    are those of the packet that installed the candidate.

    Packets are hash-partitioned by cell, sorted within partitions and folded
    batch by batch: constant memory whatever the cell size. A cell too large for one task
    (``hot_cells``) is cut into chunks of time that are folded in parallel and then stitched,
    see ``_stitched``; the result is that of the one ordered fold.
    """
    hot = hot_cells(binned, chunk_rows)
    keyed = binned.select(*WINDOW_COLS, "cell", *ORDER_COLS)
    if hot is None:
        votes = _folded(keyed.withColumn("chunk", F.lit(0)))
    else:
        cut = F.broadcast(hot)
        on = ["window_start", "cell"]
        us = wallclock_micros(F.col("ts"))
        chunk = F.size(F.filter("bounds", lambda t: t < us))
        path = scratch_path(binned.sparkSession, "hot-packets")
        keyed.join(cut, on).withColumn("chunk", chunk).drop("bounds").write.parquet(path)
        cold = _folded(keyed.join(cut, on, "left_anti").withColumn("chunk", F.lit(0)))
        votes = cold.unionByName(_stitched(binned.sparkSession.read.parquet(path)))
    return votes.select(*WINDOW_COLS, "cell", *_VOTE).where(F.col("src_ip") != 0)


def _stitched(packets: DataFrame) -> DataFrame:
    """The votes of cells that are cut into chunks, from the (written) packets with their ``chunk``.

    Every chunk is first folded from the empty state, all at once; then each from the state
    its predecessor ended in, as far as that is known, again all at once. A chunk that was
    folded from the state that the walk along the cell arrives with is settled, and so is one whose
    start had the same candidate with a count that outlasts the chunk (its count moves by
    the same ``gain``). The rest start anew from what the walk found. The first open chunk of
    a cell is settled in every round, most cells in two; after ``ROUNDS`` what is left of a cell is
    folded as one chunk. The driver sees one row a chunk (512 at most by default).
    """
    spark = packets.sparkSession
    key = lambda r: (int(r.us), r.cell, r.chunk)
    fields = lambda r: (r.src_ip, r.dst_ip, r.sport, r.dport, r["count"])

    def folded(rows: DataFrame, starts: dict) -> dict:
        out = _folded(rows, starts).withColumn("us", wallclock_micros(F.col("window_start")))
        return {key(r): r for r in out.collect()}

    done = folded(packets, {})
    ends = {(int(r.us), r.cell): r.window_end for r in done.values()}
    chunks: dict[tuple[int, int], list[int]] = {}
    for us, cell, chunk in sorted(done):
        chunks.setdefault((us, cell), []).append(chunk)
    known: dict[tuple, tuple] = {}      # (start, its result) of chunks folded from a start
    final, starts = {}, {}

    def walk(cell: tuple[int, int]) -> None:
        """Along the chunks: the state that each starts from, as far as is known; new starts where it is not settled."""
        state, sure = None, True
        for c in chunks[cell]:
            k = (*cell, c)
            if state is None or state[0] == 0:
                state = fields(done[k])     # the fold from the empty state
                continue
            start, r = known.get(k, (None, None))
            if start is not None and start[:2] == state[:2] and state[4] >= r.need:
                state = (*state[:4], state[4] + r.gain)
            elif start is not None and (start[0], start[1], start[4]) == (state[0], state[1], state[4]):
                state = fields(r)
            else:
                starts[k] = state
                sure = False
                state = fields(r if r is not None else done[k])
        if sure:
            final[cell] = state

    for turn in range(ROUNDS):
        starts.clear()
        for cell in chunks:
            if cell not in final:
                walk(cell)
        if not starts:
            break
        wanted = spark.createDataFrame([(us, cell, chunk) for us, cell, chunk in starts], "us bigint, cell int, chunk int")
        some = (packets.withColumn("us", wallclock_micros(F.col("window_start")))
                       .join(F.broadcast(wanted), ["us", "cell", "chunk"], "left_semi").drop("us"))
        for k, r in folded(some, starts).items():
            known[k] = (starts[k], r)
    else:
        _finish_in_one(packets, chunks, done, known, final, fields, folded)
    rows = [(us, ends[us, cell], cell, *state) for (us, cell), state in final.items()]
    made = spark.createDataFrame(rows, "us bigint, window_end timestamp_ntz, cell int, src_ip bigint, dst_ip bigint, sport int, dport int, count bigint")
    return made.select(micros_to_wallclock(F.col("us")).alias("window_start"), "window_end", "cell", F.lit(0).alias("chunk"), *_VOTE,
                       *[F.lit(None).cast("bigint").alias(c) for c in ("need", "gain")])


def _finish_in_one(packets: DataFrame, chunks: dict, done: dict, known: dict, final: dict, fields, folded) -> None:
    """Fold what is left of cells that do not settle from their first open chunk on as one."""
    starts, cuts = {}, []
    for cell, own in chunks.items():
        if cell in final:
            continue
        state = None
        for c in own:
            k = (*cell, c)
            start, r = known.get(k, (None, None))
            if state is None or state[0] == 0:
                state = fields(done[k])
            elif start is not None and start[:2] == state[:2] and state[4] >= r.need:
                state = (*state[:4], state[4] + r.gain)
            elif start is not None and (start[0], start[1], start[4]) == (state[0], state[1], state[4]):
                state = fields(r)
            else:
                starts[(*cell, -1)] = state
                cuts.append((*cell, c))
                break
        else:
            final[cell] = state
    if not cuts:
        return
    left = packets.sparkSession.createDataFrame(cuts, "us bigint, cell int, open int")
    rest = (packets.withColumn("us", wallclock_micros(F.col("window_start"))).join(F.broadcast(left), ["us", "cell"])
                   .where(F.col("chunk") >= F.col("open")).withColumn("chunk", F.lit(-1)).drop("us", "open"))
    for (us, cell, _), r in folded(rest, starts).items():
        final[us, cell] = fields(r)


# ---------------------------------------------------------------- E5 mergeable vote
def merge_votes(partials: DataFrame) -> DataFrame:
    """Merge vote summaries ``(window, cell, src_ip, dst_ip, sport, dport, cnt)``, one a task and cell.

    Summaries with the same candidate add; then the candidate with the largest
    total wins with count ``max(0, 2*N_max - N_all)``. Both steps are hash
    aggregates with map-side combine, so a hot cell never lands in one group.
    """
    per = (partials.groupBy(*WINDOW_COLS, "cell", "src_ip", "dst_ip")
                   .agg(F.sum("cnt").alias("n"), F.max_by(K.pack_ports(F.col("sport"), F.col("dport")), "cnt").alias("pp")))
    best = pick_dominant(per, weight="n")
    return best.select(*WINDOW_COLS, "cell", "src_ip", "dst_ip", "sport", "dport",
                       F.greatest(F.lit(0), 2 * F.col("flow_bytes") - F.col("cell_bytes")).cast("bigint").alias("count"))


def vote_merged(binned: DataFrame) -> DataFrame:
    """Mergeable weighted vote (E5): a flow of more than half of its cell's weight is always returned.

    A task keeps one candidate and count for each window and cell while it reads its
    packets, in any order; only these are shuffled, at most one row a task and cell. Cells
    without such a flow get some candidate, which may depend on how packets lie in tasks, as the ports
    always may (a packet of the flow's that a task met).
    """
    rows = binned.where(F.col("src_ip") != 0).select(*GROUP[:3], *PACKET)
    return merge_votes(rows.mapInArrow(partial_votes, PARTIAL))


def merged_majority(binned: DataFrame) -> DataFrame:
    """Each cell's merged candidate, its exact weight, the cell's (source 0
    included) and whether the candidate holds more than half of it. ``binned`` is read twice:
    give a written table (``kept_packets``)."""
    return verify_majority(binned, vote_merged(binned))


# ---------------------------------------------------------------- E8
def verify_majority(binned: DataFrame, candidates: DataFrame) -> DataFrame:
    """Flag candidates that truly hold more than half of their cell.

    No join: candidates enter the packet stream as zero-weight marker rows, one
    aggregation by (window, cell, src, dst) gives every flow's weight and marks
    the candidate's flow, a second by (window, cell) gives the cell total. Both
    combine map-side, so a hot cell costs one row per task.
    """
    pk = binned.select(*WINDOW_COLS, "cell", "src_ip", "dst_ip", F.col("w").cast("bigint").alias("w"),
                       F.lit(0).alias("is_cand"))
    cd = candidates.select(*WINDOW_COLS, "cell", "src_ip", "dst_ip", F.lit(0).cast("bigint").alias("w"),
                           F.lit(1).alias("is_cand"))
    flows = (pk.unionByName(cd).groupBy(*WINDOW_COLS, "cell", "src_ip", "dst_ip")
               .agg(F.sum("w").alias("flow_bytes"), F.max("is_cand").alias("is_cand")))
    cells = (flows.groupBy(*WINDOW_COLS, "cell")
                  .agg(F.max("is_cand").alias("has"), F.sum("flow_bytes").alias("cell_bytes"),
                       F.max_by("src_ip", "is_cand").alias("src_ip"), F.max_by("dst_ip", "is_cand").alias("dst_ip"),
                       F.max(F.when(F.col("is_cand") == 1, F.col("flow_bytes"))).alias("flow_bytes")))
    return (cells.where(F.col("has") == 1)
                 .select(*WINDOW_COLS, "cell", "src_ip", "dst_ip", "flow_bytes", "cell_bytes",
                         (F.col("flow_bytes") * 2 > F.col("cell_bytes")).alias("is_majority")))


def majority_fraction(flagged: DataFrame) -> DataFrame:
    return (flagged.groupBy(*WINDOW_COLS)
                   .agg(F.count(F.lit(1)).alias("active_cells"),
                        F.sum(F.col("is_majority").cast("int")).cast("bigint").alias("majority_cells"))
                   .withColumn("majority_fraction", F.col("majority_cells") / F.col("active_cells")))


# ---------------------------------------------------------------- G1 / A8
def top_hitters(candidates: DataFrame, estimates: DataFrame | None = None, k: int = 20) -> DataFrame:
    """Top ``k`` candidates per window by their cell's estimate (G1).

    ``candidates`` carries ``est`` itself, or ``estimates`` (window, cell, est)
    is joined in. Ties are broken by (src, dst). A window holds at most one
    candidate per cell, so each window's ranking is bounded by the brick size;
    ``row_number() <= k`` is planned as a per-partition group limit before the
    shuffle, so only k rows per window and task move.
    """
    c = candidates
    if estimates is not None:
        c = c.join(estimates.select(*WINDOW_COLS, "cell", "est"), [*WINDOW_COLS, "cell"], "inner")
    w = Window.partitionBy(*WINDOW_COLS).orderBy(F.desc("est"), "src_ip", "dst_ip")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hitter_report(top: DataFrame, unit: str = "bytes") -> DataFrame:
    """``Hitter Flow #k: [src] -> [dst]: N bytes.`` lines."""
    line = F.format_string("Hitter Flow #%d: [%s] -> [%s]: %s " + unit + ".",
                           F.col("rank"), ip_to_string("src_ip"), ip_to_string("dst_ip"), format_count(F.col("est"), 0))
    return top.select(*WINDOW_COLS, "rank", line.alias("line"))
