"""Document fingerprints by weighted SimHash, and Hamming search (operator 7).

DataFrame and SQL functions only. The terms of a text are its words (weight 1)
and its pairs of consecutive words (weight 2); each term's 128-bit hash votes on
128 signed bits. Four 16-bit lanes of one bigint count four bits at once, so 32
plain sums hold the votes of up to ``SHARE`` words and the aggregate stays in generated
code; the shares of a text add up in lanes of 32 bits.

``near_counts`` and ``near_pairs`` find all fingerprints within a Hamming radius ``r``: the
bits are cut into ``r + 2`` blocks, of which at least two agree; one table per pair of
blocks holds all fingerprints by both. A pair is found by the first two blocks on which
it agrees, once.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

BITS = 128
RADIUS = 12     # holds 92% of edited copies of five-word Jaccard 0.8 to 0.9, 99.6% of those above (see README)
GROUP = 1024    # fingerprints of one key that lie in one array
PACK = 48       # fingerprints that one compiled expression compares another with
SHARE = 10_000  # words that vote in one sum: three votes a word at most, a lane counts to 32,767
_LANES = sum(1 << k for k in (0, 16, 32, 48))
_HALVES = (0xFFFF << 32) + 0xFFFF
_BLANKS = " \t\n\u000b\f\r"


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(_BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def _bits(sums: list[Column], weight: Column) -> Column:
    """The 64 signs of 32 pairs of lanes as one bigint."""
    def bit(place: int, count: Column) -> Column:
        value = 1 << place if place < 63 else -(1 << 63)
        return F.when(count * 2 > weight, F.lit(value)).otherwise(F.lit(0))

    low = [bit(s, x.bitwiseAND(F.lit((1 << 32) - 1))) for s, x in enumerate(sums)]
    high = [bit(s + 32, F.shiftrightunsigned(x, 32)) for s, x in enumerate(sums)]
    return reduce(lambda x, y: x.bitwiseOR(y), low + high)


def simhash(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys`` and the fingerprint ``hi, lo`` of each row of ``rows`` (``keys`` tell rows apart).

    Texts of up to 700 million words. No words: all bits 0.
    """
    w = _words(F.coalesce(F.col(text_col), F.lit("")))
    pairs = rows.select(*keys, w.alias("w")).select(
        *keys, F.posexplode_outer(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("at", "t"))
    none = F.lit(0).cast("bigint")
    one = F.when(F.col("a").isNull(), 0).otherwise(1).cast("bigint")
    two = F.when(F.col("b").isNull(), 0).otherwise(2).cast("bigint")
    # what is not there has no votes: all bits 0
    hashed = (pairs.select(*keys, F.floor(F.coalesce("at", F.lit(0)) / SHARE).cast("int").alias("share"), F.col("t.a").alias("a"), F.col("t.b").alias("b"))
                   .select(*keys, "share", "a", "b", (one + two).alias("weight"), F.xxhash64("a").alias("a0"), F.xxhash64("a", "b").alias("b0"))
                   .select(*keys, "share", "weight", *[F.when(F.col(c).isNull(), none).otherwise(h).alias(f"{c}{n}") for c in ("a", "b")
                                                       for n, h in ((0, F.col(f"{c}0")), (1, F.xxhash64(f"{c}0")))]))

    def lane(n: int, s: int) -> Column:
        vote = lambda c: F.shiftrightunsigned(F.col(f"{c}{n}"), s).bitwiseAND(F.lit(_LANES))
        return F.sum(vote("a").bitwiseOR(F.shiftleft(vote("b"), 1))).alias(f"u{n}_{s}")

    def halves(n: int, s: int) -> Column:
        return F.sum(F.shiftrightunsigned(F.col(f"u{n}_{s % 16}"), s // 16 * 16).bitwiseAND(F.lit(_HALVES))).alias(f"v{n}_{s}")

    shares = hashed.groupBy(*keys, "share").agg(F.sum("weight").alias("weight"), *[lane(n, s) for n in (0, 1) for s in range(16)])
    votes = shares.groupBy(*keys).agg(F.sum("weight").alias("weight"), *[halves(n, s) for n in (0, 1) for s in range(32)])
    both = [_bits([F.col(f"v{n}_{s}") for s in range(32)], F.col("weight")) for n in (0, 1)]
    return votes.select(*keys, both[1].alias("hi"), both[0].alias("lo"))


def distance(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))


def likeness(hi: str, lo: str, hi2: str, lo2: str) -> Column:
    """Share of equal bits."""
    return 1 - distance(*map(F.col, (hi, lo, hi2, lo2))) / F.lit(float(BITS))


def as_text(hi: str, lo: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (hi, lo)]))


class _Tables:
    """The bits cut into ``radius + 2`` blocks, and the pairs of blocks, one table each."""

    def __init__(self, radius: int):
        if not 0 <= radius <= 15:
            raise ValueError("radius must be 0 to 15")
        self.radius, self.n = radius, radius + 2
        half = (self.n + 1) // 2        # blocks in ``lo``; none lies in both halves
        self.cuts = [64 * k // half for k in range(half)] + [64 + 64 * k // (self.n - half) for k in range(self.n - half + 1)]
        self.pairs = list(combinations(range(self.n), 2))

    def masks(self, k: int) -> tuple[int, int]:
        """The bits of block ``k`` in ``hi`` and in ``lo``, as bigints."""
        def mask(base: int) -> int:
            a, b = max(self.cuts[k], base) - base, min(self.cuts[k + 1], base + 64) - base
            bits = ((1 << b) - (1 << a)) if a < b else 0
            return bits - (1 << 64) if bits >> 63 else bits
        return mask(64), mask(0)

    def tops(self) -> tuple[int, int]:
        """The highest bit of each block, in ``hi`` and in ``lo``; of the last blocks of both, bit 62."""
        places = [min(c - 1, (c - 1) // 64 * 64 + 62) for c in self.cuts[1:]]
        return tuple(sum(1 << p - base for p in places if base <= p < base + 64) for base in (64, 0))

    def block(self, k: int, hi: Column, lo: Column) -> list[Column]:
        """The bits of block ``k`` in ``lo`` and in ``hi`` (one of them where it has none in the other)."""
        parts = []
        for c, base in ((lo, 0), (hi, 64)):
            a, b = max(self.cuts[k], base) - base, min(self.cuts[k + 1], base + 64) - base
            if a < b:
                mask = (1 << (b - a)) - 1
                parts.append(F.shiftrightunsigned(c, a).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1)))
        return parts

    def rows(self, prints: DataFrame) -> DataFrame:
        """Each row of ``prints`` once for every table, with the table's number ``t`` and its ``key`` there
        (the number, and 56 bits of a hash; a collision only proposes a pair). A sort by ``key`` tells most rows by one word."""
        parts = [self.block(k, F.col("hi"), F.col("lo")) for k in range(self.n)]
        # one row becomes many: dealt out by another key than it lies by, so that the count of parts holds
        deal = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keys = F.array(*[F.shiftrightunsigned(F.xxhash64(*parts[i], *parts[j]), 8).bitwiseOR(F.lit(t << 56 if t < 128 else (t << 56) - (1 << 64)))
                         for t, (i, j) in enumerate(self.pairs)])
        return prints.repartition(deal, F.xxhash64("hi", "lo")).select("*", F.posexplode(keys).alias("t", "key"))


def near_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs ``hi, lo, hi2, lo2`` of different fingerprints within ``radius``
    bits, each once with ``(hi, lo) < (hi2, lo2)``.

    ``prints`` has columns ``hi, lo``; equal fingerprints count once, nulls take
    no part. ``radius`` must be 0 to 15. Every pair is a row: where groups are large
    and their number is all that is asked for, use ``near_counts``.
    """
    tables = _Tables(radius)
    one = prints.select("hi", "lo").where(F.col("hi").isNotNull() & F.col("lo").isNotNull()).distinct()
    table = tables.rows(one)
    a, b = table.hint("merge").alias("a"), table.alias("b")
    hi, lo = F.col("a.hi").bitwiseXOR(F.col("b.hi")), F.col("a.lo").bitwiseXOR(F.col("b.lo"))
    agree = reduce(lambda x, y: x.bitwiseOR(y), [
        F.when(reduce(lambda x, y: x & y, [p == 0 for p in tables.block(k, hi, lo)]), F.lit(1 << k)).otherwise(F.lit(0))
        for k in range(tables.n)])
    upto = F.get(F.lit([(2 << j) - 1 for _, j in tables.pairs]), F.col("a.t"))
    own = F.get(F.lit([1 << i | 1 << j for i, j in tables.pairs]), F.col("a.t"))
    less = (F.col("a.hi") < F.col("b.hi")) | ((F.col("a.hi") == F.col("b.hi")) & (F.col("a.lo") < F.col("b.lo")))
    close = distance(F.col("a.hi"), F.col("a.lo"), F.col("b.hi"), F.col("b.lo")) <= radius
    return (a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & less & close
                   & (agree.bitwiseAND(upto) == own))
             .select("a.hi", "a.lo", F.col("b.hi").alias("hi2"), F.col("b.lo").alias("lo2")))


def near_counts(prints: DataFrame, radius: int = RADIUS, size: int = GROUP) -> DataFrame:
    """``hi, lo, n_near`` of the fingerprints that have others within ``radius`` bits: the
    sum of ``n`` over the different ones that are that near.

    ``prints`` has ``hi, lo, n`` (a count); equal fingerprints add up, nulls take no part;
    ``radius`` must be 0 to 15. An empty table gives an empty result.

    Fingerprints of one key lie in blocks of at most ``size``, one array row each; blocks of
    the same key meet in pairs, dealt out singly, and the hits are counted inside the arrays.
    So a row stands for a fingerprint in a pair of blocks, never for a pair of
    fingerprints. A pair counts in the first of the tables whose two blocks it agrees on.
    """
    tables = _Tables(radius)
    one = (prints.where(F.col("hi").isNotNull() & F.col("lo").isNotNull())
                 .groupBy("hi", "lo").agg(F.sum("n").cast("bigint").alias("n")))
    whole = Window.partitionBy("key")
    met = (tables.rows(one).drop("t").withColumn("many", F.count(F.lit(1)).over(whole)).where(F.col("many") > 1)
                 .withColumn("b", F.floor((F.row_number().over(whole.orderBy("hi", "lo")) - 1) / size).cast("int")))
    blocks = (met.groupBy("key", "b").agg(F.collect_list(F.struct("hi", "lo", "n")).alias("a"),
                                          (F.floor((F.first("many") - 1) / size) + 1).cast("int").alias("m")))
    blocks = written(blocks, "print-blocks")
    several = blocks.where(F.col("m") > 1)
    # block b meets each other block of its key, under the pair's two numbers
    dealt = several.select("key", "b", "a", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o")).where("o <> b")
    ends = ["key", "x", "y"]
    low = dealt.where("b < o").select("key", F.col("b").alias("x"), F.col("o").alias("y"), F.col("a").alias("own"))
    high = dealt.where("b > o").select("key", F.col("o").alias("x"), F.col("b").alias("y"), F.col("a").alias("other"))
    across = low.hint("merge").join(high, ends).select("key", "own", "other")
    meetings = (blocks.select("key", F.col("a").alias("own"), F.col("a").alias("other")).unionByName(across)
                      .unionByName(across.select("key", F.col("other").alias("own"), F.col("own").alias("other")))
                      .withColumn("t", F.shiftrightunsigned("key", 56).cast("int")))
    found = _hits(meetings, tables).groupBy("hi", "lo").agg(F.sum("c").alias("n_near"), F.max("most").alias("most"))
    return found.where(F.col("most") > 0).select("hi", "lo", "n_near")


def _hits(meetings: DataFrame, tables: _Tables) -> DataFrame:
    """``hi, lo, c, most``: for each entry of ``own`` in each row of ``meetings``, the sum and the largest ``n`` of the
    entries of ``other`` that are near it and are met in table ``t`` first; several rows an entry.

    ``PACK`` entries of ``other`` are compared by expressions without loops or lambdas, which Spark compiles. As ``c`` and
    ``most`` both take each of them, it is a common subexpression and so a method: all in one were too long for the JIT.
    """
    # a block that may agree counts as one that does not: all its bits differ
    off = [[sum(tables.masks(k)[side] for k in range(tables.n) if k in (i, j) or k > j) for side in (0, 1)] for i, j in tables.pairs]
    packs = (meetings.select("own", *[F.col("other")[c].alias(f"{c}s") for c in ("hi", "lo", "n")],
                             *[F.get(F.lit([x[s] for x in off]), F.col("t")).alias(f"off_{c}") for s, c in enumerate(("hi", "lo"))],
                             F.explode(F.sequence(F.lit(1), F.size("other"), F.lit(PACK))).alias("o"))
                     .select("own", "off_hi", "off_lo", *[F.slice(c, F.col("o"), F.lit(PACK)).alias(c) for c in ("his", "los", "ns")]))

    def unlike(k: int, c: str, top: int) -> str:
        """SQL: no block before the table's second one but its first agrees."""
        v = f"({c} ^ get({c}s, {k}) | off_{c})"
        v = f"({v} | shiftrightunsigned({v}, 1) & {1 << 62})"       # bit 62 stands for 63, too
        rest = (1 << 63) - 1 - top      # adding it carries into the block's top bit unless all others are 0
        return f"((({v} & {rest}) + {rest} | {v}) & {top}) = {top}"

    def hit(k: int) -> Column:
        apart = f"(bit_count(hi ^ get(his, {k})) + bit_count(lo ^ get(los, {k})))"
        first = " AND ".join(unlike(k, c, top) for c, top in zip(("hi", "lo"), tables.tops()))
        return F.expr(f"CASE WHEN {apart} <= {tables.radius} THEN CASE WHEN {apart} > 0 AND {first} THEN coalesce(get(ns, {k}), 0L) ELSE 0L END ELSE 0L END")

    hits = [hit(k) for k in range(PACK)]
    return packs.select("*", F.inline("own")).select("hi", "lo", reduce(lambda x, y: x + y, hits).alias("c"), F.greatest(*hits).alias("most"))


CUTS = 128


def _stretches(docs: DataFrame, id_col: str) -> tuple[Column, list[tuple[int, int | None]]]:
    """A number that grows with the id and deals the rows out evenly, and
    (stretch, largest id) of the stretches that have rows, downwards.

    The id range is cut at ``CUTS`` quantiles, and between two of them into equal
    parts, about four stretches for each shuffle partition in all; that bounds the list.
    """
    spark = docs.sparkSession
    parts = max(1, -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // CUTS))
    points = [k / CUTS for k in range(CUTS + 1)]
    cuts = sorted(set(docs.agg(F.percentile_approx(id_col, points, F.lit(100_000)).alias("q")).first().q or [0]))
    key = F.col(id_col)

    def place(lo: int, hi: int) -> Column:
        """Number of cuts below the key, of which there are ``lo`` to ``hi`` (null: ``lo``)."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key > cuts[mid], place(mid + 1, hi)).otherwise(place(lo, mid))

    low, high = [cuts[0], *cuts], [*cuts, cuts[-1]]
    at = place(0, len(cuts))
    begin, end = (F.get(F.lit(x), at).cast("double") for x in (low, high))
    inside = F.floor((key.cast("double") - begin) * parts / (end - begin + 1))
    stretch = (at * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.coalesce(inside, F.lit(0))))).cast("int")
    tops = docs.groupBy(stretch.alias("s")).agg(F.max(id_col).alias("top")).collect()
    return stretch, sorted(((r.s, r.top) for r in tops), reverse=True)


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document's.

    Documents are taken by descending id (null ids last, ties by text); the edited
    text is the text with its last ``floor(n_chars / 2)`` code points replaced by
    the first as many (or all) of the next document's, the first document being
    next to the last. Columns: ``id_col, n_chars, edited_sha256, hi, lo, edited_hi,
    edited_lo, next_hi, next_lo``; one row per row. Null text counts as empty.

    Texts are shuffled once, by stretches of ids. The first document of each
    stretch is copied to the end of the one before it, so neighbours meet within
    stretches; all further steps keep that partitioning.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    stretch, tops = _stretches(base, "id")
    kind = base.schema["id"].dataType.simpleString()
    after = {s: tops[(k + 1) % len(tops)] for k, (s, _) in enumerate(tops)}     # the stretch that follows downwards
    heads = base.sparkSession.createDataFrame([(nxt, top, s) for s, (nxt, top) in after.items()],
                                              f"s int, top {kind}, to int")
    placed = base.withColumn("s", stretch).alias("r")
    h = F.broadcast(heads).alias("h")
    here = F.struct(F.col("r.s").alias("s"), F.lit(0).alias("head"))
    copy = F.struct(F.col("h.to").alias("s"), F.lit(1).alias("head"))
    rows = (placed.join(h, (F.col("r.s") == F.col("h.s")) & F.col("id").eqNullSafe(F.col("top")), "left")
                  .select("id", "text", F.explode(F.when(F.col("h.to").isNull(), F.array(here)).otherwise(F.array(here, copy))).alias("p"))
                  .select("id", "text", "p.s", "p.head"))
    order = Window.partitionBy("s").orderBy("head", F.desc_nulls_last("id"), "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
                      F.substring("next", F.lit(1), half))
    texts = (rows.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
                 .withColumn("n_chars", F.char_length("text").cast("bigint"))
                 .withColumn("edited", F.when(F.col("head") == 0, F.coalesce(edited, F.lit("")))))
    keys = ["s", "place", "head", "id", "n_chars", "sha"]
    sides = (texts.withColumn("sha", F.unhex(F.sha2("edited", 256)))
                  .select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")),
                                                   F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")))).alias("x"))
                  .select(*keys, "x.side", "x.body").where((F.col("side") == 0) | (F.col("head") == 0)))
    prints = simhash(sides, [*keys, "side"], "body")
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    wide = prints.groupBy(*keys).agg(pick(0, "hi").alias("hi"), pick(0, "lo").alias("lo"),
                                     pick(1, "hi").alias("edited_hi"), pick(1, "lo").alias("edited_lo"))
    follow = Window.partitionBy("s").orderBy("place")
    return (wide.withColumn("next_hi", F.lead("hi").over(follow)).withColumn("next_lo", F.lead("lo").over(follow))
                .where(F.col("head") == 0)
                .select(F.col("id").alias(id_col), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "hi", "lo",
                        "edited_hi", "edited_lo", "next_hi", "next_lo"))


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, their likenesses, and how many other documents
    have a different fingerprint within the radius (``n_near``)."""
    from ..session import read_table
    f = written(fingerprint_with_edits(read_table(spark, sf_dir, "documents")), "fingerprints")
    near = near_counts(f.select("hi", "lo", F.lit(1).cast("bigint").alias("n")))
    return (f.join(near, ["hi", "lo"], "left")
             .select("doc_id", "n_chars", "edited_sha256", as_text("hi", "lo").alias("fingerprint"),
                     as_text("edited_hi", "edited_lo").alias("edited_fingerprint"),
                     likeness("hi", "lo", "edited_hi", "edited_lo").alias("near_edited"),
                     likeness("hi", "lo", "next_hi", "next_lo").alias("near_next"),
                     F.coalesce("n_near", F.lit(0)).alias("n_near")))
