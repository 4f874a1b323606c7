import hashlib
import random

from trafficbrick.llm import fingerprints as P

SCHEMA = "hi string, doc_id long, text string, s int"


def shown(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -10 ** 18), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((i, t, t[:len(t) - half] + after[:half], after))
    return out


def check(got, rows):
    by_text, want = {}, shown(rows)
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256) for r in got)
    assert have == sorted((i if i is not None else -1, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want)
    texts = {}
    for i, t, e, after in want:
        texts.setdefault((i, len(t), hashlib.sha256(e.encode()).hexdigest()), (t, e, after))
    for r in got:
        t, e, after = texts[r.doc_id, r.n_chars, r.edited_sha256]
        for text, print_ in ((t, (r.hi, r.lo)), (e, (r.edited_hi, r.edited_lo)), (after, (r.next_hi, r.next_lo))):
            assert by_text.setdefault(text, print_) == print_       # equal texts, equal fingerprints


def test_neighbours_over_stretches(spark, table):
    rnd = random.Random(3)
    rows = [(i * 7 - 50, " ".join(rnd.choices(["a", "é", "word", "日本\n", "x\u000b"], k=rnd.randrange(30)))) for i in range(120)]
    rows += [(None, "no id here"), (9999, None), (9998, ""), (9997, " \t\n"), (9996, "one"), (9996, "one"), (9995, "long word " * 5000)]
    got = P.fingerprint_with_edits(table([("x", i, t, 1) for i, t in rows], SCHEMA)).collect()
    check(got, rows)
    one = P.fingerprint_with_edits(table([("x", 5, "just one text", 1)], SCHEMA)).collect()
    check(one, [(5, "just one text")])
    assert P.fingerprint_with_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    ids = spark.createDataFrame([("x", None, "a b c", 1), ("x", None, "b", 1)], SCHEMA)
    check(P.fingerprint_with_edits(ids).collect(), [(None, "a b c"), (None, "b")])


def test_votes_match_a_plain_count(spark):
    text = "to be or not to be that is"
    h = lambda *c: spark.range(1).selectExpr(f"xxhash64({', '.join(map(repr, c))}) as h").first().h
    again = lambda v: spark.range(1).selectExpr(f"xxhash64({v}L) as h").first().h
    w = text.split()
    votes, weight = [0] * 128, 0
    for terms, x in (([(a,) for a in w], 1), (list(zip(w, w[1:])), 2)):
        for t in terms:
            lo = h(*t)
            bits = (lo & (1 << 64) - 1) | (again(lo) & (1 << 64) - 1) << 64
            weight += x
            for k in range(128):
                votes[k] += x * (bits >> k & 1)
    want = sum(1 << k for k in range(128) if 2 * votes[k] > weight)
    r = P.simhash(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t").first()
    assert (r.hi & (1 << 64) - 1) << 64 | (r.lo & (1 << 64) - 1) == want


def test_block_tables_find_all_within_the_radius(spark):
    rnd = random.Random(8)
    base = [rnd.getrandbits(128) for _ in range(8)]
    prints = {0, (1 << 128) - 1}
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(rnd.randrange(7)):
                x ^= 1 << rnd.randrange(128)
            prints.add(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(signed(p >> 64), signed(p & (1 << 64) - 1)) for p in prints]
    df = spark.createDataFrame(rows + rows[:5] + [(None, 1)], "hi long, lo long")
    number = lambda hi, lo: (hi & (1 << 64) - 1) << 64 | lo & (1 << 64) - 1
    for radius in (0, 3, 6):
        found = [frozenset((number(r.hi, r.lo), number(r.hi2, r.lo2))) for r in P.near_pairs(df, radius).collect()]
        want = {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= radius}
        assert len(found) == len(set(found)) and set(found) == want


def test_query_on_the_table(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    got = P.op7_fingerprints(spark, sf_small).collect()
    want = {i: (len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in shown(docs)}
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    assert all(len(r.fingerprint) == 32 and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    mean = lambda c: sum(r[c] for r in got) / len(got)
    assert mean("near_edited") > mean("near_next") + 0.1


def test_block_tables_at_the_query_s_radius(spark):
    rnd = random.Random(12)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    prints = set()
    for _ in range(6):
        b = rnd.getrandbits(128)
        for _ in range(25):
            x = b
            for k in rnd.sample(range(128), rnd.randrange(12)):
                x ^= 1 << k
            prints.add(x)
    df = spark.createDataFrame([(signed(p >> 64), signed(p & (1 << 64) - 1)) for p in prints], "hi long, lo long")
    number = lambda hi, lo: (hi & (1 << 64) - 1) << 64 | lo & (1 << 64) - 1
    for radius in (12, 15):
        found = [frozenset((number(r.hi, r.lo), number(r.hi2, r.lo2))) for r in P.near_pairs(df, radius).collect()]
        want = {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= radius}
        assert len(found) == len(set(found)) and set(found) == want


def test_counts_match_brute_force(spark):
    """Blocks of few fingerprints: groups meet as pairs of blocks."""
    rnd = random.Random(21)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    prints = {}
    for size in (1, 3, 70, 5):
        b = rnd.getrandbits(128)
        for _ in range(size):
            x = b
            for k in rnd.sample(range(128), rnd.randrange(12)):
                x ^= 1 << k
            prints[x] = prints.get(x, 0) + rnd.randrange(1, 4)
    rows = [(signed(p >> 64), signed(p & (1 << 64) - 1), 1) for p, n in prints.items() for _ in range(n)]
    df = spark.createDataFrame(rows + [(None, 1, 5)], "hi long, lo long, n long")
    number = lambda hi, lo: (hi & (1 << 64) - 1) << 64 | lo & (1 << 64) - 1
    for radius, size in ((12, 256), (12, 8), (3, 2)):
        got = {number(r.hi, r.lo): r.n_near for r in P.near_counts(df, radius, size).collect()}
        want = {a: sum(n for b, n in prints.items() if 0 < (a ^ b).bit_count() <= radius) for a in prints}
        assert got == {a: n for a, n in want.items() if n}, (radius, size)
    assert P.near_counts(df.limit(0)).count() == 0


def test_n_near_of_the_query(spark, sf_small):
    got = P.op7_fingerprints(spark, sf_small).collect()
    prints = [int(r.fingerprint, 16) for r in got]
    for r in got:
        own = int(r.fingerprint, 16)
        assert r.n_near == sum(0 < (own ^ p).bit_count() <= P.RADIUS for p in prints)


def test_edited_copies_of_ordinary_length_are_near(spark, sf_small, tmp_path):
    rnd = random.Random(7)
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    texts = [r.text.split() for r in spark.read.parquet(f"{sf_small}/documents.parquet").orderBy("doc_id").collect() if r.text]
    vocabulary, rows = [w for t in texts for w in t], []
    for w in [t for t in texts if 200 <= len(t) <= 400][:60]:
        v = list(w)
        for k in rnd.sample(range(len(w)), len(w) // 60):
            v[k] = rnd.choice(vocabulary)
        a, b = grams(w), grams(v)
        if 0.8 <= len(a & b) / len(a | b) < 0.9:
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    assert len(rows) >= 60
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = P.op7_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sum(r.n_near > 0 for r in got) >= 0.8 * len(rows)


def test_comparisons_are_compiled(spark, capsys):
    """No lambda runs for each two fingerprints that meet: Spark interprets lambdas."""
    P.near_counts(spark.createDataFrame([(1, 2, 1), (1, 3, 1)], "hi long, lo long, n long")).explain(True)
    plan = capsys.readouterr().out
    assert "inline(own" in plan and "lambda" not in plan


def test_counts_at_every_radius(spark):
    """Differences in the first and last bits of both halves, several packs a block, blocks of several sizes."""
    rnd = random.Random(4)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    ends = (0, 62, 63, 64, 126, 127)
    base = rnd.getrandbits(128)
    prints = {base, base ^ (1 << 128) - 1, 0, (1 << 128) - 1, *(base ^ 1 << k for k in ends), *(base ^ 1 << k ^ 1 << j for k in ends for j in ends)}
    while len(prints) < 130:
        x = base
        for k in rnd.sample(range(128), rnd.randrange(18)):
            x ^= 1 << k
        prints.add(x)
    weight = {p: rnd.randrange(1, 4) for p in prints}
    df = spark.createDataFrame([(signed(p >> 64), signed(p & (1 << 64) - 1), n) for p, n in weight.items()], "hi long, lo long, n long")
    number = lambda hi, lo: (hi & (1 << 64) - 1) << 64 | lo & (1 << 64) - 1
    for radius, size in ((0, 256), (1, 50), (2, 256), (11, 100), (12, 1024), (15, 60)):
        got = {number(r.hi, r.lo): r.n_near for r in P.near_counts(df, radius, size).collect()}
        want = {a: sum(n for b, n in weight.items() if 0 < (a ^ b).bit_count() <= radius) for a in weight}
        assert got == {a: n for a, n in want.items() if n}, (radius, size)


def test_votes_add_up_over_shares(spark, monkeypatch):
    df = spark.createDataFrame([(1, " ".join(f"w{k * k % 97}" for k in range(500))), (2, "a"), (3, ""), (4, "same " * 60_000)], "k int, t string")
    whole = {tuple(r) for r in P.simhash(df, ["k"], "t").collect()}
    monkeypatch.setattr(P, "SHARE", 7)
    assert {tuple(r) for r in P.simhash(df, ["k"], "t").collect()} == whole and len(whole) == 4
