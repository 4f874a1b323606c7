import hashlib
import random
import re
import zlib

import pytest

from trafficbrick.llm.periodic_runs import find_runs, op11_periodic_runs, with_periodic_tail

SCHEMA = "doc_id long, runs string, text string, n_words long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w, size=24, exponent=3):
    """Every maximal stretch of every period, the smallest period of each."""
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(size, exponent * q):
                out.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def noisy(rnd, vocab):
    w = []
    for _ in range(rnd.randrange(6)):
        kind = rnd.random()
        if kind < 0.6:
            unit = rnd.choices(vocab, k=rnd.randrange(1, 9))
            if rnd.random() < 0.4:      # a period with shorter repeats inside
                unit = unit * rnd.randrange(1, 4) + [rnd.choice(vocab)]
            stretch = unit * rnd.randrange(1, 9)
            w += stretch[:len(stretch) - rnd.randrange(len(unit))]
        elif w and kind < 0.8:
            i = rnd.randrange(len(w))
            w += w[i:i + rnd.randrange(50)]
        else:
            w += rnd.choices(vocab, k=rnd.randrange(20))
    return w


@pytest.mark.parametrize("size,exponent", [(24, 3), (6, 3), (3, 3), (13, 4)])
def test_matches_brute_force(table, size, exponent):
    rnd = random.Random(size)
    few, many = ["a", "é"], ["日本", "x" * 300, "b,", "c"] + [f"w{i}" for i in range(40)]
    rows = [(k, rnd.choice([" ", "\n", " \t\r\x0b\x0c "]).join(noisy(rnd, rnd.choice([few, many])))) for k in range(120)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a " * 5000), (903, "a " * 5000), (None, "x y " * 30),
             (904, " ".join(f"v{i % 700}" for i in range(5000))), (905, "one"), (905, "other")]
    got = find_runs(table([(k, "x", t, 7) for k, t in rows], SCHEMA), size=size, exponent=exponent).collect()
    seen = sorted((r.rest.doc_id or -1, r.n_words, [tuple(x) for x in r.runs], r.text) for r in got)
    want = []
    for k, t in rows:
        w = words_of(t)
        runs = brute_runs(w, size, exponent)
        want.append((k or -1 if k is None else k, len(w), runs, collapse(w, runs)))
    assert seen == sorted((k or -1, *x) for k, *x in want)
    assert all(r.rest.n_words == 7 and r.rest.runs == "x" for r in got)
    assert sum(len(r.runs) for r in got) > 40


def test_empty_table_and_arguments(spark):
    assert find_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert find_runs(spark.createDataFrame([("a " * 30,)], "text string")).collect()[0].runs[0].period == 1
    with pytest.raises(ValueError):
        find_runs(spark.createDataFrame([], SCHEMA), exponent=2)


def edited(doc_id, text):
    w, h = words_of(text), zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_edit(table):
    rows = [(k, "x", " ".join(f"w{i}" for i in range(k % 37)) + "\n", 0) for k in range(200)] + [(None, "x", "a b", 0), (7, "x", None, 0)]
    got = [(r.doc_id, words_of(r.text)) for r in with_periodic_tail(table(rows, SCHEMA)).collect()]
    want = [(k, edited(k, t) if k is not None else words_of(t)) for k, _, t, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def expected(doc_id, text):
    w = edited(doc_id, text)
    runs = brute_runs(w)
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapse(w, runs)))


def test_query_on_the_table(spark, sf_small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in op11_periodic_runs(spark, sf_small).collect()}
    short = {k for k, t in docs.items() if len(words_of(t)) < 1500}       # the brute force is quadratic
    assert set(got) == set(docs) and len(short) > 150
    assert {k: got[k] for k in short} == {k: expected(k, docs[k]) for k in short}


def test_sql_agrees(spark, sf_small):
    duckdb = pytest.importorskip("duckdb")
    from trafficbrick.llm.queries import SQL
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_small}/documents.parquet'")
    rel = con.execute(SQL["op11_periodic_runs"])
    names = [d[0] for d in rel.description]
    out = op11_periodic_runs(spark, sf_small)
    assert names == out.columns
    assert sorted(map(tuple, out.collect())) == sorted(rel.fetchall())
