import hashlib
import random
import re

import pytest

from trafficbrick.llm.substring_dedup import COVERS, cover_for, op1_substring_dedup, remove_repeats

SCHEMA = "lang string, doc_id long, text string, n_words long"


def brute(rows, size):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in rows}
    out = {}
    for k, w in words.items():
        earlier = {tuple(v[i:i + size]) for j, v in words.items() if j < k for i in range(len(v) - size + 1)}
        gone = set()
        for i in range(len(w) - size + 1):
            if tuple(w[i:i + size]) in earlier:
                gone |= set(range(i, i + size))
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_covers_hold_every_difference():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert cover_for(50) == (31, COVERS[31], 20)


@pytest.mark.parametrize("size", [3, 8, 50])
def test_matches_brute_force(spark, table, size):
    rnd = random.Random(size)
    vocab = ["a", "é", "日本", "x" * 300, "b,", "c"] + [f"w{i}" for i in range(30)]
    base = [rnd.choices(vocab, k=size * 4) for _ in range(4)]
    rows = []
    for k in range(30):
        w = []
        for _ in range(rnd.randrange(4)):
            src = rnd.choice(base)
            i = rnd.randrange(len(src))
            w += src[i:i + rnd.randrange(2 * size)] + rnd.choices(vocab, k=rnd.randrange(5))
        rows.append((k * 7 % 31, rnd.choice([" ", "\n", " \t\r\x0b\x0c "]).join(w)))
    rows += [(100, None), (101, ""), (102, "  \n"), (103, rows[5][1]), (104, rows[5][1]), (105, "a b " * 60),
             (106, "a b  " * 60), (107, " ".join(base[0] * 200))]
    got = remove_repeats(table([("x", k, t, 7) for k, t in rows], SCHEMA), size=size).collect()
    assert {r.rest.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == brute(rows, size)
    assert all(r.rest.n_words == 7 and r.rest.lang == "x" for r in got)


def test_null_ids_repeated_rows_and_empty_table(spark, table):
    text = " ".join(f"w{i}" for i in range(9))
    rows = [("x", None, text, 1), ("x", 5, text, 1), ("x", 5, text, 1), ("x", 6, text, 1)]
    got = sorted((r.rest.doc_id or -1, r.n_removed) for r in remove_repeats(table(rows, SCHEMA), size=4).collect())
    assert got == [(-1, 0), (5, 0), (5, 0), (6, 9)]
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_of_one_id_keep_apart(spark, table):
    """A passage of a smaller id goes from each text of a repeated id that has it, and from no other."""
    passage = " ".join(f"p{i}" for i in range(8))
    rows = [("x", 1, passage, 1), ("x", 2, "a " + passage, 1), ("x", 2, "b c d e f g", 1), ("x", 2, passage + " z", 1), ("x", 2, passage, 1),
            ("x", 2, passage, 1)]
    got = sorted((r.rest.doc_id, r.text, r.n_removed) for r in remove_repeats(table(rows, SCHEMA), size=4).collect())
    assert got == sorted([(1, passage, 0), (2, "a", 8), (2, "b c d e f g", 0), (2, "z", 8), (2, "", 8), (2, "", 8)])


def test_query_on_the_table(spark, sf_small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    want = {k: (n, m, hashlib.sha256(t.encode()).hexdigest()) for k, (n, m, t) in brute(docs.items(), 50).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op1_substring_dedup(spark, sf_small).collect()}
    assert got == want and any(m for _, m, _ in want.values())
