import random
import re

import numpy as np

from trafficbrick.llm import jaccard_join as J
from trafficbrick.llm.components import components

SCHEMA = "sig string, doc_id long, text string, label long"


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """id -> (class, representative, copies, links), for distinct ids."""
    texts = {}
    for k, t in rows:
        texts.setdefault(t or "", []).append(k)
    reps = {min(ks): shingle_set(t) for t, ks in texts.items()}
    links = {a: {b for b in reps if b != a and reps[a] and 5 * len(reps[a] & reps[b]) >= 4 * len(reps[a] | reps[b])}
             for a in reps}
    label = {a: a for a in reps}
    changed = True
    while changed:
        changed = False
        for a in reps:
            m = min([label[a], *[label[b] for b in links[a]]])
            if m < label[a]:
                label[a], changed = m, True
    return {k: (label[min(ks)], min(ks), len(ks), len(links[min(ks)])) for ks in texts.values() for k in ks}


def near(rnd, words, edits):
    w = list(words)
    for _ in range(edits):
        i = rnd.randrange(len(w))
        w[i:i + 1] = rnd.choice([[], [f"n{rnd.random()}"], [w[i], "added"]])
    return " ".join(w)


def make_rows():
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    passage = rnd.choices(vocab, k=60)
    for _ in range(30):
        words = rnd.choices(vocab, k=rnd.randrange(40, 300)) + (passage if rnd.random() < .5 else [])
        for _ in range(rnd.randrange(1, 8)):
            rows.append((k, near(rnd, words, rnd.randrange(0, 8))))
            k += 1
    hot = rnd.choices(vocab, k=200)
    rows += [(k + i, near(rnd, hot, rnd.randrange(0, 4))) for i in range(150)]
    rows += [(5000 + i, rows[7][1]) for i in range(40)]
    rows += [(6000, None), (6001, ""), (6002, " \n"), (6003, "a b"), (6004, "a  b"), (6005, "a b"), (6006, "a b c d e"),
             (6007, "a b c d e f"), (6008, " ".join(vocab * 50)), (6009, " ".join(vocab * 50 + ["x"]))]
    rnd.shuffle(rows)
    return rows


def test_matches_brute_force_in_small_blocks(spark, table, monkeypatch):
    rows = make_rows()
    monkeypatch.setattr(J, "BLOCK", 32)     # hot groups over many pairs of blocks
    got = J.near_duplicates(table([("s", k, t, 1) for k, t in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.class_id, r.rep_id, r.n_copies, r.n_links) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_null_ids_repeated_rows_and_empty_table(spark, table):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [("s", None, t, 1), ("s", 4, t, 1), ("s", 4, t, 1), ("s", 9, t + " x", 1), ("s", None, "alone", 1)]
    got = sorted(J.near_duplicates(table(rows, SCHEMA)).collect(), key=str)
    assert [(r.doc_id, r.class_id, r.rep_id, r.n_copies, r.n_links) for r in got] == sorted(
        [(None, 4, 4, 3, 1), (4, 4, 4, 3, 1), (4, 4, 4, 3, 1), (9, 4, 9, 1, 1), (None, None, None, 1, 0)], key=str)
    assert J.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_of_texts(rows):
    """One row per row, with every text a node of its own: (id, class, representative, copies, links)."""
    texts = {}
    for k, t in rows:
        texts.setdefault(t or "", []).append(k)
    own = {t: min((k for k in ks if k is not None), default=None) for t, ks in texts.items()}
    sets = {t: shingle_set(t) if own[t] is not None else set() for t in texts}
    links = {a: [b for b in texts if b != a and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])] for a in texts}
    group = {t: n for n, t in enumerate(texts)}
    for _ in texts:
        for a in texts:
            for b in links[a]:
                group[a] = group[b] = min(group[a], group[b])
    least = {}
    for t, g in group.items():
        if own[t] is not None:
            least[g] = min(least.get(g, own[t]), own[t])
    return [(k, least.get(group[t or ""]), own[t or ""], len(texts[t or ""]), len(links[t or ""])) for k, t in rows]


def test_several_texts_of_one_id(spark, table):
    """Links belong to texts: no text of a repeated id loses its own or gets another's."""
    x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    rows = [(1, x), (1, y), (2, x + " more"), (3, y + " more"), (3, x + " more"), (4, "a b c d e f"), (4, None), (None, y), (None, "no id at all"),
            (7, y), (7, y), (-9, x + " more"), (1, "a b c d e f"), (2, y + " less so"), (8, "")]
    got = J.near_duplicates(table([("s", k, t, 1) for k, t in rows], SCHEMA)).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted([(r.doc_id, r.class_id, r.rep_id, r.n_copies, r.n_links) for r in got], key=key) == sorted(brute_of_texts(rows), key=key)
    rnd = random.Random(17)
    base = [[f"{k}.{i}" for i in range(60)] for k in range(6)]
    rows = [(rnd.randrange(12), near(rnd, rnd.choice(base), rnd.randrange(5))) for _ in range(120)]
    got = J.near_duplicates(table([("s", k, t, 1) for k, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id, r.class_id, r.rep_id, r.n_copies, r.n_links) for r in got) == sorted(brute_of_texts(rows))


def test_components_of_hubs(spark):
    """Hubs with most of the edges, dealt over several keys."""
    rnd = random.Random(5)
    edges = [(0, i) for i in range(1, 800)] + [(i, 900) for i in range(500, 700)] + [(1000 + i, 3000 - i) for i in range(40)] \
        + [(5000, 4000 + i) for i in range(300)]
    rnd.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {n: 0 for a, b in edges[:] for n in (a, b) if n <= 900} | {n: min(a, b) for a, b in edges if 1000 <= min(a, b) < 4000 for n in (a, b)}
    want |= {n: 4000 for a, b in edges if max(a, b) == 5000 for n in (a, b)}
    assert got == want


def test_posterior_bound():
    rnd = np.random.default_rng(1)
    need = J.needed(0.8, 1e-6)
    assert need == sorted(need) and 0 < need[0] < 13
    j = rnd.uniform(size=400_000)
    m = rnd.binomial(16, j)
    low = m < need[0]       # with a uniform prior hardly any of those is at the threshold
    assert (j[low] >= 0.8).mean() < 1e-4


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(140)] + [(500 + i, 501 + i) for i in range(60)] + [(None, 3), (7, 7)]
    label = {x: x for a, b in edges if a is not None and a != b for x in (a, b)}
    for _ in range(400):
        for a, b in edges:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.label for r in got} == label and len(got) == len(label)


def test_query_on_the_table(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.rep_id, r.n_copies, r.n_links) for r in J.op6_jaccard_join(spark, sf_small).collect()}
    assert got == brute(docs)
