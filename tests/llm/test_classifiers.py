import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa

from trafficbrick.llm import quality as Q
from trafficbrick.llm import toxicity as T
from trafficbrick.llm.sampling import held_out, labelled_sample
from trafficbrick.llm.wordhash import text_bytes

SCHEMA = "score string, doc_id long, text string, evidence int, rest int"


def brute_segments(values):
    """Maximal scoring subsequences by their definition (largest first, then both sides)."""
    if not values or max(values) <= 0:
        return []
    best = max(((sum(values[i:j]), i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)),
               key=lambda x: (x[0], x[1] - x[2]))
    s, i, j = best
    left, right = brute_segments(values[:i]), brute_segments(values[j:])
    return left + [(s, i, j - 1)] + [(t, a + j, b + j) for t, a, b in right]


def test_linear_scan_finds_all_maximal_segments():
    rnd = random.Random(6)
    for _ in range(400):
        n, drift = rnd.randrange(1, 25), 0.375
        values = [-drift] * n
        place = sorted(rnd.sample(range(n), rnd.randrange(n + 1)))
        for p in place:
            values[p] = rnd.choice([1.25, 2.1875, 0.53125, 3.0, -1.4375]) + rnd.randrange(64) / 1024
        got = T.segments(np.array(place, dtype=np.int64), np.array([values[p] for p in place]), drift)
        assert [(round(s, 9), a, b) for s, a, b in got] == [(round(s, 9), a, b) for s, a, b in brute_segments(values)]


def corpus(n=600):
    rnd = random.Random(2)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for k in range(n):
        w = rnd.choices(plain, k=rnd.randrange(20, 80))
        toxic = int(rnd.random() < .3)
        if toxic:
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(["idiot!", "Stupid", "scum", f"vile{rnd.choice(plain)}"]))
        rows.append((k, " ".join(w), toxic))
    return rows


def test_toxic_passages_and_odd_texts(spark, table):
    rows = corpus()
    m = T.fit(table([(t, y) for _, t, y in rows], "text string, label int"))
    odd = [(1000, None), (1001, ""), (1002, "!!! 123"), (1003, "idiot " * 3), (1004, "word1 " * 300_000 + "stupid idiot scum"),
           (1005, "word1 word2"), (1005, "word1 word2"), (None, "vilenew scum vileother")]
    df = table([("s", k, t, 1, 2) for k, t, _ in rows] + [("s", k, t, 1, 2) for k, t in odd], SCHEMA)
    out = T.score_toxicity(df, m).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in out)
    by = {r.rest.doc_id: r for r in out}
    assert np.mean([by[k].predicted == y for k, _, y in rows]) > 0.98
    assert [by[k].predicted for k in (1000, 1001, 1002, 1003, 1005, None)] == [0, 0, 0, 1, 0, 1]
    assert by[1000].score == by[1001].score == by[1002].score
    late = by[1004].passages
    assert late and odd[4][1][late[-1].first:late[-1].last].lower().startswith("stupid")
    for k, t, y in rows[:50]:
        assert all(p.first < p.last <= len(t) for p in by[k].passages)


def words_of(text):
    """Lower-cased runs of letters with their places."""
    out, now = [], ""
    for i, c in enumerate((text or "") + " "):
        if unicodedata.category(c)[0] == "L":
            now += c.lower() if len(c.lower()) == 1 else c
        elif now:
            out.append((now, i - len(now), i))
            now = ""
    return out


def key_of(word, size=None):
    """The hash of a word, or of its first letters."""
    from trafficbrick.llm.runs import run_sums
    from trafficbrick.llm.wordhash import mix
    points = np.array([ord(c) for c in word], dtype=np.uint32)
    total, _ = run_sums(points, np.array([0]), np.array([len(word)]))
    if size is None:
        return int(mix(total[-1:] + np.uint64(len(word)))[0])
    return int(mix(total[size:size + 1] + np.uint64(size << 32))[0])


def brute_scores(text, m):
    """Net score of every word, evidence and best of a text, by the definitions."""
    table = dict(zip(m.keys.tolist(), m.scores.tolist()))
    net = []
    for w, _, _ in words_of(text):
        names = [key_of(w)] + [key_of(w, k) for k in T.PREFIXES if len(w) > k]
        net.append(next((table[k] for k in names if k in table), 0.0) - m.drift)
    total, best, kept = 0.0, 0.0, []
    for s, a, b in brute_segments(net):
        minus = m.lam * s - m.log_k - np.log(max(len(net), 1))
        best = max(best, minus, m.lam * s / 10)
        if minus > 0:
            total += minus
            kept.append((s, a, b))
    return net, total, best, kept


def test_scores_by_brute_force(spark, table):
    """Word scores, segments, E-values, evidence and score of each text; and the model's own figures."""
    rows = corpus(300)
    m = T.fit(table([(t, y) for _, t, y in rows], "text string, label int"))
    texts = [(k, t) for k, t, _ in rows[:120]] + [(900, None), (901, "É! İdiot Stupidly ünd"), (902, "scum"), (903, "vileß vileword1")]
    out = {r.rest.doc_id: r for r in T.score_toxicity(table([("s", k, t, 1, 2) for k, t in texts], SCHEMA), m).collect()}
    for k, t in texts:
        _, evidence, best, kept = brute_scores(t, m)
        w = words_of(t)
        score = 1 / (1 + np.exp(-(m.weights[0] + m.weights[1] * np.log1p(evidence) + m.weights[2] * np.log1p(best))))
        assert abs(out[k].score - score) < 1e-9
        assert [(p.first, p.last) for p in out[k].passages] == [(w[a][1], w[b][2]) for _, a, b in kept]
        assert np.allclose([p.score for p in out[k].passages], [s for s, _, _ in kept])
    # lam and K are those of the clean texts as they are scanned
    nets = [brute_scores(t, m)[0] for _, t, y in rows if not y]
    flat = np.concatenate(nets)
    mass = np.exp(m.lam * flat).sum() + 0.5 * np.exp(m.lam * (m.scores - m.drift)).sum()
    assert abs(mass / (len(flat) + len(m.scores) / 2) - 1) < 1e-6
    clean = sorted(s for net in nets for s, _, _ in brute_segments(net))
    level = clean[(len(clean) - 1) // 2] if clean else 0.0
    assert not clean and m.log_k == 0 or abs(m.log_k - (np.log(sum(s >= level - 1e-12 for s in clean) / len(flat)) + m.lam * level)) < 1e-6


def test_e_values_of_clean_texts(spark, table):
    """On clean texts that the model has not seen, as many segments pass an E-value as it says, within a factor of two."""
    rnd = random.Random(12)
    word = lambda c, i: f"{c}{chr(97 + i % 26)}{chr(97 + i // 26)}"
    common, mild = [word("w", i) for i in range(200)], [word("m", i) for i in range(40)]

    def text(toxic):
        """Of some words, each of its own weight, toxic texts have up to eight times as many."""
        w = rnd.choices(common, k=rnd.randrange(40, 60))
        for k in range(len(w)):
            if rnd.random() < (0.25 if toxic else 0.06):
                i = int(40 * rnd.random() ** (2 if toxic else 0.7))
                w[k] = mild[i]
        return " ".join(w)

    m = T.fit(table([(text(k % 2 == 0), int(k % 2 == 0)) for k in range(3000)], "text string, label int"))
    assert len(m.keys) > 10
    fresh = [text(False) for _ in range(3000)]
    rows = table([(t, len(t.split())) for t in fresh], "text string, rest int")
    out = T.score_segments(spark, rows, m._replace(max_e=np.inf)).collect()
    for level in (1.0, 0.5, 0.2):
        passed = sum(r.rest * np.exp(m.log_k - m.lam * p.score) <= level for r in out for p in r.passages)
        assert level / 2 <= passed / len(fresh) <= 2 * level, (level, passed / len(fresh))


def test_rule_column_by_brute_force(spark, table):
    """The compiled column against the rules taken one by one."""
    rnd = random.Random(8)
    rows = []
    for k in range(400):
        w = [rnd.choice("abcdefgh") * rnd.randrange(2, 9) + rnd.choice(["", "!", ",", "#"]) for _ in range(rnd.randrange(5, 60))]
        if k % 3 == 0:
            w = [x for x in w[:6] for _ in range(5)]
        rows.append((k, " ".join(w), int(k % 3 != 0)))
    stats = Q.statistics(*text_bytes(pa.array([t for _, t, _ in rows])))
    m = Q.fit_rules(stats, np.array([y for *_, y in rows], float))
    assert m.rules
    got = {r.rest.doc_id: r.score for r in Q.score_quality(table([("s", k, t, 1, 2) for k, t, _ in rows], SCHEMA), m).collect()}
    for k, row in enumerate(stats):
        values = dict(zip(Q.STATS, row))
        logit = m.intercept + sum(r.weight for r in m.rules
                                  if all(values[stat] > limit if above else values[stat] <= limit for stat, above, limit in r.terms))
        assert abs(got[k] - 1 / (1 + np.exp(-logit))) < 1e-9


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    m = T.fit(spark.createDataFrame([], "text string, label int"))
    assert T.score_toxicity(none, m).count() == 0 and Q.score_quality(none, Q.fit_rules(np.zeros((0, len(Q.STATS))), np.zeros(0))).count() == 0


def test_models_without_both_labels(spark, table):
    for labels, want in (([], 0.0), ([0, 0], 0.0), ([1, 1], 1.0)):
        df = spark.createDataFrame([("some text here", y) for y in labels], "text string, label int")
        r = T.score_toxicity(table([("s", 1, "some text", 1, 1)], SCHEMA), T.fit(df)).first()
        assert abs(r.score - want) < 1e-9
        stats = Q.statistics(*text_bytes(pa.array(["some text here"] * len(labels)))) if labels else np.zeros((0, len(Q.STATS)))
        r = Q.score_quality(table([("s", 1, "some text", 1, 1)], SCHEMA), Q.fit_rules(stats, np.array(labels, float))).first()
        assert abs(r.score - want) < 1e-9


def test_statistics_by_hand():
    texts = ["", "  ", "Ab ab ab, C!\nx", "a|b 12 é", "a b c d e " * 2]
    s = [dict(zip(Q.STATS, r)) for r in Q.statistics(*text_bytes(pa.array(texts)))]
    assert not any(s[0].values()) and not any(s[1].values())
    assert np.isclose(s[2]["repeat_share"], 0) and np.isclose(s[2]["distinct_share"], 1) and s[2]["line_share"] == 1 / 5
    assert s[2]["upper_share"] == 2 / 8 and s[2]["exclaim_share"] == 1 / 14
    assert s[3]["bar_share"] == 1 / 3 and s[3]["other_byte_share"] == 2 / 9 and s[3]["digit_share"] == 2 / 9
    assert s[4]["distinct_share"] == 0.5 and s[4]["window_repeat_share"] == 1 - 5 / 6 and np.isclose(s[4]["log_words"], np.log1p(10))


def test_rules_learn_a_conjunction(spark, table):
    rnd = random.Random(4)
    rows = []
    for k in range(800):
        shout, repeat = rnd.random() < .5, rnd.random() < .5
        w = [rnd.choice("abcdefgh") * rnd.randrange(2, 9) + str(rnd.randrange(99)) for _ in range(40)]
        if repeat:
            w = [x for x in w[:10] for _ in range(4)]
        t = " ".join(w)
        rows.append((k, t.upper() if shout else t, int(not (shout and repeat))))
    stats = Q.statistics(*text_bytes(pa.array([t for _, t, _ in rows])))
    m = Q.fit_rules(stats, np.array([y for *_, y in rows], float))
    assert 0 < len(m.rules) < 120 and any(len(r.terms) > 1 for r in m.rules)
    odd = [(1000, None), (1001, ""), (1002, "\n"), (1003, "ABC " * 100_000), (None, "x"), (1004, "x"), (1004, "x")]
    out = Q.score_quality(table([("s", k, t, 1, 2) for k, t, _ in rows] + [("s", k, t, 1, 2) for k, t in odd], SCHEMA), m).collect()
    by = {r.rest.doc_id: r for r in out}
    assert len(out) == len(rows) + len(odd) and by[1000].score == by[1001].score == by[1002].score
    assert np.mean([by[k].predicted == y for k, _, y in rows]) > 0.98


def test_sample_and_fold(spark, table):
    docs = table([("s", k, f"t{k}", 1, 1) for k in range(200)], SCHEMA)
    labels = table([(k, k % 2) for k in range(150)] + [(3, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", max_rows=50).collect()
    assert len(got) == 50
    assert all(zlib.crc32(r.text[1:].encode()) % 5 and r.label == int(r.text[1:]) % 2 for r in got)
    fold = docs.select("doc_id", held_out("doc_id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in fold)


def accuracy(rows, labels, label, threshold):
    y = {r.doc_id: r[label] for r in labels}
    held = [(r, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    assert all(r.predicted == (r.score >= threshold) and 0 <= r.score <= 1 for r in rows)
    return np.mean([r.predicted == v for r, v in held])


def test_held_out_accuracy_of_the_queries(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert accuracy(T.op2_toxicity(spark, sf).collect(), labels, "toxic", 0.5) > 0.97
    assert accuracy(Q.op8_quality_rules(spark, sf).collect(), labels, "quality", 0.3) > 0.98
