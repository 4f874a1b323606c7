import random
import zlib

import numpy as np
import pytest

from trafficbrick.llm import language_id as lid

SCHEMA = "lang_pred string, doc_id long, text string, lang string, score long"


def layout(texts, size):
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offs = np.r_[0, np.cumsum([len(t) for t in texts])]
    start, length, text = lid.cut_blocks(offs, size)
    return lid.lay_out(data, start, length, text), (start, length, text), data


def small_network(langs=3, hidden=5):
    rnd = np.random.default_rng(langs)
    shapes = [w.shape for w in lid.fresh_network(["a", "b", "c"][:langs], hidden).weights()]
    return lid.Network(["a", "b", "c"][:langs], *[rnd.normal(0, 0.6, s) for s in shapes])


def plain_probabilities(net, block):
    """The network byte by byte, with plain loops."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    states = []
    for side in (0, 1):
        h, out = np.zeros(net.bias.shape[1]), {}
        for t in range(len(block)) if side == 0 else reversed(range(len(block))):
            x = block[t]
            z = sig(net.table[side, 0, x] + h @ net.state[side, 0])
            r = sig(net.table[side, 1, x] + h @ net.state[side, 1])
            c = np.tanh(net.table[side, 2, x] + r * (h @ net.state[side, 2] + net.bias[side]))
            h = (1 - z) * c + z * h
            out[t] = h
        states.append(out)
    rows = []
    for t in range(len(block)):
        y = states[0][t] @ net.out[0] + states[1][t] @ net.out[1] + net.prior
        rows.append(np.exp(y - y.max()) / np.exp(y - y.max()).sum())
    return np.array(rows)


TEXTS = [b"hello w", "é1b".encode(), b"x", b"abcabcabca", b"", b"12 !"]


def test_positions_match_plain_loops():
    net = small_network()
    blocks, (start, length, text), data = layout(TEXTS, 6)
    p, _ = lid.probabilities(net, blocks)
    mass, labelled = lid.Reader(lid.Network(net.langs, *[w.astype(np.float32) for w in net.weights()])).label(blocks)
    for n, (s, m) in enumerate(zip(start, length)):
        block = data[s:s + m]
        want = plain_probabilities(net, block)
        assert np.abs(p[:m, n] - want).max() < 1e-5
        letter = lid._LETTER[block]
        assert np.abs(mass[:, n] - want[letter].sum(axis=0)).max() < 1e-4
        assert labelled[:, n].tolist() == np.bincount(want[letter].argmax(axis=1), minlength=3).tolist()


def test_backpropagation_matches_differences():
    net, lang = small_network(), np.array([0, 1, 2, 1, 0, 2])
    blocks, _, data = layout(TEXTS, 6)
    _, grads = lid.gradients(net, blocks, lang)
    rnd = np.random.default_rng(1)
    for k, w in enumerate(net.weights()):
        for _ in range(30):
            at = tuple(rnd.integers(0, s) for s in w.shape)
            if k == 0:
                at = (*at[:2], int(rnd.choice(data)), at[3])
            loss = []
            for step in (1e-3, -1e-3):
                moved = [x.copy() for x in net.weights()]
                moved[k][at] += step
                loss.append(lid.gradients(lid.Network(net.langs, *moved), blocks, lang)[0])
            assert abs((loss[0] - loss[1]) / 2e-3 - grads[k][at]) < 2e-4


def test_odd_texts(spark, table):
    net = lid.fresh_network(["aa", "bb"])
    texts = [None, "", " 12 .,!", "١٢٣", "word", "日本", "é" * 5000, "x\n" * 3000, "word"]
    rows = [("p", i if i != 5 else None, t, None, 9) for i, t in enumerate(texts)]
    got = lid.identify(table(rows, SCHEMA), net).collect()
    by = {r.rest.doc_id: r for r in got}
    assert len(got) == len(texts) and all(r.rest.lang_pred == "p" and r.rest.score == 9 for r in got)
    assert [by[i].lang_pred for i in range(4)] == ["und"] * 4 and all(by[i].score == 0 for i in range(4))
    assert all(by[i].lang_pred in ("aa", "bb") and 0.5 <= by[i].score <= 1 for i in (4, None, 6, 7, 8))
    assert by[4].probs == by[8].probs and sum(by[6].labelled) == 10000
    assert lid.identify(spark.createDataFrame([], SCHEMA), net).count() == 0
    assert {r.lang_pred for r in lid.identify(table(rows, SCHEMA), lid.fresh_network([])).collect()} == {"und"}
    assert {r.lang_pred for r in lid.identify(table(rows, SCHEMA), lid.fresh_network(["aa"])).collect()} == {"und", "aa"}


def test_training_sample_and_result(spark, table):
    rnd = random.Random(3)
    words = {"xx": ["ha", "li", "mo"], "yy": ["krz", "ptk", "szt"]}
    make = lambda lang, n: " ".join("".join(rnd.choices(words[lang], k=3)) for _ in range(n))
    rows = [("", i, make("xx" if i % 2 else "yy", 20), "xx" if i % 2 else "yy", 0) for i in range(400)]
    rows += [("", None, "a", "zz", 0), ("", 5000, None, "zz", 0), ("", 5001, "", "zz", 0), ("", 5003, "a b", None, 0)]
    rows += [("", 5002, make("xx", 4), "xx", 0)] * 50
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows += [("", held[0], "held out", "ww", 0)]
    docs = table(rows, SCHEMA)
    sample = lid.training_pieces(docs, rows=40, pieces=2).collect()
    assert {r.lang for r in sample} == {"xx", "yy"} and all(len(r.piece) <= lid.BLOCK for r in sample)
    assert max(sum(r.lang == k for r in sample) for k in ("xx", "yy")) <= 80
    net = lid.train_network(docs, rows=100, pieces=2, rounds=3, batch=8)
    got = {r.rest.doc_id: r.lang_pred for r in lid.identify(docs.where("doc_id < 400 AND lang <> 'ww'"), net).collect()}
    assert all(got[i] == ("xx" if i % 2 else "yy") for i in held)
    assert lid.train_network(docs.where("lang = 'ww'")).langs == []


def test_query_on_the_table(spark, sf_small):
    """Held-out accuracy on documents of more than a few words; the same rows again from a second training."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    out = lid.op12_language_id(spark, sf_small)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(docs)
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 for k, r in got.items())
    tested = [k for k, r in got.items() if r.held_out and len(docs[k].text or "") > 40]
    assert sum(got[k].lang_pred == docs[k].lang for k in tested) >= 0.9 * len(tested) and len(tested) > 20
