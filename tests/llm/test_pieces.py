import itertools
import random

import pytest

from trafficbrick.llm.pieces import BLANK, Model, decode, encode, op4_sentencepiece_nbest
from trafficbrick.llm.token_counts import tokenizer_path

SCHEMA = "ids string, doc_id long, text string"


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model(path):
    return Model(path)


def every(model, word):
    """All segmentations: (score, ids)."""
    def go(i):
        if i == len(word):
            yield 0.0, ()
            return
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in model.pieces:
                k, s = model.pieces[word[i:j]]
                for t, ids in go(j):
                    yield s + t, (k, *ids)
        if word[i] not in model.pieces:
            for t, ids in go(i + 1):
                yield model.unknown + t, tuple(model.bytes[b] for b in word[i].encode()) + ids
    return sorted(go(0), key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["hello", "the cat sat", " a  b", "naïve 日本𠮷", "x\ny\t", "\U0001F9FF", BLANK + "a", "aaaaaaa"])
@pytest.mark.parametrize("n", [1, 4, 9])
def test_nbest_matches_enumeration(model, text, n):
    whole = BLANK + text.replace(" ", BLANK)
    all_ = every(model, whole)
    ids, scores, changes = model.encode(text, n)
    assert scores == [s for s, _ in all_[:n]]
    assert tuple(ids) in {x for s, x in all_ if s == all_[0][0]}
    words = model.words(text)
    assert "".join(words) == whole
    score = {x: s for s, x in all_}
    seen = set()
    for s, change in zip(scores, changes):
        per = [model.nbest(w, n)[0][1] for w in words]
        for k, other in change:
            per[k] = other
        path = tuple(itertools.chain.from_iterable(per))
        assert score[path] == s and path not in seen
        seen.add(path)


def test_words_together_match_each_alone(model):
    """Words of many lengths, of rare characters and without pieces: ids, scores and losses to the last bit."""
    import numpy as np
    rnd = random.Random(6)
    words = {BLANK + "".join(rnd.choices("aeinrst日ж́é🙂\x07", weights=[9] * 7 + [1] * 6, k=rnd.randrange(1, 14))) for _ in range(600)}
    words = sorted(words | {BLANK, "x" * 200, "🙂", "\x07", BLANK * 20})
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    end = np.cumsum([len(w) for w in words])
    pool, size, score, loss = model.best_of_words(points, end - [len(w) for w in words], end)
    at = np.r_[0, np.cumsum(size)]
    for k, w in enumerate(words):
        assert (pool[at[k]:at[k + 1]].astype("<i4").tobytes(), score[k], loss[k]) == model.best(w), w


def test_decoding_is_the_library_s_and_the_round_trip(spark, table, path, model):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(1)
    texts = ["".join(rnd.choices([" ", "  ", "\n", "a", "the", "é", "日", "🙂", "\x00", "1,", "-", "ing"], k=rnd.randrange(40))) for _ in range(80)]
    texts += [None, "", " ", "word " * 4000, "x" * 3000]
    got = encode(table([("i", k, t) for k, t in enumerate(texts)], SCHEMA), path)
    rows = got.collect()
    back = {r.rest.doc_id: r.text for r in decode(got.select("rest.doc_id", got.ids.alias("ids"), "nbest_scores"), path).collect()}
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.rest.doc_id] or ""
        assert sp.decode(list(r.ids)) == back[r.rest.doc_id] == t
        assert r.nbest_scores == sorted(r.nbest_scores, reverse=True) and bool(r.ids) == bool(t)
        ids, scores, _ = model.encode(t, 4)
        assert (list(r.ids), list(r.nbest_scores)) == (ids, scores)
    assert encode(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_best_is_no_worse_than_the_library_s_own(model, path):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for t in ["the quick brown fox", "unbelievable segmentation", "Straße und Wörter"]:
        own = sum(model.pieces[sp.id_to_piece(i)][1] for i in sp.encode(t))
        assert model.encode(t, 1)[1][0] >= own


def test_query_on_the_table(spark, sf_small):
    rows = op4_sentencepiece_nbest(spark, sf_small).collect()
    assert len(rows) == spark.read.parquet(f"{sf_small}/documents.parquet").count()
    assert all(r.round_trip for r in rows) and any(len(r.nbest_scores) == 4 for r in rows)


def test_distributed_alternatives_match_enumeration(table, path, model):
    from pyspark.sql import functions as F
    from trafficbrick.llm.pieces import alternative
    texts = ["hello", "the cat sat", " a  b", "naïve 日本𠮷", "x\ny\t", "🧿", "aaaaaaa", "", None]
    got = encode(table([("i", k, t) for k, t in enumerate(texts)], SCHEMA), path, nbest=5)
    rows = got.select("rest.doc_id", "ids", "nbest_scores",
                      F.transform("changes", lambda c: alternative(F.col("ids"), c)).alias("paths")).collect()
    for r in rows:
        t = texts[r.doc_id]
        if not t:
            assert r.paths == [] and r.nbest_scores == []
            continue
        all_ = every(model, BLANK + t.replace(" ", BLANK))
        score = {x: s for s, x in all_}
        paths = [tuple(p) for p in r.paths]
        assert len(set(paths)) == len(paths) == min(5, len(all_)) and list(paths[0]) == r.ids
        assert [score[p] for p in paths] == pytest.approx([s for s, _ in all_[:5]]) == r.nbest_scores


def test_alternatives_of_long_texts_fall_in_place(table, path, model):
    from pyspark.sql import functions as F
    from trafficbrick.llm.pieces import alternative
    texts = ["word " * 70_000 + "unbelievable", "a b c", "the quick brown fox " * 20]
    got = encode(table([("i", k, t) for k, t in enumerate(texts)], SCHEMA), path)
    rows = got.select("rest.doc_id", "nbest_scores", F.transform("changes", lambda c: alternative(F.col("ids"), c)).alias("paths")).collect()
    price = dict(model.pieces.values())
    for r in rows:
        assert len({tuple(p) for p in r.paths}) == len(r.nbest_scores) == 4
        for p, s in zip(r.paths, r.nbest_scores):
            assert model.decode(p) == texts[r.doc_id] and sum(price[k] for k in p) == pytest.approx(s)


def test_query_hashes_every_segmentation(spark, sf_small):
    for r in op4_sentencepiece_nbest(spark, sf_small).collect():
        assert len(r.nbest_hashes) == len(r.nbest_scores) == len(set(r.nbest_hashes))
        assert r.nbest_hashes[:1] == [r.ids_hash][:len(r.nbest_hashes)]


def test_equals_put_the_best_path_first():
    m = object.__new__(Model)
    names = ["a", "b", "c", "ab", "bc", "ca", "abc", "bca", "aa", "aaa"]
    m.pieces = {p: (k, -1.0) for k, p in enumerate(names)}
    m.table = {p[:k]: None for p in names for k in range(1, len(p))} | m.pieces
    m.unknown, m.bytes, m.searched = -20.0, {}, {}
    for word in ("abc", "abcabc", "abcab", "aaaa", "aaaaaaa", "bcaabca", "cabcabca"):
        own = tuple(memoryview(m.best(word)[0]).cast("i"))
        for n in (2, 4, 9):
            found = m.nbest(word, n)
            assert found[0][1] == own and len({x for _, x in found}) == len(found)
            assert [s for s, _ in found] == [s for s, _ in every(m, word)[:n]]
