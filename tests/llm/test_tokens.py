import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from trafficbrick.llm import packing as P
from trafficbrick.llm.runs import parts, pretokens
from trafficbrick.llm.token_counts import Merges, count_tokens, op3_token_counts, tokenizer_path

SCHEMA = "n_tokens int, doc_id long, text string"


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def texts():
    rnd = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "'", "'s", "'re", "'ve", "'ll", "'d", "'m", "'t", "''", "'S",
            "a", "re", "word", "Ünï", "日本語", "42", "٣", "½", "!", "...", "$", "🙂", "é", "<|endoftext|>", "<|endof",
            "\x1c", "\x85", "​", "ǅ", "_", "x" * 40]
    made = ["".join(rnd.choices(bits, k=rnd.randrange(1, 30))) for _ in range(400)]
    return made + [None, "", " ", "  ", "'s", " 's", "\n's", "a'", "a'r", "a'rest", "<|endoftext|>", "a <|endoftext|> b",
                   "text|>", "x" * 5000, "word " * 3000, "'ve'" * 50, "a\n\n b", "a \n"]


def test_pretokens_match_the_library(tok):
    from tokenizers import pre_tokenizers
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    rows = [t.replace("<|endoftext|>", "") for t in texts() if t]
    for part in parts(pa.array(rows), limit=1 << 20):
        start, special = pretokens(part, "<|endoftext|>")
        assert not special.any()
        got = np.searchsorted(start, part.offsets)
        for r, t in enumerate(rows):
            mine = (start[got[r]:got[r + 1]] - part.offsets[r]).tolist()
            assert mine == [a for _, (a, _) in split.pre_tokenize_str(t)], repr(t)


def test_long_texts_are_cut_without_effect(path):
    t = " ".join(f"word{i} a's\n\n" for i in range(3000))
    whole, cut = (list(parts(pa.array([t, "b"]), limit=n)) for n in (1 << 20, 1000))
    assert len(whole) == 1 and len(cut) > 5
    words = lambda ps: [p.text[a:b] for p in ps for s in [pretokens(p, "")[0]] for a, b in zip(s, [*s[1:], len(p.text)])]
    assert words(whole) == words(cut)


def test_heap_merging_gives_the_library_s_counts(spark, table, tok, path):
    rows = [(1, k, t) for k, t in enumerate(texts())] + [(1, None, "a b"), (1, 3, "a b")]
    got = count_tokens(table(rows, SCHEMA), path, limit=20).collect()
    want = []
    for _, k, t in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((k, len((t or "").encode()), n, n > 20))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert Merges(path).count(b"") == 0
    assert count_tokens(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_counts_of_the_table(spark, sf_small, tok):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    for r in op3_token_counts(spark, sf_small).collect():
        n = len(tok.encode(rows[r.doc_id].text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(rows[r.doc_id].text.encode()), n > 1024)


def check_packing(rows, want_ids, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want_ids)
    for k, pieces in by_doc.items():
        ids, at = want_ids[k], 0
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        for r in pieces:
            assert r.start == at and 0 < r.length <= capacity
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
        assert all(r.length == capacity for r in pieces[1:]) and (len(ids) > capacity or len(pieces) == 1)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_pieces_and_places(spark, table, tok, path):
    rows = [(1, k, t) for k, t in enumerate(texts())]
    want = {k: tok.encode(t or "", add_special_tokens=False).ids + [0] for _, k, t in rows}
    n = check_packing(P.pack_documents(table(rows, SCHEMA), path, capacity=64).collect(), want, 64)
    total = sum(map(len, want.values()))
    assert n <= -(-total // 64) + 2
    assert P.pack_documents(spark.createDataFrame([], SCHEMA), path).count() == 0
    twice = P.pack_documents(table([(1, None, "a b"), (1, 2, "c"), (1, 2, "c")], SCHEMA), path).collect()
    assert len(twice) == 3 and len({(r.sequence_id, r.offset) for r in twice}) == 3


def test_query_on_the_table(spark, sf_small, tok):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    want = {r.doc_id: tok.encode(r.text, add_special_tokens=False).ids + [0] for r in docs}
    n = check_packing(P.op9_best_fit_packing(spark, sf_small).collect(), want, 2048)
    assert n <= -(-sum(map(len, want.values())) // 2048) + 3


def fewest(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1:])
        go(i + 1, bins + [items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimal_packing():
    rnd = random.Random(3)
    reduced = 0
    for _ in range(300):
        capacity = rnd.choice([10, 15, 20])
        items = [rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(1, 10))]
        have = np.bincount(items, minlength=capacity + 1)
        fixed = P.reduce_by_dominance(have, capacity)
        rest = np.repeat(np.arange(capacity + 1), have).tolist()
        assert sum(s.many for s in fixed) + fewest(rest, capacity) == fewest(items, capacity)
        reduced += len(items) - len(rest)
        slots = P.plan(dict(zip(*np.unique(items, return_counts=True))), capacity)
        assert slots[:, 2].sum() == len(items)
    assert reduced > 500


