import re
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as C  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def one_of_each(texts):
    """Ids that are the smallest of their near-duplicate group."""
    sets = {k: shingles(t) for k, t in texts.items()}
    label = {k: k for k in texts}
    pairs = [(a, b) for a in texts for b in texts if a < b and (
        texts[a] == texts[b] or sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return {k for k in texts if label[k] == k}


def cut(texts, size=50):
    ws = {k: words(t) for k, t in texts.items()}
    out = {}
    for k, w in ws.items():
        earlier = {tuple(v[i:i + size]) for j, v in ws.items() if j < k for i in range(len(v) - size + 1)}
        gone = {p for i in range(len(w) - size + 1) if tuple(w[i:i + size]) in earlier for p in range(i, i + size)}
        out[k] = " ".join(x for p, x in enumerate(w) if p not in gone)
    return out


def test_stages_follow_each_other_and_their_brute_force(spark, sf_small):
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality", "near_duplicates", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    seen = docs
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, seen, sf_small)
        assert out.columns == docs.columns
        rows = out.collect()
        seen = spark.createDataFrame(rows, docs.schema).repartition(3)
        now = {r.doc_id: r.text for r in rows}
        assert len(now) == len(rows)
        if name in ("toxicity", "quality"):
            assert all(now[k] == texts[k] for k in now)
            good = [k for k in texts if k in labels and (not labels[k].toxic if name == "toxicity" else labels[k].quality)]
            assert np.mean([k in now for k in good]) > 0.95
        elif name == "near_duplicates":
            assert set(now) == one_of_each(texts) and all(now[k] == texts[k] for k in now)
        else:
            assert now == cut(texts) and all(r.n_chars == len(r.text) for r in rows)
        texts = now
    packed = C.STAGES[-1][1](spark, seen, sf_small).collect()
    assert {r.doc_id for r in packed} == set(texts)
    assert max(r.offset + r.length for r in packed) <= 2048


def test_odd_rows_pass_every_stage(spark, sf_small, tmp_path):
    long = " ".join(f"plain{i % 97}word" for i in range(400))
    rows = [(1, long, "en", None, 1), (1, long, "en", None, 1), (2, None, None, None, None), (3, "", "en", "s", 0),
            (None, long, "en", "s", 1), (None, "only here and nowhere else", "en", "s", 1), (4, long + " end", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", score string")
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf_small)
        kept = out.collect()
        if name == "near_duplicates":
            assert sorted((r.doc_id, r.text or "") for r in kept if r.doc_id is not None) == [(1, long), (2, "")]
            assert [r.text for r in kept if r.doc_id is None] == ["only here and nowhere else"]
        if name != "packing":
            assert out.columns == docs.columns
        assert stage(spark, empty, sf_small).count() == 0


def test_one_text_of_each_group_stays(spark, sf_small):
    """Several texts of one id: each is kept or dropped as a text."""
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(1, x), (1, y), (1, y), (2, x + " more"), (3, y + " more"), (3, "quite another text of this id"), (None, y), (None, "alone"),
            (None, "alone"), (4, None), (4, ""), (5, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.text or "") for r in dict(C.STAGES)["near_duplicates"](spark, docs, sf_small).collect()), key=str)
    assert got == sorted([(1, x), (1, y), (3, "quite another text of this id"), (None, "alone"), (4, "")], key=str)


def test_run_gives_the_last_stage(spark, sf_small):
    out = C.run(spark, sf_small)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 50
