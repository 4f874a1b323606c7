"""Seeded table hash and strata: golden addresses (seed 134, reserved 7)."""

import numpy as np
import pytest

from trafficbrick.functions.parity import libc_rand, parity_tables
from trafficbrick.operators.binning import assign_bins
from trafficbrick.sources.strata import read_strata, read_strata_lines, reserved_bins

# Address, hash17, sub-bucket, final bin.
GOLDEN = [
    (167772161, 50494, 98, 35),
    (3232235786, 4629, 9, 67),
    (134744072, 34318, 67, 79),
    (285212673, 123007, 240, 3),
    (285343753, 98756, 192, 4),
    (3627735137, 9772, 19, 2),
    (1089011969, 8217, 16, 98),
    (1089057837, 80588, 157, 1),
    (2899902498, 116202, 226, 0),
    (520964617, 36800, 71, 5),
    (379481093, 50836, 99, 6),
    (4294967295, 29895, 58, 77),
]


PINNED = [(ip, b) for ip, _, _, b in GOLDEN if b < 7]


def strata_text():
    """Every pinned address first with another bin, then with its golden one."""
    return "".join(f"{ip} {(b + 1) % 7}\n" for ip, b in PINNED) + "".join(f"{ip} {b}\n" for ip, b in PINNED)


def test_rand_stream_heads():
    t = parity_tables(134, 7)
    assert (t.t1[0], t.t2[0], t.t3[0], t.t3[65536]) == (64167, 86354, 101072, 1297)
    assert list(t.bin_map[:4]) == [59, 67, 14, 23]
    assert libc_rand(1, 3).tolist() == [1804289383, 846930886, 1681692777]


def test_golden_numpy():
    t = parity_tables(134, 7)
    ips = np.array([g[0] for g in GOLDEN])
    h = t.hash17(ips)
    assert h.tolist() == [g[1] for g in GOLDEN]
    assert (h >> 9).tolist() == [g[2] for g in GOLDEN]


@pytest.fixture()
def strata_file(tmp_path):
    p = tmp_path / "strata.txt"
    p.write_text(strata_text())
    return str(p)


def test_strata_last_wins(spark, strata_file):
    s = {r.prefix17: r.bin for r in read_strata(spark, strata_file).collect()}
    assert s == {ip >> 15: b for ip, b in PINNED}
    assert reserved_bins(read_strata_lines(spark, strata_file)) == 7


def test_golden_spark(spark, strata_file):
    strata = read_strata(spark, strata_file)
    reserved = reserved_bins(read_strata_lines(spark, strata_file))
    t = parity_tables(134, reserved)
    df = spark.createDataFrame([(g[0], g[0]) for g in GOLDEN], "src_ip bigint, dst_ip bigint")
    got = {r.src_ip: r for r in assign_bins(df, strata, reserved, parity=t).collect()}
    for ip, h, sub, b in GOLDEN:
        r = got[ip]
        assert (r.src_hash, r.sub, r.src_bin, r.dst_bin) == (h, sub, b, b), ip
        assert r.cell == b * 128 + b
