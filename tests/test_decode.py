"""Frame decoding on hand-built frames."""

from trafficbrick.operators.decode import decode_frames, ipv4_only, truncate_frames

MACS = "AABBCCDDEEFF112233445566"
IP = "45000028000100004006000" + "00A00000108080808"  # IHL 5, TCP, 10.0.0.1 -> 8.8.8.8
PORTS = "C3500050"  # 50000 -> 80

# Frames (hex) and the packet each must decode to
# (eth_type, vlan, proto, src, dst, sport, dport).
CASES = {
    "untagged": (MACS + "0800" + IP + PORTS, (2048, 0, 6, 167772161, 134744072, 50000, 80)),
    "tagged": (MACS + "81000064" + "0800" + IP + PORTS, (2048, 100, 6, 167772161, 134744072, 50000, 80)),
    "ipv6": (MACS + "86DD" + "6" + "0" * 79, (34525, 0, None, None, None, 0, 0)),
    "icmp": (MACS + "0800" + "450000280001000040010000" + "0A00000108080808" + "08000000", (2048, 0, 1, 167772161, 134744072, 0, 0)),
    "ihl6": (MACS + "0800" + "4600002C0001000040110000" + "0A00000108080808" + "00000000" + "00350035",
             (2048, 0, 17, 167772161, 134744072, 53, 53)),
    "fragment": (MACS + "0800" + "450000280001" + "00B9" + "40060000" + "0A00000108080808" + PORTS,
                 (2048, 0, 6, 167772161, 134744072, 0, 0)),
    "truncated": (MACS + "0800" + "4500002800010000", (2048, 0, None, None, None, 0, 0)),
}


def _frames(spark):
    import datetime as dt
    rows = [(dt.datetime(2024, 1, 1), k, "t", i, len(h) // 2, 64, bytes.fromhex(h)) for i, (k, (h, _)) in enumerate(CASES.items())]
    return spark.createDataFrame(rows, "ts timestamp_ntz, device string, file string, seq bigint, cap_len int, "
                                       "wire_len int, frame binary")


def test_decode_cases(spark):
    got = {r.device: r for r in decode_frames(_frames(spark)).collect()}
    for name, (_, want) in CASES.items():
        r = got[name]
        assert (r.eth_type, r.vlan_id, r.ip_proto, r.src_ip, r.dst_ip, r.sport, r.dport) == want, name


def test_ipv4_only_keeps_decodable(spark):
    kept = {r.device for r in ipv4_only(decode_frames(_frames(spark))).collect()}
    assert kept == {"untagged", "tagged", "icmp", "ihl6", "fragment"}


def test_truncate(spark):
    t = {r.device: r for r in truncate_frames(_frames(spark), 20).collect()}
    assert len(t["tagged"].frame) == 20 and t["tagged"].cap_len == 20 and t["tagged"].wire_len == 64
    assert t["truncated"].cap_len == 20
