import struct

import pytest
from pyspark.sql import functions as F

from assayer.sources.pcap import COLUMNS, OPENING, TASK, _batches, _sizes, _tasks, addresses, capture_files, ranges, read_packets, read_pcap
from assayer.sources.tabular import distinct_names, read_tabular


def test_header_names():
    assert distinct_names([" A", "B ", " A", "A ", ""]) == ["A", "B", "A.1", "A.2", "Unnamed: 4"]


def test_delimited(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('x/y , "q, r",x/y\n 1,"a ""b""",NA\n2, null,3\n4\n')
    df = read_tabular(spark, str(path), row_index=True)
    assert df.columns == ["x/y", "q, r", "x/y.1", "row_index"] or df.columns == ["row_index", "x/y", "q, r", "x/y.1"] or set(df.columns) == {"x/y", "q, r", "x/y.1", "row_index"}
    rows = sorted(map(lambda r: r.asDict(), df.collect()), key=lambda r: r["row_index"])
    assert [r["row_index"] for r in rows] == [0, 1, 2]
    assert rows[0]["x/y"] == "1" and rows[0]["q, r"] == 'a "b"' and rows[0]["x/y.1"] is None
    assert rows[1]["q, r"] is None and rows[1]["x/y.1"] == "3" and rows[2]["x/y"] == "4"


def test_row_numbers_follow_the_file_over_many_partitions(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("v\n" + "\n".join(f"{i:09d}" for i in range(20000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_tabular(spark, str(path), row_index=True)
        assert df.rdd.getNumPartitions() > 1
        assert df.filter("cast(v as long) <> row_index").count() == 0 and df.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name, sep", [("m.csv", ","), ("m.tsv", "\t")])
def test_newlines_in_quoted_cells(spark, tmp_path, name, sep):
    path = tmp_path / name
    path.write_text(sep.join(["a", "b"]) + f'\n1{sep}"x\ny, ""z"""\n2{sep}it"s\n"3"{sep}"\n"\n4{sep}last\n')
    rows = sorted(read_tabular(spark, str(path), True).select("row_index", "a", "b").collect())
    assert [tuple(r) for r in rows] == [(0, "1", 'x\ny, "z"'), (1, "2", 'it"s'), (2, "3", "\n"), (3, "4", "last")]


def test_surplus_cells_fail(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("a,b\n1,2\n3\n4,5,\n")
    assert [(r["a"], r["b"]) for r in read_tabular(spark, str(path)).collect()] == [("1", "2"), ("3", None), ("4", "5")]
    path.write_text("a,b\n1,2\n3,4,five\n")
    for row_index in (False, True):
        with pytest.raises(Exception, match="more than 2 cells.*five"):
            read_tabular(spark, str(path), row_index).select("a").collect()


def test_rows_of_folders_are_numbered_by_file(spark, tmp_path):
    """Files of unlike sizes, which Spark reads largest first, in several splits."""
    folder = tmp_path / "f.csv"
    folder.mkdir()
    at = 0
    for name, n in (("a.csv", 10), ("b.csv", 3000), ("c.csv", 0), ("d.csv", 500)):
        (folder / name).write_text("v\n" + "".join(f"{at + i:09d}\n" for i in range(n)))
        at += n
    spark.range(0, 3000, 1, 4).write.parquet(str(tmp_path / "p.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert read_tabular(spark, str(folder), True).filter("cast(v as long) <> row_index").count() == 0 and read_tabular(spark, str(folder), True).count() == at
        df = read_tabular(spark, str(tmp_path / "p.parquet"), True)
        assert df.filter("id <> row_index").count() == 0 and df.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sheets(spark, tmp_path, monkeypatch):
    """The first sheet as text; the optional reader is stood in for, and its absence is a ValueError."""
    import pandas as pd

    def absent(*a, **k):
        raise ImportError("no reader")

    monkeypatch.setattr(pd, "read_excel", lambda path, **k: pd.DataFrame([[" a ", "b", None], [1, "x", None], [None, "NA", 2.5]], dtype=object))
    df = read_tabular(spark, str(tmp_path / "s.xlsx"), True)
    assert [tuple(r) for r in df.select("row_index", "a", "b", "`Unnamed: 2`").collect()] == [(0, "1", "x", None), (1, None, None, "2.5")]
    monkeypatch.setattr(pd, "read_excel", absent)
    with pytest.raises(ValueError, match="optional package"):
        read_tabular(spark, str(tmp_path / "s.xls"))


def test_other_formats(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n")
    assert read_tabular(spark, str(tmp_path / "t.tsv")).first().asDict() == {"a": "1", "b": "2"}
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    assert read_tabular(spark, str(tmp_path / "p.parquet"), True).columns == ["id", "row_index"]
    with pytest.raises(ValueError):
        read_tabular(spark, str(tmp_path / "x.json"))
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        read_tabular(spark, str(tmp_path / "e.csv"))


V4 = struct.pack(">BBHHHBBH", 0x45, 0, 20, 0, 0, 64, 17, 0) + bytes([10, 0, 0, 1, 8, 8, 4, 4])
V6 = b"\x60\0\0\0\0\0\x3b\x40" + bytes(15) + b"\x01" + bytes(15) + b"\x02"


def ether(kind, payload, vlan=False):
    return bytes(12) + (b"\x81\x00\x00\x01" if vlan else b"") + struct.pack(">H", kind) + payload


def capture(order="<", magic=0xA1B2C3D4, link=1, packets=()):
    out = struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for sec, frac, data in packets:
        out += struct.pack(f"{order}IIII", sec, frac, len(data), len(data)) + data
    return out


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("magic, frac", [(0xA1B2C3D4, 500_000), (0xA1B23C4D, 500_000_000)])
def test_pcap(tmp_path, order, magic, frac):
    path = tmp_path / "c.pcap"
    path.write_bytes(capture(order, magic, packets=[(1, frac, ether(0x0800, V4)), (2, 0, ether(0x86DD, V6, vlan=True)), (3, 0, ether(0x0806, b"arp")), (4, 0, b"")]))
    got = list(read_packets(str(path)))
    assert [(p[0], p[1]) for p in got] == [(0, 1.5), (1, 2.0), (2, 3.0), (3, 4.0)]
    assert got[0][3:] == (4, "10.0.0.1", "8.8.4.4") and got[1][3:] == (6, "::1", "::2") and got[2][3:] == (None, None, None) and got[3][2] == 0


def test_link_types_and_nesting():
    assert addresses(101, V4)[0] == 4 and addresses(101, V6)[0] == 6 and addresses(113, bytes(14) + b"\x08\x00" + V4)[0] == 4
    assert addresses(0, b"\x02\0\0\0" + V4)[1] == "10.0.0.1"
    assert addresses(101, V6[:6] + b"\x04" + V6[7:] + V4) == (4, "10.0.0.1", "8.8.4.4")
    assert addresses(101, b"") == (None, None, None) and addresses(999, V4) == (None, None, None)


def test_broken_captures(tmp_path):
    path = tmp_path / "c.pcap"
    whole = capture(packets=[(1, 0, ether(0x0800, V4))])
    for data in (b"", b"abc", b"nonsense of some length", whole[:-3], whole[:30]):
        path.write_bytes(data)
        with pytest.raises(ValueError):
            list(read_packets(str(path)))
    path.write_bytes(capture())
    assert list(read_packets(str(path))) == []


def test_pcapng(tmp_path):
    def block(kind, body):
        body += bytes(-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    frame = ether(0x0800, V4)
    head = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    packet = block(6, struct.pack("<IIIII", 0, 0, 2_500_000, len(frame), len(frame)) + frame)
    path = tmp_path / "c.pcapng"
    path.write_bytes(head + packet)
    assert list(read_packets(str(path))) == [(0, 2.5, len(frame), 4, "10.0.0.1", "8.8.4.4")]


def test_old_packet_blocks_and_bad_interfaces(tmp_path):
    def block(kind, body):
        body += bytes(-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    frame = ether(0x0800, V4)
    head = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    old = block(2, struct.pack("<HHIIII", 0, 7, 0, 1_500_000, len(frame), 99) + frame)
    simple = block(3, struct.pack("<I", len(frame)) + frame)
    path = tmp_path / "c.pcapng"
    path.write_bytes(head + old + simple)
    assert list(read_packets(str(path))) == [(0, 1.5, 99, 4, "10.0.0.1", "8.8.4.4"), (1, 0.0, len(frame), 4, "10.0.0.1", "8.8.4.4")]
    for bad in (block(6, struct.pack("<IIIII", 3, 0, 0, 0, 0)), block(6, struct.pack("<IIIII", 0, 0, 0, 500, 500)), block(2, b"")[:8]):
        path.write_bytes(head + bad)
        with pytest.raises(ValueError):
            list(read_packets(str(path)))


def mixed_captures(folder):
    """A pcap of each byte order, an empty one, and a pcapng whose interfaces change between packets."""
    def block(kind, body):
        body += bytes(-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    frame = ether(0x0800, V4)
    folder.mkdir()
    (folder / "a.pcap").write_bytes(capture(packets=[(k, 0, frame) for k in range(50)]))
    (folder / "b.pcap").write_bytes(capture(">", packets=[(100 + k, 0, ether(0x0806, b"arp")) for k in range(30)]))
    (folder / "c.pcap").write_bytes(capture())
    section = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    micro, milli = block(1, struct.pack("<HHI", 1, 0, 0)), block(1, struct.pack("<HHI", 101, 0, 0) + struct.pack("<HHBxxxHH", 9, 1, 3, 0, 0))
    packet = lambda port, t, data: block(6, struct.pack("<IIIII", port, 0, t, len(data), len(data)) + data)
    blocks = [section, micro, *[packet(0, k * 1_000_000, frame) for k in range(200, 210)], milli, *[packet(1, k * 1000, V6) for k in range(210, 230)], section, milli, *[packet(0, k * 1000, V6) for k in range(230, 240)]]
    (folder / "d.pcapng").write_bytes(b"".join(blocks))
    (folder / "notes.txt").write_text("no capture")


@pytest.mark.parametrize("size", [1, 100, 1000, 1 << 26])
def test_ranges_give_what_whole_files_give(spark, tmp_path, size):
    folder = tmp_path / "in"
    mixed_captures(folder)
    want = [p for name in ("a.pcap", "b.pcap", "c.pcap", "d.pcapng") for p in read_packets(str(folder / name))]
    df = read_pcap(spark, str(folder), range_bytes=size)
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(k, *p[1:]) for k, p in enumerate(want)] and len(got) == 120
    assert [r["ts"] for r in read_pcap(spark, f"file://{folder}", ("packet_index", "ts"), size).orderBy("packet_index").collect()] == [float(t) for t in (*range(50), *range(100, 130), *range(200, 240))]


def test_small_files_and_ranges_share_tasks(spark, tmp_path):
    """300 small captures in 3,000 ranges: a few tasks, numbered and in the order of the files."""
    for k in range(300):
        (tmp_path / f"{k:03d}.pcap").write_bytes(capture(packets=[(10 * k + j, 0, ether(0x0800, V4)) for j in range(10)]))
    df = read_pcap(spark, str(tmp_path), ("file", "packet_index", "ts"), 1)
    tasks = df.withColumn("task", F.spark_partition_id())
    assert df.rdd.getNumPartitions() <= 8 and tasks.select("task").distinct().count() >= 4
    assert [tuple(r) for r in df.collect()] == [(f"{tmp_path}/{k // 10:03d}.pcap", k, float(k)) for k in range(3000)]


def test_tasks_by_bytes():
    assert _tasks(list("abcd"), [TASK, 5 * TASK, 0, 1], 2) == [0, 1, 2, 2]
    assert _tasks(["a"] * 5, [TASK // 2] * 5, 1) == [0, 0, 1, 1, 2]
    assert _tasks(["a"] * 8, [8 * OPENING] * 8, 4) == [0, 0, 1, 1, 2, 2, 3, 3] and _tasks(["a"], [0], 12) == [0]
    assert len(set(_tasks([str(k) for k in range(10_000)], [0] * 10_000, 1))) == -(-10_000 * OPENING // TASK)


def test_batches_cross_ranges_and_files(tmp_path, monkeypatch):
    mixed_captures(tmp_path / "in")
    want, parts = [], []
    for name in ("a.pcap", "b.pcap", "c.pcap", "d.pcapng"):
        path = str(tmp_path / "in" / name)
        parts += [(path, start, stop, len(want) + first, state) for _, start, stop, first, _, state in ranges(path, 100)]
        want += [(path, len(want) + k, *p[1:]) for k, p in enumerate(read_packets(path))]
    monkeypatch.setattr("assayer.sources.pcap.BATCH", 7)
    found = list(_batches(parts, COLUMNS))
    assert [r for b in found for r in zip(*[b[c] for c in COLUMNS])] == want
    assert [len(b["ts"]) for b in found] == [7] * 17 + [1] and set(next(_batches(parts, ("ts",)))) == {"ts"}


def test_sizes_of_files_in_stores(tmp_path, monkeypatch):
    from pyarrow import fs

    for k in range(3):
        (tmp_path / f"{k}.pcap").write_bytes(bytes(k))
    local = _sizes(str(tmp_path), capture_files(str(tmp_path)))
    monkeypatch.setattr("assayer.sources.pcap._remote", lambda path: (fs.LocalFileSystem(), path.removeprefix("store://")))
    folder = f"store://{tmp_path}"
    assert local == _sizes(folder, capture_files(folder)) == [0, 1, 2] and _sizes(f"{folder}/2.pcap", capture_files(f"{folder}/2.pcap")) == [2]


def test_damaged_captures_raise_before_reading(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture(packets=[(1, 0, b"x" * 40)])[:-1])
    with pytest.raises(Exception, match="cut short"):
        read_pcap(spark, str(tmp_path))
    (tmp_path / "none").mkdir()
    assert read_pcap(spark, str(tmp_path / "none")).count() == 0


def test_several_captures_are_one_sequence(spark, tmp_path):
    """0 to 3 s, then 100 to 103 s: no jump back, seven gaps that add up to 103 s."""
    from assayer.operators.timestamps import gap_facts

    for name, start in (("a", 0), ("b", 100)):
        (tmp_path / f"{name}.pcap").write_bytes(capture(packets=[(start + k, 0, b"x") for k in range(4)]))
    whole = gap_facts(read_pcap(spark, str(tmp_path), ("packet_index", "ts"))).first()
    by_file = gap_facts(spark.read.format("pcap").load(str(tmp_path)), ["file", "packet_index"], chunk=3).first()
    assert whole == by_file and (whole["backwards_jump_count"], whole["gap_count"], whole["gap_sum"], whole["large_gap_count"]) == (0, 7, 103.0, 1)


def test_pcap_source(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.pcap").write_bytes(capture(packets=[(1, 0, ether(0x0800, V4))] * 3))
    df = read_pcap(spark, str(tmp_path))
    assert df.count() == 6 and df.filter("src = '10.0.0.1' and ip_version = 4").count() == 6
