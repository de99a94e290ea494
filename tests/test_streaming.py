from functools import reduce

from hypothesis import given
from hypothesis import strategies as st

from assayer.streaming.timestamps import EMPTY, CoherenceFold, merge_folds, start_coherence


def fold(times, threshold=1.0):
    one = lambda t: {**EMPTY, "packet_count": 1, "first_timestamp": t, "last_timestamp": t}
    return reduce(lambda a, b: merge_folds(a, b, threshold), map(one, times), dict(EMPTY))


@given(st.lists(st.integers(0, 20).map(float), max_size=20), st.lists(st.integers(0, 20).map(float), max_size=20))
def test_folds_merge_anywhere(a, b):
    assert merge_folds(fold(a), fold(b), 1.0) == fold(a + b)


def test_stream_equals_batch(spark, tmp_path):
    schema = "packet_index long, ts double"
    times = [10.0, 10.0, 12.5, 11.0, 13.0, 13.0, 20.0]
    source = tmp_path / "in"
    stream = CoherenceFold(str(tmp_path / "fold.json"))
    for k, part in enumerate((times[:3], times[3:4], times[4:])):
        at = sum(map(len, (times[:3], times[3:4])[:k]))
        spark.createDataFrame([(at + i, t) for i, t in enumerate(part)], schema).coalesce(1).write.mode("append").parquet(str(source))
        packets = spark.readStream.schema(schema).parquet(str(source))
        start_coherence(packets, stream, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination(60)
    got = stream.result()
    assert (got["packet_count"], got["backwards_jump_count"], got["zero_delta_count"], got["large_gap_count"], got["gap_count"]) == (7, 1, 2, 3, 5)
    assert stream.state()["fold"] == fold(times)
    stream.add(spark.createDataFrame([(9, 1.0)], schema), 0)
    assert stream.state()["fold"]["packet_count"] == 7


def write_capture(path, times):
    import struct

    data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 101) + b"".join(struct.pack("<IIII", t, 0, 4, 4) + b"none" for t in times)
    path.with_suffix(".part").write_bytes(data)
    path.with_suffix(".part").rename(path)


def test_capture_folder_stream(spark, tmp_path):
    """Files are taken as they appear, also one whose name sorts before those seen; several of a batch follow each other by name."""
    from assayer.sources.pcap import PcapSource

    spark.dataSource.register(PcapSource)
    folder = tmp_path / "in"
    folder.mkdir()
    stream = CoherenceFold(str(tmp_path / "fold.json"))

    def run():
        packets = spark.readStream.format("pcap").load(str(folder))
        query = start_coherence(packets, stream, str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()

    write_capture(folder / "cap8.pcap", [0, 1])
    write_capture(folder / "cap9.pcap", [2, 2])
    run()
    assert stream.state()["fold"] == fold([0.0, 1.0, 2.0, 2.0])
    write_capture(folder / "cap10.pcap", [5, 4])
    run()
    assert stream.state()["fold"] == fold([0.0, 1.0, 2.0, 2.0, 5.0, 4.0])
    run()
    assert stream.result()["packet_count"] == 6 and stream.result()["backwards_jump_count"] == 1
