"""Packet captures: pcap files of both byte orders with micro- or nanoseconds, and pcapng.

:func:`read_pcap` reads a file, a folder or a glob in two passes. The first walks over the record headers
of each file and cuts it into ranges that start at a record; the second parses the ranges, only what the
wanted columns need. So one large capture is read by many tasks, and packets are numbered over all files,
in the order of the files' names. Small files and ranges share tasks, by their bytes. The data source ``pcap`` (batch and stream) reads a file a task.
"""

from __future__ import annotations

import glob
import ipaddress
import json
import os
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, groupby
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

CAPTURES = (".pcap", ".pcapng", ".cap")
SCHEMA = "file string, packet_index long, ts double, wire_len int, ip_version int, src string, dst string"
COLUMNS = tuple(c.split()[0] for c in SCHEMA.split(", "))
#: Bytes of a range, of one read, and packets of one batch.
RANGE, STRETCH, BATCH = 64 << 20, 4 << 20, 1 << 16
#: Bytes of files or ranges that share a task, and what opening a file counts for besides.
TASK, OPENING = 16 << 20, 64 << 10

# Capture file magics, link types and EtherTypes.
PCAP_MAGICS = {0xA1B2C3D4: 1e6, 0xA1B23C4D: 1e9}
PCAPNG_MAGIC, BYTE_ORDER_MAGIC = 0x0A0D0D0A, 0x1A2B3C4D
INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET = 1, 2, 3, 6
LINK_NULL, LINK_ETHERNET, LINK_RAW_OLD, LINK_RAW, LINK_LINUX_SLL, LINK_IPV4, LINK_IPV6, LINK_SLL2 = 0, 1, 12, 101, 113, 228, 229, 276
ETHER_IPV4, ETHER_IPV6, ETHER_VLANS = 0x0800, 0x86DD, (0x8100, 0x88A8, 0x9100)
IP_IN_IP, IPV6_EXTENSIONS = 4, (0, 43, 60)
# End of fixed values.


def _network_layer(link: int, data: bytes) -> tuple[int, int]:
    """Where the network layer starts and its EtherType; 0 if it is no IP."""
    if link == LINK_ETHERNET:
        at = 12
        while len(data) >= at + 2 and int.from_bytes(data[at : at + 2], "big") in ETHER_VLANS:
            at += 4
        return at + 2, int.from_bytes(data[at : at + 2], "big")
    if link == LINK_LINUX_SLL:
        return 16, int.from_bytes(data[14:16], "big")
    if link == LINK_SLL2:
        return 20, int.from_bytes(data[0:2], "big")
    at = {LINK_NULL: 4}.get(link, 0 if link in (LINK_RAW, LINK_RAW_OLD, LINK_IPV4, LINK_IPV6) else -1)
    version = data[at] >> 4 if 0 <= at < len(data) else 0
    return at, {4: ETHER_IPV4, 6: ETHER_IPV6}.get(version, 0)


@lru_cache(1 << 16)
def _shown(address: bytes) -> str:
    return str(ipaddress.ip_address(address))


def addresses(link: int, data: bytes) -> tuple[int | None, str | None, str | None]:
    """(version, source, destination) of the first IPv4 header, nested in IPv6 or not, else of the first IPv6 header."""
    at, kind = _network_layer(link, data)
    if kind == ETHER_IPV4 and len(data) >= at + 20:
        return 4, _shown(data[at + 12 : at + 16]), _shown(data[at + 16 : at + 20])
    if kind != ETHER_IPV6 or len(data) < at + 40:
        return None, None, None
    outer = 6, _shown(data[at + 8 : at + 24]), _shown(data[at + 24 : at + 40])
    following, at = data[at + 6], at + 40
    while following in IPV6_EXTENSIONS and len(data) >= at + 8:
        following, at = data[at], at + 8 * (data[at + 1] + 1)
    if following == IP_IN_IP and len(data) >= at + 20:
        return 4, _shown(data[at + 12 : at + 16]), _shown(data[at + 16 : at + 20])
    return outer


class _Bytes:
    """A file by position, read ahead in stretches."""

    def __init__(self, path: str) -> None:
        remote = _remote(path)
        self.size = remote[0].get_file_info(remote[1]).size if remote else os.path.getsize(path.removeprefix("file://"))
        self.file = remote[0].open_input_file(remote[1]) if remote else open(path.removeprefix("file://"), "rb", buffering=0)
        self.start, self.data = 0, b""

    def at(self, place: int, n: int) -> int:
        """Where in ``data`` the ``n`` bytes at ``place`` are; ValueError if the file ends before."""
        if place + n > self.size:
            raise ValueError("the capture is cut short")
        if not self.start <= place or place + n > self.start + len(self.data):
            self.file.seek(place)
            parts, left = [], min(max(n, STRETCH), self.size - place)
            while left and (part := self.file.read(left)):
                parts.append(part)
                left -= len(part)
            self.start, self.data = place, b"".join(parts)
            if len(self.data) < n:
                raise ValueError("the capture is cut short")
        return place - self.start

    def take(self, place: int, n: int) -> bytes:
        at = self.at(place, n)
        return self.data[at : at + n]

    def __enter__(self) -> _Bytes:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def _head(b: _Bytes) -> tuple[dict, int]:
    """What a reader of records must know, and where the first record is. ValueError for foreign files."""
    if b.size < 4:
        raise ValueError("not a capture file")
    magic = b.take(0, 4)
    if int.from_bytes(magic, "little") == PCAPNG_MAGIC:
        return {"order": "<", "links": [], "blocks": True}, 0
    for order in "<>":
        if ticks := PCAP_MAGICS.get(struct.unpack(f"{order}I", magic)[0]):
            link = struct.unpack(f"{order}I", b.take(20, 4))[0] & 0xFFFF
            return {"order": order, "links": [[link, ticks]], "blocks": False}, 24
    raise ValueError("not a capture file")


def _options(data: bytes, order: str) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 4 <= len(data):
        code, size = struct.unpack_from(f"{order}HH", data, at)
        if not code:
            break
        out[code] = data[at + 4 : at + 4 + size]
        at += 4 + (size + 3) // 4 * 4
    return out


def _records(b: _Bytes, state: dict, place: int, stop: int) -> Iterator[tuple[int, float, int, int, int, int]]:
    """(end, ts, wire length, link, place of the data, its length) of the packets that start before ``stop``.

    ``state`` follows the section and interface blocks that are passed, so it can start a later range.
    """
    if not state["blocks"]:
        (link, ticks), order = state["links"][0], state["order"]
        read = struct.Struct(f"{order}IIII").unpack_from
        while place < stop:
            at = b.at(place, 16)
            seconds, part, kept, wire = read(b.data, at)
            end = place + 16 + kept
            if end > b.size:
                raise ValueError("the capture is cut short")
            yield end, seconds + part / ticks, wire, link, place + 16, kept
            place = end
        return
    while place < stop:
        order = state["order"]
        kind, size = struct.unpack(f"{order}II", b.take(place, 8))
        if kind == PCAPNG_MAGIC:
            order = state["order"] = "<" if b.take(place + 8, 4) == struct.pack("<I", BYTE_ORDER_MAGIC) else ">"
            size, state["links"] = struct.unpack(f"{order}I", b.take(place + 4, 4))[0], []
        end, body = place + size, place + 8
        if size < 12 or end > b.size:
            raise ValueError("the capture is cut short")
        if kind == INTERFACE:
            data = b.take(body, size - 12)
            unit = _options(data[8:], order).get(9, b"\x06")[0]
            state["links"].append([struct.unpack_from(f"{order}H", data)[0], 2.0 ** (unit & 127) if unit & 128 else 10.0**unit])
        elif kind in (PACKET, OLD_PACKET):
            port, high, low, kept, wire = struct.unpack(f"{order}IIIII" if kind == PACKET else f"{order}HxxIIII", b.take(body, 20))
            if port >= len(state["links"]) or kept > size - 32:
                raise ValueError("a packet of no interface, or longer than its block")
            link, ticks = state["links"][port]
            yield end, ((high << 32) | low) / ticks, wire, link, body + 20, kept
        elif kind == SIMPLE_PACKET and state["links"]:
            wire = struct.unpack(f"{order}I", b.take(body, 4))[0]
            yield end, 0.0, wire, state["links"][0][0], body + 4, min(wire, size - 16)
        place = end


def ranges(path: str, size: int = RANGE) -> Iterator[tuple[str, int, int, int, int, str]]:
    """(file, start, stop, first packet's number, packets, state) of the ranges of about ``size`` bytes of one file.

    Every record header is passed, so a damaged file raises ValueError here. A file without packets has one range.
    """
    with _Bytes(path) as b:
        state, start = _head(b)
        known, first, n, end = json.dumps(state), 0, 0, start
        for end, *_ in _records(b, state, start, b.size):
            n += 1
            if end - start >= size:
                yield path, start, end, first, n, known
                start, first, n, known = end, first + n, 0, json.dumps(state)
        if n or not first:
            yield path, start, b.size, first, n, known


def _batches(parts: Iterable[tuple[str, int, int, int, str]], columns: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """The wanted columns of the packets of ranges (file, start, stop, first packet's number, state), in batches.

    A batch may hold several ranges; neighbours in a file share its reads. Data is looked at only for addresses.
    """
    look = bool({"ip_version", "src", "dst"} & set(columns))
    names = [c for c in COLUMNS if c in columns]
    out: dict[str, list] = {c: [] for c in COLUMNS}
    for path, of_file in groupby(parts, key=lambda part: part[0]):
        with _Bytes(path) as b:
            for _, start, stop, index, state in of_file:
                for _, ts, wire, link, place, kept in _records(b, json.loads(state), start, stop):
                    out["file"].append(path)
                    out["packet_index"].append(index)
                    out["ts"].append(ts)
                    out["wire_len"].append(wire)
                    if look:
                        for c, v in zip(("ip_version", "src", "dst"), addresses(link, b.take(place, min(kept, 512)) if kept else b"")):
                            out[c].append(v)
                    index += 1
                    if len(out["ts"]) >= BATCH:
                        yield {c: out[c] for c in names}
                        out = {c: [] for c in COLUMNS}
    if out["ts"]:
        yield {c: out[c] for c in names}


def read_packets(path: str) -> Iterator[tuple]:
    """(packet_index, ts, wire_len, ip_version, src, dst) of one capture, in file order. ValueError for damaged or foreign files."""
    with _Bytes(path) as b:
        state, start = _head(b)
        size = b.size
    for batch in _batches([(path, start, size, 0, json.dumps(state))], COLUMNS):
        yield from zip(*[batch[c] for c in COLUMNS[1:]])


def _remote(path: str):
    """(filesystem, path) of a URI with a scheme other than file, else None."""
    if urlparse(path).scheme in ("", "file"):
        return None
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def capture_files(path: str) -> list[str]:
    """The captures a path names, by name: a file, a folder's captures, or (locally) a glob."""
    if remote := _remote(path):
        from pyarrow import fs

        if remote[0].get_file_info(remote[1]).type != fs.FileType.Directory:
            return [path]
        names = [i.base_name for i in remote[0].get_file_info(fs.FileSelector(remote[1])) if i.type == fs.FileType.File]
        return sorted(f"{path.rstrip('/')}/{n}" for n in names if n.endswith(CAPTURES))
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(os.path.join(glob.escape(path), "*")) if p.endswith(CAPTURES))
    found = [path] if os.path.exists(path) else sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


def _sizes(path: str, files: list[str]) -> list[int]:
    """The bytes of the files that :func:`capture_files` found at ``path``."""
    if not (remote := _remote(path)):
        return [os.path.getsize(f) for f in files]
    from pyarrow import fs

    info = remote[0].get_file_info(remote[1])
    if info.type != fs.FileType.Directory:
        return [info.size]
    sizes = {i.base_name: i.size for i in remote[0].get_file_info(fs.FileSelector(remote[1]))}
    return [sizes[f.rsplit("/", 1)[-1]] for f in files]


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self):
        return [_File(p) for p in capture_files(self.path)]

    def read(self, partition):
        for row in read_packets(partition.path):
            yield (partition.path, *row)


class _StreamReader(DataSourceStreamReader):
    """A folder's files as they appear, one partition each.

    The offset lists the names of the files seen, whatever their order, as Spark's own file stream logs
    them. A file must appear whole: moved in under its name.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def _files(self) -> dict[str, str]:
        return {p.rsplit("/", 1)[-1]: p for p in capture_files(self.path)}

    def initialOffset(self):
        return {"seen": []}

    def latestOffset(self):
        return {"seen": sorted(self._files())}

    def partitions(self, start, end):
        files = self._files()
        return [_File(files[n]) for n in sorted(set(end["seen"]) - set(start["seen"]))]

    def read(self, partition):
        for row in read_packets(partition.path):
            yield (partition.path, *row)


class PcapSource(DataSource):
    """``packet_index`` is the packet's place in its ``file``."""

    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def streamReader(self, schema):
        return _StreamReader(self.options["path"])


def read_pcap(spark: SparkSession, path: str, columns: tuple[str, ...] = COLUMNS[1:], range_bytes: int = RANGE) -> DataFrame:
    """The packets of a capture file, a folder or a glob of files, numbered over all files by name.

    The ranges of all files come to the driver, one row for each ``range_bytes``, as Spark's own file
    index holds a split for each. A damaged file raises here, before anything is read. Registers the data source too.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    spark.dataSource.register(PcapSource)
    wanted = T.StructType([f for f in T.StructType.fromDDL(SCHEMA).fields if f.name in columns])
    files = capture_files(path)
    if not files:
        return spark.createDataFrame([], wanted)

    def walk(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = list(zip(*ranges(name, range_bytes)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["file", "start", "stop", "first", "packets", "state"])

    listed = _dealt(spark, [(f,) for f in files], _sizes(path, files), "file string")
    found = listed.mapInArrow(walk, "file string, start long, stop long, first long, packets long, state string").collect()
    rows, base = [], 0
    for r in sorted(found):
        rows.append((r["file"], r["start"], r["stop"], base, r["state"]))
        base += r["packets"]
    target = to_arrow_schema(wanted)

    def parse(batches):
        for part in _batches((tuple(row.values()) for batch in batches for row in batch.to_pylist()), tuple(columns)):
            yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) for f in target], schema=target)

    return _dealt(spark, rows, [r[2] - r[1] for r in rows], "file string, start long, stop long, first long, state string").mapInArrow(parse, wanted)


def _tasks(files: list[str], sizes: list[int], slots: int) -> list[int]:
    """The task of each part of a file: parts that start in the same ``TASK`` bytes share one, or in fewer if else some slots had none."""
    costs = [n + (OPENING if not i or f != files[i - 1] else 0) for i, (f, n) in enumerate(zip(files, sizes))]
    most = min(TASK, max(OPENING, -(-sum(costs) // slots)))
    numbers: dict[int, int] = {}
    return [numbers.setdefault((end - cost) // most, len(numbers)) for end, cost in zip(accumulate(costs), costs)]


def _dealt(spark: SparkSession, rows: list[tuple], sizes: list[int], schema: str) -> DataFrame:
    """The rows, which begin with a file, in tasks by their bytes, in their order."""
    tasks = _tasks([r[0] for r in rows], sizes, spark.sparkContext.defaultParallelism)
    numbered = spark.createDataFrame([(t, i, *r) for i, (t, r) in enumerate(zip(tasks, rows))], f"task int, at long, {schema}")
    return numbered.repartitionById(tasks[-1] + 1, F.col("task")).sortWithinPartitions("at").drop("task", "at")
