"""Each operator against a plain computation, and on nulls, empty tables, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

LONG = "word " * 30_000
TEXTS = ["", None, "a", "Hello  World again", "Hello world AGAIN", "line one is long enough\nshort\nline two is long enough", "  LINE one is long enough \nother", LONG, "ünï cödé tëxt with accents", "\n\n", "x\r\ny", "x" * 5000]


def documents(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string, source string{extra}")


@pytest.fixture
def odd(spark):
    """All odd texts, one twice with equal id, one with a null id, null sources, and columns whose names operators use."""
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 3}", 7, "x", 1.5, b"z") for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "Hello  World again", "s1", 7, "x", 1.5, b"z"), (None, None, None, None, None, None, None)]
    return documents(spark, rows, ", size long, shard string, score double, media binary")


@pytest.fixture
def empty(spark):
    return documents(spark, [])


def as_dict(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# 1


def shards(df, n, **more):
    from assayer.llm.sharding import histogram_shards

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    return histogram_shards(df, n, size, (F.xxhash64("text"), F.col("doc_id")), [F.col("doc_id"), size.alias("bytes"), *[F.col(c) for c in df.columns if c not in ("doc_id", "bytes")]], **more)


def check_shards(rows, n, count):
    assert len(rows) == count
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < n
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_shards_balance_bytes(spark):
    rng = random.Random(1)
    df = documents(spark, [(i, "x" * int(rng.paretovariate(1.2) * 20), "s") for i in range(3000)])
    rows = shards(df, 7, part_bytes=4000).collect()
    check_shards(rows, 7, 3000)
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["bytes"]
    mean, most = sum(size.values()) / 7, max(r["bytes"] for r in rows)
    assert max(abs(v - mean) for v in size.values()) <= most + 0.001 * mean
    again = shards(df, 7, part_bytes=4000).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in again)


def test_shards_part_equal_rows(spark):
    rows = shards(documents(spark, [(5, "same text", "s")] * 900 + [(None, None, None)] * 300), 6).collect()
    check_shards(rows, 6, 1200)
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["bytes"]
    assert max(size.values()) - min(size.values()) < 0.03 * sum(size.values())


def test_shards_edges(odd, empty):
    out = shards(odd, 4)
    assert "shard" in out.columns and out.columns.count("shard") == 1
    check_shards(out.collect(), 4, len(TEXTS) + 3)
    check_shards(shards(odd, 24).collect(), 24, len(TEXTS) + 3)
    assert shards(empty, 4).count() == 0


def test_shards_have_no_python(spark, odd):
    plan = shards(odd, 3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 2


def brute_links(rows, cosine=0.93):
    ok = [(i, l, np.array(v, float)) for i, l, v in rows]

    def fine(l, v):
        return l is not None and v.size and np.isfinite(v).all() and v.any()

    links, parent = {k: 0 for k in range(len(ok))}, list(range(len(ok)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (_, la, va), (_, lb, vb) = ok[a], ok[b]
            if fine(la, va) and fine(lb, vb) and la == lb and va.size == vb.size and va @ vb / np.sqrt((va @ va) * (vb @ vb)) >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for k in range(len(ok)):
        groups[find(k)].append(ok[k][0])
    return {ok[k][0]: (links[k], min(groups[find(k)])) for k in range(len(ok))}


@pytest.mark.parametrize("dim, tile", [(64, 2048), (64, 7), (20, 2048), (3, 2048), (1, 2048)])
def test_vectors_equal_brute_force(spark, monkeypatch, dim, tile):
    from assayer.llm import embeddings

    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(dim)
    rows = []
    for i in range(150):
        base = rng.standard_normal(dim)
        for k in range(rng.integers(1, 3)):
            rows.append((len(rows), int(i % 3), (base + rng.standard_normal(dim) * 0.25 * k).astype(np.float32).tolist()))
    hub = rng.standard_normal(dim)
    rows += [(len(rows) + k, 1, (hub + 0.1 * rng.standard_normal(dim)).astype(np.float32).tolist()) for k in range(40)]
    rows += [(len(rows) + k, 2, rows[0][2]) for k in range(5)]
    df = spark.createDataFrame([(i, v, l) for i, l, v in rows], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect()}
    want = brute_links(rows)
    assert len(got) == len(rows) and got == want and sum(n for n, _ in want.values()) > 200


def test_labels_are_cut_where_that_compares_less(spark, monkeypatch):
    """Wide budgets: a large label is compared whole, each pair once. Narrow ones: by cells. Same links as brute force either way."""
    from assayer.llm import embeddings

    rng = np.random.default_rng(3)
    base = rng.standard_normal((250, 64))
    rows = [(k, 0, v.tolist()) for k, v in enumerate((base + 0.02 * rng.standard_normal(base.shape)).astype(np.float32))]
    rows += [(1000 + k, 0, v.tolist()) for k, v in enumerate((base[:60] + 0.02 * rng.standard_normal((60, 64))).astype(np.float32))]
    df = spark.createDataFrame([(i, v, l) for i, l, v in rows], "vec_id long, embedding array<float>, label int")
    plans, compared = [], []
    monkeypatch.setattr(embeddings, "TILE", 100)
    plan, tiles = embeddings._plans, embeddings._tiles
    monkeypatch.setattr(embeddings, "_plans", lambda *a: plans.append(plan(*a)) or plans[-1])
    monkeypatch.setattr(embeddings, "_tiles", lambda e: compared.append(tiles(e)) or compared[-1])
    for cosine, cells in ((0.93, False), (0.995, True)):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df, cosine=cosine).collect()}
        assert got == brute_links(rows, cosine) and sum(n for n, _ in got.values()) >= 120
        assert [r["cells"] for r in plans[-1].collect()] == [cells]
    sizes = compared[0].groupBy("i", "j").pivot("side", [0, 1]).count().fillna(0).collect()
    assert sum(r["0"] * (r["0"] - 1) // 2 if r["i"] == r["j"] else r["0"] * r["1"] for r in sizes) == 310 * 309 // 2


def test_crowded_tiles_hold_few_pairs(spark, monkeypatch):
    """A label whose vectors all link, compared a few pairs at a time, with cosines at the threshold."""
    from assayer.llm import embeddings

    monkeypatch.setattr(embeddings, "AREA", 500)
    rng = np.random.default_rng(4)
    at = [math.sqrt(1 - 0.93**2), 0.93]
    rows = [(k, 5, v.tolist()) for k, v in enumerate((1 + 0.05 * rng.standard_normal((90, 8))).astype(np.float32))]
    rows += [(200, 6, [0.0, 1.0]), (201, 6, at), (202, 6, [0.0, 3.0])]
    df = spark.createDataFrame([(i, v, l) for i, l, v in rows], "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect()} == brute_links(rows)


def test_vectors_edges(spark):
    from assayer.llm.embeddings import near_vectors

    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (11, [2.0, 0.0], 2), (12, [1e30, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = as_dict(near_vectors(df), "vec_id")
    assert (got[1]["n_links"], got[2]["component_id"], got[2]["kept"], got[None]["n_links"], got[None]["component_id"]) == (2, 1, False, 2, 1)
    for i in (3, 4, 5, 6, 7, 8, 9, 10):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[11]["n_links"], got[12]["component_id"]) == (1, 11)
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label string")).count() == 0


# 3


def brute_targets(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= cap * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def mixed(df):
    from assayer.llm.mixing import mix_sources, word_count

    return mix_sources(df, word_count(F.col("text")))


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * int(rng.paretovariate(1.1) * 5), ["a", "b", "Z", "é", None, "tiny"][min(5, int(rng.paretovariate(0.8)) - 1)]) for i in range(4000)] + [(9000 + i, "w " * 400, "hot") for i in range(2000)]
    df = documents(spark, rows).withColumn("copies", F.lit("clash"))
    got = mixed(df).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["copies"] <= 3
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * want[s] + 1e-6
        assert abs(taken[s] - want[s]) <= max(400, 0.02 * want[s]) if s == "hot" else abs(taken[s] - want[s]) <= 0.02 * want[s] + 6
    assert len(got) == 6000
    assert sorted((r["doc_id"], r["copies"]) for r in mixed(df).collect()) == sorted((r["doc_id"], r["copies"]) for r in got)


def test_mixing_edges(spark, odd, empty):
    from assayer.llm.mixing import mix_documents

    got = mixed(odd)
    assert got.count() == len(TEXTS) + 3 and got.columns.count("size") == 1
    assert mixed(empty).count() == 0 and mix_documents(empty).count() == 0
    assert {r["copies"] for r in mixed(documents(spark, [(1, None, None), (2, "", None)])).collect()} == {1}
    rows = mix_documents(odd)
    assert rows.columns == odd.columns
    counts = Counter(r["doc_id"] for r in rows.collect())
    copies = Counter()
    for r in got.collect():
        copies[r["doc_id"]] += r["copies"]
    assert {k: v for k, v in copies.items() if v} == dict(counts)


def test_rows_that_differ_only_elsewhere_are_mixed_apart(spark):
    """Null and repeated ids, and rows equal but for their source: each row has copies of its own, and reruns agree."""
    from assayer.llm.mixing import mix_documents

    rows = [(1, "one two", "a"), (1, "one two", "b"), (1, "one two", "b"), (None, "w " * 5, "a"), (None, "w " * 5, "a"), (None, None, None)] + [(None, "same text", "b")] * 40 + [(k, "x " * (k % 9), "ab"[k % 2]) for k in range(2, 60)]
    df = documents(spark, rows)
    got = Counter(tuple(r) for r in mix_documents(df).collect())
    assert got == Counter(tuple(r) for r in mix_documents(df.repartition(7)).collect()) and set(got) <= set(rows)
    want = Counter()
    for r in mixed(df).collect():
        want[r["source"], r["size"]] += r["copies"]
    have = Counter()
    for (_, t, s), n in got.items():
        have[s, len((t or "").split())] += n
    assert have == Counter({k: v for k, v in want.items() if v}) and max(got[r] / rows.count(r) for r in got) <= 3


def slow_copies(sizes, targets, cap=3):
    """Copies of each (source, size): tilts by bisection, then rounding from large sizes down, in plain Python."""
    out = {}
    for s, target in targets.items():
        mine = Counter(n for n, x in sizes if x == s)
        total, docs = sum(k * n for n, k in mine.items()), sum(k for n, k in mine.items() if n)
        rate = lambda tilt, n: min(cap, math.exp(min(50.0, tilt * n * docs / total)))
        low, high = -1e4, 1e4
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if total and sum(k * n * rate(mid, n) for n, k in mine.items()) > target else (mid, high)
        plan = taken = 0
        for n in sorted(mine, reverse=True):
            plan += n * mine[n] * rate(low, n) if n else 0
            k = mine[n] if not n else min(max(int((plan - taken) / n + 0.5), 0), cap * mine[n])
            taken += k * n
            out[s, n] = k
    return out


def test_mixing_query_equals_plain_loops(spark):
    import re

    import duckdb

    from assayer.llm.mixing import op3_mixing

    sf = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, coalesce(text, ''), source FROM '{sf}/documents.parquet'").fetchall()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in docs}
    source = {i: s for i, _, s in docs}
    totals = Counter()
    for i, s in source.items():
        totals[s] += size[i]
    want = slow_copies([(size[i], source[i]) for i in source], brute_targets(totals))
    got = Counter()
    for r in op3_mixing(spark, sf).collect():
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == totals[source[r["doc_id"]]]
        got[source[r["doc_id"]], r["size"]] += r["taken"] // r["size"] if r["size"] else 1
    assert got == Counter(want)


# 4


def brute_lines(rows, least=2):
    white = " \t\n\x0b\f\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(white).translate(low)
    rank = lambda i: (i is not None, i or 0)
    seen = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            seen[key(line)].add(i)
    gone = lambda i, k: len(k) >= 10 and len(seen[k]) >= least and i != min(seen[k], key=rank)
    return Counter((i, len((t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if not gone(i, key(x)))) for i, t in rows)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_lines(spark, odd, empty, least):
    from assayer.llm.line_dedup import dedup_lines

    more = documents(spark, [(100 + i, "shared line number one\n" + ("own line %d here\n" % i) * 2 + "shared line number one", "s") for i in range(50)])
    df = odd.unionByName(more, allowMissingColumns=True).withColumn("n_lines", F.lit("clash"))
    out = dedup_lines(df, min_docs=least)
    got = Counter((r["doc_id"], r["n_lines"], r["text"]) for r in out.collect())
    assert got == brute_lines([(r["doc_id"], r["text"]) for r in df.collect()], least)
    assert all(r["n_dropped"] == r["n_lines"] - len(r["text"].split("\n")) for r in out.filter("n_dropped < n_lines").collect())
    assert dedup_lines(empty).count() == 0


# 5


def test_warc(spark, tmp_path):
    from assayer.llm.warc import mark_revisits, parse_record, read_records, record_bytes, write_archives

    big = "<p>ü</p>" * 300
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "u\r\nx", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "n", big), (8, "u", "other" * 400), (3, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    marked = mark_revisits(pages)
    types = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in marked.collect())
    assert types[(3, "response", None)] == 2 and types[(1, "revisit", 3)] == types[(2, "revisit", 3)] == types[(None, "revisit", 3)] == 1 and types[(4, "response", None)] == 1
    for compress in (True, False):
        folder = f"file://{tmp_path}/w{compress}"
        index = write_archives(marked, folder, compress=compress, roll_bytes=2000)
        back = read_records(index, folder)
        got = Counter((r["page_id"], r["record_type"], bytes(r["payload"])) for r in back.collect())
        assert got == Counter((r["page_id"], r["record_type"], b"" if r["record_type"] == "revisit" else bytes(r["payload"])) for r in marked.collect())
        some = read_records(index.filter("page_id = 8"), folder, gap=0).collect()
        assert len(some) == 1 and bytes(some[0]["payload"]) == b"other" * 400
    none = mark_revisits(pages.limit(0))
    assert none.count() == 0 and write_archives(none, f"file://{tmp_path}/none").count() == 0
    record = record_bytes({"page_id": 1, "url": "u", "record_type": "response", "refers_to": None, "digest": "d", "payload": b"x\r\n\r\ny"}, "2000-01-01T00:00:00Z")
    assert parse_record(record)["payload"] == b"x\r\n\r\ny"
    for bad in (record[:-1], record + b"x", b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            parse_record(bad)


# 6


def test_images_round_trip():
    from assayer.llm.media import decode, decode_netpbm, encode_bmp, encode_ppm

    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (3, 5), (7, 4)):
        pixels = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        assert (decode(encode_ppm(pixels)) == pixels).all() and (decode(encode_bmp(pixels)) == pixels).all()
    assert decode(b"P1\n# c\n2 2\n1 0\n0 1\n")[:, :, 0].tolist() == [[0, 255], [255, 0]]
    assert decode(b"P4\n10 1\n\x80\x40")[0, :, 0].tolist() == [0, *[255] * 8, 0]
    assert decode(b"P2 2 1 9\n3 9")[0, :, 0].tolist() == [3, 9] and decode(b"P3 1 1 255 1 2 3")[0, 0].tolist() == [1, 2, 3]
    assert decode_netpbm(b"P5 1 1 65535\n\x01\x02")[0, 0, 0] == 258 and decode(b"P6 1 1 255\nabc")[0, 0].tolist() == [97, 98, 99]
    for bad in (b"", b"P", b"P7 1 1 1\n", b"P5 2 2 255\nabc", b"P5 0 2 255\n", b"P5 x", b"BMxx", b"P6 1 1 0\nabc"):
        with pytest.raises(ValueError):
            decode(bad)


def test_palette_bmp():
    import struct

    from assayer.llm.media import decode

    def bmp(bits, rows, height):
        palette = bytes([10, 20, 30, 0, 40, 50, 60, 0])
        return struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54 + 8) + struct.pack("<IiiHHIIiiII", 40, 2, height, 1, bits, 0, 0, 0, 0, 2, 0) + palette + rows

    want = [[[30, 20, 10], [60, 50, 40]]]
    assert decode(bmp(8, b"\x00\x01\0\0", 1)).tolist() == want and decode(bmp(4, b"\x01\0\0\0", 1)).tolist() == want and decode(bmp(1, b"\x40\0\0\0", -1)).tolist() == want


def test_area_resize():
    from assayer.llm.media import area_resize

    rng = np.random.default_rng(1)
    for h, w, th, tw in ((8, 9, 8, 9), (16, 27, 8, 9), (5, 7, 3, 2), (2, 3, 8, 9), (1, 64, 8, 9)):
        x = rng.integers(0, 256, (h, w, 2))
        fine = x.repeat(th, axis=0).repeat(tw, axis=1).reshape(th, h, tw, w, 2).mean(axis=(1, 3))
        assert np.allclose(area_resize(x, th, tw), fine)


def test_media(odd, empty):
    from assayer.llm.media import media_features, media_table

    for kinds in (("ppm",), ("bmp",), ("ppm", "bmp")):
        stored = media_table(odd.select("doc_id", "text"), kinds=kinds)
        assert {bytes(r["media"])[:2] for r in stored.collect()} == {{"ppm": b"P6", "bmp": b"BM"}[k] for k in kinds}
        rows = media_features(stored).collect()
        texts = {r["doc_id"]: r["text"] for r in odd.collect()}
        assert len(rows) == len(TEXTS) + 3
        for r in rows:
            if r["doc_id"] is None:
                continue
            data = (texts[r["doc_id"]] or "").encode()
            padded = data + b" " * (-len(data) % 192) if data else b" " * 192
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
            assert len(r["feature"]) == 16 and np.load(__import__("io").BytesIO(r["tile"])).shape == (16, 16, 3) and r["error"] is None
    assert media_features(media_table(empty)).count() == 0


def slow_means(pixels, height, width):
    """Area means pixel by pixel, in fractions."""
    from fractions import Fraction

    h, w, planes = pixels.shape
    share = lambda k, n, out, i: max(Fraction(0), min(Fraction((k + 1) * n, out), i + 1) - max(Fraction(k * n, out), i))
    rows = [[(i, s) for i in range(h) if (s := share(k, h, height, i))] for k in range(height)]
    cols = [[(j, s) for j in range(w) if (s := share(k, w, width, j))] for k in range(width)]
    area = Fraction(h * w, height * width)
    return [[[sum(si * sj * int(pixels[i, j, p]) for i, si in r for j, sj in c) / area for p in range(planes)] for c in cols] for r in rows]


def test_hashes_and_tiles_equal_a_slow_computation():
    import io

    from assayer.llm.media import difference_hash, npy_tile

    rng = np.random.default_rng(2)
    for h, w in ((1, 64), (3, 64), (11, 7), (2, 3)):
        pixels = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        pixels[:, : w // 2] = 32  # flat parts: neighbours that are equal
        grey = [[sum(p) / 3 for p in row] for row in slow_means(pixels, 8, 9)]
        bits = "".join(str(int(row[k + 1] > row[k])) for row in grey for k in range(8))
        assert difference_hash(pixels) == f"{int(bits, 2):016x}"
        tile = np.load(io.BytesIO(npy_tile(pixels, 4)))
        want = [[[(2 * v.numerator + v.denominator) // (2 * v.denominator) for v in p] for p in row] for row in slow_means(pixels, 4, 4)]
        assert tile.tolist() == want


def test_resizing_takes_little_memory():
    import tracemalloc

    from assayer.llm.media import difference_hash

    pixels = np.zeros((300_000, 64, 3), np.uint8)
    tracemalloc.start()
    difference_hash(pixels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20_000_000


def test_media_query(spark):
    """The registered query against plain Python."""
    import duckdb

    from assayer.llm.media import decode, op6_media

    sf = "/root/testdata/sf0.001"
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    got, alike = op6_media(spark, sf).collect(), defaultdict(set)
    assert len(got) == len(texts)
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        padded = data + b" " * (-len(data) % 192) if data else b" " * 192
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        header = 54 if zlib.crc32(padded) % 2 else len(b"P6\n64 %d\n255\n" % (len(padded) // 192))
        assert r["media_bytes"] == header + len(padded) and len(r["feature"]) == 16
        alike[data].add(tuple(v for k, v in r.asDict().items() if k != "doc_id"))
    assert all(len(v) == 1 for v in alike.values()) and {zlib.crc32(d + b" " * (-len(d) % 192)) % 2 for d in alike} == {0, 1}
    assert decode(b"P5 1 1 255\nx").shape == (1, 1, 1)


DAMAGED = [
    b"junk", b"", b"P2 1 1 9\n300", b"P3 1 1 255 1 2 -1", b"P2 1 1 9\n10", b"P2 1 1 255\nx", b"P5 99999999999999 99999999999999 255\n", b"P4 99999999999999999999 9\n",
    b"P6 2 2 255", b"P1 2 2\n1", b"BM" + bytes(52),
]


def damaged_palette():
    import struct

    return struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54 + 8) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 8, 0, 0, 0, 0, 2, 0) + bytes(8) + b"\x00\x09\0\0"


def test_media_that_cannot_be_read(spark):
    from assayer.llm.media import media_features

    bad = [*DAMAGED, damaged_palette()]
    rows = [(k, x, "old") for k, x in enumerate(bad)] + [(100, None, "old"), (101, b"P5 1 1 255\nx", "old"), (101, b"P5 1 1 255\nx", "old"), (None, b"P5 1 1 255\nx", "old")]
    got = media_features(spark.createDataFrame(rows, "doc_id long, media binary, feature string")).collect()
    found = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for k, x in enumerate(bad):
        assert found[k]["error"] and found[k]["feature"] is None and found[k]["media_bytes"] == len(x), x
    assert found[100]["media_bytes"] is None and found[100]["error"] is None and found[101]["error"] is None and found[None]["feature"] == "0" * 16


# 7


def brute_fingerprint(text, width=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = (text or "").translate(low).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, odd, empty):
    from assayer.llm.simhash import fingerprint, near_duplicates

    for t in TEXTS + ["one", "one two", "one two three", "One\x0btwo\fthree four"]:
        assert fingerprint((t or "").encode()) == brute_fingerprint(t)
    rows = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in near_duplicates(odd).collect()]
    assert Counter(r[1] for r in rows) == Counter(brute_fingerprint(r["text"]) for r in odd.collect())
    zero = {r for r in rows if r[1] == 0}
    assert {r[2] for r in zero} == {0} and (None, 0, 0) in zero
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_links_of_fingerprints(spark, bits):
    from assayer.llm.components import connected_components
    from assayer.llm.simhash import link_fingerprints

    rng = random.Random(bits)
    prints = {0, 2**64 - 1}
    for _ in range(150):
        p = rng.getrandbits(64)
        for _ in range(4):
            prints.add(p)
            for _ in range(rng.randint(1, 2)):
                p ^= 1 << rng.randrange(64)
    signed = sorted(p - 2**64 if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = [tuple(sorted(r)) for r in link_fingerprints(df, bits).collect()]
    got = set(found)
    assert bits == 3 or len(found) == len(got)  # each edge once
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
    assert got == want and want
    parts = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(sorted(got), "a long, b long")).collect()}
    assert all(parts[a] == parts[b] for a, b in want) and all(parts[c] == c <= n for n, c in parts.items())


def test_every_place_of_two_bits_is_linked_once(spark):
    """All fingerprints at one or two bits from a given one, and entries so narrow that a shared segment brings no pairs."""
    from assayer.llm.simhash import index_slots, link_fingerprints

    base = 0x9E3779B97F4A7C15
    near = [base ^ 1 << i for i in range(64)] + [base ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)]
    signed = [p - 2**64 if p >> 63 else p for p in [base, *near]]
    found = [tuple(r) for r in link_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp long"), 2).collect()]
    to_base = [r for r in found if signed[0] in r]
    assert len(to_base) == len(set(to_base)) == len(near) and len(found) == len({frozenset(r) for r in found})
    slots = index_slots(2)
    assert len(set(slots)) == len(slots) == 100 and {m.bit_count() for m, _ in slots} == {47, 48}
    alike = sorted({base & 0xFFFFFFFF | random.Random(i).getrandbits(31) << 32 for i in range(2000)})
    want = {(a, b) for i, a in enumerate(alike) for b in alike[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert {tuple(sorted(r)) for r in link_fingerprints(spark.createDataFrame([(p,) for p in alike], "fp long"), 2).collect()} == want


def test_entries_are_not_broadcast(spark, odd):
    """Neither the entries nor the salted classes, however small Spark takes them for: a broadcast is built on the driver."""
    from assayer.llm.simhash import link_fingerprints, near_duplicates

    prints = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    for df in (link_fingerprints(prints, 2), link_fingerprints(prints, 3), near_duplicates(odd)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components(spark):
    from assayer.llm.components import connected_components

    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001), (2001, 2000), (None, 5), (3000 + 50, 3000)] + [(3000, 3000 + i) for i in range(1, 90)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and got[2001] == got[2000] == 2000 and got[3089] == 3000 and 1000 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8


def test_token_counts(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    from assayer.llm.token_counts import UnigramCounter, load_pieces, token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, unknown = load_pieces(path)
    library = Tokenizer(models.Unigram(pieces, unknown, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts(odd, path).collect())
    assert got == Counter((r["doc_id"], count(r["text"])) for r in odd.collect())
    counter, rng = UnigramCounter(pieces, unknown), random.Random(5)
    letters = "aáb c▁e日\U0001f600\n\tst1.<0x>é"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert counter.text(text) == count(text), text
    assert token_counts(empty, path).count() == 0


def library_counter():
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    from assayer.llm.token_counts import UnigramCounter, load_pieces

    pieces, unk = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram(pieces, unk, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return UnigramCounter(pieces, unk), lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_token_counts_over_stretches(monkeypatch):
    """Texts cut into short stretches, at blanks, marks and runs of them, and words beyond the longest piece."""
    from assayer.llm import token_counts

    counter, want = library_counter()
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "the", " ", "  ", "▁", "\n", "é", "日", "\U0001f600", "tion", " of"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    texts += ["x" * 3000, " ", "▁", "  a", "a  ", "日本" * 200]
    monkeypatch.setattr(token_counts, "STRETCH", 7)
    for t in texts:
        assert counter.text(t) == want(t), t


def test_long_texts_and_words_take_little_memory():
    import tracemalloc

    from assayer.llm.token_counts import UnigramCounter

    counter = UnigramCounter([("a", -1.0), ("ab", -1.5), ("▁a", -1.0), ("<unk>", -5.0)], 3)
    for text in ("ab" * 500_000, "ab " * 333_333):
        tracemalloc.start()
        n = counter.text(text)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n > 300_000 and most < 40_000_000


def test_token_counts_query(spark):
    import duckdb

    from assayer.llm.token_counts import op8_token_counts

    sf = "/root/testdata/sf0.001"
    _, want = library_counter()
    texts = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf}/documents.parquet'").fetchall()
    got = {r["doc_id"]: (r["n_tokens"], r["n_chars"], r["n_bytes"]) for r in op8_token_counts(spark, sf).collect()}
    assert got == {i: (want(t), len(t), len(t.encode())) for i, t in texts}


def test_token_ties():
    from tokenizers import Tokenizer, models

    from assayer.llm.token_counts import UnigramCounter

    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("bb", -2.0)]
    library, counter, rng = Tokenizer(models.Unigram(pieces, 0)), UnigramCounter(pieces, 0), random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("abx") for _ in range(rng.randrange(1, 14)))
        assert counter.word(text) == len(library.encode(text).ids), text


# 9


def test_plans_cover_counts():
    from assayer.llm.packing import Places, plan_bins

    rng = random.Random(9)
    for _ in range(60):
        capacity = rng.choice([1, 5, 16, 100, 1024])
        counts = {rng.randint(1, capacity): rng.randint(0, 40) for _ in range(rng.randint(0, 40))}
        plan = plan_bins(counts, capacity)
        seen = Counter()
        for lengths, times in plan:
            assert times > 0 and sum(lengths) <= capacity
            for n in lengths:
                seen[n] += times
        assert seen == Counter({k: v for k, v in counts.items() if v})
        bins = sum(t for _, t in plan)
        assert Places(plan).sequences == bins and bins <= max(1, 1.7 * sum(k * v for k, v in counts.items()) / capacity + 1)
    assert plan_bins({6: 2, 5: 1, 4: 1, 3: 2}, 10) and plan_bins({}, 5) == []
    with pytest.raises(ValueError):
        plan_bins({11: 1}, 10)


def test_two_fit_replaces_the_smallest():
    from assayer.llm.packing import plan_bins

    # Greedy fills 6 + 3; the gap of 1 closes when 3 gives way to 2 and 2.
    assert plan_bins({6: 1, 3: 1, 2: 2}, 10)[0] == ((6, 2, 2), 1)


def slow_bins(lengths, capacity):
    """Best-two-fit on single pieces: fill greedily, then let the smallest give way to the best pair, while there is one."""
    free, bins = sorted(lengths), []
    while free:
        full, gap = [], capacity
        while fits := [n for n in free if n <= gap]:
            free.remove(fits[-1])
            full.append(fits[-1])
            gap -= fits[-1]
        while gap and len(full) > 1:
            least = min(full)
            pairs = [(free[i] + free[j], free[j], free[i]) for j in range(len(free)) for i in range(j) if least < free[i] + free[j] <= gap + least]
            if not pairs:
                break
            total, a, b = max(pairs)
            for n in (a, b):
                free.remove(n)
            full.remove(least)
            full += [a, b]
            free = sorted([*free, least])
            gap += least - total
        bins.append(tuple(sorted(full, reverse=True)))
    return Counter(bins)


def test_plans_equal_single_pieces():
    from assayer.llm.packing import plan_bins

    rng = random.Random(12)
    for _ in range(300):
        capacity = rng.choice([7, 16, 40])
        lengths = [rng.choice((rng.randint(1, capacity), rng.randint(1, 4))) for _ in range(rng.randint(0, 40))]
        got = Counter()
        for bin_, times in plan_bins(dict(Counter(lengths)), capacity):
            got[bin_] += times
        assert got == slow_bins(lengths, capacity), (lengths, capacity)


def test_packing_query(spark):
    import duckdb

    from assayer.llm.packing import op9_packing

    sf = "/root/testdata/sf0.001"
    docs = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{sf}/documents.parquet'").fetchall()}
    got = op9_packing(spark, sf).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and sum(b[-1]) <= 1024
    for p in pieces.values():
        p.sort()
        assert [x[0] for x in p] == list(range(len(p))) and all(x[1] + x[2] == y[1] for x, y in zip(p, p[1:])) and all(x[2] == 1024 for x in p[1:])
    assert set(pieces) == docs and Counter(tuple(sorted((n for _, n in b), reverse=True)) for b in bins.values()) == slow_bins([r["length"] for r in got], 1024)


def test_packing_odd_rows(spark):
    """Rows of null and repeated ids, and equal rows, have places of their own."""
    from assayer.llm.packing import pack

    rows = [(None, 0, 5)] * 300 + [(1, 0, 5)] * 5 + [(1, 0, 7), (None, None, 3)]
    got = pack(spark.createDataFrame(rows, "doc_id long, piece int, length long").withColumn("__row", F.lit(1)), 16).collect()
    assert len(got) == len(rows) and len({(r["sequence_id"], r["offset"]) for r in got}) == len(rows)


def test_packing(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from assayer.llm.packing import END, pack, token_pieces

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    special = documents(spark, [(500, "a <|endoftext|> b", "s")] + [(600 + i, "t " * (i % 37), "s") for i in range(400)])
    df = odd.select("doc_id", "text").unionByName(special.select("doc_id", "text"))
    pieces = token_pieces(df, path, 64, with_ids=True).withColumn("offset", F.lit("clash"))
    got = [r.asDict() for r in pack(pieces, 64).collect()]
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    for r in df.filter("doc_id is not null and doc_id <> 3").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, END]
        own = sorted(by_doc[r["doc_id"]], key=lambda p: p["piece"])
        assert [x for p in own for x in p["ids"]] == ids and all(p["length"] == 64 for p in own[1:]) and own[0]["start"] == 0
        assert all(p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in own)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and sum(b[-1]) <= 64
    assert len(bins) <= 1.01 * -(-sum(r["length"] for r in got) // 64) + 1
    assert pack(token_pieces(empty, path)).count() == 0


def test_ranks(spark):
    from assayer.llm.common import bucket_rank, ordered_rank

    df = spark.createDataFrame([(None if i % 7 == 0 else i % 2, i if i % 3 else 5) for i in range(3000)], "k long, v long")
    ranks = defaultdict(list)
    for r in bucket_rank(df, ["k"], ["v"], 3000).collect():
        ranks[r["k"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values()) and len(ranks) == 3
    rows = ordered_rank(df.distinct(), [F.col("v").asc_nulls_last(), F.col("k")]).collect()
    assert sorted(r["rank"] for r in rows) == list(range(len(rows)))
    rows.sort(key=lambda r: r["rank"])
    assert [r["v"] for r in rows] == sorted(r["v"] for r in rows)


# 10


def test_features():
    from assayer.llm.quality import Settings, document, feature_buckets

    s = Settings()
    assert len(feature_buckets("", s)) == 1 and len(feature_buckets("   \n", s)) == 1
    assert sorted(feature_buckets("ab ab", s)) == sorted(feature_buckets(" ab \n ab ", s))
    repeat, other = set(feature_buckets("ab ab", s)), set(feature_buckets("xy xy", s))
    assert len(repeat & other) == 2, "the end and the repetition"
    buckets, share = document("one two three two", s)
    assert abs(share.sum() - 1) < 1e-6 and len(set(buckets)) == len(buckets)


def slow_buckets(text, settings):
    """Features in plain Python integers."""
    from assayer.llm.quality import BASE, MIX

    m = (1 << 64) - 1
    points = [c if c > 32 else 32 for c in map(ord, f" {text} ")]
    found = [1]
    for size in range(settings.min_gram, settings.max_gram + 1):
        for i in range(len(points) - size + 1):
            if all(c > 32 for c in points[i + 1 : i + size - 1]):
                h = 0
                for c in points[i : i + size]:
                    h = (h * BASE + c) & m
                found.append(h + size)
    words = []
    for w in "".join(chr(c) for c in points).split(" "):
        if w:
            words.append(sum(ord(c) * BASE**k for k, c in enumerate(w)) * MIX & m)
            found.append(words[-1] + 0x51)
    found += [2 if a == b else ((a ^ (a >> 31)) * BASE + b) & m for a, b in zip(words, words[1:])]
    return sorted(((f * MIX & m) >> 32) % settings.buckets for f in found)


def test_features_equal_a_slow_computation_over_stretches(monkeypatch):
    from assayer.llm import quality

    rng, s = random.Random(6), quality.Settings()
    texts = ["".join(rng.choice(["a", "bb", "ccc", " ", "\n", "é", "日", "word "]) for _ in range(rng.randrange(50))) for _ in range(60)] + ["", " ", "x" * 40, "\ud800 a"]
    for stretch in (1, 2, 3, 7, 1 << 18):
        monkeypatch.setattr(quality, "STRETCH", stretch)
        for t in texts:
            assert sorted(quality.feature_buckets(t, s)) == slow_buckets(t, s), (t, stretch)


def test_training_gives_its_memory_back():
    """The driver keeps little of what the sample took; an array a text would stay for good."""
    import subprocess
    import sys

    code = """
import random, re
from assayer.llm import quality

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

rng = random.Random(1)
words = [f"{rng.randrange(10**6)}" for _ in range(20000)]
texts = [" ".join(rng.choices(words, k=300)) for _ in range(3000)]
before = held()
quality.train(texts, [i % 2 for i in range(3000)], quality.Settings(steps=0))
print(held() - before)
"""
    grown = float(subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True, timeout=300).stdout)
    assert grown < 30, grown


def test_long_texts_are_scored_in_little_memory():
    import tracemalloc

    from assayer.llm.quality import Settings, score

    s = Settings()
    weights = np.random.default_rng(0).standard_normal(s.buckets)
    for text in ("abcdefghij" * 300_000, "abc defg " * 300_000):
        tracemalloc.start()
        value = score(text, weights, s)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert 0 < value < 1 and most < 60_000_000


def slow_train(docs, labels, settings):
    """The training steps in plain loops over buckets."""
    from assayer.llm.quality import feature_buckets

    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1 / settings.dim, 1 / settings.dim, (settings.buckets, settings.dim))
    out = np.zeros((settings.dim, 2))
    passes = -(-settings.steps // len(docs))
    done = 0
    for _ in range(passes):
        for i in rng.permutation(len(docs)):
            rate = settings.rate * (1 - done / (passes * len(docs)))
            done += 1
            counts = Counter(feature_buckets(docs[i], settings).tolist())
            total = sum(counts.values())
            share = {b: n / total for b, n in counts.items()}
            mean = sum(p * vectors[b] for b, p in share.items())
            odds = np.exp(mean @ out)
            miss = odds / odds.sum() - np.eye(2)[labels[i]]
            back = out @ miss
            out = out - rate * np.outer(mean, miss)
            power = sum(p * p for p in share.values())
            for b, p in share.items():
                vectors[b] -= rate * 0.5 * p / power * back
    return vectors @ (out[:, 1] - out[:, 0])


def test_training_equals_plain_loops():
    from assayer.llm.quality import Settings, train

    s = Settings(buckets=64, dim=4, steps=60)
    docs, labels = ["good fine words", "bad bad bad", "fine good", "bad worse"], [1, 0, 1, 0]
    assert np.allclose(train(docs, labels, s), slow_train(docs, labels, s), atol=1e-3)


def test_repeated_ids_are_trained_on_once(spark):
    from assayer.llm.quality import Settings, training_rows

    one, two = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5][:2]
    docs = spark.createDataFrame([(one, t) for t in ("b", "a", "b", None)] * 40 + [(two, "x"), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(one, 1), (one, 0), (two, 1), (None, 1), (30, 2)], "doc_id long, quality int")
    got = [training_rows(docs.repartition(k), labels, Settings()) for k in (1, 5)]
    assert got[0] == got[1] and sorted(q for _, q in got[0]) == [0, 1] and len(got[0]) == 2


def test_classifier_learns(spark, odd, empty):
    from assayer.llm.quality import Settings, fit, quality_scores

    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(400):
        good = i % 4 != 0
        rows.append((i, " ".join(word() if good else word().upper() + "!!" for _ in range(30)), "s"))
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(1, 1, 0), (None, 1, 0), (2, None, 0), (3, 7, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    settings = Settings(sample=300)
    weights = fit(docs, labels, settings)
    held = {r["doc_id"]: r["score"] for r in quality_scores(docs, weights, settings).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert len(held) > 50 and all((s >= 0.3) == (i % 4 != 0) for i, s in held.items())
    assert (fit(docs, labels, settings) == weights).all()
    scored = quality_scores(odd, weights, settings)
    assert scored.columns.count("score") == 1 and scored.count() == len(TEXTS) + 3 and all(0 <= r["score"] <= 1 for r in scored.collect())
    assert quality_scores(empty, weights, settings).count() == 0
    nothing = fit(docs, labels.limit(0), settings)
    assert {r["score"] for r in quality_scores(docs, nothing, settings).collect()} == {0.5}
    one = Settings(sample=40)
    assert len(set(np.round(fit(docs, labels.filter("quality = 1"), one), 3))) > 0


def test_intermediates_can_be_released(spark):
    import os
    from urllib.parse import urlparse

    from assayer.llm import common

    held, common._WRITTEN[:] = list(common._WRITTEN), []
    df = common.materialize(spark.range(5), "mine")
    path = urlparse(common._WRITTEN[0]).path
    assert df.count() == 5 and os.path.isdir(path)
    common.release()
    assert not os.path.exists(path) and not common._WRITTEN
    common._WRITTEN[:] = held
