"""The near-dedup stage of the pipeline."""

import random

import pytest


def survivors(spark, rows):
    import corpus_pipeline

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_copies_of_similarity_four_fifths_go(spark):
    rng = random.Random(1)
    rows, kept = [], []
    for k in range(30):
        words = [f"w{rng.randrange(10_000)}" for _ in range(64)]
        near, far = list(words), list(words)
        near[30] = "changed"  # 5 of 60 shingles: similarity 55 / 65
        far[10] = far[50] = "other"  # 10 of 60: 50 / 70, and 45 / 75 with the other copy
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
        kept += [3 * k, 3 * k + 2]
    assert [r[0] for r in survivors(spark, rows)] == kept


def test_one_row_of_a_group_stays(spark):
    """Null ids in groups with and without other ids, and a repeated id whose rows have different texts."""
    rows = [(None, "only null here"), (None, "only null here"), (7, "has an id"), (None, "has an id"), (8, "one text"), (8, "one text"), (8, "another text")]
    assert survivors(spark, rows) == [(7, "has an id"), (8, "another text"), (8, "one text"), (None, "only null here")]


def brute_components(texts):
    from assayer.llm.near_copies import shingles

    sets = {i: frozenset(shingles((t or "").encode())) for i, t in texts.items()}
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("least, tile, keep", [(512, 4096, 8), (16, 5, 1)])
def test_groups_equal_brute_force(spark, monkeypatch, least, tile, keep):
    """Stars whose members are mostly unlike each other, chains, unlike texts with shared passages, odd texts; small limits too."""
    from assayer.llm import near_copies

    for name, value in (("LEAST", least), ("TILE", tile), ("KEEP", keep), ("SHELF", 64)):
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(least)
    word = lambda: f"w{rng.randrange(100_000)}"
    texts = [None, "", " \n", "one two", "One  Two", "a b c d e", "a b c d f"]
    for size in (60, 120):
        base = [word() for _ in range(size)]
        for _ in range(40):  # up to four words changed
            t = list(base)
            for at in rng.sample(range(size), rng.randrange(5)):
                t[at] = word()
            texts.append(" ".join(t))
        chain = list(base)
        for k in range(12):
            chain[k * 5 % size] = word()
            texts.append(" ".join(chain))
        texts += [" ".join(base[: size // 2] + [word() for _ in range(size // 2)]) for _ in range(5)]
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    df = spark.createDataFrame([(i, 7, t) for i, t in texts.items()], "key long, doc_id long, text string")
    got = {r["key"]: r["component"] for r in near_copies.near_copies(df).collect()}
    assert got == brute_components(texts) and len(set(got.values())) > 10
    assert near_copies.near_copies(df.limit(0)).count() == 0


def test_rounds_start_from_the_components(spark, monkeypatch):
    """Rounds that find links join them to a link a node, not to all links of all rounds before; rounds without links join nothing."""
    from assayer.llm import near_copies

    for name, value in (("LEAST", 16), ("TILE", 5), ("KEEP", 1), ("SHELF", 64)):
        monkeypatch.setattr(near_copies, name, value)
    compared, components, links, joined = near_copies._compared, near_copies.connected_components, [], []

    def counted_links(*args):
        out = compared(*args)
        links.append(out.count())
        return out

    def counted_edges(edges):
        joined.append(edges.filter("a <> b").distinct().count())
        return components(edges)

    monkeypatch.setattr(near_copies, "_compared", counted_links)
    monkeypatch.setattr(near_copies, "connected_components", counted_edges)
    rng = random.Random(16)
    base = [f"w{rng.randrange(100_000)}" for _ in range(80)]
    texts = {}
    for key in range(60):
        words = list(base)
        for at in rng.sample(range(80), rng.randrange(4)):
            words[at] = f"w{rng.randrange(100_000)}"
        texts[key] = " ".join(words)
    df = spark.createDataFrame([(i, 7, t) for i, t in texts.items()], "key long, doc_id long, text string")
    assert {r["key"]: r["component"] for r in near_copies.near_copies(df).collect()} == brute_components(texts)
    found = [n for n in links[1:] if n]
    assert 0 in links[1:] and len(joined) == 1 + len(found), (links, joined)
    assert all(edges < len(texts) + new for edges, new in zip(joined[1:], found)), (links, joined)


def test_stage_against_brute_force(spark):
    """The stage on whole documents: one row of each group, that of smallest id."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    part = brute_components({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == set(part.values())


def long_near_copies(count):
    """Pairs of long texts that differ in a word or more, of SimHash fingerprints 1 or 2 bits apart."""
    from assayer.llm.simhash import fingerprint

    rng, found = random.Random(3), []
    while len(found) < count:
        words = [f"w{rng.randrange(10_000)}" for _ in range(800)]
        other = [*words[:-1], "changed"]
        a, b = " ".join(words), " ".join(other)
        if 1 <= (fingerprint(a.encode(), 5) ^ fingerprint(b.encode(), 5)).bit_count() <= 2:
            found.append((a, b))
    return found


def test_simhash_finds_near_copies(spark, monkeypatch):
    """The stage links by operator 7's fingerprints where no bucket is shared, and checks unlike texts of one fingerprint."""
    from pyspark.sql import functions as F

    from assayer.llm import near_copies

    signatures = near_copies._signatures
    monkeypatch.setattr(near_copies, "_signatures", lambda df: signatures(df).withColumn("buckets", F.array(*[F.xxhash64("h1", "h2", F.lit(i)) for i in range(near_copies.BANDS)])))
    one = "p p p p p"  # its shingle is most of the next text's, which has the same fingerprint
    texts = [one, " ".join([one] * 20 + [f"q{i}" for i in range(50)])] + [t for pair in long_near_copies(6) for t in pair]
    assert [r[0] for r in survivors(spark, list(enumerate(texts)))] == [0, 1, 2, 4, 6, 8, 10, 12]


def test_simhash_pairs(spark):
    """The fingerprints are operator 7's; each node meets the smallest of its fingerprint, that one the smallest near it."""
    from assayer.llm import near_copies
    from assayer.llm.simhash import fingerprint

    for text in ("", "one two", "a b c d e f", "a b c d e " * 20, "x " * 70_000 + "y z"):
        assert near_copies.signature(text.encode())[1] == fingerprint(text.encode(), 5)
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += prints[:10] + [p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for p in prints * 3]
    order = rng.sample(range(1000), len(prints))
    nodes = dict(zip(order, prints))
    least = {}
    for n, p in sorted(nodes.items()):
        least.setdefault(p, n)
    want = {(least[p], n) for n, p in nodes.items() if n != least[p]}
    for p in least:
        near = [least[q] for q in least if 1 <= (p ^ q).bit_count() <= 2]
        want |= {tuple(sorted((least[p], min(near))))} if near else set()
    df = spark.createDataFrame([(n, p - 2**64 if p >> 63 else p) for n, p in nodes.items()], "node long, fp long")
    assert {tuple(r) for r in near_copies._by_simhash(df).collect()} == want and len(want) > 50
