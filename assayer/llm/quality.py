"""Quality classifier with supervised subword embeddings.

A document is the plain mean of learned vectors: one for each word, for each of the word's character
n-grams, for each pair of neighbouring words, and one for the document's end, all hashed into a fixed
number of buckets. A softmax over two classes stands on the mean. Numpy trains vectors and softmax by
stochastic gradient descent on a bounded sample of labelled rows. For scoring, a bucket's vector
counts only by its difference of the two class outputs, one number a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import map_arrow, quoted, slices

#: An odd multiplier for polynomial hashes modulo 2**64, its inverse, and one to mix bits with.
BASE = 0x100000001B3
UNBASE = pow(BASE, -1, 1 << 64)
MIX = 0x9E3779B97F4A7C15
#: Code points of a text that are worked on at a time, at some 100 bytes each.
STRETCH = 1 << 18


@dataclass(frozen=True)
class Settings:
    """``sample``: at most so many labelled documents are trained on, those of least hash of their id.

    ``sample_bytes``: longer texts are not trained on, which bounds what reaches the driver; they are scored whole.
    ``steps``: so many documents are shown in training, in whole passes over the sample.
    """

    sample: int = 3000
    sample_bytes: int = 1 << 18
    buckets: int = 1 << 18
    dim: int = 16
    min_gram: int = 3
    max_gram: int = 4
    steps: int = 18_000
    rate: float = 0.6
    seed: int = 7


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo 2**64."""
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)


def feature_parts(text: str, settings: Settings) -> Iterator[np.ndarray]:
    """Buckets of all features of a whole text, repeats included, by stretches of the text.

    Words are runs of code points above U+0020. An n-gram may take the blank before or behind its word
    as a mark of the word's end. A word that follows itself is one feature, whatever the word. What crosses a stretch's end is carried over: the last code points, the
    hash of a word that is still open, and the last whole word. So a text of any length, in one word or
    many, has the features it would have in one piece and takes the same memory.
    """
    u = np.uint64
    base, blank, none = u(BASE), np.full(1, 32, np.uint64), np.zeros(0, np.uint64)
    tail, last_word = none, none
    open_hash = open_power = None  # of a word that reaches the last stretch's end
    yield _bucket(np.array([1], u), settings)  # the document's end
    for at in range(0, len(text) + 1, STRETCH):
        fresh = np.frombuffer(text[at : at + STRETCH].encode("utf-32-le", "surrogatepass"), np.uint32).astype(u)
        fresh = np.concatenate((blank if not at else none, np.maximum(fresh, blank), blank if at + STRETCH > len(text) else none))
        found = []
        with np.errstate(over="ignore"):
            points = np.concatenate((tail, fresh))
            inner, n = points > 32, len(points)
            rolling, whole = points[: max(0, n - 1)] * base + points[1:], None
            for size in range(3, settings.max_gram + 1):
                rolling = rolling[: max(0, n - size + 1)] * base + points[size - 1 :]
                middle = inner[size - 2 : max(0, n - 1)]
                whole = middle if whole is None else whole[: len(middle)] & middle
                if size >= settings.min_gram:
                    new = slice(max(0, len(tail) - size + 1), None)  # grams that end in the tail have been counted
                    found.append(rolling[new][whole[new]] + u(size))
            tail = points[max(0, n - settings.max_gram + 1) :]

            inner, n = fresh > 32, len(fresh)
            starts = np.flatnonzero(inner & ~np.concatenate(([False], inner[:-1])))
            ends = np.flatnonzero(inner & ~np.concatenate((inner[1:], [False]))) + 1
            powers, backs = _powers(BASE, n), _powers(UNBASE, n)
            sums = np.concatenate((np.zeros(1, u), np.cumsum(fresh * powers[:n], dtype=u)))
            words, reach = (sums[ends] - sums[starts]) * backs[starts], powers[ends - starts]
            if open_hash is not None and n and inner[0]:
                words[0], reach[0] = open_hash + words[0] * open_power, open_power * reach[0]
            elif open_hash is not None and n:
                words, reach = np.concatenate(([open_hash], words)), np.concatenate(([open_power], reach))
            if n:
                open_hash = open_power = None
                if inner[-1]:
                    open_hash, open_power, words = words[-1], reach[-1], words[:-1]
            words = words * u(MIX)
            found.append(words + u(0x51))
            row = np.concatenate((last_word, words))
            found.append(np.where(row[:-1] == row[1:], u(2), (row[:-1] ^ (row[:-1] >> u(31))) * base + row[1:]))
            last_word = row[-1:]
        yield _bucket(np.concatenate(found), settings)


def _bucket(features: np.ndarray, settings: Settings) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((features * np.uint64(MIX) >> np.uint64(32)) % np.uint64(settings.buckets)).astype(np.int64)


def feature_buckets(text: str, settings: Settings) -> np.ndarray:
    """All of :func:`feature_parts` at once, for texts of bounded length."""
    return np.concatenate(list(feature_parts(text, settings)))


def document(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    found, n = np.unique(feature_buckets(text, settings), return_counts=True)
    return found, (n / n.sum()).astype(np.float32)


def documents(texts: list[str], settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """:func:`document` of each text, as views of two long arrays.

    An array for each text would be thousands of small pieces of the heap, which the process keeps for good
    once they are freed; long arrays are mapped apart and go back to the system.
    """
    buckets, shares, ends = np.empty(1 << 22, np.uint32), np.empty(1 << 22, np.float32), [0]
    for text in texts:
        found, share = document(text, settings)
        at, end = ends[-1], ends[-1] + len(found)
        while end > len(buckets):
            buckets, shares = (np.concatenate((x, np.empty_like(x))) for x in (buckets, shares))
        buckets[at:end], shares[at:end] = found, share
        ends.append(end)
    return [(buckets[a:b], shares[a:b]) for a, b in zip(ends, ends[1:])]


def train(texts: list[str], labels: list[int], settings: Settings = Settings()) -> np.ndarray:
    """One number a bucket: the class-1 output less the class-0 output of its vector. No texts give zeros."""
    docs = documents(texts, settings)
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1 / settings.dim, 1 / settings.dim, (settings.buckets, settings.dim)).astype(np.float32)
    out = np.zeros((settings.dim, 2), np.float32)
    passes = -(-settings.steps // len(docs)) if docs else 0
    steps, done = passes * len(docs), 0
    for _ in range(passes):
        for i in rng.permutation(len(docs)):
            rate = settings.rate * (1 - done / steps)
            done += 1
            buckets, share = docs[i]
            rows = vectors[buckets]
            mean = share @ rows
            logits = mean @ out
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            # Steps follow the bucket's share, scaled so that a document moves its mean by the rate.
            vectors[buckets] -= rate * np.outer(share / (share @ share), back) * np.float32(0.5)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64)


def score(text: str, weights: np.ndarray, settings: Settings) -> float:
    """The softmax's share of class 1 for a whole text."""
    total = n = 0
    for found in feature_parts(text, settings):
        total, n = total + weights[found].sum(), n + len(found)
    return float(1 / (1 + np.exp(-np.clip(total / n, -40, 40))))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> list[tuple[str, int]]:
    """(text, label) of the training sample: labelled documents outside the held-out fold.

    At most ``settings.sample`` ids, those of least hash. Labels other than 0 and 1 are ignored; of
    several labels of an id the least counts, of several texts that of least hash. Only these rows reach the
    driver. Null ids are not trained on.
    """
    key = F.col("doc_id").cast("string")
    usable = labels.filter("quality in (0, 1) and doc_id is not null").filter(F.crc32(key.cast("binary")) % folds != 0)
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    found = found.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "quality").filter(F.octet_length("text") <= settings.sample_bytes)
    single = found.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    rows = sorted((r["doc_id"], r["text"], r["quality"]) for r in single.collect())
    return [(t, q) for _, t, q in rows]


def quality_scores(df: DataFrame, weights: np.ndarray, settings: Settings = Settings(), text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows of ``df`` with a double ``out`` (0 to 1); a column of that name is replaced.

    Whole texts are scored; null text counts as empty. Empty texts have the score of the document's end alone.
    Repeated rows and null ids are kept, an empty table gives no rows. A worker holds the texts of about
    16 MB of rows, or one longer text, and some 30 MB for the stretch it works on.
    """
    df = df.drop(out)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                yield {c: part.column(i) for i, c in enumerate(df_columns)} | {out: [score(t or "", weights, settings) for t in part.column(at).to_pylist()]}

    df_columns = df.columns
    ddl = ", ".join(f"{quoted(c)} {t}" for c, t in df.dtypes)
    return map_arrow(df, run, f"{ddl}, `{out}` double")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Train on the bounded sample; without labelled rows all scores are 0.5."""
    rows = training_rows(docs, labels, settings)
    return train([t for t, _ in rows], [q for _, q in rows], settings)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model trained on labels outside the held-out fifth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality_scores(docs, weights)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
