"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import WHITE, ascii_lower, hash128, hidden, materialize, salted, shown, with_salt


def line_key(line: Column) -> Column:
    """A line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """Drop lines whose key stands in at least ``min_docs`` documents, except in the smallest of them.

    Keys of fewer than ``min_chars`` code points are never dropped. A document is its id: rows of one
    id are one document for the counts, and a null id is a document that sorts before all others.

    :returns: all columns of ``df`` with the text replaced by the kept lines joined by newlines, and
        two longs ``counts``, its lines before and the dropped ones (columns of those names are replaced). Null text counts as
        one empty line and becomes the empty string. An empty table gives no rows.

    Only hashes travel: 128-bit line hashes with the id and position. Counts combine map-side, so a
    line that every document holds costs one row per task; the hashes that are dropped are salted
    when the lines are joined to them. The text itself is shuffled once, to meet its dropped positions.
    """
    rid = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    row_key = hash128("__d", F.struct(rid, text))
    named = df.drop(*counts)
    docs = named.select(*hidden(named, id_col, text_col))
    exploded = docs.select(rid.alias("__id"), *row_key, F.posexplode(F.split(text, "\n", -1)).alias("__pos", "__line"))
    lines = (
        exploded.withColumn("__line", line_key("__line"))
        .filter(F.char_length("__line") >= min_chars)
        .select("__id", "__d1", "__d2", "__pos", *hash128("__h", F.col("__line")))
    )
    lines = materialize(lines, "lines", spread=True)
    # The null id sorts first: compare (is not null, id).
    order = F.struct(F.col("__id").isNotNull().alias("known"), F.col("__id").alias("id"))
    if min_docs <= 2:
        found = lines.groupBy("__h1", "__h2").agg(F.min(order).alias("__first"), F.max(order).alias("__last"))
        found = found.filter(~F.col("__first").eqNullSafe(F.col("__last"))) if min_docs == 2 else found
    else:
        docs_of = lines.select("__h1", "__h2", order.alias("__o")).distinct()
        found = docs_of.groupBy("__h1", "__h2").agg(F.min("__o").alias("__first"), F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_docs)
    found = salted(found.select("__h1", "__h2", F.col("__first.id").alias("__keep")))
    hit = with_salt(lines, F.struct("__id", "__pos")).join(found, ["__h1", "__h2", "__salt"])
    hit = hit.filter(~F.col("__id").eqNullSafe(F.col("__keep")))
    drops = hit.groupBy("__d1", "__d2").agg(F.collect_set("__pos").alias("__drops"))
    kept = docs.select("*", *row_key).join(drops, ["__d1", "__d2"], "left")
    parts = F.split(text, "\n", -1)
    # Kept positions by hashing, so that long documents cost time in proportion to their lines.
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__drops"), lambda i: F.get(parts, i))
    rebuilt = F.when(F.col("__drops").isNull(), text).otherwise(F.array_join(left, "\n"))
    return kept.select(
        *[rebuilt.alias(text_col) if c == text_col else column for c, column in zip(named.columns, shown(named, id_col, text_col))],
        F.size(parts).cast("long").alias(counts[0]),
        F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias(counts[1]),
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of at least 10 code points that two documents hold stay only in the smaller doc_id."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(p) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, range(1, len(l) + 1) AS p FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k, min(doc_id) AS keep FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT d.doc_id, d.pos, d.line, coalesce(s.keep <> d.doc_id, false) AS gone FROM keyed d LEFT JOIN shared s USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
