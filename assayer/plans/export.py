"""Outcome documents flattened to seven relations, as DataFrames.

One document a row is read as text, in parallel; both layouts of outcomes are understood: the current
one, and the older with a single ``metric_id`` and no records. Fields that a document lacks are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.sources.files import write_text

# The relations' columns behind the four that identify an outcome.
IDS = ("file_name", "case_id", "plan_id", "dataset_path")
COLUMN_QUALITY = {"field_count": "long", "usable_field_count": "long", "constant_field_count": "long", "missing_field_count": "long", "mean_non_null_ratio": "double", "mean_numeric_non_null_ratio": "double", "mean_unique_ratio": "double", "quality_score": "double"}
PEARSON = {"pair_count": "long", "mean_absolute_correlation": "double"}
TIMESTAMP = {"packet_count": "long", "capture_duration_seconds": "double", "backwards_jump_count": "long", "zero_delta_count": "long", "large_gap_count": "long", "large_gap_threshold_seconds": "double", "gap_count": "long", "mean_gap_seconds": "double", "max_gap_seconds": "double", "status": "string"}
PROTOCOL = {"packet_count": "long", "valid_packet_count": "long", "protocol_validity_ratio": "double", "invalid_ip_count": "long", "invalid_port_count": "long", "protocol_mismatch_count": "long", "zero_length_packet_count": "long", "suspicious_tcp_flag_count": "long", "status": "string"}
# End of fixed values.


def _fields(columns: dict[str, str]) -> str:
    return ", ".join(f"{k}: {t}" for k, t in columns.items())


PAIR = "fields: array<string>, value: double, overlap_non_null_count: long"
SCHEMA = (
    "struct<case_id: string, plan_id: string, dataset_path: string, status: string, metric_ids: array<string>, "
    "metric_results: array<struct<metric_id: string, status: string, error: string>>, test_results: struct<"
    f"column_quality_profile: struct<summary: struct<{_fields(COLUMN_QUALITY)}>>, "
    f"pearson_correlation_profile: struct<summary: struct<{_fields(PEARSON)}, pairs: array<struct<{PAIR}>>>>, "
    f"timestamp_coherence_profile: struct<{_fields(TIMESTAMP)}>, protocol_validity_profile: struct<{_fields(PROTOCOL)}>>>"
)


def read_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """file_name and the parsed document of each ``*.json`` in a folder."""
    texts = spark.read.text(f"{folder.rstrip('/')}/*.json", wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"), "value")
    return parse_outcomes(texts)


def parse_outcomes(texts: DataFrame) -> DataFrame:
    """``texts`` has file_name and value, a document's text. Bare NaN is a number, as writers of such documents emit it."""
    parsed = F.from_json("value", SCHEMA, {"allowNonNumericNumbers": "true"})
    return texts.select("file_name", parsed.alias("d")).select("file_name", "d.*")


def _ids() -> list[Column]:
    return [F.col(c) for c in IDS]


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.select(*_ids(), "status", F.concat_ws("|", "metric_ids").alias("metric_ids"))


def metric_results(outcomes: DataFrame) -> DataFrame:
    return outcomes.select(*_ids(), F.explode("metric_results").alias("m")).select(*_ids(), "m.metric_id", F.col("m.status").alias("metric_status"), "m.error")


def _struct(outcomes: DataFrame, path: str, columns: dict[str, str]) -> DataFrame:
    found = outcomes.filter(F.col(path.removesuffix(".summary")).isNotNull())
    return found.select(*_ids(), *[F.col(f"{path}.{c}").alias(c) for c in columns])


def column_quality_summary(outcomes: DataFrame) -> DataFrame:
    return _struct(outcomes, "test_results.column_quality_profile.summary", COLUMN_QUALITY)


def pearson_summary(outcomes: DataFrame) -> DataFrame:
    return _struct(outcomes, "test_results.pearson_correlation_profile.summary", PEARSON)


def pearson_pairs(outcomes: DataFrame) -> DataFrame:
    pairs = outcomes.select(*_ids(), F.explode("test_results.pearson_correlation_profile.summary.pairs").alias("p"))
    return pairs.select(*_ids(), F.get("p.fields", F.lit(0)).alias("field_a"), F.get("p.fields", F.lit(1)).alias("field_b"), "p.value", "p.overlap_non_null_count")


def timestamp_summary(outcomes: DataFrame) -> DataFrame:
    return _struct(outcomes, "test_results.timestamp_coherence_profile", TIMESTAMP)


def protocol_summary(outcomes: DataFrame) -> DataFrame:
    return _struct(outcomes, "test_results.protocol_validity_profile", PROTOCOL)


RELATIONS = {
    "outcome_summary": outcome_summary,
    "metric_results": metric_results,
    "column_quality_summary": column_quality_summary,
    "pearson_summary": pearson_summary,
    "pearson_pairs": pearson_pairs,
    "timestamp_summary": timestamp_summary,
    "protocol_summary": protocol_summary,
}


def export(spark: SparkSession, folder: str, target: str) -> None:
    """Write the seven relations as ``<target>/<relation>.csv``, rows by file name (outcomes are few, each relation small).

    Both folders may be URIs.
    """
    outcomes = read_outcomes(spark, folder).cache()
    for name, make in RELATIONS.items():
        write_text(spark, f"{target.rstrip('/')}/{name}.csv", make(outcomes).orderBy("file_name").toPandas().to_csv(index=False))
    outcomes.unpersist()
