"""The corpus operators' queries, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from assayer.llm.embeddings import op2_embedding_dedup
from assayer.llm.line_dedup import OP4_SQL, op4_line_dedup
from assayer.llm.media import op6_media
from assayer.llm.mixing import op3_mixing
from assayer.llm.packing import op9_packing
from assayer.llm.quality import op10_quality
from assayer.llm.sharding import op1_histogram_shards
from assayer.llm.simhash import op7_simhash
from assayer.llm.token_counts import op8_token_counts
from assayer.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_histogram_shards": op1_histogram_shards,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_warc": op5_warc,
    "op6_media": op6_media,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": OP4_SQL,
    "op5_warc": OP5_SQL,
}
