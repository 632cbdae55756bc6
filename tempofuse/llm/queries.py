"""The queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tempofuse.llm import byte_bpe, collocations, decontam, html_text, line_dedup, near_dedup, packing, pii, quality, resample, sharding, suffix_dedup, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_near_dedup": near_dedup.query,
    "op2_pii": pii.query,
    "op3_html_text": html_text.query,
    "op4_sharding": sharding.query,
    "op5_packing": packing.query,
    "op6_line_dedup": line_dedup.query,
    "op7_decontam": decontam.query,
    "op8_toxicity": toxicity.query,
    "op9_quality": quality.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_resample": resample.query,
    "op12_byte_bpe": byte_bpe.query,
    "op13_collocations": collocations.query,
    # the parts of operators 2 and 9 that SQL can express
    "pii_base_counts": pii.base_query,
    "quality_base_counts": quality.base_query,
}
SQL = {
    "op1_near_dedup": near_dedup.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op11_resample": resample.SQL,
    "op13_collocations": collocations.SQL,
    "pii_base_counts": pii.BASE_SQL,
    "quality_base_counts": quality.BASE_SQL,
}
