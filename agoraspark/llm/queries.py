"""The queries of the operators of this subpackage, and of the pipeline."""

from __future__ import annotations

import corpus_pipeline
from agoraspark.llm import oracles
from agoraspark.llm.decontamination import op2
from agoraspark.llm.filter_audit import op13
from agoraspark.llm.line_dedup import op1
from agoraspark.llm.merkle import op12
from agoraspark.llm.mixing import op6
from agoraspark.llm.neardup import op9
from agoraspark.llm.pii import op3
from agoraspark.llm.repeats import op10
from agoraspark.llm.sharding import op4
from agoraspark.llm.topk import op8
from agoraspark.llm.toxicity import op5
from agoraspark.llm.url_filters import op7
from agoraspark.llm.vectors import op11

QUERIES = {
    "op1_line_dedup": op1,
    "op2_decontamination": op2,
    "op3_pii": op3,
    "op4_sharding": op4,
    "op5_toxicity": op5,
    "op6_mixing": op6,
    "op7_url_filters": op7,
    "op8_topk_search": op8,
    "op9_near_dedup": op9,
    "op10_repeats": op10,
    "op11_vector_dedup": op11,
    "op12_merkle_manifest": op12,
    "op13_filter_audit": op13,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": oracles.OP1,
    "op2_decontamination": oracles.OP2,
    "op6_mixing": oracles.OP6,
    "op7_url_filters": oracles.OP7,
    "op8_topk_search": oracles.OP8,
    "op9_near_dedup": oracles.OP9,
    "op11_vector_dedup": oracles.OP11,
    "op12_merkle_manifest": oracles.OP12,
    "op13_filter_audit": oracles.OP13,
}
