"""Registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from weir.llm.decontamination import op10_decontamination
from weir.llm.language_id import op9_language_id
from weir.llm.packing import op1_packing
from weir.llm.quality import op3_quality
from weir.llm.secrets import op2_secrets
from weir.llm.sharding import op5_sharding
from weir.llm.simhash import op8_simhash
from weir.llm.substring_dedup import OP4_SQL, op4_substring_dedup
from weir.llm.topk_search import OP6_SQL, op6_topk_search
from weir.llm.url_filters import OP7_SQL, op7_url_filters

QUERIES = {
    "op1_packing": op1_packing,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_sharding": op5_sharding,
    "op6_topk_search": op6_topk_search,
    "op7_url_filters": op7_url_filters,
    "op8_simhash": op8_simhash,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
}

ORACLES = {"op4_substring_dedup": OP4_SQL, "op6_topk_search": OP6_SQL, "op7_url_filters": OP7_SQL}
