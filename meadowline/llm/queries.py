"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from meadowline.llm.chat import OP12_SQL, op12_chat
from meadowline.llm.clustering import OP13_SQL, op13_clustering
from meadowline.llm.decontaminate import op5_decontamination
from meadowline.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from meadowline.llm.filter_audit import OP11_SQL, op11_filter_audit
from meadowline.llm.licenses import op4_licenses
from meadowline.llm.near_dedup import op9_near_dedup
from meadowline.llm.packing import op8_packing
from meadowline.llm.pii import op1_pii
from meadowline.llm.quality import op6_quality
from meadowline.llm.secrets import op3_secrets
from meadowline.llm.sql import OP5_SQL, OP9_SQL
from meadowline.llm.token_counts import op10_token_counts
from meadowline.llm.token_files import op7_token_files

QUERIES = {
    "op1_pii": op1_pii,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_secrets": op3_secrets,
    "op4_licenses": op4_licenses,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_token_files": op7_token_files,
    "op8_packing": op8_packing,
    "op9_near_dedup": op9_near_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_filter_audit": op11_filter_audit,
    "op12_chat": op12_chat,
    "op13_clustering": op13_clustering,
}
SQL = {
    "op2_exact_dedup": OP2_SQL,
    "op5_decontamination": OP5_SQL,
    "op9_near_dedup": OP9_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_chat": OP12_SQL,
    "op13_clustering": OP13_SQL,
}
