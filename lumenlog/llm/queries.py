"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op2_byte_bpe
from .license_scan import OP3_SQL, op3_license_scan
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import OP5_SQL, op5_mixing
from .multi_index import OP10_SQL, op10_embedding_near_dedup
from .ngram_jaccard import OP4_SQL, op4_ngram_jaccard
from .preference_quality import op9_quality_classifier
from .quality_rules import OP1_SQL, op1_quality_rules
from .secret_scan import OP8_SQL, op8_secret_scan
from .site_style import op7_html_extraction
from .suffix_merge import OP13_SQL, op13_suffix_dedup
from .turn_repair import OP11_SQL, op11_turn_repair
from .url_filter import op6_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_byte_bpe, op3_license_scan, op4_ngram_jaccard, op5_mixing, op6_url_filter, op7_html_extraction, op8_secret_scan, op9_quality_classifier, op10_embedding_near_dedup, op11_turn_repair, op12_merkle_manifest, op13_suffix_dedup)
}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op3_license_scan": OP3_SQL,
    "op4_ngram_jaccard": OP4_SQL,
    "op5_mixing": OP5_SQL,
    "op8_secret_scan": OP8_SQL,
    "op10_embedding_near_dedup": OP10_SQL,
    "op11_turn_repair": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_suffix_dedup": OP13_SQL,
}
