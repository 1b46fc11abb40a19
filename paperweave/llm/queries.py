"""The registered queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from .bpe import op3_bpe
from .centroids import OP12_SQL, op12_centroid_clusters
from .conversations import op13_conversation_repair
from .html_extract import op2_html_text
from .licenses import op8_license_scan
from .line_dedup import OP11_SQL, op11_line_dedup
from .media import op9_media
from .mixing import OP1_SQL, op1_mixing
from .neardup import op5_neardup
from .quality_model import op7_quality_model
from .quality_rules import op6_quality_rules
from .secrets import OP4_SQL, op4_secrets
from .suffix_dedup import op10_suffix_dedup


def queries() -> dict:
    return {
        "op1_mixing": op1_mixing,
        "op2_html_text": op2_html_text,
        "op3_bpe": op3_bpe,
        "op4_secrets": op4_secrets,
        "op5_neardup": op5_neardup,
        "op6_quality_rules": op6_quality_rules,
        "op7_quality_model": op7_quality_model,
        "op8_license_scan": op8_license_scan,
        "op9_media": op9_media,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_line_dedup": op11_line_dedup,
        "op12_centroid_clusters": op12_centroid_clusters,
        "op13_conversation_repair": op13_conversation_repair,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    own = {"op1_mixing": OP1_SQL, "op4_secrets": OP4_SQL, "op11_line_dedup": OP11_SQL, "op12_centroid_clusters": OP12_SQL}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
