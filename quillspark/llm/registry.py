"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, infill, jaccard, mixing, resampling, sharding, substring_dedup
from .chat import op5_chat_format
from .decontaminate import op3_decontamination
from .infill import op13_infill
from .jaccard import op9_jaccard_join
from .licenses import op7_license_scan
from .media import op4_media_columns
from .mixing import op8_source_mixing
from .quality import op2_quality_classifier
from .resampling import op12_resampling
from .sharding import op11_sharding
from .substring_dedup import op1_substring_dedup
from .token_files import op10_token_files
from .urls import op6_url_filter

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontamination": op3_decontamination,
    "op4_media_columns": op4_media_columns,
    "op5_chat_format": op5_chat_format,
    "op6_url_filter": op6_url_filter,
    "op7_license_scan": op7_license_scan,
    "op8_source_mixing": op8_source_mixing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_files": op10_token_files,
    "op11_sharding": op11_sharding,
    "op12_resampling": op12_resampling,
    "op13_infill": op13_infill,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op3_decontamination": decontaminate.ORACLE_SQL,
    "op5_chat_format": chat.ORACLE_SQL,
    "op8_source_mixing": mixing.ORACLE_SQL,
    "op9_jaccard_join": jaccard.ORACLE_SQL,
    "op11_sharding": sharding.ORACLE_SQL,
    "op12_resampling": resampling.ORACLE_SQL,
    "op13_infill": infill.ORACLE_SQL,
}
