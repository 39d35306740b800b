"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontamination, jaccard, language_id, license_scan, media, mixing, pii, quality, substring_dedup, url_filter


def queries() -> dict:
    return {
        "op1_mix": mixing.op1_mix,
        "op2_pii": pii.op2_pii,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_webp": media.op6_webp,
        "op7_quality": quality.op7_quality,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_language_id": language_id.op9_language_id,
        "op10_jaccard_join": jaccard.op10_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_substring_dedup": substring_dedup.ORACLE_SQL,
        "op5_url_filter": url_filter.ORACLE_SQL,
        "op8_decontamination": decontamination.ORACLE_SQL,
        "op10_jaccard_join": jaccard.ORACLE_SQL,
    }
