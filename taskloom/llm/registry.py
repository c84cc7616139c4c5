"""Queries of this subpackage by name, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import alignment, bpe, chat, decontamination, language, licenses, minhash, mixing, neighbours, ranked, secrets, suffix_dedup, url_filters


def queries() -> dict:
    return {
        "op1_hash_forest": neighbours.op1_hash_forest,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_url_filters": url_filters.op3_url_filters,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_chat_format": chat.op6_chat_format,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_minhash": minhash.op8_minhash,
        "op9_secret_scan": secrets.op9_secret_scan,
        "op10_language": language.op10_language,
        "op11_byte_bpe": bpe.op11_byte_bpe,
        "op12_token_alignment": alignment.op12_token_alignment,
        "op13_ranked_search": ranked.op13_ranked_search,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op3_url_filters": url_filters.SQL,
        "op4_decontamination": decontamination.SQL,
        "op6_chat_format": chat.SQL,
        "op7_mix_sources": mixing.SQL,
        "op13_ranked_search": ranked.SQL,
    }
