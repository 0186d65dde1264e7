"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, chat, decontaminate, langid, mixing, periodic, quality, secrets, simhash, substrings, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.query,
        "op2_toxicity": toxicity.query,
        "op3_format_chats": chat.query,
        "op4_simhash_dedup": simhash.query,
        "op5_language_id": langid.query,
        "op6_quality": quality.query,
        "op7_decontaminate": decontaminate.query,
        "op8_substring_dedup": substrings.query,
        "op9_secrets": secrets.query,
        "op10_nearest": ann.query,
        "op11_whitening": whitening.query,
        "op12_warc": warc.query,
        "op13_periodic_runs": periodic.query,
    }


def oracle_sql() -> dict:
    return {"op1_mix_sources": mixing.SQL, "op3_format_chats": chat.SQL, "op8_substring_dedup": substrings.SQL, "op10_nearest": ann.SQL, "op12_warc": warc.SQL}
