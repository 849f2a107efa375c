"""The training-data queries and their SQL."""

from __future__ import annotations

from . import chat, decontam, linededup, minhash, mixing, quality_clf, quality_rules, secret_scan, toxicity, warc


def queries() -> dict:
    """Name to query, for ``__spark_entry__``."""
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_mix": mixing.op2_mix,
        "op3_decontaminate": decontam.op3_decontaminate,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_quality_classifier": quality_clf.op5_quality_classifier,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_line_dedup": linededup.op7_line_dedup,
        "op8_secret_scan": secret_scan.op8_secret_scan,
        "op9_minhash_dedup": minhash.op9_minhash_dedup,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    """Name to SQL, where SQL can express the query."""
    return {
        "op1_chat_format": chat.OP1_SQL,
        "op2_mix": mixing.OP2_SQL,
        "op3_decontaminate": decontam.OP3_SQL,
        "op6_quality_rules": quality_rules.OP6_SQL,
        "op7_line_dedup": linededup.OP7_SQL,
        "op9_minhash_dedup": minhash.OP9_SQL,
        "op10_warc": warc.OP10_SQL,
    }
