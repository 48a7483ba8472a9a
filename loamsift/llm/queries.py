"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from loamsift.llm import chat, decontamination, fingerprints, html, packing, repeats, secrets, simhash, token_blocks, toxicity

QUERIES = {
    "op1_html": html.op1_html,
    "op2_repeats": repeats.op2_repeats,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_secrets": secrets.op5_secrets,
    "op6_packing": packing.op6_packing,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_token_blocks": token_blocks.op8_token_blocks,
    "op9_chat": chat.op9_chat,
    "op10_simhash": simhash.op10_simhash,
}

ORACLES = {"op4_fingerprints": fingerprints.op4_sql()}
