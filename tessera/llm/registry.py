"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import ann, arrow_tokens, chat, fim, html, licenses, minhash, mixing, pii, quality, resample, warc, wfst

QUERIES = {
    "op1_pii_crf": pii.query,
    "op2_warc_index_merge": warc.query,
    "op3_weak_supervision": quality.query,
    "op4_arrow_tokens": arrow_tokens.query,
    "op5_circulant_minhash": minhash.query,
    "op6_mix_sources": mixing.query,
    "op7_layout_html": html.query,
    "op8_snapshot_collapse": chat.query,
    "op9_sentencepiece_wfst": wfst.query,
    "op10_learned_partitions": ann.query,
    "op11_fill_in_middle": fim.query,
    "op12_license_templates": licenses.query,
    "op13_importance_resampling": resample.query,
}
SQL = {
    "op2_warc_index_merge": warc.SQL,
    "op5_circulant_minhash": minhash.SQL,
    "op6_mix_sources": mixing.SQL,
    "op8_snapshot_collapse": chat.SQL,
    "op11_fill_in_middle": fim.SQL,
    "op12_license_templates": licenses.SQL,
    "op13_importance_resampling": resample.SQL,
}
