"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from postlens.llm import ann, debruijn_dedup, decontaminate, html_extract, langid, merkle, minhash, packing, secrets, suffix_dedup, toxicity, warc, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_html_extract": html_extract.op2,
    "op3_decontamination": decontaminate.op3,
    "op4_ann": ann.op4,
    "op5_secrets": secrets.op5,
    "op6_suffix_dedup": suffix_dedup.op6,
    "op7_packing": packing.op7,
    "op8_debruijn_dedup": debruijn_dedup.op8,
    "op9_langid": langid.op9,
    "op10_minhash": minhash.op10,
    "op11_merkle": merkle.op11,
    "op12_whitening": whitening.op12,
    "op13_warc": warc.op13,
}

ORACLE_SQL = {
    "op3_decontamination": decontaminate.OP3_SQL,
    "op6_suffix_dedup": suffix_dedup.OP6_SQL,
    "op8_debruijn_dedup": debruijn_dedup.OP8_SQL,
    "op10_minhash": minhash.OP10_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op13_warc": warc.OP13_SQL,
}
