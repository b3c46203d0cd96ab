"""The queries of the ten operators and their SQL. The pipeline is added by what calls it."""

from __future__ import annotations

from rowloom.llm import bpe, chat, decontaminate, htmltext, langid, licenses, neardup, quality_model, quality_rules, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op3_quality_model": quality_model.op3_quality_model,
    "op2_html": htmltext.op2_html,
    "op4_licenses": licenses.op4_licenses,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_langid": langid.op6_langid,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_chat": chat.op8_chat,
    "op9_neardup": neardup.op9_neardup,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "quality_rules_by_kind": quality_rules.quality_rules_by_kind,
}

ORACLE_SQL = {
    "op4_licenses": licenses.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op8_chat": chat.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "quality_rules_by_kind": quality_rules.ORACLE_BY_KIND,
}
