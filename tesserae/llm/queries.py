"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tesserae.llm import chat, decontaminate, htmltext, licenses, merkle, ngram_join, packing, periods, quality, secrets, simhash, substrings, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_warc": warc.op4_warc,
    "op5_chat_format": chat.op5_chat_format,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_html_text": htmltext.op10_html_text,
    "op11_periods": periods.op11_periods,
    "op12_simhash": simhash.op12_simhash,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES = {
    "op2_ngram_join": ngram_join.ORACLE,
    "op3_secret_scan": secrets.ORACLE,
    "op4_warc": warc.ORACLE,
    "op5_chat_format": chat.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op7_substring_dedup": substrings.ORACLE,
    "op8_license_scan": licenses.ORACLE,
    "op9_quality_rules": quality.ORACLE,
    "op10_html_text": htmltext.ORACLE,
    "op11_periods": periods.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
