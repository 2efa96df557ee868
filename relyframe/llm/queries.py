"""The queries of the training-data operators, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relyframe.llm import alignment, chat, decontaminate, html_text, licenses, packing, quality, secrets, sharding, simhash, spelling, substring, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_warc": warc.op2_warc,
    "op3_chat_format": chat.op3_chat_format,
    "op4_packing": packing.op4_packing,
    "op5_substring": substring.op5_substring,
    "op6_html_text": html_text.op6_html_text,
    "op7_sharding": sharding.op7_sharding,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_simhash": simhash.op10_simhash,
    "op11_alignment": alignment.op11_alignment,
    "op12_secrets": secrets.op12_secrets,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.OP2_SQL,
    "op3_chat_format": chat.OP3_SQL,
    "op5_substring": substring.OP5_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op9_decontamination": decontaminate.OP9_SQL,
    "op12_secrets": secrets.OP12_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
