"""The subpackage's queries and SQL, as the entry module registers them."""

from __future__ import annotations

from scatterlake.llm import ann, decontaminate, forest, html, language, paragraphs, pieces, quality, suffix, urls

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_paragraphs": paragraphs.op3_paragraphs,
    "op4_suffix": suffix.op4_suffix,
    "op5_pieces": pieces.op5_pieces,
    "op6_forest": forest.op6_forest,
    "op7_language": language.op7_language,
    "op8_urls": urls.op8_urls,
    "op9_html": html.op9_html,
    "op10_quality": quality.op10_quality,
}
#: What SQL expresses; tests hold the others against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op3_paragraphs": paragraphs.ORACLE,
    "op4_suffix": suffix.ORACLE,
    "op6_forest": forest.ORACLE,
    "op8_urls": urls.ORACLE,
}
