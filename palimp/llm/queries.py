"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from palimp.llm import completeness, defects, encoding, lookalike, mixing, splitting, terms, tokenizer

QUERIES = {
    "p1_found": lookalike.p1_found,
    "p1_classes": lookalike.p1_classes,
    "p1_changed": lookalike.p1_changed,
    "p2_found": defects.p2_found,
    "p2_defects": defects.p2_defects,
    "p3_found": terms.p3_found,
    "p3_terms": terms.p3_terms,
    "p4_found": completeness.p4_found,
    "p4_rates": completeness.p4_rates,
    "p4_baseline": completeness.p4_baseline,
    "p5_found": splitting.p5_found,
    "p5_pieces": splitting.p5_pieces,
    "p6_ids": tokenizer.p6_ids,
    "p7_mixture": mixing.p7_mixture,
    "p7_shares": mixing.p7_shares,
    "p8_found": encoding.p8_found,
    "p8_repaired": encoding.p8_repaired,
}
SQL: dict[str, str] = {**terms.SQL, **splitting.SQL}
