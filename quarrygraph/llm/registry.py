"""Queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from quarrygraph.llm import op10_pieces, op1_language, op2_quality, op3_neighbours, op4_factorisation, op5_suffixes, op6_lines, op7_warc, op8_packing, op9_simhash


def queries() -> dict:
    return {
        "op10_pieces": op10_pieces.op10_pieces,
        "op1_language": op1_language.op1_language,
        "op2_quality": op2_quality.op2_quality,
        "op3_neighbours": op3_neighbours.op3_neighbours,
        "op4_factorisation": op4_factorisation.op4_factorisation,
        "op5_suffixes": op5_suffixes.op5_suffixes,
        "op6_lines": op6_lines.op6_lines,
        "op7_warc": op7_warc.op7_warc,
        "op8_packing": op8_packing.op8_packing,
        "op9_simhash": op9_simhash.op9_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": op2_quality.ORACLE, "op6_lines": op6_lines.ORACLE, "op7_warc": op7_warc.ORACLE}
