"""Queries of the training-data operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from . import alignment, ann, chat, collocations, decontaminate, lines, neardup, packing, quality, sharding, sql, substring, suffix, tokens

QUERIES = {
    "op1_tokens": tokens.op1_tokens,
    "op10_suffix": suffix.op10_suffix,
    "op4_neardup": neardup.op4_neardup,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op2_quality": quality.op2_quality,
    "op3_chat": chat.op3_chat,
    "op5_shards": sharding.op5_shards,
    "op7_pack": packing.op7_pack,
    "op8_ann": ann.op8_ann,
    "op9_substring": substring.op9_substring,
    "op11_lines": lines.op11_lines,
    "op12_collocations": collocations.op12_collocations,
    "op13_alignment": alignment.op13_alignment,
}

SQL = {"op3_chat": chat.OP3_SQL, "op4_neardup": sql.OP4, "op9_substring": sql.OP9, "op10_suffix": sql.OP10, "op12_collocations": sql.OP12}
