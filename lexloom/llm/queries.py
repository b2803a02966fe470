"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from lexloom.llm import ann, line_dedup, mixing, near_dups, packing, pii, quality, secrets, token_files, warc

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op3_token_files": token_files.op3_token_files,
    "op6_pack": packing.op6_pack,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op7_warc": warc.op7_warc,
    "op8_near_dups": near_dups.op8_near_dups,
    "op4_quality": quality.op4_quality,
    "op5_pii": pii.op5_pii,
    "op9_secrets": secrets.op9_secrets,
    "op2_neighbours": ann.op2_neighbours,
}
ORACLE: dict[str, str] = mixing.ORACLE | line_dedup.ORACLE | quality.ORACLE
