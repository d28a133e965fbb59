"""Queries and SQL of this package, for the registry at the repository's top."""

from __future__ import annotations

from codeloom.llm import mixing, quality
from codeloom.llm.clips import op6_clips
from codeloom.llm.license_scan import op3_license_scan
from codeloom.llm.near_duplicates import op5_near_duplicates
from codeloom.llm.packing import op7_packing
from codeloom.llm.pitman_yor import op1_pitman_yor
from codeloom.llm.repeated_passages import op4_repeated_passages
from codeloom.llm.secret_scan import op8_secret_scan
from codeloom.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_mixing": mixing.op2_mixing,
    "op3_license_scan": op3_license_scan,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_clips": op6_clips,
    "op7_packing": op7_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality": quality.op9_quality,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {"op2_mixing": mixing.SQL, "op9_quality": quality.SQL}
