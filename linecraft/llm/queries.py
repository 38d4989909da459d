"""The queries of the document operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, convrepair, crosstoken, ctw, decontam, jaccard, language, licenses, linededup, mixing, quality, repeats, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1,
    "op2_ctw": ctw.op2,
    "op3_language": language.op3,
    "op4_jaccard_join": jaccard.op4,
    "op5_decontamination": decontam.op5,
    "op6_mixing": mixing.op6,
    "op7_licenses": licenses.op7,
    "op8_line_dedup": linededup.op8,
    "op9_suffix_array": repeats.op9,
    "op10_quality": quality.op10,
    "op11_conversation_repair": convrepair.op11,
    "op12_cross_tokenizer": crosstoken.op12,
    "op13_bpe": bpe.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": jaccard.ORACLE,
    "op5_decontamination": decontam.ORACLE,
    "op7_licenses": licenses.ORACLE,
    "op8_line_dedup": linededup.ORACLE,
}
