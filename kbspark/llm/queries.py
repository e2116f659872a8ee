"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kbspark.llm import bpe, imatch, kdshards, lexical, licenses, linededup, mixing, pii, secrets, simhash, tokenalign, toxicity, vptree

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_secrets": secrets.op1,
    "op2_pii": pii.op2,
    "op3_simhash": simhash.op3,
    "op4_imatch": imatch.op4,
    "op5_vptree": vptree.op5,
    "op6_mixing": mixing.op6,
    "op7_bpe": bpe.op7,
    "op8_line_dedup": linededup.op8,
    "op9_toxicity": toxicity.op9,
    "op10_licenses": licenses.op10,
    "op11_lexical": lexical.op11,
    "op12_token_alignment": tokenalign.op12,
    "op13_kd_shards": kdshards.op13,
}
SQL: dict[str, str] = {"op5_vptree": vptree.SQL5, "op11_lexical": lexical.SQL11}
