"""The queries of this subpackage: opN_<name> for each operator N, and what SQL can say about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, dac, fim, line_dedup, mixing, near_dup, ngram_join, quality, search, secrets, suffix_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_near_dup": near_dup.op2_near_dup,
    "op3_ann": ann.op3_ann,
    "op4_lines": line_dedup.op4_lines,
    "op5_tokens": token_counts.op5_tokens,
    "op6_dac": dac.op6_dac,
    "op7_secrets": secrets.op7_secrets,
    "op8_mixing": mixing.op8_mixing,
    "op9_suffix": suffix_dedup.op9_suffix,
    "op10_quality": quality.op10_quality,
    "op11_fim": fim.op11_fim,
    "op12_search": search.op12_search,
    "op13_ngram_join": ngram_join.op13_ngram_join,
}

ORACLE_SQL: dict[str, str] = {"op4_lines": line_dedup.OP4_SQL, "op10_quality": quality.OP10_SQL, "op12_search": search.OP12_SQL, "op13_ngram_join": ngram_join.OP13_SQL}
