"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.ball_tree import OP3_SQL, op3_topk
from strandlake.llm.bpe_codec import op5_bpe
from strandlake.llm.curve_packing import op7_packing
from strandlake.llm.importance import OP11_SQL, op11_resampling
from strandlake.llm.merge_index import OP8_SQL, op8_dedup
from strandlake.llm.merkle_audit import OP1_SQL, op1_fixity
from strandlake.llm.merkle_manifest import OP12_SQL, op12_manifest
from strandlake.llm.ngram_join import op6_ngram_join
from strandlake.llm.ngram_trie import op10_lm
from strandlake.llm.quote_links import op2_quotes
from strandlake.llm.rank_queue import op13_rank_queue
from strandlake.llm.rule_ensemble import op4_quality
from strandlake.llm.token_counts import op9_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = [op1_fixity, op2_quotes, op3_topk, op4_quality, op5_bpe, op6_ngram_join, op7_packing, op8_dedup, op9_token_counts, op10_lm, op11_resampling, op12_manifest, op13_rank_queue]
    return {query.__name__: query for query in listed}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the query; the others are tested against brute-force versions."""
    return {"op1_fixity": OP1_SQL, "op3_topk": OP3_SQL, "op8_dedup": OP8_SQL, "op11_resampling": OP11_SQL, "op12_manifest": OP12_SQL}
