"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm.byte_bpe import op9_byte_bpe
from curatrix.llm.ngram_join import op5_ngram_join
from curatrix.llm.topk import OP7_SQL, op7_topk
from curatrix.llm.language_id import op4_language_id
from curatrix.llm.toxicity import op8_toxicity
from curatrix.llm.media import op10_media
from curatrix.llm.token_files import op2_token_files
from curatrix.llm.suffix_dedup import op6_suffix_dedup
from curatrix.llm.mixing import op1_mixing
from curatrix.llm.ranked_search import OP11_SQL, op11_ranked_search
from curatrix.llm.site_quality import op3_site_quality
from curatrix.llm.whitening import op13_whitening
from curatrix.llm.piece_bpe import op12_piece_bpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_site_quality": op3_site_quality,
    "op1_mixing": op1_mixing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op2_token_files": op2_token_files,
    "op10_media": op10_media,
    "op8_toxicity": op8_toxicity,
    "op4_language_id": op4_language_id,
    "op7_topk": op7_topk,
    "op5_ngram_join": op5_ngram_join,
    "op9_byte_bpe": op9_byte_bpe,
    "op11_ranked_search": op11_ranked_search,
    "op12_piece_bpe": op12_piece_bpe,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op7_topk": OP7_SQL,
    "op11_ranked_search": OP11_SQL,
}
