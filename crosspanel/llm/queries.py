"""Queries and SQL of the training-data operators, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import OP6_SQL, op6_exact_dedup
from .html_text import op2_html_text
from .language_id import op3_language_id
from .minhash import op7_minhash
from .packing import op10_packing
from .perplexity import op1_quality
from .pieces import op9_pieces
from .pii import op5_pii
from .substring_dedup import OP8_SQL, op8_substring_dedup
from .vector_search import OP4_SQL, op4_vector_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_html_text": op2_html_text,
        "op3_language_id": op3_language_id,
        "op4_vector_search": op4_vector_search,
        "op5_pii": op5_pii,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_minhash": op7_minhash,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_pieces": op9_pieces,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_vector_search": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op8_substring_dedup": OP8_SQL}
