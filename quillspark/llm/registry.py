"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_language_id import op1_language_id
from .op10_substrings import ORACLE as OP10_ORACLE
from .op10_substrings import op10_substrings
from .op2_sentencepiece import op2_sentencepiece
from .op3_sharding import op3_sharding
from .op4_secrets import ORACLE as OP4_ORACLE
from .op4_secrets import op4_secrets
from .op5_chat import ORACLE as OP5_ORACLE
from .op5_chat import op5_chat
from .op6_decontaminate import op6_decontaminate
from .op7_embeddings import op7_embeddings
from .op8_simhash import op8_simhash
from .op9_html import op9_html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_sharding": op3_sharding,
    "op4_secrets": op4_secrets,
    "op5_chat": op5_chat,
    "op6_decontaminate": op6_decontaminate,
    "op7_embeddings": op7_embeddings,
    "op8_simhash": op8_simhash,
    "op9_html": op9_html,
    "op10_substrings": op10_substrings,
}

ORACLES: dict[str, str] = {
    "op4_secrets": OP4_ORACLE,
    "op5_chat": OP5_ORACLE,
    "op10_substrings": OP10_ORACLE,
}
