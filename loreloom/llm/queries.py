"""Registered queries of the operators, their SQL where SQL can express them, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversation_trie import OP12_SQL, op12_prefix_trie
from .decontaminate import OP5_SQL, op5_decontaminate
from .merkle import OP11_SQL, op11_merkle
from .near_dups import OP8_SQL, op8_near_dups
from .nearest import op7_nearest
from .occurrence_join import OP13_SQL, op13_ngram_join
from .pieces import op6_pieces
from .quality import op9_quality
from .secrets import op10_secrets
from .shards import op3_shards
from .token_files import op1_token_files
from .toxicity import op4_toxicity
from .warc import OP2_SQL, op2_warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {"op1_token_files": op1_token_files, "op2_warc": op2_warc, "op3_shards": op3_shards, "op4_toxicity": op4_toxicity, "op5_decontaminate": op5_decontaminate, "op6_pieces": op6_pieces, "op7_nearest": op7_nearest, "op8_near_dups": op8_near_dups, "op9_quality": op9_quality, "op10_secrets": op10_secrets, "op11_merkle": op11_merkle, "op12_prefix_trie": op12_prefix_trie, "op13_ngram_join": op13_ngram_join}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op5_decontaminate": OP5_SQL, "op8_near_dups": OP8_SQL, "op11_merkle": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_ngram_join": OP13_SQL}
