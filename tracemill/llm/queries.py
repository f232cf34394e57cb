"""The corpus queries and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import base_sql, graph_sql
from .ann import op9_ann
from .bpe import op5_bpe
from .egojoin import op13_neardup
from .html import op4_html
from .lm import op6_lm
from .manifest import op12_manifest
from .mixing import op7_mixing
from .pii import op1_pii
from .quality import op3_quality
from .secrets import op2_secrets
from .sharding import op10_sharding
from .simhash import op8_simhash
from .trie import op11_trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_pii, op2_secrets, op3_quality, op4_html, op5_bpe, op6_lm, op7_mixing, op8_simhash, op9_ann, op10_sharding, op11_trie, op12_manifest, op13_neardup]
    return {f.__name__: f for f in found} | base_sql.QUERIES


def oracle_sql() -> dict[str, str]:
    return base_sql.SQL | graph_sql.SQL
