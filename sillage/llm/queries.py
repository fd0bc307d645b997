"""The queries of this folder by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sillage.llm.bpe import op5_bpe
from sillage.llm.chat import OP2_SQL, op2_chat
from sillage.llm.clustering import OP13_SQL, op13_clusters
from sillage.llm.divergence import OP12_SQL, op12_divergence
from sillage.llm.mixing import op3_mixing
from sillage.llm.media import op1_media
from sillage.llm.near_dedup import OP7_SQL, op7_near_dedup
from sillage.llm.parity_join import OP11_SQL, op11_jaccard_join
from sillage.llm.parts import PARTS, PARTS_SQL
from sillage.llm.quality import op9_quality
from sillage.llm.secrets import op8_secrets
from sillage.llm.toxicity import op10_toxicity
from sillage.llm.url_filter import op4_url_filter
from sillage.llm.warc import OP6_SQL, op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_chat": op2_chat,
    "op3_mixing": op3_mixing,
    "op4_url_filter": op4_url_filter,
    "op5_bpe": op5_bpe,
    "op6_warc": op6_warc,
    "op7_near_dedup": op7_near_dedup,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_divergence": op12_divergence,
    "op13_clusters": op13_clusters,
    **PARTS,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat": OP2_SQL,
    "op6_warc": OP6_SQL,
    "op7_near_dedup": OP7_SQL,
    "op11_jaccard_join": OP11_SQL,
    "op12_divergence": OP12_SQL,
    "op13_clusters": OP13_SQL,
    **PARTS_SQL,
}
