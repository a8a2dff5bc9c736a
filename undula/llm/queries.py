"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from undula.llm.bpe_codec import op7_bpe_codec
from undula.llm.chat_format import ORACLE as CHAT_SQL
from undula.llm.chat_format import op13_chat_format
from undula.llm.decontamination import ORACLE as DECONTAMINATION_SQL
from undula.llm.decontamination import op2_decontamination, op2_near_matches
from undula.llm.html_text import op4_html_text
from undula.llm.language_id import op5_language_id
from undula.llm.merkle_manifest import ORACLE as MERKLE_SQL
from undula.llm.merkle_manifest import op11_merkle_manifest
from undula.llm.pii import op10_pii
from undula.llm.quality_rules import ORACLE as QUALITY_SQL
from undula.llm.quality_rules import op8_quality_rules
from undula.llm.secrets import op9_secrets
from undula.llm.simhash_dedup import op6_simhash_dedup
from undula.llm.spelling_groups import ORACLE as SPELLING_SQL
from undula.llm.spelling_groups import op12_spelling_groups
from undula.llm.token_counts import op1_token_counts
from undula.llm.toxicity import op3_toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_decontamination, op3_toxicity, op4_html_text, op5_language_id, op6_simhash_dedup, op7_bpe_codec, op8_quality_rules, op9_secrets, op10_pii, op11_merkle_manifest, op12_spelling_groups, op13_chat_format, op2_near_matches, pipeline)
}
ORACLE_SQL: dict[str, str] = {"op2_decontamination": DECONTAMINATION_SQL, "op8_quality_rules": QUALITY_SQL, "op11_merkle_manifest": MERKLE_SQL, "op12_spelling_groups": SPELLING_SQL, "op13_chat_format": CHAT_SQL}
