"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op5_bpe_roundtrip
from .decontamination import OP12_SQL, op12_benchmark_decontamination
from .fingerprint import op1_document_fingerprints
from .language import op10_language_id
from .lexical import OP11_SQL, op11_ranked_lexical_search
from .licenses import op2_license_scan
from .mixing import OP7_SQL, op7_source_mixing
from .neardup import op3_near_duplicates
from .ngrams import op4_lm_scores
from .oracles import OP2_SQL, OP9_SQL
from .quality import op9_quality_rules
from .substrings import op6_substring_dedup
from .toxicity import op8_toxicity
from .whitening import op13_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_license_scan,
        op3_near_duplicates,
        op4_lm_scores,
        op5_bpe_roundtrip,
        op6_substring_dedup,
        op7_source_mixing,
        op8_toxicity,
        op9_quality_rules,
        op10_language_id,
        op11_ranked_lexical_search,
        op12_benchmark_decontamination,
        op13_embedding_whitening,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_license_scan": OP2_SQL, "op7_source_mixing": OP7_SQL, "op9_quality_rules": OP9_SQL, "op11_ranked_lexical_search": OP11_SQL, "op12_benchmark_decontamination": OP12_SQL}
