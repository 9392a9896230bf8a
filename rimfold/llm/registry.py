"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from rimfold.llm.centroids import OP12_SQL, op12_centroid_clusters
from rimfold.llm.chat import OP6_SQL, op6_chat_format
from rimfold.llm.licenses import op3_license_scan
from rimfold.llm.licenses import oracle_sql as op3_sql
from rimfold.llm.lines import OP10_SQL, op10_line_dedup
from rimfold.llm.lm import op4_lm_scores
from rimfold.llm.mixing import op2_mix_sources
from rimfold.llm.neardup import op8_near_duplicates
from rimfold.llm.pieces import op5_sentencepiece
from rimfold.llm.quality import op9_quality_rules
from rimfold.llm.ranking import OP13_SQL, op13_ranked_search
from rimfold.llm.simhash import op11_simhash_components
from rimfold.llm.substrings import op1_suffix_dedup
from rimfold.llm.topk import OP7_SQL, op7_exact_topk

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_license_scan": op3_license_scan,
    "op4_lm_scores": op4_lm_scores,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_chat_format": op6_chat_format,
    "op7_exact_topk": op7_exact_topk,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
    "op11_simhash_components": op11_simhash_components,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_ranked_search": op13_ranked_search,
}
ORACLES: dict[str, str] = {
    "op3_license_scan": op3_sql(),
    "op6_chat_format": OP6_SQL,
    "op7_exact_topk": OP7_SQL,
    "op10_line_dedup": OP10_SQL,
    "op12_centroid_clusters": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
