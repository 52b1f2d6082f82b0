"""Queries of this subpackage and their SQL, as registered by the entry file."""

from __future__ import annotations

from rainfold.llm import quality, url_filter
from rainfold.llm.embedding_dedup import op3_embedding_dedup
from rainfold.llm.hmm import op6_hmm_score
from rainfold.llm.language_id import op5_language_id
from rainfold.llm.merkle import op11_merkle
from rainfold.llm.mixing import op8_mixing
from rainfold.llm.packing import op9_packing
from rainfold.llm.prefix_trie import op12_prefix_trie
from rainfold.llm.quality import op2_quality_rules
from rainfold.llm.quality_classifier import op13_quality_classifier
from rainfold.llm.simhash import op4_simhash
from rainfold.llm.token_records import op1_token_records
from rainfold.llm.toxicity import op7_toxicity
from rainfold.llm.url_filter import op10_url_filter

LLM_QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_quality_rules": op2_quality_rules,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_simhash": op4_simhash,
    "op5_language_id": op5_language_id,
    "op6_hmm_score": op6_hmm_score,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_packing": op9_packing,
    "op10_url_filter": op10_url_filter,
    "op11_merkle": op11_merkle,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_quality_classifier": op13_quality_classifier,
}

#: DuckDB SQL where it can express the query.
LLM_ORACLES: dict[str, str] = {
    "op2_quality_rules": quality.oracle(),
    "op10_url_filter": url_filter.oracle(),
}
