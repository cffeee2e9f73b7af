"""Queries of this subpackage and their DuckDB SQL, for ``__spark_entry__``."""

from __future__ import annotations

from veridian.llm.ann_tree import op8_ann_tree
from veridian.llm.collocations import op12_collocations, op12_sql
from veridian.llm.conversation_trie import op11_conversation_trie, op11_sql
from veridian.llm.fingerprints import op5_fingerprints
from veridian.llm.language_id import op4_language_id
from veridian.llm.language_model import op9_lm_scoring
from veridian.llm.minhash import op13_minhash
from veridian.llm.mixing import op3_mixing, op3_sql
from veridian.llm.ngram_join import op6_ngram_join
from veridian.llm.packing import op2_packing
from veridian.llm.token_stream import op7_token_stream
from veridian.llm.toxicity import op10_toxicity
from veridian.llm.url_filter import op1_sql, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_fingerprints": op5_fingerprints,
    "op6_ngram_join": op6_ngram_join,
    "op7_token_stream": op7_token_stream,
    "op8_ann_tree": op8_ann_tree,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_collocations": op12_collocations,
    "op13_minhash": op13_minhash,
}

ORACLES = {"op1_url_filter": op1_sql(), "op3_mixing": op3_sql(), "op11_conversation_trie": op11_sql(), "op12_collocations": op12_sql()}
