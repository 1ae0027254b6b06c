"""Queries of the subpackage and the SQL that must give the same rows."""

from __future__ import annotations

import corpus_pipeline
from opsloom.llm.bpe import op8_bpe
from opsloom.llm.fingerprints import op5_fingerprints
from opsloom.llm.jaccard import op2_jaccard_join
from opsloom.llm.langid import op9_language_id
from opsloom.llm.mixing import op6_mixing
from opsloom.llm.oracles import OP2, OP4, OP11, OP13
from opsloom.llm.pii import op7_pii
from opsloom.llm.pieces import op12_token_counts
from opsloom.llm.quality import op10_quality
from opsloom.llm.rules import op4_quality_rules
from opsloom.llm.secrets import op1_secrets
from opsloom.llm.sharding import op3_sharding
from opsloom.llm.trie import op13_prefix_trie
from opsloom.llm.variants import op11_spelling_variants

QUERIES = {"pipeline": corpus_pipeline.run, "op7_pii": op7_pii, "op3_sharding": op3_sharding, "op5_fingerprints": op5_fingerprints, "op2_jaccard_join": op2_jaccard_join, "op1_secrets": op1_secrets, "op4_quality_rules": op4_quality_rules, "op6_mixing": op6_mixing, "op8_bpe": op8_bpe, "op9_language_id": op9_language_id, "op10_quality": op10_quality, "op11_spelling_variants": op11_spelling_variants, "op12_token_counts": op12_token_counts, "op13_prefix_trie": op13_prefix_trie}

ORACLES: dict[str, str] = {"op2_jaccard_join": OP2, "op4_quality_rules": OP4, "op11_spelling_variants": OP11, "op13_prefix_trie": OP13}
