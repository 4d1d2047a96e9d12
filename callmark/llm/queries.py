"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from callmark.llm.bpe import op10_bpe
from callmark.llm.fingerprints import op7_order_minhash
from callmark.llm.hamming import OP1_SQL, op1_multi_index_hashing
from callmark.llm.negatives import OP12_SQL, op12_hard_negatives
from callmark.llm.ngram_join import op6_ngram_jaccard
from callmark.llm.packing import op8_nnls_packing
from callmark.llm.pii import op13_semi_markov_pii
from callmark.llm.secrets import op5_markov_secrets
from callmark.llm.separators import op9_separator_scan
from callmark.llm.sharding import op3_minimax_shards
from callmark.llm.suffixes import op2_sparse_suffixes
from callmark.llm.toxicity import op4_deobfuscated_toxicity
from callmark.llm.whitening import op11_exact_whitening

QUERIES = {
    "op1_multi_index_hashing": op1_multi_index_hashing,
    "op2_sparse_suffixes": op2_sparse_suffixes,
    "op3_minimax_shards": op3_minimax_shards,
    "op4_deobfuscated_toxicity": op4_deobfuscated_toxicity,
    "op5_markov_secrets": op5_markov_secrets,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_order_minhash": op7_order_minhash,
    "op8_nnls_packing": op8_nnls_packing,
    "op9_separator_scan": op9_separator_scan,
    "op10_bpe": op10_bpe,
    "op11_exact_whitening": op11_exact_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_semi_markov_pii": op13_semi_markov_pii,
}
ORACLE_SQL: dict[str, str] = {"op1_multi_index_hashing": OP1_SQL, "op12_hard_negatives": OP12_SQL}
