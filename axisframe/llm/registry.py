"""The numbered queries and the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op4_bpe_chunks
from .jaccard import OP5_SQL, op5_ngram_jaccard
from .lexical import OP11_SQL, op11_lexical_search
from .lm import op3_lm_scoring
from .media import op7_media_columns
from .minhash import OP13_SQL, op13_minhash_dedup
from .packing import op10_best_fit_packing
from .phrases import OP12_SQL, op12_phrase_mining
from .quality import op2_quality_classifier
from .sharding import OP1_SQL, op1_sharding
from .tokencount import op6_token_counts
from .topk import OP9_SQL, op9_exact_topk
from .toxicity import op8_toxicity

OPERATORS = (
    op1_sharding, op2_quality_classifier, op3_lm_scoring, op4_bpe_chunks, op5_ngram_jaccard,
    op6_token_counts, op7_media_columns, op8_toxicity, op9_exact_topk, op10_best_fit_packing,
    op11_lexical_search, op12_phrase_mining, op13_minhash_dedup,
)
QUERIES = {f.__name__: f for f in OPERATORS}
SQL = {"op1_sharding": OP1_SQL, "op5_ngram_jaccard": OP5_SQL, "op9_exact_topk": OP9_SQL, "op11_lexical_search": OP11_SQL, "op12_phrase_mining": OP12_SQL, "op13_minhash_dedup": OP13_SQL}
