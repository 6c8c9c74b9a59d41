"""rankspark — lexical + dense retrieval experiments as Spark jobs.

Topics, documents, runs and judgements are DataFrames; BM25 is a join and an
aggregate over a postings table, the hybrid score is a Column expression, top-k
is a window, evaluation is one join plus one aggregate.
"""

__version__ = "0.1.0"

from rankspark.functions.text import clean_whitespace, max_seq_length, sentences, tokenize  # noqa: E402,F401
from rankspark.functions.vectors import cosine, distance, dot, l2_normalize  # noqa: E402,F401
from rankspark.operators.bm25 import bm25, bm25_ablation, bm25_settings, match_terms  # noqa: E402,F401
from rankspark.operators.dense import dense_topk, encode, encode_incremental, hash_encode, unseen  # noqa: E402,F401
from rankspark.operators.evaluate import (  # noqa: E402,F401
    attach_judgements, evaluate, evaluate_residual, mean_metrics, paired_t, trec_summary)
from rankspark.operators.folds import contiguous_folds, kfolds, split_fold, stratified_folds  # noqa: E402,F401
from rankspark.operators.hybrid import attach_z, hybrid, top_bm25, z_value  # noqa: E402,F401
from rankspark.operators.index import Index, build_index  # noqa: E402,F401
from rankspark.operators.pairs import binary_eval, contrastive_loss, similarity_eval, supcon_loss  # noqa: E402,F401
from rankspark.operators.rerank import (  # noqa: E402,F401
    kmax_pool, multi_vector_stats, rank_by_embeddings, rerank, rerank_dense, rerank_hybrid)
from rankspark.operators.runs import concat_examples, exclude, rank_agreement, rank_run, top_k  # noqa: E402,F401
from rankspark.operators.sweep import ablation_grid, param_grid, sweep, sweep_cv, sweep_summary  # noqa: E402,F401
