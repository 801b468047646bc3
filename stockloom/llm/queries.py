"""Registered corpus queries, and SQL for those that it can express over whole tables."""

from stockloom.llm import filteraudit, resample, secretscan, warc
from stockloom.llm.filteraudit import op13_filter_interactions
from stockloom.llm.iblt import op2_paragraph_iblt
from stockloom.llm.langid import op7_string_kernel_language
from stockloom.llm.lbl import op9_log_bilinear_scores
from stockloom.llm.lsa import op3_latent_semantic_leaks
from stockloom.llm.packing import op10_hierarchical_packing
from stockloom.llm.prefixcount import op4_prefix_token_counts
from stockloom.llm.resample import op12_importance_resampling
from stockloom.llm.secretscan import op11_secret_automaton
from stockloom.llm.simhash import op8_simhash_covering_lsh
from stockloom.llm.spandedup import op5_suffix_array_spans
from stockloom.llm.warc import op6_warc_round_trip
from stockloom.llm.wavelet import op1_wavelet_shards

QUERIES = {f.__name__: f for f in (op1_wavelet_shards, op2_paragraph_iblt, op3_latent_semantic_leaks, op4_prefix_token_counts, op5_suffix_array_spans, op6_warc_round_trip, op7_string_kernel_language, op8_simhash_covering_lsh, op9_log_bilinear_scores, op10_hierarchical_packing, op11_secret_automaton, op12_importance_resampling, op13_filter_interactions)}
SQL: dict[str, str] = {"op6_warc_round_trip": warc.SQL, "op11_secret_automaton": secretscan.SQL, "op12_importance_resampling": resample.SQL, "op13_filter_interactions": filteraudit.SQL}
