"""divrec: divide-and-recombine analysis of large tables on Spark.

The package splits a table into subsets, applies a method to every subset and
recombines the results, and computes division-agnostic results that do not
depend on how rows are split. Names below are loaded when first used, so that
Python workers don't import what they don't need.
"""

import importlib

_NAMES = {
    "runtime": "release_staged stage staging",
    "operators.division": "Division Pair CondDiv RandomDiv add_transform cond_div ddf ddo divide dr_filter dr_join dr_lapply dr_persist dr_sample dr_subset joined_lists key_hash kv_apply kv_pair kv_pairs rr_div to_ddf",
    "operators.combine": "Combine comb_collect comb_ddf comb_ddo comb_mean comb_mean_coef comb_rbind recombine",
    "operators.agnostic": "calculate_moments combine_moments combine_multiple_moments datetime_summary dr_aggregate dr_hexbin dr_quantile format_summary frequency_summary frequency_tables moments_of moments_to_statistics numeric_summary split_row_distn split_size_distn update_attributes",
    "operators.models": "blb dr_blb dr_glm dr_lm",
    "operators.mapreduce": "Control Reduce controlled counters default_control mr_exec source_names",
    "operators.scan": "ordered_scan row_numbers",
    "operators.skew": "eager_join_aggregate key_shares key_states row_distribution",
    "operators.compaction": "compact_dataset plan_compaction",
    "sources.connections": "DiskConnection add_data char_to_output convert hdfs_conn local_disk_conn make_extractable open_division remove_data",
    "sources.text": "read_csv read_csv2 read_delim read_delim2 read_table read_text_chunks",
    "sources.bad_records": "classify_records load_typed number_blocks",
    "streaming.ingest": "ingest_files",
    "functions.keys": "bucket condition_key fraction row_identity value_text",
}
_WHERE = {name: module for module, names in _NAMES.items() for name in names.split()}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module divrec has no attribute {name}")
    return getattr(importlib.import_module(f"divrec.{_WHERE[name]}"), name)
