"""Queries of the training-data operators, each over its whole table, and SQL where it can express them."""

from . import bin_packing, collocations, decontaminate, jaccard_join, licenses, packing, periodic_runs, pii, quality_mil, quality_rules, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_robust_outliers": quality_rules.op1_robust_outliers,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_pii_surrogates": pii.op4_pii_surrogates,
    "op5_harmonic_packing": packing.op5_harmonic_packing,
    "op6_toxicity_neighbours": toxicity.op6_toxicity_neighbours,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_quality_attention": quality_mil.op8_quality_attention,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_suffix_array_dedup": suffix_dedup.op10_suffix_array_dedup,
    "op11_best_fit_packing": bin_packing.op11_best_fit_packing,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_phrase_collocations": collocations.op13_phrase_collocations,
}
SQL = {"op3_license_scan": licenses.OP3_SQL, "op2_benchmark_decontamination": decontaminate.OP2_SQL, "op7_jaccard_join": jaccard_join.OP7_SQL, "op9_substring_dedup": substring_dedup.OP9_SQL, "op13_phrase_collocations": collocations.OP13_SQL}
