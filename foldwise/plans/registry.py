"""Registry of queries: name -> (spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import io_queries as io
from . import slice as slice_
from . import text_queries as tq
from . import tfidf_queries as fq
from . import tabular_queries as tb
from . import score_queries as sq
from . import model_queries as mq
from . import wide_queries as wq

Builder = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Builder, str | None]] = {
    "te_fold_auc": (slice_.te_fold_auc, slice_.TE_FOLD_AUC_SQL),
    **{f"text_{f}": (tq.family_query(f), tq.TEXT_SQL[f]) for f in tq.TEXT_SQL},
    "topic_onehot": (tq.topic_onehot_query, tq.TOPIC_ONEHOT_SQL),
    "benford": (fq.benford, fq.BENFORD_SQL),
    "tfidf_word": (fq.tfidf_word, fq.TFIDF_WORD_SQL),
    "tfidf_char": (fq.tfidf_char, fq.TFIDF_CHAR_SQL),
    "tfidf_fixed": (fq.tfidf_fixed, fq.TFIDF_FIXED_SQL),
    "topic_coherence": (fq.topic_coherence, fq.TOPIC_COHERENCE_SQL),
    "tfidf_fold": (fq.tfidf_fold, fq.TFIDF_FOLD_SQL),
    "tab_digits": (tb.tab_digits, tb.TAB_DIGITS_SQL),
    "tab_rounding": (tb.tab_rounding, tb.TAB_ROUNDING_SQL),
    "tab_interactions": (tb.tab_interactions, tb.TAB_INTERACTIONS_SQL),
    "tab_orig_encodings": (tb.tab_orig_encodings, tb.TAB_ORIG_ENCODINGS_SQL),
    "tab_ratio_band": (tb.tab_ratio_band, tb.TAB_RATIO_BAND_SQL),
    "te_fit_transform": (tb.te_fit_transform, tb.TE_FIT_TRANSFORM_SQL),
    "te_oof_aggs": (tb.te_oof_aggs, tb.TE_OOF_AGGS_SQL),
    "te_two_stage": (tb.te_two_stage, tb.TE_TWO_STAGE_SQL),
    "te_nested": (tb.te_nested, tb.TE_NESTED_SQL),
    "factorize_codes": (tb.factorize_codes, tb.FACTORIZE_CODES_SQL),
    "auc_by_model": (sq.auc_by_model, sq.AUC_BY_MODEL_SQL),
    "auc_by_model_fold": (sq.auc_by_model_fold, sq.AUC_BY_MODEL_FOLD_SQL),
    "roc_curve": (sq.roc_curve, sq.ROC_CURVE_SQL),
    "thresholds": (sq.thresholds, sq.THRESHOLDS_SQL),
    "accuracy_by_model": (sq.accuracy_by_model, sq.ACCURACY_BY_MODEL_SQL),
    "class_weights": (sq.class_weights, sq.CLASS_WEIGHTS_SQL),
    "blend_means": (sq.blend_means, sq.BLEND_MEANS_SQL),
    "blend_linear_grid": (sq.blend_linear_grid, sq.BLEND_LINEAR_GRID_SQL),
    "blend_linear_best": (sq.blend_linear_best, sq.BLEND_LINEAR_BEST_SQL),
    "blend_logit_grid": (sq.blend_logit_grid, sq.BLEND_LOGIT_GRID_SQL),
    "blend_logit_best": (sq.blend_logit_best, sq.BLEND_LOGIT_BEST_SQL),
    "blend_simplex": (sq.blend_simplex, sq.BLEND_SIMPLEX_SQL),
    "blend_simplex_test": (sq.blend_simplex_test, sq.BLEND_SIMPLEX_TEST_SQL),
    "meta_blend": (sq.meta_blend, sq.META_BLEND_SQL),
    "seed_trim": (sq.seed_trim, sq.SEED_TRIM_SQL),
    "hp_objective": (sq.hp_objective, sq.HP_OBJECTIVE_SQL),
    "pseudo_labels": (sq.pseudo_labels, sq.PSEUDO_LABELS_SQL),
    "topic_calibration": (sq.topic_calibration, sq.TOPIC_CALIBRATION_SQL),
    "post_variants": (sq.post_variants, sq.POST_VARIANTS_SQL),
    "output_validation": (sq.output_validation, sq.OUTPUT_VALIDATION_SQL),
    "profile_lengths": (sq.profile_lengths, sq.PROFILE_LENGTHS_SQL),
    "class_distribution": (sq.class_distribution, sq.CLASS_DISTRIBUTION_SQL),
    "topic_frequency": (sq.topic_frequency, sq.TOPIC_FREQUENCY_SQL),
    "describe_applications": (sq.describe_applications, sq.DESCRIBE_APPLICATIONS_SQL),
    "score_summary": (sq.score_summary, sq.SCORE_SUMMARY_SQL),
    "csv_sources": (io.csv_sources, io.CSV_SOURCES_SQL),
    "score_files": (io.score_files, io.SCORE_FILES_SQL),
    "feature_export": (io.feature_export, io.FEATURE_EXPORT_SQL),
    "run_record": (io.run_record, io.RUN_RECORD_SQL),
    "softmax_scores": (io.softmax_scores, io.SOFTMAX_SCORES_SQL),
    "isotonic_calibration": (sq.isotonic_calibration, sq.ISOTONIC_CALIBRATION_SQL),
    "folds_group": (mq.folds_group, mq.FOLDS_GROUP_SQL),
    "folds_repeated": (mq.folds_repeated, mq.FOLDS_REPEATED_SQL),
    "folds_tuning_final": (mq.folds_tuning_final, mq.FOLDS_TUNING_FINAL_SQL),
    "standardize_meta": (mq.standardize_meta, mq.STANDARDIZE_META_SQL),
    "embedding_means": (mq.embedding_means, mq.EMBEDDING_MEANS_SQL),
    "embedding_lookup": (mq.embedding_lookup, mq.EMBEDDING_LOOKUP_SQL),
    "embedding_features": (mq.embedding_features, mq.EMBEDDING_FEATURES_SQL),
    "mi_screen": (mq.mi_screen, mq.MI_SCREEN_SQL),
    "text_lexicon": (mq.text_lexicon, mq.TEXT_LEXICON_SQL),
    "text_lexicon_table": (mq.text_lexicon_table, mq.TEXT_LEXICON_TABLE_SQL),
    "hp_draws": (mq.hp_draws, mq.HP_DRAWS_SQL),
    "text_inputs": (mq.text_inputs, mq.TEXT_INPUTS_SQL),
    "importance_rollup": (mq.importance_rollup, mq.IMPORTANCE_ROLLUP_SQL),
    "cv_logistic_meta": (mq.cv_logistic_meta, None),
    "mi_screen_folds": (wq.mi_screen_folds, wq.MI_SCREEN_FOLDS_SQL),
    "cv_logistic_wide": (wq.cv_logistic_wide, None),
    "cv_wide_coverage": (wq.cv_wide_coverage, wq.CV_WIDE_COVERAGE_SQL),
    "cv_forest_meta": (mq.cv_forest_meta, None),
    "cv_gbt_tabular": (mq.cv_gbt_tabular, None),
    "stack_scores": (mq.stack_scores, None),
    "permutation_importance_gbt": (mq.permutation_importance_gbt, None),
    "pseudo_refit": (mq.pseudo_refit, None),
    "hp_search": (mq.hp_search, None),
    "svd_tfidf": (mq.svd_tfidf, None),
}


def queries() -> dict[str, Builder]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
