"""Column -> Column functions: cleaners, presence tests, formats, chi-square."""

from .age import (
    age_present, clean_age_v1, clean_age_v2, digits_only, first_number, is_invalid,
    numeric_coerce, range_mask, to_int,
)
from .gender import (
    clean_gender, clean_gender_en, clean_gender_merged, clean_gender_zh, gender_present,
    gender_rule_matched,
)
from .stats import chi2_pvalue_dof1, chi_square_2x2, is_degenerate, significant
from .text import (
    assemble_prompt, cell_count, count_pct_cell, cut_at_stop_tokens, fill_template, fixed2,
    norm_lower, null_tokens, param_size, py_strip, round_half_even, safe_name, sci4,
    strip_admin_suffix, strip_braces, text_length,
)

__all__ = [
    "age_present", "clean_age_v1", "clean_age_v2", "digits_only", "first_number", "is_invalid",
    "numeric_coerce", "range_mask", "to_int", "clean_gender", "clean_gender_en",
    "clean_gender_merged", "clean_gender_zh", "gender_present", "gender_rule_matched",
    "chi2_pvalue_dof1", "chi_square_2x2", "is_degenerate", "significant", "assemble_prompt",
    "cell_count", "count_pct_cell", "cut_at_stop_tokens", "fill_template", "fixed2",
    "norm_lower", "null_tokens", "param_size", "py_strip", "round_half_even", "safe_name",
    "sci4", "strip_admin_suffix", "strip_braces", "text_length",
]
