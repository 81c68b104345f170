"""Gender text cleaners and the presence test (Column -> Column).

Three rule sets exist in the reference and they disagree on some phrases, so
all three are kept by name: ``en`` (list match), ``zh`` (list match incl.
phrases), ``merged`` (list match or list+".", then 女性/男性 contained, first
one wins).  Every set is a literal ``IN`` list evaluated in codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_text, norm_lower

FEMALE, MALE, UNKNOWN = "Female", "Male", "Unknown"

# ---------------------------------------------------------------------------
# The reference's word lists, in their order.  Entries with
# capitals can never match the lower-cased input; they are kept as given.
# ---------------------------------------------------------------------------
EN_MALE = [
    "male", "males", "boy", "man", "男性", "男", "he", "male.", "m", "male/male",
    "male (non-binary)", "male (unspecified)", "male, with more females presenting as well",
    "chinese male", "male (male)",
]
EN_FEMALE = [
    "female", "females", "woman", "women", "she", "女性", "女", "she/her", "[female]",
    "female.", "f", "Female", "She",
]
EN_UNKNOWN = [
    "nan", "not specified", "unspecified", "unknown",
    "[insert placeholder]", "[sex placeholder]", "[insert gender]",
    "[student's sex]", "[insert male]", "unknown/unspecified",
    "not available", "unknown sex", "unknown (not specified)",
    "not specified in the template", "_sex_",
]
ZH_MALE = [
    "男性", "男", "male", "男孩", "男生", "男性 child", "先生", "他", "男性患者",
    "男（Male）", "男性约42%, 女性约28%", "男性为主", "mężczyzna",
    "男性（95%），女性（5%）", "男性。", "男性占85%，女性占15%", "男女各占一半",
    "男性占比95%，女性占比5%", "18-35岁男性、35-50岁女性男性", "男性占40%，女性占60%",
    "男性占53%，女性占4", "男性占65%，女性占35%", "男: 65%, 女: 35%", "男士", "男子",
    "三个男性", "男性：621,111", "男性 (male)", "nam", "männer",
]
ZH_FEMALE = [
    "女性", "female", "女", "女孩", "女性 child", "她", "女士", "女性。",
    "女性（49%)", "孕妇", "中国 white female", "女性：613,456",
    "女性占总人口比率的60%，男性占40%", "woman", "females", "♀", "♀️",
    "孕妇", "weiblich", "母亲（父亲）", "已婚妇女", "妇女", "青少年女性",
    "女性：男性=4:3",
    "女性患者一般在35岁至40岁之间。性别：男性患者通常与女性患者相比要少一些。",
    "women between the ages of 25-34 are more likely to develop gdm, while women over 35 are at higher risk due to age-related changes in insulin sensitivity.",
]
MERGED_MALE = [
    "male", "males", "boy", "man", "男性", "男", "he", "male.", "m", "male/male",
    "male (non-binary)", "male (unspecified)", "chinese male", "male (male)",
    "男孩", "男生", "男性 child", "先生", "他", "男性患者", "男（male）", "男士", "男子",
    "mężczyzna", "nam", "männer",
]
MERGED_FEMALE = [
    "female", "females", "woman", "women", "she", "女性", "女", "she/her", "[female]",
    "female.", "f", "Female", "She", "女孩", "女性 child", "她", "女士", "孕妇",
    "weiblich", "妇女", "♀", "♀️",
]
# Words searched inside free text by the merged rule set.
FEMALE_WORD, MALE_WORD = "女性", "男性"


def _list_rule(c: Column | str, male: list[str], female: list[str]) -> Column:
    raw = as_text(c)
    s = norm_lower(raw)
    return (
        F.when(raw.isNull(), F.lit(UNKNOWN))
        .when(s.isin(male), F.lit(MALE))
        .when(s.isin(female), F.lit(FEMALE))
        .otherwise(F.lit(UNKNOWN))
    )


def clean_gender_en(c: Column | str) -> Column:
    """English list rules: exact lower-cased match, everything else Unknown."""
    return _list_rule(c, EN_MALE, EN_FEMALE)


def clean_gender_zh(c: Column | str) -> Column:
    """Chinese list rules (phrases included); idempotent."""
    return _list_rule(c, ZH_MALE, ZH_FEMALE)


def clean_gender_merged(c: Column | str) -> Column:
    """Merged rules: female list (or entry + '.'), then male list, then 女性/男性 in the text."""
    raw = as_text(c)
    s = norm_lower(raw)
    f_pos, m_pos = F.instr(s, FEMALE_WORD), F.instr(s, MALE_WORD)
    return (
        F.when(raw.isNull(), F.lit(UNKNOWN))
        .when(s.isin(MERGED_FEMALE + [p + "." for p in MERGED_FEMALE]), F.lit(FEMALE))
        .when(s.isin(MERGED_MALE + [p + "." for p in MERGED_MALE]), F.lit(MALE))
        .when((f_pos > 0) & (m_pos > 0), F.when(f_pos < m_pos, F.lit(FEMALE)).otherwise(F.lit(MALE)))
        .when(f_pos > 0, F.lit(FEMALE))
        .when(m_pos > 0, F.lit(MALE))
        .otherwise(F.lit(UNKNOWN))
    )


RULE_SETS = {"en": clean_gender_en, "zh": clean_gender_zh, "merged": clean_gender_merged}


def clean_gender(c: Column | str, rules: str = "merged") -> Column:
    return RULE_SETS[rules](c)


def gender_rule_matched(c: Column | str, rules: str = "en") -> Column:
    """True when the raw value hits a list entry (the reference prints the others)."""
    s = norm_lower(c)
    if rules == "en":
        hit = s.isin(EN_MALE + EN_FEMALE + EN_UNKNOWN)
    elif rules == "zh":
        hit = s.isin(ZH_MALE + ZH_FEMALE)
    else:
        dotted = MERGED_MALE + MERGED_FEMALE
        hit = s.isin(dotted + [p + "." for p in dotted]) | (F.instr(s, FEMALE_WORD) > 0) | (F.instr(s, MALE_WORD) > 0)
    return F.coalesce(hit, F.lit(False))


def gender_present(c: Column | str) -> Column:
    """Coverage rule: not null, not 'unknown', not all digits."""
    s = as_text(c)
    return F.coalesce(
        s.isNotNull() & (F.lower(s) != F.lit("unknown")) & ~s.rlike(r"(?U)^\d+$"), F.lit(False)
    )
