"""Golden table for the three gender rule sets."""

import pytest

from recordaudit.functions import gender as G

M, F, U = "Male", "Female", "Unknown"
# raw, en, zh, merged
GOLDEN = [
    ("Male", M, M, M),
    (" male ", M, M, M),
    ("female.", F, U, F),
    ("boy.", U, U, M),
    ("women", F, U, F),
    ("men", U, U, U),
    ("男", M, M, M),
    ("女性", F, F, F),
    ("男（Male）", U, U, M),
    ("男女各占一半", U, M, U),
    ("已婚妇女", U, F, U),
    ("男性占40%，女性占60%", U, M, M),
    ("女性：男性=4:3", U, F, F),
    ("male, with more females presenting as well", M, U, U),
    ("nam", U, M, M),
    ("männer", U, M, M),
    ("MÄNNER", U, M, M),
    ("未知", U, U, U),
    ("unknown", U, U, U),
    (None, U, U, U),
]
RAW = [g[0] for g in GOLDEN]


@pytest.mark.parametrize("col,fn", [(1, G.clean_gender_en), (2, G.clean_gender_zh), (3, G.clean_gender_merged)])
def test_gender_golden(one, col, fn):
    got = one(RAW, fn)
    want = [g[col] for g in GOLDEN]
    assert got == want, [(r, g, w) for r, g, w in zip(RAW, got, want) if g != w]


@pytest.mark.parametrize("fn", [G.clean_gender_en, G.clean_gender_zh, G.clean_gender_merged])
def test_idempotent(one, fn):
    once = one(RAW, fn)
    assert one(once, fn) == once


def test_gender_present(one):
    vals = ["Male", None, "1", "F", "x", "UNKNOWN", "1.0", ""]
    assert one(vals, G.gender_present) == [True, False, False, True, True, False, True, True]


def test_rule_matched(one):
    assert one(["male", "xyz", "nan", None], lambda c: G.gender_rule_matched(c, "en")) == [True, False, True, False]
