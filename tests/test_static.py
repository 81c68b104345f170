"""Static guards on the library source (rules that must hold at cluster scale)."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parents[1] / "recordaudit"
SOURCES = {p.relative_to(ROOT).as_posix(): p.read_text() for p in ROOT.rglob("*.py") if "llm" not in p.relative_to(ROOT).parts}


def _hits(pattern):
    return sorted(name for name, text in SOURCES.items() if re.search(pattern, text))


def test_no_local_checkpoint_or_cross_join():
    assert _hits(r"localCheckpoint") == []
    assert _hits(r"crossJoin|how=[\"']cross[\"']") == []


def test_no_row_at_a_time_udfs_or_driver_pandas():
    assert _hits(r"F\.udf\(|@udf\b|\budf\(") == []
    assert _hits(r"\.toPandas\(") == []


def test_checkpoint_folder_is_only_set_by_the_local_session():
    assert _hits(r"setCheckpointDir") == ["session.py"]
    text = SOURCES["session.py"]
    # the only unconditional setter is the test/bench fallback, reached when nothing is configured
    assert "def ensure_checkpoint_dir" in text and "if current:" in text


def test_collects_are_bounded():
    # one short string per input file, one row per column name, and one row of range bounds
    assert _hits(r"\.collect\(\)") == ["operators/states.py", "sources/catalogue.py", "sources/files.py", "sources/rescue.py"]
    assert _hits(r"\.toArrow\(") == ["operators/align.py"]
    assert SOURCES["operators/align.py"].count("toArrow(") == 1 and "thin.toArrow()" in SOURCES["operators/align.py"]


def test_nothing_else_imports_the_training_data_package():
    assert _hits(r"recordaudit\.llm|from \.+llm|import llm") == []
