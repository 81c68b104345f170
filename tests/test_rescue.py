"""Damaged records cost themselves only: good plus quarantined records are all records."""

import gzip
import os

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from recordaudit.sources import rescue


def test_csv_lines(spark, tmp_path):
    lines = [f"{k},name {k},{k / 2}" for k in range(200)]
    for k in range(0, 200, 9):
        lines[k] = f"{k},short"
    lines[13] = "13,too,1.0,many"
    lines[14] = 'x14,not a number,1.0'
    (tmp_path / "a.csv").write_text("id,name,v\n" + "\n".join(lines) + "\n")
    good, bad = rescue.rescue_text(spark, str(tmp_path), schema="id int, name string, v double")
    rows = bad.collect()
    assert sorted(r.record for r in rows) == sorted([f"{k},short" for k in range(0, 200, 9)] + [lines[13], lines[14]])
    assert all(r.path.endswith("a.csv") and r.rows == 1 for r in rows)
    assert good.count() + len(rows) == 200 and {r.id for r in good.collect()} == set(range(200)) - set(range(0, 200, 9)) - {13, 14}


def test_csv_headers_of_their_own_and_bad_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"id,name\n1,x\n2,bad \xff\xfe byte\n3\n")
    (tmp_path / "b.csv").write_bytes(b"name,more,id\ny,q,4\nz,r,5,6\n")
    good, bad = rescue.rescue_text(spark, str(tmp_path))
    assert {(r.id, r.name, r.more, r.file_name) for r in good.collect()} == {("1", "x", None, "a.csv"), ("4", "y", "q", "b.csv")}
    assert sorted((os.path.basename(r.path), r.reason) for r in bad.collect()) == [
        ("a.csv", "does not fit the schema"), ("a.csv", "not UTF-8"), ("b.csv", "does not fit the schema")]


def test_json_lines_and_a_cut_gzip_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"v": 1}\n{"v": 2\nnot json\n{"v": 3}\n')
    raw = gzip.compress("".join(f'{{"v": {k}}}\n' for k in range(10, 20_000)).encode())
    (tmp_path / "cut.json.gz").write_bytes(raw[:len(raw) // 2])
    good, bad = rescue.rescue_text(spark, str(tmp_path), "json", schema="v int")
    rows = bad.collect()
    ours = [r for r in rows if r.path.endswith("a.json")]
    assert sorted(r.record for r in ours) == ["not json", '{"v": 2'] and {1, 3} < {r.v for r in good.collect()}
    assert good.where("file_name = 'cut.json.gz'").count() > 100  # the lines before the break stay
    assert [r.reason.split(":")[0] for r in rows if r.path.endswith(".gz") and r.record is None] == ["stream breaks off"]


def test_parquet_row_groups(spark, tmp_path):
    src, store = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    for name, lo in (("a", 0), ("b", 1000)):
        pq.write_table(pa.table({"id": list(range(lo, lo + 1000)), "t": [f"text {k}" for k in range(lo, lo + 1000)]}), src / f"{name}.parquet",
                       row_group_size=100, compression="gzip", use_dictionary=False, write_statistics=False)
    pd.DataFrame({"id": [5000], "other": ["x"]}).to_parquet(src / "c.parquet", index=False)
    (src / "d.parquet").write_bytes(b"PAR1 nothing of use PAR1")
    meta = pq.read_metadata(src / "b.parquet")
    at = meta.row_group(3).column(1).data_page_offset + 40
    raw = bytearray((src / "b.parquet").read_bytes())
    raw[at:at + 60] = bytes(60)
    (src / "b.parquet").write_bytes(raw)
    good = rescue.rescue(spark, str(src), store)
    rows = rescue.quarantined(spark, store).collect()
    assert sorted((os.path.basename(r.path), r.place, r.rows) for r in rows) == [("b.parquet", 3, 100), ("d.parquet", None, None)]
    got = good.collect()
    assert {r.id for r in got} == (set(range(2000)) - set(range(1300, 1400))) | {5000}
    assert len(got) + 100 == 2001 and {r.other for r in got if r.file_name == "c.parquet"} == {"x"}
    assert {r.file_name for r in got} == {"a.parquet", "b.parquet", "c.parquet"}


def test_sound_files_have_an_empty_quarantine(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    pd.DataFrame({"id": [1, 2]}).to_parquet(src / "a.parquet", index=False)
    good = rescue.rescue(spark, str(src), str(tmp_path / "store"))
    assert good.count() == 2 and rescue.quarantined(spark, str(tmp_path / "store")).count() == 0


def test_names_repeated_or_with_signs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a b,x,x,q`r\n1,2,3,4\n5,6\n")
    good, bad = rescue.rescue_text(spark, str(tmp_path))
    (r,) = good.collect()
    assert r["a b"] == "1" and r["x"] == "2" and r["x_2"] == "3" and bad.count() == 1


def test_cli_reads_around_damage(spark, tmp_path):
    from recordaudit.plans import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m_v1.csv").write_text("disease,Age,Age_Chinese\nT1DM,25,30\nT1DM,26\nT1DM,27,31\n")
    cli.run(spark, ["age-profile", "--input", str(tmp_path / "in"), "--format", "csv", "--output", str(tmp_path / "out"),
                    "--quarantine", str(tmp_path / "bad")])
    assert [r.record for r in rescue.quarantined(spark, str(tmp_path / "bad")).collect()] == ["T1DM,26"]
    n = spark.read.option("header", "true").csv(str(tmp_path / "out")).where("`column` = 'Age'").agg({"n": "sum"}).first()[0]
    assert n == 2
