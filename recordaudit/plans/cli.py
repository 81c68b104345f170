"""Command-line runner for the audits: ``python -m recordaudit.plans.cli <job> ...``.

Each subcommand reads every record file of ``--input`` (one DataFrame over
all files; model key from the file name unless the data has a model column;
null tokens applied at ingest), runs one composite job and writes the report.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..operators import contingency, coverage
from ..sources import files, rescue
from . import jobs


def read_records(spark: SparkSession, path: str, fmt: str, glob: str | None, model: str,
                 skip_corrupt: str | None = None, quarantine: str | None = None) -> DataFrame:
    """All record files; a corrupt file is an error, or with ``skip_corrupt`` is left out and
    listed in the report written there, or with ``quarantine`` loses its damaged records only, which go there."""
    if skip_corrupt:
        files.write_report(files.corrupt_files(spark, path, fmt, glob), skip_corrupt)
    if quarantine:
        df = rescue.rescue(spark, path, quarantine, fmt, glob=glob)
    else:
        df = files.scan(spark, path, fmt=fmt, glob=glob, ignore_corrupt=bool(skip_corrupt))
    df = files.normalize_nulls(df)
    if model not in df.columns:
        df = df.withColumn(model, files.model_from_file(F.col(files.FILE_NAME)))
    # model keys are trimmed at ingest (a stored name may carry a trailing space)
    return df.withColumn(model, py_strip(F.col(model)))


def _common(p: argparse.ArgumentParser) -> None:
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    p.add_argument("--glob", default=None)
    p.add_argument("--skip-corrupt", default=None, metavar="REPORT", help="leave corrupt files out and list them in REPORT")
    p.add_argument("--quarantine", default=None, metavar="FOLDER", help="keep what can be read; damaged records go to FOLDER")
    p.add_argument("--model", default="model_name")
    p.add_argument("--report-format", default="csv", choices=["csv", "parquet", "json"])


def build_parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="recordaudit")
    sub = ap.add_subparsers(dest="job", required=True)
    p = sub.add_parser("coverage", help="age/gender coverage per model with ratios")
    _common(p)
    p.add_argument("--total", type=int, default=coverage.DEFAULT_SAMPLE_SIZE, help="fixed sample size; 0 = actual")
    p = sub.add_parser("location", help="province/city/district presence and gazetteer matches")
    _common(p)
    p.add_argument("--gazetteer", required=True)
    p.add_argument("--gazetteer-format", default="csv")
    p.add_argument("--home", nargs="*", default=[])
    p = sub.add_parser("age-profile", help="banded age distribution per group")
    _common(p)
    p.add_argument("--columns", nargs="+", default=["Age", "Age_Chinese"])
    p.add_argument("--group", nargs="+", default=["disease"], help="e.g. model_name disease, or file_name disease")
    p.add_argument("--labels", default="upper", choices=["upper", "lower"])
    p.add_argument("--wide", action="store_true")
    p = sub.add_parser("gender-profile", help="Female/Male/Unknown distribution per group")
    _common(p)
    p.add_argument("--columns", nargs="+", default=["Sex", "Sex_Chinese"])
    p.add_argument("--group", nargs="+", default=["disease"], help="e.g. model_name disease, or file_name disease")
    p.add_argument("--wide", action="store_true")
    p = sub.add_parser("clean", help="clean age and gender columns into a new dataset version")
    _common(p)
    p.add_argument("--version", required=True)
    p.add_argument("--age-rules", default="v2", choices=["v1", "v2"])
    p.add_argument("--gender-rules", default="merged", choices=["en", "zh", "merged"])
    p = sub.add_parser("chi-square", help="2x2 gender test against a real-world report")
    _common(p)
    p.add_argument("--real", required=True, help="wide report: a gender label column + one column per group")
    p.add_argument("--real-format", default="csv")
    p.add_argument("--label", default="gender")
    p.add_argument("--group", default="disease")
    p.add_argument("--from-reports", action="store_true", help="--input holds the models' wide reports, not records")
    p.add_argument("--alias", nargs="*", default=None, metavar="GROUP=TEXT,TEXT", help="substring rules; default: the built-in ones")
    p.add_argument("--alpha", type=float, default=0.05)
    p = sub.add_parser("audit", help="before/after table or audit of a gender column per keys")
    _common(p)
    p.add_argument("--column", default="Sex_Chinese")
    p.add_argument("--by", nargs="*", default=[])
    p.add_argument("--report", default="audit", choices=["audit", "before-after"])
    p = sub.add_parser("out-of-home", help="rows whose district is known but outside the home list")
    _common(p)
    p.add_argument("--gazetteer", required=True)
    p.add_argument("--gazetteer-format", default="csv")
    p.add_argument("--home", nargs="*", default=[])
    p.add_argument("--position", required=True, help="column with the 0-based row position")
    p = sub.add_parser("tokens", help="mean ± std of token columns per model")
    _common(p)
    p.add_argument("--columns", nargs="+", default=["English_a_tokens", "Chinese_a_tokens"])
    p = sub.add_parser("generate", help="prompt grid x runs -> answers from a client, one folder per output")
    p.add_argument("--prompts", required=True, help="table with template (and optional prompt_id)")
    p.add_argument("--conditions", required=True, help="table with condition, background (and optional disease)")
    p.add_argument("--locations", default=None, help="optional table with location")
    p.add_argument("--table-format", default="csv")
    p.add_argument("--client", required=True, help="module:function taking a prompt, returning text or None")
    p.add_argument("--model", required=True)
    p.add_argument("--language", default="English")
    p.add_argument("--runs", type=int, default=100)
    p.add_argument("--suffix", default=None)
    p.add_argument("--stop", nargs="*", default=[])
    p.add_argument("--sampling", nargs="*", default=None, metavar="KEY=VALUE", help="pass the sampling options (and changes to them) to the client")
    p.add_argument("--partitions", type=int, default=None)
    p.add_argument("--concurrency", type=int, default=1)
    p.add_argument("--pause-every", type=int, default=0)
    p.add_argument("--calls-per-second", type=int, help="bound on the calls of all tasks together (needs --budget)")
    p.add_argument("--budget", metavar="FOLDER", help="folder that all tasks mount, for the leases of --calls-per-second")
    p.add_argument("--ledger", help="folder of answered requests: a rerun asks only the others")
    p.add_argument("--pause", type=float, default=1.0)
    p.add_argument("--output", required=True)
    p = sub.add_parser("lengths", help="add character-length columns into a new dataset version")
    _common(p)
    p.add_argument("--version", required=True)
    p.add_argument("--columns", nargs="+", default=["English_a", "Chinese_a"])
    return ap


def _read_table(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.load(path)


def _load_client(spec: str):
    import importlib
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def _sampling(pairs: list[str] | None) -> dict | None:
    import json

    if pairs is None:
        return None
    from ..operators.generate import DEFAULT_SAMPLING

    return DEFAULT_SAMPLING | {k: json.loads(v) for k, _, v in (x.partition("=") for x in pairs)}


def _aliases(pairs: list[str] | None) -> dict:
    if pairs is None:
        return contingency.DEFAULT_ALIAS_RULES
    return {k: v.lower().split(",") for k, _, v in (x.partition("=") for x in pairs)}


def generate_answers(spark: SparkSession, a: argparse.Namespace) -> str:
    from ..operators import align, generate, throttle
    prompts = _read_table(spark, a.prompts, a.table_format)
    if "prompt_id" not in prompts.columns:
        prompts = align.dense_position(prompts, ["template"], name="prompt_id")
    conditions = _read_table(spark, a.conditions, a.table_format)
    carry = ["disease"] if "disease" in conditions.columns else []
    locations = _read_table(spark, a.locations, a.table_format) if a.locations else None
    grid = generate.prompt_grid(prompts, conditions, locations=locations, runs=a.runs, suffix=a.suffix,
                                carry=carry)
    if not carry:
        grid = grid.withColumn("disease", F.col("condition"))
    keys = ["disease"] + (["location"] if locations is not None else [])
    budget = None
    if a.calls_per_second:
        if not a.budget:
            raise ValueError("--calls-per-second needs --budget")
        budget = throttle.CallBudget(a.budget, a.calls_per_second)
    # with a ledger a rerun asks only what is not answered yet; the model's name is part of a request there
    where = {"resume": a.ledger, "keys": ["run", "prompt_id", "model_name", *keys]} if a.ledger else \
        {"partitions": a.partitions, "output": f"{a.output.rstrip('/')}-answers"}
    out = jobs.complete(generate.stamp(grid, {"model_name": a.model, "language": a.language}), _load_client(a.client),
                        number_by=keys, stop=a.stop or None, concurrency=a.concurrency, pause_every=a.pause_every,
                        pause=a.pause, sampling=_sampling(a.sampling), budget=budget, **where)
    files.write_partitioned(out.drop("template"), a.output, ["model_name", *keys, "language"], fmt="parquet")
    return a.output


def run(spark: SparkSession, argv: list[str]) -> DataFrame | str:
    a = build_parser().parse_args(argv)
    if a.job == "generate":
        return generate_answers(spark, a)
    if a.job == "chi-square" and a.from_reports:
        df = files.scan(spark, a.input, fmt=a.format, glob=a.glob)
    else:
        df = read_records(spark, a.input, a.format, a.glob, a.model, a.skip_corrupt, a.quarantine)
    if a.job == "coverage":
        out = jobs.coverage_report(jobs.coverage_summary(df, a.model), total=a.total or None)
    elif a.job == "location":
        gaz = _read_table(spark, a.gazetteer, a.gazetteer_format)
        out = coverage.location_summary(df, gaz, a.home or None, model=a.model)
    elif a.job == "age-profile":
        out = jobs.age_profile(df, a.columns, a.group, label_style=a.labels, wide=a.wide)
    elif a.job == "gender-profile":
        out = jobs.gender_profile(df, a.columns, a.group, wide=a.wide)
    elif a.job == "clean":
        cleaned = jobs.clean_genders(jobs.clean_ages(df, version=a.age_rules), rules=a.gender_rules)
        return files.write_version(cleaned.drop(files.FILE_NAME), a.output, a.version)
    elif a.job == "chi-square":
        real = contingency.real_from_report(_read_table(spark, a.real, a.real_format), label=a.label, group=a.group)
        rules = _aliases(a.alias)
        if a.from_reports:
            out = contingency.chi_square_from_reports(df, real, a.group, a.label, alias_rules=rules, alpha=a.alpha, expected=True)
        else:
            out = contingency.gender_chi_square(jobs.clean_genders(df), real, model=a.model, group=a.group, real_group=a.group,
                                                alias_rules=rules, alpha=a.alpha, expected=True)
        if out.isEmpty():
            raise ValueError("no counts to test: check --group, --label and --alias")
        files.write_report(out, f"{a.output.rstrip('/')}/combined", fmt=a.report_format)
        files.write_partitioned(out, f"{a.output.rstrip('/')}/split", ["model", "language", a.group], fmt=a.report_format)
        return a.output
    elif a.job == "audit":
        reports = jobs.gender_cleaning_reports(df, a.column, by=a.by)
        out = reports[1 if a.report == "audit" else 0]
    elif a.job == "out-of-home":
        gaz = _read_table(spark, a.gazetteer, a.gazetteer_format)
        out = coverage.out_of_home_rows(df, gaz, a.home or None, a.position, model=a.model)
    elif a.job == "tokens":
        out = contingency.token_summary(df, a.columns, a.model)
    else:  # lengths
        return files.write_version(jobs.add_lengths(df, a.columns).drop(files.FILE_NAME), a.output, a.version)
    files.write_report(out, a.output, fmt=a.report_format)
    return out


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("recordaudit").getOrCreate()
    run(spark, list(sys.argv[1:] if argv is None else argv))


if __name__ == "__main__":
    main()
