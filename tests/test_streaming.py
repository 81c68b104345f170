"""Incremental completion: a second run answers only the new grid file."""

import os
import sys
import tempfile

import pandas as pd
from pyspark import cloudpickle

from recordaudit.streaming import complete_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "prompt_id long, prompt string"


def shout(p):
    return None if p.endswith("9") else p.upper()


def test_restartable_stream(spark):
    root = tempfile.mkdtemp(prefix="recordaudit-stream-")
    src, sink, ckpt = (os.path.join(root, d) for d in ("grid", "answers", "ckpt"))
    os.makedirs(src)
    pd.DataFrame({"prompt_id": range(10), "prompt": [f"p{i}" for i in range(10)]}).to_parquet(
        os.path.join(src, "part-0.parquet"), index=False)
    q = complete_stream(spark, src, SCHEMA, shout, sink, ckpt, sleep=lambda s: None)
    q.awaitTermination()
    first = spark.read.parquet(sink)
    assert first.count() == 9 and first.where("prompt_id = 3").first().answer == "P3"
    pd.DataFrame({"prompt_id": range(10, 15), "prompt": [f"q{i}" for i in range(10, 15)]}).to_parquet(
        os.path.join(src, "part-1.parquet"), index=False)
    q = complete_stream(spark, src, SCHEMA, shout, sink, ckpt, sleep=lambda s: None, concurrency=4)
    q.awaitTermination()
    rows = spark.read.parquet(sink).collect()
    assert sorted(r.prompt_id for r in rows) == [i for i in range(15) if i != 9]


def test_partitioned_stream_sink(spark):
    root = tempfile.mkdtemp(prefix="recordaudit-stream-")
    src, sink, ckpt = (os.path.join(root, d) for d in ("grid", "answers", "ckpt"))
    os.makedirs(src)
    pd.DataFrame({"prompt_id": range(6), "prompt": [f"p{i}" for i in range(6)],
                  "disease": ["a", "b"] * 3}).to_parquet(os.path.join(src, "g.parquet"), index=False)
    q = complete_stream(spark, src, "prompt_id long, prompt string, disease string", shout, sink, ckpt,
                        sleep=lambda s: None, partition_by=["disease"])
    q.awaitTermination()
    assert sorted(d for d in os.listdir(sink) if d.startswith("disease=")) == ["disease=a", "disease=b"]
    assert spark.read.parquet(sink).count() == 6
