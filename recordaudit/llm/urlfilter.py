"""URL filter over a sorted digest array.

Rules are (host, path, action); a rule fits its host and all subdomains when the
url's path starts with the rule's path, and the longest fitting rule wins (ties:
the longer host).  The index holds, per shard file, the rules' 64-bit xxhash keys
in ascending order, then string offsets, actions and the rule strings.  Spark
builds it: rules are range-partitioned by key and each task writes its shard into
the shared folder; the driver sees only the manifest (key range and file of each
shard, and the host depths and path lengths that occur).

Probing: for each url the candidate rule strings are its host suffixes with a
depth that occurs, joined to its path prefixes with a length that occurs, so no
rule can be missed and nothing is capped.  The candidates of a batch are hashed,
sorted out by shard, and found by one vectorised binary search in the
memory-mapped key array; every hit is confirmed against the stored full string,
and keys that collide are walked through.  Shards are mapped one after another, so
a worker's memory does not grow with the list (a folder that is no mount is read
shard by shard instead).

Nulls: a null url, or one without ``://``, has empty host and path and fits no
rule.  A url that fits no rule gets the default verdict ``allow``: the filter is a
block list.  Rules given twice: block wins over allow.  Rules with a null host or
path are ignored.  An empty rule table leaves every url allowed.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, inline_table, new_folder, string_bytes, table

SEED = 42
HEAD = "<8sqq"  # magic, rules, bytes of strings
MAGIC = b"URLKEYS1"
#: The contract's rules.
RULES = [
    {"host": "net", "path": "/", "action": "block"},
    {"host": "example.net", "path": "/en/", "action": "allow"},
    {"host": "example.com", "path": "/de/", "action": "block"},
    {"host": "org", "path": "/fr/", "action": "allow"},
]
OUT_SCHEMA = "page_id bigint, host string, path string, rule string, verdict string"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build_index(rules: DataFrame, folder: str, shard_rules: int = 4_000_000) -> list[dict]:
    """Write the shards of ``rules`` (host, path, action) below ``folder``; returns the manifest."""
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = rules.where("host is not null and path is not null").select(lower.alias("host"), "path", "action") \
        .groupBy("host", "path").agg(F.max(F.col("action") == "block").alias("block")) \
        .withColumn("key", F.xxhash64(F.concat("host", "path")))
    shards = max(1, -(-keyed.count() // shard_rules))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]  # one shard
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        host, rest = (t[c].combine_chunks().cast(pa.large_string()) for c in ("host", "path"))
        keys = t["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys, kind="stable")
        strings, ends = string_bytes(pc.binary_join_element_wise(host, rest, pa.scalar("", pa.large_string())).take(pa.array(order)))
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.keys"
        with fs.open_output_stream(f"{root}/{name}") as out:
            out.write(struct.pack(HEAD, MAGIC, t.num_rows, int(ends[-1])))
            out.write(keys[order].tobytes())
            out.write(ends.astype(np.int64).tobytes())
            out.write(t["block"].to_numpy()[order].astype(np.uint8).tobytes())
            out.write(strings.tobytes())
        depth, size = pc.add(pc.count_substring(host, "."), 1), pc.utf8_length(rest)
        shapes = np.unique(np.stack([depth.to_numpy(), size.to_numpy()], axis=1), axis=0).tolist()
        yield pa.RecordBatch.from_pylist(
            [{"file": name, "lo": str(int(keys.min())), "hi": str(int(keys.max())),
              "depths": [d for d, _ in shapes], "lengths": [n for _, n in shapes]}],
            pa.schema([("file", pa.string()), ("lo", pa.string()), ("hi", pa.string()),
                       ("depths", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32()))]))

    path = f"{folder}/manifest"
    # unsigned order of the keys: flip the sign bit
    keyed.repartitionByRange(shards, F.col("key").bitwiseXOR(F.lit(-(1 << 63)))) \
        .mapInArrow(write, "file string, lo string, hi string, depths array<int>, lengths array<int>") \
        .write.parquet(path)
    return [r.asDict() for r in rules.sparkSession.read.parquet(path).collect()]  # one row per shard


class Shard:
    """One memory-mapped shard file."""

    def __init__(self, folder: str, name: str):
        fs, root = filesystem(folder)
        path = f"{root}/{name}"
        self.mapped = fs.type_name == "local"
        if self.mapped:
            raw = np.memmap(path, np.uint8, "r")
        else:
            with fs.open_input_file(path) as f:
                raw = np.frombuffer(f.read(), np.uint8)
        magic, n, size = struct.unpack(HEAD, raw[:struct.calcsize(HEAD)].tobytes())
        if magic != MAGIC:
            raise ValueError(f"{path} is no key file")
        at = struct.calcsize(HEAD)
        self.keys = raw[at:at + 8 * n].view(np.uint64)
        self.ends = raw[at + 8 * n:at + 16 * n + 8].view(np.int64)
        self.block = raw[at + 16 * n + 8:at + 17 * n + 8]
        self.text = raw[at + 17 * n + 8:at + 17 * n + 8 + size]

    def probe(self, keys: np.ndarray, strings: list[bytes]) -> dict[int, bool]:
        """position -> blocks, for the strings that are in the shard."""
        found = {}
        lo = np.searchsorted(self.keys, keys, "left")
        hi = np.searchsorted(self.keys, keys, "right")
        for i in np.flatnonzero(hi > lo):
            for k in range(lo[i], hi[i]):  # equal keys: several strings at most
                if self.text[self.ends[k]:self.ends[k + 1]].tobytes() == strings[i]:
                    found[int(i)] = bool(self.block[k])
        return found


def judge(urls: DataFrame, manifest: list[dict], folder: str) -> DataFrame:
    """``page_id, host, path`` -> the same with ``rule`` and ``verdict``."""
    shapes = sorted({(d, n) for m in manifest for d, n in zip(m["depths"], m["lengths"], strict=True)})
    ranges = [(m["file"], int(m["lo"]), int(m["hi"])) for m in manifest]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped: dict[str, Shard] = {}  # a memory map costs no memory of its own; elsewhere one shard is read at a time

        def shard(file: str) -> Shard:
            if file not in mapped:
                opened = Shard(folder, file)
                if not opened.mapped:
                    return opened
                mapped[file] = opened
            return mapped[file]

        for big in batches:
            for start in range(0, big.num_rows, 2000):
                batch = big.slice(start, 2000)
                hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
                strings: list[bytes] = []
                owner: list[tuple[int, int, int]] = []  # row, characters, host characters
                for row, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                    labels = host.split(".")
                    for depth, length in shapes:
                        if depth <= len(labels) and length <= len(path) and host:
                            suffix = ".".join(labels[len(labels) - depth:])
                            strings.append((suffix + path[:length]).encode())
                            owner.append((row, len(suffix) + length, len(suffix)))
                keys = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in strings), np.uint64, len(strings))
                best: dict[int, tuple[int, int, str, bool]] = {}
                for file, lo, hi in ranges:
                    inside = np.flatnonzero((keys >= np.uint64(lo)) & (keys <= np.uint64(hi)))
                    if not len(inside):
                        continue
                    order = inside[np.argsort(keys[inside], kind="stable")]
                    for j, block in shard(file).probe(keys[order], [strings[i] for i in order]).items():
                        i = int(order[j])
                        row, size, host_size = owner[i]
                        best[row] = max(best.get(row, (-1, -1, "", False)), (size, host_size, strings[i].decode(), block))
                rule = [best[i][2] if i in best else None for i in range(batch.num_rows)]
                verdict = ["block" if i in best and best[i][3] else "allow" for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("host"), batch.column("path"),
                     pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                    names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(probe, OUT_SCHEMA)


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Judge the ``url`` of every row of ``pages`` (page_id, url) by ``rules``."""
    folder = new_folder(pages.sparkSession, "url-keys")
    manifest = build_index(rules, folder)
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), url_host(F.col("url")).alias("host"),
                        url_path(F.col("url")).alias("path"))
    return judge(urls, manifest, folder)


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = inline_table(spark, RULES, "host string, path string, action string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rule_host, rule_path, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.action,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC, length(r.rule_host) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.rule_host OR p.host LIKE '%.' || r.rule_host) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
