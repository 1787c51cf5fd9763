"""Consolidation of very many small trace files into few well-sized ones.

Method: balanced longest-first scheduling. Every surviving file is assigned to
one of a fixed number of output groups with a least-loaded heap, longest first;
each group is a task of its own, streamed through pyarrow into one Parquet file,
and a manifest, verified against the counts of the input, is published in one
step. Records delivered more than once, within or across files, are kept in the
file of the lowest id only, before sizes are taken. A file beyond the target
size is scheduled in several pieces.
"""

from __future__ import annotations

import heapq
import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iolens.runtime import broadcast_if_small, fresh_dir, written

#: Bytes of record text an output file should hold.
TARGET = 32 << 20
#: Output files at least, so that readers can work side by side.
LEAST_GROUPS = 4
#: Files one scheduling task takes; more files are scheduled in several shards, each with groups of its own.
SHARD_FILES = 500_000


def parse_lines(payloads: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of (file_id, payload) to rows of every line that is one complete JSON object."""
    for pdf in payloads:
        rows = []
        for file_id, payload in zip(pdf["file_id"], pdf["payload"], strict=True):
            for line_no, line in enumerate((payload or "").split("\n")):
                text = line.strip()
                if text.endswith(","):
                    text = text[:-1].rstrip()
                if not text.startswith("{"):
                    continue
                try:
                    o = json.loads(text, parse_constant=_refused)
                except (ValueError, RecursionError):
                    continue
                args = o.get("args")
                host = args.get("hhash") if isinstance(args, dict) else None
                key = (host if host is None or isinstance(host, str) else json.dumps(host), _whole(o.get("pid")), _whole(o.get("id")))
                rows.append((file_id, line_no, *key, text if None in key else None, text))
        out = pd.DataFrame(rows, columns=["file_id", "line_no", "host_hash", "pid", "record_id", "lone", "line"])
        yield out.astype({"file_id": "Int64", "line_no": "Int64", "pid": "Int64", "record_id": "Int64"})


def _refused(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _whole(x: object) -> int | None:
    return x if isinstance(x, int) and not isinstance(x, bool) and -(2**63) <= x < 2**63 else None


def distinct_records(files: DataFrame) -> DataFrame:
    """Every distinct record of the payloads: file_id, host_hash, pid, record_id, line.

    The key is the record's own args.hhash, pid and id; parts that are missing
    or of another type are null. A record with such a part is told from others
    by its whole line (without blanks at both ends and the comma after it). Of
    several lines with one key the one in the lowest (file_id, line number)
    stays. Null or empty payloads and lines that aren't one complete JSON
    object give nothing.
    """
    kinds = "file_id bigint, line_no bigint, host_hash string, pid bigint, record_id bigint, lone string, line string"
    parsed = files.select("file_id", "payload").where("payload is not null").mapInPandas(parse_lines, kinds)
    kept = parsed.groupBy("host_hash", "pid", "record_id", "lone").agg(F.min(F.struct("file_id", "line_no", "line")).alias("r"))
    return kept.select("r.file_id", "host_hash", "pid", "record_id", "r.line")


def plan_groups(sizes: DataFrame, n_files: int, n_groups: int, target: int = TARGET) -> DataFrame:
    """file_id, groups: longest first, always to the least loaded group (the lowest of several).

    sizes: file_id, n_bytes. A file of more than `target` bytes is scheduled as
    so many equal pieces; `groups` has the group of each. A task streams a
    shard of the files, longest first, through a heap of its own groups; memory
    holds the heap alone.
    """
    shards = max(1, min(n_groups, -(-n_files // SHARD_FILES)))
    per = -(-n_groups // shards)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[int, list[tuple[int, int]]] = {}
        for pdf in batches:
            out = []
            for shard, n in zip(pdf["shard"], pdf["n_bytes"], strict=True):
                heap = heaps.setdefault(int(shard), [(0, int(shard) * per + g) for g in range(per)])
                load, group = heap[0]
                heapq.heapreplace(heap, (load + int(n), group))
                out.append(group)
            yield pd.DataFrame({"file_id": pdf["file_id"], "piece": pdf["piece"], "group_no": out})

    pieces = f"greatest(1, ceil(n_bytes / {target}))"
    spread = sizes.select("file_id", F.expr(f"ceil(n_bytes / {pieces})").alias("n_bytes"), F.explode(F.expr(f"sequence(1, {pieces})")).alias("piece"))
    spread = spread.withColumn("shard", F.expr(f"cast(pmod(xxhash64(file_id, piece), {shards}) as int)"))
    spread = spread.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("n_bytes"), "file_id", "piece")
    plan = spread.mapInPandas(assign, "file_id bigint, piece bigint, group_no bigint")
    each = plan.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("piece", "group_no"))).alias("p"))
    return each.select("file_id", F.col("p.group_no").alias("groups"))


def _write_groups(folder: str):
    kinds = pa.schema([("host_hash", pa.string()), ("pid", pa.int64()), ("record_id", pa.int64()), ("line", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        now, writer, name, done = None, None, "", []
        count = {"n_records": 0, "n_bytes": 0}

        def close() -> None:
            writer.close()
            done.append({"group_no": now, "file": name} | count)

        for batch in batches:
            groups = batch.column("group_no").to_numpy(zero_copy_only=False)
            cuts = [0, *(i + 1 for i in (groups[1:] != groups[:-1]).nonzero()[0]), len(groups)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if groups[a] != now:
                    if writer:
                        close()
                    now = int(groups[a])
                    name = f"group-{now:06d}-{uuid.uuid4().hex}.parquet"  # an attempt's own: a lost task leaves an orphan only
                    writer = pq.ParquetWriter(f"{root}/{name}", kinds, filesystem=fs, compression="zstd")
                    count = {"n_records": 0, "n_bytes": 0}
                part = batch.slice(a, b - a).select(kinds.names)
                writer.write_batch(part.cast(kinds))
                count["n_records"] += b - a
                count["n_bytes"] += int(pa.compute.sum(pa.compute.binary_length(part.column("line"))).as_py() or 0)
        if writer:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("group_no", pa.int64()), ("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return write


def compact(files: DataFrame, target: int = TARGET, folder: str | None = None) -> str:
    """Writes the distinct records of `files` (file_id, payload) as few files; returns the published folder.

    The folder holds group files and manifest.json, which names the valid ones;
    it appears in one step, after the records written have been counted
    against the records read. No records give a manifest without files.
    """
    spark = files.sparkSession
    records = written(distinct_records(files), "records")
    sizes = records.groupBy("file_id").agg(F.sum(F.octet_length("line")).alias("n_bytes"), F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.count(F.lit(1)).alias("files"), F.sum("n_bytes").alias("bytes"), F.sum("n").alias("n")).first()
    n_files, n_bytes, n_records = row["files"], row["bytes"] or 0, row["n"] or 0
    n_groups = max(1, min(n_files, LEAST_GROUPS), -(-n_bytes // target))
    plan = broadcast_if_small(plan_groups(sizes.select("file_id", "n_bytes"), n_files, n_groups, target), n_files)
    own = F.expr("p.groups[cast(pmod(xxhash64(r.line), size(p.groups)) as int)]")
    grouped = records.alias("r").join(plan.alias("p"), F.expr("r.file_id <=> p.file_id")).select(own.alias("group_no"), "r.*")
    folder = folder or fresh_dir(spark, "compacted")
    grouped = grouped.repartitionById(n_groups, F.col("group_no").cast("int")).sortWithinPartitions("group_no", "file_id")
    written_groups = grouped.mapInArrow(_write_groups(folder), "group_no bigint, file string, n_records bigint, n_bytes bigint").collect()  # a row per output file
    manifest = [r.asDict() for r in sorted(written_groups, key=lambda r: r["group_no"])]
    if (sum(m["n_records"] for m in manifest), sum(m["n_bytes"] for m in manifest)) != (n_records, n_bytes):
        raise RuntimeError("the files written don't hold the records read; nothing was published")
    _publish(folder, manifest)
    return folder


def _publish(folder: str, manifest: list[dict]) -> None:
    """One rename; on object stores, whose rename is a copy but whose files appear whole when closed, one write."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    renames = isinstance(fs, pafs.LocalFileSystem | pafs.HadoopFileSystem)
    with fs.open_output_stream(f"{root}/{'.manifest.tmp' if renames else 'manifest.json'}") as out:
        out.write(json.dumps({"version": 1, "groups": manifest}).encode())
    if renames:
        fs.move(f"{root}/.manifest.tmp", f"{root}/manifest.json")


def read_manifest(folder: str) -> list[dict]:
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())["groups"]


def read_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """host_hash, pid, record_id, line of the files the manifest names."""
    names = [os.path.join(folder, m["file"]) for m in read_manifest(folder)]
    kinds = "host_hash string, pid bigint, record_id bigint, line string"
    return spark.read.schema(kinds).parquet(*names) if names else spark.createDataFrame([], kinds)
