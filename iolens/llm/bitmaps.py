"""Exact distinct counts from compressed bitmaps that merge by OR and AND.

Method: identifiers are dictionary-encoded to dense integers, bitmaps are built
per group and bucket of 2**16 integers, and bits are counted; the error is
zero. The dictionary is made of the distinct identifiers; each of its shards
numbers its own from 0, so no step needs one task, and a bucket is (shard, high
bits). A bucket with at most 4096 identifiers is stored as a sorted list of
their low 16 bits, a fuller one as 8 KB of bits. Rows are reduced to distinct
(group, identifier) pairs first. Identifiers with the most pairs are looked up
where the pairs lie, the others meet their pairs by a shuffle in which none has
more than a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens import runtime
from iolens.functions.arrow import starts
from iolens.runtime import written

#: A list of two bytes each up to here, bits beyond: both take 8 KB at most.
LISTED = 4096
#: Pairs an identifier may have in one task of the shuffle, at least.
LEAST_HOT = 1000


def pack(low: np.ndarray) -> bytes:
    """A bucket of sorted distinct 16-bit integers, compressed."""
    if len(low) <= LISTED:
        return low.astype("<u2").tobytes()
    bits = np.zeros(65536, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes() + b"\0"  # one byte more than any list


def unpack(data: bytes) -> np.ndarray:
    if len(data) <= 2 * LISTED:
        return np.frombuffer(data, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)[:8192], bitorder="little"))


def combine(parts: list[bytes], how: str) -> np.ndarray:
    """The union (or) or intersection (and) of buckets."""
    if how == "and":
        out = unpack(parts[0])
        for p in parts[1:]:
            out = np.intersect1d(out, unpack(p), assume_unique=True)
        return out
    bits = np.zeros(65536, bool)
    for p in parts:
        bits[unpack(p)] = True
    return np.flatnonzero(bits)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[kind]


def encoded(pairs: DataFrame, value: str) -> DataFrame:
    """pairs with shard and id of the identifier.

    pairs: rows with an identifier; null ones are left out. The limit above
    which identifiers are sent to the pairs grows with the data, so that at
    most BROADCAST_ROWS lie above it.
    """
    pairs = written(pairs.where(F.col(value).isNotNull()), "pairs")
    each = pairs.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.monotonically_increasing_id())
    # written, so that every use sees the same numbers; a partition counts its rows from 0 in the low 33 bits
    known = written(each.select(value, "_n", F.shiftright("_k", 33).cast("int").alias("shard"), F.expr("_k & 8589934591L").alias("id")), "dictionary")
    n = known.agg(F.sum("_n")).first()[0] or 0
    hot = F.col("_n") > max(LEAST_HOT, -(-n // max(1, runtime.BROADCAST_ROWS)))
    first = F.broadcast(known.where(hot).drop("_n"))
    rest = pairs.join(first.select(value), value, "left_anti").join(known.where(~hot).drop("_n"), value)
    return pairs.join(first, value).unionByName(rest).select(*pairs.columns, "shard", "id")


def _folded(df: DataFrame, keys: list[str], data: str, how: str, local: bool = False) -> DataFrame:
    """One packed bucket per distinct keys, from integers (data: low) or packed buckets (bits); local: per partition only.

    Of the bucket that goes on in the next batch only the set so far is held.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema if f.name in keys}
    out = pa.schema([(k, _arrow(kinds[k])) for k in keys] + [("bits", pa.binary()), ("n", pa.int64())])
    make = (lambda col: np.unique(np.asarray(col))) if data == "low" else (lambda col: combine(col.to_pylist(), how))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(heads: pa.Table, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            full = heads.append_column("bits", pa.array([pack(s) for s in sets], pa.binary())).append_column("n", pa.array([len(s) for s in sets], pa.int64()))
            yield from full.cast(out).combine_chunks().to_batches()

        open_key: pa.Table | None = None
        so_far = np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            tab = pa.Table.from_batches([batch])
            col, head = tab[data].combine_chunks(), tab.select(keys)
            first = starts(tab, keys)
            ends = np.r_[first[1:], tab.num_rows]
            if open_key is not None:
                if len(starts(pa.concat_tables([open_key, head.slice(0, 1)]), keys)) == 1:
                    more = make(col.slice(0, ends[0]))
                    so_far = np.intersect1d(so_far, more) if how == "and" else np.union1d(so_far, more)
                    first, ends = first[1:], ends[1:]
                    if not len(first):
                        continue
                yield from done(open_key, [so_far])
            if len(first) > 1:
                yield from done(head.take(pa.array(first[:-1])), [make(col.slice(a, b - a)) for a, b in zip(first[:-1], ends[:-1], strict=True)])
            open_key, so_far = head.slice(int(first[-1]), 1), make(col.slice(first[-1], ends[-1] - first[-1]))
        if open_key is not None:
            yield from done(open_key, [so_far])

    ready = df.select(*keys, data)
    ready = (ready if local else ready.repartition(*keys)).sortWithinPartitions(*keys)
    return ready.mapInArrow(fold, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", bits binary, n bigint")


def bitmaps(coded: DataFrame, dims: list[str]) -> DataFrame:
    """dims, shard, hi, bits, n: the mergeable partial result, from `encoded` pairs distinct in dims and identifier."""
    low = coded.select(*dims, "shard", F.shiftright("id", 16).cast("int").alias("hi"), F.expr("cast(id & 65535 as int)").alias("low"))
    return _folded(low, [*dims, "shard", "hi"], "low", "or")


def merge(maps: DataFrame, dims: list[str], how: str = "or") -> DataFrame:
    """Bitmaps of finer groups, days or partitions as those of `dims`: united (or) or intersected (and).

    For `and`, every operand must have the bucket; buckets an operand lacks
    must have been dropped by the caller (see both). Unions are made within
    partitions before the shuffle, so a coarse group has a row per bucket and
    partition at most.
    """
    keys = [*dims, "shard", "hi"]
    if how == "or":
        maps = _folded(maps, keys, "bits", how, local=True)
    return _folded(maps, keys, "bits", how)


def both(a: DataFrame, b: DataFrame, dims: list[str]) -> DataFrame:
    """Intersection of two sets of bitmaps per dims."""
    keys = [*dims, "shard", "hi"]
    two = a.select(*keys, "bits").unionByName(b.select(*keys, "bits"))
    whole = two.groupBy(*keys).agg(F.collect_list("bits").alias("all")).where("size(all) = 2")
    return merge(whole.select(*keys, F.explode("all").alias("bits")), dims, "and")


def counted(maps: DataFrame, dims: list[str]) -> DataFrame:
    """dims, n_distinct: the bits of a group's buckets, which hold no identifier twice."""
    return maps.groupBy(*dims).agg(F.sum("n").alias("n_distinct"))
