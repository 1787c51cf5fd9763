"""Encoding of a whole corpus with a byte-level BPE vocabulary.

Method: corpus-level merge replay. Texts are split into words with vectorised
character-class scans and held as codes of the distinct words of their block of
texts; the distinct words of the whole corpus are replayed once each: a task
lays out its share of them as one array of tokens, with an inverted index from
token pair to positions, and applies the merges in rank order, each to all
positions that hold its pair, updating only the touched neighbours. The ids
then return to the blocks' words, those of words that occur in most blocks by a
broadcast of a bounded number of them, the others by a shuffle in which no word
has more rows than a limit, and codes are replaced by ids block by block.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iolens import runtime
from iolens.llm import textscan as ts
from iolens.runtime import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words a task lays out at once.
REPLAYED = 200_000
#: Blocks a word may be in to meet them by the shuffle, at least.
LEAST_HOT = 50


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(extra)) for b in range(256)]


class Merges:
    """Initial ids of bytes, and for each mergeable pair its rank and the merged id."""

    def __init__(self, data: bytes):
        model = json.loads(data)["model"]
        vocab = model["vocab"]
        self.byte_ids = [vocab[s] for s in byte_symbols()]
        self.pairs: dict[int, int] = {}  # pair to rank
        self.made: list[int] = []  # rank to id
        self.parts: list[tuple[int, int]] = []
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = (vocab[a], vocab[b])
            self.pairs.setdefault(pair[0] << 20 | pair[1], rank)
            self.made.append(vocab[a + b])
            self.parts.append(pair)


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """ids of all words one after another, and the number of each word's ids."""
    first = merges.byte_ids
    pairs, made, parts = merges.pairs, merges.made, merges.parts
    token: list[int] = []
    before: list[int] = []  # the position before in the word, -1 at its start
    after: list[int] = []  # the next one, -1 at its end
    index: dict[int, list[int]] = {}
    get = pairs.get
    at = 0
    heads = []
    for w in words:
        heads.append(at)
        ids = [first[b] for b in w]
        n = len(ids)
        token += ids
        before += range(at - 1, at + n - 1)
        after += range(at + 1, at + n + 1)
        if n:
            before[at] = after[at + n - 1] = -1
            left = ids[0]
            for i in range(1, n):
                right = ids[i]
                rank = get(left << 20 | right)
                if rank is not None:
                    if rank in index:
                        index[rank].append(at + i - 1)
                    else:
                        index[rank] = [at + i - 1]
                left = right
        at += n
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        a, b = parts[rank]
        new = made[rank]
        places = index.pop(rank)
        places.sort()  # leftmost first, where occurrences overlap
        for p in places:
            if token[p] != a:
                continue
            q = after[p]
            if q < 0 or token[q] != b:
                continue
            token[p] = new
            token[q] = -1
            r = after[q]
            after[p] = r
            if r >= 0:
                before[r] = p
                k = get(new << 20 | token[r])
                if k is not None:
                    if k in index:
                        index[k].append(p)
                    else:
                        index[k] = [p]
                        heapq.heappush(heap, k)
            o = before[p]
            if o >= 0:
                k = get(token[o] << 20 | new)
                if k is not None:
                    if k in index:
                        index[k].append(o)
                    else:
                        index[k] = [o]
                        heapq.heappush(heap, k)
    ids = np.array(token, np.int32)
    alive = ids >= 0
    bounds = np.r_[0, np.cumsum(alive)]
    heads = np.array([*heads, len(ids)], np.int64)
    return ids[alive], np.diff(bounds[heads])


def word_starts(points: np.ndarray) -> np.ndarray:
    """Where words start, by the splitting pattern of byte-level vocabularies.

    Runs of letters, of numbers and of other characters, each with one blank
    before it; the endings 's 't 're 've 'm 'll 'd; white space but its last
    character before a word, or all of it at the end of a text.
    """
    kind = ts.classes()[points]
    n = len(points)
    prev = np.r_[np.uint8(ts.END), kind[:-1]]
    nxt = np.r_[kind[1:], np.uint8(ts.END)]
    after_blank = np.r_[False, points[:-1] == 0x20]
    white = kind == ts.SPACE
    start = ~white & (kind != prev) & ~after_blank
    start |= white & ((prev != ts.SPACE) | ((nxt != ts.SPACE) & (nxt != ts.END)))
    start |= kind == ts.END
    # endings with an apostrophe, where it starts a run and no blank belongs to it
    q = np.flatnonzero((points == 0x27) & start & (nxt == ts.LETTER))
    if len(q):
        pad = np.r_[points, np.full(2, ts.STOP, np.uint32)]
        x, y = pad[q + 1], pad[q + 2]
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        size = np.where(one, 1, np.where(two, 2, 0))
        q, size = q[size > 0], size[size > 0]
        start[q + 1] = False
        start[np.minimum(q + 1 + size, n - 1)] = True
    return np.flatnonzero(start)


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The number of each text's words, the codes of all words, and the distinct words by code."""
    points, stops = ts.code_points(texts)
    starts = word_starts(points)
    ends = np.r_[starts[1:], len(points)]
    real = points[starts] != ts.STOP
    owner = np.searchsorted(stops, starts[real])
    starts, ends = starts[real], ends[real]
    code, uniques = pd.factorize(ts.run_hashes(points, starts, ends))
    head = np.zeros(len(uniques), np.int64)
    head[code[::-1]] = np.arange(len(code))[::-1]
    # equal hashes must be equal words
    size = ends - starts
    same = size[head[code]] == size
    if same.all():
        at = ts.spread(starts, size)
        same = points[at] == points[ts.spread(starts[head[code]], size)]
    if not same.all():
        words = np.empty(len(starts), object)
        words[:] = [points[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        code, uniques = pd.factorize(words)
        head = np.zeros(len(uniques), np.int64)
        head[code[::-1]] = np.arange(len(code))[::-1]
    words = [points[a:b].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass") for a, b in zip(starts[head], ends[head], strict=True)]
    return np.bincount(owner, minlength=len(texts)), code, words


def joined(counts: np.ndarray, code: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of all texts, and the number of each text's, from words' codes and each word's ids."""
    first = np.r_[0, np.cumsum(n)[:-1]] if len(n) else n
    total = np.r_[0, np.cumsum(n[code])]
    bounds = np.r_[0, np.cumsum(counts)]
    return ids[ts.spread(first[code], n[code])], np.diff(total[bounds])


def encode(texts: list[str | None], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """ids of all texts of a list, and the number of each text's ids (0 for empty and null)."""
    out, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for _, held in ts.blocks(texts):
        counts, code, words = split(held)
        ids, n = joined(counts, code, *replay(words, merges))
        out.append(ids)
        sizes.append(n)
    return np.concatenate(out), np.concatenate(sizes)


def _coded(doc_columns: list[str]):
    """Texts (column 1) as packed codes of their block's words; the first row of a block holds the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, held in ts.blocks(batch.column(1).to_pylist()):
                counts, code, words = split(held)
                packed = code.astype("<u2" if len(words) <= 1 << 16 else "<u4")
                bounds = np.r_[0, np.cumsum(counts)] * packed.itemsize
                data = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])
                lists = pa.array([words] + [None] * (len(held) - 1), pa.list_(pa.binary()))
                kept = [batch.column(i).slice(first, len(held)) for i in range(batch.num_columns) if i != 1]
                same = [pa.array(np.full(len(held), x), t) for x, t in ((block, pa.int64()), (packed.itemsize, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*kept, *same, data, lists], names=[*doc_columns, "block", "width", "codes", "words"])
                block += 1

    return run


def replayed_words(words: DataFrame, vocabulary: bytes) -> DataFrame:
    """word, n, ids: the ids of every distinct word (binary), each replayed once."""
    sent = words.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, held, size = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            tab = pa.Table.from_batches(held).combine_chunks()
            ids, n = replay(tab["word"].to_pylist(), merges)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids, pa.int32()))
            yield from tab.append_column("ids", lists).to_batches()

        for batch in batches:
            merges = merges or Merges(sent.value)
            held.append(batch)
            size += batch.num_rows
            if size >= REPLAYED:
                yield from done()
                held, size = [], 0
        if held:
            yield from done()

    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).mapInArrow(run, "word binary, n bigint, ids array<int>")


def _assembled(doc_columns: list[str]):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        docs, words = docs.combine_chunks(), words.combine_chunks()
        order = np.argsort(np.asarray(words["code"]))
        lists = words["ids"].combine_chunks().take(pa.array(order))
        ids, n = np.asarray(lists.flatten()), np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
        width = docs["width"][0].as_py()
        counts = np.asarray(pa.compute.binary_length(docs["codes"])).astype(np.int64) // width
        code = np.frombuffer(b"".join(docs["codes"].to_pylist()), f"<u{width}").astype(np.int64)
        ids, sizes = joined(counts, code, ids.astype(np.int32), n)
        out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(ids, pa.int32()))
        return pa.table([docs["doc_id"], out, *(docs[c] for c in doc_columns[1:])], names=["doc_id", "ids", *doc_columns[1:]])

    return run


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids (array<int>) of every row, without special tokens, whose strings are ordinary text.

    The columns named in `carried` follow as they are.

    Null and empty texts have the empty list. Texts are whole, however long;
    repeated and null doc_ids are kept. The vocabulary file is read on the
    driver and sent to the executors (about 1.5 MB, as large as the vocabulary).
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    own = {"doc_id": docs.schema[doc_id].dataType} | {c: docs.schema[c].dataType for c in carried}
    kinds = T.StructType([*(T.StructField(c, t) for c, t in own.items()), *(T.StructField(c, t) for c, t in (("block", T.LongType()), ("width", T.IntegerType()), ("codes", T.BinaryType()), ("words", T.ArrayType(T.BinaryType()))))])
    coded = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *carried).mapInArrow(_coded(list(own)), kinds)
    coded = written(coded, "coded")  # read once for the words and once for the texts
    uses = coded.where("words is not null").select("block", F.posexplode("words").alias("code", "word"))
    known = written(replayed_words(uses.select("word"), data), "replayed")
    n = known.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(LEAST_HOT, -(-n // max(1, runtime.BROADCAST_ROWS)))
    often = F.broadcast(known.where(hot).select("word", "ids"))  # BROADCAST_ROWS words at most
    rest = uses.join(often.select("word"), "word", "left_anti").join(known.where(~hot).select("word", "ids"), "word")
    ready = uses.join(often, "word").unionByName(rest).select(F.col("block").alias("of"), "code", "ids")
    result = T.StructType([T.StructField("doc_id", own.pop("doc_id")), T.StructField("ids", T.ArrayType(T.IntegerType())), *(T.StructField(c, t) for c, t in own.items())])
    return coded.drop("words").groupBy("block").cogroup(ready.groupBy("of")).applyInArrow(_assembled(["doc_id", *own]), result)
