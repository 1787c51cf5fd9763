"""Passages of evaluation items inside corpus documents.

Method: template canonicalisation. Numbers, units and all words but function
words are replaced by typed placeholders, windows of WINDOW canonical words are hash-joined between
corpus and items, and the slots of matching windows are compared: all equal is
a verbatim leak, a one-to-one renaming is a re-parameterised question. The
placeholder is a function of the word alone, so equal word windows always have
equal templates and no verbatim leak is missed.

In a re-parameterised window few content words may differ, so of their places,
dealt into one part more than may differ, one part is untouched: the hash join
takes the template together with the words of a part. That loses no pair, and a
template that is frequent in the corpus (twelve content words in code) isn't
joined by its form alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.llm import textscan as ts

WINDOW = 12
#: Characters of items sent to the executors at once (a quarter of it for re-parameterised leaks); more items are handled in several blocks.
ITEM_BLOCK = 4_000_000
#: Words for numbers.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million billion first second third fourth fifth sixth seventh eighth ninth tenth"
).split()
#: Words for units of measure.
UNIT_WORDS = (
    "unit units second seconds minute minutes hour hours day days night nights week weeks month months year years clock meter meters metre metres "
    "kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms kg km cm mm ms pound pounds ounce ounces ton tons liter liters "
    "litre litres gallon gallons degree degrees percent dollar dollars euro euros cent cents byte bytes kb mb gb copies crates pieces items"
).split()
NUM, UNIT, NAME, LITERAL = 1, 2, 3, 16
#: Words that carry a sentence's form; each is always itself in a template.
FUNCTION_WORDS = (
    "a an the this that these those some any no each every either neither both all many much more most few less another other such same what which who whom "
    "whose when where why how if unless then else otherwise than because since while until before after as so though although whether and or nor but not of in on "
    "at by for from to into onto over under within without between through toward towards upon about above below beside beneath against along around with during "
    "per out up down off i you he she it we they me him us them my your his her its our their is are was were be been being am do does did done has have had "
    "having can could may might must shall should will would there here now only also too very just"
).split()
#: A word is a learned name where at least so many words fill the same place between two neighbours.
FILLERS = 4
#: Of a window's content words that are no number, unit or learned name at most one in so many may differ; else the form alone would match.
KEPT = 3
#: Places of a re-parameterised window whose words must be the item's own, at least: function words and content words that may not differ.
FIXED = 4


@dataclass
class Lexicon:
    """Known words by hash; code: place in the lexicon, kind: placeholder or the word itself."""

    hashes: np.ndarray
    codes: np.ndarray
    kinds: np.ndarray


@dataclass
class Words:
    owner: np.ndarray  # which text
    code: np.ndarray  # int64, equal for equal words
    kind: np.ndarray  # int64, the canonical word


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    points, _ = ts.code_points([t.lower() for t in texts])
    kind = ts.classes(drop_invisible=True)[points]
    seen = kind != ts.GONE
    points, kind = points[seen], kind[seen]
    word = kind <= ts.NUMBER
    edge = np.diff(np.r_[False, word, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(np.flatnonzero(kind == ts.END), starts)
    digits = np.r_[0, np.cumsum(kind == ts.NUMBER)]
    return points, starts, ends, owner, digits[ends] - digits[starts] == ends - starts


def words_of(texts: list[str], lexicon: Lexicon) -> Words:
    points, starts, ends, owner, numeric = _runs(texts)
    h = ts.run_hashes(points, starts, ends)
    at = np.minimum(np.searchsorted(lexicon.hashes, h), len(lexicon.hashes) - 1)
    known = lexicon.hashes[at] == h
    code = np.where(known, lexicon.codes[at], (h | np.uint64(1 << 63)).view(np.int64))
    kind = np.where(known, lexicon.kinds[at], np.where(numeric, NUM, NAME))
    return Words(owner, code, np.where(known & numeric, NUM, kind))


def plain_words(text: str) -> list[str]:
    points, starts, ends, _, _ = _runs([text])
    return ["".join(map(chr, points[a:b])) for a, b in zip(starts, ends, strict=True)]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of a text once without neighbours, and each word between two neighbours."""
    for batch in batches:
        for text in batch.column(0).to_pylist():
            t = plain_words(text)
            found = [(w, None, None) for w in sorted(set(t))] + list(zip(t[1:], t, t[2:], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(3)], names=["word", "before", "after"])


def learned_names(items: DataFrame) -> set[str]:
    """Words of all items that share a place between two neighbours with FILLERS words and are in a third of the items at most."""
    texts = items.where("text is not null").select(F.col("text").cast("string"))
    seen = texts.mapInArrow(_places, "word string, before string, after string")
    rare = seen.where("before is null").groupBy("word").count().where(F.col("count") <= max(2, texts.count() // 3))
    fillers = seen.where("before is not null").distinct()
    wide = fillers.groupBy("before", "after").count().where(F.col("count") >= FILLERS)
    names = fillers.join(wide, ["before", "after"], "left_semi").select("word").distinct().join(rare, "word", "left_semi")
    return {r["word"] for r in names.toLocalIterator()}


def build_lexicon(items: list[str], names: set[str] | None = None) -> tuple[Lexicon, np.ndarray]:
    """Words of the items with their placeholders, and the codes of the content words that aren't learned names.

    Without names only verbatim leaks matter, and every word that is no number
    or unit is itself; otherwise that holds for function words alone, and any
    other word is a placeholder.
    """
    numbers, units, form = set(NUMBER_WORDS), set(UNIT_WORDS), set(FUNCTION_WORDS)
    vocabulary = sorted({w for t in items for w in plain_words(t)} | numbers | units | form)
    literal = [names is None or w in form and w not in names for w in vocabulary]
    kinds = [NUM if w in numbers else UNIT if w in units else LITERAL + i if literal[i] else NAME for i, w in enumerate(vocabulary)]
    own = [i for i, w in enumerate(vocabulary) if kinds[i] == NAME and w not in names]
    points, _ = ts.code_points(vocabulary)
    sizes = np.array([len(w) for w in vocabulary])
    ends = np.cumsum(sizes + 1) - 1
    h = ts.run_hashes(points, ends - sizes, ends)
    order = np.argsort(h)
    return Lexicon(h[order], order.astype(np.int64), np.array(kinds, np.int64)[order]), np.array(own, np.int64)


def windows(words: Words, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Place of each window within one text, and the hash of its template."""
    n = len(words.kind) - size + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(words.owner[:n] == words.owner[size - 1 :])
    return at, ts.run_hashes(words.kind, at, at + size).view(np.int64)


def _window_batch(ids: pa.Array, words: Words, at: np.ndarray, key: np.ndarray, id_name: str, size: int) -> pa.RecordBatch:
    codes = words.code[ts.spread(at, np.full(len(at), size))]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * size, pa.int32()), pa.array(codes, pa.int64()))
    firsts = np.r_[0, np.flatnonzero(np.diff(words.owner)) + 1] if len(words.owner) else np.empty(0, np.int64)
    place = at - firsts[np.searchsorted(firsts, at, "right") - 1] if len(at) else at
    return pa.RecordBatch.from_arrays([ids.take(pa.array(words.owner[at])), pa.array(place, pa.int32()), pa.array(key, pa.int64()), lists], names=[id_name, "place", "key", "codes"])


def _part_keys(words: Words, at: np.ndarray, template: np.ndarray, mask: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window's template and of its words at the places in the mask."""
    h = template.view(np.uint64) ^ (mask.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in range(size):
        w = (words.code[at + i].view(np.uint64) + np.uint64(i + 1)) * np.uint64(0xD6E8FEB86659FD93)
        w ^= w >> np.uint64(32)
        h = np.where(mask >> i & 1, (h ^ w) * np.uint64(0xBF58476D1CE4E5B9), h)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _parts(own: np.ndarray, literal: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, mask): the parts of each item window's places, and all places, by which verbatim windows meet.

    own: windows x size, the content words that are no number, unit or learned
    name; literal: their number of other words that stand for themselves. A
    window with fewer than FIXED words to be kept has no parts.
    """
    n = own.sum(1)
    may = n // KEPT
    bit = np.int64(1) << np.arange(size, dtype=np.int64)
    turn = np.cumsum(own, 1) - 1
    which, masks = [np.arange(len(own))], [np.full(len(own), (1 << size) - 1, np.int64)]
    fit = literal + n - may >= FIXED
    for part in range(size // KEPT + 1):
        some = np.flatnonzero(fit & (part <= may))
        which.append(some)
        masks.append(((own & (turn % (may + 1)[:, None] == part))[some] * bit).sum(1))
    return np.concatenate(which), np.concatenate(masks)


def _item_blocks(items: DataFrame, most: int) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, size = [], [], 0
    for r in items.where("text is not null").select("item_id", "text").toLocalIterator():
        if texts and size + len(r["text"]) > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"])
    if texts:
        yield ids, texts


def matching_windows(docs: DataFrame, items: DataFrame, size: int = WINDOW, renamed: bool = True) -> DataFrame:
    """doc_id, place, codes and item_id, item_codes, item_own of window pairs with one template.

    item_own: places in the window whose word is a content word and no number,
    unit or learned name. With `renamed` the pairs are those that can be a
    verbatim or a re-parameterised leak (a pair may come more than once);
    without, they suffice for verbatim leaks only.

    docs: doc_id, text; items: item_id, text (both bigint ids; further columns
    are ignored). Words are maximal runs of letters and digits, lower-cased,
    after removal of invisible characters. Null, empty and short texts have no
    windows. Items are taken block by block, each of a bounded size, whose
    window hashes are broadcast; every document is scanned whole.
    """
    spark = docs.sparkSession
    kinds = "doc_id bigint, place int, key bigint, codes array<bigint>"
    out = None
    names = learned_names(items) if renamed else None
    for ids, texts in _item_blocks(items, ITEM_BLOCK // 4 if renamed else ITEM_BLOCK):
        lexicon, content = build_lexicon(texts, names)
        words = words_of(texts, lexicon)
        at, template = windows(words, size)
        places = at[:, None] + np.arange(size)
        own = np.isin(words.code, content)[places] & (words.kind[places] == NAME)
        key, masks = template, None
        if renamed:
            which, mask = _parts(own, (words.kind[places] >= LITERAL).sum(1), size)
            masks = np.unique(np.stack([template[which], mask], 1), axis=0) if len(which) else np.empty((0, 2), np.int64)
            at, template, own = at[which], template[which], own[which]
            key = _part_keys(words, at, template, mask, size)
        side = pa.Table.from_batches([_window_batch(pa.array(ids, pa.int64()), words, at, key, "item_id", size)])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(own.sum(1))], pa.int32()), pa.array(np.nonzero(own)[1], pa.int32()))
        side = spark.createDataFrame(side.rename_columns(["item_id", "item_place", "key", "item_codes"]).append_column("item_own", lists))
        sent = spark.sparkContext.broadcast((lexicon, np.unique(template), np.unique(key), masks))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lexicon, templates, keys, masks = sent.value
            if not len(keys):
                return
            for batch in batches:
                for first, held in ts.blocks(batch.column(1).to_pylist()):
                    words = words_of(held, lexicon)
                    at, key = windows(words, size)
                    hit = templates[np.minimum(np.searchsorted(templates, key), len(templates) - 1)] == key
                    at, key = at[hit], key[hit]
                    if masks is not None and len(at):
                        # every part that item windows of this template have
                        lo, hi = (np.searchsorted(masks[:, 0], key, side) for side in ("left", "right"))
                        part = ts.spread(lo, hi - lo)
                        at, template = np.repeat(at, hi - lo), np.repeat(key, hi - lo)
                        key = _part_keys(words, at, template, masks[part, 1], size)
                        hit = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
                        at, key = at[hit], key[hit]
                    if len(at):
                        yield _window_batch(batch.column(0).slice(first, len(held)), words, at, key, "doc_id", size)

        found = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("text is not null").mapInArrow(scan, kinds)
        pairs = found.join(F.broadcast(side), "key")  # bounded by ITEM_BLOCK
        out = pairs if out is None else out.unionByName(pairs)
    return out if out is not None else spark.createDataFrame([], "key bigint, doc_id bigint, place int, codes array<bigint>, item_id bigint, item_place int, item_codes array<bigint>, item_own array<int>")


def verbatim(pairs: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows where every slot of a window has the item's own words."""
    same = pairs.where("codes = item_codes")
    return same.groupBy("doc_id", "item_id").agg(F.count_distinct("place").alias("n_windows"))


def reparameterised(pairs: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows: every document and item whose template it holds with other values.

    A window counts if its slots map one-to-one onto the item's, at least one
    differs, of the content words that are no number, unit or learned name at
    most one in KEPT does, and FIXED of its words at least must be the item's. Pairs that are also verbatim leaks elsewhere are kept.
    """
    zipped = F.size(F.array_distinct(F.arrays_zip("codes", "item_codes")))
    renamed = pairs.where((zipped == F.size(F.array_distinct("codes"))) & (zipped == F.size(F.array_distinct("item_codes"))) & F.expr("codes != item_codes") & F.expr(f"{KEPT} * size(filter(item_own, i -> codes[i] != item_codes[i])) <= size(item_own)"))
    return renamed.groupBy("doc_id", "item_id").agg(F.count_distinct("place").alias("n_windows"))


def best_items(each: DataFrame) -> DataFrame:
    """doc_id, n_items, item_id, n_windows: one row per document of reparameterised().

    The number of items it matches, and the item with most windows (the lowest
    id of several).
    """
    best = F.max(F.struct("n_windows", (-F.col("item_id")).alias("i"))).alias("b")
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), best).select("doc_id", "n_items", (-F.col("b.i")).alias("item_id"), "b.n_windows")
