"""Scoring of abusive, hateful and sexual language in whole texts.

Method: a convolutional text classifier, trained here in numpy: hashed word
embeddings, filters of several widths over consecutive words, max pooling over
the whole text and a logistic output; thresholds are calibrated by language on
held-out ratings. Trainings run as tasks side by side. Words are folded first, so that other spellings (look-alike
letters, digits for letters, spaced or repeated letters, masked words) meet the
plain ones. For scoring, each hashed word's share in each filter is a table row,
so a text costs a few look-ups per word.
"""

from __future__ import annotations

import hashlib
import pickle
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iolens.llm import textscan as ts
from iolens.llm.seeds import ABUSIVE, HARMLESS
from iolens.runtime import shared_dir, written

#: Rated documents used for training, at most; the lowest by hash of doc_id.
MAX_RATED = 3000
#: Their words together, at most (12 bytes each on the driver); documents come in the order of that hash, whole.
MAX_WORDS = 4_000_000
BUCKETS = 1 << 15
DIM, FILTERS, WIDTHS = 12, 12, (1, 2, 3, 4)
PAD, NUMBER_WORD, HEX_WORD, MASKED_WORD, UNKNOWN_WORD, FIRST = 0, 1, 2, 3, 4, 8
#: Places of the filter that tells words of the rated texts from others.
SEEN = 1 << 21
#: A rating that held-out scores contradict counts this much.
DOUBTED = 0.2
EPOCHS, BATCH, RATE = 12, 48, 0.08
FOLDS = 3
#: Ratings of a language count against so many of all languages when its threshold is set.
PRIOR = 20
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("авеорсухіѕјԁһԛԝαεικορτυχ", "abeopcyxisjdhqwaeikoptux", strict=True))
#: Characters written for letters.
FOR_LETTERS = dict(zip("01345789@$", "oieastbgas", strict=True))

_tables: dict[str, np.ndarray] = {}


def _fold_table() -> np.ndarray:
    """The lower-case base letter of each code point."""
    if "fold" not in _tables:
        out = np.arange(ts.STOP + 1, dtype=np.uint32)
        for a, b in ((0, 0x3000), (0xFB00, 0xFB07), (0xFF00, 0xFFF0), (0x1D400, 0x1D800)):
            for c in range(a, b):
                low = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", chr(c)).lower())
                base = low[:1]
                out[c] = ord(LOOKALIKES.get(base, base) or chr(c))
        _tables["fold"] = out
        gone = np.zeros(ts.STOP + 1, bool)
        gone[ts.INVISIBLE] = True
        gone[[c for c in range(0x300, 0x3000) if unicodedata.category(chr(c)) == "Mn"]] = True
        _tables["gone"] = gone
        upper = np.zeros(ts.STOP + 1, bool)
        upper[[c for c in range(0x3000) if chr(c).isupper()]] = True
        _tables["upper"] = upper
        letter = np.arange(ts.STOP + 1, dtype=np.uint32)
        for k, v in FOR_LETTERS.items():
            letter[ord(k)] = ord(v)
        _tables["letter"] = letter
    return _tables["fold"]


def _spelled_out(points: np.ndarray) -> np.ndarray:
    """False at blanks or underscores between single letters, where at least three letters follow each other so."""
    word = ts.classes()[points] == ts.LETTER
    edge = np.diff(np.r_[False, word, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = np.ones(len(points), bool)
    single = starts[ends - starts == 1]
    near = np.empty(0, np.int64)
    if len(single) > 2:
        between = points[single[:-1] + 1]
        near = np.flatnonzero((np.diff(single) == 2) & ((between == 0x20) | (between == 0x5F)))
    if len(near):
        joined = np.zeros(len(single), bool)
        joined[near] = True
        before, after = np.r_[False, joined[:-1]], np.r_[joined[1:], False]
        keep[single[joined & (before | after)] + 1] = False
    return keep


def folded_words(texts: list[str], seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of all texts, and the text of each; words not marked in `seen` (if given) share one bucket."""
    word, _, owner = _folded(texts, seen)
    return word, owner


def _folded(texts: list[str], seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As folded_words, with each word's mark between."""
    fold = _fold_table()
    points, _ = ts.code_points(texts)
    points = points[~_tables["gone"][points]]
    points = points[_spelled_out(points)]
    low, upper = fold[points], _tables["upper"][points]
    kind = ts.classes()[low]
    letter, digit = kind == ts.LETTER, (low >= 0x30) & (low <= 0x39)
    sign = (low == 0x40) | (low == 0x24)
    star = low == 0x2A
    left = np.r_[False, letter[:-1]]
    masked = star & (left | np.r_[False, star[:-1] & np.r_[False, letter[:-2]]]) if len(low) > 2 else star & False
    near = sign & (left | np.r_[letter[1:], False] | np.r_[False, sign[:-1]] | np.r_[digit[1:], False])
    part = letter | digit | near | masked
    cjk = (low >= 0x3040) & (low <= 0x9FFF)
    new = part & ~np.r_[False, part[:-1]]
    new |= part & (cjk | np.r_[False, cjk[:-1]])
    camel = upper & np.r_[False, letter[:-1] & ~upper[:-1]]
    new |= camel & letter
    # a repeated letter counts once, whether written as a letter or not
    spelt = _tables["letter"][low]
    part &= ~((letter | digit) & ~new & np.r_[False, spelt[1:] == spelt[:-1]])
    owner_at = np.cumsum(kind == ts.END)
    low, new, letter, digit, masked, owner_at = low[part], new[part], letter[part], digit[part], masked[part], owner_at[part]
    starts = np.flatnonzero(new)
    if not len(starts):
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(low)]
    letters, digits = np.add.reduceat(letter.astype(np.int32), starts), np.add.reduceat(digit.astype(np.int32), starts)
    hexed = np.add.reduceat((digit | ((low >= 0x61) & (low <= 0x66))).astype(np.int32), starts)
    stars = np.add.reduceat(masked.astype(np.int32), starts)
    size = ends - starts
    h = ts.run_hashes(_tables["letter"][low], starts, ends)
    word = (h % np.uint64(BUCKETS - FIRST)).astype(np.int32) + FIRST
    mark = (h >> np.uint64(40)).astype(np.int64) % SEEN
    if seen is not None:
        word[seen[mark] == 0] = UNKNOWN_WORD
    word[stars >= 2] = MASKED_WORD
    word[(hexed == size) & (size >= 7) & (digits > 0)] = HEX_WORD
    word[(letters == 0) | (digits > 3)] = NUMBER_WORD
    return word, mark, owner_at[starts]


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray] = field(default_factory=list)  # width x DIM x FILTERS each
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(0))
    base: float = 0.0

    def parts(self) -> list[np.ndarray]:
        """For each width, each word's share in each filter at each place: width x BUCKETS x FILTERS."""
        return [np.einsum("bd,kdf->kbf", self.table, f).astype(np.float32) for f in self.filters]


def _padded(word: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of n texts with pads after each, and where each text starts."""
    gap = max(WIDTHS)
    counts = np.bincount(owner, minlength=n)
    starts = np.r_[0, np.cumsum(counts + gap)[:-1]]
    out = np.full(int(counts.sum()) + gap * (n + 1), PAD, np.int32)
    first = np.r_[0, np.cumsum(counts)[:-1]]
    out[starts[owner] + np.arange(len(word)) - first[owner]] = word
    return out, starts


def scores(model: Model, parts: list[np.ndarray], word: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The score in (0, 1) of each of n texts."""
    idx, starts = _padded(word, owner, n)
    m = len(idx) - max(WIDTHS)
    logit = np.full(n, model.base, np.float64)
    for i, w in enumerate(WIDTHS):
        z = parts[i][0][idx[:m]]
        for k in range(1, w):
            z += parts[i][k][idx[k : k + m]]
        top = np.maximum.reduceat(z, starts, axis=0) + model.bias[i]
        logit += np.maximum(top, 0) @ model.out[i * FILTERS : (i + 1) * FILTERS]
    return 1 / (1 + np.exp(-logit))


def train(docs: list[np.ndarray], target: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fits the network to texts (arrays of hashed words) by adaptive gradient steps."""
    rng = np.random.default_rng(seed)
    n = len(docs)
    table = rng.normal(0, 0.1, (BUCKETS, DIM))
    # the first dimension starts as each word's log odds among the rated texts
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for d, t, w in zip(docs, target, weight, strict=True):
        u = np.unique(d)
        pos[u] += t * w
        neg[u] += (1 - t) * w
    odds = np.log((pos + 0.3) / (pos.sum() / max(1, neg.sum()) * neg + 0.3))
    table[:, 0] = np.clip(odds, -2, 2) / 2
    table[[PAD, UNKNOWN_WORD]] = 0
    model = Model(table)
    for w in WIDTHS:
        f = rng.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS))
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.5 / w
        model.filters.append(f)
        model.bias.append(np.full(FILTERS, 0.0))
    model.out = np.concatenate([np.where(np.arange(FILTERS) < FILTERS // 2, 0.3, rng.normal(0, 0.1, FILTERS)) for _ in WIDTHS])
    model.base = -2.0
    seen: dict[str, np.ndarray | float] = {}

    def step(name: str, value, grad):
        g = seen.get(name, 1e-3) + grad * grad
        seen[name] = g
        return value - RATE * grad / np.sqrt(g)

    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            at = order[a : a + BATCH]
            own = [docs[i] for i in at]
            word, owner = np.concatenate(own), np.repeat(np.arange(len(at)), [len(x) for x in own])
            word = np.where(rng.random(len(word)) < 0.1, PAD, word)  # words left out
            idx, starts = _padded(word, owner, len(at))
            m = len(idx) - max(WIDTHS)
            emb = model.table[idx].astype(np.float32)
            where, value = [], []
            ends = np.r_[starts[1:], m]
            for i, w in enumerate(WIDTHS):
                z = emb[:m] @ model.filters[i][0].astype(np.float32)
                for k in range(1, w):
                    z += emb[k : k + m] @ model.filters[i][k].astype(np.float32)
                top = np.stack([z[s:e].argmax(0) + s for s, e in zip(starts, ends, strict=True)])
                where.append(top)
                value.append(np.take_along_axis(z, top, 0) + model.bias[i])
            pooled = np.concatenate(value, 1)
            alive = pooled > 0
            drop = rng.random(pooled.shape) > 0.2
            act = np.where(alive & drop, pooled, 0) / 0.8
            p = 1 / (1 + np.exp(-(act @ model.out + model.base)))
            d = (p - target[at]) * weight[at] / len(at)
            g_act = d[:, None] * model.out[None] * (alive & drop) / 0.8
            rows, grads = [], []
            for i, w in enumerate(WIDTHS):
                g = g_act[:, i * FILTERS : (i + 1) * FILTERS]
                gf = np.empty_like(model.filters[i])
                for k in range(w):
                    e = emb[where[i] + k]  # texts x FILTERS x DIM
                    gf[k] = np.einsum("tfd,tf->df", e, g)
                    rows.append(idx[where[i] + k].ravel())
                    grads.append((g[:, :, None] * model.filters[i][k].T[None]).reshape(-1, DIM))
                model.filters[i] = step(f"f{i}", model.filters[i], gf + 1e-4 * model.filters[i])
                model.bias[i] = step(f"b{i}", model.bias[i], g.sum(0))
            model.out = step("out", model.out, act.T @ d + 1e-4 * model.out)
            model.base = float(step("base", model.base, d.sum()))
            r, g = np.concatenate(rows), np.concatenate(grads)
            u, inv = np.unique(r, return_inverse=True)
            total = np.zeros((len(u), DIM))
            np.add.at(total, inv, g)
            total[(u == PAD) | (u == UNKNOWN_WORD)] = 0
            acc = seen.setdefault("table", np.full((BUCKETS, DIM), 1e-3))
            acc[u] += total * total
            model.table[u] -= RATE * total / np.sqrt(acc[u])
    return model


def best_threshold(score: np.ndarray, target: np.ndarray) -> float:
    """The threshold with the best F1; midway between neighbouring scores."""
    if not len(score) or not (target >= 0.5).any():
        return 0.5
    order = np.argsort(-score)
    s, hit = score[order], (target[order] >= 0.5).astype(float)
    tp = np.cumsum(hit)
    f1 = 2 * tp / (np.arange(1, len(s) + 1) + hit.sum())
    i = int(f1.argmax())
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else 0)) / 2)


@dataclass
class Classifier:
    model: Model
    threshold: float
    by_lang: dict[str | None, float]
    seen: np.ndarray
    #: (lang, rated, of them abusive, flagged, rightly flagged) of held-out documents, against their ratings as given
    held_out: list[tuple] = field(default_factory=list)

    def limits(self, lang: list[str | None]) -> np.ndarray:
        return np.array([self.by_lang.get(x, self.threshold) for x in lang])


@dataclass
class Sample:
    """Rated documents as hashed words, with their words' marks."""

    docs: list[np.ndarray]
    marks: list[np.ndarray]
    target: np.ndarray
    lang: list[str | None]

    def key(self) -> str:
        """A name that differs whenever the sample or a parameter of the network does."""
        h = hashlib.md5(repr((BUCKETS, DIM, FILTERS, WIDTHS, EPOCHS, BATCH, RATE, FOLDS, PRIOR, DOUBTED, self.lang, ABUSIVE, HARMLESS)).encode())
        for x in (*self.docs, *self.marks, self.target):
            h.update(np.ascontiguousarray(x).tobytes() + b"|")
        return h.hexdigest()


def hashed(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The hashed words of each text, and their marks."""
    word, mark, owner = _folded(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], [np.unique(mark[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def _trained(docs: list[np.ndarray], soft: np.ndarray, weight: np.ndarray, epochs: int, held: np.ndarray | None) -> tuple | np.ndarray:
    """The parts of the model of all texts, or the scores of the held-out ones by a model of the others."""
    if held is None:
        m = train(docs, soft, weight, epochs)
        return m.table, m.filters, m.bias, m.out, m.base
    own = np.setdiff1d(np.arange(len(docs)), held)
    m = train([docs[i] for i in own], soft[own], weight[own], epochs)
    kept = [docs[i] for i in held]
    return scores(m, m.parts(), np.concatenate(kept), np.repeat(np.arange(len(held)), [len(x) for x in kept]), len(held))


def _side_by_side(spark: SparkSession | None, docs: list[np.ndarray], soft: np.ndarray, jobs: list[tuple]) -> list:
    """A task per training; without a session one after another. The texts sent are bounded by MAX_WORDS."""
    if spark is None:
        return [_trained(docs, soft, *j) for j in jobs]
    sent = spark.sparkContext.broadcast((docs, soft, jobs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs, soft, jobs = sent.value
            yield pd.DataFrame({"k": pdf["k"], "made": [pickle.dumps(_trained(docs, soft, *jobs[k])) for k in pdf["k"]]})

    rows = spark.range(len(jobs)).selectExpr("cast(id as int) as k").repartitionById(len(jobs), "k").mapInPandas(run, "k int, made binary").collect()  # a row per training
    return [pickle.loads(r["made"]) for r in sorted(rows, key=lambda r: r["k"])]


def fit(sample: Sample, spark: SparkSession | None = None, seeds: bool = True) -> Classifier:
    """Trains on rated documents and (unless seeds is false) the seed phrases; thresholds from scores of held-out folds.

    Ratings that a first round of held-out scores contradicts weigh less in the
    second round and in the final training, since raters err now and then.
    """
    more = [*ABUSIVE, *HARMLESS] if seeds else []
    extra, marks = hashed(more) if more else ([], [])
    docs, target, n = [*sample.docs, *extra], sample.target, len(sample.docs)
    seen = np.zeros(SEEN, np.uint8)
    for m in (*sample.marks, *marks):
        seen[m] = 1
    t = np.r_[target, np.ones(len(ABUSIVE)), np.zeros(len(HARMLESS))] if seeds else target
    soft = 0.01 + 0.98 * t
    weight = np.ones(len(docs))
    folds = [np.arange(k, n, FOLDS) for k in range(FOLDS)] if n >= 2 * FOLDS else []

    def held_out(parts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(n)
        for at, s in zip(folds, parts, strict=True):
            out[at] = s
        return out

    first = held_out(_side_by_side(spark, docs, soft, [(weight, EPOCHS // 2, f) for f in folds]) if folds else [])
    limit = best_threshold(first, target)
    weight[:n] = np.where((target >= 0.5) & (first < limit / 2) | (target < 0.5) & (first > (1 + limit) / 2), DOUBTED, 1)
    *parts, model = _side_by_side(spark, docs, soft, [*((weight, EPOCHS, f) for f in folds), (weight, EPOCHS, None)])
    held = held_out(parts)
    sure = weight[:n] == 1
    whole = best_threshold(held[sure], target[sure])
    by_lang, quality = {}, []
    for x in sorted(set(sample.lang), key=str):
        own = np.array([y == x for y in sample.lang])
        at = own & sure
        k = int((target[at] >= 0.5).sum())
        by_lang[x] = (k * best_threshold(held[at], target[at]) + PRIOR * whole) / (k + PRIOR)
        flagged, bad = held[own] >= by_lang[x], target[own] >= 0.5
        quality.append((x, int(own.sum()), int(bad.sum()), int(flagged.sum()), int((flagged & bad).sum())))
    return Classifier(Model(*model), whole, by_lang, seen, quality)


def rated(docs: DataFrame, labels: DataFrame, most: int = MAX_RATED, words: int = MAX_WORDS) -> Sample:
    """Hashed words, mean ratings and languages of at most `most` rated documents of at most `words` words together.

    docs: doc_id, text, lang; labels: doc_id, toxic. Documents are scanned once
    and hashed where they lie; rows without text, and those beyond the bounds
    in the order of a hash of doc_id, are left out.
    """
    mean = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    some = mean.withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [hashed(held) for _, held in ts.blocks(pdf["text"].tolist())]
            words, marks = ([x.astype("<i4") for m in made for x in m[i]] for i in (0, 1))
            yield pdf.drop(columns="text").assign(words=[x.tobytes() for x in words], marks=[x.tobytes() for x in marks], n=list(map(len, words)))

    kept = docs.select(F.col("doc_id").cast("bigint"), "text", "lang").where("text is not null").join(F.broadcast(some), "doc_id")  # `most` rows
    kept = written(kept.select("doc_id", "lang", "toxic", "o", "text").mapInPandas(run, "doc_id bigint, lang string, toxic double, o bigint, words binary, marks binary, n bigint"), "rated")
    sizes = kept.groupBy("o", "doc_id").agg(F.sum("n").alias("n")).collect()  # `most` rows without their words
    sizes.sort(key=lambda r: (r["o"], r["doc_id"]))
    inside = [r["doc_id"] for r, s in zip(sizes, np.cumsum([r["n"] for r in sizes]), strict=True) if s <= words]
    rows = kept.where(F.col("doc_id").isin(inside)).collect()  # `words` words
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["words"])))
    words, marks = ([np.frombuffer(r[c], "<i4").astype(t) for r in rows] for c, t in (("words", np.int32), ("marks", np.int64)))
    return Sample(words, marks, np.array([float(r["toxic"]) for r in rows]), [r["lang"] for r in rows])


def fitted(spark: SparkSession, sample: Sample, anew: bool = False) -> Classifier:
    """The classifier of this very sample, kept in the shared folder; fitted where there is none yet, or anew."""
    path = f"{shared_dir(spark)}/iolens-abuse-{sample.key()}"
    whole = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not anew and whole.getFileSystem(spark._jsc.hadoopConfiguration()).exists(whole):
        return pickle.loads(spark.read.parquet(path).first()["model"])
    made = fit(sample, spark)
    spark.createDataFrame([(bytearray(pickle.dumps(made)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return made


def score_documents(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, source, lang, score, flagged of every document.

    docs: doc_id, text, lang, source (others are ignored). Null texts have a
    null score and aren't flagged; empty and blank ones are scored like any
    other; texts are scored whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        parts = c.model.parts()
        for pdf in batches:
            out = np.empty(len(pdf))
            for first, held in ts.blocks(pdf["text"].tolist()):
                word, owner = folded_words(held, c.seen)
                out[first : first + len(held)] = scores(c.model, parts, word, owner, len(held))
            limit = c.limits(list(pdf["lang"].where(pdf["lang"].notna(), None)))
            null = pdf["text"].isna().to_numpy()
            score = pd.Series(out, dtype="Float64")
            score[null] = pd.NA
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "lang": pdf["lang"], "score": score, "flagged": (out >= limit) & ~null})

    return docs.select("doc_id", "source", "lang", "text").mapInPandas(run, "doc_id bigint, source string, lang string, score double, flagged boolean")
