import os
import random

import numpy as np
import pytest

from iolens.llm import abuse as A
from iolens.llm import leakage as L
from iolens.llm import text_queries as Q
from iolens.llm import textscan as ts
from iolens.llm import tokens as T

from ..conftest import rows

HARD = [
    "it's we'll he'd 've 'll  's x's\n's y''s 'S a'reb '", "a \n\t b  c   ", " x\x1cy\x1dz \x85q", " ", "\n", "", None, "don't'll'm'd'tt", "a" * 20_000, "<|endoftext|>hello",
    "aaa aaaa aaaaa 1234567 ١٢٣ ½²", "é ​‍👩‍👩‍👧 日本語テキスト", "x'", "x'\n", "'s", " 's", "\t's", "CR\r\nLF", "𝔘𝔫𝔦 مرحبا", "\x00null\x00", "  lead", "trail  \n  ",
]
has_vocabulary = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary file")


@has_vocabulary
def test_ids_equal_the_library_and_decode_to_the_text(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("ab c'sd\n\t  12é!_.-日") for _ in range(rng.randrange(80))) for _ in range(300)]
    library = Tokenizer.from_file(T.VOCABULARY)
    library.encode_special_tokens = True
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    ids, counts = T.encode(texts, T.Merges(open(T.VOCABULARY, "rb").read()))
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == want
    assert [library.decode(g, skip_special_tokens=False) for g in got] == [t or "" for t in texts]
    df = spark.createDataFrame([(i % 7 or None, t, "clash") for i, t in enumerate(HARD)], "doc_id bigint, text string, ids string")
    assert sorted(map(str, (tuple(r) for r in T.encode_corpus(df).collect()))) == sorted(str((i % 7 or None, w)) for i, w in enumerate(want[: len(HARD)]))
    assert T.encode_corpus(df.where("false")).count() == 0


@has_vocabulary
def test_tokens_of_a_source_count_rows_with_null_and_equal_ids(spark, tmp_path):
    texts = [(None, "a", "the cat sat"), (None, "a", "on a mat"), (1, "a", "the cat"), (1, "a", "the cat"), (1, "b", "mat"), (2, None, None)]
    spark.createDataFrame(texts, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    _, n = T.encode([t for _, _, t in texts], T.Merges(open(T.VOCABULARY, "rb").read()))
    want = [(None, 1, 0, 0), ("a", 4, int(n[:4].sum()), int(n[:4].max())), ("b", 1, int(n[4]), int(n[4]))]
    assert rows(Q.p8_source_tokens(spark, str(tmp_path))) == want


@has_vocabulary
@pytest.mark.parametrize(("hot", "sent", "block"), [(0, 10**6, 20), (0, 3, 20), (10**6, 10**6, 300)])
def test_words_of_all_blocks_are_replayed_once(spark, monkeypatch, hot, sent, block):
    monkeypatch.setattr(T, "LEAST_HOT", hot)
    monkeypatch.setattr(T.runtime, "BROADCAST_ROWS", sent)
    monkeypatch.setattr(T.ts, "BLOCK", block)
    texts = [f"word{i} and word{i % 3}" for i in range(60)] + [None, "", "long " * 50]
    df = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts)], "doc_id bigint, text string, even boolean")
    ids, n = T.encode(texts, T.Merges(open(T.VOCABULARY, "rb").read()))
    want = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    got = {r["doc_id"]: (r["ids"], r["even"]) for r in T.encode_corpus(df, carried=("even",)).collect()}
    assert got == {i: (w, i % 2 == 0) for i, w in enumerate(want)}


@has_vocabulary
def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    merges = T.Merges(open(T.VOCABULARY, "rb").read())
    want = T.encode(["the cat sat on a mat"], merges)
    monkeypatch.setattr(ts, "run_hashes", lambda p, s, e: (e - s).astype(np.uint64))
    assert np.array_equal(T.encode(["the cat sat on a mat"], merges)[0], want[0])


def test_blocks_and_stretches():
    assert np.array_equal(ts.spread(np.array([5, 1, 9]), np.array([2, 0, 3])), [5, 6, 9, 10, 11])
    assert sum(len(t) for _, t in ts.blocks([None, "a" * 2_000_000, "", "b"])) == 4


WORDS = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(8)]
ITEM = " ".join(WORDS[:30])


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id bigint, text string, place int")
    pairs = L.matching_windows(d, e)
    return rows(L.verbatim(pairs), "doc_id", "item_id"), {r["doc_id"]: r for r in L.reparameterised(pairs).collect()}


def test_twelve_words_in_any_dress(spark):
    w = WORDS
    docs = [
        "+" + "\n+ ".join(w[5:17]), " ".join(w[5:16]), " ".join(x.upper() for x in w[:12]), "​".join(" ".join(w[:12])), " ".join(w[:6] + ["stop"] + w[6:12]), None, "", "pre " * 500 + ITEM + " post" * 500,
        "_".join(w[10:22]), ".".join(w[17:29]),
    ]
    got, _ = found(spark, docs, [ITEM, None, "short", ITEM + " more"])
    assert got == [(d, i) for d in (0, 2, 3, 7, 8, 9) for i in (0, 3)]
    assert found(spark, docs, [])[0] == [] and found(spark, [], [ITEM])[0] == []


def test_random_texts_against_brute_force(spark):
    rng = random.Random(4)
    items = [" ".join(rng.choice(["two", "three", "kilns", "lanterns", "share", "one", "loom"]) for _ in range(40)) for _ in range(4)]
    docs = [" ".join(rng.choice(items).split()[k : k + rng.randrange(8, 18)]) + " tail " + rng.choice(items)[:50] for k in range(30)]
    grams = lambda t: {tuple(t.split()[k : k + 12]) for k in range(len(t.split()) - 11)}
    want = [(d, i) for d, t in enumerate(docs) for i, e in enumerate(items) if grams(t) & grams(e)]
    assert found(spark, docs, items)[0] == sorted(want)


def test_renamed_slots_are_reported_apart(spark):
    item = "if a farmer trades five wagons for seven barrels and keeps five wagons how many barrels remain after that day"
    same = "If a farmer trades 12 wagons for 40 barrels and keeps 12 wagons how many barrels remain after that day"
    torn = "If a farmer trades 12 wagons for 40 barrels and keeps 99 wagons how many barrels remain after that day"
    exact, renamed = found(spark, [same, torn, item], [item])
    assert exact == [(2, 0)]
    assert set(renamed) == {0, 1} and renamed[0]["n_windows"] > renamed[1]["n_windows"] > 0  # torn where both numbers meet


def test_every_renamed_item_of_a_document_comes_out(spark):
    base = "if a farmer trades five wagons for seven barrels and keeps five wagons how many barrels remain after that day"
    items = [base, base.replace("five", "nine"), "when the old baker sells two loaves to three guests and gives two loaves away what is then left over"]
    doc = base.replace("five", "12").replace("seven", "40") + " . " + items[2].replace("two", "6").replace("three", "8") + " . " + items[2]
    d = spark.createDataFrame([(1, doc), (2, items[2])], "doc_id bigint, text string")
    e = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    each = L.reparameterised(L.matching_windows(d, e))
    got = rows(each, "doc_id", "item_id")
    assert got == [(1, 0), (1, 1), (1, 2)]
    n = {r["item_id"]: r["n_windows"] for r in each.collect()}
    best = min(n, key=lambda i: (-n[i], i))
    assert rows(L.best_items(each)) == [(1, 3, best, n[best])]


def brute_renamed(spark, docs, items):
    names = L.learned_names(spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"))
    form = set(L.FUNCTION_WORDS)

    def kind(w):
        if w in L.NUMBER_WORDS or w.isdigit():
            return "#"
        return "unit" if w in L.UNIT_WORDS else w if w in form and w not in names else "name"

    out = set()
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            for x in zip(*[L.plain_words(text)[k:] for k in range(12)]):
                for y in zip(*[L.plain_words(item)[k:] for k in range(12)]):
                    if x == y or [*map(kind, x)] != [*map(kind, y)] or len(set(zip(x, y))) != len(set(x)) or len(set(x)) != len(set(y)):
                        continue
                    own = [k for k in range(12) if kind(y[k]) == "name" and y[k] not in names]
                    fixed = sum(kind(w) not in ("#", "unit", "name") for w in y) + len(own) - len(own) // 3
                    if 3 * sum(x[k] != y[k] for k in own) <= len(own) and fixed >= 4:
                        out.add((d, i))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_renamed_windows_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "is", "two", "7", "days", "kiln", "loom", "mill", "barrel", "lantern", "sluice", "weaver", "token", "queue"]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(10, 24))) for _ in range(6)] + ["kiln loom mill barrel lantern sluice weaver token queue stage shard probe ledger"]
    swap = lambda t: " ".join(rng.choice(["nine", "12"]) if w in ("two", "7") else rng.choice(["anvil", "forge"]) if rng.random() < 0.12 else w for w in t.split())
    docs = [f"so {swap(rng.choice(items))} then {swap(rng.choice(items))}" for _ in range(20)] + ["a b c d e f g h i j k l m n o p"]
    want = brute_renamed(spark, docs, items)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    e = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert len(want) > 5
    for block in (4, 1000, 4_000_000):
        monkeypatch.setattr(L, "ITEM_BLOCK", block)
        assert rows(L.reparameterised(L.matching_windows(d, e)), "doc_id", "item_id") == want


def test_planted_questions_with_other_values_are_found(spark):
    rng = random.Random(8)
    forms = [
        "before {n} o'clock the {a} walked past a {b} {c} counted {m} {d} and noted their {e}",
        "if the {e} of a {b} {c} doubles within {n} days how does the {f} of the {d} change",
        "no {a} may open the {b} {c} unless its {e} exceeds {n} units for {m} nights",
        "suppose each {a} trades {n} {c} for {m} {b} {d} while the {e} stays constant",
    ]
    fill = lambda tag: {k: f"{k}{chr(97 + rng.randrange(9))}{tag}" for k in "abcdef"} | {"n": rng.choice(["two", "nine"]), "m": rng.choice(["ten", "six"])}
    single = [f"the auditor of region{chr(97 + i)}x must weigh every crate before dusk and write that total under seal{chr(97 + i)}y so none is lost" for i in range(10)]
    items = [forms[i % 4].format(**fill("x")) for i in range(40)] + single
    changed = [forms[i % 4].format(**(fill("z") | {"n": "17", "m": "88"})) for i in range(40)] + [t.replace("auditor", "inspector").replace("dusk", "dawn") for t in single]
    pad = "this commit moves the parser into its own module and keeps the old entry point for now"
    d = spark.createDataFrame([(i, f"{pad}\n{t}. {pad}") for i, t in enumerate(changed)] + [(900, pad * 3)], "doc_id bigint, text string")
    e = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = set(rows(L.reparameterised(L.matching_windows(d, e)), "doc_id", "item_id"))
    planted = {(i, i) for i in range(50)}
    assert len(planted & got) >= 0.9 * len(planted) and not any(i == 900 for i, _ in got)


def test_names_without_other_fillers_and_block_by_block(spark, monkeypatch):
    items = [
        "when the old baker sells two loaves to three guests and gives two loaves away what is then left over",
        "a ferry leaves the northern harbor before the storm and the captain asks whether the cargo would reach the island",
        None,
    ]
    docs = [
        items[0].replace("baker", "Smith").replace("guests", "miners"),
        items[1].replace("captain", "pilot").replace("harbor", "port"),
        "when the new parser drops two tokens to three queues and leaves six buffers empty what is then sent on",  # the form alone
        items[1],
    ]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    e = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    want = [(0, 0), (1, 1)]
    assert rows(L.reparameterised(L.matching_windows(d, e)), "doc_id", "item_id") == want
    monkeypatch.setattr(L, "ITEM_BLOCK", 1)
    pairs = L.matching_windows(d, e)
    assert rows(L.reparameterised(pairs), "doc_id", "item_id") == want and rows(L.verbatim(pairs), "doc_id", "item_id") == [(3, 1)]
    alike = [f"the {w} tailor counts every {x} under the {y} bridge and then the {w} tailor goes home to the {y} tower" for w, x, y in ("abc", "def", "ghi", "jkl", "mno")]
    e = spark.createDataFrame(list(enumerate(alike)), "item_id bigint, text string")
    assert {"d", "e", "g", "j"} <= L.learned_names(e)
    d = spark.createDataFrame([(0, alike[0].replace(" a ", " p ").replace(" b ", " q ").replace(" c ", " r "))], "doc_id bigint, text string")
    assert rows(L.reparameterised(L.matching_windows(d, e)), "doc_id", "item_id") == [(0, i) for i in range(5)]


@pytest.mark.parametrize(
    ("a", "b"),
    [("stupid fool", "$tup1d f00l"), ("stupid fool", "s t u p i d fool"), ("stupid fool", "stuuupid foool"), ("stupid fool", "ѕtuріd fооl"), ("stupid fool", "stu​pid FOOL"), ("stupid fool", "stupid_fool"), ("stupid fool", "StupidFool"), ("cretin", "crétin"), ("mother", "m_o_t_h_e_r")],
)
def test_spellings_fold_together(a, b):
    assert np.array_equal(A.folded_words([a])[0], A.folded_words([b])[0])


def corpus(n, seed):
    """Texts of plain words, of which some hold one of a few marked phrases."""
    rng = random.Random(seed)
    plain = "buffer cache queue index stage merge token route slot frame probe ledger commit shard".split()
    bad, fine = ["you vile toad", "go away vile worm", "what a vile pig"], ["the toad species table", "worm gear model", "pig iron data"]
    texts, target = [], []
    for _ in range(n):
        t = rng.random() < 0.3
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        words.insert(rng.randrange(len(words)), rng.choice(bad if t else fine + ["read the file"] * 3))
        texts.append(" ".join(words))
        target.append(float(t))
    return texts, np.array(target)


def test_held_out_accuracy_with_wrong_ratings(spark):
    texts, target = corpus(400, 1)
    noisy = target.copy()
    noisy[::25] = 1 - noisy[::25]
    c = A.fit(A.Sample(*A.hashed(texts), noisy, ["en"] * 300 + [None] * 100))
    new, truth = corpus(200, 2)
    df = spark.createDataFrame([(i, t, "en", "s", 0.0) for i, t in enumerate(new)] + [(900, None, None, None, 0.0), (901, "", "xx", "s", 0.0), (902, "buffer " * 20_000, "en", "s", 0.0)], "doc_id bigint, text string, lang string, source string, score double")
    got = {r["doc_id"]: r for r in A.score_documents(df, c).collect()}
    right = sum(got[i]["flagged"] == bool(t) for i, t in enumerate(truth))
    assert right >= 190
    assert got[900]["score"] is None and not got[900]["flagged"] and not got[901]["flagged"] and not got[902]["flagged"]


def test_held_out_figures_are_those_of_the_ratings(spark):
    texts, target = corpus(240, 3)
    c = A.fit(A.Sample(*A.hashed(texts), target, ["en"] * 200 + [None] * 40), seeds=False)
    by = {r[0]: r for r in c.held_out}
    assert by["en"][1] == 200 and by[None][1] == 40 and sum(r[2] for r in c.held_out) == int(target.sum())
    assert sum(r[4] for r in c.held_out) >= 0.9 * target.sum() and sum(r[4] for r in c.held_out) >= 0.9 * sum(r[3] for r in c.held_out)


def test_trainings_in_tasks_equal_those_in_turn_and_are_kept(spark, tmp_path, monkeypatch):
    texts, target = corpus(90, 4)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(500, None, "en", "s", 1), (None, "a b", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, o int")
    labels = spark.createDataFrame([(i, 1, 2, int(t)) for i, t in enumerate(target)] + [(i, 2, 2, int(t)) for i, t in enumerate(target)] + [(500, 1, 0, 1), (None, 1, 0, 1), (3, 4, 0, None), (999, 1, 0, 1)], "doc_id bigint, rater_id int, quality int, toxic int")
    sample = A.rated(docs, labels)
    assert len(sample.docs) == 90 and np.array_equal(sample.target, target)
    assert all(np.array_equal(a, b) for own, want in zip((sample.docs, sample.marks), A.hashed(texts), strict=True) for a, b in zip(own, want, strict=True))
    one, two = A.fit(sample), A.fitted(spark, sample)
    assert np.array_equal(one.model.table, two.model.table) and one.by_lang == two.by_lang
    monkeypatch.setattr(A, "fit", lambda *a: pytest.fail("fitted again"))
    assert np.array_equal(A.fitted(spark, A.rated(docs, labels)).model.out, one.model.out)
    few = A.rated(docs, labels, words=100)
    assert 0 < len(few.docs) < 20 and sum(map(len, few.docs)) <= 100


def test_rates_are_those_of_the_scores(spark, tmp_path):
    texts, target = corpus(60, 5)
    spark.createDataFrame([(i, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)] + [(90, None, None, "b"), (91, "x", None, None)], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 2, int(t)) for i, t in enumerate(target)], "doc_id bigint, rater_id int, quality int, toxic int").write.parquet(f"{tmp_path}/doc_labels.parquet")
    scored = {r["doc_id"]: r for r in Q.p10_scores(spark, str(tmp_path)).collect()}
    source = {i: "ab"[i % 2] for i in range(60)} | {90: "b", 91: None}
    want = []
    for s in (None, "a", "b"):
        own = [scored[i] for i, x in source.items() if x == s]
        n, k = sum(r["score"] is not None for r in own), sum(r["flagged"] for r in own)
        want.append((s, n, k, k / n))
    assert rows(Q.p10_rates(spark, str(tmp_path))) == want
    assert rows(Q.p10_found(spark, str(tmp_path))) == sorted((i,) for i, r in scored.items() if r["flagged"])
    assert sum(r["n_rated"] for r in Q.p10_held_out(spark, str(tmp_path)).collect()) == 60


def test_few_or_no_ratings(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, None, None, None)], "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, rater_id int, quality int, toxic int")
    c = A.fit(A.rated(docs, labels), spark)
    assert A.score_documents(docs, c).where("flagged").count() == 0
