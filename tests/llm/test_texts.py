import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tidemill.llm import bpe, leakage, readability
from tidemill.llm.catalog import QUERIES


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.DEFAULT_FILE)
    t.encode_special_tokens = True
    return t


def test_encoder_equals_the_library(library):
    r = random.Random(3)
    letters = [chr(c) for c in [*range(1, 0x250), *range(0x2000, 0x2070), *range(0x3000, 0x3100), 0x85, 0xFEFF, 0x1F600, 0x301, 0x660, 0xB2]]
    texts = ["".join(r.choice(letters if r.random() < 0.5 else " \n\t'stabc12aaaa <|endoftext|>") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    texts += ["a" * 60_000, "<|endoftext|>", " " * 3000, "あ" * 20_000, "", None]
    offsets, flat = bpe.encoder(bpe.DEFAULT_FILE).encode(texts)
    for i, t in enumerate(texts):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == (library.encode(t, add_special_tokens=False).ids if t else []), t[:80]


def test_rank_queue():
    q, r, want = bpe.RankQueue(50_000), random.Random(1), []
    for _ in range(500):
        k = r.randrange(50_000)
        q.push(k, np.array([k]))
        want.append(k)
    got = []
    while (x := q.pop()) is not None:
        got += x[1].tolist()
    assert got == sorted(want)


def test_encode_query(spark, library):
    got = QUERIES["p7_ids"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    assert all(r["ids"] == (library.encode(r["text"], add_special_tokens=False).ids if r["text"] else []) for r in got) and len(got) == 100
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, "hi", "x")], "k int, text string, ids string")
    assert [r["ids"] for r in bpe.encode(df, "text").collect()] == [[], [], [5303]]
    assert bpe.encode(df.limit(0), "text").count() == 0


ITEM = "Read the text.\n\n" + " ".join(f"word{chr(97 + i)}x" for i in range(24)) + "."


def test_leaks(spark):
    body = ITEM.split("\n\n")[1].rstrip(".").split()
    docs = [
        (1, "intro " + " ".join(body[:15]) + " more"), (2, "intro " + " ".join(body[:14]) + " more"), (3, "> " + "\n> ".join(w.upper() + "," for w in body[3:20])), (4, None), (5, ""), (6, "<p>" + "</p><p>".join(body[5:]) + "</p>"),
        (7, "​ ".join(body).replace("o", "о").replace("w", "ｗ")), (8, " ".join(body[:10]) + " gap " + " ".join(body[10:])), (9, "\\n".join(body)), (10, ("filler text " * 20_000) + " ".join(body)), (1, "intro " + " ".join(body[:15]) + " more"), (None, " ".join(body)),
    ]
    items = [(70, ITEM), (71, "too short to count"), (72, None), (73, ITEM), (None, ITEM)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, doc_id int")
    want = {(k, x) for k in (1, 3, 6, 7, 9, 10) for x in (70, 73)}
    assert {tuple(r) for r in leakage.leaks(d, "doc_id", "text", i, "item_id", "text").collect()} == want
    assert {tuple(r) for r in leakage.leaks(d, "doc_id", "text", i, "item_id", "text", block_chars=10).collect()} == want
    assert leakage.leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leakage.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_leaks_with_edits():
    index = leakage.build_index([(1, ITEM)], 15, 2)
    body = ITEM.split("\n\n")[1].split()
    assert leakage.leaked_items(index, " ".join(body[2:19]).replace("wordgx", "wordg", 1)) == [1]
    assert leakage.leaked_items(index, " ".join(body[2:19])[::-1]) == []
    assert leakage.leaked_items(leakage.build_index([(1, ITEM)], 15, 0), " ".join(body[2:19]).replace("wordjx", "wordj", 1)) == []


def test_leaks_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet").collect() for t in ("documents", "eval_items"))
    runs = {}
    for r in items:
        w = leakage.words(r["text"])
        for k in range(len(w) - 14):
            runs.setdefault("".join(w[k : k + 15]), set()).add(r["item_id"])
    want = {(r["doc_id"], i) for r in docs if r["text"] for s in [leakage.stream(r["text"])] for k, ids in runs.items() if k in s for i in ids}
    assert {tuple(r) for r in QUERIES["p8_found"](spark, SMALL).collect()} == want


def test_levels_held_out(spark):
    docs, samples = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "reading_samples"))
    measure = readability.Measure(readability.word_counts(docs, "text"))
    x, y = readability.graded(samples, "text", "reading_level", measure)
    fold = np.arange(len(y)) % 5
    exact, hard = [], []
    for k in range(5):
        model = readability.fit(x[fold != k], y[fold != k])
        exact += (model.level(x[fold == k]) == y[fold == k]).tolist()
        hard += ((model.at_least(x[fold == k], 4) >= 0.5) == (y[fold == k] >= 4)).tolist()
    assert np.mean(exact) >= 0.8 and np.mean(hard) >= 0.97


def test_levels_edges(spark):
    samples = spark.read.parquet(f"{SMALL}/reading_samples.parquet")
    easy = "The cat can see the dog. We like to read a book. "
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "too short", 9), (4, easy * 6, 9), (4, easy * 6, 9), (5, easy * 5000, 9), (6, "日本語" * 100, 9), (7, "12 34 " * 40, 9)], "k bigint, text string, level int")
    got = sorted((r["k"], r["level"]) for r in readability.levels(docs, "k", "text", samples, "text", "reading_level").collect() if r["k"] != 7)
    assert [g for g in got if g[0] in (1, 2, 3, 6)] == [(1, None), (2, None), (3, None), (6, None)]
    assert all(g[1] <= 2 for g in got if g[0] in (4, 5)) and len([g for g in got if g[0] == 4]) == 2
    assert readability.levels(docs.limit(0), "k", "text", samples, "text", "reading_level").count() == 0


def test_every_line_counts_and_wrapping_does_not():
    import numpy as np

    from tidemill.llm.readability import BUCKETS, Counts, Measure, sentences

    measure = Measure(Counts({"the": 900, "notwithstanding": 2}, np.ones(BUCKETS), 5000, 100))
    prose = "The careful reader will notice that every report which arrives must be checked before it is filed, although nobody asks. " * 3
    words_ = prose.split()
    wrapped = "\n".join(" ".join(words_[k : k + 7]) for k in range(0, len(words_), 7))
    assert sentences(wrapped) and measure.features(wrapped) == measure.features(" ".join(words_))
    assert measure.features("Interdepartmental Responsibilities\n" + prose) != measure.features(prose)
    assert measure.features(prose + "\nNotwithstanding heterogeneity") != measure.features(prose)
    assert sentences("Our Team\nWe work here. We rest") == ["Our Team", "We work here", "We rest"]


def test_rare_words_do_not_share_frequent_counts(spark):
    from tidemill.llm import readability

    words_ = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(15_000)]
    rows = [(" ".join(words_[:9_000]),), (" ".join(words_[:20] * 50),), (None,), ("",)]
    old = readability.HEAD
    readability.HEAD = 20
    try:
        counts = readability.word_counts(spark.createDataFrame(rows, "text string").repartition(3), "text")
    finally:
        readability.HEAD = old
    assert len(counts.head) == 20 and counts.total == 10_000 and counts.words == 9_000 and set(counts.head.values()) == {51}
    assert counts.tail.max() == 1.0 and readability.word_counts(spark.createDataFrame([], "text string"), "text").total == 0


def test_edits_against_brute_force():
    """Substitutions, insertions and deletions; also passages of so few characters that only single characters can be shared."""
    import random

    def distance_within(a, b, most):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1] <= most

    r = random.Random(4)
    for size in (1, 4):
        item = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size)) for _ in range(18)]
        index = leakage.build_index([(7, " ".join(item))], 15, 3)
        for trial in range(60):
            passage = list("".join(item[trial % 4 : trial % 4 + 15]))
            for _ in range(r.randint(0, 5)):
                at, kind = r.randrange(len(passage)), r.randrange(3)
                passage[at : at + (kind != 1)] = [] if kind == 2 else [r.choice("0123456789")]
            text = "".join(passage)
            doc = "zzzz" * 5 + text + "yyyy" * 5
            windows_ = ["".join(item[k : k + 15]) for k in range(4)]
            want = any(distance_within(w, doc[a:b], 3) for w in windows_ for a in range(16, 25) for b in range(20 + len(text) - 4, 20 + len(text) + 5) if b > a)
            assert bool(leakage.leaked_items(index, doc)) == want, (size, text, item)
    with pytest.raises(ValueError):
        leakage.build_index([(1, " ".join("a" * 15))], 15, 15)


def test_blocks_in_one_pass(spark):
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(20)], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(2, 19))) for k in range(20)], "doc_id bigint, text string")
    found = leakage.leaks(docs, "doc_id", "text", items, "item_id", "text", block_chars=10)
    assert sorted(map(tuple, found.collect())) == [(k, k) for k in range(20)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3
