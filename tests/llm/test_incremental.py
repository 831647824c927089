import random

import numpy as np

from tidemill.llm.incremental import ChunkParams, ChunkStore, kept_share

WORDS = "your careful reviewer must check this public caption before every session and report an unclear question to our weekly desk with some short note about that label guideline price message window garden".split()


def text(seed, n=70):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) * (r.random() < 0.2) for _ in range(n))


def test_kept_share():
    assert kept_share("abc", "abc", 16) == 1.0 and kept_share("abc", "abcd", 16) == 0.0
    t = "".join(text(1).split())
    assert kept_share(t, "zzzz" + t, 16) == 1.0 and kept_share(t, t[: len(t) // 2], 16) < 0.51


def brute(rows, history):
    kept, out = [], {}
    from tidemill.llm.leakage import stream

    for n, b, i, t in sorted(rows, key=lambda r: r[0]):
        s = stream(t) if t else ""
        hit = [] if b == 0 else [m for m, j, u in kept if (i is not None and i == j) or (s and u and kept_share(u, s, 16) >= 0.75)]
        if hit:
            out[n] = min(hit)
        else:
            kept.append((n, i, s))
    return out


def test_ingest(spark):
    base = [text(k) for k in range(6)]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    rows = [(k + 1, 0, f"id{k}", base[k]) for k in range(4)] + [(5, 0, None, None), (6, 0, "dup", base[0])]
    rows += [
        (10, 1, "id1", "something else entirely"), (11, 1, None, base[2].upper().replace(" ", "  ")), (12, 1, "a", base[4]), (13, 1, "b", base[4] + " apply now"), (14, 1, "b", None), (15, 1, None, ""),
        (16, 2, "c", cut(base[3], 0, 60)), (17, 2, "d", cut(base[3], 0, 30)), (18, 2, "e", cut(base[4], 5, 70)), (19, 2, "f", "short"), (20, 2, "g", "Short!"), (21, 2, None, None), (22, 2, "d", base[5]), (23, 2, "h", base[5]), (24, 2, "i", "!!!"), (25, 2, "j", "..."),
        (26, 2, "k", (base[0] + " ") * 400),
    ]
    want = brute(rows, 0)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "no bigint, batch int, key string, body string, t string, n int").repartition(3)
    store = ChunkStore(spark)
    store.accept(df.where("batch = 0"), "no", "key", "body")
    got = {}
    for b in (1, 2):
        got |= {r["n"]: r["first_no"] for r in store.ingest(df.where(f"batch = {b}"), "no", "key", "body").collect()}
    assert got == want
    both = ChunkStore(spark)
    both.accept(df.where("batch = 0"), "no", "key", "body")
    assert {r["n"]: r["first_no"] for r in both.ingest(df.where("batch > 0"), "no", "key", "body").collect()} == want
    assert both.ingest(df.limit(0), "no", "key", "body").count() == 0


def test_scattered_edits_and_moved_sentences(spark):
    """Looked up densely, every text that keeps enough is found, however its runs lie."""
    r, texts = random.Random(5), ["".join(text(k).split()) for k in range(40)]
    for t in texts[:40]:
        # a change every 17 to 24 characters destroys most chunks and keeps runs of at least 16
        out, at = list(t), r.randint(0, 8)
        while at < len(t):
            out[at] = "q"
            at += r.randint(17, 24)
        texts.append("".join(out))
        parts = [t[k : k + 18] for k in range(0, len(t), 18)]
        r.shuffle(parts)
        texts.append("".join(parts))
        texts.append("".join(parts[: r.randint(8, len(parts))]))
    texts += ["short", "a" * 16, "a" * 300, "ab" * 40, "", "ab" * 4000]
    rows = [(k, 0 if k < 20 else 1 + k % 3, None, t) for k, t in enumerate(texts)]
    rows = [(n, *row[1:]) for n, row in enumerate(sorted(rows, key=lambda x: x[1]))]
    df = spark.createDataFrame(rows, "no bigint, batch int, key string, body string")
    store = ChunkStore(spark, params=ChunkParams(dense_below=1 << 40, buckets=4))
    store.accept(df.where("batch = 0"), "no", "key", "body")
    got = {x["n"]: x["first_no"] for k in (1, 2, 3) for x in store.ingest(df.where(f"batch = {k}"), "no", "key", "body").collect()}
    want = brute(rows, 0)
    assert got == want and len(want) > 80


def test_what_is_found_without_loss(spark):
    """A text that holds wide_kept of the windows of another is a pair to be decided, whatever else is in it; short texts always are."""
    p = ChunkParams()
    r, rows = random.Random(8), []
    for k in range(60):
        t = "".join(text(k, 80).split())
        rows.append((k, 0, None, t))
        # pieces of 64 to 120 characters in another order, with other words between
        parts, at = [], 0
        while at < len(t):
            n = r.randint(64, 120)
            parts.append(t[at : at + n])
            at += n
        r.shuffle(parts)
        rows.append((100 + k, 1, None, ("zq" * r.randint(3, 9)).join(parts)))
        rows.append((300 + k, 0, None, t[:70]))
        rows.append((400 + k, 1, None, t[:15] + "#" + t[3:62]))
    df = spark.createDataFrame(rows, "no bigint, batch int, key string, body string")
    store = ChunkStore(spark, params=p)
    store.accept(df.where("batch = 0"), "no", "key", "body")
    got = {x["n"]: x["first_no"] for x in store.ingest(df.where("batch = 1"), "no", "key", "body").collect()}
    assert got == brute(rows, 0) and len(got) > 100


def test_near_copies_meet_their_first_only(spark):
    """Four hundred near copies in one batch, and a common line in texts that differ: rounds of few leaders give what all against all gives."""
    r, base, line = random.Random(3), text(1, 80), " ".join(WORDS[:20])
    rows = [(k, 0, f"i{k}", text(1000 + k)) for k in range(3)]
    for k in range(10, 410):
        words_ = base.split()
        words_[r.randrange(len(words_))] = f"edit{k}"
        rows.append((k, 1, None if k % 50 else "same", " ".join(words_)))
    rows += [(500 + k, 1, None, text(2000 + k, 25) + " " + line) for k in range(60)] + [(600 + k, 1, None, text(2000 + k, 25) + " " + line + " now") for k in range(60)]
    df = spark.createDataFrame(rows, "no bigint, batch int, key string, body string").repartition(5)
    store = ChunkStore(spark, params=ChunkParams(leaders=4, buckets=4))
    store.accept(df.where("batch = 0"), "no", "key", "body")
    got = {x["n"]: x["first_no"] for x in store.ingest(df.where("batch = 1"), "no", "key", "body").collect()}
    assert got == brute(rows, 0)


def test_reopened_store_goes_on(spark, tmp_path):
    rows = [(k, 0, f"id{k}", text(k)) for k in range(8)]
    df = spark.createDataFrame(rows, "no bigint, batch int, key string, body string")
    at = f"file://{tmp_path}/store"
    ChunkStore(spark, at).accept(df.where("no < 4"), "no", "key", "body")
    one = ChunkStore(spark, at)
    assert one.ingest(df.where("no >= 4"), "no", "key", "body").count() == 0
    broken = ChunkStore(spark, at)
    broken._append("ids", spark.createDataFrame([("left over", 1)], "id string, n bigint"), "unfinished")
    two = ChunkStore(spark, at)
    again = spark.createDataFrame([(20, "id1", None), (21, None, text(6)), (22, "left over", "new words")], "no bigint, key string, body string")
    assert {tuple(x) for x in two.ingest(again, "no", "key", "body").collect()} == {(1, 20), (6, 21)}


def test_history_is_not_shuffled(spark):
    store = ChunkStore(spark)
    store.accept(spark.createDataFrame([(k, f"i{k}", text(k)) for k in range(50)], "no bigint, key string, body string"), "no", "key", "body")
    from tidemill.llm.incremental import _MET, _entries, _met

    new = _entries(spark.createDataFrame([(9, text(9))], "m bigint, text string"), store.p, "B")
    met = store._kept("index").groupBy("bucket").cogroup(new.groupBy("bucket")).applyInArrow(lambda x, y: _met(x, y, None), _MET)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_a_usual_line_is_not_looked_up():
    """A line that many texts have is left out of the chunks they are looked up by, wherever it stands; what is kept still covers enough."""
    from tidemill.llm.incremental import _index

    p, line = ChunkParams(), "".join(WORDS[:12])
    texts = ["".join(text(k, 60).split())[:230] + line + "".join(text(k + 500, 60).split())[:230] for k in range(200)]
    hashes, owners, shares = _index(texts, p)
    assert max(np.unique(hashes, return_counts=True)[1]) < 20
    covered = np.bincount(owners, shares, len(texts))
    assert covered.min() >= 1 - p.wide_kept + p.wide_least - 1e-9 and covered.max() < 0.9


def test_ranges_of_hashes_give_what_all_at_once_gives(monkeypatch):
    """A bucket is joined range by range, so that neither its chunks nor its pairs are held as a whole."""
    import pyarrow as pa

    from tidemill.llm import incremental

    r = np.random.default_rng(1)

    def packed(side, first):
        rows = []
        for k in range(3):
            h = np.sort(r.integers(0, 40, 300).astype(np.uint64) << np.uint64(40))
            rows.append({"bucket": 0, "side": side, "hashes": h.tobytes(), "owners": r.integers(0, 50, 300).astype(np.uint32).tobytes(), "shares": np.full(300, 0.25, np.float32).tobytes(), "numbers": (np.arange(50) + first + 50 * k).tobytes()})
        return pa.Table.from_pylist(rows)

    def total(leaders):
        pairs, hidden = {}, {}
        for x in incremental._met(known, new, leaders).to_pylist():
            if x["a"] is None:
                hidden[x["b"]] = min(hidden.get(x["b"], x["hidden"]), x["hidden"])
            else:
                pairs[x["a"], x["b"]] = pairs.get((x["a"], x["b"]), 0) + x["share"]
        return pairs, hidden

    known, new = packed(0, 0), packed(1, 100)
    whole = [total(None), total(5)]
    assert len(whole[0][0]) > 1000 and whole[1][1]
    sizes, expand = [], np.repeat
    monkeypatch.setattr(incremental, "_HELD", 100)
    monkeypatch.setattr(incremental, "_EXPANDED", 200)
    monkeypatch.setattr(incremental.np, "repeat", lambda a, n: (sizes.append(int(np.sum(n))), expand(a, n))[1])
    assert [total(None), total(5)] == whole
    assert max(sizes) < 1000
