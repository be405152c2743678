"""Characters of n-grams, short benchmark items, vectors that cannot be fitted."""

import numpy as np
from pyspark.sql import functions as F

from chapterlake.llm import common, decontaminate, langid, neighbours, sharding, toxicity


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_characters_of_every_length():
    texts = ["", "aZ é中\U0001f600!", "", "ÀÉ", "߿ࠀ￿\U00010000\U0010ffff"]
    points, begins = toxicity.characters(*buffers(texts))
    lower = [[ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in t] for t in texts]
    assert [points[a:b].tolist() for a, b in zip(begins, begins[1:])] == lower


def test_grams_equal_naive_counts(monkeypatch):
    texts = ["", "ab", "abc", "中文字符 中文字", "AbcABC", "x" * 50, "ëë中a" * 9, "\U0001f600\U0001f601é"]

    def naive():
        out = set()
        for d, t in enumerate(texts):
            t = "".join(c.lower() if c.isascii() else c for c in t)
            for n in toxicity.SIZES:
                for k in range(len(t) - n + 1):
                    (b,) = toxicity.buckets(np.array([ord(c) for c in t[k : k + n]], np.uint32), n)
                    out.add((d, int(b)))
        return out

    for step in (common.STEP_BYTES, 7):  # texts longer than a step, too
        monkeypatch.setattr(common, "STEP_BYTES", step)
        doc, bucket = toxicity.hits(*buffers(texts), None)
        assert set(zip(doc.tolist(), bucket.tolist())) == naive() and len(doc) == len(naive())


def test_toxic_words_of_wide_characters(spark):
    rng = np.random.default_rng(0)
    letters = [chr(0x4E00 + k) for k in range(300)]
    rows = []
    for k in range(600):
        words = list(rng.choice(letters, 60))
        if k % 4 == 0:
            words[20:20] = list("毒辱骂蠢货")
        rows.append((k, "".join(words), int(k % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs.filter("doc_id < 400"), labels.filter("doc_id < 400"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.filter("doc_id >= 400"), model).collect()}
    assert all((got[k] >= 0.3) == (y == 1) for k, _, y in rows if k >= 400)


def test_short_items_are_met_whole_where_asked(spark):
    bench = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, "one two three four"), (4, "one two three four five"), (5, ""), (6, "a b c")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha y beta gamma z"), (2, "one two three four five"), (3, "beta x gamma; one two three"), (4, None), (5, "a b c a b c")], "doc_id long, text string")
    found = lambda least: sorted((r["doc_id"], r["item_id"], r["start_word"], r["end_word"]) for r in decontaminate.find_leaks(docs, bench, least).collect())
    assert found(5) == [(2, 4, 0, 5)]
    assert found(2) == [(1, 2, 3, 5), (2, 3, 0, 4), (2, 4, 0, 5), (5, 6, 0, 3)]
    assert found(1)[0] == (1, 1, 1, 2) and len(found(1)) == 5
    assert sorted(r["doc_id"] for r in decontaminate.remove_leaks(docs, bench, 1).collect()) == [3, 4]


def test_neighbours_among_vectors_that_cannot_take_part(spark):
    rng = np.random.default_rng(1)
    good = [(k * 50, [float(x) for x in rng.normal(size=8)]) for k in range(40)]
    bad = [(10_000 + k, v) for k, v in enumerate([None, [0.0] * 8, [float("nan")] * 8, [float("inf")] * 8, [None] * 8, []] * 200)] + [(20_000, [1.0] * 7)]
    rows = spark.createDataFrame(bad + good + [(None, [1.0] * 8), (3, [1e300] * 8), (4, [1e-310] * 8)], "id long, vector array<double>")
    codes = neighbours.fit(rows, sample_rows=10)
    assert codes is not None and codes.dim == 8
    got = neighbours.search(rows, rows.filter("id % 50 = 0"), 3).collect()
    assert {r["query_id"] for r in got} == {i for i, _ in good} and {r["vec_id"] for r in got} <= {i for i, _ in good} | {3, 4}
    assert neighbours.fit(rows.filter("id between 10000 and 19999")) is None and neighbours.search(rows.filter("id between 10000 and 19999"), rows, 3).count() == 0


def test_language_scores_equal_a_naive_network(spark):
    docs = spark.createDataFrame([(k, ("der und die das " if k % 2 else "the and of to ") * 20 + str(k), "de" if k % 2 else "en") for k in range(80)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    rows = langid.predict(docs, model).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in rows)

    def naive(text):
        """The mean over windows, place by place and filter by filter."""
        raw, p, total, many, at = text.encode(), model.params, np.zeros(len(model.classes)), 0, 0
        while at == 0 or at + langid.SPAN - 1 < len(raw):
            window = raw[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            best = np.full(len(p["bias"]), -np.inf)
            for place in range(langid.STEP):
                seen = np.concatenate([p["embed"][b] for b in window[place : place + langid.SPAN]])
                best = np.maximum(best, seen @ p["filters"])
            e = np.exp(np.maximum(best + p["bias"], 0) @ p["dense"] + p["out"])
            total, many, at = total + e / e.sum(), many + 1, at + langid.STEP
        return total / many

    asked = spark.createDataFrame([(0, "the " * 300), (1, "dies und das"), (2, "é" * 127 + "x"), (3, "a"), (4, "und " * 63 + "abc"), (5, "w" * 257), (6, "123"), (7, None)], "doc_id long, text string")
    for r in langid.predict(asked, model).collect():
        want = naive(r["text"]) if r["doc_id"] < 6 else None
        assert r["lang_pred"] == ("und" if want is None else model.classes[int(want.argmax())]) and abs(r["score"] - (0 if want is None else want.max())) < 1e-4


def test_shards_follow_the_law(spark):
    docs = spark.createDataFrame([(k, "x" * (k * 37 % 400)) for k in range(3000)], "doc_id long, text string")
    rows = sharding.shard_by_bytes(docs, 16).select("shard", "slot", "size").toPandas()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(rows) == 3000 and sizes.sum() == sum(k * 37 % 400 + 1 for k in range(3000)) and sizes.max() - sizes.min() <= 0.05 * sizes.mean()
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
