import re
import zlib
from collections import Counter
from itertools import product
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chapterlake.llm import chat, common, decontaminate, jaccard, langid, neighbours, packing, quality, queries, sharding, sstable, tokens, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n string"
ODD = [(1, None, None, None, None, "a", None), (2, "", "en", "s", 0, None, "x"), (3, "word " * 60_000, "en", "s", None, "b", None), (4, "same text here again now", "en", None, 1, None, None), (4, "same text here again now", "en", None, 1, None, None), (None, "no id", None, "s", 3, None, None), (5, "!!! 12", "en", "s", 1, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def encoder():
    return tokens.WordEncoder(queries.tokenizer_path())


def test_word_ids_equal_whole_ids(spark):
    e = encoder()
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in [*texts, "", " ", "a  b", " x ", "a \n b", "don't <|endoftext|> x", "é" * 50, "a\tb c\t d", "\u3000x y"]:
        assert np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() == e.encode(t)


def test_added_tokens_as_the_library_encodes_them():
    library, e = Tokenizer.from_file(queries.tokenizer_path()), encoder()
    for t in ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>b  c", "<|endoftext| >", "no token\n here", "é <|endoftext|>\n x"]:
        assert np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() == e.encode(t)
    assert np.frombuffer(e.encode("x <|endoftext|> y"), "<u4").tolist() == [87, 220, 50256, 331]


@pytest.mark.parametrize("counts", [[], [5] * 7, [2048, 1, 2047, 1024, 1024, 3]])
def test_plan_uses_every_piece(counts):
    hist = np.bincount(counts, minlength=2049)
    made = packing.plan(hist, 2048)
    used = Counter()
    for contents, many in made:
        assert sum(l * a for l, a in contents.items()) <= 2048
        for l, a in contents.items():
            used[l] += a * many
    assert used == Counter(counts)


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths, most = np.unique(rng.integers(1, 12, 5)), rng.integers(1, 4, 5)
        weights = rng.random(len(lengths))
        priced = packing.Knapsack(lengths, weights, most[: len(lengths)], 20)
        for room in range(21):
            fits = [sum(a * w for a, w in zip(many, weights)) for many in product(*[range(m + 1) for m in most[: len(lengths)]]) if sum(a * l for a, l in zip(many, lengths)) == room]
            found = priced.fill(room)
            assert (found is None) == (not fits)
            if fits:
                assert np.isclose(sum(weights[list(lengths).index(l)] * a for l, a in found.items()), max(fits)) and sum(l * a for l, a in found.items()) == room


def test_program_makes_the_packing(spark):
    for sf in ("sf0.001", "sf0.01"):
        texts = [r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").collect()]
        e, hist = encoder(), np.zeros(2049, np.int64)
        for t in texts:
            n = len(e.encode(t or "")) // 4 + 1
            hist[2048] += n // 2048
            hist[n % 2048] += n % 2048 > 0
        many = lambda plan: sum(m for _, m in plan)
        made, bound = packing.plan(hist, 2048), -(-int((hist * np.arange(2049)).sum()) // 2048)
        program = {tuple(sorted(c.items())) for c, _ in packing.configured(hist, 2048)[0]}
        assert many(made) <= min(bound + 1, many(packing.best_fit(hist, 2048)))
        assert sum(m for c, m in made if tuple(sorted(c.items())) in program) > 0.7 * many(made)


def test_packing_cuts_only_long_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "x y " * 400), (3, None), (2, "x y " * 400)], "doc_id long, text string")
    rows = packing.pack_documents(docs, queries.tokenizer_path(), 64).toPandas().sort_values(["doc_id", "sequence_id", "piece"])
    e = encoder()
    for d, t in ((1, "a b c"), (3, ""), (2, "x y " * 400)):
        n, own = len(e.encode(t)) // 4 + 1, rows[rows.doc_id == d]
        copies = 2 if d == 2 else 1
        assert own.length.sum() == copies * n and (own[own.piece > 0].length == 64).all()
        assert sorted(set(zip(own.piece, own.start, own.length))) == [(k, max(0, (n % 64 or min(n, 64)) + 64 * (k - 1)) if k else 0, 64 if k else n % 64 or min(n, 64)) for k in range(-(-n // 64))]


def test_packing(spark, odd, empty):
    assert packing.pack_documents(empty, queries.tokenizer_path()).count() == 0
    rows = packing.pack_documents(odd, queries.tokenizer_path(), 512, with_ids=True).toPandas()
    e = encoder()
    assert rows.length.sum() == sum(len(e.encode(r[1] or "")) // 4 + 1 for r in ODD)
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 512 and (g.offset == g.length.cumsum() - g.length).all()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows.itertuples())


def test_shards_of_tokens(spark, odd, empty):
    for docs, n in ((odd, len(ODD)), (empty, 0)):
        path = common.new_path(spark, "t")
        sstable.write_tokens(docs, queries.tokenizer_path(), path)
        rows = sstable.read_tokens(spark, path, with_ids=True).toPandas().sort_values("start")
        assert len(rows) == n and (rows.start == rows.n_tokens.cumsum() - rows.n_tokens).all()
        if n:
            found = sstable.lookup(spark, path, spark.createDataFrame([(4,), (5,), (99,)], "doc_id long")).collect()
            assert Counter(r["doc_id"] for r in found) == {4: 2, 5: 1}
            assert bytes(next(r["ids"] for r in found if r["doc_id"] == 5)) == encoder().encode("!!! 12") + b"\0\0\0\0"


def test_checksums_of_token_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**12, "last <|endoftext|> one"), (-5, None)], "doc_id long, text string"))
    path = common.new_path(spark, "t")
    sstable.write_tokens(docs.repartition(7), queries.tokenizer_path(), path)
    library, at = Tokenizer.from_file(queries.tokenizer_path()), 0
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in sstable.read_tokens(spark, path).collect())
    want = []
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((at, r["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    asked = spark.createDataFrame([(10**12,), (-5,), (10**12 + 1,), (-6,)], "doc_id long")
    assert sorted(r["doc_id"] for r in sstable.lookup(spark, path, asked).collect()) == [-5, 10**12]


def test_leaks(spark, odd, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    words = item.split()
    words[9] = "other"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Before {item.upper()}, after"), (2, "x " + " ".join(words)), (3, " ".join(item.split()[:6]) + " clean"), (4, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.find_leaks(docs, bench).collect()) == [1, 2]
    assert sorted(r["doc_id"] for r in decontaminate.remove_leaks(docs, bench).collect()) == [3, 4]
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(odd, bench.limit(0)).count() == 0


def test_leaks_in_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "same text here again now"), (1, "same text here again now"), (2, "word " * 20), (3, "no id"), (4, "x"), (None, "same text here again now")], "item_id long, text string")
    found = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(odd, bench).collect())
    assert found == {(4, 1): 4, (4, None): 2, (3, 2): 1}


def brute_overlap(doc, item):
    """Most matches of a best run (a mismatch costs two matches) over all alignments."""
    most = 0
    for d in range(1 - len(item), len(doc)):
        score, matches, best = 0, 0, (0, 0)
        for k in range(max(0, d), min(len(doc), d + len(item))):
            same = doc[k] == item[k - d]
            score, matches = score + (1 if same else -2), matches + same
            if score <= 0:
                score, matches = 0, 0
            if score > best[0]:
                best = (score, matches)
        most = max(most, best[1])
    return most


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    items, docs = [], []
    for n in [*range(5, 25), 60]:
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, item))
        for every in (3, 4, 5, 6):
            for off in range(every):
                docs.append((n, [f"x{k}" if k % every == off else w for k, w in enumerate(item)]))
        for _ in range(40):
            changed = rng.choice(n, rng.integers(0, 2 + n // 3), replace=False)
            body = [f"x{k}" if k in changed else w for k, w in enumerate(item)]
            docs.append((n, body[rng.integers(0, 3) :]))
    docs = [(n, ["before"] * int(rng.integers(0, 4)) + body + ["after"] * int(rng.integers(0, 4))) for n, body in docs]
    bench = spark.createDataFrame([(n, " ".join(i)) for n, i in items], "item_id long, text string")
    table = spark.createDataFrame([(k, " ".join(d)) for k, (_, d) in enumerate(docs)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched_words"] for r in decontaminate.find_leaks(table, bench).collect()}
    words, want = dict(items), {}
    for k, (n, d) in enumerate(docs):
        most = brute_overlap(d, words[n])
        if most >= (n if n < 8 else min(13, -(-4 * n // 5))):
            want[k, n] = most
    assert got == want and len(want) > 300


@pytest.mark.parametrize("step", [1, 7, 16])
def test_words_that_steps_cut_are_hashed_whole(monkeypatch, step):
    texts = [b"", b"x" * 50, b" a" + b"Bc" * 31 + b" d ", b"y" * 16, b"y" * 16 + b" ", b"one two three", b"  "]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = common.word_hashes(data, offsets)
    monkeypatch.setattr(common, "STEP_BYTES", step)
    parted = common.word_hashes(data, offsets)
    assert whole[0].tolist() == parted[0].tolist() and whole[1].tolist() == parted[1].tolist()
    assert len(whole[0]) == sum(len(t.split()) for t in texts)


def test_hits_followed_in_parts(monkeypatch):
    index = decontaminate.SeedIndex([1, 2], ["a b a b a b a b", "a b c d e f g h"])
    words, _ = common.word_hashes(np.frombuffer(b"a b a b a b a b c d e f g h", np.uint8), np.array([0, 27]), common.ALNUM)
    whole = index.hits(words)
    monkeypatch.setattr(decontaminate, "HITS", 2)
    assert whole == index.hits(words) and [0, 0] in whole and [1, 6] in whole


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 32))
    x[500:] = x[0]
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (None, [1.0] * 32)]
    table = spark.createDataFrame(rows, "id long, vector array<double>")
    got = neighbours.search(table, table.filter("id % 50 = 0"), 5).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    asked = [k for k in range(600) if k % 50 == 0]
    for q in asked:
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        best = np.lexsort((np.arange(600), -s))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 5
        hit += len(set(best) & set(mine.vec_id))
    assert hit / (5 * len(asked)) >= 0.9
    assert neighbours.search(table.limit(0), table.limit(0)).count() == 0


@pytest.mark.parametrize("n", range(6, 61))
def test_equal_vectors_tie_by_id(n):
    rng = np.random.default_rng(n)
    v = rng.normal(size=48)
    codes = neighbours.Codes(rng.normal(size=(200, 48)), 5)
    for order in (np.arange(n), np.arange(n)[::-1], rng.permutation(n)):
        part = neighbours.Part(codes, order.astype(np.int64), np.tile(v, (n, 1)))
        code = codes.of(v[None] / np.linalg.norm(v))
        ids, scores = part.search(0, v, code[0], codes.substrings(code)[0], 5)
        assert ids.tolist() == list(range(1, n))[:5] and len(set(scores.tolist())) == 1 and abs(scores[0] - 1) < 1e-12


def test_neighbours_ties_across_parts_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x[100:200] = x[3]
    x[250] = x[7] * 1e200
    rows = [(k, [float(c) for c in v], "clash", 1.0) for k, v in enumerate(x)] + [(400, [1.0, None] * 8, "", 0.0), (401, [1.0] * 4, "", 0.0), (402, [float("inf")] * 16, "", 0.0)]
    table = spark.createDataFrame(rows, "id long, vector array<double>, rank string, score double").repartition(5)
    asked = table.filter("id % 50 = 0 or id = 3 or id = 7")
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 3)
    got = neighbours.search(table, asked, 5, part_rows=40).toPandas().sort_values(["query_id", "rank"])
    assert got[got.query_id == 3].vec_id.tolist() == [100, 101, 102, 103, 104]
    assert got[got.query_id == 100].vec_id.tolist() == [3, 101, 102, 103, 104]
    assert got[got.query_id == 7].vec_id.iloc[0] == 250 and abs(got[got.query_id == 7].score.iloc[0] - 1) < 1e-12
    assert set(got.query_id) == {0, 3, 7, 50, 100, 150, 200, 250} and (got.groupby("query_id").size() == 5).all()


def test_classifiers_on_odd_rows(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(odd, model, keep_text=False).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[5]["lang_pred"] == "und" and got[3]["lang_pred"] != "und"
    q, t = quality.fit(docs, labels), toxicity.fit(docs, labels)
    for rows in (quality.score(odd, q).collect(), toxicity.score(odd, t).collect()):
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert langid.predict(empty, model).count() == quality.score(empty, q).count() == toxicity.score(empty, t).count() == 0
    assert langid.fit(empty) is None and quality.fit(docs, labels.limit(0)) is None and toxicity.fit(docs, labels.limit(0)).score(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0] < 0.01


def held_out_rows(spark, sf="/root/testdata/sf0.01"):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return docs.withColumn("held_out", common.held_out(F.col("doc_id"))), labels, labels.filter(~common.held_out(F.col("doc_id")))


def area(scores, truth):
    ranks = scores.rank()
    pos = truth == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_language_of_held_out_documents(spark):
    docs, _, _ = held_out_rows(spark)
    model = langid.fit(docs.filter("not held_out"))
    rows = langid.predict(docs.filter("held_out").select("doc_id", "text"), model, keep_text=False).join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred <> 'und'").toPandas()
    assert len(rows) > 200 and (rows.lang == rows.lang_pred).mean() >= 0.97


@pytest.mark.parametrize("name,bar,least", [("quality", 0.97, 0.9), ("toxic", 0.9, 0.9)])
def test_labels_of_held_out_documents(spark, name, bar, least):
    docs, labels, known = held_out_rows(spark)
    own, cut = (quality, 0.7) if name == "quality" else (toxicity, 0.3)
    args = (("n_chars",),) if name == "quality" else ()
    model = own.fit(docs.filter("not held_out"), known, name, *args)
    rows = own.score(docs.filter("held_out").select("doc_id", "text", "n_chars"), model, *args, keep_text=False).join(labels, "doc_id").filter(f"{name} is not null").toPandas()
    assert len(rows) > 80 and area(rows.score, rows[name]) >= bar and ((rows.score >= cut) == (rows[name] == 1)).mean() >= least


def test_metadata_of_quality(spark):
    docs = spark.createDataFrame([(k, "same words here", float(4000 if k % 2 else 3)) for k in range(400)], "doc_id long, text string, n_chars double")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    model = quality.fit(docs, labels, "quality", ("n_chars",))
    asked = spark.createDataFrame([(1, "same words here", 4000.0, 9.0), (2, "same words here", 3.0, 9.0), (3, None, None, None), (4, "same words here", float("nan"), None)], "doc_id long, text string, n_chars double, score double")
    got = {r["doc_id"]: r["score"] for r in quality.score(asked, model, ("n_chars",)).collect()}
    assert got[1] > 0.8 and got[2] < 0.2 and all(0 <= s <= 1 for s in got.values()) and len(got) == 4


def test_linear_time_identity():
    m = quality.FactorisationMachine(50)
    cells, values = np.array([1, 7, 9]), np.array([0.5, 1.0, 2.0])
    pairs = sum((m.v[cells[i]] @ m.v[cells[j]]) * values[i] * values[j] for i in range(3) for j in range(i))
    assert np.isclose(m.raw(cells, values, np.array([0, 3]))[0][0], pairs)


TEXT = "a\\b <|end|> [INST] \\l\n"
MESSAGES = "array<struct<role:string,content:string,name:string>>"
LAYOUTS = {
    "prompt string, response string": ([TEXT, "yes"], [("user", TEXT), ("assistant", "yes")]),
    "prompt string, completion string": ([TEXT, "yes"], [("user", TEXT), ("assistant", "yes")]),
    "question string, answer string": ([TEXT, "yes"], [("user", TEXT), ("assistant", "yes")]),
    "instruction string, output string": ([TEXT, "yes"], [("user", TEXT), ("assistant", "yes")]),
    "instruction string, input string, output string": ([TEXT, "more", "yes"], [("user", TEXT), ("user", "more"), ("assistant", "yes")]),
    "system string, prompt string, response string": (["be", TEXT, "yes"], [("system", "be"), ("user", TEXT), ("assistant", "yes")]),
    "system string, instruction string, output string": (["be", TEXT, "yes"], [("system", "be"), ("user", TEXT), ("assistant", "yes")]),
    f"messages {MESSAGES}": ([[("user", TEXT, "n"), ("assistant", None, None), ("tool", "x", None)]], [("user", TEXT), ("assistant", ""), ("tool", "x")]),
    "conversations array<struct<from:string,value:string>>": ([[("human", TEXT), ("gpt", "yes")]], [("user", TEXT), ("assistant", "yes")]),
    "turns array<struct<turn:int,role:string,text:string>>": ([[(1, "bot", "yes"), (0, "human", TEXT), (2, None, None), (2, None, None)]], [("human", TEXT), ("bot", "yes"), ("", ""), ("", "")]),
    f"data struct<meta:string,messages:{MESSAGES}>": ([("m", [("user", TEXT, None), ("assistant", "yes", "n")])], [("user", TEXT), ("assistant", "yes")]),
    "data struct<inner:struct<prompt:string,response:string>>": ([((TEXT, "yes"),)], [("user", TEXT), ("assistant", "yes")]),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_chat_layouts(spark, layout):
    values, want = LAYOUTS[layout]
    plain = spark.createDataFrame([(1, *values)], f"id long, {layout}")
    for f in (plain, plain.withColumns({"source": F.lit("s"), "turn": F.lit(9), "text": F.lit("clash"), "a.b`c": F.lit(1)})):
        turns = chat.canonical_turns(f, "id")
        assert chat.unknown(turns).count() == 0
        pieces = chat.format_turns(turns, "id")
        back = chat.read_pieces(pieces).orderBy("nth").collect()
        assert [(r["role"], r["text"]) for r in back] == want
        loss = [t for r, t in want if r == "assistant"]
        assert [r["loss_text"] for r in back if r["loss_text"] is not None] == loss
        w = chat.whole(pieces, "id").first()
        assert [w["formatted"][s["start"] : s["end"]] for s in w["loss_spans"]] == [t.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b") for t in loss]
        assert chat.canonical_turns(f.limit(0), "id").count() == 0


def test_chat_null_fields_and_mixed_layouts(spark):
    schema = f"id long, prompt string, response string, system string, messages {MESSAGES}"
    rows = [(1, "p", None, None, None), (2, None, "r", None, None), (3, "p", "r", "s", None), (4, None, None, None, [("user", "m", None)]), (5, "p", "r", None, []), (6, None, None, None, None), (7, "p", None, "s", None), (None, "p", "r", None, None)]
    got = {r["id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.canonical_turns(spark.createDataFrame(rows, schema), "id").collect()}
    assert got == {
        1: [("user", "p"), ("assistant", "")], 2: [("user", ""), ("assistant", "r")], 3: [("system", "s"), ("user", "p"), ("assistant", "r")], 4: [("user", "m")], 5: [("user", "p"), ("assistant", "r")],
        6: [("user", ""), ("assistant", "")], 7: [("system", "s"), ("user", "p"), ("assistant", "")], None: [("user", "p"), ("assistant", "r")],
    }
    other = spark.createDataFrame([(9, "x")], "id long, strange string")
    assert chat.unknown(chat.canonical_turns(other, "id")).first()["n"] == 1


def brute_components(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (2, 50), (1, 30)])
def test_jaccard_equals_brute_force(spark, width, percent):
    rng = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(300)]
    rows = [(0, None), (1, ""), (2, "One two"), (3, "one TWO"), (4, "one"), (5, "b c d"), (6, "b c e"), (7, "d b c"), (8, "q r"), (9, "q s t")]
    base = [list(rng.choice(vocab, n)) for n in (12, 14, 40, 90, 200, 400)]
    for b in base:
        for k in range(12):
            t = list(b)
            for at in rng.integers(0, len(t), k // 3):
                t[at] = str(rng.choice(vocab))
            t = t[: len(t) - k % 3]
            rows.append((len(rows), " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(docs, width, percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_hot_keys_join_as_others(spark):
    left = spark.createDataFrame([(k % 40 if k % 3 else 7, k) for k in range(9000)] + [(None, -1), (99, -2)], "key long, row long")
    right = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("key <> 99")
    hot = common.hot_keys(right, ["key"], "n", 9002 * 20)
    assert 0 < hot.count() < right.count()
    for how in ("inner", "left"):
        got = common.join_hot(left, right, ["key"], hot, "row", how)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, left.join(right, ["key"], how).collect()))
    assert common.hot_keys(right.union(right), ["key"], "n", 9002 * 20).count() == hot.count()


def test_jaccard_of_a_hot_class(spark):
    rows = [(k % 900, "copies of one text fill the table") for k in range(1000)] + [(5, "another text that has the id of a copy"), (2000, "another text that has the id of a copy")]
    rows += [(3000 + k, f"text {k} of its own words {k * 7}") for k in range(500)]
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert len(got) == len(rows)
    assert Counter(r["component_id"] for r in got if r["doc_id"] < 900 and r["doc_id"] != 5) == {0: 998}
    assert all(r["component_id"] == r["doc_id"] for r in got if r["doc_id"] >= 3000)


def test_jaccard_on_odd_rows(spark, odd, empty):
    rows = jaccard.similar_components(odd, 5, 80).collect()
    assert len(rows) == len(ODD) and {r["component_id"] for r in rows if r["doc_id"] == 4} == {4}
    assert jaccard.similar_components(empty, 5, 80).count() == 0


def test_sharding(spark, odd, empty):
    assert sharding.shard_by_bytes(empty, 16).count() == 0
    assert sharding.shard_by_bytes(odd, 4).count() == len(ODD)
    docs = spark.createDataFrame([(k, "hot text" * 20 if k % 3 else f"text {k} " * (k % 40)) for k in range(2000)], "doc_id long, text string")
    rows = sharding.shard_by_bytes(docs, 8, 64).toPandas()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(rows) == 2000 and sizes.max() <= 1.03 * sizes.mean() and sizes.min() >= 0.97 * sizes.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))


def test_equal_texts_lie_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sharding.shard_by_bytes(docs, 16).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(zlib.crc32((texts[d] or "").encode()) == c for d, c in zip(rows.doc_id, rows.text_crc32))
    rows["text"] = [texts[d] or "" for d in rows.doc_id]
    share = rows["size"].sum() / 16
    small = rows.groupby("text").filter(lambda g: g["size"].sum() <= sharding.TOGETHER * share)
    assert small.text.duplicated().sum() > 20 and (small.groupby("text").shard.nunique() == 1).all()


def test_shards_of_rows_that_repeat_exactly(spark):
    docs = spark.createDataFrame([(None, "same text")] * 900 + [(7, "same text")] * 900 + [(k, f"text {k}") for k in range(900)], "doc_id long, text string")
    sizes = sharding.shard_by_bytes(docs, 8, 64).groupBy("shard").agg(F.sum("size").alias("n")).toPandas()
    assert len(sizes) == 8 and sizes.n.max() <= 1.05 * sizes.n.mean()


def test_small_groups_are_whole_across_ranges(spark):
    docs = spark.createDataFrame([(k, f"group {k % 400} " * 5) for k in range(4000)], "doc_id long, text string")
    rows = sharding.shard_by_bytes(docs, 8, 512).toPandas()
    rows["text"] = [k % 400 for k in rows.doc_id]
    assert (rows.groupby("text").shard.nunique() == 1).all()


def test_pipeline_keeps_and_drops(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stage(stage(spark, kept, SF), "s")
        assert after.columns == corpus_pipeline.COLUMNS and 0 < after.count() <= kept.count()
        kept = after
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def test_stages_decide_by_row(spark, tmp_path):
    import corpus_pipeline

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    same, other, leak = "one two three four five six seven", "a quite different text of its own here", f"so {item} it ends"
    rows = [*ODD[:3], (None, same), (None, same), (6, other), (6, other), (7, same), (8, "some third text that stays as it is"), (8, other), (9, leak), (9, "clean text of an id that also has a leak"), (None, leak), (None, None), (None, "")]
    docs = spark.createDataFrame([(*r[:2], "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    after = corpus_pipeline.duplicate_stage(spark, docs, str(tmp_path)).select("doc_id", "text").collect()
    got = Counter(map(tuple, after))
    want = Counter([*[r[:2] for r in ODD[:3]], (6, other), (7, same), (8, rows[8][1]), (9, leak), (9, rows[11][1]), (None, None), (None, "")])
    assert got == want
    left = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminate_stage(spark, docs, str(tmp_path)).collect())
    assert left == Counter([r[:2] for r in rows if r[1] != leak])


@pytest.mark.parametrize("rows", [ODD, []])
def test_whole_pipeline_on_odd_rows(spark, tmp_path, rows):
    import corpus_pipeline

    good = [(100 + k, f"{w} river carries water to the sea and {w} boats follow it down " * 6, "en", "s", 300) for k, w in enumerate("north south east west".split())] if rows else []
    spark.createDataFrame([*(r[:5] for r in rows), *good], "doc_id long, text string, lang string, source string, n_chars long").withColumn("text_2", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, 0) for r in [*rows, *good]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, "no id"), (1, None), (2, "")] if rows else [], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(packed.columns)
    if not rows:
        assert len(packed) == 0
    else:
        ids = set(packed.doc_id.dropna().astype(int))
        assert {r[0] for r in good} <= ids and not ids & {1, 2, 5}  # no letter: no language
        assert (packed.groupby("sequence_id").length.sum() <= 2048).all() and (packed.doc_id == 4).sum() == 1


def test_shards_of_a_lost_attempt_are_not_read(spark):
    docs = spark.createDataFrame([(k % 50, f"text {k} " * (k % 7)) for k in range(300)], "doc_id long, text string")
    path = common.new_path(spark, "t")
    folder = Path(path.removeprefix("file://"))
    folder.mkdir(parents=True)
    (folder / "shard-000000-lost.sst").write_bytes(b"half a file")
    manifest = sstable.write_tokens(docs, queries.tokenizer_path(), path, 4).collect()
    assert sum(r["docs"] for r in manifest) == 300 and all((folder / r["file"]).exists() for r in manifest)
    assert sstable.read_tokens(spark, path).count() == 300
    asked = spark.createDataFrame([(k,) for k in (None, -1, 0, 17, 49, 50, 17)], "doc_id long")
    assert Counter(r["doc_id"] for r in sstable.lookup(spark, path, asked).collect()) == {0: 6, 17: 6, 49: 6}


def test_one_id_over_many_shards_is_looked_up_whole(spark):
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(200)] + [(3, "x"), (9, "y")], "doc_id long, text string")
    path = common.new_path(spark, "t")
    manifest = sstable.write_tokens(docs, queries.tokenizer_path(), path, 6).collect()
    assert len(manifest) > 2
    found = Counter(r["doc_id"] for r in sstable.lookup(spark, path, spark.createDataFrame([(7,), (9,), (8,)], "doc_id long")).collect())
    assert found == {7: 200, 9: 1}


def test_more_ranges_for_more_bytes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_BYTES", 64)
    docs = spark.createDataFrame([(k, "y" * (k * 31 % 90)) for k in range(2500)], "doc_id long, text string")
    rows = sharding.shard_by_bytes(docs, 8).toPandas()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(rows) == 2500 and sizes.max() - sizes.min() <= 0.08 * sizes.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))


def test_remove_leaks_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(k, " ".join(f"b{k}w{i}" for i in range(16))) for k in range(5)], "item_id long, text string")
    docs = bench.withColumnRenamed("item_id", "doc_id").union(spark.createDataFrame([(None, "clean"), (None, None)], "doc_id long, text string"))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    assert sorted(r["text"] or "" for r in decontaminate.remove_leaks(docs, bench).collect()) == ["", "clean"]
    assert decontaminate.find_leaks(docs, bench).count() == 5


def test_ascii_words_are_parted_as_the_library_parts_them():
    library, e, rng = Tokenizer.from_file(queries.tokenizer_path()), encoder(), np.random.default_rng(5)
    for n in range(3000):
        text = "".join(rng.choice(list(" \n\ta'stbB9.,\x1c\x1f\x0b\r\x85\xa0é"), rng.integers(1, 30)))
        assert e.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
    e = encoder()
    e.encode("one the two.\nthree it's")
    assert "two.\nthree" not in e.words and "it's" in e.words and "\nthree" not in e.words  # parts of a line's end are remembered one by one
