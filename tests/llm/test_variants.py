"""Clustering, license scans and spelling variants against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chapterlake.llm import clustering, common, licenses, queries, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words string, word string, n string, matches string"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], t, "x", "y", "z", None) for k, t in enumerate(texts)], DOCS)


# --- clustering ---------------------------------------------------------------


def brute_clusters(rows, k, rounds, dim=64, scale=256):
    kept = []
    for i, v in rows:
        if v is None or len(v) != dim or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(scale * x) for x in v]))
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    return Counter((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), centroids


def test_tree_finds_the_nearest_and_the_smallest_of_ties():
    rng = np.random.default_rng(3)
    for k, dim, high in ((1, 2, 3), (5, 3, 2), (40, 2, 4), (97, 4, 3), (300, 8, 100)):
        centroids = rng.integers(-high, high, (k, dim))
        vectors = np.concatenate([rng.integers(-high, high, (200, dim)), centroids])
        number, far = clustering.Tree(centroids).nearest(vectors)
        every = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
        assert (far == every.min(1)).all() and (number == every.argmin(1)).all()


def test_tree_prunes_what_is_far():
    rng = np.random.default_rng(4)
    centroids = np.concatenate([rng.integers(0, 50, (32, 4)) + 1000 * c for c in range(32)])
    tree, met = clustering.Tree(centroids), []
    count = tree.distances
    tree.distances = lambda v, c: met.append(len(v)) or count(v, c)
    tree.nearest(centroids)
    assert sum(met) < 0.1 * len(centroids) ** 2


def test_tree_at_the_largest_integers():
    top = clustering.LARGEST
    centroids = np.array([[top] * 64, [-top] * 64, [top] * 63 + [top - 1]], np.int64)
    number, far = clustering.Tree(centroids, leaf=1).nearest(np.array([[top] * 64, [-top] * 64], np.int64))
    assert number.tolist() == [0, 1] and far.tolist() == [0, 0]
    assert clustering.Tree(centroids).distances(centroids[:1], np.array([1]))[0] == 64 * (2 * top) ** 2


@pytest.mark.parametrize("k", [3, 40])
def test_clusters_equal_brute_force(spark, k):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=64) * 0.02]) for i in range(120)]
    rows += [(200 + i, list(rows[i % 3][1])) for i in range(60)]  # a third are copies
    rows += [(7, list(rows[7][1])), (None, list(rows[9][1])), (300, None), (301, [0.5] * 63), (302, [0.5] * 63 + [None]), (303, [float("nan")] + [0.0] * 63), (304, [float("inf")] * 64), (305, [1e30] * 64), (306, []), (307, [0.0] * 64)]
    table = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("cluster", F.lit("x"))
    assigned, centroids = clustering.cluster(table.repartition(3), k=k, rounds=3)
    want, means = brute_clusters([r for r in rows if r[0] != 305], k, 3)
    assert Counter((r["id"], r["cluster"], r["distance"]) for r in assigned.collect()) == want
    assert centroids.tolist() == means
    done = clustering.summarised(assigned, centroids).collect()
    per = Counter()
    for (_, c, d), n in want.items():
        per[c] += d * n
    assert all(r["cluster_inertia"] == per[r["cluster"]] and r["inertia"] == sum(per.values()) for r in done)
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, means[r["cluster"]])).encode()).hexdigest() for r in done)


def test_clusters_of_no_and_few_vectors(spark):
    empty = spark.createDataFrame([], "id long, vector array<float>")
    assert clustering.summarised(*clustering.cluster(empty)).collect() == []
    few = spark.createDataFrame([(1, [0.1] * 64), (2, [0.2] * 64), (3, [0.1] * 64)], "id long, vector array<float>")
    rows = clustering.summarised(*clustering.cluster(few)).collect()
    assert len(rows) == 3 and all(r["distance"] == 0 and r["inertia"] == 0 for r in rows)


# --- licenses -----------------------------------------------------------------

SMALL = (
    licenses.Template("a", "alpha beta", 0.5, True),
    licenses.Template("b", "Alpha <<beginOptional>>, or <<beginOptional>>not<<endOptional>> to,<<endOptional>> beta <<var;words=1-3>> (gamma)", 0.9),
    licenses.Template("b", "<<beginOptional>>so<<endOptional>> delta <<var;words=0-2>> delta epsilon", 1.0),
)


def brute_matches(text, templates):
    """Every place by trying all ways through a template."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))

    def ends(parts, at):
        if not parts:
            return {at}
        head, rest = parts[0], parts[1:]
        if isinstance(head, str):
            return ends(rest, at + 1) if at < len(words) and words[at] == head else set()
        if isinstance(head, list):
            return ends(rest, at).union(*[ends(rest, e) for e in ends(head, at)])
        return set().union(*[ends(rest, at + n) for n in range(head[0], head[1] + 1) if at + n <= len(words)])

    found = [(t.label, s, max(e) - 1) for t in templates for s in range(len(words)) if (e := ends(licenses.parse(t.markup), s))]
    return len(words), Counter(found)


def check_scan(rows, texts, templates):
    for r in rows:
        n, found = brute_matches(texts[r["doc_id"]], templates)
        assert r["n_words"] == n and Counter((m["label"], m["first"], m["last"]) for m in r["matches"]) == found, texts[r["doc_id"]]


def test_templates_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["alpha", "beta", "gamma", "delta", "epsilon", "or", "not", "to", "so", "x", "Alpha", "BETA", "béta", "delta"]
    texts = [None, "", "...", "alpha", "alpha beta", "ALPHA-beta's gamma", "alpha beta x gamma", "alpha or to beta x y z gamma", "so delta delta epsilon", "delta\n" * 50 + "epsilon"]
    texts += [" ".join(rng.choice(vocabulary, rng.integers(1, 40))) for _ in range(400)]
    rows = licenses.scan(docs_of(spark, texts).repartition(3), SMALL).collect()
    assert len(rows) == len(texts) and rows[0]["word"] == "y"
    check_scan(rows, texts, SMALL)


def test_license_wording(spark):
    mit = next(t.markup for t in licenses.TEMPLATES if t.label == "mit-text")
    plain = re.sub(r"<<[^>]*>>", "", mit)
    texts = [
        plain, plain.replace("AND NONINFRINGEMENT", ""), plain.replace("free of charge", "free of cost"), plain.upper().replace(" ", "\n* "), "pad " * 30_000 + plain + " pad" * 10,
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "under the mit licence",
    ]
    rows = licenses.scan(docs_of(spark, texts)).collect()
    check_scan(rows, texts, licenses.TEMPLATES)
    labels = {r["doc_id"]: {m["label"] for m in r["matches"]} for r in rows}
    assert ["mit-text" in labels[k] for k in range(5)] == [True, True, False, True, True]
    assert labels[5] == {"mit", "mit-notice"} and labels[6] == {"apache-2", "apache-2-grant"} and labels[7] == {"cc-by-nc", "cc-by-nc-4"} and labels[8] == {"gpl-3"} and not labels[9]


def test_automaton_forgets_states_without_losing_matches():
    texts = ["alpha or not to beta x y gamma", "so delta x delta delta epsilon delta epsilon"] * 3
    data = "\n".join(texts).encode()
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    offsets[-1] = len(data)
    hashes, begins = common.word_hashes(np.frombuffer(data, np.uint8), offsets, common.ALNUM)
    small, large = licenses.Automaton(SMALL, remembered=1), licenses.Automaton(SMALL)
    for _ in range(3):
        for a, b in zip(small.matches(small.numbers(hashes), begins), large.matches(large.numbers(hashes), begins)):
            assert a.tolist() == b.tolist()


@pytest.mark.parametrize("markup", ["<<beginOptional>>a<<endOptional>>", "<<var;words=0-2>> a", "a <<endOptional>>", "<<beginOptional>> a", "a <<var;words=3-1>> b", ""])
def test_refused_templates(markup):
    with pytest.raises(ValueError):
        licenses.Automaton([licenses.Template("x", markup, 1.0)])


# --- spelling -----------------------------------------------------------------


def brute_words(rows, least=7, at_least=2):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= at_least}


def one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words):
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for d in (-1, 0, 1) for v in by_length.get(len(w) + d, []) if one_error(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_words_equal_brute_force(spark):
    texts = [None, "", "123 !!", "Zażółć gęślą Élan ÉLAN über÷wort ÀÖØÿabcde", "LettersÃ\u0083x letters-letters Letters", "x" * 70_000 + " " + "x" * 70_000, "¿comenzarÀ comenzar", "wordword" * 3 + "\U0001f600wordwords"]
    texts += [" ".join(f"wording{chr(97 + (k * j) % 26)}ly" for j in range(60)) for k in range(60)]
    ids = [*range(len(texts) - 2), 5, None]
    df = docs_of(spark, texts, ids).repartition(3)
    got = {r["word"]: r["n"] for r in spelling.words(df).collect()}
    assert got == brute_words(list(zip(ids, texts)))


def test_words_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["word"]: r["n"] for r in spelling.words(docs).collect()}
    assert got == brute_words([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("block", [1024, 5])
def test_near_words_equal_brute_force(spark, block):
    rng = np.random.default_rng(8)
    words = {}
    for _ in range(150):
        base = "".join(rng.choice(list("abcé"), rng.integers(7, 12)))
        words[base] = int(rng.choice([2, 3, 20, 30, 300, 5000]))
        for _ in range(rng.integers(0, 6)):
            k, kind = rng.integers(0, len(base) + 1), rng.integers(0, 3)
            other = base[:k] + ("" if kind == 0 else str(rng.choice(list("abcz")))) + base[k + (kind != 1) :]
            if len(other) >= 7:
                words[other] = int(rng.choice([2, 2, 3, 30, 300]))
    same = ["samesame" + x for x in "abcdefghij"]  # all near one another, ties
    words |= dict.fromkeys(same, 7) | {"q" * 200: 3, "q" * 199: 40, "q" * 199 + "r": 40, "q" * 100 + "r" + "q" * 99: 2}
    table = common.stage(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3), "w")
    near = {r["word"]: (r["n_near"], r["form"], r["form_n"]) for r in spelling.near(table, 7, block).collect()}
    want = {}
    for w in words:
        vs = [v for v in words if one_error(w, v)]
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        want[w] = (len(vs), best, words.get(best))
    assert near == want
    if block == 1024:
        assert set(rows_of(spelling.variants(table))) == brute_variants(words)


def test_spelling_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute_variants(brute_words([(r["doc_id"], r["text"]) for r in docs]))
    got = rows_of(queries.op13_spelling(spark, SF))
    assert len(got) == len(want) and set(got) == want


def test_spelling_of_no_words(spark):
    for texts in ([], [None, "", "short words"]):
        table = common.stage(spelling.words(docs_of(spark, texts)), "none")
        assert rows_of(spelling.variants(table)) == []
