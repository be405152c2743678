"""Spelling variants by a bit-sliced position index.

words() counts the runs of letters of whole texts. near() finds, for each word
of the vocabulary, the words one inserted, deleted or replaced code point away.

An index holds, for each position and letter, the set of its words with that
letter there, as bits. A word is matched against all words of an index at once:
going through its letters, four sets are carried along: those that agree so
far; and those one error away, by a replaced letter (same position), a letter
more (position shifted by one forward) or less (shifted back). Words lie in an
index in order of falling count, so the first bit of the result is the form.

Which words meet: of two near words, the shorter of length a, either the first
a // 2 code points are equal or the last a - a // 2. Each word goes to its four
keys (class a of its own length and of one less, prefix and suffix) and meets
the words of equal key only; a pair that both keys join counts once, by its
prefix. Keys are dealt to indexes of about BLOCK words; a key of more is parted
into several indexes and its words are matched against each.

Null texts have no runs; a null id is the empty text in the hash. Whole texts
are read, runs of any length; repeated rows count each. An empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words in an index, words matched at once, positions sliced at once.
BLOCK, QUERIES, SLICE = 1024, 4096, 64
#: A form's count is at least so many times the word's.
RATIO = 10

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEAD = 0xC3  # with a byte that follows it: U+00C0 to U+00FF


def runs(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters with `least` code points or more, lower-cased (A-Z):
    (bytes, offsets, text of each)."""
    inside = _LETTER[data]
    lead = data == _LEAD
    inside |= lead
    inside[1:] |= lead[:-1]
    start, end = common.word_spans(np.where(inside, np.uint8(97), np.uint8(32)), offsets)
    leads = np.zeros(len(data) + 1, np.int32)
    np.cumsum(lead, out=leads[1:])
    long = end - start - (leads[end] - leads[start]) >= least
    start, end = start[long], end[long]
    edges = np.zeros(len(data) + 1, np.int8)
    edges[start] += 1
    edges[end] -= 1
    own = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=bounds[1:])
    return common.LOWER[data[own]], bounds, np.searchsorted(offsets, start, "right") - 1


def counted(ids: list, data: np.ndarray, offsets: np.ndarray, least: int, divisor: int) -> tuple[pa.Array, pa.Array]:
    """(word, n) of texts with these ids, letters deleted by the hash's rule."""
    letters, bounds, text = runs(data, offsets, least)
    raw, edges = letters.tobytes(), bounds.tolist()
    seeds = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids]
    cut, deleted = np.zeros(len(text), bool), Counter()
    for k, t in enumerate(text.tolist()):
        h = zlib.crc32(raw[edges[k] : edges[k + 1]], seeds[t])
        if h % divisor == 0:
            cut[k] = True
            deleted[(raw[edges[k] : edges[k + 1]], h)] += 1
    array = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(bounds), pa.py_buffer(letters))
    whole = pc.value_counts(array.filter(pa.array(~cut)))
    shorter: Counter = Counter()
    for (word, h), n in deleted.items():
        run = word.decode()
        at = h % len(run)
        if len(run) > least:
            shorter[run[:at] + run[at + 1 :]] += n
    return pa.concat_arrays([whole.field(0).cast(pa.string()), pa.array(list(shorter), pa.string())]), pa.concat_arrays([whole.field(1), pa.array(list(shorter.values()), pa.int64())])


def words(docs: DataFrame, least: int = 7, at_least: int = 2, divisor: int = 31) -> DataFrame:
    """(word, n): the runs of docs (doc_id, text) of `least` code points or more,
    after the deletions, with their occurrences, at_least that many."""
    common.configure(docs.sparkSession)

    def run(batches):
        for batch in batches:
            word, n = counted(batch.column(0).to_pylist(), *common.text_buffers(batch.column(1)), least, divisor)
            yield pa.RecordBatch.from_arrays([word, n], ["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= at_least)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words one after another, where each begins: n + 1)."""
    begins = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=begins[1:])
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), begins


class Slices:
    """The bit-sliced index: bits(i)[letter] is the set of words with that letter
    at position i. Slices are made for SLICE positions at a time."""

    def __init__(self, words: list[str]):
        self.points, self.begins = code_points(words)
        self.lengths = np.diff(self.begins)
        self.letters = np.unique(self.points)
        self.codes = np.searchsorted(self.letters, self.points)
        self.width = -(-len(words) // 64)
        self.n = len(words)
        self.longest = int(self.lengths.max(initial=0))
        self.made: dict[int, np.ndarray] = {}

    def pack(self, member: np.ndarray) -> np.ndarray:
        """Sets (…, words) of booleans as bits (…, width)."""
        padded = np.zeros((*member.shape[:-1], self.width * 64), bool)
        padded[..., : self.n] = member
        return np.packbits(padded, axis=-1, bitorder="little").view("<u8")

    def bits(self, i: int) -> np.ndarray | None:
        """Rows by letter, the last one (no such letter) empty; None where no
        word has a position i."""
        if i < 0 or i >= self.longest:
            return None
        k = i // SLICE
        if k not in self.made:
            if len(self.made) > 1:  # longer words are gone through slice by slice
                del self.made[min(self.made)]
            lo, hi = k * SLICE, min((k + 1) * SLICE, self.longest)
            here = np.zeros((hi - lo, len(self.letters) + 1, self.width * 64), bool)
            for p in range(lo, hi):
                own = np.flatnonzero(self.lengths > p)
                here[p - lo, self.codes[self.begins[own] + p], own] = True
            self.made[k] = np.packbits(here, axis=-1, bitorder="little").view("<u8")
        return self.made[k][i - k * SLICE]


def match(index: Slices, same_key: np.ndarray, words: list[str], classes: np.ndarray, by_suffix: np.ndarray) -> np.ndarray:
    """For each of words the set of index words that are one error away, among
    those of its key (same_key: sets), in pairs whose shorter word has the
    length `classes`. Of words met by suffix, those with an equal first half
    of the class are left out."""
    points, begins = code_points(words)
    lengths = np.diff(begins)
    codes = np.searchsorted(index.letters, points)
    codes[codes == len(index.letters)] = 0
    codes = np.where(index.letters[codes] == points, codes, len(index.letters)) if len(index.letters) else np.zeros(len(points), np.int64)
    exact, replaced, more, less = same_key.copy(), np.zeros_like(same_key), np.zeros_like(same_key), np.zeros_like(same_key)
    prefix = np.zeros_like(same_key)
    order = np.argsort(-lengths, kind="stable")
    exact = exact[order]
    sizes, begin, half = lengths[order], begins[:-1][order], (classes // 2)[order]
    for i in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-sizes, -i, "left"))  # those longer than i come first
        at_half = np.flatnonzero(half[:n] == i)
        prefix[at_half] = exact[at_half]
        if i >= index.longest + 1:
            break
        letter = codes[begin[:n] + i]
        here, ahead, back = (index.bits(p) for p in (i, i + 1, i - 1))
        same = here[letter] if here is not None else np.zeros_like(exact[:n])
        was = exact[:n].copy()
        less[:n] = (less[:n] & back[letter] if back is not None else 0) | was
        more[:n] = (more[:n] | was) & ahead[letter] if ahead is not None else 0
        replaced[:n] = (replaced[:n] & same) | (was & ~same)
        exact[:n] = was & same
    by_length = {int(a): index.pack(index.lengths == a) for a in np.unique(np.concatenate([sizes - 1, sizes, sizes + 1]))} if len(sizes) else {}
    ends = lambda shift: np.stack([by_length[int(a)] for a in sizes + shift])
    own = sizes == classes[order]
    # a pair of equal lengths, or with a longer word, belongs to the class of this word; with a shorter one, to the class of that
    found = np.where(own[:, None], (replaced & ends(0)) | ((more | exact) & ends(1)), less & ends(-1)) if len(sizes) else exact
    found = np.where(by_suffix[order][:, None], found & ~prefix, found)
    out = np.zeros_like(found)
    out[order] = found
    return out


def keyed(vocabulary: DataFrame, least: int) -> DataFrame:
    """Each word with its keys: word, n, class, suffix (flag), key."""
    size = F.char_length("word")
    classed = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("class")).filter(F.col("class") >= least)
    half = F.floor(F.col("class") / 2).cast("int")
    parts = F.array(
        F.struct(F.lit(False).alias("suffix"), F.substr("word", F.lit(1), half).alias("part")),
        F.struct(F.lit(True).alias("suffix"), F.right("word", F.col("class") - half).alias("part")),
    )
    made = classed.select("word", "n", "class", F.explode(parts).alias("p"))
    return made.select("word", "n", "class", "p.suffix", F.xxhash64("class", "p.suffix", "p.part").alias("key"))


NEAR = "word string, n long, n_near long, form_n long, form string"


def near(vocabulary: DataFrame, least: int = 7, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form_n, form) of each row of vocabulary (word, n; each
    word once): how many near words it has, and the near one of largest count
    with that count (ties: the smallest)."""
    rows = keyed(vocabulary, least)
    blocks = max(1, -(-4 * vocabulary.count() // block))
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block).select("key", F.ceil(F.col("_n") / block).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    spread = rows.join(large, "key", "left").withColumn("_own", F.pmod(F.xxhash64("word"), parts))
    dealt = spread.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    dealt = dealt.select(F.pmod(F.xxhash64("key", "_part"), F.lit(blocks)).alias("block"), (F.col("_own") != F.col("_part")).alias("asks"), "key", "class", "suffix", "word", "n")
    # of a block its own words come first, the commonest first; then those that only ask
    ordered = dealt.repartition("block").sortWithinPartitions("block", "asks", F.col("n").desc(), "word", "key")

    def answers(index, table, keys, batch):
        word, n, key, classes, suffix = batch
        same = np.zeros((len(word), index.width), np.uint64)
        known = np.array([keys.get(k, -1) for k in key])
        same[known >= 0] = table[known[known >= 0]]
        some = np.flatnonzero(same.any(1))
        found = match(index, same[some], [word[k] for k in some], classes[some], suffix[some])
        counts = np.bitwise_count(found).sum(1).astype(np.int64)
        hit = np.flatnonzero(counts)
        if not len(hit):
            return None
        words_ = index.words
        part = (found[hit] != 0).argmax(1)
        bit = found[hit, part]
        best = part * 64 + np.bitwise_count((bit & (~bit + np.uint64(1))) - np.uint64(1)).astype(np.int64)  # the lowest bit set
        own = some[hit]
        return pa.RecordBatch.from_arrays([pa.array([word[k] for k in own], pa.string()), pa.array(n[own]), pa.array(counts[hit]), pa.array(index.counts[best]), pa.array([words_[b] for b in best], pa.string())], ["word", "n", "n_near", "form_n", "form"])

    def run(batches):
        block_, members, index, table, keys = None, [], None, None, {}
        waiting: list = []

        def built():
            nonlocal index, table, keys
            rows_ = [r for m in members for r in zip(*m)]
            order, keys = {}, {}
            for w, n, k in rows_:
                order.setdefault(w, n)
                keys.setdefault(k, len(keys))
            index = Slices(list(order))
            index.words, index.counts = list(order), np.array(list(order.values()), np.int64)
            at = {w: j for j, w in enumerate(order)}
            table = np.zeros((len(keys), index.n), bool)
            table[[keys[k] for _, _, k in rows_], [at[w] for w, _, _ in rows_]] = True
            table = index.pack(table)

        def flush():
            """Answers what waits; the index is built when a block's own words are all here."""
            nonlocal waiting
            if not waiting:
                return
            if index is None:
                built()
            word = [w for b in waiting for w in b[0]]
            n, key, classes, suffix = (np.concatenate([b[j] for b in waiting]) for j in (1, 2, 3, 4))
            waiting = []
            for k in range(0, len(word), QUERIES):
                out = answers(index, table, keys, (word[k : k + QUERIES], n[k : k + QUERIES], key[k : k + QUERIES].tolist(), classes[k : k + QUERIES], suffix[k : k + QUERIES]))
                if out is not None:
                    yield out

        for batch in batches:
            at = batch.column(0).to_numpy()
            asks = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            key, classes, n = (batch.column(j).to_numpy() for j in (2, 3, 6))
            suffix = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            word = batch.column(5).to_pylist()
            edges = np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(at)]):
                if lo == hi:
                    continue
                if at[lo] != block_:
                    yield from flush()
                    block_, members, index = at[lo], [], None
                if asks[lo] and members and index is None:
                    yield from flush()
                if not asks[lo]:
                    members.append((word[lo:hi], n[lo:hi].tolist(), key[lo:hi].tolist()))
                waiting.append((word[lo:hi], n[lo:hi], key[lo:hi], classes[lo:hi], suffix[lo:hi]))
                if index is not None:  # only those that ask come now: they need not wait
                    yield from flush()
        yield from flush()

    found = ordered.mapInArrow(run, NEAR)
    none = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("w")))).alias("b")
    met = found.unionByName(none).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    return met.select("word", "n", "n_near", (-F.col("b.m")).alias("form_n"), F.col("b.w").alias("form"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form; written): forms followed to the last,
    two steps becoming one each round. A form's count is RATIO times the word's,
    so a chain is short."""
    spark, roots = forms.sparkSession, forms.select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = common.stage(roots.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        going = not longer.filter("moved").isEmpty()
        if hasattr(roots, "_staged_path"):
            common.release(roots)
        path, roots = longer._staged_path, longer.drop("moved")
        roots._staged_path = path
        if not going:
            return roots


def variants(vocabulary: DataFrame, least: int = 7) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of vocabulary (word, n; written)."""
    far = F.coalesce(F.col("form_n") >= RATIO * F.col("n"), F.lit(False))
    all_words = near(vocabulary, least).select("word", "n", "n_near", F.when(far, F.col("form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n"))
    all_words = common.stage(all_words, "near")
    roots = rooted(all_words.filter(F.col("form").isNotNull()).select("word", "form"))
    return all_words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
