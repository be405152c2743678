"""Benchmark decontamination by spaced seeds.

Words (runs of letters and digits, A-Z folded) are hashed; each fixed mask
hashes the words at its 1 places of every window and ignores the rest, so a
substituted word between them does not hide a hit. The benchmark's seed hashes
are met in every window of every document; a hit is followed word by word as
long as it can be the beginning of a best run, and where it leads to enough
matches the two word sequences are aligned and the best substitution-tolerant
overlap is measured. The masks meet the beginning of every best run, so no
overlap that counts is lost.

A document is contaminated by an item when one alignment's best run matches at
least min(MIN_MATCH, 80 % of the item's words) words, a mismatch costing two
matches. Items of under 8 words count when they occur whole. Items of under
LEAST_WORDS are too common to tell and give no hit, unless `least_words` is
less: then those of that many words and more are met as whole sequences. Null and empty texts, on either
side, give no hit; repeated rows are each reported; the first best run is
reported on ties. An empty table on either side gives no rows. Texts are read
whole, whatever their length; columns other than the ids and texts are not
read (remove_leaks passes them on).

The benchmark goes to the tasks in blocks of about BLOCK_BYTES of text, one
pass over the documents for each, whose rows are written before the next block
is gathered: its size is not bounded by memory.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The seeds (fixed values): 1 is a place that must match. All words before any
#: place of a best run hold more than twice as many matches as mismatches (else
#: the run would begin later), so its first three words match and the next three
#: hold one mismatch at most: each run of five words or more begins with a seed.
MASKS = ("11111", "111101", "111011")
MIN_MATCH, SHARE, MISMATCH = 13, 0.8, 2
BLOCK_BYTES = 8 << 20
#: Words of the shortest items that are looked for.
LEAST_WORDS = 5
#: Seed hits that are followed at a time.
HITS = 1 << 20
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(32)], np.uint64)


def seed_hashes(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of the mask's places in every window of words."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, number + 1, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h += words[k : k + n] * _WEIGHTS[k]
    return common.mix(h)


def needed(n: int) -> int:
    """Matches that an item of n words needs."""
    return n if n < 8 else min(MIN_MATCH, int(np.ceil(SHARE * n)))


class SeedIndex:
    """The seed hashes of a block of items, sorted, with a table of their
    first bits that turns away most windows."""

    def __init__(self, ids: list[int], texts: list[str], least_words: int = LEAST_WORDS):
        raw = [(t or "").encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        words, begins = common.word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets, common.ALNUM)
        self.ids, self.words, self.all, self.begins, hashes, item, place = ids, [], words, begins, [], [], []
        for k in range(len(ids)):
            self.words.append(words[begins[k] : begins[k + 1]])
        self.need = np.array([needed(len(w)) for w in self.words], np.int64)
        # a short item is one seed of all its words
        self.masks = (*MASKS, *("1" * n for n in range(max(1, least_words), LEAST_WORDS)))
        for m, mask in enumerate(self.masks):
            for k, own in enumerate(self.words):
                if m >= len(MASKS) and len(own) != len(mask):
                    continue
                h = seed_hashes(own, mask, m)
                hashes.append(h)
                item.append(np.full(len(h), k))
                place.append(np.arange(len(h)))
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)
        self.shift = np.uint64(64 - min(26, max(16, int(len(hashes) * 32).bit_length())))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[self.hashes >> self.shift] = True

    def hits(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(item, diagonal) of every window of words that meets a seed and from
        which a run goes on to enough matches."""
        found = []
        for m, mask in enumerate(self.masks):
            h = seed_hashes(words, mask, m)
            at = np.flatnonzero(self.table[h >> self.shift]) if len(h) else np.zeros(0, np.int64)
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            many = hi - lo
            at, lo, many = at[many > 0], lo[many > 0], many[many > 0]
            ends = np.cumsum(many)
            begin = 0
            while begin < len(at):
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - many[begin] + HITS, "right")))
                a, n = at[begin:end], many[begin:end]
                k = np.repeat(lo[begin:end], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(self.follow(words, np.repeat(a, n), self.item[k], self.place[k]))
                begin = end
        return np.unique(np.concatenate(found), axis=0).tolist() if found else []

    def follow(self, words: np.ndarray, at: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(item, diagonal) of the hits from which matches stay more than twice
        the mismatches until there are enough of them."""
        out = [np.zeros((0, 2), np.int64)]
        own, last = self.begins[item] + place, self.begins[item + 1]
        matches, step = np.zeros(len(at), np.int64), 0
        while len(at):
            matches = matches + (words[at + step] == self.all[own + step])
            step += 1
            done = matches >= self.need[item]
            out.append(np.stack([item[done], (at - place)[done]], 1))
            on = ~done & (matches > MISMATCH * (step - matches)) & (at + step < len(words)) & (own + step < last)
            at, item, place, own, last, matches = (x[on] for x in (at, item, place, own, last, matches))
        return np.concatenate(out)

    def verify(self, words: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """(matches, first word, word after) of the best run, if it is enough."""
        own = self.words[item]
        a, b = max(0, diagonal), min(len(words), diagonal + len(own))
        same = words[a:b] == own[a - diagonal : b - diagonal]
        run = np.cumsum(np.where(same, 1, -MISMATCH))
        low = np.minimum.accumulate(np.concatenate([[0], run[:-1]]))
        end = int((run - low).argmax())
        start = int(np.flatnonzero(np.concatenate([[0], run[:-1]])[: end + 1] == low[end])[-1])
        matches = int(same[start : end + 1].sum())
        return (matches, a + start, a + end + 1) if matches >= self.need[item] else None


def _indexes(benchmark: DataFrame, least_words: int) -> list:
    """For each block of the benchmark a function that broadcasts its seeds."""
    spark = benchmark.sparkSession
    common.configure(spark)
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK_BYTES))

    def send(block: int):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()  # about BLOCK_BYTES
        return spark.sparkContext.broadcast(SeedIndex([r["item_id"] for r in rows], [r["text"] for r in rows], least_words))

    return [lambda block=block: send(block) for block in range(blocks)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs (doc_id, text) against benchmark (item_id, text). Returns a row for
    each document and item that overlap: doc_id, item_id, matched_words,
    item_words, start_word, end_word (of the document)."""
    schema = "doc_id long, item_id long, matched_words int, item_words int, start_word int, end_word int"
    texts = docs.select(F.col("doc_id").cast("long"), "text")

    def pass_over(send) -> DataFrame:
        shared = send()

        def run(batches):
            common.forget()
            index = shared.value
            for batch in batches:
                data, offsets = common.text_buffers(batch.column(1))
                words, begins = common.word_hashes(data, offsets, common.ALNUM)
                out = []
                for k, doc in enumerate(batch.column(0).to_pylist()):
                    own, best = words[begins[k] : begins[k + 1]], {}
                    for item, diagonal in index.hits(own):
                        found = index.verify(own, item, diagonal)
                        if found and found[0] > best.get(item, (0,))[0]:
                            best[item] = found
                    out += [(doc, index.ids[i], m, len(index.words[i]), s, e) for i, (m, s, e) in sorted(best.items())]
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
                columns = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "matched_words", "item_words", "start_word", "end_word"])

        found = texts.mapInArrow(run, schema)
        if len(sends) > 1:  # the driver holds one block at a time
            found = common.stage(found, "leaks")
            shared.unpersist()
        return found

    sends = _indexes(benchmark, least_words)
    return reduce(DataFrame.unionByName, [pass_over(send) for send in sends])


def remove_leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs whose own text has no leak. Each row is decided by its
    text alone, so ids may be null or repeated. Between two blocks of the
    benchmark the rows are written."""
    at = docs.columns.index("text")

    def pass_over(rows: DataFrame, send) -> DataFrame:
        shared = send()

        def run(batches):
            common.forget()
            index = shared.value
            for batch in batches:
                words, begins = common.word_hashes(*common.text_buffers(batch.column(at)), common.ALNUM)
                keep = []
                for k in range(batch.num_rows):
                    own = words[begins[k] : begins[k + 1]]
                    keep.append(not any(index.verify(own, item, diagonal) for item, diagonal in index.hits(own)))
                yield batch.filter(pa.array(keep, pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    sends, staged = _indexes(benchmark, least_words), None
    for send in sends[:-1]:
        now = common.stage(pass_over(docs if staged is None else staged, send), "clean")
        if staged is not None:
            common.release(staged)
        staged = now
    return pass_over(docs if staged is None else staged, sends[-1])
