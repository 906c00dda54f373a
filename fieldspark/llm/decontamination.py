"""Benchmark decontamination: SimHash of item-sized windows, Hamming multi-index, exact weighted-shingle similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldspark.llm.common import hashed, shingles, word_hashes

SHINGLE = 5
COUNTERS = (1 << 20) - 3
BLOCKS, BLOCK_BITS = 8, 8
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain(text: str | None) -> bytes:
    """Case-folded text without ASCII punctuation."""
    return text.casefold().encode().translate(None, PUNCTUATION) if text else b""


def plain_words(text: str | None) -> list[bytes]:
    return plain(text).split()


def sign_bits(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    raw = np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1).astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints: the signs of 64 sums each."""
    return np.packbits(sums > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def count_shingles(items: list[tuple[int, str]], into: np.ndarray | None = None) -> np.ndarray:
    """Adds to a table of ``COUNTERS`` counters, by hash, in how many items each shingle occurs. Its size is fixed, so it covers
    a benchmark of any number of blocks; shingles that meet in a counter weigh a little less."""
    into = np.zeros(COUNTERS, np.int64) if into is None else into
    for _, text in items:
        if words := plain_words(text):
            np.add.at(into, (np.unique(shingles(hashed(words), SHINGLE)) % np.uint64(COUNTERS)).astype(np.int64), 1)
    return into


class Index:
    """Fingerprints of a block of benchmark items by length, and their weighted shingles.

    A shingle weighs 256 to 512 (1 to 2): rarer among the items, heavier; one that no item has weighs most. Two
    fingerprints within ``radius`` agree in one of eight 8-bit parts up to ``radius // 8`` bits, so a table that lists, for
    each part and value, the items that near finds all of them.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float, radius: int, counted: np.ndarray | None = None, n_items: int = 0):
        """``counted``: in how many of ``n_items`` items shingles occur, see ``count_shingles``; by default in these."""
        rows = [(i, hashed(w)) for i, w in ((i, plain_words(t)) for i, t in items) if w]
        self.threshold, self.radius = threshold, radius
        sets = [np.unique(shingles(h, SHINGLE)) for _, h in rows]
        self.known = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        if counted is None:
            counted, n_items = count_shingles(items), len(rows)
        counts = counted[(self.known % np.uint64(COUNTERS)).astype(np.int64)]
        self.weight = np.clip(np.round(256 * (1 + np.log((1 + n_items) / (1 + counts)) / max(math.log(1 + n_items), 1e-9))), 256, 512).astype(np.int64)
        self.seen = np.zeros(1 << 20, bool)  # by the low bits: most shingles of a text are told apart here
        self.seen[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        near = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None]) <= radius // BLOCKS
        self.groups, self.least_need = [], 1 << 30
        for length in sorted({len(h) for _, h in rows}):
            at = [k for k, (_, h) in enumerate(rows) if len(h) == length]
            prints = np.array([self.fingerprint(shingles(rows[k][1], SHINGLE)) for k in at], np.uint64)
            parts = (prints[:, None] >> np.arange(0, 64, BLOCK_BITS, dtype=np.uint64)).astype(np.uint8)
            tables = [near[:, parts[:, b]] for b in range(BLOCKS)]
            need = math.ceil(threshold * 0.5 * min(len(sets[k]) for k in at))
            self.least_need = min(self.least_need, need if length >= SHINGLE else 0)
            self.groups.append((length, need, [rows[k][0] for k in at], [sets[k] for k in at], prints, tables))

    def marks(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of shingles that an item has, and their weights."""
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64((1 << 20) - 1)).view(np.int64)])
        if not len(maybe):
            return maybe, maybe
        slot = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        same = self.known[slot] == hashes[maybe]
        return maybe[same], self.weight[slot[same]]

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), 512, np.int64)
        at, weight = self.marks(hashes)
        out[at] = weight
        return out

    def fingerprint(self, hashes: np.ndarray) -> np.uint64:
        return packed((sign_bits(hashes) * self.weights(hashes)[:, None]).sum(0)[None])[0]

    def similarity(self, item: np.ndarray, window: np.ndarray) -> float:
        """Weighted Jaccard of two sets of shingles."""
        window = np.unique(window)
        mine, theirs = self.weights(item).sum(), self.weights(window).sum()
        shared = self.weights(np.intersect1d(item, window, assume_unique=True)).sum()
        return float(shared / (mine + theirs - shared))

    def search(self, texts: pa.Array, at_once: int = 500_000) -> Iterator[list[tuple[int, int, int, float]]]:
        """``matches`` of each text. Words are hashed, and shingles that an item has are found, for many texts at once."""
        held, size = [], 0
        for k, text in enumerate(texts):
            held.append(plain(text.as_py()))
            size += len(held[-1])
            if size < at_once and k + 1 < len(texts):
                continue
            words, counts = word_hashes(np.frombuffer(b"".join(held), np.uint8), np.r_[0, np.cumsum([len(h) for h in held])])
            ends = np.cumsum(counts)
            at = self.marks(shingles(words, SHINGLE))[0]
            # a run may start in one text and end in the next: too many marks are counted, never too few
            marked = np.diff(np.searchsorted(at, np.r_[0, ends]))
            for n, end, m in zip(counts.tolist(), ends.tolist(), marked.tolist()):
                yield self.matches(words[end - n:end]) if n and (m >= self.least_need or n < SHINGLE) else []
            held, size = [], 0

    def matches(self, words: np.ndarray, at_once: int = 16_384) -> list[tuple[int, int, int, float]]:
        """``item, first word, words, similarity`` of the best window of each item that reaches the threshold.

        All item-sized windows are compared, but for those with too few shingles of any item to reach the threshold. A
        text shorter than the item is one window.
        """
        best: dict[int, tuple[float, int, int]] = {}
        hashes = shingles(words, SHINGLE)
        at, heavy = self.marks(hashes)
        short: dict[int, np.ndarray] = {}
        sums = own_print = None
        for length, need, names, sets, prints, tables in self.groups:
            if length > len(words):
                if len(words) < SHINGLE or len(at) < need:
                    continue
                own_print = self.fingerprint(hashes) if own_print is None else own_print
                for q in np.flatnonzero(np.bitwise_count(prints ^ own_print) <= self.radius).tolist():
                    value = self.similarity(sets[q], hashes)
                    if value >= self.threshold and value > best.get(names[q], (0,))[0]:
                        best[names[q]] = (value, 0, len(words))
                continue
            if length < SHINGLE:
                if len(words) == length:
                    own = hashes
                else:
                    own = short.setdefault(length, shingles(words, length))
                starts = np.flatnonzero(np.isin(own, np.concatenate(sets)))
                for s in starts.tolist():
                    for name, item in zip(names, sets):
                        if item[0] == own[s] and name not in best:
                            best[name] = (1.0, s, length)
                continue
            if sums is None:
                weight, marked = np.full(len(hashes), 512, np.int64), np.zeros(len(hashes), bool)
                weight[at], marked[at] = heavy, True
                count = np.r_[0, np.cumsum(marked)]
                sums = np.zeros((len(hashes) + 1, 64), np.int64)
                np.cumsum(sign_bits(hashes) * weight[:, None], axis=0, out=sums[1:])
            wide = length - SHINGLE + 1
            starts = np.flatnonzero(count[wide:] - count[:-wide] >= need)
            for lo in range(0, len(starts), at_once):
                s = starts[lo:lo + at_once]
                found = packed(sums[s + wide] - sums[s])
                near = np.zeros((len(s), len(names)), bool)
                for b in range(BLOCKS):
                    near |= tables[b][((found >> np.uint64(BLOCK_BITS * b)) & np.uint64(255)).astype(np.int64)]
                w, k = np.nonzero(near)
                close = np.bitwise_count(found[w] ^ prints[k]) <= self.radius
                for q in np.unique(k[close]).tolist():
                    # windows by the weight that they can share at most; the rest cannot beat what is found
                    own = np.r_[0, np.cumsum(np.where(marked & np.isin(hashes, sets[q]), weight, 0))]
                    p = s[w[close][k[close] == q]]
                    bound = (own[p + wide] - own[p]) / self.weights(sets[q]).sum()
                    order = np.argsort(-bound, kind="stable")
                    for p, most in zip(p[order].tolist(), bound[order].tolist()):
                        if most < self.threshold or (names[q] in best and most <= best[names[q]][0]) or best.get(names[q], (0,))[0] == 1.0:
                            break
                        value = self.similarity(sets[q], hashes[p:p + wide])
                        if value >= self.threshold and (names[q] not in best or value > best[names[q]][0]):
                            best[names[q]] = (value, p, length)
        return [(name, p, n, value) for name, (value, p, n) in sorted(best.items())]


def indexes(benchmark: DataFrame, item_col: str, text_col: str, threshold: float, radius: int, block_chars: int) -> Iterator:
    """Broadcast indexes of blocks of about ``block_chars`` characters; one of no items for an empty benchmark."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    block = lambda b: [(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()]
    counted, n_items = np.zeros(COUNTERS, np.int64), 0
    for b in range(blocks):
        part = block(b)
        counted, n_items = count_shingles(part, counted), n_items + sum(bool(plain_words(t)) for _, t in part)
    for b in range(blocks):
        yield benchmark.sparkSession.sparkContext.broadcast(Index(block(b), threshold, radius, counted, n_items))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", threshold: float = 0.75, radius: int = 23, block_chars: int = 8_000_000) -> DataFrame:
    """``id, item_id, first_word, n_words, similarity``: every document and benchmark item of which a window of the item's
    length has a weighted Jaccard similarity of ``threshold`` or more on 5-word shingles, with its best window. A document
    shorter than the item is compared whole.

    Words are free of ASCII punctuation and case. Items shorter than five words must occur whole. The benchmark is
    read in blocks of about ``block_chars`` characters, each block's index goes to all tasks and sees all texts; no
    text is shuffled. ``radius`` is over four standard deviations beyond the Hamming distance at the threshold.

    Null and empty texts and items match nothing; a null item id is reported as null; items with one id count as one;
    repeated rows each give their rows; an empty table on either side gives no row. Further columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    out = None
    for index in indexes(benchmark, item_col, item_text_col, threshold, radius, block_chars):

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, hits = [], []
                for n, got in enumerate(index.value.search(batch.column("text"))):
                    at += [n] * len(got)
                    hits += got
                columns = list(zip(*hits)) if hits else [[]] * 4
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                                 names=["doc", "item_id", "first_word", "n_words", "similarity"])

        found = rows.mapInArrow(search, f"doc {kind}, item_id long, first_word long, n_words long, similarity double")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("doc", id_col)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               threshold: float = 0.75, radius: int = 23, block_chars: int = 8_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, in which ``find_leaks`` finds nothing. Rows are filtered where they are read."""
    out = docs
    for index in indexes(benchmark, item_col, item_text_col, threshold, radius, block_chars):

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not got for got in index.value.search(batch.column(text_col))], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
