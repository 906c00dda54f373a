"""Token ids as binary files, each block of documents under a Re-Pair grammar of its own."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldspark.llm.common import running_sum
from fieldspark.session import scratch

END = 0  # id that closes a document
FIRST_RULE = 1 << 24  # symbols from here on are nonterminals; vocabularies are smaller
#: a blank between two characters that are not white space: a safe place to cut
_SAFE = re.compile(r"(?<=\S)(?= \S)")
FILE_SCHEMA = "part int, seq int, n_docs int, n_tokens long, docs binary, doc_tokens binary, doc_symbols binary, rules binary, lengths binary, symbols binary"


class OddPiece(Exception):
    """White space at an end of a piece: no safe place to cut."""


class Pieces(dict):
    """Ids, as bytes, of text after a single blank, in two generations of at most ``limit`` pieces.

    A full generation becomes the old one, and a piece met again moves from there to the young one. So what a language uses
    often is encoded once, however many rare pieces pass.

    ``each`` looks the distinct units of many texts up at once; ``encode`` takes one text.

    A byte-level pattern starts a token at a blank that stands alone between two other characters, at a newline that
    stands alone, at what follows it, and where ASCII punctuation follows a letter or digit. So lines, words and trailing
    punctuation are encoded once each. A word of Latin letters alone is one stretch of the pattern and goes to the
    library's BPE model directly; all else goes through its whole encoder. A text that holds an added token of the
    tokenizer anywhere, even over a border of pieces, is not cut at all.
    """

    def __init__(self, path: str, limit: int = 500_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.parts, self.old, self.old_parts = Tokenizer.from_file(path), limit, {}, {}, {}
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # fixed values: bytes that a byte-level vocabulary writes as themselves; the others follow from code point 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*plain}))}
        self.blank = chr(self.letters[32])
        self.ends = {sign: self.whole(sign) for sign in punctuation}
        # ids that stand only where a unit begins: no unit holds a blank or a newline but its first character
        leads = (self.blank, chr(self.letters[10]))
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.begins[[i for letters, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if letters.startswith(leads)]] = True
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core

    def whole(self, text: str) -> bytes:
        """Ids of any text by the library's encoder."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def fresh(self, text: str) -> bytes:
        """Ids of one stretch: a word, perhaps after a blank, punctuation or a newline."""
        word = text[1:] if text[0] == " " else text
        if word.isalpha():
            if word.isascii():  # these letters stand for themselves
                return self.word(self.blank + word if word is not text else word)
            if max(word) < "\u0250":
                return self.word(text.encode().decode("latin-1").translate(self.letters))
        return self.whole(text)

    def word(self, letters: str) -> bytes:
        """Ids of a word in the letters of the vocabulary."""
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def part(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            if len(self.parts) >= self.limit:
                self.parts, self.old_parts = {}, self.parts
            found = self.old_parts.get(text)
            if found is None:
                found = self.fresh(text)
            self.parts[text] = found
        return found

    def line(self, text: str) -> bytes:
        stem = text.rstrip(punctuation)
        if stem != text and stem and (stem[-1].isalpha() or stem[-1] in "0123456789"):
            return self.part(stem) + self.part(text[len(stem):])
        return self.part(text)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        found = self.old.get(piece)
        if found is not None:
            self[piece] = found
            return found
        if piece.isalpha() and piece.isascii():
            found = self[piece] = self.word(self.blank + piece)
            return found
        if piece[-1:] in self.ends and piece[:-1].isalpha():  # the usual end of a phrase
            found = self[piece] = self[piece[:-1]] + self.ends[piece[-1]]
            return found
        stem = piece.rstrip(punctuation)
        if stem.isalpha():
            found = self.fresh(" " + piece) if stem == piece else self[stem] + self.part(piece[len(stem):])
        elif not piece or piece.strip() != piece:
            raise OddPiece
        else:
            first, *rest = piece.split("\n")
            if all(r and r.strip() == r for r in (first, *rest)):
                found = (self[first] if rest else self.line(" " + first)) + b"".join(self.part("\n") + self.line(r) for r in rest)
            else:
                found = self.whole(" " + piece)
        self[piece] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, equal to the tokenizer's own."""
        if any(a in text for a in self.added):
            return np.frombuffer(self.whole(text), "<u4")
        head, *rest = text.split(" ")
        try:
            if head != head.strip() or not head:
                raise OddPiece
            first = self.part(head) if head.isalpha() else self.whole(head)
            return np.frombuffer(first + b"".join(map(self.__getitem__, rest)), "<u4")
        except OddPiece:
            return self.by_stretch(text)

    def by_stretch(self, text: str) -> np.ndarray:
        """Ids of a text with white space in odd places."""
        return np.frombuffer(b"".join(map(self.whole, _SAFE.split(text))), "<u4") if text else np.zeros(0, "<u4")

    def each(self, texts: Iterable[str], chars: int = 4_000_000) -> Iterator[np.ndarray]:
        """Ids of every text, in order; ``chars`` characters or one text are held at a time."""
        held, n = [], 0
        for text in texts:
            held.append(text)
            n += len(text)
            if n >= chars:
                yield from self.several(held)
                held, n = [], 0
        if held:
            yield from self.several(held)

    def several(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, each of their distinct units looked up once.

        A unit is a newline or the blank before it, which is left out, and what follows up to the next of these. A text
        starts as if after a newline, whose id is taken off again.
        """
        out = {k: np.frombuffer(self.whole(t), "<u4") for k, t in enumerate(texts) if any(a in t for a in self.added)}
        at = [k for k in range(len(texts)) if k not in out]
        if at:
            lines = pa.compute.replace_substring(pa.array([texts[k] for k in at], pa.large_string()), "\n", " \n")
            split = pa.compute.split_pattern(pa.compute.binary_join_element_wise(pa.scalar("\n", pa.large_string()), lines, pa.scalar("", pa.large_string())), " ")
            coded, firsts = split.flatten().dictionary_encode(), split.offsets.to_numpy()
            found = self.units(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            index = coded.indices.to_numpy()
            odd = np.fromiter((not f for f in found), bool, len(found))
            strange = np.logical_or.reduceat(odd[index], firsts[:-1] - firsts[0])
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            table, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
            count = sizes[index]
            ends = np.cumsum(count)
            place = np.repeat(starts[index] - ends + count, count)
            place += np.arange(len(place))
            ids, ends = table[place], np.append(0, ends)[firsts - firsts[0]].tolist()
            for k, a, b, other in zip(at, ends, ends[1:], strange.tolist()):
                out[k] = self.by_stretch(texts[k]) if other else ids[a + 1:b]
        return [out[k] for k in range(len(texts))]

    def units(self, names: list[str]) -> list[bytes]:
        """Ids of distinct units; none where white space does not stand alone, for there is no safe place to cut."""
        found = list(map(self.get, names))
        missing = [k for k, f in enumerate(found) if f is None]
        old, fresh = {}, []
        for k in missing:
            name = names[k]
            known = self.old.get(name)
            if known is not None:
                found[k] = old[name] = known
                continue
            body = name[1:] if name[:1] == "\n" else name
            if not body or body[0].isspace() or body[-1].isspace():
                found[k] = b""
            else:
                fresh.append(k)
        new = [names[k] for k in fresh]
        coded = self.alone(new)
        for k, ids in zip(fresh, coded):
            found[k] = ids
        if len(self) + len(old) + len(new) > self.limit:
            self.old = dict(self) | old
            self.clear()
        else:
            self.update(old)
        self.update(islice(zip(new, coded), self.limit))
        return found

    def alone(self, units: list[str], together: int = 300) -> list[bytes]:
        """Ids of units by the library's encoder, many in one text."""
        spaced = [u if u[0] == "\n" else " " + u for u in units]
        fast, parts = self.tokenizer.encode_batch_fast, []
        for k in range(0, len(spaced), together):  # one text a call: the library's own objects take far more room than ids
            parts += [np.array(e.ids, "<u4") for e in fast(["".join(spaced[k:k + together])], add_special_tokens=False)]
        ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        begins = np.flatnonzero(self.begins[ids])
        if len(begins) != len(units):  # another vocabulary may join a blank with what is before it
            return list(map(self.whole, spaced))
        raw, ends = ids.tobytes(), np.append(begins * 4, len(ids) * 4).tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """One table per worker process and vocabulary; it outlives a task."""
    return Pieces(path)


def widths(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many ids each symbol expands to."""
    out = np.ones(len(symbols), np.int64)
    high = np.flatnonzero(symbols >= FIRST_RULE)
    out[high] = lengths[symbols[high].astype(np.int64) - FIRST_RULE]
    return out


def re_pair(symbols: np.ndarray, rounds: int = 12, least: int = 4, top: int = 4096, bits: int = 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``symbols, rules, lengths`` of a block: Re-Pair in rounds.

    A round counts the adjacent pairs by a hash of ``bits`` bits, gives the first pair of each of the ``top`` fullest
    places a nonterminal, if it occurs ``least`` times at least, and replaces its occurrences, left to right where
    they overlap. No rule holds ``END``, so documents stay whole in ``symbols``. ``rules`` are pairs of symbols;
    ``lengths`` the number of ids that each expands to.
    """
    rules, size, n_rules = [], np.zeros(0, np.int64), 0
    symbols = symbols.astype(np.uint32)
    for _ in range(rounds):
        before = len(symbols)
        pair = symbols[:-1].astype(np.uint64)
        pair <<= np.uint64(32)
        pair |= symbols[1:]
        place = pair * np.uint64(0x9E3779B97F4A7C15)
        place >>= np.uint64(64 - bits)
        place = place.view(np.int64)
        end = np.flatnonzero(symbols == END)
        place[end[end < len(place)]] = place[end[end > 0] - 1] = 1 << bits  # pairs with END
        count = np.bincount(place, minlength=(1 << bits) + 1)[:-1]
        full = np.flatnonzero(count >= least)
        if len(full) > top:
            full = full[np.argsort(-count[full], kind="stable")[:top]]
        number = np.full((1 << bits) + 1, -1, np.int32)
        number[full] = np.arange(len(full))
        slot = number[place]
        near = np.flatnonzero(slot >= 0)
        slot, pair = slot[near], pair[near]
        key = np.zeros(len(full), np.uint64)
        key[slot[::-1]] = pair[::-1]  # the first pair seen at each place
        same = key[slot] == pair
        at, slot = near[same], slot[same]
        start = np.r_[True, np.diff(at) > 1][:len(at)]
        head = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - head) % 2 == 0  # every second one of a run of overlapping places
        at, slot = at[take], slot[take]
        often = np.bincount(slot, minlength=len(full)) >= least
        at, slot = at[often[slot]], slot[often[slot]]
        if not len(at):
            break
        new = np.stack([key[often] >> np.uint64(32), key[often] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        size = np.r_[size, widths(new[:, 0], size) + widths(new[:, 1], size)]
        symbols[at] = (FIRST_RULE + n_rules + (np.cumsum(often) - 1)[slot]).astype(np.uint32)
        stay = np.ones(before, bool)
        stay[at + 1] = False
        symbols = symbols[stay]
        rules.append(new)
        n_rules += len(new)
        if before - len(symbols) < 0.02 * before:
            break
    return symbols, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), size.astype(np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids of any stretch of a block's symbols. The rules are opened level by level, all at once; the stored lengths say
    where each part goes. Then every symbol takes its stretch of ids."""
    size = lengths.astype(np.int64)
    starts = np.cumsum(size) - size
    table = np.zeros(int(size.sum()), np.uint32)
    part, place = np.arange(len(rules)) + FIRST_RULE, starts
    while len(part):
        high = part >= FIRST_RULE
        table[place[~high]] = part[~high]
        part, place = part[high], place[high]
        left, right = rules[part - FIRST_RULE].astype(np.int64).T if len(part) else (part, part)
        part, place = np.concatenate([left, right]), np.concatenate([place, place + widths(left, lengths)])
    high = symbols >= FIRST_RULE
    rule = symbols[high].astype(np.int64) - FIRST_RULE
    count, first = np.ones(len(symbols), np.int64), np.empty(len(symbols), np.int64)
    count[high], first[high] = size[rule], starts[rule]
    first[~high] = len(table) + np.arange(len(symbols) - len(rule))
    ends = np.cumsum(count)
    at = np.repeat(first - ends + count, count)
    at += np.arange(len(at))
    return np.concatenate([table, symbols[~high].astype(np.uint32)])[at]


def _packed(part: int, seq: int, ids: list[np.ndarray], docs: list[int]) -> dict:
    """One row of the file format; ``ids`` holds each document's ids and then its end id."""
    symbols, rules, lengths = re_pair(np.concatenate(ids))
    # END may also be an ordinary id, so documents are found by their token counts
    counts = np.array([len(x) + 1 for x in ids[::2]], np.int64)
    size = widths(symbols, lengths)
    starts = np.searchsorted(np.cumsum(size), np.cumsum(counts) - counts, side="right")
    zipped = lambda a: zlib.compress(np.ascontiguousarray(a).tobytes(), 1)
    return {"part": part, "seq": seq, "n_docs": len(docs), "n_tokens": int(counts.sum()), "docs": zipped(np.array(docs, "<i8")),
            "doc_tokens": zipped(counts.astype("<i8")), "doc_symbols": zipped(starts.astype("<i8")), "rules": zipped(rules.astype("<u4")),
            "lengths": zipped(lengths.astype("<u4")), "symbols": zipped(symbols.astype("<u4"))}


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 block_tokens: int = 1_000_000) -> None:
    """Write the ids of every text in ascending id order to Parquet files below ``path``.

    Documents are dealt by range of id and sorted there; a block closes at the first document that brings it to
    ``block_tokens`` ids. A row holds a block: document ids, token counts, place of each document's first symbol,
    grammar rules, expansion lengths and symbols, each as zlib-packed little-endian integers. Files are written by
    Spark's committer, so a lost task leaves no half block.

    A null text counts as empty and has the end id alone. Repeated ids stay, in the order of their texts. Rows
    with a null id come first and are stored under -2**63. An empty table writes no block.
    """
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "doc").sortWithinPartitions("doc", "text")
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64())] + [(c, pa.binary()) for c in ("docs", "doc_tokens", "doc_symbols", "rules", "lengths", "symbols")])

    closing = np.array([END], "<u4")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, seq = pieces_of(vocabulary), TaskContext.get().partitionId(), 0
        ids, names, held = [], [], 0
        for batch in batches:
            for name, got in zip(batch.column("doc").to_pylist(), pieces.each(text.as_py() for text in batch.column("text"))):
                ids += [got, closing]
                names.append(name)
                held += len(got) + 1
                if held >= block_tokens:
                    yield pa.RecordBatch.from_pylist([_packed(part, seq, ids, names)], schema)
                    ids, names, held, seq = [], [], 0, seq + 1
        if ids:
            yield pa.RecordBatch.from_pylist([_packed(part, seq, ids, names)], schema)

    rows.mapInArrow(pack, FILE_SCHEMA).write.mode("error").parquet(path)


def _numbers(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def read_document(row: dict, number: int) -> np.ndarray:
    """Ids of one document of a block, without expanding the others."""
    starts, symbols = _numbers(row["doc_symbols"], "<i8"), _numbers(row["symbols"], "<u4")
    stop = starts[number + 1] if number + 1 < len(starts) else len(symbols)
    return expand(symbols[starts[number]:stop], _numbers(row["rules"], "<u4").reshape(-1, 2), _numbers(row["lengths"], "<u4"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, n_symbols`` of every document of the files, and its ``ids`` if asked for.

    ``start`` counts the ids of all documents before it; ``n_tokens`` includes the end id.
    """
    stored = spark.read.schema(FILE_SCHEMA).parquet(path)
    fields = [("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_symbols", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)
    wanted = ("part", "seq", "docs", "doc_tokens", "doc_symbols", "rules", "lengths", "symbols")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in wanted}
                docs, counts, starts = (_numbers(row[c], "<i8") for c in ("docs", "doc_tokens", "doc_symbols"))
                symbols = _numbers(row["symbols"], "<u4")
                ids = expand(symbols, _numbers(row["rules"], "<u4").reshape(-1, 2), _numbers(row["lengths"], "<u4")).astype("<u4")
                inside = np.cumsum(counts) - counts
                spans = list(zip(inside.tolist(), (inside + counts).tolist()))
                raw = memoryview(ids.tobytes())
                crc = np.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in spans], np.int64)
                columns = [np.full(len(docs), row["part"]), np.full(len(docs), row["seq"]), docs, inside, counts, crc, np.diff(np.append(starts, len(symbols)))]
                if with_ids:
                    columns.append([ids[a:b].tolist() for a, b in spans])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    kinds = "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long, n_symbols long" + ", ids array<long>" * with_ids
    heads = running_sum(stored.select("part", "seq", "n_tokens"), [], "part", ["seq"], "n_tokens", "_ahead").select("part", "seq", "_ahead")
    return (stored.select(*wanted).mapInArrow(unpack, kinds).join(heads, ["part", "seq"])
            .select("doc_id", (F.col("_ahead") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "n_symbols", *["ids"] * with_ids))


def token_files(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write the files to the shared folder and read them back: see ``write_tokens`` and ``read_tokens``."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, id_col, text_col, **options)
    return read_tokens(docs.sparkSession, path)
