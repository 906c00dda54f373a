"""N-gram Jaccard join: size-banded tiles, hashed bitmaps that bound the overlap, exact intersection of sorted arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldspark.llm.common import mixed, shingles, text_chunks, word_hashes
from fieldspark.operators.components import connected_components
from fieldspark.session import cut, join_salted, tidy

SHINGLE = 5
PERCENT = 75  # two sets link when 100 * intersection >= PERCENT * union
HOT_LISTED = 1 << 16  # entries of the list of frequent shingles; it orders shingles, results do not depend on it
HOT_LOCAL = 8  # texts of one stretch that must share a shingle to put it forward
STRETCH = 2_000_000  # shingles counted together
GROUP = 2_000  # texts of one shingle in one task; more are dealt to several
TILE = 1_024  # texts of a block
TILE_SHINGLES = 1 << 19  # shingles of a block
KEYS_SHOWN = 8  # keys of a text that travel with it, so that a pair of several tiles is put out by one
BLOOM_BITS = 1 << 24  # in 64-bit words of a broadcast table: 2**18 rows at most


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]][:len(values)]]


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for raw, offsets in text_chunks(texts):
        words, counts = word_hashes(raw, offsets)
        runs = shingles(words, SHINGLE) if len(words) >= SHINGLE else words
        for n, end in zip(counts.tolist(), np.cumsum(counts).tolist()):
            yield distinct(runs[end - n:end - SHINGLE + 1]) if n >= SHINGLE else shingles(words[end - n:end], SHINGLE)


def prints(found: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a set."""
    return tuple(int(np.bitwise_xor.reduce(mixed(found + np.uint64(k)))) if len(found) else 0 for k in (1, 2))


def bitmap(found: np.ndarray) -> bytes:
    """One bit per shingle at a hashed place; as many places as shingles or up to twice that, a power of two from 64."""
    width = max(64, 1 << max(len(found) - 1, 0).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(mixed(found ^ np.uint64(0x5BF03635)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(raw: bytes, width: int) -> np.ndarray:
    """A bitmap brought down to ``width`` bytes: places that fall together are or-ed."""
    whole = np.frombuffer(raw, np.uint8)
    return np.bitwise_or.reduce(whole.reshape(-1, width), axis=0)


def may_link(size_a, size_b, apart) -> np.ndarray:
    """Whether sets of these sizes, whose bitmaps differ in ``apart`` places, can link. Every differing place is a shingle
    that only one of them has, so the overlap is at most half of what is left."""
    overlap = np.minimum((size_a + size_b - apart) // 2, np.minimum(size_a, size_b))
    return 100 * overlap >= PERCENT * (size_a + size_b - overlap)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))


def describe(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc, n, fp1, fp2, bits`` per text, and ``token, texts`` for shingles that many texts of a stretch share."""
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bits", pa.binary()), ("hot", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64()))])

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(held)
        held.clear()
        tokens.sort()
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        counts = np.diff(np.r_[first, len(tokens)])
        keep = counts >= HOT_LOCAL
        row = {"doc": None, "n": None, "fp1": None, "fp2": None, "bits": None, "hot": tokens[first[keep]].view(np.int64).tolist(), "texts": counts[keep].tolist()}
        return pa.RecordBatch.from_pylist([row], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0
        for batch in batches:
            out = []
            for found in sets_of(batch.column("text")):
                one, two = prints(found)
                out.append((len(found), one, two, bitmap(found)))
                if (one, two) not in seen:
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add((one, two))
                    held.append(found)
                    size += len(found)
                    if size >= STRETCH:
                        yield frequent(held)
                        size = 0
            n, one, two, bits = zip(*out) if out else ([],) * 4
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            none = pa.nulls(len(out), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), signed(one), signed(two), pa.array(bits, pa.binary()), none, none], schema=schema)
        if held:
            yield frequent(held)

    made = cut(rows.mapInArrow(run, "doc long, n long, fp1 long, fp2 long, bits binary, hot array<long>, texts array<long>"))
    hot = made.where("hot IS NOT NULL").select(F.explode(F.arrays_zip("hot", "texts")).alias("_h")).groupBy(F.col("_h.hot").alias("token")).agg(F.sum("_h.texts").alias("texts"))
    return made.where("hot IS NULL").drop("hot", "texts"), hot


def prefixes(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``key, token, doc``: the first shingles of each text's set, rare ones first. Sets that link share one of them.

    A set of n shingles links only with sets that share ``ceil(0.75 n)`` of them, so two that link share one of each
    one's first ``n - ceil(0.75 n) + 1``, in any order that all texts have in common. A frequent shingle's texts are
    dealt to several keys; ``token`` is null for other shingles. Of equal sets in a task only the first is put out.
    """
    listed = hot.orderBy(F.desc("texts"), "token").limit(HOT_LISTED).collect()  # bounded by HOT_LISTED
    order = np.argsort(np.array([r["token"] for r in listed], np.int64).view(np.uint64))
    tokens = np.array([r["token"] for r in listed], np.int64).view(np.uint64)[order]
    ranks = (len(listed) - np.arange(len(listed), dtype=np.uint64))[order] if listed else np.zeros(0, np.uint64)
    deals = np.array([-(-r["texts"] // GROUP) for r in listed], np.int64)[order] if listed else np.zeros(0, np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((tokens, ranks, deals))
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks, deals = shared.value
        seen = set()
        for batch in batches:
            docs, keys, names = [], [], []
            for doc, found in zip(batch.column("doc").to_pylist(), sets_of(batch.column("text"))):
                if not len(found):
                    continue
                mark = prints(found)
                if mark in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(mark)
                take = len(found) - -(-PERCENT * len(found) // 100) + 1
                rank, deal = np.zeros(len(found), np.uint64), np.ones(len(found), np.int64)
                if len(tokens):
                    slot = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
                    same = tokens[slot] == found
                    rank[same], deal[same] = ranks[slot[same]], deals[slot[same]]
                first = np.argsort(rank, kind="stable")[:take]
                chosen, many = found[first], deal[first] > 1
                key = chosen.copy()
                key[many] = mixed(chosen[many] + mixed(np.array([doc], np.int64).view(np.uint64))[0] % deal[first][many].astype(np.uint64))
                docs.append(doc)
                keys.append(key.view(np.int64))
                names.append(pa.array(chosen.view(np.int64), mask=~many))
            lengths = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            flat = pa.array(np.concatenate(keys)) if keys else pa.array([], pa.int64())
            named = pa.concat_arrays(names) if names else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(lengths, flat), pa.ListArray.from_arrays(lengths, named)],
                                             schema=pa.schema([("doc", pa.int64()), ("key", longs), ("token", longs)]))

    made = rows.mapInArrow(run, "doc long, key array<long>, token array<long>")
    return made.select("doc", F.explode(F.arrays_zip("key", "token")).alias("_p")).select("doc", F.col("_p.key").alias("key"), F.col("_p.token").alias("token"))


def wanted_sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc, found``: shingle sets of the texts whose id is in ``ids`` (column ``doc``). A Bloom filter of at most
    ``BLOOM_BITS`` bits, as a broadcast table of words, keeps other texts back, so that no text is shuffled and few are cut
    into words; the join that follows takes out its false hits."""
    place = F.pmod(F.xxhash64("doc"), F.lit(BLOOM_BITS))
    word, bit = F.floor(place / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    bits = ids.select(word.alias("_w"), bit.alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_bits"))
    hits = rows.withColumn("_w", word).join(F.broadcast(bits), "_w").where(F.col("_bits").bitwiseAND(bit) != 0).select("doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in sets_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found, pa.binary())], names=["doc", "found"])

    return hits.mapInArrow(run, "doc long, found binary")


def bounded(edges: DataFrame, described: DataFrame) -> DataFrame:
    """Edges ``u, v`` whose sizes and bitmaps allow a link."""
    side = lambda c: described.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}"))
    near = edges.join(side("u"), "u").join(side("v"), "v").where(100 * F.least("nu", "nv") >= PERCENT * F.greatest("nu", "nv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for nu, nv, bu, bv in zip(*(batch.column(c).to_pylist() for c in ("nu", "nv", "bu", "bv"))):
                width = min(len(bu), len(bv))
                keep.append(bool(may_link(nu, nv, int(np.bitwise_count(folded(bu, width) ^ folded(bv, width)).sum()))))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return near.select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(run, "u long, v long")


def verified(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges ``u, v`` whose sets link, by exact intersection. Each set travels once per partner hub; a hub of many edges
    is dealt to several places, with its set in each."""
    edges = cut(edges)
    tidy(rows.sparkSession)
    hubs = edges.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("_deals"))
    members = edges.join(hubs, "u").select(F.col("v").alias("doc"), "u", F.pmod(F.xxhash64("v"), F.col("_deals")).cast("int").alias("_deal"), F.lit(1).alias("_part"))
    heads = hubs.select(F.col("u").alias("doc"), "u", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1)).alias("_deal"), F.lit(0).alias("_part"))
    members = members.unionByName(heads)
    placed = (wanted_sets(rows, members.select("doc").distinct()).join(members, "doc")
              .repartition("u", "_deal").sortWithinPartitions("u", "_deal", "_part").select("u", "_deal", "_part", "doc", "found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, []
        for batch in batches:
            out = []
            for u, deal, part, doc, found in zip(*(batch.column(c).to_pylist() for c in ("u", "_deal", "_part", "doc", "found"))):
                here = np.frombuffer(found, np.uint64)
                if part == 0:
                    own = [*own, here] if (u, deal) == hub else [here]
                    hub = u, deal
                elif any(linked(head, here) for head in own):
                    out.append((u, doc))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return cut(placed.mapInArrow(run, "u long, v long"))


def tile_pairs(tiles: DataFrame) -> DataFrame:
    """Pairs ``u, v`` of texts of one tile that are not in one group (``label``) and whose bitmaps allow a link.

    Look-alikes meet in the tile of every shingle that they share. ``first`` holds the smallest keys of a text; a tile leaves
    a pair that has a smaller key in common to that key's tile, which holds both as well.
    """
    keys = ["key", "tile", "i", "j"]
    dealt = tiles.repartition(*keys).sortWithinPartitions(*keys, "rep")

    def pairs(group: list[tuple]) -> list[tuple[int, int]]:
        rep, label, n, band, block, tile, i, j, bits, first, key = zip(*group)
        if len(set(label)) < 2:
            return []
        label, n, band, block = (np.array(x, np.int64) for x in (label, n, band, block))
        width = min(map(len, bits))
        grid = np.stack([folded(b, width) for b in bits])
        grid = grid.view(np.uint64) if width % 8 == 0 else grid
        before = [{k for k in ks if k < key[0]} for ks in first]
        out = []
        for a in range(len(rep) - 1):
            b = np.arange(a + 1, len(rep))
            # a pair of one band belongs to that band's tile alone, a pair of blocks to their tile alone
            ok = (label[b] != label[a]) & ((band[b] == tile[0]) | (band[a] == tile[0])) & (100 * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b]))
            ok &= (np.minimum(block[a], block[b]) == i[0]) & (np.maximum(block[a], block[b]) == j[0])
            b = b[ok]
            apart = np.bitwise_count(grid[b] ^ grid[a]).sum(1, dtype=np.int64)
            out += [(rep[a], rep[k]) for k in b[may_link(n[a], n[b], apart)].tolist() if before[a].isdisjoint(before[k])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*keys, "rep", "label", "n", "band", "block", "bits", "first"))):
                if row[:4] != at:
                    out += pairs(group) if group else []
                    group, at = [], row[:4]
                group.append((*row[4:9], row[1], row[2], row[3], row[9], row[10], row[0]))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["u", "v"])
        if group:
            out = pairs(group)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def groups_of(edges: DataFrame) -> DataFrame:
    """``rep, group`` of the components of an edge table ``u, v``."""
    return connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("group"))


def links_within(groups: DataFrame, label: DataFrame, of_rep: DataFrame, rows: DataFrame) -> DataFrame:
    """Links ``u, v`` between components of one group of look-alikes, by exact intersection.

    A group is cut in blocks of bounded size, and its sets meet block by block; a tile returns no more links than it has texts,
    as what is joined already is not compared. Groups that are one component need nothing.
    """
    named = groups.join(label, "rep", "left").select("rep", "group", F.coalesce("label", "rep").alias("label"))
    sizes = (named.join(of_rep.select("rep", "n"), "rep").groupBy("group")
             .agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_SHINGLES)).cast("int").alias("blocks"), F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi"))
    members = cut(named.join(sizes.select("group", "blocks"), "group").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
                  .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                  .select(F.col("rep").alias("doc"), "group", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "label", "block"))
    keys = ["group", "i", "j"]
    dealt = (wanted_sets(rows, members.select("doc").distinct()).join(members, "doc").repartition(*keys).sortWithinPartitions(*keys, "doc")
             .select(*keys, "doc", "label", "block", "found"))

    def tile(group: list[tuple], i: int, j: int) -> list[tuple[int, int]]:
        doc, label, block, found = zip(*group)
        block, size = np.array(block), np.array([len(f) for f in found])
        root = np.unique(np.array(label, np.int64), return_inverse=True)[1]
        start = np.cumsum(size) - size
        names, flat = np.unique(np.concatenate(found), return_inverse=True)
        mark, out = np.zeros(len(names), np.int32), []
        for a in range(len(doc)):
            other = (root != root[a]) & (np.minimum(block, block[a]) == i) & (np.maximum(block, block[a]) == j)
            if not other.any():
                continue
            own = flat[start[a]:start[a] + size[a]]
            mark[own] = 1
            both = np.add.reduceat(mark[flat], start)
            mark[own] = 0
            for b in np.flatnonzero(other & (100 * both >= PERCENT * (size + size[a] - both))).tolist():
                if root[b] != root[a]:
                    out.append((doc[a], doc[b]))
                    root[root == root[b]] = root[a]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], None
        ended = lambda out: pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["u", "v"])
        for batch in batches:
            out = []
            for g, i, j, doc, label, block, found in zip(*(batch.column(c).to_pylist() for c in (*keys, "doc", "label", "block", "found"))):
                if (g, i, j) != at:
                    out += tile(group, *at[1:]) if group else []
                    group, at = [], (g, i, j)
                group.append((doc, label, block, np.frombuffer(found, np.uint64)))
            yield ended(out)
        if group:
            yield ended(tile(group, *at[1:]))

    return cut(dealt.mapInArrow(run, "u long, v long"))


def band_of(n: Column) -> Column:
    """Sizes of sets that link lie in one band or in neighbouring ones."""
    return F.floor(F.log(n) / math.log(100 / PERCENT) + 1e-9).cast("int")


def components(rows: DataFrame, described: DataFrame, hot: DataFrame) -> DataFrame:
    """``doc, component_id`` of the texts that have words; an id has one text, on however many rows.

    1. Equal sets fold into the smallest id (``rep``).
    2. Each text sends the rare quarter of its shingles. Texts that share one are tied to the smallest of them, one edge a text
       and hub, and the edges are checked: bitmaps first, then exact intersection. That joins most copies in linear work.
    3. Texts that bitmaps could not tell apart form groups. Within a group sets are intersected exactly, in blocks of bounded
       size, where components still differ.
    4. Shingles whose texts are in different groups form tiles by size band, in blocks of bounded size. Within a tile bitmaps
       are compared, between groups only; what they allow is checked exactly. So no link between components is lost, and no
       copies are paired within one.
    """
    sized = described.where("n > 0 AND doc IS NOT NULL")
    firsts = sized.groupBy("fp1", "fp2").agg(F.min("doc").alias("rep"))
    # a third of all texts may be equal: the smallest id of a set reaches its copies by salt
    of_doc = cut(join_salted(sized.select("doc", "fp1", "fp2"), firsts, ["fp1", "fp2"], ["doc"], 4, "inner").select("doc", "rep").distinct())
    of_rep = cut(sized.join(firsts.select("rep"), F.col("doc") == F.col("rep")).select("rep", "n", "bits").dropDuplicates(["rep"]))

    # texts that share a key: those of a dealt shingle meet through the smallest texts of its keys
    shared = W.partitionBy("key")
    posted = prefixes(rows.where(F.col("doc").isNotNull()), hot)
    met = posted.withColumn("low", F.min("doc").over(shared)).withColumn("high", F.max("doc").over(shared))
    met = cut(met.where("low < high OR token IS NOT NULL").select("key", "token", "doc", "low"))
    tidy(rows.sparkSession)
    across = met.where("token IS NOT NULL").groupBy("token", "low").agg(F.lit(1).alias("_")).drop("_")
    across = across.join(across.groupBy("token").agg(F.min("low").alias("hub")), "token").select(F.col("hub").alias("a"), F.col("low").alias("b"))
    star = met.select(F.col("low").alias("a"), F.col("doc").alias("b")).unionByName(across).where("a <> b").distinct()
    rep = lambda c, to: of_doc.select(F.col("doc").alias(c), F.col("rep").alias(to))
    star = (star.join(rep("a", "ra"), "a").join(rep("b", "rb"), "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("u"), F.greatest("ra", "rb").alias("v")).distinct())
    alike = cut(bounded(star, of_rep))
    links = verified(alike, rows)
    label = groups_of(links).withColumnRenamed("group", "label")
    # texts that bitmaps cannot tell apart form groups; within one, sets are compared exactly where components differ
    group = groups_of(alike)
    links = links.unionByName(links_within(group, label, of_rep, rows))
    label = groups_of(links).withColumnRenamed("group", "label")

    # groups that share a shingle, by whole shingles again; of two texts alone the star has checked the one pair
    apart = cut(met.select(F.coalesce("token", "key").alias("key"), "doc").join(of_doc, "doc").join(group, "rep", "left")
                .select("key", "rep", F.coalesce("group", "rep").alias("label")).distinct())
    del posted, met, across, star  # what a name still holds is not deleted
    tidy(rows.sparkSession)
    open_keys = apart.groupBy("key").agg(F.count(F.lit(1)).alias("_c"), F.min("label").alias("_lo"), F.max("label").alias("_hi"),
                                         *[F.bit_xor(F.xxhash64(F.lit(k), "rep")).alias(f"_x{k}") for k in (1, 2)]).where("_c > 2 AND _lo < _hi")
    # of shingles with the same texts one is enough
    open_keys = open_keys.groupBy("_c", "_x1", "_x2").agg(F.min("key").alias("key")).select("key")
    apart = cut(apart.join(open_keys, "key"))
    del open_keys
    tidy(rows.sparkSession)
    shown = apart.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("key")), 1, KEYS_SHOWN).alias("first"))
    tiles = apart.join(of_rep.select("rep", "n"), "rep").withColumn("band", band_of(F.col("n")))
    tiles = tiles.withColumn("tile", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    sizes = (tiles.groupBy("key", "tile").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"), F.min("label").alias("_lo"), F.max("label").alias("_hi"),
                                              F.max(F.col("band") == F.col("tile")).alias("_own")).where("_lo < _hi AND _own").select("key", "tile", "blocks"))
    tiles = (tiles.join(sizes, ["key", "tile"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
             .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", "tile", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "rep", "label", "n", "band", "block")
             .join(of_rep.select("rep", "bits").join(shown, "rep"), "rep"))
    more = verified(tile_pairs(tiles), rows)
    named = lambda c, to: label.select(F.col("rep").alias(c), F.col("label").alias(to))
    bridges = (more.join(named("u", "lu"), "u", "left").join(named("v", "lv"), "v", "left")
               .select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v")).where("u <> v"))
    joined = connected_components(bridges).select(F.col("node").alias("label"), F.col("component").alias("last"))
    return (of_doc.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep")).join(joined, "label", "left")
             .select("doc", F.coalesce("last", "label").alias("component_id")))


def own_names(rows: DataFrame, described: DataFrame) -> DataFrame | None:
    """``doc, t1, t2, name``: a number of its own, above all ids, for each text of an id that has several; None without such ids."""
    several = cut(described.where("n > 0 AND doc IS NOT NULL").groupBy("doc").agg(F.min(F.struct("fp1", "fp2")).alias("_a"), F.max(F.struct("fp1", "fp2")).alias("_b")).where("_a < _b").select("doc"))
    if several.isEmpty():
        return None
    top = rows.agg(F.max("doc")).first()[0]
    texts = cut(rows.join(several, "doc").select("doc", *_mark()).distinct().withColumn("name", F.monotonically_increasing_id()))
    low = rows.agg(F.min("doc")).first()[0] if top > 1 << 62 else None
    return texts.withColumn("name", F.lit(top + 1) + F.col("name") if low is None else F.lit(low - 1) - F.col("name"))


def _mark() -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2")]


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: texts whose sets of 5-word shingles have a Jaccard similarity of
    0.75 or more are linked, and a component is named by its smallest id. See ``components``.

    A null or empty text, or one without words, has size 0 and is a component of its own. Fewer than five words form one
    shingle. Rows of one id are linked with all that any of them links with: where an id has several texts, each is compared
    under a name of its own, and the names are tied afterwards. All rows are returned, with sizes of their own. A null id has
    a null component. An empty table gives an empty result. Further columns are not read.
    """
    rows = _rows(docs, id_col, text_col)
    described, hot = describe(rows)
    names = own_names(rows, described)
    if names is None:
        final = components(rows, described, hot)
    else:
        renamed = (rows.select("doc", "text", *_mark()).join(names, ["doc", "t1", "t2"], "left")
                   .select(F.coalesce("name", "doc").alias("doc"), "text"))
        found = cut(components(renamed, *describe(renamed)).withColumnRenamed("component_id", "label").withColumnRenamed("doc", "name"))
        found = cut(found.join(names.select("name", "doc"), "name", "left").select(F.coalesce("doc", "name").alias("doc"), "label").distinct())
        ties = found.join(found.groupBy("doc").agg(F.min("label").alias("_l")), "doc").select(F.col("_l").alias("u"), F.col("label").alias("v"))
        tied = connected_components(ties).select(F.col("node").alias("label"), F.col("component").alias("_c"))
        found = found.join(tied, "label", "left").select("doc", F.coalesce("_c", "label").alias("_c"))
        least = found.groupBy("_c").agg(F.min("doc").alias("component_id"))
        final = found.join(least, "_c").select("doc", "component_id").distinct()
    return (described.select("doc", "n").join(final, "doc", "left")
            .select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id")))
