"""Operators over whole tables, against brute force; the pipeline; the registered queries."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fieldspark.llm import decontamination, mixing, ngram_join, quality, queries
from fieldspark.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, _w string, n long"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# --- n-gram Jaccard join


def shingle_set(text):
    words = (text or "").encode().lower().split() if (text or "").isascii() else [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for w in text.encode().split()]
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    """``id: (size, component)`` by comparing every pair that shares a shingle."""
    sets, home = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}
    def top(i):
        while home[i] != i:
            i = home[i]
        return i
    posts = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            posts[g].append(i)
    shared = Counter((a, b) for p in posts.values() for k, a in enumerate(sorted(p)) for b in sorted(p)[k + 1:])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((top(a), top(b)))
            home[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_ids_of_several_texts_lose_no_link(spark, seed):
    """Each text of an id is compared by itself; its id ties them."""
    rng = random.Random(seed)
    text = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    a, b = text(60), text(60)
    rows = [(0, b), (1, a), (1, b), (5, a + " more")]
    if seed:
        base = [text(rng.choice([4, 40, 120])) for _ in range(8)]
        for k in range(60):
            words = rng.choice(base).split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = "changed"
            rows.append((rng.randrange(10, 40), " ".join(words)))
        rows += [(7, None), (7, ""), (7, base[0]), rows[9], (2**62 + 5, base[1])]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.ngram_jaccard_join(docs_of(spark, [(i, t, None, None, None) for i, t in rows])).collect()}
    home = {}
    def top(x):
        while home.setdefault(x, x) != x:
            x = home[x]
        return x
    sets = [(i, shingle_set(t)) for i, t in rows]
    for i, s in sets:
        for j, t in sets:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((top(i), top(j)))
                home[y] = x
    assert got == {(i, len(s)): top(i) for i, s in sets}


def near_copies(rng, groups=12, each=9):
    vocab, rows = [f"w{k}" for k in range(3000)], []
    passage = [rng.choice(vocab) for _ in range(60)]
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 12, 40, 150, 400]))]
        for _ in range(each):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, len(words) // 40, len(words) // 15])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            if rng.random() < 0.4:
                words += passage
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return [(k * 3, t.upper() if k % 5 == 0 else t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("small", [False, True])
def test_components_equal_brute_force(spark, monkeypatch, small):
    if small:  # every group is dealt to several keys, blocks and hubs
        for name, value in (("GROUP", 3), ("TILE", 4), ("HOT_LOCAL", 2), ("STRETCH", 5_000)):
            monkeypatch.setattr(ngram_join, name, value)
    rows = near_copies(random.Random(11 + small))
    got = ngram_join.ngram_jaccard_join(docs_of(spark, [(i, t, None, "x", 1) for i, t in rows])).collect()
    want = components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) < len(rows) * 0.8


def test_join_of_odd_rows(spark):
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "a b"), (8, "A  B"), (7, "a b c"), (2, "one two three four five six"), (2, "one two three four five six"), (None, "a b"),
            (1, "x " * 30_000), (6, "x x x x x"), (10, "q1 q2 q3 q4 q5"), (12, "r1 r2 r3 r4 r5"), (11, "q1 q2 q3 q4 q5"), (11, "r1 r2 r3 r4 r5")]
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(docs_of(spark, [(i, t, None, "x", 1) for i, t in rows])).collect())))
    assert got == sorted(map(str, [(5, 0, 5), (4, 0, 4), (3, 0, 3), (9, 1, 8), (8, 1, 8), (7, 1, 7), (2, 2, 2), (2, 2, 2), (None, 1, None), (1, 1, 1), (6, 1, 1), (10, 1, 10), (12, 1, 10), (11, 1, 10), (11, 1, 10)]))
    assert ngram_join.ngram_jaccard_join(docs_of(spark, [])).count() == 0


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(12)
    for _ in range(300):
        n, m = rng.integers(1, 400), rng.integers(0, 80)
        a = np.unique(rng.integers(0, 1 << 63, n + m, np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, rng.integers(0, 60), np.uint64)])
        if len(b) and ngram_join.linked(a, b):
            x, y = ngram_join.bitmap(a), ngram_join.bitmap(b)
            w = min(len(x), len(y))
            apart = int(np.bitwise_count(ngram_join.folded(x, w) ^ ngram_join.folded(y, w)).sum())
            assert ngram_join.may_link(len(a), len(b), apart)


# --- mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: float(k % 3 + 1) for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in over}


def test_mix(spark):
    rng, rows = random.Random(13), []
    for source, n in (("b", 300), ("a", 20), (None, 60), ("é", 3), ("Z", 100), ("empty", 2)):
        rows += [(len(rows) + k, None if source == "empty" else " ".join(["w"] * rng.randint(0, 400)) + " \n", source, "x", 1) for k in range(n)]
    rows += [(90_001, " long " * 20_000, "b", "x", 1), (None, "no id", "a", "x", 1), (90_002, "twice here", "Z", "x", 1), (90_002, "twice here", "Z", "x", 1)]
    docs = docs_of(spark, rows)
    got = mixing.mix_sources(docs, block=16).collect()
    size = defaultdict(int)
    for _, t, s, *_ in rows:
        size[s] += len((t or "").split())
    want, names = plain_targets(size), sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        s = names[r["source_no"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 64), s
    again = mixing.mix_sources(docs.repartition(5), block=16).collect()
    key = lambda x: sorted(map(str, ((r["doc_id"], r["size"], r["taken"]) for r in x)))
    assert key(got) == key(again)
    mixed = mixing.mixed_documents(docs, chars_col="n", block=16)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.select("doc_id", "text").where("doc_id < 90000").collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == Counter({r["doc_id"]: r["taken"] for r in got if r["doc_id"] is not None and r["doc_id"] < 90_000 and r["taken"]})
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0), chars_col="n").count() == 0


def test_golden_slots_are_even(spark):
    targets = spark.createDataFrame([(0, 64_000, 10_000.0), (1, 64_000, 20_000.0), (2, 64_000, 34_000.0)], "no long, source_size long, target double")
    slots = mixing.schedule(targets, 64).orderBy("slot").toPandas()
    assert len(slots) == 1000 and slots["slot"].is_unique
    for no, share in ((0, 10 / 64), (1, 20 / 64), (2, 34 / 64)):
        seen = np.cumsum(slots["no"] == no)
        assert np.abs(seen - share * np.arange(1, 1001)).max() < 6  # near the share in every prefix
        mine = slots[slots["no"] == no]
        assert (mine["rank"].to_numpy() == np.arange(len(mine))).all() and (mine["block"] == mine["rank"] % 1000).all()


# --- pipeline and queries


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    at = {r["doc_id"]: r for r in docs.collect()}
    first = corpus_pipeline.good_documents(spark, docs, SF)
    chain = quality.learn_chain(docs, table(spark, SF, "labels"))
    kept = {i for i, r in at.items() if quality.judge(r["text"], chain, 0.5, 50, 50)[6]}
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == kept and 50 < len(kept) < len(at)
    first = spark.createDataFrame(first.collect(), docs.schema)
    second = spark.createDataFrame(corpus_pipeline.one_of_each_group(spark, first, SF).collect(), docs.schema)
    groups = components([(i, at[i]["text"]) for i in kept])
    assert sorted(r["doc_id"] for r in second.collect()) == sorted({c for _, c in groups.values()})
    third = spark.createDataFrame(corpus_pipeline.without_leaks(spark, second, SF).collect(), docs.schema)
    index = decontamination.Index([(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()], 0.75, 23)
    clean = {r["doc_id"] for r in second.collect() if not index.matches(decontamination.hashed(decontamination.plain_words(r["text"])))}
    assert {r["doc_id"] for r in third.collect()} == clean
    fourth = corpus_pipeline.mixed(spark, third, SF)
    want = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(third).where("taken > 0").collect()}
    got = Counter()
    for r in (rows := fourth.collect()):
        got[r["doc_id"]] += len(at[r["doc_id"]]["text"].encode().split()) if r["text"] == at[r["doc_id"]]["text"] else len(r["text"].split())
    assert fourth.columns == docs.columns and got == want
    fourth = spark.createDataFrame(rows, docs.schema)
    plain, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    last = corpus_pipeline.token_files(spark, fourth, SF).orderBy("start").collect()
    for row, (i, text) in zip(last, sorted((r["doc_id"], r["text"]) for r in rows)):
        ids = np.array(plain.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(last) == len(rows)


def test_stages_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, kept string"
    docs = spark.createDataFrame([(1, None, None, None, None, None, None), (None, "w " * 60, None, None, 3, "a", "b"), (2, "", "en", "s", 0, "a", "b"), (3, "tell " * 20, "en", "s", 3, "a", "b"), (3, "tell " * 20, "en", "s", 3, "a", "b")], schema)
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SF)
            assert out.columns == docs.columns, name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == rows.count()
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()) == ["1", "2", "3", "None"]


def test_queries_are_registered():
    assert sorted(queries.RUN) == sorted(f"op{n}_{name}" for n, name in ((1, "ngram_jaccard_join"), (2, "secret_scan"), (3, "chat_quotes"), (4, "toxicity"), (5, "url_filter"), (6, "license_scan"),
                                                                          (7, "mix_sources"), (8, "benchmark_leaks"), (9, "quality_rules"), (10, "token_files"),
                                                                          (11, "line_dedup"), (12, "merkle_manifest"), (13, "source_divergence")))
    import __spark_entry__ as entry
    assert set(queries.RUN) | {"pipeline"} <= set(entry.queries()) and {"op5_url_filter", "op6_license_scan", "op11_line_dedup", "op12_merkle_manifest", "op13_source_divergence"} <= set(entry.oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram jaccard join", "benchmark decontamination", "source mix", "token files"]


def test_finished_steps_of_the_similarity_join_can_be_deleted(spark, monkeypatch):
    """When shuffles are released, no name holds a step that later ones do not read."""
    import sys
    from fieldspark.llm import ngram_join
    held = []
    monkeypatch.setattr(ngram_join, "tidy", lambda spark: held.append((sys._getframe(1).f_code.co_name, set(sys._getframe(1).f_locals))))
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "other words that stand alone here")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(docs).collect()}
    seen = [names for name, names in held if name == "components"]
    assert got == {1: 1, 2: 1, 3: 3} and len(seen) == 3
    assert not seen[1] & {"posted", "met", "across", "star"} and not seen[2] & {"open_keys", "met"}
