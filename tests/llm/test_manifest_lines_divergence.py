"""Line runs, Merkle manifest and source divergence against brute force, with nulls, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import divergence, line_runs, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, fp1 long, term string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    """Rows ``doc_id, text, lang, source`` with further columns of clashing names."""
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "r", 5, "t") for i, t, lang, source in rows], DOCS)


# --- line dedup


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)


def dropped(texts, least, min_chars=1):
    held = Counter(k for t in texts for k in {key_of(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key_of(x)) >= min_chars and held[key_of(x)] >= least)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_texts(seed):
    rng = random.Random(seed)
    common = ["Share this", " share THIS\t", "menu | home", "É Été", "é été", "x", "\x0b", " kept "]
    out = [None, "", "\n", "\n\n", "share this", "\tSHARE this\r\nmenu | home"]
    for k in range(60):
        out.append("\n".join(rng.choice(common) if rng.random() < 0.5 else f"line {rng.randrange(40)}" for _ in range(rng.randrange(1, 7))))
    return out + [out[10]] * 4


@pytest.mark.parametrize("least,min_chars,batches", [(3, 1, 4), (10, 3, 1), (1, 1, 3)])
def test_lines_equal_brute_force(spark, least, min_chars, batches):
    texts = line_texts(least)
    df = docs_of(spark, [(None if i == 7 else i // 2, t, "en", "s") for i, t in enumerate(texts)])
    got = line_runs.line_dedup(df, min_docs=least, min_chars=min_chars, batches=batches)
    want = dropped(texts, least, min_chars)
    assert sorted((r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect()) == sorted(want)
    assert got.select("row.*").columns == df.columns
    assert line_runs.line_dedup(df.limit(0)).count() == 0


def test_a_very_long_text_of_lines(spark):
    long = "\n".join(["spam", "ham"] * 30_000 + [f"own {k}" for k in range(1000)])
    got = {r["row"]["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept"].encode()).hexdigest())
           for r in line_runs.line_dedup(docs_of(spark, [(1, long, "en", "s"), (2, "spam\nham", "en", "s")]), min_docs=2).collect()}
    assert got == {1: (61_000, 60_000, hashlib.sha256("\n".join(f"own {k}" for k in range(1000)).encode()).hexdigest()), 2: (2, 2, hashlib.sha256(b"").hexdigest())}


def test_runs_grow_by_batches_and_are_reopened(spark, folder):
    texts = line_texts(8)
    parts = [docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts) if i % 5 == k]) for k in range(5)]
    runs = line_runs.LineRuns(spark, folder, min_docs=4, buckets=3)
    for k in range(3):
        runs.add(line_runs.line_hashes(parts[k]), str(k))
    assert sorted(r.level for r in runs.runs) == [0, 1]  # 0 and 1 are merged
    again = line_runs.LineRuns.open(spark, folder, min_docs=4)
    for k in (1, 2, 3, 4):  # 1 and 2 are there already
        again.add(line_runs.line_hashes(parts[k]), str(k))
    held = Counter(k for t in texts for k in {key_of(x) for x in (t or "").split("\n")} if k)
    lines = spark.createDataFrame([(k,) for k in held], "k string").select("k", line_runs.fingerprint(F.col("k"), line_runs.FP).alias("f")).select("k", "f.*")
    assert {r["k"] for r in again.frequent().join(lines, line_runs.FP).collect()} == {k for k, n in held.items() if n >= 4}
    assert len(again.runs) == 1 and sorted(again.runs[0].batches) == ["0", "1", "2", "3", "4"]


def test_a_settled_line_is_not_written_again(spark, folder):
    runs = line_runs.LineRuns(spark, folder, min_docs=3, fan=9)
    for k in range(3):
        runs.add(line_runs.line_hashes(docs_of(spark, [(i, f"common\nown {k} {i}", "en", "s") for i in range(5)])), str(k))
    assert [spark.table(r.name).count() for r in runs.runs] == [6, 5, 5]


# --- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(i, source, lang, n, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k:k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def path_of(levels, at):
    out = []
    for level in levels[:-1]:
        lo = at // 8 * 8
        out.append((level[lo:at], level[at + 1:lo + 8]))
        at //= 8
    return out


def manifest_of(rows):
    """Sorted rows of the contract for ``doc_id, text, lang, source``."""
    groups = defaultdict(list)
    for i, text, lang, source in rows:
        n = None if text is None else len(text)
        tampered = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        groups[lang].append(((i is not None, i or 0), leaf_of(i, source, lang, n, text), leaf_of(i, source, lang, n, text and text.translate(FOLD)) if tampered else None, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([m[1] for m in sorted(groups[g], key=lambda m: m[:2])]) for g in names}
    above = tree([trees[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for at, (_, leaf, other, i) in enumerate(sorted(groups[g], key=lambda m: m[:2])):
            path, acc = path_of(trees[g], at) + path_of(above, place), other or leaf
            for left, right in path:
                acc = sha(*left, acc, *right)
            out.append((i, leaf, trees[g][-1][0], above[-1][0], sha(*[d for left, right in path for d in (*left, *right)]), acc, acc == above[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 1, None: 9, "": 2}, {f"l{k:02}": 1 for k in range(11)}, {"en": 150, "fr": 65, None: 3}])
def test_manifest_equals_brute_force(spark, sizes):
    rng = random.Random(3)
    rows = [(rng.choice([None, rng.randrange(50), rng.randrange(10**9)]), rng.choice([None, "", "lower only", f"Text É {k}"]), lang, rng.choice([None, "web"])) for lang, n in sizes.items() for k in range(n)]
    rows += rows[:2]
    got = merkle.proofs(merkle.manifest(docs_of(spark, rows)))
    cols = ["row.doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=str) == manifest_of(rows)


def test_manifest_of_nothing(spark):
    assert merkle.proofs(merkle.manifest(docs_of(spark, []))).count() == 0


# --- source divergence


def words_of(text):
    return [w.translate(FOLD) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def divergence_of(rows, top=200):
    rows = [(text or "", lang or "", source or "") for _, text, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == lang]
        docs = Counter(w for t, _, _ in mine for w in set(words_of(t)))
        kept = sorted(w for w, n in docs.items() if n >= 3)
        groups = {s: Counter(w for t, _, g in mine if g == s for w in words_of(t)) for s in {r[2] for r in mine}}
        p = {}
        for s, c in [*groups.items(), (None, sum(groups.values(), Counter()))]:
            total = sum(c[w] for w in kept)
            p[s] = {w: 1 + 10**9 * (c[w] + 1) // (total + len(kept)) for w in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in groups:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in groups if o != s]
            terms = [(w, f(p[s][w], p[None][w])) for w in kept if groups[s][w] and p[s][w] > p[None][w]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(32, 8192), (2, 7)])
def test_divergence_equals_brute_force(spark, blocks):
    rng = random.Random(11)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)] + ["É", "é", "日本", "Ab-cD", "x_y", "a1b"]
    rows = [(k, " ".join(rng.choice(vocabulary[: 20 + 10 * (k % 8)]).upper() if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(rng.randrange(60))),
             rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "d", "e", None, ""])) for k in range(120)]
    rows += [(1, None, "en", "empty"), (2, "", "xx", "only"), (3, "rare words here", "yy", "p"), (4, "others", "yy", "q"), (5, "12 34", "en", "digits")] + rows[:3]
    got = divergence.source_divergence(docs_of(spark, rows), top=9, group_block=blocks[0], term_block=blocks[1])
    assert sorted(tuple(r) for r in got.collect()) == divergence_of(rows, 9)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert divergence.source_divergence(docs_of(spark, [])).count() == 0


def test_terms_are_handed_on_in_bounded_lots(spark):
    rows = [(k, " ".join(f"t{chr(97 + j)}" for j in range(26)), "en", f"s{k % 3}") for k in range(20)]
    got = divergence.term_counts(docs_of(spark, rows).coalesce(1), "text", "lang", "source", held_terms=10)
    assert {(r["n"], r["docs"]) for r in got.where("term IS NOT NULL AND source = 's0'").collect()} == {(7, 7)}


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, v = 10**12 + 7, 10**16 + 3, 12345
    row = spark.createDataFrame([(n, total, v)], "n long, t long, v long").select(divergence.share(F.col("n"), F.col("t"), F.col("v")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 1) // (total + v)


def test_one_cell_by_hand():
    rows = [("en", 0, 0, 0, 0, "a", None, 5, 4), ("en", 0, 0, 0, 0, "b", None, 7, 4), ("en", 0, 0, 0, 0, "a", "x", 100, None), ("en", 0, 0, 0, 0, "b", "y", 50, None)]
    got = divergence.cell_sums(pd.DataFrame(rows, columns=["lang", "g1", "g2", "tb", "gb", "source", "term", "p", "m"]))
    f = lambda p, q: (p - q) ** 2 // q
    want = {("a", "b"): f(100, 7) + f(5, 50) + 2 * f(5, 7), ("b", "a"): f(7, 100) + f(50, 5) + 2 * f(7, 5)}
    assert {(r.source, r.item): r.value for r in got.itertuples()} == want
