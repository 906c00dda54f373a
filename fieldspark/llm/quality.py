"""Quality rules: counts over whole texts, and a linear-chain CRF over lines whose content share decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: fixed value: characters that the symbol count takes
SYMBOLS = b"#*$%&|<>"
BLANK_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
CAPITALS, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
LETTERS = CAPITALS + CAPITALS.lower()
ENDS = frozenset(b".!?:;\"')")
FEATURES = ("bias", "words", "few words", "symbols", "capitals", "closed", "repeated line", "repeated words", "word length", "digits", "symbol words")


def count_in(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, each place once."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    two = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(two[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:k + len(again)] |= again
    return int(covered.sum())


def line_features(raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature rows and word counts of the lines that hold a word, and how many of these equal an earlier line."""
    rows, counts, seen, repeated = [], [], set(), 0
    for line in raw.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        again = line in seen
        repeated += again
        seen.add(line)
        marks, letters = count_in(line, SYMBOLS), count_in(line, LETTERS)
        ends = sum(w[-1] in SYMBOLS or w[-1:] == b"!" for w in words)
        rows.append((1.0, np.log1p(n) / 4, n < 3, marks / size * 5, count_in(line, CAPITALS) / max(letters, 1), line.rstrip()[-1] in ENDS, again,
                     1 - len(set(words)) / n, min(size / n, 30) / 10, count_in(line, DIGITS) / size * 5, ends / n))
        counts.append(n)
    return np.array(rows, np.float64).reshape(-1, len(FEATURES)), np.array(counts, np.int64), repeated


class Chain:
    """Two labels, 0 boilerplate and 1 content. ``weights``: score of content against boilerplate by feature;
    ``moves``: score of a label after another. Without both kinds of example every line is content."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.r_[1.0, np.zeros(len(FEATURES) - 1)] if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Viterbi path of one sequence of content scores (boilerplate scores 0)."""
        n = len(scores)
        back = np.zeros((n, 2), bool)
        (b_b, b_c), (c_b, c_c) = self.moves.tolist()
        bad, good = 0.0, float(scores[0]) if n else 0.0
        for t, s in enumerate(scores.tolist()[1:], 1):
            from_bad, from_good = bad + b_b, good + c_b
            to_bad, to_good = bad + b_c, good + c_c
            back[t] = from_good > from_bad, to_good >= to_bad
            bad, good = max(from_bad, from_good), max(to_bad, to_good) + s
        out = np.zeros(n, bool)
        now = good >= bad
        for t in range(n - 1, -1, -1):
            out[t] = now
            now = back[t, int(now)]
        return out


def fit_chain(docs: list[np.ndarray], good: list[bool], rounds: int = 60, rate: float = 0.2, l2: float = 1e-3, longest: int = 64) -> Chain:
    """CRF fitted by maximum likelihood (Adam) to lines labelled by their documents.

    A first logistic fit on lines finds which lines of low-quality documents look like those of good ones; these count as
    content. Sequences are cut into stretches of ``longest`` lines.
    """
    pairs = [(x, g) for x, g in zip(docs, good) if len(x)]
    if len({bool(g) for _, g in pairs}) < 2:
        return Chain()
    flat = np.concatenate([x for x, _ in pairs])
    owner = np.concatenate([np.full(len(x), g, float) for x, g in pairs])
    each = np.where(owner == 1, 0.5 / owner.sum(), 0.5 / (len(owner) - owner.sum()))
    w, m, v = np.zeros(flat.shape[1]), 0.0, 0.0
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(flat @ w, -30, 30)))
        g = flat.T @ ((p - owner) * each) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    labels = (owner == 1) | (flat @ w > 0)
    xs, ys, at = [], [], 0
    for x, _ in pairs:
        y = labels[at:at + len(x)]
        at += len(x)
        for lo in range(0, len(x), longest):
            xs.append(x[lo:lo + longest])
            ys.append(y[lo:lo + longest])
    size = np.array([len(x) for x in xs])
    n, most = len(xs), size.max()
    grid, truth = np.zeros((n, most, flat.shape[1])), np.zeros((n, most), int)
    for i, (x, y) in enumerate(zip(xs, ys)):
        grid[i, :len(x)], truth[i, :len(x)] = x, y
    live = np.arange(most)[None] < size[:, None]
    theta = np.r_[w, np.zeros(4)]
    m = v = 0.0
    wanted = np.r_[np.einsum("ntf,nt->f", grid, truth * live), np.zeros(4)]
    both = live[:, 1:]
    for a in range(2):
        for b in range(2):
            wanted[-4 + 2 * a + b] = ((truth[:, :-1] == a) & (truth[:, 1:] == b) & both).sum()
    for k in range(1, rounds + 1):
        moves = theta[-4:].reshape(2, 2)
        score = np.stack([np.zeros((n, most)), grid @ theta[:-4]], 2)
        ahead, behind = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        ahead[:, 0] = score[:, 0]
        for t in range(1, most):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + score[:, t]
            ahead[:, t] = np.where(live[:, t, None], step, ahead[:, t - 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        got = np.zeros(4)
        for t in range(most - 2, -1, -1):
            step = score[:, t + 1] + behind[:, t + 1]
            joint = np.exp(ahead[:, t, :, None] + moves + step[:, None, :] - total[:, None, None]) * live[:, t + 1, None, None]
            got += joint.sum(0).ravel()
            behind[:, t] = np.where(live[:, t + 1, None], np.logaddexp.reduce(moves + step[:, None, :], axis=2), 0.0)
        content = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * live
        g = (np.r_[np.einsum("ntf,nt->f", grid, content), got] - wanted) / live.sum() + l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.3 * rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Chain(theta[:-4], theta[-4:].reshape(2, 2))


def learn_chain(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                sample: int = 1500, longest_text: int = 20_000) -> Chain:
    """Fit on at most ``sample`` labelled documents of at most ``longest_text`` characters, lowest hash of the id first.
    The bound holds for the driver's memory; everything else looks at all rows."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_good"))
             .orderBy(F.xxhash64("_id"), "_id").limit(sample))  # bounded, so broadcast
    rows = (docs.where(F.length(text_col) <= longest_text).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(known), "_id").select("_id", "_text", "_good").collect())
    rows = list({r["_id"]: r for r in sorted(rows, key=lambda r: (r["_id"], r["_text"]))}.values())
    return fit_chain([line_features(r["_text"].encode())[0] for r in rows], [r["_good"] == 1 for r in rows])


def judge(text: str | None, chain: Chain, least_share: float, least_words: int, most_repeats: float) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    n, repeats = len(words), repeat_words(words)
    x, counts, repeated = line_features(raw)
    content = int(counts[chain.decode(x @ chain.weights)].sum()) if len(x) else 0
    failed = n < least_words or 100 * repeats > most_repeats * n
    return (n, len(text or "") - count_in(raw, BLANK_BYTES), count_in(raw, SYMBOLS), repeated, repeats, failed, not failed and content >= least_share * n, content)



def quality_rules(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.5,
                  least_words: int = 50, most_repeats: float = 50.0) -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_words`` of every row.

    ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeats`` % of them in repeated 3-word windows.
    ``kept``: not failed, and the lines that the chain's Viterbi path marks as content hold ``least_share`` of the
    words. A null text counts as empty, and an empty one fails; ids may be null or repeated; one row per row. Further
    columns are not read. Nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    made = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long"
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]
    names = [p.split()[0] for p in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [judge(t.as_py(), chain, least_share, least_words, most_repeats) for t in batch.column("_text")]
            columns = [pa.array([g[k] for g in got], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], names=["_id", *names])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, {made}").withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, chain: Chain, text_col: str = "text", least_share: float = 0.5, least_words: int = 50, most_repeats: float = 50.0) -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality_rules`` keeps. They are filtered where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([judge(t.as_py(), chain, least_share, least_words, most_repeats)[6] for t in batch.column(text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
