"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows, in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldspark.llm.common import byte_words, mixed

WINDOW, STRIDE = 32, 16
WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 15
DIM, HIDDEN = 8, 8
INPUT = 2 * DIM + 1
GRAMS = (3, 5)


def bare(words: list[bytes]) -> list[bytes]:
    """Words without leading and trailing ASCII punctuation; a word of nothing else stays as it is."""
    return [w.strip(b".,;:!?\"'()[]#*$%&|<>") or w for w in words]


def gram_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the 3- and 5-byte runs of the words between marks, and where each word's rows begin."""
    size = np.array([len(w) + 2 for w in words])
    raw = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    rows, owners = [], []
    for n in GRAMS:
        if len(raw) < n:
            continue
        key = np.full(len(raw) - n + 1, n, np.uint64)
        for k in range(n):
            key = key * np.uint64(257) + raw[k:k + len(key)]
        inside = (owner[n - 1:] == owner[:len(key)])
        rows.append((mixed(key[inside]) % np.uint64(CHAR_ROWS)).astype(np.int32))
        owners.append(owner[:len(key)][inside])
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return rows[order], np.searchsorted(owners[order], np.arange(len(words)))


def word_rows(words: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(w) % WORD_ROWS for w in words], np.int32)


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover ``n`` words."""
    return np.arange(0, max(1, n - STRIDE), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters by name. ``odds``: fixed log-odds of the char rows, whose strongest is one more input of a word."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        near = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"word": np.zeros((WORD_ROWS, DIM), np.float32), "char": np.zeros((CHAR_ROWS, DIM), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": near(INPUT, 3 * HIDDEN), f"U{d}": near(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": near(2 * HIDDEN, HIDDEN), "a": near(HIDDEN, 1)[:, 0], "o": near(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        self.odds = np.zeros(CHAR_ROWS, np.float32)
        self.fitted = False

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of distinct words, and the table rows they come from."""
        own = word_rows(words)
        rows, start = gram_rows(words)
        count = np.diff(np.append(start, len(rows)))[:, None].astype(np.float32)
        x = np.concatenate([self.p["word"][own], np.add.reduceat(self.p["char"][rows], start) / count, np.maximum.reduceat(self.odds[rows], start)[:, None]], 1)
        return x, own, rows, start

    def scan(self, d: str, px: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, window, unit) of one direction from projected inputs."""
        steps, n = mask.shape
        out, h, u = np.empty((steps, n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), self.p[f"U{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            q = h @ u
            g = sigmoid(px[t, :, :2 * HIDDEN] + q[:, :2 * HIDDEN])
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            new = np.tanh(px[t, :, 2 * HIDDEN:] + r * q[:, 2 * HIDDEN:])
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, new, q[:, 2 * HIDDEN:], m))
            h = h + m * (1 - z) * (new - h)
            out[t] = h
        return out

    def pooled(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        key = np.tanh(states @ self.p["A"])
        e = np.where(mask > 0, key @ self.p["a"], -1e9)
        alpha = np.exp(e - e.max(0))
        alpha = alpha / alpha.sum(0)
        sum_ = (alpha[:, :, None] * states).sum(0)
        return sigmoid(sum_ @ self.p["o"] + self.p["bias"]), sum_, alpha, key

    def score_windows(self, px: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Scores of windows given as rows of ``px``, the projected inputs of distinct words (both directions)."""
        drawn = px[ids]
        both = [self.scan("f", drawn[:, :, :3 * HIDDEN], mask), self.scan("b", drawn[:, :, 3 * HIDDEN:], mask)]
        return self.pooled(np.concatenate(both, 2), mask)[0]

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], 1)

    def gradients(self, words: list[bytes], ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        """Of the mean log loss over windows."""
        x, own, rows, start = self.inputs(words)
        drawn, kept, states = x[ids], {"f": [], "b": []}, []
        for d in "fb":
            states.append(self.scan(d, drawn @ self.p[f"W{d}"] + self.p[f"c{d}"], mask, kept[d]))
        h = np.concatenate(states, 2)
        p, sum_, alpha, key = self.pooled(h, mask)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        err = ((p - y) / len(y)).astype(np.float32)
        g["o"], g["bias"] = sum_.T @ err, np.array([err.sum()], np.float32)
        d_sum = err[:, None] * self.p["o"]
        d_alpha = (h * d_sum).sum(2)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        g["a"] = (key * d_e[:, :, None]).sum((0, 1))
        d_key = d_e[:, :, None] * self.p["a"] * (1 - key**2)
        g["A"] = np.einsum("tni,tnj->ij", h, d_key)
        d_h = alpha[:, :, None] * d_sum + d_key @ self.p["A"].T
        d_x = np.zeros_like(drawn)
        for k, d in enumerate("fb"):
            back, u, w = np.zeros((mask.shape[1], HIDDEN), np.float32), self.p[f"U{d}"], self.p[f"W{d}"]
            for t, before, z, r, new, q, m in reversed(kept[d]):
                back = back + d_h[t, :, k * HIDDEN:(k + 1) * HIDDEN]
                d_new = m * back * (1 - z) * (1 - new**2)
                d_z = m * back * (before - new) * z * (1 - z)
                d_r = d_new * q * r * (1 - r)
                d_p = np.concatenate([d_z, d_r, d_new], 1)
                d_q = np.concatenate([d_z, d_r, d_new * r], 1)
                g[f"W{d}"] += drawn[t].T @ d_p
                g[f"c{d}"] += d_p.sum(0)
                g[f"U{d}"] += before.T @ d_q
                d_x[t] += d_p @ w.T
                back = back * (1 - m * (1 - z)) + d_q @ u.T
        each = np.zeros((len(words), INPUT), np.float32)
        np.add.at(each, ids.ravel(), d_x.reshape(-1, INPUT))
        np.add.at(g["word"], own, each[:, :DIM])
        count = np.diff(np.append(start, len(rows)))
        np.add.at(g["char"], rows, np.repeat(each[:, DIM:2 * DIM] / count[:, None], count, axis=0))
        return g, float(-np.log(np.where(y == 1, p, 1 - p) + 1e-9).mean())

    def document_scores(self, docs: list[list[bytes]], at_once: int = 2048) -> list[np.ndarray]:
        """Scores of all windows of each document."""
        known: dict[bytes, int] = {}
        ids = [np.array([known.setdefault(w, len(known)) for w in d], np.int32) for d in docs]
        if not known:
            return [np.zeros(0, np.float32) for _ in docs]
        names = list(known)
        px = np.concatenate([self.project(self.inputs(names[k:k + 20_000])[0]) for k in range(0, len(names), 20_000)])
        starts = [windows(len(d)) if len(d) else np.zeros(0, int) for d in ids]
        grid = [(np.concatenate([d, np.zeros(WINDOW, np.int32)])[s[:, None] + np.arange(WINDOW)], (s[:, None] + np.arange(WINDOW)) < len(d)) for d, s in zip(ids, starts) if len(d)]
        rows, live = np.concatenate([a for a, _ in grid]), np.concatenate([b for _, b in grid])
        scores = [self.score_windows(px, rows[k:k + at_once].T, live[k:k + at_once].T.astype(np.float32)) for k in range(0, len(rows), at_once)]
        return np.split(np.concatenate(scores), np.cumsum([len(s) for s in starts])[:-1])


def log_odds(rows: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log-odds of the label among documents that have a row against all, 0 for rows of fewer than 5 documents."""
    with_, without = np.zeros(size), np.zeros(size)
    for r, t in zip(rows, toxic):
        (with_ if t else without)[np.unique(r)] += 1
    odds = np.log((with_ + 0.5) / (toxic.sum() + 1)) - np.log((without + 0.5) / ((1 - toxic).sum() + 1))
    return np.where(with_ + without < 5, 0, np.clip(odds, -4, 4)).astype(np.float32)


def fit(texts: list[str], toxic: list[int], epochs: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network:
    """Trained on windows of labelled texts: of each text the window that the network finds most toxic, as a document's score is
    that of its worst window, and a second one of the clean texts. Before there is a network, log-odds choose."""
    net, y = Network(seed), np.array(toxic, int)
    docs = [bare(byte_words(t)) for t in texts]
    y, docs = y[[k for k, d in enumerate(docs) if d]], [d for d in docs if d]
    if len(set(y.tolist())) < 2:
        return net
    net.fitted = True
    rng = np.random.default_rng(seed)
    distinct = [list(dict.fromkeys(d)) for d in docs]
    net.odds = log_odds([gram_rows(d)[0] for d in distinct], y, CHAR_ROWS)
    word_odds = log_odds([word_rows(d) for d in distinct], y, WORD_ROWS)
    for name, odds in (("word", word_odds), ("char", net.odds)):
        net.p[name] += np.where(odds[:, None] != 0, rng.standard_normal(net.p[name].shape) * 0.1, 0)
        net.p[name][:, 0] = odds
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch == 0:
            values = []
            for d in docs:
                x = net.inputs(d)[0]
                v = np.r_[0, np.cumsum(np.maximum(x[:, 0], 0) + np.maximum(x[:, -1] - 1.5, 0))]
                s = windows(len(d))
                values.append(v[np.minimum(s + WINDOW, len(d))] - v[s])
        elif epoch % 2 == 1:
            values = [v for k in range(0, len(docs), 200) for v in net.document_scores(docs[k:k + 200])]
        chosen = []
        for k, v in enumerate(values):
            worst = int(np.argmax(v))
            chosen.append((k, worst))
            if y[k] == 0 and len(v) > 1:
                chosen.append((k, int(rng.integers(len(v)))))
        for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // batch)):
            known: dict[bytes, int] = {}
            ids, mask = np.zeros((WINDOW, len(part)), np.int32), np.zeros((WINDOW, len(part)), np.float32)
            for n, c in enumerate(part):
                k, w = chosen[c]
                words = docs[k][w * STRIDE:w * STRIDE + WINDOW]
                ids[:len(words), n] = [known.setdefault(x, len(known)) for x in words]
                mask[:len(words), n] = 1
            g, _ = net.gradients(list(known), ids, mask, y[[chosen[c][0] for c in part]])
            step += 1
            for k, v in net.p.items():
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k]**2
                v -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(id_col: str):
    """Rows whose label is never learnt: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = 700, longest_text: int = 20_000) -> Network:
    """Fit on at most ``sample`` toxic and as many clean labelled texts of at most ``longest_text`` characters, lowest hash of
    the id first; held-out rows are never among them. Only the fit is bounded: every text is scored whole."""
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_toxic")))
    rows = []
    for kind in (0, 1):
        ids = known.where(F.col("_toxic") == kind).orderBy(F.xxhash64("_id"), "_id").limit(sample)  # bounded, so broadcast
        rows += (docs.where(F.length(text_col) <= longest_text).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
                 .join(F.broadcast(ids), "_id").select("_id", "_text", "_toxic").collect())
    rows = list({r["_id"]: r for r in sorted(rows, key=lambda r: (r["_id"], r["_text"]))}.values())
    return fit([r["_text"] for r in rows], [r["_toxic"] for r in rows])


def score_documents(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", words_at_once: int = 100_000) -> DataFrame:
    """``id, held_out, score, predicted, n_windows`` of every row: the score of its worst window, all overlapping windows read.

    A text without words has score 0, as has every text if the labels did not hold both kinds. Null and repeated ids
    pass through, one row each; further columns are not read; nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            scores, counts, held, words = [], [], [], 0
            for k in range(batch.num_rows):
                held.append(bare(byte_words(batch.column("_text")[k].as_py())))
                words += len(held[-1])
                if words >= words_at_once or k + 1 == batch.num_rows:
                    got = net.document_scores(held) if net.fitted else [np.zeros(0)] * len(held)
                    scores += [float(s.max()) if len(s) else 0.0 for s in got]
                    counts += [len(s) for s in got]
                    held, words = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                                              pa.array(counts, pa.int64())], names=["_id", "held_out", "score", "predicted", "n_windows"])

    return rows.mapInArrow(run, f"_id {kind}, held_out boolean, score double, predicted int, n_windows long").withColumnRenamed("_id", id_col)
