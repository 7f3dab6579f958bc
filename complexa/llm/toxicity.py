"""Toxicity: a bidirectional gated recurrent network with attention pooling
over character and word inputs, trained in numpy.

Tokens are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased.
A token's input is its hashed word embedding and the scaled sum of the hashed
embeddings of its byte 3- and 4-grams.  Overlapping windows of ``WINDOW``
tokens (every ``STRIDE``-th start, and one at the end) cover the whole text.
Two gated recurrent units read a window in both directions; attention pools
their states; a linear unit gives the window's logit.  A text's score is that
of its most toxic window.  In training a text's logit is the mean of its
windows' logits weighted by their softmax, so the labels of texts are enough.

The model is fitted on the driver to a bounded sample of labelled rows
(``SAMPLE`` toxic and ``SAMPLE_CLEAN`` clean ones with the smallest hashes, one row of each id
with its whole text); every text is scored over all its windows
by tasks.

Defined cases: null text counts as empty; a text without tokens is one empty
window (the score of the bias); a label is the largest of a doc_id's non-null
ones; no labels of either class: the untrained network scores; a null doc_id
counts as the text '' for the fold; repeated rows get equal scores; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complexa.llm.common import LOWER, Words, mix, ragged_range, row_key, text_array, text_chunks
from complexa.llm.ngram_lm import fold

WINDOW, STRIDE = 32, 20
WORD_BUCKETS, GRAM_BUCKETS, WORD_DIM, GRAM_DIM, HIDDEN = 1 << 14, 1 << 14, 8, 12, 8
#: Toxic and clean labelled rows that the network is fitted to at most, with all their windows.
SAMPLE, SAMPLE_CLEAN = 1000, 1500
#: Windows of a training step that are in memory at once, and the share of a text's strongest window below which a window has no part in the step.
TRAIN_WINDOWS, WEAK = 4096, 1e-3
EPOCHS, BATCH_TEXTS, RATE, SHARPNESS, DECAY = 5, 32, 0.01, 3.0, 1e-4
#: Share of a window's tokens that a training step leaves out, so that every telling token is learned by itself.
DROPPED = 0.3
THRESHOLD = 0.3

#: Every byte but ASCII letters, digits and those of non-ASCII characters splits tokens.
_SPLIT = np.ones(256, bool)
_SPLIT[48:58] = _SPLIT[65:91] = _SPLIT[97:123] = _SPLIT[128:] = False
_U = np.uint64


class Tokens:
    """Distinct tokens of a run of texts with their features, and the tokens of each row as indices."""

    def __init__(self, data: np.ndarray, rows: np.ndarray):
        words = Words(data, rows, lower=True, space=_SPLIT)
        hashes, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        self.hash, self.rows, self.index = hashes, words.rows, back.astype(np.int64)
        self.bucket = (hashes % _U(WORD_BUCKETS)).astype(np.int64)
        start, size = words.start[first], (words.end - words.start)[first]
        low, grams, owner = LOWER[data].astype(np.uint64), [], []
        for n in (3, 4):
            counts = np.maximum(size - n + 1, 0)
            at = ragged_range(start, counts)
            code = np.full(len(at), n, np.uint64)
            for j in range(n):
                code = code * _U(257) + low[at + j]
            grams.append(mix(code) % _U(GRAM_BUCKETS))
            owner.append(np.repeat(np.arange(len(hashes)), counts))
        grams, owner = np.concatenate(grams).astype(np.int64), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.grams, self.gram_counts = grams[order], np.bincount(owner, minlength=len(hashes))


def tokens_of(texts: list[str]) -> Tokens:
    """Tokens of many texts, put together from runs of about a megabyte (bounded working memory)."""
    parts = []
    for _, _, data, rows in text_chunks(pa.array(texts, pa.string()), 1 << 20):
        parts.append(Tokens(data, rows))
    out = parts[0]
    if len(parts) > 1:
        hashes, first, back = np.unique(np.concatenate([p.hash for p in parts]), return_index=True, return_inverse=True)
        shift = np.cumsum([0, *(len(p.hash) for p in parts)])
        counts = np.concatenate([p.gram_counts for p in parts])
        at = np.cumsum(counts) - counts
        grams = np.concatenate([p.grams for p in parts])
        out.index = np.concatenate([back[shift[k] + p.index] for k, p in enumerate(parts)])
        out.rows = np.append(0, np.cumsum(np.concatenate([np.diff(p.rows) for p in parts])))
        out.bucket = np.concatenate([p.bucket for p in parts])[first]
        out.hash, out.grams, out.gram_counts = hashes, grams[ragged_range(at[first], counts[first])], counts[first]
    return out


def windows_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, tokens, row) of every window; a row without tokens has one empty window."""
    size = np.diff(rows)
    count = 1 + np.maximum(-(-(size - WINDOW) // STRIDE), 0)
    row = np.repeat(np.arange(len(size)), count)
    start = np.minimum(ragged_range(np.zeros(len(size), np.int64), count) * STRIDE, np.maximum(size - WINDOW, 0)[row])
    return rows[:-1][row] + start, np.minimum(size[row], WINDOW), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and passes.  Index 0 of the stacked recurrent weights reads forward, 1 backward."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        self.p = {"word": normal(WORD_BUCKETS, WORD_DIM, scale=0.1), "gram": normal(GRAM_BUCKETS, GRAM_DIM, scale=0.1),
                  "wx": normal(d, 6 * h, scale=d ** -0.5), "bx": np.zeros(6 * h, np.float32), "u": normal(2, h, 3 * h, scale=h ** -0.5),
                  "wa": normal(2 * h, h, scale=(2 * h) ** -0.5), "va": normal(h, scale=1.0), "wo": normal(2 * h, scale=0.5),
                  "bo": np.full(1, -1.0, np.float32)}

    def inputs(self, bucket: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Token inputs; the last row, all zero, is padding."""
        out = np.zeros((len(bucket) + 1, WORD_DIM + GRAM_DIM), np.float32)
        out[:-1, :WORD_DIM] = self.p["word"][bucket]
        some = counts > 0
        if some.any():
            sums = np.add.reduceat(self.p["gram"][grams], (np.cumsum(counts) - counts)[some])
            out[:-1, WORD_DIM:][some] = sums / np.sqrt(counts[some])[:, None]
        return out

    def forward(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows.  ``table``: projected inputs (tokens, 6h); ``index``, ``mask``: (T, windows)."""
        h, (steps, n) = HIDDEN, index.shape
        states = np.zeros((steps, 2, n, h), np.float32)
        state, kept = np.zeros((2, n, h), np.float32), []
        for t in range(steps):
            back = steps - 1 - t
            x = np.stack([table[index[t], :3 * h], table[index[back], 3 * h:]])
            m = np.stack([mask[t], mask[back]])[:, :, None]
            r = state @ self.p["u"]
            zr = _sigmoid(x[:, :, :2 * h] + r[:, :, :2 * h])
            z, g = zr[:, :, :h], zr[:, :, h:]
            c = np.tanh(x[:, :, 2 * h:] + g * r[:, :, 2 * h:])
            new = np.where(m, c + z * (state - c), state)
            if keep:
                kept.append((state, z, g, c, r[:, :, 2 * h:], m))
            state = new
            states[t, 0], states[back, 1] = new[0], new[1]
        both = np.concatenate([states[:, 0], states[:, 1]], 2)
        tanh = np.tanh(both @ self.p["wa"])
        score = np.where(mask, tanh @ self.p["va"], -1e9)
        weight = np.exp(score - score.max(0)) * mask
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (weight[:, :, None] * both).sum(0)
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logit, (kept, both, tanh, weight, pooled)) if keep else logit

    def backward(self, d_logit: np.ndarray, index: np.ndarray, mask: np.ndarray, size: int, kept_all) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters, and of the projected input table (``size`` rows)."""
        kept, both, tanh, weight, pooled = kept_all
        h, (steps, n) = HIDDEN, index.shape
        grad = {"bo": np.array([d_logit.sum()], np.float32), "wo": pooled.T @ d_logit}
        d_pooled = d_logit[:, None] * self.p["wo"]
        d_both = weight[:, :, None] * d_pooled
        d_weight = (both * d_pooled).sum(2)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        grad["va"] = np.einsum("tn,tnk->k", d_score, tanh)
        d_tanh = d_score[:, :, None] * self.p["va"] * (1 - tanh**2)
        grad["wa"] = np.einsum("tni,tnk->ik", both, d_tanh)
        d_both = d_both + d_tanh @ self.p["wa"].T
        grad["u"] = np.zeros_like(self.p["u"])
        d_state = np.zeros((2, n, h), np.float32)
        d_x = np.zeros((steps, n, 6 * h), np.float32)
        for t in reversed(range(steps)):
            back = steps - 1 - t
            state, z, g, c, rc, m = kept[t]
            d_new = d_state + np.stack([d_both[t, :, :h], d_both[back, :, h:]])
            d_step = np.where(m, d_new, 0)
            d_c = d_step * (1 - z) * (1 - c**2)
            d_z = d_step * (state - c) * z * (1 - z)
            d_g = d_c * rc * g * (1 - g)
            d_r = np.concatenate([d_z, d_g, d_c * g], 2)
            grad["u"] += state.transpose(0, 2, 1) @ d_r
            d_state = np.where(m, d_step * z, d_new) + d_r @ self.p["u"].transpose(0, 2, 1)
            d_in = np.concatenate([d_z, d_g, d_c], 2)
            d_x[t, :, :3 * h] += d_in[0]
            d_x[back, :, 3 * h:] += d_in[1]
        flat = index.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.append(True, flat[order][1:] != flat[order][:-1]))
        d_table = np.zeros((size, 6 * h), np.float32)
        d_table[flat[order][first]] = np.add.reduceat(d_x.reshape(-1, 6 * h)[order], first)
        return grad, d_table

    def window_logits(self, tokens: Tokens, start: np.ndarray, size: np.ndarray, step: int = 16384) -> np.ndarray:
        table = self.inputs(tokens.bucket, tokens.grams, tokens.gram_counts) @ self.p["wx"] + self.p["bx"]
        out = np.empty(len(start), np.float32)
        for a in range(0, len(start), step):
            index, mask = _gather(tokens, start[a:a + step], size[a:a + step])
            out[a:a + step] = self.forward(table, index, mask)
        return out


def _gather(tokens: Tokens, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(WINDOW)[:, None]
    mask = at < size
    padded = np.append(tokens.index, len(tokens.bucket))
    return padded[np.where(mask, start + at, len(tokens.index))], mask


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Train on texts (Adam; windows of a text weighted by the softmax of their logits)."""
    net = Network(seed)
    if len(set(labels.tolist())) < 2:
        return net
    tokens = tokens_of(texts)
    start, size, row = windows_of(tokens.rows)
    of_row = np.searchsorted(row, np.arange(len(texts) + 1))
    first, second, step = {}, {}, 0
    gram_at = np.cumsum(tokens.gram_counts) - tokens.gram_counts
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + RATE / 20
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH_TEXTS):
            chosen = np.sort(order[a:a + BATCH_TEXTS])
            counts = of_row[chosen + 1] - of_row[chosen]
            w = ragged_range(of_row[chosen], counts)
            text = np.repeat(np.arange(len(chosen)), counts)
            index, mask = _gather(tokens, start[w], size[w])
            mask &= rng.random(mask.shape) >= DROPPED
            used, index = np.unique(index, return_inverse=True)
            index = index.reshape(mask.shape)
            real = used[used < len(tokens.bucket)]
            grams = tokens.grams[ragged_range(gram_at[real], tokens.gram_counts[real])]
            features = net.inputs(tokens.bucket[real], grams, tokens.gram_counts[real])
            table = features @ net.p["wx"] + net.p["bx"]
            blocks = range(0, len(w), TRAIN_WINDOWS)
            logit = np.concatenate([net.forward(table, index[:, b:b + TRAIN_WINDOWS], mask[:, b:b + TRAIN_WINDOWS]) for b in blocks])
            high = np.maximum.reduceat(logit, np.cumsum(counts) - counts)
            weight = np.exp(SHARPNESS * (logit - high[text]))
            strong = np.flatnonzero(weight >= WEAK)
            weight /= np.add.reduceat(weight, np.cumsum(counts) - counts)[text]
            whole = np.add.reduceat(weight * logit, np.cumsum(counts) - counts)
            error = (_sigmoid(whole) - labels[chosen]) / len(chosen)
            grad, d_table = {}, np.zeros((len(features), 6 * HIDDEN), np.float32)
            for b in range(0, len(strong), TRAIN_WINDOWS):
                some = strong[b:b + TRAIN_WINDOWS]
                _, kept = net.forward(table, index[:, some], mask[:, some], keep=True)
                part, d_part = net.backward((weight[some] * error[text[some]]).astype(np.float32), index[:, some], mask[:, some], len(features), kept)
                grad = {k: grad.get(k, 0) + g for k, g in part.items()}
                d_table += d_part
            grad["wx"], grad["bx"] = features.T @ d_table, d_table.sum(0)
            d_in = (d_table @ net.p["wx"].T)[:len(real)]
            grad["word"], grad["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(grad["word"], tokens.bucket[real], d_in[:, :WORD_DIM])
            n = tokens.gram_counts[real]
            np.add.at(grad["gram"], grams, np.repeat(d_in[:, WORD_DIM:] / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0))
            step += 1
            for k, g in grad.items():
                g = g + DECAY * net.p[k]
                first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                second[k] = 0.99 * second.get(k, 0) + 0.01 * g**2
                net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def text_scores(net: Network, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Score of every row: that of its most toxic window."""
    tokens = Tokens(data, rows)
    start, size, row = windows_of(tokens.rows)
    logits = net.window_logits(tokens, start, size)
    return _sigmoid(np.maximum.reduceat(logits, np.searchsorted(row, np.arange(len(rows) - 1)))).astype(np.float64)


def train_network(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE, clean: int = SAMPLE_CLEAN) -> Network:
    """Fit to labelled rows outside the held-out fold."""
    usable = labels.filter("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).filter(
        fold("doc_id", folds) != held_out)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = usable.filter("toxic = 1").orderBy(*order).limit(sample).unionByName(usable.filter("toxic = 0").orderBy(*order).limit(clean))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("rid"))
    found = rows.join(F.broadcast(ids), "doc_id")  # two samples of ids: a proven bound; of the rows of an id one, whole
    got = found.groupBy("doc_id").agg(F.min_by(F.struct("toxic", F.coalesce("text", F.lit("")).alias("text")), "rid").alias("one")).select("one.*").collect()
    got.sort(key=lambda r: (r["toxic"], r["text"]))  # the order of rows is no input of the fit
    return fit([r["text"] for r in got], np.array([r["toxic"] for r in got], np.int64))


def toxicity_scores(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, rid, score per row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, rows in text_chunks(text_array(batch)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rid"), pa.array(text_scores(net, data, rows))],
                                                 names=["doc_id", "rid", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("rid"))
    return rows.mapInArrow(scan, "doc_id long, rid long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold (scored where they are read: nothing is shuffled)."""
    net = train_network(docs, labels)
    names, schema = docs.columns, docs.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for _, _, data, rows in text_chunks(text_array(batch)):
                keep.append(text_scores(net, data, rows) < THRESHOLD)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(scan, schema).select(*names)
