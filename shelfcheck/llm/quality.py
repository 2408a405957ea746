"""Quality classifier: a small byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes, sums over a learned byte embedding, slide over the whole text in steps of ``STEP``.
Their responses are max-pooled within overlapping chunks of two ``BLOCK``-byte blocks; the chunk maxima are
pooled over the document by mean and by maximum, and a logistic unit makes one probability of them. For scoring,
embedding and filters are folded into one table for each byte place.

The network is trained on the driver on at most ``SAMPLE`` labelled documents of at most ``LONGEST`` bytes: those
with the smallest hash of the id among labelled ids whose crc32 modulo 5 is not 0. Only the text enters a score.
Scoring reads every text whole, in tasks.

Null texts are scored as empty ones. Ids that are null are held out. Of several labels of one id the mean counts
(0.5 and more: good); null labels are left out. Without labels of both kinds the score is their share, or 0.5.
Repeated rows each have a result; an empty table gives an empty result; other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import buffers, groups
from .pieces import release

WIDTH, STEP, BLOCK, FILTERS, EMBED = 8, 2, 32, 16, 6
SAMPLE, LONGEST = 2500, 32_768
FOLDS = 5


@dataclass
class Network:
    table: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    mean_w: np.ndarray
    max_w: np.ndarray
    shift: float


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each filled up with zero bytes to whole blocks; and their first blocks."""
    n = np.diff(offsets)
    blocks = -(-(n + WIDTH) // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(first[-1] * BLOCK + WIDTH, np.uint8)
    base = int(offsets[0])
    out[np.arange(base, int(offsets[-1])) + np.repeat(first[:-1] * BLOCK - offsets[:-1], n)] = data[base : int(offsets[-1])]
    return out, first


def _responses(table: np.ndarray, padded: np.ndarray, blocks: int) -> np.ndarray:
    """blocks x windows x FILTERS."""
    windows = blocks * (BLOCK // STEP)
    out = np.zeros((windows, FILTERS), np.float32)
    for j in range(WIDTH):
        out += table[j].take(padded[j : j + windows * STEP : STEP], axis=0)
    return out.reshape(blocks, BLOCK // STEP, FILTERS)


def _block_maxima(table: np.ndarray, padded: np.ndarray, blocks: int, step: int = 8192) -> np.ndarray:
    """The largest response in each block, for so many blocks at a time that a long text needs little memory."""
    parts = [_responses(table, padded[a * BLOCK :], min(step, blocks - a)).max(1) for a in range(0, blocks, step)]
    return np.concatenate(parts)


def _pooled(net: Network, top: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Chunk maxima (of a block and the next one of the text), their mean and maximum over each text."""
    inner = np.ones(len(top), bool)
    inner[first[1:] - 1] = False
    chunk = top.copy()
    at = np.flatnonzero(inner)
    chunk[at] = np.maximum(top[at], top[at + 1])
    act = np.maximum(chunk + net.bias, 0)
    n = np.diff(first)[:, None]
    return chunk, act, np.add.reduceat(act, first[:-1], axis=0, dtype=np.float64) / n, np.maximum.reduceat(act, first[:-1], axis=0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scores(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One probability for each text."""
    padded, first = _padded(data, offsets)
    top = _block_maxima(net.table, padded, int(first[-1]))
    _, _, mean, most = _pooled(net, top, first)
    return _sigmoid(mean @ net.mean_w + most @ net.max_w + net.shift)


def train(texts: list[bytes], good: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Network:
    """Fit by Adam on mini-batches; gradients follow the maxima back to the windows they came from."""
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)),
        "bias": np.zeros(FILTERS), "mean_w": rng.normal(0, 0.3, FILTERS), "max_w": rng.normal(0, 0.1, FILTERS),
        "shift": np.zeros(1)}
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0

    def net() -> Network:
        table = np.einsum("be,jef->jbf", p["embed"], p["filters"]).astype(np.float32)
        return Network(table, p["bias"].astype(np.float32), p["mean_w"], p["max_w"], float(p["shift"][0]))

    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])]).astype(np.int64)
            now = net()
            padded, first = _padded(data, offsets)
            r = _responses(now.table, padded, int(first[-1]))
            arg, top = r.argmax(1), r.max(1)
            chunk, act, mean, most = _pooled(now, top, first)
            out = _sigmoid(mean @ p["mean_w"] + most @ p["max_w"] + p["shift"][0])
            d = (out - good[rows]) / len(rows)
            n = np.diff(first)
            g_act = np.repeat(d / n, n)[:, None] * p["mean_w"]
            hit = act == np.repeat(most, n, axis=0)
            share = np.repeat(np.add.reduceat(hit, first[:-1], axis=0, dtype=np.float64), n, axis=0)
            g_act += np.repeat(d, n)[:, None] * p["max_w"] * hit / share
            g_act = g_act * (act > 0)
            from_next = np.zeros(chunk.shape, bool)
            from_next[:-1] = chunk[:-1] > top[:-1]
            g_top = np.where(from_next, 0, g_act)
            g_top[1:] += np.where(from_next, g_act, 0)[:-1]
            block, f = np.nonzero(g_top)
            at, g = block * BLOCK + arg[block, f] * STEP, g_top[block, f]
            g_table = np.stack([np.bincount(padded[at + j].astype(np.int64) * FILTERS + f, g, 256 * FILTERS) for j in range(WIDTH)])
            g_table = g_table.reshape(WIDTH, 256, FILTERS)
            grads = {
                "embed": np.einsum("jbf,jef->be", g_table, p["filters"]), "filters": np.einsum("jbf,be->jef", g_table, p["embed"]),
                "bias": g_act.sum(0), "mean_w": mean.T @ d, "max_w": most.T @ d, "shift": np.array([d.sum()])}
            step += 1
            for k, x in grads.items():
                x = x + 1e-4 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * x
                m2[k] = 0.999 * m2[k] + 0.001 * x * x
                p[k] -= rate * (1 - epoch / epochs) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return net()


def constant(share: float) -> Network:
    """A network that gives every text the same score."""
    zero = np.zeros(FILTERS)
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), zero.astype(np.float32), zero, zero, float(np.log(share / (1 - share))))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
           sample: int = SAMPLE, longest: int = LONGEST) -> Network:
    """The network trained on the bounded sample of labelled documents outside the held-out fold."""
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(
        (F.avg(label_col) >= 0.5).alias("_good"))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    # at most ``sample`` ids: a proven bound for the broadcast
    some = known.withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t")).where(F.octet_length("_t") <= longest).join(
        F.broadcast(some), "_id").select("_h", "_id", "_t", "_good").orderBy("_h", "_id", "_t").limit(sample).collect()
    good = np.array([float(x["_good"]) for x in rows])
    if not len(good) or good.min() == good.max():
        return constant(float(good.mean()) if len(good) else 0.5)
    return train([bytes(x["_t"]) for x in rows], good)


def scored(docs: DataFrame, net: Network, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns and the score of every whole text."""
    at = docs.columns.index(text_col)

    def run(batches) -> Iterator:
        import pyarrow as pa

        release()
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            parts = [scores(net, data, offsets[a : b + 1]) for a, b in groups(offsets)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], [*batch.schema.names, out])

    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{out}` double")
