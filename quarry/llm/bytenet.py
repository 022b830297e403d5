"""Quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are embedded; one more channel tells whether the same GRAM bytes
also began within the LOOKBACK bytes before.  Learned filters of WIDTH bytes slide over the whole
text in steps of STRIDE.  The text is covered by overlapping chunks; each filter's
positive part is max-pooled over a chunk, and the chunks' maxima are combined, by their
mean and their maximum, into one logit and one probability.

The network is fitted on the driver on at most ``per_class`` labelled documents of each
class, of long ones on a stretch of at most ``longest_sample`` bytes; classes weigh the
same.  Scores see whole texts and nothing else.

A null text is scored as an empty one, by the padding alone.  Without labelled rows of
both classes all scores are 0.5.  Of conflicting labels of one id the least counts;
null ids and null labels are not learned from.  Repeated rows get equal scores; other
columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import chunks, discard, table

WIDTH, STRIDE, FILTERS, EMBEDDING = 8, 2, 16, 5
#: Windows of a chunk and of the part that it shares with the next: 512 and 64 bytes.
CHUNK, OVERLAP = 256, 32
GRAM, LOOKBACK = 4, 24
#: Zero bytes before each text: a multiple of STRIDE that hides the text before from every window and comparison.
BEFORE = WIDTH + LOOKBACK
#: Windows that are held at a time.
WINDOWS = 1 << 15


def repeats(data: np.ndarray) -> np.ndarray:
    """1 where the GRAM bytes from here also begin within the LOOKBACK bytes before."""
    out = np.zeros(len(data), dtype=np.float32)
    n = len(data) - GRAM + 1
    if n <= 0:
        return out
    wide = data.astype(np.uint32)
    gram = wide[:n] | wide[1 : n + 1] << 8 | wide[2 : n + 2] << 16 | wide[3 : n + 3] << 24
    seen = np.zeros(n, dtype=bool)
    for lag in range(1, min(LOOKBACK, n - 1) + 1):
        seen[lag:] |= gram[lag:] == gram[:-lag]
    out[:n] = seen
    return out


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts end to end, and the first window of each and the one past its last.

    BEFORE zero bytes stand before each text, so that no answer depends on the text
    before; windows begin where their last bytes are the text's first.
    """
    sizes = np.array([(len(t) + STRIDE - 1) // STRIDE * STRIDE for t in texts], dtype=np.int64)
    begin = np.r_[0, np.cumsum(sizes + BEFORE)][:-1] + BEFORE
    data = np.zeros(int((sizes + BEFORE).sum()) + BEFORE, dtype=np.uint8)
    for lo, t in zip(begin, texts, strict=True):
        data[lo : lo + len(t)] = np.frombuffer(t, np.uint8)
    return data, (begin - WIDTH + STRIDE) // STRIDE, (begin + np.maximum(sizes, STRIDE)) // STRIDE


def spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, end and text of each chunk of the texts' windows [begin, end)."""
    count = np.maximum(1, -(-(end - begin - OVERLAP) // (CHUNK - OVERLAP)))
    text = np.repeat(np.arange(len(begin)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = begin[text] + k * (CHUNK - OVERLAP)
    return first, np.minimum(first + CHUNK, end[text]), text


@dataclass
class Net:
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    base: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Net:
        inputs = WIDTH * (EMBEDDING + 1)
        return cls(rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), rng.normal(0, inputs**-0.5, (inputs, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32))

    def windows(self, data: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Inputs of the windows [lo, hi), a row for each."""
        a, b = lo * STRIDE, (hi - 1) * STRIDE + WIDTH
        early = max(0, a - LOOKBACK)
        again = repeats(data[early : b + GRAM - 1])[a - early : b - early]
        x = np.column_stack([self.embedding[data[a:b]], again])
        return np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=0)[::STRIDE].transpose(0, 2, 1).reshape(hi - lo, -1)

    def maxima(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The largest answer of each filter in each chunk, before the bias."""
        out = np.empty((len(first), FILTERS), dtype=np.float32)
        lo = 0
        while lo < len(first):
            hi = max(lo + 1, int(np.searchsorted(end, first[lo] + WINDOWS, side="right")))
            answers = self.windows(data, int(first[lo]), int(end[hi - 1])) @ self.filters
            edges = np.column_stack([first[lo:hi], end[lo:hi]]).ravel() - first[lo]
            answers = np.vstack([answers, answers[-1:]])  # an end is an index too
            out[lo:hi] = np.maximum.reduceat(answers, edges, axis=0)[::2]
            lo = hi
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        data, begin, stop = padded(texts)
        first, end, text = spans(begin, stop)
        pooled = np.maximum(self.maxima(data, first, end) + self.bias, 0)
        edge = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        count = np.diff(np.r_[edge, len(text)])
        mean, most = np.add.reduceat(pooled, edge, axis=0) / count[:, None], np.maximum.reduceat(pooled, edge, axis=0)
        logit = np.hstack([mean, most]).astype(np.float64) @ self.dense.astype(np.float64) + float(self.base[0])
        return squash(logit).round(6)  # the last digits depend on what is multiplied together


def squash(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, *, epochs: int = 14, batch: int = 32, rate: float = 0.02, seed: int = 7) -> Net:
    """Gradient descent with moments on the weighted cross-entropy; a filter's gradient goes to its largest window of a chunk."""
    rng = np.random.default_rng(seed)
    net = Net.fresh(rng)
    values = [net.embedding, net.filters, net.bias, net.dense, net.base]
    first_moment, second_moment = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    weight = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels != 1).mean())
    step, total = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(texts), batch):
            rows = order[lo : lo + batch]
            data, begin, stop = padded([texts[k] for k in rows])
            first, end, text = spans(begin, stop)
            x = net.windows(data, 0, int(end[-1]))
            answers = x @ net.filters
            at = np.stack([a + answers[a:b].argmax(0) for a, b in zip(first, end, strict=True)])
            pooled = np.maximum(answers[at, np.arange(FILTERS)] + net.bias, 0)
            edge = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            count = np.diff(np.r_[edge, len(text)])
            mean, most = np.add.reduceat(pooled, edge, axis=0) / count[:, None], np.maximum.reduceat(pooled, edge, axis=0)
            both = np.hstack([mean, most])
            slope = ((squash(both @ net.dense + net.base[0]) - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            to_dense, to_base = both.T @ slope + 1e-4 * net.dense, slope.sum(keepdims=True)
            back = slope[:, None] * net.dense[None]
            to_pooled = (back[:, :FILTERS] / count[:, None])[text] + np.where(pooled == most[text], back[text, FILTERS:], 0)
            to_pooled *= pooled > 0
            to_filters, to_embedding = np.zeros_like(net.filters), np.zeros_like(net.embedding)
            for f in range(FILTERS):
                live = np.flatnonzero(to_pooled[:, f])
                if not len(live):
                    continue
                spot = at[live, f, None] * STRIDE + np.arange(WIDTH)
                to_filters[:, f] = to_pooled[live, f] @ x[at[live, f]]
                grad = to_pooled[live, f, None, None] * net.filters[:, f].reshape(WIDTH, -1)[None, :, :EMBEDDING]
                np.add.at(to_embedding, data[spot], grad)
            step += 1
            pace = rate * min(1.0, 4 * (1 - (step - 1) / total)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for v, g, m, s in zip(values, (to_embedding, to_filters, to_pooled.sum(0), to_dense, to_base), first_moment, second_moment, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= pace * m / (np.sqrt(s) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 1000, longest_sample: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Net | None:
    """Fit on at most ``per_class`` rows of ``docs`` with each label (0 and 1), picked by hashes; None unless both classes have some."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # a share of the ids that gives four times as many as are kept; of their rows the first by a hash of id and text, however many repeat
    share = F.create_map([F.lit(x) for label, n in {0: 1, 1: 1, **sizes}.items() for x in (label, min(1 << 20, -(-(per_class * 4 << 20) // n)))])
    some = known.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) < share[F.col("label")])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(some), "id")  # some 8 * per_class ids
    start = F.pmod(F.xxhash64("id", F.lit(19)), F.greatest(F.length("text") - longest_sample + 1, F.lit(1))).cast("int") + 1
    rows = table(rows.select("label", F.xxhash64("id", "text").alias("h"), F.substring("text", start, F.lit(longest_sample)).alias("text")), "sample")
    texts = [(label, r["text"].encode()[:longest_sample]) for label in (0, 1) for r in rows.where(F.col("label") == label).orderBy("h", "text").limit(per_class).collect()]
    discard(rows)
    found = np.array([label for label, _ in texts], dtype=np.float32)
    return fit([t for _, t in texts], found) if len(set(found.tolist())) == 2 else None


def score(df: DataFrame, net: Net | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score of each row: the probability of label 1."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", 1 << 18):
            texts = [v or b"" for v in chunk.column(1).cast(pa.binary()).to_pylist()]
            scores = net.score(texts) if net else np.full(len(texts), 0.5)
            yield pa.record_batch([chunk.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(answer, f"id {kind}, score double").withColumnRenamed("id", id_col)
