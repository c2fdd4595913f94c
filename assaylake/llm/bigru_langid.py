"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of a bounded sample of
labelled documents. It labels every byte position of a text, reading it in both directions, and the
document's probability of a language is the mean over its positions. Its gates use the rational
sigmoid x / (1 + |x|), which costs one division where tanh costs several times that.

Bounded, as parameters: the training sample (``per_language`` windows of ``window`` bytes for each
language) and nothing else; prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.workers import giving_back, slices
from assaylake.session import ship_package

UNKNOWN = "und"
CHUNK, CONTEXT = 256, 16  # positions that a lane labels; bytes read before them in either direction
LANES = 1024
BATCH_BYTES = 1 << 22  # of text in a slice of a batch


class Network:
    """Two directions; per direction a byte table (inputs of gate and candidate), recurrent and output weights."""

    def __init__(self, languages: list[str], hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.languages, self.hidden = languages, hidden
        self.table = normal(2, 256, 2 * hidden, by=0.5)
        self.table[:, :, :hidden] -= 1.0  # gates start half closed: the state remembers
        self.recurrent = normal(2, hidden, 2 * hidden, by=hidden**-0.5)
        self.out = normal(2, hidden, len(languages), by=0.5)
        self.bias = np.zeros(len(languages), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.recurrent, self.out, self.bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss at every position of windows x (windows, bytes) of languages y, and its gradients."""
        n, length, k = *x.shape, self.hidden
        both = np.stack([x.T, x.T[::-1]])  # direction, step, window
        h = np.zeros((2, n, k), np.float32)
        states, squashed, widths = [h], [], []
        for t in range(length):
            a = np.stack([self.table[0, both[0, t]], self.table[1, both[1, t]]]) + h @ self.recurrent
            width = 1 + np.abs(a)
            s = a / width
            h = h + (0.5 + 0.5 * s[..., :k]) * (s[..., k:] - h)
            states.append(h)
            squashed.append(s)
            widths.append(width)
        seen = np.stack(states[1:], 1)  # direction, step, window, hidden
        logits = seen[0] @ self.out[0] + seen[1, ::-1] @ self.out[1] + self.bias
        p = np.exp(logits - logits.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        real = (x.T != 0).astype(np.float32)  # zero bytes stand for the space around a text
        real /= max(1.0, real.sum())
        loss = -(np.log(p[:, np.arange(n), y] + 1e-9) * real).sum()
        p[:, np.arange(n), y] -= 1
        d = p * real[..., None]
        d_out = np.stack([np.einsum("tnk,tnl->kl", seen[0], d), np.einsum("tnk,tnl->kl", seen[1, ::-1], d)])
        d_seen = np.stack([d @ self.out[0].T, (d @ self.out[1].T)[::-1]])
        d_recurrent, d_a, d_h = np.zeros_like(self.recurrent), np.empty((2, length, n, 2 * k), np.float32), np.zeros((2, n, k), np.float32)
        back = self.recurrent.transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            d_h = d_h + d_seen[:, t]
            before, s = states[t], squashed[t]
            z = 0.5 + 0.5 * s[..., :k]
            step = d_a[:, t]
            step[..., :k] = 0.5 * d_h * (s[..., k:] - before)
            step[..., k:] = d_h * z
            step /= widths[t] ** 2
            d_recurrent += before.transpose(0, 2, 1) @ step
            d_h = d_h * (1 - z) + step @ back
        flat = d_a.reshape(2, length * n, 2 * k)
        d_table = np.stack([np.stack([np.bincount(both[i].ravel(), flat[i, :, c], 256) for c in range(2 * k)], 1) for i in (0, 1)])
        return float(loss), [d_table, d_recurrent, d_out, d.sum((0, 1))]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int, seed: int, rate: float = 0.02) -> float:
        """Adam over random batches with a falling rate; returns the mean loss of the last tenth."""
        rng = np.random.default_rng(seed)
        mean, square, losses = [np.zeros_like(w) for w in self.weights()], [np.zeros_like(w) for w in self.weights()], []
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(x), batch)
            loss, grads = self.gradients(x[rows], y[rows])
            losses.append(loss)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
            for w, g, m, v in zip(self.weights(), grads, mean, square, strict=True):
                g = g / max(1.0, norm)
                m += 0.1 * (g - m)
                v += 0.01 * (g**2 - v)
                w -= (rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return float(np.mean(losses[-max(1, steps // 10) :]))

    def position_sums(self, lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per lane the sums of its positions' probabilities; lanes are (CONTEXT + CHUNK + CONTEXT) bytes.

        Arrays have a row per feature and a column per lane; one product gives a state's part of the
        next gates and its part of its own position's scores.
        """
        n, k, steps = len(lanes), self.hidden, CONTEXT + CHUNK
        ordered = np.ascontiguousarray(lanes.T).astype(np.intp)
        languages = len(self.languages)
        scores, total = np.empty((CHUNK, languages, n), np.float32), np.zeros((languages, n), np.float32)
        a, width, gate = np.empty((2 * k, n), np.float32), np.empty((2 * k, n), np.float32), np.empty((k, n), np.float32)
        part, candidate = np.empty((2 * k + languages, n), np.float32), a[k:]
        for way in (0, 1):
            table = np.ascontiguousarray(self.table[way].T)
            weights = np.ascontiguousarray(np.concatenate([self.recurrent[way], self.out[way]], 1).T)
            h = np.zeros((k, n), np.float32)
            for t in range(steps + 1):
                np.matmul(weights, h, out=part)
                if t > CONTEXT:
                    place = (t - 1 if way == 0 else len(ordered) - t) - CONTEXT
                    p = part[2 * k :]
                    if way == 0:
                        scores[place] = p
                    else:
                        p += scores[place]
                        p += self.bias[:, None]
                        np.exp(p, out=p)
                        p *= ((place < lengths) / p.sum(0)).astype(np.float32)
                        total += p
                if t == steps:
                    break
                np.take(table, ordered[t if way == 0 else len(ordered) - 1 - t], axis=1, out=a, mode="clip")
                a += part[: 2 * k]
                np.abs(a, out=width)
                width += 1
                a /= width
                np.multiply(a[:k], 0.5, out=gate)
                gate += 0.5
                candidate -= h
                candidate *= gate
                h += candidate
        return total.T

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text (none may be empty); whole texts, in lanes."""
        sizes = np.array([len(t) for t in texts])
        counts = -(-sizes // CHUNK)
        # Each text starts at a lane boundary of its own, CONTEXT zero bytes apart from its neighbours.
        starts = np.concatenate([[0], np.cumsum(counts * CHUNK + 2 * CONTEXT)[:-1]])
        flat = np.zeros(int((counts * CHUNK + 2 * CONTEXT).sum()), np.uint8)
        for t, s in zip(texts, starts.tolist(), strict=True):
            flat[s + CONTEXT : s + CONTEXT + len(t)] = np.frombuffer(t, np.uint8)
        owner = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = starts[owner] + number * CHUNK
        lengths = np.minimum(CHUNK, sizes[owner] - number * CHUNK)
        views = np.lib.stride_tricks.sliding_window_view(flat, CHUNK + 2 * CONTEXT)
        sums = np.concatenate([self.position_sums(views[begin[i : i + LANES]], lengths[i : i + LANES]) for i in range(0, len(begin), LANES)])
        return np.add.reduceat(sums, np.cumsum(counts) - counts, axis=0) / sizes[:, None]


def training_windows(labelled: DataFrame, per_language: int, window: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows of bytes and their languages: at most ``per_language`` of each language, one a text.

    labelled has text and lang, neither null. A text is drawn by its hash, and a text that repeats counts
    once: the share drawn follows the number of different texts of the language over all rows, and
    of what is drawn the least hashes stay.
    """
    texts = labelled.where("text <> ''").select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r.lang: r.n for r in texts.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((0, window), np.uint8), np.zeros(0, np.int64)
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, 1.5 * per_language / counts[k]))])
    draw = F.pmod("h", F.lit(1_000_003)) / 1_000_003
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - window)) + 1
    drawn = texts.where(draw <= F.element_at(share, F.col("lang"))).select("lang", "h", F.expr("text").substr(start.cast("int"), F.lit(window)).alias("text"))
    once = drawn.groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_003)), "h"))
    rows = once.withColumn("_place", place).where(F.col("_place") <= per_language).select("lang", "text")
    found = sorted((r.lang, r.text) for r in rows.collect())
    order = np.random.default_rng(5).permutation(len(found))
    x, y = np.zeros((len(found), window), np.uint8), np.zeros(len(found), np.int64)
    for i, at in enumerate(order):
        lang, text = found[at]
        raw = np.frombuffer(text.encode(), np.uint8)
        # Every other window is cut short and set between zero bytes, as short texts and the ends of long ones are.
        raw = raw[: window if i % 2 else 6 + i // 2 % (window - 12)]
        y[i] = languages.index(lang)
        x[i, (begin := (i // 2 % (window - len(raw) + 1))) : begin + len(raw)] = raw
    return languages, x, y


def with_split(docs: DataFrame, id_col: str = "doc_id", parts: int = 4, held: int = 2) -> DataFrame:
    """docs with held_out: whether the CRC-32 of the id's text has that remainder; a null id is held out."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == held, F.lit(True)))


def train(labelled: DataFrame, per_language: int = 1000, window: int = 64, hidden: int = 8, steps: int = 420, batch: int = 96, seed: int = 11) -> Network:
    """A network fitted to the text and lang of labelled."""
    languages, x, y = training_windows(labelled, per_language, window)
    net = Network(languages, hidden, seed)
    if languages:
        net.fit(x, y, steps, batch, seed)
    return net


def predict(docs: DataFrame, net: Network, text_col: str = "text", rows_at_once: int = 512, keep_text: bool = False) -> DataFrame:
    """The columns of docs (the text only where asked), with lang_pred and score.

    A null text or one without a letter has lang_pred "und" and score 0; so has every text when the
    network has learned no language. Otherwise score is the mean probability of lang_pred over all
    byte positions; ties go to the language that sorts first. Equal texts have equal results, repeated
    rows each get their own, an empty table gives an empty one, and columns that clash with the two
    new names are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(net)
    kept = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    own = [text_col, *kept] if keep_text else kept

    def label(texts: list[str | None]) -> tuple[list[str], list[float]]:
        model = shared.value
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        use = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.languages else []
        if use:
            means = model.probabilities([texts[i].encode() for i in use])
            for i, best, value in zip(use, means.argmax(1).tolist(), means.max(1).tolist(), strict=True):
                names[i], scores[i] = model.languages[best], min(1.0, round(value, 6))
        return names, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, BATCH_BYTES):
            names, scores = [], []
            for at in range(0, batch.num_rows, rows_at_once):
                found = label(batch.column(0).slice(at, rows_at_once).to_pylist())
                names += found[0]
                scores += found[1]
            yield pa.RecordBatch.from_arrays([*batch.columns[not keep_text :], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*own, "lang_pred", "score"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own), "lang_pred string", "score double"])
    return docs.select(text_col, *kept).mapInArrow(giving_back(run), schema)
