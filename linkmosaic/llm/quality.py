"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmosaic.llm.common import table
from linkmosaic.sources.shared import discard, materialize

TRAIN_DOCS = 4_000  # documents learnt from, at most
TRAIN_LINES = 200_000  # lines of all of them together, at most; one of over an eighth of that is not learnt from
N_OWN = 12  # features of one line


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 5, np.uint8)  # other signs
    kind[ord("A") : ord("Z") + 1] = 0
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[[9, 11, 12, 13, 32]] = 3
    kind[[ord(c) for c in ".,;:'\"-()?"]] = 4
    kind[128:] = 6
    return kind


_KIND = _byte_classes()


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, bytes of each line): features of a line's own characters and words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    lines = data.split(b"\n")
    n = len(lines)
    sizes = np.fromiter(map(len, lines), np.int64, n)
    raw = np.frombuffer(data, np.uint8)
    owner = np.repeat(np.arange(n), sizes + np.r_[np.ones(n - 1, np.int64), 0])
    counts = np.bincount(owner * 7 + _KIND[raw], minlength=7 * n).reshape(n, 7)
    counts[:-1, 5] -= 1  # the line ends
    words = [x.split() for x in lines]
    n_words = np.fromiter(map(len, words), np.float64, n)
    n_kinds = np.fromiter((len(set(w)) for w in words), np.float64, n)
    short = np.fromiter((sum(map((1).__eq__, map(len, w))) for w in words), np.float64, n)
    size, full = np.maximum(sizes, 1), np.maximum(n_words, 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    x = np.stack(
        [
            np.log1p(sizes) / 5,
            np.log1p(n_words) / 4,
            counts[:, 0] / letters,
            counts[:, 2] / size,
            counts[:, 4] / full,
            counts[:, 5] / full,
            (counts[:, 5] > 0.3 * full).astype(float),
            n_kinds / full,
            (n_kinds < 0.5 * full).astype(float),
            short / full,
            np.minimum(size / full, 40) / 10,
            (sizes == 0).astype(float),
        ],
        axis=1,
    )
    return x, sizes


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after, a bias, and whether the text begins or ends here."""
    n = len(x)
    before, after, edge = np.zeros_like(x), np.zeros_like(x), np.zeros((n, 3))
    before[1:], after[:-1] = x[:-1], x[1:]
    edge[:, 0], edge[0, 1], edge[-1, 2] = 1, 1, 1
    return np.concatenate([x, before, after, edge], axis=1)


@dataclass
class LineCrf:
    """weights: features -> log odds of good; steps: log weight of (bad, good) to (bad, good); scale: of the document's log odds."""

    weights: np.ndarray
    steps: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def marginals(self, seqs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Forward-backward over many texts at once: chance of good for each line; log partition; expected transitions."""
        lengths = np.array([len(s) for s in seqs])
        order = np.argsort(-lengths, kind="stable")
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        odds = (np.concatenate(seqs) @ self.weights) if len(seqs) else np.empty(0)
        longest = int(lengths.max(initial=0))
        live = np.array([(lengths > t).sum() for t in range(longest)], dtype=int)
        ahead = [np.empty((0, 2))] * longest
        put = lambda t: np.stack([np.zeros(live[t]), odds[starts[order[: live[t]]] + t]], axis=1)
        for t in range(longest):
            emit = put(t)
            if t:
                prev = ahead[t - 1][: live[t]]
                emit = emit + np.logaddexp(prev[:, :1] + self.steps[0], prev[:, 1:] + self.steps[1])
            ahead[t] = emit
        good, log_z, pairs = np.empty(len(odds)), np.zeros(len(seqs)), np.zeros((2, 2))
        back = np.zeros((0, 2))
        for t in range(longest - 1, -1, -1):
            now = np.zeros((live[t], 2))
            if len(back):
                m = len(back)
                later = back + put(t + 1)
                now[:m] = np.logaddexp(later[:, :1] + self.steps[:, 0], later[:, 1:] + self.steps[:, 1])
            both = ahead[t] + now
            z = np.logaddexp(both[:, 0], both[:, 1])
            good[starts[order[: live[t]]] + t] = np.exp(both[:, 1] - z)
            if len(back):
                joint = ahead[t][:m, :, None] + self.steps[None] + later[:, None, :]
                pairs += np.exp(joint - z[:m, None, None]).sum(0)
            if not t:
                log_z[order[: live[0]]] = z
            back = now
        return np.split(good, np.cumsum(lengths)[:-1]) if len(seqs) else [], log_z, pairs


def fit(seqs: list[np.ndarray], labels: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> LineCrf:
    """Largest penalised likelihood of chains whose lines all have their text's label, by Adam from zero."""
    n_features = seqs[0].shape[1] if seqs else 3 * N_OWN + 3
    theta = np.zeros(n_features + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    if not seqs:
        return LineCrf(theta[:-4], theta[-4:].reshape(2, 2))
    flat = np.concatenate(seqs)
    lengths = np.array([len(s) for s in seqs])
    truth = np.repeat(labels.astype(float), lengths)
    stay = np.array([((lengths - 1) * (labels == 0)).sum(), 0, 0, ((lengths - 1) * (labels == 1)).sum()], dtype=float)
    total = float(len(flat))
    for t in range(1, rounds + 1):
        crf = LineCrf(theta[:-4], theta[-4:].reshape(2, 2))
        good, _, pairs = crf.marginals(seqs)
        grad = np.concatenate([flat.T @ (truth - np.concatenate(good)), stay - pairs.ravel()]) / total - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -3, 3)
    return LineCrf(theta[:-4], theta[-4:].reshape(2, 2))


def document_odds(good: np.ndarray, sizes: np.ndarray) -> float:
    """Log odds of the mean chance of good, weighted by the lines' bytes."""
    w = np.maximum(sizes, 1)
    p = float(np.clip((good * w).sum() / w.sum(), 1e-6, 1 - 1e-6))
    return float(np.log(p / (1 - p)))


def calibrate(odds: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic fit of the labels on the documents' odds (Newton steps, slope kept above 0)."""
    x = np.stack([odds, np.ones(len(odds))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, x.T @ (labels - p) - 1e-2 * (w - [1, 0])), -1, 1)
    return max(float(w[0]), 1e-3), float(w[1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, seed: int = 0) -> LineCrf:
    """Fits on at most `most` labelled documents that are not held out, those with the smallest hash of doc_id.

    Whole texts are learnt from, in the order of the hashes as long as they have TRAIN_LINES lines together.
    The executors make the features; the driver gets those of at most so many lines.  No labels: a model
    that gives every text 1/2.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
    lines = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows_held = materialize(rows.withColumn("_lines", lines), "train")
    short = rows_held.filter(F.col("_lines") <= TRAIN_LINES // 8).groupBy("doc_id").agg(F.sum("_lines").alias("n"))
    # one row for each of at most `most` documents
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id"))
    fits = short.withColumn("so_far", so_far).filter(F.col("so_far") <= TRAIN_LINES).select("doc_id")
    rows = rows_held.join(F.broadcast(fits), "doc_id")

    def features(batches):
        for b in batches:
            out = []
            for q, text in zip(b["quality"], b["text"], strict=True):
                x, sizes = line_features(text)
                x = with_neighbours(x)
                out.append((int(q), x.astype("<f4").tobytes(), sizes.astype("<i8").tobytes()))
            yield pd.DataFrame(out, columns=["quality", "x", "sizes"])

    got = rows.mapInPandas(features, "quality int, x binary, sizes binary").toPandas()
    seqs = [np.frombuffer(x, "<f4").reshape(-1, 3 * N_OWN + 3).astype(float) for x in got["x"]]
    sizes = [np.frombuffer(s, "<i8") for s in got["sizes"]]
    y = (got["quality"].to_numpy() > 0).astype(int)
    discard(rows_held)
    crf = fit(seqs, y)
    if seqs:
        odds = np.array([document_odds(g, s) for g, s in zip(crf.marginals(seqs)[0], sizes, strict=True)])
        crf.scale = calibrate(odds, y)
    return crf


def score_texts(crf: LineCrf, texts) -> np.ndarray:
    made = [line_features(t) for t in texts]
    good = crf.marginals([with_neighbours(x) for x, _ in made])[0]
    odds = np.array([document_odds(g, s) for g, (_, s) in zip(good, made, strict=True)])
    return 1 / (1 + np.exp(-np.clip(crf.scale[0] * odds + crf.scale[1], -30, 30)))


def score_documents(documents: DataFrame, crf: LineCrf) -> DataFrame:
    """All columns of documents and `score`, the chance of label 1; every line of every whole text counts.

    A null or empty text is one empty line and gets that line's score.  Without labels to learn from, all
    scores are 1/2.  Repeated rows are scored each on its own.
    """
    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            parts = [score_texts(crf, texts.slice(lo, 256).to_pylist()) for lo in range(0, len(texts), 256)]
            scores = pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], [*b.schema.names, "score"])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField("score", T.DoubleType())]))


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    crf = train(documents, labels)
    scored = score_documents(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), crf)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See score_documents and train; no documents: no rows."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
