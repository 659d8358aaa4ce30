"""Quality classifier: gated attention over the passages of a document (multiple-instance learning)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import small, stored

#: Shapes of characters: space, line break, lower, upper, digit, sentence mark, other mark, letter beyond ASCII.
SHAPES = 8
_SPACE, _BREAK, _LOWER, _UPPER, _DIGIT, _POINT, _MARK, _BEYOND = range(SHAPES)
_OF_BYTE = np.full(128, _MARK, np.int64)
for _shape, _chars in (
    (_SPACE, " \t\r\f\v"),
    (_BREAK, "\n"),
    (_LOWER, "abcdefghijklmnopqrstuvwxyz"),
    (_UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (_DIGIT, "0123456789"),
    (_POINT, ".,;:?'\"()-"),
):
    _OF_BYTE[[ord(c) for c in _chars]] = _shape
EXTRA = 4
WIDTH = SHAPES * SHAPES + EXTRA
_BLANK = regex.compile(r"\s")
_CHUNK = 1 << 20


def _encode_piece(text: str, passage: int) -> np.ndarray:
    words = text.split()
    if not words:
        return np.zeros((0, WIDTH))
    n = max(1, round(len(words) / passage))
    of_word = np.arange(len(words)) * n // len(words)
    codes = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    shapes = np.where(codes < 128, _OF_BYTE[np.minimum(codes, 127)], _BEYOND)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    of_char = np.repeat(of_word, lengths + 1)[:-1]
    pairs = of_char[:-1] * SHAPES * SHAPES + shapes[:-1] * SHAPES + shapes[1:]
    counts = np.bincount(pairs, minlength=n * SHAPES * SHAPES).reshape(n, -1)
    out = np.zeros((n, WIDTH))
    out[:, :-EXTRA] = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    size = np.bincount(of_word, minlength=n)
    lowered = np.array([hash_word(w) for w in words])
    first = np.unique(of_word * (1 << 32) + lowered, return_index=True)[1]
    out[:, -4] = np.bincount(of_word, lengths, n) / size / 10  # letters a word
    out[:, -3] = np.bincount(of_word[first], minlength=n) / size  # different words within the passage
    once = np.unique(lowered, return_index=True)[1]
    out[:, -2] = np.bincount(of_word[once], minlength=n) / size  # words that are new to the text
    out[:, -1] = np.minimum(size, passage) / passage
    return out


def hash_word(word: str) -> int:
    """A 32-bit hash of a word that is the same in every process."""
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))


def encode(text: str | None, passage: int = 50) -> np.ndarray:
    """A row of WIDTH numbers for each passage of about passage words of the whole text: shares of the pairs
    of neighbouring character shapes, and word length, variety and number. A text without words has
    one row of zeros."""
    text, parts, at = text or "", [], 0
    while at < len(text):
        cut = _BLANK.search(text, at + _CHUNK)
        end = cut.end() if cut else len(text)
        parts.append(_encode_piece(text[at:end], passage))
        at = end
    rows = np.concatenate(parts) if parts else np.zeros((0, WIDTH))
    return rows if len(rows) else np.zeros((1, WIDTH))


@dataclass
class Model:
    """Gated attention: weights softmax(w . (tanh(V h) * sigmoid(U h))) over a document's passages h; the score is
    the logistic function of c . (weighted mean of h) + b."""

    mean: np.ndarray
    scale: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: float
    passage: int = 50

    def parts(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the passages h of documents that begin at starts: gates, attention, representations and scores."""
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-np.clip(h @ self.u, -30, 30)))
        e = (t * g) @ self.w
        sizes = np.diff(np.append(starts, len(h)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ self.c + self.b, -30, 30)))

    def score(self, text: str | None) -> float:
        h = np.clip((encode(text, self.passage) - self.mean) / self.scale, -8, 8)
        return float(self.parts(h, np.zeros(1, np.int64))[-1][0])


def train(bags: list[np.ndarray], labels: np.ndarray, *, passage: int, hidden: int = 16, epochs: int = 40, rate: float = 0.01, decay: float = 1e-3, batch: int = 64, seed: int = 11) -> Model:
    """Fits a Model to bags of passages and their documents' labels (0 or 1), by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    everything = np.concatenate(bags)
    mean, scale = everything.mean(axis=0), everything.std(axis=0)
    scale = np.where(scale < 1e-6, 1.0, scale)
    bags = [np.clip((x - mean) / scale, -8, 8) for x in bags]
    d = everything.shape[1]
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    m = Model(mean, scale, rng.normal(0, d**-0.5, (d, hidden)), rng.normal(0, d**-0.5, (d, hidden)), rng.normal(0, hidden**-0.5, hidden), np.zeros(d), float(np.log(share / (1 - share))), passage)
    names = ("v", "u", "w", "c", "b")
    first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            sizes = np.array([len(bags[i]) for i in own])
            starts = np.append(0, np.cumsum(sizes)[:-1])
            h = np.concatenate([bags[i] for i in own])
            t, g, a, z, p = m.parts(h, starts)
            off = (p - labels[own]) / len(own)
            toward = off[:, None] * m.c
            along = (np.repeat(toward, sizes, axis=0) * h).sum(axis=1)
            e = a * (along - np.repeat((toward * z).sum(axis=1), sizes))
            inner = e[:, None] * m.w
            grads = {
                "v": h.T @ (inner * g * (1 - t * t)) + decay * m.v,
                "u": h.T @ (inner * t * g * (1 - g)) + decay * m.u,
                "w": (t * g).T @ e + decay * m.w,
                "c": z.T @ off + decay * m.c,
                "b": off.sum(),
            }
            step += 1
            for k, grad in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                change = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(m, k, getattr(m, k) - change)
    return m


def fit(docs: DataFrame, labels: DataFrame, *, max_documents: int = 4_000, max_passages: int = 200_000, passage: int = 50) -> Model | None:
    """A Model of labels (doc_id, label 0 or 1) for docs (doc_id, text); None without both labels.

    A bounded sample of the labelled rows teaches it: those whose hashed doc_id is smallest, at most max_documents rows, and as
    many of these in that order as have max_passages passages together; each teaches with all its passages.
    Rows with more than a twentieth of max_passages are not drawn. Null ids and labels
    teach nothing; a document with repeated rows teaches as often. Only the sample reaches the driver.
    """
    known = stored(labels.where("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")), "labels")
    n = known.count()
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    # By expectation somewhat more than are wanted; the order of the hashes then decides exactly.
    chosen = stored(known.where(draw < 1.2 * max_documents / max(n, 1) + 20 / max(n, 1)), "chosen-labels")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [encode(t.as_py(), passage) for t in batch.column("text")]
            sizes = pa.array([len(r) for r in rows], pa.int64())
            rows = pa.array([r.astype(np.float32).tobytes() if len(r) <= max_passages // 20 else b"" for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("label"), sizes, rows], ["h", "label", "size", "bag"])

    teach = docs.select("doc_id", "text").join(small(chosen, 4 * max_documents), "doc_id").select(F.xxhash64("doc_id").alias("h"), "label", "text")
    bagged = stored(teach.mapInArrow(bags, "h long, label int, size long, bag binary").where(F.length("bag") > 0), "labelled-bags")
    order = (F.shiftrightunsigned("h", 11), F.xxhash64("bag"), F.col("label"))
    sizes = [r["size"] for r in bagged.select("size", *[c.alias(f"o{i}") for i, c in enumerate(order)]).orderBy("o0", "o1", "o2").limit(max_documents).collect()]
    rows = bagged.orderBy(*order).limit(int((np.cumsum(sizes) <= max_passages).sum())).select("label", "bag").collect()
    rows = sorted((bytes(r["bag"]), r["label"]) for r in rows)  # in an order of their own
    y = np.array([label for _, label in rows], float)
    if not rows or y.min() == y.max():
        return None
    return train([np.frombuffer(b, np.float32).reshape(-1, WIDTH).astype(float) for b, _ in rows], y, passage=passage)


def score_quality(docs: DataFrame, model: Model | None, *, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted), a row for each row of docs (doc_id, text); other columns are ignored.

    score is the chance of label 1 from 0 to 1, from the whole text; null and empty texts, which have one passage of zeros,
    get one too, and every text gets 0.5 without a model. predicted is 1 from threshold on, else 0.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) if model else 0.5 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
