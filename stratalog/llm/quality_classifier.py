"""Text quality by weak supervision.

Overlapping heuristic labellers vote good, bad or nothing on each document. A label model takes the votes to come from labellers of unknown accuracy that err independently, and expectation-maximisation over the counts of vote patterns finds the accuracies and the share of good documents, without true labels. Its posteriors are the soft labels that a linear scorer over hashed features is trained on; the scorer judges every document, also those on which nobody votes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample, slices

#: Documents that the scorer is fitted on, at most, drawn by a hash.
MOST_FITTED = 6000
BUCKETS = 1 << 16
STEPS = 250
ROUNDS = 200
THRESHOLD = 0.5
GOOD, BAD, NONE = 1, 0, 2

# Frequent words of the languages that the labellers know.
STOP_WORDS = frozenset(
    "a al and are as at avec be by con das de del den der des die du ein el en est et for from in is it la las le les los nicht of on or para por pour que qui se sich sur the this to un una und une von was with y zu".encode().split()
)


def measures(text: bytes) -> dict[str, float]:
    """What the labellers look at; shares are of words or characters."""
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    letters = len(text.translate(None, bytes(range(0x41)) + b"[\\]^_`{|}~\x7f"))
    return {
        "n": len(words),
        "length": sum(map(len, words)) / n,
        "symbols": (len(text) - len(text.translate(None, b"#*$%&|<>"))) / n,
        "upper": sum(w.isupper() and len(w) > 1 for w in words) / n,
        "stops": sum(c for w, c in counts.items() if w.lower().strip(b".,") in STOP_WORDS) / n,
        "distinct": len(counts) / n,
        "again": sum(map(bytes.__eq__, words, words[1:])) / n,
        "most": max(counts.values(), default=0) / n,
        "ends": sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"', b":") for x in lines) / max(1, len(lines)),
        "same_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "letters": letters / max(1, len(text)),
    }


def _vote(value: float, bad_from: float, good_to: float) -> int:
    return BAD if value >= bad_from else GOOD if value <= good_to else NONE


#: Words under which labellers that go by shares of words or lines don't vote.
FEW = 12


def _enough(vote):
    return lambda m: vote(m) if m["n"] >= FEW else NONE


LABELLERS = (
    ("length", lambda m: GOOD if m["n"] >= 40 else NONE),
    ("word_length", lambda m: GOOD if 2 <= m["length"] <= 12 else BAD),
    ("symbols", lambda m: _vote(m["symbols"], 0.2, 0.02)),
    ("shouting", lambda m: _vote(m["upper"], 0.3, 0.05)),
    ("stop_words", _enough(lambda m: GOOD if m["stops"] >= 0.1 else BAD if m["stops"] < 0.03 else NONE)),
    ("stutter", _enough(lambda m: _vote(m["again"], 0.1, 0.01))),
    ("variety", _enough(lambda m: BAD if m["distinct"] < 0.25 else GOOD if m["distinct"] > 0.4 else NONE)),
    ("one_word", _enough(lambda m: _vote(m["most"], 0.2, 0.1))),
    ("line_ends", _enough(lambda m: GOOD if m["ends"] >= 0.6 else BAD if m["ends"] < 0.1 else NONE)),
    ("same_lines", _enough(lambda m: _vote(m["same_lines"], 0.3, 0.02))),
    ("letters", lambda m: GOOD if m["letters"] >= 0.75 else BAD if m["letters"] < 0.65 else NONE),
)


def votes(m: dict[str, float]) -> list[int]:
    """The labellers' votes on a text with these measures."""
    return [f(m) for _, f in LABELLERS]


def pattern(v: list[int]) -> int:
    return sum(x * 3**i for i, x in enumerate(v))


def unpack(p: int, k: int = len(LABELLERS)) -> list[int]:
    return [p // 3**i % 3 for i in range(k)]


class LabelModel:
    """For each labeller that votes, the chances of its votes on bad and on good documents, and the share of good ones. That a labeller doesn't vote tells nothing: its chance counts as 1."""

    def __init__(self, chances: np.ndarray, share: float):
        self.chances, self.share = chances, share

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Chance that each row of votes comes from a good document."""
        at = np.arange(v.shape[1])
        good = np.log(self.share) + np.log(self.chances[1][at, v]).sum(1)
        bad = np.log(1 - self.share) + np.log(self.chances[0][at, v]).sum(1)
        return 1 / (1 + np.exp(np.clip(bad - good, -40, 40)))


def fit_labels(v: np.ndarray, count: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts; it starts from the majority of the votes, which also says which side is good. Without patterns nothing is known of any labeller."""
    k = v.shape[1]
    if not len(v):
        return LabelModel(np.ones((2, k, 3)), 0.5)
    cast = np.maximum(1, (v != NONE).sum(1))
    q = np.clip((v == GOOD).sum(1) / cast, 0.05, 0.95) ** 2
    model = None
    for _ in range(rounds):
        chances = np.empty((2, k, 3))
        for side, w in ((0, count * (1 - q)), (1, count * q)):
            for x in (BAD, GOOD):
                chances[side, :, x] = (w[:, None] * (v == x)).sum(0) + 1
            chances[side, :, :NONE] /= chances[side, :, :NONE].sum(1, keepdims=True)
            chances[side, :, NONE] = 1
        model = LabelModel(chances, float(np.clip((count * q).sum() / count.sum(), 0.01, 0.99)))
        new = model.posterior(v)
        if np.abs(new - q).max() < 1e-7:
            break
        q = new
    return model


#: Letters, digits and others of a word, each kind alike.
_SHAPE = bytes(0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b > 0x7F else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))


def features(text: bytes, m: dict[str, float]) -> np.ndarray:
    """Buckets of a text with measures m: its distinct words' shapes and ends, and its measures in steps."""
    words = set(text.split())
    found = {b"s" + s for s in {w.translate(_SHAPE)[-6:] for w in words}} | {b"e" + e for e in {w[-4:] for w in words}}
    for name, x in m.items():
        step = min(40, int(np.log2(1 + x) * 3)) if name in ("n", "length") else int(x * 20)
        found.add(f"m{name}{step}".encode())
    return np.unique(np.array([zlib.crc32(f) % BUCKETS for f in found], np.int64))


def fit_scorer(own: list[np.ndarray], soft: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of a logistic scorer of texts' buckets on soft labels, by full-batch steps over length-normalised features."""
    w, b = np.zeros(BUCKETS), 0.0
    if not own:
        return w, b
    n = np.array([len(x) for x in own])
    row, col, val = np.repeat(np.arange(len(own)), n), np.concatenate(own), np.repeat(1 / np.sqrt(n), n)
    m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    # Both sides weigh alike.
    weight = np.where(soft > 0.5, 0.5 / max(1e-9, (soft > 0.5).mean()), 0.5 / max(1e-9, (soft <= 0.5).mean())) / len(own)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col] * val, len(own)), -40, 40)))
        g = (p - soft) * weight
        grad = np.append(np.bincount(col, g[row] * val, BUCKETS) + 1e-6 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def label(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pattern): the labellers' votes on every row, as one integer in base 3. Null reads as empty."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pattern(votes(measures(t))) for t in texts], pa.int32())], names=["id", "pattern"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, pattern int")


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST_FITTED) -> tuple[LabelModel, np.ndarray, float]:
    """The label model, from the votes on all rows, and the scorer, from at most `most` rows drawn by a hash.

    What reaches the driver is one count per vote pattern, of which there are at most 3 ** labellers, and the drawn rows' patterns and buckets, which are made where the rows are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                found = [measures(t) for t in texts]
                own = [features(t, m).astype(np.int32) for t, m in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pattern(votes(m)) for m in found], pa.int32()), pa.array(own, pa.list_(pa.int32()))], names=["h", "pattern", "buckets"])

    counts = label(docs, doc_id, text).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    model = fit_labels(np.array([unpack(r.pattern) for r in counts], np.int64).reshape(-1, len(LABELLERS)), np.array([r.n for r in counts], float))
    drawn = sample(docs, doc_id, text, most).mapInArrow(run, "h long, pattern int, buckets array<int>").toArrow().sort_by("h")
    soft = model.posterior(np.array([unpack(p) for p in drawn.column("pattern").to_pylist()], np.int64).reshape(-1, len(LABELLERS)))
    return model, *fit_scorer([np.array(x, np.int64) for x in drawn.column("buckets").to_pylist()], soft)


def margin(w: np.ndarray, b: float, buckets: np.ndarray) -> float:
    """What the scorer's logistic function takes: the mean, by the root of their number, of a text's weights."""
    return float(b + w[buckets].sum() / np.sqrt(max(1, len(buckets))))


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST_FITTED) -> DataFrame:
    """(id, pattern, posterior, score) of every row: votes, the label model's chance of good and the scorer's.

    Null reads as empty; a text of any length is read whole, and at most one long text is held besides; rows that repeat are scored each, and vote each; other columns, of whatever names, are left out; an empty table gives an empty one. Measures are taken once for a text's votes and features.
    """
    context = docs.sparkSession.sparkContext
    held = context.broadcast(train(docs, doc_id, text, most))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, w, b = held.value
        for batch in batches:
            for part, texts in slices(batch, 1):
                found = [measures(t) for t in texts]
                v = np.array([votes(m) for m in found], np.int64).reshape(-1, len(LABELLERS))
                margins = np.array([margin(w, b, features(t, m)) for t, m in zip(texts, found, strict=True)], float)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([pattern(x) for x in v.tolist()], pa.int32()), pa.array(model.posterior(v)), pa.array(1 / (1 + np.exp(-np.clip(margins, -40, 40))))],
                    names=["id", "pattern", "posterior", "score"],
                )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, pattern int, posterior double, score double")


def op4_quality_classifier(docs: DataFrame) -> DataFrame:
    """doc_id, pattern, posterior, score, kept of every document; a score of THRESHOLD itself is kept."""
    return classify(docs).select(F.col("id").alias("doc_id"), "pattern", "posterior", "score", (F.col("score") >= THRESHOLD).alias("kept"))
