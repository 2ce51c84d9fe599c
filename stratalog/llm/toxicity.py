"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positive sample; texts of the corpus, toxic ones among them, are the unlabelled one. With the class prior p, the risk of calling clean texts toxic is estimated as (risk on unlabelled) - p * (risk on positives); where that falls below zero the step goes against it, so that the estimate stays non-negative. The classifier is linear over hashed features of the distinct words: the word and its character n-grams with marked ends. Its logistic output is the score; labels of clean texts are used for nothing but the class prior.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, keep_rows, least, slices

#: Documents fitted on, at most, unless train() is told otherwise: confirmed toxic ones and unlabelled ones.
MOST_POSITIVE = 2500
MOST_UNLABELLED = 5000
#: Parts that the drawn documents, whose number is bounded, are dealt to.
PARTS = 12
BUCKETS = 1 << 18
NGRAMS = (4, 5, 6, 7)
#: A feature is used if its share among positives is at least LIFT times that among unlabelled texts, with a z score of at least Z.
LIFT = 3.0
Z = 3.5
STEPS = 300
RATE = 0.05
DECAY = 2e-5
THRESHOLD = 0.7
#: Words that a worker keeps the features of before it starts anew.
KEPT_WORDS = 250_000
#: The same while features are counted, where each word holds a list of them.
KEPT_LISTS = 40_000

#: Bytes of the longest word that a worker keeps the features of.
KEPT_BYTES = 64
#: Bytes of a word whose n-grams are held at a time.
GRAM_BYTES = 1 << 16

#: ASCII characters other than letters and digits become spaces.
_WORDS = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256))


#: Other blanks, controls and punctuation, and the zero-width space and mark.
_BREAKS = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c)[0] in "ZP" or unicodedata.category(c) == "Cc" or c in "\u200b\ufeff") + "]+")


def words_of(text: bytes) -> set[bytes]:
    """The distinct lower-cased words, between blanks and punctuation of any script."""
    words = set(text.decode().lower().encode().translate(_WORDS).split())
    for w in [w for w in words if not w.isascii()]:
        parts = _BREAKS.split(w.decode())
        if len(parts) > 1:
            words.remove(w)
            words.update(p.encode() for p in parts if p)
    return words


def features(word: bytes) -> list[int]:
    """Hashed features of a word: itself, and its n-grams with an end mark on each side."""
    marked = b"<" + word + b">"
    if len(marked) > GRAM_BYTES:
        found = {zlib.crc32(marked + b"#") % BUCKETS}
        for at in range(0, len(marked), GRAM_BYTES):
            block = marked[at : at + GRAM_BYTES + max(NGRAMS) - 1]
            found.update(zlib.crc32(block[i : i + n]) % BUCKETS for n in NGRAMS for i in range(min(GRAM_BYTES, len(block) - n + 1)))
        return list(found)
    grams = {marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1)}
    return [zlib.crc32(g) % BUCKETS for g in (marked + b"#", *grams)]


def _found(words: set[bytes], memo: dict, of) -> set[int]:
    """All that `of` gives for the words; it is kept in memo for those that aren't long."""
    out: set[int] = set()
    short = set()
    for w in words:
        if len(w) <= KEPT_BYTES:
            short.add(w)
        else:
            out.update(of(w) or ())
    for w in short.difference(memo):
        memo[w] = of(w)
    return out.union(*filter(None, map(memo.__getitem__, short)))


class Model:
    """Weights by bucket. The logistic function of a margin is the chance that a text is toxic."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self._memo: dict[bytes, tuple[int, ...] | None] = {}

    def __reduce__(self):
        """What is kept of words stays where it was gathered."""
        return Model, (self.weights, self.bias)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """The bias, and the weights of each text's distinct features over the root of their number."""
        memo = self._memo
        get = self.weights.get
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            words = words_of(text)
            if len(memo) > KEPT_WORDS:
                memo.clear()
            found = _found(words, memo, lambda w: tuple(f for f in features(w) if f in self.weights) or None)
            out[i] = self.bias + sum(map(get, found)) / max(1, len(found)) ** 0.5
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -40, 40)))


def _counts(texts: list[bytes]) -> np.ndarray:
    """In how many texts each bucket occurs."""
    memo: dict[bytes, list[int]] = {}
    out = np.zeros(BUCKETS)
    for text in texts:
        words = words_of(text)
        found = _found(words, memo, features)
        out[np.fromiter(found, np.int64, len(found))] += 1
        if len(memo) > KEPT_LISTS:
            memo.clear()
    return out


def _rows(texts: list[bytes], chosen: dict[int, int]) -> list[list[int]]:
    """The columns of the chosen buckets in each text; chosen has the column of a bucket."""
    memo: dict[bytes, tuple[int, ...] | None] = {}
    out = []
    for text in texts:
        words = words_of(text)
        if len(memo) > KEPT_WORDS:
            memo.clear()
        out.append(sorted(_found(words, memo, lambda w: tuple(chosen[f] for f in features(w) if f in chosen) or None)))
    return out


def choose(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """The buckets that tell positives from unlabelled texts, from the number of texts that have each."""
    if not n_p or not n_u:
        return np.zeros(0, np.int64)
    share, back = in_p / n_p, (in_u + 0.5) / (n_u + 1)
    z = (share - back) / np.sqrt(back * (1 - np.minimum(back, 0.999)) / n_p)
    return np.flatnonzero((in_p >= 2) & (share >= LIFT * back) & (z >= Z))


def risk(w: np.ndarray, b: float, positive: tuple[np.ndarray, np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray, np.ndarray], prior: float) -> tuple[float, float, np.ndarray, float]:
    """(risk on positives, corrected risk on clean texts, and the step's gradient by weight and bias) for texts given as (row, column, value) with rows counted from 0; every row has a last entry, a column of -1, which only counts it.

    Logistic loss: log(1 + e^-s) for "toxic", log(1 + e^s) for "clean". Where the corrected risk is negative, the gradient is that of its negative alone, so that the step undoes it.
    """
    sigmoid = lambda s: 1 / (1 + np.exp(-np.clip(s, -40, 40)))
    (rp, cp, vp), (ru, cu, vu) = positive, unlabelled
    n_p, n_u = int(rp.max()) + 1, int(ru.max()) + 1
    padded = np.append(w, 0.0)
    sp, su = b + np.bincount(rp, padded[cp] * vp, n_p), b + np.bincount(ru, padded[cu] * vu, n_u)
    toxic = prior * float(np.logaddexp(0, -sp).mean())
    clean = float(np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean())
    gp_toxic, gp_clean, gu = -sigmoid(-sp) / n_p, sigmoid(sp) / n_p, sigmoid(su) / n_u
    gp = prior * (gp_toxic - gp_clean)
    if clean < 0:
        gp, gu = prior * gp_clean, -gu
    grad = np.bincount(cp[cp >= 0], (gp[rp] * vp)[cp >= 0], len(w)) + np.bincount(cu[cu >= 0], (gu[ru] * vu)[cu >= 0], len(w))
    return toxic, clean, grad, float(gp.sum() + gu.sum())


def _entries(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value). A text's features have length 1 together, so that a few telling words count in a short text as in a long one."""
    n = np.array([len(r) for r in rows], np.int64)
    flat = np.fromiter((c for r in rows for c in (*r, -1)), np.int64)
    at = np.repeat(np.arange(len(rows)), n + 1)
    return at, flat, np.where(flat < 0, 0.0, 1 / np.sqrt(np.maximum(1, n))[at])


def descend(positive: list[list[int]], unlabelled: list[list[int]], width: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias after STEPS steps from a start that knows only the prior. Without positives or unlabelled texts they stay there."""
    prior = min(max(prior, 0.001), 0.9)
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return w, b
    p, u = _entries(positive), _entries(unlabelled)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        _, _, by_weight, by_bias = risk(w, b, p, u, prior)
        grad = np.append(by_weight + DECAY * np.sign(w), by_bias)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - float(move[-1])
    return np.where(np.abs(w) < 1e-3, 0, w), b


def fit_nnpu(positive: list[bytes], unlabelled: list[bytes], prior: float) -> Model:
    """A model from confirmed positives and unlabelled texts on one machine. Without positives, everything scores low."""
    chosen = choose(_counts(positive), _counts(unlabelled), len(positive), len(unlabelled)).tolist()
    place = {c: i for i, c in enumerate(chosen)}
    w, b = descend(_rows(positive, place), _rows(unlabelled, place), len(chosen), prior)
    return Model({c: float(x) for c, x in zip(chosen, w, strict=True) if x}, b)


def held_out(doc_id):
    """Whether a document's label must not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Fits the model. Labels of held-out documents, and their texts, are not used.

    The two samples, at most most_positive and most_unlabelled documents, are those with the least hashes of the id; the class prior is the share of toxic rows among all labels that may be learnt from. Ids may be of any type; labels' are read as docs'. Null ids, labels and texts are left out; a document with several labels is toxic if one of them is, and one with several texts counts with the least of them. Ties of hashes are drawn together.

    The drawn documents are written to the checkpoint folder, and features are made of them on the executors: what reaches the driver is one count per bucket, and the chosen buckets of each drawn text.
    """
    kind = docs.select(doc_id).schema[0].dataType
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").try_cast(kind).alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("id is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    hashed = lambda c: F.xxhash64(c, F.lit("sample"))
    toxic = known.where("toxic = 1").select("id", hashed(F.col("id")).alias("h"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    most = least(toxic.select("h"), most_positive)
    positive = toxic.where(F.lit(False) if most is None else F.col("h") <= most).select("id", F.lit(True).alias("positive"))
    usable = F.col(doc_id).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id))
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.when(usable, hashed(F.col(doc_id))).alias("h"))
    top = least(source.select("h"), most_unlabelled)
    # The positives are bounded by most_positive.
    drawn = source.where("h is not null").join(F.broadcast(positive), "id", "left").withColumn("unlabelled", F.lit(False) if top is None else F.col("h") <= top).where("positive or unlabelled")
    drawn = checkpointed(drawn.groupBy("id").agg(F.min("text").alias("text"), F.max(F.coalesce("positive", F.lit(False))).alias("positive"), F.max("unlabelled").alias("unlabelled")).repartition(PARTS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Row BUCKETS counts texts.
        sums = np.zeros((BUCKETS + 1, 2), np.int64)
        for batch in batches:
            for part, texts in slices(batch, 1):
                for k in (0, 1):
                    own = [t for t, is_ in zip(texts, part.column(2 + k).to_pylist(), strict=True) if is_]
                    sums[:BUCKETS, k] += _counts(own).astype(np.int64)
                    sums[BUCKETS, k] += len(own)
        at = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at, 0]), pa.array(sums[at, 1])], names=["bucket", "p", "u"])

    found = drawn.mapInArrow(count, "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
    sums = np.zeros((BUCKETS + 1, 2))
    at = found.column("bucket").to_numpy()
    sums[at, 0], sums[at, 1] = found.column("p").to_numpy(), found.column("u").to_numpy()
    chosen = choose(sums[:-1, 0], sums[:-1, 1], int(sums[-1, 0]), int(sums[-1, 1])).tolist()
    held = docs.sparkSession.sparkContext.broadcast({c: i for i, c in enumerate(chosen)})

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(_rows(texts, held.value), pa.list_(pa.int32()))], names=["id", "positive", "unlabelled", "columns"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("positive", T.BooleanType()), T.StructField("unlabelled", T.BooleanType()), T.StructField("columns", T.ArrayType(T.IntegerType()))])
    rows = drawn.mapInArrow(columns, schema).withColumn("h", hashed(F.col("id"))).select("h", "positive", "unlabelled", "columns").toArrow().sort_by("h").to_pylist()
    w, b = descend([r["columns"] for r in rows if r["positive"]], [r["columns"] for r in rows if r["unlabelled"]], len(chosen), prior)
    return Model({c: float(x) for c, x in zip(chosen, w, strict=True) if x}, b)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row, from its whole text alone. Null and empty texts have no features and score by the bias; rows that repeat are scored each; other columns, of whatever names, are left out; an empty table gives an empty one. The model has at most BUCKETS weights and is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.scores(texts), pa.float64())], names=["id", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())]))


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; a score of THRESHOLD itself is predicted 1."""
    return score(docs, train(docs, labels)).select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that score under THRESHOLD (one that scores it goes), with all their columns. Null and empty texts score by the bias; rows that repeat are judged each; an empty table gives an empty one. Rows are filtered where they are scored; no text is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, doc_id, text))
    return keep_rows(docs, text, lambda texts: held.value.scores(texts) < THRESHOLD)
