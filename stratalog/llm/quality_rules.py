"""Document quality rules in a cascade that stops at the first rule that rejects.

Each rule reads statistics of a text, and some statistics are dear. A bounded sample of documents is judged by every rule, which gives each rule's cost and the share that it rejects. Cost is counted work (words and blocks of bytes that are looked at), not time, so that every run orders alike. The rules are then run in an order that a greedy choice makes: next is the rule that rejects most, for its cost, of what the rules before it let pass. Statistics that are returned anyway cost their rules nothing; all others are computed only for texts that no earlier rule has rejected. The order changes what a verdict costs, never the verdict.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample as draw
from .common import slices

#: Documents that costs and rejections are estimated on.
SAMPLE = 400
WINDOW = 8
MIN_WORDS = 20
MOST_REPEATED = 30

_SYMBOLS = b"#*$%&|<>"
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: Bytes that a built-in pass over a text reads for the work of looking at one word in Python.
BLOCK = 32


class Document:
    """A text with the statistics that rules ask for, each computed once; `work` counts what that took."""

    def __init__(self, text: bytes):
        self.text = text
        self.work = 0.0
        self._kept: dict[str, object] = {}

    def once(self, name: str, work: float, make: Callable[[], object]):
        if name not in self._kept:
            self._kept[name] = make()
            self.work += work
        return self._kept[name]

    def give(self, name: str, value: object) -> None:
        """A statistic that is known already, and costs nothing."""
        self._kept[name] = value

    @property
    def words(self) -> list[bytes]:
        return self.once("words", len(self.text) / BLOCK, self.text.split)

    @property
    def lines(self) -> list[bytes]:
        """The \n-split lines that have a word."""
        return self.once("lines", len(self.text) / BLOCK, lambda: [x for x in self.text.split(b"\n") if x.split()])

    def n_words(self) -> int:
        return len(self.words)

    def word_chars(self) -> int:
        """Code points in words."""
        return self.once("word_chars", len(self.text) / BLOCK, lambda: code_points(b"".join(self.words)))

    def n_symbols(self) -> int:
        return self.once("n_symbols", len(self.text) / BLOCK, lambda: len(self.text) - len(self.text.translate(None, _SYMBOLS)))

    def n_dup_lines(self) -> int:
        return self.once("n_dup_lines", len(self.lines), lambda: len(self.lines) - len(set(self.lines)))

    def n_repeat_words(self) -> int:
        return self.once("n_repeat_words", WINDOW * len(self.words), lambda: int(repeated([self.words])[0]))

    def n_shouting(self) -> int:
        return self.once("n_shouting", len(self.words), lambda: sum(w.isupper() and len(w) > 1 for w in self.words))

    def n_bare(self) -> int:
        return self.once("n_bare", len(self.words), lambda: sum(not w.strip(_PUNCTUATION) for w in self.words))

    def n_again(self) -> int:
        return self.once("n_again", len(self.words), lambda: sum(map(bytes.__eq__, self.words, self.words[1:])))

    def counts(self) -> Counter:
        return self.once("counts", len(self.words), lambda: Counter(self.words))


#: The statistics that can be asked for along with verdicts.
BASE = {"n_words": Document.n_words, "word_chars": Document.word_chars, "n_symbols": Document.n_symbols, "n_dup_lines": Document.n_dup_lines, "n_repeat_words": Document.n_repeat_words}


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode())


def repeated(texts: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """For each list of words, how many are in a window of that many words that occurs twice or more in the list.

    Equal runs get equal numbers by doubling: runs of 2 from words, of 4 from those of 2, and so on; no hash is involved.
    """
    n = np.array([len(t) for t in texts], np.int64)
    out = np.zeros(len(texts), np.int64)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
    if len(ids) < window + 1:
        return out
    text = np.repeat(np.arange(len(texts)), n)
    # Runs of different texts are different from the start.
    runs, width = np.unique(text * len(number) + ids, return_inverse=True)[1], 1
    while width < window:
        step = min(width, window - width)
        pair = runs[: len(runs) - step] * (int(runs.max()) + 1) + runs[step:]
        runs, width = np.unique(pair, return_inverse=True)[1], width + step
    inside = text[: len(runs)] == text[window - 1 :]
    twice = inside & (np.bincount(runs[inside], minlength=len(runs) + 1)[runs] > 1)
    step = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    step[at] += 1
    np.add.at(step, at + window, -1)
    return np.bincount(text, np.cumsum(step[:-1]) > 0, len(texts)).astype(np.int64)


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Document], bool]


def _share(part: int, whole: int, most: float) -> bool:
    return whole > 0 and part > most * whole


#: Quality heuristics known from published web corpora; a text that none rejects is kept.
RULES = (
    Rule("few_words", lambda d: len(d.words) < MIN_WORDS),
    Rule("word_length", lambda d: not 2 * len(d.words) <= d.word_chars() <= 14 * len(d.words)),
    Rule("symbols", lambda d: _share(d.n_symbols(), len(d.words), 0.3)),
    Rule("shouting", lambda d: _share(d.n_shouting(), len(d.words), 0.6)),
    Rule("bare_words", lambda d: _share(d.n_bare(), len(d.words), 0.3)),
    Rule("one_word", lambda d: len(d.words) >= MIN_WORDS and _share(max(d.counts().values()), len(d.words), 0.35)),
    Rule("stutter", lambda d: _share(d.n_again(), len(d.words), 0.3)),
    Rule("distinct_words", lambda d: len(d.words) >= 50 and _share(len(d.words) - len(d.counts()), len(d.words), 0.9)),
    Rule("repeated_lines", lambda d: _share(d.n_dup_lines(), len(d.lines), 0.5)),
    Rule("repeated_windows", lambda d: _share(d.n_repeat_words(), len(d.words), MOST_REPEATED / 100)),
)


def verdicts(text: bytes, rules: tuple[Rule, ...] = RULES) -> list[bool]:
    """What each rule says, without stopping."""
    return [r.rejects(Document(text)) for r in rules]


def profile(text: bytes, rules: tuple[Rule, ...] = RULES, given: tuple[str, ...] = ()) -> tuple[list[float], list[bool]]:
    """(work, verdict) of each rule by itself, with the given statistics known."""
    work, rejects = [], []
    for rule in rules:
        d = Document(text)
        for name in given:
            BASE[name](d)
        before = d.work
        rejects.append(bool(rule.rejects(d)))
        work.append(d.work - before)
    return work, rejects


def order(work: np.ndarray, rejected: np.ndarray) -> list[int]:
    """The places of the rules in the order to run them, from (document, rule) tables of a sample; for an empty sample as they are. Ties go to the earlier rule."""
    if not len(work):
        return list(range(work.shape[1]))
    cost = work.sum(0)
    out: list[int] = []
    alive = np.ones(len(work), bool)
    while len(out) < len(cost):
        rest = [k for k in range(len(cost)) if k not in out]
        best = max(rest, key=lambda k: ((rejected[alive, k].sum() + 0.01) / max(cost[k], 1e-9), -k))
        out.append(best)
        alive &= ~rejected[:, best]
    return out


def first_rejection(document: Document, ordered: list[int], rules: tuple[Rule, ...] = RULES) -> int | None:
    """The place of the first rule that rejects; rules after it aren't run."""
    return next((k for k in ordered if rules[k].rejects(document)), None)


def estimate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE, given: tuple[str, ...] = ()) -> list[int]:
    """The order of RULES by their work and rejections on at most `rows` documents, which are judged where they are; one row of figures for each reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, 1):
                found = [profile(t, RULES, given) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.list_(pa.float64())), pa.array([r for _, r in found], pa.list_(pa.bool_()))], names=["work", "rejected"])

    found = draw(docs, doc_id, text, rows).mapInArrow(run, "work array<double>, rejected array<boolean>").collect()
    return order(np.array([r.work for r in found]).reshape(-1, len(RULES)).round(6), np.array([r.rejected for r in found], bool).reshape(-1, len(RULES)))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, statistics: bool = False) -> DataFrame:
    """(id, rejected_by), and with `statistics` (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) for every row.

    rejected_by is the name of the rule that stopped the cascade, null for texts that are kept. Which of several rules that would reject is named depends on the order, whether one is does not. Null reads as empty; empty texts fall to few_words. Rows that repeat are judged each; other columns, of whatever names, are left out; an empty table gives an empty one. The sample, `sample` rows by a hash, only orders the rules. There is no shuffle of texts but the sample's.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    counts = tuple(BASE) if statistics else ()
    ordered = estimate(docs, doc_id, text, sample, counts)
    kind = rows.schema["id"].dataType.simpleString()
    names = [r.name for r in RULES]
    fields = ["id", *counts, "rejected_by"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                documents = [Document(t) for t in texts]
                if statistics:
                    for d, n in zip(documents, repeated([d.words for d in documents]).tolist(), strict=True):
                        d.give("n_repeat_words", n)
                columns = [pa.array([BASE[c](d) for d in documents], pa.int64()) for c in counts]
                stopped = [first_rejection(d, ordered) for d in documents]
                columns.append(pa.array([None if k is None else names[k] for k in stopped], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=fields)

    return rows.mapInArrow(run, ", ".join([f"id {kind}", *(f"{c} long" for c in counts), "rejected_by string"]))


def op2_quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base statistics, base_failed, kept of every document."""
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return judge(docs, statistics=True).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept")
    )


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), starts AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)
), twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM starts) WHERE c > 1
), repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), words AS (
  SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY ALL
), per AS (
  SELECT doc_id, max(c) AS most, count(*) AS n_distinct,
         sum(CASE WHEN strlen(x) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') THEN c ELSE 0 END) AS n_upper,
         sum(CASE WHEN regexp_full_match(x, '[!-/:-@\[-`{-~]+') THEN c ELSE 0 END) AS n_bare
  FROM words GROUP BY doc_id
), base AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'gs')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(repeats.n, 0) AS n_repeat_words,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_again, coalesce(most, 0) AS most, coalesce(n_distinct, 0) AS n_distinct, coalesce(n_upper, 0) AS n_upper, coalesce(n_bare, 0) AS n_bare
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN per USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 10 * n_symbols > 3 * n_words OR 10 * n_upper > 6 * n_words OR 10 * n_bare > 3 * n_words OR 10 * n_again > 3 * n_words OR 20 * most > 7 * n_words
            OR (n_words >= 50 AND 10 * (n_words - n_distinct) > 9 * n_words) OR 2 * n_dup_lines > n_lines) AS kept
FROM base
"""
