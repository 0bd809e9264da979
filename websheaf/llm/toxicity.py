"""Toxicity: a linear-chain CRF tags toxic words; marginals add up to document scores and offending offsets."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.llm.crf import ChainModel, Chains, chains
from websheaf.llm.storage import dropped, held_out, table, text_slices, written

#: The classifier is fitted on at most so many labelled rows of each class, of at most so many characters each.
SAMPLE_ROWS, SAMPLE_CHARS, SEED = 1000, 20_000, 7
#: Of these, so many of each class, of at most so many characters each, train the chain, in so many rounds.
TAGGED_ROWS, TAGGED_CHARS, ROUNDS = 300, 6_000, 40
#: Penalty on squared weights against the likelihood of a mean word: small, or marks of few rows (a rare language) count for nothing.
L2 = 1e-6
#: Documents score 1 from this on.
THRESHOLD = 0.3
#: Words of a chain; chains also end with sentences and lines.
CHAIN_WORDS = 128
CACHED_WORDS = 1 << 18
#: A label is put on words of toxic rows that hold a mark: a beginning (or a whole word) in at least MARK_ROWS toxic rows, at
#: least MARK_LIFT times as often as in clean ones, and with a chance of at most MARK_CHANCE to be there by accident. The last
#: two, like L2, were chosen by threefold cross-validation inside the training rows.
MARK_ROWS, MARK_LIFT, MARK_CHANCE, STEMS = 3, 4.0, 1e-4, (4, 5, 6, 7)
#: Near copies teach one thing many times: of SKETCH hash minima of a row's three-word runs, fewer than ALIKE may be another's.
SKETCH, ALIKE = 8, 3

_TOKEN = re.compile(r"[^\W_]+|[.!?\n]+")
_END = re.compile(r"[.!?\n]+")


def marks_of(word: str) -> list[str]:
    """What can mark a word: itself, and its beginnings."""
    n = len(word)
    return ["=" + word] + ["^" + word[:k] for k in STEMS if n > k]


class Features(dict):
    """Feature ids of words, remembered for CACHED_WORDS words: 0 is every word's, 1 to 4 tell its length."""

    def __init__(self, index: dict[str, int]):
        self.index = index

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = [0, 1 + min(len(word) // 4, 3)]
        for m in marks_of(word):
            if (i := self.index.get(m)) is not None:
                ids.append(i)
        self[word] = ids
        return ids


class Tokens:
    """The words of some texts as numbers of distinct words, and the chains that they form."""

    def __init__(self, texts: list[str]):
        vocab: dict[str, int] = {}
        number = vocab.setdefault
        ids = [[number(w, len(vocab)) for w in _TOKEN.findall(t.lower())] for t in texts]
        self.bounds = np.cumsum([0, *map(len, ids)], dtype=np.int64)
        self.kind = np.fromiter(chain.from_iterable(ids), np.int64, self.bounds[-1])
        self.words = list(vocab)
        self.is_end = np.array([bool(_END.match(w)) for w in self.words], bool)[self.kind] if vocab else np.zeros(0, bool)

    def chains(self, features: Features) -> Chains:
        breaks = np.unique(np.concatenate((np.flatnonzero(self.is_end) + 1, self.bounds)))
        long = np.flatnonzero(np.diff(breaks) > CHAIN_WORDS)
        more = [np.arange(breaks[i], breaks[i + 1], CHAIN_WORDS) for i in long]
        return chains([features[w] for w in self.words], self.kind, np.unique(np.concatenate([breaks, *more])))


@dataclass
class ToxicityModel:
    features: Features
    chain: ChainModel
    doc_weights: np.ndarray

    def evidence(self, toxic: np.ndarray) -> np.ndarray:
        """What the document score looks at: expected toxic words (log), the two largest marginals, and all words (log), as a
        long text has more words that look toxic by accident."""
        if not len(toxic):
            return np.array([1.0, 0.0, 0.0, 0.0, 0.0])
        top = np.partition(np.concatenate(([0.0, 0.0], toxic)), -2)[-2:]
        return np.array([1.0, np.log1p(toxic.sum()), top[1], top[0], np.log1p(len(toxic)) / 5])

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's words begin, and P(toxic) of all words (0 for what ends a sentence)."""
        tokens = Tokens(texts)
        x = tokens.chains(self.features)
        toxic = self.chain.marginals(self.chain.emissions(x), x.seq)[:, 1]
        return tokens.bounds, np.where(tokens.is_end, 0.0, toxic)

    def score(self, texts: list[str], with_spans: bool = False):
        """Scores, and the character spans [a, b) of words whose marginal is at least 0.5."""
        bounds, toxic = self.tag(texts)
        evidence = np.array([self.evidence(toxic[a:b]) for a, b in zip(bounds, bounds[1:])]).reshape(-1, 5)
        scores = 1 / (1 + np.exp(-(evidence @ self.doc_weights)))
        if not with_spans:
            return scores, None
        spans = []
        for text, a, b in zip(texts, bounds, bounds[1:]):
            hits = np.flatnonzero(toxic[a:b] >= 0.5)
            found = list(_TOKEN.finditer(text.lower())) if len(hits) else []
            spans.append([[m.start(), m.end()] for m in map(found.__getitem__, hits)])
        return scores, spans


def _sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """Labelled training rows (text, label) of both classes: bounded rows, each of bounded length.

    Ids are drawn among labelled rows of such a length, class by class in the order of a hash, and texts are fetched for
    those alone. Rows return in the order of the draw, so that any first so many of a class are a fair draw as well.
    Rows that repeat a doc_id count once, with their least text.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id"))).filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("id"), "toxic")
    short = docs.filter(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text")
    pool = known.join(short.select(F.col("doc_id").alias("id")), "id", "left_semi").withColumn("turn", F.xxhash64(F.col("id"), F.lit(SEED)))
    pool = written(pool, "labelled")
    each = [pool.filter(F.col("toxic") == c).orderBy("turn", "id").limit(SAMPLE_ROWS) for c in (0, 1)]
    drawn = F.broadcast(each[0].union(each[1]))  # at most 2 * SAMPLE_ROWS rows of three numbers
    found = short.join(drawn, short["doc_id"] == drawn["id"]).groupBy("toxic", "turn", "id").agg(F.min("text").alias("text")).collect()
    dropped(pool)
    return [(r["text"], int(r["toxic"])) for r in sorted(found, key=lambda r: (r["turn"], r["id"]))]


def without_near_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The rows, in order, that don't share ALIKE or more hash minima with rows before them."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for text, label in rows:
        words = text.lower().split()
        runs = {zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))}
        h = np.fromiter(runs, np.uint64, len(runs))
        minima = [(j, int((h * np.uint64(2654435761 + 2 * 40503 * j) % np.uint64(4294967291)).min())) for j in range(SKETCH)]
        if sum(m in seen for m in minima) < ALIKE:
            kept.append((text, label))
            seen.update(minima)
    return kept


def _by_accident(toxic: int, clean: int, share: float) -> float:
    """The chance that at least `toxic` of toxic + clean rows are toxic where rows are with probability `share`."""
    n = toxic + clean
    k = range(toxic, n + 1)
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share)) for i in k)


def _marks(counts: tuple[Counter, Counter], size: list[int]) -> set[str]:
    """What toxic rows have more often than chance allows, given in how many rows of either class (of `size`) it is."""
    share = size[1] / sum(size)
    lift = lambda m, n: (n + 0.1) / size[1] / ((counts[0][m] + 0.1) / size[0])
    often = [(m, n) for m, n in counts[1].items() if n >= MARK_ROWS and lift(m, n) >= MARK_LIFT]
    return {m for m, n in often if _by_accident(n, counts[0][m], share) <= MARK_CHANCE}


def fit(rows: list[tuple[str, int]]) -> ToxicityModel:
    """From (text, label) rows in the order in which they are to be taken.

    Labelled tokens do not exist: words of toxic rows are labelled by the marks that set toxic rows apart, and the CRF
    learns from those. Near copies count once. Nothing but texts and labels is looked at.
    """
    rows = without_near_copies(rows)
    counts = (Counter(), Counter())
    for text, label in rows:
        counts[label].update({m for w in set(_TOKEN.findall(text.lower())) for m in marks_of(w)})
    size = [sum(label == y for _, label in rows) for y in (0, 1)]
    marks = _marks(counts, size) if all(size) else set()
    frequent = [m for m, n in (counts[0] + counts[1]).items() if n >= 20 and m not in marks]
    index = {m: i + 5 for i, m in enumerate(sorted(marks) + sorted(frequent, key=lambda m: (-counts[0][m], m))[:20_000])}
    model = ToxicityModel(Features(index), ChainModel(len(index) + 5, 2), np.array([-2.0, 0.0, 0.0, 0.0, 0.0]))
    short = [r for r in rows if len(r[0]) <= TAGGED_CHARS]
    tagged = [r for y in (0, 1) for r in [x for x in short if x[1] == y][:TAGGED_ROWS]]
    tokens = Tokens([t for t, _ in tagged])
    marked = np.array([any(m in marks for m in marks_of(w)) for w in tokens.words], bool)[tokens.kind] if tokens.words else np.zeros(0, bool)
    labels = (marked & np.repeat(np.array([r[1] for r in tagged], bool), np.diff(tokens.bounds))).astype(np.int64)
    if labels.any():
        model.chain.fit(tokens.chains(model.features), labels, rounds=ROUNDS, l2=L2)
    texts, y = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    x = [np.zeros((0, 5))]
    for a, b in text_slices(texts):
        bounds, p = model.tag(texts[a:b])
        x.append(np.array([model.evidence(p[i:j]) for i, j in zip(bounds, bounds[1:])]))
    x = np.concatenate(x)
    for _ in range(400 if len(y) else 0):
        p = 1 / (1 + np.exp(-(x @ model.doc_weights)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + 1e-3 * np.eye(5)
        model.doc_weights += 0.5 * np.linalg.solve(hessian, x.T @ (y - p) / len(y) - 1e-3 * model.doc_weights)
    return model


def trained(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model of the training rows: labels whose crc32(doc_id as text) mod 4 is not 2."""
    return fit(_sample(docs, labels))


def _scored(model: ToxicityModel, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for a, b in text_slices(texts, 1_000_000):
                scores, spans = model.score(texts[a:b], with_spans)
                columns = [batch["doc_id"].slice(a, b - a), pa.array(scores, pa.float64())]
                if with_spans:
                    columns.append(pa.array(spans, pa.list_(pa.list_(pa.int32()))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "spans"][: len(columns)])

    return run


def scores(docs: DataFrame, model: ToxicityModel, *, with_spans: bool = True) -> DataFrame:
    """(doc_id, score, spans) of every row of `docs` (doc_id, text); spans are the [start, end) of offending words.

    Null and empty texts get the score of a text without words. Nothing shuffles.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = "doc_id long, score double" + ", spans array<array<int>>" * with_spans
    return source.mapInArrow(_scored(model, with_spans), fields)


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` under the threshold, all columns unchanged; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            keep = [model.score(texts[a:b])[0] < threshold for a, b in text_slices(texts, 1_000_000)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of `documents`: its score, and the [start, end) of offending words in `spans`. Null and empty texts get the
    score of a text without words; rows that repeat an id each have their row; an empty table gives no rows; without
    labels of both classes no word is toxic and scores stay under the threshold; other columns are ignored."""
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, trained(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
