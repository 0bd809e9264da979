"""Language ID by nearest centroid: TF-IDF n-gram vectors, several clustered centroids a language, cosine, rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.llm.storage import dropped, held_out, table, written

#: The classifier is fitted on about so many labelled rows of each language, drawn by hash, of at most so many characters, and
#: on about SAMPLE_TOTAL rows of all languages: where there are many languages, each gives fewer.
SAMPLE_ROWS, SAMPLE_TOTAL, SAMPLE_CHARS, SEED = 800, 40_000, 50_000, 11
#: Characters of the sample in all; with these a vector entry takes 6 bytes, so the driver gets some hundred MB at most.
SAMPLE_TOTAL_CHARS = 32_000_000
#: Hashed features; n-grams are of so many bytes; centroids a language; rounds of clustering.
BUCKETS, GRAMS, CENTROIDS, ROUNDS = 1 << 14, (2, 3, 4), 4, 12
#: Texts farther than this (1 - cosine) from every centroid are marked as rejected.
MAX_DISTANCE = 0.85
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
#: ASCII that isn't a letter separates words.
_PLAIN = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))
_MIX = np.uint32(0x9E3779B1)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the n-grams of a lower-cased text in which every run of other ASCII is one space."""
    data = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(_PLAIN).split()) + b" ", np.uint8).astype(np.uint32)
    found = []
    for n in GRAMS:
        if len(data) >= n:
            code = data[: len(data) - n + 1].copy()
            for j in range(1, n):
                code = code << np.uint32(8) | data[j : len(data) - n + 1 + j]
            found.append(((code + np.uint32(n)) * _MIX) >> np.uint32(32 - 14))
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS) if found else np.zeros(BUCKETS, np.int64)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class LanguageModel:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, counts = gram_counts(text)
        w = (1 + np.log(counts)) * self.idf[at]
        norm = np.sqrt(w @ w)
        return at, w / norm if norm > 0 else w

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Nearest language, its cosine in [0, 1], and whether even that is too far. Texts without a letter: und, 0."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, True
        at, w = self.vector(text)
        cosines = self.centroids[at].T @ w
        best = int(cosines.argmax())
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[self.owner[best]], score, 1 - score > MAX_DISTANCE


def _clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; the first centroids are rows far from one another, starting at row 0."""
    centres = [x[0]]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.max(np.array(centres) @ x.T, axis=0).argmin())])
    c = np.array(centres)
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        sums = np.array([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> LanguageModel:
    """From (language, buckets, counts) of labelled texts."""
    rows = [r for r in rows if len(r[1])]
    seen = np.zeros(BUCKETS)
    for _, at, _c in rows:
        seen[at] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    languages = sorted({r[0] for r in rows})
    centroids, owner = [], []
    for i, language in enumerate(languages):
        x = np.zeros((sum(r[0] == language for r in rows), BUCKETS), np.float32)
        for j, (_, at, counts) in enumerate(r for r in rows if r[0] == language):
            w = (1 + np.log(counts)) * idf[at]
            x[j, at] = w / np.sqrt(w @ w)
        c = _clustered(x, CENTROIDS)
        centroids.append(c)
        owner += [i] * len(c)
    matrix = np.concatenate(centroids).T if centroids else np.zeros((BUCKETS, 0))
    return LanguageModel(idf, languages, np.ascontiguousarray(matrix, np.float32), np.array(owner, int))


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [gram_counts(t or "") for t in batch["text"].to_pylist()]
        packed = [pa.array([x.astype(kind).tobytes() for x in part], pa.binary()) for part, kind in zip(zip(*found), ("<u2", "<u4"))] if found else [pa.array([], pa.binary())] * 2
        yield pa.RecordBatch.from_arrays([batch["turn"], batch["lang"], *packed], ["turn", "lang", "at", "counts"])


def trained(docs: DataFrame) -> LanguageModel:
    """From rows with a language whose crc32(doc_id as text) mod 4 is not 2: a bounded sample of each language.

    Languages are counted over all rows; each then gives about SAMPLE_ROWS rows (fewer where there are many languages or
    texts are long: SAMPLE_TOTAL rows and SAMPLE_TOTAL_CHARS characters in all), those with the smallest hashes of id and text
    (rows that repeat both count once), and one row at least. Rows of over SAMPLE_CHARS characters are drawn only for
    languages that have no others, and then give their first SAMPLE_CHARS. n-grams are counted on the executors, so the
    driver holds vectors of bounded number and size, and no text.
    """
    rows = docs.filter("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(~held_out(F.col("doc_id")))
    rows = rows.withColumns({"turn": F.xxhash64("doc_id", "text", F.lit(SEED)), "whole": F.length("text") <= SAMPLE_CHARS}).withColumn("text", F.left("text", F.lit(SAMPLE_CHARS)))
    counts = rows.groupBy("lang", "whole").agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.avg(F.length("text")).alias("chars"))
    best = counts.groupBy(F.col("lang").alias("of")).agg(F.max(F.struct("whole", "n", "first", "chars")).alias("b"))  # whole ones, where there are any
    sizes = written(best.select("of", F.col("b.whole").alias("of_whole"), "b.n", "b.first", "b.chars"), "languages")
    languages = max(1, sizes.count())
    each = F.least(F.lit(min(SAMPLE_ROWS, SAMPLE_TOTAL / languages)), F.lit(SAMPLE_TOTAL_CHARS / languages) / F.greatest("chars", F.lit(1)))
    drawn = rows.join(sizes, (F.col("lang") == F.col("of")) & (F.col("whole") == F.col("of_whole")))
    early = F.pmod("turn", F.lit(1 << 30)) < each * (1 << 30) / F.col("n")
    drawn = drawn.filter(early | (F.col("turn") == F.col("first"))).dropDuplicates(["turn", "lang"]).select("turn", "lang", "text")
    found = drawn.mapInArrow(_gram_rows, "turn long, lang string, at binary, counts binary").collect()
    dropped(sizes)
    found.sort(key=lambda r: (r["turn"], r["lang"]))
    return fit([(r["lang"], np.frombuffer(r["at"], "<u2"), np.frombuffer(r["counts"], "<u4")) for r in found])


def predictions(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of `docs` (doc_id, text), in one pass.

    Null texts and texts without a letter are `und` with score 0. `rejected` marks texts too far from every centroid;
    lang_pred still names the nearest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch["text"].to_pylist()]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of `documents`. Null texts and texts without a Unicode letter are `und` with score 0, and so is every text
    if no row has a language; of equally near centroids the first language by name is predicted; rows that repeat an id
    each have their row; an empty table gives no rows; other columns are ignored."""
    docs = table(spark, sf_dir, "documents")
    return predictions(docs, trained(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
