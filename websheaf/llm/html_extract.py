"""HTML extraction: a linear-chain CRF over a page's leaf blocks, trained on labelled pages, decoded by Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.llm.crf import ChainModel, Chains, chains
from websheaf.llm.html_blocks import Block, blocks
from websheaf.llm.page_templates import labelled_pages
from websheaf.llm.storage import table, text_slices

#: Labelled pages that train the extractor, their seed, rounds, and the penalty on squared weights.
PAGES, SEED, ROUNDS, L2 = 1600, 1, 150, 1e-5
#: Characters of pages that a task parses at once.
SLICE = 2_000_000


def features(b: Block, count: int) -> list[str]:
    """What is above the block (tags, and words of class, id and role), and how its text looks."""
    n = len(b.text)
    share = 4 * b.linked // n
    words = b.text.count(" ") + 1
    length, stop, commas = min(words.bit_length(), 7), b.text[-1] in ".!?:…", min(b.text.count(","), 3)
    looks = [f"len={length}", f"link={share}", f"stop={stop}", f"commas={commas}", f"sign={'©' in b.text}", f"tag={b.tag}", f"near={b.section}", f"edge={b.order == 0}{b.order == count - 1}"]
    return ["any", *looks, *("in=" + t for t in sorted(b.tags)), *("name=" + w for w in sorted(b.names)), f"tag={b.tag} link={share}", f"named={bool(b.names)}", f"tag={b.tag} len={length} stop={stop}", f"near={b.section} len={length}"]


@dataclass(eq=False)
class Extractor:
    index: dict[str, int]
    chain: ChainModel

    def blocks(self, page: str) -> list[Block]:
        """The page's blocks, with those tags and names that the model knows."""
        return blocks(page, self.known("in="), self.known("name="))

    @cache
    def known(self, kind: str) -> frozenset[str]:
        return frozenset(f[len(kind) :] for f in self.index if f.startswith(kind))

    def chains_of(self, pages: list[list[Block]]) -> Chains:
        rows: dict[tuple[int, ...], int] = {}
        kind = []
        for page in pages:
            for b in page:
                ids = tuple(i for f in features(b, len(page)) if (i := self.index.get(f)) is not None)
                kind.append(rows.setdefault(ids, len(rows)))
        return chains([list(r) for r in rows], np.array(kind, np.int64), np.cumsum([0, *map(len, pages)]))

    def content(self, pages: list[list[Block]]) -> list[list[str]]:
        x = self.chains_of(pages)
        labels = self.chain.viterbi(self.chain.emissions(x), x.seq) if len(x.kind) else np.zeros(0, int)
        return [[b.text for b, y in zip(page, labels[a:]) if y] for page, a in zip(pages, x.seq)]


def fit(pages: list[tuple[str, dict[str, bool]]], rounds: int = ROUNDS) -> Extractor:
    """From (html, {block text: is content}); blocks without a label count as not content."""
    parsed = [blocks(page) for page, _ in pages]
    names = sorted({f for page in parsed for b in page for f in features(b, len(page))} - {"any"})
    model = Extractor({f: i for i, f in enumerate(["any", *names])}, ChainModel(len(names) + 1, 2))
    labels = np.array([bool(known.get(b.text)) for page, (_, known) in zip(parsed, pages) for b in page], np.int64)
    model.chain.fit(model.chains_of(parsed), labels, rounds=rounds, l2=L2)
    return model


@cache
def trained() -> Extractor:
    """The extractor of PAGES generated pages; the same at every call, so made once a process."""
    return fit(labelled_pages(PAGES, SEED))


def main_texts(pages: DataFrame, model: Extractor) -> DataFrame:
    """(page_id, url, text) of every row of `pages` (page_id, url, html): content blocks joined by an empty line.

    Null and empty pages, and pages without content, have the empty text. Whole pages are read; nothing shuffles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch["html"].to_pylist()
            for a, b in text_slices(pages, SLICE):
                part = batch.slice(a, b - a)
                found = model.content([model.blocks(h or "") for h in pages[a:b]])
                texts = pa.array(["\n\n".join(t) for t in found], pa.string())
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], texts], ["page_id", "url", "text"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of `pages`. Null and empty pages, and pages without content, have the empty text and n_chars 0; rows that
    repeat an id each have their row; an empty table gives no rows; other columns are ignored."""
    found = main_texts(table(spark, sf_dir, "pages"), trained())
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
