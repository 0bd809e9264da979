"""Token ids in a content-addressed store: unique chunks, document recipes, Merkle manifests.

A store is a folder with three Parquet tables:
  chunks              key (SHA-256 of the stored bytes), ids (little-endian unsigned 16- or 32-bit), n_ids; once each
  recipes/shard=N     doc_id, start, n_tokens, chunk_ids, lengths, root; ascending doc_id within and across shards
  manifest            shard, n_docs, n_tokens, root: the Merkle root of the shard's documents in order
"""

from __future__ import annotations

import hashlib
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from websheaf.llm.bpe import CACHED_WORDS, byte_letters, default_path, vocabulary, words_of
from websheaf.llm.chunking import chunk_ends
from websheaf.llm.storage import dropped, new_path, table, text_slices, written

#: Ids of a chunk: least, mean of what follows, most. The id that ends a document.
CHUNK, END_ID = (256, 512, 4096), 2
_CRC = 0xEDB88320

Batches = Iterator[pa.RecordBatch]


class LibraryEncoder:
    """Packed ids as the tokenizers library gives them; what it says of a word is remembered for 4 * CACHED_WORDS words."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        vocabulary(path)  # refuses files whose split or merging is another
        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.code = "H" if max(self.library.get_vocab_size() - 1, end_id) < 1 << 16 else "I"
        self.merge = self.library.model.tokenize
        letter_of = {b: c for c, b in byte_letters().items()}
        self.letters = "".join(letter_of[b] for b in range(256))
        self.width = "<u2" if self.code == "H" else "<u4"
        self.young, self.old = {}, {}

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def word(self, word: str) -> bytes:
        """The library's own merging of one piece, whose bytes it wants written as its vocabulary writes them."""
        if word[0] == " " and word.isascii() and word[1:].isalpha():  # letters are written as they are
            return self.packed([t.id for t in self.merge(self.letters[32] + word[1:])])
        return self.packed([t.id for t in self.merge(word.encode().decode("latin-1").translate(self.letters))])

    def remembered(self, words: list[str]) -> list[bytes]:
        """Ids of each of some distinct pieces."""
        found = [self.young.get(w) for w in words]
        lost = {}
        for i in [i for i, ids in enumerate(found) if ids is None]:
            w = words[i]
            ids = self.old.get(w)
            lost[w] = found[i] = self.word(w) if ids is None else ids
        if len(self.young) + len(lost) > 2 * CACHED_WORDS:
            self.old, self.young = self.young, {}
        self.young.update(lost)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian numbers of 16 bits, or of 32 where the vocabulary needs them.

        Texts are cut into pieces, Arrow numbers the distinct ones, the library gives their ids, and numpy lays them out in the
        order of the texts. Texts with special tokens go to the library whole.
        """
        cut = [None if any(s in t for s in self.specials) else words_of(t) for t in texts]
        numbered = pa.array(list(chain.from_iterable(c for c in cut if c)), pa.large_string()).dictionary_encode()
        data = self.remembered(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, data), np.int64, len(data)) // np.dtype(self.width).itemsize
        code = numbered.indices.to_numpy()
        n = lengths[code]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = np.frombuffer(b"".join(data), self.width)[np.repeat((np.cumsum(lengths) - lengths)[code] - ends[:-1], n) + np.arange(ends[-1])]
        out, at = [], 0
        for t, c in zip(texts, cut):
            if c is None:
                out.append(self.packed(self.library.encode(t, add_special_tokens=False).ids))
            else:
                out.append(ids[ends[at] : ends[at + len(c)]].tobytes())
                at += len(c)
        return out


@lru_cache(maxsize=2)
def process_encoder(path: str, end_id: int) -> LibraryEncoder:
    """One encoder a worker process: tasks that follow one another find its word memory filled."""
    return LibraryEncoder(path, end_id)


def merkle(leaves) -> bytes:
    """Root of the leaves in order: equal subtrees pair up as they come, what is left folds from the right."""
    peaks: list[tuple[int, bytes]] = []
    for leaf in leaves:
        node, height = hashlib.sha256(b"\0" + leaf).digest(), 0
        while peaks and peaks[-1][0] == height:
            node, height = hashlib.sha256(b"\1" + peaks.pop()[1] + node).digest(), height + 1
        peaks.append((height, node))
    if not peaks:
        return hashlib.sha256(b"").digest()
    node = peaks.pop()[1]
    while peaks:
        node = hashlib.sha256(b"\1" + peaks.pop()[1] + node).digest()
    return node


_PARTS = pa.schema(
    [("kind", pa.string()), ("key", pa.binary()), ("ids", pa.binary()), ("n_ids", pa.int64()), ("doc_id", pa.int64()),
     ("root", pa.binary()), ("chunk_ids", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32()))]
)
_PARTS_DDL = "kind string, key binary, ids binary, n_ids long, doc_id long, root binary, chunk_ids array<binary>, lengths array<int>"


def _parts(path: str, end_id: int):
    def run(batches: Batches) -> Batches:
        encoder = process_encoder(path, end_id)
        width = encoder.width
        end = encoder.packed([end_id])
        for batch in batches:
            uids, doc_ids = batch["uid"].to_pylist(), batch["doc_id"].to_pylist()
            texts = [t or "" for t in batch["text"].to_pylist()]
            for a, b in text_slices(texts, 2_000_000):
                streams = [x + end for x in encoder.encode(texts[a:b])]
                bounds = np.cumsum([0, *[len(x) // len(end) for x in streams]]).tolist()
                symbols = np.frombuffer(b"".join(streams), width)
                recipes, chunks = [], {}
                for start, ends, uid, doc_id in zip(bounds, chunk_ends(symbols, bounds, *CHUNK), uids[a:b], doc_ids[a:b]):
                    keys, lengths = [], []
                    for x, y in zip([start, *ends], ends):
                        data = symbols[x:y].tobytes()
                        key = hashlib.sha256(data).digest()
                        chunks[key] = (data, y - x)
                        keys.append(key)
                        lengths.append(y - x)
                    recipes.append(("recipe", uid.to_bytes(8, "big"), None, sum(lengths), doc_id, merkle(keys), keys, lengths))
                rows = recipes + [("chunk", k, data, n, None, None, None, None) for k, (data, n) in chunks.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARTS)], schema=_PARTS)

    return run


def _shard_roots(batches: Batches) -> Batches:
    """One row a shard from rows sorted by shard; memory is one hash a tree level."""

    def rows():
        for batch in batches:
            yield from zip(batch["shard"].to_pylist(), batch["n_tokens"].to_pylist(), batch["root"].to_pylist())

    for shard, docs in groupby(rows(), key=lambda r: r[0]):
        count = [0, 0]

        def leaves(docs=docs, count=count):
            for _, n, root in docs:
                count[0] += 1
                count[1] += n
                yield root

        root = merkle(leaves())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": pa.array([count[0]], pa.int64()), "n_tokens": pa.array([count[1]], pa.int64()), "root": pa.array([root], pa.binary())})


def write_store(docs: DataFrame, store: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encodes every row of `docs` (doc_id, text; null text: empty), appends `end_id` to each, and writes a store.

    One pass encodes and writes recipes and chunks as they come; chunks, a slice's copies already met, then meet the
    others in one shuffle by content hash and are written once. Recipes, some dozens of bytes each, are range-partitioned
    into ascending doc_id (nulls first, rows that repeat an id one after another), and running totals of the shards give
    each document's start.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = source.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_parts(tokenizer, end_id), _PARTS_DDL)
    parts = written(parts, "encoded", partition_by="kind", compression="zstd")
    chunks = parts.filter("kind = 'chunk'").groupBy("key").agg(F.first("ids").alias("ids"), F.first("n_ids").alias("n_ids"))
    chunks.write.option("compression", "zstd").parquet(f"{store}/chunks")
    slim = parts.filter("kind = 'recipe'").select("doc_id", F.col("key").alias("uid"), F.col("n_ids").alias("n_tokens"), "root", "chunk_ids", "lengths")
    ranged = written(slim.repartitionByRange("doc_id", "uid").withColumn("shard", F.spark_partition_id()), "ranged")
    dropped(parts)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("doc_id", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(totals), "shard")  # a row a shard
    start = F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    final = placed.withColumn("start", start).select("doc_id", "uid", "start", "n_tokens", "root", "chunk_ids", "lengths", "shard")
    final.sortWithinPartitions("shard", "doc_id", "uid").write.partitionBy("shard").parquet(f"{store}/recipes")
    _roots_of_shards(_recipes(spark, store)).write.parquet(f"{store}/manifest")
    dropped(ranged)


def _roots_of_shards(docs: DataFrame) -> DataFrame:
    """(shard, n_docs, n_tokens, root) from documents (shard, doc_id, uid, n_tokens, root)."""
    rows = docs.select("shard", "doc_id", "uid", "n_tokens", "root").repartition("shard").sortWithinPartitions("shard", "doc_id", "uid")
    return rows.select("shard", "n_tokens", "root").mapInArrow(_shard_roots, "shard int, n_docs long, n_tokens long, root binary")


def _recipes(spark: SparkSession, store: str) -> DataFrame:
    fields = "doc_id long, uid binary, start long, n_tokens long, root binary, chunk_ids array<binary>, lengths array<int>, shard int"
    return spark.read.schema(fields).parquet(f"{store}/recipes")


def _chunks(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("key binary, ids binary, n_ids long").parquet(f"{store}/chunks")


def _wide(data: bytes, n: int) -> bytes:
    return data if len(data) == 4 * n else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def _seen(batches: Batches) -> Batches:
    """What the stored bytes of each chunk are: their SHA-256, and the crc32 of their ids as 32-bit numbers."""
    for batch in batches:
        data, n = batch["ids"].to_pylist(), batch["n_ids"].to_pylist()
        columns = {
            "key": batch["key"],
            "read_id": pa.array([hashlib.sha256(d).digest() for d in data], pa.binary()),
            "crc": pa.array([zlib.crc32(_wide(d, k)) for d, k in zip(data, n)], pa.int64()),
            "read_n": pa.array([len(_wide(d, k)) // 4 for d, k in zip(data, n)], pa.int64()),
        }
        yield pa.RecordBatch.from_pydict(columns)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in GF(2)[x] modulo the crc32 polynomial, lowest power in the highest bit."""
    out = np.zeros_like(a)
    for i in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(i) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(_CRC), np.uint32(0))
    return out


def shifted_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part's crc32 adds (by exclusive or) to that of a text in which `after` bytes follow it: crc * x^(8 after)."""
    power = np.full(1, 1 << 23, np.uint32)  # x^8
    total, left = crc.astype(np.uint32), after.astype(np.int64)
    while left.any():
        odd = (left & 1).astype(bool)
        total[odd] = _times(np.broadcast_to(power, odd.sum()).copy(), total[odd])
        power, left = _times(power.copy(), power.copy()), left >> 1
    return total


def _placed(batches: Batches) -> Batches:
    for batch in batches:
        share = shifted_crc(batch["crc"].to_numpy(), batch["after"].to_numpy()) if len(batch) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch["uid"], batch["at"], batch["read_id"], batch["read_n"], pa.array(share, pa.int64())], ["uid", "at", "read_id", "read_n", "share"])


def _rooted(batches: Batches) -> Batches:
    for batch in batches:
        roots = [merkle(x["read_id"] for x in leaves) for leaves in batch["leaves"].to_pylist()]
        rest = batch.drop_columns(["leaves"])
        yield rest.append_column("read_root", pa.array(roots, pa.binary()))


def _read_documents(spark: SparkSession, store: str) -> DataFrame:
    """Recipes with what the stored bytes say: read_n ids of crc32 ids_crc32, and the Merkle root of the chunks read."""
    recipes = _recipes(spark, store)
    seen = _chunks(spark, store).mapInArrow(_seen, "key binary, read_id binary, crc long, read_n long")
    uses = recipes.select("uid", "n_tokens", "lengths", F.posexplode("chunk_ids").alias("at", "key"))
    upto = F.aggregate(F.slice("lengths", F.lit(1), F.col("at") + 1), F.lit(0).cast("long"), lambda s, x: s + x)
    uses = uses.select("uid", "at", "key", (4 * (F.col("n_tokens") - upto)).alias("after"))
    joined = uses.join(seen, "key").select("uid", "at", "after", "read_id", "read_n", "crc")
    placed = joined.mapInArrow(_placed, "uid binary, at int, read_id binary, read_n long, share long")
    whole = placed.groupBy("uid").agg(F.bit_xor("share").alias("ids_crc32"), F.sum("read_n").alias("read_n"), F.sort_array(F.collect_list(F.struct("at", "read_id"))).alias("leaves"))
    whole = whole.mapInArrow(_rooted, "uid binary, ids_crc32 long, read_n long, read_root binary")
    return recipes.select("shard", "doc_id", "uid", "start", "n_tokens", "root").join(whole, "uid", "left")


def verified_shards(spark: SparkSession, store: str, read: DataFrame | None = None) -> DataFrame:
    """(shard, sound) of every shard in the manifest or among the recipes.

    A shard is sound if the documents rebuilt from the stored bytes, in order, give the manifest's count, ids and root:
    changed chunks, changed, added or lost recipes and a changed manifest all show.
    """
    read = _read_documents(spark, store) if read is None else read
    seen = _roots_of_shards(read.select("shard", "doc_id", "uid", F.coalesce("read_n", F.lit(0)).alias("n_tokens"), F.coalesce("read_root", F.lit(b"")).alias("root")))
    seen = seen.select(F.col("shard").alias("s"), F.struct("n_docs", "n_tokens", "root").alias("seen"))
    stated = spark.read.schema("shard int, n_docs long, n_tokens long, root binary").parquet(f"{store}/manifest")
    stated = stated.select("shard", F.struct("n_docs", "n_tokens", "root").alias("stated"))
    both = stated.join(seen, stated["shard"] == seen["s"], "full")
    return both.select(F.coalesce("shard", "s").alias("shard"), F.coalesce(F.col("seen") == F.col("stated"), F.lit(False)).alias("sound"))


def document_digests(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified) of every document, from the stored bytes.

    Every chunk is read and hashed once, where it lies; only digests travel to the documents that use it. crc32 is linear:
    a document's is the exclusive or of its chunks', each shifted by the bytes that follow. `verified` says that the root
    rebuilt from the bytes read is the one on record, and that the document's whole shard agrees with the manifest.
    """
    read = written(_read_documents(spark, store), "read")
    shards = verified_shards(spark, store, read)
    right = (F.col("root") == F.col("read_root")) & (F.col("n_tokens") == F.col("read_n")) & F.col("sound")
    return read.join(shards, "shard", "left").select("doc_id", "start", F.col("read_n").alias("n_tokens"), "ids_crc32", F.coalesce(right, F.lit(False)).alias("verified"))


def documents(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, ids) of every document, rebuilt from its chunks in order."""
    uses = _recipes(spark, store).select("uid", F.posexplode("chunk_ids").alias("at", "key"))
    parts = uses.join(_chunks(spark, store), "key").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("at", "ids", "n_ids"))).alias("parts"))

    def whole(batches: Batches) -> Batches:
        for batch in batches:
            ids = [np.frombuffer(b"".join(_wide(p["ids"], p["n_ids"]) for p in parts), "<u4").astype(np.int32) for parts in batch["parts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["uid"], pa.array(ids, pa.list_(pa.int32()))], ["uid", "ids"])

    return _recipes(spark, store).join(parts.mapInArrow(whole, "uid binary, ids array<int>"), "uid").select("doc_id", "start", "ids")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes `documents` to a store and reads it back: one row per row, null texts being the end id alone. Rows that repeat an
    id follow one another, null ids come first; an empty table gives no rows; other columns are ignored."""
    store = new_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), store, default_path())
    return document_digests(spark, store)
