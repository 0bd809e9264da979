"""MinHash near-dedup: universal hash minima in bands, verified on signatures and on whole sets, and connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.llm.components import components
from websheaf.llm.storage import dropped, met, table, written

#: Contract: words a shingle; sets are linked from SIMILAR hundredths of their union in common.
SHINGLE_WORDS, SIMILAR = 4, 80
#: Bands and minima a band. Sets that have 0.8 in common share no band with a chance of (1 - 0.8 ** 4) ** 32, 5e-8.
BANDS, ROWS = 32, 4
#: Standard deviations under SIMILAR at which a signature's agreement still counts: 1e-9 of linked pairs have less.
DEVIATIONS = 6
#: Sets that meet in one task: those that look for partners, those that are looked at, and shingles of either.
LEFT, RIGHT, SHINGLES = 128, 512, 4_000_000

_SPACE = np.isin(np.arange(256), list(b"\x20\x09\x0a\x0b\x0c\x0d"))
_MINIMA = "doc_id long, text_hash long, uid long, n long, sha binary, signature binary, bands array<long>"
_EDGES = "a long, b long"


def shingles(text: bytes | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 values of the text's word shingles; of the whole sequence if it is shorter; empty without words."""
    a = np.frombuffer((text or b"").lower(), np.uint8)  # lower() of bytes: A-Z only
    space = _SPACE[a]
    keep = ~space
    keep[1:] |= ~space[:-1]
    a = np.where(space, np.uint8(32), a)[keep]
    a = a[int(len(a) > 0 and a[0] == 32) : len(a) - int(len(a) > 1 and a[-1] == 32)]
    if not len(a):
        return np.zeros(0, np.uint64)
    data, marks = a.tobytes(), np.flatnonzero(a == 32)
    starts, ends = np.concatenate(([0], marks + 1)), np.append(marks, len(a))
    if len(starts) > size:
        starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    found, step, digest = [], 1 << 16, xxhash.xxh64_intdigest
    for i in range(0, len(starts), step):
        spans = zip(starts[i : i + step].tolist(), ends[i : i + step].tolist())
        found.append(np.unique(np.array([digest(data[x:y]) for x, y in spans], np.uint64)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Functions a * x + b mod 2^64 with odd a: each maps 64-bit values one to one."""
    r = np.random.default_rng(42)
    return r.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, count, np.uint64)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The upper halves of each function's least value over `values` (not empty)."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 256):
        np.minimum(least, (values[i : i + 256, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketches(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _family(bands * rows)
        for batch in batches:
            texts, out = batch["text"].cast(pa.binary()), ([], [], [], [])
            for i in range(len(batch)):
                own = shingles(texts[i].as_py(), size)
                found = minima(own, a, b).astype("<u4") if len(own) else None
                keys = None if found is None else [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in found.reshape(bands, rows)]
                for column, value in zip(out, (len(own), hashlib.sha256(own.tobytes()).digest() if len(own) else None, None if found is None else found.tobytes(), keys)):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            names = ["doc_id", "text_hash", "uid"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *map(pa.array, out, kinds)], [*names, "n", "sha", "signature", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), size).astype("<u8").tobytes() for t in batch["text"].cast(pa.binary())]
            names = ["node", "signature", "bands"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(found, pa.binary())], [*names, "shingles"])

    return run


def linked(x: np.ndarray, y: np.ndarray, similar: int = SIMILAR) -> bool:
    """Whether two sets, sorted and distinct, share at least `similar` hundredths of their union."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= similar * (len(x) + len(y) - both)


def _forest(similar: int, count: int):
    """Links of a group that join what was apart: sets on the left against those on the right, likeliest first.

    A pair is passed over only if its sizes or its signatures rule a link out, if a smaller band holds both (which is
    that band's group), if it is met the other way round, or if links found before have joined the two already.
    """
    least = int(np.floor(count * (similar / 100 - DEVIATIONS * np.sqrt(similar / 100 * (1 - similar / 100) / count))))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side, node, minor = (group[c].to_numpy() for c in ("side", "node", "minor"))
        band, parent = group["band"][0].as_py(), {}
        comp = group["comp"].to_pylist()
        bands = np.array(group["bands"].to_pylist(), np.int64)
        signature = np.stack([np.frombuffer(x, "<u4") for x in group["signature"].to_pylist()])
        sets = [np.frombuffer(x, "<u8") for x in group["shingles"].to_pylist()]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        left, right, edges = np.flatnonzero(side == 0), np.flatnonzero(side == 1), []
        for i in left:
            alike = (signature[right] == signature[i]).sum(axis=1)
            fits = (alike >= least) & (100 * np.minimum(sizes[right], sizes[i]) >= similar * np.maximum(sizes[right], sizes[i])) & (node[right] != node[i])
            if band >= 0:
                fits &= ((bands[right] == bands[i]).argmax(axis=1) == band) & ~(minor[right] & (node[right] < node[i]))
            for j in right[fits][np.argsort(-alike[fits], kind="stable")]:
                x, y = root(comp[i]), root(comp[j])
                if x != y and linked(sets[i], sets[j], similar):
                    parent[x] = y
                    edges.append((node[i], node[j]))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run


def _dealt(node: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(node), parts)


def _parts(rows: Column, size: Column, most: int) -> Column:
    """Parts of at most about `most` sets and SHINGLES shingles."""
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(most)), F.ceil(size / F.lit(SHINGLES))).cast("long")


def _links_in(placed: DataFrame, by: list[str], sets: DataFrame, similar: int, count: int) -> DataFrame:
    return placed.join(sets, "node").groupBy(*by).applyInArrow(_forest(similar, count), _EDGES)


def _hub_links(members: DataFrame, groups: DataFrame, sets: DataFrame, similar: int, count: int) -> DataFrame:
    """Links of each bucket's members to its hub, the member with most neighbours over all bands.

    A group of near copies has its original for a hub in nearly every band, so each member meets few hubs, and those
    links alone join most groups. A hub is sent to as many parts as its members fill.
    """
    total = members.count()
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = written(members.join(weights, "node").groupBy("band", "key").agg(F.max_by("node", "weight").alias("hub"), F.first("n").alias("n")), "hubs")
    pairs = met(members.drop("n"), hubs, ["band", "key"], "n", total).filter("node <> hub")
    pairs = written(pairs.select("hub", "node", "size").distinct(), "pairs")
    met_by = written(pairs.groupBy("hub").agg(F.count("*").alias("n"), F.sum("size").alias("sizes")).withColumn("parts", _parts(F.col("n"), F.col("sizes"), RIGHT)), "met-by")
    rights = met(pairs, met_by, ["hub"], "n", pairs.count())
    fixed = [F.lit(-1).alias("band"), F.lit(True).alias("minor")]
    rights = rights.select("hub", _dealt(F.col("node"), F.col("parts")).alias("part"), F.lit(1).alias("side"), "node", F.col("node").alias("comp"), *fixed)
    lefts = met_by.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("hub").alias("node"), F.col("hub").alias("comp"), *fixed)
    return _links_in(rights.unionByName(lefts), ["hub", "part"], sets, similar, count)


def _other_links(members: DataFrame, roots: DataFrame, sets: DataFrame, similar: int, count: int) -> DataFrame:
    """Links within buckets whose members are still in several components: those outside the bucket's largest one meet all
    members, in blocks. Only links that join components come out, so rows stay in proportion to the members."""
    placed = written(members.drop("n").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"), "placed")
    per = placed.groupBy("band", "key", "comp").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    open_ = per.groupBy("band", "key").agg(F.max_by("comp", "c").alias("top"), F.count("*").alias("comps"), F.sum("c").alias("n"), F.max("c").alias("most"), F.sum("s").alias("s")).filter("comps > 1")
    blocks = open_.select("band", "key", "top", "n", _parts(F.col("n") - F.col("most"), F.col("s"), LEFT).alias("ls"), _parts(F.col("n"), F.col("s"), RIGHT).alias("rs"))
    rows = written(met(placed, written(blocks, "open"), ["band", "key"], "n", placed.count()), "rows").withColumn("minor", F.col("comp") != F.col("top"))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    fixed = ["band", "key", "node", "comp", "minor"]
    rights = rows.select(*fixed, F.lit(1).alias("side"), _dealt(F.col("node"), F.col("rs")).alias("j"), every("ls").alias("i"))
    lefts = rows.filter("minor").select(*fixed, F.lit(0).alias("side"), _dealt(F.col("node"), F.col("ls")).alias("i"), every("rs").alias("j"))
    return _links_in(rights.unionByName(lefts), ["band", "key", "i", "j"], sets, similar, count)


def _links(nodes: DataFrame, source: DataFrame, size: int, similar: int, count: int) -> DataFrame:
    """Edges (a, b) that connect exactly the nodes which chains of links connect; `nodes` has a row for each distinct set."""
    keyed = nodes.select("node", F.col("n").alias("size"), F.posexplode("bands").alias("band", "key"))
    groups = written(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = written(met(keyed, groups, ["band", "key"], "n", nodes.count()), "members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "node", "signature", "bands")
    wanted = written(wanted, "wanted")
    same = source["doc_id"].eqNullSafe(wanted["id"]) & source["text_hash"].eqNullSafe(wanted["hash"])
    sets = written(source.join(wanted, same).select("node", "signature", "bands", "text").mapInArrow(_sets(size), "node long, signature binary, bands array<long>, shingles binary"), "sets")
    if sets.count() > wanted.count():  # rows that repeat id and text
        sets = written(sets.dropDuplicates(["node"]), "sets")
    first = written(_hub_links(members, groups, sets, similar, count), "links")
    others = written(_other_links(members, components(first), sets, similar, count), "links")
    for used in (groups, members, wanted, sets):
        dropped(used)
    return first.union(others)


def near_duplicates(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, similar: int = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id long, text string; other columns are ignored): doc_id, n_shingles, component_id, kept.

    A text's set holds its distinct shingles of `shingle_words` words, A-Z lower-cased; a shorter text is one shingle; null and
    wordless texts have none and are linked with nothing, not even one another. Sets are linked if 100 times their
    intersection is at least `similar` times their union, counted on 64-bit values of all their shingles. component_id is the
    smallest doc_id that chains of links reach, the row's own included (null if all are); kept says that it is the own one.

    Each text is cut once into bands * rows minima. Equal sets are one node. Nodes that share a band are candidates: first
    each against its bucket's hub, then what that left apart against the rest of the bucket, in blocks; never are all
    pairs of a bucket written. Only nodes in buckets have their whole sets made, in a second pass over the texts.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    cut = source.withColumn("uid", F.monotonically_increasing_id()).select("doc_id", "text_hash", "uid", "text")
    sketches = written(cut.mapInArrow(_sketches(shingle_words, bands, rows), _MINIMA), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")).alias("first")
    classes = sketches.filter("n > 0").groupBy("sha").agg(first, F.count("*").alias("copies"))
    classes = written(classes.select("sha", "copies", F.col("first.doc_id").alias("least"), F.col("first.uid").alias("node")), "classes")
    nodes = sketches.join(classes.select(F.col("node").alias("uid"), "node"), "uid").select("node", "doc_id", "text_hash", "n", "signature", "bands")
    nodes = written(nodes, "nodes")
    roots = components(_links(nodes, source, shingle_words, similar, bands * rows))
    rooted = classes.join(roots, "node", "left").select("sha", "copies", "least", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = written(met(rooted, written(named, "named"), ["root"], "n", rooted.count()).select("sha", "copies", "component_id"), "components")
    dropped(nodes)
    own = sketches.select("doc_id", F.col("n").alias("n_shingles"), "sha")
    shared = met(own.filter("n_shingles > 0"), named, ["sha"], "copies", sketches.count())
    found = shared.select("doc_id", "n_shingles", "component_id").unionByName(own.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of `documents`. Null and wordless texts have n_shingles 0 and stand alone; a null id is smaller than none, so
    such a row is kept only where its whole component has no id; rows that repeat an id or a text each have their row; an
    empty table gives no rows; columns other than doc_id and text are ignored."""
    return near_duplicates(table(spark, sf_dir, "documents"))
