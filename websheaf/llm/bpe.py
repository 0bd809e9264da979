"""BPE as a bounded-lookahead streaming transducer, and decoding as an incremental byte-to-text machine."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.llm.storage import table, text_slices

#: Characters that a transducer takes at a time; a run of this length is passed on before its end is known.
PIECE, LONG_RUN, RUN_TAIL = 1 << 15, 1 << 12, 16
#: Characters of texts whose ids are held at once where ids are the result.
SLICE = 4_000_000
#: Words whose ids are remembered, in each of two generations.
CACHED_WORDS = 1 << 18
_NEVER = 1 << 60

#: The splitting pattern of byte-level BPE, with L letters, N numbers, S white space.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Letters and numbers that are younger than the character tables with which the vocabulary's library splits.
_LATER_LETTERS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_LATER_NUMBERS = "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
_L, _N = f"[\\p{{L}}--[{_LATER_LETTERS}]]", f"[\\p{{N}}--[{_LATER_NUMBERS}]]"
_ANY = regex.compile(_SPLIT.format(L=_L, N=_N, S=r"\p{White_Space}"), regex.V1)
_LATIN = re.compile(_SPLIT.format(L="A-Za-zªµºÀ-ÖØ-öø-ɏ", N="0-9²³¹¼½¾", S="\\t\\n\\x0b\\x0c\\r \\x85\\xa0"))
_BEYOND_LATIN = re.compile("[^\\x00-\\u024f]")


def words_of(text: str) -> list[str]:
    """The pieces between which merges never reach."""
    return (_ANY if _BEYOND_LATIN.search(text) else _LATIN).findall(text)


def byte_letters() -> dict[str, int]:
    """Vocabulary files write printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Settings of a tokenizers file that this module (and the token store) reproduces; any other changes the ids.
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
_SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def refuse_other_kinds(spec: dict) -> None:
    """ValueError unless the file describes plain byte-level BPE with the usual split and literal added tokens."""
    model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [f"model.{k}" for k, v in _MODEL.items() if (model.get(k, v) or v) != v]
    wrong += [f"pre_tokenizer.{k}" for k, v in _SPLITTER.items() if splitter.get(k, True if k == "use_regex" else None) != v]
    wrong += [k for k in ("normalizer",) if spec.get(k)]
    wrong += [f"added_tokens.{k}" for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip") if t.get(k)]
    if wrong:
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(wrong)}")


class Vocabulary:
    """Token bytes, merges and special tokens of a tokenizers JSON file, and the lookahead that its merges need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_other_kinds(spec)
        letter = byte_letters()
        ids = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(map(letter.__getitem__, t)) for t, i in ids.items()}
        self.byte_id = [0] * 256
        for c, b in letter.items():
            self.byte_id[b] = ids[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.rank = {a << 16 | b: r for (a, b), (r, _) in self.merges.items()}
        self.made = {r: m for r, m in self.merges.values()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.specials.items()}
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.lookahead = self._sufficient_lookahead()

    def _sufficient_lookahead(self) -> int:
        """Bytes right of a boundary that decide whether any merge removes it.

        Merge (u, v) at a boundary needs v whole: its own bytes, and that no earlier merge (x, w), x a right end of v,
        takes v's end away; the same holds at the boundary itself for right ends of u. Going by rank, `need[x]` is the
        most that the merges seen so far with x on the left look ahead.
        """
        right: dict[int, int] = {}
        need: dict[int, int] = {}

        def over_right_ends(token: int) -> int:
            most = need.get(token, 0)
            while (token := right.get(token, -1)) >= 0:
                most = max(most, need.get(token, 0))
            return most

        for (u, v), (_, made) in sorted(self.merges.items(), key=lambda x: x[1][0]):
            need[u] = max(need.get(u, 0), len(self.bytes_of[v]) + over_right_ends(v), over_right_ends(u))
            right.setdefault(made, v)
        return max(need.values(), default=0)

    def merged(self, data: bytes) -> list[int]:
        """The ids of `data`, which no split divides: lowest rank first, leftmost first."""
        ids = [*map(self.byte_id.__getitem__, data)]
        if len(ids) <= 48:
            rank, made = self.rank.get, self.made
            ranks = [rank(a << 16 | b, _NEVER) for a, b in zip(ids, ids[1:])]
            while ranks:
                best = min(ranks)
                if best == _NEVER:
                    break
                i = ranks.index(best)
                ids[i] = new = made[best]
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = rank(ids[i - 1] << 16 | new, _NEVER)
                if i < len(ranks):
                    ranks[i] = rank(new << 16 | ids[i + 1], _NEVER)
            return ids
        merges = self.merges
        n = len(ids)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = made, False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if m := merges.get((made, ids[after[j]])):
                    heapq.heappush(queue, (m[0], i, made, ids[after[j]], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], made))):
                heapq.heappush(queue, (m[0], h, ids[h], made, m[1]))
        return [t for t, on in zip(ids, alive) if on]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Run:
    """Ids of one undivided run of bytes that arrives in parts, each emitted once no later byte can change it."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.held = vocab, bytearray()

    def feed(self, data: bytes, final: bool) -> list[int]:
        self.held += data
        block, out = 4 * self.vocab.lookahead + 512, []
        while len(self.held) > block or final and self.held:
            part = bytes(self.held[:block])
            ids = self.vocab.merged(part)
            if len(part) == len(self.held) and final:
                self.held.clear()
                return out + ids
            at, stable = 0, len(part) - self.vocab.lookahead
            for t in ids:
                if at + len(self.vocab.bytes_of[t]) > stable:
                    break
                at += len(self.vocab.bytes_of[t])
                out.append(t)
            del self.held[:at]
        return out


class Encoder:
    """feed() returns the ids that are settled; finish() the rest. Memory does not follow the text's length."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.young, self.old = vocab, {}, {}
        self._reset()

    def _reset(self) -> None:
        self.special_part, self.carry, self.run = "", "", None

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word)
        if ids is None:
            ids = tuple(self.vocab.merged(word.encode()))
        if len(self.young) >= CACHED_WORDS:
            self.old, self.young = self.young, {}
        if len(word) <= 64:
            self.young[word] = ids
        return ids

    def _plain(self, text: str, final: bool) -> list[int]:
        words = words_of(self.carry + text)
        hold = 0 if final or not words else 1 if len(words[-1]) > 2 else 2
        rest = words[len(words) - hold :]
        out: list[int] = []
        if words and self.run and len(rest) < len(words):
            out += self.run.feed(words[0].encode(), True)
            self.run, done = None, 1
        else:
            done = 0
        known, miss = self.young.get, self._word
        for w in words[done : len(words) - hold]:
            ids = known(w)
            out += miss(w) if ids is None else ids
        if rest and len(rest[0]) > LONG_RUN:
            self.run = self.run or _Run(self.vocab)
            out += self.run.feed(rest[0][:-RUN_TAIL].encode(), False)
            rest[0] = rest[0][-RUN_TAIL:]
        self.carry = "".join(rest)
        return out

    def feed(self, text: str, final: bool = False) -> list[int]:
        text, out, at = self.special_part + text, [], 0
        self.special_part = ""
        if self.vocab.special_split:
            for m in self.vocab.special_split.finditer(text):
                out += self._plain(text[at : m.start()], True)
                out.append(self.vocab.specials[m[0]])
                at = m.end()
            if not final:
                k = max((k for s in self.vocab.specials for k in range(1, len(s)) if text.endswith(s[:k], at)), default=0)
                self.special_part = text[len(text) - k :]
                text = text[: len(text) - k]
        return out + self._plain(text[at:], final)

    def finish(self) -> list[int]:
        out = self.feed("", True)
        self._reset()
        return out

    def emissions(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, piece by piece as they become certain; what was fed before is forgotten."""
        self._reset()
        for i in range(0, len(text), PIECE):
            yield self.feed(text[i : i + PIECE])
        yield self.finish()

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.emissions(text) for i in ids]


@lru_cache(maxsize=2)
def process_encoder(path: str) -> Encoder:
    """One encoder a worker process: tasks that follow one another find its word memory filled."""
    return Encoder(vocabulary(path))


class Decoder:
    """Text of ids that arrive in parts: bytes of an unfinished character wait, malformed ones become U+FFFD."""

    def __init__(self, vocab: Vocabulary):
        self.bytes_of, self.state = vocab.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        text = self.state.decode(b"", True)
        self.state.reset()
        return text


Batches = Iterator[pa.RecordBatch]


def _encoded(path: str, batches: Batches) -> Batches:
    encoder = process_encoder(path)
    for batch in batches:
        texts = batch["text"].to_pylist()
        for a, b in text_slices(texts, SLICE):
            ids = [np.concatenate([np.array(x, np.int32) for x in encoder.emissions(t or "")]) for t in texts[a:b]]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
            lists = pa.LargeListArray.from_arrays(ends, np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a).cast(pa.int64()), lists.cast(pa.list_(pa.int32()))], ["doc_id", "ids"])


def _decoded(path: str, batches: Batches) -> Batches:
    decoder = Decoder(vocabulary(path))
    for batch in batches:
        texts = []
        for ids in batch["ids"]:
            ids = ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int32)
            parts = [decoder.feed(ids[i : i + PIECE].tolist()) for i in range(0, len(ids), PIECE)]
            texts.append("".join(parts) + decoder.finish())
        yield batch.append_column("text", pa.array(texts, pa.string()))


def _round_trips(path: str, batches: Batches) -> Batches:
    """Digests of ids and decoded texts, made as the encoder emits: one text's piece and its ids are held at a time."""
    encoder, decoder = process_encoder(path), Decoder(vocabulary(path))
    for batch in batches:
        found = []
        for text in batch["text"]:
            n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
            for ids in encoder.emissions(text.as_py() or ""):
                n += len(ids)
                of_ids.update(np.array(ids, "<u4").tobytes())
                of_text.update(decoder.feed(ids).encode())
            of_text.update(decoder.finish().encode())
            found.append((n, of_ids.hexdigest(), of_text.hexdigest()))
        columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.string(), pa.string()))] if found else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.string())]
        yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row; null texts count as empty and have no ids. No shuffle; rows keep their number."""
    return _source(docs).mapInArrow(lambda b: _encoded(path, b), "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of every row of (doc_id, ids)."""
    return tokens.select("doc_id", "ids").mapInArrow(lambda b: _decoded(path, b), "doc_id long, ids array<int>, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids of every row and of the text that they decode to, in one pass over the documents; a task's memory is
    its Arrow batch and one piece of a text, however long texts are."""
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _source(docs).mapInArrow(lambda b: _round_trips(path, b), fields)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of `documents`: digests of its ids and of their decoded text. Null texts count as empty (no ids); rows
    that repeat an id each have their row; an empty table gives no rows; columns other than doc_id and text are ignored."""
    return round_trip_digests(table(spark, sf_dir, "documents"), default_path())
