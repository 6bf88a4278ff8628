"""Operator 13: phrase collocations, level by level, counted in the slots of minimal perfect hashes.

A word's id is a 64-bit hash of language and word, tested to be free of collisions with any frequent word. A frequent phrase of k words has
as its id its slot among the frequent phrases of k words, and a phrase of k + 1 words is a pair of ids: of its first and
of its last k words. So a pair of ids both of which are frequent is all that the Apriori property asks for, and a stored
key is two numbers, compared exactly.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import discard
from .common import bitmap, bytes_of, inside, materialise, new_path, own, pieces

#: Pairs in a perfect hash, counts in a block of an array, arrays that one step of a tree sums, ids that a task counts at once.
SLICE, BLOCK, FAN, FLUSH = 1 << 19, 1 << 11, 32, 1 << 19
#: Pairs that a task remembers to have sent.
MEMO = 1 << 20
#: Rows that Spark hands to a task's Python at once, of texts, of about ROW ids (or one piece of text) or of BLOCK counts, and the bytes of
#: such a batch. Spark's reader takes as many rows, so that no array in an executor's heap is wide, however many rows there are.
ROWS, ROW, BATCH = 500, 1 << 10, "4m"
#: Lower case; separators become line ends, tabs blanks. A lone full stop, which no word holds, then stands for a break.
FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words in their order, with b"." wherever a piece ends."""
    return text.translate(FOLD).replace(b"\n", b" . ").split()


def mixed(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of pairs."""
    h = p * np.uint64(0x9E3779B97F4A7C15) ^ (s + np.uint64(0x7F4A7C159E3779B9)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def cell(h: np.ndarray, slices: int) -> np.ndarray:
    """The slice of a pair, from 16 bits of its hash."""
    return ((h & np.uint64(0xFFFF)).astype(np.int64) * slices) >> 16


class PerfectHash:
    """Minimal: n keys have the slots 0 to n - 1. Keys that meet no other in a level's bits stay there, the rest go on.

    `p` and `s` hold the keys by slot, so that a pair which is no key is told from one by comparison.
    """

    def __init__(self, p: np.ndarray, s: np.ndarray):
        self.levels, self.p, self.s = [], np.zeros(len(p), np.uint64), np.zeros(len(p), np.uint64)
        h, left, ranked = mixed(p, s), np.arange(len(p)), 0
        self.odd = {}  # keys whose hashes are equal: a slot each, by the key itself
        order = np.argsort(h, kind="stable")
        equal = h[order][1:] == h[order][:-1]
        twins = np.unique(np.concatenate([order[1:][equal], order[:-1][equal]])) if equal.any() else left[:0]
        left = np.setdiff1d(left, twins)
        while len(left):
            size = max(64, 2 * len(left))
            at = self.place(h[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(-(-size // 64), np.uint64)
            np.bitwise_or.at(bits, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
            before = ranked + np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])[:-1]
            self.levels.append((size, bits, before))
            slot = self.rank(bits, before, at[alone])
            self.p[slot], self.s[slot] = p[left[alone]], s[left[alone]]
            ranked += int(alone.sum())
            left = left[~alone]
        for i in twins:
            self.odd[int(p[i]), int(s[i])] = ranked
            self.p[ranked], self.s[ranked], ranked = p[i], s[i], ranked + 1

    @staticmethod
    def place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (h + np.uint64(level + 1)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(30)
        return ((x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(size)).astype(np.int64)

    @staticmethod
    def rank(bits: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        below = bits[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return before[at >> 6] + np.bitwise_count(below)

    def slots(self, p: np.ndarray, s: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The slot of every pair, -1 of one that is no key."""
        out, left = np.full(len(p), -1, np.int64), np.arange(len(p))
        for level, (size, bits, before) in enumerate(self.levels):
            at = self.place(h[left], level, size)
            hit = (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            slot, who = self.rank(bits, before, at[hit]), left[hit]
            same = (self.p[slot] == p[who]) & (self.s[slot] == s[who])
            out[who[same]] = slot[same]
            left = left[~hit]
        for (a, b), slot in self.odd.items():
            out[(p == np.uint64(a)) & (s == np.uint64(b))] = slot
        return out


_loaded: dict[str, PerfectHash] = {}


def hash_at(uri: str) -> PerfectHash:
    """The perfect hash of a file; a worker keeps the last four."""
    if uri not in _loaded:
        while len(_loaded) >= 4:
            _loaded.pop(next(iter(_loaded)))
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_stream(path, compression=None) as file:
            _loaded[uri] = pickle.loads(file.read())
    return _loaded[uri]


def perfect(pairs: DataFrame) -> list[str]:
    """Files in the shared folder, each with the perfect hash of a slice of the distinct pairs (`cell16`, `p`, `s`).

    A slice has about SLICE pairs, dealt by hash and built in a task of its own; the driver sees the names alone.
    """
    folder, slices = new_path(pairs.sparkSession, "perfect"), max(1, -(-pairs.count() // SLICE))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = PerfectHash(rows["p"].to_numpy().view(np.uint64), rows["s"].to_numpy().view(np.uint64))
        uri = f"{folder}/{uuid.uuid4().hex}"
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path, compression=None) as file:
            file.write(pickle.dumps(made))
        return pd.DataFrame({"slice": [key[0]], "uri": [uri]})

    dealt = pairs.select(F.floor(F.col("cell16") * slices / 65536).cast("int").alias("slice"), "p", "s")
    made = {r["slice"]: r.uri for r in materialise(dealt.groupBy("slice").applyInPandas(build, "slice int, uri string"), "perfect-list").collect()}
    return [made.get(i, "") for i in range(slices)]


def found(uris: list[str], p: np.ndarray, s: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slice by slice: its number, where its keys stand among the pairs, and their slots."""
    h = mixed(p, s)
    dealt = cell(h, len(uris))
    for i, uri in enumerate(uris):
        if uri:
            at = np.flatnonzero(dealt == i) if len(uris) > 1 else np.arange(len(p))
            slot = hash_at(uri).slots(p[at], s[at], h[at])
            yield i, at[slot >= 0], slot[slot >= 0]


def labelled(uris: list[str], p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The id of every pair, from its slice and slot; 0 of one that is no key."""
    out = np.zeros(len(p), np.uint64)
    for i, at, slot in found(uris, p, s):
        out[at] = (np.uint64(i) << np.uint64(32)) + slot.astype(np.uint64) + np.uint64(1)
    return out


def runs(ids: np.ndarray) -> np.ndarray:
    """Ids with one 0 between runs and at the end; runs of one id, which make no pair, go."""
    near = np.concatenate([[False], ids != 0, [False]])
    keep = near[1:-1] & (near[:-2] | near[2:])
    ends = np.concatenate([keep[:-1] & ~keep[1:], keep[-1:]])
    at = np.flatnonzero(keep)
    out = ids[at]
    return np.insert(out, np.searchsorted(at, np.flatnonzero(ends), "right"), np.uint64(0))


#: Ids with the number of the part, a task's output, in which they were written.
IDS = "part int, ids array<long>"


def rows_of(ids: np.ndarray, most: int = ROW) -> Iterator[pa.RecordBatch]:
    """Rows of IDS of about `most` ids, cut at a 0 only."""
    zeros, begin, part = np.flatnonzero(ids == 0), 0, pa.array([TaskContext.get().partitionId()], pa.int32())
    while begin < len(ids):
        end = int(zeros[min(np.searchsorted(zeros, begin + most), len(zeros) - 1)]) + 1
        yield pa.RecordBatch.from_arrays([part, pa.array([ids[begin:end].view(np.int64)], pa.list_(pa.int64()))], ["part", "ids"])
        begin = end


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """The ids of a task, about FLUSH of one part at once, after the part's number; rows end with a 0."""
    held, n, last = [], 0, 0
    for b in batches:
        lists = b.column(1)
        for row, part in enumerate(b.column(0).to_pylist()):
            if n and (n >= FLUSH or part != last):
                yield last, np.concatenate(held)
                held, n = [], 0
            held.append(lists.slice(row, 1).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            n, last = n + len(held[-1]), part
    if n:
        yield last, np.concatenate(held)
    held.clear()
    pa.default_memory_pool().release_unused()


def pairs_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring ids that are both frequent."""
    both = (ids[:-1] != 0) & (ids[1:] != 0)
    return ids[:-1][both], ids[1:][both]


def tree_sum(parts: DataFrame) -> DataFrame:
    """Sum arrays (`slice`, `block`, `task`, `counts`) elementwise, FAN tasks at a time, until each block has one.

    A group of a step holds the arrays of FAN tasks for a block of fixed width.
    """
    tasks = parts.agg(F.max("task")).first()[0] or 0

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for counts in rows["counts"]:
            total += np.frombuffer(counts, np.int64)
        return pd.DataFrame({"slice": [key[0]], "block": [key[1]], "task": [key[2]], "counts": [total.tobytes()]})

    while True:
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN).cast("long")).groupBy("slice", "block", "task").applyInPandas(add, "slice int, block int, task long, counts binary")
        if tasks < FAN:
            return parts
        tasks //= FAN


PARTS = "slice int, block int, task long, counts binary"


def blocks(slice_: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of an array that are not all 0, as rows of PARTS."""
    task = TaskContext.get().partitionId()
    for block, begin in enumerate(range(0, len(counts), BLOCK)):
        part = counts[begin : begin + BLOCK]
        if part.any():
            part = np.concatenate([part, np.zeros(BLOCK - len(part), part.dtype)])
            yield pa.RecordBatch.from_arrays([pa.array([slice_], pa.int32()), pa.array([block], pa.int32()), pa.array([task], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["slice", "block", "task", "counts"])


#: Bits of a hash that deal it to one of the parts which have it.
DEAL = 0xFFF


def frequent_hashes(ids: DataFrame, least: int) -> DataFrame:
    """`h`, `n`, `part` of the hashes that `least` pairs or more have: a pair with another hash cannot be frequent.

    Tasks add up equal hashes before they send them, so that no pair is common in what is exchanged. `part` is one of those that have
    the hash, dealt evenly by its bits.
    """

    def count(batches):
        for part, flat in gathered(batches):
            h, n = np.unique(mixed(*pairs_of(flat)), return_counts=True)
            turn = np.int32(part) ^ (h & np.uint64(DEAL)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(turn)], ["h", "n", "turn"])

    sums = ids.mapInArrow(count, "h long, n int, turn int").groupBy("h").agg(F.sum("n").alias("n"), F.min("turn").alias("turn"))
    return sums.where(F.col("n") >= least).select("h", "n", F.col("turn").bitwiseXOR(F.col("h").bitwiseAND(F.lit(DEAL)).cast("int")).alias("part"))


def likely(hashes: DataFrame, owned: bool) -> np.ndarray:
    """A bitmap of the hashes, if `owned` each mixed with its part."""
    return bitmap(hashes.select(F.col("h").bitwiseXOR(F.shiftleft(F.col("part").cast("long"), 38)).alias("h") if owned else "h"))


class Sent:
    """The pairs that a task has sent, in MEMO places by hash: the last pair of each place. It never takes a pair for another."""

    def __init__(self):
        self.p, self.s = np.zeros(MEMO, np.uint64), np.zeros(MEMO, np.uint64)  # 0 is no id

    def new(self, p: np.ndarray, s: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Which of these distinct pairs have not been sent, or were forgotten since; they are remembered."""
        at = (h >> np.uint64(16)) % np.uint64(MEMO)  # the low bits deal pairs to slices
        fresh = (self.p[at] != p) | (self.s[at] != s)
        places, last = np.unique(at[fresh][::-1], return_index=True)  # one pair a place
        self.p[places], self.s[places] = p[fresh][::-1][last], s[fresh][::-1][last]
        return fresh


def candidates(ids: DataFrame, hashes: np.ndarray, owned: bool) -> DataFrame:
    """Neighbouring pairs of frequent ids (with a likely hash), with the 16 bits that deal them to slices.

    If `owned`, a pair is sent from the one part of its hash, else from every task that has it. A task sends a pair again
    only if another one took its place among those that it remembers.
    """
    known = ids.sparkSession.sparkContext.broadcast(hashes)

    def pick(batches):
        sent = Sent()
        for part, flat in gathered(batches):
            p, s = pairs_of(flat)
            h = mixed(p, s)
            keep = inside(known.value, h ^ np.uint64(part << 38 & 2**64 - 1) if owned else h)
            p, s, h = p[keep], s[keep], h[keep]
            order = np.lexsort((s, p))
            p, s, h = p[order], s[order], h[order]
            new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])]) if len(p) else np.zeros(0, bool)
            p, s, h = p[new], s[new], h[new]
            new = sent.new(p, s, h)
            columns = [pa.array((h[new] & np.uint64(0xFFFF)).astype(np.int32)), pa.array(p[new].view(np.int64)), pa.array(s[new].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["cell16", "p", "s"])

    return ids.mapInArrow(pick, "cell16 int, p long, s long")


def frequent_pairs(ids: DataFrame, least: int) -> DataFrame:
    """`p`, `s`, `f` of the neighbouring pairs that occur `least` times or more.

    A candidate is sent from one part. Only pairs of equal hashes may be missed by that: then the pairs found are fewer than the hashes
    counted, and every task sends its candidates.
    """
    hashes = materialise(frequent_hashes(ids, least), "phrase-hashes")
    wanted = hashes.agg(F.sum("n")).first()[0]
    for owned in (True, False):
        pairs = materialise(candidates(ids, likely(hashes, owned), owned).distinct(), "phrase-candidates")
        kept = counted(ids, perfect(pairs), least)
        discard(pairs)
        if not owned or kept.agg(F.sum("f")).first()[0] == wanted:
            break
        discard(kept)
    discard(hashes)
    return kept


def counted(ids: DataFrame, uris: list[str], least: int) -> DataFrame:
    """`p`, `s`, `f` of the keys that occur `least` times or more: tasks count into arrays, a tree sums them."""

    def count(batches):
        held: dict[int, np.ndarray] = {}
        for _, flat in gathered(batches):
            for i, _, slot in found(uris, *pairs_of(flat)):
                if len(held) >= 4 and i not in held:
                    for j, counts in held.items():
                        yield from blocks(j, counts)
                    held = {}
                n = len(hash_at(uris[i]).p)
                held[i] = held.get(i, 0) + np.bincount(slot, minlength=n)
        for j, counts in held.items():
            yield from blocks(j, counts)

    def frequent(batches):
        for b in batches:
            for i, block, counts in zip(*(b.column(c).to_pylist() for c in ("slice", "block", "counts"))):
                f, keys = np.frombuffer(counts, np.int64), hash_at(uris[i])
                at = np.flatnonzero(f >= least)
                slot = block * BLOCK + at
                yield pa.RecordBatch.from_arrays([pa.array(keys.p[slot].view(np.int64)), pa.array(keys.s[slot].view(np.int64)), pa.array(f[at])], ["p", "s", "f"])

    parts = materialise(ids.mapInArrow(count, PARTS), "phrase-counts")
    sums = materialise(tree_sum(parts), "phrase-sums")  # so that no task needs two Python workers
    out = materialise(sums.mapInArrow(frequent, "p long, s long, f long"), "phrase-frequent")
    discard(parts)
    discard(sums)
    return out


def relabelled(ids: DataFrame, uris: list[str]) -> DataFrame:
    """Each id replaced by that of the frequent pair which begins there; what makes no pair goes."""

    def label(batches):
        for _, flat in gathered(batches):
            at = np.flatnonzero((flat[:-1] != 0) & (flat[1:] != 0))
            out = np.zeros(len(flat), np.uint64)
            out[at] = labelled(uris, flat[at], flat[at + 1])
            yield from rows_of(runs(out))

    return materialise(ids.mapInArrow(label, IDS), "phrase-ids")


def with_ids(pairs: DataFrame, uris: list[str]) -> DataFrame:
    @F.arrow_udf("long")
    def label(p: pa.Array, s: pa.Array) -> pa.Array:
        return pa.array(labelled(uris, p.to_numpy().view(np.uint64), s.to_numpy().view(np.uint64)).view(np.int64))

    return pairs.withColumn("id", label("p", "s"))


def lang_of(docs: DataFrame, lang_col: str) -> Column:
    return F.coalesce(own(docs, lang_col).cast("string"), F.lit("und"))


def word_counts(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """`lang`, `word`, `f` of every word; a task adds up until it holds `most` words."""

    def count(batches):
        held: dict[str, Counter] = {}

        def flush():
            for lang, counts in held.items():
                counts.pop(b".", None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "f"])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), bytes_of(b.column(1))):
                held.setdefault(lang, Counter()).update(tokens(text))
                if sum(map(len, held.values())) >= most:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def unmistakable(words: DataFrame, least: int) -> str:
    """A salt with which no frequent word shares its hash with another word."""
    for n in range(100):
        hashed = words.select(word_id(f"{n}").alias("h"), "f")
        if not hashed.groupBy("h").agg(F.count("*").alias("n"), F.max("f").alias("f")).where((F.col("n") > 1) & (F.col("f") >= least)).limit(1).collect():
            return f"{n}"
    raise ValueError("no salt tells the words apart")


def word_id(salt: str) -> Column:
    return F.xxhash64(F.lit(salt), "lang", "word")


class Ids(dict):
    """Memo of the ids of a language's words; 0 of a break and of words that are not frequent. Emptied when it holds `most`."""

    def __init__(self, lang: str, salt: str, bits: np.ndarray, most: int = 50_000):
        super().__init__({b".": 0})
        self.seed, self.bits, self.most = xxhash.xxh64_intdigest(lang.encode(), xxhash.xxh64_intdigest(salt.encode(), 42)), bits, most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        value = h if self.bits[h >> 44] >> np.uint64(h >> 38 & 63) & np.uint64(1) else 0
        if len(self) >= self.most:
            self.clear()
            self[b"."] = 0
        if len(word) < 64:
            self[word] = value
        return value


def encoded(rows: DataFrame, salt: str, bits: np.ndarray) -> DataFrame:
    """Rows of ids of words in their order, 0 between pieces and where words are not frequent (`bits` says so of most)."""
    known = rows.sparkSession.sparkContext.broadcast(bits)

    def encode(batches):
        memo: dict[str, Ids] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), bytes_of(b.column(1))
            for i, j in pieces(texts, 2_000_000):
                flat: list[np.ndarray] = []
                for lang, text in zip(langs[i:j], texts[i:j]):
                    if lang not in memo:
                        if len(memo) >= 8:
                            memo.clear()
                        memo[lang] = Ids(lang, salt, known.value)
                    ids = memo[lang]
                    flat.append(np.fromiter(map(ids.__getitem__, tokens(text)), np.uint64))
                    flat.append(np.zeros(1, np.uint64))
                yield from rows_of(runs(np.concatenate(flat)))

    return materialise(rows.mapInArrow(encode, IDS), "phrase-ids")


def scored(phrases: DataFrame) -> DataFrame:
    """Add `l`, `r` and `score` of the cut with the lowest score: whole numbers without bounds."""

    @F.arrow_udf("struct<l:long,r:long,score:long>")
    def cut(a: pa.Array, n: pa.Array, heads: pa.Array, tails: pa.Array) -> pa.Array:
        out = []
        for a_, n_, h, t in zip(a.to_pylist(), n.to_pylist(), heads.to_pylist(), tails.to_pylist()):
            score, k = min((1000 * a_ * n_ // (h[k] * t[-1 - k]), k) for k in range(len(h)))
            out.append({"l": h[k], "r": t[-1 - k], "score": score})
        return pa.array(out, pa.struct([("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64())]))

    return phrases.withColumn("cut", cut("a", "n", "heads", "tails")).select("lang", "phrase", "a", F.col("cut")["l"].alias("l"), F.col("cut")["r"].alias("r"), "n", F.col("cut")["score"].alias("score"))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, most: int | None = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Phrases of 2 to `longest` words by language: `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`.

    A null language is `und`. Null, empty and blank texts have no words; long ones are counted whole, repeated rows each;
    ties of score go by `a`, then by the phrase's bytes, and no two phrases of a language are equal. Empty tables, and
    tables without a phrase that occurs `least` times, give no rows. Other columns are ignored.

    No text is exchanged: tasks exchange counts of words, distinct candidates and arrays of counts. A task's memory is
    bounded by FLUSH ids, MEMO pairs and one perfect hash of SLICE pairs; candidates beyond that are more slices, which a task goes
    through in turn. Of the pairs of frequent phrases, whose number grows fastest, only those are candidates whose
    hash `least` pairs have, and each is sent from one of the parts that have it; a bitmap of fixed size says so, and lets a few
    others pass, which are counted in vain.
    """
    with small_batches(docs.sparkSession):
        return best(*counted_levels(docs.select(lang_of(docs, lang_col).alias("lang"), own(docs, text_col).cast("string").alias("text")), least, longest), most)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """ROWS a batch, of BATCH bytes at most, while the levels are counted, which is done when this ends."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": BATCH, "spark.sql.parquet.columnarReaderBatchSize": str(ROWS)}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def counted_levels(rows: DataFrame, least: int, longest: int) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of each length, and the words of each language, from `lang` and `text`; all are stored."""
    words = materialise(word_counts(rows), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    salt = unmistakable(words, least)
    frequent = materialise(words.where(F.col("f") >= least).select(word_id(salt).alias("id"), "lang", "word", "f"), "phrase-frequent-words")
    ids = encoded(rows, salt, bitmap(frequent.select(F.col("id").alias("h"))))
    # an id's phrase, and the counts of its first and last 1, 2, ... words
    level = frequent.select("id", "lang", F.array("word").alias("words"), F.array("f").alias("heads"), F.array("f").alias("tails"))
    levels: list[DataFrame] = []
    for k in range(2, longest + 1):
        kept = frequent_pairs(ids, least)
        uris = perfect(with_cells(kept))
        first, last = (level.select(*[F.col(c).alias(f"{side}_{c}") for c in level.columns]) for side in ("first", "last"))
        joined = with_ids(kept, uris).join(first, F.col("p") == F.col("first_id")).join(last, F.col("s") == F.col("last_id"))
        words_of = F.concat("first_words", F.slice("last_words", -1, 1))
        level = materialise(
            joined.select("id", "p", "s", "f", F.col("first_lang").alias("lang"), words_of.alias("words"), F.concat("first_heads", F.array("f")).alias("heads"), F.concat("last_tails", F.array("f")).alias("tails")),
            "phrase-level",
        )
        levels.append(level)
        level = level.drop("p", "s", "f")
        if k < longest:
            done, ids = ids, relabelled(ids, uris)
            discard(done)
        discard(kept)
    discard(ids)
    return levels, totals


def with_cells(pairs: DataFrame) -> DataFrame:
    @F.arrow_udf("int")
    def low(p: pa.Array, s: pa.Array) -> pa.Array:
        return pa.array((mixed(p.to_numpy().view(np.uint64), s.to_numpy().view(np.uint64)) & np.uint64(0xFFFF)).astype(np.int32))

    return pairs.select(low("p", "s").alias("cell16"), "p", "s")


def best(levels: list[DataFrame], totals: DataFrame, most: int | None) -> DataFrame:
    """The phrases that no longer one covers, scored and ranked.

    Counts never grow with the length, so a phrase is covered by some longer one exactly if one word more covers it.
    """
    kept = []
    for level, longer in zip(levels, [*levels[1:], None]):
        if longer is not None:
            inside_of = longer.select(F.col("p").alias("id"), "f").unionByName(longer.select(F.col("s").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("longer"))
            level = level.join(inside_of, "id", "left").where("longer is null or longer < f")
        # heads and tails of the cuts: all but the whole phrase
        parts = [F.slice(c, 1, F.size(c) - 1).alias(c) for c in ("heads", "tails")]
        kept.append(level.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), *parts))
    phrases = kept[0]
    for more in kept[1:]:
        phrases = phrases.unionByName(more)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    out = scored(phrases.join(totals, "lang"))
    if most is not None:  # each of 64 parts of a language first
        part = F.pmod(F.xxhash64("phrase"), F.lit(64))
        out = out.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("nth") <= most).drop("part", "nth")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
