"""Operator 6: benchmark decontamination with a generalised suffix automaton."""

import pickle
import uuid
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, materialise, new_path, own, pieces
from .toxicity import FOLD

#: A word of items and documents.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Words of test items in one automaton, on average; longer benchmarks take several.
BLOCK = 50_000
#: Automata that a task keeps in memory; if there are more, each is loaded again for each batch of documents.
KEPT = 4


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z lower-cased."""
    return text.translate(FOLD).split()


@dataclass
class Automaton:
    """Suffix automaton of several word sequences: state 0 is the root; `link` leads to the longest other suffix."""

    width: int
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    items: list[set] = field(default_factory=lambda: [set()])
    short: list[tuple] = field(default_factory=lambda: [()])
    vocabulary: dict[bytes, int] = field(default_factory=dict)

    def new(self, longest: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.longest.append(longest)
        self.items.append(set())
        self.short.append(())
        return len(self.step) - 1

    def split(self, p: int, c: int, q: int) -> int:
        """A state for the suffixes of q that are reached from p by c, taking over q's steps."""
        clone = self.new(self.longest[p] + 1)
        self.step[clone] = dict(self.step[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.longest[q] == self.longest[last] + 1 else self.split(last, c, q)
        state, p = self.new(self.longest[last] + 1), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[state] = q if self.longest[q] == self.longest[p] + 1 else self.split(p, c, q)
        return state

    def build(self, items: list[tuple[str, list[bytes]]]) -> "Automaton":
        ids = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, seq in ids:
            last = 0
            for c in seq:
                last = self.extend(last, c)
        whole: dict[int, list] = {}
        for name, seq in ids:
            state = 0
            for c in seq:
                state = self.step[state][c]
                at = state
                while at > 0 and name not in self.items[at]:
                    self.items[at].add(name)
                    at = self.link[at]
            if len(seq) < self.width:
                whole.setdefault(state, []).append((len(seq), name))
        for state in sorted(range(len(self.step)), key=self.longest.__getitem__):
            up = self.short[self.link[state]] if state else ()
            self.short[state] = tuple(whole.get(state, ())) + up
        return self

    def spans(self, words: list[bytes], least: int = 1) -> tuple[list[tuple[int, int]], set]:
        """Merged ranges of words inside an occurring window of at least `least` words, and the items with one."""
        step, link, longest, short, width = self.step, self.link, self.longest, self.short, self.width
        state = length = 0
        found: list[tuple[int, int]] = []
        items: set = set()
        for end, c in enumerate(map(self.vocabulary.get, words), 1):
            if c is None:
                state = length = 0
                continue
            nxt = step[state].get(c)
            if nxt is None:
                while state and c not in step[state]:
                    state = link[state]
                length = longest[state]
                nxt = step[state].get(c)
                if nxt is None:
                    continue
            state = nxt
            length += 1
            if length >= width:
                found.append((end - length, end))
                at = state
                while longest[link[at]] >= width:
                    at = link[at]
                items |= self.items[at]
            if short[state]:
                for n, name in short[state]:
                    if least <= n <= length:
                        found.append((end - n, end))
                        items.add(name)
        return merged(found), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def automata(benchmark: DataFrame, item_col: str, text_col: str, width: int, block: int) -> list[str]:
    """Files in the shared folder, with an automaton each, for about `block` words of items.

    Distinct items are dealt to blocks by hash and each automaton is built in a task of its own; the driver sees the
    names alone, of the attempts that counted.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    words = items.select(F.sum(F.regexp_count("text", F.lit(WORD))).alias("n")).first().n or 0
    parts, folder = max(1, -(-words // block)), new_path(spark, "automata")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item", "text"])
        made = Automaton(width).build([("" if i is None else i, words_of(t.encode())) for i, t in zip(rows["item"], rows["text"])])
        uri = f"{folder}/{uuid.uuid4().hex}"
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path, compression=None) as file:
            file.write(pickle.dumps(made))
        return pd.DataFrame({"uri": [uri]})

    blocks = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(parts))).groupBy("block").applyInPandas(build, "uri string")
    return [r.uri for r in materialise(blocks, "automata-list").orderBy("uri").collect()]


_loaded: dict[str, Automaton] = {}


def automaton_at(uri: str) -> Automaton:
    """The automaton of a file; a worker keeps the last KEPT."""
    if uri not in _loaded:
        while len(_loaded) >= KEPT:
            _loaded.pop(next(iter(_loaded)))
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_stream(path, compression=None) as file:
            _loaded[uri] = pickle.loads(file.read())
    return _loaded[uri]


def spans_of(uris: list[str], lists: list[list[bytes]], least: int = 1) -> list[tuple[list[tuple[int, int]], set]]:
    """Merged spans and items of each word list under all automata, one automaton after the other."""
    found: list[tuple[list, set]] = [([], set()) for _ in lists]
    for uri in uris:
        automaton = automaton_at(uri)
        for (spans, items), words in zip(found, lists):
            s, i = automaton.spans(words, least)
            spans += s
            items |= i
    return [(merged(s), i) for s, i in found]


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, block: int = BLOCK) -> DataFrame:
    """Per row of `docs`: the id, `n_words`, `spans` (merged word ranges inside occurring windows) and `items`.

    Documents are scanned once, whatever the size of the benchmark, and each row is judged where it stands.
    """
    uris = automata(benchmark, item_col, item_text_col, width, block)

    def scan(batches):
        for b in batches:
            texts = bytes_of(b.column(1))
            for i, j in pieces(texts, 10_000_000):
                lists = [words_of(t) for t in texts[i:j]]
                found = spans_of(uris, lists)
                columns = ([len(w) for w in lists], [[{"begin": x, "end": y} for x, y in s] for s, _ in found], [sorted(i) for _, i in found])
                kinds = (pa.int64(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *[pa.array(v, k) for v, k in zip(columns, kinds)]], ["id", "n_words", "spans", "items"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(own(docs, id_col).alias("id"), own(docs, text_col).alias("text"))
    return rows.mapInArrow(scan, f"id {kind}, n_words long, spans array<struct<begin:int,end:int>>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block: int = BLOCK) -> DataFrame:
    """Per document: `doc_id`, `n_words`, `n_hit`, `n_items`, `items_sha256`, `contaminated`, `spans`.

    A window is `width` consecutive words of an item; an item with fewer, but some, is one window. A document word
    inside an occurrence of a window is hit. Null and empty texts have no words and no hits; items without words
    never occur, and a null item id is an empty one. Repeated rows are judged each, long texts whole. Empty tables give
    no rows, or no hits; other columns are ignored.
    `items_sha256` is of the item ids sorted as strings and joined by commas (of the empty string without any).
    """
    found = hits(docs, benchmark, width=width, block=block)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["begin"]).cast("long"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans",
    )


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text with the words of the spans, and what stands between them, cut out."""
    folded, places, at = text.translate(FOLD), [], 0
    for w in folded.split():
        at = folded.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, text[last:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, width: int = 10, coverage: float = 0.2, block: int = BLOCK, least: int = 1) -> DataFrame:
    """The documents with the matched spans of at least `width` words (or whole shorter items) removed from the text.

    A document goes as a whole if more than `coverage` of its words are hit. Items of fewer than `least` words are cut out
    but do not count there; only a document of which they leave no word goes. Cutting can bring words together that
    form a window again, so a text is cut until no window is left. `n_chars` follows the text; clean rows stay as
    they are, null and blank texts too. Repeated rows are judged each, long texts whole; empty tables give no rows, or
    leave all. Columns are those of `docs`, whatever their names.
    """
    uris = automata(benchmark, "item_id", "text", width, block)

    @F.arrow_udf("struct<gone:boolean,text:string>")
    def cut(text: pa.Array) -> pa.Array:
        gone, out, texts = [], [], bytes_of(text)
        for i, j in pieces(texts, 10_000_000):
            for t, words, spans, judged in zip(texts[i:j], *judge(texts[i:j])):
                gone.append(sum(b - a for a, b in judged) > coverage * len(words))
                rest = t
                while spans and not gone[-1]:
                    rest = without_spans(rest, spans)
                    left = words_of(rest)
                    spans = spans_of(uris, [left])[0][0]
                    gone[-1] = not left
                out.append(rest.decode() if rest != t else None)
        return pa.StructArray.from_arrays([pa.array(gone, pa.bool_()), pa.array(out, pa.string())], ["gone", "text"])

    def judge(texts: list[bytes]) -> tuple[list, list, list]:
        """Words, spans, and those of the spans' items that count for the coverage."""
        lists = [words_of(t) for t in texts]
        spans = [s for s, _ in spans_of(uris, lists)]
        hit = [k for k, s in enumerate(spans) if s]
        judged = dict(zip(hit, spans_of(uris, [lists[k] for k in hit], least))) if least > 1 else {}
        return lists, spans, [judged[k][0] if k in judged else s for k, s in enumerate(spans)]

    cut = cut.asNondeterministic()  # keeps the filter from asking for the same cut a second time
    row, done = F.struct(*[own(docs, c).alias(c) for c in docs.columns]), F.col("cut")
    judged = docs.select(row.alias("row"), cut(own(docs, "text")).alias("cut")).where(~done["gone"])
    text = F.coalesce(done["text"], F.col("row")["text"])
    changes = {"text": text, "n_chars": F.when(done["text"].isNotNull(), F.length(done["text"]).cast("long")).otherwise(F.col("row")["n_chars"])} if "n_chars" in docs.columns else {"text": text}
    return judged.select(*[changes.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
