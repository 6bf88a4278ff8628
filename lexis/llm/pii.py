"""Operator 12: personal data, by fixed rules and by a bidirectional LSTM over characters with CRF transitions, in numpy."""

from __future__ import annotations

import heapq
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import own

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window to learn from, and from one to the next.
WIDE, STEP = 96, 48
#: Characters of a window to read, and how many it shares with the next: a span of up to SHARED - 2 characters is whole in some window.
READ, SHARED = 2048, 256
#: Units of each direction; tags are O, then begin and inside of each kind.
HIDDEN, TAGS = 16, 1 + 2 * len(KINDS)
#: Most spans hold one of these: windows with one and no span are a stratum of their own among those to learn from.
TRIGGER = re.compile("[0-9@]")

# The rules. Possessive counts and lookbehinds change no match, but keep each in time linear to the text.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def at_most_255(digits: str) -> bool:
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: at each @, as much before it as the local part's characters and the last match allow."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and LOCAL.match(text[begin - 1]):
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(begin, kind, end) of what the rules find, in that order."""
    out = []
    if "@" in text:
        out += [(b, 0, e) for b, e in emails(text)]
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(at_most_255(part) for part in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = "".join(DIGITS.findall(m.group())) if m.end() - m.start() < 38 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGITS.findall(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# The network. Characters fall into classes: padding, digits, capitals, control characters, each other one of ASCII, all others.
_SINGLE = [c for c in range(32, 127) if not 48 <= c <= 57 and not 65 <= c <= 90]
_CLASS = np.array([1 if 48 <= c <= 57 else 2 if 65 <= c <= 90 else 3 if c not in _SINGLE else 4 + _SINGLE.index(c) for c in range(128)], np.int16)
PAD, OTHER, CLASSES = 0, 4 + len(_SINGLE), 5 + len(_SINGLE)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], OTHER).astype(np.int16)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


#: No inside tag comes first, or after another kind's.
BARRED = np.zeros((TAGS + 1, TAGS), np.float32)
for _k in range(len(KINDS)):
    for _before in range(TAGS + 1):
        if _before not in (1 + 2 * _k, 2 + 2 * _k):
            BARRED[_before, 2 + 2 * _k] = -1e4


@dataclass
class Tagger:
    """Weights by name: each direction's class table, recurrence and bias; the output layer; transitions, the last row from the start."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        w = {"out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "out_bias": np.zeros(TAGS), "moves": np.zeros((TAGS + 1, TAGS))}
        for d in "fb":
            w |= {f"{d}_in": rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN)), f"{d}_own": rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"{d}_bias": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def states(self, x: np.ndarray, d: str, kept: list | None = None) -> np.ndarray:
        """Hidden states of one direction; x has a row per position, a column per window. Gates: in, forget, out, new."""
        w, n = self.weights, x.shape[1]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((len(x), n, HIDDEN), np.float32)
        table = w[f"{d}_in"] + w[f"{d}_bias"]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = table[x[t]] + h @ w[f"{d}_own"]
            g = sigmoid(z[:, : 3 * HIDDEN])
            new = np.tanh(z[:, 3 * HIDDEN :])
            last_h, last_c = h, c
            c = g[:, HIDDEN : 2 * HIDDEN] * c + g[:, :HIDDEN] * new
            bent = np.tanh(c)
            h = g[:, 2 * HIDDEN :] * bent
            out[t] = h
            if kept is not None:
                kept.append((t, g, new, last_h, last_c, bent))
        return out

    def back(self, x: np.ndarray, d: str, kept: list, pull: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients through time of one direction, from those of its states."""
        w, n = self.weights, x.size
        dh, dc = np.zeros_like(pull[0]), np.zeros_like(pull[0])
        dz, came = np.zeros((*x.shape, 4 * HIDDEN), np.float32), np.zeros((*x.shape, HIDDEN), np.float32)
        for t, g, new, last_h, last_c, bent in reversed(kept):
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            dh = dh + pull[t]
            dc = dc + dh * o * (1 - bent * bent)
            dz[t] = np.concatenate([dc * new * i * (1 - i), dc * last_c * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - new * new)], axis=1)
            came[t] = last_h
            dh, dc = dz[t] @ w[f"{d}_own"].T, dc * f
        flat, hot = dz.reshape(n, -1), np.zeros((n, CLASSES), np.float32)
        hot[np.arange(n), x.ravel()] = 1
        return {f"{d}_in": hot.T @ flat, f"{d}_own": came.reshape(n, -1).T @ flat, f"{d}_bias": flat.sum(axis=0)}

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags y, and its gradients."""
        w, (steps, n) = self.weights, x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.states(x, d, kept[d]) for d in "fb"], axis=2)
        e = both @ w["out"] + w["out_bias"]
        moves = w["moves"] + BARRED
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[0] = e[0] + moves[TAGS]
        for t in range(1, steps):
            a[t] = log_sum(a[t - 1][:, :, None] + moves[:TAGS], 1) + e[t]
        for t in range(steps - 2, -1, -1):
            b[t] = log_sum((b[t + 1] + e[t + 1])[:, None, :] + moves[:TAGS], 2)
        whole = log_sum(a[-1], 1)
        de = np.exp(a + b - whole[:, None])
        d_moves = np.zeros_like(moves)
        d_moves[TAGS] = de[0].sum(axis=0)
        for t in range(1, steps):
            d_moves[:TAGS] += np.exp(a[t - 1][:, :, None] + moves[:TAGS] + (e[t] + b[t])[:, None, :] - whole[:, None, None]).sum(axis=0)
        at = np.arange(n)
        gold = e[np.arange(steps)[:, None], at, y].sum() + moves[TAGS, y[0]].sum() + moves[y[:-1], y[1:]].sum()
        de[np.arange(steps)[:, None], at, y] -= 1
        np.add.at(d_moves, (TAGS, y[0]), -1)
        np.add.at(d_moves, (y[:-1], y[1:]), -1)
        pull = de @ w["out"].T
        grads = {"out": np.tensordot(both, de, ((0, 1), (0, 1))), "out_bias": de.sum(axis=(0, 1)), "moves": d_moves}
        for d, part in (("f", pull[:, :, :HIDDEN]), ("b", pull[:, :, HIDDEN:])):
            grads |= self.back(x, d, kept[d], part)
        return float((whole.sum() - gold) / n), {k: v / n for k, v in grads.items()}

    def emissions(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """By how much each position's emissions exceed that of O, for all tags but O.

        The windows (columns) stand by size, the longest first, so that those which go on at a position are the first ones.
        As `states`, but nothing is kept, each gate has an array of its own, and a sigmoid is a tanh of half its argument.
        """
        (steps, n), w = x.shape, self.weights
        out, bias = (v[..., 1:] - v[..., :1] for v in (w["out"], w["out_bias"]))
        half = np.array([0.5, 0.5, 0.5, 1], np.float32)[:, None, None]
        going = np.searchsorted(-sizes, -np.arange(steps), "left")
        e = np.zeros((steps, n, TAGS - 1), np.float32)
        for side, d in enumerate("fb"):
            table, own_ = (np.ascontiguousarray(v.reshape(-1, 4, HIDDEN).transpose(1, 0, 2) * half) for v in (w[f"{d}_in"] + w[f"{d}_bias"], w[f"{d}_own"]))
            h, c, bent = (np.zeros((n, HIDDEN), np.float32) for _ in range(3))
            z, seen = np.zeros((4, n, HIDDEN), np.float32), np.zeros((4, n, HIDDEN), np.float32)
            last = np.ascontiguousarray(out[side * HIDDEN : (side + 1) * HIDDEN])
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                m = going[t]
                at, h_, c_, bent_, z_ = x[t, :m].astype(np.intp), h[:m], c[:m], bent[:m], z[:, :m]
                for g in range(4):
                    np.take(table[g], at, axis=0, out=seen[g, :m], mode="clip")
                    np.matmul(h_, own_[g], out=z_[g])
                z_ += seen[:, :m]
                np.tanh(z_, out=z_)
                z_[:3] *= 0.5
                z_[:3] += 0.5
                c_ *= z_[1]
                c_ += np.multiply(z_[0], z_[3], out=bent_)
                np.multiply(z_[2], np.tanh(c_, out=bent_), out=h_)
                e[t, :m] += h_ @ last
        e += bias
        for t in np.flatnonzero(going < n):
            e[t, going[t] :] = -1e4
        return e

    def open(self, e: np.ndarray) -> np.ndarray:
        """The windows whose best tags may be others than O.

        A bound for each position: the most that a run without O, up to there, gains over O, each step with the best tag and the
        best move. Where no run makes up for the move back to O, all tags of the window are O, without Viterbi.
        """
        moves = self.weights["moves"] + BARRED
        begin = np.maximum(moves[0] - moves[0, 0], moves[TAGS] - moves[TAGS, 0])[1::2, None]
        on, back = (moves[1:TAGS, 1:].max(axis=0) - moves[0, 0])[:, None], max(0.0, float((moves[1:TAGS, 0] - moves[0, 0]).max()))
        gain, most = np.full(e.shape[1], -1e4, np.float32), np.full(e.shape[1], -1e4, np.float32)
        for at in e:
            at = np.ascontiguousarray(at.T)
            gain = np.maximum(gain + (at + on).max(axis=0), (at[::2] + begin).max(axis=0))
            np.maximum(most, gain, out=most)
        return np.flatnonzero(most + back > -1e-2)

    def best(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags (Viterbi), and by how much each tag's emission exceeds that of O."""
        e = np.concatenate([np.zeros_like(e[:, :, :1]), e], axis=2)
        moves = self.weights["moves"] + BARRED
        best, came = e[0] + moves[TAGS], np.zeros(e.shape, np.int8)
        for t in range(1, len(e)):
            ways = best[:, :, None] + moves[:TAGS]
            came[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + e[t]
        tags, at = np.zeros(e.shape[:2], np.int8), np.arange(e.shape[1])
        tags[-1] = best.argmax(axis=1)
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = came[t, at, tags[t]]
        return tags, np.take_along_axis(e, tags[:, :, None].astype(np.int64), 2)[:, :, 0]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of whole windows, and their margins."""
        return self.best(self.emissions(x, np.full(x.shape[1], len(x))))


def fit(windows: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 6, batch: int = 128, rate: float = 0.02, seed: int = 12) -> Tagger | None:
    """Adam over shuffled mini-batches of windows with spans (begin, kind, end). None if there are no spans to learn."""
    if not any(spans for _, spans in windows):
        return None
    x, y = np.full((WIDE, len(windows)), PAD, np.int16), np.zeros((WIDE, len(windows)), np.int64)
    for i, (text, spans) in enumerate(windows):
        x[: len(text), i] = classes(text)[:WIDE]
        for begin, kind, end in spans:
            y[begin:end, i] = 2 + 2 * kind
            y[begin, i] = 1 + 2 * kind
    tagger, rng, step = Tagger.fresh(seed), np.random.default_rng(seed), 0
    first, second = ({k: np.zeros_like(v) for k, v in tagger.weights.items()} for _ in range(2))
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for chosen in np.array_split(order, -(-len(order) // batch)):
            step += 1
            for k, g in tagger.loss(x[:, chosen], y[:, chosen])[1].items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                pace = rate * (1 - epoch / epochs) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                tagger.weights[k] -= (pace * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return tagger


# Labelled windows

VARIANTS = {"at": (" @ ", "(at)", " (at) ", " [at] "), "dot": (".", " . ", "(dot)", "[.]"), "part": (".", " . ", "[.]", "(.)", ":"), "group": (".", "/", "_", "  ", " - "), "lead": ("00", "", "(+)", "tel.")}


def varied(kind: int, span: str, rng: random.Random) -> str:
    """The same data written in another way, which the rules do not read."""
    if kind == 0:
        local, _, domain = span.rpartition("@")
        return local + rng.choice(VARIANTS["at"]) + domain.replace(".", rng.choice(VARIANTS["dot"]))
    if kind == 1:
        return span.replace(".", rng.choice(VARIANTS["part"][1:]))
    digits = "".join(DIGITS.findall(span))
    between = rng.choice(VARIANTS["group"])
    if kind == 2:
        return between.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return rng.choice(VARIANTS["lead"][:2]) + between.join([digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]]).strip(between)


def with_variants(windows: list[tuple[str, list[tuple[int, int, int]]]], times: int = 4, seed: int = 12) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The windows, and each of those with spans `times` times more with its spans written in other ways."""
    rng, out = random.Random(seed), list(windows)
    for text, spans in windows:
        if any(a[2] > b[0] for a, b in zip(spans, spans[1:])):
            continue
        for _ in range(times if spans else 0):
            made, at, new = "", 0, []
            for begin, kind, end in spans:
                made += text[at:begin]
                other = varied(kind, text[begin:end], rng)
                new.append((len(made), kind, len(made) + len(other)))
                made, at = made + other, end
            if new[-1][2] <= WIDE:
                out.append(((made + text[at:])[:WIDE], new))
    return out


def windows_of(text: str, spans: list[tuple[int, int, int]], plain: bool = False) -> Iterator[tuple[int, str, list[tuple[int, int, int]]]]:
    """Stratum, window and its spans: of each kind, around each span, at a place that depends on the text alone, and the windows
    that no span touches: those with a trigger and, if `plain`, those without as a stratum of their own."""
    for begin, kind, end in spans:
        if end - begin <= STEP:
            shift = xxhash.xxh64_intdigest(text[begin:end].encode("utf-8", "replace"), 12) % (WIDE - (end - begin))
            at = max(0, begin - shift)
            inside = [(b - at, k, e - at) for b, k, e in spans if b >= at and e <= at + WIDE]
            if not any(b < at < e or b < at + WIDE < e for b, _, e in spans):
                yield kind, text[at : at + WIDE], inside
    ends = sorted((b, e) for b, _, e in spans)
    for at in places(text):
        i = bisect_right(ends, (at + WIDE, -1))
        if not any(e > at for _, e in ends[max(0, i - 8) : i]):
            window = text[at : at + WIDE]
            if (bare := not TRIGGER.search(window)) <= plain:
                yield len(KINDS) + bare, window, []


def places(text: str) -> range:
    """Where the windows to learn from begin; they overlap by WIDE - STEP characters and leave nothing out."""
    return range(0, max(1, len(text) - STEP), STEP)


def training_windows(docs: DataFrame, most: int, text_col: str = "text", spans_col: str | None = None) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most `most` labelled windows for the driver: of each stratum, the ones with the smallest hashes.

    Spans are those of the column, or of the rules. A task keeps no more than it may send.
    """
    strata = len(KINDS) + 2
    each = max(1, most // strata)
    kind = "array<struct<begin:int,kind:int,end:int>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(strata)]
        known: list[set] = [set() for _ in held]
        for b in batches:
            given = b.column(1).to_pylist() if b.num_columns > 1 else None
            for row, text in enumerate(b.column(0).to_pylist()):
                if text:
                    spans = sorted((s["begin"], s["kind"], s["end"]) for s in given[row] or []) if given else base_spans(text)
                    for stratum, window, inside in windows_of(text, spans, plain=True):
                        key = xxhash.xxh64_intdigest(window.encode("utf-8", "replace"), 5) >> 1
                        if key in known[stratum] or (len(held[stratum]) >= each and -held[stratum][0][0] <= key):
                            continue
                        known[stratum].add(key)
                        heapq.heappush(held[stratum], (-key, window, inside))
                        if len(held[stratum]) > each:
                            known[stratum].discard(-heapq.heappop(held[stratum])[0])
        flat = [(s, -k, w, [{"begin": b, "kind": c, "end": e} for b, c, e in i]) for s, rows in enumerate(held) for k, w, i in rows]
        types = (pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], t) for c, t in enumerate(types)], ["stratum", "key", "text", "spans"])

    rows = docs.select(own(docs, text_col).cast("string").alias("text"), *([own(docs, spans_col).cast(kind).alias("spans")] if spans_col else []))
    found = rows.mapInArrow(cut, f"stratum int, key long, text string, spans {kind}").dropDuplicates(["stratum", "key"])
    nth = F.row_number().over(Window.partitionBy("stratum").orderBy("key"))
    got = found.withColumn("nth", nth).where(F.col("nth") <= each).orderBy("stratum", "key").collect()
    return [(r.text, [(s.begin, s.kind, s.end) for s in r.spans]) for r in got]


# Decoding


def plausible(kind: int, span: str) -> bool:
    """What a span that the network adds must hold besides; rules may ask more."""
    digits = DIGITS.findall(span)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s*(@|[(\[]at[)\]])\s*[A-Za-z0-9-]+([\s.(\[)\]]+|dot)+[A-Za-z0-9].*", span, re.S))
    if kind == 1:
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(map(at_most_255, parts)) and not re.search("[A-Za-z]", span)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn("".join(digits)) and not re.search("[A-Za-z]", span)
    return 10 <= len(digits) <= 15 and not re.search("[A-Za-z]", span)


def reconciled(found: dict[tuple[int, int, int], float]) -> list[tuple[int, int, int]]:
    """Of the spans that overlapping windows propose, the disjoint ones with the greatest sum of scores."""
    spans = sorted(found, key=lambda s: (s[2], s[0], s[1]))
    ends = [s[2] for s in spans]
    best: list[tuple[float, int | None, int]] = [(0.0, None, 0)]  # sum, span taken last, how many spans came before it
    for i, s in enumerate(spans):
        before = bisect_right(ends, s[0], 0, i)
        taken = best[before][0] + found[s]
        best.append((taken, i, before) if taken > best[i][0] else (best[i][0], None, i))
    out, at = [], len(spans)
    while at:
        _, i, before = best[at]
        if i is not None:
            out.append(spans[i])
        at = before
    return sorted(out)


def reads(length: int) -> Iterator[tuple[int, int]]:
    """The windows in which a text is read, without a gap."""
    for at in range(0, max(1, length - SHARED), READ - SHARED):
        yield at, min(at + READ, length)


def proposals(tagger: Tagger, texts: list[str], batch: int = 1000) -> list[dict[tuple[int, int, int], float]]:
    """Per text the plausible spans of its windows, with their scores added up over windows. Every character is read.

    A span at a window's edge, where the text goes on, is left to the next window, which holds it whole.
    """
    found: list[dict] = [{} for _ in texts]
    held: list[tuple[int, int, np.ndarray]] = []

    def read() -> None:
        held.sort(key=lambda w: -len(w[2]))
        sizes = np.array([len(w[2]) for w in held])
        x = np.full((sizes[0] + 1, len(held)), PAD, np.int16)  # all end with O, whatever else is in the batch
        for i, (_, _, points) in enumerate(held):
            x[: len(points), i] = points
        e = tagger.emissions(x, sizes)
        chosen = tagger.open(e)
        tags, margin = tagger.best(e[:, chosen])
        for i, column in enumerate(chosen):
            row, at, points = held[column]
            text, own_, size = texts[row], tags[: len(points), i], len(points)
            for t in np.flatnonzero(own_ % 2 == 1).tolist():
                kind, end = (int(own_[t]) - 1) // 2, t + 1
                while end < size and own_[end] == 2 + 2 * kind:
                    end += 1
                begin_, end_ = at + t, at + end
                while end_ > begin_ and text[end_ - 1].isspace():
                    end_ -= 1
                whole = (t > 0 or at == 0) and (end < size or at + size == len(text))
                if whole and plausible(kind, text[begin_:end_]):
                    key = (begin_, kind, end_)
                    found[row][key] = found[row].get(key, 0.0) + max(1e-3, float(margin[t:end, i].sum()))
        held.clear()

    for row, text in enumerate(texts):
        if text:
            points = classes(text)
            for at, end in reads(len(text)):
                held.append((row, at, points[at:end]))
                if len(held) == batch:
                    read()
    if held:
        read()
    return found


def spans_of(tagger: Tagger | None, texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
    """(begin, kind, end, whether of the rules), in that order. What overlaps a span of the rules is not added."""
    out = []
    for text, found in zip(texts, proposals(tagger, texts) if tagger else [{}] * len(texts)):
        base = base_spans(text)
        begins, reach = [b for b, _, _ in base], np.maximum.accumulate([0, *[e for _, _, e in base]])
        free = {s: v for s, v in found.items() if reach[bisect_right(begins, s[2] - 1)] <= s[0]}
        out.append(sorted([*[(*s, True) for s in base], *[(*s, False) for s in reconciled(free)]]))
    return out


def train(docs: DataFrame, most: int = 1000, text_col: str = "text", spans_col: str | None = None) -> Tagger | None:
    return fit(with_variants(training_windows(docs, most, text_col, spans_col)))


SPANS = "array<struct<kind:string,begin:int,end:int,base:boolean>>"


def personal_data(docs: DataFrame, most: int = 1000, labelled: DataFrame | None = None, spans_col: str = "spans", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs `doc_id` and `spans`: of the rules (`base`), and those that the network adds, by begin, then kind.

    The network learns from `labelled` (texts with spans of begin, kind number, end), or, without it, from what the rules find in
    docs, each span also written in ways that the rules do not read: windows of WIDE characters, at most `most`, those with
    the smallest hashes. Every whole text is read in overlapping windows of READ characters, whatever they hold. An added span
    is plausible for its kind, overlaps none of the rules', and is one of the disjoint spans with the greatest score over all
    windows of its text; one of more than SHARED - 2 characters is found unless it lies across a window's end.

    Null and empty texts have no spans; long texts are read whole; repeated rows each; a null doc_id stays. If there is
    nothing to learn from, nothing is added; empty tables give no rows. Other columns are ignored. No row is exchanged.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, most, text_col) if labelled is None else train(labelled, most, text_col, spans_col))
    fields = [("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]

    @F.arrow_udf(SPANS)
    def find(text: pa.Array) -> pa.Array:
        found = spans_of(model.value, [t or "" for t in text.to_pylist()])
        rows = [[{"kind": KINDS[k], "begin": b, "end": e, "base": base} for b, k, e, base in spans] for spans in found]
        return pa.array(rows, pa.list_(pa.struct(fields)))

    return docs.select(own(docs, id_col).alias("doc_id"), find(own(docs, text_col).cast("string")).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind and a digest of the rules' spans, and all spans in one string."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")

    def number(spans, kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [number(base, k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
