"""Operator 1: quality rules with risk-controlled thresholds."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, materialise

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
SPACES = b" \t\n\r\v\f"
#: Rules reject a document whose value, in thousandths, is above the cutoff.
RULES = ("symbols", "duplicate_lines", "repeats", "capitals")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside a window of `width` words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key = at[:n]
    for k in range(1, width):  # exact: pairs of numbers are numbered anew before they can overflow
        key = key * len(ids) + at[k : k + n]
        if k + 1 < width and len(ids) > 1 << 20:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + n] |= twice
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    points = np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    blanks = len(text) - len(text.translate(None, SPACES))
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            duplicates += line in seen
            seen.add(line)
    symbols, capitals = (len(text) - len(text.translate(None, chars)) for chars in (SYMBOLS, UPPER))
    return len(words), int(points) - blanks, symbols, duplicates, repeated_words(words), lines, capitals


def measures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id, the MEASURES of every row's whole text and its 64-bit hash `text_hash`; null is like empty."""
    names = [m.split()[0] for m in MEASURES.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t) for t in bytes_of(b.column(1))]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "text_hash", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(scan, f"doc_id {kind}, text_hash long, {MEASURES}")


def thousandths(part: Column, whole: Column) -> Column:
    return F.least(F.coalesce(F.try_divide(part * 1000, whole), F.lit(0.0)), F.lit(1000.0)).cast("int")


VALUES = {
    "symbols": lambda: thousandths(F.col("n_symbols"), F.col("word_chars")),
    "duplicate_lines": lambda: thousandths(F.col("n_dup_lines"), F.col("n_lines")),
    "repeats": lambda: thousandths(F.col("n_repeat_words"), F.col("n_words")),
    "capitals": lambda: thousandths(F.col("n_capitals"), F.col("word_chars")),
}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), summed from k down to terms that no longer matter."""
    if k >= n:
        return 1.0
    total = 0.0
    for i in range(k, -1, -1):
        term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
        total += term
        if i < n * p and term < total * 1e-16:
            break
    return min(1.0, total)


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact (Clopper-Pearson) upper confidence bound: the largest rate at which k or fewer of n is no surprise."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if binomial_tail(k, n, mid) > level:
            low = mid
        else:
            high = mid
    return high


def candidate(good: np.ndarray, bad: np.ndarray, cost: float = 10.0) -> tuple[float, int] | None:
    """The cutoff (0 to 1000) that gains most: bad documents above it less `cost` times the good ones; mid of a plateau."""
    above = lambda h: h.sum() - np.cumsum(h)
    gain = above(bad) - cost * above(good)
    if gain.max() <= 0:
        return None
    best = np.flatnonzero(gain == gain.max())
    run = best[: np.flatnonzero(np.diff(best) > 1)[0] + 1] if (np.diff(best) > 1).any() else best
    return float(gain.max()), int(run[len(run) // 2])


def loosest(good: np.ndarray, proposed: int, risk: float, level: float) -> int | None:
    """The lowest cutoff, down to `proposed`, that the holdout's good documents (a histogram of their values) allow.

    Cutoffs are tested in a fixed order, from 1000, which rejects nothing, downwards; testing ends at the first whose
    exact bound on the rate of false rejection, at `level`, exceeds the risk. So the cutoff found is wrong with
    probability `level` at most. None if not even the first passes.
    """
    n, found, rejected = int(good.sum()), None, 0
    for cut in range(1000, proposed - 1, -1):
        now = int(good[cut + 1 :].sum())
        if found is None or now > rejected:
            if upper_bound(now, n, level) > risk:
                break
            rejected = now
        found = cut
    return found


def thresholds(labelled: DataFrame, strata: list[str], risk: float = 0.05, error: float = 0.1) -> dict[str, dict[str, int]]:
    """Cutoffs by stratum and rule: with confidence 1 - `error`, every stratum rejects at most `risk` of its good texts.

    `labelled` has `text_hash`, `stratum`, `good` and a column per rule. A text counts once, however many copies it has,
    and is good only if all its labels say so. Half of the texts (by hash) propose: for each rule of a stratum the
    cutoff that gains most, or that the rule is of no use there. The other half decides how far each proposed rule may
    go (`loosest`). The risk of a stratum is shared by its rules in equal parts, so that the union of their false
    rejections keeps to it; the error is shared over all rules of all strata (Bonferroni). A rule that fails does not
    stop another. The driver sees histograms of a fixed size.
    """
    texts = labelled.groupBy("text_hash", "stratum", *RULES).agg(F.min("good").alias("good"))
    design = F.pmod(F.xxhash64("text_hash", F.lit(1)), F.lit(2)) == 0
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in RULES]))
    rows = texts.select(design.alias("design"), "stratum", "good", values.alias("x")).groupBy("design", "stratum", "good", "x.rule", "x.v").agg(F.count("*").alias("n")).collect()
    histograms = {(d, s, r, g): np.zeros(1001, np.int64) for d in (True, False) for s in strata for r in RULES for g in (True, False)}
    for r in rows:
        histograms[r.design, r.stratum, r.rule, r.good][r.v] = r.n
    proposed = {(s, r): c[1] for s in strata for r in RULES if (c := candidate(histograms[True, s, r, True], histograms[True, s, r, False]))}
    out: dict[str, dict[str, int]] = {s: {} for s in strata}
    for (s, r), cut in proposed.items():
        share = risk / sum(t == s for t, _ in proposed)
        found = loosest(histograms[False, s, r, True], cut, share, error / len(proposed))
        if found is not None:
            out[s][r] = found
    return out


def rule_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: tuple[int, ...] = (400,), risk: float = 0.05, error: float = 0.1) -> DataFrame:
    """Measures and verdict of every row: `doc_id`, the MEASURES, `base_failed`, `kept`, `stratum`, `failed_rules`.

    Fixed rules first: under 50 words, or over half of the words in repeated three-word windows, fail. Among the
    rest, cutoffs of RULES are learned from all labelled documents (quality 1 is good; repeated labels: the smallest)
    by `thresholds`, with strata of word counts below each of `bands` and above. A stratum with too few labels to
    prove the risk keeps every document. Null texts are like empty ones: no words, base failed. A null doc_id is
    measured and judged but never matches a label. Repeated rows are judged each; long texts are measured whole; empty
    tables give no rows, or no learned rules; other columns are ignored.
    """
    rows = materialise(measures(docs, id_col, text_col), "rule-measures")
    strata = [f"below {b} words" for b in bands] + ["long"]
    stratum = F.lit("long")
    for b, name in sorted(zip(bands, strata), reverse=True):
        stratum = F.when(F.col("n_words") < b, name).otherwise(stratum)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("stratum", stratum).withColumns({r: VALUES[r]() for r in RULES})
    known = labels.where("quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    cutoffs = thresholds(materialise(rows.where("not base_failed").join(known, "doc_id").select("text_hash", "stratum", "good", *RULES), "rule-labelled"), strata, risk, error)
    broken = F.array(*[F.when((F.col("stratum") == s) & (F.col(r) > cut), r) for s in strata for r, cut in cutoffs[s].items()], F.lit(None).cast("string"))
    judged = rows.withColumn("failed_rules", F.array_compact(broken))
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    names = [m.split()[0] for m in MEASURES.split(", ")]
    return judged.select(F.col("doc_id").alias(id_col), *names, "base_failed", kept.alias("kept"), "stratum", "failed_rules")
