"""Operator 9: URL filter of rules and gradient-boosted trees on lexical features."""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, materialise

#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
NAMES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels", "fragment", "secure", "top_suffix", "second_suffix")
BINS = 32
#: Block rates of suffixes are kept in so many slots by hash: a table of fixed size that leaves no suffix out.
SLOTS = 1 << 16


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty for a null url and one without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: tuple) -> Column:
    """The longest fitting rule as struct<rule, verdict>, null without any; of equally long ones the longer host's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def slot(suffix: str) -> int:
    """The slot of a suffix, as pmod(xxhash64(suffix), SLOTS) has it."""
    return xxhash.xxh64_intdigest(suffix.encode("utf-8", "surrogatepass"), 42) % SLOTS


@dataclass
class Trees:
    """Boosted trees of fixed depth: node i has children 2 i + 1 and 2 i + 2; the last level holds the leaves."""

    depth: int
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    rates: np.ndarray = field(default_factory=lambda: np.full(SLOTS, 0.5))

    def margins(self, x: np.ndarray) -> np.ndarray:
        out, inner = np.full(len(x), self.base), 2**self.depth - 1
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out

    def features(self, urls: list[str | None], hosts: list[str], paths: list[str]) -> np.ndarray:
        out = np.zeros((len(urls), len(NAMES)))
        for i, (url, host, path) in enumerate(zip(urls, hosts, paths)):
            url = url or ""
            counts = np.array([url.count(c) for c in set(url)], float)
            share = counts / max(1, len(url))
            query = url.partition("#")[0].partition("?")[2]
            top, second = suffixes(host)
            out[i] = (
                len(url), len(host), len(path), path.strip("/").count("/") + (path.strip("/") != ""), sum(map(url.count, "0123456789")) / max(1, len(url)),
                -(share * np.log2(share)).sum() if url else 0, query.count("&") + (query != ""), host.count("-"), host.count(".") + (host != ""), "#" in url, url.startswith("https:"),
                self.rates[slot(top)], self.rates[slot(second)],
            )
        return out


def suffix_rates(labelled: DataFrame, weight: float = 20.0) -> np.ndarray:
    """Block rates by SLOTS of the suffixes of one and two labels over all labelled urls (`host`, `y`), drawn towards the
    rate of all by `weight` urls. Only the sums of a slot leave the tasks."""
    ends = F.array(F.substring_index("host", ".", -1), F.substring_index("host", ".", -2))
    sums = labelled.select("y", F.explode(F.array_distinct(ends)).alias("s")).groupBy(F.pmod(F.xxhash64("s"), F.lit(SLOTS)).alias("slot"))
    rows = sums.agg(F.count("*").alias("n"), F.sum("y").alias("y")).toArrow()
    n, y = np.zeros(SLOTS), np.zeros(SLOTS)
    n[rows["slot"].to_numpy()], y[rows["slot"].to_numpy()] = rows["n"].to_numpy(), rows["y"].to_numpy()
    prior = y.sum() / n.sum() if n.sum() else 0.5
    return (y + weight * prior) / (n + weight)


def boost(model: Trees, x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.2, penalty: float = 1.0, least: float = 5.0) -> Trees:
    """Second-order boosting of logistic loss over BINS quantile bins a feature."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model.base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin, inner = np.full(len(y), model.base), 2**model.depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for i in range(inner):
            at = np.flatnonzero(node == i)
            best = 1e-6
            if len(at):
                total_g, total_h = g[at].sum(), h[at].sum()
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(binned[at, f], g[at], BINS + 1))[: len(e)]
                    hl = np.cumsum(np.bincount(binned[at, f], h[at], BINS + 1))[: len(e)]
                    gr, hr = total_g - gl, total_h - hl
                    gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - total_g**2 / (total_h + penalty)
                    gain[(hl < least / 4) | (hr < least / 4)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[i], cut[i] = gain[k], f, e[k]
                node[at] = 2 * i + 1 + (x[at, feature[i]] > cut[i])
        leaf = node - inner
        sums = np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        model.trees.append((feature, cut, -rate * sums))
        margin += model.trees[-1][2][leaf]
    return model


def train(judged: DataFrame, most: int = 20_000, depth: int = 3) -> Trees:
    """Fit on the urls that a rule labels; without any, all are allowed.

    A url counts once, however often it occurs. Suffix rates come from all of them, the trees from at most `most`:
    those with the smallest hashes.
    """
    labelled = judged.where("fit is not null").select("url", "host", "path", (F.col("fit.verdict") == "block").cast("double").alias("y")).distinct()
    labelled = materialise(labelled, "url-labels")
    rows = least_hashed(labelled, most, "url").toArrow()
    y = rows["y"].to_numpy()
    model = Trees(depth, base=-1.0)
    if not len(y):
        return model
    model.rates = suffix_rates(labelled)
    return boost(model, model.features(rows["url"].to_pylist(), rows["host"].to_pylist(), rows["path"].to_pylist()), y)


def url_verdicts(pages: DataFrame, rules: tuple = RULES, most: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """Judge every url: `page_id`, `host`, `path`, `rule`, `verdict`, `score`.

    The longest fitting rule decides; other urls get the verdict of trees trained on the urls that rules label (the
    labelled urls at hand), `score` being the chance of block. How often a url is repeated changes no other's verdict. Rules are a parameter list that becomes one
    expression: hundreds are fine, and lists beyond that belong in a joined table. Null, empty and odd urls have an
    empty host and path, no rule, and the trees' verdict. Long urls are read whole; an empty table gives no rows. Repeated rows are judged each; other columns are ignored.
    """
    host, path = parts(F.col("url"))
    judged = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("fit", fitting(F.col("host"), F.col("path"), rules))
    model = pages.sparkSession.sparkContext.broadcast(train(judged, most))

    @F.arrow_udf("double")
    def score(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for url, host, path in columns:
            x = model.value.features(url.to_pylist(), host.to_pylist(), path.to_pylist())
            yield pa.array(1 / (1 + np.exp(-np.clip(model.value.margins(x), -30, 30))), pa.float64())

    scored = judged.withColumn("score", score("url", "host", "path"))
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", learned).alias("verdict"), "score")
