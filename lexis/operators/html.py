"""Senses and example sentences from dictionary articles in HTML."""

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import BLANKS

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_JS_BLANKS = re.sub(r"\\x\{(\w+)\}", lambda m: "\\u" + m[1].zfill(4), BLANKS)
SENSE = "struct<mrk:string,num:string,definition:string,examples:array<string>,domain:string>"


@dataclass
class Node:
    """An element; `children` holds elements and raw text (entities still encoded)."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: "Node | None" = None
    children: list = field(default_factory=list)
    elements: list["Node"] = field(default_factory=list)  # of the children, and this one's place among its parent's
    nth: int = 0

    def add(self, node: "Node") -> None:
        node.nth = len(self.elements)
        self.elements.append(node)
        self.children.append(node)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator["Node"]:
        """All elements below this one, in document order; by a stack, as pages nest to any depth."""
        ahead = self.elements[::-1]
        while ahead:
            node = ahead.pop()
            yield node
            ahead += node.elements[::-1]

    def all(self, *kinds: tuple[str, str | None]) -> list["Node"]:
        """Descendants of any of the (tag, class or None) kinds."""
        return [n for n in self.walk() if n.fits(*kinds)]

    def fits(self, *kinds: tuple[str, str | None]) -> bool:
        return any(self.tag == t and (c is None or c in self.classes) for t, c in kinds)

    def first(self, *kinds: tuple[str, str | None]) -> "Node | None":
        return next((n for n in self.walk() if n.fits(*kinds)), None)

    def closest(self, tag: str, cls: str | None = None) -> "Node | None":
        node = self
        while node is not None and not (node.tag == tag and (cls is None or cls in node.classes)):
            node = node.parent
        return node

    def beside(self, step: int) -> "Node | None":
        """The next (1) or previous (-1) sibling element."""
        at = self.nth + step
        return self.parent.elements[at] if self.parent is not None and 0 <= at < len(self.parent.elements) else None

    def raw(self, skip: Callable[["Node"], bool] = lambda n: False) -> str:
        out, ahead = [], self.children[::-1]
        while ahead:
            c = ahead.pop()
            if isinstance(c, str):
                out.append(c)
            elif not skip(c):
                ahead += reversed(c.children)
        return "".join(out)

    def text(self, skip: Callable[["Node"], bool] = lambda n: False) -> str:
        return html.unescape(self.raw(skip))


class TreeBuilder(HTMLParser):
    """Lenient: an end tag closes up to its nearest open start tag, or nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = self.at = Node("")
        self.open: Counter[str] = Counter()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.add(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.add(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        while self.open[tag]:  # else nothing of the kind is open
            self.open[self.at.tag] -= 1
            closed, self.at = self.at, self.at.parent
            if closed.tag == tag:
                return

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def handle_entityref(self, name: str) -> None:
        self.at.children.append(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.at.children.append(f"&#{name};")


def parse(text: str) -> Node:
    builder = TreeBuilder()
    builder.feed(text)
    builder.close()
    return builder.root


def clean(text: str) -> str:
    return re.sub(f"[{_JS_BLANKS}]+", " ", text).strip(" ")


def trim(text: str) -> str:
    return re.sub(f"^[{_JS_BLANKS}]+|[{_JS_BLANKS}]+$", "", text)


def is_reference(n: Node) -> bool:
    return n.tag in ("span", "sup") and "fntref" in n.classes


def examples(container: Node) -> list[str]:
    found = [clean(e.text(is_reference)) for e in container.all(("i", "ekz"))]
    return [e for e in found if e]


def definition(dif: Node) -> str:
    return clean(dif.text(lambda n: is_reference(n) or (n.tag == "i" and "ekz" in n.classes)))


def sense_of(dd: Node, key: str | None, num: str | None) -> dict:
    dif, domain = dd.first(("span", "dif")), dd.first(("abbr", "uzo"), ("span", "uzo"))
    return {"mrk": key, "num": num, "definition": definition(dif) if dif else "", "examples": examples(dd), "domain": trim(domain.text()) if domain else None}


def senses_of(drv: Node, key: str) -> list[dict]:
    """Numbered senses: every dt (nested ones too) whose class text lacks `lng` and that a dd follows; else one sense."""
    numbered = [dt for dt in drv.all(("dt", None)) if "lng" not in dt.attrs.get("class", "")]
    if numbered:
        pairs = [(dt, dt.beside(1)) for dt in numbered]
        return [sense_of(dd, dt.attrs.get("id"), trim(dt.text())) for dt, dd in pairs if dd is not None and dd.tag == "dd"]
    dd = drv.first(("dd", None))
    if dd is not None and not dd.attrs.get("lang"):
        return [sense_of(dd, key, None)]
    dif = drv.first(("span", "dif"))
    if dif is None:
        return []
    return [{"mrk": key, "num": None, "definition": definition(dif), "examples": examples(dif.parent), "domain": None}]


def derivations(root: Node) -> list[dict]:
    """Every section of class drv with an h2: key, headword, senses."""
    heads = [(drv, drv.first(("h2", None))) for drv in root.all(("section", "drv"))]
    return [{"mrk": h.attrs.get("id", ""), "headword": clean(h.text()), "senses": senses_of(drv, h.attrs.get("id", ""))} for drv, h in heads if h is not None]


def keyed_senses(root: Node) -> dict[str, list[dict]]:
    """Senses by derivation key and by sense key; a derivation's key goes before an equal sense key."""
    out: dict[str, list[dict]] = {}
    heads: set[str] = set()
    for h in root.all(("h2", None)):
        key, drv = h.attrs.get("id"), h.closest("section", "drv")
        if key and key not in heads:
            heads.add(key)
            if drv is not None:
                out[key] = senses_of(drv, key)
    tried: set[str] = set()
    for dt in root.all(("dt", None)):
        key, drv, dd = dt.attrs.get("id"), dt.closest("section", "drv"), dt.beside(1)
        if not key or key in tried:
            continue  # only the first dt with an id stands for it
        tried.add(key)
        if key not in out and drv is not None and drv.first(("h2", None)) is not None and dd is not None:
            out[key] = [sense_of(dd, key, trim(dt.text()))]
    return out


def markdown(ekz: Node) -> str:
    """An example in Markdown: names in bold, footnotes dropped, entities as they are written."""
    out: list[str] = []
    ahead = ekz.children[::-1]
    while ahead:
        c = ahead.pop()
        if isinstance(c, str):
            out.append(c)
        elif not {"fnt", "fntref"} & set(c.classes):
            mark = "**" if "nom" in c.classes else ""
            out.append(mark)
            ahead += [mark, *reversed(c.children)]
    return clean("".join(out))


def sense_key(ekz: Node) -> str | None:
    """The id of the nearest dt before the dd around the example."""
    dd = ekz.closest("dd")
    node = dd.beside(-1) if dd is not None else None
    while node is not None and node.tag != "dt":
        node = node.beside(-1)
    return node.attrs.get("id") if node is not None else None


def article_examples(root: Node) -> list[tuple[str, str | None, str]]:
    """(derivation key, sense key, Markdown) of every example that is not empty."""
    out = []
    for drv in root.all(("section", "drv")):
        h = drv.first(("h2", None))
        if h is not None and h.attrs.get("id"):
            out += [(h.attrs["id"], sense_key(e), md) for e in drv.all(("i", "ekz")) if (md := markdown(e))]
    return out


def page_examples(root: Node) -> list[tuple[str, str | None, str]]:
    """Our reading of general web pages: the paragraphs of the article, under its h1, without navigation and advertising."""
    noise = {"nav", "script", "style", "footer", "header", "aside"}
    head = root.first(("h1", None))
    key = clean(head.text()) if head is not None else ""
    skip = lambda n: n.tag in noise or "ad" in n.classes
    out = []
    for article in root.all(("article", None)):
        for p in article.all(("p", None)):
            around = p
            while around is not None and not skip(around):
                around = around.parent
            if around is None and (md := clean(p.text(skip))):
                out.append((key, None, md))
    return out


def _rows(articles: DataFrame, make: Callable[[str, Node], Iterator[dict]], schema: str) -> DataFrame:
    """The rows that `make` finds in each article, with `error` null; one row with `error` for an article that fails."""

    names = [*StructType.fromDDL(schema).names, "error"]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for mrk, rid, txt in zip(f["mrk"], f["rid"], f["txt"]):
                if txt is not None:
                    try:
                        found += [row | {"rid": rid} for row in make(mrk, parse(txt))]
                    except Exception as e:  # noqa: BLE001  one bad page must not end the job
                        found.append({"art": mrk, "rid": rid, "error": f"{type(e).__name__}: {e}"[:500]})
            yield pd.DataFrame(found, columns=names).astype(object).where(lambda x: x.notna(), None)

    return articles.select("mrk", "rid", F.col("txt").cast("string").alias("txt")).mapInPandas(scan, f"{schema}, error string")


def _good(rows: DataFrame) -> DataFrame:
    return rows.where("error is null").drop("error")


def parse_articles(articles: DataFrame) -> DataFrame:
    """One row per derivation: `art`, `position`, `mrk`, `headword`, `senses`."""
    return _good(_rows(articles, lambda art, root: ({"art": art, "position": i, **d} for i, d in enumerate(derivations(root))), f"art string, position int, mrk string, headword string, senses array<{SENSE}>"))


def extracted(articles: DataFrame, profile: str = "dictionary") -> DataFrame:
    """All that an article has, by one parse: `art`, `rid`, `keyed` (key and senses), `examples`, or `error`.

    Store this, and take senses, examples and failures from what is stored.
    """
    find = {"dictionary": article_examples, "page": page_examples}[profile]

    def make(art: str, root: Node) -> Iterator[dict]:
        keyed = [{"key": k, "senses": s} for k, s in keyed_senses(root).items()] if profile == "dictionary" else []
        yield {"art": art, "keyed": keyed, "examples": [{"drv_mrk": d, "sense_mrk": s, "ekz_md": md} for d, s, md in find(root)]}

    return _rows(articles, make, f"art string, rid long, keyed array<struct<key:string,senses:array<{SENSE}>>>, examples array<struct<drv_mrk:string,sense_mrk:string,ekz_md:string>>")


def senses_in(found: DataFrame) -> DataFrame:
    """`art`, `key`, `senses`; of an article's key that repeats, as of articles that do, the first."""
    each = _good(found).select("art", "rid", F.explode("keyed").alias("k"))
    return each.groupBy("art", F.col("k.key").alias("key")).agg(F.min_by("k.senses", "rid").alias("senses"))


def failures_in(found: DataFrame) -> DataFrame:
    """`art`, `error` of the articles that cannot be parsed; all others give their rows regardless."""
    return found.where("error is not null").select("art", "error")


def examples_in(found: DataFrame) -> DataFrame:
    """The example corpus. `position` counts an article's examples from 0; `rid` is the article's, then the position."""
    rows = _good(found).select("art", "rid", F.posexplode("examples").alias("position", "e")).select("art", "e.*", "position", "rid")
    return rows.withColumn("rid", F.shiftleft("rid", 20).bitwiseOR(F.col("position").cast("bigint")))


def parse_senses(articles: DataFrame) -> DataFrame:
    return senses_in(extracted(articles))


def failures(articles: DataFrame) -> DataFrame:
    return failures_in(extracted(articles))


def build_examples(articles: DataFrame, profile: str = "dictionary") -> DataFrame:
    return examples_in(extracted(articles, profile))
