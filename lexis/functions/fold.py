"""Case and diacritic folding of full-text search, and its tokens."""

import sqlite3
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LOWER, UPPER

#: Everything else separates tokens.
TOKEN_BREAK = r"[^\p{L}\p{N}\p{Co}]+"
#: Blocks in which the tokenizer changes characters.
BLOCKS = ((0x80, 0x2000), (0x2C00, 0x2E00), (0xA640, 0xA7FF))


@cache
def fold_table() -> tuple[str, str]:
    """(from, to) for translate: what the public FTS5 tokenizer `unicode61 remove_diacritics 2` makes of each character.

    The rule is the tokenizer itself, asked once for every character of BLOCKS; the combining marks that it drops come
    last in `from`, without a counterpart in `to`.
    """
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 2')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", [(i, f"q{chr(i)}z") for a, b in BLOCKS for i in range(a, b)])
    terms: dict[int, list[str]] = {}
    for doc, term in db.execute("SELECT doc, term FROM v ORDER BY doc, offset"):
        terms.setdefault(doc, []).append(term)
    db.close()
    images = {chr(i): t[0][1:-1] for i, t in terms.items() if len(t) == 1}
    changed = [c for c, image in images.items() if image and image != c]
    dropped = [c for c, image in images.items() if not image]
    return UPPER + "".join(changed + dropped), LOWER + "".join(images[c] for c in changed)


def fold(text: Column) -> Column:
    """Characters of one byte each have no case but A-Z, which is folded in one go; only other texts are looked up by character."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, *fold_table()))


def tokens(text: Column) -> Column:
    """Folded tokens in order; folding comes first, so that combining marks do not separate."""
    return F.filter(F.split(fold(text), TOKEN_BREAK), lambda t: t != "")
