"""Candidate stems of a word by stripping grammatical endings."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings in the order in which they are tried, each with what may take their place.
ENDINGS = (
    (("anta", "inta", "onta", "ata", "ita", "ota"), ("i", "")),
    (("ojn", "ajn"), ("", "o", "a")),
    (("oj", "aj", "on", "an"), ("", "o", "a")),
    (("as", "is", "os", "us"), ("i", "")),
    (("o", "a", "e", "i", "u"), ("",)),
    (("n",), ("", "o", "a")),
    (("j",), ("",)),
)


def rules() -> list[tuple[str, str]]:
    """(ending, replacement) in order."""
    return [(e, s) for endings, instead in ENDINGS for e in endings for s in instead]


def stems(word: Column) -> Column:
    """Distinct stems of a word, itself included, shortest first; equal lengths in the order of the rules.

    A rule applies if the word has the ending and more than two characters besides.
    """
    low = F.lower(word)
    table = F.expr("array(" + ", ".join(f"named_struct('ending', '{e}', 'instead', '{s}')" for e, s in rules()) + ")")
    fits = F.filter(table, lambda r: low.endswith(r["ending"]) & (F.length(low) > F.length(r["ending"]) + 2))
    made = F.transform(fits, lambda r: F.concat(F.left(low, F.length(low) - F.length(r["ending"])), r["instead"]))
    every = F.array_distinct(F.concat(F.array(low), made))
    ranked = F.array_sort(F.transform(every, lambda s, i: F.struct(F.length(s).alias("n"), i.alias("i"), s.alias("stem"))))
    return F.transform(ranked, lambda x: x["stem"])
