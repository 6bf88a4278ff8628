"""The tables of a lexicon, and their derived keys."""

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import ascii_fold, drv_key, root_key
from . import covering
from .covering import Copy, read_copy, read_manifest, write_copy, write_manifest

#: Columns of the stored tables. `rid` orders rows as they were ingested.
SCHEMAS = {
    "nodo": "mrk string, art string, kap string, num string, rid bigint",
    "var": "mrk string, kap string, rid bigint",
    "traduko": "mrk string, lng string, trd string, rid bigint",
    "artikolo": "mrk string, txt string, rid bigint",
    "referenco": "mrk string, cel string, tip string, rid bigint",
    "uzo": "mrk string, uzo string, rid bigint",
    "ekzemplo": "art string, drv_mrk string, sense_mrk string, ekz_md string, position int, rid bigint",
}


#: What is stored as it comes in, and what is derived from the stored tables.
BASE = ("nodo", "var", "traduko", "referenco", "uzo", "ekzemplo", "artikolo", "senses", "failures")
DERIVED = ("first", "rotations", "trd_grams", "kap_terms", "kap_blocks", "trd_terms", "trd_blocks", "ekz_terms", "ekz_blocks", "ekz_lengths", "ekz_stats", "heads")
#: The covering copies: of a table, by a key. Derived tables that are only met by one key are stored as its copy alone.
COPIES = {
    "nodo": ("kap_norm", "mrk", "art"), "var": ("kap_norm",), "traduko": ("trd_fold", "drv_mrk", "rid"), "referenco": ("drv_mrk",), "uzo": ("drv_mrk",), "ekzemplo": ("rid",), "senses": ("art",),
    "first": ("mrk",), "rotations": ("head",), "trd_grams": ("gram",), "kap_terms": ("head",), "kap_blocks": ("term",), "trd_terms": ("head",), "trd_blocks": ("term",),
    "ekz_terms": ("head",), "ekz_blocks": ("term",),
}
#: About how many rows a derived table has for each row of a table that comes in, which sets the buckets of its copy.
GROWTH = {
    "first": ("nodo", 1.0), "rotations": ("nodo", 12.0), "trd_grams": ("traduko", 6.0), "kap_terms": ("nodo", 0.5), "kap_blocks": ("nodo", 1.0), "trd_terms": ("traduko", 0.1), "trd_blocks": ("traduko", 0.5),
    "ekz_terms": ("ekzemplo", 0.5), "ekz_blocks": ("ekzemplo", 2.0),
}

#: Tables much larger than that of headwords. Where they are not stored, a search makes only what it asks for of them.
WIDE = ("traduko", "referenco", "uzo", "ekzemplo", "trd_grams")


def with_keys(name: str, df: DataFrame) -> DataFrame:
    """The derived columns that make every search an equality on a stored key."""
    if name in ("nodo", "var"):
        df = df.withColumn("kap_norm", F.lower("kap"))
    if name == "traduko":
        df = df.withColumn("trd_fold", ascii_fold(F.col("trd")))
    if name in ("nodo", "traduko", "referenco", "uzo"):
        df = df.withColumns({"drv_mrk": drv_key(F.col("mrk")), "root_mrk": root_key(F.col("mrk"))})
    return df


@dataclass
class Tables:
    """The tables as DataFrames with keys.

    Optional ones are built when data comes in: `senses` has the parsed articles (`art`, `key`, `senses`), `failures`
    (`art`, `error`) those that could not be parsed, `first` the first node of each key, `rotations` those of headwords,
    `heads` their and the dictionaries' first characters, `trd_grams` the three-character pieces of translations; the others are the inverted
    indexes of headwords, translations and examples. Where one is missing, searches make it as they go. `copies` has the
    covering copies, by table and key, `sizes` the rows of tables as they are stored. Tables that are made anew by each search
    have `unstored`: about how many rows a table will have.
    """

    nodo: DataFrame
    var: DataFrame
    traduko: DataFrame
    referenco: DataFrame
    uzo: DataFrame
    ekzemplo: DataFrame
    artikolo: DataFrame
    senses: DataFrame | None = None
    failures: DataFrame | None = None
    first: DataFrame | None = None
    rotations: DataFrame | None = None
    trd_grams: DataFrame | None = None
    kap_terms: DataFrame | None = None
    kap_blocks: DataFrame | None = None
    trd_terms: DataFrame | None = None
    trd_blocks: DataFrame | None = None
    ekz_terms: DataFrame | None = None
    ekz_blocks: DataFrame | None = None
    ekz_lengths: DataFrame | None = None
    ekz_stats: DataFrame | None = None
    heads: DataFrame | None = None
    copies: dict[tuple[str, str], Copy] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    unstored: Callable[[str], int] | None = None

    @classmethod
    def of(cls, **frames: DataFrame) -> "Tables":
        return cls(**{k: with_keys(k, v) for k, v in frames.items()})

    @property
    def nodo_first(self) -> DataFrame:
        """One row per key: the first ingested one."""
        if self.first is not None:
            return self.first
        first = F.min_by(F.struct("art", "kap", "num", "rid"), "rid").alias("n")
        return self.nodo.groupBy("mrk").agg(first).select("mrk", "n.*")

    def near(self, name: str, key: str, wanted: DataFrame, column: str, settled: bool = False) -> DataFrame:
        """Of a table the rows that can have a key which the batch has in `column`: by a covering copy (see there), or else all.

        Of a wide table that is not stored, others are left out where it is made, before anything is exchanged.
        """
        copy = self.copies.get((name, key))
        if copy is not None:
            return copy.near(wanted, column, settled)
        only = covering.asked_for(wanted, column) if self.unstored and name in WIDE else None
        if only is None:
            return self.derived(name)
        if name == "trd_grams":
            from ..operators.fulltext import grams

            return grams(self.traduko, "trd_fold", only)
        return getattr(self, name).where(only(F.col(key)))

    def rows(self, name: str) -> int:
        """How many rows a table has, or about how many it will have; 0, if that is not known."""
        return self.sizes.get(name) or (self.unstored(name) if self.unstored else 0)

    def derived(self, name: str) -> DataFrame:
        """A table; if it is derived and not stored, it is planned once, and made wherever it is read."""
        if getattr(self, name) is None:
            setattr(self, name, _derivations()[name](self))
        return getattr(self, name)

    def indexed(self) -> "Tables":
        """The tables with the derived ones that they lack."""
        out = replace(self)
        for name in DERIVED:
            out.derived(name)
        return out

    def write(self, folder: str) -> None:
        """Store the tables, then what is derived from the stored ones, then the covering copies, then the list of them all.

        Every table is computed once: what is derived reads files. Readers see the new tables when all are written.
        """
        spark = self.nodo.sparkSession
        listed: dict = {"tables": {}, "copies": []}
        sizes: dict[str, int] = {}

        def keep(name: str, df: DataFrame) -> DataFrame:
            """Store a table and its copies, if it is large enough; a derived table that has a copy is that copy alone."""
            path, schema = f"{folder}/{name}", df.schema
            if name in GROWTH:
                of, times = GROWTH[name]
                sizes[name] = int(times * sizes[of])
            if name not in GROWTH or sizes[name] < covering.WORTH:
                df.write.mode("overwrite").parquet(path)
                df = spark.read.schema(schema).parquet(path)
                listed["tables"][name] = schema.jsonValue()
            if name not in GROWTH:
                sizes[name] = df.count() if name in COPIES else 0
            for key in COPIES.get(name, ()) if sizes[name] >= covering.WORTH else ():
                buckets = write_copy(df, key, f"{path}.{key}", sizes[name])
                listed["copies"].append([name, key, buckets, schema.jsonValue()])
                if name in GROWTH:
                    df = read_copy(spark, f"{path}.{key}", schema, key, buckets).frame.drop("bucket")
            return df

        stored = {name: keep(name, df) for name in BASE if (df := getattr(self, name)) is not None}
        own = replace(self, **stored, copies={}, sizes=sizes, unstored=None, **dict.fromkeys(DERIVED))
        for name, make in _derivations().items():
            setattr(own, name, keep(name, make(own)))
        write_manifest(spark, f"{folder}/tables.json", listed)

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> "Tables":
        """The tables of a folder; what was not stored is None. No file is opened but the list of tables."""
        listed = read_manifest(spark, f"{folder}/tables.json")
        if listed is None:
            raise ValueError(f"no lexicon is stored in {folder}")
        frames = {n: spark.read.schema(StructType.fromJson(schema)).parquet(f"{folder}/{n}") for n, schema in listed["tables"].items()}
        copies = {(n, key): read_copy(spark, f"{folder}/{n}.{key}", StructType.fromJson(schema), key, buckets) for n, key, buckets, schema in listed["copies"]}
        alone = {n: copy.frame.drop("bucket") for (n, _), copy in copies.items() if n not in frames}
        return cls(**frames, **alone, copies=copies)


def _derivations() -> dict[str, Callable[[Tables], DataFrame]]:
    """How each derived table is made from the others, in this order."""
    from ..operators import fulltext as ft
    from ..operators import permuterm

    made: dict[str, Callable[[Tables], DataFrame]] = {
        "first": lambda t: t.nodo_first,
        "rotations": lambda t: permuterm.rotations(t.nodo, t.var),
        "trd_grams": lambda t: ft.grams(t.traduko, "trd_fold"),
        "ekz_lengths": lambda t: ft.lengths(t.ekzemplo, "ekz_md"),
        "ekz_stats": lambda t: ft.corpus_stats(t.ekz_lengths if t.ekz_lengths is not None else ft.lengths(t.ekzemplo, "ekz_md")),
        "kap_blocks": lambda t: ft.blocks(t.nodo.select("kap_norm").unionByName(t.var.select("kap_norm")).distinct().withColumn("rid", F.col("kap_norm")), "kap_norm", t.rows("nodo")),
        "trd_blocks": lambda t: ft.blocks(t.traduko, "trd", t.rows("traduko")),
        "ekz_blocks": lambda t: ft.blocks(t.ekzemplo, "ekz_md", t.rows("ekzemplo")),
    }

    def own(t: Tables, name: str) -> DataFrame:
        return getattr(t, name) if getattr(t, name) is not None else made[name](t)

    for name in ("kap", "trd", "ekz"):
        made[f"{name}_terms"] = lambda t, name=name: ft.terms(own(t, f"{name}_blocks"))
    made["heads"] = lambda t: ft.heads({name: own(t, name) for name in ("rotations", "kap_terms", "ekz_terms")})
    return made
