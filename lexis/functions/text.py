"""Text normalisation as column expressions.

Four notions of case live side by side and must not be mixed: full Unicode lower case (headwords), ASCII folding
(translations, LIKE), diacritics removed (full text; see fold.py), and code point order (sorting).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of ECMAScript, inside a character class.
BLANKS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Base letters of the x-system and the letters they stand for.
X_LETTERS = {"c": "ĉ", "g": "ĝ", "h": "ĥ", "j": "ĵ", "s": "ŝ", "u": "ŭ"}

#: Esperanto names of languages by code.
LANGUAGE_NAMES = {
    "af": "Afrikaans", "am": "Amara", "ar": "Araba", "az": "Azerbajĝana", "be": "Belarusa", "bg": "Bulgara",
    "bn": "Bengala", "bo": "Tibeta", "br": "Bretona", "bs": "Bosnia", "ca": "Kataluna", "co": "Korsika",
    "cs": "Ĉeĥa", "cy": "Kimra", "da": "Dana", "de": "Germana", "el": "Greka", "en": "Angla", "eo": "Esperanto",
    "es": "Hispana", "et": "Estona", "eu": "Eŭska", "fa": "Persa", "fi": "Finna", "fr": "Franca", "fy": "Frisa",
    "ga": "Irlanda", "gd": "Gaela", "gl": "Galega", "gu": "Guĝarata", "ha": "Haŭsa", "he": "Hebrea", "hi": "Hinda",
    "hr": "Kroata", "hu": "Hungara", "hy": "Armena", "id": "Indonezia", "is": "Islanda", "it": "Itala",
    "ja": "Japana", "jv": "Java", "ka": "Kartvela", "kk": "Kazaĥa", "km": "Kmera", "kn": "Kanara", "ko": "Korea",
    "ku": "Kurda", "ky": "Kirgiza", "la": "Latina", "lb": "Luksemburga", "lt": "Litova", "lv": "Latva",
    "mg": "Malagasa", "mk": "Makedona", "ml": "Malajala", "mn": "Mongola", "mr": "Marata", "ms": "Malaja",
    "mt": "Malta", "my": "Birma", "ne": "Nepala", "nl": "Nederlanda", "no": "Norvega", "oc": "Okcitana",
    "pa": "Panĝaba", "pl": "Pola", "ps": "Paŝtua", "pt": "Portugala", "qu": "Keĉua", "rm": "Romanĉa",
    "ro": "Rumana", "ru": "Rusa", "rw": "Ruanda", "sa": "Sanskrita", "sd": "Sinda", "si": "Sinhala",
    "sk": "Slovaka", "sl": "Slovena", "so": "Somala", "sq": "Albana", "sr": "Serba", "sv": "Sveda",
    "sw": "Svahila", "ta": "Tamila", "te": "Telugua", "tg": "Taĝika", "th": "Taja", "tk": "Turkmena",
    "tl": "Filipina", "tr": "Turka", "tt": "Tatara", "ug": "Ujgura", "uk": "Ukraina", "ur": "Urdua",
    "uz": "Uzbeka", "vi": "Vjetnama", "xh": "Ksosa", "yi": "Jida", "yo": "Joruba", "zh": "Ĉina", "zu": "Zulua",
    "sgn": "Signolingvo",
}
#: Labels of cross-reference types.
REF_LABELS = {
    "vid": "See", "sin": "Synonym", "ant": "Antonym", "dif": "Differs from", "super": "Broader", "sub": "Narrower",
    "prt": "Part of", "hom": "Homonym", "malprt": "Contains",
}
#: Languages shown where a request names none.
SHOWN_IN_LOOKUP = ("en", "de", "fr", "es", "ru", "zh", "ja")
SHOWN_IN_FAMILY = ("en", "de", "fr", "es", "ru")


def x_pairs() -> list[tuple[str, str]]:
    """Each digraph and its letter: cx, Cx and CX forms (cX is left as it is)."""
    return [p for c, a in X_LETTERS.items() for p in ((c + "x", a), (c.upper() + "x", a.upper()), (c.upper() + "X", a.upper()))]


def from_x_system(text: Column) -> Column:
    for pair, letter in x_pairs():
        text = F.replace(text, F.lit(pair), F.lit(letter))
    return text


def has_x_system(text: Column) -> Column:
    return text.rlike("[cCgGhHjJsSuU][xX]")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{BLANKS}]+|[{BLANKS}]+$", "")


def clean_text(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, rf"[{BLANKS}]+", " "), "^ | $", "")


def normalize_query(query: Column) -> Column:
    return F.lower(from_x_system(strip(query)))


def ascii_fold(text: Column) -> Column:
    """Case folding of A-Z only, as NOCASE comparison and LIKE have it."""
    return F.translate(text, UPPER, LOWER)


def like(text: Column, pattern: Column) -> Column:
    """LIKE without an escape character, ASCII case folded."""
    return F.like(ascii_fold(text), F.replace(ascii_fold(pattern), F.lit("\\"), F.lit("\\\\")))


def like_pattern(glob: Column) -> Column:
    """A glob with * as a LIKE pattern; % and _ stay live."""
    return F.replace(F.lower(glob), F.lit("*"), F.lit("%"))


def drv_key(mrk: Column) -> Column:
    """The first two segments of a dotted key."""
    return F.substring_index(mrk, ".", 2)


def root_key(mrk: Column) -> Column:
    return F.substring_index(mrk, ".", 1)


def labelled(code: Column, names: dict[str, str]) -> Column:
    """The name of a code from a small fixed table; unknown codes stand for themselves."""
    table = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in names.items()) + ")")
    return F.coalesce(F.try_element_at(table, code), code)


def language_name(code: Column) -> Column:
    return labelled(code, LANGUAGE_NAMES)


def ref_label(kind: Column) -> Column:
    return labelled(kind, REF_LABELS)
