"""Text and number functions as columns; Python only where Spark has no function."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Number words and scales.
UNITS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
    "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
)
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
SCALES = {"hundred": 100.0, "thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
# White space other than line feed and tab, and characters without width.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in "\n\t")
EMPTY = "\u200b\ufeff\u2061"

_VALUES = {w: float(i) for i, w in enumerate(UNITS)} | {w: 10.0 * (i + 2) for i, w in enumerate(TENS)}


def standardized(text: Column) -> Column:
    """White space of all kinds as spaces, characters without width too, and none at the ends."""
    plain = F.translate(text, SPACES + EMPTY, " " * len(SPACES + EMPTY))
    return F.regexp_replace(plain, r"^[ \n\t]+|[ \n\t]+$", "")


def lead_standardized(text: Column) -> Column:
    """The text as it is, without the white space at its start that standardized() drops."""
    return F.regexp_replace(text, f"^[ \\n\\t{SPACES}{EMPTY}]+", "")


@F.pandas_udf(StringType())
def unescaped(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def unescaped_all(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: [None if x is None else html.unescape(x) for x in xs], na_action="ignore")


def _collapsed(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(standardized(text), r"\s+", " ")), r"\.:\d+(-\d+)*", ".")


def standardized_well(text: Column) -> Column:
    """Entities resolved, white space collapsed, reference marks of the kind `.:12-13` dropped."""
    return _collapsed(unescaped(text))


def all_standardized_well(texts: Column) -> Column:
    """The same for each text of an array."""
    return F.transform(unescaped_all(texts), _collapsed)


@F.pandas_udf(StringType())
def without_accents(s: pd.Series) -> pd.Series:
    return s.map(lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"), na_action="ignore")


def marks_removed(text: Column) -> Column:
    return F.trim(F.translate(text, ",%£$", ""))


def once(value: Column, use) -> Column:
    """use(value), the value computed once however often it is named."""
    return F.transform(F.array(value), use)[0]


def number_of(text: Column) -> Column:
    """A number written in digits (commas and percent signs aside) or words; null if it is neither. Needs a number word."""
    bare = F.trim(F.translate(text, ",%", ""))
    words = F.filter(F.split(F.lower(bare), r"\s+"), lambda w: w != "")
    values = F.create_map(*[F.lit(x) for pair in _VALUES.items() for x in pair])
    scales = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])
    start = F.struct(F.lit(0.0).alias("done"), F.lit(0.0).alias("now"))

    def step(a: Column, w: Column) -> Column:
        by, add = F.coalesce(scales[w], F.lit(1.0)), F.coalesce(values[w], F.lit(0.0))
        now = a["now"] * by + add
        return F.struct(F.when(by > 100, a["done"] + now).otherwise(a["done"]).alias("done"), F.when(by > 100, F.lit(0.0)).otherwise(now).alias("now"))

    def said(words: Column) -> Column:
        known = F.forall(words, lambda w: (w == "and") | values[w].isNotNull() | scales[w].isNotNull()) & F.exists(words, lambda w: values[w].isNotNull())
        return F.when(known, F.aggregate(words, start, step, lambda a: a["done"] + a["now"]))

    return F.coalesce(F.when(bare.rlike(r"^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$"), bare.try_cast("double")), once(words, said))


def first_number(text: Column) -> Column:
    """The first number of a text times a magnitude that follows it."""
    found = F.regexp_extract(text, r"(-?\d[\d,]*(?:\.\d+)?)\s*(hundred|thousand|million|billion|trillion)?", 1)
    scale = F.regexp_extract(text, r"(-?\d[\d,]*(?:\.\d+)?)\s*(hundred|thousand|million|billion|trillion)?", 2)
    scales = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])
    return F.when(found != "", F.translate(found, ",", "").try_cast("double") * F.coalesce(scales[scale], F.lit(1.0))).otherwise(number_of(text))


def all_offsets(text: Column, part: Column) -> Column:
    """Offsets from 0 at which a part occurs, overlaps included."""
    last = F.length(text) - F.length(part) + 1
    at = F.when((last >= 1) & (F.length(part) > 0), F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(at, lambda i: F.substring(text, i, F.length(part)) == part), lambda i: i - 1)


def numbers_in(text: Column) -> Column:
    """Numbers of a text with the index of their word, and a sentinel 0 at the end."""
    words = F.split(text, r"\s+")
    found = F.filter(F.transform(words, lambda w, i: F.struct(number_of(F.regexp_replace(w, r"[.;:!?]+$", "")).alias("v"), i.alias("i"))), lambda x: x["v"].isNotNull())
    return F.concat(found, F.array(F.struct(F.lit(0.0).alias("v"), F.lit(-1).alias("i"))))


def to_marks(text: Column) -> Column:
    """`#3` as `@@3@@`."""
    return F.regexp_replace(text, r"#([1-9][0-9]?)", "@@$1@@")


def from_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"@@([1-9][0-9]?)@@", "#$1")


def normalized_answer(text: Column) -> Column:
    """Lower case, without punctuation and articles, single spaces: as span answers are compared."""
    out = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.array_join(F.filter(F.split(out, r"\s+"), lambda w: ~w.isin("", "a", "an", "the")), " ")


def valid_spans(tokens: list[str], span: list[str], ignorable: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Inclusive token ranges that spell a span, ignorable tokens in between left out."""
    out = []
    for start in (i for i, t in enumerate(tokens) if span and t == span[0]):
        at, k = start, 0
        while at < len(tokens) and k < len(span):
            if tokens[at] == span[k]:
                k += 1
            elif tokens[at] not in ignorable:
                break
            at += 1
        if k == len(span):
            out.append((start, at - 1))
    return out


def is_number_word(word: str) -> bool:
    return bool(re.fullmatch(r"[-+]?\d[\d,]*(\.\d+)?", word)) or word.lower() in _VALUES
