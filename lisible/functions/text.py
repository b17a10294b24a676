"""Column functions over text; all built-in, so they stay inside generated code.

Patterns are written with ECMAScript's meaning and translated: a word boundary there is one between ASCII word
characters, and white space is Unicode's.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

WORD = "[A-Za-z0-9_]"
BOUNDARY = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

#: Lower-case letters with marks (Latin-1 and Latin Extended-A) and their base letters, by canonical decomposition.
MARKED = "".join(c for c in map(chr, range(0xE0, 0x180)) if c.islower() and len(unicodedata.normalize("NFD", c)) > 1)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)


#: A boundary before a group whose alternatives all begin with an ASCII letter needs to look back only.
ASCII_GROUP = re.compile(r"\\b(?=\(\?:(?:[a-z][^()|]*\|)*[a-z][^()|]*\))|\\b(?=[A-Za-z])")


def js(pattern: str) -> str:
    """An ECMAScript pattern as a Java one."""
    return ASCII_GROUP.sub(f"(?<!{WORD})", pattern).replace(r"\b", BOUNDARY).replace(r"\s", f"[{SPACE}]")


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(js(pattern)))


def every(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(js(pattern)), F.lit(0))


def collapse(c: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def strip_marks(c: Column) -> Column:
    """Lower case without accents; combining marks go as well."""
    return F.regexp_replace(F.translate(F.lower(c), MARKED, PLAIN), r"[\u0300-\u036F]", "")


def normalise_word(c: Column) -> Column:
    """The key of lexicon and dictionary: trimmed, lower case, ligatures spelled out, one kind of apostrophe and dash."""
    low = F.replace(F.replace(F.lower(F.trim(c)), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    return F.translate(strip_marks(low), "’‐‑–—", "'----")


def lines(text: Column) -> Column:
    """The non-blank lines of a text."""
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


#: Reader, colouring and audio tokens.
READER_TOKEN = r"\s+|\p{L}+(?:['’-]\p{L}+)*|[0-9]+|[^\s\p{L}0-9]"
AUDIO_TOKEN = r"\p{L}[\p{L}\p{M}'’-]*|\d+(?:[.,]\d+)?"


def token_type(value: Column) -> Column:
    return F.when(value.rlike(f"^[{SPACE}]+$"), "space").when(value.rlike(r"\p{L}"), "word").when(value.rlike("^[0-9]+$"), "number").otherwise("punct")


@F.arrow_udf(ArrayType(IntegerType()))
def running_sums(lengths: pa.Array) -> pa.Array:
    """Of each array of lengths its sums up to every entry. One pass over a batch, whatever the length of a text."""
    flat = np.concatenate([[0], np.cumsum(lengths.flatten().to_numpy(zero_copy_only=False))]).astype(np.int64)
    sizes = np.asarray(lengths.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    sums = flat[1:] - np.repeat(flat[offsets[:-1]], sizes)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sums, pa.int32()))


def tokens(text: Column, pattern: str = READER_TOKEN) -> Column:
    """array<struct<value, type, start, end>> of a text; the values joined give the text back. Null gives null."""
    found = every(text, pattern)
    ends = running_sums(F.transform(F.coalesce(found, F.array().cast("array<string>")), F.length))
    return F.zip_with(found, ends, lambda v, e: F.struct(v.alias("value"), token_type(v).alias("type"), (e - F.length(v)).alias("start"), e.alias("end")))


def sentences(text: Column) -> Column:
    """Sentences for reading aids: split after . ! ? and white space."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, f"[{SPACE}]+", " "), f"(?<=[.!?])[{SPACE}]+"), lambda x: F.trim(x)), lambda x: x != "")


def clip(text: Column, most: int, mark: str = "…") -> Column:
    """At most so many characters; a cut word goes and a mark tells of the cut."""
    whole = F.trim(text)
    cut = F.trim(F.regexp_replace(F.substring(whole, 1, most), rf"[{SPACE}]+[^{SPACE}]*$", ""))
    return F.when(F.length(whole) <= most, whole).when(cut != "", F.concat(cut, F.lit(mark))).otherwise(F.concat(F.trim(F.substring(whole, 1, most)), F.lit(mark)))


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def storage_hash(text: Column) -> Column:
    """31-polynomial hash of the code points modulo 2^32 as eight hex digits."""
    total = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.when(c == "", 0).otherwise(F.ascii(c))).bitwiseAND(F.lit(4294967295)))
    return F.lpad(F.lower(F.hex(total)), 8, "0")
