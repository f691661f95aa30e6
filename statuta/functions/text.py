"""Text expressions: every function takes and returns Columns and stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The obligation phrases that mark a normative sentence.
DEONTIC = ["must", "shall", "should", "required to", "is required to", "is obliged to", "is prohibited from", "prohibited", "forbidden", "may not"]
DEONTIC_PATTERN = r"\b(" + "|".join(DEONTIC) + r")\b"
#: Fixed value: capitalised phrases of up to 1 + n words.
PROPER_NOUN = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,%d})\b"
_CUT = "\u0001"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once: inside other lambdas it would be computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (trim() takes only spaces)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """The words of a text; an empty array for a blank one."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def join_words(array: Column) -> Column:
    return F.array_join(array, " ")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def normalize_text(text: Column) -> Column:
    """Words broken over lines made whole; all white space as single spaces."""
    whole = F.regexp_replace(text, r"(?U)-\s*\n\s*", "")
    return strip(F.regexp_replace(whole, r"(?U)\s+", " "))


def sentences(text: Column, marks: str = ".?!;:") -> Column:
    """Pieces that end in one of marks before white space."""
    pieces = F.split(strip(text), r"(?U)(?<=[" + marks.replace("\n", "\\n") + r"])\s+")
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def lines(text: Column) -> Column:
    """Lines by any line end; a final line end leaves an empty last line."""
    return F.split(text, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]", -1)


def is_capitals(text: Column) -> Column:
    """Has a cased letter, and no lower-case one."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def has_deontic(text: Column) -> Column:
    return text.rlike("(?i)" + DEONTIC_PATTERN)


def proper_nouns(text: Column, more_words: int = 3) -> Column:
    return F.regexp_extract_all(text, F.lit(PROPER_NOUN % more_words), F.lit(1))


def snippet(text: Column, n: int = 300) -> Column:
    return F.translate(F.substring(text, 1, n), "\n", " ")


def truncated(text: Column, n: int = 2000) -> Column:
    """The first n characters, with a mark where more followed."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("\n\n[TRUNCATED]"))).otherwise(text)


def falsy_coalesce(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def cut_at(marked: Column) -> Column:
    """The stripped, non-blank pieces between cut marks."""
    return F.filter(F.transform(F.split(marked, _CUT), strip), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines; the whole text if there is none."""
    pieces = F.filter(F.transform(F.split(text, r"\n{2,}"), strip), lambda s: s != "")
    return let(pieces, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text)))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def file_extension(path: Column) -> Column:
    """In lower case, without the dot."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def split_list(reply: Column) -> Column:
    """Items of a loosely written list: cut at commas, semicolons and lines, without quotes and brackets."""
    return F.filter(F.transform(F.split(reply, r"[,;\n]+"), lambda x: F.btrim(strip(x), F.lit('[] "'))), lambda s: s != "")


def json_array_part(reply: Column) -> Column:
    """From the first [ to the last ]; null if there is none."""
    first = F.locate("[", reply)
    last = F.length(reply) - F.locate("]", F.reverse(reply)) + 1
    return F.when((first > 0) & (F.locate("]", reply) > 0) & (last > first), F.substring(reply, first, last - first + 1))
