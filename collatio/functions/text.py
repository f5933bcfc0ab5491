"""Text splitting as column expressions, with Python's (not Java's) notion of white space."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that Python's ``\\s`` and ``str.strip`` take as white space, as a regex class body.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The line boundaries of Python's ``str.splitlines``.
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"


def _word_class() -> str:
    """The characters of Python's ``\\w`` as a Java regex class; halves are intersected with their bounds, so that a character meets few ranges."""
    ranges: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if c == ord("_") or chr(c).isalnum():
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    span = lambda a, b: rf"\x{{{a:X}}}-\x{{{b:X}}}"

    def half(some: list[list[int]]) -> str:
        if len(some) <= 8:
            return "".join(span(a, b) for a, b in some)
        m = len(some) // 2
        return "".join(f"[[{span(x[0][0], x[-1][1])}]&&[{half(x)}]]" for x in (some[:m], some[m:]))

    return f"[{half(ranges)}]"


#: Java's own ``\\w`` takes combining marks and leaves numbers such as fractions out.
WORD = _word_class()


def tokens(text: Column) -> Column:
    """Runs of non-space and runs of space, in order; joined they give the text back."""
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+|[{SPACE}]+"), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def _blocks(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda s: s != "")


def lines(text: Column) -> Column:
    """Non-blank lines, stripped."""
    return _blocks(text, LINE_BREAK)


def paragraphs(text: Column) -> Column:
    """Non-blank blocks between blank lines, stripped; the lines if there is only one block."""
    blocks = _blocks(text, rf"\n[{SPACE}]*\n")
    return F.when(F.size(blocks) > 1, blocks).otherwise(lines(text))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"[{SPACE}]+"), lambda s: s != ""))


def char_count(text: Column) -> Column:
    return F.char_length(text)


def too_large(content: Column, most: int = 20 * 1024 * 1024) -> Column:
    """Bytes beyond the upload limit; the limit itself is allowed."""
    return F.octet_length(content) > most


def too_long(text: Column, most: int = 100_000) -> Column:
    """Code points beyond the limit for pasted text."""
    return F.char_length(text) > most
