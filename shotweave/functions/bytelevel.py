"""Byte-level text: every UTF-8 byte shown as one printable character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotweave.functions.hashing import as_column

# Fixed value: how text is cut into words before merges are learnt or applied.
WORD_PATTERN = (
    r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def _byte_alphabet() -> list[str]:
    """Character of every byte: itself where printable, else the next from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


BYTE_CHARS = _byte_alphabet()
_LATIN = "".join(chr(b) for b in range(256) if BYTE_CHARS[b] != chr(b))
_SHOWN = "".join(BYTE_CHARS[ord(c)] for c in _LATIN)


def to_byte_level(text) -> Column:
    """Text as its UTF-8 bytes, one printable character each."""
    latin = F.decode(F.encode(as_column(text), "UTF-8"), "ISO-8859-1")
    return F.translate(latin, _LATIN, _SHOWN)


def from_byte_level(shown) -> Column:
    """Back to text; bytes that are no valid UTF-8 become U+FFFD."""
    raw = F.encode(F.translate(as_column(shown), _SHOWN, _LATIN), "ISO-8859-1")
    return F.make_valid_utf8(raw.cast("string"))


def split_words(text) -> Column:
    """Words of one text in order; joined together they are the text again."""
    return F.regexp_extract_all(as_column(text), F.lit(WORD_PATTERN), F.lit(0))


def split_lines(text) -> Column:
    """Lines of a text, each with its line end; the last gets one as well."""
    ended = F.concat(as_column(text), F.lit("\n"))
    return F.regexp_extract_all(ended, F.lit(r"[^\n]*\n"), F.lit(0))


#: Splits on it need no regular expression; texts that have it themselves are cut by one.
_CUT = "\x01"
# All white space but the blank and the line end.
_RARE_SPACE = r"(?U)[\s&&[^ \n]]"


def split_units(text) -> Column:
    """A text cut into words or into whole runs of them, line ends included.

    Cutting the units into words gives the words of the text's lines: no word goes on
    after a blank between two other characters, and what is on either side has no say
    in how the other is cut.  Lines with other white space, or with several blanks in
    a row, are cut into words at once.
    """
    ended = F.concat(as_column(text), F.lit("\n"))
    lines = F.when(F.contains(ended, F.lit(_CUT)), split_lines(text)).otherwise(
        F.split(F.replace(ended, F.lit("\n"), F.lit("\n" + _CUT)), _CUT)
    )

    def units(line: Column) -> Column:
        odd = F.rlike(line, F.lit(_RARE_SPACE))
        for found in (_CUT, "  ", " \n"):
            odd = F.contains(line, F.lit(found)) | odd
        return F.when(odd, split_words(line)).otherwise(F.split(F.replace(line, F.lit(" "), F.lit(_CUT + " ")), _CUT))

    return F.flatten(F.transform(lines, units))
