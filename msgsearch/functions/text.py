"""Text analysis as native column expressions.

Words are maximal runs of letters and digits, lower-cased. Chinese text has no blanks,
so each run of ideographs is indexed as its single characters and its overlapping pairs;
a query looks for pairs only, or for the character when it stands alone. Every
expression is linear in the length of the text.
"""

from pyspark.sql import Column, functions as F

# The ideograph range, the word pattern and the blanks that separate parts.
CJK = r"[\x{4e00}-\x{9fff}]"
WORD = r"[\p{L}\p{N}]+"
BLANKS = r"[\t-\r\x1c-\x20\x85\p{Z}]+"

# The same without ideographs, whose runs end a word.
_PLAIN_WORD = r"[\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]+"
_PAIR = rf"(?=({CJK}{{2}}))"
_LONE = rf"(?<!{CJK}){CJK}(?!{CJK})"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokens(text: Column, *ideographs: Column) -> Column:
    """Words and tokens of ideographs; a text without any is passed over once."""
    lower = F.lower(text)
    return F.when(text.rlike(CJK), F.concat(_all(lower, _PLAIN_WORD), *ideographs)).otherwise(_all(lower, WORD))


def index_tokens(text: Column) -> Column:
    """All tokens of a document field, repeats included; empty for a null text."""
    found = tokens(text, _all(text, CJK), _all(text, _PAIR, 1))
    return F.coalesce(found, F.array().cast("array<string>"))


def query_tokens(part: Column) -> Column:
    """The distinct tokens that a document must contain to satisfy one query part."""
    return F.array_distinct(tokens(part, _all(part, _LONE), _all(part, _PAIR, 1)))


def split_blanks(text: Column) -> Column:
    """Split on any Unicode blank, without empty pieces."""
    return F.filter(F.split(text, BLANKS), lambda piece: piece != "")
