"""The functions of this package for SQL: session functions, all native.

    register(spark)
    spark.sql("SELECT id, c.* FROM messages, LATERAL chunk_lines(text, 4096) AS c")
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.matching import B, K1
from .text import BLANKS, CJK, WORD

_WORDS = rf"regexp_extract_all(lower(t), r'{WORD}', 0)"
_BETWEEN = rf"regexp_extract_all(regexp_replace(lower(t), r'{CJK}+', ' '), r'{WORD}', 0)"
_PAIRS = rf"regexp_extract_all(t, r'(?=({CJK}{{2}}))', 1)"
_SINGLE = rf"regexp_extract_all(t, r'{CJK}', 0)"
_LONE = rf"regexp_extract_all(t, r'(?<!{CJK}){CJK}(?!{CJK})', 0)"


def _tokens(singles: str) -> str:
    return f"CASE WHEN t RLIKE r'{CJK}' THEN concat({_BETWEEN}, {singles}, {_PAIRS}) ELSE {_WORDS} END"


_JOINED = "CASE WHEN s.current = '' THEN line ELSE concat(s.current, '\\n', line) END"
_FLUSHED = "CASE WHEN s.current = '' THEN s.done ELSE concat(s.done, array(s.current)) END"
_CUT = (
    "transform(sequence(0, CAST(floor((greatest(length(line), 1) - 1) / size) AS INT)), "
    "k -> substring(line, k * size + 1, size))"
)
_STEP = (
    f"CASE WHEN length({_JOINED}) <= size THEN named_struct('done', s.done, 'current', {_JOINED}) "
    f"ELSE named_struct('done', concat({_FLUSHED}, slice({_CUT}, 1, cardinality({_CUT}) - 1)), 'current', element_at({_CUT}, -1)) END"
)
_CHUNKS = (
    "CASE WHEN length(body) <= size THEN array(body) ELSE aggregate(split(body, '\\n'), "
    "named_struct('done', CAST(array() AS ARRAY<STRING>), 'current', ''), "
    f"(s, line) -> {_STEP}, s -> {_FLUSHED}) END"
)

FUNCTIONS = {
    "index_tokens(t STRING) RETURNS ARRAY<STRING>": f"coalesce({_tokens(_SINGLE)}, CAST(array() AS ARRAY<STRING>))",
    "query_tokens(t STRING) RETURNS ARRAY<STRING>": f"array_distinct({_tokens(_LONE)})",
    "query_parts(t STRING) RETURNS ARRAY<STRING>": f"filter(split(t, r'{BLANKS}'), p -> p <> '')",
    "term_rarity(df BIGINT, n_docs BIGINT) RETURNS DOUBLE": "ln(1 + (n_docs - df + 0.5D) / (df + 0.5D))",
    "term_saturation(tf BIGINT, dl BIGINT, avg_len DOUBLE) RETURNS DOUBLE": f"tf * {K1 + 1}D / (tf + {K1}D * ({1 - B}D + {B}D * dl / avg_len))",
    "message_chunks(body STRING, size INT) RETURNS ARRAY<STRING>": _CHUNKS,
    "chunk_lines(body STRING, size INT) RETURNS TABLE (chunk_no BIGINT, chunk STRING)": (
        f"SELECT CAST(pos + 1 AS BIGINT), col FROM posexplode({_CHUNKS})"
    ),
    "text_terms(t STRING) RETURNS TABLE (term STRING)": f"SELECT col FROM explode({_tokens(_SINGLE)})",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session, in place of earlier ones of these names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
