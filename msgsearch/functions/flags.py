"""Routing of request texts and parsing of the flags inside them."""

from pyspark.sql import Column, functions as F

from .text import split_blanks

# Flag spellings, the per-side bound and the command patterns.
FULL_ON = "toggle_on:full"
FULL_OFF = "toggle_off:full"
CONTEXT = "context:"
SIDE_MAX = 10
TOTAL_MAX = 20
HELP_COMMAND = r"^/start"
SEARCH_COMMAND = r"^/search ([^\n]+)"


def route(raw: Column) -> Column:
    return (
        F.when(raw.rlike(HELP_COMMAND), "help")
        .when(raw.rlike(SEARCH_COMMAND), "search")
        .when(raw.startswith("/") | raw.isNull() | (raw == ""), "ignored")
        .otherwise("search")
    )


def routed_query(raw: Column) -> Column:
    """The query text of a request that is routed to the search, else null."""
    return F.when(
        route(raw) == "search",
        F.when(raw.startswith("/"), F.regexp_extract(raw, SEARCH_COMMAND, 1)).otherwise(raw),
    )


def _is_number(piece: Column) -> Column:
    return piece.rlike(r"^[+-]?[0-9]+$")


def clamp_number(piece: Column, upper: int = SIDE_MAX) -> Column:
    """Numeric text limited to 0..upper, whatever its length; null if it is no number."""
    digits = F.regexp_replace(piece, r"^[+-]?0*", "")
    return (
        F.when(~_is_number(piece), None)
        .when(piece.startswith("-") | (digits == ""), 0)
        .when(F.length(digits) > len(str(upper)), upper)
        .otherwise(F.least(digits.try_cast("int"), F.lit(upper)))
    )


def _settable(piece: Column) -> Column:
    return (piece == "") | _is_number(piece)


def _value(piece: Column) -> Column:
    return F.when(piece == "", 0).otherwise(clamp_number(piece))


def _sides(token: Column) -> tuple[Column, Column, Column]:
    raw = F.substring(token, len(CONTEXT) + 1, 2**31 - 1)
    comma = F.instr(raw, ",")
    left = F.when(comma > 0, F.left(raw, comma - 1)).otherwise(raw)
    right = F.when(comma > 0, F.right(raw, F.length(raw) - comma)).otherwise(raw)
    return comma > 0, left, right


def _sets_before(token: Column) -> Column:
    pair, left, _ = _sides(token)
    return token.startswith(CONTEXT) & F.when(pair, _settable(left)).otherwise(_is_number(left))


def _sets_after(token: Column) -> Column:
    pair, left, right = _sides(token)
    both = _settable(left) & _settable(right)
    return token.startswith(CONTEXT) & F.when(pair, both).otherwise(_is_number(right))


def _last(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.element_at(items, -1))


def parse_flags(
    query: Column, full_text: Column, before: Column, after: Column
) -> dict[str, Column]:
    """Columns ``query, full_text, before, after`` of a request text; arguments are the defaults.

    The last setting of each side wins. A malformed ``context:`` stays in the query; if
    only its right half is malformed, the left half has taken effect all the same.
    """
    tokens = split_blanks(query)
    toggle = _last(F.filter(tokens, lambda t: t.isin(FULL_ON, FULL_OFF)))
    set_before = _last(F.filter(tokens, _sets_before))
    set_after = _last(F.filter(tokens, _sets_after))
    kept = F.filter(tokens, lambda t: ~t.isin(FULL_ON, FULL_OFF) & ~_sets_after(t))
    return {
        "query": F.array_join(kept, " "),
        "full_text": F.when(toggle.isNotNull(), toggle == FULL_ON).otherwise(full_text),
        "before": F.when(set_before.isNotNull(), _value(_sides(set_before)[1])).otherwise(before),
        "after": F.when(set_after.isNotNull(), _value(_sides(set_after)[2])).otherwise(after),
    }


def context_budget(before: Column, after: Column) -> tuple[Column, Column]:
    """Both sides floored at 0 and shrunk so that they take at most 20 messages together."""
    low_b, low_a = F.greatest(before, F.lit(0)), F.greatest(after, F.lit(0))
    half = TOTAL_MAX // 2
    over = low_b + low_a > TOTAL_MAX
    fit_b = F.when(low_b <= half, low_b).when(low_a <= half, TOTAL_MAX - low_a).otherwise(half)
    fit_a = F.when(low_a <= half, low_a).when(low_b <= half, TOTAL_MAX - low_b).otherwise(half)
    return F.when(over, fit_b).otherwise(low_b), F.when(over, fit_a).otherwise(low_a)


def context_defaults(
    preceding: Column, subsequent: Column, shared: Column
) -> tuple[Column, Column]:
    """Configured context sizes: the side's own setting, else the shared one, never below 0."""
    fallback = F.greatest(F.coalesce(shared, F.lit(0)), F.lit(0))
    return (
        F.greatest(F.coalesce(preceding, fallback), F.lit(0)),
        F.greatest(F.coalesce(subsequent, fallback), F.lit(0)),
    )
