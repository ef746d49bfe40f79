"""Display rules: preview, labels, dates, lines and chunks of a response."""

from pyspark.sql import Column, functions as F

from .names import present

# Display texts and sizes.
PREVIEW_MAX = 200
PREVIEW_KEPT = 197
ELLIPSIS = "..."
UNKNOWN = "Unknown"
DATE_FORMAT = "yyyy-MM-dd HH:mm"
NO_RESULTS = "No results found."
HEADER_MARK = "🔍"
MATCH_MARK = "🎯"
PERSON_MARK = "👤"
BEFORE_MARK = "⬆️"
AFTER_MARK = "⬇️"
ARROW = " → "
BAR = "════════"
CHUNK_MAX = 4096


def preview(text: Column, full_text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    cut = F.concat(F.left(body, F.lit(PREVIEW_KEPT)), F.lit(ELLIPSIS))
    return F.when(~full_text & (F.length(body) > PREVIEW_MAX), cut).otherwise(body)


def sender_label(sender: Column) -> Column:
    return F.coalesce(present(sender), F.lit(UNKNOWN))


def who_label(sender: Column, receiver: Column, title: Column) -> Column:
    source = sender_label(sender)
    target = F.coalesce(present(receiver), present(title), F.lit(UNKNOWN))
    return F.when(source == target, source).otherwise(F.concat(source, F.lit(ARROW), target))


def format_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), DATE_FORMAT)


def context_role(message_id: Column, hit_message_id: Column) -> Column:
    return (
        F.when(message_id == hit_message_id, "match")
        .when(message_id < hit_message_id, "before")
        .otherwise("after")
    )


def header(count: Column, query: Column) -> Column:
    return F.concat(
        F.lit(f"{HEADER_MARK} Found "), count.cast("string"), F.lit(" results for: "), query, F.lit("\n\n")
    )


def match_block(date: Column, who: Column, body: Column) -> Column:
    return F.concat(
        F.lit(f"{MATCH_MARK} "), date, F.lit(f"\n{PERSON_MARK} "), who, F.lit("\n\n"), body, F.lit("\n")
    )


def context_line(role: Column, date: Column, sender: Column, body: Column) -> Column:
    mark = F.when(role == "before", BEFORE_MARK).otherwise(AFTER_MARK)
    return F.concat(F.lit("  "), mark, F.lit(" "), date, F.lit(" "), sender, F.lit(": "), body, F.lit("\n"))


def separator(rank: Column, count: Column) -> Column:
    return F.concat(
        F.lit(f"\n{BAR} "), rank.cast("string"), F.lit("/"), count.cast("string"), F.lit(f" {BAR}\n\n")
    )


def _pieces(line: Column, size: int) -> Column:
    """One line cut into pieces of at most ``size`` characters; an empty line is one empty piece."""
    last = F.floor((F.greatest(F.length(line), F.lit(1)) - 1) / size).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(line, i * size + 1, F.lit(size))
    )


def chunks(body: Column, size: int = CHUNK_MAX) -> Column:
    """A response as an array of messages of at most ``size`` characters, broken at line ends.

    A short response stays as it is. Otherwise lines are packed greedily; a line that is
    too long by itself is cut, and its remainder goes on packing.
    """

    def pack(state: Column, line: Column) -> Column:
        done, current = state["done"], state["current"]
        joined = F.when(current == "", line).otherwise(F.concat(current, F.lit("\n"), line))
        flushed = F.when(current == "", done).otherwise(F.concat(done, F.array(current)))
        cut = _pieces(line, size)
        full = F.slice(cut, F.lit(1), F.size(cut) - 1)
        fits = F.length(joined) <= size
        return F.struct(
            F.when(fits, done).otherwise(F.concat(flushed, full)).alias("done"),
            F.when(fits, joined).otherwise(F.element_at(cut, -1)).alias("current"),
        )

    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("current")
    )
    packed = F.aggregate(
        F.split(body, "\n"),
        start,
        pack,
        lambda s: F.when(s["current"] == "", s["done"]).otherwise(
            F.concat(s["done"], F.array(s["current"]))
        ),
    )
    return F.when(F.length(body) <= size, F.array(body)).otherwise(packed)
