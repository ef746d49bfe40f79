"""Formatted answers."""

from pyspark.sql import DataFrame, functions as F

from ..functions import render


def lines(rows: DataFrame) -> DataFrame:
    """Add ``role`` and ``line`` to rows of hits and their context."""
    role = render.context_role(F.col("message_id"), F.col("hit_message_id"))
    date = render.format_date(F.col("date"))
    body = render.preview(F.col("text"), F.col("full_text"))
    who = render.who_label(F.col("sender_name"), F.col("receiver_name"), F.col("chat_title"))
    around = render.context_line(role, date, render.sender_label(F.col("sender_name")), body)
    line = F.when(role == "match", render.match_block(date, who, body)).otherwise(around)
    return rows.withColumn("role", role).withColumn("line", line)


def responses(prepared: DataFrame, rows: DataFrame) -> DataFrame:
    """One body per request.

    ``rows`` are :func:`lines` with ``rank`` and ``n_results``. The list that is collected
    per request holds its hits and their context, so it is bounded by the result limit times
    the context budget, whatever the size of the archive.
    """
    is_last = F.col("rank") == F.col("n_results")
    entry = F.struct("rank", F.col("message_id").alias("position"), "line")
    bar = F.struct(
        "rank",
        F.lit(2**63 - 1).alias("position"),
        render.separator(F.col("rank"), F.col("n_results")).alias("line"),
    )
    with_bar = (F.col("role") == "match") & ~is_last
    entries = F.when(with_bar, F.array(entry, bar)).otherwise(F.array(entry))
    joined = (
        rows.select("request_id", "n_results", F.explode(entries).alias("entry"))
        .groupBy("request_id", "n_results")
        .agg(F.sort_array(F.collect_list("entry")).alias("entries"))
        .select("request_id", "n_results", F.array_join("entries.line", "").alias("found"))
    )
    body = F.concat(render.header(F.col("n_results"), F.col("query")), F.col("found"))
    return prepared.join(joined, "request_id", "left").select(
        "request_id",
        F.coalesce("n_results", F.lit(0).cast("bigint")).alias("n_results"),
        F.coalesce(body, F.lit(render.NO_RESULTS)).alias("body"),
    )


def response_chunks(bodies: DataFrame, size: int = render.CHUNK_MAX) -> DataFrame:
    """The messages to send for each body, numbered from 1."""
    return bodies.select(
        "request_id",
        F.posexplode(render.chunks(F.col("body"), size)).alias("chunk_no", "chunk"),
    ).withColumn("chunk_no", (F.col("chunk_no") + 1).cast("bigint"))
