"""The message-archive shapes of the workload, derived from the given tables with Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from msgsearch.operators.enrich import enrich
from msgsearch.session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _account(number) -> F.Column:
    return F.concat(F.lit("acct"), number.cast("string"))


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per delivered message; some group chats are seen by two accounts."""
    conv, turn = F.col("conv_id"), F.col("turn")
    seen_by = F.when(conv % 10 == 1, F.array(conv % 3, (conv + 1) % 3)).otherwise(
        F.array(conv % 3)
    )
    seen = table(spark, sf_dir, "conversations").withColumn("s", F.explode(seen_by))
    role = F.col("role")
    return seen.select(
        _account(F.col("s")).alias("session_name"),
        (5000 + conv).alias("chat_id"),
        (turn + 1).alias("message_id"),
        F.when((conv + turn) % 13 == 12, "service").otherwise("message").alias("kind"),
        F.when((conv + turn) % 17 == 0, None)
        .when((conv + turn) % 17 == 1, "")
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(role == "user", 1000 + conv % 3)
        .when((role == "assistant") & (conv % 2 == 0), 5000 + conv)
        .when(role == "assistant", 900000 + conv)
        .alias("from_user_id"),
        F.when((role == "system") & (conv % 2 == 1), 5000 + conv).alias("from_channel_id"),
        F.lit(None).cast("bigint").alias("from_chat_id"),
        (F.lit(1704067200).cast("bigint") + conv * 3600 + turn * 60).alias("date"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account owners, peers, groups and group members."""
    conv = F.col("conv_id")
    chats = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    none = F.lit(None).cast("string")

    def rows(source, entity_id, kind, username, first, last, title):
        return source.select(
            entity_id.cast("bigint").alias("entity_id"),
            F.lit(kind).alias("kind"),
            username.alias("username"),
            first.alias("first_name"),
            last.alias("last_name"),
            title.alias("title"),
        )

    text = conv.cast("string")
    owners = chats.select((conv % 3).alias("conv_id")).distinct()
    peers, groups = chats.filter(conv % 2 == 0), chats.filter(conv % 2 == 1)
    return (
        rows(owners, 1000 + conv, "user", none, F.lit("Me"), text, none)
        .unionByName(
            rows(
                peers,
                5000 + conv,
                "user",
                F.concat(F.lit("peer"), text),
                F.lit("Peer"),
                F.when(conv % 4 != 0, text),
                none,
            )
        )
        .unionByName(
            rows(groups, 5000 + conv, "channel", none, none, none, F.concat(F.lit("Group "), text))
        )
        .unionByName(rows(groups, 900000 + conv, "user", none, F.lit("Member"), text, none))
    )


def session_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured chat references per account, one of them leading nowhere."""
    conv = F.col("conv_id")
    chats = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    channel = F.concat(F.lit("-100"), F.lpad((5000 + conv).cast("string"), 10, "0"))
    ref = (
        F.when(conv % 2 == 1, channel)
        .when(conv % 4 == 0, F.concat(F.lit("@peer"), conv.cast("string")))
        .otherwise((5000 + conv).cast("string"))
    )
    followed = chats.filter(conv % 7 != 6)
    own = followed.select(_account(conv % 3).alias("session_name"), ref.alias("chat_ref"))
    second = followed.filter(conv % 10 == 1).select(
        _account((conv + 1) % 3).alias("session_name"), channel.alias("chat_ref")
    )
    nobody = chats.select(_account(conv % 3).alias("session_name")).distinct()
    return (
        own.union(second).distinct().union(nobody.withColumn("chat_ref", F.lit("@nobody")))
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts in their configured order."""
    pos = (F.col("conv_id") % 3).alias("pos")
    return (
        table(spark, sf_dir, "conversations")
        .select(pos)
        .distinct()
        .select(
            "pos", _account(F.col("pos")).alias("name"), (1000 + F.col("pos")).alias("telegram_id")
        )
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with their chat lists."""
    chats = (
        session_chats(spark, sf_dir)
        .groupBy(F.col("session_name").alias("name"))
        .agg(F.sort_array(F.collect_list("chat_ref")).alias("included_chats"))
    )
    return accounts(spark, sf_dir).join(chats, "name")


# A batch of search requests; user 9999 owns no account.
REQUESTS = [
    (1, 1000, "the"),
    (2, 1001, "que la"),
    (3, 1002, "que-la"),
    (4, 9999, "Me"),
    (5, 1001, "group"),
    (6, 1000, "zzznonexistent"),
    (7, 9999, "the context:2,1 toggle_on:full"),
    (8, 1000, "/search der context:,3"),
    (9, 1000, "/start"),
    (10, 1002, "!!! ..."),
    (11, 1002, "die context:3,x"),
    (12, 1000, ""),
]


def requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUESTS, "request_id bigint, user_id bigint, raw_text string")


def turn_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a request, with commands and flags around its whole text."""
    conv, turn = F.col("conv_id"), F.col("turn")
    number = (conv % 14 - 2).cast("string")
    flag = (
        F.when(conv % 8 == 0, F.concat(F.lit(" context:"), number))
        .when(conv % 8 == 1, F.concat(F.lit(" context:"), number, F.lit(","), turn.cast("string")))
        .when(conv % 8 == 2, F.concat(F.lit(" context:,"), number))
        .when(conv % 8 == 3, F.concat(F.lit(" toggle_on:full context:"), number, F.lit(",")))
        .when(conv % 8 == 4, " context:3,x toggle_on:full toggle_off:full")
        .when(conv % 8 == 5, " context: context:abc context:99999999999999999999999999999999999999999")
        .when(conv % 8 == 6, F.concat(F.lit(" context:1 context:+"), turn.cast("string"), F.lit(",")))
        .otherwise("")
    )
    front = (
        F.when(turn % 5 == 1, "/search ")
        .when(turn % 5 == 2, "/start ")
        .when(turn % 5 == 3, "/other ")
        .otherwise("")
    )
    raw = F.when((conv + turn) % 17 == 0, None).when((conv + turn) % 17 == 1, "").otherwise(
        F.concat(front, F.col("text"), flag)
    )
    return table(spark, sf_dir, "conversations").select(
        (conv * 1000 + turn).alias("request_id"),
        (1000 + (conv + turn) % 4).alias("user_id"),
        raw.alias("raw_text"),
    )


def documents_as_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger corpus: each text as a message of its language and source."""
    chat = F.substring("source", 4, 20)
    return table(spark, sf_dir, "documents").select(
        F.concat_ws(":", "lang", chat, F.col("doc_id").cast("string")).alias("id"),
        chat.cast("bigint").alias("chat_id"),
        F.col("doc_id").alias("message_id"),
        F.col("lang").alias("session_name"),
        "text",
        F.lit(None).cast("bigint").alias("sender_id"),
        F.lit(None).cast("string").alias("sender_name"),
        F.col("source").alias("receiver_name"),
        (F.lit(1704067200).cast("bigint") + F.col("doc_id") * 60).alias("date"),
        F.col("source").alias("chat_title"),
    )


# Letters that become ideographs in the mixed-script corpus.
LETTERS, IDEOGRAPHS = "aeious", "今天气真好日"


def mixed_script(column) -> F.Column:
    return F.translate(F.lower(column), LETTERS, IDEOGRAPHS)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched messages as a plan over the given tables."""
    return enrich(
        raw_messages(spark, sf_dir),
        entities(spark, sf_dir),
        accounts(spark, sf_dir),
        session_chats(spark, sf_dir),
    )


_archives: dict[tuple, str] = {}


def _archive(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """A derived document table, written once per application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
    if key not in _archives:
        path = scratch_dir(spark, "archive")
        files = 2 * spark.sparkContext.defaultParallelism
        build(spark, sf_dir).repartition(files, "id").write.parquet(path)
        _archives[key] = path
    return spark.read.parquet(_archives[key])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched messages as a table."""
    return _archive(spark, sf_dir, enriched)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger corpus as a table."""
    return _archive(spark, sf_dir, documents_as_messages)


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger corpus with some letters turned into ideographs, for runs of both scripts."""
    return documents(spark, sf_dir).withColumn("text", mixed_script(F.col("text")))
