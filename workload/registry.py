"""Every query of the workload with its SQL check.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLES[name]`` is the same in SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from msgsearch.functions import flags, names, render, sql, text
from msgsearch.operators import enrich, ingest, matching, postings, resolve
from msgsearch.operators.context import context
from msgsearch.operators.gaps import GAP, chat_gaps
from msgsearch.operators.lexicon import Lexicon
from msgsearch.operators.response import lines, responses
from msgsearch.operators.sequence import message_sequence
from msgsearch.operators.topk import top_k
from msgsearch.plans import alerts, answer as answers, requests as rq, search as plans, skipping
from msgsearch.schemas import DOCUMENT_COLUMNS, RAW_MESSAGE
from msgsearch.session import scratch_dir, stored
from msgsearch.sources import readers
from msgsearch.sources.corpus import IndexCorpus, ScanCorpus
from msgsearch.sources.index_store import DEFAULT_BUCKETS, MessageIndex
from msgsearch.sources.paged import write_pages
from msgsearch.streaming import live

from . import oracle as o, views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep


_paths: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, label: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _paths:
        _paths[key] = build()
    return _paths[key]


M = o.query(["m"], f"SELECT {o.M_COLUMNS} FROM m")
RAW = ", ".join(RAW_MESSAGE.fieldNames())

# --- scans, resolving, enriching ------------------------------------------------------------


def _export(spark: SparkSession, sf_dir: str) -> str:
    """Raw messages as JSON lines, one folder per account, as history exports come."""

    def build() -> str:
        path = scratch_dir(spark, "export")
        raw = v.raw_messages(spark, sf_dir)
        raw.withColumn("account", F.col("session_name")).write.partitionBy("account").json(path)
        return path

    return _once(spark, sf_dir, "export", build)


@register("scan_messages", o.query(["raw_messages"], f"SELECT {RAW} FROM raw_messages"))
def _(spark, sf_dir):
    return readers.read_messages(spark, _export(spark, sf_dir), "json").select(
        *RAW_MESSAGE.fieldNames()
    )


@register("union_sessions", o.query(["raw_messages"], f"SELECT {RAW} FROM raw_messages"))
def _(spark, sf_dir):
    root = _export(spark, sf_dir)
    paths = [f"{root}/account=acct{i}" for i in range(3)]
    return readers.read_messages(spark, paths, "json").select(*RAW_MESSAGE.fieldNames())


def _paged(spark: SparkSession, sf_dir: str, path: str, condition: str = "true") -> str:
    """Raw messages in pages of three, whose lines leave account and chat to their folders."""
    chat = Window.partitionBy("session_name", "chat_id").orderBy("message_id")
    rows = v.raw_messages(spark, sf_dir).withColumn("page", ((F.row_number().over(chat) - 1) / 3).cast("bigint"))
    said = [c for c in RAW_MESSAGE.fieldNames() if c not in ("session_name", "chat_id")]
    lines = rows.filter(condition).select(
        F.col("session_name").alias("account"), F.col("chat_id").alias("chat"), "page", F.to_json(F.struct(*said)).alias("line")
    )
    write_pages(lines, path)
    return path


@register("scan_paged", o.query(["raw_messages"], f"SELECT {RAW} FROM raw_messages"))
def _(spark, sf_dir):
    path = _paged(spark, sf_dir, scratch_dir(spark, "pages"))
    return readers.read_pages(spark, path).select(*RAW_MESSAGE.fieldNames())


@register("filter_text_messages", o.query(["text_rows"], f"SELECT {RAW} FROM text_rows"))
def _(spark, sf_dir):
    return enrich.text_messages(v.raw_messages(spark, sf_dir))


@register(
    "semi_included_chats",
    o.query(
        ["raw_messages", "chats"],
        f"SELECT {RAW} FROM raw_messages r WHERE EXISTS (SELECT 1 FROM chats c "
        "WHERE c.session_name = r.session_name AND c.chat_id = r.chat_id)",
    ),
)
def _(spark, sf_dir):
    chats = resolve.resolved_chats(v.session_chats(spark, sf_dir), v.entities(spark, sf_dir))
    return v.raw_messages(spark, sf_dir).join(chats, ["session_name", "chat_id"], "left_semi")


@register(
    "session_chats_exploded",
    o.query(["session_chats"], "SELECT session_name, chat_ref FROM session_chats"),
)
def _(spark, sf_dir):
    return resolve.explode_chats(v.sessions(spark, sf_dir)).drop("ref_pos")


@register(
    "sessions_summary",
    o.query(
        ["accounts", "session_chats"],
        "SELECT name AS session_name, telegram_id, count(*) AS n_chats FROM accounts "
        "JOIN session_chats ON session_name = name GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    return resolve.sessions_summary(v.sessions(spark, sf_dir))


@register(
    "resolve_chats",
    o.query(["resolution"], "SELECT session_name, chat_ref, chat_id, chat_title, is_private FROM resolution"),
)
def _(spark, sf_dir):
    return resolve.resolve_refs(v.session_chats(spark, sf_dir), v.entities(spark, sf_dir))


@register(
    "unresolved_chats",
    o.query(["resolution"], "SELECT session_name, chat_ref FROM resolution WHERE chat_id IS NULL"),
)
def _(spark, sf_dir):
    return resolve.unresolved_refs(v.session_chats(spark, sf_dir), v.entities(spark, sf_dir))


@register(
    "live_sessions",
    o.query(["chats"], "SELECT session_name, count(*) AS n_chats FROM chats GROUP BY session_name"),
)
def _(spark, sf_dir):
    return resolve.followed_sessions(v.session_chats(spark, sf_dir), v.entities(spark, sf_dir))


@register(
    "sessions_without_data",
    o.query(
        ["raw_messages"],
        "SELECT DISTINCT concat('acct', CAST(conv_id % 5 AS VARCHAR)) AS session_name FROM conversations "
        "EXCEPT SELECT session_name FROM raw_messages",
    ),
)
def _(spark, sf_dir):
    configured = v.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("acct"), (F.col("conv_id") % 5).cast("string")).alias("name")
    )
    return resolve.sessions_without_data(configured.distinct(), v.raw_messages(spark, sf_dir))


KEY = "session_name, chat_id, message_id"


@register(
    "enrich_sender",
    o.query(
        ["with_sender", "people"],
        f"SELECT {KEY}, sender_id, display_name AS sender_name FROM with_sender "
        "LEFT JOIN people ON entity_id = sender_id",
    ),
)
def _(spark, sf_dir):
    rows = enrich.with_sender_id(enrich.text_messages(v.raw_messages(spark, sf_dir)))
    named = enrich.with_sender_name(rows, v.entities(spark, sf_dir))
    return named.select("session_name", "chat_id", "message_id", "sender_id", "sender_name")


@register(
    "enrich_chat",
    o.query(
        ["text_rows", "chats"],
        f"SELECT {KEY}, chat_title, is_private FROM text_rows JOIN chats USING (session_name, chat_id)",
    ),
)
def _(spark, sf_dir):
    lookup = resolve.resolved_chats(v.session_chats(spark, sf_dir), v.entities(spark, sf_dir))
    rows = enrich.text_messages(v.raw_messages(spark, sf_dir))
    return rows.join(lookup, ["session_name", "chat_id"]).select(
        "session_name", "chat_id", "message_id", "chat_title", "is_private"
    )


@register(
    "enrich_self",
    o.query(
        ["text_rows", "accounts", "people"],
        f"SELECT {KEY}, telegram_id AS own_id, display_name AS own_name FROM text_rows "
        "JOIN accounts ON name = session_name LEFT JOIN people ON entity_id = telegram_id",
    ),
)
def _(spark, sf_dir):
    own = resolve.own_names(v.accounts(spark, sf_dir), v.entities(spark, sf_dir))
    rows = enrich.text_messages(v.raw_messages(spark, sf_dir))
    return rows.join(own, "session_name").select(
        "session_name", "chat_id", "message_id", "own_id", "own_name"
    )


@register("enrich_messages", M)
def _(spark, sf_dir):
    return v.enriched(spark, sf_dir)


@register("receiver_name", o.query(["m"], "SELECT id, receiver_name FROM m"))
def _(spark, sf_dir):
    return v.enriched(spark, sf_dir).select("id", "receiver_name")


@register(
    "sender_id_coalesce",
    o.query(["with_sender"], f"SELECT {KEY}, sender_id FROM with_sender"),
)
def _(spark, sf_dir):
    rows = enrich.with_sender_id(enrich.text_messages(v.raw_messages(spark, sf_dir)))
    return rows.select("session_name", "chat_id", "message_id", "sender_id")


@register(
    "build_doc_id",
    o.query(["raw_messages"], "SELECT concat(session_name, ':', chat_id, ':', message_id) AS id FROM raw_messages"),
)
def _(spark, sf_dir):
    key = names.doc_id(F.col("session_name"), F.col("chat_id"), F.col("message_id"))
    return v.raw_messages(spark, sf_dir).select(key.alias("id"))


@register("display_name", o.query(["people"], "SELECT entity_id, display_name FROM people"))
def _(spark, sf_dir):
    name = names.display_name(F.col("first_name"), F.col("title"), F.col("last_name"))
    return v.entities(spark, sf_dir).select("entity_id", name.alias("display_name"))


@register(
    "chat_title",
    o.query(
        ["entities"],
        "SELECT entity_id, coalesce(nullif(title, ''), nullif(first_name, '')) AS chat_title FROM entities",
    ),
)
def _(spark, sf_dir):
    title = names.chat_title(F.col("title"), F.col("first_name"))
    return v.entities(spark, sf_dir).select("entity_id", title.alias("chat_title"))


@register(
    "date_to_seconds",
    "SELECT event_id, coalesce(CAST(floor(epoch(ts)) AS BIGINT), 0) AS date FROM events",
)
def _(spark, sf_dir):
    events = v.table(spark, sf_dir, "events")
    return events.select("event_id", names.unix_date(F.col("ts")).alias("date"))


# --- incremental indexing -------------------------------------------------------------------

# What an earlier, interrupted run has left: the owners' messages only, so a set with holes.
HOLES = "sender_name LIKE 'Me %'"
# What an earlier, complete run has left: the beginning of each chat.
BEGINNING = "message_id <= 3"


@register("incremental_anti", o.query(["m"], f"SELECT id FROM m WHERE NOT coalesce({HOLES}, false)"))
def _(spark, sf_dir):
    documents = v.messages(spark, sf_dir)
    return ingest.new_by_id(documents, documents.filter(HOLES)).select("id")


@register(
    "incremental_watermark",
    o.query(
        ["m"],
        "SELECT id FROM m LEFT JOIN (SELECT session_name, chat_id, max(message_id) AS top FROM m "
        f"WHERE {HOLES} GROUP BY ALL) USING (session_name, chat_id) WHERE top IS NULL OR message_id > top",
    ),
)
def _(spark, sf_dir):
    documents = v.messages(spark, sf_dir)
    return ingest.beyond_marks(documents, documents.filter(HOLES)).select("id")


@register(
    "new_documents",
    o.query(
        ["m"],
        f"SELECT session_name, count(*) AS n_new FROM m WHERE NOT ({BEGINNING}) GROUP BY session_name",
    ),
)
def _(spark, sf_dir):
    documents = v.messages(spark, sf_dir)
    fresh = ingest.new_by_id(documents, documents.filter(BEGINNING))
    return fresh.groupBy("session_name").agg(F.count("*").alias("n_new"))


@register("dedupe_by_id", M)
def _(spark, sf_dir):
    documents = v.messages(spark, sf_dir)
    later = documents.withColumn("date", F.col("date") + 5)
    return ingest.dedupe_by_id(later.unionByName(documents).unionByName(documents))


@register("high_water_mark", o.query(["m"], "SELECT session_name, chat_id, max(message_id) AS max_message_id FROM m GROUP BY ALL"))
def _(spark, sf_dir):
    return ingest.high_water_mark(v.messages(spark, sf_dir))


@register(
    "ingest_counts",
    o.query(
        ["m"],
        "SELECT session_name, chat_id, count(*) AS n_documents FROM m GROUP BY ALL "
        "UNION ALL SELECT session_name, NULL, count(*) FROM m GROUP BY session_name",
    ),
)
def _(spark, sf_dir):
    return ingest.ingest_counts(v.messages(spark, sf_dir))


@register(
    "chat_coverage",
    o.query(
        ["raw_messages"],
        "SELECT session_name, chat_id, count(*) AS n_rows, CASE WHEN max(message_id) > 0 THEN "
        "(max(message_id) - min(message_id)) / max(message_id) * 100 END AS percent FROM raw_messages GROUP BY ALL",
    ),
)
def _(spark, sf_dir):
    return ingest.chat_coverage(v.raw_messages(spark, sf_dir))


@register("document_count", o.query(["m"], "SELECT count(*) AS n_documents FROM m"))
def _(spark, sf_dir):
    return ingest.document_count(v.messages(spark, sf_dir))


@register(
    "document_exists",
    o.query(
        ["raw_messages", "m"],
        'SELECT id, id IN (SELECT id FROM m) AS "exists" FROM asked',
        asked="SELECT concat(session_name, ':', chat_id, ':', message_id) AS id FROM raw_messages",
    ),
)
def _(spark, sf_dir):
    key = names.doc_id(F.col("session_name"), F.col("chat_id"), F.col("message_id"))
    asked = v.raw_messages(spark, sf_dir).select(key.alias("id"))
    return ingest.documents_exist(asked, v.messages(spark, sf_dir))


# --- the stored index -----------------------------------------------------------------------


# Rows of a given table for a bucket: a task holds about one bucket of an index.
ROWS_PER_BUCKET = 10_000


def _buckets(spark: SparkSession, sf_dir: str, table: str, least: int = DEFAULT_BUCKETS) -> int:
    """Buckets in proportion to a table, so that what a task holds does not grow with it."""
    return max(least, -(-v.table(spark, sf_dir, table).count() // ROWS_PER_BUCKET))


def _new_index(spark: SparkSession, sf_dir: str, table: str = "conversations") -> MessageIndex:
    buckets = _buckets(spark, sf_dir, table)
    return MessageIndex(spark, scratch_dir(spark, "index"), f"msgs_{uuid.uuid4().hex}", buckets).open()


def indexed(spark: SparkSession, sf_dir: str) -> MessageIndex:
    """The archive, indexed in two runs of which the second sees everything again."""

    def build() -> MessageIndex:
        index, documents = _new_index(spark, sf_dir), v.messages(spark, sf_dir)
        index.append(documents.filter(BEGINNING), "first")
        index.append(documents, "second")
        return index

    return _once(spark, sf_dir, "index", build)


def indexed_documents(spark: SparkSession, sf_dir: str) -> MessageIndex:
    """The larger corpus, indexed in one run."""

    def build() -> MessageIndex:
        index = _new_index(spark, sf_dir, "documents")
        index.append(v.documents(spark, sf_dir), "all")
        return index

    return _once(spark, sf_dir, "document index", build)


@register("index_append", M)
def _(spark, sf_dir):
    index, documents = _new_index(spark, sf_dir), v.messages(spark, sf_dir)
    index.append(documents.filter(HOLES), "first")
    index.append(documents, "second")
    index.append(documents, "second")
    return index.documents().select(*DOCUMENT_COLUMNS)


def _reopened(spark: SparkSession, index: MessageIndex) -> MessageIndex:
    """The same files under other table names, opened without knowing how they were written."""
    return MessageIndex(spark, index.path, f"again_{uuid.uuid4().hex}").open()


@register(
    "index_reopened",
    o.query(["m"], f"SELECT {o.HIT_COLUMNS} FROM hits", searches=o.fixed_searches([("a", "the", "acct0"), ("b", "que la"), ("c", "group me", "acct1", 5031)]), **o.search_ctes("m", 20)),
)
def _(spark, sf_dir):
    """Written with three buckets or as many as the rows ask for, searched with whatever the files say."""
    path, name = scratch_dir(spark, "index"), f"three_{uuid.uuid4().hex}"
    index = MessageIndex(spark, path, name, _buckets(spark, sf_dir, "conversations", 3)).open()
    index.append(v.messages(spark, sf_dir), "all")
    searches = searches_frame(spark, [("a", "the", "acct0"), ("b", "que la"), ("c", "group me", "acct1", 5031)])
    return plans.ranked_searches(IndexCorpus(_reopened(spark, index)), searches, 20, bounded=True)


def _posting_rows(index: MessageIndex) -> DataFrame:
    return _with_id(index.postings()).selectExpr(*POSTING.split(", "))


@register("append_after_failure", o.query(["m"], "SELECT field, term, id, session_name, chat_id, sender_id, dl, tf FROM post", **o.postings_ctes("m")))
def _(spark, sf_dir):
    """Deriving postings fails once; the same rows come again, without a batch id."""
    index, documents = _new_index(spark, sf_dir), v.messages(spark, sf_dir)
    derive, index._derive = index._derive, None
    try:
        index.append(documents)
    except TypeError:
        pass
    index._derive = derive
    index.append(documents)
    return _posting_rows(index)


@register("index_compacted", o.query(["m"], "SELECT field, term, id, session_name, chat_id, sender_id, dl, tf FROM post", **o.postings_ctes("m")))
def _(spark, sf_dir):
    """Two batches, merged, their files removed, and a third one."""
    index, documents = _new_index(spark, sf_dir), v.messages(spark, sf_dir)
    index.append(documents.filter(HOLES), "first")
    index.append(documents.filter(BEGINNING), "second")
    index.compact()
    index.vacuum()
    index.append(documents, "third")
    index.append(documents.filter(HOLES), "first")
    return _posting_rows(index)


@register("index_retry", M)
def _(spark, sf_dir):
    """A committed batch comes again with other rows and a failing derivation; it stays as it was."""
    index, documents = _new_index(spark, sf_dir), v.messages(spark, sf_dir)
    index.append(documents, "only")
    derive, index._derive = index._derive, None
    again = index.append(documents.filter(HOLES).withColumn("message_id", F.col("message_id") + 1_000_000), "only")
    index._derive = derive
    rows = index.documents().select(*DOCUMENT_COLUMNS)
    return rows if again == 0 else rows.limit(0)


@register(
    "index_snapshot",
    o.query(
        ["m"],
        "SELECT search_id, id, score FROM hits",
        early=f"SELECT * FROM m WHERE {BEGINNING}",
        searches=o.fixed_searches([("a", "the"), ("b", "que la"), ("c", "group me", "acct1", 5031)]),
        **o.search_ctes("early", 20),
    ),
)
def _(spark, sf_dir):
    """Between looking up and fetching, the rest is appended and everything merged."""
    index, documents = _new_index(spark, sf_dir), v.messages(spark, sf_dir)
    index.append(documents.filter(BEGINNING).filter(HOLES), "holes")
    index.append(documents.filter(BEGINNING), "beginning")
    searches = searches_frame(spark, [("a", "the"), ("b", "que la"), ("c", "group me", "acct1", 5031)])
    pinned = IndexCorpus(index).pinned()
    wanted = matching.clauses(searches)
    found, weights = pinned.lookup(wanted, True)
    index.append(documents, "rest")
    index.compact()
    scored = matching.score(found, wanted, weights, bounded=True)
    scored = scored.select("search_id", names.doc_id(*map(F.col, postings.KEY)).alias("id"), "micro")
    hits = pinned.fetch(top_k(scored, ["search_id"], [F.desc("micro"), F.asc("id")], 20, "id"), True)
    return hits.select("search_id", "id", (F.col("micro") / matching.MICRO).alias("score"))


@register("index_two_writers", M)
def _(spark, sf_dir):
    """Two threads append the same messages at once, in different batches, while a third merges."""
    index, documents = _new_index(spark, sf_dir), v.messages(spark, sf_dir)
    parts = [documents.filter(F.col("message_id") % 3 != n) for n in (0, 1)]
    with ThreadPoolExecutor(3) as pool:
        done = [pool.submit(index.append, part, f"writer-{n}") for n, part in enumerate(parts)]
        done.append(pool.submit(index.compact))
        for one in done:
            one.result()
    index.append(documents.filter(F.col("message_id") % 3 == 0), "writer-2")
    return index.documents().select(*DOCUMENT_COLUMNS)


@register("index_reset_then_append", M)
def _(spark, sf_dir):
    index, documents = _new_index(spark, sf_dir), v.messages(spark, sf_dir)
    index.append(documents.filter(BEGINNING), "first")
    index.reset(confirm=True)
    index.append(documents, "first")
    return index.documents().select(*DOCUMENT_COLUMNS)


@register("project_documents", M)
def _(spark, sf_dir):
    return indexed(spark, sf_dir).documents().select(*DOCUMENT_COLUMNS)


def _with_id(rows: DataFrame) -> DataFrame:
    key = names.doc_id(*map(F.col, postings.KEY))
    return rows.withColumn("id", key).drop("message_id")


POSTING = "field, term, id, session_name, chat_id, sender_id, dl, tf"


@register(
    "postings_build", o.query(["m"], f"SELECT {POSTING} FROM post", **o.postings_ctes("m"))
)
def _(spark, sf_dir):
    return _with_id(postings.postings(v.messages(spark, sf_dir)))


@register(
    "index_postings", o.query(["m"], f"SELECT {POSTING} FROM post", **o.postings_ctes("m"))
)
def _(spark, sf_dir):
    return _with_id(indexed(spark, sf_dir).postings().drop("slab"))


@register(
    "term_stats",
    o.query(["dm"], "SELECT field, term, count(*) AS df FROM post GROUP BY ALL", **o.postings_ctes("dm")),
)
def _(spark, sf_dir):
    return postings.term_stats(postings.postings(v.documents(spark, sf_dir)))


@register("field_stats", o.query(["dm"], "SELECT * FROM fstat", **o.postings_ctes("dm")))
def _(spark, sf_dir):
    return postings.field_stats(v.documents(spark, sf_dir))


@register(
    "index_term_stats",
    o.query(["m"], "SELECT field, term, count(*) AS df FROM post GROUP BY ALL", **o.postings_ctes("m")),
)
def _(spark, sf_dir):
    stats = indexed(spark, sf_dir).term_stats()
    return stats.groupBy("field", "term").agg(F.sum("df").alias("df"))


@register("index_field_stats", o.query(["m"], "SELECT * FROM fstat", **o.postings_ctes("m")))
def _(spark, sf_dir):
    return indexed(spark, sf_dir).field_stats()


# --- text analysis --------------------------------------------------------------------------


def _tokenized(documents: DataFrame) -> DataFrame:
    tokens = text.index_tokens(F.col("text"))
    return documents.select("id", F.array_join(tokens, " ").alias("tokens"))


def _tokenized_sql(src: str) -> str:
    return o.query(
        [src], f"SELECT id, array_to_string({o.index_tokens('text')}, ' ') AS tokens FROM {src}"
    )


@register("tokenize_documents", _tokenized_sql("dm"))
def _(spark, sf_dir):
    return _tokenized(v.documents(spark, sf_dir))


@register("tokenize_mixed_script", _tokenized_sql("mixed"))
def _(spark, sf_dir):
    return _tokenized(v.mixed_documents(spark, sf_dir))


# The words of a dictionary; those that are not of two or more ideographs are left out.
WORDS = ["今天", "天气", "今日", "天日", "气真", "真好", "好日", "真好日", "气真好日", "天气真"]


def _lexicon(spark: SparkSession) -> Lexicon:
    return Lexicon.of(spark.createDataFrame([(w,) for w in [*WORDS, "好", "ok", None]], "word string"))


@register(
    "tokenize_lexicon",
    o.query(["mixed"], f"SELECT id, array_to_string(list_sort({o.lexicon_tokens(WORDS)[0]('text')}), ' ') AS tokens FROM mixed"),
)
def _(spark, sf_dir):
    found = _lexicon(spark).with_index_terms(v.mixed_documents(spark, sf_dir), "text")
    return found.select("id", F.array_join(F.array_sort("text_terms"), " ").alias("tokens"))


@register(
    "tokenize_queries",
    o.query(
        ["turn_requests"],
        "SELECT search_id, CAST(part_no AS BIGINT) AS part_no, part, array_to_string(list_sort(toks), ' ') AS tokens FROM ("
        f"SELECT *, {o.query_tokens('part')} AS toks FROM (SELECT search_id, unnest(ps) AS part, "
        "generate_subscripts(ps, 1) AS part_no FROM (SELECT request_id AS search_id, "
        f"{o.split_parts('raw_text')} AS ps FROM turn_requests))) WHERE len(toks) > 0",
    ),
)
def _(spark, sf_dir):
    searches = v.turn_requests(spark, sf_dir).select(
        F.col("request_id").alias("search_id"), F.col("raw_text").alias("query")
    )
    return matching.query_parts(searches).select(
        "search_id",
        (F.col("part_no") + 1).cast("bigint").alias("part_no"),
        "part",
        F.array_join(F.array_sort("tokens"), " ").alias("tokens"),
    )


# --- searching ------------------------------------------------------------------------------

SCOPED = "search_id string, query string, scope_session_name string, scope_chat_id bigint, scope_sender_id bigint"


def searches_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    full = [tuple((*row, None, None, None)[:5]) for row in rows]
    return spark.createDataFrame(full, SCOPED)


def _register_search(
    name: str,
    rows: list[tuple],
    source: str = "m",
    limit: int = 20,
    match: str = "any",
) -> None:
    sources = {
        "m": v.messages,
        "dm": v.documents,
        "mixed": v.mixed_documents,
    }

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        corpus = ScanCorpus(sources[source](spark, sf_dir))
        searches = searches_frame(spark, rows)
        bounded = rq.is_bounded(searches, per_request=limit)
        return plans.ranked_searches(corpus, searches, limit, match, bounded)

    register(name, o.search_sql(source, rows, limit, match))(run)


_register_search("search_bm25", [("a", "the"), ("b", "und"), ("c", "les"), ("d", "las")], "dm", 50)
_register_search("search_topk", [("a", "the"), ("b", "the of and"), ("c", "src1 de la")], "dm", 5)
_register_search("search_filtered_session", [("a", "the", "acct0"), ("b", "the", "acct1"), ("c", "die que", "acct2")])
_register_search("search_filtered_chat", [("a", "the que die les", None, 5001), ("b", "group me", "acct1", 5031)])
_register_search("search_filtered_sender", [("a", "the la", None, None, 1000), ("b", "die", "acct2", None, 1002), ("c", "the", None, 5001, 4)])
_register_search("search_and_within_part", [("a", "que-la"), ("b", "the,of.and"), ("c", "que-zzz")])
_register_search("search_or_across_parts", [("a", "que la"), ("b", "the of and"), ("c", "que zzz"), ("d", "the the")])
_register_search("search_multi_field", [("a", "group the"), ("b", "Group-the"), ("c", "peer member me")])
_register_search("search_chat_title", [("a", "group"), ("b", "GROUP-5001 1"), ("c", "peer")], limit=100)
_register_search("search_match_all", [("a", "que la"), ("b", "group the of"), ("c", "the zzz")], match="all")
_register_search("search_filtered_few", [("a", "the", "acct0"), ("b", "group", "acct1", 5031), ("c", "the"), ("d", "que", None, None, 1000)], limit=3)
_register_search("search_cjk", [("a", "天气"), ("b", "今天 th天n"), ("c", "真"), ("d", "天气真"), ("e", "nd-气ng")], "mixed")


_DICTIONARY = [("a", "天气"), ("b", "气真好日"), ("c", "真好"), ("d", "今日天日 好日"), ("e", "天今th"), ("f", "th")]


@register(
    "search_lexicon",
    o.query(
        ["mixed"],
        f"SELECT {o.HIT_COLUMNS} FROM hits",
        searches=o.fixed_searches(_DICTIONARY),
        **o.search_ctes("mixed", 20, analysis=o.lexicon_tokens(WORDS)),
    ),
)
def _(spark, sf_dir):
    corpus = ScanCorpus(v.mixed_documents(spark, sf_dir), _lexicon(spark))
    return plans.ranked_searches(corpus, searches_frame(spark, _DICTIONARY), 20, bounded=True)


# Sender names here are two words, which no single part equals; a view with one-word names.
def _one_word(documents: DataFrame) -> DataFrame:
    return documents.withColumn("sender_name", F.regexp_replace("sender_name", " ", "_"))


_SENDERS = [("a", "Me_0"), ("b", "me_0"), ("c", "Member_1 Member_31"), ("d", "Peer")]


@register(
    "search_sender_exact",
    o.query(
        ["m"],
        f"SELECT {o.HIT_COLUMNS} FROM hits",
        mw="SELECT * REPLACE (replace(sender_name, ' ', '_') AS sender_name) FROM m",
        searches=o.fixed_searches(_SENDERS),
        **o.search_ctes("mw", 20),
    ),
)
def _(spark, sf_dir):
    corpus = ScanCorpus(_one_word(v.messages(spark, sf_dir)))
    searches = searches_frame(spark, _SENDERS)
    return plans.ranked_searches(corpus, searches, 20, bounded=rq.is_bounded(searches, 20))


@register(
    "search_date_order",
    o.query(
        ["dm"],
        f"SELECT {o.M_COLUMNS}, score, row_number() OVER (ORDER BY date DESC, score DESC, id) AS rank FROM hits",
        searches=o.fixed_searches([("a", "the und", "en")]),
        **o.search_ctes("dm", 20),
    ),
)
def _(spark, sf_dir):
    corpus = ScanCorpus(v.documents(spark, sf_dir))
    return plans.search(corpus, "the und", filters={"session_name": "en", "ignored": 1})


# --- requests -------------------------------------------------------------------------------


@register("route_requests", o.query(["turn_requests"], "SELECT request_id, route, query0 AS query FROM routed", routed=o.routed("turn_requests")))
def _(spark, sf_dir):
    return rq.routed(v.turn_requests(spark, sf_dir)).select("request_id", "route", "query")


@register(
    "parse_flags",
    o.query(
        ["turn_requests"],
        "SELECT request_id, query, full_text, before, after FROM flagged",
        **o.parsed_ctes("turn_requests"),
    ),
)
def _(spark, sf_dir):
    searches = rq.routed(v.turn_requests(spark, sf_dir)).filter("route = 'search'")
    return rq.with_flags(searches).select("request_id", "query", "full_text", "before", "after")


@register(
    "request_scope",
    o.query(
        ["turn_requests", "accounts"],
        "SELECT request_id, user_id, (SELECT arg_min(name, pos) FROM accounts a "
        "WHERE a.telegram_id = t.user_id) AS scope_session_name FROM turn_requests t",
    ),
)
def _(spark, sf_dir):
    scoped = rq.with_scope(v.turn_requests(spark, sf_dir), v.accounts(spark, sf_dir))
    return scoped.select("request_id", "user_id", "scope_session_name")


@register(
    "context_budget",
    "SELECT conv_id, turn, CASE WHEN b + a <= 20 THEN b WHEN b <= 10 THEN b WHEN a <= 10 THEN 20 - a ELSE 10 END AS before, "
    "CASE WHEN b + a <= 20 THEN a WHEN a <= 10 THEN a WHEN b <= 10 THEN 20 - b ELSE 10 END AS after FROM ("
    "SELECT conv_id, turn, greatest(turn * 4 - 2, 0) AS b, greatest(conv_id % 35 - 3, 0) AS a FROM conversations)",
)
def _(spark, sf_dir):
    before, after = flags.context_budget(F.col("turn") * 4 - 2, F.col("conv_id") % 35 - 3)
    rows = v.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", before.alias("before"), after.alias("after"))


@register(
    "context_defaults",
    "SELECT conv_id, turn, CASE WHEN p IS NOT NULL THEN greatest(p, 0) WHEN s IS NULL THEN 0 ELSE greatest(s, 0) END AS before, "
    "CASE WHEN a IS NOT NULL THEN greatest(a, 0) WHEN s IS NULL THEN 0 ELSE greatest(s, 0) END AS after FROM ("
    "SELECT conv_id, turn, nullif(conv_id % 9 - 2, 1) AS p, nullif(turn - 1, 2) AS a, nullif(conv_id % 5 - 1, 3) AS s FROM conversations)",
)
def _(spark, sf_dir):
    conv, turn = F.col("conv_id"), F.col("turn")
    before, after = flags.context_defaults(
        F.nullif(conv % 9 - 2, F.lit(1).cast("bigint")),
        F.nullif(turn - 1, F.lit(2).cast("bigint")),
        F.nullif(conv % 5 - 1, F.lit(3).cast("bigint")),
    )
    rows = v.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", before.alias("before"), after.alias("after"))


def _prepared(spark: SparkSession, sf_dir: str, unknown_user: str) -> DataFrame:
    return rq.prepare(v.requests(spark), v.accounts(spark, sf_dir), unknown_user=unknown_user)


def _results(spark: SparkSession, sf_dir: str, unknown_user: str, corpus=None) -> DataFrame:
    corpus = corpus or ScanCorpus(v.messages(spark, sf_dir))
    return plans.batch_search(corpus, _prepared(spark, sf_dir, unknown_user))


RESULT = f"request_id, {o.M_COLUMNS}, score, rank, n_results"
RESULT_COLUMNS = ["request_id", *DOCUMENT_COLUMNS, "score", "rank", "n_results"]
BATCH = ["m", "requests", "accounts"]


def _results_sql(unknown_user: str) -> str:
    return o.query(BATCH, f"SELECT {RESULT} FROM results", **o.batch_ctes("m", unknown_user))


@register("search_batch", _results_sql("none"))
def _(spark, sf_dir):
    return _results(spark, sf_dir, "none").select(*RESULT_COLUMNS)


@register("search_batch_open", _results_sql("all"))
def _(spark, sf_dir):
    return _results(spark, sf_dir, "all").select(*RESULT_COLUMNS)


@register(
    "search_many_requests",
    o.query(
        ["m", "turn_requests", "accounts"],
        f"SELECT {RESULT} FROM results",
        **{**o.batch_ctes("m", "all"), **o.prepared_ctes("turn_requests", "all")},
    ),
)
def _(spark, sf_dir):
    """Every turn of every conversation as a request: a table of any size, on the grid."""
    prepared = rq.prepare(v.turn_requests(spark, sf_dir), v.accounts(spark, sf_dir), unknown_user="all")
    return plans.batch_search(IndexCorpus(indexed(spark, sf_dir)), prepared).select(*RESULT_COLUMNS)


_FREQUENT = [("a", "the"), ("b", "und-der of"), ("c", "src1 de la", "fr"), ("d", "the", None, 7), ("e", "zzz")]


def _register_skipping(name: str, match: str, limit: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Slabs that cannot hold one of the best are not read, however few postings there are."""
        corpus = IndexCorpus(indexed_documents(spark, sf_dir))
        wanted = matching.clauses(searches_frame(spark, _FREQUENT))
        order, asked = [F.desc("micro"), F.asc("id")], corpus.asked(wanted)
        best = skipping.skipping_search(corpus, wanted, asked, limit, order, match, least_postings=0)
        hits = corpus.fetch(best, True)
        return hits.select("search_id", *DOCUMENT_COLUMNS, (F.col("micro") / matching.MICRO).alias("score"))

    register(name, o.search_sql("dm", _FREQUENT, limit, match))(run)


_register_skipping("search_skipping", "any", 5)
_register_skipping("search_skipping_all", "all", 30)


@register("search_grid", o.search_sql("dm", _FREQUENT, 20))
def _(spark, sf_dir):
    """The way of a large table of searches, with hot terms, from the stored index."""
    corpus = IndexCorpus(indexed_documents(spark, sf_dir))
    return plans.ranked_searches(corpus, searches_frame(spark, _FREQUENT), 20)


@register("search_grid_all", o.search_sql("m", _FREQUENT, 20, "all"))
def _(spark, sf_dir):
    corpus = ScanCorpus(v.messages(spark, sf_dir))
    return plans.ranked_searches(corpus, searches_frame(spark, _FREQUENT), 20, "all")


@register("search_indexed", _results_sql("all"))
def _(spark, sf_dir):
    corpus = IndexCorpus(indexed(spark, sf_dir))
    return _results(spark, sf_dir, "all", corpus).select(*RESULT_COLUMNS)


@register(
    "result_rank",
    o.query(BATCH, "SELECT request_id, id, rank, n_results FROM results", **o.batch_ctes("m", "all")),
)
def _(spark, sf_dir):
    return _results(spark, sf_dir, "all").select("request_id", "id", "rank", "n_results")


@register(
    "result_counts",
    o.query(
        BATCH,
        "SELECT request_id, (SELECT count(*) FROM results r WHERE r.request_id = p.request_id) AS n_results FROM prepared p",
        **o.batch_ctes("m", "none"),
    ),
)
def _(spark, sf_dir):
    prepared = _prepared(spark, sf_dir, "none")
    hits = plans.batch_search(ScanCorpus(v.messages(spark, sf_dir)), prepared)
    return plans.result_counts(prepared, hits)


# --- context --------------------------------------------------------------------------------


@register(
    "message_sequence",
    o.query(
        ["m"],
        f"SELECT {KEY}, row_number() OVER (PARTITION BY session_name, chat_id ORDER BY message_id) AS seq FROM m",
    ),
)
def _(spark, sf_dir):
    keys = v.messages(spark, sf_dir).select("session_name", "chat_id", "message_id")
    return message_sequence(keys)


@register(
    "chat_gaps",
    o.query(
        ["m"],
        "SELECT session_name, chat_id, after_id, before_id, before_id - after_id - 1 AS n_missing FROM ("
        "SELECT session_name, chat_id, message_id AS before_id, "
        "lag(message_id) OVER (PARTITION BY session_name, chat_id ORDER BY message_id) AS after_id FROM m"
        ") WHERE before_id - after_id > 1",
    ),
)
def _(spark, sf_dir):
    return chat_gaps(IndexCorpus(indexed(spark, sf_dir)).message_keys()).select(*GAP)


def _own_hits(spark: SparkSession, sf_dir: str, before, after) -> DataFrame:
    """Every message of an account's owner as a hit."""
    return (
        v.messages(spark, sf_dir)
        .filter(HOLES)
        .select(
            "session_name",
            "chat_id",
            "message_id",
            F.col("id").alias("hit_id"),
            before.cast("bigint").alias("before"),
            after.cast("bigint").alias("after"),
        )
    )


def _own_context_sql(before: str, after: str) -> str:
    return o.query(
        ["m"],
        "SELECT hit_id, hit_message_id, id, message_id, text FROM near",
        wanted=(
            f"SELECT session_name, chat_id, message_id AS hit_message_id, id AS hit_id, {before} AS before, "
            f"{after} AS after FROM m WHERE {HOLES}"
        ),
        near=o.around("m"),
    )


def _own_context(spark: SparkSession, sf_dir: str, before, after) -> DataFrame:
    corpus = ScanCorpus(v.messages(spark, sf_dir))
    rows = context(corpus, _own_hits(spark, sf_dir, before, after))
    return rows.select("hit_id", "hit_message_id", "id", "message_id", "text")


@register("context_range", _own_context_sql("2", "message_id % 4"))
def _(spark, sf_dir):
    return _own_context(spark, sf_dir, F.lit(2), F.col("message_id") % 4)


@register("context_zero", _own_context_sql("0", "0"))
def _(spark, sf_dir):
    return _own_context(spark, sf_dir, F.lit(0), F.lit(0))


def _contextual(spark: SparkSession, sf_dir: str, unknown_user: str) -> tuple[DataFrame, DataFrame]:
    """Prepared requests, and their hits with context."""
    prepared = stored(_prepared(spark, sf_dir, unknown_user), "requests")
    corpus = ScanCorpus(v.messages(spark, sf_dir))
    bounded = rq.is_bounded(prepared, per_request=plans.REQUEST_LIMIT * (flags.TOTAL_MAX + 1))
    hits = stored(plans.batch_search(corpus, prepared, bounded=bounded).select(*answers.HIT), "hits")
    return prepared, answers.contextual_hits(corpus, prepared, hits, bounded)


RESPONSE = ["m", "requests", "accounts"]


@register(
    "context_batch",
    o.query(
        RESPONSE,
        "SELECT request_id, rank, hit_message_id, id, message_id, text FROM near",
        **o.response_ctes("m", "all"),
    ),
)
def _(spark, sf_dir):
    _, rows = _contextual(spark, sf_dir, "all")
    return rows.select("request_id", "rank", "hit_message_id", "id", "message_id", "text")


# --- display --------------------------------------------------------------------------------


@register("preview_text", o.query(["dm"], f"SELECT id, {o.preview('(message_id % 2 = 0)')} AS preview FROM dm"))
def _(spark, sf_dir):
    body = render.preview(F.col("text"), F.col("message_id") % 2 == 0)
    return v.documents(spark, sf_dir).select("id", body.alias("preview"))


@register("who_label", o.query(["m"], f"SELECT id, {o.WHO} AS who FROM m"))
def _(spark, sf_dir):
    who = render.who_label(F.col("sender_name"), F.col("receiver_name"), F.col("chat_title"))
    return v.messages(spark, sf_dir).select("id", who.alias("who"))


@register(
    "context_role",
    o.query(
        ["m"],
        "SELECT id, CASE WHEN message_id = hit THEN 'match' WHEN message_id < hit THEN 'before' ELSE 'after' END AS role "
        "FROM (SELECT id, message_id, chat_id % 5 + 1 AS hit FROM m)",
    ),
)
def _(spark, sf_dir):
    role = render.context_role(F.col("message_id"), F.col("chat_id") % 5 + 1)
    return v.messages(spark, sf_dir).select("id", role.alias("role"))


@register("format_date", o.query(["dm"], f"SELECT id, {o.DATE_TEXT} AS shown FROM dm"))
def _(spark, sf_dir):
    shown = render.format_date(F.col("date"))
    return v.documents(spark, sf_dir).select("id", shown.alias("shown"))


@register(
    "render_response",
    o.query(RESPONSE, "SELECT request_id, n_results, body FROM bodies", **o.response_ctes("m", "all")),
)
def _(spark, sf_dir):
    prepared, rows = _contextual(spark, sf_dir, "all")
    return responses(prepared, lines(rows))


@register(
    "render_chunks",
    o.query(
        RESPONSE,
        "SELECT request_id, CAST(generate_subscripts(chunks, 1) AS BIGINT) AS chunk_no, unnest(chunks) AS chunk FROM chunked",
        **o.response_ctes("m", "none"),
        **o.chunk_ctes(render.CHUNK_MAX),
    ),
)
def _(spark, sf_dir):
    corpus = ScanCorpus(v.messages(spark, sf_dir))
    return answers.answer(corpus, v.requests(spark), v.accounts(spark, sf_dir), unknown_user="none")


CHUNKS = (
    "SELECT request_id, CAST(generate_subscripts(chunks, 1) AS BIGINT) AS chunk_no, "
    "unnest(chunks) AS chunk FROM chunked"
)


@register(
    "split_texts",
    o.query(
        [],
        CHUNKS,
        bodies="SELECT doc_id AS request_id, text AS body FROM documents",
        **o.chunk_ctes(render.CHUNK_MAX),
    ),
)
def _(spark, sf_dir):
    rows = v.table(spark, sf_dir, "documents")
    pieces = F.posexplode(render.chunks(F.col("text"))).alias("chunk_no", "chunk")
    return rows.select(F.col("doc_id").alias("request_id"), pieces).withColumn(
        "chunk_no", (F.col("chunk_no") + 1).cast("bigint")
    )


@register(
    "sql_chunks",
    o.query(
        [],
        CHUNKS,
        bodies="SELECT doc_id AS request_id, text AS body FROM documents",
        **o.chunk_ctes(render.CHUNK_MAX),
    ),
)
def _(spark, sf_dir):
    """The same in plain SQL, by the table function."""
    sql.register(spark)
    rows = "SELECT doc_id AS request_id, c.chunk_no, c.chunk FROM {texts}, LATERAL chunk_lines(text, 4096) AS c"
    return spark.sql(rows, texts=v.table(spark, sf_dir, "documents"))


@register(
    "sql_frequencies",
    o.query(["m"], "SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM post WHERE field = 'text' GROUP BY term", **o.postings_ctes("m")),
)
def _(spark, sf_dir):
    """Document frequencies in plain SQL, by the token function."""
    sql.register(spark)
    return spark.sql(
        "SELECT term, count(DISTINCT id) AS df, count(*) AS n FROM {texts}, LATERAL text_terms(text) AS t GROUP BY term",
        texts=v.messages(spark, sf_dir),
    )


# --- streaming ------------------------------------------------------------------------------


def _feed(spark: SparkSession, sf_dir: str, deliveries: int = 2) -> str:
    """Raw messages as a folder of files in which every message is delivered repeatedly."""
    path = scratch_dir(spark, "feed")
    for _ in range(deliveries):
        v.raw_messages(spark, sf_dir).repartition(3).write.mode("append").parquet(path)
    return path


def _dims(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The small tables as files, so that each micro-batch reads them instead of deriving them."""

    def build() -> list[DataFrame]:
        frames = (v.entities, v.accounts, v.session_chats)
        return [stored(f(spark, sf_dir), f.__name__) for f in frames]

    return _once(spark, sf_dir, "dims", build)


@register("live_ingest", M)
def _(spark, sf_dir):
    """Two micro-batches or more; every message comes twice."""
    index = _new_index(spark, sf_dir)
    raw = readers.stream_messages(spark, _feed(spark, sf_dir), max_files=3)
    live.start_ingest(
        raw, index, *_dims(spark, sf_dir), checkpoint=scratch_dir(spark, "ckpt")
    ).awaitTermination()
    return index.documents().select(*DOCUMENT_COLUMNS)


@register("live_two_feeds", M)
def _(spark, sf_dir):
    """One feed per account, each on its own checkpoint, into one index with default arguments."""
    index, raw = _new_index(spark, sf_dir), v.raw_messages(spark, sf_dir)
    for account in ("acct0", "acct1", "acct2"):
        path = scratch_dir(spark, "feed")
        raw.filter(F.col("session_name") == account).coalesce(1).write.parquet(path)
        stream = readers.stream_messages(spark, path)
        live.start_ingest(
            stream, index, *_dims(spark, sf_dir), checkpoint=scratch_dir(spark, "ckpt")
        ).awaitTermination()
    return index.documents().select(*DOCUMENT_COLUMNS)


@register("backfill_then_live", M)
def _(spark, sf_dir):
    """History first, then newer files, on one checkpoint."""
    index, checkpoint, path = _new_index(spark, sf_dir), scratch_dir(spark, "ckpt"), scratch_dir(spark, "feed")
    raw = v.raw_messages(spark, sf_dir)
    for part in (raw.filter(BEGINNING), raw.filter(f"NOT ({BEGINNING})")):
        part.coalesce(1).write.mode("append").parquet(path)
        stream = readers.stream_messages(spark, path)
        live.start_ingest(stream, index, *_dims(spark, sf_dir), checkpoint=checkpoint).awaitTermination()
    return index.documents().select(*DOCUMENT_COLUMNS)


@register("live_paged", M)
def _(spark, sf_dir):
    """Pages that come while no query runs: the next one goes on at the offset of the last, page by page."""
    index, checkpoint, path = _new_index(spark, sf_dir), scratch_dir(spark, "ckpt"), scratch_dir(spark, "pages")
    for some in ("page = 0", "page > 0"):
        stream = readers.stream_pages(spark, _paged(spark, sf_dir, path, some))
        live.start_ingest(stream, index, *_dims(spark, sf_dir), checkpoint=checkpoint).awaitTermination()
    return index.documents().select(*DOCUMENT_COLUMNS)


@register(
    "stream_rejects",
    o.query(
        ["raw_messages"],
        "SELECT 'missing chat_id' AS reason, count(*) AS n FROM raw_messages WHERE kind = 'service' HAVING count(*) > 0 "
        "UNION ALL SELECT 'unparsable', count(*) FROM raw_messages",
    ),
)
def _(spark, sf_dir):
    """A feed of JSON lines of which each comes once whole and once cut in two.

    Service rows have lost their chat.
    """
    raw = v.raw_messages(spark, sf_dir).withColumn(
        "chat_id", F.when(F.col("kind") != "service", F.col("chat_id"))
    )
    whole = raw.select(F.to_json(F.struct("*")).alias("value"))
    broken = whole.select(F.expr("left(value, length(value) div 2)").alias("value"))
    path, rejects = scratch_dir(spark, "feed"), scratch_dir(spark, "rejects")
    whole.unionByName(broken).write.text(path)
    stream = readers.stream_messages(spark, path, "json")
    live.start_ingest(
        stream, _new_index(spark, sf_dir), *_dims(spark, sf_dir),
        checkpoint=scratch_dir(spark, "ckpt"), rejects=rejects,
    ).awaitTermination()
    return spark.read.parquet(rejects).groupBy("reason").agg(F.count("*").alias("n"))


_SAVED = [("a", "the"), ("b", "que-la und"), ("c", "group me", "acct1", 5031), ("d", "the,of", None, None, 1000), ("e", "!!!"), ("f", "Peer")]


@register(
    "stream_alerts",
    o.query(["m"], "SELECT search_id, id FROM hits", searches=o.fixed_searches(_SAVED), **o.search_ctes("m", 1_000_000_000)),
)
def _(spark, sf_dir):
    """Saved queries against a feed that delivers every message twice, in several batches."""
    raw, sink = readers.stream_messages(spark, _feed(spark, sf_dir), max_files=3), scratch_dir(spark, "alerts")
    saved = stored(alerts.saved_clauses(searches_frame(spark, _SAVED)), "saved")
    live.start_ingest(
        raw, _new_index(spark, sf_dir), *_dims(spark, sf_dir), checkpoint=scratch_dir(spark, "ckpt"), saved=saved, alerts=sink
    ).awaitTermination()
    return spark.read.parquet(sink).select("search_id", "id")


@register("stream_dedup", M)
def _(spark, sf_dir):
    raw = readers.stream_messages(spark, _feed(spark, sf_dir), max_files=3)
    documents = live.dedup(enrich.enrich(raw, *_dims(spark, sf_dir)))
    path = scratch_dir(spark, "deduped")
    live.start_table(documents, path, scratch_dir(spark, "ckpt")).awaitTermination()
    return spark.read.parquet(path).select(*DOCUMENT_COLUMNS)


@register(
    "stream_counts",
    o.query(["m"], "SELECT session_name, chat_id, count(*) AS n_documents FROM m GROUP BY ALL"),
)
def _(spark, sf_dir):
    raw = readers.stream_messages(spark, _feed(spark, sf_dir, 1), max_files=1)
    documents = enrich.enrich(raw, *_dims(spark, sf_dir))
    path = scratch_dir(spark, "counts")
    live.start_counts(documents, path, scratch_dir(spark, "ckpt")).awaitTermination()
    return live.latest_counts(spark.read.parquet(path))


@register(
    "stream_requests",
    o.query(RESPONSE, CHUNKS, **o.response_ctes("m", "all"), **o.chunk_ctes(render.CHUNK_MAX)),
)
def _(spark, sf_dir):
    """The request table as a stream, answered from the stored index."""
    path, sink = scratch_dir(spark, "requests"), scratch_dir(spark, "responses")
    v.requests(spark).repartition(2).write.parquet(path)
    corpus = IndexCorpus(indexed(spark, sf_dir))
    live.start_answers(
        readers.stream_requests(spark, path), lambda: corpus, v.accounts(spark, sf_dir),
        sink, scratch_dir(spark, "ckpt"), unknown_user="all",
    ).awaitTermination()
    return spark.read.parquet(sink).select("request_id", "chunk_no", "chunk")
