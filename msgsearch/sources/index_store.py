"""The index as seven tables and a history of commits.

``documents``, ``postings`` and ``id_words`` are bucketed by slab (see operators/sequence.py): all rows of
a document, and of up to 2**16 neighbouring messages of its chat, share a bucket. Building
postings from documents, matching a query and ranking messages within a chat therefore need
no shuffle, while a chat of any size is spread over all buckets. Postings are sorted by
field, term and chat, documents by id, so that literal lookups skip row groups. ``id_words`` has a bit for
each message, 64 neighbours to a row, sorted by slab: an append looks up the slabs of its batch there, so
it costs what the batch does and not what the archive does. ``term_slabs`` has the largest weight of each
term in each slab, so that a search for the best hits skips slabs that cannot hold one. The other three
tables hold one increment per part and are summed when read: messages per slab, documents per term, and
documents and lengths per field.

A part is one partition of every table, under a name that is used once. It is invisible until a commit lists
it (``commits.py``), and never changes afterwards. So a write that fails halfway leaves nothing behind
that counts, a batch that is tried again finds its name committed, and whoever reads through a
:class:`Snapshot` sees one state of all tables while others append and merge. Writers need no lock: each
publishes the next commit, and one that comes second compares its ids with what came first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.literals import any_of
from ..operators import ingest
from ..operators import postings as terms
from ..operators.lexicon import Lexicon
from ..operators.matching import saturation
from ..operators.sequence import slab_directory, slab_key
from .commits import CommitLog, State

# Sized for tests. At scale choose about one bucket per gigabyte of text, and at least a
# few per core.
DEFAULT_BUCKETS = 8
# Slabs that are looked up by literals; a batch with more of them joins the key table by bucket.
PUSHED_SLABS = 500
WORD_BITS = 6

_DOCUMENTS = (
    "id STRING, chat_id BIGINT, message_id BIGINT, session_name STRING, text STRING, "
    "sender_id BIGINT, sender_name STRING, receiver_name STRING, `date` BIGINT, "
    "chat_title STRING, slab BIGINT"
)
_POSTINGS = (
    "field STRING, term STRING, session_name STRING, chat_id BIGINT, message_id BIGINT, "
    "sender_id BIGINT, dl BIGINT, slab BIGINT, tf BIGINT"
)
_WORD = ["slab", "session_name", "chat_id", "word"]
_TABLES = {
    "documents": (_DOCUMENTS, "CLUSTERED BY (slab) SORTED BY (id)"),
    "postings": (_POSTINGS, "CLUSTERED BY (slab) SORTED BY (field, term, session_name, chat_id)"),
    "id_words": ("slab BIGINT, session_name STRING, chat_id BIGINT, word BIGINT, bits BIGINT", "CLUSTERED BY (slab) SORTED BY (slab, word)"),
    "term_slabs": ("field STRING, term STRING, slab BIGINT, session_name STRING, chat_id BIGINT, top DOUBLE", "CLUSTERED BY (slab) SORTED BY (field, term)"),
    "slab_stats": ("session_name STRING, chat_id BIGINT, slab_no BIGINT, n BIGINT", None),
    "term_stats": ("field STRING, term STRING, df BIGINT", None),
    "field_stats": ("field STRING, n_docs BIGINT, total_len BIGINT", None),
}
_FORMAT = 2


class _Readable:
    """What can be read of an index; ``_read`` gives the live rows of a table."""

    def documents(self) -> DataFrame:
        return self._read("documents").drop("part")

    def postings(self) -> DataFrame:
        return self._read("postings").drop("part")

    def id_words(self) -> DataFrame:
        """The indexed message ids: bit ``message_id % 64`` of word ``message_id / 64`` of a chat."""
        return self._read("id_words").drop("part")

    def term_slabs(self) -> DataFrame:
        """``top``: the largest saturation of a term in a slab, for the ``avg_len`` of that part."""
        lengths = self._read("field_stats").groupBy("part", "field").agg(F.try_divide(F.sum("total_len"), F.sum("n_docs")).alias("avg_len"))
        return self._read("term_slabs").join(F.broadcast(lengths), ["part", "field"]).drop("part")

    def slab_stats(self) -> DataFrame:
        """Increments; sum ``n`` per chat and slab."""
        return self._read("slab_stats").drop("part")

    def term_stats(self) -> DataFrame:
        """Increments; sum ``df`` per field and term."""
        return self._read("term_stats").drop("part")

    def field_stats(self) -> DataFrame:
        return (
            self._read("field_stats")
            .groupBy("field")
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))
        )

    def document_exists(self, doc_id: str) -> bool:
        return not self._read("documents").filter(F.col("id") == doc_id).limit(1).isEmpty()


class Snapshot(_Readable):
    """One state of an index. It stays readable until :meth:`MessageIndex.vacuum` removes merged parts."""

    def __init__(self, index: MessageIndex, state: State):
        self.index, self.state, self.spark, self.lexicon = index, state, index.spark, index.lexicon

    def at(self) -> Snapshot:
        return self

    def document_count(self) -> int:
        return sum(self.state.live.values())

    def _read(self, kind: str) -> DataFrame:
        return self.index._of(kind, self.state.parts())


class MessageIndex(_Readable):
    """Stored documents, postings and statistics under one folder.

    Each reading method looks at the newest commit. What belongs together is read through :meth:`at`.
    With a lexicon, ideographs are indexed and searched by its words; give the same one at every opening, and
    index anew to change it.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        name: str,
        buckets: int | None = None,
        lexicon: Lexicon | None = None,
    ):
        self.spark, self.path, self.name, self.buckets = spark, path.rstrip("/"), name, buckets
        self.commits, self.lexicon = CommitLog(spark, self.path), lexicon
        self._seen: set[str] = set()

    def table_name(self, kind: str) -> str:
        return f"{self.name}_{kind}"

    def is_open(self) -> bool:
        return all(self.spark.catalog.tableExists(self.table_name(k)) for k in _TABLES)

    def open(self) -> MessageIndex:
        """Create the tables, or attach them to files written earlier.

        The bucket count belongs to the files: it is stored with them at first, and another
        one asked for later is refused.
        """
        self.buckets = self._layout()
        self.commits.create()
        for kind, (columns, clustering) in _TABLES.items():
            location = f"{self.path}/{kind}"
            _ensure_folder(self.spark, location)
            buckets = f"{clustering} INTO {self.buckets} BUCKETS" if clustering else ""
            # Each write to such a table has a staging folder of its own, so writers do not meet.
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.table_name(kind)} ({columns}, part STRING) "
                "USING parquet OPTIONS (partitionOverwriteMode 'dynamic') "
                f"PARTITIONED BY (part) {buckets} LOCATION '{location}'"
            )
        self._seen = set(self.commits.read().live)
        self.refresh()
        return self

    def _layout(self) -> int:
        """The bucket count of the files; written where there are none yet."""
        location = f"{self.path}/layout"
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{location}/_SUCCESS")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            asked = self.buckets or DEFAULT_BUCKETS
            written = self.spark.createDataFrame([(_FORMAT, asked)], "format int, buckets int")
            written.coalesce(1).write.mode("overwrite").parquet(location)
            return asked
        stored_format, buckets = self.spark.read.parquet(location).first()
        if stored_format != _FORMAT:
            raise ValueError(f"{self.path} has format {stored_format}, not {_FORMAT}")
        if self.buckets not in (None, buckets):
            raise ValueError(f"{self.path} has {buckets} buckets, not {self.buckets}")
        return buckets

    def refresh(self) -> None:
        """Make files written by another application visible here; reading does it when needed."""
        for kind in _TABLES:
            self.spark.sql(f"ALTER TABLE {self.table_name(kind)} RECOVER PARTITIONS")
            self.spark.catalog.refreshTable(self.table_name(kind))

    def at(self) -> Snapshot:
        """The newest state, which stays the same however the index goes on."""
        return Snapshot(self, self._state())

    def _state(self) -> State:
        state = self.commits.read()
        unseen = set(state.live) - self._seen
        if unseen:
            self._seen = set(state.live)
            self.refresh()
        return state

    def live_batches(self) -> list[str]:
        """The parts that count; ``compact`` keeps them few."""
        return self._state().parts()

    def document_count(self) -> int:
        return self.at().document_count()

    def _read(self, kind: str) -> DataFrame:
        return self.at()._read(kind)

    def _of(self, kind: str, parts: list[str]) -> DataFrame:
        return self.spark.table(self.table_name(kind)).filter(F.col("part").isin(parts))

    def append(
        self,
        documents: DataFrame,
        batch_id: str | None = None,
        first: Callable[[DataFrame], None] | None = None,
    ) -> int:
        """Index the documents that are new, as one batch; returns their number.

        A caller that may try a batch again gives it a ``batch_id`` of its own: once committed, a
        name is final, and 0 comes back. Ids are compared with those of the slabs that the batch
        touches, so holes that an interrupted run has left are closed. Other writers may append and
        merge meanwhile: before it publishes, and each time another commit came first, the batch
        leaves out what has been committed since. ``first`` is called with the new documents before
        they are published, and again if others come first; what it does must replace what it did.
        """
        name = batch_id or uuid.uuid4().hex
        state = self._state()
        if self.commits.holds(state, name):
            return 0
        part = self._write_documents(documents)
        checked: set[str] = set()
        derived = None
        while True:
            came = [p for p in state.parts() if p not in checked]
            known = self._known(part, came) if came else None
            if known is not None and not known.isEmpty():
                part = self._rewrite(part, known)
            checked.update(came)
            if derived != part:
                many, derived = self._derive(part), part
                if first:
                    first(self._part("documents", part))
            if self.commits.publish(state.with_part(part, many, name)):
                self._seen.add(part)
                return many
            state = self._state()
            if self.commits.holds(state, name):
                return 0

    def _write_documents(self, documents: DataFrame) -> str:
        """A new part with one row of each id, and its key table."""
        part = uuid.uuid4().hex
        slab = slab_key(F.col("session_name"), F.col("chat_id"), F.col("message_id"))
        rows = ingest.dedupe_by_id(documents).withColumn("slab", slab)
        self._write("documents", part, rows.repartition(self.buckets, "slab"))
        self._write("id_words", part, _id_words(self._part("documents", part)))
        return part

    def _known(self, part: str, others: list[str]) -> DataFrame:
        """The words of a part's ids with the bits that other parts have too."""
        own, theirs = self._part("id_words", part), self._of("id_words", others)
        slabs = [r.slab for r in own.select("slab").distinct().limit(PUSHED_SLABS + 1).collect()]
        if len(slabs) <= PUSHED_SLABS:
            theirs = theirs.filter(any_of("slab", slabs))
        theirs = theirs.groupBy(*_WORD).agg(F.bit_or("bits").alias("taken"))
        return own.join(theirs, _WORD).filter(F.col("bits").bitwiseAND(F.col("taken")) != 0).select(*_WORD, "taken")

    def _rewrite(self, part: str, known: DataFrame) -> str:
        """The part again without the known ids; the first one is never seen."""
        rows = self._part("documents", part).withColumn("word", F.shiftright("message_id", WORD_BITS))
        left = rows.join(known, _WORD, "left")
        fresh = left.filter(F.col("taken").isNull() | (F.col("taken").bitwiseAND(_bit()) == 0))
        again = uuid.uuid4().hex
        self._write("documents", again, fresh.drop("word", "taken").repartition(self.buckets, "slab"))
        self._write("id_words", again, _id_words(self._part("documents", again)))
        return again

    def compact(self) -> int:
        """Rewrite all parts as one; returns how many there were.

        Readers change from the old parts to the new one with its commit. Parts that are
        appended meanwhile stay by themselves; where another merging came first, this one is
        dropped. Files of replaced parts go with ``vacuum``.
        """
        state = self._state()
        parts = state.parts()
        if len(parts) < 2:
            return len(parts)
        merged = f"merged-{uuid.uuid4().hex}"
        for kind in ("documents", "postings"):
            rows = self._of(kind, parts).drop("part")
            self._write(kind, merged, rows.repartition(self.buckets, "slab"))
        words = self._of("id_words", parts).groupBy(*_WORD).agg(F.bit_or("bits").alias("bits"))
        self._write("id_words", merged, words.repartition(self.buckets, "slab"))
        keys = {
            "slab_stats": (["session_name", "chat_id", "slab_no"], ["n"]),
            "term_stats": (["field", "term"], ["df"]),
            "field_stats": (["field"], ["n_docs", "total_len"]),
        }
        for kind, (names, sums) in keys.items():
            rows = self._of(kind, parts).groupBy(*names).agg(*[F.sum(c).alias(c) for c in sums])
            self._write(kind, merged, rows.sortWithinPartitions(*names))
        self._write("term_slabs", merged, self._tops(merged))
        while set(parts) <= set(state.live):
            if self.commits.publish(self.commits.folded(state.merged(parts, merged))):
                self._seen.add(merged)
                return len(parts)
            state = self._state()
        return 0

    def reset(self, confirm: bool = False) -> None:
        """Remove all rows; names of batches may then come again."""
        if not confirm:
            raise ValueError("pass confirm=True to remove all indexed messages")
        while not self.commits.publish(self._state().emptied()):
            pass

    def vacuum(self, abandoned: bool = False) -> int:
        """Remove the files of replaced parts; for times when no search of before is running.

        With ``abandoned``, also what failed writes have left; for times when nobody writes.
        """
        state = self._state()
        gone = set(state.gone)
        if abandoned:
            shown = self.spark.sql(f"SHOW PARTITIONS {self.table_name('documents')}").collect()
            gone |= {r.partition.removeprefix("part=") for r in shown} - set(state.live)
        context = self.spark.sparkContext
        for kind in _TABLES:
            for part in gone:
                folder = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/part={part}")
                folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
                self.spark.sql(
                    f"ALTER TABLE {self.table_name(kind)} DROP IF EXISTS PARTITION (part = '{part}')"
                )
            self.spark.catalog.refreshTable(self.table_name(kind))
        while gone and not self.commits.publish(state.cleaned(list(gone))):
            state = self._state()
        self.commits.forget()
        return len(gone)

    def _derive(self, part: str) -> int:
        """Postings and statistics of a part, from its written documents and postings."""
        documents = self._part("documents", part)
        many = documents.count()
        if not many:
            return 0
        self._write("slab_stats", part, slab_directory(documents))
        self._write("postings", part, terms.postings(terms.analysed(documents, self.lexicon)))
        rows = self._part("postings", part)
        stats = terms.term_stats(rows).sortWithinPartitions("field", "term")
        self._write("term_stats", part, stats)
        fields = F.explode(F.array(*[F.lit(f) for f in (terms.TEXT, terms.SENDER, terms.TITLE)]))
        zero = F.lit(0).cast("bigint")
        counts = documents.agg(F.count("*").alias("n_docs")).select(
            fields.alias("field"), "n_docs", zero.alias("total_len")
        )
        lengths = rows.groupBy("field").agg(zero.alias("n_docs"), F.sum("tf").alias("total_len"))
        self._write("field_stats", part, counts.unionByName(lengths).coalesce(1))
        self._write("term_slabs", part, self._tops(part))
        return many

    def _tops(self, part: str) -> DataFrame:
        """Rows of ``term_slabs`` from a part's postings; its three average lengths are broadcast."""
        lengths = self._part("field_stats", part).groupBy("field").agg(
            F.try_divide(F.sum("total_len"), F.sum("n_docs")).alias("avg_len")
        )
        rows = self._part("postings", part).join(F.broadcast(lengths), "field")
        top = F.max(saturation(F.col("tf"), F.col("dl"), F.col("avg_len"))).alias("top")
        return rows.groupBy("slab", "field", "term", "session_name", "chat_id").agg(top)

    def _part(self, kind: str, part: str) -> DataFrame:
        return self._of(kind, [part]).drop("part")

    def _write(self, kind: str, part: str, rows: DataFrame) -> None:
        table = self.table_name(kind)
        columns = [c for c in self.spark.table(table).columns if c != "part"]
        rows.select(*columns, F.lit(part).alias("part")).write.insertInto(table, overwrite=True)
        # A micro-batch writes in a session of its own.
        self.spark.catalog.refreshTable(table)


def _bit():
    place = F.col("message_id").bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def _id_words(documents: DataFrame) -> DataFrame:
    words = documents.groupBy("slab", "session_name", "chat_id", F.shiftright("message_id", WORD_BITS).alias("word"))
    return words.agg(F.bit_or(_bit()).alias("bits"))


def _ensure_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
