"""Where a search finds postings: computed from documents on the fly, or stored in an index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.literals import any_of
from ..operators import matching, postings
from ..operators.lexicon import Lexicon
from ..operators.sequence import slab_directory, slab_key
from ..session import stored
from .index_store import MessageIndex, Snapshot

# Up to this many terms or documents are looked up by literals that reach the file scan;
# more are joined.
PUSHED_TERMS = 500
PUSHED_KEYS = 1_000
# Single keys are pushed one by one, more as a set with its range.
PUSHED_IDS = 50
# Chats, senders or accounts that all searches of a table are limited to.
PUSHED_SCOPES = 100
# Terms of a table of any size that are sent to every task as the frequent ones, at most.
MOST_FREQUENT = 10_000
# Hits of a table of any size that Spark may send to every task, about 200 bytes each. It goes by the size of a
# compressed file, and the driver holds some ten times that.
SENT_HITS = 50_000


@dataclass(frozen=True)
class ScanCorpus:
    """Searches a document table directly; nothing is stored.

    Only occurrences of wanted terms leave the scan. They are counted per document, then
    laid out by document, so that matching and scoring need no further shuffle. With a lexicon,
    ideographs are searched by its words.
    """

    documents: DataFrame
    lexicon: Lexicon | None = None

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    def pinned(self) -> ScanCorpus:
        return self

    def asked(self, wanted: DataFrame) -> None:
        """There is no stored order in which literals could be looked up."""

    def lookup(
        self, wanted: DataFrame, bounded: bool = False, asked: list | None = None
    ) -> tuple[DataFrame, DataFrame]:
        """Postings of the wanted terms, and the weights of those terms."""
        terms = matching.vocabulary(wanted)
        few = terms.limit(PUSHED_TERMS + 1).collect() if bounded else []
        if 0 < len(few) <= PUSHED_TERMS and None not in {t.term for t in few}:
            # The texts are passed over once, for the wanted terms and for all lengths.
            rows = stored(postings.with_only(postings.field_tokens(self._analysed()), few), "tokens")
            counted = postings.count_terms(postings.exploded(rows))
            weights = matching.term_weights(postings.term_stats(counted), postings.total_lengths(rows))
            return counted.repartition(*postings.KEY), weights
        counted = self._counted(terms, bounded)
        weights = matching.term_weights(
            postings.term_stats(counted), postings.field_stats(self._analysed())
        )
        return counted.repartition(*postings.KEY), weights

    def _analysed(self) -> DataFrame:
        return postings.analysed(self.documents, self.lexicon)

    def _counted(self, terms: DataFrame, bounded: bool) -> DataFrame:
        occurrences = postings.token_occurrences(self._analysed())
        return postings.count_terms(
            occurrences.join(F.broadcast(terms) if bounded else terms, ["field", "term"])
        )

    def placed(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Stored postings of any number of terms with their slab, and ``field, term, df`` of these."""
        where = slab_key(*map(F.col, postings.KEY))
        found = stored(self._counted(terms, False).withColumn("slab", where), "found")
        return found, stored(postings.term_stats(found), "frequencies")

    def field_stats(self) -> DataFrame:
        return postings.field_stats(self._analysed())

    def fetch(self, hits: DataFrame, bounded: bool = False, few: bool = False) -> DataFrame:
        """Join the documents of the hits on ``id``; bounded hits are broadcast to the scan."""
        return self.documents.join(F.broadcast(hits) if bounded else hits, "id")

    def message_keys(self) -> DataFrame:
        return self.documents.select(*postings.KEY)

    def slab_directory(self) -> DataFrame:
        return slab_directory(self.message_keys())


@dataclass(frozen=True)
class IndexCorpus:
    """Searches stored postings, of a whole index or of one state of it.

    Postings are bucketed by slab, so a document's postings lie in one task and matching
    needs no shuffle. A small set of terms or documents is looked up by literal values.
    """

    index: MessageIndex | Snapshot

    @property
    def spark(self) -> SparkSession:
        return self.index.spark

    @property
    def documents(self) -> DataFrame:
        return self.index.documents()

    @property
    def lexicon(self) -> Lexicon | None:
        return self.index.lexicon

    def pinned(self) -> IndexCorpus:
        """The same at the newest state; all steps of a search then see one state."""
        return IndexCorpus(self.index.at())

    def lookup(
        self, wanted: DataFrame, bounded: bool = False, asked: list | None = None
    ) -> tuple[DataFrame, DataFrame]:
        """Postings of the wanted terms, and the weights of those terms.

        ``asked`` is the result of :meth:`asked`, where the caller has it already.
        """
        terms = matching.vocabulary(wanted)
        rows, stats = self.index.postings(), self.index.term_stats()
        if bounded:
            asked = asked or self.asked(wanted)
            if asked:
                stats = stats.filter(any_of("term", {a.term for a in asked}))
                rows = self.pushed(rows, wanted, asked)
            terms = F.broadcast(terms)
        on = ["field", "term"]
        counts = stats.join(terms, on).groupBy(*on).agg(F.sum("df").alias("df"))
        weights = matching.term_weights(counts, self.index.field_stats())
        return rows.join(terms, on, "left_semi"), weights

    def asked(self, wanted: DataFrame) -> list | None:
        """The different terms and scopes of a few searches; None for more than ``PUSHED_TERMS``."""
        scope = [c for c in matching.SCOPE if c in wanted.columns]
        rows = wanted.select("term", *scope).distinct().limit(PUSHED_TERMS + 1).collect()
        return rows if len(rows) <= PUSHED_TERMS else None

    @staticmethod
    def pushed(rows: DataFrame, wanted: DataFrame, asked: list) -> DataFrame:
        """Rows of the asked terms and scopes, by conditions that reach the scan."""
        rows = rows.filter(any_of("term", {a.term for a in asked}))
        for c in matching.SCOPE:
            column = c.removeprefix("scope_")
            if c in wanted.columns and column in rows.columns:
                values = {a[c] for a in asked}
                if None not in values and len(values) <= PUSHED_SCOPES:
                    rows = rows.filter(any_of(column, values))
        return rows

    def placed(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Stored postings of any number of terms with their slab, and ``field, term, df`` of these.

        The postings are read once. The terms' own table is compared with that of the frequencies. Up to
        ``MOST_FREQUENT`` terms are sent to the postings, which then stay where they are. For more terms, those of frequent terms stay where they are, as there are few such terms, and
        those of rare ones meet their terms by key, so no task holds a hot term.
        """
        on = ["field", "term"]
        counts = self.index.term_stats().join(terms, on, "left_semi").groupBy(*on).agg(F.sum("df").alias("df"))
        frequencies = stored(counts, "frequencies")
        if frequencies.limit(MOST_FREQUENT + 1).count() <= MOST_FREQUENT:
            few = F.broadcast(frequencies.select(*on))
            return stored(self.index.postings().join(few, on, "left_semi"), "found"), frequencies
        total = frequencies.agg(F.sum("df")).first()[0] or 0
        # At most MOST_FREQUENT terms can have this share of all postings.
        hot = frequencies.filter(F.col("df") * MOST_FREQUENT >= F.lit(total)).select(*on, F.lit(True).alias("hot"))
        rows = self.index.postings().join(F.broadcast(hot), on, "left")
        # Rows of hot terms need no second look: their key is a hash of their slab, which spreads them.
        key = F.when(F.col("hot"), F.xxhash64("slab")).otherwise(F.xxhash64(*on))
        rare = frequencies.join(F.broadcast(hot), on, "left_anti").select(*on, F.xxhash64(*on).alias("key"), F.lit(True).alias("rare"))
        kept = rows.withColumn("key", key).join(rare.hint("merge"), ["key", *on], "left").filter(F.col("hot") | F.col("rare"))
        return stored(kept.drop("key", "hot", "rare"), "found"), frequencies

    def field_stats(self) -> DataFrame:
        return self.index.field_stats()

    def term_slabs(self) -> DataFrame:
        return self.index.term_slabs()

    def fetch(self, hits: DataFrame, bounded: bool = False, few: bool = False) -> DataFrame:
        """Join the documents of the hits on ``id``.

        A few hits are computed first and fetched by their slabs and ids, which prunes
        buckets and row groups of the document table instead of reading its texts. Many hits
        meet the documents where these lie. ``few`` says that there are ``PUSHED_KEYS`` at most.
        """
        documents = self.index.documents()
        located = hits.withColumn("slab", _slab_of(F.col("id")))
        if few:
            rows = located.collect()
            kept = self.spark.createDataFrame(rows, located.schema)
            return _only(documents, rows).join(F.broadcast(kept), ["slab", "id"])
        kept = stored(located, "hits")
        many = kept.count()
        if not bounded:
            return documents.join(kept if many <= SENT_HITS else kept.hint("merge"), ["slab", "id"])
        if many <= PUSHED_KEYS:
            documents = _only(documents, kept.select("id", "slab").distinct().collect())
        return documents.join(F.broadcast(kept), ["slab", "id"])

    def message_keys(self) -> DataFrame:
        return self.index.documents().select(*postings.KEY, "slab")

    def slab_directory(self) -> DataFrame:
        return self.index.slab_stats()


def _only(documents: DataFrame, keys: list) -> DataFrame:
    """Documents of some slabs and ids. A long list of equalities costs more than it skips."""
    ids, slabs = {k.id for k in keys}, {k.slab for k in keys}
    wanted = any_of("id", ids) if len(ids) <= PUSHED_IDS else F.col("id").isin(sorted(ids))
    return documents.filter(F.col("slab").isin(sorted(slabs)) & wanted)


def _slab_of(key):
    """Slab of a document id; the two numbers stand at its end."""
    pattern = r"(?s)^(.*):(-?[0-9]+):(-?[0-9]+)$"
    session, chat, message = (F.regexp_extract(key, pattern, i) for i in (1, 2, 3))
    return slab_key(session, chat.cast("bigint"), message.cast("bigint"))
