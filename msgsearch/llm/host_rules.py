"""Quality rules at host level: hosts whose documents fail too often lose all of them.

Each document is measured and judged by base rules. Failures are counted by host; the rates of small
hosts are shrunk towards all hosts by a beta prior whose two parameters come from the hosts themselves
(method of moments). A host whose shrunk rate exceeds the limit is rejected, and its verdict is joined
back to its documents. Windows of a text are compared by hash first; no text has its windows copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from msgsearch.session import stored

MIN_WORDS = 20
MOST_REPEATED_PERCENT = 30
WINDOW = 8
#: A host goes when more than this share of its documents fails, after shrinking.
MOST_FAILING = 0.5
#: What the prior is worth in documents, at least and at most.
LEAST_WORTH, MOST_WORTH = 1.0, 1000.0
#: Separators besides the blank.
CONTROLS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    """The words of a text, split at blanks and the controls from tab to carriage return."""
    return F.array_remove(F.split(F.translate(text, CONTROLS, " " * len(CONTROLS)), " "), "")


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(_without(line, CONTROLS)) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def _window_hashes(words: Column) -> Column:
    """A hash of each window; ``words`` must be a column of the row, or it is computed per window."""
    places = F.sequence(F.lit(1), F.size(words) - WINDOW + 1)
    hashed = F.transform(places, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>"))


def _sorted_windows(words: Column, hashes: Column) -> Column:
    """The places of all windows by two hashes, so that equal windows are neighbours; no window is copied."""

    def entry(h: Column, k: Column) -> Column:
        second = F.hash(F.slice(words, k + 1, WINDOW))
        return F.struct(h.alias("h"), second.alias("g"), (k + 1).alias("i"))

    return F.array_sort(F.transform(hashes, entry))


def _repeated_places(windows: Column, words: Column) -> Column:
    """Ascending places of windows with an equal neighbour; both must be columns of the row.

    Neighbours with the same hashes are compared word by word.
    """

    def like(x: Column, k: Column) -> Column:
        other = F.get(windows, k)
        same = F.slice(words, other["i"], WINDOW) == F.slice(words, x["i"], WINDOW)
        return F.coalesce((other["h"] == x["h"]) & (other["g"] == x["g"]) & same, F.lit(False))

    flagged = F.transform(windows, lambda x, k: F.when(like(x, k - 1) | like(x, k + 1), x["i"]))
    return F.array_sort(F.filter(flagged, lambda i: i.isNotNull()))


def _covered(places: Column) -> Column:
    """Words inside the windows at ascending places: eight each, less what the one before covers."""
    sums = F.aggregate(
        places,
        F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum"), i.alias("last")),
    )
    return sums["sum"].cast("bigint")


def measure(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``MEASURES`` (long); a null text has no words. Columns of these names are replaced.

    ``n_repeat_words`` counts words inside windows that the text has twice or more. Only texts in which two
    windows have the same hash sort their windows.
    """
    own = documents.drop(*MEASURES, "_words", "_hashes", "_windows")
    whole = F.coalesce(F.col(text), F.lit(""))
    stepwise = own.withColumn("_words", words_of(whole)).withColumn("_hashes", _window_hashes(F.col("_words")))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    stepwise = stepwise.withColumn("_windows", F.when(repeats, _sorted_windows(F.col("_words"), F.col("_hashes"))))
    covered = F.when(F.col("_windows").isNotNull(), _covered(_repeated_places(F.col("_windows"), F.col("_words"))))
    return stepwise.select(
        *own.columns,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(_without(whole, " " + CONTROLS)).cast("bigint").alias("word_chars"),
        (F.length(whole) - F.length(_without(whole, SYMBOLS))).cast("bigint").alias("n_symbols"),
        duplicate_lines(whole).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Parameters (failed, passed) of the prior, from the failures of all hosts with their document counts.

    The moments are those of a beta-binomial: with the overall rate m, hosts of n documents with f failures
    and the correlation r of two documents of a host, the sum of n (f/n - m)^2 is expected to be
    m (1 - m) ((hosts - 1) + r (documents - sum of n^2 / documents - (hosts - 1))). So small hosts count for
    what they tell, and none is left out. The prior is worth 1/r - 1 documents, within ``LEAST_WORTH`` and
    ``MOST_WORTH``. Where hosts cannot tell r (one host, one document each, equal outcomes everywhere), it
    is worth the most, at the overall rate.
    """
    f, n = F.col("failed").cast("double"), F.col("docs").cast("double")
    sums = hosts.agg(
        F.sum(f).alias("failed"), F.sum(n).alias("docs"), F.count(F.lit(1)).alias("hosts"),
        F.sum(f * f / n).alias("between"), F.sum(n * n).alias("squares"),
    ).first()
    if not sums["docs"]:
        return 0.5, 0.5
    failed, docs, others = sums["failed"], sums["docs"], sums["hosts"] - 1
    mean = min(max(failed / docs, 1e-6), 1 - 1e-6)
    room = docs - sums["squares"] / docs - others
    among = (sums["between"] - failed * failed / docs) / (mean * (1 - mean)) - others
    worth = MOST_WORTH
    if room > 0 and among > 0:
        worth = min(max(room / among - 1, LEAST_WORTH), MOST_WORTH)
    return mean * worth, (1 - mean) * worth


def host_verdicts(judged: DataFrame, host: str) -> DataFrame:
    """Per host: docs, failed, ``host_rate`` (shrunk) and ``host_failed``. Failures are counted before the shuffle."""
    counted = judged.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("bigint")).alias("failed")
    )
    hosts = stored(counted, "hosts")
    failed, passed = beta_prior(hosts)
    shrunk = (F.col("failed") + failed) / (F.col("docs") + failed + passed)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_failed", F.col("host_rate") > MOST_FAILING)


def judge(documents: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """Every document (its columns but the text) with measures, base_failed, host_rate, host_failed and kept.

    A null host is no host: only the base rules count, host_rate is null. A null text has no words and
    fails. Repeated rows count each. An empty table gives an empty one. Columns of the result's names in
    the input are replaced. The join back has no hint: Spark broadcasts the hosts if they are small, and
    splits a hot host's documents if not.
    """
    added = ["base_failed", "host_rate", "host_failed", "kept", "docs", "failed"]
    kept = documents.drop(*(x for x in added if x != host))
    measured = measure(kept, text).withColumn("base_failed", base_failed())
    judged = stored(measured if text == host else measured.drop(text), "measures")
    hosts = host_verdicts(judged, host).select(F.col(host).alias("_host"), "host_rate", "host_failed")
    return (
        judged.join(hosts, F.col(host) == F.col("_host"), "left")
        .drop("_host")
        .withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    )


def passing(documents: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that :func:`judge` keeps, with their own columns only.

    Rows are known by 128 bits of hashes of their columns (equal rows are judged alike); the rejected ones,
    fewer and narrow, are joined back, so that no text is written. Nulls and repeats count as in :func:`judge`;
    input columns named ``_row`` or ``_twin`` are left behind.
    """
    own = documents.drop("_row", "_twin")
    key = ["_row", "_twin"]
    keyed = own.withColumn("_row", F.xxhash64(*own.columns)).withColumn("_twin", F.xxhash64(F.lit(7), *own.columns[::-1]))
    judged = judge(keyed.select(*key, host, text), host, text)
    rejected = judged.where(~F.col("kept")).select(*key).distinct()
    return keyed.join(rejected, key, "left_anti").drop(*key)
