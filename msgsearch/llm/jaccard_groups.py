"""N-gram Jaccard join by grouped prefixes: which texts are linked, as connected components.

1. Each text becomes the set of its word shingles (64-bit hashes). Equal sets are one class. A fixed-size
   sketch gives every shingle a coarse frequency; (frequency, hash) orders shingles, rare ones first.
2. Two sets can only be similar if they share a shingle among their first few (the prefix). Classes with
   the same prefix and size are one group; groups meet in the buckets of their prefix shingles, where size,
   position in the order and a parity signature of the sets (if the group has one class) exclude pairs.
3. Group pairs are expanded to classes, the signature is tested again, and the sets are compared exactly.
4. Links first connect every bucket's members to few pivots. Then only pairs that are still in different
   components are compared, all of them. Pairs inside a component are never enumerated, so thousands of
   near copies cost about as many comparisons, and no component misses a link.
5. Large buckets are cut into blocks. All blocks of one get the same pivots first. In the exact pass what is
   outside a bucket's largest component is compared with everything in it, by pairs of blocks; buckets of one
   component are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from msgsearch.llm.cells import level_of, levels, may_repeat, power_of_two, repeated
from msgsearch.llm.common import Words, mix, runs_hash, text_slices
from msgsearch.llm.components import components
from msgsearch.session import stored

LEVEL_CELLS = 1 << 20
#: Bits of a signature; each shingle flips one. A wide signature has a bit per shingle or more.
SIGNED = 256
#: Rounds of pivots in a bucket before its rest is left to the exact pass.
PIVOTS = 3
#: Entries of a bucket beyond which it is cut into blocks of about as many, and the pivots its blocks share.
BLOCK = 8192
SEEDS = 64
#: What an entry is in the exact pass: compared, compared with, of the bucket's largest component.
LEFT, RIGHT, TOP = 1, 2, 4
SETS = "doc_id bigint, n bigint, cls bigint, grp bigint, sig binary, wide binary, prefix binary"
GROUPS = "grp bigint, n bigint, cls bigint, sig binary, prefix binary"
POSTINGS = "bucket bigint, entry bigint, n bigint, pos int, sig binary, comp bigint"
PAIRS = "a bigint, b bigint"


@dataclass(frozen=True)
class Rule:
    """Two sets link when 100 * common >= percent * all; sets are of ``shingle`` words."""

    shingle: int = 4
    percent: int = 85

    def common(self, both):
        """Fewest common members of sets with ``both`` members together."""
        return -(-self.percent * both // (100 + self.percent))

    def prefix(self, n: int) -> int:
        return n - (-(-self.percent * n // 100)) + 1


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The set of each text, ascending; fewer words than a shingle are one member, no words none."""
    words = Words(texts, lower=True)
    runs = runs_hash(words.hashes, shingle)
    found = []
    for low, high in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if high - low >= shingle:
            found.append(np.unique(runs[low : high - shingle + 1]))
        elif high > low:
            found.append(runs_hash(words.hashes[low:high], high - low, high - low))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def _class(members: np.ndarray) -> int:
    """A hash of a set, from its members' sum and number."""
    total = mix(np.add.reduce(mix(members + np.uint64(7)), keepdims=True) + np.uint64(len(members)))
    return int(total.view(np.int64)[0])


def _signature(members: np.ndarray, bits: int = SIGNED) -> bytes:
    flips = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(bool)).tobytes()


def _wide(members: np.ndarray) -> bytes:
    return _signature(members, max(SIGNED, 1 << (len(members) - 1).bit_length()))


def _folded(sig: np.ndarray, size: int) -> np.ndarray:
    """A wide signature as it would be with fewer bits."""
    return np.bitwise_xor.reduce(sig.reshape(-1, size), axis=0)


def _sets(documents: DataFrame, rule: Rule, found: Broadcast) -> DataFrame:
    """Class, group and, once per class and task, prefix of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for some in text_slices(batch, "text"):
                out = []
                for doc_id, members in zip(some.column("doc_id").to_pylist(), shingle_sets(some.column("text"), rule.shingle)):
                    n = len(members)
                    if not n:
                        out.append((doc_id, 0, None, None, None, None, None))
                        continue
                    cls = _class(members)
                    first = cls not in seen
                    seen.add(cls)
                    order = np.lexsort((members, level_of(found.value, members)))
                    prefix = members[order[: rule.prefix(n)]]
                    grp = int(mix(runs_hash(prefix, len(prefix), 3) + np.uint64(n)).view(np.int64)[0])
                    more = (_signature(members), _wide(members), prefix.tobytes()) if first else (None, None, None)
                    out.append((doc_id, n, cls, grp, *more))
                yield _batch(out, SETS)

    return documents.select("doc_id", "text").mapInArrow(rows, SETS)


KINDS = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(c, KINDS[k]) for c, k in zip(columns, kinds)], list(names))


def _groups(sets: DataFrame) -> DataFrame:
    """One row per group: a group of several classes has no class and no signature."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and held[0] == row[0]:
                    if held[2] != row[2]:
                        held = (held[0], held[1], None, None, held[4])
                    continue
                if held is not None:
                    out.append(held)
                held = row
            yield _batch(out, GROUPS)
        if held is not None:
            yield _batch([held], GROUPS)

    own = sets.where("prefix IS NOT NULL").select("grp", "n", "cls", "sig", "prefix")
    return own.repartition("grp").sortWithinPartitions("grp", "cls").mapInArrow(reduce, GROUPS)


def _prefixes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The prefix shingles of a batch and how many each row has."""
    raw = batch.column("prefix").to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64), np.array([len(x) // 8 for x in raw], np.int64)


def _postings(groups: DataFrame, bits: Broadcast) -> DataFrame:
    """A row per group and prefix shingle that another group may have too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                some = batch.slice(begin, 1000)
                tokens, many = _prefixes(some)
                row = np.repeat(np.arange(some.num_rows), many)
                pos = np.arange(len(tokens)) - np.repeat(np.cumsum(many) - many, many)
                keep = may_repeat(bits.value, tokens)
                row = pa.array(row[keep])
                grp, n, sig = (some.column(c).take(row) for c in ("grp", "n", "sig"))
                columns = [pa.array(tokens[keep].view(np.int64)), grp, n, pa.array(pos[keep], pa.int32()), sig, pa.nulls(len(row), pa.int64())]
                yield pa.record_batch(columns, [x.split()[0] for x in POSTINGS.split(", ")])

    return groups.mapInArrow(rows, POSTINGS)


class Bucket:
    """The entries of one shingle (or of one group) or of a block of them, and which pairs may be similar.

    ``role`` is the turn of a shared pivot or 0 for :meth:`stars`, the flags above for :meth:`crossing`.
    """

    def __init__(self, rule: Rule, entry, n, pos, sig, comp, role):
        self.rule = rule
        order = np.lexsort((entry, n))
        self.entry, self.n, self.pos, self.comp, self.role = (x[order] for x in (entry, n, pos, comp, role))
        self.signed = np.array([sig[i] is not None for i in order])
        blank = bytes(SIGNED // 8)
        self.sig = np.frombuffer(b"".join(sig[i] or blank for i in order), np.uint64).reshape(len(order), -1)

    def possible(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of the other entries pass all bounds with this one."""
        both = self.n[one] + self.n[others]
        common = self.rule.common(both)
        most = np.minimum(self.n[one] - self.pos[one], self.n[others] - self.pos[others])
        differ = np.bitwise_count(self.sig[one] ^ self.sig[others]).sum(1)
        close = (differ <= both - 2 * common) | ~(self.signed[one] & self.signed[others])
        return (most >= common) & close & (self.entry[others] != self.entry[one])

    def stars(self) -> Iterator[tuple[int, int]]:
        """Entries with pivots: shared ones, then the one earliest in its own order, then of what it leaves."""
        rest, shared = np.flatnonzero(self.role == 0), np.flatnonzero(self.role > 0)
        shared = shared[np.argsort(self.role[shared])]
        while len(shared):
            pivot, shared = shared[0], shared[1:]
            near, alike = self.possible(pivot, rest), self.possible(pivot, shared)
            for other in np.concatenate((rest[near], shared[alike])):
                yield self.entry[pivot], self.entry[other]
            rest, shared = rest[~near & (self.entry[rest] != self.entry[pivot])], shared[~alike]
        for _ in range(PIVOTS):
            if len(rest) < 2:
                return
            pivot = rest[np.argmin(self.pos[rest])]
            near = self.possible(pivot, rest)
            for other in rest[near]:
                yield self.entry[pivot], self.entry[other]
            rest = rest[~near & (rest != pivot)]

    def crossing(self) -> Iterator[tuple[int, int]]:
        """All possible pairs of different components, one of them outside the largest."""
        rights = np.flatnonzero(self.role & RIGHT)
        sizes = self.n[rights]
        for one in np.flatnonzero(self.role & LEFT):
            low = np.searchsorted(sizes, -(-self.rule.percent * self.n[one] // 100))
            others = rights[low : np.searchsorted(sizes, 100 * self.n[one] // self.rule.percent, "right")]
            once = (self.role[others] & TOP > 0) | (self.entry[others] > self.entry[one])
            others = others[once & (self.comp[others] != self.comp[one])]
            if len(others):
                for other in others[self.possible(one, others)]:
                    yield self.entry[one], self.entry[other]


def _blocks(many: str):
    return F.ceil(F.col(many) / F.lit(BLOCK)).cast("int")


def _star_blocks(postings: DataFrame) -> DataFrame:
    """The postings with their role; large buckets in blocks, each with the pivots that all of them share."""
    large = stored(postings.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > BLOCK), "large-buckets")
    plain = postings.withColumn("role", F.lit(0))
    if large.isEmpty():
        return plain
    cut = postings.join(large, "bucket")
    own = cut.withColumn("block", F.pmod(F.xxhash64("entry"), _blocks("many")))
    turn = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("entry"), "entry"))
    seeds = cut.withColumn("role", turn).where(F.col("role") <= SEEDS).withColumn("block", F.explode(F.sequence(F.lit(0), _blocks("many") - 1)))
    dealt = own.withColumn("role", F.lit(0)).unionByName(seeds.withColumn("block", F.col("block").cast("bigint")))
    dealt = dealt.withColumn("bucket", F.xxhash64("bucket", "block")).select(plain.columns)
    return plain.join(large, "bucket", "left_anti").unionByName(dealt)


def _crossing_blocks(postings: DataFrame) -> DataFrame:
    """The postings of buckets of several components with their role; large buckets by pairs of blocks.

    A pair of blocks has a part of what is outside the largest component and a part of all entries.
    """
    parts = postings.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    several = parts.groupBy("bucket").agg(
        F.sum("n").alias("many"), F.max(F.struct("n", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")
    ).where("comps > 1")
    several = several.select("bucket", "many", F.col("most")["comp"].alias("top"), (F.col("many") - F.col("most")["n"]).alias("others"))
    cut = postings.join(stored(several, "crossing-buckets"), "bucket")
    top, place = F.col("comp") == F.col("top"), F.xxhash64("entry", "comp")

    def cell(left, right, role):
        return F.struct(F.xxhash64("bucket", left, right).alias("bucket"), role.alias("role"))

    lefts, rights = _blocks("others"), _blocks("many")
    right_role = F.when(top, F.lit(RIGHT | TOP)).otherwise(F.lit(RIGHT))
    as_right = F.transform(F.sequence(F.lit(0), lefts - 1), lambda k: cell(k, F.pmod(place, rights).cast("int"), right_role))
    as_left = F.transform(F.sequence(F.lit(0), rights - 1), lambda k: cell(F.pmod(place, lefts).cast("int"), k, F.lit(LEFT)))
    whole = F.array(F.struct(F.col("bucket"), F.when(top, F.lit(RIGHT | TOP)).otherwise(F.lit(LEFT | RIGHT)).alias("role")))
    cells = F.when(F.col("many") <= BLOCK, whole).when(top, as_right).otherwise(F.concat(as_right, as_left))
    kept = [c for c in postings.columns if c != "bucket"]
    return cut.select(*kept, F.explode(cells).alias("cell")).select(*kept, "cell.bucket", "cell.role")


def _bucket_pairs(postings: DataFrame, rule: Rule, pick: Callable[[Bucket], Iterator[tuple[int, int]]]) -> DataFrame:
    """Candidate pairs of entries, each once, from postings with roles, gathered by bucket or block."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            keys = rest.column("bucket").to_numpy()
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
            if len(heads) > 1:
                yield from some(rest.slice(0, heads[-1]), heads)
                rest = rest.slice(heads[-1])
        if rest is not None and rest.num_rows:
            yield from some(rest, np.array([0, rest.num_rows]))

    def some(table: pa.Table, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
        entry, n, pos, role = (table.column(c).to_numpy() for c in ("entry", "n", "pos", "role"))
        comp = table.column("comp").fill_null(0).to_numpy()
        sig = table.column("sig")
        found: set[tuple[int, int]] = set()
        for low, high in zip(heads[:-1].tolist(), heads[1:].tolist()):
            if high - low > 1:
                own = slice(low, high)
                bucket = Bucket(rule, entry[own], n[own], pos[own], sig[own].to_pylist(), comp[own], role[own])
                for x, y in pick(bucket):
                    found.add((min(x, y), max(x, y)))
                    if len(found) > 50_000:
                        yield _batch(list(found), PAIRS)
                        found = set()
        yield _batch(list(found), PAIRS)

    dealt = postings.repartition("bucket").sortWithinPartitions("bucket", "entry")
    return dealt.mapInArrow(pairs, PAIRS).distinct()


def _near(pairs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose wide signatures differ in no more bits than similar sets may."""
    for side in "ab":
        pairs = pairs.join(members.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("wide").alias(f"wide_{side}")), side)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, n, m, one, two in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "wide_a", "wide_b"))):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                size = min(len(x), len(y))
                differ = np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()
                if differ <= n + m - 2 * rule.common(n + m):
                    out.append((a, b))
            yield _batch(out, PAIRS)

    return pairs.mapInArrow(compare, PAIRS)


def _verified(documents: DataFrame, candidates: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """The pairs of classes whose sets are similar. Only sets of classes in a likely pair are sent."""
    spark = documents.sparkSession
    pairs = stored(_near(candidates, members, rule), "pairs")
    wanted = pairs.select("a").union(pairs.select("b")).distinct()

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield np.repeat(batch.column(0).to_numpy().view(np.uint64), 2)

    cells = power_of_two(8 * wanted.count(), 1 << 20, 1 << 30)
    bits = spark.sparkContext.broadcast(repeated(wanted, hashes, cells))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for some in text_slices(batch, "text"):
                out = []
                for members in shingle_sets(some.column("text"), rule.shingle):
                    cls = _class(members) if len(members) else None
                    if cls is not None and cls not in seen and may_repeat(bits.value, np.array([cls]).view(np.uint64))[0]:
                        seen.add(cls)
                        out.append((cls, members.tobytes()))
                yield _batch(out, "cls bigint, members binary")

    made = documents.select("text").mapInArrow(sets, "cls bigint, members binary").groupBy("cls").agg(F.first("members").alias("members"))
    made = stored(made, "class-sets")
    first = pairs.join(made.select(F.col("cls").alias("a"), F.col("members").alias("one")), "a")
    both = first.join(made.select(F.col("cls").alias("b"), F.col("members").alias("two")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, one, two in zip(*(batch.column(c) for c in ("a", "b", "one", "two"))):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (one, two))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= rule.percent * (len(x) + len(y) - common):
                    out.append((a.as_py(), b.as_py()))
            yield _batch(out, PAIRS)

    return both.select("a", "b", "one", "two").mapInArrow(compare, PAIRS)


def _differ(left: str, right: str):
    """How many bits two signatures differ in."""
    words = [
        F.bit_count(F.conv(F.hex(F.substring(left, k, 4)), 16, 10).cast("bigint").bitwiseXOR(F.conv(F.hex(F.substring(right, k, 4)), 16, 10).cast("bigint")))
        for k in range(1, SIGNED // 8 + 1, 4)
    ]
    return sum(words[1:], words[0])


def _expanded(pairs: DataFrame, members: DataFrame, rule: Rule, crossing: bool) -> DataFrame:
    """Pairs of classes from pairs of groups; ``members`` has grp, cls, n, sig and comp."""
    sides = [members.select(*(F.col(c).alias(f"{c}_{s}") for c in ("grp", "cls", "n", "sig", "comp"))) for s in "ab"]
    joined = pairs.join(sides[0], F.col("a") == F.col("grp_a")).join(
        sides[1], (F.col("b") == F.col("grp_b")) & ((F.col("comp_a") != F.col("comp_b")) if crossing else F.lit(True))
    )
    both = F.col("n_a") + F.col("n_b")
    common = F.ceil(F.lit(rule.percent) * both / F.lit(100 + rule.percent) - F.lit(1e-9))
    near = joined.where(_differ("sig_a", "sig_b") <= both - 2 * common)
    return near.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b"))


def classes(documents: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, n, cls: null without words) and the component of every linked class."""
    spark = documents.sparkSession

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for some in text_slices(batch, "text"):
            yield np.concatenate(shingle_sets(some.column("text"), rule.shingle))

    found = spark.sparkContext.broadcast(levels(documents.select("text"), hashes, LEVEL_CELLS))
    sets = stored(_sets(documents, rule, found), "sets")
    groups = stored(_groups(sets), "groups")

    def tokens(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield _prefixes(batch)[0]

    many = groups.agg(F.sum(F.length("prefix"))).first()[0] or 0
    bits = spark.sparkContext.broadcast(repeated(groups, tokens, power_of_two(many, 1 << 20, 1 << 30)))
    postings = stored(_postings(groups, bits), "postings")
    mixed = groups.where("cls IS NULL").select("grp")
    members = stored(
        sets.where("prefix IS NOT NULL").groupBy("cls").agg(F.first("grp").alias("grp"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("wide").alias("wide")),
        "members",
    )
    inner = members.join(mixed, "grp", "left_semi").select(
        F.col("grp").alias("bucket"), F.col("cls").alias("entry"), "n", F.lit(0).alias("pos"), "sig", F.lit(None).cast("bigint").alias("comp")
    )
    inner = stored(inner, "inner")
    lone = members.groupBy("grp").agg(F.min("cls").alias("cls")).withColumn("comp", F.col("cls"))
    heads = lone.join(members.drop("grp"), "cls")
    outer_pairs = _expanded(_bucket_pairs(_star_blocks(postings), rule, Bucket.stars), heads, rule, False)
    candidates = outer_pairs.unionByName(_bucket_pairs(_star_blocks(inner), rule, Bucket.stars)).distinct()
    links = stored(_verified(documents, candidates, members, rule), "verified")
    roots = components(links).withColumnsRenamed({"node": "cls", "root": "comp"})

    placed = stored(members.join(roots, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "placed")
    sides = placed.select("grp", "comp").distinct()
    crossing = postings.drop("comp").join(sides, F.col("entry") == F.col("grp")).drop("grp")
    inside_groups = inner.drop("comp").join(placed.select("cls", "comp"), F.col("entry") == F.col("cls")).drop("cls")
    outer_pairs = _expanded(_bucket_pairs(_crossing_blocks(crossing), rule, Bucket.crossing), placed, rule, True)
    candidates = outer_pairs.unionByName(_bucket_pairs(_crossing_blocks(inside_groups), rule, Bucket.crossing)).distinct()
    more = stored(_verified(documents, candidates, members, rule), "verified")
    return sets.select("doc_id", "n", "cls"), components(links.unionByName(more)).withColumnsRenamed({"node": "cls", "root": "comp"})


def linked_documents(documents: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """Every document once per row: doc_id, n_shingles (long), component_id (smallest doc_id reachable).

    Words are lower-cased in A-Z. A text of fewer words than a shingle is one shingle; one without words, or
    null, has none, links with nothing and keeps its own id. Equal rows link with each other. A null doc_id
    does not count for component_id unless the component has no other. An empty table gives an empty one.
    """
    rows, roots = classes(documents, Rule(shingle, percent))
    kept = rows.where("cls IS NOT NULL")
    firsts = kept.groupBy("cls").agg(F.min("doc_id").alias("first"))
    placed = firsts.join(roots, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = placed.groupBy("comp").agg(F.min("first").alias("least"))
    ids = placed.join(least, "comp").select("cls", F.col("least").alias("component_id"))
    found = kept.join(ids, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(rows.where("cls IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest doc_id stays.

    A null doc_id comes first. Of rows that are equal in all columns one stays; of linked rows with the same
    doc_id the one with the smallest hash. Rows without words link with nothing and stay, repeated ones too.
    All columns pass. Rows are known by a hash of their columns, so that no text is written.
    """
    own = documents.drop("_row", "_turn")
    rows = own.withColumn("_row", F.xxhash64(*own.columns))
    found, roots = classes(rows.select(F.col("_row").alias("doc_id"), "text"), Rule(shingle, percent))
    keys = rows.select("_row", "doc_id").distinct().join(
        found.where("cls IS NOT NULL").select(F.col("doc_id").alias("_row"), "cls").distinct(), "_row"
    )
    first = keys.groupBy("cls").agg(F.min(F.struct("doc_id", "_row")).alias("first"))
    placed = first.join(roots, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    best = placed.groupBy("comp").agg(F.min("first").alias("best"))
    kept = placed.join(best, "comp").select("cls", F.col("best")["_row"].alias("kept"))
    dropped = keys.join(kept, "cls").where(F.col("_row") != F.col("kept")).select("_row")
    single = found.where("cls IS NOT NULL").groupBy(F.col("doc_id").alias("_row")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    fate = stored(dropped.select("_row", F.lit(0).alias("_turn")).union(single.select("_row", F.lit(1))).groupBy("_row").agg(F.min("_turn").alias("_turn")), "fate")
    judged = rows.join(fate, "_row", "left")
    alone = judged.where("_turn IS NULL").select(own.columns)
    once = rows.join(fate.where("_turn = 1"), "_row", "left_semi").dropDuplicates(["_row"]).select(own.columns)
    return alone.unionByName(once)
