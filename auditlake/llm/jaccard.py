"""Exact Jaccard join on word shingles by prefix filters, moved to a leader where texts are alike.

Two sets of similarity t share a token among the first n - ceil(t n) + 1 of each
under any global order of tokens.  Candidates come from shared prefix tokens
(common tokens last, so that boilerplate stays out of the prefixes); the counts
of tokens by cell have to allow the similarity before sets are compared.

Documents with one shingle set are one class with a number of its own, since
rows of one doc_id may differ in text and so be in several classes.  A group of
classes that share a token is not expanded into pairs: each class is first
compared with the group's leader, the one with the commonest prefix tokens.
Groups are also split by set size, since sets of very different sizes can't be
similar.

Groups that still hold several components are moved to their leader b: a set x
becomes the symmetric difference D(x) of x and b.  That leaves the difference of
any two sets as it is, and what a family of copies has in common is gone.  Two
sets are similar if and only if their difference is at most
h = (1 - t) / (1 + t) * (n(x) + n(y)), so D(x) and D(y) share at least
(d(x) + d(y) - h) / 2 tokens.  That is above 0 unless both are similar to b, and
gives prefixes of D, whose groups are joined with themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, arrow_map, discard, slices, slim, stored, texts, trimmed
from .graph import components
from .shingles import Sets, mix

#: Groups up to this size are joined with themselves; sizes and positions are tested inside the join.
SMALL = 8
#: Least and most cells by which the tokens of a set are counted for the filter before the exact test.
CELLS, MOST_CELLS = 32, 2048
#: A cell counts at most this many tokens: cut counts differ by no more than whole ones.
FULL = 127
#: Rows compared with one leader in one task.
SALT_ROWS = 64
#: Tokens that the orders know to be common, and the cells of the table that holds their levels; others count as equally rare.
COMMON_TOKENS, LEVEL_BITS = 1 << 22, 24
#: A task counts tokens over stretches of about this many and reports those that occur twice or more.
COUNTED_TOKENS = 1 << 21
#: Bytes of text that are cut into shingles at once.
TEXT_BYTES = 2 << 20

_SALT = np.uint64(0x9E3779B97F4A7C15)


def prefix_size(n: int, percent: int) -> int:
    """Tokens of a set of n of which a set of at least ``percent`` similarity shares one."""
    return n - -(-percent * n // 100) + 1 if n else 0


def shared_at_least(n: int, d: int, leader_n: int, far: bool, percent: int) -> int:
    """Tokens that D of a set of n, d tokens off its leader, shares with D of any similar set; one of the two is not similar to the leader.

    ``far``: this one is not.  Then a partner of any kind counts, whose D holds
    the shared tokens: d - h.  A set similar to the leader has only partners
    that are not, whose d is above (1 - t) / (1 + t) * (n + leader_n).
    """
    slope = (100 - percent) / (100 + percent)
    if far:
        return max(1, math.ceil(d - slope * (n + 100 * n / percent) - 1e-6))
    return max(1, math.floor((d + slope * (leader_n - n)) / 2 - 1e-6) + 1)


class Order:
    """The global token order: known common tokens last by count, then by a hash.

    It is a function of the token alone, so common tokens that meet in one cell
    and counts that are rounded change the order, not what the filter finds.
    """

    def __init__(self, halves: np.ndarray, levels: np.ndarray):
        """``halves``: upper halves of the known tokens; ``levels``: their counts on a logarithmic scale."""
        self.levels = np.zeros(1 << LEVEL_BITS, np.uint8)
        np.maximum.at(self.levels, halves >> np.uint32(32 - LEVEL_BITS), levels)

    def level(self, tokens: np.ndarray) -> np.ndarray:
        return self.levels[tokens >> np.uint64(64 - LEVEL_BITS)]

    @staticmethod
    def first(tokens: np.ndarray, level: np.ndarray, size: int) -> tuple[np.ndarray, int]:
        """The first ``size`` of distinct tokens of these levels, and their mean level."""
        rank = level.astype(np.uint64) << np.uint64(56) | mix(tokens ^ _SALT) >> np.uint64(8)
        at = np.argpartition(rank, size - 1)[:size] if size < len(tokens) else np.arange(len(tokens))
        at = at[np.argsort(rank[at])]
        return tokens[at], int(level[at].mean()) if len(at) else 0

    def moved(self, tokens: np.ndarray) -> np.ndarray:
        """Levels of a leader's tokens after the move, about: those are found where a set of its family lacks them."""
        level = self.level(tokens).astype(float)
        family = 2 ** (level.max() / 8)
        return np.minimum(8 * np.log2(np.maximum(family - 2 ** (level / 8), 1 + family / 32)), 255).astype(np.uint8)


def _common_tokens(seen: DataFrame) -> Order:
    """An order that knows the most frequent tokens: at most ``COMMON_TOKENS``, five bytes each, reach the driver.

    A histogram of counts gives the smallest count whose tokens are few enough;
    they come packed, a few large rows in all.
    """
    counts = stored(seen.groupBy("token").agg(F.least(F.sum("n"), F.lit((1 << 31) - 1)).cast("int").alias("n")), "jaccard-counts")
    steps = counts.groupBy(F.least("n", F.lit(1 << 12)).alias("n")).agg(F.count("*").alias("tokens")).collect()
    least, total = (1 << 12) + 1, 0
    for step in sorted(steps, key=lambda r: -r.n):
        total += step.tokens
        if total > COMMON_TOKENS:
            break
        least = step.n

    def pack(batches):
        for batch in batches:
            half = (batch.column("token").to_numpy().view(np.uint64) >> np.uint64(32)).astype("<u4")
            level = np.minimum(8 * np.log2(batch.column("n").to_numpy()), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([half.tobytes()], pa.binary()), pa.array([level.tobytes()], pa.binary())], ["token", "level"])

    packed = counts.where(F.col("n") >= least).mapInArrow(pack, "token binary, level binary").collect()
    discard(counts)
    return Order(np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(bytes(r.token), "<u4") for r in packed)]), np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(bytes(r.level), np.uint8) for r in packed)]))


def by_cell(tokens: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens lie in each cell, ``FULL`` at most; cells of adjacent numbers make one of a smaller set.

    Unrelated sets of n tokens differ by about 1.1 sqrt(n cells), similar ones by
    at most 2 n (1 - t) / (1 + t), so the cells grow with the size.
    """
    wanted = len(tokens) * (4 * (100 - percent) / (100 + percent)) ** 2
    bits = min(max(math.ceil(math.log2(max(wanted, 1))), CELLS.bit_length() - 1), MOST_CELLS.bit_length() - 1)
    return np.minimum(np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), FULL)


def _apart(one: str, other: str) -> Column:
    """The sum of the differences by cell of two columns of cells, in as many as the smaller has."""
    least = F.least(F.size(one), F.size(other))

    def merged(name: str) -> Column:
        width = (F.size(name) / least).cast("int")
        added = F.transform(F.sequence(F.lit(0), least - 1), lambda i: F.least(F.aggregate(F.slice(name, i * width + 1, width), F.lit(0), lambda total, x: total + x), F.lit(FULL)))
        return F.when(width > 1, added).otherwise(F.col(name).cast("array<int>"))

    return F.aggregate(F.zip_with(merged(one), merged(other), lambda x, y: F.abs(x - y)), F.lit(0), lambda total, x: total + x)


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)))


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which tokens of ``a`` are in ``b`` (both sorted, not empty)."""
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    shared = int(_shared(a, b).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


class JaccardJoin:
    """The join of one table."""

    def __init__(self, docs: DataFrame, words: int = 3, percent: int = 90):
        if not 0 < percent <= 100:
            raise ValueError("the similarity is a percentage above 0")
        self.words, self.percent = words, percent
        slim(docs.sparkSession)
        self.docs = texts(docs).withColumn("text_hash", F.xxhash64("text"))

        def measure(batches):
            gathered: list[np.ndarray] = []
            held = 0

            def rows(common, doc_id, n, key, text_hash) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(common, pa.bool_()), pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(text_hash, pa.int64())], ["common", "doc_id", "n", "key", "text_hash"])

            def often() -> pa.RecordBatch:
                token = np.concatenate(gathered)
                token.sort()
                edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
                count = np.diff(edges)
                token, count = token[edges[:-1][count > 1]], count[count > 1]
                return rows(np.ones(len(token), bool), token.view(np.int64), count, [None] * len(token), [None] * len(token))

            for batch in batches:
                for part in slices(batch, most=TEXT_BYTES):
                    sets = Sets(part.column("text"), words)
                    yield rows(np.zeros(len(sets), bool), part.column("doc_id"), sets.sizes, sets.keys(), part.column("text_hash"))
                    gathered.append(sets.tokens)
                    held += len(sets.tokens)
                    if held >= COUNTED_TOKENS:
                        yield often()
                        gathered, held = [], 0
            if held:
                yield often()

        measured = stored(self.docs.mapInArrow(trimmed(measure), "common boolean, doc_id long, n long, key binary, text_hash long"), "jaccard-sets")
        #: One row per document: doc_id, n, key of its shingle set (null: empty), hash of its text.
        self.sets = stored(measured.where("not common").drop("common"), "jaccard-documents")
        self.order = _common_tokens(measured.where("common").select(F.col("doc_id").alias("token"), "n"))
        discard(measured)
        #: key -> number (id) of the class, and its smallest doc_id with the hash of one of that row's texts; documents without id make no class.
        named = self.sets.where("key is not null and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
        self.classes = stored(named.select("key", "first.doc_id", "first.text_hash", F.monotonically_increasing_id().alias("id")), "jaccard-classes")

    def _measured(self) -> DataFrame:
        """id, n, weight, tokens and cells of every class: its prefix tokens in their order, their mean level, and its tokens by cell."""
        words, order, percent = self.words, self.order, self.percent

        def run(batch: pa.RecordBatch) -> dict:
            sets = Sets(batch.column("text"), words)
            seen: dict[bytes, tuple[int, int]] = {}
            for row, (doc_id, key) in enumerate(zip(batch.column("doc_id").to_pylist(), sets.keys(), strict=True)):
                if doc_id is not None and key is not None and (key not in seen or seen[key][0] > doc_id):
                    seen[key] = (doc_id, row)
            rows = [row for _, row in seen.values()]
            found = [order.first(sets[row], order.level(sets[row]), prefix_size(int(sets.sizes[row]), percent)) for row in rows]
            return {"doc_id": [i for i, _ in seen.values()], "key": list(seen), "n": sets.sizes[rows], "weight": [w for _, w in found], "tokens": _lists([t for t, _ in found], np.int64), "cells": _lists([by_cell(sets[row], percent) for row in rows], np.int8)}

        found = arrow_map(self.docs, run, "doc_id long, key binary, n long, weight int, tokens array<long>, cells array<tinyint>", most=TEXT_BYTES)
        named = found.join(self.classes.select("key", "doc_id", "id"), ["key", "doc_id"])
        return named.dropDuplicates(["key", "doc_id"]).select("id", "n", "weight", "tokens", "cells")  # repeated rows make one class

    def _dealt(self, pairs: DataFrame) -> DataFrame:
        """b, kind (0: the leader itself), id and packed text of pairs (a, b), so that a's partners stream past b.

        Rows are dealt by (b, salt): a leader with many partners is repeated for
        each salt.  Only texts of classes in the pairs are moved.
        """

        def pack(batch: pa.RecordBatch) -> dict:
            import zstandard

            pack = zstandard.ZstdCompressor(level=3).compress
            return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "text": [pack(t.as_buffer()) for t in batch.column("text")]}

        salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
        members = pairs.join(salts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.col("a").alias("id"), F.lit(1).alias("kind"))
        leaders = salts.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("b").alias("id"), F.lit(0).alias("kind"))
        dealt = stored(members.unionByName(leaders).join(self.classes.select("id", "doc_id", "text_hash"), "id"), "jaccard-dealt")
        near = KeyFilter(dealt, "doc_id", "text_hash", bits=64).possible(self.docs, "doc_id", "text_hash")
        packed = arrow_map(near, pack, "doc_id long, text_hash long, text binary", most=TEXT_BYTES).dropDuplicates(["doc_id", "text_hash"])
        rows = dealt.join(packed, ["doc_id", "text_hash"]).select("b", "salt", "kind", "id", "text")
        return rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")

    def _against(self, each, gather):
        """A function of dealt batches: ``each(id, set, leader, set)`` gives a row or None, ``gather(rows)`` a batch."""
        words = self.words

        def run(batches):
            import zstandard

            unpack = zstandard.ZstdDecompressor().decompress
            leader, tokens = None, None
            for batch in batches:
                for part in slices(batch, most=TEXT_BYTES // 4):
                    found = []
                    sets = Sets(pa.array([unpack(t.as_buffer(), max_output_size=1 << 31) for t in part.column("text")], pa.binary()), words)
                    for row, (b, number, kind) in enumerate(zip(*(part.column(c).to_pylist() for c in ("b", "id", "kind")), strict=True)):
                        if kind == 0:
                            leader, tokens = b, sets[row].copy()
                        elif leader == b:
                            found.append(each(number, sets[row], b, tokens))
                    yield gather([f for f in found if f is not None])

        return trimmed(run)

    def _verified(self, pairs: DataFrame, measured: DataFrame) -> DataFrame:
        """Pairs (a, b) whose tokens by cell allow the similarity and that pass the exact test."""
        percent = self.percent
        sketch = measured.select("id", "n", "cells")
        both = pairs.join(sketch.toDF("a", "a_n", "a_cells"), "a").join(sketch.toDF("b", "b_n", "b_cells"), "b")
        passed = stored(both.where((100 + percent) * _apart("a_cells", "b_cells").cast("long") <= (100 - percent) * (F.col("a_n") + F.col("b_n"))).select("a", "b"), "jaccard-candidates")

        def each(number, own, b, tokens):
            return (number, b) if _similar(own, tokens, percent) else None

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        links = stored(self._dealt(passed).mapInArrow(self._against(each, batch), "a long, b long"), "jaccard-links")
        discard(passed)
        return links

    def _moved(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of every a in pairs (a, b), moved to b: the links (a, b); and g, id, n, d, far and pos of the prefixes of D."""
        percent, order = self.percent, self.order

        def each(number, own, b, tokens):
            more, less = own[~_shared(own, tokens)], ~_shared(tokens, own)
            apart = np.concatenate([more, tokens[less]])
            n, d = len(own), len(apart)
            far = (100 + percent) * d > (100 - percent) * (n + len(tokens))
            size = d - shared_at_least(n, d, len(tokens), far, percent) + 1
            if size < 1:
                return number, b, n, d, far, apart[:0]
            return number, b, n, d, far, order.first(apart, np.concatenate([order.level(more), order.moved(tokens)[less]]), size)[0]

        names = ["id", "b", "n", "d", "far", "tokens"]

        def batch(found):
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)), _lists([x[5] for x in found], np.int64)], names)

        found = stored(self._dealt(pairs).mapInArrow(self._against(each, batch), "id long, b long, n long, d long, far boolean, tokens array<long>"), "jaccard-moved")
        rows = found.select("b", "id", "n", "d", "far", F.posexplode("tokens").alias("pos", "token"))
        return found.where("not far").select(F.col("id").alias("a"), "b"), rows.select(F.xxhash64("b", "token").alias("g"), "id", "n", "d", "far", "pos")

    def _by_size(self, rows: DataFrame) -> DataFrame:
        """Groups split by set size: each row goes to its size class and the next, so that two sets of possible sizes meet.

        A row stays only where its token can be the first that it shares with a
        partner of the class: what follows it has to hold the whole overlap.
        """
        if self.percent == 100:
            return rows.where("pos = 0").withColumn("g", F.xxhash64("g", "n"))
        width = math.log(100 / self.percent) * 1.0001  # a little wide, for rounding
        step = F.floor(F.log("n") / width)
        split = rows.withColumn("size_class", F.explode(F.array(step, step + 1)))
        least = F.greatest(F.exp((F.col("size_class") - 1) * width), F.col("n") * self.percent / 100)
        split = split.where(F.col("n") - F.col("pos") >= (F.col("n") + least) * self.percent / (100 + self.percent) - 0.001)
        return split.select(F.xxhash64("g", "size_class").alias("g"), "id", "n", "weight", "pos")

    def _close(self, one: str, other: str):
        """The sizes, and the places of the first shared token, allow the similarity of two rows (prefixes of their columns)."""
        (n, d, pos), (m, e, at) = ([F.col(f"{side}{c}") for c in ("n", "d", "pos")] for side in (one, other))
        room = F.least(d - pos, e - at)
        return (100 * F.least(n, m) >= self.percent * F.greatest(n, m)) & ((100 + self.percent) * 2 * room >= (100 + self.percent) * (d + e) - (100 - self.percent) * (n + m))

    def membership(self) -> DataFrame:
        """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every document.

        Documents without words or text are empty and alone.  A document without
        id links to nothing and has a null component.  Rows that share a doc_id
        belong to one component.  Other columns are left out; an empty table
        gives an empty one.  One row per input row.
        """
        measured = stored(self._measured(), "jaccard-prefixes")
        prefixes = measured.select(F.posexplode("tokens").alias("pos", "token"), "id", "n", "weight")
        met = stored(prefixes.groupBy("token").agg(F.count("*").alias("many")).where("many > 1").select("token"), "jaccard-groups")
        shared = KeyFilter(met, "token").possible(prefixes, "token").join(met, "token").withColumnRenamed("token", "g")
        split = stored(self._by_size(shared), "jaccard-split")
        discard(met)
        rows = stored(self._led(split.select("g", "id", "n", F.col("n").alias("d"), F.lit(True).alias("far"), "weight", "pos")), "jaccard-rows")
        discard(split)
        slim(rows.sparkSession)
        links = stored(self._verified(self._to_leader(rows), measured).unionByName(self._same_document()), "jaccard-linked")
        labels = self._remaining(rows, links, measured)
        discard(rows, measured)
        joined = self.classes.join(labels, "id").select("key", "doc_id", "component")
        least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        linked = joined.join(least, "component").select("key", "component_id")
        named = self.sets.join(self.classes.select("key", F.col("doc_id").alias("first_id")), "key", "left").join(linked, "key", "left")
        named = stored(named.select("doc_id", "n", F.coalesce("component_id", "first_id", "doc_id").alias("component_id")), "jaccard-named")
        discard(self.classes, self.sets)
        # A row without words goes with the other rows of its doc_id.
        empty = named.where("n = 0")
        other = named.join(empty.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        rows = named.where("n > 0").unionByName(empty.drop("component_id").join(other, "doc_id", "left").select("doc_id", "n", "component_id"))
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))

    def _same_document(self) -> DataFrame:
        """Links (a, b) that join the classes of the rows of one doc_id."""
        repeated = self.sets.where("key is not null and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
        rows = self.sets.where("key is not null").join(repeated, "doc_id").select("key", "lo").distinct()
        number = self.classes.select("key", "id")
        return rows.join(number.toDF("key", "a"), "key").join(number.toDF("lo", "b"), "lo").where("a <> b").select("a", "b")

    def _led(self, rows: DataFrame) -> DataFrame:
        """Adds to rows of groups of two classes or more the group's leader and size; the leader is the one of the commonest prefix."""
        lead = F.max(F.struct("weight", "id", "n", "d", "pos"))
        groups = rows.groupBy("g").agg(lead.alias("lead"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
        return rows.join(groups.select("g", F.col("lead.id").alias("leader"), *(F.col(f"lead.{c}").alias(f"leader_{c}") for c in ("n", "d", "pos")), "size"), "g")

    def _to_leader(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b) of each class and its groups' leaders whose sizes and places fit."""
        return rows.where((F.col("id") != F.col("leader")) & self._close("", "leader_")).select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()

    def _meeting(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b), a > b, of one group and two components whose sizes and places fit."""
        columns = ("id", "n", "d", "far", "pos", "component")
        mine = rows.select(F.col("g").alias("own"), *columns)
        other = rows.select("g", *(F.col(c).alias(f"b_{c}") for c in columns))
        met = (F.col("id") > F.col("b_id")) & (F.col("component") != F.col("b_component")) & (F.col("far") | F.col("b_far")) & self._close("", "b_")
        return mine.join(other, (F.col("own") == F.col("g")) & met).select(F.col("id").alias("a"), F.col("b_id").alias("b")).distinct()

    @staticmethod
    def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows, with their components, of groups of several components where a row is not similar to the leader."""
        open_ = rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = open_.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("far").alias("any_far")).where("lo <> hi and any_far").select("g")
        return stored(open_.join(mixed, "g"), "jaccard-open")

    def _remaining(self, rows: DataFrame, links: DataFrame, measured: DataFrame) -> DataFrame:
        """The components (id, component) once members of one group in different components have been compared."""
        labels = components(links)
        # The leader has been compared with all others of its group.
        open_ = self._mixed(rows.where("size > 2 and id <> leader").drop("leader_n", "leader_d", "leader_pos"), labels)
        if open_.isEmpty():
            return labels
        links = links.unionByName(self._verified(self._meeting(open_.where(F.col("size") <= SMALL)), measured))
        pairs = stored(open_.where(F.col("size") > SMALL).select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), "jaccard-pairs")
        if not pairs.isEmpty():
            near, moved = self._moved(pairs)
            links = links.unionByName(near)
            links = links.unionByName(self._verified(self._meeting(self._mixed(moved, components(links))), measured))
        return components(links)


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; see ``JaccardJoin.membership``."""
    return JaccardJoin(docs, words, percent).membership()


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns kept, with one document of each component: its smallest doc_id.

    Of rows that repeat a doc_id, which are one component, one stays, chosen by
    a hash of its text; rows without an id all stay.  Documents without words
    are alone and stay; an empty table stays empty.
    """
    found = stored(jaccard_components(docs, words, percent), "jaccard-components")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("k")).distinct()
    repeated = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    special = stored(gone.select("k", F.lit(True).alias("gone")).unionByName(repeated.select("k", F.lit(False).alias("gone"))).groupBy("k").agg(F.max("gone").alias("gone")), "jaccard-special")
    # Only rows that the filter can't rule out are moved.
    rows = KeyFilter(special, "k").marked(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("k")), "k")
    settled = rows.where("not _filter_hit or k is null").select("row")
    open_ = rows.where("_filter_hit and k is not null").join(special, "k", "left").where("not coalesce(gone, false)")
    alone = open_.where("gone is null").select("row")
    chosen = open_.where("gone is not null").groupBy("k").agg(F.min_by("row", F.xxhash64("row.text")).alias("row")).select("row")
    return settled.unionByName(alone).unionByName(chosen).select("row.*")
