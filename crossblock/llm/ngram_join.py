"""N-gram Jaccard join with set-relation skipping.

A document's set holds the hashes of its word n-grams. Two documents link when the Jaccard
similarity of their sets reaches a ratio; linked documents form components.

Equal sets are one set from the start. Sets are posted under their rarest n-grams, as many as a
linked set must share one of; rarity comes from counts over all documents, hashed to a fixed
number of slots (the order only has to be the same everywhere). An index list is sorted into
blocks of equal size and position. Size and position bound what two blocks can still have in
common, so whole pairs of blocks are skipped; sets of blocks that are not go to the same
candidate group.

Counts by slot tell rare n-grams of a large corpus badly, so sets meet in lists by chance and more
of them the larger the corpus is, until they are all one group. So a set is also posted under
every n-gram of the rarest slots. There a list of one set means that no other set has that n-gram,
and a set with enough of those links with nothing and leaves all lists, by which others are left
alone; this is repeated while it takes much away.

Inside a group the exact overlaps of one set with all others are counted from
an inverted index, and the answers of a set that is highly similar to one already answered are
derived from that one's by the n-grams in which they differ. Members of the component of the
first set answered need no answer of their own: every pair that leaves it is seen from outside.

Index lists that are long are salted, their blocks meeting in a second round. Groups with more
than BLOCK_TOKENS n-grams are divided by equal parts of their sets. In those that stay large all
sets are held against a few pivots, and the largest component that these links make needs no
pairs of its own, as in a small group. The rest is cut into blocks that meet each other and those
of that component, so a set is sent once per block of the rest and not of the group.

Missing and empty texts have an empty set and link with nothing. Repeated rows and copies have
equal sets and are linked. Ties need no rule. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossblock.llm.arrays import Chunk, chunks, mix, word_hashes, words
from crossblock.llm.components import components
from crossblock.operators.lookup import sized_lookup
from crossblock.session import cut

#: Slots that n-grams are counted in, and the rows they travel in.
SLOT_BITS, SLICES = 22, 64
#: n-grams that all sets which have them are posted under, as a multiple of the share that a prefix takes.
WITNESSES = 1.5
#: Postings of an index list that one task sorts, about; n-grams of a block of a group.
LIST_ROWS, BLOCK_TOKENS = 100_000, 1_000_000
#: Documents up to which their keys are broadcast to fetch their texts again.
BROADCAST_KEYS = 200_000
#: Parts that may be empty where a large group is divided by parts.
SPARE_PARTS = 2
#: Sets whose answers others are derived from, in one group; sets that a large group is held against.
LEADERS, PIVOTS = 32, 8
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


@dataclass(frozen=True)
class Rule:
    """Sets of `width`-word n-grams link when part * union <= whole * intersection."""

    width: int = 3
    part: int = 9
    whole: int = 10

    def prefix(self, n: int) -> int:
        """n-grams of a set of n of which a linked set has at least one."""
        return n - -(-self.part * n // self.whole) + 1

    def enough(self, common: np.ndarray, total: np.ndarray) -> np.ndarray:
        """If an intersection of `common` is enough for sets of `total` n-grams together."""
        return (self.part + self.whole) * common >= self.part * total


def sets(chunk: Chunk, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text of a chunk."""
    found = words(chunk)
    hashes = word_hashes(chunk, found)
    grams = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width):
        grams += hashes[k : k + len(grams)] * _ODD[k]
    grams = mix(grams)
    for low, high in zip(found.edges[:-1].tolist(), found.edges[1:].tolist(), strict=True):
        if high - low >= width:
            yield np.unique(grams[low : high - width + 1])
        elif high > low:
            own = (hashes[low:high] * _ODD[: high - low]).sum(dtype=np.uint64)
            yield mix(np.array([own + np.uint64(high - low)], np.uint64))
        else:
            yield grams[:0]


def names(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set."""
    if not len(tokens):
        return 0, 0
    a = mix(tokens ^ _ODD[0]).sum(dtype=np.uint64)
    b = mix(tokens ^ _ODD[1]).sum(dtype=np.uint64)
    return tuple(mix(np.array([a, b], np.uint64)).view(np.int64).tolist())


def profile(docs: DataFrame, width: int, *, key: str, text: str) -> DataFrame:
    """Per document key, n, name, spare; per task SLICES rows (slice, counts) of n-gram counts."""
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    fields = ["key", "n", "name", "spare", "slice", "counts"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.uint32)
        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            for chunk in chunks(batch.column(1)):
                every = list(sets(chunk, width))
                np.add.at(total, np.concatenate(every) >> np.uint64(64 - SLOT_BITS), np.uint32(1))
                named = [names(t) for t in every]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, chunk.n),
                        pa.array([len(t) for t in every], pa.int64()),
                        pa.array([x[0] for x in named], pa.int64()),
                        pa.array([x[1] for x in named], pa.int64()),
                        pa.nulls(chunk.n, pa.int32()),
                        pa.nulls(chunk.n, pa.binary()),
                    ],
                    names=fields,
                )
        if key_type is not None:
            none = [pa.nulls(SLICES, t) for t in (key_type, pa.int64(), pa.int64(), pa.int64())]
            parts = [packed(x) for x in np.split(total, SLICES)]
            yield pa.RecordBatch.from_arrays(
                [*none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=fields
            )

    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(apply, f"key {kind}, n long, name long, spare long, slice int, counts binary")


def packed(counts: np.ndarray) -> bytes:
    """Mostly small counts, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<i8").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8")


def slot_counts(profiled: DataFrame) -> np.ndarray:
    """Counts by slot over all documents: a fixed 2^SLOT_BITS numbers, summed in two steps."""

    def add(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SLOT_BITS) // SLICES, np.int64)
        for data in rows["counts"]:
            total += unpacked(data)
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "counts": [packed(total)]})

    rows = profiled.where("slice IS NOT NULL").select("slice", "counts")
    some = rows.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(64))).groupBy("slice", "part")
    once = some.applyInPandas(add, "slice int, counts binary")
    whole = once.groupBy("slice").applyInPandas(add, "slice int, counts binary")
    total = np.zeros((SLICES, (1 << SLOT_BITS) // SLICES), np.uint32)
    for r in whole.collect():
        total[r["slice"]] = np.minimum(unpacked(r["counts"]), 0xFFFFFFFF)
    return total.ravel()


def named(name: np.ndarray, spare: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The name of a set, or its spare one where two sets have the first."""
    return np.where(np.isin(name, shared), spare, name) if len(shared) else name


def rarest(counts: np.ndarray, share: float) -> np.ndarray:
    """The slots that come first by count and hold this share of all n-grams at most."""
    order = np.argsort(counts, kind="stable")
    sums = np.cumsum(counts[order], dtype=np.float64)
    out = np.zeros(len(counts), bool)
    out[order[: np.searchsorted(sums, share * sums[-1], side="right")]] = True
    return out


def postings(docs: DataFrame, rule: Rule, counts: np.ndarray, shared: np.ndarray, *, text: str,
             list_rows: int) -> DataFrame:
    """(token, route, place, id, spare): each set under its rarest n-grams; place is size and position.

    A set is in the lists of its prefix and of all its n-grams of the rarest slots. Lists of the
    latter have route 0 and hold every set with their n-gram; other lists have route -1, or
    are dealt to several routes above 0 where they are long by the counts. `spare` counts the
    lists that the set is in beyond its prefix.
    """
    usual = float(np.median(counts))
    sure = rarest(counts, min(1.0, WITNESSES * (1 - rule.part / rule.whole)))
    held = docs.sparkSession.sparkContext.broadcast((counts, shared, sure))  # 2^SLOT_BITS numbers

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shared, sure = held.value
        seen: set[int] = set()  # ids of this task, so that its copies are posted once
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                out = []
                for tokens in sets(chunk, rule.width):
                    n = len(tokens)
                    if not n:
                        continue
                    first, spare = names(tokens)
                    own = int(named(np.array([first]), np.array([spare]), shared)[0])
                    if own in seen:
                        continue
                    seen.add(own)
                    slot = tokens >> np.uint64(64 - SLOT_BITS)
                    # Tokens are sorted, so equal counts keep the order of the hashes.
                    often = counts[slot]
                    # In that order the n-grams of the rarest slots come first.
                    certain, prefix = int(np.count_nonzero(sure[slot])), rule.prefix(n)
                    rare = np.argsort(often, kind="stable")[: max(certain, prefix)]
                    routes = np.maximum(1, np.ceil((often[rare] - usual) / list_rows)).astype(np.int64)
                    at = np.arange(len(rare), dtype=np.int64)
                    out.append((
                        tokens[rare].view(np.int64), routes, np.where(at < certain, 0, -1), (n << 32) + at,
                        np.full(len(rare), own, np.int64), np.full(len(rare), len(rare) - prefix, np.int64),
                    ))
                if out:
                    token, width, kind, place, ids, spare = (np.concatenate(x) for x in zip(*out, strict=True))
                    route = np.where(width > 1, 1 + (ids & 0x7FFFFFFF) % np.maximum(width, 1), kind)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(token), pa.array(route), pa.array(place), pa.array(ids), pa.array(spare)],
                        names=["token", "route", "place", "id", "spare"],
                    )

    slim = docs.select(F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(apply, "token long, route long, place long, id long, spare long")


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The columns of batches that lie in order of (token, route), cut where a list ends."""
    rest = None
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy() for i in range(batch.num_columns)])
        rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
        # The last list may go on in the next batch.
        change = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0))
        last = int(change[-1]) + 1 if len(change) else 0
        rest = rows[:, last:]
        if last:
            yield rows[:, :last]
    if rest is not None and rest.shape[1]:
        yield rest


def in_lists(rows: DataFrame) -> DataFrame:
    """Rows of one list side by side, in order of place and id."""
    return rows.repartition("token", "route").sortWithinPartitions("token", "route", "place", "id")


def met(posted: DataFrame) -> DataFrame:
    """A written table of the postings without those of n-grams that only one of these sets has."""
    fields = posted.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_lists(batches):
            first = np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))
            rows = rows[:, first | np.append(True, rows[3, 1:] != rows[3, :-1])]  # without copies of a set
            first = np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))
            alone = first & np.append(first[1:], True) & (rows[1] == 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[~alone]) for x in rows], names=fields)

    return cut(in_lists(posted).mapInArrow(apply, posted.schema))


def contenders(posted: DataFrame, rule: Rule) -> DataFrame:
    """(token, route, place, id): the prefixes of the sets that others may be linked with.

    A set that is alone in as many of its lists as its prefix has cannot share enough with
    any other. Its rows go, which may leave others alone. For the rest the n-grams that a set
    is alone with come first in the order, so fewer others are left in its prefix and their
    positions are later.
    """
    own = Window.partitionBy("id")  # as many rows as a set has n-grams, at most
    rows, before = met(posted), None
    while before is None or rows.count() * 10 < before * 9:
        before = rows.count()
        rows = met(rows.withColumn("_rows", F.count("*").over(own)).where(F.col("_rows") > F.col("spare")).drop("_rows"))
    placed = rows.withColumn("_rows", F.count("*").over(own)).withColumn("_nth", F.row_number().over(own.orderBy("place")))
    n = F.shiftright("place", 32)
    prefix = n - F.expr(f"({rule.part} * shiftright(place, 32) + {rule.whole - 1}) div {rule.whole}") + 1
    at = prefix + F.col("spare") - F.col("_rows") + F.col("_nth") - 1
    return placed.where(at < prefix).select("token", "route", (F.shiftleft(n, 32) + at).alias("place"), "id")


def block_links(places: np.ndarray, heads: np.ndarray, members: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Pairs of blocks (as indices) that join all blocks of one list that may hold linked sets.

    `places` ascend; a block stands for `members` sets. A pair (i, i) says that a block's own
    sets may be linked. A spanning forest is enough.
    """
    n = places >> 32
    cap = n - (places & 0xFFFFFFFF)  # what a set can share from this position on
    label = np.arange(len(places))
    out, joined = [], np.zeros(len(places), bool)
    for i in range(len(places)):
        able = rule.enough(np.minimum(cap[i], cap[:i]), n[i] + n[:i]) & (rule.part * n[i] <= rule.whole * n[:i])
        near = np.flatnonzero(able)
        if len(near):
            groups, at = np.unique(label[near], return_index=True)
            out += [(i, int(j)) for j in near[at]]
            joined[near] = joined[i] = True
            label[np.isin(label, groups)] = i
        if members[i] > 1 and rule.enough(cap[i], 2 * n[i]):
            joined[i] = True
    return out + [(int(i), int(i)) for i in np.flatnonzero(joined)]


def list_links(lists: np.ndarray, place: np.ndarray, ids: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all sets which may be linked by one of these whole lists.

    Rows are in order of (list, place, id); `lists` numbers the list of each.
    """
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (lists[1:] != lists[:-1]) | (ids[1:] != ids[:-1]) | (place[1:] != place[:-1])
    lists, place, ids = lists[fresh], place[fresh], ids[fresh]
    if not len(ids):
        return ids, ids
    starts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
    sizes = np.diff(np.append(starts, len(ids)))
    two = starts[sizes == 2]
    n, cap = place >> 32, (place >> 32) - (place & 0xFFFFFFFF)
    able = rule.enough(np.minimum(cap[two], cap[two + 1]), n[two] + n[two + 1]) & (
        rule.part * n[two + 1] <= rule.whole * n[two]
    )
    a, b = [ids[two[able]]], [ids[two[able] + 1]]
    for low, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        own, at = ids[low : low + size], place[low : low + size]
        edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(edge, size))
        for i, j in block_links(at[edge], own[edge], count, rule):
            if i == j:
                a.append(np.full(count[i] - 1, own[edge[i]]))
                b.append(own[edge[i] + 1 : edge[i] + count[i]])
            else:
                a.append(own[edge[i] : edge[i] + 1])
                b.append(own[edge[j] : edge[j] + 1])
    return np.concatenate(a), np.concatenate(b)


def candidate_links(posted: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, token, place): links between sets that may be linked; for routed lists also the
    first set of every block (a = b), to meet the other routes' blocks by token."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["a", "b", "token", "place"]

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            token, route, place, ids = rows
            first = np.ones(len(ids), bool)
            first[1:] = (token[1:] != token[:-1]) | (route[1:] != route[:-1]) | (place[1:] != place[:-1])
            a, b = list_links(np.cumsum(np.append(False, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))), place, ids, rule)
            # Blocks that go on to meet others stay whole, whatever they met here.
            tail = ~first & (route > 0)
            own = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
            a, b = np.concatenate([a, ids[own[tail]]]), np.concatenate([b, ids[tail]])
            none = [pa.nulls(len(a), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], names=fields)
            head = first & (route > 0)
            if head.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[head]) for x in (ids, ids, token, place)], names=fields)

        for rows in whole_lists(batches):
            yield from out(rows)

    return posted.mapInArrow(apply, "a long, b long, token long, place long")


def group_links(ids: np.ndarray, tokens: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Links that join exactly the sets of one group that are connected by linked pairs."""
    m = len(ids)
    sizes = np.array([len(t) for t in tokens])
    if m == 2:
        common = len(np.intersect1d(*tokens, assume_unique=True))
        return [(int(ids[0]), int(ids[1]))] if rule.enough(common, sizes.sum()) else []
    flat = np.concatenate(tokens)
    owner = np.repeat(np.arange(m), sizes)
    values, token = np.unique(flat, return_inverse=True)
    order = np.argsort(token, kind="stable")
    lists, ends = owner[order], np.cumsum(np.bincount(token, minlength=len(values)))
    begins = np.concatenate([[0], ends[:-1]])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    of = [token[bounds[i] : bounds[i + 1]] for i in range(m)]

    def counted(which: np.ndarray) -> np.ndarray:
        """Over all sets, how many of these n-grams they have."""
        spans = ends[which] - begins[which]
        if not len(which):
            return np.zeros(m, np.int64)
        at = np.repeat(begins[which] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        return np.bincount(lists[at], minlength=m)

    parent = np.arange(m)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links: list[tuple[int, int]] = []
    leaders: list[tuple[int, np.ndarray]] = []

    def answer(i: int) -> None:
        best = max(leaders, key=lambda x: x[1][i], default=None)
        change = sizes[best[0]] + sizes[i] - 2 * best[1][i] if best else sizes[i]
        if best and change < sizes[i]:
            theirs, ours = of[best[0]], of[i]
            common = best[1] - counted(np.setdiff1d(theirs, ours, True)) + counted(np.setdiff1d(ours, theirs, True))
        else:
            common = counted(of[i])
        # Keep answers from which many others may be derived.
        if len(leaders) < LEADERS and 2 * change >= sizes[i]:
            leaders.append((i, common))
        for j in np.flatnonzero(rule.enough(common, sizes + sizes[i])).tolist():
            x, y = find(i), find(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((int(ids[i]), int(ids[j])))

    # Start with the set that shares most with all: its component needs no further answers.
    central = int(np.argmax(np.add.reduceat((ends - begins)[token], bounds[:-1]) / sizes))
    answer(central)
    for i in range(m):
        if i != central and find(i) != find(central):
            answer(i)
    return links


def exact_links(grouped: DataFrame, rule: Rule) -> DataFrame:
    """(a, b) from rows (root, i, j, id, tokens) that lie together and in order by group."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, held = None, [], []

        def done() -> pa.RecordBatch:
            found = group_links(np.array(ids), held, rule) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"]
            )

        for batch in batches:
            marks = zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True)
            for r, (root, i, j, own) in enumerate(marks):
                if group != (root, i, j):
                    if len(ids) > 1:
                        yield done()
                    group, ids, held = (root, i, j), [], []
                if not ids or ids[-1] != own:  # copies of a set lie side by side
                    ids.append(own)
                    held.append(np.frombuffer(batch.column(4)[r].as_py(), "<u8"))
        if len(ids) > 1:
            yield done()

    return grouped.mapInArrow(apply, "a long, b long")


def tokens_of(docs: DataFrame, rule: Rule, shared: np.ndarray) -> DataFrame:
    """(root, blocks, id, n-grams as binary) of rows (root, blocks, id, text) whose text has that id."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2).to_numpy()
            for chunk in chunks(batch.column(3)):
                every = list(sets(chunk, rule.width))
                both = np.array([names(t) for t in every], np.int64).reshape(-1, 2)
                own = named(both[:, 0], both[:, 1], shared)
                right = pa.array(own == wanted[chunk.first : chunk.first + chunk.n])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(chunk.first, chunk.n) for k in range(3)]
                    + [pa.array([t.astype("<u8").tobytes() for t in every], pa.binary())],
                    names=["root", "blocks", "id", "tokens"],
                ).filter(right)

    return docs.select("root", "blocks", "id", "text").mapInArrow(
        apply, "root long, blocks int, id long, tokens binary"
    )


def linked_components(docs: DataFrame, rule: Rule = Rule(), *, key: str = "doc_id", text: str = "text",
                      list_rows: int = LIST_ROWS, block_tokens: int = BLOCK_TOKENS,
                      broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Per document key, n (size of its set) and component (smallest key linked to it).

    Texts are read three times: to name and count, to post, and for sets with a candidate
    once more; only names and postings are shuffled.
    """
    profiled = cut(profile(docs, rule.width, key=key, text=text))
    counts = slot_counts(profiled)
    whole = profiled.where("slice IS NULL")
    # Names of 64 bits that two sets share: a handful even in a corpus of 10^10 texts.
    twice = whole.where("n > 0").groupBy("name").agg(F.min("spare").alias("x"), F.max("spare").alias("y")).where("x <> y")
    shared = np.array([r["name"] for r in twice.select("name").collect()], np.int64)

    def id_of() -> Column:
        if not len(shared):
            return F.col("name")
        return F.when(F.col("name").isin(*shared.tolist()), F.col("spare")).otherwise(F.col("name"))

    headers = whole.select("key", "n", F.when(F.col("n") > 0, id_of()).alias("id"))
    classes = cut(
        headers.where("id IS NOT NULL")
        .groupBy("id")
        .agg(F.min("key").alias("first"), F.first("n").alias("n"), F.count("*").alias("rows"))
    )
    posted = postings(docs, rule, counts, shared, text=text, list_rows=list_rows)
    candidates = cut(candidate_links(in_lists(contenders(posted, rule)), rule))
    links = candidates.where("token IS NULL").select("a", "b")
    if counts.max() - np.median(counts) > list_rows:
        heads = candidates.where("token IS NOT NULL").select(
            "token", F.lit(0).cast("long").alias("route"), "place", F.col("a").alias("id")
        )
        again = heads.repartition("token").sortWithinPartitions("token", "place", "id")
        links = links.unionByName(candidate_links(again, rule).select("a", "b"))
    groups = components(links)
    joined, stars = _grouped(docs, groups, classes, rule, shared, key, text, block_tokens, broadcast_keys)
    found = exact_links(joined, rule)
    roots = components(found if stars is None else found.unionByName(stars))
    rooted = cut(
        classes.join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select("id", "first", "rows", F.coalesce("root", "id").alias("root"))
    )
    smallest = cut(rooted.groupBy("root").agg(F.min("first").alias("component"), F.sum("rows").alias("size")))
    placed = cut(sized_lookup(rooted.select("id", "rows", "root"), smallest, ["root"], "size").select("id", "rows", "component"))
    return sized_lookup(headers, placed, ["id"], "rows").select(
        "key", "n", F.when(F.col("id").isNull(), F.col("key")).otherwise(F.col("component")).alias("component")
    )


def with_blocks(roots: DataFrame, sizes: DataFrame, block_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: roots (id, root) with the blocks of their group, and the groups."""
    sized = cut(roots.join(sizes, "id"))
    groups = cut(
        sized.groupBy("root").agg(F.sum("n").alias("tokens"), F.count("*").alias("sets"))
        .withColumn("blocks", F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("int"))
    )
    placed = sized_lookup(sized, groups.select("root", "blocks", "sets"), ["root"], "sets")
    return cut(placed.select("id", "root", "blocks", "first")), groups


def part_names(held: DataFrame, rule: Rule) -> DataFrame:
    """(name, id): names of the parts of each set, of which linked sets of a group have one in common.

    Sets are in classes of sizes within the rule's ratio, and a linked pair is in one class or
    in two next to each other. For both, the n-grams are dealt to more parts than a linked pair
    can differ in, by the pigeonhole principle leaving an equal part. SPARE_PARTS parts may be
    empty; a set with more empty ones has a name for that as well.
    """
    ratio = rule.part / rule.whole

    def named_parts(tokens: np.ndarray) -> np.ndarray:
        own, out = int(np.floor(np.log(len(tokens)) / -np.log(ratio) + 1e-9)), []
        for scope in (own - 1, own):
            largest = int(np.ceil(ratio ** -(scope + 2)))
            # Sizes up to `largest` twice, less twice what they must share.
            differ = 2 * largest * (rule.whole - rule.part) // (rule.whole + rule.part) + 1
            parts = differ + 1 + SPARE_PARTS
            part = tokens % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            begin = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
            sums = np.add.reduceat(mix(tokens[order] ^ _ODD[2]), begin)
            salt = np.uint64((scope + 1000) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(sums + mix(part[order][begin] + salt)))
            if parts - len(begin) > SPARE_PARTS:
                out.append(mix(np.array([salt], np.uint64)))
        return np.concatenate(out)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, roots = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            for i in range(batch.num_rows):
                found = mix(named_parts(np.frombuffer(batch.column(1)[i].as_py(), "<u8")) ^ roots[i]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.full(len(found), ids[i]))], names=["name", "id"]
                )

    return held.select("id", "tokens", "root").mapInArrow(apply, "name long, id long")


def finer(held: DataFrame, rule: Rule) -> DataFrame:
    """(id, root) of the sets that share a part with another one; the rest link with nothing."""
    parts = cut(part_names(held, rule))
    heads = cut(parts.groupBy("name").agg(F.min("id").alias("head"), F.count("*").alias("rows")).where("rows > 1"))
    links = sized_lookup(parts, heads, ["name"], "rows").where("head IS NOT NULL")
    return components(links.select(F.col("head").alias("a"), F.col("id").alias("b"))).withColumnRenamed("node", "id")


def star_links(held: DataFrame, groups: DataFrame, rule: Rule) -> DataFrame:
    """A written table (a, b) of the links of PIVOTS sets of each group with all sets of the group.

    held: (root, id, tokens); groups: (root, sets).
    """
    first = Window.partitionBy("root").orderBy(F.xxhash64("id"), "id")
    chosen = held.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= PIVOTS)
    pivots = chosen.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("id", "tokens"))).alias("pivots"))
    table = cut(groups.join(pivots, "root").select("root", "pivots", "sets"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for own, mine, against in zip(*[batch.column(k) for k in range(3)], strict=True):
                one = np.frombuffer(mine.as_py(), "<u8")
                for pivot in against.as_py():
                    other = np.frombuffer(pivot["tokens"], "<u8")
                    if pivot["id"] == own.as_py():
                        continue
                    common = len(np.intersect1d(one, other, assume_unique=True))
                    if rule.enough(np.array(common), np.array(len(one) + len(other))):
                        links.append((pivot["id"], own.as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"]
            )

    met = sized_lookup(held, table, ["root"], "sets").select("id", "tokens", "pivots")
    return cut(met.mapInArrow(apply, "a long, b long"))


def _meeting(held: DataFrame, stars: DataFrame, sizes: DataFrame, block_tokens: int) -> DataFrame:
    """Rows (root, i, j, id, tokens) of the pairs of blocks in which sets of large groups meet.

    A set outside of its group's largest star component meets all blocks, one inside only the
    blocks outside. held: (root, id, tokens).
    """
    members = cut(held.select("root", "id").join(sizes.select("id", "n"), "id").join(
        components(stars).withColumnRenamed("root", "star").withColumnRenamed("node", "id"), "id", "left"
    ))
    stars_of = members.where("star IS NOT NULL").groupBy("root", "star").agg(F.count("*").alias("k"))
    inner = stars_of.groupBy("root").agg(F.max_by("star", F.struct("k", "star")).alias("_inner"))
    groups = members.groupBy("root").agg(F.count("*").alias("sets")).join(inner, "root", "left")
    marked = sized_lookup(members, cut(groups), ["root"], "sets").withColumn(
        "inside", F.coalesce(F.col("star") == F.col("_inner"), F.lit(False))
    )
    marked = cut(marked.select("root", "id", "n", "inside"))
    blocks = [
        F.ceil(F.coalesce(F.sum(F.when(F.col("inside") == side, F.col("n"))), F.lit(0)) / F.lit(block_tokens)).cast("int").alias(name)
        for name, side in (("outer", False), ("inner", True))
    ]
    counts = cut(marked.groupBy("root").agg(*blocks, F.count("*").alias("sets")))
    placed = sized_lookup(marked, counts, ["root"], "sets").where("NOT inside OR outer > 0")
    own = F.when(F.col("inside"), F.col("outer") + F.pmod(F.xxhash64("id"), F.col("inner"))).otherwise(
        F.pmod(F.xxhash64("id"), F.col("outer"))
    ).cast("int")
    others = F.when(F.col("inside"), F.col("outer")).otherwise(F.col("outer") + F.col("inner"))
    pairs = F.transform(
        F.sequence(F.lit(0), others - 1),
        lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")),
    )
    spread = placed.withColumn("own", own).select("id", "root", F.explode(pairs).alias("at"))
    return held.select("id", "tokens").join(spread, "id").select("root", "at.i", "at.j", "id", "tokens")


def _grouped(docs: DataFrame, groups: DataFrame, classes: DataFrame, rule: Rule, shared: np.ndarray,
             key: str, text: str, block_tokens: int, broadcast_keys: int) -> tuple[DataFrame, DataFrame | None]:
    """The sets of every candidate group, a row for each pair of blocks that a set belongs to.

    Groups of more than one block are first divided by the parts that their sets share; with
    what stays large come links that are known already.
    """
    sizes = classes.select("id", "first", "n")
    wanted, totals = with_blocks(groups.withColumnRenamed("node", "id"), sizes, block_tokens)

    def fetched(some: DataFrame) -> DataFrame:
        keyed = some.withColumnRenamed("first", "_first")
        here = docs.select(F.col(key).alias("first"), F.col(text).cast("string").alias("text"))
        few = some.count() <= broadcast_keys
        # A missing key is a key like others.
        found = here.join(F.broadcast(keyed) if few else keyed, F.col("first").eqNullSafe(F.col("_first")))
        return tokens_of(found, rule, shared)

    def alone(held: DataFrame) -> DataFrame:
        nought = F.lit(0)
        return held.select("root", nought.alias("i"), nought.alias("j"), "id", "tokens")

    stars = None
    if totals.where("blocks > 1").isEmpty():
        flat = alone(fetched(wanted))
    else:
        large = cut(fetched(wanted.where("blocks > 1")).select("root", "id", "tokens").dropDuplicates(["id"]))
        again, parts = with_blocks(finer(large, rule), sizes, block_tokens)
        large = large.drop("root")
        flat = alone(fetched(wanted.where("blocks = 1")))
        flat = flat.unionByName(alone(large.join(again.where("blocks = 1").select("id", "root"), "id")))
        if not parts.where("blocks > 1").isEmpty():
            held = cut(large.join(again.where("blocks > 1").select("id", "root"), "id"))
            stars = star_links(held, parts.where("blocks > 1").select("root", "sets"), rule)
            flat = flat.unionByName(_meeting(held, stars, sizes, block_tokens))
    return flat.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "id"), stars


def representatives(docs: DataFrame, rule: Rule, *, key: str = "doc_id", text: str = "text",
                    broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of `docs` without all but one of every component: that with the smallest key.

    Of equal keys the one whose text has the smallest hash stays, and of repeated rows one.
    Texts without a word are linked with nothing and stay.
    """
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("hash")).alias("_own"),
        F.col(text).alias("_text"),
    )
    found = linked_components(marked, rule, key="_own", text="_text", broadcast_keys=broadcast_keys)
    linked = cut(found.where("n > 0"))
    gone = cut(linked.where("key <> component").select("key").distinct())
    again = cut(linked.where("key = component").groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"))
    gone = F.broadcast(gone) if gone.count() <= broadcast_keys else gone
    kept = marked.join(gone, F.col("_own") == F.col("key"), "left_anti")
    if not again.isEmpty():
        repeated = F.col("_own") == F.col("key")
        once = kept.join(again, repeated, "left_semi").dropDuplicates(["_own"])
        kept = kept.join(again, repeated, "left_anti").unionByName(once)
    return kept.select("row.*")
