"""Best-fit packing with certified partitions.

Texts become token pieces of at most one sequence. Pieces are dealt to partitions of bounded
size by hash, and each partition is packed best-fit decreasing. A lower bound from dual
feasible functions certifies partitions whose sequence count cannot be beaten. Partitions with
a gap give up the sequences that are not nearly full; the pieces of all of them are dealt anew,
so that documents change partitions, and packed again. A round counts if it needs fewer
sequences than before, else it is undone and the packing stands.

Missing and empty texts are the end id alone. Repeated rows are packed one by one; ties go by
key and piece. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossblock.session import cut

CAPACITY, END_ID = 2048, 0
#: Pieces of one partition, about; free tokens from which a sequence counts as not nearly full.
PART_ROWS, LOOSE, ROUNDS = 32_768, 8, 3
#: A string that the tokenizer file maps to one id wherever it stands.
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, fill long, part long, bins long, bound long"


@cache
def encoder(path: str):
    """text -> ids of the tokenizer file at `path`.

    The merges run in tiktoken, built from the file's own vocabulary, which gives the same ids
    about five times as fast. Texts that hold the special string or a character outside the
    ranges where both libraries know the same letters go through tokenizers itself.
    """
    import json
    import re

    import tiktoken
    from tokenizers import Tokenizer, pre_tokenizers

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    # The file spells bytes as characters: printable ones as they are, the rest from U+0100 on.
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    spelt = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    assert set(spelt) == set(pre_tokenizers.ByteLevel.alphabet())
    ranks = {bytes(spelt[c] for c in token): i for token, i in vocab.items() if token != SPECIAL}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    unsure = re.compile(r"[^\u0000-\u0377\u2010-\u2027\u2030-\u205e\u20a0-\u20ac]|" + re.escape(SPECIAL))

    def encode(text: str) -> list[int]:
        if unsure.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, and the first the rest."""
    first = length - (-(-length // capacity) - 1) * capacity
    return [(0, first), *[(s, capacity) for s in range(first, length, capacity)]]


def pieces(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece; `keep_ids` adds the ids as little-endian unsigned 32-bit binary."""
    columns = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * keep_ids

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode(content or ""), END_ID], dtype="<u4")
                for i, (start, length) in enumerate(cuts(len(ids), capacity)):
                    data = ids[start : start + length].tobytes()
                    rows.append((doc, i, start, length, zlib.crc32(data), data)[: len(columns)])
            out = pd.DataFrame(rows, columns=columns)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInPandas(split, PIECES + ", ids binary" * keep_ids)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that no packing of these lengths can go below.

    For every a up to half the capacity the function that lifts lengths above capacity - a to
    the whole, drops those below a and keeps the others is dual feasible; the best one counts.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    below = np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])  # sum of lengths < i
    fewer = np.concatenate([[0], np.cumsum(count)])
    a = np.arange(0, capacity // 2 + 1)
    large = len(lengths) - fewer[capacity - a + 1]
    middle = below[capacity - a + 1] - below[a]
    return int((large + -(-middle // capacity)).max())


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, longest first, each into the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms, used = 0, 0  # rooms: bit r is set when a bin has room r
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            chosen = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, chosen, used = capacity, used, used + 1
        bins[i], offsets[i] = chosen, capacity - room
        left = room - n
        if left:
            if not free[left]:
                rooms |= 1 << left
            free[left].append(chosen)
    return bins, offsets, used


def _round(rows: DataFrame, number: int, n: int, capacity: int, part_rows: int) -> DataFrame:
    """Deal the rows to partitions anew and pack each."""
    parts = max(1, -(-n // part_rows))

    def fill(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
        lengths = items["length"].to_numpy()
        bins, offsets, used = best_fit(lengths, capacity)
        filled = np.bincount(bins, weights=lengths, minlength=used).astype(np.int64)
        out = items[[c.split()[0] for c in PIECES.split(", ")]].copy()
        # Room for 2^20 sequences in a partition and 2^24 partitions in a round.
        out["sequence_id"] = (number * 2**24 + key[0]) * 2**20 + bins
        out["offset"], out["fill"] = offsets, filled[bins]
        out["part"], out["bins"], out["bound"] = key[0], used, lower_bound(lengths, capacity)
        return out

    spread = F.pmod(F.xxhash64(F.lit(number), "doc_id", "piece", "ids_crc32"), F.lit(parts))
    names = [c.split()[0] for c in PIECES.split(", ")]
    return cut(rows.select(*names, spread.alias("part")).groupBy("part").applyInPandas(fill, PACKED))


def pack(items: DataFrame, *, capacity: int = CAPACITY, part_rows: int = PART_ROWS,
         rounds: int = ROUNDS, loose: int = LOOSE) -> DataFrame:
    """Pieces with sequence_id and offset.

    `bins` and `bound` are those of the partition when it was packed; an exchange may since have
    taken sequences from it. Exchange ends after `rounds` rounds, also where gaps remain.
    """
    whole = _round(items, 0, items.count(), capacity, part_rows)
    for number in range(1, rounds + 1):
        open_ = (F.col("bins") > F.col("bound")) & (F.col("fill") <= capacity - loose)
        before = whole.where(open_).agg(
            F.count("*").alias("rows"),
            F.sum(F.when(F.col("offset") == 0, 1)).alias("sequences"),
        ).first()
        if not before["rows"]:
            break
        again = _round(whole.where(open_), number, before["rows"], capacity, part_rows)
        after = again.where("offset = 0").count()
        if after >= before["sequences"]:
            break
        whole = cut(whole.where(~open_).unionByName(again))
    return whole


def sequences(packed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """The ids of every sequence, from `pieces(..., keep_ids=True)`; a sequence has a bounded length."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    held = with_ids.dropDuplicates(names).select(*[F.col(c).alias(f"_{c}") for c in names], "ids")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = packed.join(held, same).select("sequence_id", F.struct("offset", "ids").alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list("at")), lambda x: x["ids"])
    return placed.groupBy("sequence_id").agg(ordered.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids")
    )
