"""Language-model scoring: the probability of a text over all its subword segmentations.

A text is lower-cased (A-Z) and read as words and one end. A word is spelled by pieces, the first
of which holds a word mark, and a close. Pieces are those of an existing vocabulary file and
single bytes, so every word has a segmentation; pieces that no such word holds (capital letters,
inner marks) are left out. The file's scores are ranks and give the prior weights, 1 / rank. A few
rounds of expected counts over all segmentations of the distinct training words, plus the prior as
PRIOR further pieces, turn them into probabilities of pieces and close, which sum to 1. The sum
over the segmentations of a word is a forward recursion in log space. A training word is besides
an edge over its whole width, with its count in the corpus less DISCOUNT; what the discounts free
is the share of spelled words. No edge crosses a word, so the words of a text multiply, and the
model is a distribution over texts: edges, spelled words and the end have 1 in all.

Each distinct word is counted and scored once. Words that make up more than 1 / HEAVY of all are
fewer than HEAVY and are handed to every task; the others of a document are joined to the table
of words. Beside the model's score stands the word unigram baseline with 0.1 added per word; it
counts all unseen words as one, so it is no distribution over texts and may be higher.

Missing and empty texts are just the end; repeated rows are scored each and count each in
training. Without training rows words are spelled by the prior weights. Ties need no rule. Words
and texts may be of any length: tables of a word are cut into windows. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossblock.session import cut

#: Rounds of expected counts; pieces that the prior is worth; taken from every word's count.
ROUNDS, PRIOR, DISCOUNT = 3, 1000.0, 0.75
#: The share that makes a word heavy, and what is added to every count of the baseline.
HEAVY, ADDED = 500_000, 0.1
#: Bytes of text taken at once, words scored at once, and cells of a table of pieces.
CHUNK, WORDS, CELLS = 4 << 20, 100_000, 1 << 17
MARK = b" "
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20


@dataclass(frozen=True)
class Pieces:
    """Byte strings with the logarithm (base e) of their probabilities; the close stands apart."""

    strings: tuple[bytes, ...]
    logs: np.ndarray
    close: float


def vocabulary(path: str) -> Pieces:
    """Pieces of a sentencepiece file with 1 / rank as weight, and all single bytes."""
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=path)
    weights: dict[bytes, float] = {}
    lowest = 1.0
    for i in range(held.vocab_size()):
        text, score = held.id_to_piece(i), held.get_score(i)
        if held.is_control(i) or held.is_unknown(i) or held.is_unused(i) or held.is_byte(i):
            continue
        string = text.replace("▁", " ").encode()
        if b" " in string[1:] or any(65 <= b <= 90 for b in string):
            continue
        weights[string] = 1 / (1 - score)
        lowest = min(lowest, weights[string])
    for b in range(256):
        weights[bytes([b])] = weights.get(bytes([b]), 0.0) + lowest
    strings = tuple(sorted(weights))
    values = np.array([weights[s] for s in strings])
    close = float(values.max())
    total = values.sum() + close
    return Pieces(strings, np.log(values / total), float(np.log(close / total)))


class Lattice:
    """Segmentations of many words at once. Pieces are found by a hash of their bytes."""

    def __init__(self, pieces: Pieces):
        self.logs = np.append(pieces.logs, -np.inf)
        self.lengths = np.unique([len(s) for s in pieces.strings])
        values = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.values = values | np.uint64(1)
        self.inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        hashes = np.array([self._hash(np.frombuffer(s, np.uint8)) for s in pieces.strings], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        # Open addressing: a piece lies at its slot or the next free one.
        self.slots = np.full((1 << _SLOTS) + 64, -1, np.int32)
        for i, at in enumerate(self._slot(hashes).tolist()):
            while self.slots[at] >= 0:
                at += 1
            self.slots[at] = i
        self.hashes = hashes

    def _hash(self, data: np.ndarray) -> np.uint64:
        up = _ODD ** np.arange(len(data), dtype=np.uint64)
        total = (self.values[data] * up).sum(dtype=np.uint64, keepdims=True)
        return (total * np.uint64(2 * len(data) + 1))[0]

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(29))) * _ODD) >> np.uint64(64 - _SLOTS)

    def _found(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or the number of pieces where there is none."""
        flat = hashes.ravel()
        at = self._slot(flat)
        held = self.slots[at]
        found = np.where(held < 0, len(self.hashes), held)
        left = np.flatnonzero(held >= 0)
        while len(left):
            left = left[self.hashes[found[left]] != flat[left]]
            at[left] += np.uint64(1)
            held = self.slots[at[left]]
            found[left] = np.where(held < 0, len(self.hashes), held)
            left = left[held >= 0]
        return found.reshape(hashes.shape)

    def _sums(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros((data.shape[0], data.shape[1] + 1), np.uint64)
        up = _ODD ** np.arange(data.shape[1], dtype=np.uint64)
        np.cumsum(self.values[data] * up, axis=1, out=sums[:, 1:])
        return sums

    def _edges(self, sums: np.ndarray, low: int, high: int) -> np.ndarray:
        """Piece that ends at j and has length l, for low < j <= high: (words, j, l)."""
        lengths = self._lengths(high)
        ends = np.arange(low + 1, high + 1)[:, None]
        starts = ends - lengths[None, :]
        inside = starts >= 0
        starts = np.maximum(starts, 0)
        down = self.inverse ** starts.astype(np.uint64)
        odd = (2 * lengths + 1).astype(np.uint64)
        found = self._found((sums[:, ends] - sums[:, starts]) * down * odd)
        return np.where(inside, found, len(self.hashes))

    def _lengths(self, most: int) -> np.ndarray:
        return self.lengths[self.lengths <= most]

    def _windows(self, rows: int, width: int) -> list[tuple[int, int]]:
        step = max(1, CELLS // max(1, rows * len(self.lengths)))
        return [(low, min(low + step, width)) for low in range(0, width, step)]

    def forward(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of every prefix of words of equal length (rows of bytes)."""
        rows, width = data.shape
        sums = self._sums(data)
        alpha = np.full((rows, width + 1), -np.inf)
        alpha[:, 0] = 0
        for low, high in self._windows(rows, width):
            logs, lengths = self.logs[self._edges(sums, low, high)], self._lengths(high)
            for j in range(low + 1, high + 1):
                terms = alpha[:, np.maximum(j - lengths, 0)] + logs[:, j - low - 1]
                most = terms.max(axis=1, keepdims=True)
                alpha[:, j] = most[:, 0] + np.log(np.exp(terms - most).sum(axis=1))
        return alpha, sums

    def expected(self, data: np.ndarray) -> np.ndarray:
        """Expected occurrences of every piece in words of equal length."""
        rows, width = data.shape
        alpha, sums = self.forward(data)
        beta = np.full((rows, width + 1), -np.inf)
        beta[:, width] = 0
        total = np.zeros(len(self.logs))
        for low, high in reversed(self._windows(rows, width)):
            edges = self._edges(sums, low, high)
            logs = self.logs[edges]
            for j in range(high, low, -1):
                lengths = self._lengths(j)
                terms = logs[:, j - low - 1, : len(lengths)] + beta[:, j : j + 1]
                at = j - lengths
                share = np.exp(alpha[:, at] + terms - alpha[:, width:])
                piece = edges[:, j - low - 1, : len(lengths)]
                total += np.bincount(piece.ravel(), share.ravel(), len(total))
                beta[:, at] = np.logaddexp(beta[:, at], terms)
        return total[:-1]


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about WORDS words or CHUNK bytes, so that tables fill up."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= WORDS or size >= CHUNK:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _same_width(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words with their mark as rows of bytes, by length, in tables of bounded size."""
    held = [MARK + w.as_buffer().to_pybytes() for w in words.cast(pa.large_binary())]
    sizes = np.array([len(w) for w in held])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, CELLS // int(size))
        for low in range(0, len(at), step):
            own = at[low : low + step]
            yield own, np.frombuffer(b"".join(held[i] for i in own), np.uint8).reshape(len(own), size)


def word_logs(lattice: Lattice, words: pa.Array) -> np.ndarray:
    """Natural log probability of each word's pieces, mark included and close not."""
    found = np.zeros(len(words))
    for at, data in _same_width(words):
        found[at] = lattice.forward(data)[0][:, -1]
    return found


@dataclass(frozen=True)
class _Texts:
    """Words of some texts: distinct words, and for every occurrence its text and its word."""

    first: int
    n: int
    words: pa.Array
    text: np.ndarray
    word: np.ndarray


def _texts(column: pa.Array) -> Iterator[_Texts]:
    """Slices of whole texts of about CHUNK bytes."""
    filled = pc.ascii_lower(pc.fill_null(pc.cast(column, pa.large_string()), ""))
    edges = np.append(0, np.cumsum(pc.binary_length(filled).to_numpy(zero_copy_only=False)))
    low = 0
    while low < len(filled):
        high = int(np.searchsorted(edges, edges[low] + CHUNK, side="right")) - 1
        high = min(max(high, low + 1), len(filled))
        split = pc.ascii_split_whitespace(filled.slice(low, high - low))
        flat, text = pc.list_flatten(split), pc.list_parent_indices(split)
        solid = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(solid).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        yield _Texts(low, high - low, coded.dictionary, text.filter(solid).to_numpy(zero_copy_only=False), codes)
        low = high


def count_words(docs: DataFrame) -> DataFrame:
    """A written table (word, n, learnt): occurrences in all rows of (text, trains) and in those that train."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trains = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for texts in _texts(batch.column(0)):
                size = len(texts.words)
                learnt = np.bincount(texts.word, trains[texts.first + texts.text], size).astype(np.int64)
                columns = [texts.words.cast(pa.string()), pa.array(np.bincount(texts.word, minlength=size)), pa.array(learnt)]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n", "learnt"])

    found = docs.select("text", "trains").mapInArrow(count, "word string, n long, learnt long")
    return cut(found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("learnt").alias("learnt")))


def refined(words: DataFrame, kinds: int, pieces: Pieces, prior: Pieces) -> Pieces:
    """One round: expected counts of the pieces of `kinds` distinct words, with the prior added."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)  # as large as the vocabulary

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        total = np.zeros(len(shared.value.strings))
        for batch in _larger(batches):
            for _, data in _same_width(batch.column(0)):
                total += lattice.expected(data)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

    found = words.select("word").mapInArrow(expect, "piece long, n double")
    total = PRIOR * np.exp(prior.logs)
    for row in found.groupBy("piece").agg(F.sum("n").alias("n")).collect():
        total[row["piece"]] += row["n"]
    close = PRIOR * np.exp(prior.close) + kinds
    whole = total.sum() + close
    return replace(pieces, logs=np.log(total / whole), close=float(np.log(close / whole)))


@dataclass(frozen=True)
class Model:
    """Pieces, and the counts behind whole words: tokens that train, distinct words and ends."""

    pieces: Pieces
    tokens: int
    kinds: int
    ends: int

    @property
    def end(self) -> float:
        """Natural log probability of the end; one end and one spelled word are added."""
        return float(np.log((self.ends + 1) / (self.tokens + 2)))

    def word_logs(self, lattice: Lattice, words: pa.Array, counts: np.ndarray) -> np.ndarray:
        """Natural log probability of words that occur `counts` times in training."""
        spelled = np.log((DISCOUNT * self.kinds + 1) / (self.tokens + 2)) + self.pieces.close
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(counts - DISCOUNT, 0) / (self.tokens + 2))
        return np.logaddexp(whole, spelled + word_logs(lattice, words))


def score(
    docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", trains: Column, rounds: int = ROUNDS
) -> DataFrame:
    """One row per row: key, n_tokens, n_known, train_tokens, base_score and score (base 10).

    `trains` marks the rows to learn from; `path` is a sentencepiece vocabulary.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.coalesce(trains, F.lit(False)).alias("trains")
    )
    words = count_words(slim)
    ends = slim.where("trains").count()
    all_words, learnt, kinds = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("learnt"), F.lit(0)), F.count_if(F.col("learnt") > 0)
    ).first()
    prior = pieces = vocabulary(path)
    for _ in range(rounds if kinds else 0):
        pieces = refined(words.where("learnt > 0"), kinds, pieces, prior)
    model = Model(pieces, learnt + ends, kinds, ends)
    shared = spark.sparkContext.broadcast(model)
    below = np.log10(model.tokens + ADDED * (kinds + (ends > 0) + 1))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        lattice = Lattice(held.pieces)
        for batch in _larger(batches):
            counts = batch.column(2).to_numpy(zero_copy_only=False)
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(counts > 0),
                pa.array(np.log10(counts + ADDED) - below),
                pa.array(held.word_logs(lattice, batch.column(0), counts) / np.log(10)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "known", "base", "lattice"])

    scored = cut(words.mapInArrow(weigh, "word string, n long, known boolean, base double, lattice double"))
    # Fewer than HEAVY words, of HEAVY times the mean length of a word in all.
    heavy = scored.where(F.col("n") * F.lit(HEAVY) > F.lit(all_words)).select("word", "known", "base", "lattice").toArrow()
    heavy_words = spark.sparkContext.broadcast(
        (heavy["word"].combine_chunks(), *(heavy[c].to_numpy().astype(float) for c in ("known", "base", "lattice")))
    )
    end_known, end_base, end_score = int(ends > 0), float(np.log10(ends + ADDED) - below), model.end / np.log(10)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, *values = heavy_words.value
        names = ["row", "key", "word", "times", "n_tokens", "known", "base", "lattice"]
        for batch in batches:
            for texts in _texts(batch.column(2)):
                rows, keys = (batch.column(i).slice(texts.first, texts.n) for i in (0, 1))
                at = pc.index_in(texts.words.cast(pa.string()), value_set=table)
                place = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)[texts.word]
                light = place < 0
                # Without heavy words the sums are whole numbers unless made floats.
                sums = [np.bincount(texts.text[~light], v[place[~light]], texts.n).astype(float) for v in values]
                sizes = np.bincount(texts.text, minlength=texts.n) + 1
                nothing = pa.nulls(texts.n, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [rows, keys, nothing, pa.array(np.zeros(texts.n, np.int64)), pa.array(sizes), *map(pa.array, sums)],
                    names,
                )
                pairs, times = np.unique(
                    texts.text[light].astype(np.int64) * max(1, len(texts.words)) + texts.word[light], return_counts=True
                )
                text, word = np.divmod(pairs, max(1, len(texts.words)))
                zeros = pa.array(np.zeros(len(pairs)))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.take(pa.array(text)),
                        pa.nulls(len(pairs), keys.type),
                        texts.words.take(pa.array(word)).cast(pa.string()),
                        pa.array(times),
                        pa.array(np.zeros(len(pairs), np.int64)),
                        *[zeros] * 3,
                    ],
                    names,
                )

    kind = slim.schema["key"].dataType.simpleString()
    numbered = slim.select(F.monotonically_increasing_id().alias("row"), "key", "text")
    parts = numbered.mapInArrow(
        read,
        f"row long, key {kind}, word string, times long, n_tokens long, known double, base double, lattice double",
    )
    # A row of a document itself has no word; its own key keeps such rows apart and matches none.
    keyed = parts.withColumn("at", F.coalesce("word", F.concat(F.lit(" "), F.col("row").cast("string"))))
    table = scored.select(
        F.col("word").alias("at"), F.col("known").alias("w_known"), F.col("base").alias("w_base"), F.col("lattice").alias("w_lattice")
    )
    joined = keyed.join(table, "at", "left")

    def total(own: str, word: Column) -> Column:
        return F.sum(F.col(own) + F.coalesce(word * F.col("times"), F.lit(0.0)))

    return (
        joined.groupBy("row")
        .agg(
            F.max("key").alias("key"),
            F.sum("n_tokens").alias("n_tokens"),
            total("known", F.col("w_known").cast("int")).alias("known"),
            total("base", F.col("w_base")).alias("base"),
            total("lattice", F.col("w_lattice")).alias("lattice"),
        )
        .select(
            "key",
            "n_tokens",
            (F.col("known").cast("long") + end_known).alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + end_base).alias("base_score"),
            (F.col("lattice") + end_score).alias("score"),
        )
    )
