"""Tokens with offsets, and the five token positions read off the prompt anchors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossblock.functions.names import PositionNames
from crossblock.functions.values import as_column, bound, insist, running_totals

TOKENS = T.ArrayType(
    T.StructType([T.StructField(n, T.IntegerType()) for n in ("id", "start", "end")])
)
#: Pieces of the default tokenizer: a word with its leading blank, or one other character.
PIECES = r" ?[A-Za-z0-9]+|[^A-Za-z0-9]"

#: Texts whose tokens a worker holds as Python objects at a time.
TEXTS = 64

Tokenizer = Callable[[str], list[tuple[int, int, int]]]


def default_tokens(text: Column) -> Column:
    """The default pieces with ids and character offsets, without leaving the JVM.

    Pieces cover every character, so offsets are running lengths. The id of a piece is the head
    of its hash.
    """
    def token(piece: Column, end: Column) -> Column:
        number = F.conv(F.substring(F.md5(piece.cast("binary")), 1, 7), 16, 10).cast("int")
        return F.struct(number.alias("id"), (end - F.char_length(piece)).alias("start"), end.alias("end"))

    def placed(pieces: Column) -> Column:
        ends = running_totals(F.transform(pieces, lambda p: F.char_length(p)))
        return bound(ends, lambda e: F.transform(pieces, lambda p, i: token(p, F.get(e, i))))

    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    return F.when(text.isNotNull(), bound(pieces, placed)).cast(TOKENS)


def token_arrays(run: Tokenizer, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Tokens of the texts as Arrow arrays of at most TEXTS texts, whatever the batches hold."""
    for texts in (c.slice(i, TEXTS).to_pylist() for c in batches for i in range(0, len(c), TEXTS)):
        found = [run(t) if t is not None else [] for t in texts]
        flat = [token for tokens_ in found for token in tokens_]
        columns = np.array(flat, dtype=np.int32).reshape(-1, 3).T
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        spans = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["id", "start", "end"])
        yield pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), spans, mask=pa.array([t is None for t in texts], pa.bool_())
        )


def encode(text: str | Column, factory: Callable[[], Tokenizer] | None = None) -> Column:
    """Token ids with character offsets.

    Without a factory these are the default pieces. A factory is called once per worker
    iterator and its tokenizer once per text. A worker holds the tokens of TEXTS texts at a time.
    """
    if factory is None:
        return default_tokens(as_column(text))

    @F.arrow_udf(TOKENS)
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from token_arrays(factory(), batches)

    return tokens(as_column(text))


def count_tokens(text: str | Column, factory: Callable[[], Tokenizer] | None = None) -> Column:
    """How many tokens `encode` makes, without their ids and offsets where it can do without."""
    if factory is None:
        return F.size(F.regexp_extract_all(as_column(text), F.lit(PIECES), F.lit(0)))
    return F.size(encode(text, factory))


def tokens_from_parts(ids: str, offsets: str) -> Column:
    """Join separate id and offset arrays of an external tokenizer; their lengths must agree."""
    same = F.size(ids) == F.size(offsets)
    message = F.concat(
        F.size(ids).cast("string"),
        F.lit(" ids do not pair with "),
        F.size(offsets).cast("string"),
        F.lit(" offsets"),
    )
    pairs = F.zip_with(
        ids,
        offsets,
        lambda i, o: F.struct(
            i.cast("int").alias("id"), o["start"].alias("start"), o["end"].alias("end")
        ),
    )
    return F.when(same, pairs).otherwise(F.raise_error(message).cast(TOKENS))


def covering_token(tokens: str | Column, char: Column) -> Column:
    """Index of the last token whose span covers a character; -1 if none does.

    Zero-width spans cover nothing.
    """
    spans = F.col(tokens) if isinstance(tokens, str) else tokens
    hits = F.transform(
        spans,
        lambda t, i: F.when((t["start"] <= char) & (char < t["end"]), i).otherwise(F.lit(-1)),
    )
    return F.coalesce(F.array_max(hits), F.lit(-1))


def token_window(
    text: str, tokens: str | Column, index: Column, radius: int = 3
) -> Column:
    """Readable pieces around a token, the token itself starred."""
    spans = F.col(tokens) if isinstance(tokens, str) else tokens
    low = F.greatest(F.lit(0), index - F.lit(radius))
    count = F.least(F.size(spans), index + F.lit(radius + 1)) - low
    pieces = F.transform(
        F.slice(spans, low + 1, F.greatest(count, F.lit(0))),
        lambda t, i: F.concat(
            F.lit("["),
            (low + i).cast("string"),
            F.lit("]"),
            F.substr(F.col(text), t["start"] + 1, t["end"] - t["start"]),
            F.when(low + i == index, F.lit("*")).otherwise(F.lit("")),
        ),
    )
    return F.array_join(pieces, " ")


# Error codes, in the order in which the conditions are tested.
ERRORS = [
    "AC_UNCOVERED",
    "AC_RUNS_PAST_COLON",
    "ANSWER_START_UNCOVERED",
    "ANSWER_START_SWALLOWS_COLON",
    "LAT_UNCOVERED",
    "LAT_RUNS_PAST_ANSWER",
    "NEWLINE_UNCOVERED",
    "NEWLINE_NOT_ITS_OWN_TOKEN",
    "NO_TOKEN_AFTER_NEWLINE",
    "CC_UNCOVERED",
    "CC_RUNS_PAST_COLON",
    "CC_NOT_LAST_TOKEN",
    "NOT_STRICTLY_ORDERED",
]


def resolve_positions(
    df: DataFrame,
    *,
    tokens: str = "tokens",
    anchors: str = "anchors",
    names: PositionNames = PositionNames(),
) -> DataFrame:
    """Add pos_*, tok_*, input_ids, the answer span, counts and `position_error`.

    A boundary that a token straddles is reported as a code, NULL meaning resolved.
    """
    at = {c: F.col(f"{anchors}.{c}") for c in (
        "answer_colon", "answer_boundary", "answer_start", "answer_end", "newline",
        "confidence_colon",
    )}
    chars = {
        "ac": at["answer_colon"], "first": at["answer_start"], "lat": at["answer_end"] - 1,
        "nl": at["newline"], "cc": at["confidence_colon"],
    }

    def covered(asked: Column) -> Column:
        """All five from one scan of the tokens: only those that reach into their span are looked at."""
        numbered = F.transform(tokens, lambda t, i: F.struct(i.alias("at"), t["start"].alias("start"), t["end"].alias("end")))
        near = F.filter(numbered, lambda t: (t["end"] > asked["low"]) & (t["start"] <= asked["high"]))

        def last(held: Column, char: Column) -> Column:
            hits = F.filter(held, lambda t: (t["start"] <= char) & (char < t["end"]))
            return F.coalesce(F.array_max(F.transform(hits, lambda t: t["at"])), F.lit(-1))

        return bound(near, lambda held: F.struct(
            *[last(held, asked[c]).alias(c) for c in chars], F.size(tokens).alias("n")
        ))

    asked = F.struct(
        *[c.alias(name) for name, c in chars.items()],
        F.least(*chars.values()).alias("low"), F.greatest(*chars.values()).alias("high"),
    )
    hits = bound(asked, covered)

    def describe(h: Column) -> Column:
        def edge(index: Column, field: str) -> Column:
            return F.get(F.col(tokens), index)[field]

        ac, first, lat, nl, cc, n = (h[c] for c in ("ac", "first", "lat", "nl", "cc", "n"))
        after = nl + 1
        broken = [
            ac < 0,
            edge(ac, "end") != at["answer_boundary"],
            first < 0,
            edge(first, "start") < at["answer_boundary"],
            lat < 0,
            edge(lat, "end") != at["answer_end"],
            nl < 0,
            (edge(nl, "start") != at["newline"]) | (edge(nl, "end") != at["newline"] + 1),
            after >= n,
            cc < 0,
            edge(cc, "end") != at["confidence_colon"] + 1,
            cc != n - 1,
            ~((ac < lat) & (lat < nl) & (after < cc)),
        ]
        code = F.lit(None).cast("string")
        for condition, name in reversed(list(zip(broken, ERRORS, strict=True))):
            code = F.when(condition, F.lit(name)).otherwise(code)
        fields = [code.alias("position_error"), n.alias("n_tokens")]
        for label, index in zip(names.ordered(), (ac, lat, nl, after, cc), strict=True):
            fields.append(index.alias(f"pos_{label}"))
            token = F.get(F.col(tokens), F.when(index >= 0, index))["id"]
            fields.append(token.alias(f"tok_{label}"))
        fields.append(first.alias("answer_start"))
        fields.append((lat + 1).alias("answer_end"))
        fields.append((lat + 1 - first).alias("n_answer_tokens"))
        return F.struct(*fields)

    # The lambda binds the hits once. Spelled out flat, a filter on any of the columns would
    # be pushed below them with a copy of the token scan for every mention.
    found = df.withColumn("_p", F.get(F.transform(F.array(hits), describe), F.lit(0)))
    fields = ["position_error", "n_tokens"]
    fields += [f"{p}_{label}" for label in names.ordered() for p in ("pos", "tok")]
    fields += ["answer_start", "answer_end", "n_answer_tokens"]
    return found.withColumns(
        {
            **{f: F.col(f"_p.{f}") for f in fields},
            "input_ids": F.transform(tokens, lambda t: t["id"]),
        }
    ).drop("_p")


# The named position sets.
SETS = ["answer", "after_answer", "post_newline", "suffix_before_cc"]


def in_position_set(name: str, names: PositionNames = PositionNames()) -> Column:
    """Whether the token at column `index` belongs to a named set of positions."""
    i = F.col("index")
    newline, cc = F.col(f"pos_{names.newline}"), F.col(f"pos_{names.confidence}")
    if name == "answer":
        return (i >= F.col("answer_start")) & (i < F.col("answer_end"))
    if name == "after_answer":
        return i >= newline
    if name == "post_newline":
        return i > newline
    if name == "suffix_before_cc":
        return (i > newline) & (i < cc)
    if name in names.ordered():
        return i == F.col(f"pos_{name}")
    raise KeyError(f"unknown position set {name!r}")


def token_table(
    resolved: DataFrame,
    key: list[str],
    sets: list[str] | None = None,
    names: PositionNames = PositionNames(),
) -> DataFrame:
    """One row per token with a boolean column per position set."""
    wanted = sets if sets is not None else [*SETS, *names.ordered()]
    spans = [f"pos_{label}" for label in names.ordered()] + ["answer_start", "answer_end"]
    long = resolved.select(*key, *spans, F.posexplode("input_ids").alias("index", "token_id"))
    return long.select(
        *key, "index", "token_id", *[in_position_set(s, names).alias(f"in_{s}") for s in wanted]
    )


def position_snapshot(
    resolved: DataFrame, key: Sequence[str], names: PositionNames = PositionNames()
) -> DataFrame:
    """What a tokenizer made of each prompt: checksum, length, and index and id at every position."""
    columns = [f"{p}_{n}" for n in names.ordered() for p in ("pos", "tok")]
    return resolved.select(*key, "prompt_sha256", "n_tokens", *columns)


def snapshot_drift(current: DataFrame, frozen: DataFrame) -> DataFrame:
    """Rows on one side only, labelled by side, counting repeats: one signed count per row."""
    columns = current.columns
    both = current.withColumn("_s", F.lit(1)).unionByName(
        frozen.select(*columns).withColumn("_s", F.lit(-1))
    )
    net = both.groupBy(*columns).agg(F.sum("_s").alias("_net")).where("_net <> 0")
    side = F.when(F.col("_net") > 0, "current").otherwise("frozen")
    copies = F.sequence(F.lit(1).cast("long"), F.abs("_net"))
    return net.select(*columns, side.alias("side"), F.explode(copies).alias("_c")).drop("_c")


def field_drift(
    current: DataFrame, frozen: DataFrame, key: Sequence[str], fields: Sequence[str] | None = None
) -> DataFrame:
    """One row per key that is not the same on both sides: what happened to it and in which fields.

    `change` is added, missing or changed; `fields` holds structs (field, was, now), values as
    text, for the fields that differ (all of the present side's for the first two). Two missing
    values are equal. A key that repeats on one side fails the job.
    """
    names = list(fields if fields is not None else [c for c in current.columns if c not in key])
    held = F.struct(*[F.col(n).cast("string").alias(n) for n in names])
    both = current.select(*key, F.lit(True).alias("_now"), held.alias("_held")).unionByName(
        frozen.select(*key, F.lit(False).alias("_now"), held.alias("_held"))
    )
    sides = {"now": F.col("_now"), "was": ~F.col("_now")}
    paired = both.groupBy(*key).agg(
        *[F.max(F.when(side, F.col("_held"))).alias(name) for name, side in sides.items()],
        *[F.count_if(side).alias(f"_n_{name}") for name, side in sides.items()],
    )
    once = insist(paired, (F.col("_n_now") <= 1) & (F.col("_n_was") <= 1), "a key of a snapshot repeats")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "missing").otherwise("changed")
    differing = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f"was.{n}").eqNullSafe(F.col(f"now.{n}")) | (change != "changed"),
                    F.struct(F.lit(n).alias("field"), F.col(f"was.{n}").alias("was"), F.col(f"now.{n}").alias("now")),
                )
                for n in names
            ]
        )
    )
    return once.select(*key, change.alias("change"), differing.alias("fields")).where(F.size("fields") > 0)
