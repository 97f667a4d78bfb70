"""The dealt operators as registered queries over whole tables, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossblock.llm import language, lattice, line_dedup, mixing, neighbours, ngram_join, packing, prefix_trie, quality, secrets, spotsigs, warc, whitening
from crossblock.llm.common import fold, table, word_count
from crossblock.session import cut, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


@query
def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document, learnt from the labels outside fold 0 of 5."""
    vectors = cut(quality.measured(table(spark, sf, "documents")))
    learnt = quality.with_labels(
        vectors, table(spark, sf, "labels"), key="doc_id", label="quality", where=fold("key", 5) != 0
    )
    scored = quality.score(vectors, quality.fit(learnt))
    return scored.select(
        F.col("key").alias("doc_id"),
        (fold("key", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of every document when repeated three-line windows are removed."""
    return line_dedup.dedup(table(spark, sf, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "text", "lines", "removed"
    )


@query
def op3_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of secrets in every document, through a ledger that has seen one source before."""
    ledger = scratch_path(spark, "ledger")
    docs = table(spark, sf, "documents")
    first = docs.agg(F.min("source").alias("source")).scalar()
    secrets.scan(docs.where(F.col("source") == first), ledger, path=["doc_id"])
    paths, holders = secrets.scan(docs, ledger, path=["doc_id"])
    return secrets.findings(paths, holders, ledger).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_pem", "n_jwt", "blob"
    )


@query
def op4_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9."""
    found = ngram_join.linked_components(table(spark, sf, "documents"), ngram_join.Rule(3, 9, 10))
    return found.select(
        F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )


@query
def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words the mix takes of every document; targets by repeating weights 5, 2, 1."""
    docs = table(spark, sf, "documents")
    mixed = mixing.taken(docs.select("doc_id", "source", word_count("text").alias("size")), size="size")
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def tokenizer() -> str:
    """Where the public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Token pieces of every document, packed into sequences of 2048."""
    items = cut(packing.pieces(table(spark, sf, "documents"), tokenizer()))
    return packing.pack(items).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound"
    )


@query
def op7_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 nearest of every 50th vector among all others."""
    found = neighbours.search(table(spark, sf, "embeddings"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op8_spotsigs(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness."""
    beside = spotsigs.neighbours(table(spark, sf, "documents"))
    changed = beside.withColumn("edit", spotsigs.edited(F.col("text"), F.col("next_text")))
    signed = changed.withColumn("edit_sigs", spotsigs.signatures(F.col("edit")))
    return signed.select(
        F.col("key").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edit", 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edit_sigs")).alias("edited_fingerprint"),
        spotsigs.jaccard(F.col("sigs"), F.col("edit_sigs")).alias("near_edited"),
        spotsigs.jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        spotsigs.length_partition(F.col("sigs"), spotsigs.LIKENESS).alias("length_partition"),
    )


@query
def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written as WARC bundles and read back."""
    folder = scratch_path(spark, "warc")
    index = warc.write(table(spark, sf, "pages"), folder)
    return warc.read(index, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op10_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learnt from the documents outside fold 1 of 3."""
    docs = table(spark, sf, "documents")
    model = language.fit(docs, where=fold("doc_id", 3) != 1)
    return language.predict(docs, model).select(
        F.col("key").alias("doc_id"), (fold("key", 3) == 1).alias("held_out"), "lang_pred", "score"
    )


@query
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Every usable vector on the first 16 components of the distinct ones, with unit variance."""
    found = whitening.whiten(table(spark, sf, "embeddings"))
    return found.select(
        F.col("key").alias("vec_id"),
        "component",
        "n",
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened",
        "explained",
        "identity_error",
    )


@query
def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Trie of all conversations, each begun by turns of the first of its hundred."""
    turns = prefix_trie.ordered(table(spark, sf, "conversations"))
    conv = F.col("conv")
    share = F.crc32(conv.cast("string").cast("binary")) % 6
    rebuilt, convs = prefix_trie.share_heads(turns, base=conv - conv % 100, share=share, most=5)
    return prefix_trie.trie(rebuilt, convs).drop("k1", "k2")


def pieces_file() -> str:
    """Where the vocabulary of subwords lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op13_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    """Log probability of every text, learnt from the documents outside fold 0 of 10."""
    found = lattice.score(table(spark, sf, "documents"), pieces_file(), trains=fold("doc_id", 10) != 0)
    return found.select(
        F.col("key").alias("doc_id"),
        (fold("key", 10) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )
