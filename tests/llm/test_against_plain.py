"""Queries that SQL cannot express, held against plain Python; the others against their SQL."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_oracle import compare, connect
from crossblock.llm import ngram_join, oracle, packing, queries, spotsigs
from crossblock.llm.components import components
from crossblock.llm.queries import REGISTRY, tokenizer
from crossblock.session import cut

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def documents(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_sql(spark, name):
    assert compare(REGISTRY[name](spark, SMALL), connect(SMALL), oracle.SQL[name]) == ""


def shingles(text, width):
    folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if len(words) < width:
        return {tuple(words)} - {()}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain_components(texts, width, part, whole):
    lists, parent, sets = defaultdict(list), {k: k for k in texts}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in sorted(texts):
        sets[k] = shingles(texts[k], width)
        common = Counter(j for g in sets[k] for j in lists[g])
        for g in sets[k]:
            lists[g].append(k)
        for j, n in common.items():
            if whole * n >= part * (len(sets[k]) + len(sets[j]) - n) and find(j) != find(k):
                a, b = find(j), find(k)
                parent[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize(
    ("rule", "how"),
    [
        (ngram_join.Rule(3, 9, 10), {}),
        (ngram_join.Rule(5, 4, 5), {"list_rows": 3, "block_tokens": 300, "broadcast_keys": 0}),
    ],
)
def test_ngram_join(spark, rule, how):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    # Families of near copies of growing distance, around the limit.
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    near = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 6)), replace=False):
            words[at] = f"x{i}_{at}"
        near.append((10_000 + i, " ".join(words)))
    whole = cut(docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string")))
    want = plain_components({r["doc_id"]: r["text"] for r in whole.collect()}, rule.width, rule.part, rule.whole)
    got = {r["key"]: (r["n"], r["component"]) for r in ngram_join.linked_components(whole, rule, **how).collect()}
    assert got == want


def test_group_links_agree_with_all_pairs():
    rng = np.random.default_rng(3)
    rule = ngram_join.Rule(3, 4, 5)
    for _ in range(20):
        base = rng.choice(10_000, 60, replace=False)
        sets = []
        for _ in range(25):
            out = rng.choice(60, int(rng.integers(0, 14)), replace=False)
            sets.append(np.unique(np.append(np.delete(base, out), rng.choice(10_000, len(out)))).astype(np.uint64))
        ids = np.arange(25)
        parts = np.arange(25)
        for i in range(25):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                    parts[parts == parts[i]] = parts[j]
        found = np.arange(25)
        for a, b in ngram_join.group_links(ids, sets, rule):
            found[found == found[a]] = found[b]
        assert [list(parts).index(x) for x in parts] == [list(found).index(x) for x in found]


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    parts = {x: x for pair in links if pair[0] != pair[1] for x in pair}
    for _ in range(len(parts)):
        before = dict(parts)
        for a, b in links:
            if a != b:
                parts[a] = parts[b] = min(parts[a], parts[b])
        if parts == before:
            break
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: parts[k] for k in parts} == got


def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    got = REGISTRY["op1_quality"](spark, MID).collect()
    assert {r["doc_id"] for r in got} == set(documents(spark, MID))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == q for p, q in held) >= 0.97 * len(held)
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) for r in got)


def test_language_held_out(spark):
    docs = documents(spark, MID)
    got = REGISTRY["op10_language"](spark, MID).collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got if r["held_out"]]
    assert sum(held) >= 0.98 * len(held)


def test_packing(spark):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer())
    got = REGISTRY["op6_packing"](spark, SMALL).collect()
    at = {(r["doc_id"], r["piece"]): r for r in got}
    n = 0
    for k, doc in documents(spark, SMALL).items():
        ids = np.array([*exact.encode(doc["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for i, (start, length) in enumerate(packing.cuts(len(ids))):
            r = at[(k, i)]
            assert (r["start"], r["length"]) == (start, length)
            assert r["ids_crc32"] == zlib.crc32(ids[start : start + length].tobytes())
            n += 1
    assert n == len(got)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)])]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    assert len(held) <= packing.lower_bound(np.array([r["length"] for r in got]), 2048) + 1


def test_packing_exchanges_between_partitions(spark):
    rng = np.random.default_rng(5)
    lengths = rng.integers(300, 900, 600).tolist()
    items = cut(spark.createDataFrame(
        [(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES
    ))
    alone = packing.pack(items, part_rows=20, rounds=0).select("sequence_id").distinct().count()
    traded = packing.pack(items, part_rows=20).collect()
    assert len({r["sequence_id"] for r in traded}) <= alone and len(traded) == 600
    assert all(r["bins"] >= r["bound"] for r in traded)


def test_special_strings_are_tokenised_alike():
    from tokenizers import Tokenizer

    exact, own = Tokenizer.from_file(tokenizer()), packing.encoder(tokenizer())
    for text in ["", " \t\x0b\x1c\x85\xa0 a  b", "日本語 😀 x<|endoftext|>y", "ñandú 12³½ €5 … “x”\r\n\n  q"]:
        assert own(text) == exact.encode(text, add_special_tokens=False).ids


def test_sequences_hold_their_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    held = cut(packing.pieces(docs, tokenizer(), keep_ids=True))
    packed = packing.pack(held)
    found = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed, held).collect()}
    for r in packed.collect():
        part = found[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert zlib.crc32(part) == r["ids_crc32"]


def test_neighbours_recall(spark):
    frame = spark.read.parquet(f"{MID}/embeddings.parquet").toPandas()
    vectors = np.stack(frame["embedding"].to_numpy()).astype(float)
    ids, norms = frame["vec_id"].to_numpy(), np.sqrt((vectors**2).sum(axis=1))
    got = defaultdict(list)
    for r in REGISTRY["op7_neighbours"](spark, MID).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i in ids if i % 50 == 0]
    assert sorted(got) == sorted(asked)
    hits = 0
    for q in asked:
        own = int(np.flatnonzero(ids == q)[0])
        cosine = (vectors * vectors[own]).sum(axis=1) / norms / norms[own]
        cosine[own] = -2
        best = np.lexsort((ids, -cosine))[:5]
        hits += len(set(ids[best].tolist()) & {v for _, v, _ in got[q]})
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        for _, v, s in got[q]:
            assert abs(cosine[np.flatnonzero(ids == v)[0]] - s) < 1e-12
    assert hits >= 0.9 * 5 * len(asked)


def plain_signatures(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    content = [w for w in words if w not in spotsigs.ANCHORS]
    found, before = set(), 0
    for w in words:
        if w in spotsigs.ANCHORS:
            chain = content[before : before + spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                found.add((w, *chain))
        else:
            before += 1
    return found or {" ".join(words)}


def test_spotsigs(spark):
    docs = documents(spark, SMALL)
    order = sorted(docs)
    got = {r["doc_id"]: r for r in REGISTRY["op8_spotsigs"](spark, SMALL).collect()}
    assert sorted(got) == order

    def likeness(a, b):
        return len(a & b) / len(a | b)

    prints = defaultdict(set)
    for k, following in zip(order, [*order[1:], order[0]], strict=True):
        text, after = docs[k]["text"], docs[following]["text"]
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        r = got[k]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(likeness(plain_signatures(text), plain_signatures(edit)), abs=1e-9)
        assert r["near_next"] == pytest.approx(likeness(plain_signatures(text), plain_signatures(after)), abs=1e-9)
        prints[text].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_successors_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 7)
    docs = spark.createDataFrame([(i * i, f"text {i}") for i in range(100)], "doc_id long, text string")
    got = {r["key"]: r["next_text"] for r in spotsigs.neighbours(docs).collect()}
    assert got == {i * i: f"text {(i + 1) % 100}" for i in range(100)}


def test_near_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    marked = cut(docs.select("doc_id", spotsigs.signatures(F.col("text")).alias("sigs")))
    sets = {}
    for r in marked.orderBy("doc_id").collect():
        sets.setdefault(frozenset(r["sigs"]), r["doc_id"])
    want = {
        (a, b)
        for s, a in sets.items()
        for t, b in sets.items()
        if (len(s), a) < (len(t), b) and len(s & t) >= 0.8 * len(s | t) - 1e-12
    }
    got = {(r["a"], r["b"]) for r in spotsigs.near_pairs(marked, key="doc_id", sigs="sigs").collect()}
    assert got == want


def test_pipeline(spark):
    """Every stage works on what the one before kept, and the last one packs all of it."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = cut(corpus_pipeline.keep_quality(spark, docs, SMALL))
    score = {r["doc_id"]: r["predicted"] for r in REGISTRY["op1_quality"](spark, SMALL).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {k for k, p in score.items() if p}
    lines = cut(corpus_pipeline.dedup_lines(spark, kept, SMALL))
    left = queries.line_dedup.dedup(kept).where("removed = 0 OR left > 0")
    assert sorted(r["text"] for r in lines.collect()) == sorted(r["text"] for r in left.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    near = cut(corpus_pipeline.keep_one_of_near(spark, lines, SMALL))
    parts = plain_components({r["doc_id"]: r["text"] for r in lines.collect()}, 5, 4, 5)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(k for k, (_, root) in parts.items() if root == k)
    mixed = cut(corpus_pipeline.mix_sources(spark, near, SMALL))
    assert kept.columns == lines.columns == near.columns == mixed.columns == columns
    taken = {r["doc_id"]: r["copies"] for r in queries.mixing.taken(near).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: n for k, n in taken.items() if n})
    packed = corpus_pipeline.pack_sequences(spark, mixed, SMALL)
    assert packed.where("piece = 0").count() == mixed.count()


@pytest.mark.parametrize("seed", [0, 1])
def test_large_groups_of_near_copies_and_bridges(spark, seed):
    """Most sets link with a pivot, some only with others, and chains lead from one cluster to the next."""
    rng = np.random.default_rng(seed)
    rule, rows = ngram_join.Rule(3, 9, 10), []
    base = [f"w{i}" for i in range(200)]
    words = list(base)
    for i in range(60):  # a chain: each link changes one more word, so its ends do not link
        words = list(words)
        words[(7 * i) % 200] = f"c{i}"
        rows.append((1000 + i, " ".join(words)))
    for i in range(200):  # a cluster around the first
        near = list(base)
        near[int(rng.integers(0, 200))] = f"n{i}"
        rows.append((2000 + i, " ".join(near)))
    other = [f"w{i}" if i % 3 else f"o{i}" for i in range(200)]
    for i in range(60):  # sets that share many n-grams with the others and link among themselves
        near = list(other)
        near[int(rng.integers(0, 200))] = f"m{i}"
        rows.append((3000 + i, " ".join(near)))
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string"))
    want = plain_components(dict(rows), 3, 9, 10)
    for block_tokens in (500, 5000):
        got = ngram_join.linked_components(docs, rule, block_tokens=block_tokens).collect()
        assert {r["key"]: (r["n"], r["component"]) for r in got} == want


def test_sets_inside_a_star_are_not_paired(spark):
    """Two thousand copies that all link with each other: a set is sent to no pair of blocks."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[:50], f"x{i}", *base[51:]])) for i in range(400)]
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string"))
    held = cut(docs.select(F.lit(1).cast("long").alias("root"), F.col("doc_id").alias("id"), F.encode(F.repeat(F.lit("12345678"), 20), "utf-8").alias("tokens")))
    groups = cut(spark.createDataFrame([(1, 400)], "root long, sets long"))
    rule = ngram_join.Rule(3, 9, 10)
    stars = ngram_join.star_links(held, groups, rule)
    sizes = cut(held.select("id", F.lit(20).cast("long").alias("n")))
    assert ngram_join._meeting(held, stars, sizes, 100).count() == 0
    got = ngram_join.linked_components(docs, rule, block_tokens=1000).collect()
    assert {r["component"] for r in got} == {0}


def test_sets_that_meet_by_chance_form_no_group(spark, monkeypatch):
    """Texts of common words share some n-grams with many others, though their slots tell none of them from rare ones."""
    rng = np.random.default_rng(5)
    rule, rows = ngram_join.Rule(5, 4, 5), []
    common = [" ".join(f"c{i}_{k}" for k in range(5)) for i in range(60)]
    for i in range(300):  # 24 words of its own, then a passage that others have, six times
        own = [" ".join(f"w{i}_{j}_{k}" for k in range(24)) for j in range(6)]
        rows.append((i, " ".join(x for j in range(6) for x in (own[j], common[int(rng.integers(0, 60))]))))
    for i in range(20):  # copies of some with one word changed
        words = rows[i][1].split(" ")
        words[90] = f"x{i}"
        rows.append((1000 + i, " ".join(words)))
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string"))
    monkeypatch.setattr(ngram_join, "slot_counts", lambda _: np.ones(1 << ngram_join.SLOT_BITS, np.uint32))
    grouped, most = ngram_join._grouped, []

    def noted(docs, groups, *rest):
        most.append(groups.groupBy("root").count().agg(F.max("count")).first()[0])
        return grouped(docs, groups, *rest)

    monkeypatch.setattr(ngram_join, "_grouped", noted)
    got = {r["key"]: (r["n"], r["component"]) for r in ngram_join.linked_components(docs, rule).collect()}
    assert got == plain_components(dict(rows), 5, 4, 5)
    assert most[0] <= 20
