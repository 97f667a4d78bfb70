"""Whitening, prefix trie and lattice scores, held against plain Python and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crossblock.llm import lattice, prefix_trie, whitening
from crossblock.llm.queries import REGISTRY, pieces_file
from crossblock.session import cut

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# Whitening.


def plain_whitening(vectors, wanted=16):
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(wanted, int((e > 1e-10 * e[0]).sum())) if e[0] > 0 else 0
    white = (x - sums / n) @ q[:, :k] / np.sqrt(e[:k])
    return n, ((n * x - sums) ** 2).sum(1), white, e[:k] / e.sum()


def test_whitening_against_eigenvectors(spark):
    emb = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").toPandas()
    n, deviation, white, explained = plain_whitening(np.stack(emb["embedding"]))
    got = REGISTRY["op11_whitening"](spark, SMALL).orderBy("vec_id", "component").toPandas()
    assert got["vec_id"].tolist() == [v for v in emb["vec_id"] for _ in range(16)]
    assert got["component"].tolist() == list(range(1, 17)) * len(emb)
    assert set(got["n"]) == {n} and got["deviation"].tolist() == [int(d) for d in deviation for _ in range(16)]
    found = got["whitened"].to_numpy().reshape(-1, 16)
    sign = np.sign((found * white).sum(0))
    assert np.abs(found - white * sign).max() < 1e-8
    assert np.allclose(got["explained"][:16], explained, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def few_directions(spark, parts):
    """Vectors of rank 3 in 6 dimensions, with two equal eigenvalues and repeated rows."""
    rows = []
    for i, (axis, size) in enumerate([(0, 2), (0, -2), (1, 1), (1, -1), (2, 1), (2, -1)]):
        vec = [0.0] * 6
        vec[axis] = float(size)
        rows += [(100 * i + j, vec) for j in range(1 + 40 * (i == 0))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)


@pytest.mark.parametrize("parts", [1, 5])
def test_whitening_finds_equal_eigenvalues_and_counts_vectors_once(spark, parts):
    got = whitening.whiten(few_directions(spark, parts)).orderBy("key", "component").toPandas()
    assert set(got["n"]) == {6} and got["component"].max() == 3
    assert np.allclose(sorted(got["explained"].unique(), reverse=True)[0], 4 / 6)
    assert got["identity_error"].max() < 1e-12
    rows = got.pivot(index="key", columns="component", values="whitened")
    once = rows[rows.index % 100 == 0]
    assert np.allclose(once.T @ once / 6, np.eye(3))


def test_whitening_odd_rows(spark):
    rows = [
        (1, [0.5, 1.0], 7),
        (1, [0.5, 1.0], 8),
        (None, [-0.5, 2.0], 7),
        (2, None, 7),
        (3, [1.0, None], 7),
        (4, [1.0, float("nan")], 7),
        (5, [float("inf"), 1.0], 7),
        (6, [], 7),
        (7, [0.0, 0.0], 7),
        (8, [1.0, 2.0, 3.0], 7),
        (9, [2.0, 2.0, 4.0], 7),
        (10, [1.0], 7),
        (11, [1e300, 1.0], 7),
    ]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int").withColumn("x", F.lit(1))
    got = whitening.whiten(odd).toPandas()
    by = Counter(tuple(r) for r in got[["key", "n"]].fillna(-1).itertuples(index=False))
    # Three distinct pairs have two directions; two distinct triples have one; one single has none.
    assert by == {(1, 3): 4, (-1, 3): 2, (7, 3): 2, (8, 2): 1, (9, 2): 1}
    none = whitening.whiten(odd.where("false"))
    assert none.count() == 0 and none.columns == got.columns.tolist()
    assert whitening.whiten(odd.where("vec_id = 10")).count() == 0


def test_deviations_stay_exact():
    big = 1 << 60
    x = np.array([[big, -big], [big + 1, 5], [3, 4]], np.int64)
    sums = [int(v) for v in x.astype(object).sum(0)]
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.Centre(3, tuple(sums)).deviations(x) == [Decimal(w) for w in want]
    sums = [int(v) for v in (x >> 50).sum(0)]
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x >> 50]
    assert whitening.Centre(3, tuple(sums)).deviations(x >> 50) == [Decimal(w) for w in want]


# Prefix trie.


def plain_trie(turns):
    """turns: rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            said = (role or "", text or "")
            digest = hashlib.md5(f"{len(said[0])}:{said[0]}{said[1]}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, said))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    nodes = {}
    for conv in sorted(own):
        share = zlib.crc32(str(conv).encode()) % 6
        base = int(math.fmod(conv, 100))
        path = own.get(conv - base, [])[:share] + own[conv][share:]
        for d in range(len(path) + 1):
            node = nodes.setdefault(tuple(path[:d]), {"members": [], "ends": [], "kids": set()})
            node["members"].append(conv)
            if d < len(path):
                node["kids"].add(tuple(path[: d + 1]))
            else:
                node["ends"].append(conv)
    for path in sorted(nodes, key=len, reverse=True):
        node = nodes[path]
        node["leaves"] = sum(nodes[k]["leaves"] for k in node["kids"]) or 1
        own_part = (len(node["members"]) - 1) * (len(path[-1][1]) if path else 0)
        node["saved"] = own_part + sum(nodes[k]["saved"] for k in node["kids"])
    return sorted(
        (
            n["members"][0],
            len(p),
            nodes[p[:-1]]["members"][0] if p else None,
            len(n["members"]),
            len(n["kids"]),
            n["leaves"],
            n["saved"],
            hashlib.sha256(",".join(map(str, n["ends"])).encode()).hexdigest(),
        )
        for p, n in nodes.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(rows, **how):
    turns = prefix_trie.ordered(rows)
    conv = F.col("conv")
    share = F.crc32(conv.cast("string").cast("binary")) % 6
    rebuilt, convs = prefix_trie.share_heads(turns, base=conv - conv % 100, share=share, most=5)
    return sorted(tuple(r) for r in prefix_trie.trie(rebuilt, convs, **how).select(*COLUMNS).collect())


TURNS = "conv_id long, turn long, role string, text string"


def many_turns():
    """Copies, long conversations, missing values, repeated rows, turnless conversations, negative ids."""
    rng = np.random.default_rng(4)
    rows = []
    for conv in [*range(-120, 40), *range(300, 420), 1007, 2013]:
        for turn in range(int(rng.integers(1, 12))):
            text = ["yes", "no", "", None, "日本語😀"][int(rng.integers(0, 5 if turn > 2 else 1))]
            rows.append((conv, turn, "user" if turn % 2 == 0 else None, text))
    rows += [(500 + i % 3, t, "user", f"t{t}") for i in range(3) for t in range(300)]
    rows += [(7, None, "user", "first"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (None, 1, "user", "x")]
    rows += [(50, 1, "user", "one turn only"), (53, 1, None, None)]
    return rows


@pytest.mark.parametrize("block", [1, 3, 4])
def test_trie_against_plain(spark, block):
    rows = many_turns()
    odd = cut(spark.createDataFrame(rows, TURNS).withColumn("k1", F.lit(1)).withColumn("conv", F.lit("c")).repartition(7))
    assert trie_of(odd, block=block) == plain_trie(rows)


def test_trie_over_many_parts_and_long_runs(spark, monkeypatch):
    """A conversation that spans sort partitions, and more equal conversations than a run holds."""
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    monkeypatch.setattr(prefix_trie, "sized_lookup", _salted(prefix_trie.sized_lookup))
    rows = [(100 * i, t, "user", f"long {t}") for i in (1, 2) for t in range(700)]
    rows += [(3000 + 100 * i, t, "user", f"copy {t}") for i in range(40) for t in range(3)]
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        odd = cut(spark.createDataFrame(rows, TURNS))
        parts = prefix_trie.ordered(odd).where("conv = 100").select("part").distinct().count()
        assert parts > 1
        assert trie_of(odd) == plain_trie(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _salted(lookup):
    """The form of the lookup that large tables take."""
    import crossblock.operators.lookup as module

    def run(*args):
        held, module.SMALL = module.SMALL, 0
        try:
            return lookup(*args)
        finally:
            module.SMALL = held

    return run


def test_trie_query_and_empty_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MID}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = REGISTRY["op12_prefix_trie"](spark, MID)
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == plain_trie(rows)
    assert trie_of(spark.createDataFrame([], TURNS)) == []


# Lattice scores.


def words_of(text):
    folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", folded)


def plain_forward(word, chances):
    held = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        held[j] = sum(held[i] * chances.get(word[i:j], 0.0) for i in range(j))
    return held


def plain_scores(docs, learnt, rounds):
    """docs and learnt: lists of word lists. One round: expected counts over all segmentations."""
    prior = lattice.vocabulary(pieces_file())
    first = dict(zip(prior.strings, np.exp(prior.logs), strict=True))
    chances, close = dict(first), math.exp(prior.close)
    counts = Counter(w for words in learnt for w in words)
    for _ in range(rounds if counts else 0):
        expected = Counter({s: lattice.PRIOR * p for s, p in first.items()})
        for w in counts:
            word = lattice.MARK + w.encode()
            left, right = plain_forward(word, chances), [0.0] * len(word) + [1.0]
            for i in reversed(range(len(word))):
                right[i] = sum(chances.get(word[i:j], 0.0) * right[j] for j in range(i + 1, len(word) + 1))
            for i in range(len(word)):
                for j in range(i + 1, len(word) + 1):
                    if word[i:j] in chances:
                        expected[word[i:j]] += left[i] * chances[word[i:j]] * right[j] / right[0]
        closing = lattice.PRIOR * math.exp(prior.close) + len(counts)
        whole = sum(expected.values()) + closing
        chances, close = {s: c / whole for s, c in expected.items()}, closing / whole
    tokens = sum(counts.values()) + len(learnt)
    spelled = (lattice.DISCOUNT * len(counts) + 1) / (tokens + 2) * close

    def word_log(w):
        whole = max(counts[w] - lattice.DISCOUNT, 0) / (tokens + 2)
        return math.log10(whole + spelled * plain_forward(lattice.MARK + w.encode(), chances)[-1])

    kinds = len(counts) + bool(learnt)
    below = math.log10(tokens + 0.1 * (kinds + 1))
    out = []
    for words in docs:
        score = sum(map(word_log, words)) + math.log10((len(learnt) + 1) / (tokens + 2))
        base = sum(math.log10(counts[w] + 0.1) for w in words) + math.log10(len(learnt) + 0.1) - below * (len(words) + 1)
        out.append((len(words) + 1, sum(counts[w] > 0 for w in words) + bool(learnt), tokens, base, score))
    return out


@pytest.mark.parametrize(("rounds", "heavy"), [(0, 500_000), (2, 500_000), (2, 20)])
def test_lattice_against_plain(spark, monkeypatch, rounds, heavy):
    """With every word handed to all tasks, and with most words joined."""
    monkeypatch.setattr(lattice, "HEAVY", heavy)
    texts = [
        "The cat sat on the mat. The cat!",
        None,
        "",
        " \t\n",
        "Étion zueinander 日本語 😀 the",
        "ÀB c THE",
        "the the the the " * 5,
        "▁odd ▁ marks",
        "the cat",
        "the cat",
    ]
    ids = [1, 2, 3, 4, 5, None, 7, 8, 9, 9]
    docs = cut(
        spark.createDataFrame(list(zip(ids, texts, [1] * 10, strict=True)), "doc_id long, text string, word int")
        .withColumn("n", F.lit(0)).repartition(3)
    )
    trains = F.col("doc_id").isin(1, 2, 5, 9)
    got = lattice.score(docs, pieces_file(), trains=trains, rounds=rounds).collect()
    learnt = [words_of(t) for i, t in zip(ids, texts, strict=True) if i in (1, 2, 5, 9)]
    want = plain_scores([words_of(t) for t in texts], learnt, rounds)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(map(tuple, got), key=key)
    want = sorted(((i, *w) for i, w in zip(ids, want, strict=True)), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)


def test_lattice_query_counts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in docs}
    counts = Counter(w for r in docs if not held[r["doc_id"]] for w in words_of(r["text"]))
    ends = sum(not h for h in held.values())
    tokens, kinds = sum(counts.values()) + ends, len(counts) + 1
    got = {r["doc_id"]: r for r in REGISTRY["op13_lm_score"](spark, SMALL).collect()}
    assert set(got) == set(held)
    for r in docs:
        words, g = words_of(r["text"]), got[r["doc_id"]]
        base = sum(math.log10((c + 0.1) / (tokens + 0.1 * (kinds + 1))) for c in [*(counts[w] for w in words), ends])
        assert (g["held_out"], g["n_tokens"], g["train_tokens"]) == (held[r["doc_id"]], len(words) + 1, tokens)
        assert g["n_known"] == sum(counts[w] > 0 for w in words) + 1
        assert g["base_score"] == pytest.approx(base, rel=1e-9) and g["score"] < 0


def test_lattice_masses_and_long_words(spark, monkeypatch):
    pieces = lattice.vocabulary(pieces_file())
    assert np.exp(pieces.logs).sum() + math.exp(pieces.close) == pytest.approx(1)
    model = lattice.Model(pieces, 30, 7, 4)
    edges = sum(c - lattice.DISCOUNT for c in [10, 5, 5, 3, 1, 1, 1])
    spelled = lattice.DISCOUNT * 7 + 1
    assert edges + spelled + math.exp(model.end) * 32 == pytest.approx(32)
    # Windows of a long word, and its expected counts: every byte lies in exactly one piece.
    word = pa.array(["ab" * 3000 + "日"])
    whole = lattice.word_logs(lattice.Lattice(pieces), word)
    monkeypatch.setattr(lattice, "CELLS", 1 << 10)
    grid = lattice.Lattice(pieces)
    assert lattice.word_logs(grid, word) == pytest.approx(whole)
    for _, data in lattice._same_width(word):
        expected = grid.expected(data)
    assert (expected * [len(s) for s in pieces.strings]).sum() == pytest.approx(1 + 6003)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lattice.score(none, pieces_file(), trains=F.lit(True)).count() == 0
    alone = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    untrained = {r["key"]: r for r in lattice.score(alone, pieces_file(), trains=F.lit(False)).collect()}
    assert untrained[2]["score"] == pytest.approx(math.log10(0.5)) and untrained[1]["train_tokens"] == 0
