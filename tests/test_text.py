import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crossblock.functions import likelihood, positions, prompts, text
from crossblock.functions.values import running_totals
from crossblock.operators import donors, score
from crossblock.plans import measure
from crossblock.sources import manifest, vectors


@pytest.mark.parametrize(
    "raw, slug",
    [
        ("Côte d'Ivoire", "cote-d-ivoire"),
        ("C++", "c-plus-plus"),
        ("F#", "f-sharp"),
        ("Simon & Schuster", "simon-and-schuster"),
        ("  Rubik's   Cube ", "rubik-s-cube"),
        ("Catch-22", "catch-22"),
        ("日本", ""),
    ],
)
def test_slugs(spark, raw, slug):
    assert spark.createDataFrame([(raw,)], "t string").select(text.slugify("t")).first()[0] == slug


def test_entities_and_first_lines(spark):
    df = spark.createDataFrame([(" Reykjavík\x1f CITY \n", " a b \nc\n")], "t string, u string")
    row = df.select(text.normalize_entity("t"), text.first_line("u")).first()
    assert tuple(row) == ("reykjavik city", "a b")


def test_blank_prompts_and_the_template_hash(spark):
    # Fixed value: the hash of the default template.
    assert prompts.PromptText().template_hash == "1759f5f1931e1e70"
    df = spark.createDataFrame([("q", " ")], "question string, answer string")
    with pytest.raises(Exception, match="is blank"):
        prompts.render_prompts(df).collect()


def rendered(spark, answer="Paris"):
    df = spark.createDataFrame([("Where?", answer)], "question string, answer string")
    return prompts.render_prompts(df)


def test_positions_of_a_prompt(spark):
    found = positions.resolve_positions(rendered(spark, "New York").withColumn("tokens", positions.encode("prompt")))
    row = found.first()
    assert row["position_error"] is None
    pieces = [row["prompt"][t["start"]:t["end"]] for t in row["tokens"]]
    assert [pieces[row[f"pos_{n}"]] for n in ("AC", "LAT", "NL", "NL1", "CC")] == [":", " York", "\n", "Confidence", ":"]
    assert pieces[row["answer_start"]:row["answer_end"]] == [" New", " York"]
    assert row["n_answer_tokens"] == 2 and len(row["input_ids"]) == row["n_tokens"]
    long = positions.token_table(found.withColumn("k", F.lit(1)), ["k"])
    counts = long.agg(*[F.count_if(c) for c in ("in_answer", "in_after_answer", "in_post_newline",
                                                "in_suffix_before_cc", "in_CC")]).first()
    assert tuple(counts) == (2, 3, 2, 1, 1)
    with pytest.raises(KeyError):
        positions.in_position_set("elsewhere")
    window = found.select(positions.token_window("prompt", "tokens", F.col("pos_NL"))).first()[0]
    assert window.count("*") == 1 and window.endswith(":")


def merged(spans, text_, *pairs):
    """Merge tokens so that a piece runs over the given (start, end)."""
    out = []
    for s, e in spans:
        if any(lo <= s and e <= hi for lo, hi in pairs):
            if out and any(lo <= out[-1][0] and e <= hi for lo, hi in pairs):
                out[-1] = (out[-1][0], e)
                continue
        out.append((s, e))
    return out


def test_broken_boundaries_are_coded(spark):
    base = rendered(spark).first()
    a, p = base["anchors"], base["prompt"]
    spans = [m.span() for m in re.finditer(positions.PIECES, p)]
    colon, start, end, nl, cc = (a["answer_colon"], a["answer_start"], a["answer_end"], a["newline"],
                                 a["confidence_colon"])
    cases = {
        "AC_RUNS_PAST_COLON": merged(spans, p, (colon, end)),
        "LAT_RUNS_PAST_ANSWER": merged(spans, p, (colon + 1, nl + 1)),
        "NEWLINE_NOT_ITS_OWN_TOKEN": merged(spans, p, (nl, cc)),
        "CC_NOT_LAST_TOKEN": [*spans, (cc + 1, cc + 2)],
        "AC_UNCOVERED": [x for x in spans if x[0] != colon],
        "ANSWER_START_UNCOVERED": [x for x in spans if not x[0] <= start < x[1]],
        "NEWLINE_UNCOVERED": [x for x in spans if x[0] != nl],
        "NO_TOKEN_AFTER_NEWLINE": [x for x in spans if x[0] <= nl],
        "CC_UNCOVERED": spans[:-1],
        "NOT_STRICTLY_ORDERED": merged(spans, p, (nl + 1, cc + 1)),
        None: [(0, 0), *spans],
    }
    for code, broken in cases.items():
        df = rendered(spark).withColumn(
            "tokens",
            F.array(*[F.struct(F.lit(1).alias("id"), F.lit(s).alias("start"), F.lit(e).alias("end"))
                      for s, e in broken]),
        )
        assert positions.resolve_positions(df).first()["position_error"] == code


def test_external_tokens(spark):
    df = spark.createDataFrame([([1, 2], [(0, 1), (1, 2)])], "ids array<int>, off array<struct<start:int,end:int>>")
    got = df.select(positions.tokens_from_parts("ids", "off").alias("t")).first()["t"]
    assert [tuple(x) for x in got] == [(1, 0, 1), (2, 1, 2)]
    short = spark.createDataFrame([([1], [(0, 1), (1, 2)])], "ids array<int>, off array<struct<start:int,end:int>>")
    with pytest.raises(Exception, match="1 ids do not pair with 2 offsets"):
        short.select(positions.tokens_from_parts("ids", "off").alias("t")).collect()


def test_class_tokens(spark):
    schema = "label string, tokens array<int>"
    good = spark.createDataFrame([("high", [5]), ("low", [6])], schema)
    assert tuple(likelihood.class_tokens(good).first()) == (5, 6)
    with pytest.raises(Exception, match="not a single token"):
        likelihood.class_tokens(spark.createDataFrame([("high", [5, 1]), ("low", [6])], schema)).collect()
    with pytest.raises(Exception, match="same token"):
        likelihood.class_tokens(spark.createDataFrame([("high", [5]), ("low", [5])], schema)).collect()


def test_likelihood_forms_agree(spark):
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(6, 9)) * 20
    rows = [(1, i, [float(v) for v in x]) for i, x in enumerate(logits)]
    predicted = spark.createDataFrame(rows, "k int, index int, logits array<double>")
    tokens = spark.createDataFrame([(1, i, i % 9, 2 <= i < 5) for i in range(6)],
                                   "k int, index int, token_id int, in_answer boolean")
    found = likelihood.answer_logprobs(predicted, tokens, ["k"])
    expected = [logits[i - 1, i % 9] - np.log(np.exp(logits[i - 1]).sum()) for i in (2, 3, 4)]
    assert [r["logprob"] for r in found.orderBy("index").collect()] == pytest.approx(expected)
    long = likelihood.likelihood_stats(found, ["k"]).first().asDict()
    array = spark.createDataFrame([([float(x) for x in expected],)], "x array<double>")
    wide = likelihood.with_array_stats(array, "x").first().asDict()
    for name in set(long) - {"k"}:
        assert long[name] == pytest.approx(wide[name])
    assert long["lp_var"] == pytest.approx(np.var(expected))
    assert likelihood.with_array_stats(spark.createDataFrame([([-2.0],)], "x array<double>"), "x").first()["lp_var"] == 0.0


def test_batches_have_one_length(spark):
    def factory():
        def run(pdf):
            assert pdf["n_tokens"].nunique() == 1 and len(pdf) <= 8
            return pd.DataFrame({"z": pdf["id"] * 2.0, "size": len(pdf)})

        return run

    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5).cast("int").alias("n_tokens"))
    out = score.score(df, factory, "z double, size long", key=["id"], batch_size=8).toPandas()
    assert len(out) == 500 and (out["z"] == out["id"] * 2).all()
    bad = score.score(df, lambda: (lambda pdf: pd.DataFrame({"z": [1.0]})), "z double", key=["id"], batch_size=8)
    with pytest.raises(Exception, match="scorer returned 1 rows"):
        bad.collect()


def test_select_rows(cells):
    first = score.select_rows(cells, splits=["train"], n_blocks=5)
    assert first.count() == 20 and first.select("split").distinct().count() == 1
    with pytest.raises(ValueError, match="100000 blocks are wanted"):
        score.select_rows(cells, n_blocks=100_000)


def test_measured_cells(cells):
    def factory():
        return lambda pdf: pd.DataFrame({"confidence_margin": pdf["answer_start"].astype(float)})

    out = measure.measure(cells, factory)
    assert out.count() == cells.count()
    assert out.where("pos_AC >= confidence_margin OR confidence_margin IS NULL").count() == 0


def test_unresolved_cells_fail(cells):
    def blind():
        return lambda text: [(1, 0, len(text))]

    with pytest.raises(Exception, match="unresolved position: AC_RUNS_PAST_COLON"):
        measure.resolved_cells(cells, tokenizer=blind).select("n_tokens").collect()


def vector_table(spark, rows=24, layers=3, width=6):
    data = [
        (r, layer, "NL", [float(np.sin(r * 7 + layer * 3 + d)) for d in range(width)])
        for r in range(rows)
        for layer in range(layers)
    ]
    return spark.createDataFrame(data, "row long, layer int, position string, vec array<float>")


def test_vector_store(spark, tmp_path):
    table = vector_table(spark)
    path = f"{tmp_path}/v"
    vectors.write_vectors(table.where("row < 10"), path)
    vectors.write_vectors(table.where("row >= 10"), path)
    back = vectors.read_vectors(spark, path, [1])
    assert "PartitionFilters: [isnotnull(layer" in back._jdf.queryExecution().executedPlan().toString()
    assert back.count() == 24
    whole = vectors.read_vectors(spark, path)
    assert vectors.shape_faults(whole, n_rows=24, d_model=6).count() == 0
    assert vectors.shape_faults(whole.where("row > 0 OR layer > 0"), n_rows=24, d_model=6).count() == 1
    pair = table.join(whole.withColumnRenamed("vec", "half"), ["row", "layer", "position"]).toPandas()
    for a, b in zip(pair["vec"], pair["half"], strict=True):
        assert (np.asarray(a, np.float32).astype(np.float16).astype(np.float32) == np.asarray(b, np.float32)).all()


def test_noise(spark):
    table = vector_table(spark)
    out = {}
    for n in (1, 5):
        noise = donors.gaussian_vectors(table.repartition(n), key=["row"], seed=3)
        out[n] = noise.orderBy("row", "layer").toPandas()
    real = table.orderBy("row", "layer").toPandas()
    for a, b, v in zip(out[1]["vec"], out[5]["vec"], real["vec"], strict=True):
        assert (np.asarray(a) == np.asarray(b)).all()
        assert np.linalg.norm(a) == pytest.approx(np.linalg.norm(v), rel=1e-4)
        assert not np.allclose(a, v)
    pool = np.concatenate([np.asarray(v) / np.linalg.norm(v) for v in out[1]["vec"]])
    assert abs(pool.mean()) < 0.08


def test_donors(spark):
    cells = spark.range(80).select(
        F.concat(F.lit("b"), F.floor(F.col("id") / 4)).alias("block_id"),
        F.concat(F.lit("c"), F.col("id") % 4).alias("cell"),
    )
    pairs = spark.range(4000).select(
        F.concat(F.lit("b"), F.col("id") % 20).alias("block_id"), F.col("id").alias("pair")
    )
    drawn = donors.draw_donors(pairs, cells, key=["pair"], seed="s")
    assert drawn.count() == 4000
    assert drawn.where("block_id = donor_block").count() == 0
    hits = [r["count"] for r in drawn.groupBy("donor_block", "donor_cell").count().collect()]
    assert len(hits) == 80 and min(hits) > 20 and max(hits) < 90
    one = cells.where("block_id = 'b1'")
    with pytest.raises(Exception, match="no donor outside"):
        donors.draw_donors(pairs.where("block_id = 'b1'"), one, key=["pair"], seed="s").collect()


def test_fingerprint_sees_content_not_order(spark):
    table = vector_table(spark).select("row", "layer", "position")
    first = manifest.fingerprint(table).first()
    assert first == manifest.fingerprint(table.repartition(7).orderBy(F.col("row").desc())).first()
    assert first != manifest.fingerprint(table.withColumn("layer", F.col("layer") + 1)).first()
    doubled = manifest.fingerprint(table.union(table)).first()
    assert doubled["hash_xor"] == 0 and doubled["hash_sum"] != "0"


def test_default_pieces_and_a_custom_tokenizer(spark):
    texts = ["", " a  b", "x1-y\n Z", "é 日本 a", None, "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = {r["i"]: r["k"] for r in df.select("i", positions.encode("t").alias("k")).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else [m.span() for m in re.finditer(positions.PIECES, t)]
        assert (got[i] and [(x["start"], x["end"]) for x in got[i]]) == (want or got[i])
        assert (got[i] is None) == (t is None)
    def blanks():
        return lambda t: [(len(m[0]), *m.span()) for m in re.finditer("[^ ]+", t)]

    own = df.select(positions.encode("t", blanks).alias("k")).collect()
    assert [tuple(x) for x in own[1]["k"]] == [(1, 1, 2), (1, 4, 5)]


def test_snapshots_drift(spark):
    df = rendered(spark).withColumn("tokens", positions.encode("prompt"))
    now = positions.position_snapshot(positions.resolve_positions(df), ["question"])
    assert positions.snapshot_drift(now, now).count() == 0
    other = rendered(spark, "Lyon").withColumn("tokens", positions.encode("prompt"))
    before = positions.position_snapshot(positions.resolve_positions(other), ["question"])
    found = positions.snapshot_drift(now.union(now), before).collect()
    assert sorted(r["side"] for r in found) == ["current", "current", "frozen"]


def test_field_drift(spark):
    schema = "key long, a int, b string"
    now = spark.createDataFrame([(1, 1, "x"), (2, None, "y"), (3, 5, None), (4, None, None)], schema)
    was = spark.createDataFrame([(1, 1, "x"), (2, 2, "y"), (4, None, None), (5, 7, "z")], schema)
    found = {r["key"]: (r["change"], [tuple(f) for f in r["fields"]]) for r in positions.field_drift(now, was, ["key"]).collect()}
    assert found == {
        2: ("changed", [("a", "2", None)]),
        3: ("added", [("a", None, "5"), ("b", None, None)]),
        5: ("missing", [("a", "7", None), ("b", "z", None)]),
    }
    with pytest.raises(Exception, match="a key of a snapshot repeats"):
        positions.field_drift(now.union(now), was, ["key"]).collect()
    df = rendered(spark).withColumn("tokens", positions.encode("prompt"))
    snap = positions.position_snapshot(positions.resolve_positions(df), ["question"])
    assert positions.field_drift(snap, snap, ["question"]).count() == 0


def test_default_tokens_of_long_and_odd_texts(spark):
    import hashlib
    import re

    texts = [None, "", "a", " ", "é 😀x y\n\n", "a b." * 25_000, "x" * 5000, " lead  two", "日本 語12"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("k", positions.encode("t"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        if r["t"] is None:
            assert r["k"] is None
            continue
        want = [
            (int(hashlib.md5(m[0].encode()).hexdigest()[:7], 16), m.start(), m.end())
            for m in re.finditer(positions.PIECES, r["t"])
        ]
        assert [tuple(k) for k in r["k"]] == want


def test_a_worker_holds_the_tokens_of_few_texts():
    """However many texts a batch has, their tokens are made and handed over in small lots."""
    texts = pa.array([None if i % 7 == 0 else "a b" * (i % 3) for i in range(300)])
    run = lambda t: [(len(m[0]), *m.span()) for m in re.finditer("[^ ]+", t)]
    lots = list(positions.token_arrays(run, iter([texts, texts.slice(0, 5)])))
    assert max(map(len, lots)) <= positions.TEXTS
    got = [None if x is None else [tuple(t.values()) for t in x] for lot in lots for x in lot.to_pylist()]
    assert got == [None if t is None else run(t) for t in [*texts.to_pylist(), *texts.slice(0, 5).to_pylist()]]


def test_running_totals_across_runs(spark):
    """Short arrays, whole runs, and arrays of several runs."""
    rows = [(n, [(i * 7) % 5 for i in range(n)]) for n in (0, 1, 2, 63, 64, 65, 128, 500)] + [(-1, None)]
    df = spark.createDataFrame(rows, "n int, x array<int>")
    got = {r["n"]: r["t"] for r in df.select("n", running_totals(F.col("x")).alias("t")).collect()}
    for n, x in rows:
        assert got[n] == (None if x is None else np.cumsum(x).tolist())


def test_cells_are_counted_without_their_ids(spark):
    """The length of a prompt needs no token ids; they were made and dropped in a pass of their own."""
    cells = rendered(spark).withColumns({"block_id": F.lit("b"), "cell": F.lit("q1a1")})
    counted = measure.counted_cells(cells.drop("prompt", "anchors", "prompt_sha256", "template_hash"))
    assert "md5" not in counted._jdf.queryExecution().optimizedPlan().toString().lower()
    whole = positions.resolve_positions(cells.withColumn("tokens", positions.encode("prompt")))
    assert counted.first()["n_tokens"] == whole.first()["n_tokens"]
