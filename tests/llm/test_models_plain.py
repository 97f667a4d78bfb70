"""The quality classifier and language identification, held against plain Python versions."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossblock.llm import language, quality
from crossblock.session import cut

SMALL = "/root/testdata/sf0.001"


# Quality.


def odds(part, whole):
    return math.log((part + 0.5) / (max(whole - part, 0) + 0.5))


def plain_statistics(text):
    data = (text or "").encode()
    size = len(data)
    among = lambda chars: sum(data.count(c) for c in chars.encode())
    upper, lower = (sum(data.count(c) for c in range(a, a + 26)) for a in (65, 97))
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    lengths, n = [len(w) for w in words], len(words)
    mean = sum(lengths) / max(n, 1)
    spread = sum(x * x for x in lengths) / max(n, 1) - mean**2
    folded = Counter(w.lower() for w in words)
    lines = data.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    closed = sum(line[-1:] in b".!?:\"'" for line in lines if line)
    distinct = len({line.strip() for line in lines})
    shares = [c / size for c in Counter(data).values()] if size else []
    return [
        odds(upper, upper + lower),
        odds(among("#$%&*+/<=>@[]^_`{|}~\\"), size),
        odds(among("!?"), size),
        odds(among("0123456789"), size),
        odds(among(" \t\n\x0b\x0c\r"), size),
        odds(among("."), n),
        odds(among(",;:"), n),
        odds(sum(b >= 128 for b in data), size),
        math.log1p(mean),
        0.5 * math.log1p(max(spread, 0)),
        odds(sum(x <= 3 for x in lengths), n),
        odds(sum(65 <= w[0] <= 90 for w in words), n),
        math.log1p(len(folded)) / math.log1p(max(n, 1)),
        odds(max(folded.values(), default=0), n),
        math.log1p(size / max(len(lines), 1)),
        odds(len(lines) - distinct, len(lines)),
        odds(closed, len(lines)),
        -sum(s * math.log2(s) for s in shares),
    ]


def plain_discriminant(x, y, every):
    """Posterior of class 1 for `every`, from explicit covariances, determinants and inverses."""
    d = x.shape[1]
    parts = [x[y == c] for c in (0, 1)]
    centre = np.mean([p.mean(0) for p in parts], axis=0)
    scale = np.mean([p.std(0) for p in parts], axis=0) + 1e-3
    bend = lambda v: quality.BEND * np.tanh((v - centre) / scale / quality.BEND)
    parts = [bend(p) for p in parts]
    scatters = [(p - p.mean(0)).T @ (p - p.mean(0)) for p in parts]
    n = np.array([len(p) for p in parts])
    pooled = sum(scatters) / n.sum()
    t = quality.TO_DIAGONAL
    pooled = (1 - t) * pooled + t * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
    logs = []
    for p, s, k in zip(parts, scatters, n, strict=True):
        pull = max(quality.TO_POOLED, d / (k + d))
        covariance = (1 - pull) * s / k + pull * pooled
        off = bend(every) - p.mean(0)
        far = np.einsum("ij,jk,ik->i", off, np.linalg.inv(covariance), off)
        logs.append(math.log(k / n.sum()) - 0.5 * np.linalg.slogdet(covariance)[1] - 0.5 * far)
    return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))


ODD_TEXTS = ["", None, "\nstarts with a line feed", "ends.\n", "\n\n\n", "A", "é ö\r\nü! a a A", " \t ", "x" * 3000, "a\nb\na\nb"]


def test_quality_against_plain(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(110).select("doc_id", "text").collect()
    texts = {r["doc_id"]: r["text"] for r in docs} | {10**6 + i: t for i, t in enumerate(ODD_TEXTS)}
    frame = cut(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3))
    vectors = cut(quality.measured(frame))
    got = {r["key"]: r["x"] for r in vectors.collect()}
    plain = {k: plain_statistics(t) for k, t in texts.items()}
    for k in texts:
        assert np.allclose(got[k], plain[k], atol=1e-9), (k, texts[k], np.array(got[k]) - plain[k])
    # Labels that the statistics can tell in part.
    marks = {k: int(plain[k][17] + 0.1 * (k % 7) > 4.2) for k in texts}
    assert min(Counter(marks.values()).values()) >= 5
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    model = quality.fit(quality.with_labels(vectors, labels, key="doc_id", label="quality", where=F.col("key") % 3 != 0))
    scores = {r["key"]: r["score"] for r in quality.score(vectors, model).collect()}
    learnt = [k for k in texts if k % 3]
    x, y = np.array([plain[k] for k in learnt]), np.array([marks[k] for k in learnt])
    want = plain_discriminant(x, y, np.array([plain[k] for k in texts]))
    assert np.allclose([scores[k] for k in texts], want, atol=1e-7)
    none = quality.score(vectors.where("false"), model)
    assert none.count() == 0


# Language.


def plain_grams(text):
    """Counts of hashed 1- to 3-grams over letters and spaces."""
    points = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    counts = Counter()
    for order in language.ORDERS:
        for i in range(len(points) - order + 1):
            h = order * 0x9E3779B1 & 0xFFFFFFFF
            for p in points[i : i + order]:
                h = (h ^ p) * 0x85EBCA6B & 0xFFFFFFFF
                h ^= h >> 15
            counts[(h * 0xC2B2AE35 & 0xFFFFFFFF) >> (32 - language.BITS)] += 1
    return counts


def plain_language(learnable, every):
    """learnable: (key, lang, text), all of them trained on; returns (language, score) of `every`."""
    counted = [plain_grams(t) for _, _, t in learnable]
    df = Counter(b for c in counted for b in c)
    idf = lambda b: math.log((1 + len(learnable)) / (1 + df[b])) + 1

    def vector(counts):
        raw = {b: (1 + math.log(n)) * idf(b) for b, n in counts.items()}
        size = max(math.sqrt(sum(v * v for v in raw.values())), 1e-12)
        return {b: v / size for b, v in raw.items()}

    def place(i):
        key, lang, _ = learnable[i]
        at = sorted(counted[i])
        return lang, key, np.array(at, "<u4").tobytes(), np.array([counted[i][b] for b in at], "<u4").tobytes()

    rows = sorted(range(len(learnable)), key=place)
    langs = sorted({lang for _, lang, _ in learnable})
    examples = [(vector(counted[i]), langs.index(learnable[i][1])) for i in rows]
    rng = np.random.default_rng(language.SEED)
    order = rng.permutation(len(examples))
    cut_at = int(len(order) * language.KEPT_BACK) if len(langs) > 1 else 0
    back, rest = order[:cut_at], order[cut_at:]
    turns = [examples[i] for _ in range(language.EPOCHS) for i in rng.permutation(rest)]
    z, n = Counter(), Counter()

    def weight(b, k):
        if abs(z[b, k]) <= language.L1:
            return 0.0
        pull = (language.BETA + math.sqrt(n[b, k])) / language.ALPHA + language.L2
        return -(z[b, k] - math.copysign(language.L1, z[b, k])) / pull

    def logits(features):
        return [sum(v * weight(b, k) for b, v in features.items()) for k in range(len(langs))]

    for features, label in turns:
        features = features | {"bias": 1.0}
        told = logits(features)
        top = max(told)
        parts = [math.exp(t - top) for t in told]
        for k in range(len(langs)):
            error = parts[k] / sum(parts) - (k == label)
            held = {b: weight(b, k) for b in features}
            for b, v in features.items():
                g = v * error
                step = (math.sqrt(n[b, k] + g * g) - math.sqrt(n[b, k])) / language.ALPHA
                z[b, k] += g - step * held[b]
                n[b, k] += g * g
    kept = np.array([logits(examples[i][0] | {"bias": 1.0}) for i in back]).reshape(len(back), len(langs))
    truth = [examples[i][1] for i in back]
    best, doubt = (math.inf, 1.0), 1 / (len(back) + 2)
    for t in np.geomspace(0.02, 20, 120):
        loss = 0.0
        for row, label in zip(kept / t, truth, strict=True):
            logs = np.log(np.exp(row - row.max()).sum()) + row.max() - row
            loss += (1 - doubt) * logs[label] + doubt * logs.mean()
        best = min(best, (loss / max(len(back), 1), float(t)))
    out = []
    for text in every:
        if text is None or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        told = np.array(logits(vector(plain_grams(text)) | {"bias": 1.0})) / (best[1] if len(back) else 1.0)
        p = np.exp(told - told.max())
        out.append((langs[int(p.argmax())], float(p.max() / p.sum())))
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_language_against_plain(spark, parts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 600").orderBy("doc_id").limit(70)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    rows += [(10**6, None, "en"), (10**6 + 1, "12 !?", "de"), (10**6 + 2, "Été ÇA 日本", None), (10**6 + 3, "", "fr")]
    frame = cut(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts))
    learns = F.col("doc_id") % 3 != 1
    got = {r["key"]: (r["lang_pred"], r["score"]) for r in language.predict(frame, language.fit(frame, where=learns)).collect()}
    learnable = [(k, lang, t) for k, t, lang in rows if k % 3 != 1 and lang and t and any(c.isalpha() for c in t)]
    want = plain_language(learnable, [t for _, t, _ in rows])
    for (k, _, _), (name, score) in zip(rows, want, strict=True):
        assert got[k][0] == name and got[k][1] == pytest.approx(score, abs=1e-4), k
