"""The same queries as SQL over the driver tables, for checking."""

from __future__ import annotations

from crossblock.functions.keyed import GOLDEN, MASK, MULTIPLIER, POISSON
from crossblock.functions.names import (
    ANSWER_SOURCES,
    CELLS,
    FITTABLE_SPLITS,
    POLICY_STATUSES,
    SOURCE_KINDS,
    SPLITS,
    PositionNames,
)
from crossblock.functions.positions import ERRORS, PIECES, SETS
from crossblock.functions.prompts import PromptText
from crossblock.plans.inputs import PLACES, POSITIONS, SHARES, SHORT_PIECES, START, TEMPLATE_TEXTS, WIDTH
from crossblock.sources.contract import CELL_COLUMNS

Parts = list[tuple[str, str]]


def sql(parts: Parts, select: str) -> str:
    seen: dict[str, str] = {}
    for name, body in parts:
        seen.setdefault(name, body)
    head = ",\n".join(f"{name} AS ({body})" for name, body in seen.items())
    return f"WITH {head}\n{select}" if head else select


def rd(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name or expr}"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(text(v) for v in values)


def hex32(expr: str, index: int = 0) -> str:
    return f"CAST(('0x' || substr({expr}, {1 + 8 * index}, 8)) AS BIGINT)"


def unit(expr: str) -> str:
    return f"({hex32(f'md5({expr})')} / CAST(4294967296 AS DOUBLE))"


def band(expr: str) -> str:
    return (
        f"CASE WHEN {expr} < CAST(0.7 AS DOUBLE) THEN 'train' "
        f"WHEN {expr} < CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE) THEN 'validation' ELSE 'test' END"
    )


def slug(expr: str) -> str:
    spoken = expr
    for symbol, word in (("+", " plus "), ("#", " sharp "), ("&", " and ")):
        spoken = f"replace({spoken}, '{symbol}', '{word}')"
    return f"trim(regexp_replace(lower({fold(spoken)}), '[^a-z0-9]+', '-', 'g'), '-')"


def fold(expr: str) -> str:
    return f"regexp_replace(strip_accents({expr}), '[^\\x00-\\x7F]+', '', 'g')"


def array(values) -> str:
    return f"[{listed(values)}]"


# Natural 2x2.

LINE = (
    "line",
    """SELECT 'supplier-' || l_suppkey AS block_id,
      CAST(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS INTEGER) AS q_index,
      CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS INTEGER) AS a_index,
      'q' || q_index || 'a' || a_index AS cell,
      l_extendedprice * (l_discount - CAST(0.05 AS DOUBLE)) / 370 AS v,
      l_quantity, l_orderkey, l_linenumber,
      CAST(floor(round(l_tax * 100) * 5 / 9) AS INTEGER) AS tier FROM lineitem""",
)
BEHAVIOR = (
    "behavior",
    """SELECT block_id, cell, q_index, a_index, q_index = a_index AS matched,
      avg(v) AS confidence_margin, sum(l_quantity) > 25.5 * count(*) AS correct,
      CAST(length(CAST(min(l_orderkey) AS VARCHAR)) AS INTEGER) AS n_answer_tokens
      FROM line GROUP BY ALL""",
)
PAIRS = (
    "pairs",
    """SELECT t.block_id, t.cell AS target_cell, s.cell AS source_cell,
      CASE WHEN t.matched THEN 'ablate' ELSE 'restore' END AS direction,
      t.confidence_margin AS target_clean, s.confidence_margin AS source_clean
      FROM behavior t JOIN behavior s
      ON t.block_id = s.block_id AND t.q_index = s.q_index AND t.a_index <> s.a_index""",
)
NATURAL: Parts = [LINE, BEHAVIOR, PAIRS]
READOUTS = """p.*, patched, patched - target_clean AS moved, source_clean - target_clean AS gap,
  coalesce(sign(patched) <> sign(target_clean), true) AS flipped"""


def measured(name: str, axes: str) -> tuple[str, str]:
    return (
        name,
        f"""SELECT {READOUTS}, m.* EXCLUDE (block_id, target_cell, patched) FROM pairs p JOIN (
      SELECT block_id, cell AS target_cell, {axes}, avg(v) AS patched FROM line GROUP BY ALL) m
      USING (block_id, target_cell)""",
    )


POSITION = f"{array(POSITIONS)}[tier + 1] AS position"
SWEEP = measured("sweep", f"{POSITION}, CAST(l_linenumber - 1 AS INTEGER) AS layer")
CONTROLS = measured(
    "controls", f"{POSITION}, {array(SOURCE_KINDS)}[least(l_linenumber, 6)] AS source_kind"
)
GAPS = (
    "gaps",
    """SELECT block_id, avg(confidence_margin) FILTER (matched)
      - avg(confidence_margin) FILTER (NOT matched) AS gap FROM behavior GROUP BY 1""",
)
CONTRASTS = (
    "contrasts",
    """SELECT block_id, q1a1 - q1a2 - q2a1 + q2a2 AS interaction,
      (q1a1 - q1a2 - q2a1 + q2a2) / 2 AS delta_fit FROM (SELECT block_id,
      """
    + ", ".join(f"max(confidence_margin) FILTER (cell = '{c}') AS {c}" for c in CELLS)
    + " FROM behavior GROUP BY 1)",
)


# Bootstrap draws.


def draws(blocks: str, n_boot: int, seed: int = 0) -> Parts:
    """Per (block_id, r): Poisson weight w and sign s, through the 32-bit mixing steps."""

    def step(src: str, extra: str) -> str:
        return f"SELECT {extra}, (xor(x >> 16, x) * {MULTIPLIER}) & {MASK} AS x FROM {src}"

    weight = "CASE " + " ".join(
        f"WHEN x < {edge} THEN {k}" for k, edge in enumerate(POISSON)
    ) + f" ELSE {len(POISSON)} END"
    keep = "block_id, h1, h2, r"
    return [
        ("dw", f"SELECT block_id, {hex32('h')} AS h0, {hex32('h', 1)} AS h1, {hex32('h', 2)} AS h2 "
               f"FROM (SELECT DISTINCT block_id, md5('{seed}:' || block_id) AS h FROM {blocks})"),
        ("d0", f"SELECT block_id, h1, h2, r, (h0 + r * {GOLDEN}) & {MASK} AS x "
               f"FROM dw, range({n_boot}) t(r)"),
        ("d1", step("d0", keep)),
        ("d2", step("d1", keep)),
        ("d3", f"SELECT {keep}, xor(x >> 16, x) AS x FROM d2"),
        ("w0", "SELECT block_id, r, xor(x, h1) AS x FROM d3"),
        ("w1", step("w0", "block_id, r")),
        ("w2", step("w1", "block_id, r")),
        ("w3", f"SELECT block_id, r, xor(x >> 16, x) AS x FROM w2"),
        ("s0", "SELECT block_id, r, xor(x, h2) AS x FROM d3"),
        ("s1", step("s0", "block_id, r")),
        ("s2", step("s1", "block_id, r")),
        ("s3", f"SELECT block_id, r, xor(x >> 16, x) AS x FROM s2"),
        ("weights", f"SELECT block_id, r, CAST({weight} AS DOUBLE) AS w FROM w3"),
        ("signs", "SELECT block_id, r, CASE WHEN x < 2147483648 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM s3"),
    ]


def group_by(keys: list[str]) -> str:
    return f"GROUP BY {', '.join(keys)}" if keys else ""


def cols(keys: list[str]) -> str:
    return "".join(f"{k}, " for k in keys)


def using(keys: list[str]) -> str:
    return f"JOIN %s USING ({', '.join(keys)})" if keys else "CROSS JOIN %s"


def edges(value: str, prefix: str = "") -> str:
    return (
        f"quantile_cont({value}, 0.025) AS {prefix}ci_low, "
        f"quantile_cont({value}, 0.975) AS {prefix}ci_high"
    )


def mean_estimate(
    blocks: str, value: str, keys: list[str], n_boot: int, permutation: bool, name: str = "est"
) -> Parts:
    k = cols(keys)
    parts = [
        (f"{name}_b", f"SELECT {k}block_id, CAST({value} AS DOUBLE) AS x FROM {blocks} WHERE {value} IS NOT NULL"),
        (f"{name}_p", f"""SELECT {k}avg(x) AS mean, count(*) AS n_blocks, CASE
          WHEN avg(x) > 0 THEN avg(CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0 END)
          WHEN avg(x) < 0 THEN avg(CASE WHEN x < 0 THEN 1.0::DOUBLE ELSE 0 END) ELSE 0 END
          AS sign_consistency FROM {name}_b {group_by(keys)}"""),
        (f"{name}_r", f"""SELECT {k}r, CASE WHEN sum(w) > 0 THEN sum(w * x) / sum(w) END AS m FROM {name}_b
          JOIN weights USING (block_id) GROUP BY {k}r"""),
        (f"{name}_c", f"SELECT {k}{edges('m')} FROM {name}_r {group_by(keys)}"),
    ]
    tail = "p.* , c.ci_low, c.ci_high"
    joins = f"{name}_p p {using(keys) % f'{name}_c c'}"
    if permutation:
        parts += [
            (f"{name}_f", f"""SELECT {k}r, sum(s * x) AS f FROM {name}_b
              JOIN signs USING (block_id) GROUP BY {k}r"""),
            (f"{name}_q", f"""SELECT {k}(count(*) FILTER (abs(f / n_blocks) >= abs(mean)
              * (1 - CAST(1e-12 AS DOUBLE))) + 1) / CAST({n_boot + 1} AS DOUBLE) AS p_permutation
              FROM {name}_f {using(keys) % f'{name}_p'} {group_by(keys)}"""),
        ]
        tail += ", q.p_permutation"
        joins += " " + using(keys) % f"{name}_q q"
    parts.append(
        (name, f"SELECT {tail}, c.ci_low > 0 OR c.ci_high < 0 AS excludes_zero FROM {joins}")
    )
    return parts


def summary(rows: str, keys: list[str], n_boot: int, name: str = "summ") -> Parts:
    """Patch summary: ratio and shift over blocks, flips over pairs."""
    k = cols(keys)
    return [
        (f"{name}_b", f"""SELECT {k}block_id, avg(moved) AS moved, avg(gap) AS gap,
          sum(CASE WHEN flipped THEN 1 ELSE 0 END) AS flips, count(*) AS pairs
          FROM {rows} GROUP BY {k}block_id"""),
        *draws(f"{name}_b", n_boot),
        (f"{name}_r", f"""SELECT {k}r, sum(w * moved) AS wn, sum(w * gap) AS wd, sum(w) AS w1
          FROM {name}_b JOIN weights USING (block_id) GROUP BY {k}r"""),
        (f"{name}_c", f"""SELECT {k}{edges('CASE WHEN wd <> 0 THEN wn / wd END')},
          {edges('CASE WHEN w1 <> 0 THEN wn / w1 END', 'moved_')} FROM {name}_r GROUP BY {', '.join(keys)}"""),
        (name, f"""SELECT {k}avg(moved) / avg(gap) AS effect, any_value(c.ci_low) AS ci_low,
          any_value(c.ci_high) AS ci_high,
          avg(CASE WHEN gap <> 0 THEN CASE WHEN moved / gap > 0 THEN 1.0::DOUBLE ELSE 0 END END)
          AS sign_consistency, avg(moved) AS mean_moved,
          any_value(c.moved_ci_low) AS moved_ci_low, any_value(c.moved_ci_high) AS moved_ci_high,
          CAST(sum(flips) AS DOUBLE) / sum(pairs) AS flip_rate, avg(gap) AS mean_gap,
          count(*) AS n_blocks FROM {name}_b JOIN {name}_c c USING ({', '.join(keys)})
          GROUP BY {', '.join(keys)}"""),
    ]


SUMMARY = ["effect", "ci_low", "ci_high", "sign_consistency", "mean_moved", "moved_ci_low",
           "moved_ci_high", "flip_rate", "mean_gap"]
SHORT = ["effect", "ci_low", "ci_high", "mean_moved", "flip_rate"]


def rounded(names: list[str]) -> str:
    return ", ".join(rd(n) for n in names)


# Route conditions.

_names = ["clean", "cut one", "cut two", "only via NL", "cut three", "cut four", "only direct", "cut everything"]
_edges = [0, 1, 2, 1, 3, 4, 2, 1]
SCORED = (
    "scored",
    f"""SELECT m.*, b.matched, b.n_answer_tokens FROM (SELECT block_id, cell, r.condition, r.edges_cut,
      avg(v) AS confidence_margin FROM (SELECT *, unnest([{{'condition': 'clean', 'edges_cut': 0}},
      {{'condition': {array(_names)}[least(l_linenumber, {len(_names) - 1}) + 1],
        'edges_cut': {_edges}[least(l_linenumber, {len(_names) - 1}) + 1]}}])
      AS r FROM line) GROUP BY ALL) m JOIN behavior b USING (block_id, cell)""",
)


def conditions(n_boot: int) -> Parts:
    return [
        SCORED,
        ("cblock", """SELECT condition, block_id, any_value(edges_cut) AS edges_cut,
          avg(confidence_margin) FILTER (matched) - avg(confidence_margin) FILTER (NOT matched) AS gap,
          sum(confidence_margin) FILTER (matched) AS sm, count(*) FILTER (matched) AS nm,
          sum(confidence_margin) FILTER (NOT matched) AS sc, count(*) FILTER (NOT matched) AS nc,
          min(n_answer_tokens) = max(n_answer_tokens) AS one FROM scored GROUP BY 1, 2"""),
        ("members", """SELECT 'all' AS subset, * FROM cblock UNION ALL
          SELECT 'length_matched', * FROM cblock WHERE one"""),
        *draws("members", n_boot),
        *mean_estimate("members", "gap", ["condition", "subset"], n_boot, False, "cest"),
        ("ctab", """SELECT e.condition, e.subset, m.edges_cut, e.mean AS gap, e.ci_low, e.ci_high,
          e.mean / c.mean AS share_of_clean, m.mean_matched, m.mean_crossed, e.n_blocks FROM cest e
          JOIN (SELECT condition, subset, any_value(edges_cut) AS edges_cut,
            sum(sm) / sum(nm) AS mean_matched, sum(sc) / sum(nc) AS mean_crossed
            FROM members GROUP BY 1, 2) m USING (condition, subset)
          LEFT JOIN cest c ON c.subset = e.subset AND c.condition = 'clean'"""),
    ]


# Facts.

RAW = (
    "raw",
    """SELECT c.*, n.n_name, n.n_regionkey, m.n_name AS next_nation FROM customer c
      JOIN nation n ON c_nationkey = n.n_nationkey
      JOIN nation m ON (c_nationkey + 1) % 25 = m.n_nationkey""",
)
FACTS = (
    "facts",
    f"""SELECT *, c_mktsegment AS relation_family, c_name AS subject, 'the firm ' || c_name AS subject_phrase,
      n_name AS answer, CASE WHEN c_acctbal < 0 THEN [{slug('next_nation')}] ELSE [] END AS also_correct,
      {slug('c_name')} AS subject_slug, {slug('n_name')} AS answer_slug,
      c_mktsegment || ':' || {slug('c_name')} AS fact_id,
      'q:' || c_mktsegment || ':' || {slug('c_name')} AS question_id,
      'a:' || c_mktsegment || ':' || {slug('n_name')} AS answer_id,
      list_distinct(['a:' || c_mktsegment || ':' || {slug('n_name')}]
        || list_transform(also_correct, lambda s: 'a:' || c_mktsegment || ':' || s)) AS correct_ids
      FROM raw""",
)
SPLIT = [
    ("clusters", """SELECT relation_family, answer_id, count(*) AS cluster_size FROM facts GROUP BY 1, 2"""),
    ("laid", """SELECT *, sum(cluster_size) OVER o - cluster_size AS before,
      sum(cluster_size) OVER (PARTITION BY relation_family) AS total, row_number() OVER o - 1 AS rk,
      count(*) OVER (PARTITION BY relation_family) AS n FROM clusters WINDOW o AS (PARTITION BY relation_family
      ORDER BY md5('7:' || relation_family || ':' || answer_id), answer_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    ("banded", f"SELECT *, {band('(before + cluster_size / CAST(2 AS DOUBLE)) / total')} AS band FROM laid"),
    ("counted", """SELECT *, greatest(2, count(*) FILTER (band = 'validation') OVER f) AS k_validation,
      greatest(2, count(*) FILTER (band = 'test') OVER f) AS k_test
      FROM banded WINDOW f AS (PARTITION BY relation_family)"""),
    ("cluster_split", """SELECT relation_family, answer_id, CASE WHEN relation_family = 'FURNITURE'
      THEN 'family_holdout' WHEN rk >= n - k_test THEN 'test' WHEN rk >= n - k_test - k_validation
      THEN 'validation' ELSE 'train' END AS split FROM counted"""),
    ("assigned", "SELECT facts.*, split FROM facts JOIN cluster_split USING (relation_family, answer_id)"),
]
FACT_PARTS: Parts = [RAW, FACTS, *SPLIT]


VALID = "coalesce(b IS NOT NULL AND NOT list_contains(cb, aa) AND NOT list_contains(ca, ab), false)"


def pairing(rounds: int) -> Parts:
    """Ranks that add up to a round's sum meet; what may not pair is laid out by answer and met again."""
    pool = "relation_family, split"
    both = "x.relation_family = y.relation_family AND x.split = y.split AND x.round = y.round"
    sides = """x.relation_family, x.split, x.round, x.fact_id AS a, x.answer_id AS aa, x.correct_ids AS ca, x.place AS pa,
      y.fact_id AS b, y.answer_id AS ab, y.correct_ids AS cb, y.place AS pb, x.n"""
    own = """CASE WHEN n % 2 = 1 THEN (((pa + pb) % n - 1 + n) % n) * ((n + 1) // 2) % n
      WHEN (pa + pb) % n % 2 = 1 THEN ((pa + pb) % n - 1) // 2 ELSE n // 2 + (pa + pb) % n // 2 END"""
    return [
        ("ranked_facts", f"""SELECT {pool}, fact_id, answer_id, correct_ids, count(*) OVER (PARTITION BY {pool}) AS n,
          row_number() OVER (PARTITION BY {pool} ORDER BY md5('7:' || fact_id), fact_id) - 1 AS place FROM assigned"""),
        ("seated", f"""SELECT *, CASE WHEN round >= n THEN place ELSE (CASE WHEN n % 2 = 1 THEN (2 * round + 1) % n
          WHEN 2 * round < n THEN 2 * round + 1 ELSE 2 * round - n END - place + n) % n END AS other
          FROM ranked_facts, range({rounds}) r(round)"""),
        ("judged", f"""SELECT *, {VALID} AS ok FROM (SELECT {sides} FROM seated x LEFT JOIN seated y ON {both}
          AND y.place = x.other AND y.place > x.place WHERE x.place <= x.other)"""),
        ("loose", f"""SELECT {pool}, round, a AS fact_id, aa AS answer_id, ca AS correct_ids, pa AS place, n FROM judged WHERE NOT ok
          UNION ALL SELECT {pool}, round, b, ab, cb, pb, n FROM judged WHERE NOT ok AND b IS NOT NULL"""),
        ("short", f"""SELECT {pool}, round, sum(k) AS m, max(k) AS h, arg_max(answer_id, (k, answer_id)) AS top
          FROM (SELECT {pool}, round, answer_id, count(*) AS k FROM loose GROUP BY ALL) GROUP BY ALL"""),
        ("broken", f"""SELECT * FROM (SELECT x.*, need, row_number() OVER (PARTITION BY x.relation_family, x.split, x.round
          ORDER BY md5('7:d:' || x.round || ':' || least(a, b) || ':' || greatest(a, b)), x.round, least(a, b), greatest(a, b)) - 1 AS rk
          FROM judged x JOIN (SELECT *, h - (m + 1) // 2 AS need FROM short) y ON {both}
          WHERE ok AND need > 0 AND NOT list_contains(ca, top) AND NOT list_contains(cb, top)) WHERE rk < need"""),
        ("free_facts", f"""SELECT * FROM loose UNION ALL SELECT {pool}, round, a, aa, ca, pa, n FROM broken
          UNION ALL SELECT {pool}, round, b, ab, cb, pb, n FROM broken"""),
        ("met", f"""SELECT *, row_number() OVER (PARTITION BY {pool}, round ORDER BY md5('7:' || round || ':' || answer_id),
          md5('7:' || round || ':' || fact_id), fact_id) - 1 AS i, (count(*) OVER (PARTITION BY {pool}, round) + 1) // 2 AS half FROM free_facts"""),
        ("mended", f"""SELECT *, row_number() OVER (PARTITION BY {pool}, least(a, b), greatest(a, b) ORDER BY round) AS again
          FROM (SELECT {sides} FROM met x JOIN met y ON {both} AND y.i = x.i + x.half)
          WHERE {VALID} AND ({own} >= {rounds} OR {own} = round)"""),
        ("fact_pairs", f"""SELECT {pool}, round, least(a, b) AS a, greatest(a, b) AS b FROM judged x
          WHERE ok AND NOT EXISTS (SELECT 1 FROM broken y WHERE y.a = x.a AND y.b = x.b AND y.round = x.round)
          UNION ALL SELECT {pool}, round, least(a, b), greatest(a, b) FROM mended WHERE again = 1"""),
    ]


TEMPLATES = (
    "templates",
    f"""SELECT c_mktsegment AS relation_family, CAST(o.i AS INTEGER) AS ordinal, c_mktsegment || '/t' || (o.i + 1)
      AS template_id, {array(TEMPLATE_TEXTS)}[o.i + 1] AS text
      FROM (SELECT DISTINCT c_mktsegment FROM customer), range({len(TEMPLATE_TEXTS)}) o(i)""",
)
PAIRED: Parts = [*FACT_PARTS, *pairing(2)]
BLOCKS: Parts = [
    *PAIRED,
    TEMPLATES,
    ("ranked", """SELECT *, (row_number() OVER (PARTITION BY relation_family, split
      ORDER BY md5('7:t:' || a || ':' || b), a, b) - 1) % 3 AS ordinal FROM fact_pairs"""),
    ("blocks", """SELECT r.*, t.template_id, t.text, f.subject_slug AS sa, g.subject_slug AS sb,
      r.relation_family || '/' || f.subject_slug || '__' || g.subject_slug || '/t' || (r.ordinal + 1) AS block_id
      FROM ranked r JOIN templates t ON t.relation_family = r.relation_family AND t.ordinal = r.ordinal
      JOIN facts f ON f.fact_id = r.a JOIN facts g ON g.fact_id = r.b"""),
]
BUILT: Parts = [
    *BLOCKS,
    ("cells", """SELECT block_id, b.relation_family, CAST(1 AS TINYINT) AS dataset_tier,
      'q' || q || 'a' || s AS cell, CAST(q AS TINYINT) AS q_index, CAST(s AS TINYINT) AS a_index,
      qf.question_id, af.answer_id, qf.subject, replace(b.text, '{s}', qf.subject_phrase) AS question,
      af.answer, q = s AS matched, list_contains(qf.correct_ids, af.answer_id) AS correct,
      CASE WHEN q = s THEN 'gold' ELSE 'distractor' END AS answer_source,
      CASE WHEN q = s THEN 'natural' ELSE 'off_policy' END AS policy_status, b.template_id, b.split
      FROM blocks b, (VALUES (1, 1), (1, 2), (2, 1), (2, 2)) v(q, s)
      JOIN facts qf ON qf.fact_id = CASE WHEN q = 1 THEN b.a ELSE b.b END
      JOIN facts af ON af.fact_id = CASE WHEN s = 1 THEN b.a ELSE b.b END"""),
]
UNCHECKED: Parts = [
    RAW,
    FACTS,
    ("seats", """SELECT *, CAST(floor(c_custkey * 2 / CAST(3 AS DOUBLE)) AS BIGINT) AS j,
      CASE WHEN c_custkey % 3 = 1 THEN 2 ELSE 1 END AS seat FROM facts"""),
    ("dirty", f"""SELECT 'pair-' || x.j AS block_id, x.c_mktsegment AS relation_family,
      CAST(x.n_regionkey + 1 AS TINYINT) AS dataset_tier, 'q' || x.seat || 'a' || y.seat AS cell,
      CAST(x.seat AS TINYINT) AS q_index, CAST(y.seat AS TINYINT) AS a_index,
      x.question_id, y.answer_id, x.c_name AS subject,
      CASE WHEN x.c_acctbal < -900 THEN {text(TEMPLATE_TEXTS[0])}
        ELSE replace({text(TEMPLATE_TEXTS[0])}, '{{s}}', x.c_name) END AS question,
      CASE WHEN y.c_acctbal > 9500 THEN lower(y.n_name) ELSE y.n_name END AS answer,
      CASE WHEN y.c_acctbal < -950 THEN x.seat <> y.seat ELSE x.seat = y.seat END AS matched,
      list_contains(x.correct_ids, y.answer_id) AS correct,
      CASE WHEN x.seat = y.seat THEN 'gold' WHEN x.c_acctbal < 0 THEN 'swap' ELSE 'distractor' END AS answer_source,
      CASE WHEN x.seat = y.seat THEN 'natural' ELSE 'off_policy' END AS policy_status,
      x.c_mktsegment || '/t1' AS template_id, CASE WHEN {unit("'11:' || x.question_id")} < CAST(0.02 AS DOUBLE)
      THEN 'family_holdout' ELSE {band(unit("'11:' || x.question_id"))} END AS split
      FROM seats x JOIN seats y USING (j)"""),
]


# Prompts and tokens.

_prompt = PromptText()
_open = f"{_prompt.instruction}\n\n{_prompt.question_prefix} "
PROMPTS: Parts = [
    ("turns", """SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q
      JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
      AND q.role = 'user' AND a.role = 'assistant'"""),
    ("prompts", f"""SELECT *, {text(_open)} || question || chr(10) AS head,
      head || 'Answer: ' || answer || chr(10) || 'Confidence:' AS prompt,
      CAST(length(head) + 7 AS INTEGER) AS answer_boundary, answer_boundary - 1 AS answer_colon,
      answer_boundary + 1 AS answer_start, CAST(answer_start + length(answer) AS INTEGER) AS answer_end,
      answer_end AS newline, answer_end + 11 AS confidence_colon FROM turns"""),
]


def tokens(rows: str, column: str, name: str = "tok", pattern: str = PIECES) -> Parts:
    return [
        (f"{name}_p", f"""SELECT conv_id, turn, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS index
          FROM (SELECT conv_id, turn, regexp_extract_all({column}, {text(pattern)}) AS ps FROM {rows})"""),
        (name, f"""SELECT conv_id, turn, CAST(index AS INTEGER) AS index, piece,
          CAST(('0x' || substr(md5(piece), 1, 7)) AS INTEGER) AS id,
          CAST(sum(length(piece)) OVER o - length(piece) AS INTEGER) AS start,
          CAST(sum(length(piece)) OVER o AS INTEGER) AS stop FROM {name}_p
          WINDOW o AS (PARTITION BY conv_id, turn ORDER BY index)"""),
    ]


def hit(char: str) -> str:
    return f"coalesce(max(index) FILTER (start <= {char} AND {char} < stop), -1)"


_at = {"ac": "answer_colon", "fst": "answer_start", "lat": "answer_end - 1", "nl": "newline",
       "cc": "confidence_colon"}


def resolved(tag: str = "", pattern: str = PIECES) -> Parts:
    """Tokens `tok` and positions `resolved` of all prompts, their names followed by the tag."""
    tok = f"tok{tag}"
    return [
        *PROMPTS,
        *tokens("prompts", "prompt", tok, pattern),
        (f"hits{tag}", f"""SELECT conv_id, turn, count(*) AS n, {', '.join(f'{hit(c)} AS {k}' for k, c in _at.items())}
          FROM {tok} JOIN prompts USING (conv_id, turn) GROUP BY 1, 2"""),
        (f"found{tag}", """SELECT h.*, p.* EXCLUDE (conv_id, turn), """
         + ", ".join(f"t{k}.start AS {k}_start, t{k}.stop AS {k}_stop" for k in _at)
         + f" FROM hits{tag} h JOIN prompts p USING (conv_id, turn) "
         + " ".join(f"LEFT JOIN {tok} t{k} ON t{k}.conv_id = h.conv_id AND t{k}.turn = h.turn AND t{k}.index = h.{k}"
                    for k in _at)),
        (f"resolved{tag}", "SELECT *, CASE " + " ".join(
            f"WHEN {c} THEN '{e}'" for c, e in zip([
                "ac < 0", "ac_stop <> answer_boundary", "fst < 0", "fst_start < answer_boundary", "lat < 0",
                "lat_stop <> answer_end", "nl < 0", "nl_start <> newline OR nl_stop <> newline + 1",
                "nl + 1 >= n", "cc < 0", "cc_stop <> confidence_colon + 1", "cc <> n - 1",
                "NOT (ac < lat AND lat < nl AND nl + 1 < cc)"], ERRORS, strict=True))
         + f" END AS position_error, nl + 1 AS af FROM found{tag}"),
    ]


RESOLVED = resolved()
_role = dict(zip(PositionNames().ordered(), ["ac", "lat", "nl", "af", "cc"], strict=True))


def snapshot(tag: str) -> str:
    """Checksum, length, and index and id at every position, as text."""
    fields = ["sha256(prompt) AS prompt_sha256", "CAST(n AS VARCHAR) AS n_tokens"]
    for p, v in _role.items():
        fields += [f'CAST(r.{v} AS VARCHAR) AS "pos_{p}"', f'CAST(k{v}.id AS VARCHAR) AS "tok_{p}"']
    joins = " ".join(
        f"LEFT JOIN tok{tag} k{v} ON k{v}.conv_id = r.conv_id AND k{v}.turn = r.turn AND k{v}.index = r.{v}" for v in _role.values()
    )
    return f"SELECT r.conv_id, r.turn, {', '.join(fields)} FROM resolved{tag} r {joins}"


def position_drift() -> str:
    names = ["prompt_sha256", "n_tokens", *[f"{k}_{p}" for p in _role for k in ("pos", "tok")]]
    other = "(c.turn IS NULL OR f.turn IS NULL OR c.\"{n}\" IS DISTINCT FROM f.\"{n}\")"
    listed_fields = ", ".join(
        f"""CASE WHEN {other.format(n=n)} THEN ['{n}', coalesce(f."{n}", '-') || '>' || coalesce(c."{n}", '-')] END""" for n in names
    )
    return sql(
        [*resolved(), *resolved("_short", SHORT_PIECES), ("snap_c", snapshot("") + " WHERE r.turn >= 2"),
         ("snap_f", snapshot("_short") + " WHERE r.turn <= 4"),
         ("diff", f"""SELECT coalesce(c.conv_id, f.conv_id) AS conv_id, coalesce(c.turn, f.turn) AS turn,
           CASE WHEN f.turn IS NULL THEN 'added' WHEN c.turn IS NULL THEN 'missing' ELSE 'changed' END AS change,
           list_filter([{listed_fields}], lambda x: x IS NOT NULL) AS d
           FROM snap_c c FULL JOIN snap_f f ON c.conv_id = f.conv_id AND c.turn = f.turn""")],
        """SELECT conv_id, turn, change, array_to_string(list_transform(d, lambda x: x[1]), ',') AS fields,
        array_to_string(list_transform(d, lambda x: x[2]), ',') AS "values" FROM diff WHERE len(d) > 0""",
    )


# Validation rules.


def rule(rows: str, rule_name: str, kind: str, broken: str, detail: str, ident: str) -> str:
    return (
        f"SELECT '{rule_name}' AS rule, {text(kind)} AS kind, {ident} AS id, "
        f"CAST({detail} AS VARCHAR) AS detail FROM {rows} WHERE {broken}"
    )


CELL_ID = "block_id || '/' || cell"
CROSSED = "NOT matched AND correct AND answer_source <> 'alias'"


def row_rules(rows: str) -> list[str]:
    out = [rule(rows, "row", f"{c} is null", f"{c} IS NULL", f"'{c}'", CELL_ID) for c in CELL_COLUMNS]
    for c in ("block_id", "relation_family", "question_id", "answer_id", "subject", "question",
              "answer", "template_id"):
        out.append(rule(rows, "row", f"{c} is empty", f"{c} = ''", f"'{c}'", CELL_ID))
    for c, d in {"cell": CELLS, "answer_source": ANSWER_SOURCES, "policy_status": POLICY_STATUSES,
                 "split": SPLITS}.items():
        out.append(rule(rows, "row", f"{c} outside its domain", f"{c} NOT IN ({listed(d)})", c, CELL_ID))
    for c, top in {"dataset_tier": 3, "q_index": 2, "a_index": 2}.items():
        out.append(rule(rows, "row", f"{c} out of range", f"{c} NOT BETWEEN 1 AND {top}", c, CELL_ID))
    q, a = "substr(cell, 2, 1)", "substr(cell, 4, 1)"
    out.append(rule(rows, "row", "cell disagrees with its indices",
                    f"CAST(q_index AS VARCHAR) <> {q} OR CAST(a_index AS VARCHAR) <> {a}", "cell", CELL_ID))
    out.append(rule(rows, "row", "cell disagrees with matched", f"matched <> ({q} = {a})", "cell", CELL_ID))
    out.append(rule(rows, "row", "crossed cell is correct without being an alias", CROSSED,
                    "answer_source", CELL_ID))
    return out


def block_rules(rows: str) -> tuple[Parts, list[str]]:
    constant = ["relation_family", "template_id", "split", "dataset_tier"]

    def lst(c: str) -> str:
        return f"array_to_string(list_sort(list_distinct(list({c}))), ',')"

    parts = [
        ("nrow", f"SELECT block_id, count(*) AS n FROM {rows} GROUP BY 1"),
        ("four", f"SELECT * FROM {rows} JOIN nrow USING (block_id) WHERE n = 4"),
        ("prof", f"""SELECT block_id, {lst('cell')} AS cells, count(DISTINCT question_id || '|' || answer_id) AS np,
          count(DISTINCT question_id) AS nq, count(DISTINCT answer_id) AS na,
          count(*) FILTER (matched) AS nm, {', '.join(f'count(DISTINCT {c}) AS n_{c}, {lst(c)} AS l_{c}' for c in constant)}
          FROM four GROUP BY 1"""),
        ("ident", """SELECT block_id, 'question' AS k, question_id AS i, matched FROM four
          UNION ALL SELECT block_id, 'answer', answer_id, matched FROM four"""),
    ]
    selects = [
        rule("nrow", "block", "row count", "n <> 4", "n", "block_id"),
        rule("prof", "block", "cells", f"cells <> {text(','.join(CELLS))}", "cells", "block_id"),
        rule("prof", "block", "pairs not unique", "np <> 4", "np", "block_id"),
        rule("prof", "block", "question identities", "nq <> 2", "nq", "block_id"),
        rule("prof", "block", "answer identities", "na <> 2", "na", "block_id"),
        rule("prof", "block", "matched cells", "nm <> 2", "nm", "block_id"),
        *[rule("prof", "block", f"{c} not constant", f"n_{c} <> 1", f"l_{c}", "block_id")
          for c in constant],
        """SELECT 'block' AS rule, k || ' not balanced' AS kind, block_id AS id, i || ':' ||
          count(*) FILTER (matched) || ':' || count(*) FILTER (NOT matched) AS detail FROM ident
          GROUP BY block_id, k, i HAVING count(*) FILTER (matched) <> 1 OR count(*) FILTER (NOT matched) <> 1""",
    ]
    return parts, selects


def label_rules(rows: str) -> list[str]:
    return [
        rule(rows, "label", "crossed cell is correct without being an alias", CROSSED, "answer_source", CELL_ID),
        rule(rows, "label", "matched cell is incorrect", "matched AND NOT correct", "answer_source", CELL_ID),
    ]


def leak_rules(rows: str) -> list[str]:
    return [
        f"""SELECT 'leak' AS rule, '{kind}' AS kind, {c} AS id,
          array_to_string(list_sort(list_distinct(list(split))), ',') AS detail FROM {rows}
          GROUP BY {c} HAVING count(DISTINCT split) > 1"""
        for kind, c in (("block", "block_id"), ("question identity", "question_id"),
                        ("answer identity", "answer_id"))
    ]


def family_rules(rows: str) -> list[str]:
    absent = f"list_filter({array(sorted(FITTABLE_SPLITS))}, lambda s: NOT list_contains(list(split), s))"
    return [
        f"""SELECT 'family' AS rule, 'held out and fittable' AS kind, relation_family AS id,
          'family_holdout' AS detail FROM {rows} GROUP BY relation_family
          HAVING bool_or(split = 'family_holdout') AND bool_or(split <> 'family_holdout')""",
        f"""SELECT 'family', 'absent from a fittable split', relation_family,
          array_to_string({absent}, ',') FROM {rows} GROUP BY relation_family
          HAVING bool_or(split <> 'family_holdout') AND len({absent}) > 0""",
    ]


def text_rules(rows: str) -> list[str]:
    return [
        rule(rows, "text", "unfilled placeholder", "question LIKE '%{%' OR question LIKE '%}%'", "question", CELL_ID),
        rule(rows, "text", "blank question or answer", "trim(question) = '' OR trim(answer) = ''", "''", CELL_ID),
        f"""SELECT 'text' AS rule, 'question text varies in a template' AS kind, question_id AS id,
          template_id AS detail FROM {rows} GROUP BY question_id, template_id HAVING count(DISTINCT question) > 1""",
        f"""SELECT 'text', 'answer text varies', answer_id, '' FROM {rows} GROUP BY answer_id
          HAVING count(DISTINCT answer) > 1""",
    ]


def union(selects: list[str]) -> str:
    return "\nUNION ALL\n".join(f"({s})" for s in selects)


_block_parts, _block_selects = block_rules("dirty")
ALL_RULES = union(
    row_rules("dirty") + _block_selects + label_rules("dirty") + leak_rules("dirty")
    + family_rules("dirty") + text_rules("dirty")
)


def _vectors() -> tuple[str, str]:
    return (
        "vectors",
        f"""SELECT vec_id AS "row", 'NL' AS position, CAST(l AS INTEGER) AS layer,
          embedding[l * {WIDTH} + 1:l * {WIDTH} + {WIDTH}] AS vec
          FROM embeddings, range(64 // {WIDTH}) t(l) WHERE l < len(embedding) // {WIDTH}""",
    )


VECTORS = _vectors()
NORM = "sqrt(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
VECTOR_CELLS = (
    "vcells",
    """SELECT *, 'q' || q_index || 'a' || a_index AS cell, q_index = a_index AS matched FROM (
      SELECT 'block-' || vec_id // 4 AS block_id, vec_id AS "row", (vec_id % 4) // 2 + 1 AS q_index,
      vec_id % 2 + 1 AS a_index FROM embeddings)""",
)


def pool(rows: str, tag: str = "") -> Parts:
    return [
        (f"pool_b{tag}", f"SELECT block_id, count(*) AS m, md5('pool:' || block_id) AS h FROM {rows} GROUP BY 1"),
        (f"pool_l{tag}", f"SELECT *, sum(m) OVER (ORDER BY h, block_id) - m AS lo FROM pool_b{tag}"),
        (f"pool{tag}", f"""SELECT r.block_id AS donor_block, r.cell AS donor_cell,
          lo + row_number() OVER (PARTITION BY r.block_id ORDER BY cell) - 1 AS index
          FROM {rows} r JOIN pool_l{tag} USING (block_id)"""),
    ]


def donors(kind: str, where: str) -> str:
    drawn = f"md5('7:NL:{kind}:' || block_id || ':' || target_cell)"
    u = f"(CAST(('0x' || substr({drawn}, 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"
    return sql(
        [
            *NATURAL,
            ("chosen", f"SELECT * FROM behavior WHERE {where}"),
            *pool("chosen"),
            ("own", f"""SELECT p.*, l.lo, coalesce(l.m, 0) AS m,
              floor({u} * (s.n - coalesce(l.m, 0))) AS u
              FROM pairs p LEFT JOIN pool_l l USING (block_id), (SELECT count(*) AS n FROM pool) s"""),
        ],
        """SELECT block_id, target_cell, source_cell, donor_block, donor_cell FROM own JOIN pool
        ON pool.index = CASE WHEN own.m > 0 AND own.u >= own.lo THEN own.u + own.m ELSE own.u END""",
    )


def control_rows() -> str:
    """Pairs of whole blocks, patched with the sums of five kinds of replacement vectors."""
    where = {"random_cell": "true", "matched_donor": "matched", "crossed_donor": "NOT matched"}
    parts: Parts = [
        VECTOR_CELLS,
        ("vsum", """SELECT vec_id AS "row", list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS z FROM embeddings"""),
        ("pcells", """SELECT block_id, "row", cell, q_index, a_index, matched, z FROM vcells JOIN vsum USING ("row")
          WHERE block_id IN (SELECT block_id FROM vcells GROUP BY 1 HAVING count(*) = 4)"""),
        ("places", f"""SELECT position, CAST(k AS INTEGER) AS k, CAST(share AS DOUBLE) AS share FROM (VALUES
          {', '.join(f"({text(p)}, {k}, {SHARES[p]})" for p, k in PLACES.items())}) t(position, k, share)"""),
        ("ppairs", """SELECT t.block_id, t.cell AS target_cell, t.matched, s."row" AS source_row, t.z AS target_clean, s.z AS source_clean,
          position, k, share FROM pcells t JOIN pcells s ON t.block_id = s.block_id AND t.q_index = s.q_index
          AND t.a_index <> s.a_index, places"""),
        ("el", f"""SELECT vec_id AS "row", position, ((i // {WIDTH}) - k + 8) % 8 AS layer, i, CAST(x AS DOUBLE) AS x
          FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), places"""),
        ("probe", f"""SELECT "row", position, sum(x) AS read FROM el WHERE layer >= {START} GROUP BY 1, 2"""),
        ("middle", f"""SELECT position, sum(m) AS read FROM (SELECT position, CAST(CAST(avg(x) AS FLOAT) AS DOUBLE) AS m
          FROM el WHERE layer >= {START} GROUP BY position, layer, i) GROUP BY 1"""),
    ]
    reads = ["""SELECT p.*, 'partner' AS source_kind, read FROM ppairs p JOIN probe b ON b."row" = source_row AND b.position = p.position""",
             "SELECT p.*, 'mean' AS source_kind, read FROM ppairs p JOIN middle USING (position)"]
    for kind, condition in where.items():
        drawn = f"md5('7:' || position || ':{kind}:' || block_id || ':' || target_cell)"
        u = f"(CAST(('0x' || substr({drawn}, 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"
        parts += [
            (f"c_{kind}", f"SELECT * FROM pcells WHERE {condition}"),
            *pool(f"c_{kind}", f"_{kind}"),
            (f"own_{kind}", f"""SELECT p.*, l.lo, coalesce(l.m, 0) AS m, floor({u} * (s.n - coalesce(l.m, 0))) AS u
              FROM ppairs p LEFT JOIN pool_l_{kind} l USING (block_id), (SELECT count(*) AS n FROM pool_{kind}) s"""),
        ]
        reads.append(
            f"""SELECT o.* EXCLUDE (lo, m, u), '{kind}' AS source_kind, read FROM own_{kind} o JOIN pool_{kind} d
            ON d.index = CASE WHEN o.m > 0 AND o.u >= o.lo THEN o.u + o.m ELSE o.u END
            JOIN pcells c ON c.block_id = d.donor_block AND c.cell = d.donor_cell
            JOIN probe b ON b."row" = c."row" AND b.position = o.position"""
        )
    parts += [("reads", union(reads)), ("patched_rows", "SELECT *, target_clean * (1 - share) + read * share AS patched FROM reads")]
    return sql(parts, f"""SELECT block_id, target_cell, position, source_kind, CAST({START} AS INTEGER) AS start_layer,
        CASE WHEN matched THEN 'ablate' ELSE 'restore' END AS direction, {rd('patched', digits=5)},
        {rd('patched - target_clean', 'moved', 5)}, {rd('source_clean - target_clean', 'gap', 5)} FROM patched_rows""")  # fmt: skip


def quantile(value: str, q: str, name: str) -> str:
    return rd(f"quantile_cont({value}, {q})", name)


SCORES = (
    "scores",
    """SELECT c_mktsegment AS relation_family, c_name AS subject, n_name AS gold, CASE WHEN c_acctbal < 0
      THEN next_nation WHEN c_acctbal > 8000 THEN lower(n_name) ELSE n_name END AS greedy_answer,
      c_acctbal / 370 AS gold_margin, greedy_answer = gold AS greedy_exact,
      lower(greedy_answer) = lower(gold) AS greedy_entity FROM raw""",
)
SCORE_SUMMARY = f"""count(*) AS n_facts, {rd('avg(greedy_exact::INT)', 'on_policy_exact')},
  {rd('avg(greedy_entity::INT)', 'on_policy_entity')}, count(*) FILTER (NOT greedy_entity) AS model_errors,
  {rd('avg((abs(gold_margin) < 10)::INT)', 'unsaturated_fraction')},
  {quantile('gold_margin', '0.5', 'median_gold_margin')} FROM scores"""

FACT_SCORES: Parts = [
    RAW,
    FACTS,
    TEMPLATES,
    ("names", "SELECT list(n_name ORDER BY n_nationkey) AS all_names FROM nation"),
    ("asked", f"""SELECT fact_id AS conv_id, 0 AS turn, f.*, replace(t.text, '{{s}}', subject_phrase) AS question,
      {text(_open)} || question || chr(10) || 'Answer:' AS head, head || ' ' || answer || chr(10) || 'Confidence:' AS prompt,
      length(head) + 1 AS first_char, first_char + length(answer) AS past_char,
      CAST(('0x' || substr(sha256(head), 1, 7)) AS BIGINT) AS drawn
      FROM facts f JOIN templates t ON t.relation_family = f.relation_family AND t.ordinal = 1"""),
    *tokens("asked", "prompt"),
    ("read", """SELECT conv_id, (sum(id) / CAST(count(*) AS DOUBLE) / 134217728 - 1) * 50 AS gold_margin,
      avg(id / CAST(268435456 AS DOUBLE)) FILTER (start < past_char AND stop > first_char) AS gold_nll_per_token,
      CAST(count(*) FILTER (start < past_char AND stop > first_char) AS INTEGER) AS gold_n_tokens
      FROM tok JOIN asked USING (conv_id, turn) GROUP BY 1"""),
    ("scores", """SELECT fact_id, relation_family, subject, question, answer AS gold,
      CASE WHEN drawn % 3 = 0 THEN lower(all_names[drawn % len(all_names) + 1]) ELSE all_names[drawn % len(all_names) + 1] END
      AS greedy_answer, gold_margin, gold_nll_per_token, gold_n_tokens, greedy_answer = gold AS greedy_exact,
      lower(greedy_answer) = lower(gold) AS greedy_entity FROM asked JOIN read USING (conv_id), names"""),
]

STATS = """avg(x) AS lp_mean, min(x) AS lp_min, max(x) AS lp_max, var_pop(x) AS lp_var,
  arg_min(x, i) AS lp_first, arg_max(x, i) AS lp_last, sum(x) AS lp_sum, -sum(x) AS nll,
  -avg(x) AS nll_per_token"""
STAT_NAMES = ["lp_mean", "lp_min", "lp_max", "lp_var", "lp_first", "lp_last", "lp_sum", "nll",
              "nll_per_token"]

AUC = """CAST(sum(pos * (below + neg / CAST(2 AS DOUBLE))) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg))
  AS auc FROM (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS below FROM (SELECT score,
  count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM scored_rows GROUP BY 1))"""


def gates_signal(sweep: tuple[str, str] = SWEEP) -> str:
    n = 10_000
    names = PositionNames()
    peaks = ", ".join(f"max(effect) FILTER (position = '{p}') AS \"p_{p}\"" for p in POSITIONS)
    return sql(
        [
            *NATURAL, sweep, CONTRASTS, *summary("sweep", ["direction", "position", "layer"], n),
            *mean_estimate("contrasts", "interaction", [], n, False),
            ("g", f"""SELECT {peaks}, avg(mean_gap) AS mean_clean_gap,
              arg_max({{'l': layer, 'm': mean_moved, 'f': flip_rate}}, (effect, -layer))
              FILTER (position = 'NL' AND effect IS NOT NULL) AS best FROM summ WHERE direction = 'restore'"""),
            ("k", """SELECT est.mean > 0 AND est.ci_low > 0 AS confidence_signal,
              coalesce("p_NL" >= CAST(0.3 AS DOUBLE), false) AS newline_effect_floor,
              coalesce("p_NL1" IS NOT NULL AND "p_NL" >= 2 * greatest("p_NL1", CAST(1e-6 AS DOUBLE)), false) AS newline_beats_next,
              coalesce("p_AC" IS NOT NULL AND "p_NL" >= 2 * greatest("p_AC", CAST(1e-6 AS DOUBLE)), false) AS newline_beats_answer_colon,
              "p_CC" IS NULL OR coalesce("p_CC" >= CAST(0.9 AS DOUBLE) * "p_NL", false) AS confidence_sanity, g.*
              FROM g, est"""),
        ],
        f"""SELECT confidence_signal, newline_effect_floor, newline_beats_next, newline_beats_answer_colon,
        confidence_sanity, confidence_signal AND newline_effect_floor AND newline_beats_next
        AND newline_beats_answer_colon AND confidence_sanity AS overall,
        coalesce(best.l, -1) AS newline_best_layer, coalesce(mean_clean_gap > 10, false) AS saturated,
        {rd('mean_clean_gap')}, {rd('best.m', 'newline_moved')}, {rd('best.f', 'newline_flip_rate')},
        {', '.join(rd(f'"p_{p}"', f'"peak_{p}"') for p in names.ordered())} FROM k""",
    )


def gates_route() -> str:
    return sql(
        [
            *NATURAL, SWEEP, *conditions(10_000),
            ("restore", "SELECT * FROM sweep WHERE direction = 'restore'"),
            ("iso_b", """SELECT position, layer, block_id, avg(moved) AS moved, avg(gap) AS gap,
              sum(CASE WHEN flipped THEN 1 ELSE 0 END) AS flips, count(*) AS pairs
              FROM restore GROUP BY 1, 2, 3"""),
            ("iso", """SELECT position, layer, avg(moved) / avg(gap) AS effect,
              CAST(sum(flips) AS DOUBLE) / sum(pairs) AS flip_rate FROM iso_b GROUP BY 1, 2"""),
            ("sh", """SELECT max(share_of_clean) FILTER (condition = 'cut everything' AND subset = 'all') AS gap_floor,
              max(share_of_clean) FILTER (condition = 'cut everything' AND subset = 'length_matched') AS gap_floor_length_matched,
              max(share_of_clean) FILTER (condition = 'only via NL' AND subset = 'all') AS share_only_newline,
              max(share_of_clean) FILTER (condition = 'only direct' AND subset = 'all') AS share_only_direct FROM ctab"""),
            ("pk", """SELECT arg_max({'e': effect, 'f': flip_rate}, (effect, -layer)) FILTER (position = 'NL') AS peak,
              max(flip_rate) FILTER (position IN ('NL1', 'AC')) AS control,
              max(effect) FILTER (position = 'NL') AS top FROM iso"""),
            ("cl", """SELECT coalesce(max(layer) FILTER (top > 0 AND effect >= CAST(0.9 AS DOUBLE) * top), -1) AS cliff
              FROM iso, pk WHERE position = 'NL'"""),
            ("k", """SELECT coalesce(gap_floor < CAST(0.05 AS DOUBLE), false) AS a, coalesce(share_only_newline > 0.5, false) AS b,
              coalesce(peak.f >= 0.5, false) AS c, coalesce(control < CAST(0.1 AS DOUBLE), false) AS d, * FROM sh, pk, cl"""),
        ],
        f"""SELECT a AS knockout_collapses_the_gap, b AS newline_alone_carries_the_signal,
        c AS isolated_patch_flips_decisions, d AS controls_stay_flat, a AND b AND c AND d AS overall,
        {rd('gap_floor')}, {rd('gap_floor_length_matched')}, gap_floor_length_matched IS NULL OR
        coalesce(gap_floor_length_matched < 0.5 * greatest(gap_floor, CAST(1e-6 AS DOUBLE)), false) AS floor_is_a_length_artefact,
        {rd('share_only_newline')}, {rd('share_only_direct')},
        coalesce(share_only_direct < 0.5, false) AS newline_is_necessary, {rd('peak.e', 'newline_peak_effect')},
        {rd('peak.f', 'newline_peak_flip_rate')}, cliff AS newline_read_cliff FROM k""",
    )


def gates_control() -> str:
    sides = ("restore", "ablate")
    flips = ", ".join(
        f"max(flip_rate) FILTER (source_kind = '{k}' AND direction = '{s}') AS {k}_{s}"
        for k in SOURCE_KINDS for s in sides
    )

    def beaten(kind: str) -> str:
        return (f"{kind}_ablate IS NULL OR coalesce(partner_ablate >= 3 * greatest({kind}_ablate, "
                f"CAST(0.01 AS DOUBLE)), false)")  # fmt: skip

    return sql(
        [
            *NATURAL, CONTROLS,
            ("cb", """SELECT position, source_kind, direction, block_id, avg(moved) AS moved, avg(gap) AS gap,
              sum(CASE WHEN flipped THEN 1 ELSE 0 END) AS flips, count(*) AS pairs FROM controls GROUP BY ALL"""),
            ("cs", """SELECT position, source_kind, direction, avg(moved) / avg(gap) AS effect,
              CAST(sum(flips) AS DOUBLE) / sum(pairs) AS flip_rate FROM cb GROUP BY ALL"""),
            ("one", f"""SELECT {flips}, max(effect) FILTER (source_kind = 'partner' AND direction = 'restore') AS er,
              max(effect) FILTER (source_kind = 'partner' AND direction = 'ablate') AS ea FROM cs WHERE position = 'NL'"""),
            ("k", f"""SELECT coalesce(partner_restore >= 0.5 AND partner_ablate >= 0.5, false) AS bidirectional,
              ({beaten('gaussian')}) AND ({beaten('mean')}) AS beats_destructive_controls,
              {beaten('crossed_donor')} AS effect_is_pair_specific, * FROM one"""),
        ],
        f"""SELECT bidirectional, beats_destructive_controls, effect_is_pair_specific,
        bidirectional AND beats_destructive_controls AND effect_is_pair_specific AS overall,
        {rd('partner_restore', 'partner_flip_restore')}, {rd('partner_ablate', 'partner_flip_ablate')},
        {rd('er', 'partner_effect_restore')}, {rd('ea', 'partner_effect_ablate')},
        coalesce(gaussian_restore >= 0.5, false) AS restore_is_confounded,
        {', '.join(rd(f'{k}_{s}') for k in SOURCE_KINDS[1:] for s in sides)} FROM k""",
    )


def row_hash(columns: list[str]) -> str:
    marked = ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '~')" for c in columns)
    return f"CAST(('0x' || substr(md5(concat_ws(chr(31), {marked})), 1, 15)) AS BIGINT)"


def fingerprint(rows: str, columns: list[str], prefix: str = "") -> str:
    h = row_hash(columns)
    return (
        f"bit_xor({h}) AS {prefix}hash_xor, CAST(sum(CAST({h} AS HUGEINT)) AS VARCHAR) AS {prefix}hash_sum, "
        f"count(*) AS {prefix}n_rows FROM {rows}"
    )


POINT_SUMMARY: Parts = [
    *NATURAL, SWEEP,
    ("ps_b", """SELECT position, layer, block_id, avg(moved) AS moved, avg(gap) AS gap,
      sum(CASE WHEN flipped THEN 1 ELSE 0 END) AS flips, count(*) AS pairs FROM sweep
      WHERE direction = 'restore' GROUP BY 1, 2, 3"""),
    ("ps", """SELECT position, layer, avg(moved) / avg(gap) AS effect, avg(moved) AS mean_moved,
      CAST(sum(flips) AS DOUBLE) / sum(pairs) AS flip_rate FROM ps_b GROUP BY 1, 2"""),
]

_W = r"[ \t\n\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_W}+|{_W}+$', '', 'g')"


def entity(expr: str) -> str:
    return f"trim(regexp_replace(lower({fold(strip(expr))}), '[ \\t\\n\\x0b\\f\\r\\x1c-\\x1f]+', ' ', 'g'))"


def moved_by_layer(n_boot: int) -> str:
    return sql(
        [*NATURAL, SWEEP,
         ("ml", "SELECT layer, block_id, avg(moved) AS moved FROM sweep GROUP BY 1, 2"),
         *draws("ml", n_boot), *mean_estimate("ml", "moved", ["layer"], n_boot, True)],
        f"SELECT layer, {rounded(['mean', 'sign_consistency'])}, n_blocks, "
        f"{rounded(['ci_low', 'ci_high', 'p_permutation'])}, excludes_zero FROM est",
    )


def queries() -> dict[str, str]:
    cells = ", ".join(CELL_COLUMNS)
    signal_auc = (
        "scored_rows", "SELECT confidence_margin + 0.0 AS score, correct AS label FROM behavior"
    )
    summ_keys = ["direction", "position", "layer"]
    restore = ("restore", "SELECT *, true AS cumulative FROM sweep WHERE direction = 'restore'")
    restore_old = ("restore", "SELECT *, false AS cumulative FROM sweep WHERE direction = 'restore'")
    iso_keys = ["position", "layer", "cumulative"]
    ctl_keys = ["position", "source_kind", "direction"]
    sets_sql = {
        "answer": "index >= fst AND index < lat + 1", "after_answer": "index >= nl",
        "post_newline": "index > nl", "suffix_before_cc": "index > nl AND index < cc",
        **{p: f"index = {r}" for p, r in _role.items()},
    }
    out = {
        "a1_contract_scan": sql(UNCHECKED, """SELECT split, relation_family, count(*) AS n_rows,
            count(DISTINCT block_id) AS n_blocks FROM dirty GROUP BY 1, 2"""),
        "a2_contract_sink": sql(UNCHECKED, f"SELECT {cells} FROM dirty"),
        "a3_result_sink": sql(NATURAL, f"""SELECT block_id, q_index, a_index, {rd('confidence_margin')}, correct,
            n_answer_tokens, cell, matched FROM behavior"""),
        "a4_saved_sweep_summary": sql([*NATURAL, SWEEP, restore_old, *summary("restore", iso_keys, 10_000)],
            f"SELECT {cols(iso_keys)}{rounded(SHORT)}, n_blocks FROM summ"),
        "a5_vector_store": sql([VECTORS], f"""SELECT "row", layer, position, {rd(NORM, 'norm')} FROM vectors
            WHERE layer IN (1, 3)"""),
        "a6_fingerprint": "SELECT " + fingerprint("documents", ["doc_id", "text", "lang", "source", "n_chars"]),
        "a7_manifest": f"""SELECT 'report' AS command, '{{"seed": 7, "splits": ["train", "validation", "test", "family_holdout"]}}' AS config,
            sha256('{{"seed": 7, "splits": ["train", "validation", "test", "family_holdout"]}}') AS config_sha256, '{{"source": "driver tables"}}' AS payload,
            'unknown' AS revision, c.*, l.* FROM (SELECT {fingerprint('conversations', ['conv_id', 'turn', 'role', 'text'], 'conversations_')}) c,
            (SELECT {fingerprint('labels', ['doc_id', 'quality', 'toxic'], 'labels_')}) l""",
        "a8_fact_source": sql([RAW, FACTS], """SELECT relation_family, subject, subject_phrase, answer,
            array_to_string(also_correct, ',') AS also_correct FROM facts"""),
        "a9_templates": sql([TEMPLATES], "SELECT relation_family, ordinal, template_id, text FROM templates WHERE ordinal < 2"),
        "a10_run_size": sql([VECTOR_CELLS, VECTORS], """SELECT (SELECT count(*) FROM vcells) AS n_rows,
            (SELECT count(DISTINCT block_id) FROM vcells) AS n_blocks,
            (SELECT count(DISTINCT layer) FROM vectors) AS n_layers,
            (SELECT CAST(max(len(vec)) AS INTEGER) FROM vectors) AS d_model"""),
        "b1_facts_of_families": sql([RAW, FACTS], """SELECT relation_family, subject, answer FROM facts
            WHERE relation_family IN ('BUILDING', 'MACHINERY')"""),
        "b2_fact_ids": sql([RAW, FACTS], """SELECT subject, fact_id, question_id, answer_id, answer_id ||
            CASE WHEN len(also_correct) > 0 THEN ',a:' || relation_family || ':' || also_correct[1] ELSE '' END
            AS correct_ids FROM facts"""),
        "b3_select_rows": sql([*UNCHECKED, ("held", """SELECT * FROM dirty WHERE split IN ('train', 'test')
            AND relation_family IN ('BUILDING', 'HOUSEHOLD', 'FURNITURE')"""),
            ("first", "SELECT DISTINCT block_id FROM held ORDER BY 1 LIMIT 25")],
            "SELECT block_id, cell, split, relation_family, question_id FROM held SEMI JOIN first USING (block_id)"),
        "b4_can_pair": sql([RAW, FACTS, ("k", """SELECT *, row_number() OVER (PARTITION BY relation_family
            ORDER BY md5('b4:' || fact_id), fact_id) - 1 AS i FROM facts""")],
            """SELECT x.relation_family, x.fact_id AS first, y.fact_id AS second,
            NOT list_contains(y.correct_ids, x.answer_id) AND NOT list_contains(x.correct_ids, y.answer_id) AS can_pair
            FROM k x JOIN k y ON x.relation_family = y.relation_family AND y.i = x.i + 1 AND x.i % 2 = 0"""),
        "b5_expand_blocks": sql([RAW, FACTS, TEMPLATES, ("k", """SELECT *, row_number() OVER (PARTITION BY relation_family
            ORDER BY md5('b4:' || fact_id), fact_id) - 1 AS i FROM facts"""), ("pr", """SELECT least(x.fact_id, y.fact_id) AS a,
            greatest(x.fact_id, y.fact_id) AS b FROM k x JOIN k y ON x.relation_family = y.relation_family AND y.i = x.i + 1
            AND x.i % 2 = 0 AND NOT list_contains(y.correct_ids, x.answer_id) AND NOT list_contains(x.correct_ids, y.answer_id)""")],
            """SELECT f.relation_family || '/' || f.subject_slug || '__' || g.subject_slug || '/t1' AS block_id,
            f.relation_family, CAST(2 AS TINYINT) AS dataset_tier, 'q' || q || 'a' || s AS cell, CAST(q AS TINYINT) AS q_index,
            CAST(s AS TINYINT) AS a_index, qf.question_id, af.answer_id, qf.subject, replace(t.text, '{s}', qf.subject_phrase) AS question,
            af.answer, q = s AS matched, list_contains(qf.correct_ids, af.answer_id) AS correct,
            CASE WHEN q = s THEN 'gold' ELSE 'distractor' END AS answer_source,
            CASE WHEN q = s THEN 'natural' ELSE 'off_policy' END AS policy_status, t.template_id, 'train' AS split
            FROM pr JOIN facts f ON f.fact_id = pr.a JOIN facts g ON g.fact_id = pr.b, (VALUES (1, 1), (1, 2), (2, 1), (2, 2)) v(q, s)
            JOIN facts qf ON qf.fact_id = CASE WHEN q = 1 THEN pr.a ELSE pr.b END
            JOIN facts af ON af.fact_id = CASE WHEN s = 1 THEN pr.a ELSE pr.b END
            JOIN templates t ON t.relation_family = f.relation_family AND t.ordinal = 0"""),
        "b9_readouts": sql([*NATURAL, SWEEP], f"""SELECT block_id, target_cell, position, layer, {rd('moved')},
            {rd('gap')}, flipped FROM sweep"""),
        "b11_finite_only": f"""SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal >= 100) AS n_finite,
            {rd('avg(c_acctbal / 370) FILTER (c_acctbal >= 100)', 'mean_finite')} FROM customer GROUP BY 1""",
        "b12_score_flags": sql([RAW, SCORES], """SELECT subject, greedy_exact, greedy_entity,
            NOT greedy_entity AS is_model_error, greedy_entity AND NOT greedy_exact AS is_alias FROM scores"""),
        "b13_layer_stride": sql([*NATURAL, SWEEP], f"""SELECT layer, position, count(*) AS n_rows,
            {rd('avg(moved)', 'mean_moved')} FROM sweep WHERE layer IN (0, 3, 6) GROUP BY 1, 2"""),
        "b14_cell_factors": sql(NATURAL, """SELECT block_id, cell, CAST(q_index AS TINYINT) AS q_index,
            CAST(a_index AS TINYINT) AS a_index, matched FROM behavior"""),
        "c1_partner_pairs": sql(NATURAL, f"""SELECT block_id, target_cell, source_cell, direction,
            {rounded(['target_clean', 'source_clean'])} FROM pairs"""),
        "c2_pair_facts": sql(PAIRED, "SELECT relation_family, split, CAST(round AS INTEGER) AS round, a AS fact_1, b AS fact_2 FROM fact_pairs"),
        "c3_random_donors": donors("random_cell", "true"),
        "c3_matched_donors": donors("matched_donor", "matched"),
        "c3_crossed_donors": donors("crossed_donor", "NOT matched"),
        "c4_gather_vectors": sql([VECTORS, VECTOR_CELLS], f"""SELECT t.block_id, t."row" AS target_row,
            s."row" AS source_row, layer, {rd(NORM, 'norm')} FROM vcells t JOIN vcells s
            ON t.block_id = s.block_id AND t.q_index = s.q_index AND t.a_index <> s.a_index
            JOIN vectors v ON v."row" = s."row" WHERE layer IN (2, 5)"""),
        "c5_cumulative_span": sql([VECTORS], f"""SELECT "row", CAST(s AS INTEGER) AS start_layer, count(*) AS n_layers,
            {rd(f'sum({NORM})', 'norms')} FROM vectors, (VALUES (0), (2), (4), (6)) t(s) WHERE layer >= s GROUP BY 1, 2"""),
        "c6_sweep_grid": sql(NATURAL, """SELECT block_id, target_cell, direction, position, CAST(layer AS INTEGER) AS layer FROM pairs,
            (VALUES ('AC'), ('LAT'), ('NL'), ('NL1'), ('CC')) p(position), range(7) l(layer)"""),
        "c7_keep_block_set": sql([*NATURAL, ("same", """SELECT block_id FROM behavior GROUP BY 1
            HAVING min(n_answer_tokens) = max(n_answer_tokens)""")], f"""SELECT block_id, cell, {rd('confidence_margin')}
            FROM behavior SEMI JOIN same USING (block_id)"""),
        "c10_behavior_with_vectors": sql([VECTORS, VECTOR_CELLS], f"""SELECT block_id, cell, matched, position, layer, {rd(NORM, 'norm')}
            FROM vcells JOIN vectors USING ("row")"""),
        "c11_template_assignment": sql(BLOCKS, "SELECT relation_family, split, template_id, count(*) AS n_blocks FROM blocks GROUP BY 1, 2, 3"),
        "c12_share_side_by_side": sql([*NATURAL, *conditions(10_000)], f"""SELECT condition,
            {rd("max(share_of_clean) FILTER (subset = 'all')", 'share_all')},
            {rd("max(share_of_clean) FILTER (subset = 'length_matched')", 'share_length_matched')} FROM ctab GROUP BY 1"""),
        "d1_table_counts": sql(UNCHECKED, union([f"SELECT '{s}' AS scope, {v} AS value, count(*) AS n_rows, "
            f"count(DISTINCT block_id) AS n_blocks FROM dirty GROUP BY ALL" for s, v in
            (("table", "''"), ("split", "split"), ("family", "relation_family"))])),
        "d2_block_contrasts": sql([*NATURAL, CONTRASTS], f"SELECT block_id, {rounded(['interaction', 'delta_fit'])} FROM contrasts"),
        "d3_block_gaps": sql([*NATURAL, GAPS], f"SELECT block_id, {rd('gap')} FROM gaps"),
        "d4_confidence_signal": sql([*NATURAL, CONTRASTS, *draws("contrasts", 10_000),
            *mean_estimate("contrasts", "interaction", [], 10_000, True), signal_auc,
            ("auc1", f"SELECT {AUC}")], f"""SELECT {rd('mean', 'interaction_mean')}, {rd('ci_low', 'interaction_ci_low')},
            {rd('ci_high', 'interaction_ci_high')}, {rd('sign_consistency', 'interaction_sign_consistency')},
            n_blocks AS interaction_n_blocks, {rd('p_permutation', 'interaction_p_permutation')}, excludes_zero,
            {rd('mean / 2', 'delta_fit_mean')}, {rd('ci_low / 2', 'delta_fit_ci_low')}, {rd('ci_high / 2', 'delta_fit_ci_high')},
            {rd('(SELECT avg(interaction) / stddev_samp(interaction) FROM contrasts)', 'effect_size')},
            {rd('(SELECT auc FROM auc1)', 'calibration_auc')},
            {rd('(SELECT avg(confidence_margin) FROM behavior WHERE matched)', 'mean_margin_matched')},
            {rd('(SELECT avg(confidence_margin) FROM behavior WHERE NOT matched)', 'mean_margin_crossed')} FROM est"""),
        "d5_block_bootstrap": sql([*NATURAL, CONTRASTS, *draws("contrasts", 10_000),
            *mean_estimate("contrasts", "interaction", [], 10_000, True)],
            f"SELECT {rounded(['mean', 'sign_consistency'])}, n_blocks, {rounded(['ci_low', 'ci_high', 'p_permutation'])}, excludes_zero FROM est"),
        "d6_sign_flip_by_layer": moved_by_layer(10_000),
        "d7_bootstrap_ratio": sql([LINE, ("nd", "SELECT block_id, avg(v) AS num, avg(l_quantity / 37) AS den FROM line GROUP BY 1"),
            *draws("nd", 10_000), ("rr", "SELECT r, sum(w * num) / sum(w * den) AS m FROM nd JOIN weights USING (block_id) GROUP BY 1"),
            ("cc", f"SELECT {edges('m')} FROM rr"), ("pp", """SELECT avg(num) / avg(den) AS mean,
            avg(CASE WHEN num / den > 0 THEN 1.0::DOUBLE ELSE 0 END) AS sign_consistency, count(*) AS n_blocks FROM nd""")],
            f"SELECT {rounded(['mean', 'sign_consistency'])}, n_blocks, {rounded(['ci_low', 'ci_high'])}, ci_low > 0 OR ci_high < 0 AS excludes_zero FROM pp, cc"),
        "d8_paired_effect_size": sql([*NATURAL, CONTRASTS], f"SELECT {rd('avg(interaction) / stddev_samp(interaction)', 'effect_size')} FROM contrasts"),
        "d9_auc": sql([("scored_rows", "SELECT CAST(n_chars AS DOUBLE) AS score, quality = 1 AS label FROM documents JOIN labels USING (doc_id)")],
            f"SELECT {rd('auc')} FROM (SELECT {AUC})"),
        "d9_auc_line_items": sql([("scored_rows", "SELECT l_quantity AS score, l_returnflag = 'R' AS label FROM lineitem")],
            f"SELECT {rd('auc')} FROM (SELECT {AUC})"),
        "d12_answer_clusters": sql([RAW, FACTS], "SELECT relation_family, answer_id, count(*) AS cluster_size FROM facts GROUP BY 1, 2"),
        "d12_pool_sizes": sql(FACT_PARTS, """SELECT relation_family, split, count(*) AS n_facts,
            count(DISTINCT answer_id) AS n_answers FROM assigned GROUP BY 1, 2"""),
        "d13_likelihood_array": sql([("seq", """SELECT vec_id, -abs(CAST(unnest(embedding) AS DOUBLE)) AS x,
            generate_subscripts(embedding, 1) AS i FROM embeddings"""), ("st", f"SELECT vec_id, {STATS}, count(*) AS n FROM seq GROUP BY 1")],
            f"SELECT vec_id, {rounded(STAT_NAMES)}, CAST(n AS INTEGER) AS n_answer_tokens FROM st"),
        "d13_likelihood_rows": sql([("seq", """SELECT label, vec_id * 64 + unnest(range(len(embedding))) AS i,
            -abs(CAST(unnest(embedding) AS DOUBLE)) AS x FROM embeddings"""),
            ("st", f"SELECT label, {STATS}, count(*) AS n FROM seq GROUP BY 1")],
            f"SELECT label, {rounded(STAT_NAMES)}, n AS n_answer_tokens FROM st"),
        "d14_mean_vectors": sql([VECTORS, ("el", """SELECT position, layer, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS dim,
            CAST(unnest(vec) AS DOUBLE) AS x FROM vectors""")], f"""SELECT position, layer, dim,
            {rd('CAST(avg(x) AS FLOAT)', 'value', 5)} FROM el GROUP BY 1, 2, 3"""),
        "d15_patch_summary": sql([*NATURAL, SWEEP, *summary("sweep", summ_keys, 10_000)],
            f"SELECT {cols(summ_keys)}{rounded(SUMMARY)}, n_blocks FROM summ"),
        "d16_isolated_summary": sql([*NATURAL, SWEEP, restore, *summary("restore", iso_keys, 10_000)],
            f"SELECT {cols(iso_keys)}{rounded(SHORT)}, n_blocks FROM summ"),
        "d17_control_summary": sql([*NATURAL, CONTROLS, *summary("controls", ctl_keys, 10_000)],
            f"SELECT {cols(ctl_keys)}{rounded(SHORT)}, n_blocks FROM summ"),
        "d18_condition_table": sql([*NATURAL, *conditions(10_000)], f"""SELECT condition, subset, edges_cut,
            {rounded(['gap', 'ci_low', 'ci_high', 'share_of_clean', 'mean_matched', 'mean_crossed'])}, n_blocks FROM ctab"""),
        "d19_length_matched": sql(NATURAL, "SELECT block_id FROM behavior GROUP BY 1 HAVING min(n_answer_tokens) = max(n_answer_tokens)"),
        "d20_score_summary": sql([RAW, SCORES], f"SELECT {SCORE_SUMMARY}"),
        "d21_score_summary_by_family": sql([RAW, SCORES], f"SELECT relation_family, {SCORE_SUMMARY} GROUP BY 1"),
        "d22_peak_layers": sql(POINT_SUMMARY, f"""SELECT position, {rd('max(effect)', 'peak_effect')},
            arg_max(layer, (effect, -layer)) AS best_layer, {rd('arg_max(flip_rate, (effect, -layer))', 'peak_flip_rate')},
            {rd('arg_max(mean_moved, (effect, -layer))', 'peak_mean_moved')} FROM ps GROUP BY 1"""),
        "d23_read_cliff": sql(POINT_SUMMARY, """SELECT position, coalesce(max(layer) FILTER (peak > 0
            AND effect >= CAST(0.5 AS DOUBLE) * peak), -1) AS read_cliff FROM ps JOIN (SELECT position, max(effect) AS peak
            FROM ps GROUP BY 1) USING (position) GROUP BY 1"""),
        "d24_matched_by_correct": sql(NATURAL, """SELECT matched, count(*) FILTER (correct) AS n_correct,
            count(*) FILTER (NOT correct) AS n_incorrect FROM behavior GROUP BY 1"""),
        "e2_shuffle_rank": """SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority
            ORDER BY md5('5:' || o_orderkey), o_orderkey) - 1 AS rank FROM orders""",
        "e3_row_index": sql(NATURAL, 'SELECT block_id, cell, row_number() OVER (ORDER BY block_id, cell) - 1 AS "row" FROM behavior'),
        "e4_average_ranks": f"""SELECT score, n, (2 * (sum(n) OVER (ORDER BY score) - n) + n + 1) / CAST(2 AS DOUBLE)
            AS average_rank FROM (SELECT CAST(n_chars AS DOUBLE) AS score, count(*) AS n FROM documents GROUP BY 1)""",
        "e5_flips_by_difficulty": sql([*NATURAL, CONTROLS, GAPS, ("cuts", """SELECT quantile_cont(gap, 1 / CAST(3 AS DOUBLE)) AS lo,
            quantile_cont(gap, 2 / CAST(3 AS DOUBLE)) AS hi FROM gaps""")], f"""SELECT CASE WHEN g.gap <= lo THEN 'hard'
            WHEN g.gap <= hi THEN 'medium' ELSE 'easy' END AS stratum, source_kind, direction, {rd('avg(flipped::INT)', 'flip_rate')},
            {rd('avg(g.gap)', 'mean_clean_gap')}, count(*) AS n_pairs FROM controls c JOIN gaps g USING (block_id), cuts GROUP BY 1, 2, 3"""),
        "e5_exact_terciles": f"""SELECT o_orderpriority, {quantile('o_totalprice / 37', '1 / CAST(3 AS DOUBLE)', 'lower')},
            {quantile('o_totalprice / 37', '2 / CAST(3 AS DOUBLE)', 'upper')} FROM orders GROUP BY 1""",
        "e6_batch_numbers": """SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n_tokens, (row_number() OVER (
            PARTITION BY length(p_name) ORDER BY md5('0:' || p_partkey), p_partkey) - 1) // 32 AS batch FROM part""",
        "f4_ordered_report": sql([*UNCHECKED, *_block_parts, ("viol", ALL_RULES), ("marked", """SELECT *, CASE WHEN rule = 'leak'
            THEN 'leak ' || kind ELSE rule END AS "check" FROM viol""")], """SELECT "check", kind, id, detail,
            row_number() OVER (ORDER BY "check", id, kind, detail) - 1 AS place FROM marked"""),
        "f3_capped_report": sql([*UNCHECKED, *_block_parts, ("viol", ALL_RULES), ("marked", """SELECT *, CASE WHEN rule = 'leak'
            THEN 'leak ' || kind ELSE rule END AS "check" FROM viol"""), ("numbered", """SELECT *, row_number() OVER (
            PARTITION BY "check" ORDER BY id, kind, detail) AS i, CASE WHEN "check" = 'row' THEN 20 WHEN rule = 'leak' THEN 10 ELSE NULL END AS cap FROM marked""")],
            """SELECT "check", kind, id, detail FROM numbered WHERE cap IS NULL OR i <= cap UNION ALL
            SELECT "check", 'further violations', '', CAST(count(*) - any_value(cap) AS VARCHAR) FROM numbered
            WHERE cap IS NOT NULL GROUP BY 1 HAVING count(*) > any_value(cap)"""),
        "g1_concat_facts": sql([RAW, FACTS], """SELECT relation_family, subject, subject_phrase, answer,
            array_to_string(also_correct, ',') AS also_correct FROM facts UNION ALL
            SELECT 'SUPPLIER', s_name, s_name, n_name, '' FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
        "g3_duplicate_blocks": sql([RAW], "SELECT c_mktsegment || '/' || n_name AS block_id, count(*) AS n FROM raw GROUP BY 1 HAVING count(*) > 1"),
        "g4_position_drift": position_drift(),
        "g4_snapshot_drift": sql([("cur", "SELECT o_custkey AS key, o_orderpriority AS label FROM orders"), ("fro", """SELECT
            c_custkey AS key, o_orderpriority AS label FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 0""")],
            """SELECT *, 'current' AS side FROM (SELECT * FROM cur EXCEPT ALL SELECT * FROM fro)
            UNION ALL SELECT *, 'frozen' FROM (SELECT * FROM fro EXCEPT ALL SELECT * FROM cur)"""),
        "h1_slugify": f"SELECT doc_id, md5(s) AS slug_md5, CAST(length(s) AS INTEGER) AS slug_length FROM (SELECT doc_id, {slug('text')} AS s FROM documents)",
        "h1_slugify_names": f"SELECT p_partkey, {slug(chr(39).join(['concat_ws(', ' & ', ', p_name, p_brand, p_type)']))} AS slug FROM part",
        "h2_normalize_entity": f"SELECT doc_id, md5(s) AS entity_md5, CAST(length(s) AS INTEGER) AS entity_length FROM (SELECT doc_id, {entity('text')} AS s FROM documents)",
        "h3_fill_template": sql([RAW, FACTS, TEMPLATES], """SELECT subject, ordinal, replace(text, '{s}', subject_phrase) AS question
            FROM facts JOIN templates USING (relation_family)"""),
        "h4_prompts": sql(PROMPTS, f"""SELECT conv_id, turn, sha256(prompt) AS prompt_sha256, '1759f5f1931e1e70' AS template_hash,
            CAST(length(prompt) AS INTEGER) AS n_chars, answer_colon, answer_boundary, answer_start, answer_end, newline, confidence_colon FROM prompts"""),
        "h7_tokens": sql(tokens("conversations", "text"), 'SELECT conv_id, turn, index, id, start, stop AS "end" FROM tok'),
        "h8_covering_token": sql(tokens("conversations", "text"), f"""SELECT t.conv_id, t.turn,
            {hit('length(text) // 2')} AS index FROM tok t JOIN conversations USING (conv_id, turn) GROUP BY 1, 2"""),
        "h9_positions": sql(RESOLVED, "SELECT r.conv_id, r.turn, position_error, CAST(n AS INTEGER) AS n_tokens, lat + 1 - fst AS n_answer_tokens, "
            "fst AS answer_start, lat + 1 AS answer_end, " + ", ".join(f'{v} AS "pos_{p}", k{v}.id AS "tok_{p}"' for p, v in _role.items())
            + " FROM resolved r " + " ".join(f"LEFT JOIN tok k{v} ON k{v}.conv_id = r.conv_id AND k{v}.turn = r.turn AND k{v}.index = r.{v}" for v in _role.values())),
        "h10_token_window": sql(RESOLVED, """SELECT r.conv_id, r.turn, string_agg('[' || index || ']' || piece ||
            CASE WHEN index = nl THEN '*' ELSE '' END, ' ' ORDER BY index) AS window FROM resolved r JOIN tok t
            ON t.conv_id = r.conv_id AND t.turn = r.turn AND index BETWEEN nl - 3 AND nl + 3 GROUP BY 1, 2"""),
        "h12_position_sets": sql(RESOLVED, "SELECT conv_id, turn, " + ", ".join(f'count(*) FILTER ({sets_sql[s]}) AS "n_{s}"'
            for s in [*SETS, *_role]) + " FROM tok JOIN resolved USING (conv_id, turn) GROUP BY 1, 2"),
        "h13_class_margin": f"SELECT vec_id, {rd('CAST(embedding[8] AS DOUBLE) - CAST(embedding[4] AS DOUBLE)', 'margin')} FROM embeddings",
        "h14_answer_logprobs": sql([("lg", """SELECT label, vec_id + 1 AS index, CAST((vec_id * 7) % len(embedding) AS INTEGER) AS t FROM embeddings"""),
            ("pr", "SELECT label, vec_id + 1 AS index, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings")],
            f"""SELECT label, index, {rd('e[t + 1] - list_max(e) - ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e)))))', 'logprob')}
            FROM lg LEFT JOIN pr USING (label, index)"""),
        "h15_half_precision": sql([("el", "SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings"), ("st", """SELECT vec_id, x,
            pow(CAST(2 AS DOUBLE), greatest(floor(log2(greatest(abs(x), 1e-30::DOUBLE))), -14) - 10) AS step FROM el""")],
            f"SELECT vec_id, {rd('max(abs(x - round_even(x / step, 0) * step)) * 1000', 'largest_error')} FROM st GROUP BY 1"),
        "h16_gaussian": sql([VECTORS, ("hh", """SELECT *, md5('7:' || position || ':gaussian:' || "row" || ':' || layer) AS h FROM vectors"""),
            ("ww", f"SELECT * EXCLUDE (h), {hex32('h')} AS h0, {hex32('h', 1)} AS h1 FROM hh"),
            ("m0", f'SELECT "row", layer, position, vec, h1, k, (h0 + k * {GOLDEN}) & {MASK} AS x FROM ww, range({2 * WIDTH}) t(k)'),
            *[(f"m{i + 1}", f'SELECT "row", layer, position, vec, h1, k, (xor(x >> 16, x) * {MULTIPLIER}) & {MASK} AS x FROM m{i}') for i in (0, 1)],
            ("m3", 'SELECT "row", layer, position, vec, k, xor(xor(x >> 16, x), h1) AS x FROM m2'),
            *[(f"m{i + 1}", f'SELECT "row", layer, position, vec, k, (xor(x >> 16, x) * {MULTIPLIER}) & {MASK} AS x FROM m{i}') for i in (3, 4)],
            ("u", 'SELECT "row", layer, position, vec, k, (xor(x >> 16, x) + 1) / CAST(4294967296 AS DOUBLE) AS u FROM m5'),
            ("z", """SELECT a."row", a.layer, a.position, a.vec, a.k // 2 AS dim, sqrt(-2 * ln(a.u)) * cos(2 * pi() * b.u) AS z
              FROM u a JOIN u b ON a."row" = b."row" AND a.layer = b.layer AND b.k = a.k + 1 AND a.k % 2 = 0"""),
            ("n", f'SELECT "row", layer, position, dim, z, {NORM} / sqrt(sum(z * z) OVER (PARTITION BY "row", layer)) AS scale FROM z')],
            f"""SELECT "row", layer, position, CAST(dim AS INTEGER) AS dim, {rd('CAST(z * scale AS FLOAT) * CAST(1000 AS DOUBLE)', 'value', 2)} FROM n"""),
        "h17_stable_seed": """SELECT c_custkey, (2147483643 + CAST(('0x' || substr(sha256(c_name || chr(31) || c_mktsegment), 1, 8)) AS BIGINT))
            % 2147483648 AS seed FROM customer""",
        "h18_first_line": f"SELECT doc_id, {strip('split_part(text, chr(10), 1)')} AS first_line FROM documents",
        "j1_score_batches": sql(RESOLVED, f"""SELECT conv_id, turn, {rd('sum(id) / CAST(count(*) AS DOUBLE) / 134217728 - 1', 'confidence_margin')}
            FROM tok GROUP BY 1, 2"""),
        "a4_signal_report": gates_signal(),
        "a4_routes_report": gates_route(),
        "a4_controls_report": gates_control(),
        "j2_custom_tokenizer": sql([("p", "SELECT conv_id, turn, string_split(text, ' ') AS ps FROM conversations"),
            ("e", "SELECT conv_id, turn, ps, unnest(range(1, len(ps) + 1)) AS i FROM p"),
            ("t", """SELECT conv_id, turn, i, length(ps[i]) AS n,
              coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x))), 0) + i - 1 AS start FROM e WHERE ps[i] <> ''""")],
            """SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INTEGER) AS index,
            CAST(n AS INTEGER) AS id, CAST(start AS INTEGER) AS start, CAST(start + n AS INTEGER) AS "end" FROM t"""),
        "k1_signal_gates": gates_signal(),
        "k2_route_gates": gates_route(),
        "k3_control_gates": gates_control(),
        "l1_split_exact": sql(FACT_PARTS, "SELECT fact_id, split FROM assigned"),
        "l1_split_hash": sql([RAW, FACTS], f"""SELECT fact_id, CASE WHEN relation_family = 'FURNITURE' THEN 'family_holdout'
            ELSE {band(unit("'7:' || relation_family || ':' || answer_id"))} END AS split FROM facts"""),
        "l2_build_cells": sql(BUILT, f"SELECT {cells} FROM cells"),
        "l2_build_dataset": sql(BUILT, "SELECT *, true AS valid FROM (" + union([f"SELECT '{s}' AS scope, {v} AS value, count(*) AS n_rows, "
            f"count(DISTINCT block_id) AS n_blocks FROM cells GROUP BY ALL" for s, v in
            (("table", "''"), ("split", "split"), ("family", "relation_family"))]) + ")"),
        "l4_sweep_to_gates": gates_signal(("sweep", f"""SELECT {READOUTS} FROM (SELECT pairs.*, position, layer,
            target_clean + (source_clean - target_clean) * (share * (CAST(1 AS DOUBLE) - layer / CAST(10 AS DOUBLE))) AS patched
            FROM pairs, (VALUES ('AC', 0.02::DOUBLE), ('LAT', 0.3::DOUBLE), ('NL', 0.9::DOUBLE), ('NL1', 0.05::DOUBLE),
            ('CC', 1.0::DOUBLE)) w(position, share), range(7) l(layer)) p""")),
        "l6_control_sweep": control_rows(),
        "l8_scored_facts": sql(FACT_SCORES, f"""SELECT fact_id, relation_family, subject, question, gold, greedy_answer,
            {rounded(['gold_margin', 'gold_nll_per_token'])}, gold_n_tokens, greedy_exact, greedy_entity,
            NOT greedy_entity AS is_model_error, greedy_entity AND NOT greedy_exact AS is_alias FROM scores"""),
        "l9_fact_score_summary": sql(FACT_SCORES, f"SELECT relation_family, {SCORE_SUMMARY} GROUP BY 1"),
        "l5_behavior_likelihood": sql([*BUILT, ("cp", f"""SELECT block_id AS conv_id, cell AS turn, {text(_open)} || question || chr(10)
            || 'Answer: ' || answer || chr(10) || 'Confidence:' AS prompt FROM cells"""), *tokens("cp", "prompt"),
            ("seq", "SELECT conv_id, turn, index AS i, -(id / CAST(268435456 AS DOUBLE)) AS x FROM tok"),
            ("st", f"SELECT conv_id, turn, {STATS}, count(*) AS n FROM seq GROUP BY 1, 2")],
            f"""SELECT conv_id AS block_id, turn AS cell, {rounded(STAT_NAMES)}, CAST(n AS INTEGER) AS n_answer_tokens FROM st"""),
        "l3_measured_behavior": sql([*BUILT, ("cp", f"""SELECT block_id AS conv_id, cell AS turn, matched, {text(_open)} || question || chr(10)
            || 'Answer: ' || answer || chr(10) || 'Confidence:' AS prompt FROM cells"""), *tokens("cp", "prompt"), ("mb", """SELECT conv_id, turn,
            sum(id) / CAST(count(*) AS DOUBLE) / 134217728 - 1 AS z FROM tok GROUP BY 1, 2""")], f"""SELECT conv_id AS block_id,
            {rd('avg(z) FILTER (matched) - avg(z) FILTER (NOT matched)', 'gap')} FROM mb JOIN cp USING (conv_id, turn) GROUP BY 1"""),
        "v1_row_rules": sql(UNCHECKED, union(row_rules("dirty"))),
        "v7_appended_cells": sql([*UNCHECKED, *_block_parts], ALL_RULES),
        "a7_altered_file": f"""WITH now AS (SELECT c_custkey, CASE WHEN c_custkey % 100 = 7 AND c_mktsegment = 'MACHINERY'
            THEN upper(c_name) ELSE c_name END AS c_name, c_mktsegment FROM customer),
            part AS (SELECT * FROM now WHERE c_mktsegment = 'MACHINERY')
            SELECT 'altered' AS change, 'MACHINERY' AS segment, p.*, w.w_hash_xor AS table_xor
            FROM (SELECT {fingerprint('part', ['c_custkey', 'c_name', 'c_mktsegment'])}) p,
            (SELECT {fingerprint('now', ['c_custkey', 'c_name', 'c_mktsegment'], 'w_')}) w""",
        "v2_block_rules": sql([*UNCHECKED, *_block_parts], union(_block_selects)),
        "v3_split_leaks": sql(UNCHECKED, union(leak_rules("dirty"))),
        "v4_label_rules": sql(UNCHECKED, union(label_rules("dirty"))),
        "v4_family_rules": sql(UNCHECKED, union(family_rules("dirty"))),
        "v5_text_rules": sql(UNCHECKED, union(text_rules("dirty"))),
        "v5_empty_table": sql(UNCHECKED, """SELECT 'table' AS rule, 'empty' AS kind, '' AS id, 'table is empty' AS detail
            WHERE NOT EXISTS (SELECT 1 FROM dirty WHERE dataset_tier > 100)"""),
        "v6_fact_rules": sql([RAW, ("odd", f"""SELECT c_mktsegment AS f, 'Firm ' || CAST(floor(c_custkey * 2 / CAST(3 AS DOUBLE)) AS BIGINT) AS subject,
            CASE WHEN c_acctbal > 9000 THEN c_name ELSE subject END AS phrase, CASE WHEN c_acctbal < -950 THEN '?' ELSE n_name END AS answer,
            CASE WHEN c_acctbal < 0 THEN [{slug('n_name')}, lower(c_mktsegment)] ELSE [] END AS also, {slug('answer')} AS a,
            {slug('subject')} AS s, f || ':' || {slug('subject')} AS id FROM raw"""),
            ("more", "SELECT f, id, unnest(also) AS slug FROM odd")], union([
            "SELECT 'fact' AS rule, 'subject repeated' AS kind, id, CAST(count(*) AS VARCHAR) AS detail FROM odd GROUP BY id HAVING count(*) > 1",
            "SELECT 'fact', 'unknown family', id, f FROM odd WHERE f NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')",
            "SELECT 'fact', 'empty subject slug', id, subject FROM odd WHERE s = ''",
            "SELECT 'fact', 'empty answer slug', id, answer FROM odd WHERE a = ''",
            "SELECT 'fact', 'phrase lacks the subject', id, phrase FROM odd WHERE NOT contains(phrase, subject)",
            "SELECT 'fact', 'also_correct repeats the answer', id, a FROM odd WHERE list_contains(also, a)",
            "SELECT 'fact', 'also_correct is no answer of the family', id, slug FROM more ANTI JOIN (SELECT DISTINCT f, a AS slug FROM odd) USING (f, slug)",
        ])),
    }
    return out
