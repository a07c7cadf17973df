"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .licenses import COVERAGE, K, NEIGHBOURS, NOTICES, PHRASES, words_of

OP8 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p
), digits AS (  -- five bits of the digest at a time
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v >> (15 - 5 * (k % 4))) & 31) AS BIGINT), 1), '' ORDER BY k) AS payload_digest
  FROM (SELECT page_id, k, CAST('0x' || substr(x, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) AS v FROM (SELECT page_id, x, unnest(range(32)) AS k FROM d))
  GROUP BY page_id
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM d JOIN digits USING (page_id)
"""


def _templates() -> str:
    rows = []
    for t, (label, text) in enumerate([*PHRASES, *NOTICES]):
        words = ", ".join(f"'{w}'" for w in words_of(text))
        rows.append(f"({t}, '{label}', {str(t < len(PHRASES)).lower()}, [{words}])")
    return ",\n    ".join(rows)


OP9 = rf"""
WITH t(template, label, is_phrase, words) AS (VALUES
    {_templates()}
), d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), tg AS (
  SELECT template, label, is_phrase, n, p, words[p + 1 : p + {K}] AS g
  FROM (SELECT *, len(words) - {K - 1} AS n, unnest(range(len(words) - {K - 1})) AS p FROM t)
), dg AS (
  SELECT doc_id, i, words[i + 1 : i + {K}] AS g
  FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - {K - 1}, 0))) AS i FROM d)
), diagonals AS (
  SELECT doc_id, template, label, is_phrase, n, i - p AS diagonal, count(*) AS votes, min(i) AS lo, max(i) AS hi, list(DISTINCT p) AS places
  FROM dg JOIN tg USING (g) GROUP BY ALL
), steps AS (
  SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER w) <= {NEIGHBOURS} THEN 0 ELSE 1 END AS new
  FROM diagonals WHERE NOT is_phrase
  WINDOW w AS (PARTITION BY doc_id, template ORDER BY lo, diagonal)
), chains AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY lo, diagonal) AS span FROM steps
), turns AS (  -- a chain much longer than the template is cut where the template starts again
  SELECT *, CASE WHEN max(hi) OVER c - min(lo) OVER c > 2 * n + {2 * NEIGHBOURS}
    AND list_min(places) <= lag(list_max(places)) OVER (PARTITION BY doc_id, template, span ORDER BY lo, diagonal) THEN 1 ELSE 0 END AS again
  FROM chains WINDOW c AS (PARTITION BY doc_id, template, span)
), spans AS (
  SELECT doc_id, label, n, min(lo) AS lo, max(hi) AS hi, len(list_distinct(flatten(list(places)))) AS grams
  FROM (SELECT *, sum(again) OVER (PARTITION BY doc_id, template, span ORDER BY lo, diagonal) AS copy FROM turns)
  GROUP BY doc_id, template, label, n, span, copy
), found AS (
  SELECT doc_id, label, diagonal AS lo, CAST(1 AS DOUBLE) AS share, true AS base FROM diagonals WHERE is_phrase AND votes = n
  UNION ALL
  SELECT doc_id, label, lo, CASE WHEN hi - lo <= 2 * n + {2 * NEIGHBOURS} THEN CAST(grams AS DOUBLE) / n ELSE 0 END, false FROM spans
), merged AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(lo) FILTER (base) AS first_word, max(lo) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR share >= {COVERAGE}) AS labels,
    max(share) AS score
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN merged m ON d.doc_id = m.doc_id
"""

OP10 = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""



def _merkle(levels: int = 7, top_levels: int = 3, arity: int = 8) -> str:
    """The trees level by level; enough levels for 8**levels leaves a group."""
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(enc(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {enc(text)})"
    crc = (  # bit by bit over the bytes of the id
        "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), "
        "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
    )
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [
        f"""WITH d AS (
  SELECT doc_id, lang, {leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(lower)} END AS bad FROM documents
), e AS (
  SELECT *, coalesce('=' || lang, '') AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS s,
    count(*) OVER (PARTITION BY lang) AS n FROM d
), a0 AS (
  SELECT k, s, n, leaf AS h FROM e
)"""
    ]

    def tree(a: str, f: str, levels: int) -> None:
        """``a``0 are nodes (k, s, n, h); ``f``0 their leaves' folds and proofs."""
        for j in range(levels):
            out.append(f"""g{a}{j} AS (
  SELECT k, s // {arity} AS p, list(h ORDER BY s) AS kids FROM {a}{j} WHERE n > 1 GROUP BY ALL
), {a}{j + 1} AS (
  SELECT k, s // {arity} AS s, (n + {arity - 1}) // {arity} AS n, sha256(string_agg(h, '' ORDER BY s)) AS h FROM {a}{j} WHERE n > 1 GROUP BY k, s // {arity}, n
  UNION ALL SELECT * FROM {a}{j} WHERE n = 1
), {f}{j + 1} AS (
  SELECT f.* REPLACE (
    f.slot // {arity} AS slot,
    CASE WHEN g.p IS NULL THEN f.fold ELSE sha256(array_to_string(kids[1:slot % {arity}], '') || f.fold || array_to_string(kids[slot % {arity} + 2:], '')) END AS fold,
    CASE WHEN g.p IS NULL THEN f.proof ELSE f.proof || array_to_string(kids[1:slot % {arity}], '') || array_to_string(kids[slot % {arity} + 2:], '') END AS proof)
  FROM {f}{j} f LEFT JOIN g{a}{j} g ON f.k = g.k AND f.slot // {arity} = g.p
)""")

    out.append("f0 AS (SELECT doc_id, k, s AS slot, leaf, coalesce(bad, leaf) AS fold, '' AS proof FROM e)")
    tree("a", "f", levels)
    out.append(f"""b0 AS (
  SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS s, count(*) OVER () AS n, h, k AS lang FROM a{levels}
), t0 AS (
  SELECT f.* REPLACE ('' AS k, b0.s AS slot), b0.h AS subroot FROM f{levels} f JOIN b0 ON f.k = b0.lang
), c0 AS (SELECT k, s, n, h FROM b0)""")
    tree("c", "t", top_levels)
    out.append(f"r AS (SELECT h AS root FROM c{top_levels})")
    return (
        ", ".join(out)
        + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM t{top_levels}, r
"""
    )


OP12 = _merkle()


def _lloyd(rounds: int = 3, clusters: int = 16, dims: int = 64, scale: int = 64) -> str:
    out = [
        f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
), x AS MATERIALIZED (
  SELECT r, unnest(range({dims})) AS d, unnest(v) AS x FROM kept
), seeds AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {clusters}
), c0 AS MATERIALIZED (
  SELECT c, unnest(range({dims})) AS d, unnest(v) AS y FROM seeds
)"""
    ]
    for i in range(rounds + 1):
        out.append(f"""p{i} AS (
  SELECT r, c, sum((x - y) * (x - y)) AS dist FROM x JOIN c{i} USING (d) GROUP BY r, c
), a{i} AS MATERIALIZED (
  SELECT r, c, dist FROM p{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, c) = 1
)""")
        if i < rounds:
            out.append(f"""s{i} AS (
  SELECT c, d, sum(x) AS s, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY c, d
), c{i + 1} AS MATERIALIZED (
  SELECT c, d, CASE WHEN n IS NULL THEN y ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS y FROM c{i} LEFT JOIN s{i} USING (c, d)
)""")
    return (
        ", ".join(out)
        + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance,
  CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c) USING (c)
"""
    )


OP11 = _lloyd()

ORACLE = {"op8_warc": OP8, "op9_license_scan": OP9, "op10_exact_dedup": OP10, "op11_centroids": OP11, "op12_merkle": OP12}
