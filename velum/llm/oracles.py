"""SQL of the corpus operators that join or cut texts, for DuckDB."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _classes(nodes: str, links: str) -> str:
    """CTEs: `cls` (id, root), the smallest id that each id of `nodes` reaches by `links` (a, b, both ways)."""
    return f"""
        walk AS (SELECT id, id AS root FROM {nodes} UNION SELECT l.b AS id, w.root FROM walk w JOIN {links} l ON l.a = w.id AND w.root < l.b),
        cls AS (SELECT id, min(root) AS root FROM walk GROUP BY id)"""


VECTORS = f"""
    WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
    l AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.label = y.label AND x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.93),
    ids AS (SELECT vec_id AS id FROM embeddings), {_classes("ids", "l")}
    SELECT id AS vec_id, (SELECT count(*) FROM l WHERE l.a = cls.id) AS n_links, root AS component_id, id = root AS kept FROM cls"""

TEXTS = f"""
    WITH RECURSIVE w AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents),
    g AS (SELECT id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
    s AS (SELECT id, len(g) AS n, unnest(g) AS gram FROM g),
    c AS (SELECT x.id AS a, y.id AS b, x.n + y.n AS total, count(*) AS shared FROM s x JOIN s y ON x.gram = y.gram AND x.id <> y.id GROUP BY x.id, y.id, x.n, y.n),
    l AS (SELECT a, b FROM c WHERE shared >= 0.8 * (total - shared) - 1e-9),
    ids AS (SELECT id FROM w), {_classes("ids", "l")}
    SELECT id AS doc_id, root AS class_id, (SELECT count(*) FROM l WHERE l.a = cls.id) AS n_links, id = root AS kept FROM cls"""

#: Strings are compared by hash first and only looked at where the hash repeats.
STRINGS = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    p AS (SELECT doc_id, x, unnest(range(n - 399)) AS i FROM d WHERE n >= 400),
    h AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 800)) AS k FROM p),
    r AS (SELECT doc_id, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
    o AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM r),
    q AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o),
    spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 400 AS b FROM q GROUP BY doc_id, span),
    gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS behind FROM spans),
    parts AS (SELECT d.doc_id, string_agg(substr(x, 2 * behind + 1, 2 * (a - behind)), '' ORDER BY a) AS t, max(b) AS last, sum(b - a)::BIGINT AS gone, count(*) AS spans FROM gaps JOIN d USING (doc_id) GROUP BY d.doc_id)
    SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
        sha256(unhex(CASE WHEN t IS NULL THEN x ELSE t || substr(x, 2 * last + 1) END)) AS kept_sha256
    FROM d LEFT JOIN parts USING (doc_id)"""


def clusters(k: int, dims: int, rounds: int) -> str:
    """Clustering of integer vectors: every distance in every round."""
    out = f"""
    WITH v AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k, x FROM v WHERE vec_id IS NOT NULL QUALIFY k < {k})"""
    for i in range(rounds + 1):
        out += f""",
    d{i} AS (SELECT v.r, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{i} c),
    a{i} AS MATERIALIZED (SELECT r, arg_min(k, d * {k} + k) AS k, min(d) AS d FROM d{i} GROUP BY r)"""
        if i < rounds:
            out += f""",
    e{i} AS (SELECT k, unnest(x) AS x, unnest(range({dims})) AS i FROM v JOIN a{i} USING (r)),
    s{i} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM e{i} GROUP BY k, i),
    m{i} AS (SELECT k, list((s - ((s % n + n) % n)) // n ORDER BY i) AS x FROM s{i} GROUP BY k),
    c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (k))"""
    return (
        out
        + f"""
    SELECT vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
        sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c USING (k)"""
    )


def ranked(best: int) -> str:
    """Ranked search: the score of every document for every item."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS l FROM documents),
    total AS (SELECT count(*) AS docs, sum(len(l))::BIGINT AS length FROM d WHERE len(l) > 0),
    p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(l) AS term FROM d) GROUP BY r, term),
    w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p CROSS JOIN total GROUP BY term, docs),
    i AS (SELECT row_number() OVER () AS a, item_id, {terms} AS l FROM benchmark),
    q AS (SELECT a, term, count(*) AS q FROM (SELECT a, unnest(l) AS term FROM i) GROUP BY a, term),
    m AS (SELECT r, doc_id, 75 + (25 * len(l) * docs) // length AS m FROM d CROSS JOIN total WHERE len(l) > 0),
    s AS (SELECT a, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY a, r, doc_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o JOIN i USING (a) WHERE rank <= {best}"""
