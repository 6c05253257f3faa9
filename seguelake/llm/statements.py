"""DuckDB statements of the registered queries that SQL can express."""

from __future__ import annotations

_WRITTEN = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
# CRC-32 of the decimal digits, bit by bit
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce({0}::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_WRITTEN.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _levels(name: str, start: str) -> str:
    """All nodes of the trees whose leaves ``start`` gives as (grp, level, n, idx, h)."""
    return f"""{name} AS (
    {start}
    UNION ALL
    SELECT grp, level + 1, (n + 1) // 2, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY grp, level, n, idx // 2)"""


def _walk(name: str, tree: str, start: str) -> str:
    """Siblings so far and folded digest of every row of ``start`` up the nodes of ``tree``."""
    return f"""{name} AS (
    {start}
    UNION ALL
    SELECT w.row, w.grp, w.level + 1, (w.n + 1) // 2, w.idx // 2, w.siblings || coalesce(s.h, ''),
           sha256(CASE WHEN w.idx % 2 = 1 THEN coalesce(s.h, '') || w.f ELSE w.f || coalesce(s.h, '') END)
    FROM {name} w LEFT JOIN {tree} s ON s.grp IS NOT DISTINCT FROM w.grp AND s.level = w.level AND s.idx = xor(w.idx, 1) WHERE w.n > 1)"""


MERKLE = f"""WITH RECURSIVE leaves AS (
    SELECT *, row_number() OVER () AS row, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
    FROM (SELECT doc_id, lang AS grp, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC32.format("doc_id")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS claimed FROM documents)),
{_levels("inside", "SELECT grp, 0 AS level, n, idx, leaf AS h FROM leaves")},
{_walk("climbed", "inside", "SELECT row, grp, 0 AS level, n, idx, '' AS siblings, claimed AS f FROM leaves")},
subroots AS (SELECT grp, h, count(*) OVER () AS n, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS idx FROM inside WHERE n = 1),
{_levels("above", "SELECT 0 AS grp, 0 AS level, n, idx, h FROM subroots")},
{_walk("reached", "above", '''SELECT c.row, 0 AS grp, 0 AS level, s.n, s.idx, c.siblings, c.f
    FROM climbed c JOIN subroots s ON s.grp IS NOT DISTINCT FROM c.grp WHERE c.n = 1''')}
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(e.siblings) AS proof_sha256, e.f AS folded_root, e.f = r.h AS verified
FROM leaves l JOIN reached e ON e.row = l.row AND e.n = 1 JOIN subroots s ON s.grp IS NOT DISTINCT FROM l.grp CROSS JOIN (SELECT h FROM above WHERE n = 1) r"""

HARD_NEGATIVES = """WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.q, r.q)::BIGINT AS score
    FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5"""
