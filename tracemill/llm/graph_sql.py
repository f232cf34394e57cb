"""SQL of the trie, the manifest and the embedding near-duplicates, as plain definitions: prefixes, levels and all pairs."""

from __future__ import annotations

_WORDS = "len(regexp_extract_all(text, '[^ ' || chr(9) || '-' || chr(13) || ']+'))"


def _crc32(value: str) -> str:
    """CRC-32 of a number in decimal, bit by bit."""
    bits = f"flatten(list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda c: list_prepend(CAST(ord(c) AS BIGINT), list_transform(range(8), lambda b: -1))))"
    step = "CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END"
    return f"xor(list_reduce({bits}, lambda a, x: {step}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


def _field(name: str) -> str:
    return f"coalesce(octet_length(encode(CAST({name} AS VARCHAR))) || ':' || {name}, '-')"


def _level(table: str, grp: str, out: str) -> str:
    """CTEs out_l (grp, l, idx, up, hash, n, lefts, rights) of all levels over table (grp, idx, hash, n)."""
    return f"""{out}_l AS (SELECT {grp} AS grp, 0 AS l, idx, hash, n FROM {table}
      UNION ALL SELECT grp, l + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM {out}_l WHERE n > 1 GROUP BY grp, l, idx // 2)"""


_LEAF = f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', 'text')))})"
_FORGED = f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', '(n_chars + 1)', 'text')))})"

SQL = {
    "op11_trie": f"""WITH RECURSIVE o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
      i AS (SELECT c, {_crc32('c')} % 4 AS h FROM (SELECT DISTINCT c FROM o)), m AS (SELECT i.c, h, count(o.c) AS m FROM i LEFT JOIN o ON o.c = i.c - i.c % 20 AND o.p <= h GROUP BY i.c, h),
      r AS (SELECT m.c, p AS d, role, text FROM m JOIN o ON o.c = m.c - m.c % 20 AND o.p <= h UNION ALL SELECT m.c, p - h + m, role, text FROM m JOIN o ON o.c = m.c AND o.p > h),
      k AS (SELECT c, 0 AS d, '' AS k, CAST(NULL AS VARCHAR) AS up, CAST(0 AS BIGINT) AS w FROM m UNION ALL SELECT r.c, r.d, sha256(k.k || ' ' || length(role) || ' ' || role || text), k.k, {_WORDS} FROM k JOIN r ON r.c = k.c AND r.d = k.d + 1),
      n AS (SELECT k, d, any_value(up) AS up, any_value(w) AS w, count(*) AS n_convs, min(c) AS c FROM k GROUP BY k, d),
      x AS (SELECT n.*, (SELECT count(*) FROM n s WHERE s.up = n.k AND s.d = n.d + 1) AS n_children FROM n),
      a AS (SELECT k AS below, d AS lv, k, d, up FROM n UNION ALL SELECT a.below, a.lv, n.k, n.d, n.up FROM a JOIN n ON n.k = a.up AND n.d = a.d - 1),
      t AS (SELECT a.k, a.d, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.w) AS saved_tokens FROM a JOIN x ON x.k = a.below AND x.d = a.lv GROUP BY a.k, a.d),
      e AS (SELECT k, d, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM (SELECT * FROM k QUALIFY d = max(d) OVER (PARTITION BY c)) GROUP BY k, d)
      SELECT x.c AS conv_id, CAST(x.d AS BIGINT) AS depth, u.c AS parent_conv_id, x.n_convs, x.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
      FROM x JOIN t USING (k, d) LEFT JOIN e USING (k, d) LEFT JOIN n u ON u.k = x.up AND u.d = x.d - 1""",
    "op12_manifest": f"""WITH RECURSIVE f AS (SELECT doc_id, coalesce('=' || lang, '-') AS grp, {_LEAF} AS leaf, CASE WHEN {_crc32('doc_id')} % 7 = 0 AND n_chars IS NOT NULL THEN {_FORGED} END AS forged FROM documents),
      p AS (SELECT *, leaf AS hash, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM f),
      {_level('p', 'grp', 'a')}, s AS (SELECT grp, hash AS subroot, l AS height, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM a_l WHERE n = 1),
      q AS (SELECT '' AS grp, idx, subroot AS hash, n FROM s), {_level('q', 'grp', 'b')}, z AS (SELECT hash AS root FROM b_l WHERE n = 1),
      y AS (SELECT grp, l, idx, hash FROM a_l WHERE n > 1), v AS (SELECT l, idx, hash FROM b_l WHERE n > 1), h AS (SELECT max(l) + 1 AS h FROM a_l),
      w AS (SELECT p.doc_id, p.grp, p.leaf, p.idx, y.l AS lv, sib.hash AS hash, (p.idx >> y.l) % 2 AS side, p.forged FROM p JOIN (SELECT DISTINCT grp, l FROM y) y ON y.grp = p.grp LEFT JOIN y sib ON sib.grp = p.grp AND sib.l = y.l AND sib.idx = xor(p.idx >> y.l, 1)
        UNION ALL SELECT p.doc_id, p.grp, p.leaf, p.idx, h.h + g.l, sib.hash, (s.idx >> g.l) % 2, p.forged FROM p JOIN s ON s.grp = p.grp CROSS JOIN h JOIN (SELECT DISTINCT l FROM v) g ON true LEFT JOIN v sib ON sib.l = g.l AND sib.idx = xor(s.idx >> g.l, 1)),
      ways AS (SELECT grp, idx, string_agg(coalesce(hash, ''), '' ORDER BY lv) AS proof, list(struct_pack(x := coalesce(hash, ''), side := side) ORDER BY lv) AS steps FROM w GROUP BY grp, idx),
      d AS (SELECT p.doc_id, p.leaf, s.subroot, z.root, sha256(coalesce(proof, '')) AS proof_sha256, list_reduce(list_prepend(struct_pack(x := coalesce(p.forged, p.leaf), side := CAST(0 AS BIGINT)), coalesce(steps, [])), lambda a, b: struct_pack(x := sha256(CASE WHEN b.side = 1 THEN b.x || a.x ELSE a.x || b.x END), side := CAST(0 AS BIGINT))).x AS folded_root
        FROM p JOIN s ON s.grp = p.grp CROSS JOIN z LEFT JOIN ways ON ways.grp = p.grp AND ways.idx = p.idx)
      SELECT *, folded_root = root AS verified FROM d""",
    "op13_neardup": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
      l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
      r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) AS least FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
      SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
}
