"""SQL of the operators on conversations, manifests and lines."""

from __future__ import annotations

#: Checksums byte by byte: a table of 256 remainders, made by eight steps each.
_CRC = """crc AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t FROM range(256) r(n))"""


def crc32(text: str) -> str:
    """Unsigned checksum of ASCII text that isn't empty; reads ``crc``."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


_BLANK = r"[\x20\x09-\x0D]"

CONVERSATIONS = rf"""
WITH RECURSIVE {_CRC},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt FROM c, (VALUES (1), (2)) t(k) WHERE fate <> 0 AND (k = 1 OR fate = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(txt)) AS i, regexp_replace(txt, '{_BLANK}+$', '') AS core FROM d),
r AS (SELECT conv_id, i, turn, role, txt, left(role, 1) AS ini, count(*) OVER (PARTITION BY conv_id) AS total,
  CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) > 1 THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
-- Costs from a row's end on, by grammar state: 0 nothing yet, 1 after s, 2 after u, 3 after a.
f AS (
  SELECT DISTINCT conv_id, total AS i, 0 AS f0, 10 AS f1, 5 AS f2, 0 AS f3 FROM r
  UNION ALL
  SELECT conv_id, i - 1, least(g0, 5 + least(g2, 5 + g3)), least(g1, 5 + least(g2, 5 + g3)), least(g2, 5 + g3), least(g3, 5 + g2) FROM (
    SELECT f.conv_id, f.i,
      least(2 + f0, CASE WHEN stays THEN more + least(f2 + CASE ini WHEN 'u' THEN 0 ELSE 1 END, CASE ini WHEN 's' THEN f1 ELSE 1000000 END) ELSE 1000000 END) AS g0,
      least(2 + f1, CASE WHEN stays THEN more + f2 + CASE ini WHEN 'u' THEN 0 ELSE 1 END ELSE 1000000 END) AS g1,
      least(2 + f2, CASE WHEN stays THEN more + f3 + CASE ini WHEN 'a' THEN 0 ELSE 1 END ELSE 1000000 END) AS g2,
      least(2 + f3, CASE WHEN stays THEN more + f2 + CASE ini WHEN 'u' THEN 0 ELSE 1 END ELSE 1000000 END) AS g3
    FROM f JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more FROM r) r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i WHERE f.i > 0)),
w AS (
  SELECT DISTINCT conv_id, total, CAST(0 AS BIGINT) AS i, 0 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS turns, FALSE AS done FROM r
  UNION ALL
  SELECT conv_id, total, CASE WHEN edit IN ('D', 'K', 'R') THEN i + 1 ELSE i END, CASE edit WHEN 'D' THEN s WHEN 'K' THEN own WHEN 'R' THEN want WHEN 'I' THEN want ELSE s END, audit || edit,
    CASE edit WHEN 'K' THEN list_append(turns, role || ':' || txt) WHEN 'R' THEN list_append(turns, said || ':' || txt) WHEN 'I' THEN list_append(turns, said || ':') ELSE turns END, edit = ''
  FROM (SELECT *, CASE WHEN i = total AND s IN (0, 3) THEN '' WHEN i < total AND 2 + after[s + 1] = here[s + 1] THEN 'D' WHEN 5 + here[want + 1] = here[s + 1] THEN 'I'
      WHEN stays AND own >= 0 AND more + after[own + 1] = here[s + 1] THEN 'K' ELSE 'R' END AS edit FROM (
    SELECT w.*, a.role, a.txt, CASE w.s WHEN 2 THEN 3 ELSE 2 END AS want, CASE w.s WHEN 2 THEN 'assistant' ELSE 'user' END AS said, [h.f0, h.f1, h.f2, h.f3] AS here, [x.f0, x.f1, x.f2, x.f3] AS after,
      a.fault NOT IN ('blank', 'duplicate') AS stays, CASE a.fault WHEN 'truncated' THEN 5 ELSE 0 END AS more, CASE WHEN a.ini = 's' AND w.s = 0 THEN 1 WHEN a.ini = 'u' AND w.s <> 2 THEN 2 WHEN a.ini = 'a' AND w.s = 2 THEN 3 ELSE -1 END AS own
    FROM w JOIN f h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.i = w.i LEFT JOIN f x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1 LEFT JOIN r a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.i = w.i + 1
    WHERE NOT w.done))),
pairs AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM r),
sums AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (was IS NOT NULL AND was || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(f.f0, 0) AS BIGINT) AS cost,
  coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN (SELECT * FROM w WHERE done) w ON w.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN (SELECT * FROM f WHERE i = 0) f ON f.conv_id IS NOT DISTINCT FROM k.conv_id
"""


def _value(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_value, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


def _grown(name: str, source: str) -> str:
    """``name``: the nodes of every level of the trees of ``source`` (tree, i, n, digest), and ``name``_path: every leaf's siblings, from the leaf up."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, i, n, digest FROM {source}
  UNION ALL
  SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, level, i // 2, n),
{name}_path AS (
  SELECT l.tree, l.i AS leaf, list(CASE WHEN s.digest IS NULL THEN '-' WHEN s.i < (l.i >> p.level) THEN 'L' || s.digest ELSE 'R' || s.digest END ORDER BY p.level) AS path
  FROM (SELECT * FROM {name} WHERE level = 0) l JOIN {name} p ON p.tree = l.tree AND p.i = (l.i >> p.level) AND p.n > 1 LEFT JOIN {name} s ON s.tree = p.tree AND s.level = p.level AND s.i = xor(p.i, 1) GROUP BY l.tree, l.i)"""


MANIFEST = f"""
WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS digest, CASE WHEN doc_id IS NOT NULL AND {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS told FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_grown("low", "leaves")},
subroots AS (SELECT '' AS tree, tree AS own, digest, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
{_grown("high", "subroots")},
whole AS (SELECT l.doc_id, l.digest AS leaf, l.told, s.digest AS subroot, (SELECT digest FROM high WHERE n = 1) AS root, list_concat(coalesce(p.path, []), coalesce(q.path, [])) AS path
  FROM leaves l JOIN subroots s ON s.own = l.tree LEFT JOIN low_path p ON p.tree = l.tree AND p.leaf = l.i LEFT JOIN high_path q ON q.leaf = s.i),
folds AS (SELECT *, list_reduce(list_prepend(told, path), lambda acc, x: sha256(CASE left(x, 1) WHEN 'L' THEN substr(x, 2) || acc WHEN 'R' THEN acc || substr(x, 2) ELSE acc END)) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(path, lambda x: x <> '-'), lambda x: substr(x, 2)), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""

LINES = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^{_BLANK}+|{_BLANK}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN 1 END) >= 5),
x AS (SELECT k.*, coalesce(o.key IS NOT NULL AND (k.doc_id IS NULL OR k.doc_id < o.last), FALSE) AS gone FROM k LEFT JOIN often o ON o.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM x GROUP BY row
"""
