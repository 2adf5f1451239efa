"""Plain SQL for those of the contract's queries that SQL can express and DuckDB runs quickly over whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DIGITS = ", ".join(f"substr('{UPPER}234567', 1 + CAST((v >> {shift}) & 31 AS INTEGER), 1)" for shift in (15, 10, 5, 0))

OP1 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
o AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS owner FROM p),
g AS (SELECT page_id, k, CAST('0x' || substr(s, 5 * k + 1, 5) AS BIGINT) AS v FROM o CROSS JOIN range(8) r(k)),
d AS (SELECT page_id, string_agg(concat({DIGITS}), '' ORDER BY k) AS digest FROM g GROUP BY page_id)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN owner <> page_id THEN owner END AS refers_to FROM o JOIN d USING (page_id)"""

OP5 = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.n > 0 AND b.n > 0 WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
comp AS (SELECT node AS vec_id, min(other) AS component_id FROM reach GROUP BY node)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = vec_id AS kept FROM comp LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a) USING (vec_id)"""

OP6 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW}, '{SPACED}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT node AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n ON n.doc_id = node GROUP BY node"""

OP7 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOW}, '{ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
place AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM win))),
hits AS (SELECT doc_id, i, n, item_id FROM place JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""

OP9 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS o FROM win) WHERE o > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later)),
placed AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""



def crc(text: str) -> str:
    """CRC-32 of ASCII text, bit by bit."""
    bits = "list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda y: CAST(ascii(y) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, x: {bits}))"


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256(concat({', '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"


LEVELS = 12  # 8**12 nodes


def _levels(name: str, nodes: str) -> str:
    """CTEs of a tree over `nodes` (g, p, h): all levels as `name` (g, level, p, h, n)."""
    parts = [f"{name}0 AS (SELECT g, p, h, count(*) OVER (PARTITION BY g) AS n FROM {nodes})"]
    for k in range(1, LEVELS + 1):
        parts.append(f"{name}{k} AS (SELECT g, p, h, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, p // 8 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM {name}{k - 1} WHERE n > 1 GROUP BY g, p // 8))")
    union = " UNION ALL ".join(f"SELECT g, {k} AS level, p, h, n FROM {name}{k}" for k in range(LEVELS + 1))
    return ", ".join(parts) + f", {name} AS ({union})"


def _steps(name: str, tree: str) -> str:
    """CTEs of each node's way up: (g, p, level, before, after), the digests left and right of it in its run."""
    return (
        f"{name} AS (SELECT a.g, a.p, t.level, string_agg(t.h, '' ORDER BY t.p) FILTER (t.p < a.p // CAST(pow(8, t.level) AS BIGINT)) AS before, string_agg(t.h, '' ORDER BY t.p) FILTER (t.p > a.p // CAST(pow(8, t.level) AS BIGINT)) AS after "
        f"FROM {tree}0 a JOIN {tree} t ON a.g = t.g AND t.n > 1 AND t.p // 8 = a.p // CAST(pow(8, t.level + 1) AS BIGINT) GROUP BY a.g, a.p, t.level)"
    )


OP11 = f"""WITH leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("text")} AS h, CASE WHEN {crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM leaves),
{_levels("t", "placed")}, {_steps("up", "t")},
subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS q FROM t WHERE n = 1),
tops AS (SELECT '' AS g, q AS p, subroot AS h FROM subs),
{_levels("r", "tops")}, {_steps("over", "r")},
root AS (SELECT h AS root FROM r WHERE n = 1),
steps AS (SELECT g, p, level, before, after FROM up UNION ALL SELECT placed.g, placed.p, 100 + level, before, after FROM placed JOIN subs USING (g) JOIN over ON over.p = subs.q),
lists AS (SELECT g, p, string_agg(concat(before, after), '' ORDER BY level) AS siblings, list({{'b': coalesce(before, ''), 'a': coalesce(after, '')}} ORDER BY level) AS ways FROM steps GROUP BY g, p),
joined AS (SELECT placed.*, subroot, root, coalesce(siblings, '') AS siblings, coalesce(ways, []) AS ways FROM placed JOIN subs USING (g) CROSS JOIN root LEFT JOIN lists ON lists.g = placed.g AND lists.p = placed.p),
folds AS (SELECT *, list_reduce(list_prepend({{'b': '', 'a': coalesce(other, h)}}, ways), lambda x, y: {{'b': '', 'a': sha256(concat(y.b, x.a, y.a))}}).a AS fold FROM joined)
SELECT doc_id, h AS leaf, subroot, root, sha256(siblings) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM folds"""


def _code(branch: str, name: str) -> str:
    return f"({crc(f"concat('{branch}:', CAST(doc_id AS VARCHAR), ':', {name})")} % 11)"


def _column(name: str, branch: str) -> str:
    return f"CASE {_code(branch, repr(name))} WHEN 0 THEN '' WHEN 1 THEN {name} || '!' WHEN 2 THEN {name} || '?' ELSE {name} END"


def _merged(name: str) -> str:
    x, y = f"{name}_l", f"{name}_r"
    return f"CASE WHEN {x} <> {name} AND {y} <> {name} AND {x} <> {y} THEN {name} WHEN {x} <> {name} THEN {x} ELSE {y} END"


_BOTH = " + ".join(f"CAST({c}_l <> {c} AND {c}_r <> {c} AND {c}_l <> {c}_r AS BIGINT)" for c in ("lang", "source"))
_EITHER = " + ".join(f"CAST(({c}_l <> {c} OR {c}_r <> {c}) AND NOT ({c}_l <> {c} AND {c}_r <> {c} AND {c}_l <> {c}_r) AS BIGINT)" for c in ("lang", "source"))

OP13 = f"""WITH b AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
c AS (SELECT *, {", ".join(f"{_column(c, b)} AS {c}_{b.lower()}" for c in ("lang", "source") for b in "LR")}, {_code("L", "'row'")} AS row_l, {_code("R", "'row'")} AS row_r, string_split(text, chr(10)) AS lines FROM b),
n AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM c),
u AS (SELECT *, {_code("L", "CAST(k AS VARCHAR)")} AS x, {_code("R", "CAST(k AS VARCHAR)")} AS y FROM n),
v AS (SELECT *, x < 3 AND y < 3 AND x <> y AS clash, coalesce(least(CASE WHEN x < 3 THEN x END, CASE WHEN y < 3 THEN y END), 9) AS edit,
 x IN (3, 4) AND y IN (3, 4) AND x <> y AS clash_gap, coalesce(least(CASE WHEN x IN (3, 4) THEN x END, CASE WHEN y IN (3, 4) THEN y END), 9) AS gap FROM u),
w AS (SELECT doc_id, sum(CAST(x < 5 AS BIGINT)) AS n_l, sum(CAST(y < 5 AS BIGINT)) AS n_r, sum(CAST(edit < 3 AND NOT clash AS BIGINT) + CAST(gap < 5 AND NOT clash_gap AS BIGINT)) AS clean,
 sum(CAST(clash AND x > 0 AND y > 0 AS BIGINT)) AS ee, sum(CAST(clash AND (x = 0 OR y = 0) AS BIGINT)) AS ed, sum(CAST(clash_gap AS BIGINT)) AS ii,
 string_agg(CASE WHEN edit = 0 AND NOT clash THEN '' ELSE line || CASE WHEN clash THEN '' WHEN edit = 1 THEN '!' WHEN edit = 2 THEN '?' ELSE '' END || chr(10) END || CASE WHEN clash_gap THEN '' WHEN gap = 3 THEN '!' || chr(10) WHEN gap = 4 THEN '?' || chr(10) ELSE '' END, '' ORDER BY k) AS t FROM v GROUP BY doc_id),
m AS (SELECT c.*, w.* EXCLUDE (doc_id), row_l = 0 OR row_r = 0 AS cut, CASE WHEN row_l = 0 AND row_r = 0 THEN false WHEN row_l = 0 THEN n_r > 0 OR lang_r <> lang OR source_r <> source WHEN row_r = 0 THEN n_l > 0 OR lang_l <> lang OR source_l <> source ELSE false END AS lost FROM c JOIN w USING (doc_id)),
rows AS (SELECT doc_id, CASE WHEN NOT cut THEN {_merged("lang")} WHEN lost THEN lang END AS lang, CASE WHEN NOT cut THEN {_merged("source")} WHEN lost THEN source END AS source,
 CASE WHEN NOT cut THEN sha256(CASE WHEN t = '' THEN '' ELSE left(t, length(t) - 1) END) WHEN lost THEN sha256(text) END AS text_sha256,
 CASE WHEN NOT cut THEN clean + {_EITHER} WHEN lost THEN 0 ELSE 1 END AS n_clean, CASE WHEN cut THEN 0 ELSE ee + {_BOTH} END AS n_edit_edit, CASE WHEN cut THEN CAST(lost AS BIGINT) ELSE ed END AS n_edit_delete, CASE WHEN cut THEN 0 ELSE ii END AS n_insert_insert FROM m),
added AS (SELECT -1 - doc_id AS doc_id, 'L' AS side, {{'t': CASE row_l WHEN 3 THEN '!' ELSE '?' END, 'l': lang, 's': source}} AS r FROM c WHERE row_l IN (3, 4) UNION ALL SELECT -2 - doc_id, 'R', {{'t': CASE row_r WHEN 3 THEN '!' ELSE '?' END, 'l': lang, 's': source}} FROM c WHERE row_r IN (3, 4)),
met AS (SELECT doc_id, min(r) FILTER (side = 'L') AS x, min(r) FILTER (side = 'R') AS y FROM added WHERE doc_id NOT IN (SELECT doc_id FROM b) GROUP BY doc_id),
won AS (SELECT doc_id, x IS NOT NULL AND y IS NOT NULL AND x <> y AS clash, CASE WHEN x IS NOT NULL AND y IS NOT NULL AND x <> y THEN NULL ELSE coalesce(x, y) END AS r FROM met)
SELECT doc_id, lang, source, text_sha256, CAST(n_clean AS BIGINT) AS n_clean, CAST(n_edit_edit AS BIGINT) AS n_edit_edit, CAST(n_edit_delete AS BIGINT) AS n_edit_delete, CAST(n_insert_insert AS BIGINT) AS n_insert_insert FROM rows
UNION ALL SELECT doc_id, r.l, r.s, CASE WHEN r IS NOT NULL THEN sha256(r.t) END, CAST(NOT clash AS BIGINT), 0, 0, CAST(clash AS BIGINT) FROM won"""

ORACLES = {"op1_warc": OP1, "op5_embedding_dedup": OP5, "op6_ngram_join": OP6, "op7_decontamination": OP7, "op9_substring_dedup": OP9, "op11_merkle_manifest": OP11, "op13_branch_merge": OP13}
