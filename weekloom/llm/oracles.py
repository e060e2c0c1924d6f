"""The same results as plain SQL, where SQL can express them."""

from __future__ import annotations

WORD = r"'[^\x20\x09-\x0D]+'"

ORACLES: dict[str, str] = {}

ORACLES["op1_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM starts),
owners AS (SELECT h, min(doc_id) AS owner FROM windows GROUP BY h),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN owners USING (h) WHERE doc_id > owner
),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (
    SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n
    FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

# Links come from the counts of shared shingles; classes of equal sets go on as one, and components follow by recursion.
ORACLES["op5_minhash_dedup"] = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS ws
    FROM documents
),
s AS (
    SELECT DISTINCT doc_id, unnest(
        CASE WHEN len(ws) = 0 THEN []
             WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END
    ) AS g FROM d
),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
classes AS (SELECT k, min(doc_id) AS rep, min(n) AS n FROM sizes GROUP BY k),
r AS (SELECT rep, classes.n, g FROM classes JOIN s ON s.doc_id = rep),
links AS (
    SELECT a.rep AS a, b.rep AS b FROM r AS a JOIN r AS b ON a.g = b.g AND a.rep <> b.rep
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
parts AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
    coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN classes USING (k) LEFT JOIN parts ON parts.rep = classes.rep
"""

ORACLES["op9_decontaminate"] = rf"""
WITH texts AS (
    SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
),
w AS (
    SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS ws
    FROM texts
),
items AS (SELECT id, least(len(ws), 5) AS n, ws FROM w WHERE kind = 1 AND len(ws) > 0),
item_shingles AS (
    SELECT DISTINCT id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g FROM items
),
widths AS (SELECT DISTINCT n FROM items),
doc_shingles AS (
    SELECT DISTINCT id AS doc_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g
    FROM w JOIN widths ON len(ws) >= n WHERE kind = 0
),
sizes AS (SELECT id, count(*) AS total FROM item_shingles GROUP BY id),
hits AS (
    SELECT doc_id, id FROM doc_shingles JOIN item_shingles USING (n, g) JOIN sizes USING (id)
    GROUP BY doc_id, id, total HAVING count(*) >= 0.8 * total
),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS item_ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids
FROM documents AS d LEFT JOIN found USING (doc_id)
"""

ORACLES["op10_embedding_dedup"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9
),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings AS e JOIN parts USING (vec_id) LEFT JOIN counts USING (vec_id)
"""


def _url_oracle(order: int = 4) -> str:
    grams = ",\n".join(
        f"""g{k} AS (SELECT right(run, {k}) AS g, sum(a) AS a, sum(b) AS b FROM runs GROUP BY 1),
c{k} AS (SELECT left(g, {k - 1}) AS c, sum(a) AS na, sum(b) AS nb, count(*) FILTER (a > 0) AS ta, count(*) FILTER (b > 0) AS tb FROM g{k} GROUP BY 1)"""
        for k in range(1, order + 1)
    )
    joins = "\n".join(
        f"LEFT JOIN g{k} ON g{k}.g = right(run, {k}) LEFT JOIN c{k} ON c{k}.c = left(right(run, {k}), {k - 1})" for k in range(1, order + 1)
    )
    chance = {}
    for s in "ab":
        p = "(1.0 / 256)"
        for k in range(1, order + 1):
            n, t = f"coalesce(c{k}.n{s}, 0)", f"coalesce(c{k}.t{s}, 0)"
            p = f"(CASE WHEN {n} + {t} > 0 THEN (coalesce(g{k}.{s}, 0) + {t} * {p}) / ({n} + {t})::DOUBLE ELSE {p} END)"
        chance[s] = p
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    whens = [("org", "/", "allow"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block")]
    whens = sorted(whens, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{h + p}'" for h, p, _ in whens)
    action = " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{v}'" for h, p, v in whens)
    return rf"""
WITH rest AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
),
p AS (
    SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
),
j AS (SELECT *, host || path AS address, CASE {rule} END AS rule, CASE {action} END AS action FROM p),
addresses AS (
    SELECT address, count(*) FILTER (action = 'allow') AS allowed, count(*) FILTER (action = 'block') AS blocked FROM j GROUP BY 1
),
chars AS (
    SELECT *, substr(repeat(chr(2), {order - 1}) || address || chr(3), i, {order}) AS run
    FROM (SELECT *, unnest(range(1, length(address) + 2)) AS i FROM addresses)
),
runs AS (SELECT run, sum(allowed) AS a, sum(blocked) AS b FROM chars GROUP BY 1),
{grams},
model AS (
    SELECT run, CAST(round((ln({chance["a"]}) - ln({chance["b"]})) * 1000000) AS BIGINT) AS micro FROM runs
    {joins}
),
scores AS (
    SELECT address, any_value(allowed) AS a, any_value(blocked) AS b, sum(micro) / count(*)::DOUBLE / 1000000 AS score
    FROM chars JOIN model USING (run) GROUP BY 1
),
bins AS (
    SELECT floor(greatest(-20.0, least(score, 20.0)) * 200) AS bin, sum(a) AS a, sum(b) AS b FROM scores WHERE a + b > 0 GROUP BY 1
),
cuts AS (
    SELECT bin, coalesce(sum(a) OVER before, 0) / (sum(a) OVER ())::DOUBLE + (sum(b) OVER () - coalesce(sum(b) OVER before, 0)) / (sum(b) OVER ())::DOUBLE AS wrong
    FROM bins WINDOW before AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
cut AS (SELECT bin / 200.0 AS least_score FROM cuts ORDER BY wrong, bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN score >= (SELECT least_score FROM cut) THEN 'allow' ELSE 'block' END) AS verdict
FROM j JOIN scores USING (address)
"""


ORACLES["op6_url_filter"] = _url_oracle()

# Nodes are named by their depth and the hashes of their turns; each node's ancestors are found along its smallest member.
ORACLES["op13_prefix_trie"] = rf"""
WITH own AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
),
h AS (
    SELECT DISTINCT c, c - c % 20 AS base,
        list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(8 * length(c::VARCHAR)),
            lambda i: ((ord(substr(c::VARCHAR, 1 + i // 8, 1)) >> (i % 8)) & 1)::UBIGINT)),
            lambda r, b: xor(r // 2, CASE WHEN (r % 2) <> b THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)) AS crc
    FROM own
),
k AS (SELECT c, base, 3 - (crc % 4)::BIGINT AS h FROM h),
told AS (
    SELECT k.c, 0 AS part, pos, role, text FROM k JOIN own ON own.c = base WHERE pos <= h
    UNION ALL SELECT k.c, 1, pos, role, text FROM k JOIN own USING (c) WHERE pos > h
),
turns AS (
    SELECT c, row_number() OVER w AS d, len(regexp_extract_all(text, {WORD})) AS words, c AS conv,
        string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path
    FROM told WINDOW w AS (PARTITION BY c ORDER BY part, pos)
),
members AS (SELECT c, 0 AS d, 0 AS words, '' AS path FROM k UNION ALL SELECT c, d, words, path FROM turns),
ends AS (SELECT c, max(d) AS last FROM members GROUP BY c),
n AS (
    SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
        string_agg(CASE WHEN d = last THEN c::VARCHAR END, ',' ORDER BY c) AS ended
    FROM members JOIN ends USING (c) GROUP BY d, path
),
child AS (SELECT d - 1 AS d, left(path, length(path) - 32) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN child USING (d, path)),
below AS (
    SELECT m.d, m.path, sum((x.n_children = 0)::BIGINT) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved
    FROM full_nodes AS x JOIN members AS m ON m.c = x.conv_id AND m.d <= x.d GROUP BY m.d, m.path
)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children,
    n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(f.ended, '')) AS ends_sha256
FROM full_nodes AS f JOIN below USING (d, path)
LEFT JOIN n AS p ON p.d = f.d - 1 AND p.path = left(f.path, greatest(0, length(f.path) - 32)) AND f.d > 0
"""

ORACLES["op12_collocations"] = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
runs AS (
    SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
    FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS size))
),
f AS (SELECT lang, size, phrase, count(*) AS n FROM runs GROUP BY lang, size, phrase HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
cand AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE size >= 2),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
scores AS (
    SELECT c.lang, c.phrase, c.a, l.n AS l, r.n AS r, t.n AS n, k,
        (1000::HUGEINT * c.a * t.n) // (l.n::HUGEINT * r.n) AS score
    FROM cuts AS c JOIN totals AS t USING (lang)
    JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:k], ' ')
    JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')
),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT DISTINCT s.lang, s.phrase FROM cand AS s JOIN cand AS b
    ON s.lang = b.lang AND b.size > s.size AND 100 * b.a >= 100 * s.a AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')
),
kept AS (SELECT * FROM lowest ANTI JOIN inside USING (lang, phrase))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
    a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
