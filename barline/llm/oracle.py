"""DuckDB SQL of the operators whose whole result SQL can express, by plain search instead of the operators' methods."""

from __future__ import annotations

from barline.llm.licenses import LOWER, TEMPLATES, UPPER, Template

WARC_SQL = """SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN again THEN least_id END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM (SELECT *, coalesce(strlen(html) >= 100 AND page_id > least_id, FALSE) AS again FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS least_id FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)))"""

#: Equal sets are one node; all pairs with a common shingle are counted; the smallest node that each one reaches names its class.
JACCARD_SQL = rf"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM worded),
same AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM shingled WHERE len(s) > 0 GROUP BY s),
posting AS (SELECT node, n, unnest(s) AS shingle FROM same),
linked AS (SELECT a.node AS a, b.node AS b FROM posting a JOIN posting b ON a.shingle = b.shingle AND a.node < b.node AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reached AS (SELECT node, node AS seen FROM same UNION SELECT r.node, e.b FROM reached r JOIN both_ways e ON r.seen = e.a),
labelled AS (SELECT node, min(seen) AS component_id FROM reached GROUP BY node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM shingled d LEFT JOIN same USING (s) LEFT JOIN labelled l USING (node)"""

#: Windows as texts, each kept at its first place.
REPEATS_SQL = r"""WITH worded AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT row, doc_id, start, hash(array_to_string(w[start:start + 19], ' ')) AS one, md5(array_to_string(w[start:start + 19], ' ')) AS two
FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 18)) AS start FROM worded WHERE len(w) >= 20)),
ranked AS (SELECT row, start, (coalesce(doc_id, 9223372036854775807), start) > min((coalesce(doc_id, 9223372036854775807), start)) OVER (PARTITION BY one, two) AS again FROM windows),
gone AS (SELECT row, list(DISTINCT place) AS gone FROM (SELECT row, unnest(range(start, start + 20)) AS place FROM ranked WHERE again) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_where(w, list_transform(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i))), ' ') END) AS kept_sha256
FROM worded LEFT JOIN gone USING (row)"""

FIM_SQL = """WITH seeded AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
numbered AS (SELECT doc_id, t, n, CAST(concat('0x', h[1:8]) AS BIGINT) % (n + 1) AS a, CAST(concat('0x', h[9:16]) AS BIGINT) % (n + 1) AS b, CAST(concat('0x', h[17:24]) AS BIGINT) % 100 AS c, CAST(concat('0x', h[25:32]) AS BIGINT) % 100 AS d FROM seeded),
formed AS (SELECT doc_id, t, n, least(a, b) AS x, greatest(a, b) AS y, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbered),
parts AS (SELECT *, substr(t, 1, x) AS p, substr(t, x + 1, y - x) AS m, substr(t, y + 1) AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
sha256(CASE form WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) WHEN 'spm' THEN concat('<S>', s, '<P>', p, '<M>', m) ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""


def _conversation_sql() -> str:
    """Rows one after another; of each place of the grammar the least (cost, audit) and the text that it gives."""
    order = {0: "n", 1: "s", 2: "u", 3: "a"}
    pick = lambda ways: f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"
    way = lambda s, cost, edit, line: f"CASE WHEN {s} IS NOT NULL THEN {{'cost': {s}.cost + {cost}, 'audit': {s}.audit || '{edit}', 'said': {s}.said || {line}}} END"
    put = lambda role: f"'\n{role}:'"
    inserts = f"""SELECT *, n AS n1, s AS s1, {pick(["u", way("n", 2, "I", put("user")), way("s", 2, "I", put("user")), way("a", 2, "I", put("user"))])} AS u1 FROM ahead"""
    inserts = f"SELECT *, {pick(['a', way('u1', 2, 'I', put('assistant'))])} AS a1 FROM ({inserts})"
    inserts = f"SELECT *, {pick(['u1', way('a1', 2, 'I', put('user'))])} AS u2 FROM ({inserts})"
    paid, fine = "CAST(fault = 'truncated' AS INT)", "fault IN ('', 'truncated')"
    keep = "'\n' || role || ':' || text"
    to_u = [f"CASE WHEN {fine} THEN {way(x, f'2 + {paid}', 'R', put('user') + ' || text')} END" for x in ("n1", "s1", "a1")] + [f"CASE WHEN {fine} AND role[1:1] = 'u' THEN {way(x, paid, 'K', keep)} END" for x in ("n1", "s1", "a1")]
    to_a = [f"CASE WHEN {fine} THEN {way('u2', f'2 + {paid}', 'R', put('assistant') + ' || text')} END", f"CASE WHEN {fine} AND role[1:1] = 'a' THEN {way('u2', paid, 'K', keep)} END"]
    to_s = [f"CASE WHEN {fine} AND role[1:1] = 's' THEN {way('n1', paid, 'K', keep)} END"]
    step = {"n": [way("n1", 3, "D", "''")], "s": [way("s1", 3, "D", "''"), *to_s], "u": [way("u2", 3, "D", "''"), *to_u], "a": [way("a1", 3, "D", "''"), *to_a]}
    moved = ", ".join(f"{pick(ways)} AS {s}" for s, ways in step.items())
    kind = "STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR)"
    begin = ", ".join(f"CAST({'NULL' if s != 'n' else chr(123) + repr('cost') + ': 0, ' + repr('audit') + ': ' + repr('') + ', ' + repr('said') + ': ' + repr('') + chr(125)} AS {kind}) AS {s}" for s in order.values())
    ended = pick(["n", "a", way("u", 2, "I", put("assistant")), way("s", 4, "II", put("user") + " || " + put("assistant"))])
    return rf"""WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS name FROM conversations),
slots AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS slot FROM named, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN slot = 4 THEN 'user' ELSE role END AS role, CASE slot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN slot = 3 THEN [0, 1] ELSE [0] END) AS copy FROM slots WHERE slot <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS seat FROM damaged),
judged AS (SELECT *, lead(role[1:1]) OVER (PARTITION BY conv_id ORDER BY seat) AS next_initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS told,
row_number() OVER (PARTITION BY conv_id, role, text ORDER BY seat) > 1 AS again FROM placed),
faulty AS MATERIALIZED (SELECT conv_id, turn, seat, role, text, next_initial, CASE WHEN told = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN told[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM judged),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS seat, {begin} FROM (SELECT DISTINCT conv_id FROM faulty)
UNION ALL SELECT conv_id, seat, {moved} FROM ({inserts.replace("FROM ahead", "FROM (SELECT f.conv_id, f.seat, f.role, f.text, f.fault, w.n, w.s, w.u, w.a FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.seat = w.seat + 1)")})),
last_of AS (SELECT conv_id, max(seat) AS seat, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
count(*) FILTER (next_initial IS NOT NULL AND role[1:1] || next_initial NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM faulty GROUP BY conv_id),
done AS (SELECT l.*, {ended} AS best FROM last_of l JOIN walk w ON w.conv_id IS NOT DISTINCT FROM l.conv_id AND w.seat = l.seat)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
coalesce(best.audit, '') AS audit, sha256(coalesce(best.said[2:], '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done d ON o.conv_id IS NOT DISTINCT FROM d.conv_id"""


CONVERSATION_SQL = _conversation_sql()


def _strings(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _places(t: Template) -> str:
    """A row for each place where the template's mandatory phrases stand, with the share of its words there."""
    (at, (first, *_)), *_ = t.phrases()
    stands = " AND ".join(f"w[start + {a + 1}:start + {a + len(p)}] = {_strings(p)}" for a, p in t.phrases())
    total = " + ".join(f"weight['{w}']" for w in t.words)
    held = " + ".join(f"CASE WHEN w[start + {k + 1}] = '{w}' THEN weight['{w}'] ELSE 0.0 END" for k, w in enumerate(t.words))
    return f"""SELECT row, '{t.label}' AS label, {t.base} AS base, start, ({held}) / ({total}) AS share
FROM (SELECT row, w, i - {at} AS start, weight FROM seats CROSS JOIN idf WHERE word = '{first}' AND i >= {at}) WHERE {stands}"""


def license_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    known = _strings(sorted({w for t in templates for w in t.words}))
    return rf"""WITH worded AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
seats AS MATERIALIZED (SELECT row, w, i, word FROM (SELECT row, w, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM worded WHERE list_has_any(w, {known})) WHERE list_contains({known}, word)),
idf AS MATERIALIZED (SELECT map(list(word), list(weight)) AS weight FROM (SELECT word, ln((n + 1) / (count(DISTINCT row) + 1)) + 1 AS weight
FROM (SELECT unnest({known}) AS word) LEFT JOIN seats USING (word) CROSS JOIN (SELECT count(*) AS n FROM worded) GROUP BY word, n)),
places AS ({" UNION ALL ".join(_places(t) for t in templates)}),
found AS (SELECT row, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
list_sort(list(DISTINCT label) FILTER (base)) AS base_labels, list_sort(list(DISTINCT label)) AS labels, max(share) AS score FROM places GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels, CAST(least(1.0, coalesce(score, 0.0)) AS DOUBLE) AS score
FROM worded LEFT JOIN found USING (row)"""
