"""The chat query in DuckDB's SQL: lines, parts, originals and replies by plain joins, threads by recursive walks."""

from __future__ import annotations


def _lines(text: str) -> str:
    return rf"list_transform(string_split({text}, chr(10)), lambda z: lower(trim(regexp_replace(z, '[\x09-\x0D\x{{85}}\p{{Z}}]+', ' ', 'g'))))"


_paragraphs = r"list_transform(string_split_regex(array_to_string(ls, chr(10)), '\n\n+'), lambda p: trim(replace(p, chr(10), ' ')))"
_mark = r"^((?:[ \t]{0,3}>)+)[ \t]?"
_blanks = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, replace(coalesce(text, ''), concat(chr(13), chr(10)), chr(10)) AS t FROM conversations),
li AS (SELECT rid, i, len(regexp_replace(regexp_extract(line, '{_mark}', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '{_mark}', '') AS rest
    FROM (SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT rid, string_split(t, chr(10)) AS ls FROM m))),
ch AS (SELECT *, (level IS DISTINCT FROM lag(level) OVER (PARTITION BY rid ORDER BY i))::INT AS new FROM li),
g AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM ch),
runs AS (SELECT rid, run - 1 AS pos, any_value(level) AS level, string_agg(rest, chr(10) ORDER BY i) AS passage FROM g GROUP BY rid, run),
bodies AS (SELECT rid, conv_id, turn, coalesce(trim(b, {_blanks}), '') AS body FROM m LEFT JOIN (SELECT rid, string_agg(passage, chr(10) ORDER BY pos) AS b FROM runs WHERE level = 0 GROUP BY rid) USING (rid)),
counts AS (SELECT rid, count(*) AS n_passages, max(level) AS max_level FROM runs WHERE level > 0 GROUP BY rid),
pl AS (SELECT rid, conv_id, turn, pos, level, ls, list_filter(ls, lambda z: z <> '') AS fl FROM (SELECT rid, conv_id, turn, pos, level, {_lines('passage')} AS ls FROM runs JOIN m USING (rid) WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL)),
pw AS (SELECT *, CASE WHEN len(fl) > 0 THEN CAST(pow(2, floor(log2(len(fl) + 0.5))) AS BIGINT) ELSE 0 END AS w FROM pl),
px AS (SELECT *, list_concat([array_to_string(fl, ' ')], {_paragraphs}, CASE WHEN w > 1 THEN [array_to_string(fl[1:w], chr(10)), array_to_string(fl[len(fl) - w + 1:len(fl)], chr(10))] ELSE [] END, fl) AS parts FROM pw),
pt AS (SELECT conv_id, turn, pos, level, txt, min(p) AS part FROM (SELECT conv_id, turn, pos, level, unnest(parts) AS txt, generate_subscripts(parts, 1) AS p FROM px) WHERE txt <> '' GROUP BY ALL),
sizes AS (SELECT list(DISTINCT w) FILTER (w > 1) AS sizes FROM pw),
bl AS (SELECT rid, conv_id, turn, ls, list_filter(ls, lambda z: z <> '') AS fl FROM (SELECT rid, conv_id, turn, {_lines('body')} AS ls FROM bodies WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
bw AS (SELECT conv_id, turn, array_to_string(fl[i:i + w - 1], chr(10)) AS txt FROM (SELECT conv_id, turn, fl, w, unnest(range(1, len(fl) - w + 2)) AS i FROM (SELECT *, unnest((SELECT sizes FROM sizes)) AS w FROM bl))),
bt AS (SELECT conv_id, turn, unnest(list_concat([array_to_string(fl, ' ')], {_paragraphs}, fl)) AS txt FROM bl),
h AS (SELECT conv_id, txt, min(turn) AS ht FROM (SELECT * FROM bt UNION ALL SELECT * FROM bw) WHERE txt <> '' GROUP BY ALL),
hit AS (SELECT pt.conv_id, pt.turn, pt.pos, pt.level, pt.txt, pt.part, min(own.ht) AS ht, min(x.conv_id) AS oc, arg_min(x.ht, x.conv_id) AS ot
    FROM pt LEFT JOIN h own ON own.txt = pt.txt AND own.conv_id = pt.conv_id AND own.ht < pt.turn LEFT JOIN h x ON x.txt = pt.txt AND x.conv_id <> pt.conv_id GROUP BY ALL),
tg AS (SELECT *, CASE WHEN ht IS NOT NULL THEN conv_id ELSE oc END AS tc, coalesce(ht, ot) AS tt FROM hit WHERE ht IS NOT NULL OR oc IS NOT NULL),
ag AS (SELECT conv_id, turn, level, pos, tc, tt, min(part) AS part, sum(length(txt)) AS n FROM tg GROUP BY ALL),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, level, pos ORDER BY part > 1, n DESC, part, tc, tt) AS o FROM ag) WHERE o = 1),
re AS (SELECT conv_id, turn, arg_min({{'c': tc, 't': tt}}, {{'l': level, 'p': pos}}) AS target, count(DISTINCT pos) AS n_linked FROM be GROUP BY ALL),
ids AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
up AS (SELECT conv_id, turn, before, target, n_linked, coalesce(target.c, CASE WHEN before IS NOT NULL THEN conv_id END) AS pc, coalesce(target.t, before) AS pt FROM ids LEFT JOIN re USING (conv_id, turn)),
reach(qc, qt, c, t) AS (SELECT conv_id, turn, pc, pt FROM up WHERE target IS NOT NULL UNION SELECT qc, qt, pc, pt FROM reach JOIN up ON conv_id = c AND turn = t WHERE pc IS NOT NULL),
ring AS (SELECT qc, qt FROM reach WHERE qc = c AND qt = t),
cut AS (SELECT DISTINCT arg_min({{'c': b.qc, 't': b.qt}}, {{'c': b.qc, 't': b.qt}}) AS x FROM ring a JOIN reach r ON r.qc = a.qc AND r.qt = a.qt JOIN ring b ON b.qc = r.c AND b.qt = r.t GROUP BY a.qc, a.qt),
tree AS (SELECT up.*, x IS NOT NULL AS is_cut FROM up LEFT JOIN cut ON x.c = conv_id AND x.t = turn),
walk(conv_id, turn, thread_conv, thread_turn, depth, path) AS (SELECT conv_id, turn, conv_id, turn, 0::BIGINT, [{{'c': conv_id, 't': turn}}] FROM tree WHERE pc IS NULL OR is_cut
    UNION ALL SELECT tree.conv_id, tree.turn, thread_conv, thread_turn, depth + 1, list_append(path, {{'c': tree.conv_id, 't': tree.turn}}) FROM walk JOIN tree ON pc = walk.conv_id AND pt = walk.turn AND NOT is_cut),
spot AS (SELECT *, row_number() OVER (PARTITION BY thread_conv, thread_turn ORDER BY path) - 1 AS position FROM walk)
SELECT m.conv_id, m.turn, m.role, body, coalesce(n_passages, 0) AS n_passages, coalesce(n_linked, 0) AS n_linked, coalesce(max_level, 0)::BIGINT AS max_level,
    CASE WHEN NOT is_cut THEN pc END AS reply_conv, CASE WHEN NOT is_cut THEN pt END AS reply_turn, CASE WHEN is_cut OR pc IS NULL THEN NULL WHEN target IS NOT NULL THEN 'quote' ELSE 'turn' END AS reply_by, thread_conv, thread_turn, depth, position
FROM m JOIN bodies USING (rid) LEFT JOIN counts USING (rid) LEFT JOIN tree ON tree.conv_id = m.conv_id AND tree.turn = m.turn LEFT JOIN spot ON spot.conv_id = m.conv_id AND spot.turn = m.turn
"""
