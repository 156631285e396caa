"""DuckDB SQL for the queries that SQL can express on whole tables."""

_ALNUM = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

SQL = {
    "op5_decontamination": rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
b AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
bl AS (SELECT item_id, ws, least(13, len(ws)) AS l FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(ws[i + 1 : i + l], ' ') AS w
        FROM (SELECT item_id, ws, l, unnest(range(0, len(ws) - l + 1)) AS i FROM bl)),
lens AS (SELECT DISTINCT l FROM win),
pos AS (SELECT doc_id, l, i, array_to_string(ws[i + 1 : i + l], ' ') AS w
        FROM (SELECT doc_id, ws, l, unnest(range(0, len(ws) - l + 1)) AS i FROM d, lens WHERE len(ws) >= l)),
hit AS (SELECT doc_id, pos.l, i, item_id FROM pos JOIN win ON pos.l = win.l AND pos.w = win.w),
cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS k FROM (SELECT DISTINCT doc_id, i, l FROM hit)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op4_url_filter": r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rule, rhost, rpath, act) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
                               ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(act, length(rule)) AS act
        FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
mark AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
outc AS (SELECT host, bad FROM p JOIN mark ON TRY_CAST(nullif(regexp_extract(path, '/([0-9]{1,18})(?:\.html|/)?$', 1), '') AS BIGINT) = doc_id WHERE host <> ''),
cnt0 AS (SELECT host, count(*) AS n, sum(bad) AS k, string_split(host, '.') AS pt FROM outc GROUP BY host),
nm AS (SELECT DISTINCT host, string_split(host, '.') AS pt FROM p WHERE host <> ''),
nm2 AS (SELECT host, pt, CASE WHEN len(pt) > 2 AND length(pt[-1]) = 2 AND pt[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN pt[-2] || '.' || pt[-1] ELSE pt[-1] END AS suffix FROM nm),
nm3 AS (SELECT host, suffix, array_to_string(pt[greatest(1, len(pt) - len(string_split(suffix, '.'))) : len(pt)], '.') AS domain FROM nm2),
cnt AS (SELECT host, domain, suffix, n, k FROM cnt0 JOIN nm3 USING (host)),
w AS (SELECT (sum(k) + 0.5) / (sum(n) + 1.0) AS p FROM cnt),
s1 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(p) AS p FROM cnt, w GROUP BY suffix),
ms AS (SELECT (sum(n * (k / n - p) ** 2) - sum(p * (1 - p))) / nullif(sum(p * (1 - p) * (n - 1)), 0) AS rho FROM s1),
s2 AS (SELECT suffix, k + m * p AS a, n - k + m * (1 - p) AS b FROM s1, (SELECT coalesce(CASE WHEN rho <= 0.001 THEN 1000.0 ELSE greatest(8.0, least(1000.0, 1 / rho - 1)) END, 1000.0) AS m FROM ms)),
d1 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(a / (a + b)) AS p FROM cnt JOIN s2 USING (suffix) GROUP BY domain, suffix),
md AS (SELECT (sum(n * (k / n - p) ** 2) - sum(p * (1 - p))) / nullif(sum(p * (1 - p) * (n - 1)), 0) AS rho FROM d1),
d2 AS (SELECT domain, k + m * p AS a, n - k + m * (1 - p) AS b FROM d1, (SELECT coalesce(CASE WHEN rho <= 0.001 THEN 1000.0 ELSE greatest(8.0, least(1000.0, 1 / rho - 1)) END, 1000.0) AS m FROM md)),
h1 AS (SELECT host, n, k, a / (a + b) AS p FROM cnt JOIN d2 USING (domain)),
mh AS (SELECT (sum(n * (k / n - p) ** 2) - sum(p * (1 - p))) / nullif(sum(p * (1 - p) * (n - 1)), 0) AS rho FROM h1),
h2 AS (SELECT host, k + m * p AS a, n - k + m * (1 - p) AS b FROM h1, (SELECT coalesce(CASE WHEN rho <= 0.001 THEN 1000.0 ELSE greatest(8.0, least(1000.0, 1 / rho - 1)) END, 1000.0) AS m FROM mh)),
ab AS (SELECT host, coalesce(h2.a, d2.a, s2.a) AS a, coalesce(h2.b, d2.b, s2.b) AS b FROM nm3 LEFT JOIN h2 USING (host) LEFT JOIN d2 USING (domain) LEFT JOIN s2 USING (suffix)),
post AS (SELECT host, greatest(0.0, a / (a + b) - 1.6449 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1))) AS bound FROM ab)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.act, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (page_id) LEFT JOIN post ON p.host = post.host""",
    "op2_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
         SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                                    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.doc_id)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op9_html_extraction": r"""
WITH a AS (SELECT page_id, url, string_split(regexp_replace(replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<br>', ' '), '</?(?:p|h1)>', chr(1), 'g'), chr(1)) AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'),
             '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM a),
c AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c""",
    "op10_chat_format": r"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, role)),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>') AS et,
             replace(replace(replace(replace(role, '\', '\\'), '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>'), chr(10), '\n') AS er,
             CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS step FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(er) + 1 + length(et) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(step, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)+') AS valid
FROM e GROUP BY conv_id""",
    "base_text_stats": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS k FROM w) WHERE k > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
       CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(ws) AS base_failed
FROM d LEFT JOIN r USING (doc_id)""",
    "op11_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
l AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS ls, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(d, k, 8) AS BIGINT)) AS h FROM t),
c AS (SELECT *, CAST(len(ls) AS BIGINT) AS n, least(h[1] % (len(ls) + 1), h[2] % (len(ls) + 1)) AS lo, greatest(h[1] % (len(ls) + 1), h[2] % (len(ls) + 1)) AS hi FROM l),
p AS (SELECT *, array_to_string(ls[1 : lo], '') AS prefix, array_to_string(ls[lo + 1 : hi], '') AS middle, array_to_string(ls[hi + 1 : n], '') AS suffix,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p""",
    "op13_source_mix": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                            substr(sha256('13:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
s AS (SELECT source, source_size, CAST(2 * source_size AS DOUBLE) AS cap, CAST([5, 2, 1][k % 3 + 1] AS DOUBLE) AS w FROM s0),
fill(turn, n_full, rest, w) AS (
  SELECT 0, CAST(-1 AS BIGINT), CAST(1.5 AS DOUBLE) * sum(CAST(source_size AS DOUBLE)), sum(w) FROM s
  UNION ALL
  SELECT turn + 1, g.n_full, g.rest, g.w FROM fill, LATERAL (
    SELECT count(*) FILTER (fill.rest / fill.w * s.w > cap) AS n_full, CAST(1.5 AS DOUBLE) * sum(CAST(source_size AS DOUBLE)) - coalesce(sum(cap) FILTER (fill.rest / fill.w * s.w > cap), 0) AS rest,
           coalesce(sum(s.w) FILTER (NOT fill.rest / fill.w * s.w > cap), 0) AS w FROM s) g
  WHERE fill.w > 0 AND g.n_full > greatest(fill.n_full, 0)),
lv AS (SELECT rest, w FROM fill ORDER BY turn DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN lv.w = 0 THEN cap ELSE least(cap, lv.rest * s.w / lv.w) END AS target FROM s, lv),
b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
u AS (SELECT source, key, doc_id, size, count(*) AS m FROM d GROUP BY ALL),
o AS (SELECT *, sum(m * size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - m * size AS before FROM u)
SELECT d.doc_id, d.size, e.source_size, e.target,
       CAST(d.size * e.epochs + greatest(0, least(d.size * o.m, e.budget - e.epochs * e.source_size - o.before)) // o.m AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
JOIN o ON d.source IS NOT DISTINCT FROM o.source AND d.key = o.key AND d.doc_id IS NOT DISTINCT FROM o.doc_id AND d.size = o.size""",
    "op12_prefix_trie": r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, {'role': role, 'text': text} AS turn FROM t),
c AS (SELECT DISTINCT conv_id, conv_id - (conv_id % 5 + 5) % 5 AS base,
             xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                 lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h FROM o),
r AS (SELECT c.conv_id, pos, turn FROM c JOIN o ON o.conv_id = base AND pos < h UNION ALL SELECT c.conv_id, pos, turn FROM c JOIN o ON o.conv_id = c.conv_id AND pos >= h),
s AS (SELECT c.conv_id, list(turn ORDER BY pos) FILTER (pos IS NOT NULL) AS seq FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, coalesce(len(seq), 0) AS n, unnest(range(0, coalesce(len(seq), 0) + 1)) AS d, seq FROM s),
q AS (SELECT conv_id, n, d, CASE WHEN d = 0 THEN '' ELSE to_json(seq[1 : d])::VARCHAR END AS k, CASE WHEN d = 0 THEN '' WHEN d = 1 THEN '' ELSE to_json(seq[1 : d - 1])::VARCHAR END AS up, CASE WHEN d > 0 THEN octet_length(encode(seq[d].text)) ELSE 0 END AS b FROM p),
node AS (SELECT k, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(b) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM q GROUP BY k, d),
kids AS (SELECT up, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY up, d),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.up = node.k AND kids.d = node.d),
above AS (SELECT DISTINCT a.k, a.d, b.k AS k2, b.d AS d2 FROM q a JOIN q b ON a.conv_id = b.conv_id AND b.d >= a.d),
sums AS (SELECT a.k, a.d, sum(f.saved) AS saved, count(*) FILTER (f.n_children = 0) AS leaves FROM above a JOIN full_node f ON f.k = a.k2 AND f.d = a.d2 GROUP BY a.k, a.d)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM full_node f JOIN sums s ON s.k = f.k AND s.d = f.d LEFT JOIN node u ON f.d > 0 AND u.k = f.up AND u.d = f.d - 1""",
}
