"""Expected results of the queries as SQL, where SQL can express them."""

# Escaping adds one character for each control string; a run of turns with one role has
# marks of 8, 8 and 7 characters, and other turns have a join mark of 8.
OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, row_number() OVER w AS k, coalesce(role = lag(role) OVER w, false) AS same,
    length(text) + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\]|/?SYS>)')) AS text_chars,
    length(role) + len(regexp_extract_all(role, '[<\[]\\*(\||/?s>|/?INST\]|/?SYS>)')) AS role_chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss,
    sum(text_chars + CASE WHEN same THEN 8 ELSE 8 + 8 + 7 + role_chars END) AS formatted_chars
  FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars
FROM c
"""

# Entries by md5 as in `dated_entries`; intervals from the changes of state; one row per
# page and interval that holds.
OP2 = r"""
WITH p AS (
  SELECT page_id, url,
    nullif(regexp_replace(regexp_extract(lower(trim(url)),
      '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') AS host,
    regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    ('0x' || substr(md5(page_id::VARCHAR), 1, 5))::BIGINT % 17520 AS hour
  FROM pages),
hosts AS (
  SELECT DISTINCT host, unnest(CASE WHEN regexp_matches(host, '^[0-9]+(\.[0-9]+){3}$|^\[') THEN [host]
    ELSE [array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')
      for i in range(1, len(string_split(host, '.')) + 1)] END) AS key
  FROM p WHERE host IS NOT NULL),
keys AS (
  SELECT DISTINCT 'spam' AS list, 'host' AS kind, key FROM hosts
  UNION ALL SELECT DISTINCT 'malware', 'url', host || path FROM p WHERE host || path IS NOT NULL),
k AS (
  SELECT *, ('0x' || substr(md5(key), 1, 4))::BIGINT % 8760 AS first,
    ('0x' || substr(md5(key), 5, 3))::BIGINT AS gap, ('0x' || substr(md5(key), 8, 3))::BIGINT AS gap2,
    ('0x' || substr(md5(key), 12, 1))::BIGINT AS turns
  FROM keys WHERE ('0x' || substr(md5(key), 11, 1))::BIGINT < 6),
valid AS (
  SELECT list, kind, key, first AS a, CASE WHEN turns >= 6 THEN first + 1 + gap END AS b FROM k
  UNION ALL SELECT list, kind, key, first + 1 + gap + 1 + gap2, NULL FROM k WHERE turns >= 11),
found AS (
  SELECT DISTINCT page_id, list FROM p JOIN hosts USING (host) JOIN valid v ON v.kind = 'host' AND v.key = hosts.key
  WHERE a <= hour AND (b IS NULL OR hour < b)
  UNION SELECT page_id, list FROM p JOIN valid v ON v.kind = 'url' AND v.key = host || path
  WHERE a <= hour AND (b IS NULL OR hour < b)),
lists AS (SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists FROM found GROUP BY page_id)
SELECT page_id, host AS url_host, coalesce(lists, '') AS url_lists, lists IS NOT NULL AS url_listed
FROM p LEFT JOIN lists USING (page_id)
"""

# All windows of all documents joined with those of the items.
OP9 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM (SELECT *, least(10, len(w)) AS k FROM i WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)),
found AS (SELECT doc_id, p, windows.k, item FROM places JOIN windows ON places.k = windows.k AND places.g = windows.g),
hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + k)) AS place FROM (SELECT DISTINCT doc_id, p, k FROM found)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# Totals counted at once from the last state of every document.
OP10 = r"""
WITH last AS (
  SELECT doc_id, source, lang,
    CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE coalesce(text, '') END AS text
  FROM documents WHERE length(text) >= 200 OR text IS NULL),
w AS (
  SELECT *, [x for x in string_split(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13),
    '      '), ' ') if x <> ''] AS words FROM last),
n AS (
  SELECT source, lang, 'words-1' AS version, len(words) AS tokens FROM w
  UNION ALL SELECT source, lang, 'words-2',
    len(words) + len([x for x in words if regexp_matches(x, '[!-/:-@\[-`{-~]$')]) FROM w
  UNION ALL SELECT source, lang, 'bytes-1', strlen(text) FROM w)
SELECT source, lang, version, count(*) AS documents, sum(tokens)::BIGINT AS tokens FROM n GROUP BY source, lang, version
"""

# All pairs with a common shingle, then their components by label propagation.
OP3 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
near AS (
  SELECT a, b FROM links JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b),
first AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a),
same AS (
  SELECT a AS doc_id, least(a, min(b)) AS set_id FROM links JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE common = x.n AND common = y.n GROUP BY a),
sets AS (SELECT doc_id, coalesce(set_id, doc_id) AS set_id FROM n LEFT JOIN same USING (doc_id)),
linked AS (
  SELECT near.a AS doc_id, count(DISTINCT y.set_id) AS n_links
  FROM near JOIN sets x ON x.doc_id = near.a JOIN sets y ON y.doc_id = near.b WHERE x.set_id <> y.set_id GROUP BY near.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
  coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN first USING (doc_id) LEFT JOIN linked USING (doc_id)
"""

# The ring's virtual nodes with the rows up to each; then one walk of two laps, a step for
# each visit, that fills the shards' rooms with the waiting rows.
OP11 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS place FROM documents),
i AS (SELECT *, row_number() OVER (ORDER BY place, doc_id) - 1 AS pos FROM d),
size AS (SELECT count(*) AS n FROM d),
node AS (
  SELECT id % 24 AS shard, ('0x' || substr(md5('shard/' || (id % 24) || '/' || (id // 24)), 1, 15))::BIGINT AS place
  FROM range(24 * 64) r(id)),
upto AS (
  SELECT row_number() OVER (ORDER BY node.place, shard) - 1 AS visit, shard,
    coalesce((SELECT max(pos) + 1 FROM i WHERE i.place <= node.place), 0) AS upto FROM node),
laps AS (
  SELECT visit, shard, upto FROM upto UNION ALL SELECT visit + 24 * 64, shard, n FROM upto, size),
walk AS (
  SELECT -1::BIGINT AS visit, 0::BIGINT AS pos, 0::BIGINT AS took, -1::BIGINT AS shard, 0::BIGINT AS base,
    [n // 24 + CASE WHEN s < n % 24 THEN 1 ELSE 0 END for s in range(24)] AS room
  FROM size
  UNION ALL
  SELECT laps.visit, walk.pos + walk.took, greatest(0, least(laps.upto - walk.pos - walk.took,
      CASE WHEN walk.shard = laps.shard THEN room[laps.shard + 1] - walk.took ELSE room[laps.shard + 1] END)),
    laps.shard, 0,
    [CASE WHEN s = walk.shard + 1 THEN room[s] - walk.took ELSE room[s] END for s in range(1, 25)]
  FROM walk JOIN laps ON laps.visit = walk.visit + 1),
crc AS (
  SELECT list(list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crc FROM range(256) r(b)),
part AS (
  SELECT pos AS first, pos + took AS last, shard, n // 24 + CASE WHEN shard < n % 24 THEN 1 ELSE 0 END - room[shard + 1] AS base
  FROM walk, size WHERE took > 0)
SELECT doc_id, strlen(t) + 8 AS size, xor(list_reduce([4294967295::BIGINT] ||
    list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda b: ('0x' || b)::BIGINT),
    lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS text_crc32,
  'rows' AS law, part.shard::INTEGER AS shard, (base + pos - first)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM i JOIN part ON pos >= first AND pos < last, crc
"""

ORACLES: dict[str, str] = {
    "op1_chat_format": OP1,
    "op2_url_filter": OP2,
    "op3_jaccard_join": OP3,
    "op9_decontaminate": OP9,
    "op10_token_counts": OP10,
    "op11_sharding": OP11,
}
