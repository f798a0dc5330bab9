"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from . import sharding, urlfilter

M = sharding.TABLE_SIZE

OP8 = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.i, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.i <> q.i
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op1(shards: list[str]) -> str:
    """The table is filled turn by turn in a recursive query: owner is the list of slots."""
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    return f"""
WITH RECURSIVE shards AS (
  SELECT i, name, CAST('0x' || substr(md5(name), 1, 15) AS BIGINT) % {M} AS off, CAST('0x' || substr(md5(name), 16, 15) AS BIGINT) % {M - 1} + 1 AS step FROM (VALUES {names}) t(i, name)),
fill AS (
  SELECT 0 AS turn, list_transform(range({M}), lambda x: CAST(-1 AS BIGINT)) AS owner
  UNION ALL
  SELECT turn + 1, owner[:slot] || [i] || owner[slot + 2:] FROM (
    SELECT f.turn, f.owner, CAST(s.i AS BIGINT) AS i, (s.off + s.step * list_position(list_transform(range({M}), lambda k: f.owner[(s.off + s.step * k) % {M} + 1]), CAST(-1 AS BIGINT)) - s.step) % {M} AS slot
    FROM fill f JOIN shards s ON s.i = f.turn % {len(shards)} WHERE f.turn < {M})),
slots AS (SELECT unnest(range({M})) AS slot, unnest(owner) AS i FROM fill WHERE turn = {M})
SELECT doc_id, CAST(d.slot AS INTEGER) AS slot, name AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '{sharding.NULL_KEY}')), 1, 15) AS BIGINT) % {M} AS slot FROM documents) d JOIN slots s ON s.slot = d.slot JOIN shards USING (i)
"""


def op3(forged: str) -> str:
    esc = lambda c: f"replace(replace({c}, '\\', '\\\\'), '<|', '<\\|')"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{forged}' UNION ALL SELECT -1, 1, 'assistant', '{forged}'),
sized AS (
  SELECT *, sum(len('<|im_start|>') + len(replace({esc("role")}, chr(10), '\\n')) + 1 + len({esc("text")}) + len('<|im_end|>') + 1) OVER w AS upto, lead(turn) OVER w IS NULL AS last
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op7() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{(h + p, v)[k]}'" for v, h, p in ordered) + " END"
    d = urlfilter.DAMPING

    def ranks(name: str, edges: str, seeds: str, rounds: int = 200) -> str:
        """Plain power iteration; after 200 rounds what is left is below 1e-14 of the whole."""
        return f"""{name}_moves AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM {edges}),
{name}_hosts AS MATERIALIZED (SELECT host FROM {seeds} UNION SELECT src FROM {edges} UNION SELECT dst FROM {edges}),
{name}_ranks AS (
  SELECT 0 AS k, host, coalesce(seed, 0) AS rank FROM {name}_hosts LEFT JOIN {seeds} USING (host)
  UNION ALL
  SELECT any_value(l.k) + 1, h.host, {1 - d} * coalesce(any_value(s.seed), 0) + {d} * coalesce(sum(r.rank * m.share), 0)
  FROM {name}_hosts h LEFT JOIN {seeds} s USING (host) LEFT JOIN {name}_moves m ON m.dst = h.host LEFT JOIN {name}_ranks r ON r.host = m.src, (SELECT max(k) AS k FROM {name}_ranks) l
  WHERE l.k < {rounds} GROUP BY h.host),
{name} AS MATERIALIZED (SELECT host, rank FROM {name}_ranks WHERE k = {rounds})"""

    seeds = lambda v: f"SELECT host, count(*) / sum(count(*)) OVER () AS seed FROM judged WHERE ruled = '{v}' AND host <> '' GROUP BY host"
    return f"""
WITH RECURSIVE named AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
judged AS MATERIALIZED (SELECT *, {case(0)} AS rule, {case(1)} AS ruled FROM named),
links AS (SELECT host, CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END AS href FROM (
  SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS href FROM judged)),
counted AS (SELECT host AS src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (
  SELECT host, CASE WHEN contains(href, '://') THEN translate(regexp_extract(href, '^.*?://([^/?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}') WHEN NOT regexp_matches(href, '^([A-Za-z][A-Za-z0-9+.-]*:|#)') THEN host END AS dst FROM links) WHERE host <> '' AND dst <> '' GROUP BY ALL),
hosts AS (SELECT src AS host FROM counted UNION SELECT dst FROM counted UNION SELECT host FROM judged WHERE host <> ''),
parents AS (SELECT host AS src, regexp_replace(host, '^[^.]*\\.', '') AS dst FROM hosts WHERE len(string_split(host, '.')) > 2),
kin AS (SELECT src, dst FROM parents UNION SELECT dst, src FROM parents),
edges AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM counted UNION ALL SELECT src, dst, {urlfilter.KIN} FROM kin) GROUP BY ALL),
back AS (SELECT dst AS src, src AS dst, weight FROM edges),
good AS MATERIALIZED ({seeds("allow")}), bad AS MATERIALIZED ({seeds("block")}),
{ranks("t", "edges", "good")},
{ranks("d", "back", "bad")},
scores AS (SELECT host, coalesce(t.rank, 0) AS trust, coalesce(d.rank, 0) AS distrust FROM t FULL JOIN d USING (host))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust > trust * {1 + urlfilter.TIE} THEN 'block' ELSE 'allow' END) AS verdict FROM judged LEFT JOIN scores USING (host)
"""


#: CRC-32 of a text of ASCII characters; its table is worked out first.
CRC = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS v)"""


def crc32(text: str) -> str:
    """In a query that has crc in its FROM clause."""
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda c, b: xor(c >> 8, v[xor(c, b) % 256 + 1]), 4294967295), 4294967295)"


def op13() -> str:
    """Prefixes as texts: a node's subtree is what starts with it."""
    return f"""
WITH {CRC},
said AS (SELECT conv_id, turn, md5(len(coalesce(role, '')) || chr(10) || coalesce(role, '') || coalesce(text, '')) AS d, octet_length(encode(coalesce(text, ''))) AS size FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos FROM said),
shape AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own), crc),
sequences AS (
  SELECT s.conv_id, 0 AS part, o.pos, o.d, o.size FROM shape s JOIN own o ON o.conv_id = s.base AND o.pos <= s.h
  UNION ALL SELECT s.conv_id, 1, o.pos, o.d, o.size FROM shape s JOIN own o ON o.conv_id = s.conv_id AND o.pos > s.h),
steps AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(d, '') OVER w AS path, size, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS ends
  FROM sequences WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM sequences) FROM shape),
nodes AS MATERIALIZED (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM steps GROUP BY path, depth),
linked AS MATERIALIZED (SELECT n.*, p.conv_id AS parent_conv_id, count(k.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.path = left(n.path, len(n.path) - 32) AND n.depth > 0 LEFT JOIN nodes k ON left(k.path, len(k.path) - 32) = n.path AND k.depth > 0 GROUP BY ALL)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, CAST(count(*) FILTER (s.n_children = 0) AS BIGINT) AS n_leaves,
  CAST(sum((s.n_convs - 1) * s.size) AS BIGINT) AS saved_tokens, n.ends_sha256
FROM linked n JOIN linked s ON starts_with(s.path, n.path) GROUP BY ALL
"""


def all_sql(shards: list[str], forged: str) -> dict[str, str]:
    return {"op1_sharding": op1(shards), "op3_chat": op3(forged), "op7_urlfilter": op7(), "op8_topk": OP8, "op13_trie": op13()}
