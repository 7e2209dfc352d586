"""SQL for the operators' results where SQL can say them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


def _components(nodes: str, edges: str) -> str:
    """CTEs ``comp(id, c)``: the smallest id that links reach. ``edges(a, b)`` hold both directions."""
    return f"""reach AS (SELECT id, id AS r FROM {nodes} UNION SELECT reach.id, {edges}.b FROM reach JOIN {edges} ON {edges}.a = reach.r),
comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id)"""


BITS = " + ".join(f"{16 >> j} * CAST(substr(bits, 5 * k + {j + 1}, 1) AS INT)" for j in range(5))

WARC = f"""WITH d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)),
b AS (SELECT *, array_to_string(list_transform(string_split(x, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {BITS}, 1)), '') AS payload_digest,
 CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM b"""

MINHASH = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words("text", "[^\\x20\\x09-\\x0D]+")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[k:k + 2] END AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 85 * (x.n + y.n - i)),
nodes AS (SELECT doc_id AS id FROM documents), {_components("nodes", "e")}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, comp.c AS component_id, d.doc_id = comp.c AS kept FROM documents d JOIN comp ON comp.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

PATTERN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_words("text", PATTERN)} AS w FROM documents), i AS (SELECT item_id, {_words("text", PATTERN)} AS w FROM benchmark),
pw AS (SELECT DISTINCT item_id, s, w[k:k + s - 1] AS x FROM (SELECT item_id, w, least(13, len(w)) AS s, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, k, w[k:k + s - 1] AS x FROM (SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS k FROM d, (SELECT DISTINCT s FROM pw) WHERE len(w) >= s)),
o AS (SELECT doc_id, k, s, item_id FROM dw JOIN pw USING (s, x)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + s)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a), nodes AS (SELECT vec_id AS id FROM v), {_components("nodes", "e")}
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept FROM v JOIN comp ON comp.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""

CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n))"
BAND = f"""WITH tab AS (SELECT {CRC_TABLE} AS tab),
c AS (SELECT *, CAST(floor(100 * amount + 0.5) AS BIGINT) AS a, concat(sale_id, ',', line_no, ',', item_id) AS t FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND amount IS NOT NULL AND quantity <> 0),
d AS (SELECT *, (2 * a + quantity) * sign(quantity) AS x, 2 * abs(quantity)::BIGINT AS y FROM c),
l AS (SELECT sale_id, line_no, item_id, (x - (x % y + y) % y) // y AS u,
 xor(list_reduce(list_transform(range(1, length(t) + 1), lambda i: ascii(substr(t, i, 1))::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc FROM d, tab),
i AS (SELECT row_number() OVER () AS r, item_id, CAST(floor(100 * price + 0.5) AS BIGINT) AS p FROM items),
j AS (SELECT r, i.item_id AS item, abs(u - p) AS gap, u, sale_id, line_no, l.item_id AS line_item_id, crc FROM i JOIN l ON l.u BETWEEN least(p - 50, 1000 * p // 1005) AND greatest(p + 50, 1005 * p // 1000)
 WHERE l.item_id <> i.item_id AND (abs(u - p) <= 50 OR 1000 * abs(u - p) <= 5 * least(u, p))),
s AS (SELECT r, count(*) AS n, sum(gap) AS g, sum(crc) AS k FROM j GROUP BY r),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS rank FROM j) WHERE rank <= 10)
SELECT i.item_id, CAST(coalesce(rank, 0) AS INT) AS rank, CAST(gap AS BIGINT) AS gap, CAST(u AS BIGINT) AS u, sale_id, CAST(line_no AS BIGINT) AS line_no, line_item_id,
 CAST(coalesce(n, 0) AS BIGINT) AS n_pairs, CAST(coalesce(g, 0) AS BIGINT) AS gap_sum, CAST(coalesce(k, 0) AS BIGINT) AS lines_crc FROM i LEFT JOIN f ON f.r = i.r LEFT JOIN s ON s.r = i.r"""

ORACLES = {"op4_warc": WARC, "op5_minhash": MINHASH, "op7_decontamination": DECONTAMINATION, "op8_embeddings": EMBEDDINGS, "op13_band_join": BAND}
