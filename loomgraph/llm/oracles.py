"""DuckDB SQL for the queries that SQL can express on whole tables."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op1_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n""",
    "op2_bm25_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
g AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM d),
f AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t, g GROUP BY term, n),
s AS (SELECT q.doc_id AS query_id, t.doc_id, sum(idf * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len(d.w) / a))) AS score
      FROM t q JOIN f USING (term) JOIN t USING (term) JOIN d ON d.doc_id = t.doc_id, g WHERE q.doc_id % 20 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "op3_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
x AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM x WHERE k > 1),
v AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
r AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS m FROM v ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(m, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)""",
    "op6_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
c AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(c.r) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id, n.n""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages),
x AS (SELECT *, sha1(h) AS s FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(s, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1), '' ORDER BY k) FROM (SELECT unnest(range(32)) AS k) q) AS payload_digest,
  CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m = page_id THEN NULL ELSE m END AS refers_to
FROM x""",
    "op8_sharding": r"""
WITH d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + octet_length(encode(coalesce(lang, ''))) + octet_length(encode(coalesce(source, ''))) + 16 AS BIGINT) AS n_bytes,
             lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)), 60, '0') AS bits FROM documents),
k AS (SELECT doc_id, n_bytes, k AS depth, substr(bits, 1, k) AS shard FROM d, (SELECT unnest(range(61)) AS k)),
b AS (SELECT shard, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows FROM k GROUP BY shard HAVING sum(n_bytes) <= 1048576 OR count(*) = 1),
f AS (SELECT k.*, b.shard_bytes, b.shard_rows, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS r FROM k JOIN b USING (shard))
SELECT doc_id, shard, depth::INTEGER AS depth, n_bytes, n_bytes > 1048576 AS oversized, shard_bytes::BIGINT AS shard_bytes, shard_rows FROM f WHERE r = 1""",
}


def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Assignments and means, a pair of table expressions a round; products of integers are exact in doubles here."""
    near = (
        "SELECT vec_id, label, p, first(e ORDER BY far, e) AS e, min(far)::BIGINT AS far, any_value(v) AS v"
        " FROM (SELECT *, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS far FROM q JOIN b{r} USING (p)) GROUP BY vec_id, label, p"
    )
    step = (
        "m{r} AS (SELECT p, e, list(floor(s / n) ORDER BY i) AS c FROM (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{r}) GROUP BY p, e, i) GROUP BY p, e),"
        " b{t} AS MATERIALIZED (SELECT b{r}.p, b{r}.e, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (p, e))"
    )
    out = [
        "k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"q AS MATERIALIZED (SELECT vec_id, label, p, w[p * len(w) // {parts} + 1:(p + 1) * len(w) // {parts}] AS v FROM k, (SELECT unnest(range({parts})) AS p))",
        f"b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM q QUALIFY e < {entries})",
    ]
    for r in range(rounds):
        out += [f"a{r} AS MATERIALIZED ({near.format(r=r)})", step.format(r=r, t=r + 1)]
    out += [
        f"a AS MATERIALIZED ({near.format(r=rounds)})",
        "g AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a GROUP BY vec_id, label)",
        f"h AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS x, unnest(range(len(c))) AS i FROM b{rounds}))",
    ]
    return "WITH " + ",\n".join(out) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM g, h"


ORACLES["op11_vector_codes"] = _vector_codes()

# CRC-32 a bit at a time: a byte is taken in, and eight steps (256) follow it.
_CRC = "xor(list_reduce(flatten(list_transform(range(len(conv_id::VARCHAR)), lambda i: [ascii(substr(conv_id::VARCHAR, i + 1, 1)), 256, 256, 256, 256, 256, 256, 256, 256])), lambda c, x: CASE WHEN x < 256 THEN xor(c, x::BIGINT) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT), 4294967295)"
ORACLES["op12_prefix_trie"] = f"""
WITH o AS (SELECT conv_id, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, len(coalesce(text, '')) AS chars,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, conv_id - conv_id % 100 AS block, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT k.conv_id, 0 AS own, o.i, x, chars FROM k JOIN o ON o.conv_id = block AND o.i <= h UNION ALL SELECT k.conv_id, 1, o.i, x, chars FROM k JOIN o ON o.conv_id = k.conv_id AND o.i > h),
t AS (SELECT *, row_number() OVER w AS depth, string_agg(x || '/', '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
p AS MATERIALIZED (SELECT conv_id, 0 AS depth, '' AS path, 0 AS chars FROM k UNION ALL SELECT conv_id, depth, path, chars FROM t),
e AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path),
n AS MATERIALIZED (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, CASE WHEN depth > 0 THEN left(path, length(path) - 65) END AS parent FROM p GROUP BY path, depth),
c AS (SELECT parent AS path, count(*) AS n_children FROM n GROUP BY parent),
s AS (SELECT a.path, count(*) FILTER (c.path IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.chars)::BIGINT AS saved_tokens FROM n a JOIN n b ON starts_with(b.path, a.path) LEFT JOIN c ON c.path = b.path GROUP BY a.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM n LEFT JOIN n m ON m.path = n.parent LEFT JOIN c ON c.path = n.path JOIN s ON s.path = n.path LEFT JOIN e ON e.path = n.path"""
# On pages whose article is marked and holds no template: its text without tags and with the references that occur there.
ORACLES["op13_html_text"] = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS t FROM pages),
d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text, length(text) AS n_chars FROM d"""
