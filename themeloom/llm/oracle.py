"""DuckDB SQL of the queries that SQL can express."""

QUERIES: dict[str, str] = {
    "op3_stratified_shards": """
        WITH table_steps AS (
            SELECT i, list_reduce(range(8), lambda acc, x:
                CASE WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END, i::BIGINT) AS c
            FROM range(256) t(i)
        ), crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM table_steps),
        rows AS (
            SELECT doc_id, source, coalesce(text, '') AS text,
                md5(concat('interleave:', doc_id, ':', coalesce(text, ''))) AS hash
            FROM documents
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY hash, doc_id) AS r,
                count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total
            FROM rows
        ), placed AS (
            SELECT *, row_number() OVER (
                ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS LAST, hash, doc_id) - 1 AS place
            FROM ranked
        )
        SELECT doc_id, (octet_length(encode(text)) + 1)::BIGINT AS size,
            xor(list_reduce(
                list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT),
                lambda acc, b: xor(acc // 256, crcs[xor(acc % 256, b) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32,
            'rows' AS law, (place * 16 // total)::INTEGER AS shard,
            (place - ((place * 16 // total) * total + 15) // 16)::BIGINT AS slot,
            NULL::INTEGER AS grown_shard
        FROM placed, crc_table
    """,
    "op8_exact_top_scores": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op12_shared_lines": """
        WITH rows AS (
            SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), lines AS (
            SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM rows
        ), keyed AS (
            SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS key
            FROM lines
        ), shared AS (
            SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key
            HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5
        ), judged AS (
            SELECT k.*, s.key IS NOT NULL AND coalesce(k.doc_id < s.last, s.last IS NOT NULL) AS gone
            FROM keyed k LEFT JOIN shared s USING (key)
        )
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY row, doc_id
    """,
    "op13_merkle_manifest": """
        WITH RECURSIVE table_steps AS (
            SELECT i, list_reduce(range(8), lambda acc, x:
                CASE WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END, i::BIGINT) AS c
            FROM range(256) t(i)
        ), crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM table_steps),
        given AS (
            SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                xor(list_reduce(
                    list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda b: ('0x' || b)::BIGINT),
                    lambda acc, b: xor(acc // 256, crcs[xor(acc % 256, b) + 1]), 4294967295), 4294967295) % 5 = 0 AS hit
            FROM documents, crc_table
        ), fields AS (
            SELECT *, concat(
                    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'),
                    coalesce(octet_length(encode(source)) || ':' || source, '-'),
                    coalesce(octet_length(encode(lang)) || ':' || lang, '-'),
                    coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')) AS head
            FROM given
        ), leaves AS (
            SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                CASE WHEN hit THEN sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) END AS changed
            FROM fields
        ), placed AS (
            SELECT *, row_number() OVER () AS row, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
                row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
                count(*) OVER (PARTITION BY source) AS n
            FROM leaves
        ), rows AS (
            SELECT *, (SELECT min(x) FROM range(16) t(x) WHERE 16::BIGINT ** x >= n)::BIGINT AS h FROM placed
        ), nodes(g, h, l, place, digest) AS (
            SELECT g, h, 0::BIGINT, place, leaf FROM rows
            UNION ALL
            SELECT g, any_value(h), l + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place))
            FROM nodes WHERE l < h GROUP BY g, l, place // 16
        ), subroots AS (SELECT g, digest AS subroot FROM nodes WHERE l = h),
        size AS (
            SELECT (SELECT min(x) FROM range(16) t(x) WHERE 16::BIGINT ** x >= (SELECT count(*) FROM subroots))::BIGINT AS top
        ), upper(l, place, digest) AS (
            SELECT 0::BIGINT, g, subroot FROM subroots
            UNION ALL
            SELECT l + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place))
            FROM upper, size WHERE l < top GROUP BY l, place // 16
        ), whole AS (SELECT digest AS root FROM upper, size WHERE l = top),
        runs AS (
            SELECT r.row, t.l AS step, t.place, t.digest, (r.place >> (4 * t.l)::INTEGER) AS own
            FROM rows r JOIN nodes t ON t.g = r.g AND t.l < r.h
                AND (t.place >> 4) = (r.place >> (4 * t.l + 4)::INTEGER)
            UNION ALL
            SELECT r.row, r.h + t.l, t.place, t.digest, (r.g >> (4 * t.l)::INTEGER)
            FROM rows r, size s JOIN upper t ON t.l < s.top AND (t.place >> 4) = (r.g >> (4 * t.l + 4)::INTEGER)
        ), steps AS (
            SELECT row, step, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place < own), '') AS before,
                coalesce(string_agg(digest, '' ORDER BY place) FILTER (place > own), '') AS after
            FROM runs GROUP BY row, step
        ), proofs AS (SELECT row, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM steps GROUP BY row),
        folds(row, step, digest) AS (
            SELECT row, 0::BIGINT, coalesce(changed, leaf) FROM rows
            UNION ALL
            SELECT f.row, f.step + 1, sha256(s.before || f.digest || s.after)
            FROM folds f JOIN steps s ON s.row = f.row AND s.step = f.step
        )
        SELECT r.doc_id, r.leaf, s.subroot, w.root, coalesce(p.proof, sha256('')) AS proof_sha256,
            f.digest AS folded_root, f.digest = w.root AS verified
        FROM rows r JOIN subroots s ON s.g = r.g CROSS JOIN whole w CROSS JOIN size z
            JOIN folds f ON f.row = r.row AND f.step = r.h + z.top LEFT JOIN proofs p ON p.row = r.row
    """,
}
