"""DuckDB SQL for the queries that SQL can express, over the same whole tables.

Fixed values (patterns, thresholds, masks) are stated again here on purpose,
so that a wrong one in the operator does not pass.
"""

SHARDING = """
WITH RECURSIVE crc_step(n, k, c) AS (
    SELECT i, 0, i FROM range(256) t(i)
    UNION ALL
    SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM crc_step WHERE k < 8
), crc_table AS (
    SELECT list(c::BIGINT ORDER BY n) AS t FROM crc_step WHERE k = 8
), d AS (
    SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
           list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
    FROM documents
), sized AS (
    SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
    FROM d, crc_table
), placed AS (
    SELECT *, sum(size) OVER w - size AS start, row_number() OVER w - 1 AS row, sum(size) OVER () AS total
    FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
), cut AS (
    SELECT *, least(15, ((2 * start + size) * 16) // (2 * total))::INTEGER AS shard FROM placed
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       (row - min(row) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""

QUALITY = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
           string_split(coalesce(text, ''), chr(10)) AS l
    FROM documents
), windows AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (
        SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d))
), repeated AS (
    SELECT r, count(DISTINCT i + k) AS n FROM windows, range(3) o(k) WHERE n > 1 GROUP BY r
), lines AS (
    SELECT r, i, x, row_number() OVER (PARTITION BY r, x ORDER BY i) > 1 AS again,
           len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n
    FROM (SELECT r, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM d)
), judged AS (
    SELECT *, len(regexp_extract_all(x, '[#*$%&|<>]+|[!?]{2,}')) AS marks,
           len(regexp_extract_all(x, '(^|\s)[|>»›·•/\\]+(\s|$)')) AS separators
    FROM lines
), failed AS (
    SELECT *, n > 0 AND ((marks >= 2 AND marks > 0.3 * n)
        OR (n < 4 AND NOT regexp_matches(x, '[.!?:;…。！？"''”’»)\]]\s*$'))
        OR (separators >= 2 AND separators > 0.2 * n)
        OR regexp_matches(x, '(?i)^\W*(home|menu|search|login|log in|sign in|sign up|register|next|previous|back|top|contact|about|help|sitemap|share|tweet|print|read more|skip to content|skip to main content)\W*$')
        OR again) AS bad,
        regexp_matches(x, '(?i)javascript|cookie policy|uses cookies|privacy policy|terms of (use|service)|all rights reserved|lorem ipsum|click here|subscribe to our|sign up for our|404 not found|powered by wordpress') AS stock,
        length(translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS chars
    FROM judged
), sentences AS (
    SELECT r, i, unnest(string_split(regexp_replace(regexp_replace(x, '([.!?…])([\x20\x09-\x0D])', '\1' || chr(65535) || '\2', 'g'),
                                                    '([。！？])', '\1' || chr(65535), 'g'), chr(65535))) AS y
    FROM failed WHERE NOT bad AND stock AND n >= 40
), stays AS (
    SELECT r, i, sum(length(translate(y, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))) AS chars
    FROM sentences
    WHERE NOT regexp_matches(y, '(?i)javascript|cookie policy|uses cookies|privacy policy|terms of (use|service)|all rights reserved|lorem ipsum|click here|subscribe to our|sign up for our|404 not found|powered by wordpress')
       OR len(list_filter(string_split_regex(y, '[\x20\x09-\x0D]+'), lambda z: z <> '')) >= 40
    GROUP BY ALL
), by_doc AS (
    SELECT r, sum(CASE WHEN again AND n > 0 THEN 1 ELSE 0 END) AS n_dup_lines, sum(failed.chars) AS word_chars,
           sum(CASE WHEN bad THEN 0 WHEN NOT stock THEN failed.chars ELSE coalesce(stays.chars, 0) END) AS kept_chars
    FROM failed LEFT JOIN stays USING (r, i) GROUP BY r
), base AS (
    SELECT doc_id, len(w) AS n_words, word_chars, kept_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
           n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
    FROM d JOIN by_doc USING (r) LEFT JOIN repeated USING (r)
), verdict AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND 1 - kept_chars / word_chars <= 0.3 AS kept
FROM verdict
"""

DECONTAMINATION = r"""
WITH docs AS (
    SELECT DISTINCT doc_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')),
        '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*)', ' \1 ', 'g'), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w
    FROM documents
), items AS (
    SELECT DISTINCT item_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')),
        '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*)', ' \1 ', 'g'), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS v
    FROM benchmark
), masks(m, least, most, span, kept) AS (
    VALUES (0, 11, 1000000000, 6, [1, 3, 4, 5, 6]), (1, 11, 1000000000, 9, [1, 2, 3, 6, 9]),
           (2, 9, 10, 5, [1, 2, 4, 5]), (3, 9, 10, 7, [1, 2, 4, 7]),
           (4, 5, 8, 4, [1, 2, 3, 4]), (5, 5, 8, 5, [1, 2, 3, 5]), (6, 5, 8, 5, [1, 2, 4, 5]), (7, 5, 8, 5, [1, 3, 4, 5])
), test AS (
    SELECT item_id, v, m, q, list_transform(kept, lambda k: v[q + k]) AS seed
    FROM (SELECT item_id, v, m, kept, unnest(range(0, len(v) - span + 1)) AS q FROM items JOIN masks ON len(v) BETWEEN least AND most)
), training AS (
    SELECT doc_id, w, m, p, list_transform(kept, lambda k: w[p + k]) AS seed
    FROM (SELECT doc_id, w, m, kept, unnest(range(0, len(w) - span + 1)) AS p FROM docs, masks
          WHERE len(w) >= span AND m IN (SELECT m FROM test))
), hits AS (
    SELECT DISTINCT doc_id, item_id, w, v, p - q AS d FROM training JOIN test USING (m, seed)
), compared AS (
    SELECT *, len(v) AS n_item, len(equal) AS n, list_sum(equal)::BIGINT AS n_eq FROM (
        SELECT *, list_transform(list_filter(range(1, len(v) + 1), lambda i: i + d BETWEEN 1 AND len(w)),
                                 lambda i: (w[i + d] = v[i])::INT) AS equal FROM hits)
), whole AS (
    SELECT doc_id, item_id, d, true AS whole, n_eq AS n_same, n AS n_compared FROM compared
    WHERE n >= least(12, n_item) AND n_eq >= 0.8 * n
), others AS (
    SELECT row_number() OVER () AS r, * FROM compared WHERE NOT (n >= least(12, n_item) AND n_eq >= 0.8 * n)
), stretches AS (
    SELECT r, a, z, list_sum(equal[a + 1:z])::BIGINT AS same FROM (
        SELECT r, equal, a, unnest(range(a + 12, n + 1)) AS z FROM (
            SELECT r, equal, n, unnest(range(0, n - 11)) AS a FROM others WHERE n >= 12 AND n_eq >= 9.6))
), stretch AS (
    SELECT r, same, z - a AS n FROM stretches WHERE 5 * same >= 4 * (z - a)
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY 200 * same - 800 * (z - a - same) DESC, z - a DESC) = 1
), lanes AS (
    SELECT r, n_item, list_transform(range(1, n_item + 1), lambda i: coalesce((i + d - 1 BETWEEN 1 AND len(w) AND w[i + d - 1] = v[i])::INT, 0)) AS a,
           list_transform(range(1, n_item + 1), lambda i: coalesce((i + d BETWEEN 1 AND len(w) AND w[i + d] = v[i])::INT, 0)) AS b,
           list_transform(range(1, n_item + 1), lambda i: coalesce((i + d + 1 BETWEEN 1 AND len(w) AND w[i + d + 1] = v[i])::INT, 0)) AS c
    FROM others WHERE n_item < 25 AND r NOT IN (SELECT r FROM stretch)
), turns AS (
    SELECT r, n_item, unnest([greatest(
        coalesce(list_sum(a[1:k]), 0) + coalesce(list_sum(b[k + 1:n_item]), 0) - 1, coalesce(list_sum(b[1:k]), 0) + coalesce(list_sum(c[k + 1:n_item]), 0) - 1,
        coalesce(list_sum(b[1:k]), 0) + coalesce(list_sum(a[k + 1:n_item]), 0), coalesce(list_sum(c[1:k]), 0) + coalesce(list_sum(b[k + 1:n_item]), 0))]) AS same
    FROM (SELECT *, unnest(range(0, n_item + 1)) AS k FROM lanes)
), gap AS (
    SELECT r, max(same)::BIGINT AS same, any_value(n_item) AS n FROM turns GROUP BY r HAVING max(same) >= 0.8 * any_value(n_item)
), good AS (
    SELECT * FROM whole
    UNION ALL SELECT doc_id, item_id, d, false, s.same, s.n FROM others JOIN (SELECT * FROM stretch UNION ALL SELECT * FROM gap) s USING (r)
)
SELECT doc_id, item_id, d::BIGINT AS position, n_same::BIGINT AS n_same, n_compared::BIGINT AS n_compared,
       n_same / n_compared AS same
FROM good
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY whole DESC, n_same DESC, n_compared DESC, d) = 1
"""

SUFFIXES = """
WITH d AS (
    SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents
), strings AS (
    SELECT doc_id, p, array_slice(b, p + 1, p + 100) AS s FROM (SELECT doc_id, b, unnest(range(0, n - 99)) AS p FROM d)
), repeats AS (
    SELECT doc_id, p FROM strings QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, p) > 1
), runs AS (
    SELECT *, sum(CASE WHEN p <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
    FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM repeats)
), spans AS (
    SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM runs GROUP BY doc_id, run
), gaps AS (
    SELECT doc_id, z AS a, lead(a) OVER w AS z FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
    UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id
), kept AS (
    SELECT doc_id, string_agg(substr(hex(b), 2 * a + 1, 2 * (coalesce(z, n) - a)), '' ORDER BY a) AS h
    FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
), sums AS (
    SELECT doc_id, count(*) AS n_spans, sum(z - a) AS removed FROM spans GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(coalesce(unhex(h), b)) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

AUDIT = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), firsts AS (
    SELECT t, min(doc_id) AS first FROM d GROUP BY t
), l AS (
    SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id
), failed AS (
    SELECT part, [CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
                  CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' END,
                  CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first THEN 'E' END] AS f,
           coalesce(good, false)::INT AS good, coalesce(bad, false)::INT AS bad
    FROM d JOIN firsts USING (t) LEFT JOIN l USING (doc_id)
), groups AS (
    SELECT part, list_filter(f, lambda x: x IS NOT NULL) AS f, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM failed GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT o, s, o[s] AS own, string_split(o[1:s - 1], '') AS before FROM orders, range(1, 6) r(s)
), sums AS (
    SELECT part, o, s, own, coalesce(sum(n) FILTER (NOT meets AND NOT earlier), 0) AS kept,
           coalesce(sum(n) FILTER (meets AND NOT earlier), 0) AS removed, coalesce(sum(n) FILTER (meets AND earlier), 0) AS redundant,
           coalesce(sum(n) FILTER (f = [own]), 0) AS unique_fails, coalesce(sum(good) FILTER (meets AND NOT earlier), 0) AS good_lost,
           coalesce(sum(bad) FILTER (meets AND NOT earlier), 0) AS toxic_lost
    FROM (SELECT *, list_contains(f, own) AS meets, list_has_any(f, before) AS earlier FROM groups, steps) GROUP BY ALL
)
SELECT part, o AS filter_order, s::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM sums
"""


def vector_codes(rounds: int = 4) -> str:
    """Plain Lloyd, a full scan for every assignment."""
    def assigned(k: int) -> str:
        return f"""assigned{k} AS MATERIALIZED (
    SELECT r, p, min(d * 256 + e) AS best FROM (
        SELECT r, x.p, e, (list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v))::BIGINT AS d
        FROM parts x JOIN book{k} b ON x.p = b.p) GROUP BY r, p)"""

    def updated(k: int) -> str:
        return f"""book{k + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(u.v, b.v) AS v FROM book{k} b LEFT JOIN (
        SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY j) AS v FROM (
            SELECT p, best % 256 AS e, j, sum(v[j]::BIGINT)::BIGINT AS s, count(*) AS n
            FROM assigned{k} JOIN parts USING (r, p), range(1, 17) t(j) GROUP BY ALL) GROUP BY p, e) u ON b.p = u.p AND b.e = u.e)"""

    steps = ",\n".join(f"{assigned(k)},\n{updated(k)}" for k in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, x, row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r FROM (
        SELECT vec_id, label, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)
), parts AS MATERIALIZED (
    SELECT r, p, x[16 * p + 1:16 * p + 16] AS v FROM kept, range(4) t(p)
), book0 AS (
    SELECT p, r - 1 AS e, v FROM parts WHERE r <= 256
), {steps},
{assigned(rounds)}, coded AS (
    SELECT r, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error
    FROM assigned{rounds} GROUP BY r
), print AS (
    SELECT sha256(string_agg(list_aggregate(list_transform(v, lambda y: y::BIGINT), 'string_agg', ','), ',' ORDER BY p, e)) AS h FROM book{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), print
"""


SQL = {
    "op1_decontamination": DECONTAMINATION,
    "op4_suffix_dedup": SUFFIXES,
    "op5_sharding": SHARDING,
    "op8_quality_rules": QUALITY,
    "op11_filter_audit": AUDIT,
    "op13_vector_codes": vector_codes(),
}
