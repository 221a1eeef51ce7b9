"""SQL that text queries must equal, where SQL can express them."""

SHARDING = """
WITH hashed AS (
    SELECT doc_id, COALESCE(strlen(text), 0) AS n_bytes,
           CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
    FROM documents
), prefixes AS (
    SELECT doc_id, n_bytes, depth, h >> (60 - depth) AS prefix
    FROM hashed, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS depth)
), shards AS (
    SELECT depth, prefix, CAST(SUM(n_bytes) AS BIGINT) AS shard_bytes, COUNT(*) AS shard_rows
    FROM prefixes GROUP BY depth, prefix HAVING SUM(n_bytes) <= {limit}
)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, depth, prefix, shard_bytes, shard_rows
FROM prefixes JOIN shards USING (depth, prefix)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""

DECONTAMINATION = r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark
), starts AS (
    SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i
    FROM items WHERE len(ws) > 0
), windows AS (
    SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM starts
), places AS (
    SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
    FROM split, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n
), hits AS (
    SELECT DISTINCT p.doc_id, p.i, p.n, w.item_id
    FROM (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM places) p
    JOIN windows w ON p.w = w.w AND p.n = w.n
), covered AS (
    SELECT doc_id, COUNT(DISTINCT pos) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.ws) AS BIGINT) AS n_words, CAST(COALESCE(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(COALESCE(n.n_items, 0) AS BIGINT) AS n_items, sha256(COALESCE(n.items, '')) AS items_sha256,
       c.n_hit IS NOT NULL AS contaminated
FROM split s LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

FILL_IN_MIDDLE = r"""
WITH drawn AS (
    SELECT doc_id, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[A-Za-z]+|[^A-Za-z]') AS ts,
           sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), cuts AS (
    SELECT doc_id, text, ts, CAST(len(ts) AS BIGINT) AS n,
           CAST('0x' || h[1:8] AS BIGINT) % (len(ts) + 1) AS one, CAST('0x' || h[9:16] AS BIGINT) % (len(ts) + 1) AS two,
           CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4
    FROM drawn
), parted AS (
    SELECT *, COALESCE(array_to_string(ts[1:least(one, two)], ''), '') AS p,
           COALESCE(array_to_string(ts[least(one, two) + 1:greatest(one, two)], ''), '') AS m,
           COALESCE(array_to_string(ts[greatest(one, two) + 1:], ''), '') AS s,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain'
                WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM cuts
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parted
"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Plain k-means over the parts of `embeddings`, one step for each round; every number is whole."""
    steps = [f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
    SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v
    FROM kept, (SELECT unnest(range({parts})) AS p)
), c0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS c, v FROM x
    QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries}
)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
    SELECT vec_id, x.p, arg_min(c, (list_inner_product(c{r}.v, c{r}.v) - 2 * list_inner_product(x.v, c{r}.v), c)) AS c
    FROM x JOIN c{r} ON x.p = c{r}.p GROUP BY vec_id, x.p
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
    SELECT c{r}.p, c{r}.c, COALESCE(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
        SELECT p, c, list(mean ORDER BY i) AS v FROM (
            SELECT p, c, i, floor(sum(y) / count(*)) AS mean
            FROM (SELECT a{r}.p, a{r}.c, unnest(x.v) AS y, generate_subscripts(x.v, 1) AS i FROM a{r} JOIN x USING (vec_id, p))
            GROUP BY p, c, i
        ) GROUP BY p, c
    ) m ON m.p = c{r}.p AND m.c = c{r}.c
)""")
    last = rounds
    steps.append(f"""coded AS MATERIALIZED (
    SELECT vec_id, x.label, string_agg(lower(lpad(to_hex(a{last}.c), 2, '0')), '' ORDER BY x.p) AS code,
           CAST(sum(list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c{last}.v) + list_inner_product(c{last}.v, c{last}.v)) AS BIGINT) AS error
    FROM x JOIN a{last} USING (vec_id, p) JOIN c{last} ON c{last}.p = x.p AND c{last}.c = a{last}.c GROUP BY vec_id, x.label
), digest AS (
    SELECT sha256(string_agg(array_to_string(list_transform(v, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, c)) AS codebooks_sha256
    FROM c{last}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest""")
    return steps[0] + ", " + ", ".join(steps[1:-1]) + ", " + steps[-1]


ORACLES: dict[str, str] = {
    "op1_sharding": SHARDING.format(limit=64 << 20),
    "op9_decontamination": DECONTAMINATION,
    "op11_vector_codes": vector_codes(),
    "op13_fill_in_middle": FILL_IN_MIDDLE,
}
