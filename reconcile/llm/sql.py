"""SQL that gives the rows of the queries which SQL can express."""

LETTERS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A CRC-32 is the exclusive or of what each byte adds, by its distance from the end, and of a number for the length.
# Near words are found by leaving out a letter, which needs no index.
SPELLING = f"""
WITH RECURSIVE eight AS (
  SELECT b, b AS x, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM eight WHERE k < 8),
crc AS MATERIALIZED (SELECT b, x FROM eight WHERE k = 8),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS varchar), '') AS doc_id, unnest(regexp_extract_all(translate(text, '{LETTERS}', '{SMALL}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL),
named AS MATERIALIZED (SELECT row_number() OVER () AS id, *, doc_id || ':' || run AS s FROM runs),
bytes AS MATERIALIZED (
  SELECT id, strlen(s) - pos AS k, b FROM (
    SELECT id, s, unnest(range(1, strlen(s) + 1)) AS pos, unnest([CAST('0x' || h AS int) for h in regexp_extract_all(hex(encode(s)), '..')]) AS b FROM named)),
longest AS (SELECT max(strlen(s)) AS k FROM named),
adds AS (
  SELECT 0 AS k, b, x FROM crc
  UNION ALL SELECT k + 1, adds.b, xor(adds.x >> 8, crc.x) FROM adds JOIN crc ON crc.b = adds.x & 255 WHERE k < (SELECT k FROM longest)),
by_length AS (
  SELECT 0 AS k, 4294967295 AS x
  UNION ALL SELECT k + 1, xor(by_length.x >> 8, crc.x) FROM by_length JOIN crc ON crc.b = by_length.x & 255 WHERE k < (SELECT k FROM longest)),
summed AS (SELECT id, bit_xor(x) AS x FROM bytes JOIN adds USING (k, b) GROUP BY id),
hashed AS (SELECT run, n, xor(xor(summed.x, by_length.x), 4294967295) AS h FROM named JOIN summed USING (id) JOIN by_length ON by_length.k = strlen(s)),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS bigint) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT * FROM (
    SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION ALL SELECT cut.word, words.word, words.n FROM cut JOIN words ON words.word = head || tail
    UNION ALL SELECT words.word, cut.word, cut.n FROM cut JOIN words ON words.word = head || tail)),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * words.n THEN most END AS form_n,
    CASE WHEN most >= 5 * words.n THEN (SELECT min(other) FROM near WHERE near.word = words.word AND other_n = most) END AS form
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NOT NULL)
SELECT formed.word, form, root, n, n_near, form_n FROM formed
JOIN (SELECT chain.word, chain.root FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NULL) USING (word)
"""


def _clusters(rounds: int = 5) -> str:
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, [CAST(floor(256 * CAST(x AS double)) AS bigint) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if isfinite(x)]) = 64)""",
        """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
  FROM (SELECT v, sha256('2:' || CAST(vec_id AS varchar)) AS h FROM kept ORDER BY h, v LIMIT 40))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT id, min(64 * list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(kept.v, c{r}.v)]) + c) AS least FROM kept, c{r} GROUP BY id)""")
        if r < rounds:
            # A floor of exact whole numbers.
            steps.append(f"""sums{r} AS MATERIALIZED (SELECT c, i, sum(x) AS s, count(*) AS n FROM (
    SELECT least % 64 AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept JOIN near{r} USING (id)) GROUP BY c, i)""")
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(m, v) AS v FROM c{r} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS bigint) ORDER BY i) AS m FROM sums{r} GROUP BY c) USING (c))""")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(c AS int) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS bigint) AS cluster_inertia,
  CAST(sum(distance) OVER () AS bigint) AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
FROM (SELECT vec_id, CAST(least % 64 AS bigint) AS c, CAST(least // 64 AS bigint) AS distance FROM kept JOIN near{rounds} USING (id)) JOIN c{rounds} USING (c)"""


CLUSTERS = _clusters()
