"""DuckDB SQL for those corpus queries that SQL can express."""

from __future__ import annotations

from upwell.llm.sharding import fill_table

_REACH = """reach AS (SELECT a AS node, a AS seen FROM link UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.seen),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)"""


def embedding_links(threshold: float) -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= {threshold}),
{_REACH}
SELECT e.vec_id, (SELECT count(*) FROM link WHERE a = e.vec_id) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN comp c ON c.node = e.vec_id"""


def placement(shards: list[str], size: int) -> str:
    names = ", ".join(f"'{shards[i]}'" for i in fill_table(shards, size))
    return f"""WITH t AS (SELECT [{names}] AS owner),
d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {size} AS slot FROM documents)
SELECT doc_id, slot, (SELECT owner FROM t)[slot + 1] AS shard FROM d"""


def near_duplicates(percent: int) -> str:
    """Over two-word shingles."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM w),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM items p JOIN items q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN sets s ON s.doc_id = a JOIN sets t ON t.doc_id = b WHERE 100 * n >= {percent} * (len(s.s) + len(t.s) - n)),
{_REACH}
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN comp c ON c.node = d.doc_id"""


def vector_codes(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Plain Lloyd on integers; every distance is taken."""

    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT r, part, min({{'d': d, 'entry': entry}}) AS best FROM (
  SELECT x.r, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{k} c ON c.part = x.part AND c.i = x.i GROUP BY x.r, x.part, c.entry) GROUP BY r, part)"""

    def moved(k: int) -> str:
        return f"""c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.i, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
  SELECT x.part, a.best.entry AS entry, x.i, ((sum(x.v) - (sum(x.v) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS v
  FROM x JOIN a{k} a ON a.r = x.r AND a.part = x.part GROUP BY ALL) m ON m.part = c.part AND m.entry = c.entry AND m.i = c.i)"""

    steps = ",\n".join(f"{assigned(k)},\n{moved(k)}" for k in range(rounds))
    return f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor(y::DOUBLE * {scale})::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
n AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r, * FROM e),
x AS MATERIALIZED (SELECT r, i // (len(v) // {parts}) AS part, i % (len(v) // {parts}) AS i, v[i + 1] AS v FROM (SELECT r, v, unnest(range(len(v))) AS i FROM n)),
c0 AS MATERIALIZED (SELECT part, r AS entry, i, v FROM x WHERE r < {entries}),
{steps},
{assigned(rounds)},
codes AS (SELECT r, string_agg(lpad(lower(to_hex(best.entry)), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, i)) AS h FROM c{rounds})
SELECT n.vec_id, code, error, (sum(error) OVER (PARTITION BY n.label))::BIGINT AS label_error, (SELECT h FROM book) AS codebooks_sha256 FROM n JOIN codes USING (r)"""


def lexical_search(limit: int) -> str:
    """Scores of all documents, without an index."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, text, unnest({words}) AS term FROM benchmark),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
f AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s GROUP BY term, s.n),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(w)::BIGINT * s.n) // s.l AS m FROM d, s WHERE len(w) > 0),
found AS (SELECT item_id, text, r, any_value(doc_id) AS doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY item_id, text, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM found WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {limit}"""
