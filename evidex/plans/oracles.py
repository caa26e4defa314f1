"""SQL of the catalog queries over the same tables, for checking results."""

from __future__ import annotations

_SEGMENTS = "['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']"
_TYPES = "['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD']"

_PEOPLE = """people AS (
  SELECT CAST(c_custkey AS VARCHAR) AS person_id, c_custkey, c_name AS full_name,
         n_name || ' ' || c_mktsegment AS location, n_name AS country,
         c_mktsegment AS current_title, c_acctbal / 1000 AS years,
         CAST(20 + floor(abs(c_acctbal) / 200) AS INTEGER) AS age
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

_BOUGHT = """bought AS (
  SELECT CAST(o_custkey AS VARCHAR) AS person_id, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
parts AS (
  SELECT DISTINCT person_id, p_brand, p_type FROM bought JOIN part ON l_partkey = p_partkey),
worked AS (SELECT DISTINCT person_id, CAST(l_suppkey AS VARCHAR) AS company FROM bought),
projects AS (
  SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS person_id, o_orderpriority AS project FROM orders)"""

_SKILLED = f"""skilled AS (
  SELECT 'q' || n_nationkey AS query_id, n_nationkey AS k,
         'Brand#' || (n_nationkey % 25 + 1) AS b1,
         'Brand#' || ((n_nationkey + 7) % 25 + 1) AS b2,
         list_extract({_TYPES}, n_nationkey % 6 + 1) AS ty,
         list_extract({_SEGMENTS}, n_nationkey % 5 + 1) AS seg,
         CASE WHEN n_nationkey > 12 THEN 2.5 END AS min_years
  FROM nation),
pairs AS (
  SELECT s.query_id, p.person_id, p.full_name, p.years, s.min_years
  FROM skilled s JOIN people p ON p.current_title = s.seg
  WHERE (s.min_years IS NULL OR p.years >= s.min_years)
    AND EXISTS (SELECT 1 FROM parts t WHERE t.person_id = p.person_id AND t.p_brand = s.b1)
    AND EXISTS (SELECT 1 FROM parts t WHERE t.person_id = p.person_id AND t.p_brand = s.b2)
    AND EXISTS (SELECT 1 FROM parts t WHERE t.person_id = p.person_id AND t.p_type = s.ty))"""

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _clean(text: str) -> str:
    """Raw-text normalisation of a SQL expression."""
    unix = f"replace({text}, chr(13) || chr(10), chr(10))"
    return f"trim(regexp_replace({unix}, '[^\\S\\n]+(\\n|$)', '\\1', 'g'), {_WS})"


def _norm(text: str) -> str:
    """Name normalisation of a SQL expression."""
    folded = f"replace(replace(replace(replace(lower({text}), '.net', 'dotnet'), 'c#', 'csharp'), 'c++', 'cpp'), '&', ' and ')"
    return f"trim(regexp_replace({folded}, '[\\p{{P}}\\p{{S}}\\s]+', ' ', 'g'))"


_SNAPSHOT = f"""stored AS (
  SELECT sha256({_clean('text')}) AS cs, min(doc_id) AS doc_id
  FROM documents JOIN labels USING (doc_id) GROUP BY 1),
batch AS (
  SELECT d.doc_id, sha256(CASE WHEN toxic = 1 THEN {_clean("text || chr(10) || 'edited'")}
                          ELSE {_clean('text')} END) AS cs
  FROM documents d LEFT JOIN labels l USING (doc_id)),
owners AS (
  SELECT b.cs, coalesce(any_value(s.doc_id), min(b.doc_id)) AS owner
  FROM batch b LEFT JOIN stored s USING (cs) GROUP BY b.cs),
outcomes AS (
  SELECT b.doc_id, b.cs AS checksum,
         CASE WHEN o.owner <> b.doc_id THEN 'duplicate' WHEN s.cs = b.cs THEN 'unchanged'
              WHEN s.doc_id IS NULL THEN 'created' ELSE 'updated' END AS outcome
  FROM batch b JOIN owners o USING (cs) LEFT JOIN stored s ON s.doc_id = b.doc_id)"""

_CENTROIDS = """spread AS (
  SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings),
means AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM spread GROUP BY ALL),
centroids AS (SELECT CAST(label AS VARCHAR) AS query_id, list(x ORDER BY pos) AS v FROM means GROUP BY label),
scored AS (
  SELECT query_id, CAST(vec_id AS VARCHAR) AS vector_id, CAST(label AS VARCHAR) AS person_id, label,
         list_cosine_similarity(v, CAST(embedding AS DOUBLE[])) AS s
  FROM centroids, embeddings)"""

_WORDS = r"""words AS (
  SELECT doc_id, unnest(list_distinct(list_filter(
           regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''))) AS w
  FROM documents),
own AS (SELECT doc_id, list_sort(list(w)) AS ws FROM words GROUP BY doc_id),
keyed AS (SELECT doc_id, ws, sha256(array_to_string(ws, chr(31))) AS set_id FROM own)"""

_INFERRED = """st AS (
  SELECT source AS person_id, CAST(doc_id AS VARCHAR) AS claim,
         CASE WHEN quality = 0 THEN 'rejected' WHEN toxic = 1 THEN 'reviewed' ELSE 'unverified' END AS status
  FROM labels JOIN documents USING (doc_id)),
pr AS (SELECT source AS person_id, CAST(doc_id AS VARCHAR) AS claim FROM documents WHERE lang <> 'fr')"""

_CHECKED = """checked AS (
  SELECT lang AS query_id, doc_id AS claim_no,
         CASE WHEN source = 'src9' THEN 'stranger' ELSE source END AS candidate_id,
         CASE WHEN source = 'src9' THEN 'unknown candidate' WHEN source = 'src8' THEN 'no evidence'
              WHEN source = 'src7' THEN 'unknown evidence'
              WHEN quality = 1 AND toxic = 1 THEN 'fact without confidence 1'
              WHEN quality <> 1 AND source <= 'src4' THEN 'inference without reason' END AS violation
  FROM labels JOIN documents USING (doc_id))"""

_GOOD = f"""{_PEOPLE},
good AS (SELECT * FROM people WHERE age > 24 AND years >= 0)"""

_DELIVERED = """c AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, n_name, c_mktsegment AS seg, c_nationkey % 2 = 1 AS odd,
         CAST(floor(c_acctbal / 1000) AS INTEGER) AS years, c_acctbal > 2000 AS early,
         c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY') AS changed
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
good AS (
  SELECT *, CASE WHEN seg IN ('BUILDING', 'FURNITURE') THEN 'Lead ' ELSE '' END || seg AS title
  FROM c WHERE years >= 0)"""

_TEAM = f"""RECURSIVE {_BOUGHT},
customers AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS request_id, c_mktsegment AS role,
         CAST(c_custkey AS VARCHAR) AS person_id, greatest(0, c_acctbal / 10000) AS score FROM customer),
slots AS (
  SELECT request_id, role, slot, row_number() OVER (PARTITION BY request_id ORDER BY role, slot) AS step
  FROM (SELECT DISTINCT request_id, role FROM customers), (VALUES (1), (2)) AS t(slot)),
held AS (
  SELECT person_id, list(DISTINCT term) AS terms
  FROM (SELECT person_id, p_brand AS term FROM parts UNION ALL SELECT person_id, p_type FROM parts) GROUP BY 1),
best AS (
  SELECT request_id, role, person_id, score, coalesce(terms, []) AS terms
  FROM customers LEFT JOIN held USING (person_id)
  QUALIFY row_number() OVER (PARTITION BY request_id, role ORDER BY score DESC, person_id) <= 20),
team AS (
  SELECT DISTINCT request_id, CAST(0 AS BIGINT) AS step, CAST(NULL AS VARCHAR) AS role, 0 AS slot,
         CAST(NULL AS VARCHAR) AS person_id, CAST(NULL AS DOUBLE) AS selection_score,
         CAST([] AS VARCHAR[]) AS taken, CAST([] AS VARCHAR[]) AS covered
  FROM customers
  UNION ALL
  SELECT request_id, step, role, slot, person_id, value, list_append(taken, person_id),
         list_distinct(list_concat(covered, coalesce(terms, [])))
  FROM (SELECT t.request_id, s.step, s.role, s.slot, b.person_id, b.score, b.terms, t.taken, t.covered,
               CASE WHEN b.person_id IS NOT NULL THEN greatest(0, b.score - 0.15 * CASE WHEN len(b.terms) + len(t.covered) = 0 THEN 0
                 ELSE CAST(len(list_intersect(b.terms, t.covered)) AS DOUBLE)
                      / len(list_distinct(list_concat(b.terms, t.covered))) END) END AS value
        FROM team t JOIN slots s ON s.request_id = t.request_id AND s.step = t.step + 1
        LEFT JOIN best b ON b.request_id = s.request_id AND b.role = s.role
                        AND NOT list_contains(t.taken, b.person_id))
  QUALIFY row_number() OVER (PARTITION BY request_id
            ORDER BY value DESC NULLS LAST, score DESC NULLS LAST, person_id DESC NULLS LAST) = 1)"""


def _greedy(tokens: str, limit: str) -> str:
    """Tokens joined with blanks up to a limit; a token that is not open stands on its own."""
    joined = "a.items[-1] || ' ' || x.items[1]"
    return f"""list_reduce({tokens}, lambda a, x:
  CASE WHEN a.open AND x.open AND length({joined}) <= {limit}
       THEN {{'items': list_append(list_slice(a.items, 1, len(a.items) - 1), {joined}), 'open': true}}
       ELSE {{'items': list_concat(a.items, x.items), 'open': x.open}} END).items"""


ORACLES: dict[str, str] = {
    "structured_all_of": f"WITH {_PEOPLE}, {_BOUGHT}, {_SKILLED} SELECT query_id, person_id FROM pairs",
    "structured_companies": f"""WITH {_BOUGHT},
q AS (SELECT 'q' || n_nationkey AS query_id, CAST(n_nationkey % 25 AS VARCHAR) AS c1,
             CAST(n_nationkey % 25 + 3 AS VARCHAR) AS c2 FROM nation),
found AS (
  SELECT query_id, a.person_id FROM q JOIN worked a ON a.company = c1
  WHERE EXISTS (SELECT 1 FROM worked b WHERE b.person_id = a.person_id AND b.company = c2)
    AND EXISTS (SELECT 1 FROM projects p WHERE p.person_id = a.person_id AND project = '1-URGENT')
    AND EXISTS (SELECT 1 FROM projects p WHERE p.person_id = a.person_id AND project = '5-LOW'))
SELECT query_id, person_id FROM found
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY person_id) <= 100""",
    "structured_scalar": f"""WITH {_PEOPLE}
SELECT 'q' || n_nationkey AS query_id, person_id FROM nation, people
WHERE (n_regionkey >= 3 OR country = n_name) AND years >= n_nationkey % 7
  AND age >= 25 AND age <= 40 + n_nationkey""",
    "city_terms": f"""WITH {_PEOPLE}
SELECT 'q' || n_nationkey AS query_id, person_id FROM nation, people
WHERE contains(location, n_name) OR contains(location, 'N_' || (n_nationkey % 25 + 1) || ' BUI')""",
    "profile_lists": f"""WITH {_PEOPLE}, {_BOUGHT},
b AS (SELECT person_id, string_agg(p_brand, ',' ORDER BY p_brand) AS skills
      FROM (SELECT DISTINCT person_id, p_brand FROM parts) GROUP BY 1),
t AS (SELECT person_id, string_agg(p_type, ',' ORDER BY p_type) AS technologies
      FROM (SELECT DISTINCT person_id, p_type FROM parts) GROUP BY 1),
p AS (SELECT person_id, string_agg(project, ',' ORDER BY project) AS projects FROM projects GROUP BY 1),
c AS (SELECT person_id, count(*) AS n_companies FROM worked GROUP BY 1)
SELECT person_id, coalesce(skills, '') AS skills, coalesce(technologies, '') AS technologies,
       current_title AS domains, coalesce(projects, '') AS projects,
       coalesce(n_companies, 0) AS n_companies
FROM people LEFT JOIN b USING (person_id) LEFT JOIN t USING (person_id)
LEFT JOIN p USING (person_id) LEFT JOIN c USING (person_id)""",
    "first_evidence": """SELECT source AS person_id,
       row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position,
       CAST(doc_id AS VARCHAR) AS chunk_id, 'structured' AS source, CAST(1 AS DOUBLE) AS score
FROM documents QUALIFY position <= 5""",
    "vocabulary": f"""WITH {_PEOPLE},
v AS (SELECT DISTINCT 'city' AS kind, location AS value FROM people
  UNION ALL SELECT DISTINCT 'country', country FROM people
  UNION ALL SELECT DISTINCT 'company', s_name FROM supplier
  UNION ALL SELECT DISTINCT 'skill', p_brand FROM part
  UNION ALL SELECT DISTINCT 'technology', p_name FROM part
  UNION ALL SELECT DISTINCT 'domain', current_title FROM people)
SELECT kind, value FROM v WHERE value IS NOT NULL""",
    "candidate_detail": """WITH wanted AS (
  SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
profile AS (SELECT source, count(*) AS n, min(lang) AS l FROM documents GROUP BY 1),
shown AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position
          FROM documents WHERE source IN (SELECT source FROM wanted) QUALIFY position <= 5)
SELECT source AS person_id, n AS n_documents, l AS first_lang, position,
       CAST(doc_id AS VARCHAR) AS chunk_id
FROM shown JOIN profile USING (source)""",
    "normalize_names": f"""WITH names AS (
  SELECT DISTINCT p_name || ' & ' || p_brand || ' (C++)' AS name FROM part
  UNION SELECT s_name FROM supplier)
SELECT name, {_norm('name')} AS key, {_norm('name')} AS canonical FROM names""",
    "normalize_documents": f"""SELECT doc_id,
  CAST(CASE WHEN {_norm('text')} = '' THEN 0 ELSE len(string_split({_norm('text')}, ' ')) END AS BIGINT) AS n_words
FROM documents""",
    "json_fields": """SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k,
  '{"k":' || (props ->> '$.k') || '}' AS raw_text FROM events""",
    "jsonl_records": """SELECT event_id AS seq, 'json:events.jsonl' AS source,
  'checksum:' || sha256('{"k":' || (props ->> '$.k') || '}') AS external_id, 'json' AS document_type
FROM events""",
    "page_documents": f"""SELECT page_id || '.html' AS file, 'text:' || page_id || '.html' AS source,
  'checksum:' || sha256(trim(html, {_WS})) AS external_id, length(trim(html, {_WS})) AS n_chars
FROM pages WHERE trim(html, {_WS}) <> ''""",
    "parse_customers": f"""WITH {_PEOPLE},
judged AS (SELECT *, CASE WHEN age <= 24 THEN 'ValueError' WHEN years < 0 THEN 'ValidationError'
                     ELSE 'ok' END AS outcome FROM people)
SELECT person_id AS external_id, outcome,
  CASE WHEN outcome = 'ok' THEN full_name END AS full_name,
  CASE WHEN outcome = 'ok' THEN current_title || ',' || lower(country) END AS skills,
  CASE WHEN outcome = 'ok' THEN current_title || ',AWS' END AS technologies,
  CASE WHEN outcome = 'ok' THEN country || '/' || current_title END AS job,
  CASE WHEN outcome = 'ok' THEN round(years, 5) END AS years
FROM judged""",
    "list_split": """SELECT p_partkey, p_name || '/' || p_brand || '/' || lower(p_type) AS items,
  CAST(3 AS BIGINT) AS n_items FROM part""",
    "unsafe_quarantine": """SELECT CAST(doc_id AS VARCHAR) AS external_id, 'ValueError' AS error_type,
  CASE WHEN length(text) > 20000
       THEN 'Resume text exceeds input limit (' || length(text) || ' > 20000)'
       ELSE 'Document was rejected: it contains prompt-injection-like instructions' END AS message
FROM documents
WHERE length(text) > 20000 OR contains(lower(text), 'license') OR contains(lower(text), 'password')
   OR contains(lower(text), 'der die')""",
    "checksum_dedup": f"""SELECT sha256({_clean('text')}) AS checksum, min(doc_id) AS doc_id, count(*) AS copies
FROM documents GROUP BY 1""",
    "ingest_outcomes": f"WITH {_SNAPSHOT} SELECT * FROM outcomes",
    "ingest_report": f"""WITH {_SNAPSHOT},
bad AS (SELECT count(*) AS n FROM events WHERE event_type = 'error')
SELECT count(*) + any_value(n) AS total, count(*) FILTER (outcome = 'created') AS created,
  count(*) FILTER (outcome = 'updated') AS updated,
  count(*) FILTER (outcome = 'unchanged') AS unchanged,
  count(*) FILTER (outcome = 'duplicate') AS duplicates,
  count(*) FILTER (outcome IN ('unchanged', 'duplicate')) AS skipped, any_value(n) AS failed
FROM outcomes, bad""",
    "delivery_outcomes": """WITH labelled AS (SELECT doc_id, toxic FROM documents JOIN labels USING (doc_id))
SELECT CAST(0 AS BIGINT) AS delivery, 'crawl' AS source, doc_id, 'created' AS outcome FROM labelled
UNION ALL
SELECT 1, 'crawl', d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'created' WHEN toxic = 1 THEN 'updated' ELSE 'unchanged' END
FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL
SELECT 2, 'mirror', doc_id, CASE WHEN toxic = 1 THEN 'created' ELSE 'duplicate' END FROM labelled""",
    "corpus_merge": """WITH n AS (
  SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN urgent > 0 THEN c_name || ' (' || urgent || ')' ELSE c_name END AS c_name,
       c_acctbal, c_mktsegment
FROM customer JOIN n ON c_custkey = o_custkey""",
    "resolve_persons": """WITH sup AS (
  SELECT s_suppkey AS key, abs(floor(s_acctbal / 100)) || '|' || s_nationkey AS ident FROM supplier),
cus AS (SELECT c_custkey AS key, abs(floor(c_acctbal / 100)) || '|' || c_nationkey AS ident FROM customer),
holders AS (SELECT ident, count(*) AS n, min(key) AS holder FROM sup GROUP BY 1),
founders AS (SELECT ident, min(key) AS founder FROM cus GROUP BY 1)
SELECT 'supplier' AS source, CAST(key AS VARCHAR) AS external_id,
       sha256(concat_ws(chr(31), 'person', 'supplier', CAST(key AS VARCHAR))) AS person_id FROM sup
UNION ALL
SELECT 'customer', CAST(key AS VARCHAR), sha256(CASE
   WHEN n = 1 THEN concat_ws(chr(31), 'person', 'supplier', CAST(holder AS VARCHAR))
   WHEN n IS NULL THEN concat_ws(chr(31), 'person', 'customer', CAST(founder AS VARCHAR))
   ELSE concat_ws(chr(31), 'person', 'customer', CAST(key AS VARCHAR)) END)
FROM cus JOIN founders USING (ident) LEFT JOIN holders USING (ident)""",
    "scalar_merge": """SELECT CAST(user_id AS VARCHAR) AS person_id,
  arg_max(event_type, event_id) AS full_name,
  arg_max(props, event_id) FILTER (event_type = 'click' AND props IS NOT NULL) AS location,
  arg_max(props, event_id) FILTER (event_type = 'view' AND props IS NOT NULL) AS current_title,
  arg_max(value, event_id) FILTER (event_type = 'purchase' AND value IS NOT NULL) AS years_experience,
  CAST(max(event_id) FILTER (event_type = 'signup') AS INTEGER) AS age
FROM events GROUP BY user_id""",
    "entity_first_wins": """WITH m AS (
  SELECT lower(p_name) AS normalized_name, p_partkey,
         CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS spelled FROM part),
known AS (SELECT DISTINCT lower(p_name) AS normalized_name FROM part WHERE p_type = 'PROMO' AND p_size = 7)
SELECT sha256(concat_ws(chr(31), 'technology', normalized_name)) AS technology_id,
       CASE WHEN normalized_name IN (SELECT normalized_name FROM known) THEN 'Known ' || normalized_name
            ELSE arg_min(spelled, p_partkey) END AS name, normalized_name
FROM m GROUP BY normalized_name""",
    "entity_bridges": f"""WITH {_GOOD}
SELECT person_id, 'skill' AS kind, lower(current_title) AS entity FROM good
UNION ALL SELECT person_id, 'skill', replace(lower(country), '_', ' ') FROM good
UNION ALL SELECT person_id, 'technology', lower(current_title) FROM good
UNION ALL SELECT person_id, 'technology', 'amazon web services' FROM good
UNION ALL SELECT DISTINCT replace(lower(country), '_', ' '), 'company_domain', lower(current_title) FROM good""",
    "chunk_sections": f"""WITH {_GOOD}
SELECT person_id AS document_id, 0 AS ordinal, 'summary' AS section,
  'SUMMARY' || chr(10) || chr(10) || 'Candidate: ' || full_name || chr(10) || chr(10) ||
  'Current title: ' || current_title || chr(10) || chr(10) || 'Country: ' || country || chr(10) ||
  chr(10) || 'Years of experience: ' || CAST(CAST(years AS DECIMAL(10,5)) AS DOUBLE) || chr(10) || chr(10) || 'Age: ' || age AS content
FROM good
UNION ALL SELECT person_id, 1, 'experience',
  'EXPERIENCE: ' || country || chr(10) || chr(10) || 'Domains: ' || current_title FROM good
UNION ALL SELECT person_id, 2, 'skills',
  'SKILLS AND EXPERTISE' || chr(10) || chr(10) || 'Skills: ' || current_title || ', ' || lower(country) ||
  chr(10) || chr(10) || 'Technologies: ' || current_title || ', AWS' FROM good""",
    "chunk_stale": """SELECT CAST(d.doc_id AS VARCHAR) AS document_id,
  CASE WHEN l.doc_id IS NULL THEN 'created' WHEN quality = 1 AND toxic <> 1 THEN 'unchanged'
       ELSE 'updated' END AS state
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "chunk_upsert": """WITH pieces AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS ordinal, unnest(ls) AS line FROM pieces)
SELECT CAST(doc_id AS VARCHAR) AS document_id, ordinal,
  CASE WHEN toxic = 1 THEN 'new' ELSE sha256(line) END AS content_checksum
FROM lines LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) <> 1 OR ordinal < 2""",
    "vector_validate": """SELECT vec_id, label, label NOT IN (3, 4) AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS valid FROM embeddings""",
    "cosine_top": f"""WITH {_CENTROIDS}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vector_id) AS position,
       vector_id, round(greatest(0, least(1, s)), 6) AS score
FROM scored QUALIFY position <= 20""",
    "ann_top": f"""WITH {_CENTROIDS}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vector_id) AS position,
       vector_id, round(greatest(0, least(1, s)), 6) AS score
FROM scored QUALIFY position <= 20""",
    "ann_recall": """SELECT count(*) FILTER (vec_id % 50 = 0) AS n_queries, count(*) AS n_indexed, true AS recall_reached
FROM embeddings""",
    "cosine_filtered": f"""WITH {_CENTROIDS}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vector_id) AS position,
       vector_id, round(greatest(0, least(1, s)), 6) AS score
FROM scored
WHERE query_id <> '7' AND label - CAST(query_id AS INTEGER) IN (0, 1, 4)
QUALIFY position <= 20""",
    "graph_edges": f"""WITH {_BOUGHT}
SELECT 'Person' AS src_type, person_id AS src, 'WORKED_AT' AS rel, 'Company' AS dst_type,
       company AS dst, person_id AS evidence_person FROM worked
UNION ALL SELECT 'Person', CAST(c_custkey AS VARCHAR), 'SPECIALIZES_IN', 'Domain', c_mktsegment,
       CAST(c_custkey AS VARCHAR) FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'Person', person_id, 'WORKED_ON', 'Project', project, person_id FROM projects
UNION ALL SELECT 'Company', company, 'OPERATES_IN', 'Domain', any_value(n_name), max(person_id)
FROM worked JOIN supplier ON company = CAST(s_suppkey AS VARCHAR)
JOIN nation ON s_nationkey = n_nationkey GROUP BY company""",
    "graph_search": f"""WITH {_BOUGHT},
q AS (SELECT 'q' || n_nationkey AS query_id, CAST(n_nationkey % 25 + 2 AS VARCHAR) AS company, n_nationkey AS home
      FROM nation),
reach AS (SELECT DISTINCT person_id, s_nationkey AS home FROM worked
          JOIN supplier ON company = CAST(s_suppkey AS VARCHAR))
SELECT query_id, w.person_id FROM q JOIN worked w USING (company)
JOIN projects p ON p.person_id = w.person_id AND project = '1-URGENT'
JOIN reach r ON r.person_id = w.person_id AND r.home = q.home""",
    "graph_paths": f"""WITH {_PEOPLE},
e AS (SELECT person_id, full_name, current_title AS hub, 'SPECIALIZES_IN' AS rel,
             sha256(concat_ws(chr(31), 'edge', 'SPECIALIZES_IN', person_id, current_title)) AS edge FROM people
      UNION ALL SELECT person_id, full_name, country, 'STUDIED_AT',
             sha256(concat_ws(chr(31), 'edge', 'STUDIED_AT', person_id, country)) FROM people),
p AS (SELECT person_id, 1 AS hops, full_name || ' → ' || hub AS claim, rel AS relationships,
             hub AS n1, edge AS e1, '' AS n2, '' AS e2 FROM e
      UNION ALL
      SELECT a.person_id, 2, a.full_name || ' → ' || a.hub || ' → ' || b.full_name,
             a.rel || ',' || b.rel, a.hub, a.edge, b.full_name, b.edge
      FROM e a JOIN e b ON a.hub = b.hub AND a.rel = b.rel AND a.edge <> b.edge)
SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY hops, n1, e1, n2, e2) AS position,
       CAST(hops AS BIGINT) AS hops, claim, relationships, round(1.0 / hops, 6) AS score
FROM p QUALIFY position <= 10""",
    "graph_relevant": f"""WITH {_PEOPLE},
pool AS (SELECT r_name AS query_id, 'NATION_1' || r_regionkey AS target, person_id, country, current_title
         FROM people JOIN nation ON country = n_name JOIN region ON n_regionkey = r_regionkey),
near AS (SELECT DISTINCT country AS target, current_title FROM people)
SELECT query_id, person_id, CAST(CASE WHEN country = target THEN 1 ELSE 3 END AS BIGINT) AS hops,
       round(CASE WHEN country = target THEN 1.0 ELSE 1.0 / 3 END, 6) AS score
FROM pool WHERE country = target
   OR EXISTS (SELECT 1 FROM near n WHERE n.target = pool.target AND n.current_title = pool.current_title)""",
    "graph_relevant_lengths": f"""WITH {_PEOPLE},
pool AS (SELECT r_name AS query_id, 'NATION_1' || r_regionkey AS target, person_id, country, current_title
         FROM people JOIN nation ON country = n_name JOIN region ON n_regionkey = r_regionkey),
found AS (
  SELECT query_id, person_id, 1 AS hops FROM pool WHERE country = target
  UNION ALL
  SELECT query_id, person_id, 3 FROM pool
  WHERE EXISTS (SELECT 1 FROM people o WHERE o.country = pool.target
                AND o.current_title = pool.current_title AND o.person_id <> pool.person_id))
SELECT query_id, person_id, CAST(hops AS BIGINT) AS hops, round(1.0 / hops, 6) AS score FROM found""",
    "hybrid_pool": """WITH own AS (
  SELECT 'q' || c_nationkey AS query_id, CAST(c_custkey AS VARCHAR) AS person_id, c_acctbal, c_mktsegment,
         n_regionkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
                              AND o_orderpriority = '1-URGENT') AS urgent
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
vec AS (SELECT query_id, person_id FROM own
        WHERE c_mktsegment = 'BUILDING' AND query_id NOT IN ('q4', 'q24') AND n_regionkey >= 3)
SELECT query_id, person_id FROM own
WHERE n_regionkey < 3 AND c_acctbal > 4000 AND (n_regionkey <> 1 OR urgent)
UNION ALL SELECT query_id, person_id FROM vec
UNION ALL SELECT query_id, person_id FROM own WHERE n_regionkey >= 3 AND c_acctbal > 4000
  AND query_id NOT IN (SELECT query_id FROM vec)""",
    "composite_rank": f"""WITH {_PEOPLE}, {_BOUGHT}, {_SKILLED},
spent AS (SELECT CAST(o_custkey AS VARCHAR) AS person_id, count(*) AS n,
                 bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1),
f AS (SELECT query_id, person_id, full_name, least(1.0, n / 20) AS semantic,
             CAST(1 AS DOUBLE) AS skills, CAST(1 AS DOUBLE) AS domains,
             CASE WHEN min_years IS NULL THEN 0.5 ELSE (0.5 + least(years / min_years, 1)) / 2 END AS experience,
             CASE WHEN urgent THEN 0.5 ELSE 0 END AS graph, CAST(0 AS DOUBLE) AS location,
             CAST(0.5 AS DOUBLE) AS preference
      FROM pairs JOIN spent USING (person_id)),
s AS (SELECT *, semantic * 0.3 + skills * 0.25 + domains * 0.15 + experience * 0.1 + graph * 0.1
             + location * 0.05 + preference * 0.05 AS score FROM f)
SELECT query_id, row_number() OVER (PARTITION BY query_id
         ORDER BY round(score, 9) DESC, lower(full_name), person_id) AS position, person_id,
       round(semantic, 6) AS semantic, skills, domains, round(experience, 6) AS experience,
       CAST(graph AS DOUBLE) AS graph, location, preference, round(score, 6) AS score
FROM s QUALIFY position <= 20""",
    "rerank_contract": """WITH ranked AS (
  SELECT c_mktsegment AS query_id, CAST(c_custkey AS VARCHAR) AS person_id,
         row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, CAST(c_custkey AS VARCHAR)) AS position
  FROM customer QUALIFY position <= 50),
proposed AS (SELECT CAST(o_custkey AS VARCHAR) AS person_id, min(o_orderkey) AS place
             FROM orders GROUP BY 1)
SELECT query_id, person_id, position, row_number() OVER (PARTITION BY query_id ORDER BY position > 20,
         CASE WHEN position <= 20 THEN place END ASC NULLS LAST, position) AS rerank_position
FROM ranked LEFT JOIN proposed USING (person_id)""",
    "reasons": f"""WITH needles AS (
  SELECT 'Evidence mentions required skill or technology: the' AS claim, 'the' AS needle
  UNION ALL SELECT 'Evidence mentions required skill or technology: der die', 'der die'
  UNION ALL SELECT 'Evidence mentions required skill or technology: License!', 'license'
  UNION ALL SELECT 'Evidence mentions required domain: les', 'les'),
d AS (SELECT lang, source, doc_id, {_norm('text')} AS t FROM documents)
SELECT lang AS query_id, source AS person_id, claim, CAST(doc_id AS VARCHAR) AS chunk_id
FROM d, needles WHERE contains(t, needle)""",
    "ngrams_contains": f"""WITH n AS (
  SELECT concat_ws('-', conv_id, turn) AS query_id, {_norm('text')} AS t FROM conversations),
w AS (SELECT query_id, t, list_filter(string_split(t, ' '), lambda x: x <> '') AS ws FROM n),
g AS (SELECT query_id, t, ws,
        list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
          list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS ps
      FROM w)
SELECT query_id, CAST(len(list_distinct(ps)) AS BIGINT) AS n_phrases,
       contains(' ' || t || ' ', ' ai ') AS has_ai, contains(' ' || t, ' than') AS has_than,
       contains(' ' || t || ' ', ' of the ') AS has_of_the
FROM g""",
    "enrich_queries": f"""WITH n AS (
  SELECT concat_ws('-', conv_id, turn) AS query_id, text, ' ' || {_norm('text')} || ' ' AS t
  FROM conversations),
f AS (SELECT *, contains(t, ' ai ') AS ai, contains(t, ' ml ') AS ml FROM n)
SELECT query_id, text || CASE WHEN ai AND ml THEN ' machine learning ml llm mlops ml engineer'
       WHEN ai THEN ' machine learning ml llm mlops' WHEN ml THEN ' machine learning ml engineer mlops'
       ELSE '' END AS semantic_query,
       CASE WHEN ai OR ml THEN 'Machine Learning,MLOps' ELSE '' END AS preferred, '' AS skills,
       CAST(NULL AS VARCHAR) AS city, CAST(NULL AS INTEGER) AS min_age, CAST(NULL AS INTEGER) AS max_age
FROM f""",
    "expertise": f"""WITH d AS (
  SELECT source, doc_id, {_norm('text')} AS t,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents QUALIFY n <= 5),
w AS (SELECT unnest(['the', 'der', 'les', 'que']) AS domain)
SELECT source AS person_id, 'Likely has sustained expertise in ' || domain AS claim,
       CAST(round(least(0.55 + count(*) * 0.08, 0.87), 6) AS DOUBLE) AS confidence,
       string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS evidence, 'unverified' AS status
FROM d, w WHERE contains(t, domain) GROUP BY source, domain HAVING count(*) >= 2""",
    "jaccard_pairs": f"""WITH {_WORDS},
sets AS (SELECT set_id, any_value(ws) AS ws FROM keyed GROUP BY 1),
sw AS (SELECT set_id, len(ws) AS n, unnest(ws) AS w FROM sets),
c AS (SELECT a.set_id AS set_a, b.set_id AS set_b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS s
      FROM sw a JOIN sw b ON a.w = b.w AND a.set_id < b.set_id GROUP BY 1, 2)
SELECT set_a, set_b, round(s, 6) AS similarity FROM c WHERE s >= 0.5""",
    "similar_members": f"""WITH {_WORDS}
SELECT CAST(doc_id AS VARCHAR) AS person_id, set_id, count(*) OVER (PARTITION BY set_id) AS n_members FROM keyed""",
    "shared_company": f"""WITH {_BOUGHT}, s AS (
  SELECT company, person_id, count(*) OVER (PARTITION BY company) - 1 AS n_peers FROM worked)
SELECT * FROM s WHERE n_peers > 0""",
    "inference_sync": f"""WITH {_INFERRED}
SELECT person_id, claim, CAST(CASE WHEN st.status IN ('rejected', 'reviewed') THEN 0.5 ELSE 0.8 END AS DOUBLE) AS confidence,
       CASE WHEN st.status IN ('rejected', 'reviewed') THEN st.status ELSE 'unverified' END AS status
FROM st FULL JOIN pr USING (person_id, claim)
WHERE st.status IN ('rejected', 'reviewed') OR (person_id, claim) IN (SELECT (person_id, claim) FROM pr)""",
    "inference_upsert": f"""WITH {_INFERRED}
SELECT person_id, claim, CAST(0.8 AS DOUBLE) AS confidence, 'unverified' AS status FROM pr
UNION ALL SELECT person_id, claim, 0.5, status FROM st ANTI JOIN pr USING (person_id, claim)""",
    "claim_check": f"""WITH {_CHECKED}
SELECT query_id, claim_no, candidate_id, violation IS NULL AS accepted, violation FROM checked""",
    "answers_accepted": f"""WITH {_CHECKED}
SELECT query_id, bool_and(violation IS NULL) AS accepted, count(*) AS n_claims FROM checked GROUP BY 1""",
    "answer_evidence": """SELECT lang AS query_id, source AS person_id,
  row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rank,
  CAST(doc_id AS VARCHAR) AS chunk_id, 'structured' AS source
FROM documents QUALIFY rank <= 12""",
    "profile_export": f"""WITH {_PEOPLE}, {_BOUGHT},
b AS (SELECT person_id, string_agg(p_brand, ', ' ORDER BY p_brand) AS skills
      FROM (SELECT DISTINCT person_id, p_brand FROM parts) GROUP BY 1)
SELECT person_id, 'Profile' AS label, CASE WHEN age > 40 THEN 'Works in ' || current_title
       ELSE 'No summary provided.' END AS value FROM people
UNION ALL SELECT person_id, 'Location', location || ', ' || country FROM people
UNION ALL SELECT person_id, 'Experience', CAST(floor(years) AS BIGINT) || ' years' FROM people WHERE floor(years) <> 0
UNION ALL SELECT person_id, 'Age', age || ' years' FROM people
UNION ALL SELECT person_id, 'Skills', skills FROM b
UNION ALL SELECT person_id, 'Domains', current_title FROM people""",
    "chunk_pack": f"""WITH lines AS (
  SELECT doc_id, 'DOCUMENT: ' || doc_id AS header, 598 - length('DOCUMENT: ' || doc_id) AS lim,
         list_filter(list_transform(string_split(text, chr(10)), lambda b: trim(b, {_WS})), lambda b: b <> '') AS blocks
  FROM documents WHERE text IS NOT NULL),
blocks AS (
  SELECT doc_id, lim, unnest(blocks) AS block, generate_subscripts(blocks, 1) AS n FROM lines),
sentences AS (
  SELECT doc_id, lim, n, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS k
  FROM (SELECT *, string_split(regexp_replace(block, '([.!?])[\\t-\\r ]+', '\\1' || chr(1), 'g'), chr(1)) AS parts
        FROM blocks WHERE length(block) > lim)),
words AS (
  SELECT *, flatten(list_transform(
    list_filter(regexp_split_to_array(sentence, '[\\t-\\r ]+'), lambda w: w <> ''),
    lambda w: list_transform(range((length(w) - 1) // lim + 1),
      lambda i: {{'items': [substr(w, i * lim + 1, lim)], 'open': (i + 1) * lim >= length(w)}}))) AS tokens
  FROM sentences WHERE length(sentence) > lim),
tokens AS (
  SELECT doc_id, lim, n, k, [{{'items': [sentence], 'open': true}}] AS tokens FROM sentences WHERE length(sentence) <= lim
  UNION ALL
  SELECT doc_id, lim, n, k, list_transform({_greedy('tokens', 'lim')}, lambda p: {{'items': [p], 'open': false}}) FROM words),
pieces AS (
  SELECT doc_id, n, [block] AS pieces FROM blocks WHERE length(block) <= lim
  UNION ALL
  SELECT doc_id, n, {_greedy('tokens', 'lim')} FROM (
    SELECT doc_id, n, any_value(lim) AS lim, flatten(list(tokens ORDER BY k)) AS tokens FROM tokens GROUP BY doc_id, n)),
packed AS (
  SELECT doc_id, list_reduce(list_concat([[header]], list_transform(coalesce(pieces, []), lambda p: [p])), lambda a, x:
    CASE WHEN length(a[-1] || chr(10) || chr(10) || x[1]) <= 600
         THEN list_append(list_slice(a, 1, len(a) - 1), a[-1] || chr(10) || chr(10) || x[1])
         ELSE list_append(a, header || chr(10) || chr(10) || x[1]) END) AS chunks
  FROM lines LEFT JOIN (SELECT doc_id, flatten(list(pieces ORDER BY n)) AS pieces FROM pieces GROUP BY 1) USING (doc_id))
SELECT doc_id, unnest(range(len(chunks))) AS ordinal, length(unnest(chunks)) AS n_chars, sha256(unnest(chunks)) AS content_sum FROM packed""",
    "team_select": f"""WITH {_TEAM}
SELECT request_id, role, slot, person_id, round(selection_score, 6) AS selection_score FROM team WHERE step > 0""",
    "team_totals": f"""WITH {_TEAM}
SELECT request_id, round(coalesce(avg(selection_score), 0), 6) AS aggregate_score, count(person_id) AS assigned,
       count(*) - count(person_id) AS unfilled FROM team WHERE step > 0 GROUP BY 1""",
    "team_queries": """WITH r AS (
  SELECT o_custkey, o_orderpriority AS role, count(*) AS n, list_sort(list(DISTINCT o_orderstatus)) AS states,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) - 1 AS role_no,
         max(count(*)) OVER (PARTITION BY o_custkey) AS most
  FROM orders GROUP BY o_custkey, o_orderpriority)
SELECT c_custkey || '|' || role_no AS query_id,
       concat_ws(' ', role, CASE WHEN n > 2 THEN 'senior' END, array_to_string(states, ' '),
                 CASE WHEN c_nationkey > 4 THEN c_mktsegment END) AS text,
       CASE WHEN c_nationkey > 4 THEN c_mktsegment ELSE role END AS semantic_query,
       CASE WHEN n > 2 THEN 'senior' END AS seniority,
       CASE WHEN c_nationkey > 9 THEN 30 ELSE 20 END AS candidates_per_role,
       round(CASE WHEN c_nationkey > 14 THEN c_acctbal / 10000 ELSE 0.15 END, 6) AS diversity_weight
FROM r JOIN customer ON c_custkey = o_custkey
WHERE most <= 10 AND (c_nationkey <= 14 OR c_acctbal / 10000 BETWEEN 0 AND 0.5)""",
    "team_terms": """WITH w AS (
  SELECT DISTINCT lang, source, unnest(regexp_extract_all(lower(text), '[a-z0-9+#.-]+')) AS word FROM documents)
SELECT lang AS query_id, source AS person_id, CAST(count(*) AS INTEGER) AS n_terms,
       sha256(string_agg(word, ' ' ORDER BY word)) AS terms_sum
FROM w WHERE length(word) > 2 GROUP BY ALL""",
    "plan_flags": """WITH q AS (
  SELECT CAST(c_custkey AS VARCHAR) AS query_id,
         c_nationkey BETWEEN 3 AND 5 OR c_acctbal > 8000 OR c_acctbal < -800
           OR c_mktsegment <> 'HOUSEHOLD' AS has_hard_filters,
         c_nationkey > 12 AS use_vector, c_mktsegment IN ('BUILDING', 'MACHINERY') AS use_graph
  FROM customer)
SELECT *, concat_ws(',', 'structured', CASE WHEN use_vector THEN 'vector' END,
                    CASE WHEN use_graph THEN 'graph' END) AS strategy FROM q""",
    "rank_features": f"""WITH {_PEOPLE}, {_BOUGHT}, {_SKILLED.split("," + chr(10) + "pairs AS")[0]},
q AS (SELECT s.*, n_regionkey, n_name, k % 2 = 1 AS strict FROM skilled s JOIN nation ON n_nationkey = k),
near AS (
  SELECT q.query_id, strict, b1, b2, ty, seg, q.n_name, p.*
  FROM people p JOIN customer USING (c_custkey) JOIN nation n ON n.n_nationkey = c_nationkey
  JOIN q ON q.n_regionkey = n.n_regionkey),
spent AS (
  SELECT CAST(o_custkey AS VARCHAR) AS person_id, count(*) AS n,
         count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1),
held AS (SELECT person_id, p_brand AS term FROM parts UNION SELECT person_id, p_type FROM parts),
counted AS (
  SELECT query_id, person_id, count(*) AS skill_hits, bool_or(term = b1) AS first_held
  FROM near JOIN held USING (person_id) WHERE term IN (b1, b2, ty) GROUP BY ALL),
f AS (
  SELECT query_id, person_id, full_name, strict, coalesce(least(1, n / 20), 0) AS semantic,
         CASE WHEN strict THEN coalesce(skill_hits, 0) / 3 ELSE 0 END AS skills,
         CAST(strict AND current_title = seg AS DOUBLE) AS domains,
         CASE WHEN strict THEN (CASE WHEN current_title = seg THEN 0.5 ELSE 0 END + least(years / 2.5, 1)) / 2
              WHEN current_title = seg THEN 0.5 ELSE 0 END AS experience,
         coalesce(urgent / n, 0) AS graph,
         CASE WHEN strict THEN (CAST(country = n_name AS INTEGER) + CAST(current_title = seg AS INTEGER)) / 2
              ELSE 0 END AS location,
         CASE WHEN first_held THEN 0.5 ELSE 0 END AS preference
  FROM near LEFT JOIN spent USING (person_id) LEFT JOIN counted USING (query_id, person_id)),
s AS (
  SELECT *, greatest(0, least(1, CAST(semantic AS DOUBLE) * CAST(0.3 AS DOUBLE)
           + skills * CAST(0.25 AS DOUBLE) + domains * CAST(0.15 AS DOUBLE)
           + CAST(experience AS DOUBLE) * CAST(0.1 AS DOUBLE) + graph * CAST(0.1 AS DOUBLE)
           + location * CAST(0.05 AS DOUBLE) + CAST(preference AS DOUBLE) * CAST(0.05 AS DOUBLE))) AS score FROM f),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(full_name), person_id) AS position
  FROM s QUALIFY position <= 200)
SELECT query_id, person_id, position, round(semantic, 6) AS semantic, round(skills, 6) AS skills, domains,
       round(CAST(experience AS DOUBLE), 6) AS experience, round(graph, 6) AS graph,
       CAST(location AS DOUBLE) AS location, CAST(preference AS DOUBLE) AS preference, round(score, 6) AS score
FROM r WHERE strict OR score >= 0.2""",
    "evidence_fusion": """WITH d AS (
  SELECT lang, source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS early,
         row_number() OVER (PARTITION BY lang, source ORDER BY length(text) DESC, doc_id) AS long
  FROM documents),
shown AS (SELECT DISTINCT lang, source FROM documents),
e AS (
  SELECT s.lang, s.source, 1 AS source_no, early AS position, 0 AS detail, doc_id, 'structured' AS kind,
         text, 1.0 AS score FROM d JOIN shown s USING (source) WHERE early <= 5
  UNION ALL
  SELECT lang, source, 2, long, 0, doc_id, 'vector', text, length(text) / 20000 FROM d WHERE long <= 10
  UNION ALL
  SELECT lang, source, 3, CASE WHEN toxic = 1 THEN 1 ELSE 2 END, doc_id, doc_id, 'graph', text,
         CASE WHEN toxic = 1 THEN 1 ELSE 0.5 END
  FROM d JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 0)
SELECT lang AS query_id, source AS person_id, source_no, CAST(position AS INTEGER) AS position,
       CAST(detail AS INTEGER) AS detail, CAST(doc_id AS VARCHAR) AS chunk_id, kind AS source,
       sha256(text) AS content_sum, round(CAST(score AS DOUBLE), 6) AS score FROM e""",
    "ingest_deliveries": f"""WITH {_DELIVERED},
one AS (SELECT count(*) FILTER (early) AS early, count(*) FILTER (early AND changed) AS changed,
               count(*) FILTER (NOT early) AS late, count(*) FILTER (seg = 'FURNITURE') AS twice,
               count(*) FILTER (seg = 'FURNITURE' AND early) AS same,
               count(*) FILTER (seg = 'HOUSEHOLD') AS copies, count(*) AS n FROM good),
bad AS (SELECT count(*) + count(*) FILTER (seg IN ('FURNITURE', 'HOUSEHOLD')) AS n FROM c WHERE years < 0),
r AS (
  SELECT 1 AS delivery, 'documents' AS what, {{'total': early, 'created': early, 'updated': 0, 'unchanged': 0,
         'duplicates': 0, 'skipped': 0, 'failed': 0}} AS v FROM one
  UNION ALL
  SELECT 2, 'documents', {{'total': one.n + twice + copies + bad.n, 'created': late, 'updated': changed + twice - same,
         'unchanged': early - changed + same, 'duplicates': copies, 'skipped': early - changed + same + copies,
         'failed': bad.n}} FROM one, bad),
e AS (
  SELECT 1 AS delivery, 'chunks' AS what, {{'total': early, 'created': early, 'updated': 0, 'unchanged': 0,
         'failed': 0}} AS v FROM one
  UNION ALL
  SELECT 2, 'chunks', {{'total': n, 'created': late, 'updated': changed, 'unchanged': early - changed,
         'failed': 0}} FROM one)
SELECT delivery, what, counter, CAST(n AS BIGINT) AS n FROM (
  SELECT delivery, what, unnest(['total','created','updated','unchanged','duplicates','skipped','failed']) AS counter,
         unnest([v.total, v.created, v.updated, v.unchanged, v.duplicates, v.skipped, v.failed]) AS n FROM r
  UNION ALL
  SELECT delivery, what, unnest(['total','created','updated','unchanged','failed']),
         unnest([v.total, v.created, v.updated, v.unchanged, v.failed]) FROM e)""",
    "ingest_entities": f"""WITH {_DELIVERED},
m AS (SELECT *, early OR seg <> 'MACHINERY' AS gcp, seg = 'MACHINERY' AS google FROM good)
SELECT DISTINCT 'skill' AS kind, seg AS name, lower(seg) AS key, NULL AS country, NULL AS description FROM m
UNION ALL SELECT 'skill', 'Google Cloud Platform', 'google cloud platform', NULL, NULL
UNION ALL SELECT DISTINCT 'domain', seg, lower(seg), NULL, NULL FROM m
UNION ALL SELECT DISTINCT 'company', n_name, {_norm('n_name')}, NULL, NULL FROM m
UNION ALL SELECT DISTINCT 'university', 'University ' || seg, 'university ' || lower(seg),
                          CASE WHEN odd THEN n_name END, NULL FROM m
UNION ALL SELECT DISTINCT 'project', 'Project ' || seg, 'project ' || lower(seg), NULL,
                          CASE WHEN google THEN 'Plan of ' || seg END FROM m
UNION ALL SELECT DISTINCT 'alias', lower(seg), lower(seg), NULL, NULL FROM m
UNION ALL SELECT DISTINCT 'alias', 'gcp', 'google cloud platform', NULL, NULL FROM m WHERE gcp
UNION ALL SELECT DISTINCT 'alias', 'google cloud', 'google cloud platform', NULL, NULL FROM m WHERE google""",
    "ingest_people": f"""WITH {_DELIVERED}
SELECT id AS c_custkey, c_name AS full_name, title AS current_title, years,
       CASE WHEN seg < 'Google' THEN seg || ',Google Cloud Platform' ELSE 'Google Cloud Platform,' || seg END AS skills,
       n_name AS companies, 'University ' || seg AS universities, 'Project ' || seg AS projects FROM good""",
    "ingest_chunks": f"""WITH {_DELIVERED},
k AS (
  SELECT id, n_name, CAST(0 AS INTEGER) AS ordinal, 'summary' AS section, 'SUMMARY' || chr(10) || chr(10)
           || 'Candidate: ' || c_name || chr(10) || chr(10) || 'Current title: ' || title || chr(10) || chr(10)
           || 'Country: ' || n_name || chr(10) || chr(10) || 'Years of experience: ' || CAST(years AS DOUBLE) AS content
  FROM good
  UNION ALL SELECT id, n_name, 1, 'experience', 'EXPERIENCE: ' || n_name || chr(10) || chr(10) || 'Domains: ' || seg FROM good
  UNION ALL SELECT id, n_name, 2, 'project', 'PROJECT: Project ' || seg
    || CASE WHEN seg = 'MACHINERY' THEN chr(10) || chr(10) || 'Plan of ' || seg ELSE '' END FROM good
  UNION ALL SELECT id, n_name, 3, 'education', 'EDUCATION: University ' || seg
    || CASE WHEN odd THEN chr(10) || chr(10) || 'Country: ' || n_name ELSE '' END FROM good
  UNION ALL SELECT id, n_name, 4, 'skills', 'SKILLS AND EXPERTISE' || chr(10) || chr(10) || 'Skills: '
    || CASE WHEN seg = 'MACHINERY' THEN 'Google  Cloud' ELSE 'GCP' END || ', ' || seg FROM good)
SELECT id AS external_id, ordinal, section, content, CASE WHEN section = 'experience' THEN n_name END AS company,
       CAST(16 AS INTEGER) AS dimension FROM k""",
    "enrich_requests": f"""WITH {_PEOPLE},
r AS (SELECT p.person_id, p.age, current_title = 'BUILDING' AS ml, current_title = 'AUTOMOBILE' AS py,
             current_title = 'MACHINERY' AS mts, c_nationkey % 4 AS place, c.c_custkey % 5 AS form
      FROM people p JOIN customer c USING (c_custkey))
SELECT person_id AS query_id,
  concat_ws(' ', 'Нужен', CASE WHEN py THEN 'Питон!' WHEN ml THEN 'ML-Engineer' WHEN mts THEN 'МТС,' END,
    CASE place WHEN 0 THEN 'в Берлине' WHEN 1 THEN 'из Москвы' WHEN 2 THEN '(Moscow, Лондон)' END,
    CASE WHEN form < 4 THEN ['старше', 'от', 'Младше', 'до'][form + 1] || ' ' || age || '  лет.' END,
    CASE WHEN ml THEN 'machine learning ml engineer mlops' END) AS semantic_query,
  CASE place WHEN 0 THEN 'Berlin' WHEN 1 THEN 'Москва' WHEN 2 THEN 'London' END AS city,
  CASE form WHEN 0 THEN age + 1 WHEN 1 THEN age END AS min_age,
  CASE form WHEN 2 THEN age - 1 WHEN 3 THEN age END AS max_age,
  CASE WHEN form NOT IN (0, 2) THEN CAST(3 AS DOUBLE) END AS min_years_experience,
  CASE place WHEN 0 THEN 'Berlin' WHEN 1 THEN 'Москва' WHEN 2 THEN 'London,Moscow' ELSE '' END AS cities,
  CASE WHEN ml THEN 'MLOps' WHEN py THEN 'Python' ELSE '' END AS required_skills,
  CASE WHEN ml THEN 'Kafka' ELSE 'MLOps,Kafka' END AS required_technologies,
  CASE WHEN ml THEN 'Machine Learning' ELSE '' END AS preferred_skills,
  CASE WHEN ml THEN 'Machine Learning,MLOps' ELSE '' END AS preferred_technologies,
  CASE WHEN mts THEN 'МТС' ELSE '' END AS companies FROM r""",
}
