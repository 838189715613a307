"""SQL that gives the same rows as a registered query, for those that SQL can express on whole tables."""

P3_FOUND = """
SELECT DISTINCT 'chunks' AS tab, doc_id, CAST(ordinal AS BIGINT) AS ordinal FROM chunks WHERE length(trim(text, ' ' || chr(10))) > 1000
UNION ALL
SELECT DISTINCT 'parents' AS tab, doc_id, CAST(ordinal AS BIGINT) AS ordinal FROM parents WHERE length(trim(text, ' ' || chr(10))) > 6000
"""


P1_FOUND = r"""
WITH distinct_rows AS (
  SELECT chat_id, role, text, created_at, min(id) AS id FROM messages WHERE chat_id IS NOT NULL GROUP BY ALL
), read AS (
  SELECT *, CASE lower(trim(role)) WHEN 'user' THEN 1 WHEN 'human' THEN 1 WHEN 'assistant' THEN 2 WHEN 'bot' THEN 2 WHEN 'ai' THEN 2 WHEN 'system' THEN 3 END AS code,
    regexp_matches(text, '[^\s\pZ\p{Cc}\p{Cf}]') AS visible
  FROM distinct_rows
), talk AS (
  SELECT chat_id, code, row_number() OVER (PARTITION BY chat_id ORDER BY created_at, id) AS n, count(*) OVER (PARTITION BY chat_id) AS of_all FROM read WHERE code IN (1, 2)
), kept AS (
  SELECT chat_id FROM read GROUP BY chat_id HAVING bool_and(coalesce(code IS NOT NULL AND visible AND created_at IS NOT NULL, false))
  INTERSECT
  SELECT chat_id FROM talk GROUP BY chat_id HAVING bool_and(code = 2 - n % 2) AND max(of_all) % 2 = 0
)
SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY created_at, id) AS pos, id FROM read WHERE chat_id IN (SELECT chat_id FROM kept)
"""


def _neighbours(tab: str, key: str, number: str) -> str:
    ok = "len({0}.embedding) = 64 AND list_sum(list_transform({0}.embedding, lambda x: abs(x))) > 0"
    return f"""SELECT '{tab}' AS tab, key, other, round(cosine, 6) AS cosine FROM (
  SELECT q.{key}::VARCHAR AS key, v.{key}::VARCHAR AS other, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS cosine,
    row_number() OVER (PARTITION BY q.{key} ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.{key}::VARCHAR) AS n
  FROM (SELECT DISTINCT ON ({key}) {key}, embedding FROM {tab} WHERE {ok.format(tab)}) q JOIN (SELECT DISTINCT ON ({key}) {key}, embedding FROM {tab} WHERE {ok.format(tab)}) v ON q.{key} <> v.{key} AND {number} % 20 = 0
) WHERE n <= 10"""


P5_NEIGHBOURS = "\nUNION ALL\n".join([_neighbours("chunks", "id", "q.id"), _neighbours("memories", "id", "q.id"), _neighbours("answer_cache", "cache_key", "('0x' || substr(md5(q.cache_key), 1, 8))::UBIGINT")])


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p3_found": P3_FOUND, "p5_neighbours": P5_NEIGHBOURS}
