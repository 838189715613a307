"""Registered queries on documents: rollups, duplicates, topics, symbols, text functions, ingest decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarnwell.functions import text as T
from skarnwell.operators import analytics, chunking, components, lexical
from skarnwell.plans.base import CH, DIM, QUESTIONS, chunks, documents, query, questions, sql_dense, sql_tokens, table
from skarnwell import store

FIRST_PATH = "local/fugradrux/mafon/kernel-giskox-1d2.docx"


@query(f"WITH {CH}, n AS (SELECT doc_id, count(*) AS chunks FROM ch GROUP BY doc_id) SELECT source, count(DISTINCT d.doc_id) AS documents, coalesce(sum(chunks), 0)::BIGINT AS chunks, max(indexed_at) AS last_indexed FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY source")
def sources_rollup(spark: SparkSession, d: str) -> DataFrame:
    return analytics.sources(documents(spark, d), chunks(spark, d, "doc_id"))


@query(f"WITH {CH} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM ch) AS chunks")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).agg(F.count("*").alias("documents")).crossJoin(F.broadcast(chunks(spark, d, "id").agg(F.count("*").alias("chunks"))))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def scan_docs_by_source(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT doc_id, path FROM documents WHERE contains(lower(path), 'repos/')")
def filter_folder(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).filter(F.contains(F.lower("path"), F.lit("repos/"))).select("doc_id", "path")


@query("SELECT doc_id, path FROM documents WHERE source = 'obsidian:main'")
def filter_source(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).filter("source = 'obsidian:main'").select("doc_id", "path")


@query("SELECT doc_id, metadata['service'] AS service FROM documents WHERE lower(metadata['type']) = 'runbook'")
def filter_metadata(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).filter(F.lower(F.try_element_at("metadata", F.lit("type"))) == "runbook").select("doc_id", F.try_element_at("metadata", F.lit("service")).alias("service"))


@query("SELECT doc_id, path, indexed_at FROM documents WHERE starts_with(source, 'web:') ORDER BY indexed_at DESC NULLS LAST, doc_id DESC LIMIT 200")
def bookmarks(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).filter(F.col("source").startswith("web:")).orderBy(F.desc_nulls_last("indexed_at"), F.desc("doc_id")).limit(200).select("doc_id", "path", "indexed_at")


ROOTS = ("local/fugradrux", "repos", "web:https:", "nowhere")


@query(f"""WITH {CH}, n AS (SELECT doc_id, count(*) AS chunks FROM ch GROUP BY doc_id), r AS (SELECT unnest([{', '.join(map(repr, ROOTS))}]) AS root)
    SELECT root, count(d.doc_id) AS documents, coalesce(sum(chunks), 0)::BIGINT AS chunks FROM r LEFT JOIN documents d ON d.path = root OR starts_with(d.path, root || '/') LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY root""")
def roots_rollup(spark: SparkSession, d: str) -> DataFrame:
    return analytics.roots_rollup(documents(spark, d), chunks(spark, d, "doc_id"), list(ROOTS))


@query("SELECT doc_id, path, mtime FROM documents WHERE mtime > 0 ORDER BY mtime, doc_id LIMIT 5")
def oldest_documents(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).filter("mtime > 0").orderBy("mtime", "doc_id").limit(5).select("doc_id", "path", "mtime")


@query("SELECT coalesce(strftime(max(indexed_at), '%Y-%m-%d %H:%M:%S'), '') AS revision FROM documents")
def corpus_revision(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).agg(F.coalesce(F.date_format(F.max("indexed_at"), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("revision"))


@query(f"WITH {CH} SELECT doc_id, (ordinal // 2000)::BIGINT AS part, string_agg(text, chr(10) || chr(10) ORDER BY ordinal, id) AS text FROM ch GROUP BY ALL")
def document_text(spark: SparkSession, d: str) -> DataFrame:
    return analytics.document_text(chunks(spark, d, "doc_id", "ordinal", "text"))


LINES = "dig AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), digs AS (SELECT doc_id, line FROM dig WHERE line <> ''), n AS (SELECT doc_id, count(*) AS n FROM digs GROUP BY doc_id)"
PAIRS = f"{LINES}, pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM digs a JOIN digs b ON a.line = b.line AND a.doc_id < b.doc_id GROUP BY ALL), good AS (SELECT a, b, shared, round(shared / least(x.n, y.n)::DOUBLE, 3) AS ratio FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 3 AND shared / least(x.n, y.n)::DOUBLE >= 0.5)"


@query(f"""WITH RECURSIVE {PAIRS}, links AS (SELECT a, b FROM good UNION SELECT b, a FROM good), reach AS (SELECT a AS node, a AS low FROM links UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node WHERE r.low < l.b),
    comp AS (SELECT node, min(low) AS cluster FROM reach GROUP BY node), best AS (SELECT cluster, max(ratio) AS ratio, max(shared) AS shared FROM good JOIN comp ON comp.node = good.a GROUP BY cluster)
    SELECT cluster, node AS doc_id, shared, ratio FROM comp JOIN best USING (cluster)""")
def duplicate_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Documents grouped by the distinct lines they share."""
    lines = analytics.duplicate_pairs_of_lines(documents(spark, d), "doc_id", "text")
    return analytics.duplicate_clusters(lines, documents(spark, d))


def _star_sql() -> str:
    """Pairs between class representatives, and copies linked to theirs: classes are documents with equal sets of lines."""
    return f"""{LINES}, sets AS (SELECT doc_id, list(line ORDER BY line) AS s FROM digs GROUP BY doc_id), cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS rep FROM sets),
    repline AS (SELECT digs.doc_id, line FROM digs JOIN cls ON cls.doc_id = digs.doc_id AND cls.rep = digs.doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM repline a JOIN repline b ON a.line = b.line AND a.doc_id < b.doc_id GROUP BY ALL
      UNION ALL SELECT rep, cls.doc_id, n FROM cls JOIN n ON n.doc_id = cls.doc_id WHERE rep <> cls.doc_id)
    SELECT a, b, shared, round(shared / least(x.n, y.n)::DOUBLE, 3) AS ratio FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 3 AND shared / least(x.n, y.n)::DOUBLE >= 0.5"""


@query(f"WITH {_star_sql()}")
def duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    lines = analytics.duplicate_pairs_of_lines(documents(spark, d), "doc_id", "text")
    return analytics.shared_digests(lines, documents(spark, d))


@query("""WITH RECURSIVE e AS (SELECT s_nationkey AS a, 100 + s_suppkey % 40 AS b FROM supplier), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS low FROM l UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node WHERE r.low < l.b)
    SELECT node, min(low) AS component FROM r GROUP BY node""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("a"), (F.lit(100) + F.col("s_suppkey") % 40).alias("b"))
    return components.connected_components(e)


CENT = f"cent AS (SELECT doc_id AS other, list(m ORDER BY i) AS embedding FROM (SELECT doc_id, i, avg(x) AS m FROM (SELECT doc_id, unnest(range(1, {DIM + 1})) AS i, unnest(embedding)::DOUBLE AS x FROM ch WHERE len(embedding) = {DIM} AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0) GROUP BY doc_id, i) GROUP BY doc_id)"


@query(f"""WITH {CH}, {CENT}, probes AS (SELECT other AS doc_id, embedding AS pv FROM cent WHERE other % 20 = 0), {sql_dense('lane', 'probes', 'doc_id', 'pv', 6, 'cent', 'other')}
    SELECT * FROM (SELECT doc_id, other, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, other) AS rank FROM lane WHERE doc_id <> other) WHERE rank <= 5""")
def related_documents(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set, documents whose id is divisible by 20, against all."""
    return analytics.related_documents(chunks(spark, d, "doc_id", "embedding"), DIM, documents(spark, d).filter("doc_id % 20 = 0"))


@query(f"WITH {CH}, h AS (SELECT doc_id, count(*) AS hits FROM ch WHERE list_has_all({sql_tokens('text')}, ['kernel', 'giskox', '1d2'][:2]) GROUP BY doc_id) SELECT path, hits FROM h JOIN documents USING (doc_id) WHERE path <> '{FIRST_PATH}' ORDER BY hits DESC, path LIMIT 8")
def backlinks(spark: SparkSession, d: str) -> DataFrame:
    return lexical.backlinks(chunks(spark, d, "doc_id", "text"), documents(spark, d), FIRST_PATH.replace("-1d2", ""), 8).filter(F.col("path") != FIRST_PATH)


@query()
def topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    return analytics.topic_clusters(table(spark, d, "embeddings"), "vec_id", "embedding")


@query(f"""WITH l AS (SELECT doc_id, source AS label, text FROM documents), w AS (SELECT DISTINCT doc_id, label, unnest({sql_tokens('text')}) AS term FROM l), here AS (SELECT label, term, count(*) AS n FROM w WHERE length(term) >= 3 GROUP BY ALL),
    everywhere AS (SELECT term, sum(n) AS all_n FROM here GROUP BY term), sizes AS (SELECT label, count(*) AS size FROM l GROUP BY label), total AS (SELECT count(*) AS total FROM l),
    sc AS (SELECT label, term, round(n / size::DOUBLE - all_n / total::DOUBLE, 9) AS score FROM here JOIN everywhere USING (term) JOIN sizes USING (label) CROSS JOIN total WHERE n >= 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, term DESC) AS nth FROM sc)
    SELECT s.label, coalesce(string_agg(term, ', ' ORDER BY nth), '(mixed)') AS terms FROM sizes s LEFT JOIN best b ON b.label = s.label AND nth <= 5 GROUP BY s.label""")
def topic_labels(spark: SparkSession, d: str) -> DataFrame:
    return analytics.distinctive_terms(documents(spark, d).select(F.col("source").alias("label"), "text"), "label", "text")


_CODE = ", ".join(map(repr, analytics.CODE_EXTENSIONS))
_DEFINES = analytics.DEFINES.format("emit").replace("'", "''")


@query(rf"""WITH {CH}, l AS (SELECT d.path, CASE WHEN line_start > 0 THEN line_start ELSE 1 END AS first, string_split(ch.text, chr(10)) AS lines FROM ch JOIN documents d USING (doc_id) WHERE contains(ch.text, 'emit')),
    e AS (SELECT path, first + unnest(range(0, len(lines))) AS line, unnest(lines) AS t FROM l), m AS (SELECT *, lower(regexp_extract(path, '[^/]\.([^./]*)$', 1)) AS ext, trim(regexp_replace(t, '[\s\p{{Z}}]+', ' ', 'g')) AS one FROM e WHERE regexp_matches(t, '\bemit\b')),
    k AS (SELECT path, line, CASE WHEN ext IN ({_CODE}) AND regexp_matches(t, '{_DEFINES}') THEN 'definition' WHEN ext IN ({_CODE}) AND regexp_matches(t, '\bemit\s*\(') THEN 'call' ELSE 'mention' END AS kind, CASE WHEN length(one) > 160 THEN one[:159] || '…' ELSE one END AS text FROM m),
    g AS (SELECT path, line, min(kind) AS kind, min(text) AS text FROM k GROUP BY path, line) SELECT kind, path, line::BIGINT AS line, text FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path, line) AS n FROM g) WHERE n <= CASE WHEN kind = 'mention' THEN 8 ELSE 25 END""")
def symbol_sites(spark: SparkSession, d: str) -> DataFrame:
    return analytics.symbol_sites(chunks(spark, d, "doc_id", "text", "line_start"), documents(spark, d), "emit")


@query("""WITH h AS (SELECT doc_id, source, path, sha256(path || ':' || text) AS h FROM documents WHERE text IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, path) AS n FROM h)
    SELECT doc_id, source, path FROM o WHERE n = 1 ORDER BY h LIMIT 20""")
def hash_order_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).filter("text is not null").select("doc_id", "source", "path", "text")
    return analytics.hash_sample(rows, "source", ["path", "text"], 20).select("doc_id", "source", "path")


@query(r"""WITH b AS (SELECT doc_id, regexp_extract(text, '\A---\n((?:[^\n]*\n)*?)---(?:\n|\z)', 1) AS block FROM documents), l AS (SELECT doc_id, unnest(string_split(block, chr(10))) AS line FROM b)
    SELECT doc_id, lower(trim(split_part(line, ':', 1))) AS key, trim(substr(line, instr(line, ':') + 1))[:100] AS value FROM l WHERE regexp_matches(line, '^\s*[A-Za-z0-9_-]+\s*:\s*\S')""")
def front_matter(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.explode(T.front_matter(F.col("text"))))


@query("SELECT doc_id, path FROM documents WHERE regexp_matches(path, '^email/.*$') OR regexp_matches(path, '[^/]*\\.log$')")
def never_index_glob(spark: SparkSession, d: str) -> DataFrame:
    return store.never_index(documents(spark, d), ["email/*", "*.log"]).select("doc_id", "path")


@query("""WITH f AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN mtime + 5 ELSE mtime END AS mtime, CASE WHEN doc_id % 14 = 0 THEN 'x' ELSE content_hash END AS h FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT 'new/' || path, mtime, content_hash FROM documents WHERE doc_id % 50 = 0)
    SELECT coalesce(d.path, f.path) AS path, CASE WHEN d.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'missing' WHEN coalesce(chunk_config = 'v2:1000/150', false) AND coalesce(abs(f.mtime - d.mtime) < 1e-6, false) THEN 'unchanged'
      WHEN coalesce(chunk_config = 'v2:1000/150', false) AND coalesce(f.h = d.content_hash, false) THEN 'touched' ELSE 'changed' END AS state FROM documents d FULL JOIN f ON f.path = d.path""")
def manifest_classify(spark: SparkSession, d: str) -> DataFrame:
    """A made-up later listing: some files gone, some with another time, some with another text, some new."""
    docs = documents(spark, d)
    seen = docs.filter("doc_id % 11 <> 0").select("path", F.expr("case when doc_id % 7 = 0 then mtime + 5 else mtime end").alias("mtime"), F.expr("case when doc_id % 14 = 0 then 'x' else content_hash end").alias("content_hash"))
    new = docs.filter("doc_id % 50 = 0").select(F.concat(F.lit("new/"), "path").alias("path"), "mtime", "content_hash")
    return store.classify(docs, seen.unionByName(new), "v2:1000/150")


@query("SELECT doc_id, path FROM documents WHERE source = 'local:fugradrux' AND doc_id % 3 <> 0 AND starts_with(path, 'local/fugradrux/')")
def prune_missing(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).withColumns({"source": F.when(F.col("source") == "local:fugradrux", "local"), "path": F.concat(F.lit("/"), "path")})
    gone = store.missing_local(docs, docs.filter("doc_id % 3 = 0"), ["/local/fugradrux"])
    return gone.select("doc_id", F.substring("path", 2, 4096).alias("path"))


@query("""WITH g AS (SELECT doc_id FROM documents WHERE path LIKE 'email/%') SELECT 'documents' AS tab, count(*) AS n FROM documents WHERE doc_id NOT IN (FROM g) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE doc_id NOT IN (FROM g) UNION ALL SELECT 'parents', count(*) FROM parents WHERE doc_id NOT IN (FROM g)""")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = store.never_index(documents(spark, d), ["email/*"])
    left = store.delete_documents({n: table(spark, d, n).select("doc_id") for n in ("documents", "chunks", "parents")}, gone)
    out = None
    for name, df in left.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n")
        out = part if out is None else out.unionByName(part)
    return out


HTML = """'<title>' || path || '</title><body><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p><a href="/' || path || '">x</a></body>'"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as web pages: there is no table of pages."""
    return documents(spark, d).filter("text is not null").select("doc_id", F.concat(F.lit("https://Host.example/"), F.regexp_replace("path", "^web:https://", ""), F.lit("?v=1#top")).alias("url"), F.expr(HTML.replace("chr(10)", "'\\n'")).alias("html"))


@query("""WITH t AS (SELECT doc_id, path || text || chr(10) || 'x' AS t FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), chr(10)) AS t FROM t) SELECT doc_id, trim(regexp_replace(trim(t, chr(10) || ' '), '\\n{3,}', chr(10) || chr(10), 'g'), ' ') AS text FROM l""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of the documents give back their texts: title, text and the link's one letter; lines trimmed, blank lines at most one."""
    return _pages(spark, d).select("doc_id", T.html_to_text(F.col("html")).alias("text"))


@query("SELECT doc_id, path AS title FROM documents WHERE text IS NOT NULL")
def page_title(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", T.page_title(F.col("html")).alias("title"))


@query("SELECT doc_id, '/' || path AS link FROM documents WHERE text IS NOT NULL")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", F.explode(T.page_links(F.col("html"))).alias("link"))


@query("SELECT doc_id, 'web://Host.example/' || regexp_replace(path, '^web:https://', '') AS path FROM documents WHERE text IS NOT NULL")
def web_path_key(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", T.web_path(F.col("url")).alias("path"))


@query()
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(documents(spark, d), "doc_id", "text")


@query()
def group_parents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.parents(chunking.chunked(documents(spark, d), "doc_id", "text"), "doc_id")


@query(f"WITH {QUESTIONS}, s AS (SELECT cache_key, unnest(string_split_regex(question, '[ ]+')) AS w FROM questions) SELECT cache_key, count(*) FILTER (w <> '') AS words FROM s GROUP BY cache_key")
def question_words(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("cache_key", F.size(F.filter(F.split("question", "[ ]+"), lambda w: w != "")).cast("long").alias("words"))


@query(r"""SELECT id, len(regexp_extract_all(text, '\[(\d{1,6})\]', 1)) AS refs, coalesce(len(regexp_extract_all(text, '\[(\d{1,6})\]', 1)) > 0 AND list_bool_and(list_transform(regexp_extract_all(text, '\[(\d{1,6})\]', 1), lambda x: x::INT BETWEEN 1 AND coalesce(len(citations), 0))), false) AS valid
    FROM (SELECT DISTINCT ON (id) * FROM messages) WHERE text IS NOT NULL AND id IS NOT NULL""")
def citations_valid(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").dropDuplicates(["id"]).filter("text is not null and id is not null")
    n = F.coalesce(F.size("citations"), F.lit(0))
    return m.select("id", F.size(T.citation_refs(F.col("text"))).cast("long").alias("refs"), T.citations_valid(F.col("text"), F.greatest(n, F.lit(0))).alias("valid"))
