"""The registered queries of the retrieval and question-answering engine, with their SQL.

Documents stand for chunks, benchmark items for questions, embeddings for
chunk vectors, conversations for sessions and events for model calls and
requests; columns that the tables lack are derived the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom import providers
from corpusloom.config import DEFAULT
from corpusloom.functions import policy, text
from corpusloom.functions import tables as table_functions
from corpusloom.operators import answers, chunking, incremental, retrieval, state, tables
from corpusloom.operators import questions as questions_of
from corpusloom.operators.keyword_index import KeywordIndex
from corpusloom.session import scratch
from corpusloom.sources import sinks
from corpusloom.sources.readers import chunks, documents, requests, sse_events, table
from corpusloom.sources.sse import ServerSentEvents
from corpusloom.store import Append, Store
from corpusloom.streaming import loading

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

K = DEFAULT.retrieval.route_top_k


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


CHUNKS = """
chunks AS (
  SELECT d.doc_id AS chunk_id, d.doc_id // 10 AS document_id, d.lang AS tenant,
         CASE WHEN d.doc_id % 5 <> 0 THEN CAST(2020 + d.doc_id % 5 AS INTEGER) END AS year,
         CAST(d.doc_id % 40 AS INTEGER) AS page_start, CAST(d.doc_id % 40 + d.n_chars // 3000 AS INTEGER) AS page_end,
         d.text AS content, t.doc_id IS NOT NULL AS is_deleted
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) t ON d.doc_id = t.doc_id)
"""
STRIP = "regexp_replace({0}, '^[\\s\\x0B\\x{{3000}}\\x{{A0}}\\x{{85}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}]+|[\\s\\x0B\\x{{3000}}\\x{{A0}}\\x{{85}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}]+$', '', 'g')"


def strip_sql(x: str) -> str:
    return STRIP.format(x)


# Chunks and incremental loading


@query(f"WITH {CHUNKS} SELECT chunk_id, tenant, substring(content, 1, 200) AS preview FROM chunks WHERE NOT is_deleted")
def tenant_live_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.live(chunks(spark, sf_dir)).select("chunk_id", "tenant", text.preview(F.col("content")).alias("preview"))


@query("SELECT sha256(text) AS content_sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = chunks(spark, sf_dir).withColumn("content_sha256", text.sha256(F.col("content")))
    return incremental.duplicate_groups(hashed)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.col("lang").alias("tenant"), text.sha256(F.col("text")).alias("file_sha256"))


def _known_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are known: good ones parsed, the others still pending."""
    status = F.when(F.col("quality") == 1, "parsed").otherwise("pending").alias("parse_status")
    return _files(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", status), "doc_id")


_FILES = """
files AS (SELECT doc_id, lang AS tenant, sha256(text) AS file_sha256 FROM documents),
known AS (SELECT f.tenant, f.file_sha256, CASE WHEN l.quality = 1 THEN 'parsed' ELSE 'pending' END AS parse_status FROM files f JOIN labels l USING (doc_id))
"""


@query(f"WITH {_FILES} SELECT f.* FROM files f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.tenant = f.tenant AND k.file_sha256 = f.file_sha256 AND k.parse_status = 'parsed')")
def file_skip_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.new_files(_files(spark, sf_dir), _known_files(spark, sf_dir)).select("doc_id", "tenant", "file_sha256")


@query(
    f"""WITH {_FILES}, state AS (SELECT tenant, file_sha256, max(CASE WHEN parse_status = 'parsed' THEN 1 ELSE 0 END) AS parsed FROM known GROUP BY 1, 2)
SELECT f.doc_id, CASE s.parsed WHEN 1 THEN 'skip' WHEN 0 THEN 'reparse' ELSE 'create' END AS action FROM files f LEFT JOIN state s USING (tenant, file_sha256)"""
)
def file_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.file_action(_files(spark, sf_dir), _known_files(spark, sf_dir)).select("doc_id", "action")


@query(
    f"""WITH {CHUNKS}, stored AS (SELECT DISTINCT tenant, sha256(content) AS h FROM chunks WHERE is_deleted)
SELECT c.document_id, count(*) AS total, count(s.h) AS reused_chunks, count(*) - count(s.h) AS new_chunks
FROM chunks c LEFT JOIN stored s ON s.tenant = c.tenant AND s.h = sha256(c.content) GROUP BY 1"""
)
def chunk_reuse_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = chunks(spark, sf_dir).withColumn("content_sha256", text.sha256(F.col("content")))
    return incremental.reuse_counters(incremental.mark_reuse(hashed, hashed.where("is_deleted")), ("document_id",))


@query(
    f"""WITH {CHUNKS}, active AS (SELECT sha256(c.content) AS h, min(e.vec_id) AS source_id FROM embeddings e JOIN chunks c ON c.chunk_id = e.vec_id GROUP BY 1)
SELECT c.chunk_id, a.source_id, e.embedding[1] AS first_component FROM chunks c LEFT JOIN active a ON a.h = sha256(c.content) LEFT JOIN embeddings e ON e.vec_id = a.source_id"""
)
def embedding_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors found by content, so that every copy of a chunk has one."""
    hashed = chunks(spark, sf_dir).withColumn("content_sha256", text.sha256(F.col("content")))
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id").join(hashed.select("chunk_id", "content_sha256"), "chunk_id")
    stored = vectors.select(F.col("chunk_id").alias("id"), "content_sha256", F.lit("default").alias("embed_model"), F.struct(F.col("chunk_id").alias("id"), F.col("embedding").alias("v")).alias("vector"), F.lit(True).alias("is_active"))
    found = incremental.vectors_for(hashed, stored)
    return found.select("chunk_id", F.col("vector.id").alias("source_id"), F.get("vector.v", F.lit(0)).alias("first_component"))


@query(
    f"""WITH {CHUNKS}, v AS (SELECT chunk_id, document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_id) AS INTEGER) AS version_no FROM chunks)
SELECT *, version_no = max(version_no) OVER (PARTITION BY document_id) AS is_current FROM v"""
)
def version_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = incremental.number_versions(chunks(spark, sf_dir), "document_id", F.col("chunk_id"))
    return numbered.select("chunk_id", "document_id", "version_no", (F.col("version_no") == F.max("version_no").over(Window.partitionBy("document_id"))).alias("is_current"))


@query(f"WITH {CHUNKS} SELECT document_id, count(*) AS chunk_count, sha256(string_agg(content, chr(10) ORDER BY chunk_id)) AS content_sha256 FROM chunks GROUP BY 1")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.content_digest(chunks(spark, sf_dir), "document_id", "chunk_id")


@query(
    f"""WITH {CHUNKS}, gone AS (SELECT DISTINCT document_id FROM chunks WHERE is_deleted), lost AS (SELECT chunk_id FROM chunks WHERE document_id IN (SELECT document_id FROM gone))
SELECT DISTINCT 'documents' AS table_name, document_id AS id FROM chunks WHERE document_id NOT IN (SELECT document_id FROM gone)
UNION ALL SELECT 'chunks', chunk_id FROM chunks WHERE document_id NOT IN (SELECT document_id FROM gone)
UNION ALL SELECT 'embeddings', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT chunk_id FROM lost)"""
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_chunks = chunks(spark, sf_dir)
    stored = {
        "documents": all_chunks.select("document_id").distinct(),
        "chunks": all_chunks.select("document_id", "chunk_id"),
        "embeddings": table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id")),
    }
    left = incremental.cascade_delete(stored, all_chunks.where("is_deleted"))
    rows = [df.select(F.lit(name).alias("table_name"), F.col(df.columns[-1]).alias("id")) for name, df in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# Text: documents with page marks, dates, titles and numbered headings around their texts

AROUND = (
    ("公司年度报告\n第 3 页\n1. 范围\n", "\n第 4 页 共 9 页\n2、结束"),
    ("第一章 总则\n一、概述\n（2）细则\n", "\nPage 1 of 9\n第２节 附录\nlast words"),
    ("12\n２０２４\n3 / 10\nPAGE 7\n", "\n\n\n\n2024-01-02\n第１２页"),
    ("截至2024年12月31日\n\n123456\n", "\n\n摘要说明\n\n三、尾声\nthe end"),
    ("", ""),
)


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % len(AROUND)
    around = [F.get(F.array(*[F.lit(x[k]) for x in AROUND]), n.cast("int")) for k in (0, 1)]
    return documents(spark, sf_dir).withColumn("text", F.concat(around[0], "text", around[1]))


def _around_sql(k: int) -> str:
    return f"[{', '.join(chr(39) + x[k] + chr(39) for x in AROUND)}][doc_id % {len(AROUND)} + 1]"


NOTED = f"noted AS (SELECT doc_id, {_around_sql(0)} || text || {_around_sql(1)} AS text FROM documents)"


@query(
    f"""WITH {NOTED}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM noted),
s AS (SELECT *, {strip_sql("line")} AS x FROM l),
kept AS (SELECT * FROM s WHERE NOT (regexp_matches(x, '^\\p{{Nd}}{{1,5}}$') OR regexp_matches(x, '^(第\\s*\\p{{Nd}}+\\s*页|Page\\s*\\p{{Nd}}+)$', 'i') OR (length(x) <= 10 AND regexp_matches(x, '^[\\p{{Nd}}\\s./\\-]+$')))),
agg AS (SELECT doc_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY n) AS t FROM kept GROUP BY 1)
SELECT d.doc_id, CASE WHEN {strip_sql("d.text")} = '' THEN sha256(d.text) ELSE sha256(coalesce(a.t, '')) END AS cleaned_sha256 FROM noted d LEFT JOIN agg a USING (doc_id)"""
)
def page_noise_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noted(spark, sf_dir).select("doc_id", text.sha256(text.drop_page_noise(F.col("text"))).alias("cleaned_sha256"))


@query(
    f"""WITH {NOTED}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM noted),
r AS (SELECT doc_id, line FROM l WHERE {strip_sql("line")} <> '' GROUP BY 1, 2 HAVING count(*) >= 3),
s AS (SELECT l.doc_id, l.line, l.n, {strip_sql("l.line")} AS x FROM l),
kept AS (SELECT s.* FROM s LEFT JOIN r ON r.doc_id = s.doc_id AND r.line = s.x
  WHERE s.x = '' OR NOT (r.line IS NOT NULL OR regexp_matches(s.x, '第\\s*\\p{{Nd}}+\\s*页\\s*共\\s*\\p{{Nd}}+\\s*页|Page\\s+\\p{{Nd}}+\\s+of\\s+\\p{{Nd}}+|\\p{{Nd}}{{4}}\\s*年\\s*\\p{{Nd}}{{1,2}}\\s*月\\s*\\p{{Nd}}{{1,2}}\\s*日')
    OR (regexp_matches(s.x, '^\\p{{Nd}}+$') AND length(s.x) < 5) OR regexp_matches(s.x, '^\\p{{Nd}}{{4}}[-/]\\p{{Nd}}{{1,2}}[-/]\\p{{Nd}}{{1,2}}$'))),
agg AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS t FROM kept GROUP BY 1),
c AS (SELECT d.doc_id, {strip_sql("regexp_replace(coalesce(a.t, ''), '\\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM noted d LEFT JOIN agg a USING (doc_id))
SELECT doc_id, length(t) AS n_chars, sha256(t) AS cleaned_sha256 FROM c"""
)
def header_footer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = noted(spark, sf_dir).select("doc_id", text.clean_text(F.col("text")).alias("t"))
    return cleaned.select("doc_id", F.length("t").cast("long").alias("n_chars"), text.sha256(F.col("t")).alias("cleaned_sha256"))


NUMBERED_SQL = "regexp_matches({0}, '^第[一二三四五六七八九十\\p{{Nd}}]+[章节部分]|^[一二三四五六七八九十]+、|^\\p{{Nd}}+[.、]|^[（(]\\p{{Nd}}+[）)]')"


@query(
    f"""WITH {NOTED}, p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {strip_sql("x")}), lambda x: x <> '')) AS p FROM noted),
q AS (SELECT doc_id, p, string_split(p, chr(10))[1] AS f, len(string_split(p, chr(10))) AS n FROM p)
SELECT doc_id, CASE WHEN length(f) < 100 AND NOT regexp_matches(f, '[。.；;]$') AND ({NUMBERED_SQL.format("f")} OR (length(f) < 50 AND n = 1)) THEN 'Title' ELSE 'NarrativeText' END AS element_type,
count(*) AS n_elements, sum(length(p)) AS n_chars FROM q GROUP BY 1, 2"""
)
def paragraph_title_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = noted(spark, sf_dir).select("doc_id", F.explode(text.paragraphs(F.col("text"))).alias("p"))
    return parts.groupBy("doc_id", text.element_type(F.col("p")).alias("element_type")).agg(F.count("*").alias("n_elements"), F.sum(F.length("p")).cast("decimal(38,0)").alias("n_chars"))


@query(
    f"""WITH {NOTED}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM noted),
s AS (SELECT doc_id, n, {strip_sql("line")} AS x FROM l),
v AS (SELECT *, CASE WHEN regexp_matches(x, '^第[一二三四五六七八九十\\p{{Nd}}]+[章节部分]') THEN 1 WHEN regexp_matches(x, '^[一二三四五六七八九十]+、') THEN 2 WHEN regexp_matches(x, '^\\p{{Nd}}+[.、]') THEN 3 WHEN regexp_matches(x, '^[（(]\\p{{Nd}}+[）)]') THEN 4 ELSE 0 END AS level FROM s WHERE x <> ''),
i AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS section_no FROM v)
SELECT doc_id, CAST(section_no AS INTEGER) AS section_no, CAST(max(level) AS INTEGER) AS level, max(x) FILTER (level > 0) AS title, coalesce(string_agg(x || chr(10), '' ORDER BY n) FILTER (level = 0), '') AS content
FROM i WHERE section_no > 0 GROUP BY doc_id, section_no"""
)
def section_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.section_outline(noted(spark, sf_dir))


@query(
    f"""WITH {NOTED}, l AS (SELECT doc_id, list_transform(string_split({strip_sql("text")}, chr(10)), lambda x: {strip_sql("x")})[1:10] AS t FROM noted),
u AS (SELECT doc_id, t, unnest(t) AS x, generate_subscripts(t, 1) AS n FROM l),
g AS (SELECT doc_id, x, n FROM u WHERE x <> '' AND ((length(x) < 200 AND regexp_matches(x, '报告|公告|说明|摘要|目录')) OR (list_position(t, x) <= 3 AND length(x) > 10 AND length(x) < 100)))
SELECT d.doc_id, (SELECT arg_min(g.x, g.n) FROM g WHERE g.doc_id = d.doc_id) AS title FROM noted d"""
)
def doc_title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noted(spark, sf_dir).select("doc_id", text.document_title(F.col("text")).alias("title"))


def _sentence_chunks_sql(source: str) -> str:
    """Chunks of a table's texts as out_: doc_id, n (paragraph), i (order in it), c (the chunk) and start."""
    return f"""
raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10) || chr(10))) AS r, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS n FROM {source}),
par AS (SELECT doc_id, n, {strip_sql("r")} AS p, sum(length(r) + 2) OVER (PARTITION BY doc_id ORDER BY n) - length(r) - 2 + strpos(r, {strip_sql("r")}) - 1 AS at_ FROM raw),
sen AS (SELECT *, list_filter(list_transform(CASE WHEN length(p) <= 500 THEN [p] ELSE regexp_extract_all(p, '[^。.]*[。.]|[^。.]+') END, lambda x: {strip_sql("x")}), lambda x: x <> '') AS s FROM par WHERE p <> ''),
f AS (SELECT doc_id, n, p, at_, s, 1 AS i, s[1] AS current, greatest(strpos(p, s[1]) - 1, 0) AS b, NULL::VARCHAR AS said, 0::BIGINT AS said_at FROM sen
  UNION ALL SELECT doc_id, n, p, at_, s, i + 1, CASE WHEN over_ THEN tail || ' ' || s[i + 1] ELSE current || ' ' || s[i + 1] END,
    CASE WHEN over_ THEN CASE WHEN k > 0 THEN from_ + k - 1 ELSE 0 END ELSE b END, CASE WHEN over_ THEN current END, b
  FROM (SELECT *, strpos(substring(p, from_ + 1), tail) AS k FROM (SELECT *, length(current) + length(s[i + 1]) + 1 > 500 AS over_, right(current, 100) AS tail, greatest(strpos(p, current) - 1, 0) AS from_ FROM f WHERE i < len(s)))),
out_ AS (SELECT doc_id, n, i, said AS c, at_ + said_at AS start FROM f WHERE said IS NOT NULL UNION ALL SELECT doc_id, n, i + 1, current, at_ + b FROM f WHERE i = len(s))
"""


@query(
    f"""WITH RECURSIVE {NOTED}, {_sentence_chunks_sql("noted")}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, i) AS INTEGER) AS piece, CAST(length({strip_sql("c")}) AS INTEGER) AS n_chars, CAST(start AS INTEGER) AS "start", CAST(start + length(c) AS INTEGER) AS "end", sha256({strip_sql("c")}) AS content_sha256 FROM out_ WHERE {strip_sql("c")} <> ''"""
)
def chunk_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by paragraph and sentence with their places."""
    pieces = chunking.explode_chunks(noted(spark, sf_dir), chunking.placed_by_paragraphs, placed=True)
    return pieces.select("doc_id", "piece", F.length("content").alias("n_chars"), "start", "end", text.sha256(F.col("content")).alias("content_sha256"))


def _after_sentence_sql(low: str, high: str) -> str:
    return f"({low} + length(regexp_extract(substring(t, {low} + 1, {high} - {low}), '(?s)^.*[。！？.!?\\n]')))"


@query(
    f"""WITH RECURSIVE w AS (SELECT doc_id, text AS t, length(text) AS n, 0::BIGINT AS b, 0::BIGINT AS e, 0 AS k FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, t, n, b2, CASE WHEN b2 + 512 >= n THEN n ELSE greatest({_after_sentence_sql("(b2 + 384)", "(b2 + 512)")}, b2 + 1) END, k + 1
  FROM (SELECT doc_id, t, n, k, CASE WHEN k = 0 THEN 0 WHEN e - 50 > b THEN greatest(b + 1, {_after_sentence_sql("greatest(0, e - 100)", "(e - 50)")}) ELSE e END AS b2 FROM w WHERE k = 0 OR e < n) WHERE b2 < n),
p AS (SELECT doc_id, k, {strip_sql("substring(t, b + 1, e - b)")} AS c FROM w WHERE k > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS piece, CAST(length(c) AS INTEGER) AS n_chars, sha256(c) AS content_sha256 FROM p WHERE c <> ''"""
)
def chunk_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = chunking.explode_chunks(documents(spark, sf_dir), chunking.by_window)
    return pieces.select("doc_id", "piece", F.length("content").alias("n_chars"), text.sha256(F.col("content")).alias("content_sha256"))


@query(
    f"""WITH {NOTED}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS r FROM noted), s AS (SELECT doc_id, {strip_sql("r")} AS x FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (x <> '' AND ({NUMBERED_SQL.format("x")} OR (length(x) BETWEEN 5 AND 100 AND NOT regexp_matches(x, '[。.；;]$') AND regexp_matches(x, '报告|公告|说明|摘要|目录|概述|总结')))) AS n_titles FROM s GROUP BY 1"""
)
def title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = noted(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return line.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(text.is_title_line(F.col("line"))).alias("n_titles"))


# Tables, made of the lines of an order


def _order_rows() -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("long").alias("q"))))
    return F.transform(ordered, lambda r: F.array(r["n"].cast("string"), r["p"].cast("string"), r["q"].cast("string")))


@query(
    """WITH t AS (SELECT l_orderkey, count(*) AS n, string_agg('| ' || l_linenumber || ' | ' || l_partkey || ' | ' || CAST(l_quantity AS BIGINT) || ' |', chr(10) ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS BIGINT)) AS body,
string_agg('["' || l_linenumber || '", "' || l_partkey || '", "' || CAST(l_quantity AS BIGINT) || '"]', ', ' ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS BIGINT)) AS cells FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(n + 1 AS INTEGER) AS row_count, sha256('| 序号 | 代码 | 数量 |' || chr(10) || '| --- | --- | --- |' || chr(10) || body) AS markdown_sha256,
sha256('{"col_count": 3, "data": [' || cells || '], "header": ["序号", "代码", "数量"], "row_count": ' || (n + 1) || '}') AS table_sha256 FROM t"""
)
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.array(*[F.lit(x) for x in ("序号", "代码", "数量")])
    made = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(tables.table_data(F.concat(F.array(header), _order_rows())).alias("t"))
    return made.select("l_orderkey", F.col("t.row_count").alias("row_count"), text.sha256(tables.markdown(F.col("t"))).alias("markdown_sha256"), tables.table_sha256(F.col("t")).alias("table_sha256"))


@query(
    """WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
k AS (SELECT *, n % 5 = 1 AS header, n % 5 <> 1 AND n % 7 = 0 AS wide FROM p),
c AS (SELECT *, last_value(CASE WHEN header THEN n WHEN wide THEN 0 END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS from_ FROM k),
i AS (SELECT *, coalesce(from_ > 0 AND NOT header AND NOT wide, FALSE) AS injected FROM c)
SELECT o_custkey, CAST(n AS INTEGER) AS page_no, injected, CASE WHEN header THEN '项目' || n || '|金额' WHEN injected THEN '项目' || from_ || '|金额' WHEN wide THEN o_orderkey || '|100|7' ELSE o_orderkey || '|100' END AS header,
CASE WHEN injected THEN o_orderkey || '|100' ELSE '' END AS first_row, CASE WHEN injected THEN 2 ELSE 1 END AS n_rows FROM i"""
)
def cross_page_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a table that goes on over pages: every fifth page has a header of its own, and every seventh one column more, which ends it; what each page has on top."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    row = F.array(F.col("o_orderkey").cast("string"), F.lit("100"))
    pages = table(spark, sf_dir, "orders").withColumn("page_no", F.row_number().over(w))
    own = F.array(F.concat(F.lit("项目"), F.col("page_no").cast("string")), F.lit("金额"))
    first = F.when(F.col("page_no") % 5 == 1, own).when(F.col("page_no") % 7 == 0, F.array_append(row, "7")).otherwise(row)
    carried = tables.carry_headers(pages.select(F.col("o_custkey").alias("doc_id"), "page_no", F.lit(1).alias("seq"), tables.table_data(F.array(first)).alias("table_data")))
    below = F.coalesce(F.array_join(F.get("table_data.data", F.lit(0)), "|"), F.lit(""))
    return carried.select(F.col("doc_id").alias("o_custkey"), "page_no", "injected", F.array_join("table_data.header", "|").alias("header"), below.alias("first_row"), F.col("table_data.row_count").alias("n_rows"))


_HEADER_SQL = "len(list_filter(cells, lambda c: regexp_matches(c, '" + "|".join(tables.HEADER_WORDS) + "'))) > 0 OR (len(list_filter(cells, lambda c: length(c) > 20)) = 0 AND len(list_filter(cells, lambda c: NOT regexp_matches(c, '^[\\p{Nd}.,%\\s\\-]+$'))) > 0 AND len(cells) >= 2)"


@query(
    f"""WITH b AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber * 100 + l_quantity AS INTEGER) AS seq, (l_partkey % 400)::DOUBLE AS top, (l_suppkey % 3)::DOUBLE AS left_,
  CASE l_partkey % 8 WHEN 0 THEN [l_partkey::VARCHAR, l_suppkey || ' %'] WHEN 1 THEN [l_returnflag, l_linestatus] WHEN 2 THEN [' 合计 ', l_partkey::VARCHAR] WHEN 3 THEN [repeat(l_returnflag, 21), l_partkey::VARCHAR, l_linestatus] WHEN 4 THEN [' ', NULL]
    WHEN 5 THEN [l_returnflag] WHEN 6 THEN [l_returnflag, repeat(l_linestatus || ' ', 15), '', l_suppkey || ',5', l_linestatus, l_returnflag] ELSE [CAST(l_shipdate AS DATE)::VARCHAR] END AS row_ FROM lineitem),
c AS (SELECT *, list_filter(list_transform(row_, lambda c: {strip_sql("coalesce(c, '')")}), lambda c: c <> '') AS cells FROM b),
h AS (SELECT *, len(cells) > 0 AND ({_HEADER_SQL}) AS header, len(list_filter(cells, lambda c: regexp_matches(c, '^[\\p{{Nd}}.,%\\s\\-]+$') OR length(c) > 20)) AS telling FROM c)
SELECT doc_id, seq, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY top, left_, seq) AS INTEGER) AS elem_no, header AS header_like, top < 180 AND (len(cells) = 0 OR (NOT header AND telling * 2 >= len(cells))) AS may_continue FROM h"""
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as tables on a page: their order by place, which begin with a header, and which may go on from the page before."""
    s = lambda c: F.col(c).cast("string")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    kinds = (
        F.array(s("l_partkey"), F.concat(s("l_suppkey"), F.lit(" %"))), F.array(flag, status), F.array(F.lit(" 合计 "), s("l_partkey")), F.array(F.repeat(flag, 21), s("l_partkey"), status), F.array(F.lit(" "), F.lit(None).cast("string")),
        F.array(flag), F.array(flag, F.repeat(F.concat(status, F.lit(" ")), 15), F.lit(""), F.concat(s("l_suppkey"), F.lit(",5")), status, flag), F.array(F.date_format("l_shipdate", "yyyy-MM-dd")),
    )
    first = F.get(F.array(*kinds), (F.col("l_partkey") % len(kinds)).cast("int"))
    place = [F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), (F.col("l_linenumber") * 100 + F.col("l_quantity")).cast("int").alias("seq"), (F.col("l_partkey") % 400).cast("double").alias("top"), (F.col("l_suppkey") % 3).cast("double").alias("left")]
    boxes = table(spark, sf_dir, "lineitem").select(*place, first.alias("first"))
    return tables.reading_order(boxes).select("doc_id", "seq", "elem_no", tables.is_header_like(F.col("first")).alias("header_like"), tables.may_continue(F.col("top"), F.col("first")).alias("may_continue"))


@query(
    f"""WITH RECURSIVE {_sentence_chunks_sql("documents")},
e AS (SELECT doc_id AS d, 1 AS elem_no, n, i, {strip_sql("c")} AS c FROM out_ WHERE {strip_sql("c")} <> ''
  UNION ALL SELECT doc_id, 2, 1, 1, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | ' || n_chars || ' |' FROM documents)
SELECT d // 10 AS doc_id, CAST(row_number() OVER (PARTITION BY d // 10 ORDER BY d % 10, elem_no, n, i) AS INTEGER) AS chunk_no, CASE elem_no WHEN 1 THEN 'text' ELSE 'table' END AS kind, sha256(c) AS content_sha256 FROM e"""
)
def chunk_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents as the text of a file's pages, each with a small table below it."""
    docs = documents(spark, sf_dir)
    place = [F.expr("doc_id div 10").alias("doc_id"), (F.col("doc_id") % 10).cast("int").alias("page_no")]
    table_text = F.concat(F.lit("| a | b |\n| --- | --- |\n| "), F.col("doc_id").cast("string"), F.lit(" | "), F.col("n_chars").cast("string"), F.lit(" |"))
    parts = docs.select(*place, F.lit(1).alias("elem_no"), F.lit("text").alias("kind"), F.col("text").alias("content")).unionByName(docs.select(*place, F.lit(2).alias("elem_no"), F.lit("table").alias("kind"), table_text.alias("content")))
    return chunking.chunk_elements(parts).select("doc_id", "chunk_no", "kind", text.sha256(F.col("content")).alias("content_sha256"))


@query(
    f"""WITH {CHUNKS}, t AS (SELECT tenant, sha256(content) AS h, min(chunk_id) AS table_id FROM chunks WHERE is_deleted OR chunk_id % 3 = 0 GROUP BY 1, 2)
SELECT c.chunk_id, t.table_id FROM chunks c LEFT JOIN t ON t.tenant = c.tenant AND t.h = sha256(c.content)"""
)
def table_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the stored table of equal content; every third document and the deleted ones are stored."""
    hashed = chunks(spark, sf_dir).withColumn("table_sha256", text.sha256(F.col("content")))
    stored = hashed.where("is_deleted or chunk_id % 3 = 0").select(F.col("chunk_id").alias("id"), "tenant", "table_sha256")
    return incremental.with_tables(hashed, stored).select("chunk_id", "table_id")


_NAMED = """
stored AS (SELECT page_id AS document_id, page_id % 3 AS tenant, CASE page_id % 2 WHEN 0 THEN 'a/' ELSE 'b\\' END || 'file' || (page_id % 50) || '.pdf' AS file_uri FROM pages),
asked AS (SELECT DISTINCT page_id % 3 AS tenant, 'file' || (page_id % 50) || '.pdf' AS file_name FROM pages WHERE page_id % 4 = 0),
same AS (SELECT a.tenant, a.file_name, min(s.document_id) AS document_id FROM asked a JOIN stored s ON s.tenant = a.tenant AND regexp_extract(s.file_uri, '[^/\\\\]*$') = a.file_name GROUP BY 1, 2)
"""


def _stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    uri = F.concat(F.when(n % 2 == 0, "a/").otherwise("b\\"), F.lit("file"), (n % 50).cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "pages").select(n.alias("document_id"), (n % 3).alias("tenant"), uri.alias("file_uri"))


@query(f"WITH {_NAMED} SELECT * FROM same")
def find_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest stored page of each name that every fourth page asks for, within its tenant."""
    n = F.col("page_id")
    names = table(spark, sf_dir, "pages").where(n % 4 == 0).select((n % 3).alias("tenant"), F.concat(F.lit("file"), (n % 50).cast("string"), F.lit(".pdf")).alias("file_name"))
    return incremental.by_file_name(_stored_files(spark, sf_dir), names)


@query(
    f"""WITH {_NAMED}, left_ AS (SELECT * FROM stored WHERE document_id NOT IN (SELECT document_id FROM same))
SELECT 'document' AS kind, document_id AS id, tenant, 'annual_report' AS doc_type, 'upload' AS source, 'faiss_' || document_id AS vector_id FROM left_
UNION ALL SELECT 'chunk', document_id * 2 + i, NULL, NULL, NULL, NULL FROM left_, range(2) r(i) UNION ALL SELECT 'vector', document_id * 2 + i, NULL, NULL, NULL, NULL FROM left_, range(2) r(i)"""
)
def overwrite_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of documents, chunks and vectors when every fourth page comes again, with the defaults of a document."""
    stored = _stored_files(spark, sf_dir)
    pieces = stored.select("document_id", F.explode(F.array(F.col("document_id") * 2, F.col("document_id") * 2 + 1)).alias("chunk_id"))
    left = incremental.overwrite({"documents": stored, "chunks": pieces, "embeddings": pieces.select("chunk_id")}, stored.where(F.col("document_id") % 4 == 0))
    full = incremental.with_document_defaults(left["documents"]).select(F.lit("document").alias("kind"), F.col("document_id").alias("id"), "tenant", "doc_type", "source", incremental.vector_id("faiss", F.col("document_id")).alias("vector_id"))
    return reduce(lambda a, b: a.unionByName(b, True), [full, *[left[t].select(F.lit(k).alias("kind"), F.col("chunk_id").alias("id")) for k, t in (("chunk", "chunks"), ("vector", "embeddings"))]])


# Retrieval

TOKENS = "list_filter(regexp_extract_all({0}, '[一-龥]+|[a-zA-Z]+|\\p{{Nd}}+'), lambda t: length(t) > 1)"
BM25 = f"""
tok AS (SELECT chunk_id, unnest({TOKENS.format("content")}) AS term FROM chunks WHERE NOT is_deleted),
tfs AS (SELECT chunk_id, term, count(*) AS tf, CAST(sum(count(*)) OVER (PARTITION BY chunk_id) AS BIGINT) AS dl FROM tok GROUP BY 1, 2),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT chunk_id, dl FROM tfs)),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM stats) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM tfs GROUP BY 1),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM stats)))), 9) AS score FROM qt JOIN idf USING (term) JOIN tfs USING (term) GROUP BY 1, 2),
worded AS (SELECT * FROM (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sc WHERE score > 0) WHERE rank <= {K})
"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a question, with the vector of its id and the years it asks for."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    asked = F.when(F.col("query_id") % 3 != 0, F.array((2020 + F.col("query_id") % 5).cast("int"))).otherwise(F.array().cast("array<int>"))
    return items.join(vectors, "query_id", "left").withColumn("years", asked)


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def _with_odd(vectors: DataFrame) -> DataFrame:
    """As many vectors again that can't be searched: empty ones, short ones, and ones with a null or no finite number."""
    n = F.col("chunk_id") % 4
    short = F.when(n == 0, F.array().cast("array<float>")).when(n == 1, F.slice("vector", 1, 3))
    odd = short.otherwise(F.transform("vector", lambda x: F.when(x > 0, x).when(n == 3, float("nan")).cast("float")))
    return vectors.unionByName(vectors.select((-F.col("chunk_id") - 1).alias("chunk_id"), odd.alias("vector")))


def _live_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.postings(retrieval.live(chunks(spark, sf_dir)))


@query(f"WITH {CHUNKS}, {BM25} SELECT chunk_id, term, tf, dl FROM tfs")
def bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live_postings(spark, sf_dir)


@query(f"WITH {CHUNKS}, {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _live_postings(spark, sf_dir)
    return retrieval.term_idf(posts, retrieval.corpus_stats(posts).first()["n"]).select("term", "df", F.round("idf", 6).alias("idf"))


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(retrieval.live(chunks(spark, sf_dir)), questions(spark, sf_dir), K)


@query(f"WITH {CHUNKS}, {BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM worded")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worded(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


KNN = f"""
pairs AS (SELECT b.item_id AS query_id, c.vec_id AS chunk_id, list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE) AS a, c.embedding AS b
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings c),
l2 AS (SELECT query_id, chunk_id, round(list_sum(list_transform(range(1, 65), lambda i: pow(a[i] - b[i]::DOUBLE, 2))), 9) AS distance FROM pairs),
cosine AS (SELECT query_id, chunk_id, round(list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i]::DOUBLE)) / (sqrt(list_sum(list_transform(range(1, 65), lambda i: a[i] * a[i]))) * sqrt(list_sum(list_transform(range(1, 65), lambda i: b[i]::DOUBLE * b[i]::DOUBLE)))), 9) AS distance FROM pairs)
"""


@query(
    f"""WITH {KNN} SELECT query_id, chunk_id, round(1 / (1 + distance), 6) AS score, rank FROM
(SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS rank FROM l2) WHERE rank <= {K}"""
)
def knn_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.knn(_with_odd(vectors_of(spark, sf_dir)), questions(spark, sf_dir), K).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {KNN} SELECT query_id, chunk_id, round(distance, 6) AS score, rank FROM
(SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance DESC, chunk_id) AS INTEGER) AS rank FROM cosine) WHERE rank <= {K}"""
)
def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.knn(_with_odd(vectors_of(spark, sf_dir)), questions(spark, sf_dir), K, "cosine").select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


HITS = f"""
near AS (SELECT query_id, chunk_id, round(1 / (1 + distance), 9) AS score, rank FROM
  (SELECT l2.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, l2.chunk_id) AS INTEGER) AS rank FROM l2 JOIN chunks c ON c.chunk_id = l2.chunk_id WHERE NOT c.is_deleted) WHERE rank <= {K}),
hits AS (SELECT query_id, 'vector' AS route, 1 AS r, chunk_id, score, rank FROM near UNION ALL SELECT query_id, 'keyword', 2, chunk_id, score, rank FROM worded),
asked AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 <> 0 THEN [CAST(2020 + item_id % 5 AS INTEGER)] ELSE [] END AS years FROM benchmark),
marked AS (SELECT h.*, len(a.years) = 0 AS unasked, coalesce(c.year IS NULL OR list_contains(a.years, c.year) OR len(list_filter(a.years, lambda y: contains(c.content, CAST(y AS VARCHAR)))) > 0, FALSE) AS allowed
  FROM hits h JOIN chunks c USING (chunk_id) LEFT JOIN asked a USING (query_id)),
counted AS (SELECT *, (SELECT count(DISTINCT m.chunk_id) FROM marked m WHERE m.query_id = marked.query_id AND m.allowed) AS n FROM marked)
"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = retrieval.live(chunks(spark, sf_dir))
    known = vectors_of(spark, sf_dir).join(kept.select("chunk_id"), "chunk_id", "left_semi")
    near = retrieval.knn(known, questions(spark, sf_dir), K).select("query_id", F.lit("vector").alias("route"), "chunk_id", "score", "rank")
    return near.unionByName(_worded(spark, sf_dir).select("query_id", F.lit("keyword").alias("route"), "chunk_id", "score", "rank"))


def _years_kept(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    kept = retrieval.year_filter(_hits(spark, sf_dir), chunks(spark, sf_dir), questions(spark, sf_dir).select("query_id", "years"), least)
    return kept.select("query_id", "route", "chunk_id", "rank")


@query(f"WITH {CHUNKS}, {BM25}, {KNN}, {HITS} SELECT query_id, route, chunk_id, rank FROM marked WHERE unasked OR allowed")
def year_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _years_kept(spark, sf_dir, 0)


@query(f"WITH {CHUNKS}, {BM25}, {KNN}, {HITS} SELECT query_id, route, chunk_id, rank FROM counted WHERE unasked OR allowed OR n < 3")
def year_filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _years_kept(spark, sf_dir, DEFAULT.retrieval.min_year_hits)


def _rrf_sql(source: str) -> str:
    return f"""
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY rank, chunk_id) AS place FROM ({source})),
fused0 AS (SELECT query_id, chunk_id, round(sum(CASE WHEN r = 1 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END / (60 + place)), 9) AS f, arg_min(score, r * 1000000 + place) AS score, min(r * 1000000 + place) AS first, min(r) AS low, max(r) AS high FROM placed GROUP BY 1, 2),
fused1 AS (SELECT *, CASE WHEN min(low) OVER (PARTITION BY query_id) <> max(high) OVER (PARTITION BY query_id) THEN f END AS rrf_score FROM fused0),
fused AS (SELECT query_id, chunk_id, score, rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC NULLS LAST, first) AS INTEGER) AS rank FROM fused1)
"""


@query(f"WITH {CHUNKS}, {BM25}, {KNN}, {HITS}, {_rrf_sql('SELECT * FROM hits')} SELECT query_id, chunk_id, round(score, 6) AS score, round(rrf_score, 6) AS rrf_score, rank FROM fused")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = retrieval.weighted_rrf(_hits(spark, sf_dir))
    return fused.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.round("rrf_score", 6).alias("rrf_score"), "rank")


@query(
    f"""WITH {CHUNKS}, {BM25}, {KNN}, {HITS}, placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY rank, chunk_id) AS place FROM hits),
f AS (SELECT query_id, chunk_id, round(sum(1 / (60 + place)::DOUBLE), 9) AS s, min(CASE WHEN route = 'keyword' THEN 0 ELSE 1000000 END + place) AS first FROM placed GROUP BY 1, 2)
SELECT query_id, chunk_id, round(s, 6) AS rrf_score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first) AS INTEGER) AS rank FROM f) WHERE rank <= {K}"""
)
def rrf_multi_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.multi_route_rrf(_hits(spark, sf_dir), K).select("query_id", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"), "rank")


@query(
    f"""WITH {CHUNKS}, {BM25}, {KNN}, {HITS}, {_rrf_sql('SELECT * FROM counted WHERE unasked OR allowed OR n < 3')}
SELECT f.query_id, f.rank, f.chunk_id, c.document_id, c.year, round(f.score, 6) AS score, round(f.rrf_score, 6) AS rrf_score, substring(c.content, 1, 200) AS preview
FROM fused f JOIN chunks c USING (chunk_id) WHERE f.rank <= {DEFAULT.retrieval.top_k}"""
)
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid(chunks(spark, sf_dir), vectors_of(spark, sf_dir), questions(spark, sf_dir))


_HYDRATE = "SELECT e.vec_id AS chunk_id, c.document_id, substring(c.content, 1, 200) AS preview FROM embeddings e {0} JOIN (SELECT * FROM chunks WHERE NOT is_deleted) c ON c.chunk_id = e.vec_id"


def _vector_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors_of(spark, sf_dir).select("chunk_id")


@query(f"WITH {CHUNKS} {_HYDRATE.format('LEFT')}")
def hydrate_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hydrate(_vector_ids(spark, sf_dir), retrieval.live(chunks(spark, sf_dir)), "left").select("chunk_id", "document_id", "preview")


@query(f"WITH {CHUNKS} {_HYDRATE.format('')}")
def hydrate_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hydrate(_vector_ids(spark, sf_dir), retrieval.live(chunks(spark, sf_dir))).select("chunk_id", "document_id", "preview")


@query(f"WITH {CHUNKS} SELECT chunk_id, document_id, year FROM chunks WHERE NOT is_deleted AND chunk_id IN (SELECT vec_id FROM embeddings)")
def hydrate_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.live(chunks(spark, sf_dir)).join(_vector_ids(spark, sf_dir), "chunk_id", "left_semi").select("chunk_id", "document_id", "year")


@query(f"WITH {CHUNKS}, {BM25}, {KNN}, {HITS} SELECT DISTINCT query_id, chunk_id FROM hits")
def set_ops_route_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "chunk_id").distinct()


@query(
    f"""WITH {CHUNKS}, {BM25}, {KNN}, {HITS} SELECT query_id, route, count(*) AS hits, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 6) AS avg_score FROM hits GROUP BY 1, 2"""
)
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.score_distribution(_hits(spark, sf_dir), ("query_id", "route"))


# Answers


@query(
    f"""WITH {CHUNKS}, p AS (SELECT *, CASE WHEN page_end <> 0 THEN page_end ELSE page_start END AS e FROM chunks),
m AS (SELECT *, max(e) OVER (PARTITION BY document_id ORDER BY page_start, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR page_start > b + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY page_start, chunk_id) AS island FROM m)
SELECT document_id, CAST(island AS INTEGER) AS island, string_agg(chunk_id, ',' ORDER BY page_start, chunk_id) AS chunk_ids, sha256(string_agg(content, chr(10) || chr(10) ORDER BY page_start, chunk_id)) AS content_sha256 FROM i GROUP BY 1, 2"""
)
def adjacent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = answers.merge_adjacent(chunks(spark, sf_dir))
    return merged.select("document_id", "island", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"), text.sha256(F.col("content")).alias("content_sha256"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers: two of three cite chunks, one kind twice, some a number that is no id or one in full-width digits, and every fifth refuses."""
    turns = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") + F.col("turn")
    cite = F.when(n % 3 == 1, F.concat(F.lit(" [Chunk "), F.col("conv_id").cast("string"), F.lit("]"))).when(n % 3 == 2, F.concat(F.lit("[chunk  "), n.cast("string"), F.lit("][Chunk "), n.cast("string"), F.lit("]"))).otherwise("")
    odd = F.when(n % 7 == 0, "[Chunk 99999999999999999999]").when(n % 7 == 1, "[CHUNK １２]").otherwise("")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.concat("text", cite, odd, F.when(n % 5 == 0, "无法确定").otherwise("")).alias("answer"))


ANSWERS = """
answers AS (SELECT conv_id * 1000 + turn AS request_id, text || CASE (conv_id + turn) % 3 WHEN 1 THEN ' [Chunk ' || conv_id || ']' WHEN 2 THEN '[chunk  ' || (conv_id + turn) || '][Chunk ' || (conv_id + turn) || ']' ELSE '' END
  || CASE (conv_id + turn) % 7 WHEN 0 THEN '[Chunk 99999999999999999999]' WHEN 1 THEN '[CHUNK １２]' ELSE '' END || CASE WHEN (conv_id + turn) % 5 = 0 THEN '无法确定' ELSE '' END AS answer FROM conversations),
ids AS (SELECT request_id, answer, list_transform(regexp_extract_all(answer, '(?i)\\[Chunk\\s+(\\p{Nd}+)\\]', 1), lambda x: TRY_CAST(translate(x, '０１２３４５６７８９', '0123456789') AS BIGINT)) AS cited FROM answers)
"""


@query(f"WITH {ANSWERS} SELECT * FROM (SELECT request_id, CAST(generate_subscripts(cited, 1) AS INTEGER) AS rank_no, unnest(cited) AS chunk_id FROM ids) WHERE chunk_id IS NOT NULL")
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("request_id", F.posexplode(policy.citations(F.col("answer"))).alias("pos", "chunk_id")).where("chunk_id is not null").select("request_id", (F.col("pos") + 1).alias("rank_no"), "chunk_id")


@query(
    f"""WITH {CHUNKS}, {ANSWERS}, u AS (SELECT request_id, CAST(generate_subscripts(cited, 1) AS INTEGER) AS rank_no, unnest(cited) AS chunk_id FROM ids)
SELECT u.*, substring(c.content, 1, 200) AS quote FROM u JOIN chunks c USING (chunk_id)"""
)
def citation_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.cited(_answers(spark, sf_dir), chunks(spark, sf_dir))


@query(
    f"""WITH {ANSWERS}, c AS (SELECT *, round(greatest(0, least(1, 0.5::DOUBLE + CASE WHEN len(cited) > 0 THEN 0.3::DOUBLE + least(len(cited) * 0.05::DOUBLE, 0.15::DOUBLE) ELSE -0.2::DOUBLE END
  + CASE WHEN length(trim(answer)) < 10 THEN -0.3::DOUBLE WHEN length(trim(answer)) > 50 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(answer, '无法|不知道|没有找到|未找到|不清楚|无法确定') THEN -0.2::DOUBLE ELSE 0 END)), 6) AS confidence FROM ids)
SELECT request_id, confidence, trim(answer) = '' OR confidence < 0.6 OR len(cited) = 0 AS is_refused FROM c"""
)
def confidence_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("request_id", policy.confidence(F.col("answer")).alias("confidence"), policy.is_refused(F.col("answer")).alias("is_refused"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("conv_id") + F.col("turn")
    word = F.when(n % 4 == 0, " 请总结").when(n % 4 == 1, " 同比是多少").when(n % 4 == 2, " 2023 增长的汇总，2021 与 2023").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat("text", word).alias("query"))


ASKED = """
asked0 AS (SELECT conv_id, turn, role, text || CASE (conv_id + turn) % 4 WHEN 0 THEN ' 请总结' WHEN 1 THEN ' 同比是多少' WHEN 2 THEN ' 2023 增长的汇总，2021 与 2023' ELSE '' END AS query FROM conversations)
"""
INTENT_SQL = "CASE WHEN regexp_matches(query, '报表|总结|汇总|概括|核心观点|主要内容|奋斗') THEN 'SUMMARY' WHEN regexp_matches(query, '增长|同期|比例|谁更多|差值|计算|同比|环比') THEN 'CALC' ELSE 'FACT' END"


@query(f"WITH {ASKED} SELECT conv_id, turn, {INTENT_SQL} AS intent FROM asked0")
def intent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", policy.intent(F.col("query")).alias("intent"))


@query(
    f"""WITH r AS (SELECT conv_id, turn, CASE (conv_id + turn) % 8 WHEN 0 THEN ' calc ' || text WHEN 1 THEN text || chr(10) || 'Summary' WHEN 2 THEN text WHEN 3 THEN 'factual: ' || text || ' calc' WHEN 4 THEN substring(text, 1, 30) || ' CALC or fact ' || text WHEN 5 THEN 'Summary.' WHEN 6 THEN text || ' xCALC' ELSE '' END AS raw FROM conversations),
u AS (SELECT conv_id, turn, upper({strip_sql("raw")}) AS t FROM r), w AS (SELECT *, regexp_split_to_array(t, '\\s+') AS ws FROM u)
SELECT conv_id, turn, CASE WHEN ws[1] IN ('FACT', 'CALC', 'SUMMARY') THEN ws[1] WHEN starts_with(t, 'FACT') OR list_contains(ws, 'FACT') THEN 'FACT' WHEN starts_with(t, 'CALC') OR list_contains(ws, 'CALC') THEN 'CALC' WHEN starts_with(t, 'SUMMARY') OR list_contains(ws, 'SUMMARY') THEN 'SUMMARY' ELSE 'FACT' END AS intent FROM w"""
)
def intent_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents that a model names first, last, in between, as part of a word, or not at all, among the texts of turns."""
    n, lit = (F.col("conv_id") + F.col("turn")) % 8, F.lit
    said = F.when(n == 0, F.concat(lit(" calc "), "text")).when(n == 1, F.concat("text", lit("\nSummary"))).when(n == 2, F.col("text")).when(n == 3, F.concat(lit("factual: "), "text", lit(" calc")))
    said = said.when(n == 4, F.concat(F.substring("text", 1, 30), lit(" CALC or fact "), "text")).when(n == 5, "Summary.").when(n == 6, F.concat("text", lit(" xCALC"))).otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", policy.parse_intent(said).alias("intent"))


@query(
    """WITH y AS (SELECT o_custkey, year(o_orderdate) AS year, count(*)::DOUBLE AS a FROM orders GROUP BY 1, 2),
p AS (SELECT *, lag(a) OVER (PARTITION BY o_custkey ORDER BY year) AS b FROM y)
SELECT o_custkey, year, op, round(CASE op WHEN 'growth' THEN (a - b) / b WHEN 'diff' THEN a - b ELSE a / b END, 6) AS result,
CASE op WHEN 'growth' THEN format('({} - {}) / {} = {:.2f}%', a::BIGINT, b::BIGINT, b::BIGINT, (a - b) / b * 100) WHEN 'diff' THEN format('{} - {} = {}', a::BIGINT, b::BIGINT, (a - b)::BIGINT) ELSE format('{} / {} = {:.2f}%', a::BIGINT, b::BIGINT, a / b * 100) END AS formula
FROM p CROSS JOIN (VALUES ('growth'), ('diff'), ('ratio')) o(op) WHERE b IS NOT NULL"""
)
def calc_growth_diff_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders of a year against the year before."""
    yearly = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").cast("double").alias("a"))
    pairs = yearly.withColumn("b", F.lag("a").over(Window.partitionBy("o_custkey").orderBy("year"))).where("b is not null")
    asked = pairs.withColumn("op", F.explode(F.array(*[F.lit(x) for x in ("growth", "diff", "ratio")])))
    return answers.formulas(asked).select("o_custkey", "year", "op", F.round("result", 6).alias("result"), "formula")


@query(
    f"""WITH {ASKED}, g AS (SELECT *, CASE turn % 5 WHEN 0 THEN [] WHEN 1 THEN [query] WHEN 2 THEN ['a'] WHEN 3 THEN ['a', query] ELSE ['a', 'b', 'c', 'd'] END AS given FROM asked0),
f AS (SELECT *, CASE WHEN len(given) = 0 THEN [query] ELSE given END AS first FROM g),
w AS (SELECT *, CASE WHEN list_contains(first, query) THEN first ELSE list_append(first, query) END AS with_query FROM f),
r AS (SELECT conv_id, turn, (CASE WHEN len(first) >= 3 THEN first WHEN len(with_query) < 3 THEN list_append(with_query, query || ' 详细信息') ELSE with_query END)[1:3] AS all_ FROM w)
SELECT conv_id, turn, CAST(generate_subscripts(all_, 1) - 1 AS INTEGER) AS route, unnest(all_) AS route_query FROM r"""
)
def rewrite_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = lambda *x: F.array(*[F.lit(y) for y in x])
    turn = F.col("turn") % 5
    given = F.when(turn == 0, F.array().cast("array<string>")).when(turn == 1, F.array("query")).when(turn == 2, lit("a")).when(turn == 3, F.array(F.lit("a"), F.col("query"))).otherwise(lit("a", "b", "c", "d"))
    return answers.fan_out(_asked(spark, sf_dir).withColumn("given", given)).select("conv_id", "turn", "route", "route_query")


@query(f"WITH {ASKED}, y AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(query, '(?:19|20)[0-9]{{2}}')) AS ys FROM asked0) SELECT conv_id, turn, CAST(unnest(ys) AS INTEGER) AS year FROM y")
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", F.explode(text.years(F.col("query"))).alias("year"))


# Sessions, requests and events


def _turn_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.when(F.col("turn") % 2 == 0, (2020 + (F.col("conv_id") + F.col("turn")) % 5).cast("string")).otherwise(" ")
    dept = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit(" "), F.col("role"))).otherwise("")
    slots = F.create_map(F.lit("date"), year, F.lit("dept"), dept, F.lit("other"), F.lit("x"))
    return table(spark, sf_dir, "conversations").withColumn("slots", slots)


_SLOTS = """
s AS (SELECT conv_id, turn, 'date' AS slot, CASE WHEN turn % 2 = 0 THEN CAST(2020 + (conv_id + turn) % 5 AS VARCHAR) ELSE '' END AS value FROM conversations
  UNION ALL SELECT conv_id, turn, 'dept', CASE WHEN conv_id % 3 <> 0 THEN role ELSE '' END FROM conversations),
merged AS (SELECT conv_id, slot, arg_max(value, turn) AS value FROM s WHERE value <> '' GROUP BY 1, 2)
"""


@query(f"WITH {_SLOTS} SELECT conv_id, slot, value FROM merged")
def slot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.merge_slots(_turn_slots(spark, sf_dir), "conv_id", "turn", "slots")


@query(
    f"""WITH {_SLOTS}, c AS (SELECT DISTINCT conv_id FROM conversations), h AS (SELECT c.conv_id, d.value AS year, p.value AS dept FROM c LEFT JOIN merged d ON d.conv_id = c.conv_id AND d.slot = 'date' LEFT JOIN merged p ON p.conv_id = c.conv_id AND p.slot = 'dept')
SELECT conv_id, concat_ws(',', CASE WHEN year IS NULL THEN 'year' END, CASE WHEN dept IS NULL THEN 'dept' END) AS missing,
CASE WHEN year IS NULL THEN '请问您要查询哪一年（年份）？' WHEN dept IS NULL THEN '请问您要查询哪个部门？' END AS question FROM h"""
)
def slot_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a summary still has to ask for, per session; a date stands in for the year."""
    turns = _turn_slots(spark, sf_dir)
    merged = state.merge_slots(turns, "conv_id", "turn", "slots").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("slots"))
    sessions = turns.select("conv_id").distinct().join(merged, "conv_id", "left").withColumn("slots", F.coalesce("slots", F.create_map().cast("map<string,string>")))
    return state.missing(sessions, F.lit("SUMMARY"), F.col("slots")).select("conv_id", F.array_join("missing", ",").alias("missing"), "question")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.history_tail(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


@query(
    """WITH k AS (SELECT event_id, ts, event_type <> 'error' AS ok, sha256(user_id || '|' || CASE event_type WHEN 'error' THEN 'click' ELSE event_type END) AS task_id FROM events)
SELECT event_id, task_id, CASE WHEN coalesce(max(ok::INT) OVER (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'cached' ELSE 'run' END AS action FROM k"""
)
def idempotency_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as requests, an error being a click that failed."""
    asked = F.when(F.col("event_type") == "error", "click").otherwise(F.col("event_type"))
    out = state.replay(table(spark, sf_dir, "events"), policy.task_id(F.col("user_id"), asked), ("ts", "event_id"), F.col("event_type") != "error")
    return out.select("event_id", "task_id", "action")


@query(
    """WITH k AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
SELECT event_id, user_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id)::BIGINT AS streak FROM k"""
)
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.failure_streaks(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), F.col("event_type") == "error").select("event_id", "user_id", "streak")


@query(
    """WITH RECURSIVE u AS (SELECT user_id, list({'id': event_id, 'at_': epoch_ms(ts) / 1000.0, 'bad': event_type IN ('click', 'error')} ORDER BY ts, event_id) AS l FROM events GROUP BY 1),
f AS (SELECT user_id, l, 0::BIGINT AS i, 0 AS failures, -1.0::DOUBLE AS opened, 'CLOSED' AS mode, NULL::BOOLEAN AS allowed FROM u
  UNION ALL SELECT user_id, l, i + 1, CASE WHEN NOT pass THEN failures WHEN bad THEN failures + 1 ELSE 0 END, CASE WHEN pass AND bad AND failures + 1 >= 5 THEN at_ ELSE opened END,
    CASE WHEN NOT pass THEN mode WHEN NOT bad THEN 'CLOSED' WHEN failures + 1 >= 5 THEN 'OPEN' WHEN mode = 'OPEN' THEN 'HALF_OPEN' ELSE mode END, pass
  FROM (SELECT *, l[i + 1].at_::DOUBLE AS at_, l[i + 1].bad AS bad, NOT (mode = 'OPEN' AND l[i + 1].at_::DOUBLE - opened < 60) AS pass FROM f WHERE i < len(l)))
SELECT l[i].id AS event_id, user_id, allowed, mode AS state FROM f WHERE i > 0"""
)
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's calls through a breaker; clicks and errors fail."""
    calls = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    out = state.breaker(calls, "user_id", ("ts", "event_id"), F.unix_millis(F.col("ts").cast("timestamp")) / 1000.0, F.col("event_type").isin("click", "error"))
    return out.select("event_id", "user_id", "allowed", "state")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "error", F.when(k % 4 == 0, 429).when(k % 4 == 1, 500 + k).when(k % 4 == 2, 404))
    error = F.when((F.col("event_type") == "error") & (k % 4 == 3), F.when(k % 8 == 3, "timeout").otherwise("parse"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type", status.cast("int").alias("status"), error.alias("error"))


CALLS = """
k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
calls AS (SELECT event_id, user_id, ts, value, event_type, CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN 429 WHEN 1 THEN 500 + k WHEN 2 THEN 404 END END AS status,
  CASE WHEN event_type = 'error' AND k % 4 = 3 THEN CASE WHEN k % 8 = 3 THEN 'timeout' ELSE 'parse' END END AS error FROM k),
kinds AS (SELECT *, CASE WHEN error = 'timeout' THEN 'timeout' WHEN status = 429 THEN 'rate_limit' WHEN status BETWEEN 500 AND 599 THEN '5xx' WHEN error = 'parse' THEN 'parse_error' ELSE 'fallback' END AS kind,
  coalesce(error = 'timeout', FALSE) OR coalesce(status = 429 OR status BETWEEN 500 AND 599, FALSE) AS retryable FROM calls)
"""


@query(f"WITH {CALLS} SELECT event_id, kind, retryable FROM kinds WHERE event_type = 'error'")
def event_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _calls(spark, sf_dir).where("event_type = 'error'")
    return failed.select("event_id", policy.error_kind(F.col("error"), F.col("status")).alias("kind"), policy.is_retryable(F.col("error"), F.col("status")).alias("retryable"))


@query(f"WITH {CALLS} SELECT user_id, CASE WHEN event_type = 'error' THEN kind ELSE 'ok' END AS kind, count(*) AS n, count(*) FILTER (retryable) AS n_retryable, min(ts) AS first_ts, max(ts) AS last_ts FROM kinds GROUP BY 1, 2")
def model_event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", policy.error_kind(F.col("error"), F.col("status"))).otherwise("ok").alias("kind")
    calls = _calls(spark, sf_dir).withColumn("retryable", policy.is_retryable(F.col("error"), F.col("status")))
    return calls.groupBy("user_id", kind).agg(F.count("*").alias("n"), F.count_if("retryable").alias("n_retryable"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    """WITH k AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
s AS (SELECT event_id, event_type, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS attempt FROM k)
SELECT event_id, attempt::BIGINT AS attempt, least(pow(2.0, attempt - 1), 10.0)::DOUBLE AS wait FROM s WHERE event_type = 'error'"""
)
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long to wait after each failure in a row, without jitter."""
    streaks = state.failure_streaks(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), F.col("event_type") == "error").where("event_type = 'error'")
    return streaks.select("event_id", F.col("streak").alias("attempt"), policy.backoff(F.col("streak")).alias("wait"))


@query(
    """SELECT user_id, event_type, count(*) AS n, sum(cast(round(value * 1000) AS BIGINT))::BIGINT AS total_ms, min(cast(round(value * 1000) AS BIGINT)) AS min_ms, max(cast(round(value * 1000) AS BIGINT)) AS max_ms FROM events GROUP BY 1, 2"""
)
def qa_latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.round(F.col("value") * 1000).cast("long")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(ms).alias("total_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"))


@query("SELECT event_id, user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def audit_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each request: an append-only log seen as if it were updated in place."""
    events = table(spark, sf_dir, "events")
    return sinks.latest(events, ("user_id", "event_type"), F.struct("ts", "event_id")).select("event_id", "user_id", "event_type", "ts")


@query(
    f"""WITH {CHUNKS} SELECT tenant, 'vector' AS index_type, '{{"chunk_overlap":"100","chunk_size":"500"}}' AS params, count(DISTINCT document_id) AS doc_count, count(*) AS chunk_count, 'success' AS status FROM chunks WHERE NOT is_deleted GROUP BY tenant"""
)
def index_build_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = DEFAULT.chunking
    return sinks.index_build_log(retrieval.live(chunks(spark, sf_dir)), "vector", {"chunk_size": str(size.size), "chunk_overlap": str(size.overlap)})


# Models: what they are given, what they say, and what users are told


@query(
    f"""WITH {CHUNKS}, p AS (SELECT *, CASE WHEN page_end <> 0 THEN page_end ELSE page_start END AS e FROM chunks),
m AS (SELECT *, max(e) OVER (PARTITION BY document_id ORDER BY page_start, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR page_start > b + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY page_start, chunk_id) AS island FROM m),
g AS (SELECT document_id, island, string_agg('[Chunk ' || chunk_id || ']', ' ' ORDER BY page_start, chunk_id) || chr(10) || string_agg(content, chr(10) || chr(10) ORDER BY page_start, chunk_id) AS t FROM i GROUP BY 1, 2),
c AS (SELECT document_id // 3 AS request_id, string_agg(t, chr(10) || chr(10) ORDER BY document_id, island) AS context FROM g GROUP BY 1)
SELECT request_id, sha256(context) AS context_sha256, sha256('【参考资料】' || chr(10) || context || chr(10) || chr(10) || '【用户问题】' || chr(10) || 'question ' || request_id) AS prompt_sha256 FROM c"""
)
def summary_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents as the context of a question, and the prompt made of both."""
    merged = answers.merge_adjacent(chunks(spark, sf_dir)).withColumn("request_id", F.expr("document_id div 3"))
    context = answers.contexts(merged, ("request_id",))
    prompt = providers.filled_prompt(providers.SUMMARY_PROMPT, context=F.col("context"), query=F.concat(F.lit("question "), F.col("request_id").cast("string")))
    return context.select("request_id", text.sha256(F.col("context")).alias("context_sha256"), text.sha256(prompt).alias("prompt_sha256"))


_FENCED_SQL = "CASE WHEN regexp_extract(raw, '(?is)```(?:json)?\\s*(.*?)\\s*```', 1) <> '' THEN regexp_extract(raw, '(?is)```(?:json)?\\s*(.*?)\\s*```', 1) ELSE trim(raw, ' ' || chr(10) || chr(9) || chr(13)) END"


def _reply(n: Column, body: Column, said: Column) -> Column:
    """A model's reply: fenced in three ways, bare, cut off, with words around it, or words alone."""
    lit = F.lit
    fenced = F.when(n % 7 == 0, F.concat(lit("```json\n"), body, lit("\n```"))).when(n % 7 == 1, F.concat(lit("Here:\n```\n"), body, lit("\n``` as asked"))).when(n % 7 == 2, F.concat(lit("```JSON"), body, lit("```")))
    return fenced.when(n % 7 == 3, F.concat(lit(" \n"), body, lit("\n"))).when(n % 7 == 4, F.substring(body, 1, 30)).when(n % 7 == 5, body).otherwise(said)


def _reply_sql(n: str, body: str, said: str) -> str:
    return f"""CASE {n} % 7 WHEN 0 THEN '```json' || chr(10) || {body} || chr(10) || '```' WHEN 1 THEN 'Here:' || chr(10) || '```' || chr(10) || {body} || chr(10) || '``` as asked' WHEN 2 THEN '```JSON' || {body} || '```'
  WHEN 3 THEN ' ' || chr(10) || {body} || chr(10) WHEN 4 THEN substring({body}, 1, 30) WHEN 5 THEN {body} ELSE {said} END"""


@query(
    f"""WITH s AS (SELECT conv_id, turn, conv_id * 2 + turn AS n, text, CASE turn % 3 WHEN 0 THEN ['product', 'date'] WHEN 1 THEN ['year', 'dept'] ELSE [] END AS names FROM conversations),
b AS (SELECT *, '{{"date": ' || to_json(substring(text, 1, 12)) || ', "year": ' || (2000 + n % 30) || ', "dept": ' || CASE n % 3 WHEN 0 THEN '"  "' WHEN 1 THEN 'null' ELSE to_json(' ' || substring(text, 3, 9) || chr(10)) END || ', "product": ' || to_json(text) || ', "other": "x"}}' AS body FROM s),
r AS (SELECT *, {_reply_sql("n", "body", "text")} AS raw FROM b), j AS (SELECT *, TRY_CAST({_FENCED_SQL} AS JSON) AS j FROM r),
v AS (SELECT *, list_transform(list_sort(names), lambda k: CASE k WHEN 'date' THEN json_extract_string(j, '$.date') WHEN 'year' THEN json_extract_string(j, '$.year') WHEN 'dept' THEN json_extract_string(j, '$.dept') ELSE json_extract_string(j, '$.product') END) AS vs FROM j)
SELECT conv_id, turn, CASE WHEN len(names) > 0 THEN '槽位名列表：' || array_to_string(names, '、') || chr(10) || chr(10) || '用户输入：' || trim(text) END AS prompt,
coalesce(array_to_string(list_filter(list_transform(list_sort(names), lambda k, i: k || '=' || {strip_sql("vs[i]")}), lambda x: x IS NOT NULL AND NOT ends_with(x, '=')), ','), '') AS slots FROM v"""
)
def slot_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What asks for a turn's slots, and what is taken from replies that hold the turn's text in JSON, fenced, bare, cut off or not at all."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("t"))), r"(?s)^\{\"t\":(.*)\}$", "$1")
    turns, n, one = table(spark, sf_dir, "conversations").withColumn("n", F.col("conv_id") * 2 + F.col("turn")), F.col("n"), F.lit
    lit = lambda *x: F.array(*[F.lit(y) for y in x]) if x else F.array().cast("array<string>")
    names = F.when(F.col("turn") % 3 == 0, lit("product", "date")).when(F.col("turn") % 3 == 1, lit("year", "dept")).otherwise(lit())
    dept = F.when(n % 3 == 0, '"  "').when(n % 3 == 1, "null").otherwise(quoted(F.concat(one(" "), F.substring("text", 3, 9), one("\n"))))
    body = F.concat(one('{"date": '), quoted(F.substring("text", 1, 12)), one(', "year": '), (2000 + n % 30).cast("string"), one(', "dept": '), dept, one(', "product": '), quoted(F.col("text")), one(', "other": "x"}'))
    slots = F.array_sort(F.transform(F.map_entries(providers.parsed_slots(_reply(n, body, F.col("text")), names)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return turns.select("conv_id", "turn", providers.slot_prompt(F.col("text"), names).alias("prompt"), F.array_join(slots, ",").alias("slots"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, conv_id * 5 + turn AS n, text FROM conversations),
b AS (SELECT *, '{{"op_type": ' || CASE n % 5 WHEN 0 THEN '" Growth "' WHEN 1 THEN '"diff"' WHEN 2 THEN '"ratio"' WHEN 3 THEN '"none"' ELSE to_json(text) END || ', "val1": ' || CASE n % 3 WHEN 0 THEN (n * 7919) || '.25' WHEN 1 THEN '"' || n || '"' ELSE to_json(text) END
  || CASE WHEN n % 4 = 0 THEN '' ELSE ', "val2": ' || CASE n % 4 WHEN 1 THEN 'null' ELSE '123456789012.5' END END || ', "reason": ' || to_json(text || CASE WHEN n % 11 = 0 THEN ' ```{{"a":1}}``` ' ELSE ' {{"quoted": "\\"}} ' END) || '}}' AS body FROM t),
r AS (SELECT *, {_reply_sql("n", "body", "text")} AS raw FROM b), p AS (SELECT *, TRY_CAST({_FENCED_SQL} AS JSON) AS j FROM r),
o AS (SELECT *, json_type(j) = 'OBJECT' AS object, CASE WHEN json_type(j) = 'OBJECT' THEN lower({strip_sql("json_extract_string(j, '$.op_type')")}) END AS op FROM p),
v AS (SELECT conv_id, turn, op AS op_type, CASE WHEN object THEN CASE WHEN json_type(j, '$.val1') IS NULL THEN 0 ELSE TRY_CAST(json_extract_string(j, '$.val1') AS DOUBLE) END END AS val1,
  CASE WHEN object THEN CASE WHEN json_type(j, '$.val2') IS NULL THEN 0 ELSE TRY_CAST(json_extract_string(j, '$.val2') AS DOUBLE) END END AS val2 FROM o)
SELECT conv_id, turn, op_type, val1, val2, NOT coalesce(op_type IN ('growth', 'diff', 'ratio') AND val1 IS NOT NULL AND val2 IS NOT NULL, FALSE) AS fallback FROM v"""
)
def calc_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calculations that a model asks for in JSON with the texts of turns in it: quotes, braces, line ends and fences; some with a wrong kind, a missing value, no number, or no JSON at all."""
    n, lit = F.col("n"), F.lit
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("t"))), r"(?s)^\{\"t\":(.*)\}$", "$1")
    turns = table(spark, sf_dir, "conversations").withColumn("n", F.col("conv_id") * 5 + F.col("turn"))
    op = F.when(n % 5 == 0, '" Growth "').when(n % 5 == 1, '"diff"').when(n % 5 == 2, '"ratio"').when(n % 5 == 3, '"none"').otherwise(quoted(F.col("text")))
    val1 = F.when(n % 3 == 0, F.concat((n * 7919).cast("string"), lit(".25"))).when(n % 3 == 1, F.concat(lit('"'), n.cast("string"), lit('"'))).otherwise(quoted(F.col("text")))
    val2 = F.when(n % 4 == 0, "").when(n % 4 == 1, ', "val2": null').otherwise(', "val2": 123456789012.5')
    reason = quoted(F.concat("text", F.when(n % 11 == 0, ' ```{"a":1}``` ').otherwise(' {"quoted": "\\"} ')))
    body = F.concat(lit('{"op_type": '), op, lit(', "val1": '), val1, val2, lit(', "reason": '), reason, lit("}"))
    return turns.select("conv_id", "turn", answers.calc_payload(_reply(n, body, F.col("text"))).alias("p")).select("conv_id", "turn", "p.*")


@query(
    f"""WITH t AS (SELECT conv_id, turn, conv_id * 3 + turn AS n, text FROM conversations),
b AS (SELECT *, '{{' || CASE n % 3 WHEN 0 THEN '"primary_query": ' || to_json('about ' || text) || ', ' ELSE '' END || CASE n % 4 WHEN 0 THEN '"rewritten_queries": [' || to_json(substring(text, 1, 20)) || ', ' || to_json('"two" of ' || n) || '], ' WHEN 1 THEN '"rewritten_queries": [], ' ELSE '' END
  || '"extracted_years": ' || CASE n % 5 WHEN 0 THEN '[2021, "2022", "x", 2023.7, null]' WHEN 1 THEN '"2020"' ELSE '[' || (2000 + n % 30) || ']' END || '}}' AS body FROM t),
r AS (SELECT *, {_reply_sql("n", "body", "CASE WHEN n % 2 = 0 THEN 'Primary query: ' || replace(replace(substring(text, 1, 40), chr(39), ' '), chr(34), ' ') ELSE text END")} AS raw FROM b), p AS (SELECT *, TRY_CAST({_FENCED_SQL} AS JSON) AS j FROM r),
o AS (SELECT *, coalesce(json_type(j) = 'OBJECT', FALSE) AS object FROM p),
q AS (SELECT *, CASE WHEN object THEN coalesce(json_extract_string(j, '$.primary_query'), text) ELSE coalesce(nullif(regexp_extract(raw, '["\\x27]([^"\\x27]+)["\\x27]', 1), ''),
  nullif({strip_sql("regexp_extract(raw, '(?i)primary[_\\s]*query[:\\s]+[\"\\x27]?([^\"\\x27\\n]+)', 1)")}, ''), CASE WHEN (length(raw) < 200 AND contains(raw, '?')) OR contains(raw, '？') THEN trim(raw) END, text) END AS primary_query FROM o),
g AS (SELECT *, CASE WHEN len(CAST(j->'$.rewritten_queries' AS VARCHAR[])) > 0 THEN CAST(j->'$.rewritten_queries' AS VARCHAR[]) WHEN object THEN [primary_query] ELSE [text] END AS first FROM (SELECT * FROM q)),
w AS (SELECT *, CASE WHEN list_contains(first, text) THEN first ELSE list_append(first, text) END AS with_query FROM g)
SELECT conv_id, turn, primary_query, array_to_string((CASE WHEN len(first) >= 3 THEN first WHEN len(with_query) < 3 THEN list_append(with_query, text || ' 详细信息') ELSE with_query END)[1:3], '|') AS rewritten,
CASE WHEN NOT object THEN '' WHEN n % 5 = 0 THEN '2021,2022,2023' WHEN n % 5 = 1 THEN '' ELSE (2000 + n % 30)::VARCHAR END AS years FROM w"""
)
def rewrite_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites as a model gives them, with the texts of turns in them: JSON fenced, bare or cut off, a quoted or named text, a bare question, or anything else."""
    n, lit = F.col("n"), F.lit
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("t"))), r"(?s)^\{\"t\":(.*)\}$", "$1")
    turns = table(spark, sf_dir, "conversations").withColumn("n", F.col("conv_id") * 3 + F.col("turn"))
    primary = F.when(n % 3 == 0, F.concat(lit('"primary_query": '), quoted(F.concat(lit("about "), F.col("text"))), lit(", "))).otherwise("")
    given = F.when(n % 4 == 0, F.concat(lit('"rewritten_queries": ['), quoted(F.substring("text", 1, 20)), lit(", "), quoted(F.concat(lit('"two" of '), n.cast("string"))), lit("], "))).when(n % 4 == 1, '"rewritten_queries": [], ').otherwise("")
    years = F.when(n % 5 == 0, '[2021, "2022", "x", 2023.7, null]').when(n % 5 == 1, '"2020"').otherwise(F.concat(lit("["), (2000 + n % 30).cast("string"), lit("]")))
    body = F.concat(lit("{"), primary, given, lit('"extracted_years": '), years, lit("}"))
    said = F.when(n % 2 == 0, F.concat(lit("Primary query: "), F.translate(F.substring("text", 1, 40), "'\"", "  "))).otherwise(F.col("text"))
    parsed = turns.select("conv_id", "turn", providers.parsed_rewrite(_reply(n, body, said), F.col("text")).alias("p"))
    return parsed.select("conv_id", "turn", "p.primary_query", F.array_join("p.rewritten_queries", "|").alias("rewritten"), F.array_join(F.transform("p.extracted_years", lambda y: y.cast("string")), ",").alias("years"))


@query(
    f"""WITH {ANSWERS}, f AS (SELECT request_id, answer, CASE request_id % 3 WHEN 0 THEN substring(answer, 1, 5) ELSE 'formula ' || request_id END AS formula FROM answers)
SELECT request_id, CASE WHEN contains(answer, formula) THEN answer ELSE answer || chr(10) || chr(10) || formula END AS answer,
CASE request_id % 5 WHEN 0 THEN '服务暂时不可用，请稍后重试' WHEN 1 THEN '数据库连接失败，请稍后重试' WHEN 2 THEN '请求超时，请稍后重试' WHEN 3 THEN '请求参数验证失败，请检查输入' ELSE '处理失败，请稍后重试' END AS error FROM f"""
)
def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their formula below, and what users are told instead of an error."""
    n = F.col("request_id")
    formula = F.when(n % 3 == 0, F.substring("answer", 1, 5)).otherwise(F.concat(F.lit("formula "), n.cast("string")))
    error = F.element_at(F.array(*[F.lit(x) for x in ("Circuit is open", "no connection", "Timeout after 3 s", "pydantic says no", "boom")]), (n % 5 + 1).cast("int"))
    return _answers(spark, sf_dir).select("request_id", answers.with_formula(F.col("answer"), formula).alias("answer"), policy.error_message(error).alias("error"))


@query(
    f"""WITH {ANSWERS}, a AS (SELECT request_id, answer, cited FROM ids),
e AS (SELECT request_id, 0 AS seq, 'connected' AS event, '{{}}' AS payload FROM a
  UNION ALL SELECT request_id, 1, CASE WHEN request_id % 4 = 0 THEN 'slot_asking' ELSE 'citations' END, CASE WHEN request_id % 4 = 0 THEN '{{"missing":["year"]}}' ELSE '{{"citations":[' || coalesce(array_to_string(cited, ','), '') || ']}}' END FROM a
  UNION ALL SELECT request_id, 1 + i, 'answer', '{{"token":' || to_json(substring(answer, i, 1)) || '}}' FROM (SELECT *, unnest(range(1, length(answer) + 1)) AS i FROM a WHERE request_id % 4 <> 0))
SELECT request_id, CAST(seq AS INTEGER) AS seq, event, payload FROM e"""
)
def answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of answers as they are streamed; every fourth asks for a year instead."""
    missing = F.when(F.col("request_id") % 4 == 0, F.array(F.lit("year"))).otherwise(F.array().cast("array<string>"))
    return answers.stream_events(_answers(spark, sf_dir).select("request_id", "answer", F.filter(policy.citations(F.col("answer")), lambda x: x.isNotNull()).alias("citations"), missing.alias("missing")))


@query(f"WITH {ANSWERS} SELECT request_id, answer, CASE request_id % 2 WHEN 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS confidence, FALSE AS success, 0 AS latency_ms, 'https://h/' || CASE request_id % 3 WHEN 0 THEN 'compatible-mode/v1' WHEN 1 THEN 'api/compatible-mode/v1' ELSE 'compatible-mode/x' END AS url FROM answers")
def response_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of which half lack a confidence and all lack the rest, and base URLs of their services."""
    n = F.col("request_id")
    url = F.when(n % 3 == 0, "https://h/v1").when(n % 3 == 1, "https://h/api/").otherwise("https://h/compatible-mode/x")
    full = answers.with_response_defaults(_answers(spark, sf_dir).withColumn("confidence", F.when(n % 2 == 0, 0.5)))
    return full.select("request_id", "answer", "confidence", "success", "latency_ms", providers.compatible_url(url).alias("url"))


@query(
    f"""WITH {CHUNKS}, {BM25}, {KNN}, {HITS}, o AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, route DESC) AS place FROM hits),
b AS (SELECT query_id, chunk_id, min(place) AS place FROM o GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INTEGER) AS rank FROM b)
SELECT query_id, chunk_id, rank FROM r WHERE rank <= {DEFAULT.retrieval.top_k}"""
)
def rerank_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both routes' hits in turns, each chunk once where it comes first, cut as for a reranker."""
    placed = _hits(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", F.desc("route"))))
    return retrieval.rerank(retrieval.keep_best(placed)).select("query_id", "chunk_id", "rank")


# Questions over several rewrites


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with rewrites of its own words: its start and its end, or none; each fifth has no vector, and neither have second rewrites."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    given = F.when(F.col("query_id") % 2 == 0, F.array(F.substring("query", 1, 80), F.substring(F.col("query"), F.greatest(F.length("query") - 79, F.lit(1)), F.lit(80)))).otherwise(F.array().cast("array<string>"))
    routes = answers.fan_out(items.withColumn("given", given))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("from_vec"), F.col("embedding").alias("vector"))
    named = F.when((F.col("query_id") % 5 != 4) & (F.col("route") != 1), F.col("query_id") + 7 * F.col("route"))
    asked = F.when(F.col("query_id") % 3 != 0, F.array((2020 + F.col("query_id") % 5).cast("int"))).otherwise(F.array().cast("array<int>"))
    return routes.withColumn("from_vec", named).join(vectors, "from_vec", "left").select("query_id", "route", "route_query", "vector", asked.alias("years"))


_REWRITTEN = """
g AS (SELECT item_id, text AS query, CASE WHEN item_id % 2 = 0 THEN [substring(text, 1, 80), substring(text, greatest(length(text) - 79, 1), 80)] ELSE [] END AS given FROM benchmark),
f1 AS (SELECT *, CASE WHEN len(given) = 0 THEN [query] ELSE given END AS first FROM g),
f2 AS (SELECT *, CASE WHEN list_contains(first, query) THEN first ELSE list_append(first, query) END AS with_query FROM f1),
f3 AS (SELECT item_id, (CASE WHEN len(with_query) < 3 THEN list_append(with_query, query || ' 详细信息') ELSE with_query END)[1:3] AS all_ FROM f2),
routes AS (SELECT item_id, unnest(all_) AS text, generate_subscripts(all_, 1) - 1 AS route, item_id * 3 + generate_subscripts(all_, 1) - 1 AS rid FROM f3)
"""
_ROUTE_BM25 = BM25.replace("SELECT item_id AS query_id, unnest", "SELECT rid AS query_id, unnest").replace("FROM benchmark) GROUP BY", "FROM routes) GROUP BY")
_ROUTE_KNN = KNN.replace("b.item_id AS query_id", "b.rid AS query_id").replace("FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id", "FROM routes b JOIN embeddings q ON q.vec_id = b.item_id + 7 * b.route AND b.item_id % 5 <> 4 AND b.route <> 1")
_ROUTE_HITS = HITS.replace("asked AS (SELECT item_id AS query_id,", "asked AS (SELECT rid AS query_id,").replace("AS years FROM benchmark)", "AS years FROM routes)")
_OVER_ROUTES = f"""
WITH {CHUNKS}, {_REWRITTEN}, {_ROUTE_BM25}, {_ROUTE_KNN}, {_ROUTE_HITS}, {_rrf_sql('SELECT * FROM counted WHERE unasked OR allowed OR n < 3')},
lists AS (SELECT query_id // 3 AS query_id, query_id % 3 AS route, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS place FROM fused WHERE rank <= {K}),
over_ AS (SELECT query_id, chunk_id, round(sum(1 / (60 + place)::DOUBLE), 9) AS s, arg_min(score, route * 1000000 + place) AS score, min(route * 1000000 + place) AS first FROM lists GROUP BY 1, 2),
best AS (SELECT query_id, chunk_id, score, s, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first) AS INTEGER) AS rank FROM over_)
"""


@query(f"{_OVER_ROUTES} SELECT query_id, rank, chunk_id, round(score, 6) AS score, round(s, 6) AS rrf_score FROM best WHERE rank <= {DEFAULT.retrieval.top_k}")
def rewrite_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = questions_of.search_rewrites(chunks(spark, sf_dir), vectors_of(spark, sf_dir), _routes(spark, sf_dir))
    return found.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), F.round("rrf_score", 6).alias("rrf_score"))


@query(
    f"""{_OVER_ROUTES}, top5 AS (SELECT b.query_id, b.rank, c.* FROM best b JOIN chunks c USING (chunk_id) WHERE b.rank <= {DEFAULT.retrieval.top_k}),
made AS (SELECT query_id, string_agg('[Chunk ' || chunk_id || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY chunk_id) AS context, string_agg(substring(content, 1, 200) || ' [Chunk ' || chunk_id || ']', chr(10) ORDER BY rank) AS answer,
  string_agg(chunk_id, ',' ORDER BY rank) AS chunk_ids, count(*) AS n FROM top5 GROUP BY 1),
m AS (SELECT *, len(regexp_extract_all(answer, '(?i)\\[Chunk\\s+\\p{{Nd}}+\\]')) AS k FROM made),
c AS (SELECT *, round(greatest(0, least(1, 0.5::DOUBLE + CASE WHEN k > 0 THEN 0.3::DOUBLE + least(k * 0.05::DOUBLE, 0.15::DOUBLE) ELSE -0.2::DOUBLE END + CASE WHEN length({strip_sql("answer")}) < 10 THEN -0.3::DOUBLE WHEN length({strip_sql("answer")}) > 50 THEN 0.1::DOUBLE ELSE 0 END
  + CASE WHEN regexp_matches(answer, '无法|不知道|没有找到|未找到|不清楚|无法确定') THEN -0.2::DOUBLE ELSE 0 END)), 6) AS confidence FROM m)
SELECT b.item_id AS query_id, coalesce(chunk_ids, '') AS chunk_ids, sha256(context) AS context_sha256, sha256(coalesce(answer, '根据提供的上下文，无法找到相关信息')) AS answer_sha256, coalesce(confidence, 0)::DOUBLE AS confidence, coalesce(confidence < 0.6 OR k = 0, TRUE) AS is_refused
FROM benchmark b LEFT JOIN c ON c.query_id = b.item_id"""
)
def question_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every question over its rewrites to its context, an extractive answer, and whether that is refused."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    said = questions_of.answer(items, _routes(spark, sf_dir), chunks(spark, sf_dir), vectors_of(spark, sf_dir))
    ids = F.array_join(F.transform("chunk_ids", lambda c: c.cast("string")), ",").alias("chunk_ids")
    return said.select("query_id", ids, text.sha256(F.col("context")).alias("context_sha256"), text.sha256(F.col("answer")).alias("answer_sha256"), "confidence", "is_refused")


# Stores


@query(f"WITH {CHUNKS}, {BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM worded")
def keyword_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that was filled with half of the chunks, then with others under wrong texts, which are replaced, while the deleted ones go, and merged."""
    index = KeywordIndex(Store(spark, scratch(spark, "keyword-index")), fan=2)
    everything = chunks(spark, sf_dir).select("chunk_id", "content", "is_deleted")
    even = F.col("chunk_id") % 2 == 0
    index.update(everything.where(even))
    index.update(everything.where(~even).withColumn("content", F.reverse("content")))
    index.merge()
    index.store.expire()  # of the segments that were merged
    index.update(everything.where(~even & ~F.col("is_deleted")), everything.where("is_deleted"))
    return index.search(questions(spark, sf_dir), K).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(ORACLE_SQL["cascade_delete"])
def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade as one commit over three tables, read from its snapshot."""
    store, all_chunks = Store(spark, scratch(spark, "store")), chunks(spark, sf_dir)
    store.commit(
        {
            "documents": Append(all_chunks.select("document_id").distinct()),
            "chunks": Append(all_chunks.select("document_id", "chunk_id")),
            "embeddings": Append(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))),
        }
    )
    incremental.delete_documents(store, all_chunks.where("is_deleted"))
    snapshot = store.snapshot()
    left = {name: store.read(name, snapshot) for name in ("documents", "chunks", "embeddings")}
    rows = [df.select(F.lit(name).alias("table_name"), F.col(df.columns[-1]).alias("id")) for name, df in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    """WITH u AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3 DESC, ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, event_type, event_id, ts FROM u WHERE n = 1 AND NOT (event_id % 3 = 2 AND value < 10)"""
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of events put over each other by user and kind, of which the second comes twice and the last takes away what is worth little."""
    store, events = Store(spark, scratch(spark, "upserts")), table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    for number in (0, 1, 1, 2):
        batch = events.where(F.col("event_id") % 3 == number)
        store.upsert("requests", batch, ("user_id", "event_type"), F.struct("ts", "event_id"), F.lit(number == 2) & (F.col("value") < 10), ("events", number))
        if number == 1:
            store.compact("requests", ("user_id", "event_type"))
    return store.latest("requests", ("user_id", "event_type")).select("user_id", "event_type", "event_id", "ts")


class _Pages:
    """Pages of text that can't be read where their bytes are a multiple of 17."""

    def pages(self, content: bytes) -> list[str]:
        if len(content) % 17 == 0:
            raise ValueError("unreadable")
        return [content.decode()]


@query(
    f"""WITH RECURSIVE live AS (SELECT lang AS tenant, doc_id % 300 AS k, max(doc_id) AS doc_id FROM documents GROUP BY 1, 2),
f AS (SELECT l.tenant, l.k, d.doc_id, d.text AS whole, strlen(d.text) % 17 = 0 AS failed FROM live l JOIN documents d USING (doc_id)),
l AS (SELECT doc_id, unnest(string_split(whole, chr(10))) AS line, generate_subscripts(string_split(whole, chr(10)), 1) AS n FROM f WHERE NOT failed), s AS (SELECT *, {strip_sql("line")} AS x FROM l),
clean AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM s WHERE NOT (regexp_matches(x, '^\\p{{Nd}}{{1,5}}$') OR regexp_matches(x, '^(第\\s*\\p{{Nd}}+\\s*页|Page\\s*\\p{{Nd}}+)$', 'i') OR (length(x) <= 10 AND regexp_matches(x, '^[\\p{{Nd}}\\s./\\-]+$'))) GROUP BY 1),
{_sentence_chunks_sql("clean").replace("f AS (SELECT", "fold AS (SELECT").replace("FROM f WHERE", "FROM fold WHERE")},
c AS (SELECT doc_id, count(*) AS n_chunks, sha256(string_agg({strip_sql("c")}, chr(10) ORDER BY n, i)) AS content_sha256 FROM out_ WHERE {strip_sql("c")} <> '' GROUP BY 1)
SELECT f.tenant, 'f' || f.k || '.pdf' AS file_name, sha256(f.whole) AS file_sha256, CASE WHEN failed THEN 'failed' ELSE 'parsed' END AS parse_status, coalesce(n_chunks, 0) AS n_chunks, content_sha256 FROM f LEFT JOIN c USING (doc_id)"""
)
def load_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files of 300 names, loaded in three batches of which one comes twice, the newest of a name first or last: what each name has in the end."""
    store, docs = Store(spark, scratch(spark, "loaded")), documents(spark, sf_dir)
    name = F.concat(F.lit("in/f"), (F.col("doc_id") % 300).cast("string"), F.lit(".pdf"))
    files = docs.where("text is not null").select(F.col("lang").alias("tenant"), name.alias("path"), F.col("doc_id").alias("modified"), F.encode("text", "UTF-8").alias("content"), "doc_id")
    for number, part in enumerate((2, 0, 0, 1)):
        loading.load(store, files.where(F.col("doc_id") % 3 == part).drop("doc_id"), _Pages(), providers.HashingEmbedder(8), ("files", min(number, 1) if number < 3 else 2))
    chunks_of = loading.live_chunks(store).groupBy("tenant", "file_name").agg(F.count("*").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("chunk_no", "content"))).alias("all"))
    status = store.latest("files", loading.NAME).join(store.latest("documents", ("document_id",)).select("document_id", "file_sha256", "parse_status"), "document_id")
    joined = status.join(chunks_of, list(loading.NAME), "left")
    digest = F.sha2(F.array_join(F.transform("all", lambda c: c["content"]), "\n"), 256)
    return joined.select("tenant", "file_name", "file_sha256", "parse_status", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), digest.alias("content_sha256"))


@query(ORACLE_SQL["chunk_live"])
def chunk_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks and places of ``chunk_live``, asked for in SQL."""
    table_functions.register(spark)
    noted(spark, sf_dir).select("doc_id", "text").createOrReplaceTempView("noted_documents")
    return spark.sql('SELECT doc_id, piece, length(content) AS n_chars, start, `end`, sha2(content, 256) AS content_sha256 FROM chunk_text(TABLE(noted_documents))')


@query(
    """WITH r AS (SELECT conv_id, turn, repeat(text, turn % 6) AS query, turn * 5 - 3 AS top_k FROM conversations)
SELECT conv_id, turn, coalesce(length(query) BETWEEN 1 AND 1000 AND top_k BETWEEN 1 AND 20, FALSE) AS valid FROM r"""
)
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of no, fitting and too much text, for too few, enough and too many results."""
    made = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("repeat(text, int(turn % 6))").alias("query"), (F.col("turn") * 5 - 3).alias("top_k"))
    good, bad = requests(made)
    return good.select("conv_id", "turn", F.lit(True).alias("valid")).unionByName(bad.select("conv_id", "turn", F.lit(False).alias("valid")))


@query(
    f"""WITH {ASKED} SELECT conv_id, turn, query || '|' || query || ' 详细信息' AS rewritten, coalesce(array_to_string(list_distinct_in_order, ','), '') AS years FROM
(SELECT *, list_filter(ys, lambda y, i: list_position(ys, y) = i) AS list_distinct_in_order FROM (SELECT *, regexp_extract_all(query, '(?:19|20)[0-9]{{2}}') AS ys FROM asked0))"""
)
def rewrite_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in for a model that rewrites: the question itself, a variant of it, and the years it names."""
    made = providers.rewrite(_asked(spark, sf_dir))
    return made.select("conv_id", "turn", F.array_join("rewritten_queries", "|").alias("rewritten"), F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"))


@query(
    """WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE NOT contains(text, chr(10) || chr(10)) AND trim(text) <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM t)
SELECT conv_id, CAST(2 * k AS INTEGER) AS seq, role AS type, text AS answer FROM o"""
)
def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as server-sent text with comments before each event and a mark at the end, read again."""
    turns = table(spark, sf_dir, "conversations").where(~F.contains("text", F.lit("\n\n")) & (F.trim("text") != ""))
    event = F.concat(F.lit(": turn\n\n"), F.lit("data: "), F.to_json(F.struct(F.col("role").alias("type"), F.col("text").alias("answer"))), F.lit("\r\n\r\n"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", event.alias("e"))))
    raw = turns.groupBy("conv_id").agg(F.concat(F.array_join(F.transform(ordered, lambda t: t["e"]), ""), F.lit("data: [DONE]\n\n")).alias("raw"))
    return sse_events(raw, "raw", "type string, answer string").select("conv_id", (F.col("seq") + 1).alias("seq"), "payload.type", "payload.answer")


@query(
    """WITH k AS (SELECT event_id, event_type, event_id % 5 AS f, CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS broken FROM events)
SELECT event_id, CASE WHEN f = 0 AND broken = 1 THEN NULL WHEN f = 0 OR f = 1 OR f = 2 THEN 'second ' || event_id ELSE 'first ' || event_id END AS answer, CASE WHEN f = 0 AND broken = 1 THEN 'none' WHEN f <= 2 THEN 'secondary' ELSE 'primary' END AS model,
CASE f WHEN 0 THEN 'rate_limit,rate_limit,rate_limit,fallback' || CASE WHEN broken = 1 THEN ',fallback' ELSE '' END WHEN 1 THEN 'parse_error,fallback' WHEN 2 THEN 'timeout,timeout,timeout,fallback' ELSE '' END AS events FROM k"""
)
def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that fail by the prompt: too many requests, a wrong reply, a timeout; and a second one that fails on some prompts too."""

    def first(prompt: str) -> str:
        kind = int(prompt.split(" ")[0]) % 5
        if kind == 0:
            raise providers.ModelError("busy", 429)
        if kind == 1:
            raise ValueError("no JSON")
        if kind == 2:
            raise TimeoutError("slow")
        return f"first {prompt.split(' ')[0]}"

    def second(prompt: str) -> str:
        if prompt.endswith("error") and int(prompt.split(" ")[0]) % 5 == 0:
            raise RuntimeError("no")
        return f"second {prompt.split(' ')[0]}"

    prompts = table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", F.col("event_id").cast("string"), "event_type").alias("prompt"))
    never = replace(DEFAULT.resilience, breaker_failures=1 << 30)  # a task's breaker depends on which prompts it has
    asked = providers.ask_models(prompts, "prompt", first, second, never, wait=lambda s: None, clock=lambda: 0.0)
    return asked.select("event_id", "answer", "model", F.array_join(F.transform("events", lambda e: e["event_type"]), ",").alias("events"))


@query(
    """WITH m AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'HTTP 404: ' || text WHEN 1 THEN text || ' UNAUTHORIZED' WHEN 2 THEN 'Read TimeOut after ' || turn WHEN 3 THEN text WHEN 4 THEN 'Model not Found, 401' END AS message FROM conversations),
l AS (SELECT *, lower(message) AS low FROM m)
SELECT conv_id, turn, CASE WHEN message IS NULL THEN NULL WHEN contains(low, '404') OR contains(low, 'not found') THEN 'no_model' WHEN contains(low, '401') OR contains(low, 'unauthorized') THEN 'no_access' WHEN contains(low, 'timeout') THEN 'timeout' ELSE 'other' END AS kind FROM l"""
)
def embedding_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why questions have no vector, by what the errors say, texts of turns among them."""
    n = (F.col("conv_id") + F.col("turn")) % 6
    message = F.when(n == 0, F.concat(F.lit("HTTP 404: "), "text")).when(n == 1, F.concat("text", F.lit(" UNAUTHORIZED"))).when(n == 2, F.concat(F.lit("Read TimeOut after "), F.col("turn").cast("string"))).when(n == 3, F.col("text")).when(n == 4, "Model not Found, 401")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", policy.embedding_error(message).alias("kind"))


@query(
    f"""WITH {CHUNKS}, f AS (SELECT document_id, chunk_id, {strip_sql("regexp_extract(" + strip_sql("content") + ", '^[^。.！？!?\\n]*[。.！？!?]?')")} AS s FROM chunks WHERE NOT is_deleted)
SELECT document_id, sha256(string_agg(s || ' [Chunk ' || chunk_id || ']', chr(10) ORDER BY chunk_id)) AS summary_sha256, count(*) AS n FROM f WHERE s <> '' GROUP BY 1"""
)
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of each of a document's chunks with its citation, as without a model."""
    kept = retrieval.live(chunks(spark, sf_dir))
    passages = kept.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))).alias("passages"))
    said = providers.ExtractiveSummary().answer(passages, "", "passages").where("answer <> ''")
    return said.select("document_id", text.sha256(F.col("answer")).alias("summary_sha256"), F.size(policy.citations(F.col("answer"))).cast("long").alias("n"))


@query(ORACLE_SQL["answer_events"])
def sse_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of answers written by the data source of server-sent events, and read again."""
    spark.dataSource.register(ServerSentEvents)
    folder = scratch(spark, "events")
    QUERIES["answer_events"](spark, sf_dir).select("event", F.to_json(F.struct("request_id", "seq", "payload")).alias("data")).write.format("sse").option("compression", "zstd").mode("append").save(folder)
    back = spark.read.format("sse").load(folder).select("event", F.from_json("data", "request_id long, seq int, payload string").alias("d"))
    return back.select("d.request_id", "d.seq", "event", "d.payload")
