"""The registered queries of the document checker and the SQL each is compared with.

Documents run as they are; LaTeX, Chinese and review texts, which they don't have, are made of whole
relational tables by SQL that both engines read (TEX, THESIS, ANSWERS).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import checks, incremental, parser, reports, review
from inkwell.schema import RANGE
from inkwell.sources import files as sources
from inkwell.sources.state import stage
from inkwell.streaming import saves

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


# --- SQL in DuckDB's words ---------------------------------------------------------------------

W = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def uncommented(x: str) -> str:
    return rf"regexp_extract({x}, '(?s)^(?:[^\\%]|\\.)*(?:\\$)?', 0)"


def terminal(x: str) -> str:
    return rf"""regexp_matches(regexp_replace({trim(x)}, '[)\]）】》」』”"''`]+$', ''), '[.!?。？！：:；;]$')"""


def acronyms(x: str) -> str:
    return rf"regexp_extract_all({x}, '\b[A-Z]{{3,}}\b')"


def hashed(x: str) -> str:
    return f"CAST(list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 33 + c) % 4294967296) AS VARCHAR)"


KNOWN = ", ".join(f"'{a}'" for a in X.KNOWN_ACRONYMS)
LINES = f"""l AS (SELECT doc_id, unnest(a) AS line, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS line_no FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS a FROM documents)),
s AS (SELECT doc_id, line_no, line, {uncommented("line")} AS stripped, {trim(uncommented("line"))} AS trimmed FROM l)"""

# --- SQL that both engines read ----------------------------------------------------------------

BS, NL = "chr(92)", "chr(10)"
_FILE = "concat('n', CAST({} AS STRING), '.tex')"
_ACR = "translate(CAST(o_orderkey % 997 AS STRING), '0123456789', 'ABCDEFGHIJ')"
#: Elements: sentences of orders in 25 files, headings and figures of parts in every third of them.
THESIS = f"""
SELECT {_FILE.format("o_custkey % 25")} AS file_path, CAST(o_custkey % 25 AS BIGINT) AS file_ord, CAST(2 * o_orderkey AS BIGINT) AS seq, 'sentence' AS type,
       CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN concat('The ', {_ACR}, ' model works.') WHEN 1 THEN concat('模型', {_ACR}, '很好。') WHEN 2 THEN concat('Long name (', {_ACR}, ') is used')
            WHEN 3 THEN concat({_ACR}, '与CNN分别表示两种网络。)') WHEN 4 THEN concat(o_orderpriority, '：') WHEN 5 THEN concat('CPU and ', {_ACR}, '_X are fine，') ELSE concat('see ', o_orderstatus, ' … ”') END AS content,
       CAST(NULL AS BOOLEAN) AS has_caption
FROM orders
UNION ALL
SELECT {_FILE.format("(p_partkey % 9) * 3")}, CAST((p_partkey % 9) * 3 AS BIGINT), CAST(14 * p_partkey + 1 AS BIGINT),
       CASE CAST(p_size % 5 AS INT) WHEN 0 THEN 'chapter' WHEN 1 THEN 'section' WHEN 2 THEN 'subsection' WHEN 3 THEN 'subsubsection' ELSE 'title' END, p_name, CAST(NULL AS BOOLEAN)
FROM part
UNION ALL
SELECT {_FILE.format("(p_partkey % 9) * 3")}, CAST((p_partkey % 9) * 3 AS BIGINT), CAST(14 * p_partkey + 3 AS BIGINT), CASE WHEN p_partkey % 2 = 0 THEN 'figure' ELSE 'table' END, p_type, p_size % 2 = 0
FROM part
"""
E = f"e AS ({THESIS})"
#: The previous run: other words in some sentences, and rows that are gone since.
PREVIOUS = f"SELECT file_path, file_ord, seq, type, CASE WHEN seq % 22 = 0 THEN concat(content, ' old') ELSE content END AS content, has_caption FROM ({THESIS}) t UNION ALL SELECT 'gone.tex', CAST(99 AS BIGINT), CAST(r_regionkey AS BIGINT), 'sentence', r_name, CAST(NULL AS BOOLEAN) FROM region"
TEX = f"""
SELECT concat('p', CAST(p_partkey AS STRING), '.tex') AS file_path, CAST(p_partkey AS BIGINT) AS file_ord,
       concat({BS}, 'chapter{{', p_name, '}}', {NL}, 'Brand ', p_brand, ' is fine. It works! % no', {NL}, {BS}, 'begin{{', kind, '}}', {NL},
              CASE WHEN p_size % 2 = 0 THEN concat({BS}, 'caption{{x}}') ELSE '%' END, {NL}, {BS}, 'end{{', kind, '}}', {NL},
              '$$', {NL}, 'a=', CAST(p_size AS STRING), {NL}, '$$', {NL}, {BS}, 'textbf{{skip}} me.', {NL}, 'See ', {BS}, '[x', {BS}, '] and $$y$$ here.') AS text, kind, p_name, p_brand, p_size
FROM (SELECT *, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'figure' WHEN 1 THEN 'table*' ELSE 'itemize' END AS kind FROM part) t
"""
#: Answers of a model, and the sentences they are about. Messages may have what one rule each of the filter rejects.
ANSWERS = f"""
SELECT CAST(o_orderkey AS BIGINT) AS id, before, after, msg, CAST(o_custkey AS BIGINT) AS cust,
       CASE CAST(o_custkey % 13 AS INT) WHEN 4 THEN '本文别的研究。' WHEN 5 THEN concat('本文', before, after, '研究。') ELSE concat('本文', before, '研究。') END AS content,
       CASE CAST(o_orderkey % 6 AS INT)
            WHEN 0 THEN 'issue_count=0'
            WHEN 1 THEN concat('```', {NL}, '- issue_count=1', {NL}, '- issue1 ＝ 错误｜', msg, {NL}, 'rewrite="本文研究。"', {NL}, '```')
            WHEN 2 THEN concat('issue1_message=', msg, {NL}, 'issue1_severity=Error!', {NL}, 'Issue2=warning: second', {NL}, 'rewrite= x ')
            WHEN 3 THEN concat('message=first', {NL}, 'message=', msg, {NL}, 'severity=轻微', {NL}, 'rewrite=”y')
            WHEN 4 THEN concat('1. issue_count = 1 issue', {NL}, '2) issue1_message = ', msg, {NL}, '3、issue_2=err：other', {NL}, 'rewrite=z')
            ELSE 'nothing to report here' END AS raw
FROM (SELECT *, CASE CAST(o_custkey % 13 AS INT) WHEN 0 THEN concat(plain, '，引号有误') WHEN 1 THEN concat(plain, '，首字母') WHEN 2 THEN concat('note=', plain) WHEN 3 THEN concat('建议', plain) ELSE plain END AS msg
      FROM (SELECT *, concat('【', CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN '语病' WHEN 1 THEN '搭配不当' WHEN 2 THEN '成分残缺' ELSE '其他' END, '】“', before, '”应改为“', after, '”') AS plain
            FROM (SELECT *, CASE CAST(o_orderkey % 11 AS INT) WHEN 0 THEN '非常非常' WHEN 1 THEN '的的方法' WHEN 2 THEN '的的' WHEN 3 THEN '进行行' WHEN 4 THEN '了的在系统' WHEN 5 THEN '对与' WHEN 6 THEN '通过对' WHEN 7 THEN 'x的' WHEN 8 THEN '与对' WHEN 9 THEN '的研究' ELSE '和及' END AS before,
                         CASE CAST(o_orderkey % 11 AS INT) WHEN 0 THEN '非常' WHEN 1 THEN '的方法' WHEN 2 THEN '的' WHEN 3 THEN '进行' WHEN 4 THEN '系统' WHEN 5 THEN '对于' WHEN 6 THEN '通对过' WHEN 7 THEN 'x' WHEN 8 THEN '研究' WHEN 9 THEN '地研究' ELSE '和在' END AS after FROM orders) a) b) c
"""


def thesis(spark: SparkSession, sf_dir: str, sql: str = THESIS) -> DataFrame:
    """An element table of THESIS: an element's line is its seq."""
    rows = made(spark, sf_dir, sql, "orders", "part", "region")
    meta = F.struct(F.lit(None).cast("string").alias("command"), F.lit(None).cast("string").alias("environment"), F.col("has_caption"), F.lit(None).cast("boolean").alias("inline"), F.lit(None).cast("boolean").alias("block"), F.lit(None).cast("string").alias("delimiter"))
    at = F.col("seq").cast("int")
    return rows.select("file_path", "file_ord", at.alias("line_no"), "seq", "type", "content", at.alias("start_line"), F.lit(0).alias("start_char"), at.alias("end_line"), F.length("content").alias("end_char"), meta.alias("metadata"))


def tex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of TEX. Parts are short and become long texts, so they are dealt evenly to a few tasks a core first; the table's few row groups would be as few tasks."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    table(spark, sf_dir, "part").repartition(n, "p_partkey").createOrReplaceTempView("part")
    return spark.sql(TEX)


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(X.lines(F.col("text"))).alias("line_no", "line"))
    stripped = rows.withColumn("stripped", X.strip_comment(F.col("line")))
    return stripped.withColumn("trimmed", X.js_trim(F.col("stripped")))


# --- lines and the parser ----------------------------------------------------------------------


@query(
    f"""WITH {LINES}, k AS (SELECT source, {terminal("trimmed")} AS ends FROM s JOIN documents USING (doc_id) WHERE trimmed <> '' AND NOT starts_with(trimmed, '\\'))
SELECT source, count(*) AS lines, count(*) FILTER (WHERE NOT ends) AS unterminated FROM k GROUP BY source"""
)
def unterminated_by_source(spark, sf_dir):
    rows = line_rows(spark, sf_dir).filter((F.col("trimmed") != "") & ~F.col("trimmed").startswith("\\"))
    return rows.groupBy("source").agg(F.count("*").alias("lines"), F.count_if(~X.ends_sentence(F.col("trimmed"))).alias("unterminated"))


@query(f"WITH {LINES} SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE trimmed = '') AS blank FROM s GROUP BY doc_id")
def lines_scan(spark, sf_dir):
    return line_rows(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("trimmed") == "").alias("blank"))


@query(f"WITH {LINES} SELECT doc_id, line_no, stripped, trimmed FROM s WHERE stripped <> line")
def strip_comments(spark, sf_dir):
    return line_rows(spark, sf_dir).filter("stripped <> line").select("doc_id", "line_no", "stripped", "trimmed")


@query(
    f"""WITH {LINES}, m AS (SELECT doc_id, line_no, list_concat(regexp_extract_all(stripped, '\\\\\\[(.+?)\\\\\\]'), regexp_extract_all(stripped, '\\$\\$(.+?)\\$\\$')) AS a FROM s)
SELECT doc_id, line_no, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos, unnest(a) AS content FROM m"""
)
def display_math_inline(spark, sf_dir):
    return line_rows(spark, sf_dir).select("doc_id", "line_no", F.posexplode(X.inline_display(F.col("stripped"))).alias("pos", "content"))


_TEX_LINES = f"t AS ({TEX}), x AS (SELECT file_path, unnest(a) AS line, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS line_no FROM (SELECT file_path, string_split(text, {NL}) AS a FROM t)), y AS (SELECT *, {trim(uncommented('line'))} AS u FROM x)"


def _tex_lines(spark, sf_dir):
    files = tex(spark, sf_dir)
    return files.select("file_path", F.posexplode(X.lines(F.col("text"))).alias("line_no", "line")).withColumn("line", X.strip_comment(F.col("line")))


@query(f"WITH {_TEX_LINES} SELECT file_path, line_no, CASE WHEN starts_with(u, '$$') THEN 'dollar' ELSE 'bracket' END AS delimiter FROM y WHERE starts_with(u, '$$') AND len(string_split(u, '$$')) = 2 OR starts_with(u, '\\[') AND NOT contains(substr(u, 3), '\\]')")
def display_block_open(spark, sf_dir):
    return _tex_lines(spark, sf_dir).withColumn("delimiter", X.display_open(F.col("line"))).filter("delimiter IS NOT NULL").select("file_path", "line_no", "delimiter")


@query(f"WITH {_TEX_LINES} SELECT file_path, line_no, regexp_extract(u, '^\\\\([a-z]+)', 1) AS type, substr(u, instr(u, '{{') + 1, len(u) - instr(u, '{{') - 1) AS title FROM y WHERE regexp_matches(u, '^\\\\(title|chapter|section|subsection|subsubsection)\\*?\\{{.+\\}}$')")
def heading_extract(spark, sf_dir):
    rows = _tex_lines(spark, sf_dir)
    return rows.select("file_path", "line_no", X.heading(F.col("line"), 1).alias("type"), X.heading(F.col("line"), 2).alias("title")).filter("type <> ''")


_BLOCK = f"concat({BS}, 'begin{{', kind, '}}', {NL}, CASE WHEN p_size % 2 = 0 THEN concat({BS}, 'caption{{x}}') ELSE '%' END, {NL}, {BS}, 'end{{', kind, '}}')"
_EXPECTED = f"""t AS ({TEX}),
p AS (SELECT file_path, 0 AS n, 'chapter' AS type, p_name AS content, 0 AS start_line, 0 AS start_char, 0 AS end_line, CAST(length(p_name) + 10 AS INTEGER) AS end_char FROM t
UNION ALL SELECT file_path, 1, 'sentence', concat('Brand ', p_brand, ' is fine.'), 1, 0, 1, CAST(length(p_brand) + 15 AS INTEGER) FROM t
UNION ALL SELECT file_path, 2, 'sentence', 'It works!', 1, CAST(length(p_brand) + 16 AS INTEGER), 1, CAST(length(p_brand) + 25 AS INTEGER) FROM t
UNION ALL SELECT file_path, 3, CASE kind WHEN 'table*' THEN 'table' ELSE kind END, {_BLOCK}, 2, 0, 4, CAST(length(kind) + 6 AS INTEGER) FROM t WHERE kind <> 'itemize'
UNION ALL SELECT file_path, 4, 'equation', concat('$$', {NL}, 'a=', CAST(p_size AS VARCHAR), {NL}, '$$'), 5, 0, 7, 2 FROM t
UNION ALL SELECT file_path, 5, 'equation', concat({BS}, '[x', {BS}, ']'), 9, 4, 9, 9 FROM t
UNION ALL SELECT file_path, 6, 'equation', '$$y$$', 9, 14, 9, 19 FROM t
UNION ALL SELECT file_path, 7, 'sentence', 'See and here.', 9, 0, 9, 25 FROM t)"""


@query(f"WITH {_EXPECTED} SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY n) - 1 AS seq, type, content, start_line, start_char, end_line, end_char FROM p")
def parse_elements(spark, sf_dir):
    return parser.elements(tex(spark, sf_dir)).select("file_path", "seq", "type", "content", *RANGE)


@query(f"WITH {_EXPECTED} SELECT file_path, type, contains(content, '\\caption') AS has_caption FROM p WHERE type IN ('figure', 'table')")
def env_blocks(spark, sf_dir):
    return parser.elements(tex(spark, sf_dir)).filter("metadata.environment IS NOT NULL").select("file_path", "type", F.col("metadata.has_caption").alias("has_caption"))


@query(f"WITH {_EXPECTED} SELECT type, count(*) AS n FROM p GROUP BY type")
def element_counts(spark, sf_dir):
    return reports.element_counts(parser.elements(tex(spark, sf_dir)))


@query()
def document_elements(spark, sf_dir):
    return parser.elements(sources.documents(table(spark, sf_dir, "documents"))).drop("metadata")


@query()
def document_diagnostics(spark, sf_dir):
    elements = stage(parser.elements(sources.documents(table(spark, sf_dir, "documents"))), "elements")  # four checks read it
    return checks.analyze(elements).select("file_path", "seq", "rule", "message")


@query(f"WITH {LINES} SELECT doc_id, line_no, trimmed AS content FROM s WHERE trimmed <> '' AND (regexp_matches(trimmed, '[\\\\{{}}]') OR length(trimmed) < 5)")
def suspicious_lines(spark, sf_dir):
    rows = line_rows(spark, sf_dir).filter("trimmed <> ''").withColumn("type", F.lit("sentence")).withColumnRenamed("trimmed", "content")
    return reports.suspicious(rows).select("doc_id", "line_no", "content")


@query(f"WITH {LINES} SELECT doc_id, line_no, trimmed AS content FROM s WHERE trimmed <> '' AND (regexp_matches(trimmed, '[\\\\{{}}]') OR length(trimmed) < 5) ORDER BY doc_id, line_no LIMIT 20")
def suspicious_top(spark, sf_dir):
    rows = line_rows(spark, sf_dir).filter("trimmed <> ''").withColumn("type", F.lit("sentence")).withColumnRenamed("trimmed", "content")
    return reports.top_suspicious(rows.withColumn("file_ord", F.col("doc_id")).withColumn("seq", F.col("line_no"))).select("doc_id", "line_no", "content")


# --- checks ------------------------------------------------------------------------------------


@query(f"WITH {E} SELECT file_path, seq, '句子缺少句末标点。' AS message FROM e WHERE type = 'sentence' AND {trim('content')} <> '' AND NOT {terminal('content')}")
def missing_punctuation(spark, sf_dir):
    return checks.punctuation(thesis(spark, sf_dir)).select("file_path", "seq", "message")


@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({acronyms('text')}) AS token FROM documents) GROUP BY token")
def acronym_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.acronyms(F.col("text"))).alias("token"))
    per = rows.groupBy("token", "doc_id").agg(F.count("*").alias("k"))
    return per.groupBy("token").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


_DEFINED = rf"list_distinct(list_concat(flatten(list_transform(regexp_extract_all(content, '[^()（）]{{2,}}\s*[(（]([^)）]+)[)）]', 1), lambda x: {acronyms('x')})), CASE WHEN regexp_matches(content, '分别.*?(代表|表示|指|是)') THEN {acronyms('content')} ELSE [] END))"


@query(f"WITH {E} SELECT file_path, seq, unnest({_DEFINED}) AS acronym FROM e WHERE type = 'sentence'")
def acronym_definitions(spark, sf_dir):
    return checks.sentences(thesis(spark, sf_dir)).select("file_path", "seq", F.explode(X.defined_acronyms(F.col("content"))).alias("acronym"))


_FIRST = f"""{E}, a AS (SELECT *, unnest(list_distinct({acronyms("content")})) AS acronym FROM e WHERE type = 'sentence'),
u AS (SELECT *, row_number() OVER (PARTITION BY acronym ORDER BY file_ord, seq) AS r FROM a WHERE acronym NOT IN ({KNOWN})),
f AS (SELECT *, list_contains({_DEFINED}, acronym) AS defined FROM u WHERE r = 1)"""


@query(f"WITH {_FIRST} SELECT file_path, seq, concat('缩写“', acronym, '”首次出现，应当给出全称。') AS message, 'ACRONYM_FIRST_USE' AS code FROM f WHERE NOT defined")
def acronym_first_use(spark, sf_dir):
    return checks.abbreviations(thesis(spark, sf_dir)).select("file_path", "seq", "message", "code")


@query(f"WITH {_FIRST} SELECT file_path, seq, concat('缩写“', acronym, '”首次出现，应当给出全称。') AS message FROM f WHERE NOT defined AND (file_ord > 7 OR file_ord = 7 AND seq >= 100)")
def acronym_first_use_since(spark, sf_dir):
    return checks.abbreviations(thesis(spark, sf_dir), (7, 100)).select("file_path", "seq", "message")


def _density_sql(scope: str) -> str:
    part = "PARTITION BY file_ord" if scope == "file" else ""
    return f"""WITH {E}, o AS (SELECT *, CASE type WHEN 'chapter' THEN 0 WHEN 'section' THEN 1 WHEN 'subsection' THEN 2 WHEN 'subsubsection' THEN 3 END AS level FROM e WHERE type IN ('sentence', 'chapter', 'section', 'subsection', 'subsubsection')),
g AS (SELECT *, count(level) OVER ({part} ORDER BY file_ord, seq) AS h FROM o),
c AS (SELECT {"file_ord, " if part else ""}h, count(*) FILTER (WHERE level IS NULL) AS n, max(level) AS level, max(content) FILTER (WHERE level IS NOT NULL) AS content, max(seq) FILTER (WHERE level IS NOT NULL) AS seq, max(file_path) FILTER (WHERE level IS NOT NULL) AS file_path FROM g GROUP BY ALL)
SELECT a.file_path, a.seq, concat('章节“', a.content, '”过于简短，建议丰富内容。') AS message FROM c a LEFT JOIN c b ON b.h = a.h + 1 {"AND a.file_ord = b.file_ord" if part else ""}
WHERE a.h > 0 AND a.n < 3 AND NOT coalesce(b.level > a.level, false)"""


@query(_density_sql("corpus"))
def section_density_corpus(spark, sf_dir):
    return checks.density(thesis(spark, sf_dir)).select("file_path", "seq", "message")


@query(_density_sql("file"))
def section_density_file(spark, sf_dir):
    return checks.density(thesis(spark, sf_dir), scope="file").select("file_path", "seq", "message")


@query(f"WITH {E} SELECT file_path, seq, CASE type WHEN 'figure' THEN '图缺少 \\caption{{...}}。' ELSE '表缺少 \\caption{{...}}。' END AS message FROM e WHERE type IN ('figure', 'table') AND has_caption IS NOT TRUE")
def caption_check(spark, sf_dir):
    return checks.captions(thesis(spark, sf_dir)).select("file_path", "seq", "message")


_ALL = f"""{_FIRST}, q AS (SELECT 0 AS ord, file_path, file_ord, seq, '句子缺少句末标点。' AS message, NULL AS code FROM e WHERE type = 'sentence' AND {trim("content")} <> '' AND NOT {terminal("content")}
UNION ALL SELECT 1, file_path, file_ord, seq, concat('缩写“', acronym, '”首次出现，应当给出全称。'), 'ACRONYM_FIRST_USE' FROM f WHERE NOT defined
UNION ALL SELECT 2, file_path, CAST(regexp_extract(file_path, '[0-9]+') AS BIGINT), seq, message, NULL FROM ({_density_sql("corpus").replace("WITH " + E + ", o", "WITH o")}) z
UNION ALL SELECT 3, file_path, file_ord, seq, CASE type WHEN 'figure' THEN '图缺少 \\caption{{...}}。' ELSE '表缺少 \\caption{{...}}。' END, NULL FROM e WHERE type IN ('figure', 'table') AND has_caption IS NOT TRUE)"""


@query(
    f"""WITH {_ALL}, n AS (SELECT coalesce(code, message) AS key, *, row_number() OVER (PARTITION BY coalesce(code, message) ORDER BY ord, file_ord, seq, message) AS r FROM q)
SELECT key, count(*) AS n, min(ord) AS check_no, string_agg(concat(file_path, ':', seq + 1, ' ', message), chr(10) ORDER BY r) FILTER (WHERE r <= 5) AS samples FROM n GROUP BY key"""
)
def diagnostic_summary(spark, sf_dir):
    found = reports.diagnostic_summary(checks.analyze(thesis(spark, sf_dir)), ["ord", "file_ord", "seq"])
    line = lambda r: F.concat(r["file_path"], F.lit(":"), r["line"].cast("string"), F.lit(" "), r["message"])
    return found.select("key", "n", F.col("samples")[0]["ord"].alias("check_no"), F.array_join(F.transform("samples", line), "\n").alias("samples"))


@query(f"WITH {_ALL} SELECT file_path, count(*) AS n, md5(string_agg(concat(ord, ' ', seq, ' ', message, ' ', coalesce(code, '')), chr(10) ORDER BY ord, file_ord, seq, message)) AS rows_md5 FROM q GROUP BY file_path")
def publish_by_file(spark, sf_dir):
    found = reports.by_file(checks.analyze(thesis(spark, sf_dir)), ["ord", "file_ord", "seq", "message"])
    line = lambda r: F.concat_ws(" ", r["ord"].cast("string"), r["seq"].cast("string"), r["message"], F.coalesce(r["code"], F.lit("")))
    return found.select("file_path", F.size("diagnostics").cast("long").alias("n"), F.md5(F.array_join(F.transform("diagnostics", line), "\n")).alias("rows_md5"))


# --- increments --------------------------------------------------------------------------------


def _keyed_sql(name: str, sql: str) -> str:
    return f"""{name} AS (SELECT *, concat_ws(':', file_path, type, content_hash, CAST(occurrence AS VARCHAR)) AS element_key FROM
(SELECT *, CAST(row_number() OVER (PARTITION BY file_path, type, content_hash ORDER BY seq) - 1 AS INTEGER) AS occurrence FROM (SELECT *, {hashed("content")} AS content_hash FROM ({sql}) r) r) r)"""


_CUR, _OLD = _keyed_sql("c", THESIS), _keyed_sql("p", PREVIOUS)
_RUNS = f"{_CUR}, {_OLD}"


def _runs(spark, sf_dir):
    return incremental.keyed(thesis(spark, sf_dir)), incremental.keyed(thesis(spark, sf_dir, PREVIOUS))


@query(f"SELECT doc_id, {hashed('text')} AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query(f"WITH {_CUR} SELECT file_path, seq, occurrence, element_key FROM c")
def element_keys(spark, sf_dir):
    return incremental.keyed(thesis(spark, sf_dir)).select("file_path", "seq", "occurrence", "element_key")


@query(f"WITH {_RUNS} SELECT coalesce(c.element_key, p.element_key) AS element_key, CASE WHEN p.element_key IS NULL THEN 'new' WHEN c.element_key IS NULL THEN 'removed' ELSE 'unchanged' END AS status FROM c FULL JOIN p ON c.element_key = p.element_key")
def element_diff(spark, sf_dir):
    return incremental.difference(*_runs(spark, sf_dir)).select("element_key", "status")


@query(f"WITH {_RUNS} SELECT (SELECT count(*) FROM c WHERE element_key NOT IN (SELECT element_key FROM p)) AS added, (SELECT count(*) FROM p WHERE element_key NOT IN (SELECT element_key FROM c)) AS deleted, (SELECT count(*) FROM p WHERE type = 'sentence' AND element_key NOT IN (SELECT element_key FROM c)) AS deleted_sentences")
def incremental_summary(spark, sf_dir):
    return incremental.summary(incremental.difference(*_runs(spark, sf_dir)))


@query(f"WITH {_RUNS} SELECT element_key FROM c WHERE type = 'sentence' AND element_key NOT IN (SELECT element_key FROM p)")
def changed_sentences(spark, sf_dir):
    now, old = _runs(spark, sf_dir)
    return incremental.changed(now, old, "sentence").select("element_key")


@query(f"WITH {_RUNS}, b AS (SELECT element_key FROM p WHERE type = 'sentence') SELECT element_key FROM c WHERE type IN ('figure', 'table') AND element_key NOT IN (SELECT element_key FROM b)")
def changed_captions(spark, sf_dir):
    now, old = _runs(spark, sf_dir)
    return incremental.changed(now, old.filter("type = 'sentence'"), "figure", "table").select("element_key")


@query(f"WITH {_RUNS} SELECT file_ord, seq FROM (SELECT c.file_ord, c.seq FROM c WHERE type = 'sentence' AND element_key NOT IN (SELECT element_key FROM p WHERE element_key IN (SELECT element_key FROM c)) ORDER BY 1, 2 LIMIT 1)")
def earliest_changed(spark, sf_dir):
    now, old = _runs(spark, sf_dir)
    return incremental.earliest_changed(now, old.join(now.select("element_key"), "element_key", "left_semi"))


@query(f"WITH {_RUNS} SELECT DISTINCT file_path FROM c WHERE type IN ('chapter', 'section', 'subsection', 'subsubsection')")
def section_files(spark, sf_dir):
    now, old = _runs(spark, sf_dir)
    return incremental.section_files(now.filter("type <> 'sentence'"), old)


@query(f"WITH {_RUNS} SELECT DISTINCT file_path FROM c WHERE type IN ('sentence', 'chapter', 'section', 'subsection', 'subsubsection') AND element_key NOT IN (SELECT element_key FROM p)")
def section_files_changed(spark, sf_dir):
    now, old = _runs(spark, sf_dir)
    return incremental.section_files(now, old.join(now.select("element_key"), "element_key", "left_semi"))


_CACHED = f"k AS (SELECT *, 'punctuation' AS rule FROM p WHERE type = 'sentence' AND {trim('content')} <> '' AND NOT {terminal('content')})"


def _cached(spark, sf_dir):
    now, old = _runs(spark, sf_dir)
    return now, old, checks.punctuation(old)


@query(f"WITH {_RUNS}, {_CACHED} SELECT element_key, rule FROM k WHERE element_key IN (SELECT element_key FROM c) AND seq % 10 <> 0")
def cached_logic_filter(spark, sf_dir):
    now, _, cached = _cached(spark, sf_dir)
    recheck = cached.filter("seq % 10 = 0").select("rule", "element_key")
    return incremental.still_valid(cached, now, recheck, llm=False).select("element_key", "rule")


@query(f"WITH {_RUNS}, {_CACHED} SELECT k.element_key, coalesce(c.seq, k.seq) AS seq, CAST(coalesce(c.seq, k.seq) AS INTEGER) AS start_line FROM k LEFT JOIN c ON c.element_key = k.element_key")
def range_rebind(spark, sf_dir):
    now, _, cached = _cached(spark, sf_dir)
    moved = cached.withColumn("start_line", F.lit(-1)).withColumn("seq", F.when(F.col("file_path") == "gone.tex", F.col("seq")).otherwise(F.col("seq")))
    cached = moved.withColumn("start_line", F.col("seq").cast("int"))
    return incremental.rebound(cached, now).select("element_key", "seq", "start_line")


@query(f"WITH {_RUNS} SELECT file_path, seq, content FROM p WHERE file_path NOT IN (SELECT file_path FROM c WHERE file_ord < 5) UNION ALL SELECT file_path, seq, content FROM c WHERE file_ord < 5")
def incremental_merge(spark, sf_dir):
    now, old = _runs(spark, sf_dir)
    return incremental.merged(old, now.filter("file_ord < 5")).select("file_path", "seq", "content")


@query(f"WITH {_CUR} SELECT file_path, CAST(seq AS INTEGER) AS start_line, element_key FROM c")
def keys_by_location(spark, sf_dir):
    return incremental.key_by_location(incremental.keyed(thesis(spark, sf_dir))).select("file_path", "start_line", "element_key")


# --- reviews -----------------------------------------------------------------------------------


def _answers(spark, sf_dir):
    return review.parsed_answers(made(spark, sf_dir, ANSWERS, "orders"))


_PARSED = f"""r AS ({ANSWERS}), m AS (SELECT *, CAST(id % 6 AS INT) AS k FROM r),
i AS (SELECT id, k, cust, msg AS message, CASE WHEN k IN (1, 2) THEN 'error' ELSE 'warning' END AS severity, 1 AS pos, CASE k WHEN 1 THEN '本文研究。' WHEN 2 THEN 'x' WHEN 3 THEN '”y' ELSE 'z' END AS rewrite FROM m WHERE k IN (1, 2, 3, 4)
UNION ALL SELECT id, k, cust, 'second', 'warning', 2, 'x' FROM m WHERE k = 2)"""


@query(f"WITH {_PARSED} SELECT id, message, severity, rewrite FROM i")
def review_issues(spark, sf_dir):
    rows = review.issues(_answers(spark, sf_dir))
    return rows.select("id", "message", F.col("issue_severity").alias("severity"), "rewrite")


@query(f"WITH r AS ({ANSWERS}) SELECT id, CAST(CASE CAST(id % 6 AS INT) WHEN 0 THEN 0 WHEN 5 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS n FROM r")
def review_parse_kv(spark, sf_dir):
    return _answers(spark, sf_dir).select("id", F.size("issues").alias("n"))


def _filter_sql(*kept: int) -> str:
    """The pairs of ANSWERS that pass by the rules, by hand: 0 a doubled word, 1 a function word, 4 three of them, 5 and 10 near pairs.

    Of the messages 0 names punctuation, 1 style, 2 is a key=value line, 3 is weak; the sentence of 4 lacks
    the fragment, that of 5 has the corrected one, too, which rejects pairs neither of which holds the other.
    """
    return f"WITH {_PARSED} SELECT id, message, severity FROM i WHERE pos = 1 AND cust % 4 <> 3 AND id % 11 IN ({', '.join(map(str, kept))}) AND cust % 13 > 3 AND cust % 13 <> 4 AND NOT (cust % 13 = 5 AND id % 11 IN (5, 10))"


@query(_filter_sql(0, 1, 5, 10))
def issue_filter_low_fp(spark, sf_dir):
    return review.accepted(review.issues(_answers(spark, sf_dir)), review.LOW).select("id", "message", F.col("issue_severity").alias("severity"))


@query(_filter_sql(0, 1, 4, 5, 10))
def issue_filter_high_recall(spark, sf_dir):
    return review.accepted(review.issues(_answers(spark, sf_dir)), review.HIGH).select("id", "message", F.col("issue_severity").alias("severity"))


_BODIES = """SELECT CAST(c_custkey AS BIGINT) AS id, CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN concat('{"error":{"message":"', c_name, '"}}') WHEN 1 THEN concat(' {"message":"', c_mktsegment, '"} ') WHEN 2 THEN '{"message":7}' WHEN 3 THEN concat('  ', c_name) ELSE ' ' END AS body,
concat('https://', CASE WHEN c_custkey % 2 = 0 THEN 'openrouter.ai' ELSE 'api.example.com' END, CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN '/v1' WHEN 1 THEN '/v1/' WHEN 2 THEN '/v1/chat/completions' WHEN 3 THEN '/api/v1' WHEN 4 THEN '/api/v1/' WHEN 5 THEN '/v1x' ELSE '/x' END) AS url, c_mktsegment FROM customer"""


@query(f"SELECT id, CASE CAST(id % 5 AS INT) WHEN 0 THEN json_extract_string(body, '$.error.message') WHEN 1 THEN json_extract_string(body, '$.message') WHEN 4 THEN NULL ELSE trim(body) END AS message FROM ({_BODIES}) b")
def api_error_message(spark, sf_dir):
    return made(spark, sf_dir, _BODIES, "customer").select("id", review.api_error(F.col("body")).alias("message"))


@query(
    f"""SELECT id, CASE WHEN NOT contains(url, 'openrouter.ai') THEN url ELSE concat('https://openrouter.ai', CASE CAST(id % 7 AS INT) WHEN 2 THEN '/api/v1/chat/completions' WHEN 5 THEN '/v1x' WHEN 6 THEN '/x' ELSE '/api/v1/chat/completions' END) END AS url FROM ({_BODIES}) b"""
)
def url_normalize(spark, sf_dir):
    return made(spark, sf_dir, _BODIES, "customer").select("id", review.api_url(F.col("url")).alias("url"))


@query(f"WITH {E} SELECT file_path, seq, concat('模式 lowFalsePositive。', chr(10), '待检查句子：', chr(10), content) AS prompt FROM e WHERE type = 'sentence'")
def prompt_build(spark, sf_dir):
    return checks.sentences(thesis(spark, sf_dir)).select("file_path", "seq", review.user_prompt(F.col("content")).alias("prompt"))


@query("SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 3 < 2 THEN 'highRecall' ELSE 'lowFalsePositive' END AS mode FROM customer")
def review_modes(spark, sf_dir):
    rows = made(spark, sf_dir, "SELECT CAST(c_custkey AS BIGINT) AS id, CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN ' HighRecall ' WHEN 1 THEN 'high_recall' ELSE c_mktsegment END AS v FROM customer", "customer")
    return rows.select("id", review.review_mode(F.col("v")).alias("mode"))


# --- save events -------------------------------------------------------------------------------


def _sessions_sql(gap: int) -> str:
    return f"""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > {gap * 1000} THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS saves, max_by(event_id, (ts, event_id)) AS last_file, count(DISTINCT event_id) AS files FROM s GROUP BY user_id, session"""


def _sessions(spark, sf_dir, gap):
    out = saves.sessions(table(spark, sf_dir, "events"), gap, by="user_id", file="event_id")
    return out.select("user_id", "session", "saves", "last_file", F.size("files").cast("long").alias("files"))


@query(_sessions_sql(60_000))
def debounce_sessions(spark, sf_dir):
    return _sessions(spark, sf_dir, 60_000)


@query(_sessions_sql(300_000))
def debounce_sessions_long(spark, sf_dir):
    return _sessions(spark, sf_dir, 300_000)


@query("SELECT event_id FROM events WHERE event_type <> 'click' AND event_id % 2 = 0")
def save_event_filter(spark, sf_dir):
    path = F.concat(F.lit("/w/f"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".TeX").otherwise(".txt"))
    keep = sources.is_save_event(path, F.lit("file"), F.col("event_type") == "click", F.lit(True), "/w")
    return table(spark, sf_dir, "events").filter(keep).select("event_id")
