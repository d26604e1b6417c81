"""The knowledge base that the star-schema tables give: forms and topics from page anchors, the co-link graph, and DuckDB's way to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import html_anchors
from ..functions.text import link_target, normalize_form
from ..operators import corpus, links
from .registry import table


#: Lines of orders whose pairs of parts one task makes distinct.
LINES = 250_000


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, form, topic), distinct: what each page's anchors call each target."""
    a = html_anchors(table(spark, sf_dir, "pages"))
    rows = a.select("page", normalize_form("shown").alias("form"), link_target(F.lit("Main"), F.ltrim("href", F.lit("/"))).alias("topic"))
    return rows.where("form <> '' and topic <> 'Main:'").distinct()


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.form_targets(forms(spark, sf_dir))


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, target): spellings with capitals or punctuation redirect to the plain one."""
    names = forms(spark, sf_dir).select("topic").distinct()
    plain = F.concat(F.lit("Main:"), F.lower(F.regexp_replace(F.expr("substr(topic, 6)"), r"[^\p{L}\p{N}]", "")))
    return names.select("topic", plain.alias("target")).where("target <> topic and target <> 'Main:'")


def colinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b), both ways: topics linked from one page."""
    f = forms(spark, sf_dir).select("page", "topic").distinct()
    return f.withColumnRenamed("topic", "a").join(f.withColumnRenamed("topic", "b"), "page").where("a <> b").select("a", "b").distinct()


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.merged_weights(links.link_weights(colinks(spark, sf_dir)))


def parts_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b), a < b: parts ordered together.

    Partitions are by lines, about ``LINES`` each, as their pairs are more than their bytes let expect.
    """
    lines = table(spark, sf_dir, "lineitem")
    n = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES))
    p = lines.select("l_orderkey", F.col("l_partkey").alias("p")).repartition(n, "l_orderkey").distinct()
    pairs = p.withColumnRenamed("p", "a").join(p.withColumnRenamed("p", "b").hint("merge"), "l_orderkey").where("a < b").select("a", "b")
    return pairs.repartition(n, "a", "b").distinct()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the documents to link."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def tok(x: str) -> str:
    """DuckDB's form of ``functions.text.tokens``."""
    return rf"list_filter(regexp_split_to_array(replace(replace(translate(lower({x}), '/-''', '  '), 'c++', 'cplusplus'), '.net', 'dotnet'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


FORMS = rf"""
anchors AS (SELECT page_id AS page, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS shown FROM pages),
forms AS (SELECT DISTINCT page, form, topic FROM (SELECT page, array_to_string({tok("shown")}, ' ') AS form, 'Main:' || split_part(ltrim(href, '/'), '#', 1) AS topic FROM anchors) WHERE form <> '' AND topic <> 'Main:')"""
TARGETS = FORMS + """,
targets AS (SELECT form, topic, count(*)::BIGINT AS n FROM forms GROUP BY form, topic HAVING count(*) > 1)"""
REDIRECTS = FORMS + r""",
redirects AS (SELECT * FROM (SELECT DISTINCT topic, 'Main:' || lower(regexp_replace(substr(topic, 6), '[^\p{L}\p{N}]', '', 'g')) AS target FROM forms) WHERE target <> topic AND target <> 'Main:')"""
WEIGHTS_OF = """,
near AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
degree AS (SELECT a, count(*) AS d FROM near GROUP BY a),
common AS (SELECT e.a, e.b, count(*) AS c FROM edges e JOIN near p ON p.a = e.a JOIN near q ON q.a = e.b AND q.b = p.b GROUP BY e.a, e.b),
weights AS (SELECT e.a, e.b, (coalesce(c, 0) + 1)::DOUBLE / (x.d + 1) AS w1, (coalesce(c, 0) + 1)::DOUBLE / (y.d + 1) AS w2
  FROM edges e JOIN degree x ON x.a = e.a JOIN degree y ON y.a = e.b LEFT JOIN common m ON m.a = e.a AND m.b = e.b)"""
COLINKS = """,
edges AS (SELECT DISTINCT x.topic AS a, y.topic AS b FROM forms x JOIN forms y ON x.page = y.page WHERE x.topic <> y.topic)"""
MERGED = COLINKS + WEIGHTS_OF + """,
merged AS (SELECT a AS topic, b AS context, CASE WHEN b LIKE 'Category:%' THEN sqrt(least(w1, w2)) ELSE least(w1, w2) END AS weight FROM weights)"""
PARTS = """
edges AS (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey WHERE x.l_partkey < y.l_partkey)"""
CONTEXTS = MERGED + """,
first AS (SELECT topic, context, round(weight, 12) AS weight FROM merged WHERE topic <> context),
sparse AS (SELECT topic FROM first GROUP BY topic HAVING count(*) < 10),
second AS (SELECT topic, context, round(w, 12) AS weight FROM (
  SELECT x.topic, y.context, x.weight * y.weight * 0.1::DOUBLE AS w, row_number() OVER (PARTITION BY x.topic, y.context ORDER BY x.context) AS k
  FROM first x JOIN sparse USING (topic) JOIN first y ON y.topic = x.context WHERE y.context <> x.topic AND NOT EXISTS (SELECT 1 FROM first z WHERE z.topic = x.topic AND z.context = y.context)) WHERE k = 1),
contexts AS (SELECT topic, context, weight, hops FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, context) AS k FROM (
  SELECT topic, context, weight, 1 AS hops FROM first UNION ALL SELECT topic, context, weight, 2 FROM second)) WHERE k <= 30)"""
