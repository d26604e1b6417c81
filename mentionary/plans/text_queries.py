"""Queries over documents and pages: words, markup, forms, phrases, tf-idf."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, text
from ..operators import corpus, links, phrases
from . import knowledge as kb
from .knowledge import FORMS, REDIRECTS, TARGETS, tok
from .registry import query, table

_WORDS = f"words AS (SELECT word, count(*)::BIGINT AS n FROM (SELECT DISTINCT doc_id, unnest({tok('text')}) AS word FROM documents) GROUP BY word)"
_DICT = _WORDS + ", dict AS (SELECT word, row_number() OVER (ORDER BY encode(word)) - 1 AS word_id, n FROM words WHERE n > 4 AND octet_length(encode(word)) < 20)"


@query(f"WITH {_WORDS} SELECT * FROM words")
def word_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.word_document_frequency(table(spark, sf_dir, "documents"))


@query(f"WITH {_DICT} SELECT word, word_id::BIGINT AS word_id, n FROM dict")
def word_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.word_dictionary(word_doc_freq(spark, sf_dir))


@query("SELECT page_id, translate(lower(url), '/-''', '  ') AS norm FROM pages")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.normalize("url").alias("norm"))


@query(f"SELECT doc_id, array_to_string({tok('text')}, ' ') AS form FROM documents")
def sf_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_form("text").alias("form"))


@query("SELECT p_partkey, CASE WHEN contains(t, ':') THEN t ELSE 'Main:' || t END AS topic FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Category:' ELSE '' END || p_name AS t FROM part)")
def topic_title_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.when(F.col("p_size") % 2 == 0, "Category:").otherwise(""), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", text.topic_title(t).alias("topic"))


@query("SELECT page_id, 'Main:' || split_part(url, '#', 1) AS target FROM pages")
def link_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.link_target(F.lit("Main"), "url").alias("target"))


_NAMES = "SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'Main:List of ' || p_name WHEN 1 THEN 'Category:' || p_name WHEN 2 THEN 'Main:' || p_name || ' (song)' WHEN 3 THEN 'Main:' || p_name || ' postcode area' WHEN 4 THEN 'Main:' || p_name || ' ' || (1900 + p_size) WHEN 5 THEN 'Main:redirect ' || p_name WHEN 6 THEN 'Main:Table of ' || p_name ELSE 'Main:' || p_name END AS name FROM part"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("p_size") % 8, F.col("p_name")
    name = F.when(k == 0, F.concat(F.lit("Main:List of "), p)).when(k == 1, F.concat(F.lit("Category:"), p)).when(k == 2, F.concat(F.lit("Main:"), p, F.lit(" (song)"))).when(k == 3, F.concat(F.lit("Main:"), p, F.lit(" postcode area")))
    name = name.when(k == 4, F.concat(F.lit("Main:"), p, F.lit(" "), (F.col("p_size") + 1900).cast("string"))).when(k == 5, F.concat(F.lit("Main:redirect "), p)).when(k == 6, F.concat(F.lit("Main:Table of "), p)).otherwise(F.concat(F.lit("Main:"), p))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


@query(f"SELECT p_partkey, NOT (starts_with(name, 'Main:List of') OR starts_with(name, 'Main:Table of') OR starts_with(name, 'Category:') OR ends_with(name, 'postcode area') OR contains(name, '(novel)') OR contains(name, '(song)') OR contains(name, '(band)') OR contains(name, 'TV series') OR contains(name, '(album)')) AS allowed FROM ({_NAMES})")
def allowed_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", text.allowed_topic("name").alias("allowed"))


@query(f"SELECT p_partkey, NOT (name IN ({', '.join(repr(c) for c in text.UNHELPFUL_CONTEXTS)}) OR regexp_matches(name, '[0-9]{{4}}') OR contains(name, 'redirect')) AS allowed FROM ({_NAMES})")
def allowed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", text.allowed_context("name").alias("allowed"))


@query("SELECT o_orderkey, NOT regexp_full_match(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey::VARCHAR || ' ' || o_custkey::VARCHAR ELSE o_orderpriority END, '[0-9]+( [0-9]+)*') AS allowed FROM orders")
def allowed_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.allowed_phrase(phrase).alias("allowed"))


@query(f"WITH {_WORDS} SELECT word, n FROM words WHERE word IN ({', '.join(repr(w) for w in text.STOP_WORDS)})")
def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_doc_freq(spark, sf_dir).where(text.is_stop_word("word"))


@query(r"""SELECT page_id AS page, (unnest(range(1, len(h) + 1)) - 1)::INT AS pos, unnest(h) AS href, unnest(s) AS shown FROM (
  SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS s FROM pages) WHERE len(h) > 0""")
def anchor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.html_anchors(table(spark, sf_dir, "pages"))


def _wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as wiki text: anchors as links, and the title that the URL gives."""
    wiki = F.regexp_replace("html", r'<a href="/?([^"#]+)(#[^"]*)?">([^<]*)</a>', "[[$1$2|$3]]")
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("title"), wiki.alias("text"))


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/?([^"#]+)(#[^"]*)?">([^<]*)</a>', 1)) AS t, unnest(regexp_extract_all(html, '<a href="/?([^"#]+)(#[^"]*)?">([^<]*)</a>', 3)) AS s FROM pages)
SELECT page_id::VARCHAR AS title, 'Main' AS namespace, trim(t) AS target, CASE WHEN s = '' THEN t ELSE s END AS shown, count(*)::BIGINT AS n FROM a GROUP BY ALL""")
def wiki_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.wiki_links(_wiki(spark, sf_dir)).groupBy("title", "namespace", "target", "shown").agg(F.count("*").alias("n"))


@query(rf"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/?([^"#]+)(#[^"]*)?">([^<]*)</a>', 1)) AS t, unnest(regexp_extract_all(html, '<a href="/?([^"#]+)(#[^"]*)?">([^<]*)</a>', 3)) AS s FROM pages)
SELECT DISTINCT * FROM (SELECT page_id::VARCHAR AS title, array_to_string({tok("CASE WHEN s = '' THEN t ELSE s END")}, ' ') AS form, 'Main:' || trim(t) AS topic FROM a
UNION ALL SELECT page_id::VARCHAR, page_id::VARCHAR, 'Main:' || page_id FROM pages) WHERE form <> ''""")
def wiki_surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.surface_forms(_wiki(spark, sf_dir))


@query(f"WITH {REDIRECTS} SELECT topic, target, 'R from other' AS reason FROM redirects")
def wiki_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = kb.redirects(spark, sf_dir)
    pages = r.select(F.col("topic").alias("title"), F.concat(F.lit("#REDIRECT [["), F.expr("substr(target, 6)"), F.lit("]] {{R from other}}")).alias("text"))
    reason = pages.select(F.col("title").alias("topic"), markup.redirect_reason("text").alias("reason"))
    return markup.redirects(pages).join(reason, "topic").select("topic", "target", "reason")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', ' ', 'g'), '(?s)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&[#A-Za-z0-9]+;', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def plain_text_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.html_text("html").alias("text"))


@query(f"WITH {TARGETS} SELECT * FROM targets")
def surface_form_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.targets(spark, sf_dir)


_EDGES = FORMS + ", ctx AS (SELECT DISTINCT topic, 'Category:' || lower(substr(topic, 6, 1)) AS context FROM forms UNION SELECT DISTINCT 'Category:' || lower(substr(topic, 6, 1)), 'Category:' || lower(substr(topic, 6, 1)) || ' topics' FROM forms UNION SELECT DISTINCT topic, 'Main:' || form FROM forms)"


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = kb.forms(spark, sf_dir)
    first = F.substring("topic", 6, 1)
    low = F.concat(F.lit("Category:"), F.lower(first))
    one = f.select("topic", low.alias("context"))
    two = f.select(low.alias("topic"), F.concat(F.lit("Category:"), F.lower(first), F.lit(" topics")).alias("context"))
    return one.union(two).union(f.select("topic", F.concat(F.lit("Main:"), "form"))).distinct()


@query(f"WITH {_EDGES} SELECT * FROM ctx")
def topic_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir)


@query(f"WITH {_EDGES} SELECT context, count(*)::BIGINT AS n FROM ctx GROUP BY context")
def context_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.in_degree(_contexts(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT context, (count(*) + 1)::BIGINT AS n FROM ctx WHERE starts_with(topic, 'Category:') GROUP BY context")
def category_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.category_in_degree(_contexts(spark, sf_dir))


@query(f"WITH {REDIRECTS} SELECT t.topic, coalesce(r.target, t.topic) AS resolved FROM (SELECT DISTINCT topic FROM forms) t LEFT JOIN redirects r ON r.topic = t.topic")
def redirect_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.resolve(kb.forms(spark, sf_dir).select("topic").distinct(), kb.redirects(spark, sf_dir))


_RESOLVED = REDIRECTS + """, targets AS (SELECT form, topic, count(*)::BIGINT AS n FROM forms GROUP BY form, topic HAVING count(*) > 1),
counted AS (SELECT form, coalesce(r.target, t.topic) AS topic, sum(n)::BIGINT AS n FROM targets t LEFT JOIN redirects r ON r.topic = t.topic GROUP BY ALL)"""


@query(f"WITH {_RESOLVED} SELECT * FROM counted")
def phrase_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.resolved_counts(kb.targets(spark, sf_dir), kb.redirects(spark, sf_dir))


@query(f"WITH {TARGETS} SELECT form, topic, n, round(prior, 9) AS prior FROM (SELECT *, n / sum(n) OVER (PARTITION BY form) AS prior FROM targets) WHERE prior > 1e-5")
def phrase_topic_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.priors(kb.targets(spark, sf_dir)).withColumn("prior", F.round("prior", 9))


_PHRASES = f"""sizes AS (SELECT DISTINCT len(string_split(form, ' ')) AS n FROM targets),
grams AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {tok('text')} AS w FROM documents)), sizes WHERE i + n - 1 <= len(w))"""


@query(f"WITH {TARGETS}, {_PHRASES} SELECT phrase, count(*)::BIGINT AS n FROM grams WHERE phrase IN (SELECT form FROM targets) GROUP BY phrase")
def phrase_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.phrase_document_frequency(table(spark, sf_dir, "documents"), kb.targets(spark, sf_dir).select(F.col("form").alias("phrase")))


@query(f"WITH {TARGETS}, {_PHRASES}, df AS (SELECT phrase, count(*) AS d FROM grams WHERE phrase IN (SELECT form FROM targets) GROUP BY phrase) SELECT form, round(links / d, 9) AS weight FROM (SELECT form, sum(n) AS links FROM targets GROUP BY form) JOIN df ON phrase = form")
def phrase_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.form_weights(kb.targets(spark, sf_dir), phrase_doc_freq(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


def _part_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = table(spark, sf_dir, "part").select(text.normalize_form("p_name").alias("form"))
    words = f.select(F.explode(F.split("form", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return f, corpus.numbered(words, "word", "word_id")


_TRIE = f"""RECURSIVE f AS (SELECT DISTINCT {tok('p_name')} AS w FROM part),
d AS (SELECT word, row_number() OVER (ORDER BY encode(word)) - 1 AS word_id FROM (SELECT DISTINCT unnest(w) AS word FROM f)),
nodes AS (SELECT DISTINCT list_slice(w, 1, n) AS w, n AS level FROM (SELECT w, unnest(range(1, len(w) + 1)) AS n FROM f)),
paths AS (SELECT array_to_string(w, ' ') AS phrase, level, array_to_string(list_slice(w, 1, level - 1), ' ') AS parent, w[level] AS word, list_transform(range(1, level + 1), lambda i: w[i]) AS p FROM nodes),
keyed AS (SELECT any_value(q.phrase) AS phrase, any_value(q.level) AS level, any_value(q.parent) AS parent, any_value(q.word) AS word, list(d.word_id ORDER BY q.i) AS k FROM (SELECT *, unnest(p) AS x, unnest(range(1, level + 1)) AS i FROM paths) q JOIN d ON d.word = q.x GROUP BY q.p),
trie AS (SELECT phrase, level::INT AS level, parent, word, (row_number() OVER (ORDER BY level, k) - 1)::BIGINT AS phrase_id FROM keyed)"""


@query(f"WITH {_TRIE} SELECT * FROM trie")
def trie_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrase_trie(*_part_words(spark, sf_dir))


@query(f"WITH {_TRIE}, asked AS (SELECT p_name AS phrase FROM part UNION SELECT p_type FROM part) SELECT lower(a.phrase) AS phrase, CASE WHEN a.phrase <> '' THEN coalesce(phrase_id, -1) END AS phrase_id FROM asked a LEFT JOIN trie t ON t.phrase = lower(a.phrase)")
def phrase_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    asked = p.select(F.col("p_name").alias("phrase")).union(p.select("p_type")).distinct()
    return phrases.find_phrases(asked.select(F.lower("phrase").alias("phrase")), trie_levels(spark, sf_dir))


@query(f"WITH {_TRIE}, asked AS (SELECT p_name AS phrase FROM part UNION SELECT p_type FROM part) SELECT count(*)::BIGINT AS total, count(t.phrase_id)::BIGINT AS found FROM asked a LEFT JOIN trie t ON t.phrase = lower(a.phrase)")
def phrase_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_lookup(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("phrase_id") >= 0).alias("found"))


@query(f"WITH {_TRIE} SELECT c.phrase_id, coalesce(p.phrase_id, -1) AS parent_id, c.phrase FROM trie c LEFT JOIN trie p ON p.phrase = c.parent AND p.level = c.level - 1")
def phrase_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trie_levels(spark, sf_dir)
    up = t.select(F.col("phrase").alias("parent"), F.col("phrase_id").alias("parent_id"))
    return t.join(up, "parent", "left").select("phrase_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "phrase")


@query(f"WITH {TARGETS} SELECT form, topic, n, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY n DESC, topic) AS k FROM targets) WHERE k <= 50")
def top_topics_per_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.ranked(kb.targets(spark, sf_dir), "form", [F.desc("n"), "topic"], 50)


@query(rf"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM documents), r AS (SELECT * FROM t WHERE len(w) >= 100),
tf AS (SELECT doc_id AS doc, size, word, count(*) AS c FROM (SELECT doc_id, len(w) AS size, unnest(w) AS word FROM r) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word HAVING count(*) > 2 AND count(*) < 100000),
s AS (SELECT word, doc, round(c / size * ln((SELECT count(*) FROM r) // df), 12) AS weight FROM tf JOIN df USING (word))
SELECT word, doc, round(weight, 9) AS weight, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY weight DESC, doc) AS k FROM s) WHERE k <= 100""")
def tfidf_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.tf_idf(table(spark, sf_dir, "documents"), cut=text.words).withColumn("weight", F.round("weight", 9))


@query("SELECT event_id, event_type, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k double")["k"].alias("k"))


@query(r"SELECT doc_id, len(w)::INT AS words, list_sum(list_transform(w, lambda x: octet_length(encode(x))))::BIGINT AS bytes FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0B]+'), lambda x: x <> '' AND octet_length(encode(x)) <= 8192) AS w FROM documents)")
def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", markup.word_list("text").alias("w"))
    return w.select("doc_id", F.size("w").alias("words"), F.when(F.size("w") > 0, F.aggregate("w", F.lit(0).cast("bigint"), lambda s, x: s + F.octet_length(x))).alias("bytes"))


@query("SELECT page_id, regexp_replace(url, '[^\\x00-\\x7F]', '', 'g') AS ascii, length(url) - length(replace(url, '/', '')) AS slashes FROM pages")
def ascii_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.ascii_only("url").alias("ascii"), (F.length("url") - F.length(F.replace("url", F.lit("/"), F.lit("")))).cast("bigint").alias("slashes"))


@query("SELECT s_suppkey, CAST(split_part(translate(p, '() ', ''), ',', 1) AS DOUBLE) AS lat, CAST(split_part(translate(p, '() ', ''), ',', 2) AS DOUBLE) AS lon, round(greatest(ln(10000.0::DOUBLE * w), 0.0), 9) AS font FROM (SELECT s_suppkey, '(' || (s_suppkey % 90) || ', -' || (s_suppkey % 180) || ')' AS p, 1.0::DOUBLE / (s_suppkey + 1) / (s_suppkey + 1) AS w FROM supplier)")
def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    p = F.concat(F.lit("("), (k % 90).cast("string"), F.lit(", -"), (k % 180).cast("string"), F.lit(")"))
    at = text.parse_location(p)
    return table(spark, sf_dir, "supplier").select("s_suppkey", at["lat"].alias("lat"), at["lon"].alias("lon"), F.round(text.font_weight(F.lit(1.0) / (k + 1) / (k + 1)), 9).alias("font"))


@query(r"SELECT page_id, NOT (regexp_matches(html, '(?i)\{\{\s*(?:disambig|hndis|geodis|surname|given name)\b') OR starts_with(url, 'List of') OR starts_with(url, 'Table of') OR starts_with(url, 'File:') OR starts_with(url, 'Template:') OR starts_with(url, 'Wikipedia:') OR starts_with(url, 'Portal:') OR starts_with(url, 'MediaWiki:')) AS good FROM pages")
def good_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.good_page("url", "html").alias("good"))


@query()
def metaphone_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.phonetic import metaphone

    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    keyed = words.select("word", metaphone("word").alias("key"))
    return keyed.join(keyed.withColumnRenamed("word", "like"), "key").select("word", "like", "key")
