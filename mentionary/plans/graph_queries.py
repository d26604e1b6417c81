"""Queries over the topic graph and the graph of parts: weights, contexts, linking, communities, paths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, components, corpus, graphs, links, phrases, profiles, resolve
from ..sources import edges as edge_lists
from ..sources import sinks
from ..storage import written
from . import knowledge as kb
from .knowledge import COLINKS, CONTEXTS, FORMS, MERGED, PARTS, TARGETS, WEIGHTS_OF, tok
from .registry import query, table


@query(f"WITH {PARTS} SELECT a, b FROM edges UNION SELECT b, a FROM edges")
def bidirectional_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.both_ways(kb.parts_together(spark, sf_dir))


@query(f"WITH {PARTS}{WEIGHTS_OF} SELECT a, b, round(w1, 9) AS w1, round(w2, 9) AS w2 FROM weights")
def link_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.link_weights(kb.parts_together(spark, sf_dir)).select("a", "b", F.round("w1", 9).alias("w1"), F.round("w2", 9).alias("w2"))


@query(f"WITH {FORMS}{MERGED} SELECT topic, context, round(weight, 9) AS weight FROM merged")
def merged_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.merged(spark, sf_dir).withColumn("weight", F.round("weight", 9))


@query(f"WITH {FORMS}{MERGED}, r AS (SELECT topic, context, round(weight, 12) AS weight FROM merged) SELECT topic, context, round(weight, 9) AS weight, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, context) AS k FROM r) WHERE k <= 50")
def top_contexts_per_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = kb.merged(spark, sf_dir).withColumn("weight", F.round("weight", 12))
    return links.ranked(m, "topic", [F.desc("weight"), "context"], 50).withColumn("weight", F.round("weight", 9))


@query(f"WITH {FORMS}{CONTEXTS} SELECT topic, context, round(weight, 9) AS weight, hops::INT AS hops FROM contexts")
def second_order_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.all_contexts(kb.merged(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


@query(f"WITH {FORMS}{MERGED}, own AS (SELECT DISTINCT topic FROM forms) SELECT context, round(sum(weight), 9) AS weight FROM merged WHERE topic IN (SELECT topic FROM own) AND topic <> context GROUP BY context")
def context_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of the topics of all pages."""
    asked = kb.forms(spark, sf_dir).select("topic")
    return links.context_profile(asked, kb.merged(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {TARGETS}{MERGED}, t AS (SELECT topic, n FROM targets WHERE form = 'the' ORDER BY n DESC, topic LIMIT 50), c AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 12) DESC, context) AS k FROM merged)
SELECT t.topic, t.n, context, round(weight, 9) AS weight FROM t LEFT JOIN (SELECT * FROM c WHERE k <= 50) c ON c.topic = t.topic""")
def phrase_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = kb.merged(spark, sf_dir).withColumn("weight", F.round("weight", 12))
    none = spark.createDataFrame([], "form string, weight double")
    return links.phrase_query("the", kb.targets(spark, sf_dir), m, none).select("topic", "n", "context", F.round("weight", 9).alias("weight"))


@query(f"WITH {FORMS}{MERGED} SELECT x.topic AS a, y.topic AS b, round(sum(x.weight * y.weight), 9) AS dot FROM merged x JOIN merged y USING (context) WHERE x.topic < y.topic GROUP BY ALL")
def topic_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.topic_dot_products(kb.merged(spark, sf_dir)).withColumn("dot", F.round("dot", 9))


_LINKING = TARGETS + f""",
vocab AS (SELECT DISTINCT unnest(string_split(form, ' ')) AS word FROM targets),
toks AS (SELECT doc_id AS doc, {tok('text')} AS w FROM documents),
pos AS (SELECT doc, unnest(range(1, len(w) + 1)) - 1 AS pos, unnest(w) AS word FROM toks),
known AS (SELECT doc, list(pos ORDER BY pos) AS ps, list(word ORDER BY pos) AS ws FROM pos WHERE word IN (SELECT word FROM vocab) GROUP BY doc),
heads AS (SELECT doc, ps, ws, unnest(range(1, len(ps) + 1)) AS i FROM known),
spans AS (SELECT doc, ps[i] AS start, ps[i + n - 1] AS "end", array_to_string(list_slice(ws, i, i + n - 1), ' ') AS form FROM heads, (SELECT DISTINCT len(string_split(form, ' ')) AS n FROM targets) WHERE i + n - 1 <= len(ps)),
mentions AS (SELECT doc, start, "end", form FROM spans WHERE form IN (SELECT form FROM targets) AND NOT regexp_full_match(form, '[0-9]+( [0-9]+)*')),
marked AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY doc ORDER BY start, "end", form ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS opened FROM mentions),
sites AS (SELECT doc, start, "end", form, sum(opened) OVER (PARTITION BY doc ORDER BY start, "end", form)::BIGINT AS site FROM marked)"""


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions, with their sites if these are found at the same time."""
    t = kb.targets(spark, sf_dir)
    known = profiles.trie(t)
    if known is not None:
        return profiles.mentions(kb.documents(spark, sf_dir), known)
    vocabulary = t.select(F.explode(F.split("form", " ")).alias("word")).distinct()
    return phrases.mentions(phrases.known_words(kb.documents(spark, sf_dir), vocabulary), t)


@query(f'WITH {_LINKING} SELECT doc, start::INT AS start, "end"::INT AS "end", form FROM mentions')
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir).select("doc", "start", "end", "form")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _mentions(spark, sf_dir)
    return found if "site" in found.columns else phrases.sites(found)


def _profiles(spark: SparkSession, sf_dir: str, linked: bool = True) -> profiles.Documents | None:
    """Documents by the classes of their sites, with what links these if ``linked``; None if forms or candidates are too many to hold."""
    t = written(kb.targets(spark, sf_dir), "targets")
    contexts = links.all_contexts(kb.merged(spark, sf_dir)) if linked else None
    docs = kb.documents(spark, sf_dir)
    return profiles.find(docs.where("doc_id is not null") if linked else docs, t, corpus.priors(t), lambda frequency: corpus.form_weights(t, frequency), contexts)


@query(f'WITH {_LINKING} SELECT doc, start::INT AS start, "end"::INT AS "end", form, site FROM sites')
def mention_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(spark, sf_dir)


@query(f'WITH {_LINKING} SELECT doc, site, 0 AS alternative, start::INT AS start, "end"::INT AS "end", form FROM sites')
def site_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All forms of these tables are single words, so each site has one reading, which is what the SQL says; tests have the rest."""
    own = _profiles(spark, sf_dir, False)
    if own is None:
        return resolve.alternatives(_sites(spark, sf_dir))

    def one(c: profiles.Classes, kinds: np.ndarray, starts: np.ndarray) -> dict:
        each = [c.reads_of[k] for k in kinds]
        at, site = np.concatenate(each), np.repeat(np.arange(len(kinds)), [len(x) for x in each])
        return {"site": site + 1, "alternative": c.alternative[at], "start": c.read_start[at] + starts[site], "end": c.read_end[at] + starts[site], "form": (c.forms, c.read_form[at])}

    return own.map(one, "site bigint, alternative int, start int, end int, form string")


_CANDS = _LINKING + """,
df AS (SELECT form, count(DISTINCT doc) AS d FROM mentions GROUP BY form),
fw AS (SELECT form, sum(n) / max(d) AS weight FROM targets JOIN df USING (form) GROUP BY form),
pri AS (SELECT form, topic, n / sum(n) OVER (PARTITION BY form) AS prior FROM targets),
cands AS (SELECT doc, site, start, "end", form, topic, round(CASE WHEN weight <= 0.005 THEN 1.0 ELSE weight END, 12) AS aw, round(CASE WHEN weight <= 0.005 THEN 0.0 ELSE weight * prior END, 12) AS tw FROM sites JOIN fw USING (form) JOIN pri USING (form) WHERE prior > 1e-5)"""
_WEIGHTED = _CANDS + CONTEXTS + """,
weighted AS (SELECT * FROM (SELECT c.*, x.context, round(aw * tw * x.weight, 15) AS w FROM cands c JOIN contexts x USING (topic)) WHERE w > 1e-9)"""


def _cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(_sites(spark, sf_dir), "sites")
    t = written(kb.targets(spark, sf_dir), "targets")
    frequency = found.groupBy(F.col("form").alias("phrase")).agg(F.countDistinct("doc").alias("n"))
    return resolve.candidates(resolve.alternatives(found), corpus.priors(t), corpus.form_weights(t, frequency))


@query(f'WITH {_CANDS} SELECT doc, site, start::INT AS start, form, topic, round(aw, 9) AS alt_weight, round(tw, 9) AS topic_weight FROM cands')
def candidate_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _profiles(spark, sf_dir, False)

    def one(c: profiles.Classes, kinds: np.ndarray, starts: np.ndarray) -> dict:
        each = [c.of[k] for k in kinds]
        at, site = np.concatenate(each), np.repeat(np.arange(len(kinds)), [len(x) for x in each])
        return {"site": site + 1, "start": c.start[at] + starts[site], "form": (c.forms, c.form[at]), "topic": (c.topics, c.topic[at]), "alt_weight": c.alt_weight[at], "topic_weight": c.topic_weight[at]}

    cands = _cands(spark, sf_dir) if own is None else own.map(one, "site bigint, start int, form string, topic string, alt_weight double, topic_weight double")
    return cands.select("doc", "site", "start", "form", "topic", F.round("alt_weight", 9).alias("alt_weight"), F.round("topic_weight", 9).alias("topic_weight"))


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidates, and these by context, written."""
    cands = written(_cands(spark, sf_dir), "candidates")
    return written(resolve.context_weights(cands, links.all_contexts(kb.merged(spark, sf_dir))), "context-weights"), cands


def _topic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(resolve.all_topic_links(*_linked(spark, sf_dir)), "topic-links")


_LINKS = _WEIGHTED + """,
cl AS (SELECT x.doc, x.site AS site1, x.start AS start1, x.topic AS topic1, y.site AS site2, y.start AS start2, y.topic AS topic2, x.w * y.w AS weight FROM weighted x JOIN weighted y ON x.doc = y.doc AND x.context = y.context
  WHERE (x.site <> y.site OR x.start <> y.start) AND x.topic <> y.topic AND x.w * y.w > 1e-9),
dl AS (SELECT x.doc, x.site AS site1, x.start AS start1, x.topic AS topic1, y.site AS site2, y.start AS start2, y.topic AS topic2, x.w * (y.aw * y.tw) AS weight FROM weighted x JOIN cands y ON x.doc = y.doc AND x.context = y.topic
  WHERE (x.site <> y.site OR x.start <> y.start) AND x.topic <> y.topic AND x.w * (y.aw * y.tw) > 1e-9),
links AS (SELECT * FROM cl UNION ALL SELECT * FROM dl)"""
_SHAPE = "SELECT doc, topic1, topic2, count(*)::BIGINT AS n, round(sum(weight), 6) AS weight FROM {} GROUP BY doc, topic1, topic2"


def _shape(df: DataFrame) -> DataFrame:
    return df.groupBy("doc", "topic1", "topic2").agg(F.sum("n").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def _between(own: profiles.Documents, kind: int) -> DataFrame:
    def one(c: profiles.Classes, kinds: np.ndarray, starts: np.ndarray) -> dict:
        topics, n, w = c.between_topics(kinds, (kind,))
        i, j = np.nonzero(n > 0)
        return {"topic1": (c.topics, topics[i]), "topic2": (c.topics, topics[j]), "n": n[i, j], "weight": w[i, j]}

    return own.map(one, "topic1 string, topic2 string, n bigint, weight double").withColumn("weight", F.round("weight", 6))


@query(f"WITH {_LINKS} " + _SHAPE.format("cl"))
def context_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _profiles(spark, sf_dir)
    if own is not None:
        return _between(own, 0)
    return _shape(resolve.topic_links(*resolve._meeting(*_linked(spark, sf_dir))[0]))


@query(f"WITH {_LINKS} " + _SHAPE.format("dl"))
def direct_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _profiles(spark, sf_dir)
    if own is not None:
        return _between(own, 1)
    return _shape(resolve.topic_links(*resolve._meeting(*_linked(spark, sf_dir))[1]))


_ENDS = "ends AS (SELECT doc, site1 AS site, start1 AS start, topic1 AS topic, weight FROM links UNION ALL SELECT doc, site2, start2, topic2, weight FROM links)"


@query(f"WITH {_LINKS}, {_ENDS} SELECT doc, site, start::INT AS start, topic, round(sum(weight), 6) AS score FROM ends GROUP BY ALL")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _profiles(spark, sf_dir)

    def one(c: profiles.Classes, kinds: np.ndarray, starts: np.ndarray) -> dict:
        scored, n, score = c.scores(kinds)
        each = [c.of[k] for k in kinds]
        at, site = np.concatenate(each), np.repeat(np.arange(len(kinds)), [len(x) for x in each])
        place = np.searchsorted(scored, at)
        kept = n[place] > 0
        at, site, place = at[kept], site[kept], place[kept]
        return {"site": site + 1, "start": c.start[at] + starts[site], "topic": (c.topics, c.topic[at]), "score": score[place]}

    if own is not None:
        return own.map(one, "site bigint, start int, topic string, score double").withColumn("score", F.round("score", 6))
    return resolve.candidate_scores(*_linked(spark, sf_dir)).select("doc", "site", "start", "topic", F.round("score", 6).alias("score"))


@query(f"WITH {_LINKS}, {_ENDS} SELECT doc, n AS links, round(w, 3) AS weight, round(s, 3) AS scored FROM (SELECT doc, count(*)::BIGINT AS n, sum(weight) AS w FROM links GROUP BY doc) JOIN (SELECT doc, sum(weight) / 2 AS s FROM ends GROUP BY doc) USING (doc)")
def link_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's links counted from its topics, and from its candidates."""
    found = _profiles(spark, sf_dir)

    def one(c: profiles.Classes, kinds: np.ndarray, starts: np.ndarray) -> dict:
        _, n, w = c.between_topics(kinds, (0, 1))
        some = n.sum() > 0
        return {"links": np.full(int(some), n.sum()), "weight": np.full(int(some), w.sum()), "scored": np.full(int(some), (c.scores(kinds)[2] * c.here(kinds)[1]).sum() / 2)}

    if found is not None:
        return found.map(one, "links bigint, weight double, scored double").select("doc", "links", F.round("weight", 3).alias("weight"), F.round("scored", 3).alias("scored"))
    own = _linked(spark, sf_dir)
    return resolve.link_totals(resolve.all_topic_links(*own), resolve.candidate_scores(*own)).select("doc", "links", F.round("weight", 3).alias("weight"), F.round("scored", 3).alias("scored"))


@query()
def resolve_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _profiles(spark, sf_dir)
    if own is not None:
        table = own.classes.pruner()

        def one(c: profiles.Classes, kinds: np.ndarray, starts: np.ndarray) -> dict:
            site, at, weight = table.resolve(kinds)
            at = c.ordered[at]
            return {"site": site + 1, "start": c.start[at] + starts[site], "end": c.end[at] + starts[site], "form": (c.forms, c.form[at]), "topic": (c.topics, c.topic[at]), "weight": weight}

        return own.map(one, "site bigint, start int, end int, form string, topic string, weight double")
    weighted, cands = _linked(spark, sf_dir)
    return resolve.resolve(cands, weighted)


_DIGEST = _LINKS + """,
totals AS (SELECT doc, least(topic1, topic2) AS a, greatest(topic1, topic2) AS b, sum(weight) AS weight FROM links GROUP BY ALL),
dt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY weight DESC, topic) AS k FROM (SELECT doc, topic, round(sum(weight), 12) AS weight FROM (SELECT doc, a AS topic, weight FROM totals UNION ALL SELECT doc, b, weight FROM totals) GROUP BY ALL)) WHERE k <= 100)"""


def _digest(c: profiles.Classes, kinds: np.ndarray, top: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A document's ``top`` topics with their weights, and number and weight of the links between each two of these."""
    topics, n, w = c.between_topics(kinds, (0, 1))
    n, w = n + n.T, w + w.T
    total = np.round(w.sum(1), 12)
    at = np.flatnonzero(n.any(1))
    at = np.sort(at[np.lexsort((at, -total[at]))[:top]])
    return topics[at], total[at], n[np.ix_(at, at)], w[np.ix_(at, at)]


def _grouped(edges: tuple[np.ndarray, np.ndarray, np.ndarray], strictness: float, mop_up: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Topics and their groups, from links (a, b, weight)."""
    group = clustering.groups_of({(a, b): w for a, b, w in zip(*(x.tolist() for x in edges))}, strictness, mop_up)
    return np.array(list(group), np.int64), np.array(list(group.values()), np.int32)


@query(f"WITH {_DIGEST} SELECT doc, topic, round(weight, 6) AS weight FROM dt")
def digest_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _profiles(spark, sf_dir)

    def one(c: profiles.Classes, kinds: np.ndarray, starts: np.ndarray) -> dict:
        topics, total, _, _ = _digest(c, kinds)
        return {"topic": (c.topics, topics), "weight": total}

    if own is not None:
        return own.map(one, "topic string, weight double").withColumn("weight", F.round("weight", 6))
    return resolve.digest_topics(_topic_links(spark, sf_dir)).select("doc", "topic", F.round("weight", 6).alias("weight"))


@query(f"WITH {_DIGEST} SELECT t.doc, a, b, round(t.weight, 6) AS weight FROM totals t JOIN dt x ON x.doc = t.doc AND x.topic = a JOIN dt y ON y.doc = t.doc AND y.topic = b")
def digest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _profiles(spark, sf_dir)

    def one(c: profiles.Classes, kinds: np.ndarray, starts: np.ndarray) -> dict:
        topics, _, n, w = _digest(c, kinds)
        i, j = np.nonzero(np.triu(n, 1))
        return {"a": (c.topics, topics[i]), "b": (c.topics, topics[j]), "weight": np.round(w[i, j], 12)}

    if own is not None:
        return own.map(one, "a string, b string, weight double").withColumn("weight", F.round("weight", 6))
    both = _topic_links(spark, sf_dir)
    return resolve.digest_links(both, resolve.digest_topics(both)).withColumn("weight", F.round("weight", 6))


@query()
def digest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _profiles(spark, sf_dir)

    def one(c: profiles.Classes, kinds: np.ndarray, starts: np.ndarray) -> dict:
        topics, _, n, w = _digest(c, kinds)
        i, j = np.nonzero(np.triu(n, 1))
        at, group = _grouped((topics[i], topics[j], np.round(w[i, j], 12)), 0.7)
        return {"topic": (c.topics, at), "group_id": group}

    if own is not None:
        return own.map(one, "topic string, group_id int")
    both = _topic_links(spark, sf_dir)
    return clustering.cluster_topics(resolve.digest_links(both, resolve.digest_topics(both)))


@query()
def output_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _profiles(spark, sf_dir)

    def one(c: profiles.Classes, kinds: np.ndarray, starts: np.ndarray) -> dict:
        topics, w = c.weights_of(kinds)
        i, j = np.nonzero(w)
        at, group = _grouped((topics[i], topics[j], np.round(w[i, j], 12)), 0.99, True)
        return {"topic": (c.topics, at), "group_id": group}

    if own is not None:
        return own.map(one, "topic string, group_id int")
    return clustering.cluster_topics(resolve.output_edges(_topic_links(spark, sf_dir)), 0.99, True)


@query(f"WITH {PARTS} SELECT a, b, (count(*) * 2)::DOUBLE AS weight FROM (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges) GROUP BY a, b")
def edge_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = kb.parts_together(spark, sf_dir).withColumn("weight", F.lit(2.0))
    return edge_lists.with_reverse(edge_lists.clean_edges(e))  # a < b, so parallel edges are the same before they are reversed


@query(f"WITH {FORMS}{COLINKS} SELECT a AS node, (row_number() OVER (ORDER BY encode(a)) - 1)::BIGINT AS id FROM (SELECT DISTINCT a FROM edges)")
def node_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_lists.renumber(kb.colinks(spark, sf_dir).withColumn("weight", F.lit(1.0)))[1]


@query(f"WITH {FORMS}{COLINKS}" + """ SELECT format('  "{}" -- "{}" [label="1.000000"];', a, b) AS line FROM edges WHERE a < b""")
def dot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.dot_lines(kb.colinks(spark, sf_dir).where("a < b").withColumn("weight", F.lit(1.0)))


_UP = "steps AS (SELECT DISTINCT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1)"


@query(f"WITH RECURSIVE {_UP}, walk AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS hops FROM part UNION ALL SELECT start, s.b, hops + 1 FROM walk JOIN steps s ON s.a = node WHERE hops < 50) SELECT start, node, min(hops)::INT AS hops FROM walk GROUP BY ALL")
def category_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    up = p.where("p_partkey > 1").select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 2").alias("b"))
    return graphs.closure(p.select(F.col("p_partkey").alias("node")), up)


@query(f"WITH RECURSIVE {_UP}, e AS (SELECT a, b, (1 + a % 3)::DOUBLE AS weight FROM steps UNION SELECT a, b // 2, 2.5 FROM steps WHERE b > 1), walk AS (SELECT p_partkey AS start, p_partkey AS node, 0.0::DOUBLE AS d FROM part UNION ALL SELECT start, e.b, d + weight FROM walk JOIN e ON e.a = node WHERE d + weight <= 12) SELECT start, node, min(d) AS distance FROM walk GROUP BY ALL")
def bounded_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    up = p.where("p_partkey > 1").select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 2").alias("b"))
    e = up.select("a", "b", (1 + F.col("a") % 3).cast("double").alias("weight")).union(up.where("b > 1").select("a", F.expr("b div 2"), F.lit(2.5)))
    return graphs.shortest_paths(p.select(F.col("p_partkey").alias("node")), e, 12.0)


_CHAINS = "SELECT c_custkey AS a, c_custkey + 1 + c_nationkey % 2 * 1000000 AS b FROM customer"


@query(f"""WITH RECURSIVE e AS ({_CHAINS}), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk AS (SELECT DISTINCT a AS node, a AS seen FROM both_ways UNION SELECT node, b FROM walk JOIN both_ways ON a = seen)
SELECT node, min(seen) AS component FROM walk GROUP BY node""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1 + F.col("c_nationkey") % 2 * 1000000).alias("b"))
    return components.connected_components(e)


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 + 1 AS b FROM part UNION SELECT p_partkey // 3 + 1, p_partkey FROM part WHERE p_size > 25),
edges AS (SELECT DISTINCT a, b FROM e WHERE a <> b), nodes AS (SELECT a AS node FROM e UNION SELECT b FROM e),
walk AS (SELECT a AS node, b AS seen FROM edges UNION SELECT node, b FROM walk JOIN edges ON a = seen)
SELECT n.node, least(n.node, coalesce(min(x.seen), n.node)) AS component FROM nodes n LEFT JOIN (SELECT x.node, x.seen FROM walk x JOIN walk y ON x.node = y.seen AND x.seen = y.node) x ON x.node = n.node GROUP BY n.node""")
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    e = p.select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 2 + 1").alias("b")).union(p.where("p_size > 25").select(F.expr("p_partkey div 3 + 1"), F.col("p_partkey")))
    return graphs.scc(e)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component, a, b, weight), a < b: the co-link graph by connected component."""
    m = written(kb.merged(spark, sf_dir).where("topic < context").select(F.col("topic").alias("a"), F.col("context").alias("b"), "weight"), "graph")
    c = components.connected_components(m)
    return m.join(c.select(F.col("node").alias("a"), "component"), "a").select("component", "a", "b", "weight")


@query()
def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.louvain(_parts(spark, sf_dir))


@query()
def community_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return louvain(spark, sf_dir).groupBy("component", "level", "community").agg(F.count("*").alias("size"))


@query(f"""WITH {FORMS}{MERGED}, g AS (SELECT topic AS a, context AS b, weight FROM merged WHERE topic < context), c AS (SELECT DISTINCT topic AS node, lower(substr(topic, 6, 1)) AS community FROM merged),
s AS (SELECT x.community AS ca, y.community AS cb, weight FROM g JOIN c x ON x.node = a JOIN c y ON y.node = b), t AS (SELECT c, sum(weight) AS tot FROM (SELECT ca AS c, weight FROM s UNION ALL SELECT cb, weight FROM s) GROUP BY c), i AS (SELECT ca AS c, 2 * sum(weight) AS inn FROM s WHERE ca = cb GROUP BY ca)
SELECT round(sum(coalesce(inn, 0) / m - (tot / m) ** 2), 9) AS modularity FROM t LEFT JOIN i USING (c), (SELECT 2 * sum(weight) AS m FROM s)""")
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = written(kb.merged(spark, sf_dir), "merged")
    g = m.where("topic < context").select(F.col("topic").alias("a"), F.col("context").alias("b"), "weight")
    partition = m.select(F.col("topic").alias("node"), F.lower(F.substring("topic", 6, 1)).alias("community")).distinct()
    return graphs.modularity(g, partition).select(F.round("modularity", 9).alias("modularity"))


@query()
def spanning_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = written(_parts(spark, sf_dir), "parts")
    topics = e.select("component", F.col("a").alias("topic")).union(e.select("component", "b")).distinct().join(kb.targets(spark, sf_dir).select("topic").distinct(), "topic", "left_semi").select("component", "topic")
    return graphs.spanning_hierarchy(e.withColumn("weight", 1 / F.col("weight")), topics)
