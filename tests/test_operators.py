import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from mentionary.functions import markup, phonetic, text
from mentionary.operators import clustering, components, corpus, graphs, links, phrases, resolve, vectors
from mentionary.sources import edges as edge_lists
from mentionary.sources import sinks, wiki
from mentionary.streaming import matching
from pyspark.sql import functions as F

PAGE = """{{Infobox city | name = Aldmoor {{small|x}} }}
'''Aldmoor''' is a town in [[Northland|the north]] near [[River Ald#Course]] and [[Aldmoor Castle]]. <!-- [[Hidden]] -->
== History ==
Built by [[Eadric of Wick|Eadric]]; see [[Northland]]. &nbsp; [http://example.org more here]
[[Category:Towns]]
[[File:map.png|A map]]
"""


@pytest.fixture(scope="module")
def wiki_pages(spark):
    return spark.createDataFrame([("Aldmoor", PAGE), ("Old Aldmoor", "#REDIRECT [[Aldmoor]] {{R from other name}}"), ("Plain", "no links"), ("Nothing", None)], "title string, text string")


def test_links_contexts_forms_and_redirects(wiki_pages):
    found = [(r.namespace, r.target, r.shown, r.in_first_section) for r in markup.wiki_links(wiki_pages).where("title = 'Aldmoor'").orderBy("pos").collect()]
    assert ("Main", "Northland", "the north", True) in found and ("Main", "River Ald", "River Ald", True) in found
    assert ("Main", "Eadric of Wick", "Eadric", False) in found and ("Category", "Towns", "Towns", False) in found
    contexts = {r.context for r in markup.contexts(wiki_pages).where("topic = 'Main:Aldmoor'").collect()}
    assert {"Category:Towns", "Main:Northland", "Main:River Ald", "Main:Aldmoor Castle"} <= contexts and "Main:Eadric of Wick" not in contexts
    forms = {(r.form, r.topic) for r in markup.surface_forms(wiki_pages).collect()}
    assert {("the north", "Main:Northland"), ("aldmoor", "Main:Aldmoor"), ("plain", "Main:Plain")} <= forms
    assert [(r.topic, r.target) for r in markup.redirects(wiki_pages).collect()] == [("Main:Old Aldmoor", "Main:Aldmoor")]
    reason = wiki_pages.select("title", markup.redirect_reason("text").alias("r")).where("title = 'Old Aldmoor'").first().r
    assert reason == "R from other name"


def test_plain_text_and_templates(wiki_pages, spark):
    plain = wiki_pages.where("title = 'Aldmoor'").select(markup.plain_text("text").alias("t")).first().t
    assert plain.startswith("Aldmoor is a town in the north near River Ald#Course and Aldmoor Castle.") and "Infobox" not in plain and "Hidden" not in plain and "[" not in plain
    assert markup.split_templates("a {{b {{c}} d}} e {{f") == ("a  e {{f", ["{{b {{c}} d}}"])
    assert markup.split_templates(None) == (None, None)
    got = wiki_pages.select(markup.balanced_templates("text").alias("t")).where("size(t.templates) > 0").collect()
    assert len(got) == 2
    good = spark.createDataFrame([("List of towns", "x"), ("Reed", "{{surname}}"), ("Wick", "a {{town}}")], "t string, b string")
    assert [r.t for r in good.where(markup.good_page("t", "b")).collect()] == ["Wick"]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("C++ and .NET: it's well-known/Old", "(12.5,-3)", 0.5)], "s string, p string, w double")
    r = df.select(text.tokens("s").alias("t"), text.normalize("s").alias("n"), text.parse_location("p").alias("l"), text.font_weight("w").alias("f"), text.font_size("w").alias("z"), text.percent("w").alias("pc"), text.ascii_only(F.lit("aéb")).alias("a"), text.ascii_folded(F.lit("éñü")).alias("d"), text.is_non_word_char(F.lit(";")).alias("c"), text.page_url(F.lit("Main:X")).alias("u"), text.great_circle_miles(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("m"), text.squared_distance(F.lit(0), F.lit(0), F.lit(3), F.lit(4)).alias("q"), markup.word_list(F.lit(" A b  ")).alias("wl"), text.distance_weight(F.lit(0.0)).alias("dw")).first()
    assert r.t == ["cplusplus", "and", "dotnet", "its", "well", "known", "old"] and r.n == "c++ and .net: its well known old"
    assert (r.l.lat, r.l.lon) == (12.5, -3.0) and r.f == pytest.approx(8.517, abs=1e-3) and r.z == pytest.approx(17.307, abs=1e-3) and r.pc == "50%"
    assert (r.a, r.d, r.c, r.u, r.m, r.q, r.wl, r.dw) == ("ab", "enu", True, "http://en.wikipedia.org/wiki/X", pytest.approx(69.09), 25, ["a", "b"], 1.0)


@pytest.mark.parametrize("word,key", [("Smith", "SM0"), ("Schmidt", "XMT"), ("Thompson", "TMPS"), ("Knight", "NT"), ("Philip", "FLP"), ("Wright", "RT"), ("Xavier", "SF"), ("caesar", "SSR"), ("", "")])
def test_double_metaphone(word, key):
    got = phonetic.double_metaphone(word)
    assert got[: len(key)] == key or got == key


def test_trie_finds_what_was_stored(spark):
    forms = spark.createDataFrame([("new york",), ("new york city",), ("old town",), ("york",)], "form string")
    words = forms.select(F.explode(F.split("form", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    trie = phrases.phrase_trie(forms, corpus.numbered(words, "word", "word_id"))
    ids = {r.phrase: r.phrase_id for r in trie.collect()}
    assert sorted(ids.values()) == list(range(len(ids))) and set(ids) == {"new", "old", "york", "new york", "old town", "new york city"}
    asked = spark.createDataFrame([("new york",), ("new york city hall",), ("city",), ("in old town",), ("",)], "phrase string")
    assert {r.phrase: r.phrase_id for r in phrases.find_phrases(asked, trie).collect()} == {"new york": ids["new york"], "new york city hall": -1, "city": -1, "in old town": -1, "": None}


def test_mentions_run_across_unknown_words_and_make_sites(spark):
    docs = spark.createDataFrame([(1, "Big new the-unknown york city and 12 old")], "doc_id long, text string")
    forms = spark.createDataFrame([("new york",), ("york city",), ("old",), ("12",)], "form string")
    vocabulary = forms.select(F.explode(F.split("form", " ")).alias("word")).distinct()
    found = phrases.sites(phrases.mentions(phrases.known_words(docs, vocabulary), forms))
    assert sorted((r.start, r.end, r.form, r.site) for r in found.collect()) == [(1, 4, "new york", 1), (4, 5, "york city", 1), (8, 8, "old", 2)]


def brute_chains(spans):
    import itertools

    out, first, last = set(), min(s for s, _ in spans), max(e for _, e in spans)
    for n in range(1, len(spans) + 1):
        for c in itertools.combinations(sorted(range(len(spans)), key=lambda i: spans[i]), n):
            if any(spans[a][1] >= spans[b][0] for a, b in zip(c, c[1:])):
                continue
            gaps = [(first, spans[c[0]][0])] + [(spans[a][1] + 1, spans[b][0]) for a, b in zip(c, c[1:])]
            if any(a <= s < b and e <= b for a, b in gaps for s, e in spans) or any(s > spans[c[-1]][1] and e <= last for s, e in spans):
                continue
            out.add(tuple(c))
    return out


@settings(max_examples=150, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 3)), min_size=1, max_size=7))
def test_chains_are_all_fillings_without_a_fillable_gap(raw):
    spans = sorted((a, a + n) for a, n in raw)
    assert {tuple(c) for c in resolve.chains(spans)} == brute_chains(spans)


def test_chains_leave_out_the_reading_whose_leading_gap_can_be_filled():
    spans = [(0, 1), (1, 1), (2, 2), (2, 4)]
    assert sorted(resolve.chains(spans)) == [[0, 2], [0, 3]]


def test_strong_components_and_sets():
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "e"), ("b", "d"), ("a", "e"), ("a", "b"), ("d", "f")]
    assert graphs.strong_components(edges) == [["d"], ["e", "f"], ["a", "b", "c"]]
    assert graphs.strong_components(edges + edges, least=3) == [["c"], ["d"], ["e"], ["f"], ["a"], ["b"]] or len(graphs.strong_components(edges, least=2)) == 6
    s = clustering.DisjointSet(range(4))
    sizes = [s.size(0)]
    for a, b in ((0, 1), (2, 3), (0, 3)):
        s.join(a, b)
        sizes.append(s.size(a))
    assert sizes == [1, 2, 2, 4] and sorted(s.members(2)) == [0, 1, 2, 3]
    q = clustering.MinQueue()
    for k, v in ((2.0, "a"), (1.0, "b"), (1.0, "c"), (3.0, "d")):
        q.add(k, v)
    q.remove("d")
    q.add(0.5, "a")
    assert [q.pop() for _ in range(len(q))] == [(0.5, "a"), (1.0, "b"), (1.0, "c")]


CLIQUES = [(a, b, 1.0) for g in ((1, 2, 3, 4), (5, 6, 7, 8)) for i, a in enumerate(g) for b in g[i + 1 :]] + [(4, 5, 0.1), (3, 6, 0.1)]


def test_louvain_and_agglomeration_of_two_cliques(spark):
    top = graphs.louvain_levels(CLIQUES)[-1]
    assert top == {n: 1 if n < 5 else 5 for n in range(1, 9)}
    clusters, _ = clustering.agglomerate({(a, b): w for a, b, w in CLIQUES}, 0.7)
    assert sorted(clusters) == [[1, 2, 3, 4], [5, 6, 7, 8]]
    df = spark.createDataFrame([(1, *e) for e in CLIQUES], "component int, a long, b long, weight double")
    last = graphs.louvain(df).where("level = 0")
    assert {r.node: r.community for r in last.collect()} == top
    q = graphs.modularity(df, last.select("node", "community")).first().modularity
    m = 2 * sum(w for *_, w in CLIQUES)
    assert q == pytest.approx(2 * (12.0 / m - (12.2 / m) ** 2))
    assert {(r.a, r.b): round(r.weight, 6) for r in graphs.community_graph(df, last.select("node", "community")).collect()} == {(1, 1): 6.0, (1, 5): 0.2, (5, 5): 6.0}
    assert clustering.complete_linkage({(1, 2): 1.0, (2, 3): 1.5, (1, 3): 9.0}, 2.0) == [[1, 2], [3]]
    assert clustering.set_distance([1], [2, 3], {(1, 2): 0.5}) == pytest.approx(2.0)


def test_components_and_scc_on_random_graphs(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    df = spark.createDataFrame(edges, "a long, b long")
    sets = clustering.DisjointSet()
    for a, b in edges:
        sets.join(a, b)
    assert {x.node: x.component for x in components.connected_components(df).collect()} == {n: min(sets.members(n)) for e in edges for n in e}
    want = {n: c[0] for c in graphs.strong_components(edges) for n in c}
    assert {x.node: x.component for x in graphs.scc(df).collect()} == want
    assert components.connected_components(df.where("false")).count() == 0


def test_hierarchy_keeps_topics_connected():
    edges = [("t1", "c1", 1.0), ("t2", "c1", 1.0), ("c1", "c2", 1.0), ("c2", "c3", 1.0), ("c3", "t3", 1.0), ("t1", "x", 5.0), ("x", "t3", 5.0), ("y", "z", 1.0)]
    h = graphs.TopicHierarchy(edges, {"t1", "t2", "t3", "t9"})
    tree = h.build()
    parents = {n: p for n, p, _ in tree}
    assert set(parents) == {"t1", "t2", "t3", "t9", "c1"} and sum(p is None for p in parents.values()) == 2
    lines = graphs.tree_lines(tree)
    assert len(lines) == 5 and all(any(t in x for x in lines) for t in ("t1", "t2", "t3", "t9"))
    paths = graphs.dijkstra(["t1"], {"t1": {"a": 1.0}, "a": {"b": 2.0}}, visit=lambda n, d: d < 1)
    assert paths["a"] == (1.0, "t1") and "b" not in paths


def test_closure_and_shortest_paths_on_cycles(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 5.0), (1, 4, 9.0)], "a long, b long, weight double")
    start = spark.createDataFrame([(1,)], "node long")
    assert {r.node: r.hops for r in graphs.closure(start, e).collect()} == {1: 0, 2: 1, 4: 1, 3: 2}
    assert {r.node: r.distance for r in graphs.shortest_paths(start, e).collect()} == {1: 0.0, 2: 1.0, 3: 2.0, 4: 7.0}
    banned = spark.createDataFrame([(2,)], "node long")
    assert {r.node for r in graphs.closure(start, e, banned=banned).collect()} == {1, 4}


def test_prune_leaves_one_topic_for_each_form_and_prefers_linked_ones(spark):
    import pandas as pd

    c = pd.DataFrame([(1, 0, 0, 0, "python", "Snake"), (1, 0, 0, 0, "python", "Language"), (2, 0, 2, 2, "java", "Island"), (2, 0, 2, 2, "java", "Java language"), (3, 0, 4, 4, "code", "Code")], columns=["site", "alternative", "start", "end", "form", "topic"])
    k = pd.DataFrame([(1, 0, 0, "Language", 2, 0, 2, "Java language", 0.5), (1, 0, 0, "Language", 3, 0, 4, "Code", 0.4), (2, 0, 2, "Java language", 3, 0, 4, "Code", 0.4), (1, 0, 0, "Snake", 2, 0, 2, "Island", 0.1)], columns=["site1", "alternative1", "start1", "topic1", "site2", "alternative2", "start2", "topic2", "weight"])
    out = resolve.prune(c, k)
    assert out["topic"].tolist() == ["Language", "Java language", "Code"] and (out["weight"] > 0).all()


def test_vectors(spark):
    v = spark.createDataFrame([(1, "x", 1.0, True), (1, "y", 2.0, False), (2, "x", 2.0, True), (2, "z", 1.0, False), (3, "q", 0.0, True)], "doc long, topic string, weight double, primary boolean")
    got = {(r.a, r.b): r.cosine for r in vectors.cosine(v, v).collect()}
    assert got[1, 2] == pytest.approx(2 / (5**0.5 * 5**0.5)) and got[1, 2] == got[2, 1] and got[3, 3] is None
    pair = spark.createDataFrame([(1, 2)], "a long, b long")
    assert vectors.match(pair, v, v).first().similarity == pytest.approx(1.0)
    assert vectors.without_solitary(pair, v, "a", False).count() == 1
    assert {(r.row, r.col) for r in vectors.grid(v, ["doc", "topic"], 2).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)}
    assert vectors.top_weights(v, spark.createDataFrame([(1, 1), (2, 2)], "doc long, keep int")).count() == 3


def test_link_weights_of_a_triangle_with_a_tail(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "a long, b long")
    assert {(r.a, r.b): (r.w1, r.w2) for r in links.link_weights(e).collect()} == {(1, 2): (2 / 3, 2 / 3), (2, 3): (2 / 3, 2 / 4), (1, 3): (2 / 3, 2 / 4), (3, 4): (1 / 4, 1 / 2)}


def test_link_weights_equal_sets_of_neighbours_with_loops_and_hubs(spark):
    r = random.Random(11)
    edges = {(r.randrange(25), r.randrange(25)) for _ in range(90)} | {(0, i) for i in range(25)} | {(3, 3)}
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    got = {(x.a, x.b): (x.w1, x.w2) for x in links.link_weights(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert got.keys() == edges
    for a, b in edges:
        common = 1 + len(near[a] & near[b])
        assert got[a, b] == pytest.approx((common / (1 + len(near[a])), common / (1 + len(near[b]))))


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "dump.xml").write_text("<mediawiki><page><title>A</title><id>1</id><revision><id>7</id><text>one [[B]]</text></revision></page><page><title>B</title><id>2</id><revision><id>8</id><text/></revision></page></mediawiki>")
    import bz2

    (tmp_path / "dump.xml.bz2").write_bytes(bz2.compress((tmp_path / "dump.xml").read_bytes()))
    for name in ("dump.xml", "dump.xml.bz2"):
        assert sorted((r.title, r.id, r.revision, r.text) for r in wiki.read_dump(spark, str(tmp_path / name)).collect()) == [("A", 1, 7, "one [[B]]"), ("B", 2, 8, "")]
    (tmp_path / "edges.txt").write_text("1 2 0.5\n2 2 1\n1 2 0.25\n")
    e = edge_lists.clean_edges(edge_lists.read_edges(spark, str(tmp_path / "edges.txt"), True))
    assert {(r.a, r.b): r.weight for r in e.collect()} == {(1, 2): 0.75, (2, 1): 0.75, (2, 2): 1.0}
    assert {r.node: r.id for r in edge_lists.renumber(e)[1].collect()} == {1: 0, 2: 1}
    assert sinks.dot_document(e.where("a < b")).splitlines() == ["graph g {", '  "1" -- "2" [label="0.750000"];', "}"]
    store = wiki.put(None, spark.createDataFrame([("k", "1"), ("j", "1")], "key string, value string"))
    store = wiki.put(store, spark.createDataFrame([("k", "2")], "key string, value string"))
    assert wiki.get(store, "k").first().value == "2" and store.count() == 2
    wiki.save_kb({"redirects": spark.createDataFrame([(1, 2)], "from_id long, to_id long")}, str(tmp_path / "kb"))
    assert wiki.load_kb(spark, str(tmp_path / "kb"), "redirects")["redirects"].count() == 1
    j = spark.createDataFrame([('{"a": {"b": [1, 2]}}',), ("{bad",)], "s string").select(wiki.parse_json("s", "a struct<b: array<double>>").alias("p"), wiki.variant("s").isNull().alias("n")).collect()
    assert j[0].p.a.b == [1.0, 2.0] and not j[0].n and j[1].n
    words = spark.createDataFrame([(1, 0, "see"), (1, 1, "new"), (1, 2, "<york>")], "doc long, pos int, word string")
    found = spark.createDataFrame([(1, 1, 2, 1, "Main:NY", 0.5)], "doc long, start int, end int, site long, topic string, weight double")
    assert sinks.annotated_html(words, found).first().html == 'see <a href="http://en.wikipedia.org/wiki/NY" style="font-size:17px">new &lt;york&gt;</a>'
    linked = spark.createDataFrame([(1, 1, 1, "Main:NY", "Main:B", "Main:C", 0.1)], "doc long, site1 long, start1 int, topic1 string, topic2 string, via string, weight double")
    nested = sinks.resolution_documents(found, linked)
    assert nested.first().sites[0].peers[0].topic == "Main:B"
    sinks.write_json(nested, str(tmp_path / "json"))
    sinks.write_xml(nested, str(tmp_path / "xml"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_redirect_chains_and_counts(spark):
    r = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "D"), ("E", None)], "topic string, target string")
    n = spark.createDataFrame([(x,) for x in "ABCDE"], "topic string")
    assert {x.topic: x.resolved for x in corpus.resolve(n, r).collect()} == {"A": "B", "B": "C", "C": "C", "D": "D", "E": "E"}
    assert {x.topic: x.resolved for x in corpus.resolve(n, r, 2).collect()}["A"] == "C"
    f = spark.createDataFrame([(1, "f", "A"), (2, "f", "A"), (3, "f", "B"), (3, "g", "B")], "page long, form string, topic string")
    assert {x.form: [(t.topic, t.n) for t in x.targets] for x in corpus.targets_by_form(f).collect()} == {"f": [("A", 2)], "g": []}


def test_incremental_pairs_equal_all_pairs_in_the_end(spark):
    s = spark.createDataFrame([(i, i % 3) for i in range(6)], "search long, user long")
    p = spark.createDataFrame([(i, i % 2) for i in range(5)], "position long, user long")
    every = {(r.search, r.position) for r in matching.new_pairs(s, p, -1, -1).collect()}
    before = {(r.search, r.position) for r in matching.new_pairs(s.where("search <= 2"), p.where("position <= 1"), -1, -1).collect()}
    later = {(r.search, r.position) for r in matching.new_pairs(s, p, 2, 1).collect()}
    assert before | later == every and not before & later and len(every) == sum(a % 3 != b % 2 for a in range(6) for b in range(5))
    assert matching.high_water(s, "search") == 6 and matching.high_water(s.where("false"), "search") == 0


def test_windowed_counts_and_event_log(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 05:00:00", "a", 2.0), ("2024-01-02 01:00:00", "b", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = matching.read_stream(spark, str(tmp_path / "in"), rows.schema)
    q = matching.windowed_counts(stream).writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.event_type, r.n, r.value) for r in spark.table("windowed").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
    matching.event_log(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3


def test_lines_through_a_program(spark):
    from mentionary.sources.process import pipe

    lines = spark.createDataFrame([("abc",), (None,), ("cab",)], "line string")
    assert sorted(r.line for r in pipe(lines, "tr a-c A-C").collect()) == ["", "ABC", "CAB"]


def test_dense_vectors_meet_across_all_blocks_and_labels(spark, sf):
    import __spark_entry__ as entry
    import numpy as np

    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, m = e["vec_id"].to_numpy(), np.array(e["embedding"].tolist(), dtype=float)
    m /= np.sqrt((m * m).sum(1, keepdims=True))
    c = np.round(m @ m.T, 9)
    pairs = entry.queries()["dense_cosine"](spark, sf).toPandas()
    asked = [x for x in ids if x % 20 == 0]
    assert len(pairs) == len(asked) * (len(ids) - 1) == len(pairs[["a", "b"]].drop_duplicates()) and (pairs["a"] != pairs["b"]).all() and set(pairs["a"]) == set(asked)
    at = {x: k for k, x in enumerate(ids)}
    assert np.allclose(pairs["similarity"], c[pairs["a"].map(at), pairs["b"].map(at)], atol=1.1e-6)
    np.fill_diagonal(c, -np.inf)
    want = {(ids[i], ids[j], k + 1) for i in range(len(ids)) for k, j in enumerate(np.lexsort((ids, -c[i]))[:5])}
    top = entry.queries()["topk_per_source"](spark, sf).toPandas()
    assert set(zip(top["a"], top["b"], top["rank"])) == {w for w in want if w[0] % 20 == 0}
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), vectors.unit("embedding").alias("v"))
    small = vectors.dense_top(v, size=60).toPandas()
    assert set(zip(small["a"], small["b"], small["rank"])) == want and vectors.dense_pairs(v, 60).select("a", "b").distinct().count() == len(ids) * (len(ids) - 1) // 2


def test_dense_vectors_with_ties_nulls_and_other_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0]), (6, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    for size in (2, 100):
        got = {(r.a, r.b): r.similarity for r in vectors.dense_pairs(v, size).collect()}
        assert len(got) == 15 and got[1, 2] == got[2, 3] == 1.0 and got[1, 6] == 0.0 and got[1, 4] is None and got[1, 5] is None
        top = {(r.a, r.rank): r.b for r in vectors.dense_top(v, 2, size).collect()}
        assert top[1, 1] == 2 and top[1, 2] == 3 and top[3, 1] == 1 and top[3, 2] == 2 and top[6, 1] == 1 and top[6, 2] == 2


def test_turn_vectors_keep_common_words(spark, sf):
    import math
    from collections import Counter

    import __spark_entry__ as entry
    from mentionary.plans import match_queries

    turns = spark.read.parquet(f"{sf}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), text.words("text").alias("w")).collect()
    words = {r.doc: r.w for r in turns if r.w is not None and len(r.w) >= 20}
    df = Counter(w for ws in words.values() for w in set(ws))
    assert max(df.values()) >= 10
    want = {(d, w): c / len(ws) * math.log(len(words) // df[w]) for d, ws in words.items() for w, c in Counter(ws).items() if 1 < df[w] < 100_000}
    got = {(r.doc, r.topic): r.weight for r in match_queries._vectors(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-11 for k in want)
    by: dict = {}
    for (d, w), x in want.items():
        by.setdefault(d, {})[w] = x
    norm = {d: math.sqrt(sum(x * x for x in v.values())) for d, v in by.items()}
    cosine = {(a, b): sum(x * by[b].get(w, 0.0) for w, x in by[a].items()) / (norm[a] * norm[b]) for a in by for b in by if a < b and norm[a] and norm[b]}
    v = match_queries._vectors(spark, sf)
    pairs = {(r.a, r.b): r.cosine for r in vectors.cosine_pairs(v).collect()}
    assert pairs.keys() == {k for k, c in cosine.items() if c > 0.01} and all(abs(pairs[k] - cosine[k]) < 1e-6 for k in pairs)
    number = Counter(x for k in pairs for x in k)
    linked = {r.doc: r.links for r in entry.queries()["cosine_pairs"](spark, sf).collect()}
    assert linked.keys() == by.keys() and all(linked[d] == number[d] for d in by)
    explained = entry.queries()["cosine_explain"](spark, sf)
    assert explained.agg(F.sum("links")).first()[0] == sum(n * (n - 1) // 2 for n in Counter(w for _, w in want).values())
    ranked = entry.queries()["ranked_groups"](spark, sf)
    assert ranked.agg(F.sum("size")).first()[0] == len(want)
    own = v.withColumn("primary", F.length("topic") >= 5)
    alike = vectors.match(spark.createDataFrame(sorted(cosine), "a long, b long"), own, own).select("a", "b").collect()
    number = Counter(x for p in alike for x in p)
    assert alike and {r.doc: r.links for r in entry.queries()["tv_match"](spark, sf).collect()} == {d: number[d] for d in by}


def test_context_profile_has_the_topics_of_all_pages(spark, sf):
    import __spark_entry__ as entry
    from mentionary.plans import knowledge as kb

    want: dict = {}
    for r in kb.merged(spark, sf).collect():  # every topic here is some page's
        if r.topic != r.context:
            want[r.context] = want.get(r.context, 0.0) + r.weight
    got = {r.context: r.weight for r in entry.queries()["context_profile"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


@pytest.mark.parametrize("name", ["mentions", "candidate_weights", "digest_topics"])
def test_linking_reads_documents(name, spark, sf):
    import __spark_entry__ as entry
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sql = entry.oracle_sql()[name].replace("conv_id * 1000 + turn AS doc", "doc_id AS doc").replace("FROM conversations", "FROM documents")
    want = con.execute(sql).df()
    got = entry.queries()[name](spark, sf).toPandas()[list(want.columns)]
    assert len(want) and sorted(map(repr, got.itertuples(index=False, name=None))) == sorted(map(repr, want.itertuples(index=False, name=None)))


def test_links_by_groups_and_matrices_equal_those_row_by_row(spark):
    import random

    import numpy as np

    r = random.Random(1)
    rows = [(d, s, a, 10 * s + p, 10 * s + p, f"f{r.randrange(4)}", t, r.choice([1.0, 0.5]), r.choice([0.2, 0.4])) for d in (1, 2) for s in range(4) for a in range(2) for p in range(a + 1) for t in r.sample("ABCDE", 3)]
    cands = spark.createDataFrame(rows, "doc long, site long, alternative int, start int, `end` int, form string, topic string, alt_weight double, topic_weight double")
    near = spark.createDataFrame([(t, c, 0.1 + 0.1 * i) for i, t in enumerate("ABCDE") for c in ("A", "C", "x", "y")], "topic string, context string, weight double")
    weighted = resolve.context_weights(cands, near)
    links = resolve.context_links(weighted).unionByName(resolve.direct_links(weighted, cands))
    flat = links.toPandas()
    got = {(x.doc, x.topic1, x.topic2): (x.n, round(x.weight, 9)) for x in resolve.all_topic_links(weighted, cands).groupBy("doc", "topic1", "topic2").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).collect()}
    assert got == {k: (len(g), round(g["weight"].sum(), 9)) for k, g in flat.groupby(["doc", "topic1", "topic2"])}
    ends = ["site", "alternative", "start", "topic"]
    want: dict = {}
    for x in flat.to_dict("records"):
        for k in "12":
            key = (x["doc"], *(x[c + k] for c in ends))
            want[key] = want.get(key, 0) + x["weight"]
    scores = {(x.doc, x.site, x.alternative, x.start, x.topic): x.score for x in resolve.candidate_scores(weighted, cands).collect()}
    assert scores.keys() == want.keys() and all(abs(scores[k] - want[k]) < 1e-9 for k in want)
    c = cands.where("doc = 1").toPandas().sort_values(resolve._ORDER).reset_index(drop=True)
    a, b = resolve._linked_by(c, flat[flat["doc"] == 1]), resolve._linked_in(c, weighted.where("doc = 1").toPandas())
    assert np.allclose(a, b) and a.any()
    out = {tuple(x)[1:] for x in resolve.resolve(cands, weighted).where("doc = 1").collect()}
    assert out == {tuple(x) for x in resolve.prune(c, flat[flat["doc"] == 1]).itertuples(index=False)}


def test_merging_sets_equals_counting_all_their_pairs():
    import random

    for seed in range(30):
        r = random.Random(seed)
        weights = {(a, b): r.random() for a in range(9) for b in range(a + 1, 9) if r.random() < 0.5}
        fits = lambda a, b: (a + b) % 5 != 0
        got, _ = clustering.agglomerate(weights, 0.6, fits)
        root = {x: {x} for k in weights for x in k}
        for (a, b), _ in sorted(weights.items(), key=lambda e: (-e[1], e[0])):
            if root[a] is not root[b]:
                n = sum(fits(x, y) and (min(x, y), max(x, y)) in weights for x in root[a] for y in root[b])
                if n / (len(root[a]) * len(root[b])) >= 0.6:
                    both = root[a] | root[b]
                    for x in both:
                        root[x] = both
        assert sorted(map(sorted, got)) == sorted(sorted(s) for s in {frozenset(s) for s in root.values()} if len(s) > 1)
