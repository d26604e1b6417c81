"""Queries against their SQL on rows that the given tables lack, and against brute force."""

import os
import random

import __spark_entry__ as entry
import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from mentionary.operators import profiles, resolve
from test_oracle import TABLES


def rows(t):
    return sorted((tuple(None if r[c] != r[c] else r[c] for c in sorted(r)) for r in t.to_pylist()), key=repr)


@pytest.fixture
def equal(spark, sf, tmp_path):
    """Whether a query equals its SQL where some tables are replaced."""

    def compare(name, **own):
        for t in TABLES:
            at = tmp_path / f"{t}.parquet"
            if t in own:
                pq.write_table(pa.table(own[t]), at)
            elif not at.exists():
                os.symlink(f"{sf}/{t}.parquet", at)
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
        got = entry.queries()[name](spark, str(tmp_path)).toArrow()
        want = con.execute(entry.oracle_sql()[name]).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert rows(got) == rows(want)
        return got.to_pandas()

    return compare


def test_words_beyond_the_3000th_are_linked(equal):
    got = equal("mentions", documents={"doc_id": [7], "text": ["zzz " * 3500 + "la pour de la"]})
    assert (got["start"] >= 3500).any()


def test_blank_texts_have_no_bytes_and_a_dotted_capital_is_one_character(equal):
    equal("word_lists", documents={"doc_id": [1, 2, 3, 4, 5], "text": ["", " \t", "a" * 9000, "İzmir İ", None]})


LINKING = ["mentions", "mention_sites", "site_alternatives", "candidate_weights", "context_links", "direct_links", "candidate_scores", "link_consistency", "digest_topics", "digest_links", "digest_groups", "output_groups"]


@pytest.fixture(scope="module")
def overlapping(tmp_path_factory, sf):
    """Pages and documents with forms of several words that overlap."""
    at = tmp_path_factory.mktemp("overlapping")
    names = ["alpha", "alpha beta", "beta", "beta gamma", "gamma delta alpha", "delta", "2024", "delta 7", "gamma"]
    anchor = lambda i, n: f'<a href="/T{i}">{n}</a>'
    pages = [" ".join(anchor(i if (i + k) % 4 else i + 1, n) for i, n in enumerate(names) if (i * 7 + k) % 3) for k in range(12)]
    words = "alpha beta gamma delta 2024 7 other".split()
    texts = [" ".join(words[(i * i + i * k + k) % (7 - (k % 3 == 0))] for i in range(3 + 5 * k)) for k in range(9)] + ["", None, "alpha", "other 7", "alpha x alpha x delta"]
    for t in TABLES:
        own = {"pages": {"page_id": list(range(12)), "url": [f"p{k}" for k in range(12)], "html": pages}, "documents": {"doc_id": list(range(len(texts))), "text": texts}}.get(t)
        pq.write_table(pa.table(own), at / f"{t}.parquet") if own else os.symlink(f"{sf}/{t}.parquet", at / f"{t}.parquet")
    return str(at)


@pytest.mark.parametrize("name", LINKING)
def test_linking_by_classes_equals_linking_by_mentions(name, spark, overlapping, monkeypatch):
    fast = rows(entry.queries()[name](spark, overlapping).toArrow())
    monkeypatch.setattr(profiles, "MOST_FORMS", 0)
    assert fast and fast == rows(entry.queries()[name](spark, overlapping).toArrow())


WORDS = "harbour lights burning water evening boats returned mountains forests rivers winter stays longer anywhere quiet land story another market bread".split()
TURNS = [" ".join((WORDS[4 * g :] + WORDS[: 4 * g])[: 9 + g] * 3) + f" end{k % 2}" for g in range(4) for k in range(3)] + [" ".join(f"{w}{g}" for w in WORDS) for g in range(4)]


@pytest.mark.parametrize("name", ["cosine_pairs", "tv_match"])
def test_copies_are_one_class_and_all_links_count(name, equal):
    got = equal(name, conversations={"conv_id": list(range(len(TURNS))), "turn": [1] * len(TURNS), "role": ["user"] * len(TURNS), "text": TURNS})
    assert got["class"].nunique() < len(got) and got["links"].max() >= 2


@pytest.mark.parametrize("cut", [False, True])
def test_links_do_not_depend_on_the_blocks(cut, spark, sf):
    from mentionary.operators import vectors
    from mentionary.plans.match_queries import _vectors

    v = _vectors(spark, sf)
    one, many = (sorted(map(tuple, vectors.links(v, 0.1, cut, size).collect())) for size in (10_000, 3))
    assert one == many


def test_explained_topics_stand_for_all_pairs(equal):
    got = equal("cosine_explain", conversations={"conv_id": list(range(len(TURNS))), "turn": [1] * len(TURNS), "role": ["user"] * len(TURNS), "text": TURNS})
    assert (got["links"] > 1).any() and (got["links"] == 0).any()


def test_streamed_positions_count_other_users_searches(equal):
    equal("stream_matches", customer={"c_custkey": [1, 2, 3, 4], "c_nationkey": [7, 8, None, 9]}, supplier={"s_suppkey": [1, 2, 3, 4], "s_nationkey": [7, 7, 8, None]})


def test_strong_components_send_no_table_to_the_driver(spark, monkeypatch):
    from mentionary.operators import graphs

    plans, write = [], graphs.written

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(graphs, "written", written)
    got = graphs.scc(spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 3)]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def _linked_document(rng):
    """Candidates of a document whose sites repeat, and these by context; all weights are such that sums are exact."""
    topics = [f"t{i}" for i in range(rng.randint(2, 8))]
    eighths = lambda: rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 12]) / 8
    kinds = []
    for k in range(rng.randint(1, 6)):
        own = [(0, 0, 0, t) for t in rng.sample(topics, rng.randint(1, min(3, len(topics))))]
        if rng.random() < 0.4:
            own = [(a, 2 * s, 2 * s + 1 - a % 2, t) for a in range(rng.randint(1, 3)) for s in range(rng.randint(1, 2)) for t in rng.sample(topics, rng.randint(1, 2))]
        weight = {a: eighths() for a, *_ in own}
        kinds.append([(a, s, e, f"f{k}{a}{s}", t, weight[a], eighths()) for a, s, e, t in own])
    near = {t: {x: eighths() for x in rng.sample([*topics, "x", "y", "z"], rng.randint(1, 4))} for t in topics}
    sites = [rng.choice(kinds) for _ in range(rng.randint(1, 25))]
    cands = [(1, n + 1, a, 10 * n + s, 10 * n + e, f, t, x, y) for n, own in enumerate(sites) for a, s, e, f, t, x, y in own]
    weighted = [(*c[:4], c[6], v, c[7] * c[8] * w) for c in cands for v, w in near[c[6]].items()]
    return pd.DataFrame(cands, columns=["doc", "site", "alternative", "start", "end", "form", "topic", "alt_weight", "topic_weight"]), pd.DataFrame(weighted, columns=["doc", "site", "alternative", "start", "topic", "context", "w"])


def test_pruning_by_classes_equals_pruning_by_mentions():
    for seed in range(300):
        rng = random.Random(seed)
        cands, weighted = _linked_document(rng)
        strictness = rng.choice([0.99, 0.9, 0.5])
        cands = cands.sort_values(resolve._ORDER).reset_index(drop=True)
        all_pairs = resolve.between(cands, weighted)
        site, alt, start = (cands[c].to_numpy()[:, None] for c in ("site", "alternative", "start"))
        all_pairs[(site == site.T) & ((alt != alt.T) | (start == start.T))] = 0
        want = resolve._prune(cands, all_pairs, strictness)
        got = resolve.resolved(cands, weighted, strictness)
        assert [tuple(r) for r in got.itertuples(index=False)] == [tuple(r) for r in want.itertuples(index=False)]


def test_a_document_of_many_mentions_is_resolved_by_its_classes():
    """10,000 mentions, whose pairs would take some 800 MB and minutes."""
    n, topics = 10_000, ["a", "b", "c", "d"]
    cands = pd.DataFrame([(1, s, 0, s, s, f"f{s % 3}", t, 1.0, 0.5) for s in range(n) for t in [topics[s % 3]] + ["d"] * (s % 3 == 0)], columns=["doc", "site", "alternative", "start", "end", "form", "topic", "alt_weight", "topic_weight"])
    weighted = cands.assign(context="x", w=0.25)
    got = resolve.resolved(cands, weighted, 0.99)
    assert len(got) == n and got["site"].is_unique


def test_resolution_by_profiles_equals_resolution_by_mentions(spark, overlapping, tmp_path, monkeypatch):
    for t in TABLES:
        if t == "documents":
            pq.write_table(pa.table({"doc_id": [1, 2, 3], "text": ["new x york alpha gamma", "alpha beta gamma delta alpha alpha new york", "new york"]}), tmp_path / f"{t}.parquet")
        elif t == "pages":
            html = " ".join(f'<a href="/T{i}">{n}</a>' for i, n in enumerate(["alpha", "gamma", "new york", "delta"]))
            pq.write_table(pa.table({"page_id": list(range(4)), "url": [f"p{k}" for k in range(4)], "html": [html] * 4}), tmp_path / f"{t}.parquet")
        else:
            os.symlink(f"{overlapping}/{t}.parquet", tmp_path / f"{t}.parquet")
    fast = rows(entry.queries()["resolve_mentions"](spark, str(tmp_path)).toArrow())
    readings = rows(entry.queries()["site_alternatives"](spark, str(tmp_path)).toArrow())
    monkeypatch.setattr(profiles, "MOST_FORMS", 0)
    assert fast and fast == rows(entry.queries()["resolve_mentions"](spark, str(tmp_path)).toArrow())
    assert readings == rows(entry.queries()["site_alternatives"](spark, str(tmp_path)).toArrow())


def test_tf_idf_reads_texts_once_and_counts_texts_of_one_id_and_size_as_one(spark, sf, equal):
    assert "split(" not in entry.queries()["tfidf_top100"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    texts = [" ".join(f"w{(i * k + i) % (7 + k % 3)}" for i in range(100 + k % 2)) for k in range(8)]
    equal("tfidf_top100", documents={"doc_id": [1, 1, 2, 2, 3, 4, None, None, 5, 6], "text": [*texts, "short", None]})


@pytest.mark.parametrize("graph", ["tree", "chain", "cycles", "diamonds"])
def test_closure_equals_search_and_rarely_meets_what_was_reached(graph, spark, monkeypatch):
    from mentionary.operators import graphs

    rng = random.Random(3)
    edges = {"tree": [(i, i // 2) for i in range(2, 80)], "chain": [(i, i + 1) for i in range(22)], "cycles": [(i, (i * 3 + 1) % 12) for i in range(12)] + [(0, 5), (5, 0)], "diamonds": [(rng.randrange(14), rng.randrange(14)) for _ in range(24)]}[graph]
    plans, write = [], graphs.written

    def written(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(graphs, "written", written)
    nodes = sorted({x for e in edges for x in e})
    got = graphs.closure(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long"), 20)
    want = set()
    for n in nodes:
        far, front = {n: 0}, [n]
        for hop in range(1, 21):
            front = sorted({b for a, b in edges if a in set(front)} - far.keys())
            far |= dict.fromkeys(front, hop)
        want |= {(n, m, h) for m, h in far.items()}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    if graph in ("tree", "chain"):
        assert sum("LeftAnti" in p for p in plans) <= 5


def test_parts_together_are_spread_by_lines(spark, sf, equal, monkeypatch):
    from mentionary.plans import knowledge

    monkeypatch.setattr(knowledge, "LINES", 500)
    assert knowledge.parts_together(spark, sf).rdd.getNumPartitions() >= 12
    equal("edge_clean")
