import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import prose
from mentionary.llm import bpe, decontam, near_dup
from mentionary.llm.queries import TOKENIZERS, VOCABULARY


def shingles(text: str, n: int = 3) -> frozenset:
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_pairs(docs: list[tuple], threshold: float, n: int = 3) -> dict:
    sets = [(i, shingles(t, n)) for i, t in docs if i is not None]
    out = {}
    for x, (a, s) in enumerate(sets):
        for b, t in sets[x + 1 :]:
            if a != b and s and t and (j := len(s & t) / len(s | t)) >= threshold:
                out[min(a, b), max(a, b)] = j
    return out


def near_copies(seed: int) -> list[tuple]:
    r = random.Random(seed)
    rows, i = [], 0
    for family in range(25):
        base = prose(seed * 100 + family, r.randint(2, 150)).split()
        shared = prose(seed, 60).split() if family % 3 == 0 else []
        for _ in range(r.choice([1, 2, 3, 12])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 3, 8])):
                words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
            rows.append((i, " ".join(words + shared)))
            i += 1
    return rows


def brute_rows(docs: list[tuple], pairs: dict) -> dict:
    """doc_id: (class_id, copies, links), by all pairs."""
    root = {i: i for i, _ in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    copies, links = dict.fromkeys(root, 0), dict.fromkeys(root, 0)
    for (a, b), j in pairs.items():
        for x in (a, b):
            links[x] += 1
            copies[x] += j == 1
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: (top(i), copies[i], links[i]) for i in root if links[i]}


def recall_of(got: dict, want: dict) -> float:
    """Share of the links that are in the rows; there may be none that brute force lacks."""
    assert got.keys() <= want.keys() and all(got[i].copies == want[i][1] and got[i].links <= want[i][2] for i in got)
    assert all(got[i].class_id >= want[i][0] for i in got)
    return sum(r.links for r in got.values()) / sum(w[2] for w in want.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_against_brute_force(spark, seed):
    docs = near_copies(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs = brute_pairs(docs, near_dup.THRESHOLD)
    got = {r.doc_id: r for r in near_dup.jaccard_join(df).collect()}
    assert len(pairs) > 100 and recall_of(got, brute_rows(docs, pairs)) >= near_dup.RECALL - 0.02
    found = {(r.doc_a, r.doc_b): r.jaccard for r in near_dup.near_pairs(df).collect()}
    assert found.keys() <= pairs.keys() and all(abs(found[k] - pairs[k]) < 1e-6 for k in found)
    rep = {a: min([a, *(x for x, y in pairs if y == a and pairs[x, y] == 1)]) for a, _ in docs}
    want = {(a, b) for (a, b), j in pairs.items() if (j < 1 and a == rep[a] and b == rep[b]) or (j == 1 and a == rep[b])}
    assert found.keys() <= want and len(found) >= 0.93 * len(want)


def test_jaccard_join_of_real_documents_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_rows(docs, brute_pairs(docs, near_dup.THRESHOLD))
    got = {r.doc_id: r for r in near_dup.jaccard_join(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert recall_of(got, want) >= near_dup.RECALL - 0.02


def test_nodes_cut_into_blocks_lose_no_pair(spark):
    r = random.Random(3)
    base = prose(77, 80).split()
    docs = [(i, " ".join(w if r.random() > 0.02 else f"n{r.randrange(10**6)}" for w in base)) for i in range(120)]
    classes = near_dup.written(near_dup.set_classes(near_dup.signatures(spark.createDataFrame(docs, "doc_id long, text string"), 3, 96)), "test-classes")
    forest = near_dup.Forest(24, 4, 0.6, 0.95)

    def seen(block):
        cells = forest.cells(classes, block)
        rows, longer, n = set(), None, 0
        assert max(len(c.m) for c in cells.collect()) <= max(4 * block, 120 if block > 100 else 0)
        for depth in forest.prefixes():
            got = forest.level(cells, depth, longer).collect()
            rows |= {x.rep for x in got if x.n is None}
            n += sum(x.n for x in got if x.n is not None)
            longer = depth
        return rows, n

    assert seen(250) == seen(9)


def test_prefixes_are_shortened_until_the_recall_is_reached(spark):
    forest = near_dup.Forest(24, 4, 0.6, 0.95)
    alike, apart = np.zeros(97, int), np.zeros(97, int)
    alike[90:] = 5
    apart[60] = 1
    assert forest.enough(8, alike) and not forest.enough(16, apart) and not forest.enough(6, apart) and not forest.enough(4, np.zeros(97, int))
    for depth in (4, 5, 8, 16):
        recall = near_dup.recall_at(depth, 4, 24)
        assert recall[96] == 1 and recall[0] == 0 and (np.diff(recall) >= -1e-9).all()
    equal = np.random.default_rng(1).random((50, 96)) < 0.8
    want = [[all(e[(4 * t + i) % 96] for i in range(7)) for t in range(24)] for e in equal]
    assert (near_dup._shared(equal, 7, 4) == np.array(want)).all()


def test_many_equal_texts_are_one_class_and_one_survivor(spark):
    docs = [(i, "the same words again and again here") for i in range(500)] + [(900, "other words that are on their own")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = near_dup.jaccard_join(df).collect()
    assert len(rows) == 500 and {(r.class_id, r.copies, r.links) for r in rows} == {(0, 499, 499)}
    assert len(near_dup.near_pairs(df).collect()) == 499
    assert sorted(r.doc_id for r in near_dup.keep_one(df).collect()) == [0, 900]


def test_an_id_with_two_texts_is_one_document(spark):
    docs = [(1, "one text of some words in it"), (5, "one text of some words in it"), (7, "one text of some words in it"), (7, "another text that nothing else is like"), (7, "one text of some words in it")]
    rows = near_dup.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {1, 5} <= {r.doc_id for r in rows}


def test_one_of_each_connected_group_stays(spark):
    docs = near_copies(5)
    want = brute_rows(docs, brute_pairs(docs, near_dup.THRESHOLD))
    kept = {r.doc_id for r in near_dup.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    roots = {i for i, _ in docs if i not in want or want[i][0] == i}
    assert roots <= kept and len(kept - roots) <= 0.05 * len(docs)


def test_more_ids_than_may_be_broadcast_are_joined(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (7,)], "gone long")
    for limit in (100, 0):
        assert sorted(r.text for r in near_dup.with_ids(docs, ids, False, limit).collect()) == ["b", "c"]
        assert [r.text for r in near_dup.with_ids(docs, ids, True, limit).collect()] == ["a"]
    with pytest.raises(ValueError):
        near_dup.shortest_prefix(0.1, 2, 0.99)
    assert near_dup.shortest_prefix(0.6, 24, 0.95) == 4


def test_jaccard_join_of_awkward_tables(awkward, nothing):
    rows = near_dup.jaccard_join(awkward).collect()
    assert rows == []  # the repeated row has one id, the others nothing in common
    assert near_dup.jaccard_join(nothing).count() == 0
    kept = near_dup.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert near_dup.keep_one(nothing).count() == 0
    assert near_dup.near_pairs(awkward).count() == 0 and near_dup.near_pairs(nothing).count() == 0


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(bpe.Vocabulary.load(VOCABULARY).tables())


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    v = bpe.Vocabulary.load(VOCABULARY)
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(v.tokens)}, special_tokens={})


def odd_texts(n: int) -> list[str]:
    r = random.Random(9)
    alphabet = ["a", "aaaa", "the", " ", "  ", "\n\n", "é", "日本", "🙂", "ing", "'s", "1", "123", "!!", "=", "\t", "\x00", "ß"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(n)]


def test_ids_equal_an_independent_encoder_and_decode_exactly(coder, reference_encoding, spark, sf):
    texts = odd_texts(400) + ["a" * 4000, "=-" * 700, " " * 900, ""] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    ids, off = coder.encode(pa.array(texts))
    back, ends = coder.decode(ids, off)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == reference_encoding.encode_ordinary(t)
        assert back[ends[i] : ends[i + 1]].tobytes() == t.encode()


def test_every_prefix_has_one_last_token_equal_to_plain_bpe(coder):
    v = bpe.Vocabulary.load(VOCABULARY)
    ranks = {t: i for i, t in enumerate(v.tokens)}
    r = random.Random(2)
    pieces = [bytes(r.choice(b"abcdetion ") for _ in range(r.randint(1, 24))) for _ in range(300)]
    ids, off = coder.encode_pieces(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)]))
    for i, p in enumerate(pieces):
        assert ids[off[i] : off[i + 1]].tolist() == [ranks[t] for t in bpe._merge(p, ranks, len(ranks))]


def test_forgetting_what_was_seen_changes_nothing(coder):
    texts = pa.array(odd_texts(200))
    small = bpe.Encoder(bpe.Vocabulary.load(VOCABULARY).tables(), remember=10)
    for _ in range(2):
        a, b = coder.encode(texts), small.encode(texts)
        assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_a_second_vocabulary_round_trips():
    e = bpe.Encoder(bpe.Vocabulary.load(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken").tables())
    texts = odd_texts(100)
    ids, off = e.encode(pa.array(texts))
    back, ends = e.decode(ids, off)
    assert [back[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:])] == texts
    with pytest.raises(ValueError):
        e.decode(np.array([10**6]), np.array([0, 1]))


def test_bpe_of_awkward_tables(awkward, nothing):
    out = bpe.encode_texts(awkward, VOCABULARY)
    rows = out.collect()
    assert len(rows) == awkward.count() and all(r.exact for r in rows if r.ids is not None)
    assert sum(r.ids is None and r.n_tokens is None for r in rows) == 2 and sum(r.ids == [] for r in rows) == 1
    assert bpe.encode_texts(nothing, VOCABULARY).count() == 0
    back = sorted(((r.doc_id or 0), r.text or "") for r in bpe.decode_ids(out, VOCABULARY).collect())
    assert back == sorted(((r.doc_id or 0), r.text or "") for r in awkward.collect())


def edit_span(item: bytes, text: bytes) -> int:
    """Fewest edits between the item and any part of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(r: random.Random, s: str, k: int) -> str:
    for _ in range(k):
        i = r.randrange(len(s))
        s = r.choice([s[:i] + r.choice("xyz") + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + r.choice("xyz") + s[i:]])
    return s


def test_leaks_equal_brute_force_alignment():
    r = random.Random(6)
    items = [prose(500 + i, r.randint(5, 40)) for i in range(12)] + ["short"]
    texts = []
    for i in range(40):
        parts = [prose(900 + i, r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            item = r.choice(items)
            parts += [edited(r, r.choice([str, str.upper])(item), r.randint(0, int(0.16 * len(item)))), prose(2000 + i, 10)]
        texts.append(r.choice([" ", "\n", ", "]).join(parts))
    index = decontam.Index.build(list(range(len(items))), items)
    got = {(f[0], int(index.ids[f[1]])) for f in decontam._best(decontam.Matcher(index).leaks(pa.array(texts)))}
    want = set()
    for d, t in enumerate(texts):
        for x, (size, k) in enumerate(zip(index.size, index.budget)):
            if edit_span(index.text[index.starts[x] : index.starts[x] + size].tobytes(), decontam.fold_text(t)) <= k:
                want.add((d, int(index.ids[x])))
    assert got == want and 10 < len(want)


def test_leaks_in_parts_of_the_benchmark_and_their_places(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = decontam.find_leaks(docs, bench).collect()
    parts = decontam.find_leaks(docs, bench, pass_bytes=2000).collect()
    key = lambda rs: sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in rs)
    assert key(rows) == key(parts)
    texts, items = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in bench.collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert exact and exact <= {(r.doc_id, r.item_id) for r in rows}
    for r in rows:
        if not r.edits and r.item_id is not None and items[r.item_id] in texts[r.doc_id]:
            assert decontam.fold_text(texts[r.doc_id][r.start : r.end]) == decontam.fold_text(items[r.item_id])
    kept = {r.doc_id for r in decontam.drop_leaked(docs, bench).collect()}
    assert kept == texts.keys() - {r.doc_id for r in rows}


def test_decontamination_of_awkward_tables(awkward, nothing, spark):
    long = awkward.where("doc_id = 6").first().text
    bench = spark.createDataFrame([(1, long[100_000:100_200], 0), (1, long[100_000:100_200], 0), (None, "x" * 100, 0), (2, None, 0), (3, "", 0), (4, "x" * 60, 0)], "item_id long, text string, doc_id int")
    rows = {(r.doc_id, r.item_id) for r in decontam.find_leaks(awkward, bench).collect()}
    assert rows == {(6, 1), (7, 4)}
    assert decontam.find_leaks(nothing, bench).count() == 0 and decontam.find_leaks(awkward, bench.where("false")).count() == 0
    kept = decontam.drop_leaked(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 2


def test_of_overlapping_findings_one_stays_however_many_lie_between():
    found = [(0, 1, 0, 100, 3)] + [(0, 1, 1000 + 200 * i, 1100 + 200 * i, 1) for i in range(60)] + [(0, 1, 5, 105, 4), (0, 2, 5, 105, 4), (1, 1, 5, 105, 4)]
    kept = decontam._best(found)
    assert (0, 1, 0, 100, 3) in kept and (0, 1, 5, 105, 4) not in kept and (0, 2, 5, 105, 4) in kept and (1, 1, 5, 105, 4) in kept and len(kept) == 63


def test_items_of_every_length_have_their_whole_budget():
    index = decontam.Index.build(list(range(40)), ["abcdefghij klmnopqrs tuvwxyz ABCDE fghij klmno pqrst"[: 24 + i].rstrip() + "z" for i in range(40)])
    assert (index.budget == np.floor(index.size * decontam.RATE + 1e-9)).all() and (index.bound >= 1).all()
