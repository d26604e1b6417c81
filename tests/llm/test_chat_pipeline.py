import os
import random
import subprocess
import sys

import pytest
from mentionary.llm import chat
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def brute_fold(events: list[tuple]) -> dict:
    """Messages by one pass over the sorted log."""
    state: dict = {}
    for conv, msg, seq, kind, role, text in sorted(set(events), key=lambda e: (e[0], e[2], e[3], e[5] or "", e[4] or "")):
        m = state.setdefault((conv, msg), {"first": seq, "role": None, "text": "", "gone": False})
        m["role"] = role if role is not None else m["role"]
        if kind == "delta":
            m["text"] += "" if m["gone"] else text or ""
        elif kind == "delete":
            m["text"], m["gone"] = "", True
        else:
            m["text"], m["gone"] = text or "", False
    return {k: (m["first"], m["role"], m["text"]) for k, m in state.items() if not m["gone"]}


def test_fold_equals_one_pass_over_the_log(spark):
    r = random.Random(8)
    events = []
    for conv in range(30):
        for seq in range(r.randint(1, 25)):
            kind = r.choice(["start", "delta", "delta", "delta", "edit", "regenerate", "delete"])
            events.append((conv, r.randint(0, 3), seq, kind, r.choice([None, "user", "assistant"]), r.choice([None, "", "a", "bc ", "é"])))
    events += r.sample(events, 40)  # delivered twice
    r.shuffle(events)
    df = spark.createDataFrame(events, "conv_id long, msg long, seq long, kind string, role string, text string")
    got = {(x.conv_id, x.msg): (x.first_seq, x.role, x.text) for x in chat.fold_events(df).collect()}
    assert got == brute_fold(events)


def test_turns_come_back_whole_whatever_the_delta_size(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    whole = {r.conv_id: r.chat for r in chat.format_chats(c).collect()}
    small = {r.conv_id: r.chat for r in chat.render(chat.fold_events(chat.events_of(c, 7))).collect()}
    assert whole == small and len(whole) == c.select("conv_id").distinct().count()
    rows = sorted((r.conv_id, r.turn, r.role, r.text) for r in c.collect())
    for conv, text in whole.items():
        assert text == "".join(f"<|im_start|>{role}\n{t}<|im_end|>\n" for k, _, role, t in rows if k == conv)


def test_chat_of_awkward_tables(spark):
    rows = [(1, 0, "user", "hi<|im_end|>x", "m"), (1, 0, "user", "hi<|im_end|>x", "m"), (1, 1, "wizard", None, None), (1, 2, None, "", "m"), (None, 0, "user", "lost", "m"), (2, None, "user", "lost", "m"), (3, 5, "user", "first", "m"), (3, 5, "user", "second", "m"), (3, 4, "system", "y" * 300_000, "m")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, msg string")
    got = {r.conv_id: (r.n_messages, r.chat) for r in chat.format_chats(c).collect()}
    assert got == {1: (3, "<|im_start|>user\nhi< |im_end|>x<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>user\n<|im_end|>\n"), 3: (2, f"<|im_start|>system\n{'y' * 300_000}<|im_end|>\n<|im_start|>user\nsecond<|im_end|>\n")}
    assert chat.format_chats(c.where("false")).count() == 0


@pytest.fixture(scope="module")
def pipeline():
    sys.path.insert(0, ROOT)
    import corpus_pipeline

    return corpus_pipeline


def test_each_stage_of_the_pipeline(spark, sf, pipeline):
    from mentionary.llm.near_dup import jaccard_join
    from mentionary.storage import written

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes, toxic = docs.columns, [docs.count()], spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1")
    for name, stage in pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf), "test-stage")
        assert out.columns == columns, name
        assert out.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "toxicity":
            assert out.join(toxic, "doc_id", "left_semi").count() <= 0.1 * toxic.count()
        if name == "n-gram Jaccard join":
            assert jaccard_join(out).count() == 0
        if name == "PII":
            assert out.count() == docs.count() and out.where(F.length("text") != F.col("n_chars")).count() == 0
        docs = out
        sizes.append(out.count())
    ids = pipeline.STAGES[-1][1](spark, docs, sf)
    assert ids.count() == sizes[-1] and ids.where("not exact").count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert sorted(r.doc_id for r in pipeline.run(spark, sf).select("doc_id").collect()) == sorted(r.doc_id for r in ids.select("doc_id").collect())


def test_stages_take_awkward_and_empty_tables(spark, sf, pipeline, awkward, nothing):
    for docs in (awkward, nothing):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            assert out.where("text is null").count() == docs.where("text is null").count()
        assert pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


@pytest.mark.parametrize("parts", [(), ("corpus_pipeline.py",)])
def test_entry_works_without_this_subpackage(tmp_path, parts):
    import shutil

    for part in ("mentionary", "__spark_entry__.py", *parts):
        src = os.path.join(ROOT, part)
        shutil.copytree(src, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'word_doc_freq' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
