"""The phrase trie, exact look-ups in it, and mentions of known forms in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import allowed_phrase, tokens
from ..storage import spread, written
from .corpus import numbered


def known_words(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut=tokens) -> DataFrame:
    """(doc, pos, k, word): a document's words of the vocabulary, with their place among those (k).

    Unknown words leave no place, so phrases may run across them.
    """
    rows = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc"), F.posexplode(cut(text_col)).alias("pos", "word"))
    return rows.join(vocabulary.select("word"), "word", "left_semi").withColumn("k", F.row_number().over(W.partitionBy("doc").orderBy("pos"))).select("doc", "pos", "k", "word")


def phrase_trie(forms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(phrase, level, parent, word, phrase_id): every prefix of every form's known words, however long.

    Ids run through the levels, and in a level by the parent's and the word's id, from 0.
    """
    words = forms.select("form").distinct().select("form", F.posexplode(F.split("form", " ")).alias("pos", "word"))
    known = words.join(dictionary.select("word", "word_id"), "word")
    paths = known.groupBy("form").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("w"))
    prefixes = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda n: F.slice("w", 1, n))).alias("w")).distinct()
    nodes = prefixes.select(F.array_join("w", " ").alias("phrase"), F.size("w").alias("level"), F.array_join(F.slice("w", 1, F.size("w") - 1), " ").alias("parent"), F.element_at("w", -1).alias("word"))
    nodes = written(nodes.join(dictionary.select("word", "word_id"), "word"), "trie-nodes")
    longest = nodes.agg(F.max("level")).first()[0] or 1
    out, ids = None, None
    for level in range(1, longest + 1):
        here = nodes.where(F.col("level") == level)
        here = here.withColumn("parent_id", F.lit(-1).cast("bigint")) if ids is None else here.join(ids.select(F.col("phrase").alias("parent"), F.col("phrase_id").alias("parent_id")), "parent")
        here = numbered(here, ["parent_id", "word_id"], "at")
        if out is None:
            here = here.withColumn("phrase_id", F.col("at"))
        else:
            here = here.crossJoin(F.broadcast(out.agg(F.count("*").alias("before")))).withColumn("phrase_id", F.col("at") + F.col("before")).drop("before")
        here = here.select("phrase", "level", "parent", "word", F.col("phrase_id").cast("bigint").alias("phrase_id"))
        out, ids = here if out is None else out.unionByName(here), here
    return out


def find_phrases(phrases: DataFrame, trie: DataFrame) -> DataFrame:
    """(phrase, phrase_id): the id of each phrase, -1 if it isn't there, null for an empty one."""
    found = phrases.select("phrase").join(trie.select("phrase", F.col("phrase_id").alias("id")), "phrase", "left")
    return found.select("phrase", F.when(F.col("phrase") != "", F.coalesce("id", F.lit(-1))).alias("phrase_id"))


def _longest(forms: DataFrame) -> int:
    """Words of the longest form, 1 at least."""
    return forms.agg(F.max(F.size(F.split("form", " ")))).first()[0] or 1


def mentions(words: DataFrame, forms: DataFrame, longest: int | None = None) -> DataFrame:
    """(doc, start, end, form): places where a document's known words, one after another, make a form.

    ``words`` as of ``known_words``; forms may have any number of words (``longest`` saves
    counting them). A row's following words come from one window, so the documents are
    shuffled once whatever the forms; forms all of digits are left out.
    """
    longest = longest or _longest(forms)
    w = W.partitionBy("doc").orderBy("k")
    row = words.withColumn("ws", F.collect_list("word").over(w.rowsBetween(0, longest - 1))).withColumn("ps", F.collect_list("pos").over(w.rowsBetween(0, longest - 1)))
    each = row.select("doc", F.col("pos").alias("start"), "ws", "ps", F.explode(F.sequence(F.lit(1), F.size("ws"))).alias("n"))
    spans = each.select("doc", "start", F.element_at("ps", F.col("n")).alias("end"), F.array_join(F.slice("ws", F.lit(1), F.col("n")), " ").alias("form"))
    return spans.join(forms.select("form").distinct(), "form", "left_semi").where(allowed_phrase("form")).select("doc", "start", "end", "form")


def sites(found: DataFrame) -> DataFrame:
    """``found`` with the site (from 1 in each document) of overlapping mentions that each belongs to."""
    w = W.partitionBy("doc").orderBy("start", "end", "form")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    return found.withColumn("__new", opened).withColumn("site", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("bigint")).drop("__new")
