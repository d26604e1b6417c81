"""Statistics of a corpus: word and phrase frequencies, surface forms, contexts, redirects, tf-idf."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import admissible_word, tokens
from ..storage import spread, written


def numbered(df: DataFrame, key: str | list[str], name: str) -> DataFrame:
    """A 0-based position in the order of ``key`` (one or several columns) over the whole table, without one task that sorts it all.

    Rows are range-partitioned by the key and sorted there; each partition's first number
    is the number of rows before it. The ranged rows are written once, so that all that
    follows sees the same ranges.
    """
    keys = [key] if isinstance(key, str) else key
    ranged = written(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "numbered")
    ranged = ranged.withColumn("__in", F.row_number().over(W.partitionBy("__part").orderBy(*keys)) - 1)
    before = ranged.groupBy("__part").agg(F.count("*").alias("__n"), F.min(F.struct(*keys)).alias("__least"))
    start = before.withColumn("__start", F.coalesce(F.sum("__n").over(W.orderBy("__least").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__part", "__start")
    return ranged.join(F.broadcast(start), "__part").withColumn(name, (F.col("__start") + F.col("__in")).cast("bigint")).drop("__part", "__in", "__start")


def document_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut=tokens) -> DataFrame:
    """(doc, word): the distinct words of each document, found before any shuffle."""
    return spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(cut(text_col))).alias("word"))


def word_document_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): in how many documents each word is. Ids are taken to be unique, so a row is a document."""
    return document_words(docs, id_col, text_col).groupBy("word").agg(F.count("*").alias("n"))


def word_dictionary(frequencies: DataFrame) -> DataFrame:
    """(word, word_id, n) of the admissible words; the id is the word's place in sorted order."""
    return numbered(frequencies.where(admissible_word("word", "n")), "word", "word_id").select("word", "word_id", "n")


def form_targets(forms: DataFrame, more_than: int = 1) -> DataFrame:
    """(form, topic, n): links of each form to each topic that are on more than ``more_than`` pages; ``forms`` is distinct by page."""
    return forms.groupBy("form", "topic").agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def targets_by_form(forms: DataFrame, more_than: int = 1) -> DataFrame:
    """(form, targets array<struct<topic, n>>) most frequent first; a form without frequent targets has an empty array."""
    n = forms.groupBy("form", "topic").agg(F.count("*").alias("n"))
    pair = F.when(F.col("n") > more_than, F.struct((-F.col("n")).alias("order"), "topic", "n"))
    return n.groupBy("form").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.struct(x["topic"].alias("topic"), x["n"].alias("n"))).alias("targets"))


def in_degree(edges: DataFrame) -> DataFrame:
    """(context, n): how many topics have each context."""
    return edges.groupBy("context").agg(F.count("*").alias("n"))


def category_in_degree(edges: DataFrame) -> DataFrame:
    """(context, n) counting only categories as sources, from 1, so that n is one more than their number."""
    return edges.where(F.col("topic").startswith("Category:")).groupBy("context").agg((F.count("*") + 1).alias("n"))


def resolve(names: DataFrame, redirects: DataFrame, hops: int = 1) -> DataFrame:
    """(topic, resolved): each name after at most ``hops`` redirects; a redirect to itself or to nothing counts for nothing, of several the smallest target."""
    clean = redirects.where("target is not null and target <> topic").groupBy("topic").agg(F.min("target").alias("target"))
    out = names.select("topic", F.col("topic").alias("resolved"))
    for _ in range(hops):
        out = out.join(clean.withColumnsRenamed({"topic": "resolved", "target": "__next"}), "resolved", "left").select("topic", F.coalesce("__next", "resolved").alias("resolved"))
    return out


def resolved_counts(targets: DataFrame, redirects: DataFrame) -> DataFrame:
    """(form, topic, n) with redirected topics added to their targets."""
    return targets.join(resolve(targets.select("topic").distinct(), redirects), "topic").groupBy("form", F.col("resolved").alias("topic")).agg(F.sum("n").alias("n"))


def priors(targets: DataFrame, least: float = 1e-5) -> DataFrame:
    """(form, topic, n, prior): a topic's share of its form's links, if above ``least``."""
    share = F.col("n") / F.sum("n").over(W.partitionBy("form"))
    return targets.withColumn("prior", share).where(F.col("prior") > least)


def form_weights(targets: DataFrame, phrase_frequency: DataFrame) -> DataFrame:
    """(form, weight): links of a form over documents that hold it, its probability of being a link."""
    return targets.groupBy("form").agg(F.sum("n").alias("links")).join(phrase_frequency.select(F.col("phrase").alias("form"), F.col("n").alias("docs")), "form").select("form", (F.col("links") / F.col("docs")).alias("weight"))


def phrase_document_frequency(docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut=tokens) -> DataFrame:
    """(phrase, n): documents that hold each of the ``phrases``, of as many words as these have.

    Candidate n-grams are made distinct inside the row, before they meet the phrases.
    """
    own = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc"), cut(text_col).alias("w"))
    sizes = sorted(r[0] for r in phrases.select(F.size(F.split("phrase", " "))).distinct().collect())  # lengths that occur, a handful
    grams = [ngrams("w", k) for k in sizes] or [F.array().cast("array<string>")]
    found = own.select("doc", F.explode(F.array_distinct(F.concat(*grams))).alias("phrase"))
    return found.join(phrases.select("phrase").distinct(), "phrase").groupBy("phrase").agg(F.count("*").alias("n"))


def ngrams(array: str | Column, k: int) -> Column:
    """Space-joined runs of ``k`` elements of an array of words."""
    a = F.col(array) if isinstance(array, str) else array
    if k == 1:
        return a
    starts = F.when(F.size(a) >= k, F.sequence(F.lit(1), F.size(a) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(a, i, k), " "))


#: Words counted at a time.
WORDS = 4_000_000


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 1, cut=tokens) -> DataFrame:
    """(doc, size, word, c, first): how often each word is in each row of at least ``least_words`` words, counted where the text is; ``first`` is true in one row of each text."""
    rows = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc"), cut(text_col).alias("w"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array(pc.fill_null(pc.list_value_length(batch.column("w")), 0), np.int64)
            kept = np.flatnonzero(size >= max(least_words, 1))
            for own in np.split(kept, np.flatnonzero(np.diff(np.cumsum(size[kept]) // WORDS)) + 1):
                words = batch.column("w").take(pa.array(own)).flatten().dictionary_encode()
                many = max(1, len(words.dictionary))
                both, c = np.unique(np.repeat(np.arange(len(own)) * many, size[own]) + np.asarray(words.indices), return_counts=True)
                row, word = np.divmod(both, many)
                first = np.r_[True, row[1:] != row[:-1]][: len(row)]
                for k in range(0, len(row), 100_000):
                    p = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(own[row[p]])), pa.array(size[own[row[p]]].astype(np.int32)), words.dictionary.take(pa.array(word[p])), pa.array(c[p].astype(np.int64)), pa.array(first[p])], names=["doc", "size", "word", "c", "first"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, size int, word string, c bigint, first boolean")


def tf_idf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = 100, least_words: int = 100, rarer_than: int = 100_000, commoner_than: int = 2, cut=tokens) -> DataFrame:
    """(word, doc, weight, rank): the ``top`` documents of each word by term frequency * ln(N div document frequency).

    Documents under ``least_words`` words are skipped; words must be in more than
    ``commoner_than`` and fewer than ``rarer_than`` documents; N div df is whole, as it
    always was in this weighting. Texts are read once, and only rows of words that are
    rare enough are shuffled, once, by word.
    """
    tf = written(term_counts(docs, id_col, text_col, least_words, cut), "term-counts")
    rows = tf.where("first")
    n = rows.count()
    if not rows.groupBy("doc", "size").count().where("count > 1").isEmpty():  # texts of one id and size count as one
        tf = tf.groupBy("doc", "size", "word").agg(F.sum("c").alias("c"))
    df = written(tf.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") > commoner_than), "document-frequencies")
    common = df.where(F.col("df") >= rarer_than).select("word")  # few, as each takes so many rows
    rarer = tf.join(F.broadcast(common), "word", "left_anti").join(df.where(F.col("df") < rarer_than), "word")
    weight = F.round(F.col("c") / F.col("size") * F.log(F.floor(F.lit(n).cast("bigint") / F.col("df"))), 12)
    ranked = rarer.select("word", "doc", weight.alias("weight"))
    rank = F.row_number().over(W.partitionBy("word").orderBy(F.desc("weight"), F.asc_nulls_last("doc")))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= top)
