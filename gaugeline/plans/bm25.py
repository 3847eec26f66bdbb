"""BM25 with statistics that add up over document types and an exact top-k by bounds.

The texts are read twice, however many groups of types are ranked: once for the counts per type and term, once
for the postings of the terms that are asked for. Everything after that works on these two tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.text import words
from gaugeline.operators.ranking import top_per_group
from gaugeline.operators.scored_texts import lists_of
from gaugeline.session import settle, ship

# BM25 constants.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: A term in more than this share of the documents is common: it adds to the score of documents that rarer
#: terms brought in, and brings in none itself unless a question needs it.
COMMON_SHARE = 0.02
#: Room for rounding where bounds are compared.
SLACK = 1e-8


def corpus_statistics(documents: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    """(term, df, words), with ``kind`` per value of that column: documents per term, and one row with a NULL term for all.

    The NULL row holds the number of documents and of all their words. Terms are made
    distinct inside each document's row, so counts are combined in every task before they
    are shuffled, and one pass over the texts gives everything. (The outer form of explode
    here and below keeps Spark from adding a filter that splits every text once more.)
    """
    by = [] if kind is None else [kind]
    listed = documents.select(*by, words(F.col(text)).alias("__w"))
    whole = F.array(F.lit(None).cast("string"))
    rows = listed.select(*by, F.size("__w").alias("n"), F.explode_outer(F.concat(F.array_distinct("__w"), whole)).alias("term"))
    counted = rows.groupBy(*by, "term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("n"))).alias("words"))
    return settle(counted)


def _raw_idf(total: Column) -> Column:
    return F.log(total - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def term_weights(statistics: DataFrame) -> DataFrame:
    """(term, df, idf); a negative idf becomes EPSILON times the mean idf of all terms."""
    total = statistics.filter(F.col("term").isNull()).select(F.col("df")).scalar()
    raw = statistics.filter(F.col("term").isNotNull()).select("term", "df", _raw_idf(total).alias("raw"))
    floor = raw.agg(F.avg("raw")).scalar() * EPSILON
    return raw.select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))


def asked_terms(queries: DataFrame, query_id: str, question: str, keep: Sequence[str] = ()) -> DataFrame:
    """(query_id, keep..., term, times): the words of each question and how often it says them."""
    return queries.select(query_id, *keep, F.explode(words(F.col(question))).alias("term")).groupBy(query_id, *keep, "term").agg(F.count("*").alias("times"))


def postings(documents: DataFrame, asked: DataFrame, id_column: str, text: str, keep: Sequence[str] = (), listed: Sequence[str] | None = None) -> DataFrame:
    """(id, keep..., length, term, tf) of the terms that any question asks for, written once.

    Other terms are dropped where they are read. All words of a document are in one task, so
    counts are whole before they are shuffled.

    With ``listed``, the terms asked for in a list, there is one row (id, keep..., length, terms, counts) per text
    that holds one, a term as its place in the list; nothing is shuffled or written. Texts with one id are not added up.
    """
    if listed is not None:
        ship(documents.sparkSession)
        shared = documents.sparkSession.sparkContext.broadcast(list(listed))
        read = documents.select(id_column, *keep, text)
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1])
        return read.mapInArrow(lists_of(shared), f"{kept}, length int, terms array<int>, counts array<int>")
    tokens = documents.select(id_column, *keep, words(F.col(text)).alias("__t")).select(
        id_column, *keep, F.size("__t").alias("length"), F.explode_outer("__t").alias("term")
    )
    hits = tokens.join(asked.select("term").distinct(), "term", "left_semi")
    return settle(hits.groupBy(id_column, *keep, "length", "term").agg(F.count("*").alias("tf")))


def group_weights(statistics: DataFrame, asked: DataFrame) -> DataFrame:
    """(grp, term, idf, mean_length, documents) of the terms asked for, from (grp, kind..., term, df, words).

    A group is the documents that some questions read. A document has one type, so the counts of a group's types add up.
    """
    counts = settle(statistics.groupBy("grp", "term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")))
    # One row per group: groups are as few as the intents.
    whole = counts.filter(F.col("term").isNull()).select("grp", F.col("df").alias("documents"), (F.col("words") / F.col("df")).alias("mean_length"))
    terms = counts.filter(F.col("term").isNotNull()).join(whole, "grp").withColumn("raw", _raw_idf(F.col("documents")))
    floor = terms.groupBy("grp").agg((F.avg("raw") * EPSILON).alias("floor"))
    wanted = terms.join(asked.select("grp", "term").distinct(), ["grp", "term"], "left_semi").join(floor, "grp")
    idf = F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw"))
    return wanted.select("grp", "term", idf.alias("idf"), "mean_length", "documents")


def group_weights_by_kind(statistics: DataFrame, kind: str, readers: Mapping[str | None, Sequence[int]], asked: DataFrame) -> DataFrame:
    """``group_weights`` from counts per kind, where ``readers`` names the groups that read a kind.

    Kinds and groups are fixed vocabularies: a term is one row with a column per group, so no row is there once per group.
    """
    spark = statistics.sparkSession
    counts, words_of = {}, {}
    for name, df, n in statistics.filter(F.col("term").isNull()).select(kind, "df", "words").collect():
        for g in readers.get(name, ()):
            counts[g], words_of[g] = counts.get(g, 0) + df, words_of.get(g, 0) + (n or 0)
    if not counts:
        return spark.createDataFrame([], "grp int, term string, idf double, mean_length double")

    def reads(g: int) -> Column:
        own = F.lit(False)
        for name in (k for k, groups in readers.items() if g in groups):
            own = own | F.col(kind).eqNullSafe(F.lit(name))
        return own

    def per_term(rows: DataFrame) -> DataFrame:
        summed_up = rows.groupBy("term").agg(*[F.sum(F.when(reads(g), F.col("df"))).alias(f"df{g}") for g in counts])
        return summed_up.select("term", *[(F.log(F.lit(n) - F.col(f"df{g}") + 0.5) - F.log(F.col(f"df{g}") + 0.5)).alias(f"raw{g}") for g, n in counts.items()])

    terms = statistics.filter(F.col("term").isNotNull())
    means = per_term(terms).agg(*[F.avg(f"raw{g}").alias(f"raw{g}") for g in counts]).first()
    wanted = per_term(terms.join(asked.select("term").distinct(), "term", "left_semi"))
    groups = spark.createDataFrame([(g, None if means[f"raw{g}"] is None else means[f"raw{g}"] * EPSILON, words_of[g] / counts[g]) for g in counts], "grp int, floor double, mean_length double")
    each = wanted.select("term", F.inline(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(f"raw{g}").alias("raw")) for g in counts]))).filter(F.col("raw").isNotNull())
    idf = F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw"))
    return each.join(groups, "grp").select("grp", "term", idf.alias("idf"), "mean_length")


def term_gains(found: DataFrame, weights: DataFrame) -> DataFrame:
    """(grp, term, documents, gain, ...): what a term adds to the score of a document per time it is asked for."""
    mean = F.when(F.col("mean_length") > 0, F.col("mean_length")).otherwise(1.0)
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    return found.join(weights, ["grp", "term"]).withColumn("gain", F.col("idf") * part).drop("tf", "length", "idf", "mean_length")


def summed(gains: DataFrame, asked: DataFrame, columns: Sequence[str]) -> DataFrame:
    return gains.join(asked, ["grp", "term"]).groupBy(*columns).agg(F.sum(F.col("times") * F.col("gain")).alias("score"))


def _one_group(df: DataFrame) -> DataFrame:
    return df.withColumn("grp", F.lit(0))


def bm25_scores(documents: DataFrame, queries: DataFrame, id_column: str, text: str, query_id: str, question: str, keep: Sequence[str] = ()) -> DataFrame:
    """(query_id, id, keep..., score) of all documents that share a token with the query; a token asked for twice counts twice."""
    asked = _one_group(asked_terms(queries, query_id, question))
    found = _one_group(postings(documents, asked, id_column, text, keep))
    weights = group_weights(_one_group(corpus_statistics(documents, text)), asked)
    return summed(term_gains(found, weights), asked, [query_id, id_column, *keep])


def best_documents(found: DataFrame, weights: DataFrame, asked: DataFrame, deepest: int, id_column: str, query_id: str) -> DataFrame:
    """The best documents of each query, without a row for every document that shares a common word with it.

    ``found`` are postings with their group, ``asked`` has (query_id, grp, depth, term, times); ``deepest`` is the largest depth.

    Every term has a bound: the most it adds to any document of the group. Documents are scored by the rare terms of a
    query first. Its k-th best such score is a bound from below; a document without a rare term cannot pass
    the sum of the common terms' bounds. Where the first is above the second, the k best are among the documents
    already met, and only those that can still reach the k-th get the common terms added. Other
    queries (few rare terms, or less than k documents with one) are scored in full. Results are those of full scores.
    """
    own, group = [query_id, "depth"], ["grp", "term"]
    gains = term_gains(found, weights)
    bounds = gains.groupBy(*group).agg(F.max("gain").alias("most"), F.count("*").alias("df"), F.max("documents").alias("documents"))
    # A term that lowers scores is taken at once: what is left out of a first score may only add to it.
    common = (F.col("df") > COMMON_SHARE * F.col("documents")) & (F.col("most") > 0)
    parts = settle(asked.select(*own, *group, "times").join(bounds.select(*group, "most", common.alias("common")), group))
    rare, rest = parts.filter(~F.col("common")), parts.filter("common")
    first = settle(summed(gains, rare, [*own, id_column]))
    left = rest.groupBy(query_id).agg(F.sum(F.col("times") * F.col("most")).alias("left"))
    kth = top_per_group(first, [query_id], [F.col("score").desc(), F.col(id_column)], deepest).filter(F.col("rank") == F.col("depth"))
    limits = kth.select(query_id, F.col("score").alias("reach")).join(left, query_id, "left").select(query_id, "reach", F.coalesce("left", F.lit(0.0)).alias("left"))
    # One row per question; read by both branches.
    closed = settle(limits.filter(F.col("reach") > F.col("left") + SLACK))
    can = first.join(closed, query_id).filter(F.col("score") + F.col("left") >= F.col("reach") - SLACK).select(*own, id_column, "score")
    added = can.select(query_id, id_column).join(rest.select(query_id, *group, "times"), query_id).join(gains.select(id_column, *group, "gain"), [id_column, *group])
    more = added.groupBy(query_id, id_column).agg(F.sum(F.col("times") * F.col("gain")).alias("more"))
    exact = can.join(more, [query_id, id_column], "left").select(*own, id_column, (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    open_ = parts.join(closed, query_id, "left_anti")
    scores = exact.unionByName(summed(gains, open_, [*own, id_column])).withColumn("score", F.round("score", 9))
    best = top_per_group(scores, [query_id], [F.col("score").desc(), F.col(id_column)], deepest)
    return best.filter(F.col("rank") <= F.col("depth")).select(query_id, id_column, "score", "rank")


def bm25_topk(documents: DataFrame, queries: DataFrame, k: int, id_column: str = "doc_id", text: str = "text", query_id: str = "query_id", question: str = "question") -> DataFrame:
    """(query_id, id, score, rank) of the k best documents of each query; equal scores keep the smaller id."""
    asked = settle(_one_group(asked_terms(queries, query_id, question)).withColumn("depth", F.lit(k)))
    found = _one_group(postings(documents, asked, id_column, text))
    return best_documents(found, group_weights(_one_group(corpus_statistics(documents, text)), asked), asked, k, id_column, query_id)
