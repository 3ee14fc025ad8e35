"""N-gram counts over one global token stream, their log-probabilities, and close words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of the items whose n-grams are sent to every task.
FEW = 200_000


def stream(docs: DataFrame) -> DataFrame:
    """(doc_id, tok) -> w1, w2, w3: a row for each token of the stream of documents by doc_id, with the two that follow it.

    N-grams cross documents. A document gives the rows that lie within it; for its last two tokens, those and its first two
    travel (one small row a document; a document with one token takes the next one's too). The window over those rows has
    no partition, so it is laid out by ranges of doc_id where that matters; texts are not shuffled.
    """
    inner = F.greatest(F.size("tok") - 2, F.lit(0))
    shifted = F.arrays_zip(*[F.slice("tok", k, inner).alias(f"w{k}") for k in (1, 2, 3)])
    within = docs.select(F.explode_outer(shifted).alias("g")).where("g is not null").select("g.w1", "g.w2", "g.w3")
    w, none = Window.orderBy(F.col("doc_id").asc_nulls_last()), F.array().cast("array<string>")
    both = F.struct(F.slice("tok", 1, 2).alias("head"), F.slice("tok", inner + 1, 2).alias("tail"))
    ends = docs.select("doc_id", F.explode_outer(F.when(F.size("tok") > 0, F.array(both))).alias("e")).where("e is not null").select("doc_id", "e.*")
    ahead = F.slice(F.concat(*[F.coalesce(F.lead("head", k).over(w), none) for k in (1, 2)]), 1, 2)
    ends = ends.select("tail", F.concat("tail", ahead).alias("all"))
    ends = ends.withColumn("i", F.explode_outer(F.sequence(F.lit(0), F.size("tail") - 1)))
    return within.unionByName(ends.select(*[F.get("all", F.col("i") + k).alias(f"w{k + 1}") for k in range(3)]))


def counts(docs: DataFrame, order: int) -> DataFrame:
    """w1[, w2[, w3]], n: counts over the stream of documents by doc_id."""
    if order == 1:
        return docs.select(F.explode_outer("tok").alias("w1")).where("w1 is not null").groupBy("w1").agg(F.count("*").alias("n"))
    names = [f"w{i + 1}" for i in range(order)]
    return stream(docs).where(f"{names[-1]} is not null").groupBy(*names).agg(F.count("*").alias("n"))


def average_log_prob(docs: DataFrame, items: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(item_id, tok) -> item_id, avg_log_prob under trigram, bigram or unigram counts, by the context there is.

    Of the stream's bigrams and trigrams only those of the items are counted, along with all words. Items of up to FEW words
    in all are broadcast, more are joined by shuffle.
    """
    x = items.select("item_id", "tok", F.posexplode("tok").alias("i", "w"))
    x = x.select("item_id", "w", F.when(F.col("i") > 0, F.get("tok", F.col("i") - 1)).alias("p1"), F.when(F.col("i") > 1, F.get("tok", F.col("i") - 2)).alias("p2"))
    two = x.where("p1 is not null").select(F.col("p1").alias("w1"), F.col("w").alias("w2"), F.lit(True).alias("second")).distinct()
    three = x.where("p2 is not null").select(F.col("p2").alias("w1"), F.col("p1").alias("w2"), F.col("w").alias("w3"), F.lit(True).alias("third")).distinct()
    sent = F.broadcast if x.limit(FEW + 1).count() <= FEW else lambda df: df
    # A word, with its follower if the items have that bigram, and the next one if they have that trigram.
    seen = stream(docs).join(sent(two), ["w1", "w2"], "left").join(sent(three), ["w1", "w2", "w3"], "left")
    seen = seen.select("w1", F.when(F.col("second"), F.col("w2")).alias("w2"), F.when(F.col("third"), F.col("w3")).alias("w3"))
    seen = seen.groupBy("w1", "w2", "w3").agg(F.count("*").alias("n")).persist()  # read three times; a row a word and a few more
    total = seen.agg(F.count_distinct("w1").alias("v"), F.sum("n").alias("total"))

    def gram(*words):
        return F.struct(*[F.coalesce(c, F.lit("")).alias(f"w{k + 1}") for k, c in enumerate((*words, *[F.lit(None).cast("string")] * (3 - len(words))))])

    first, second, third = F.col("w1"), F.col("w2"), F.col("w3")
    parts = F.array(gram(first), F.when(second.isNotNull(), gram(first, second)), F.when(third.isNotNull(), gram(first, second, third)))
    found = seen.select(F.explode_outer(parts).alias("gram"), "n").where("gram is not null")

    w, p1, p2 = F.col("w"), F.col("p1"), F.col("p2")
    x = x.withColumn("over", F.when(p2.isNotNull(), gram(p2, p1, w)).when(p1.isNotNull(), gram(p1, w)).otherwise(gram(w)))
    x = x.withColumn("under", F.when(p2.isNotNull(), gram(p2, p1)).when(p1.isNotNull(), gram(p1)))
    wanted = x.select(F.col("over").alias("gram")).unionByName(x.select(F.col("under").alias("gram"))).where("gram is not null").distinct()
    found = found.join(sent(wanted), "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("n"))
    x = x.join(found.select(F.col("gram").alias("over"), F.col("n").alias("a")), "over", "left").join(found.select(F.col("gram").alias("under"), F.col("n").alias("b")), "under", "left")
    x = x.join(F.broadcast(total))  # one row
    below = F.when(F.col("under").isNull(), F.col("total")).otherwise(F.coalesce("b", F.lit(0)))
    prob = (F.coalesce("a", F.lit(0)) + smoothing) / (F.coalesce(below, F.lit(0)) + smoothing * F.col("v"))
    return x.groupBy("item_id").agg(F.avg(F.ln(prob)).alias("avg_log_prob"))


def char_counts(texts: DataFrame, order: int) -> DataFrame:
    """(text) -> context, ch, n for every context length below `order`, texts padded with ^."""
    x = texts.select(F.concat(F.lit("^" * (order - 1)), "text").alias("s")).where(F.length("s") >= order)
    x = x.withColumn("i", F.explode(F.sequence(F.lit(order), F.length("s")))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(order - 1))))
    return x.select(F.substring("s", F.col("i") - F.col("k"), F.col("k")).alias("context"), F.substring("s", F.col("i"), F.lit(1)).alias("ch")).groupBy("context", "ch").agg(F.count("*").alias("n"))


def close_words(words: DataFrame, vocab: DataFrame, most: int) -> DataFrame:
    """(word) x (candidate) -> word, candidate, distance <= most; joined on the lengths within reach."""
    x = words.withColumn("len", F.explode(F.sequence(F.length("word") - most, F.length("word") + most)))
    y = vocab.withColumn("len", F.length("candidate"))
    near: Column = F.levenshtein("word", "candidate", most)
    return x.join(y, "len").withColumn("distance", near).where("distance >= 0").select("word", "candidate", "distance")


def candidates(words: DataFrame, vocab: DataFrame, most: int, top: int) -> DataFrame:
    """The `top` nearest other vocabulary words of each word, ties by spelling."""
    x = close_words(words, vocab, most).where("word <> candidate")
    rank = F.row_number().over(Window.partitionBy("word").orderBy("distance", "candidate"))
    return x.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")
