"""TF-IDF features and a linear text classifier on Spark ML."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, IDF, IndexToString, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.session import share

WORD = r"([\p{L}\p{N}_]{2,})"
WORD_OR_MARK = r"([\p{L}\p{N}_]+|[;{}()\[\]+,\-./*=<>])"


def tokens(c: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(1))


def ngrams(arr: Column, sizes: Sequence[int] = (1, 2, 3)) -> Column:
    """All n-grams of a token array, shorter ones first."""
    def of(n: int) -> Column:
        if n == 1:
            return arr
        # element access is constant time; slicing would copy the whole array for every n-gram
        made = F.transform(F.sequence(F.lit(0), F.size(arr) - n), lambda i: F.concat_ws(" ", *[F.get(arr, i + k) for k in range(n)]))
        return F.when(F.size(arr) >= n, made).otherwise(F.array().cast("array<string>"))
    return F.concat(*[of(n) for n in sizes])


def char_ngrams(low: Column, sizes: Sequence[int] = (3, 4, 5)) -> Column:
    """Character n-grams of a lower-cased text column."""
    def of(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: low.substr(i, F.lit(n)))
        return F.when(F.length(low) >= n, made).otherwise(F.array().cast("array<string>"))
    return F.concat(*[of(n) for n in sizes])


def term_table(df: DataFrame, ident: list[str], terms: str, max_terms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Relational TF-IDF: (ident, term, tf) and (term, cf, df, idf) of all terms, or of the ``max_terms`` most frequent.

    Rows are dealt out by ``ident`` while they are texts, or what makes them: their terms are many times their size and are counted where they lie.
    """
    tf = df.select(*ident, F.explode(terms).alias("term")).where("term IS NOT NULL").groupBy(*ident, "term").agg(F.count("*").alias("tf"))
    n = df.agg(F.count("*")).scalar()
    vocab = tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    if max_terms is not None:
        vocab = vocab.orderBy(F.desc("cf"), "term").limit(max_terms)
    return tf, vocab.select("term", "cf", "df", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))


def weight_sums(tf: DataFrame, vocab: DataFrame, ident: list[str]) -> DataFrame:
    """(ident, terms, top_weight, mass) of the weights of `tfidf_weights`: their number, greatest and sum, for idents without nulls.

    Three sums over the damped counts give all of them, combined within tasks: the weights themselves are never brought together a second time.
    """
    w = tf.join(vocab.select("term", "idf"), "term").select(*ident, ((F.lit(1.0) + F.log("tf")) * F.col("idf")).alias("__w"))
    norm = F.sqrt(F.sum(F.col("__w") * F.col("__w")))
    return w.where(" AND ".join(f"{c} IS NOT NULL" for c in ident)).groupBy(*ident).agg(
        F.count("*").alias("terms"), (F.max("__w") / norm).alias("top_weight"), (F.sum("__w") / norm).alias("mass"))


def tfidf_weights(tf: DataFrame, vocab: DataFrame, ident: list[str]) -> DataFrame:
    """Sublinear, L2-normalised weights (ident, term, weight)."""
    w = tf.join(vocab.select("term", "idf"), "term").withColumn("w", (F.lit(1.0) + F.log("tf")) * F.col("idf"))
    norm = w.groupBy(*ident).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("__n"))
    return w.join(norm, ident).select(*ident, "term", (F.col("w") / F.col("__n")).alias("weight"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` = rows / (classes * rows of the class). A row per class is sent to the rows: dealt by class, half of them could meet in one task."""
    every = Window.partitionBy()  # one row per class by now
    per = df.groupBy(label).agg(F.count("*").alias("__c"))
    per = per.select(label, (F.sum("__c").over(every) / (F.count("*").over(every) * F.col("__c"))).alias("weight"))
    return df.join(F.broadcast(per), label)


def featurise(df: DataFrame, text: str, with_chars: bool = False) -> DataFrame:
    """Adds ``terms``: word 1-3-grams, or with marks and character 3-5-grams for the older layout.

    A null text has no terms. Tokens and lower-cased text become columns first: an expression inside a lambda would be
    evaluated again for every n-gram.
    """
    known = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("__tok", tokens(known, WORD_OR_MARK if with_chars else WORD))
    if not with_chars:
        return out.withColumn("terms", ngrams(F.col("__tok"))).drop("__tok")
    out = out.withColumn("__low", F.lower(known))
    return out.withColumn("terms", F.concat(ngrams(F.col("__tok")), char_ngrams(F.col("__low")))).drop("__tok", "__low")


def vocabulary(df: DataFrame, terms: str, max_terms: int, max_df: float | None = None) -> list[str]:
    """The ``max_terms`` most frequent terms, ties in order of the term; with ``max_df``, of those in at most that share of the rows.

    Counts are combined within each task before they are sent.
    """
    if max_df is None:
        counts = df.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("cf"))
    else:
        rows = df.select(F.monotonically_increasing_id().alias("id"), terms)
        per = rows.select("id", F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
        counts = per.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")).where(F.col("df") <= F.lit(max_df * df.count()))
    return [r.term for r in counts.orderBy(F.desc("cf"), "term").limit(max_terms).collect()]


def train(df: DataFrame, text: str, label: str, max_terms: int, c: float = 3.0, max_iter: int = 100,
          with_chars: bool = False) -> PipelineModel:
    """TF-IDF plus multinomial logistic regression with balanced class weights.

    The inverse document frequency carries the usual +1, set through the fitted vector of at most
    ``max_terms`` entries. Term frequency is linear, which equals the damped form on short messages.
    The n-grams of a text are many times its size and are made twice, for the vocabulary and for the counts; only counts are kept.
    """
    made = featurise(class_weights(df, label), text, with_chars).select(label, "terms", "weight")
    counts = CountVectorizerModel.from_vocabulary(vocabulary(made, "terms", max_terms, 0.95 if with_chars else None), inputCol="terms", outputCol="tf")
    rows = share(counts.transform(made).drop("terms"))
    idf = IDF(inputCol="tf", outputCol="unused").fit(rows).idf
    scale = ElementwiseProduct(inputCol="tf", outputCol="scaled", scalingVec=Vectors.dense(idf.toArray() + 1.0))
    norm = Normalizer(inputCol="scaled", outputCol="features", p=2.0)
    index = StringIndexer(inputCol=label, outputCol="label_ix", stringOrderType="alphabetAsc").fit(rows)
    lr = LogisticRegression(featuresCol="features", labelCol="label_ix", weightCol="weight", family="multinomial",
                            standardization=False, regParam=1.0 / (c * max(1, rows.count())), maxIter=max_iter)
    ready = norm.transform(scale.transform(index.transform(rows)))
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    return PipelineModel(stages=[counts, scale, norm, lr.fit(ready), back])


def predict(model: PipelineModel, df: DataFrame, text: str, with_chars: bool = False) -> DataFrame:
    """Adds ``predicted`` and ``confidence``."""
    out = model.transform(featurise(df, text, with_chars))
    return out.withColumn("confidence", F.array_max(vector_to_array("probability"))).drop(
        "terms", "tf", "scaled", "features", "rawPrediction", "probability", "prediction")


def rules_then_model(df: DataFrame, text: str, rule: Column) -> DataFrame:
    """Rule label where it exists, else the model's."""
    return df.withColumn("combined", F.coalesce(rule["category"], F.col("predicted")))
