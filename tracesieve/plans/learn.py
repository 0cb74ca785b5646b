"""TF-IDF tables and the text classifier."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.operators import labels as L
from tracesieve.operators import ml as M
from tracesieve.plans.diagnostics import messages
from tracesieve.plans.registry import Tables, query
from tracesieve.session import share

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
_NG = " UNION ALL ".join(f"SELECT conv_id, turn, unnest(list_transform(range(1, len(tk) - {n - 2}), lambda i: array_to_string(tk[i:i + {n - 1}], ' '))) AS term FROM tk WHERE len(tk) >= {n}" for n in (1, 2, 3))
TF_SQL = f"""WITH tk AS (SELECT conv_id, turn, {_TOK} AS tk FROM conversations), g AS ({_NG}), tf AS (SELECT conv_id, turn, term, count(*) AS tf FROM g GROUP BY 1, 2, 3),
vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df, ln((1.0::DOUBLE + (SELECT count(*) FROM conversations)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM tf GROUP BY 1)
"""


def _terms(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = M.featurise(t.conversations.select("conv_id", "turn", "text").repartition("conv_id", "turn"), "text").drop("text")
    return M.term_table(d, ["conv_id", "turn"], "terms")


@query("tfidf_terms", TF_SQL + "SELECT term, cf, df, round(idf, 6) AS idf FROM vocab")
def tfidf_terms(t: Tables) -> DataFrame:
    """Vocabulary of word 1-3-grams with document frequencies."""
    return _terms(t)[1].withColumn("idf", F.round("idf", 6))


@query("tfidf_weights", TF_SQL.rstrip() + """, w AS (SELECT conv_id, turn, tf.term, (1.0::DOUBLE + ln(tf)) * idf AS w FROM tf JOIN vocab ON vocab.term = tf.term), n AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS n FROM w GROUP BY 1, 2)
SELECT conv_id, turn, count(*) AS terms, round(max(w / n), 5) AS top_weight, round(sum(w / n), 5) AS mass FROM w JOIN n USING (conv_id, turn) GROUP BY 1, 2""")
def tfidf_weights(t: Tables) -> DataFrame:
    """Normalised weights summarised per turn."""
    tf, vocab = _terms(t)
    sums = M.weight_sums(tf, vocab, ["conv_id", "turn"])
    return sums.withColumns({c: F.round(c, 5) for c in ("top_weight", "mass")})


@query("text_classifier")
def text_classifier(t: Tables) -> DataFrame:
    """Category model trained on half of the distinct messages by hash and applied to all of them."""
    m = messages(t).select("message", L.phrase_label(F.col("message")).alias("category"))
    m = share(m.withColumn("part", F.substring(F.md5("message"), 1, 1)))
    model = M.train(m.where("part < '8'"), "message", "category", c=3.0, max_terms=10_000, max_iter=50)
    p = M.rules_then_model(M.predict(model, m, "message"), "message", L.override(F.col("message")))
    return p.select("message", "category", "predicted", F.round("confidence", 4).alias("confidence"), "combined")


@query("document_classifier")
def document_classifier(t: Tables) -> DataFrame:
    """Quality model over whole labelled documents and its predictions."""
    d = share(t.documents.join(t.labels, "doc_id").select("doc_id", "text", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth")))
    model = M.train(d, "text", "truth", c=1.0, max_terms=10_000, max_iter=30)
    return M.predict(model, d, "text").select("doc_id", "truth", "predicted", F.round("confidence", 4).alias("confidence"))
