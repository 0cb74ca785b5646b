"""Training-set assembly over documents, benchmark items, conversations and log messages."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.functions import text as T
from tracesieve.operators import dataset as S
from tracesieve.operators import labels as L
from tracesieve.plans.derived import CODE_LINES, LOG_LINES, LOGS_SQL, case_text, line_chunk, line_text, log_lines
from tracesieve.plans.diagnostics import CORPUS_SQL, VERIFIED_SQL, corpus
from tracesieve.plans.registry import Tables, query
from tracesieve.plans.sqltext import LINES, STRIP, any_sql, doc_lines_sql, in_sql, q

# Line normal form used as dataset key: lower case, blanks collapsed.
def line_norm(c):
    return T.strip(F.regexp_replace(F.lower(c), r"\s+", " "))


NORM_SQL = STRIP.format(r"regexp_replace(lower({0}), '\s+', ' ', 'g')")
DOC_LINES_SQL = doc_lines_sql("documents", "doc_id", "text")


@query("content_ids", "SELECT doc_id, sha256(text) AS sha, 'doc_' || substr(md5(text), 1, 8) AS group_id FROM documents")
def content_ids(t: Tables) -> DataFrame:
    """Content hashes of every document."""
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), S.group_id(F.col("text"), "doc_").alias("group_id"))


@query("first_wins_dedupe", """SELECT doc_id, lang, source FROM (
  SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lower(text), lang ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def first_wins_dedupe(t: Tables) -> DataFrame:
    """First document of every (lower-cased text, language)."""
    d = t.documents.select("doc_id", "lang", "source", S.content_key(F.lower("text"), F.col("lang")).alias("key"))
    return S.dedupe_first(d, F.col("key"), [F.col("doc_id")]).drop("key")


@query("per_class_cap", """WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY lower(text), source ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM d WHERE rn = 1) WHERE place <= 25""")
def per_class_cap(t: Tables) -> DataFrame:
    """Deduplicated documents, at most 25 per source in arrival order."""
    d = t.documents.select("doc_id", "source", S.content_key(F.lower("text"), F.col("source")).alias("key"))
    return S.cap_per_class(S.dedupe_first(d, F.col("key"), [F.col("doc_id")]).drop("key"), "source", [F.col("doc_id")], 25)


@query("priority_cap", f"""WITH {LOGS_SQL}, p AS (SELECT file % 7 AS grp, file, line_no, line, row_number() OVER (PARTITION BY file % 7 ORDER BY
   CASE WHEN contains(line, 'curated') THEN 0 WHEN contains(line, 'error:') THEN 1 ELSE 2 END, file, line_no) AS place FROM logs)
SELECT CAST(grp AS BIGINT) AS grp, file, line_no, line, CAST(place AS INT) AS place FROM p WHERE place <= 40""")
def priority_cap(t: Tables) -> DataFrame:
    """Capped rows per class, curated and error lines first."""
    from tracesieve.functions.ordered import top_n_per_key
    l = F.col("line")
    rank = F.when(l.contains("curated"), 0).when(l.contains("error:"), 1).otherwise(2)
    d = log_lines(t.lineitem).select((F.col("file") % 7).alias("grp"), "file", "line_no", "line", rank.alias("pri"))
    return top_n_per_key(d, ["grp"], [F.col("pri"), F.col("file"), F.col("line_no")], 40, rank="place").drop("pri")


@query("nested_caps", """WITH u AS (SELECT l_suppkey AS program, l_partkey AS message, l_partkey % 7 AS category, min((l_orderkey, l_linenumber)) AS o FROM lineitem GROUP BY 1, 2, 3),
a AS (SELECT *, row_number() OVER (PARTITION BY message ORDER BY o, program) AS r1 FROM u),
b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY o, program, message) AS place FROM a WHERE r1 <= 3)
SELECT program, message, CAST(category AS BIGINT) AS category, CAST(place AS INT) AS place FROM b WHERE place <= 150""")
def nested_caps(t: Tables) -> DataFrame:
    """Unique (supplier, part), at most 3 per part and 150 per part class."""
    d = t.lineitem.select(F.col("l_suppkey").alias("program"), F.col("l_partkey").alias("message"),
                          (F.col("l_partkey") % 7).alias("category"), "l_orderkey", "l_linenumber")
    return S.nested_caps(d, "program", "message", "category", ["l_orderkey", "l_linenumber"], 3, 150)


SPLIT_SQL = """
WITH g AS (SELECT source, row_number() OVER (ORDER BY md5(source)) AS gr, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
held AS (SELECT source FROM g WHERE gr <= greatest(1, floor(n * 0.2::DOUBLE))),
pool AS (SELECT doc_id, lang, source, text, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR))) AS r,
   count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE source NOT IN (SELECT source FROM held)),
v AS (SELECT *, CASE WHEN n >= 10 THEN greatest(2, floor(n * 0.15::DOUBLE)) ELSE 1 END AS nv FROM pool),
split AS (SELECT doc_id, lang, source, text, CASE WHEN r <= nv THEN 'val' WHEN r <= nv + 1500 THEN 'train' END AS split FROM v
  UNION ALL SELECT doc_id, lang, source, text, 'test' FROM documents WHERE source IN (SELECT source FROM held))
"""


@query("grouped_stratified_split", SPLIT_SQL + "SELECT doc_id, lang, source, split FROM split")
def grouped_stratified_split(t: Tables) -> DataFrame:
    """Whole sources held out for test; the rest split per language."""
    return S.grouped_split(t.documents.select("doc_id", "lang", "source"), "source", "lang", "doc_id")


@query("split_leakage", SPLIT_SQL.rstrip() + f""", k AS (SELECT {NORM_SQL.format('text')} AS key, max(CAST(split = 'train' AS INT)) AS train,
  max(CAST(split = 'val' AS INT)) AS val, max(CAST(split = 'test' AS INT)) AS test, max(CAST(split = 'gold' AS INT)) AS gold
  FROM (SELECT text, coalesce(split, '') AS split FROM split UNION ALL SELECT text, 'gold' FROM benchmark) GROUP BY 1)
SELECT CAST(sum(train * test) AS BIGINT) AS train_test, CAST(sum(train * gold) AS BIGINT) AS train_gold,
  CAST(sum(val * test) AS BIGINT) AS val_test, CAST(sum(val * gold) AS BIGINT) AS val_gold FROM k""")
def split_leakage(t: Tables) -> DataFrame:
    """Distinct normalised texts shared by any two splits."""
    d = t.documents.select("doc_id", "lang", "source", F.sha2(line_norm(F.col("text")), 256).alias("key"))
    split = S.grouped_split(d, "source", "lang", "doc_id")
    return S.leakage(split, "key", "split", t.benchmark.select(F.sha2(line_norm(F.col("text")), 256).alias("key")))


@query("gold_exclusion", f"""WITH l AS ({DOC_LINES_SQL}), b AS ({doc_lines_sql('benchmark', 'item_id', 'text')}),
k AS (SELECT doc_id, {NORM_SQL.format('line')} AS key FROM l), g AS (SELECT DISTINCT {NORM_SQL.format('line')} AS key FROM b)
SELECT doc_id, CAST(count(*) AS BIGINT) AS kept FROM k WHERE key <> '' AND key NOT IN (SELECT key FROM g) GROUP BY 1""")
def gold_exclusion(t: Tables) -> DataFrame:
    """Lines of each document that are not lines of the gold set."""
    lines = T.explode_lines(t.documents, "text", "doc_id").select("doc_id", line_norm(F.col("line")).alias("n"))
    keyed = lines.where("n <> ''").groupBy("doc_id", F.sha2("n", 256).alias("key")).agg(F.count("*").alias("c"))
    gold = T.explode_lines(t.benchmark, "text", "item_id").select(F.sha2(line_norm(F.col("line")), 256).alias("key"))
    return S.exclude(keyed, "key", gold).groupBy("doc_id").agg(F.sum("c").alias("kept"))


@query("class_balance", """SELECT lang, n, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS pct, round(max(n) OVER () / min(n) OVER (), 6) AS imbalance, max(n) OVER () / min(n) OVER () > 10 AS warn
FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)""")
def class_balance(t: Tables) -> DataFrame:
    """Language distribution and imbalance."""
    return S.class_balance(t.documents, "lang").withColumns(
        {"pct": F.round("pct", 6), "imbalance": F.round("imbalance", 6)})


@query("top_messages", f"""WITH l AS ({DOC_LINES_SQL}) SELECT line, CAST(count(*) AS BIGINT) AS n FROM (SELECT {STRIP.format('line')} AS line FROM l) WHERE line <> '' GROUP BY 1 ORDER BY n DESC, line LIMIT 20""")
def top_messages(t: Tables) -> DataFrame:
    """The 20 most frequent lines of the corpus."""
    lines = T.explode_lines(t.documents, "text", "doc_id").select(T.strip(F.col("line")).alias("line"))
    return S.top_values(lines, "line", 20)


@query("unique_per_class", f"""SELECT lang, count(*) AS n, count(DISTINCT {NORM_SQL.format('text')}) AS uniq, count(DISTINCT {NORM_SQL.format('text')}) < 30 AS few FROM documents GROUP BY 1""")
def unique_per_class(t: Tables) -> DataFrame:
    """Rows and distinct normalised texts per language."""
    d = t.documents.select("lang", F.sha2(line_norm(F.col("text")), 256).alias("key"))
    return S.unique_per_class(d, "lang", "key")


@query("union_sources", f"""WITH u AS (
  SELECT 'gold' AS source, 0 AS source_rank, item_id AS ord, 0 AS turn, text FROM benchmark
  UNION ALL SELECT 'corpus', 1, doc_id, 0, text FROM documents
  UNION ALL SELECT 'dialogue', 2, conv_id, turn, text FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY {NORM_SQL.format('text')} ORDER BY source_rank, ord, turn) AS rn FROM u)
SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (rn = 1) AS BIGINT) AS kept FROM r GROUP BY 1""")
def union_sources(t: Tables) -> DataFrame:
    """Rows per provenance before and after first-wins dedupe across sources."""
    def part(df, i, turn):
        return df.select(F.col(i).alias("ord"), turn.cast("bigint").alias("turn"), F.sha2(line_norm(F.col("text")), 256).alias("key"))
    u = S.union_ranked([("gold", part(t.benchmark, "item_id", F.lit(0))), ("corpus", part(t.documents, "doc_id", F.lit(0))),
                        ("dialogue", part(t.conversations, "conv_id", F.col("turn")))])
    kept = S.dedupe_first(u, F.col("key"), [F.col("source_rank"), F.col("ord"), F.col("turn")])
    return (u.groupBy("source").agg(F.count("*").alias("n"))
            .join(kept.groupBy("source").agg(F.count("*").alias("kept")), "source", "left")
            .select("source", "n", F.coalesce("kept", F.lit(0)).alias("kept")))


@query("merge_unseen", """WITH e AS (SELECT doc_id, text, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
n AS (SELECT doc_id, text, lang, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS rn FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  AND (text, lang) NOT IN (SELECT text, lang FROM e))
SELECT doc_id, lang, 'existing' AS origin FROM e UNION ALL SELECT doc_id, lang, 'new' FROM n WHERE rn = 1""")
def merge_unseen(t: Tables) -> DataFrame:
    """Labelled documents plus the first unlabelled one of each unseen text."""
    d = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("key"))
    ids = t.labels.select("doc_id").distinct()
    return S.merge_unseen(d.join(ids, "doc_id", "left_semi"), d.join(ids, "doc_id", "left_anti"), ["key", "lang"],
                          [F.col("doc_id")]).drop("key")


@query("variant_augmentation", f"""WITH d AS (SELECT doc_id, lang, {NORM_SQL.format('text')} AS key FROM documents),
base AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
excl AS (SELECT key FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)),
fresh AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn FROM d
  WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND key NOT IN (SELECT key FROM excl) AND key NOT IN (SELECT key FROM base)),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM fresh WHERE rn = 1),
have AS (SELECT lang, count(*) AS h FROM base GROUP BY 1)
SELECT doc_id, r.lang FROM r LEFT JOIN have ON have.lang = r.lang WHERE r + coalesce(h, 0) <= 300""")
def variant_augmentation(t: Tables) -> DataFrame:
    """Unlabelled documents that extend the good ones up to 300 per language."""
    d = t.documents.select("doc_id", "lang", F.sha2(line_norm(F.col("text")), 256).alias("key"))
    good, bad = t.labels.where("quality = 1").select("doc_id"), t.labels.where("quality = 0").select("doc_id")
    return S.augment(d.join(good, "doc_id", "left_semi"), d.join(t.labels.select("doc_id"), "doc_id", "left_anti"),
                     d.join(bad, "doc_id", "left_semi"), "lang", "key", [F.col("doc_id")], cap=300).select("doc_id", "lang")


_SRC = f"{case_text(CODE_LINES)} || chr(10) || {case_text(CODE_LINES, '(k + 5)')}"
# the same text: two lookups by halves instead of two tables read from the top, in a method that the JVM would not compile
_SOURCE = f"transform(array(k), k -> {line_text(CODE_LINES)} || chr(10) || {line_text(CODE_LINES, '(k + 5)')})[0]"
_DIRS = r"regexp_extract_all(source_text, '(?im)^\s*#\s*(?:error|warning)\s+([^\n]*)', 1)"
_DIR = STRIP.format(r"""regexp_replace(lower(regexp_replace(""" + STRIP.format("d") + r""", '^["'']+|["'']+$', '', 'g')), '\s+', ' ', 'g')""")
_MSGN = NORM_SQL.format("message")
GATE_SQL = CORPUS_SQL.rstrip() + f""", e AS (SELECT c.file, c.line_no, c.message, coalesce({VERIFIED_SQL.replace('message', 'c.message')}, 'unknown') AS category, n.source_text
  FROM corpus c JOIN (SELECT file, line_no, {_SRC} AS source_text FROM numbered) n ON n.file = c.file AND n.line_no = c.line_no),
f AS (SELECT *, len(list_filter({_DIRS}, lambda d: {_DIR} <> '' AND (contains({_DIR}, {_MSGN}) OR contains({_MSGN}, {_DIR})))) > 0 AS echo,
  NOT {in_sql('category', L.CATEGORIES)} AS badcat,
  length(message) > 300 OR regexp_matches(message, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]|[^\\x00-\\x7F]') OR regexp_matches(message, {q(S.PATH_HINT)}) AS badmsg,
  regexp_matches(message, {q(T.ANY_SECRET)}) AS secret FROM e),
g AS (SELECT *, sum(CASE WHEN echo OR badcat OR badmsg OR secret THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY line_no) - CASE WHEN echo OR badcat OR badmsg OR secret THEN 0 ELSE 1 END AS before FROM f)
"""


@query("dataset_gate", GATE_SQL + """SELECT file, line_no, array_to_string(list_filter([CASE WHEN echo THEN 'dataset_directive_message' END, CASE WHEN badcat THEN 'dataset_bad_category' END,
  CASE WHEN badmsg THEN 'dataset_bad_message' END, CASE WHEN secret THEN 'dataset_secret' END, CASE WHEN before >= 20 THEN 'dataset_rate_limit' END], lambda x: x IS NOT NULL), ';') AS problems,
  NOT (echo OR badcat OR badmsg OR secret OR before >= 20) AS accepted FROM g""")
def dataset_gate(t: Tables) -> DataFrame:
    """Quarantine decision of every corpus message, at most 20 accepted per log."""
    lines = log_lines(t.lineitem)
    from tracesieve.operators.diagnostics import parse_corpus
    e = parse_corpus(lines, ["file", "k"]).select("file", "line_no", "message",
                                                  F.coalesce(L.verified_label(F.col("message")), F.lit("unknown")).alias("category"),
                                                  F.expr(_SOURCE).alias("source_text"))
    g = S.entry_gate(e, "file", line_chunk(), ["line_no"], "message", "category", "source_text", run_limit=20, keep=["file", "line_no"])
    return g.select("file", "line_no", F.array_join("problems", ";").alias("problems"), "accepted")
