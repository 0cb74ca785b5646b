"""Training-set assembly: ordered dedupe, caps, splits, exclusion and leakage checks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.functions.ordered import first_per_key, ranked, running, top_n_per_key
from tracesieve.functions.rules import all_matches
from tracesieve.functions.text import holds_secret, strip
from tracesieve.operators.labels import CATEGORIES


def content_key(*cols: Column) -> Column:
    """Fixed-width key of long texts, so shuffles and sorts never carry the text as key."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"}), 256)


def group_id(c: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(c), 1, 8))


def dedupe_first(df: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """First row per key in arrival order."""
    return first_per_key(df.withColumn("__key", key), ["__key"], order).drop("__key")


def cap_per_class(df: DataFrame, label: str, order: Sequence[Column], cap: int) -> DataFrame:
    return top_n_per_key(df, [label], order, cap)


def nested_caps(df: DataFrame, program: str, message: str, category: str, order: Sequence[str],
                per_message: int = 15, per_category: int = 150) -> DataFrame:
    """Unique (program, message), then at most ``per_message`` per message and ``per_category``
    per category. The category must be a function of the message; then the stages equal a
    one-by-one greedy pass."""
    uniq = df.groupBy(program, message, category).agg(F.min(F.struct(*order)).alias("__o"))
    by = [F.col("__o"), F.col(program)]
    a = top_n_per_key(uniq, [message], by, per_message)
    b = top_n_per_key(a, [category], [F.col("__o"), F.col(program), F.col(message)], per_category, rank="place")
    return b.select(program, message, category, "place")


def grouped_split(df: DataFrame, group: str, label: str, ident: str, test_share: float = 0.20,
                  val_share: float = 0.15, train_cap: int = 1500) -> DataFrame:
    """Adds ``split``: whole groups held out for test, the rest split per class.

    Order is by MD5 of group and row id, so the split does not depend on partitioning. Rows over
    the train cap get NULL.
    """
    groups = df.select(group).distinct().withColumn("__gh", F.md5(F.col(group).cast("string")))
    n_groups = groups.agg(F.greatest(F.lit(1), F.floor(F.count("*") * test_share)))
    places = ranked(groups, [], ["__gh"], "__gr")
    held = places.where(F.col("__gr") <= n_groups.scalar()).select(group, F.lit(True).alias("__test"))
    marked = df.join(held, group, "left").withColumn("__h", F.md5(F.col(ident).cast("string")))
    pool = marked.where("__test IS NULL")
    sizes = pool.groupBy(label).agg(F.count("*").alias("__n"))
    n_val = F.when(F.col("__n") >= 10, F.greatest(F.lit(2), F.floor(F.col("__n") * val_share))).otherwise(F.lit(1))
    placed = ranked(pool, [label], ["__h"], "__r").join(sizes.select(label, n_val.alias("__v")), label)
    split = (F.when(F.col("__r") <= F.col("__v"), "val")
             .when(F.col("__r") <= F.col("__v") + train_cap, "train"))
    rest = placed.withColumn("split", split).select(*df.columns, "split")
    return rest.unionByName(marked.where("__test").select(*df.columns, F.lit("test").alias("split")))


def exclude(df: DataFrame, key: str, *gold: DataFrame) -> DataFrame:
    """Rows whose key occurs in none of the gold key sets."""
    keys = gold[0].select(key)
    for g in gold[1:]:
        keys = keys.unionByName(g.select(key))
    return df.join(keys.distinct(), key, "left_anti")


def leakage(df: DataFrame, key: str, split: str, gold: DataFrame) -> DataFrame:
    """One row with the four pairwise overlaps of distinct keys; one shuffle for all four."""
    tagged = df.select(key, F.col(split).alias("__s")).unionByName(gold.select(key, F.lit("gold").alias("__s")))
    seen = tagged.groupBy(key).agg(*[F.max(F.when(F.col("__s") == s, 1).otherwise(0)).alias(s)
                                     for s in ("train", "val", "test", "gold")])
    return seen.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("bigint").alias(f"{a}_{b}")
                      for a, b in (("train", "test"), ("train", "gold"), ("val", "test"), ("val", "gold"))])


def assert_no_leakage(df: DataFrame, key: str, split: str, gold: DataFrame) -> None:
    row = leakage(df, key, split, gold).first().asDict()
    bad = {k: v for k, v in row.items() if v}
    if bad:
        raise ValueError(f"splits share keys: {bad}")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows, share and imbalance ratio per class; ``warn`` above 10."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy()  # one row per class by now
    ratio = F.max("n").over(w) / F.min("n").over(w)
    return counts.select(label, "n", (F.lit(100.0) * F.col("n") / F.sum("n").over(w)).alias("pct"),
                         ratio.alias("imbalance"), (ratio > 10).alias("warn"))


def top_values(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """Most frequent values; ties by value."""
    return df.where(F.col(col) != "").groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(n)


def unique_per_class(df: DataFrame, label: str, key: str, few: int = 30, approximate: bool = False) -> DataFrame:
    """Rows and distinct keys per class. The exact form dedupes (class, key) first, which spreads a
    hot class over all tasks; ``approximate`` uses a sketch."""
    if approximate:
        u = df.groupBy(label).agg(F.count("*").alias("n"), F.approx_count_distinct(key).alias("uniq"))
    else:
        u = (df.groupBy(label, key).agg(F.count("*").alias("__c")).groupBy(label)
             .agg(F.sum("__c").alias("n"), F.count("*").alias("uniq")))
    return u.withColumn("few", F.col("uniq") < few)


def union_ranked(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Union with ``source`` name and ``source_rank`` in the given order."""
    out = None
    for i, (name, df) in enumerate(parts):
        tagged = df.withColumns({"source": F.lit(name), "source_rank": F.lit(i)})
        out = tagged if out is None else out.unionByName(tagged)
    return out


def merge_unseen(existing: DataFrame, new: DataFrame, keys: list[str], order: Sequence[Column]) -> DataFrame:
    """Existing rows plus the first new row of every unseen key."""
    fresh = first_per_key(new.join(existing.select(*keys).distinct(), keys, "left_anti"), keys, order)
    return existing.withColumn("origin", F.lit("existing")).unionByName(fresh.withColumn("origin", F.lit("new")))


def augment(base: DataFrame, new: DataFrame, excluded: DataFrame, label: str, key: str,
            order: Sequence[Column], cap: int = 1500) -> DataFrame:
    """New rows that are neither excluded nor seen, while the class stays within the cap."""
    fresh = first_per_key(exclude(new, key, excluded, base), [key], order)
    ranked = top_n_per_key(fresh, [label], order, cap, rank="__r")
    have = base.groupBy(label).agg(F.count("*").alias("__have"))
    return ranked.join(have, label, "left").where(F.col("__r") + F.coalesce("__have", F.lit(0)) <= cap) \
        .select(*new.columns)


# fixed values: directive lines, path hints, limits of the entry gate
DIRECTIVE = r"(?im)^\s*#\s*(?:error|warning)\s+([^\n]*)"
PATH_HINT = r"(?i)(?:[a-zA-Z]:[/\\]|[/\\]Users[/\\]|[/\\]home[/\\])"
MESSAGE_LIMIT = 300
RUN_LIMIT = 50
STORE_LIMIT = 5 * 1024 * 1024


def _flat(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(c, r"\s+", " ")))


def entry_problems(message: Column, category: Column, source_text: Column, store_bytes: int = 0) -> Column:
    """Array of rejection categories of one entry, without the run cap."""
    msg = F.coalesce(message, F.lit(""))
    norm = _flat(msg)
    # only texts with a "#" are searched
    said = F.when(source_text.contains("#"), F.regexp_extract_all(source_text, F.lit(DIRECTIVE), F.lit(1))).otherwise(F.array().cast("array<string>"))
    dirs = F.transform(F.coalesce(said, F.array().cast("array<string>")), lambda d: _flat(F.regexp_replace(strip(d), r"^[\x22']+|[\x22']+$", "")))
    echo = (msg != "") & F.exists(dirs, lambda d: (d != "") & (d.contains(norm) | norm.contains(d)))
    bad = (strip(msg) == "") | (F.length(msg) > MESSAGE_LIMIT) | msg.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]|[^\x00-\x7F]") | msg.rlike(PATH_HINT)
    return all_matches([
        (echo, F.lit("dataset_directive_message")),
        (F.coalesce(~category.isin(*CATEGORIES), F.lit(True)), F.lit("dataset_bad_category")),
        (bad, F.lit("dataset_bad_message")),
        (holds_secret(msg), F.lit("dataset_secret")),
        (F.lit(store_bytes > STORE_LIMIT), F.lit("dataset_store_too_large")),
    ])


def entry_gate(df: DataFrame, session: str, chunk: Column, order: list[str], message: str, category: str,
               source_text: str, run_limit: int = RUN_LIMIT, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds ``problems`` and ``accepted`` to ``keep``, all columns by default: texts left out are not sorted. A session accepts ``run_limit`` entries; only accepted
    ones count, and an entry with another problem is never accepted, so a running count decides."""
    checked = df.select(*(df.columns if keep is None else keep), entry_problems(F.col(message), F.col(category), F.col(source_text)).alias("problems"))
    clean = F.size("problems") == 0
    counted = running(checked, [session], chunk, order, {"__ok": ("sum", clean.cast("bigint"))})
    before = F.col("__ok") - clean.cast("bigint")
    full = F.array_append(F.col("problems"), F.lit("dataset_rate_limit"))
    return counted.withColumn("problems", F.when(before >= run_limit, full).otherwise(F.col("problems"))) \
        .withColumn("accepted", F.size("problems") == 0).drop("__ok")
