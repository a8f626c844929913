"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Every text of K words or more has a hash for each K-gram; of each SPAN - K + 1 hashes in a row the least is a
fingerprint. Two texts that share SPAN words share all hashes of that span, so they share a fingerprint in it: no shared
span of SPAN words or more is missed. Training and test fingerprints are joined; each hit is then extended word by word
along both texts, and counts only if the words that agree around it number SPAN or more.

Items of fewer than SPAN words are one window each, and are looked up whole by a hash of all their words: the runs of as
many words are hashed in the same pass as the fingerprints, for the lengths that occur, nine at most. Texts are read twice:
once for values of fingerprints, once for the words around them in those rows that share one.

Defined cases: a null text has no words; an item without words is no window; rows that repeat a doc_id are judged by
their own text; a very long text is read whole, its fingerprints are a fixed share of its words; a word run that repeats
within a text counts at each place; items with equal texts are all named; an empty benchmark leaves every document clean;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bounded, documents, settle, table

#: What separates words, once A-Z are lower case.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window, and of a hashed gram.
SPAN, K = 10, 5
W = SPAN - K + 1
#: Greatest number of benchmark fingerprints that are broadcast, about 400 bytes each; beyond it both sides are shuffled.
BROADCAST_ROWS = 100_000


def words_of(text: Column | str) -> Column:
    """The words of a text after A-Z became lower case; of null, none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS)
    return F.filter(parts, lambda w: w != "")


def _grams(words: Column, k: int) -> Column:
    """A hash for each k words in a row."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.xxhash64(F.slice(words, i, k)))


def _padded(words: Column) -> Column:
    """The words between SPAN - K empty strings on both sides, so that each gram's context is one slice."""
    side = F.array_repeat(F.lit(""), SPAN - K)
    return F.concat(side, words, side)


def _least(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, the gram hashes ``g`` and their window minima ``m`` of ``words``; texts of under SPAN words have none.

    Short texts get empty arrays and no filter, which would be pushed down and split each text a second time.
    """
    none = F.expr("cast(array() as array<bigint>)")
    long = df.select(*keep, F.when(F.size("words") >= SPAN, _grams(F.col("words"), K)).otherwise(none).alias("g"))
    least = F.transform(F.sequence(F.lit(1), F.size("g") - W + 1), lambda j: F.array_min(F.slice("g", j, W)))
    return long.withColumn("m", F.when(F.size("g") >= W, least).otherwise(none))


def _winnowed(df: DataFrame, ids: list[str]) -> DataFrame:
    """ids, fp, pos and context of each fingerprint of ``words``."""
    long = _least(df.select(*ids, "words", _padded(F.col("words")).alias("padded")), [*ids, "padded"])

    def chosen(i: Column) -> Column:
        from_ = F.greatest(i - W + 1, F.lit(0))
        return F.array_contains(F.slice("m", from_ + 1, W), F.get("g", i))

    at = F.when(F.size("m") > 0, F.filter(F.sequence(F.lit(0), F.size("m") + (W - 2)), chosen))
    found = F.transform(at, lambda i: F.struct(F.get("g", i).alias("fp"), i.alias("pos"), F.slice("padded", i + 1, 2 * SPAN - K).alias("ctx")))
    return long.select(*ids, F.explode(found).alias("x")).select(*ids, "x.fp", "x.pos", "x.ctx")


def _extended(a: Column, b: Column) -> tuple[Column, Column]:
    """How many words agree to the left and to the right of the gram, within both contexts."""
    side = SPAN - K

    def run(order: list[int]) -> Column:
        agree = F.lit(0)
        for j in reversed(order):
            agree = F.when((F.get(a, F.lit(j)) == F.get(b, F.lit(j))) & (F.get(a, F.lit(j)) != ""), agree + 1).otherwise(F.lit(0))
        return agree

    return run(list(range(side - 1, -1, -1))), run(list(range(SPAN, SPAN + side)))


def _short_runs(words: Column, lengths: list[int], context: bool) -> Column:
    """(fp, pos, ctx) of each run of as many words as one of ``lengths``, or with no ``context`` the distinct fp alone."""
    none = "array<struct<fp:bigint,pos:int,ctx:array<string>>>" if context else "array<bigint>"
    out = F.expr(f"cast(array() as {none})")

    def placed(n: int) -> Column:
        return F.transform(_grams(words, n), lambda g, i: F.struct(g.alias("fp"), i.alias("pos"), F.slice(words, i + 1, n).alias("ctx")))

    for n in lengths:
        runs = placed(n) if context else _grams(words, n)
        out = F.concat(out, F.when(F.size(words) >= n, runs).otherwise(F.expr(f"cast(array() as {none})")))
    return out if context else F.array_distinct(out)


def _short_hits(found: DataFrame, short: DataFrame, lengths: list[int], ids: list[str]) -> DataFrame:
    """Hits of items of under SPAN words in the rows that share the hash of one; ``found`` has ids and words."""
    items = short.select("item_id", F.xxhash64("words").alias("fp"), F.col("words").alias("item_words"))
    runs = found.select(*ids, F.explode(_short_runs(F.col("words"), lengths, True)).alias("x")).select(*ids, "x.fp", "x.pos", "x.ctx")
    same = runs.join(_sized(settle(items, "short-items")), "fp").where(F.col("ctx") == F.col("item_words"))
    return same.select(*ids, "item_id", F.col("pos").alias("lo"), (F.col("pos") + F.size("ctx") - 1).alias("hi"))


def _sized(small: DataFrame) -> DataFrame:
    """A broadcast of a table whose rows were counted to be few; any other stays as it is, for a shuffle."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of("text").alias("words"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def marks(docs: DataFrame, prints: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, text_hash, n_words and whether a fingerprint, or a run of ``lengths`` words, is shared, of each distinct row.

    Only values of fingerprints take part here; positions and contexts are worked out for the rows that share one. One
    more row, with a key of its own, carries each text's number of words.
    """
    d = _keyed(docs)
    few = _sized(prints.select("fp").distinct())
    runs = [_short_runs(F.col("words"), lengths, False).alias("runs")] if lengths else []
    long = _least(d.select("doc_id", "text_hash", "words", F.size("words").alias("n"), *runs), ["doc_id", "text_hash", "n", *(["runs"] if lengths else [])])
    prints_of = F.array_union("m", "runs") if lengths else F.array_distinct("m")
    rows = F.concat(F.array(F.struct(F.xxhash64("doc_id", "text_hash", F.lit("n")).alias("fp"), F.col("n").alias("n"))), F.transform(prints_of, lambda x: F.struct(x.alias("fp"), F.lit(None).cast("int").alias("n"))))
    each = long.select("doc_id", "text_hash", F.explode(rows).alias("x")).select("doc_id", "text_hash", "x.fp", "x.n")
    flagged = each.join(few.withColumn("shared", F.lit(True)), "fp", "left").where("n is not null or shared")
    return settle(flagged.groupBy("doc_id", "text_hash").agg(F.max("n").cast("long").alias("n_words"), F.coalesce(F.bool_or("shared"), F.lit(False)).alias("shared")), "marks")


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The marks of all rows, and doc_id, text_hash, item_id and first and last hit word (from 0) of each extended hit."""
    ids = ["doc_id", "text_hash"]
    b = benchmark.select("item_id", words_of("text").alias("words")).where(F.size("words") > 0)
    prints = settle(_winnowed(b, ["item_id"]).groupBy("fp", "ctx").agg(F.collect_set("item_id").alias("items")), "prints")
    short = b.where(F.size("words") < SPAN)
    lengths = sorted(r["n"] for r in short.select(F.size("words").alias("n")).distinct().collect())
    values = prints.select("fp").union(short.select(F.xxhash64("words").alias("fp"))) if lengths else prints
    marked = marks(docs, values, lengths)
    some = bounded(marked.where("shared").select(*ids))
    raw = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    d = raw.join(some, _same(raw, some), "left_semi").select("doc_id", "text_hash", words_of("text").alias("words"))
    left, right = _extended(F.col("ctx"), F.col("item_ctx"))
    joined = _winnowed(d, ids).join(_sized(prints.withColumnRenamed("ctx", "item_ctx")), "fp").withColumns({"left": left, "right": right})
    same = F.slice("ctx", SPAN - K + 1, K) == F.slice("item_ctx", SPAN - K + 1, K)
    found = joined.where(same & (F.col("left") + F.col("right") + K >= SPAN)).select(*ids, F.explode("items").alias("item_id"), (F.col("pos") - F.col("left")).alias("lo"), (F.col("pos") + K - 1 + F.col("right")).alias("hi"))
    return marked, found.union(_short_hits(d, short, lengths, ids)) if lengths else found


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document: n_words, n_hit, the hit words' positions, n_items, items_sha256 and contaminated."""
    marked, found = hits(docs, benchmark)
    per_doc = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"), F.collect_set("item_id").alias("items"))
    at = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["lo"], s["hi"]))))
    per_doc = settle(per_doc.select("doc_id", "text_hash", at.alias("hit_words"), "items"), "hits")
    judged = marked.join(per_doc, _same(marked, per_doc), "left").select(marked["doc_id"], marked["text_hash"], "n_words", "hit_words", "items")
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    judged = judged.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce(F.size("hit_words"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(names, F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.col("hit_words").isNotNull().alias("contaminated"),
        "hit_words",
    )
    every = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    return every.join(judged, _same(every, judged)).select(judged["doc_id"], judged["text_hash"], *judged.columns[2:])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which a window of the benchmark occurs."""
    bad = bounded(settle(hits(docs, benchmark)[1].select("doc_id", "text_hash").distinct(), "contaminated"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"))
    return keyed.join(bad, _same(keyed, bad), "left_anti").select("row.*")


def op7_winnowing(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    out = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _sql_words(table_name: str, key: str) -> str:
    return f"""select {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from {table_name}"""


#: The contract by every run of words of every document, in DuckDB: no fingerprints, no extension.
ORACLE = f"""
with d as ({_sql_words("documents", "row_number() over () as k, doc_id")}),
b as ({_sql_words("benchmark", "item_id")}),
item_runs as (
    select distinct item_id, least(len(w), {SPAN}) as n, array_to_string(w[i:i + least(len(w), {SPAN}) - 1], ' ') as run
    from b, lateral (select unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) as i) where len(w) > 0
),
doc_runs as (
    select k, i, n, array_to_string(w[i:i + n - 1], ' ') as run
    from (select k, w, n from d, (select distinct n from item_runs) where len(w) >= n), lateral (select unnest(range(1, len(w) - n + 2)) as i)
),
hit as (select distinct k, i, n, item_id from doc_runs join item_runs using (n, run)),
words_hit as (select k, count(distinct i + j) as n_hit from hit, lateral (select unnest(range(n)) as j) group by k),
items_hit as (
    select k, count(*) as n_items, string_agg(item, ',' order by item) as items
    from (select distinct k, cast(item_id as varchar) as item from hit) group by k
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join words_hit using (k) left join items_hit using (k)
"""
