"""Exact deduplication by content sort, with DataFrame functions only.

The normalised text is ordered by (head, digest, text): ``head`` is its
first 64 characters, ``digest`` its SHA-256.  Splitters drawn from a sample of
(head, digest, place in the input) cut that order into buckets, so each has about as many
rows and a group of copies that holds a third of the corpus is cut across many
buckets by place, whatever its doc_ids.  One shuffle moves each row to its bucket, the external sort
of the window puts equal texts side by side, and every row is compared in full
with its neighbour.  Runs that touch a bucket's edge are joined with those of
the adjacent buckets through a table of two rows per bucket.

Of equal texts the row with the most code points in its original text stays,
then that with the smallest doc_id.

Defined cases: a null text counts as empty; empty texts and those of white space
alone are equal to each other; a null doc_id sorts after every other id; several
rows with one doc_id each count in ``group_size`` and all of them carry the same
``kept`` (``dedup`` keeps exactly one row of the group); extra columns of the
input pass through ``dedup`` untouched and are ignored by ``classes``; an empty
table gives an empty table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import release_shuffles, shuffle_parts, written

#: The white space that does not count, as in [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
HEAD = 64
#: Sampled keys for each bucket, buckets for each shuffle partition, and the most of them: the splitters are part of the plan.
SAMPLED, BUCKETS, MOST_BUCKETS = 20, 4, 32_768
#: Where a doc_id is null, in the order of ids.
NO_ID = 2**63 - 1


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _splitters(placed: DataFrame, text: Column, buckets: int, rows: int) -> list[tuple]:
    """At most ``buckets - 1`` keys in order, from a sample of bounded size, drawn before any text is looked at."""
    want, norm = buckets * SAMPLED, normalised(text)
    some = placed if rows <= want else placed.sample(min(1.0, 1.1 * want / rows), seed=17)
    some = some.limit(2 * want).select(F.left(norm, F.lit(HEAD)), F.sha2(norm, 256), "__place")
    got = sorted(some.toLocalIterator(), key=lambda r: (r[0].encode(), r[1], r[2]))
    step = max(1, len(got) / buckets)
    picked = [tuple(got[int(i * step)]) for i in range(1, buckets) if int(i * step) < len(got)]
    return list(dict.fromkeys(picked))


def _bucket(head: Column, digest: Column, order: Column, splitters: list[tuple]) -> Column:
    """How many splitters are <= the key, by binary search inside one expression."""
    if not splitters:
        return F.lit(0)
    # One literal, however many splitters: JSON text parsed once when the plan is folded.
    listed = json.dumps([{"h": h, "d": d, "i": i} for h, d, i in splitters])
    cuts = F.from_json(F.lit(listed), "array<struct<h:string,d:string,i:bigint>>")
    key = F.struct(head, digest, order)
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        here = (s["lo"] < s["hi"]) & (F.element_at(cuts, F.least(mid, F.lit(len(splitters) - 1)) + 1) <= key)
        lo = F.when(here, mid + 1).otherwise(s["lo"])
        hi = F.when((s["lo"] < s["hi"]) & ~here, mid).otherwise(s["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(len(splitters).bit_length() + 1))
    return F.aggregate(steps, state, halve)["lo"]


def _runs(docs: DataFrame, text: str, doc_id: str, carry: bool) -> DataFrame:
    """Every row with its bucket and its run of equal texts there; ``new`` marks a run's best row.

    ``row`` holds the row itself if ``carry``.
    """
    spark = docs.sparkSession
    ident, body = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")
    place = F.monotonically_increasing_id().alias("__place")
    norm = normalised(body)
    rows = docs.select(
        ident.alias("doc_id"),
        F.coalesce(ident, F.lit(NO_ID)).alias("ord"),
        F.char_length(F.coalesce(body, F.lit(""))).cast("long").alias("points"),
        norm.alias("norm"),
        F.sha2(norm, 256).alias("sha"),
        place,
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    head, parts = F.left(F.col("norm"), F.lit(HEAD)), shuffle_parts(spark)
    splitters = _splitters(docs.select(body.alias("text"), place), F.col("text"), min(BUCKETS * parts, MOST_BUCKETS), docs.count())
    dealt = rows.withColumn("bucket", _bucket(head, F.col("sha"), F.col("__place"), splitters)).drop("__place")
    if carry:  # a row brings its text along, so only one form of it is shuffled
        again = normalised(F.col("row")[text])
        dealt = dealt.drop("norm").repartition(parts, "bucket").withColumn("norm", again)
    else:
        dealt = dealt.repartition(parts, "bucket")
    line = Window.partitionBy("bucket").orderBy(F.left(F.col("norm"), F.lit(HEAD)), "sha", "norm", F.desc("points"), "ord")
    return (
        dealt.withColumn("new", (~F.col("norm").eqNullSafe(F.lag("norm").over(line))).cast("int"))
        .withColumn("run", F.sum("new").over(line))
        .drop("norm")
    )


def _stitched(runs: DataFrame) -> DataFrame:
    """Runs that go on across bucket edges: (bucket, run, size_all, best_all), two rows a bucket at most.

    Only a bucket's first and last run can; digests tell which ones belong together.
    """
    ends = runs.join(runs.groupBy("bucket").agg(F.max("run").alias("last")), "bucket").where(
        (F.col("run") == 1) | (F.col("run") == F.col("last"))
    )
    whole = ends.groupBy("sha").agg(
        F.sum("size").alias("size_all"), F.max("best").alias("best_all"), F.collect_list(F.struct("bucket", "run")).alias("at")
    )
    return whole.where(F.size("at") > 1).select(F.explode("at").alias("at"), "size_all", "best_all").select(
        "at.bucket", "at.run", "size_all", "best_all"
    )


def _best() -> Column:
    return F.max(F.struct(F.col("points"), (-F.col("ord")).alias("neg"))).alias("best")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_points): a row per row of ``docs``."""
    flagged = written(_runs(docs, text, doc_id, carry=False), "content-sort")
    release_shuffles(docs.sparkSession)
    runs = flagged.groupBy("bucket", "run").agg(F.count("*").alias("size"), _best(), F.first("sha").alias("sha"))
    result = (
        flagged.join(runs.drop("sha"), ["bucket", "run"])
        .join(F.broadcast(_stitched(runs)), ["bucket", "run"], "left")  # at most two rows a bucket
        .withColumn("keep", -F.coalesce("best_all", "best")["neg"])
    )
    return result.select(
        "doc_id",
        F.when(F.col("keep") < NO_ID, F.col("keep")).alias("keep_id"),
        F.coalesce("size_all", "size").alias("group_size"),
        (F.col("ord") == F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("points").alias("n_points"),
    )


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Exactly one row of every class of equal texts, with the columns of ``docs``.

    Rows that tie in length and doc_id too are interchangeable; one of them stays.
    """
    best = written(_runs(docs, text, doc_id, carry=True).where("new = 1"), "content-sort")
    release_shuffles(docs.sparkSession)
    runs = best.select("bucket", "run", "sha", F.lit(1).alias("size"), F.struct("points", (-F.col("ord")).alias("neg")).alias("best"))
    ends = _stitched(runs.withColumn("best", F.struct("best.points", "best.neg", "bucket")))
    lost = ends.where(F.col("best_all.bucket") != F.col("bucket")).select("bucket", "run")
    return best.join(F.broadcast(lost), ["bucket", "run"], "left_anti").select("row.*")
