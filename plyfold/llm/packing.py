"""Packing by optimal length buckets: boundaries by dynamic programming over the global histogram, token-budget batches inside each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions


def word_count(text: Column) -> Column:
    """Words between white space; none in a null or empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets that minimise the sum of (end of its bucket - length) over all texts.

    histogram: (length, count) pairs with distinct lengths. With lengths L sorted, C and S the running sums of counts and of
    count * length, the least padding of the first j lengths in k buckets is L[j] * C[j] - S[j] + min over i of
    best[k - 1][i] + S[i] - L[j] * C[i]: lines of falling slope asked at rising places, so each k takes one pass.
    """
    h = sorted(histogram)
    n, buckets = len(h), min(buckets, len(h))
    if not h:
        return []
    length = [x for x, _ in h]
    c, s = [0], [0]
    for x, m in h:
        c.append(c[-1] + m)
        s.append(s[-1] + m * x)
    best = [length[j - 1] * c[j] - s[j] if j else 0 for j in range(n + 1)]
    came = [[0] * (n + 1)]
    for k in range(2, buckets + 1):
        lines: list[tuple[int, int, int]] = []  # slope -c[i], value best[i] + s[i], i
        new, back, top = [0] * (n + 1), [0] * (n + 1), 0
        for j in range(k, n + 1):
            i = j - 1
            m, b = -c[i], best[i] + s[i]
            while len(lines) >= 2 and (b - lines[-2][1]) * (lines[-2][0] - lines[-1][0]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - m):
                lines.pop()
            lines.append((m, b, i))
            top, x = min(top, len(lines) - 1), length[j - 1]
            while top + 1 < len(lines) and lines[top + 1][0] * x + lines[top + 1][1] <= lines[top][0] * x + lines[top][1]:
                top += 1
            new[j], back[j] = x * c[j] - s[j] + lines[top][0] * x + lines[top][1], lines[top][2]
        best = new
        came.append(back)
    out, j = [], n
    for k in range(buckets - 1, -1, -1):
        out.append(length[j - 1])
        j = came[k][j]
    return out[::-1]


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """(doc_id, n_tokens, bucket_len, bucket, batch, slot) for every row: texts of a bucket are padded to bucket_len.

    `length` counts a row's tokens (by default its words); the boundaries are the best for the exact histogram of all rows, which
    has one entry per distinct length and is all that comes to the driver. A batch holds max(1, budget // bucket_len) texts of
    one bucket, in the order of doc_id; only a bucket's last batch is short, and a text over the budget is a batch alone. Texts
    without tokens are in a bucket of length 0 if that is best, with `budget` texts to a batch. Null ids come first; repeated
    rows get slots of their own; other columns are dropped; an empty table gives an empty table.
    """
    spark = df.sparkSession
    sized = df.select(F.col(id_col).cast("long").alias("doc_id"), (word_count(F.col(text_col)) if length is None else length).cast("long").alias("n_tokens"))
    sized = materialize(sized, "lengths")
    ends = boundaries([(r.n_tokens, r["count"]) for r in sized.groupBy("n_tokens").count().collect()], buckets)
    if not ends:
        ends = [0]
    bucket = F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[i], i).otherwise(bucket)
    end = F.element_at(F.array(*map(F.lit, ends)), F.col("bucket") + 1).cast("long")
    # ranks without a task for each bucket: ordered parts, counted by part and bucket, then offset
    dealt = sized.withColumn("bucket", bucket.cast("int")).repartitionByRange(partitions(spark), "bucket", "doc_id").sortWithinPartitions("bucket", "doc_id")
    dealt = materialize(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "dealt")
    counts = sorted((r.bucket, r.part, r.n, r.first) for r in dealt.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.min("row").alias("first")).collect())  # parts + buckets entries at most
    shift, seen, last = [], 0, None
    for b, part, n, first in counts:
        seen = seen if b == last else 0
        shift.append((b, part, first - seen))
        seen, last = seen + n, b
    starts = F.broadcast(spark.createDataFrame(shift, "bucket int, part int, shift long"))  # parts + buckets rows at most
    cap = F.greatest(F.lit(1), F.when(end == 0, budget).otherwise(F.floor(F.lit(budget) / end))).cast("long")
    ranked = dealt.join(starts, ["bucket", "part"]).withColumn("rank", F.col("row") - F.col("shift"))
    return ranked.select("doc_id", "n_tokens", end.alias("bucket_len"), "bucket", F.floor(F.col("rank") / cap).cast("long").alias("batch"), (F.col("rank") % cap).cast("long").alias("slot"))
