"""Length buckets with least padding, and token-budget batches inside them.

The global histogram of lengths is one small table; dynamic programming over it
chooses at most `buckets` upper lengths so that the sum of padding is least.  The
recurrence is best[k][i] = min over j of best[k-1][j] + L[i] * (C[i] - C[j]), whose
terms are lines in L[i] with falling slopes, so a lower hull of lines answers each
layer in one sweep.  Batches are runs of `budget // bucket length` documents in the
order of doc_id inside a bucket.

Every length is a row of the histogram.  k distinct lengths take at least k * k / 2
words, so it has at most the square root of twice the corpus's words: 100,000 rows for
five thousand million words.

Cases: null and empty texts have length 0 and go to the first bucket; a document
longer than the budget makes a batch of its own; equal rows are interchangeable; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import materialize, ranked, text_of, words_of


def bin_of(length: Column, exact: int = 65_536) -> Column:
    """The upper edge of the length's bin."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)))) - 10).cast("long")
    step = F.greatest(step, F.lit(1))
    return F.when(length <= exact, length).otherwise(F.ceil(length / step).cast("long") * step)


def best_bounds(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """The upper lengths, ascending, of at most `buckets` groups of consecutive
    lengths with the least sum of upper length times count."""
    n = len(lengths)
    if n <= buckets:
        return list(lengths)
    total = [0]
    for c in counts:
        total.append(total[-1] + c)
    best: list[int | None] = [0] + [None] * n
    cuts: list[list[int]] = []
    for _ in range(buckets):
        now: list[int | None] = [None] * (n + 1)
        cut = [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # slope -C[j], intercept best[j], j
        head = 0
        for i in range(1, n + 1):
            if best[i - 1] is not None:
                line = (-total[i - 1], best[i - 1], i - 1)
                while len(hull) - head >= 2:
                    (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                    if (line[1] - b1) * (m1 - m2) <= (b2 - b1) * (m1 - line[0]):
                        hull.pop()
                    else:
                        break
                hull.append(line)
            x = lengths[i - 1]
            while len(hull) - head >= 2 and hull[head][0] * x + hull[head][1] > hull[head + 1][0] * x + hull[head + 1][1]:
                head += 1
            if len(hull) > head:
                m, b, j = hull[head]
                now[i], cut[i] = m * x + b + x * total[i], j
        cuts.append(cut)
        best = now
    bounds, i = [], n
    for cut in reversed(cuts):
        if i == 0:
            break
        bounds.append(lengths[i - 1])
        i = cut[i]
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = 16, budget: int = 16_384, length: Column | None = None) -> DataFrame:
    """doc_id, length, bucket, bucket_length, batch, slot and padding per document.

    length defaults to the number of words; any integer column expression of docs
    (such as token counts) can take its place."""
    length = F.size(words_of(text_of())) if length is None else length
    sized = docs.select("doc_id", length.cast("long").alias("length"))
    sized = materialize(sized)
    histogram = sorted((r["length"], r["n"]) for r in sized.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())
    bounds = best_bounds([b for b, _ in histogram], [n for _, n in histogram], buckets)
    bucket, upper = F.lit(0), F.lit(bounds[-1] if bounds else 0)
    for k in range(len(bounds) - 1, -1, -1):
        inside = F.col("length") <= bounds[k]
        bucket = F.when(inside, F.lit(k)).otherwise(bucket)
        upper = F.when(inside, F.lit(bounds[k])).otherwise(upper)
    sized = sized.withColumns({"bucket": bucket, "bucket_length": upper.cast("long")})
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    placed = ranked(sized, ["bucket"], ["doc_id"])
    return placed.select(
        "doc_id",
        "length",
        "bucket",
        "bucket_length",
        F.floor(F.col("__row") / rows).cast("long").alias("batch"),
        (F.col("__row") % rows).cast("long").alias("slot"),
        (F.col("bucket_length") - F.col("length")).alias("padding"),
    )
