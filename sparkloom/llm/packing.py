"""Packing: length buckets that minimise padding, and token-budget batches inside them.

Documents over `SEQUENCE` tokens are cut into full pieces and a rest, so the global histogram of
piece lengths has at most SEQUENCE rows. Dynamic programming over it places `BUCKETS` boundaries with
the least total padding. Inside a bucket, pieces are numbered and each batch takes as many rows
as the padded budget allows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

SEQUENCE = 2048
BUCKETS = 8
BATCH_TOKENS = 16384
GROUP_ROWS = 4096  # rows that one task numbers together
TOKENS = r"[^\x20\x09-\x0D]+"  # a token is a run of non-blanks, unless the caller names a column of token counts


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most `buckets` buckets that minimise sum(count * (bound - length)); of equal plans the one with the earliest cuts.

    cost(i, j) of one bucket for lengths i < k <= j is bound_j * (C_j - C_i) - (T_j - T_i) with prefix sums C of
    counts and T of tokens; best_m(j) = min over i of best_{m-1}(i) + cost(i, j).
    """
    n = len(lengths)
    if not n:
        return []
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, object)[order], np.asarray(counts, object)[order]
    many = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(lengths * counts)])
    exact = int(many[-1]) * int(lengths[-1]) < 1 << 62  # otherwise Python's integers
    kind = np.int64 if exact else object
    many, tokens, bound = many.astype(kind), tokens.astype(kind), lengths.astype(kind)
    best = bound * many[1:] - tokens[1:]  # one bucket
    choice = []
    for _ in range(1, min(buckets, n)):
        now, cut = best.copy(), np.full(n, -1)
        for j in range(1, n):
            options = best[:j] + bound[j] * (many[j + 1] - many[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            i = int(np.argmin(options))
            if options[i] < now[j]:
                now[j], cut[j] = options[i], i
        choice.append(cut)
        best = now
    out, j = [int(lengths[-1])], n - 1
    for cut in reversed(choice):
        if cut[j] >= 0:
            j = int(cut[j])
            out.append(int(lengths[j]))
    return out[::-1]


def pieces(docs: DataFrame, sequence: int = SEQUENCE, length_col: str | None = None) -> DataFrame:
    """doc_id, part (from 0) and length of each piece; a text without tokens is one piece of length 0."""
    length = F.col(length_col).cast("long") if length_col else F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKENS)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).alias("tokens"))
    last = F.greatest(F.ceil(F.col("tokens") / sequence) - 1, F.lit(0))
    return sized.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part")).select("doc_id", "part", F.least(F.lit(sequence), F.col("tokens") - F.col("part") * sequence).cast("int").alias("length"))


def pack(docs: DataFrame, sequence: int = SEQUENCE, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, length_col: str | None = None) -> DataFrame:
    """doc_id, part, length, bucket (its upper bound), batch (from 0 in each bucket), place in the batch and padding of every piece.

    Every token of every row is packed, repeated rows included; null texts are empty; other columns don't matter. Pieces of length 0 are in the lowest
    bucket. A batch of a bucket with bound b has max(1, batch_tokens // b) rows, all but each bucket's last one full. The order in a
    bucket is by hash of id and part, then length. No rows in, no rows out.

    The histogram is pre-aggregated and has at most sequence + 1 rows. Numbering a bucket is spread: pieces
    are dealt to groups of about GROUP_ROWS by hash, numbered there, and moved by the sizes of the groups before. Pieces of one id, part and length (null or
    repeated ids) can't be told apart: they are one row with a count until all is numbered, and are then counted out in runs, so no task holds them all.
    """
    rows = settle(pieces(docs, sequence, length_col))
    histogram = rows.groupBy("length").agg(F.count("*").alias("n")).toPandas()  # at most sequence + 1 rows
    bounds = best_boundaries(histogram["length"].to_numpy(), histogram["n"].to_numpy(), buckets) or [sequence]
    groups = max(1, -(-int(histogram["n"].sum()) // GROUP_ROWS))
    bucket = F.element_at(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("length")), 1)
    order = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("part").cast("string")))
    group = F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % groups
    alike = rows.groupBy("doc_id", "part", "length").agg(F.count("*").alias("copies"))
    dealt = alike.select("*", bucket.alias("bucket"), order.alias("order")).withColumn("group", group)
    sizes = dealt.groupBy("bucket", "group").agg(F.sum("copies").alias("rows"))
    # a row for each bucket and GROUP_ROWS pieces
    before = sizes.select("bucket", "group", (F.sum("rows").over(Window.partitionBy("bucket").orderBy("group")) - F.col("rows")).alias("before"))
    place = Window.partitionBy("bucket", "group").orderBy("order", "doc_id", "part", "length").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("at", F.sum("copies").over(place) - F.col("copies")).join(before, ["bucket", "group"])
    firsts = ranked.select("doc_id", "part", "length", "bucket", (F.col("before") + F.col("at")).alias("first"), "copies")
    single, many = firsts.filter("copies = 1"), firsts.filter("copies > 1")
    runs = many.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(GROUP_ROWS).cast("long"))).alias("run"))
    runs = runs.repartition("bucket", "first", "run")
    counted = runs.select("*", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + GROUP_ROWS, "copies") - 1)).alias("copy"))
    columns = ["doc_id", "part", "length", "bucket"]
    numbered = single.select(*columns, F.col("first").alias("number")).unionAll(counted.select(*columns, (F.col("first") + F.col("copy")).alias("number")))
    fits = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest("bucket", F.lit(1)))).cast("long")
    return numbered.select(*columns, F.floor(F.col("number") / fits).alias("batch"), F.pmod("number", fits).alias("place"), (F.col("bucket") - F.col("length")).alias("padding"))
