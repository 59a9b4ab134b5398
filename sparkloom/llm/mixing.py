"""Mixing sources to target weights by temperature, as budgeted permutations of blocks.

With p a source's share of all tokens, its weight is p^t over the sum of all p^t. Entropy falls as t
grows, and so does the most repeated source's number of passes fall towards t = 1; bisection finds t for
the target. The budget is the least in which no source gets less than one pass, unless one is named. Each source is cut
to `BLOCKS` blocks by hash. Whole passes take all blocks; the last pass takes blocks in the order of a
keyed permutation until the source's tokens are spent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..names import fresh
from .common import settle

BLOCKS = 256  # blocks of a source
SEED = "mix"
REPEATS = 2.0  # most passes over a source, on average
SHARPEST = 8.0
LEVELS = 4  # bisection steps per Spark job
STEPS = 40
BROADCAST_ROWS = 100_000  # a plan of more rows is joined by shuffle
TOKENS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Target:
    """entropy: wanted entropy of the weights as a share of the most possible (0 to 1); repeats: most passes over any source.

    Entropy alone takes the largest exponent that reaches it; repeats alone the smallest that keeps to it; with both, the limit on repeats comes first.
    """

    entropy: float | None = None
    repeats: float | None = REPEATS


def source_key(column: str = "source"):
    """The source as text that is never null: null sources are one source of their own."""
    return F.when(F.col(column).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(column).cast("string")))


def block_of(id_col: str = "doc_id", blocks: int = BLOCKS, seed: str = SEED):
    """The block of a row, from its id (null: none) and the seed."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(blocks)).cast("int")


def block_tokens(docs: DataFrame, length_col: str | None = None, blocks: int = BLOCKS, seed: str = SEED) -> DataFrame:
    """key, block, tokens and docs: at most `blocks` rows a source, pre-aggregated, so a hot source is no hot task."""
    length = F.col(length_col).cast("long") if length_col else F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKENS)).cast("long")
    rows = docs.select(source_key().alias("key"), block_of("doc_id", blocks, seed).alias("block"), F.coalesce(length, F.lit(0)).alias("tokens"))
    return rows.groupBy("key", "block").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))


def exponent(sources: DataFrame, target: Target) -> float:
    """The exponent t by bisection over `sources` (key, tokens); 1 keeps the sources' own shares, more sharpens them.

    entropy: the largest t up to SHARPEST whose weights have at least that share of the most possible entropy. repeats: the smallest t
    at which, if each source gets at least one pass, none gets more than `repeats`. With both, the repeats decide if they ask for more.
    LEVELS steps are taken per job: the job evaluates all exponents that these steps can reach.
    """
    sized = sources.filter("tokens > 0")
    total, n, low_share, high_share = sized.agg(F.sum("tokens"), F.count("*"), F.min("tokens"), F.max("tokens")).first()
    if not n or n == 1:
        return 1.0
    p = F.col("tokens") / F.lit(float(total))
    t = 1.0
    if target.entropy is not None:
        t = bisect(lambda ts: entropies(sized, p, ts, n), target.entropy, top=SHARPEST)
    if target.repeats is not None:
        # passes of a source at budget B: w * B / tokens, in proportion to p^(t-1), largest for the smallest source; the largest source gets one
        from math import log

        spread = log(high_share / low_share)
        need = bisect(lambda ts: [-((1 - x) * spread) for x in ts], -log(target.repeats), rising=True) if spread > log(target.repeats) else 0.0
        t = max(t, need) if target.entropy is not None else need  # at more than 1 small sources are never repeated more than large ones
    return round(t, 9)


def bisect(values, goal: float, rising: bool = False, top: float = 1.0, levels: int = LEVELS, steps: int = STEPS) -> float:
    """The place in [0, top] where values(ts) crosses the goal: falling values, the largest t with value >= goal; rising ones, the smallest.

    values: gives the values of a list of exponents, in one job.
    """
    lo, hi = 0.0, top
    first, last = values([lo, hi])
    if rising:
        if first >= goal:
            return lo
    elif last >= goal:
        return hi
    elif first < goal:
        return lo
    done = 0
    while done < steps:
        grid = [lo + (hi - lo) * k / (1 << levels) for k in range(1, 1 << levels)]
        found = values(grid)
        a, b = 0, 1 << levels
        for _ in range(levels):
            m = (a + b) // 2
            if (found[m - 1] >= goal) != rising:
                a = m
            else:
                b = m
        edges = [lo, *grid, hi]
        lo, hi = edges[a], edges[b]
        done += levels
    return hi if rising else lo


def entropies(sized: DataFrame, p, ts: list[float], n: int) -> list[float]:
    """Entropy of the weights p^t / sum p^t over log(n), for each t: log Z - t * (sum p^t log p) / Z."""
    from math import log

    row = sized.agg(*[F.sum(F.pow(p, F.lit(t))) for t in ts], *[F.sum(F.pow(p, F.lit(t)) * F.log(p)) for t in ts]).first()
    return [(log(row[i]) - t * row[len(ts) + i] / row[i]) / log(n) for i, t in enumerate(ts)]


def plan(docs: DataFrame, target: Target = Target(), budget: int | None = None, length_col: str | None = None, blocks: int = BLOCKS, seed: str = SEED) -> DataFrame:
    """key, block, epoch and place: the block's place in each pass over its source that it is part of.

    A source of T tokens and weight w gets w * budget tokens: that many whole passes and, of the rest, blocks in the permuted order
    as long as more than half of the next one fits. Each pass has its own permutation. Without a budget, it is the
    largest T / w, so no source gets less than one pass. Sources without tokens get one pass.
    """
    sized = settle(block_tokens(docs, length_col, blocks, seed))
    sources = settle(sized.groupBy("key").agg(F.sum("tokens").alias("total")))
    t = exponent(sources.select("key", F.col("total").alias("tokens")), target)
    raised = F.pow(F.col("total").cast("double"), F.lit(t))
    z, most = sources.filter("total > 0").agg(F.sum(raised), F.max(F.col("total") / raised)).first()
    spend = float(budget) if budget is not None else (most or 0.0) * (z or 0.0)
    quota = F.when(F.col("total") > 0, F.round(raised / F.lit(z or 1.0) * F.lit(spend)).cast("long")).otherwise(0)
    passes = sources.select("key", "total", quota.alias("quota")).select("key", F.when(F.col("total") > 0, F.expr("quota div total")).otherwise(1).alias("whole"), F.when(F.col("total") > 0, F.expr("quota % total")).otherwise(0).alias("rest"))
    order = F.md5(F.concat_ws("|", F.lit(seed), "key", F.col("epoch").cast("string"), F.col("block").cast("string")))
    epochs = sized.join(passes, "key").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole")))).withColumn("turn", order)
    one_pass = Window.partitionBy("key", "epoch").orderBy("turn", "block")  # at most `blocks` rows
    placed = epochs.withColumn("place", F.row_number().over(one_pass)).withColumn("before", F.sum("tokens").over(one_pass) - F.col("tokens"))
    taken = (F.col("epoch") < F.col("whole")) | ((F.col("before") < F.col("rest")) & (2 * (F.col("rest") - F.col("before")) > F.col("tokens")))
    return settle(placed.filter(taken).select("key", "block", F.col("epoch").cast("int").alias("epoch"), "place"))


def _passes(docs: DataFrame, kept: list, target: Target, budget: int | None, length_col: str | None, blocks: int, seed: str) -> tuple[DataFrame, str]:
    """`kept` columns of docs and, in a column of the returned name, the pass (epoch, place): a row for each pass that takes the row's block.

    Small plans are broadcast, larger ones joined by source and block, so a hot source is spread over `blocks` keys.
    """
    key, block, several, one = (fresh(f"_mix_{n}", docs) for n in ("key", "block", "passes", "pass"))
    chosen = plan(docs, target, budget, length_col, blocks, seed)
    chosen = chosen.groupBy("key", "block").agg(F.collect_list(F.struct("epoch", "place")).alias(several)).select(F.col("key").alias(key), F.col("block").alias(block), several)
    rows = docs.select(*kept, source_key().alias(key), block_of("doc_id", blocks, seed).alias(block))
    small = chosen.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(chosen) if small else chosen, [key, block])
    return joined.withColumn(one, F.explode(several)), one


def mix(docs: DataFrame, target: Target = Target(), budget: int | None = None, length_col: str | None = None, blocks: int = BLOCKS, seed: str = SEED) -> DataFrame:
    """doc_id, source, epoch, place and turn of each row, once for each pass that takes the row's block.

    Training order: epoch, place, turn (a hash of the id). Repeated rows stay repeated, null sources are one source, null texts have no tokens;
    an empty table gives no rows.
    """
    turn = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"))).alias("turn")
    taken, one = _passes(docs.select("doc_id", "source", "text", *([length_col] if length_col else [])), ["doc_id", "source", turn], target, budget, length_col, blocks, seed)
    return taken.select("doc_id", "source", F.col(one).epoch.alias("epoch"), F.col(one).place.alias("place"), "turn")


def repeated(docs: DataFrame, target: Target = Target(), budget: int | None = None, length_col: str | None = None, blocks: int = BLOCKS, seed: str = SEED) -> DataFrame:
    """The rows of docs with all their columns, whatever their names, as often as `mix` takes them."""
    return _passes(docs, ["*"], target, budget, length_col, blocks, seed)[0].select(docs.columns)
