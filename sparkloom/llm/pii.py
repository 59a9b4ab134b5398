"""Personal data by fixed shapes, and by contexts bootstrapped from them; DataFrame functions only.

Base spans: four shapes, each checked (parts of an ip, Luhn of a card, digits of a phone). They are
the seeds. The two words left of a span, or of any token of five or more characters with a digit, are its lexical
pattern: `^` stands for the text's start and `#` for a match of the same shape on the way. Patterns and instances form a graph that is
scored in rounds until nothing changes: a pattern is as good for a kind as the share of its distinct instances that are known to be of that kind; an instance is
accepted when the patterns around it make the kind likely (noisy or); accepted instances count as known in the next round. Tokens
accepted in the end, which no fixed shape covers, are the identifiers the patterns discovered.

Work is linear in the number of matches of a text: places are running sums in two levels of blocks, overlaps are found in one ordered pass over
the spans as rows, and a redacted text is put together from blocks of characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..names import fresh
from .common import settle, text_key

# The shapes. Possessive quantifiers and the looks behind change no match: they keep matching linear and its stack flat.
SHAPES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(SHAPES)
TOKEN = r"(?<![A-Za-z0-9._@+-])(?=[A-Za-z._@+-]*+[0-9])[A-Za-z0-9._@+-]{5,}+"
PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"

SUPPORT = 3  # known instances that a pattern needs
CONFIDENCE = 0.6  # least share of known instances, smoothed by one unknown
ACCEPT = 0.6  # least likelihood of an instance
NEAR = 64  # characters left of a match that are looked at first; all of them where two whole words don't stand there
BLOCK = 256
FREE = len(KINDS)  # the kind of a token that no shape covers


def _passes(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.char_length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def _placed(matches: DataFrame, kind: str) -> DataFrame:
    """The column `kind`: an array of (start, end, hit, context) in code points, from hits_<kind>, and gaps_<kind>: the texts between hits.

    Each step is a column of its own, so that none is evaluated again inside another's lambda function.
    """
    hits, gaps, tails, ends, sizes, begins = (f"{part}_{kind}" for part in ("hits", "gaps", "tails", "ends", "sizes", "begins"))
    found = matches.withColumn(tails, F.transform(gaps, lambda gap: _words(F.right(gap, F.lit(NEAR)))))
    # a third word shows that the last two are whole
    found = found.withColumn(ends, F.transform(tails, lambda words, i: F.when((F.size(words) > 2) | (F.char_length(F.get(F.col(gaps), i)) <= NEAR), words).otherwise(_words(F.get(F.col(gaps), i)))))

    def context(i: Column) -> Column:
        before = F.get(F.col(ends), i - 1)
        left = F.when(i == 0, F.array(F.lit("^"), F.lit("^"))).otherwise(F.array(F.coalesce(F.get(before, F.size(before) - 1), F.lit("#")), F.lit("#")))
        return F.concat_ws(" ", F.slice(F.concat(left, F.get(F.col(ends), i)), -2, 2))

    found = found.withColumn(sizes, F.transform(hits, lambda hit, i: F.struct(F.char_length(F.get(F.col(gaps), i)).alias("gap"), F.char_length(hit).alias("size"), hit.alias("hit"), context(i).alias("context"))))
    block = lambda b: F.slice(F.col(sizes), b * BLOCK + 1, BLOCK)
    last = F.floor((F.size(sizes) - 1) / BLOCK).cast("int")
    sums = F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(block(b), F.lit(0), lambda a, x: a + x.gap + x.size))
    running = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a.at + x).alias("at"), F.array_append(a.out, a.at).alias("out")), lambda a: a.out)
    found = found.withColumn(begins, F.when(F.size(sizes) > 0, running).otherwise(F.array().cast("array<int>")))
    empty = F.array().cast("array<struct<start:int,end:int,hit:string,context:string>>")
    step = lambda a, x: F.struct((a.at + x.gap + x.size).alias("at"), F.array_append(a.out, F.struct((a.at + x.gap).alias("start"), (a.at + x.gap + x.size).alias("end"), x.hit.alias("hit"), x.context.alias("context"))).alias("out"))
    return found.withColumn(kind, F.flatten(F.transform(begins, lambda begin, b: F.aggregate(block(b), F.struct(begin.alias("at"), empty.alias("out")), step, lambda a: a.out))))


def parse(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_key and marks (array of start, kind, end, hit, context): the checked base spans, and all tokens, of each row."""
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    shapes = {**SHAPES, "token": TOKEN}
    found = found.withColumns({f"hits_{k}": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in shapes.items()})
    found = found.withColumns({f"gaps_{k}": F.when(F.size(f"hits_{k}") > 0, F.split("text", p, -1)) for k, p in shapes.items()})
    for kind in shapes:
        found = _placed(found, kind)

    def checked(number: int, kind: str) -> Column:
        good = F.filter(kind, lambda x: _passes(kind, x.hit))
        return F.transform(good, lambda x: F.struct(x.start.alias("start"), F.lit(number).alias("kind"), x.end.alias("end"), x.hit.alias("hit"), x.context.alias("context")))

    return found.select("row", "doc_id", "text_key", F.concat(*[checked(i, k) for i, k in enumerate(shapes)]).alias("marks"))


def instance(hit: Column) -> Column:
    """An instance of the graph: a digest of the value in lower case."""
    return F.md5(F.lower(hit))


def marked(parsed: DataFrame) -> DataFrame:
    """row, start, kind, end, pattern and instance of each base span, and of each token that overlaps none (kind FREE).

    A token is held against the furthest end of the base spans that begin before it or with it, and the first start of those behind it.
    """
    rows = parsed.select("row", F.inline("marks"))
    based = lambda c: F.when(F.col("kind") < FREE, F.col(c))
    left = F.max(based("end")).over(Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    right = F.min(based("start")).over(Window.partitionBy("row").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.select("row", "start", "kind", "end", F.col("context").alias("pattern"), instance(F.col("hit")).alias("instance"), left.alias("left"), right.alias("right"))
    free = (F.coalesce("left", F.lit(0)) <= F.col("start")) & (F.coalesce("right", "end") >= F.col("end"))
    return placed.filter((F.col("kind") < FREE) | free).drop("left", "right")


def learn(marks: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, accept: float = ACCEPT) -> DataFrame:
    """instance and kind of the identifiers that no fixed shape knows but the scored contexts do; of several kinds the first.

    The graph has one edge for each distinct pattern and instance; its size follows the corpus and it stays distributed. Counts
    are pre-aggregated; joins carry no grouping above them that would keep Spark from splitting a hot pattern or instance.
    What is accepted only grows from round to round, so the rounds end when its number stays.
    """
    graph = settle(marks.select("pattern", "instance", F.when(F.col("kind") < FREE, F.col("kind")).alias("kind")).distinct())
    seeded = graph.filter("kind is not null").select("instance", "kind").distinct()
    edges = settle(graph.select("pattern", "instance").distinct())
    totals = edges.groupBy("pattern").agg(F.count("*").alias("instances"))
    known, size = seeded, 0
    while True:
        hits = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("hits")).filter(F.col("hits") >= support)
        share = F.col("hits") / (F.col("instances") + 1)
        good = settle(hits.join(totals, "pattern").withColumn("share", share).filter(F.col("share") >= confidence).select("pattern", "kind", "share"))
        doubt = F.sum(F.log(1 - F.col("share")))
        likely = edges.join(good, "pattern").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score")).filter(F.col("score") >= accept).select("instance", "kind")
        learned = settle(likely.join(seeded.select("instance").distinct(), "instance", "left_anti"))
        now = learned.count()
        if now <= size:
            return learned.groupBy("instance").agg(F.min("kind").alias("kind"))
        known, size = seeded.unionAll(learned), now


def spans(parsed: DataFrame) -> DataFrame:
    """row, start, kind and end of all spans; kind counts base kinds, then the discovered ones in the same order."""
    marks = settle(marked(parsed))
    learned = learn(marks)
    found = marks.filter(F.col("kind") == FREE).select("row", "start", "end", "instance").join(learned, "instance")
    return marks.filter(F.col("kind") < FREE).select("row", "start", "kind", "end").unionAll(found.select("row", "start", F.col("kind") + len(KINDS), "end"))


def _names() -> Column:
    return F.array(*[F.lit(n) for n in (*KINDS, *[f"ctx_{k}" for k in KINDS])])


def _listed(column: str) -> Column:
    return F.concat_ws(",", F.transform(column, lambda x: F.concat_ws(":", F.get(_names(), x.kind), x.start.cast("string"), x.end.cast("string"))))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_context, base_sha256 and spans of every row.

    Whole texts; null and empty ones have no spans (the digest is that of the empty string). Repeated rows stay, a null id stays null;
    no rows in, no rows out; other columns don't matter. Spans are code points, end exclusive, by start, then kind. Discovered spans are ctx_<kind>.
    The spans of one text are one group, whatever their number.
    """
    parsed = settle(parse(docs))
    shape = F.struct("start", "kind", "end")
    listed = spans(parsed).groupBy("row").agg(F.array_sort(F.collect_list(shape)).alias("all"))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    joined = parsed.select("row", "doc_id").join(listed, "row", "left").select("doc_id", F.coalesce("all", none).alias("all"))
    joined = joined.withColumn("base", F.filter("all", lambda x: x.kind < FREE))

    def of(kind: int):
        return lambda x: x.kind == kind  # one parameter: of a second one Spark would make the index

    counts = [F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    context = (F.size("all") - F.size("base")).cast("long").alias("n_context")
    return joined.select("doc_id", *counts, context, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("all").alias("spans"))


def merged(found: DataFrame) -> DataFrame:
    """row and spots (array of start, end, kind, in order): spans that overlap are one spot, of the kind of the first."""
    order = Window.partitionBy("row").orderBy("start", "kind", "end")
    first = F.coalesce(F.col("start") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    numbered = found.withColumn("first", first).withColumn("spot", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spots = numbered.groupBy("row", "spot").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    return spots.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spots"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by [EMAIL], [IP], [CARD] or [PHONE], n_chars set anew if there is such a column; all rows stay.

    Overlapping spans become one mark, that of the first. Texts without spans, null ones included, are unchanged. Columns of any name are kept.
    """
    ident, unnamed, key, spots, blocks = (fresh(f"_pii_{n}", docs) for n in ("id", "unnamed", "text", "spots", "blocks"))

    def keys(text: Column) -> list[Column]:
        return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(ident), F.col("doc_id").isNull().alias(unnamed), text.alias(key)]

    parsed = settle(parse(docs))
    found = parsed.join(merged(spans(parsed)), "row").select(*keys(F.col("text_key")), F.col("spots").alias(spots)).dropDuplicates([ident, unnamed, key])
    joined = docs.select("*", *keys(text_key())).join(found.hint("shuffle_hash"), [ident, unnamed, key], "left")
    joined = joined.withColumn(blocks, F.when(F.col(spots).isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, *KINDS)])

    def between(begin: Column, end: Column) -> Column:
        """The text's characters from begin on, before end, from the blocks that hold them."""
        block = F.floor(begin / BLOCK).cast("int")
        held = F.array_join(F.slice(F.col(blocks), block + 1, F.floor((end - 1) / BLOCK).cast("int") - block + 1), "")
        return F.when(end > begin, F.substring(held, begin - block * BLOCK + 1, end - begin)).otherwise("")

    before = lambda i: F.when(i > 0, F.get(F.col(spots), i - 1).end).otherwise(0)
    parts = F.transform(spots, lambda x, i: F.concat(between(before(i), x.start), F.get(marks, x.kind)))
    clean = F.concat(F.array_join(parts, ""), between(before(F.size(spots)), F.char_length("text")))
    cleaned = joined.withColumn("text", F.when(F.col(spots).isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(spots).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return cleaned.select(docs.columns)
