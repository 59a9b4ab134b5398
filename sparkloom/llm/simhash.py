"""SimHash near-duplicates through vantage-point trees.

Each document gets a 64-bit fingerprint of its 3-word shingles. Distinct fingerprints are dealt
to shards by a vantage-point tree built on a bounded sample: a node holds a vantage point and a
radius, and a fingerprint goes inside or outside by its Hamming distance. By the triangle
inequality a partner within `RADIUS` bits can only stand across a boundary that is no more than
RADIUS away, so a fingerprint also visits the later shards whose region its ball overlaps. Each
shard builds its own tree over what it owns, searches it for owners and visitors, and gives
a spanning star for each group of linked fingerprints, never all pairs. Shards that own far more than planned (many near-equal
fingerprints, which no boundary parts) are cut to blocks. Stars of all shards are joined to components by repeated star contraction on Spark.

`keep_alike` uses the same trees for likeness of texts: fingerprints of the sets of single words and of word pairs, in several tables of differently mixed
hashes, propose partners; whole texts decide, by the Jaccard likeness of their sets of 5-word shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import fresh
from .common import settle, slices, text_key
from .likeness import SKETCH, WordHashes, agreeing, class_of, linked, min_max, permutations, sets_of, shingles, sketch, verified

RADIUS = 3
SHINGLE = 3
SEED = 42
SAMPLE = 1 << 16  # fingerprints that the routing tree is built on
SHARD_ROWS = 8192  # distinct fingerprints a shard is to own
DENSE = 1 << 15  # owned fingerprints beyond which a shard is cut to blocks
LEAF = 48  # fingerprints of a leaf inside a shard
TABLES = (1, 1, 1, 1, 1, 1, 2, 2)  # words of the shingles of each table's fingerprints in the search for alike texts
LIKE_SHINGLE = 5  # words of a shingle in the likeness of texts
LIKE, OF = 4, 5  # least likeness, 4/5, in whole numbers


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of each run of `shingle` words, or of all words if there are fewer; none without words."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: lower() and split() know only ASCII letters and blanks
    if not words:
        return np.array([], np.uint64)
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    span = min(shingle, len(words))
    return np.array([digest(line[starts[i] : ends[i + span - 1] - 1], SEED) for i in range(n)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed number; 0 without hashes."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return int(np.packbits(bits * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: str) -> int:
    """The 64 bits as a signed number; a bit is set if it is in over half of the shingles' hashes."""
    return majority(shingle_hashes(text))


def mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """The hashes turned into others: a bijection for each table, that of table 0 changes nothing."""
    if not table:
        return hashes
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * table & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and fp (signed 64 bits) of each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([fingerprint(t or "") for t in part.column(2).to_pylist()], pa.int64())], ["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text")).mapInArrow(run, "doc_id long, text_key long, fp long")


def hamming(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """A vantage-point tree over uint64 fingerprints in flat arrays; leaves are numbered from left to right.

    A node that would send most fingerprints to both sides becomes a leaf: splitting near-equal fingerprints gains nothing.
    """

    def __init__(self, points: np.ndarray, leaf_rows: int, leaves: int = 1 << 30, seed: int = 7):
        self.nodes: list[tuple[np.uint64, int, int, int]] = []  # vantage, radius, inside, outside; a leaf is ~number
        self.members: list[np.ndarray] = []
        self.points, self.leaf_rows, self.depth = points, leaf_rows, max(0, int(np.ceil(np.log2(leaves))))
        self.random = np.random.default_rng(seed)
        self.root = self._grow(np.arange(len(points)), 0)

    def _grow(self, own: np.ndarray, depth: int) -> int:
        if len(own) > self.leaf_rows and depth < self.depth:
            mine = self.points[own]
            best = None
            for v in mine[self.random.integers(0, len(own), 8)]:
                d = hamming(mine, v)
                r = int(np.median(d))
                inside = np.count_nonzero(d <= r)
                both = np.count_nonzero((d > r - RADIUS) & (d <= r + RADIUS))
                cost = both + 2 * abs(len(own) - 2 * inside)
                if 0 < inside < len(own) and (best is None or cost < best[0]):
                    best = (cost, v, r, both, d)
            if best and best[3] < 0.9 * len(own):
                _, v, r, _, d = best
                at = len(self.nodes)
                self.nodes.append((v, r, 0, 0))
                sides = self._grow(own[d <= r], depth + 1), self._grow(own[d > r], depth + 1)
                self.nodes[at] = (v, r, *sides)
                return at
        self.members.append(own)
        return ~(len(self.members) - 1)

    def owners(self, points: np.ndarray) -> np.ndarray:
        """The leaf in whose region each point lies."""
        out = np.zeros(len(points), np.int32)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, at = stack.pop()
            if node < 0:
                out[at] = ~node
                continue
            v, r, inside, outside = self.nodes[node]
            near = hamming(points[at], v) <= r
            stack += [(inside, at[near]), (outside, at[~near])]
        return out

    def visits(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, places of the points whose ball of RADIUS may overlap its region)."""
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if node < 0:
                yield ~node, at
                continue
            v, r, inside, outside = self.nodes[node]
            d = hamming(points[at], v).astype(np.int16)
            stack += [(inside, at[d <= r + RADIUS]), (outside, at[d > r - RADIUS])]


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The labels after groups a[k] and b[k] have become one, for all k, and those k that it takes: fewer than there were groups."""
    differ = np.flatnonzero(a != b)
    if not len(differ):
        return label, differ
    pairs, at = np.unique(np.minimum(a, b)[differ] * len(label) + np.maximum(a, b)[differ], return_index=True)
    parent: dict[int, int] = {}
    taken = []

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for pair, k in zip(pairs.tolist(), differ[at].tolist()):
        x, y = map(root, divmod(pair, len(label)))
        if x != y:
            parent[max(x, y)] = min(x, y)
            taken.append(k)
    to = np.arange(len(label))
    for x in list(parent):
        to[x] = root(x)
    return to[label], np.array(taken, np.int64)


def neighbours(own: np.ndarray, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in points, places in own, matrix of which are within RADIUS bits), in blocks, for all pairs that the tree over `own` can't rule out."""
    tree = Tree(own, LEAF)
    for leaf, at in tree.visits(points):
        members = tree.members[leaf]
        for low in range(0, len(members), 256):
            part = members[low : low + 256]
            for cut in range(0, len(at), 8192):
                some = at[cut : cut + 8192]
                yield some, part, hamming(points[some][:, None], own[part][None, :]) <= RADIUS


def stars(own: np.ndarray, visitors: np.ndarray, within: bool = True, *_) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) fingerprints of each group that links within RADIUS bits form among owners and visitors.

    Visitors link to owners only, owners to each other if `within`. A leaf's links are folded to groups at once, so nothing grows with the number of pairs.
    """
    points = np.concatenate([own, visitors])
    first = 0 if within else len(own)
    label = np.arange(len(points))
    for some, part, near in neighbours(own, points[first:]):
        i, j = np.nonzero(near)
        label, _ = merged(label, label[some[i] + first], label[part[j]])
    signed = points.view(np.int64)
    lead = np.full(len(points), np.iinfo(np.int64).max)
    np.minimum.at(lead, label, signed)
    linked = lead[label] != signed
    return signed[linked], lead[label][linked]


def partners(own: np.ndarray, visitors: np.ndarray, within: bool, mine: pd.DataFrame, theirs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) fingerprints within RADIUS bits whose `size` allows the likeness: for each owner and visitor the partners that are next below and next above it by size.

    Two partners for a point, however many it has, so the pairs of a large family grow with its size. A point with more than one on a side, or one that is or meets a fingerprint of
    several classes (`many`), is marked by the pair (a, a): `left_in_crowds` looks at all its partners.
    """
    points, size, many = np.concatenate([own, visitors]), *(np.concatenate([mine[c].to_numpy(), theirs[c].to_numpy()]) for c in ("size", "many"))
    order = np.lexsort((mixed(points, 1), size))
    rank = np.empty(len(points), np.int64)
    rank[order] = np.arange(len(points))
    first = 0 if within else len(own)
    below, above, met_by, crowd = np.full(len(points), -1), np.full(len(points), len(points)), np.zeros((2, len(points)), np.int64), many.copy()
    for some, part, near in neighbours(own, points[first:]):
        some = some + first
        a, b, loose = size[some][:, None], size[part][None, :], many[some][:, None] | many[part][None, :]
        near &= loose | (OF * np.minimum(a, b) >= LIKE * np.maximum(a, b))
        left, right = rank[some], rank[part]
        near &= left[:, None] != right[None, :]
        for here, there, met, beside, where in ((left, right, near, many[part], some), (right, left, near.T, many[some], part)):
            at = np.flatnonzero(met.any(1))
            less = there[None, :] < here[at, None]
            np.maximum.at(below, here[at], np.where(met[at] & less, there[None, :], -1).max(1, initial=-1))
            np.minimum.at(above, here[at], np.where(met[at] & ~less, there[None, :], len(points)).min(1, initial=len(points)))
            crowd[where[at]] |= (met[at] & beside[None, :]).any(1)
        for k, side in enumerate((near & (right[None, :] < left[:, None]), near & (right[None, :] > left[:, None]))):
            met_by[k, some] += side.sum(1)
            met_by[1 - k, part] += side[some >= len(own)].sum(0)  # owners that search as well have met each other from both sides
    crowd |= (met_by > 1).any(0)
    low, high = np.flatnonzero(below >= 0), np.flatnonzero(above < len(points))
    ranked, signed = points[order].view(np.int64), points.view(np.int64)
    return np.concatenate([ranked[low], ranked[high], signed[crowd]]), np.concatenate([ranked[below[low]], ranked[above[high]], signed[crowd]])


def strangers(own: np.ndarray, visitors: np.ndarray, within: bool, mine: pd.DataFrame, theirs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) classes (`name`) of pairs of points within RADIUS bits that are of different groups (`root`) and whose sizes and sketches allow the likeness.

    As many as it takes to join the groups that all such pairs join, so fewer than the points.
    """
    points, name, size, root = np.concatenate([own, visitors]), *(np.concatenate([mine[c].to_numpy(np.int64), theirs[c].to_numpy(np.int64)]) for c in ("name", "size", "root"))
    sketches = np.frombuffer(b"".join([*mine["sketch"], *theirs["sketch"]]), np.uint8).reshape(len(points), -1)
    label = np.unique(root, return_inverse=True)[1]
    first, found = 0 if within else len(own), [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for some, part, near in neighbours(own, points[first:]):
        some = some + first
        for at in range(0, len(some), 512):  # looks at the groups as they are when it comes to a block
            block = some[at : at + 512]
            i, j = np.nonzero(near[at : at + 512] & (label[block][:, None] != label[part][None, :]))
            i, j = block[i], part[j]
            fits = OF * np.minimum(size[i], size[j]) >= LIKE * np.maximum(size[i], size[j])
            i, j = i[fits], j[fits]
            good = agreeing(sketches, i, j)
            i, j = i[good], j[good]
            label, taken = merged(label, label[i], label[j])
            found.append((name[i[taken]], name[j[taken]]))
    return tuple(map(np.concatenate, zip(*found)))


INDEXED, ASKING = 1, 2  # what a fingerprint is in a group: others search it, it searches others


def search_shards(fps: DataFrame, search=stars, shard_rows: int = SHARD_ROWS, dense: int = DENSE) -> DataFrame:
    """tab, a and b: what `search` gives for the shards of the rows (tab, fp, and what else it needs); each table is searched for itself.

    Rows are distinct by tab and fp, or by tab, fp and name. The driver sees a sample of SAMPLE fingerprints a table at most, an eighth of them on small inputs, the routing trees made of it, and
    the shards that own more than `dense`: no more than the trees have leaves. A shard of B times as many is cut to B blocks of owners, and
    those that search it to B parts, so a group stays near `dense` owners; each pair of fingerprints meets in one group only.
    """
    spark = fps.sparkSession
    sizes = {r.tab: r.n for r in fps.groupBy("tab").agg(F.count("*").alias("n")).collect()}
    largest = max(sizes.values(), default=0)
    part = min(0.125, SAMPLE / max(1, largest))
    taken = fps.select("tab", "fp").filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 24)) < int(part * (1 << 24))).limit(2 * SAMPLE * max(1, len(sizes))).toPandas() if largest > shard_rows else None
    trees = {}
    for tab, n in sizes.items():
        shards = -(-n // shard_rows)
        sample = taken["fp"][taken["tab"] == tab] if shards > 1 else []
        seeds = np.sort(np.asarray(sample, np.int64)).view(np.uint64)
        trees[tab] = Tree(seeds, max(1, len(seeds) // (2 * shards)), shards)
    routers = spark.sparkContext.broadcast(trees)

    def owned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tab, rows in pdf.groupby("tab"):
                leaf, n = np.unique(routers.value[tab].owners(rows["fp"].to_numpy(np.int64).view(np.uint64)), return_counts=True)
                yield pd.DataFrame({"tab": tab, "leaf": leaf, "n": n})

    crowded = {}
    if largest > dense:
        counts = fps.select("tab", "fp").mapInPandas(owned, "tab int, leaf int, n long").groupBy("tab", "leaf").agg(F.sum("n").alias("n")).filter(F.col("n") > dense)
        crowded = {(r.tab, r.leaf): -(-r.n // dense) for r in counts.collect()}
    spread_by = "name" if "name" in fps.columns else "fp"

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tab, rows in pdf.groupby("tab"):
                points, spread = rows["fp"].to_numpy(np.int64).view(np.uint64), mixed(rows[spread_by].to_numpy(np.int64).view(np.uint64), 2)
                own = routers.value[tab].owners(points)
                for leaf, at in routers.value[tab].visits(points):
                    at = at[own[at] <= leaf]  # a pair across shards meets in the later one
                    mine, many = own[at] == leaf, crowded.get((tab, leaf), 1)
                    block, piece = ((x % np.uint64(many)).astype(int) for x in (spread[at], spread[at] // np.uint64(many)))
                    # as one that searches: in all blocks of owners, an owner in those before its own; as an owner: in all parts of its own block, searching in the first
                    times = np.where(mine, block, many)
                    asks, holds = np.repeat(np.arange(len(at)), times), np.repeat(np.flatnonzero(mine), many)
                    blocks = np.arange(len(asks)) - np.repeat(np.cumsum(times) - times, times)
                    parts = np.arange(len(holds)) % many
                    roles = np.concatenate([np.full(len(asks), ASKING), np.where(parts == 0, INDEXED | ASKING, INDEXED)])
                    out = rows.iloc[at[np.concatenate([asks, holds])]]
                    yield out.assign(leaf=leaf, block=np.concatenate([blocks, block[holds]]), part=np.concatenate([piece[asks], parts]), role=roles)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp")
        points, role = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["role"].to_numpy()
        own = role & INDEXED > 0
        a, b = search(points[own], points[~own], bool((role[own] & ASKING).any()), pdf[own], pdf[~own])
        return pd.DataFrame({"tab": pdf["tab"].iloc[0], "a": a, "b": b})

    schema = ", ".join(f"{n} {t}" for n, t in fps.dtypes)
    dealt = fps.mapInPandas(deal, f"{schema}, leaf int, block int, part int, role int")
    return dealt.groupBy("tab", "leaf", "block", "part").applyInPandas(run, "tab int, a long, b long")


def links(fps: DataFrame, shard_rows: int = SHARD_ROWS, dense: int = DENSE) -> DataFrame:
    """Edges (a, b), b < a, whose components are those of all links among the distinct fingerprints `fps.fp`."""
    return search_shards(fps.select(F.lit(0).alias("tab"), "fp"), stars, shard_rows, dense).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of each node of the edges (a, b), which is stated as well.

    Alternating large-star and small-star steps until nothing moves; each step is written to the shared folder.
    Nodes of any degree are spread: minima are pre-aggregated and the joins are such as Spark can split.
    """

    def directed(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        both = directed(e)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        return both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("low"))
        moved = e.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
        return moved.unionAll(low.select("a", F.col("low").alias("b"))).distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = state(now)
    while was[0]:
        now = settle(small(large(now)))
        new = state(now)
        if new == was:
            break
        was = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def group(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, text_key, fp and component_id of every row.

    component_id is the smallest doc_id that links of RADIUS bits or fewer reach, the row's own included; it is null
    where no row of the group has an id. Equal fingerprints are one node, so exact copies cost nothing in the search.
    Texts without words have fingerprint 0, which links like any other. No rows in, no rows out.
    """
    fps = settle(fingerprints(docs))
    nodes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), shard_rows))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = settle(named.join(ids, "root").select("fp", "component_id"))
    return fps.join(by_fp, "fp").select("doc_id", "text_key", "fp", "component_id")


def near_duplicates(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of every row; see `group`."""
    return group(docs, shard_rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, with all columns of docs: the one with the smallest id, of equal ids the one whose text hashes lowest.

    Groups without ids keep one row for each fingerprint.
    """
    return keep_rows(docs, settle(group(docs)))


def keep_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents that `keep_one` keeps, from the doc_id, text_key, fp and component_id of every row."""
    ident, unnamed, key = KEY = [fresh(f"_kept_{n}", docs) for n in ("id", "unnamed", "text")]

    def keys(text) -> list:
        """The id in two columns without nulls, so that join and deduplication share one shuffle."""
        return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(ident), F.col("doc_id").isNull().alias(unnamed), text.alias(key)]

    named = rows.filter("component_id is not null and doc_id = component_id").groupBy("doc_id").agg(F.min("text_key").alias("text_key"))
    nameless = rows.filter("component_id is null").groupBy("fp").agg(F.min("text_key").alias("text_key")).select(F.lit(None).cast("long").alias("doc_id"), "text_key")
    kept = named.unionAll(nameless).select(*keys(F.col("text_key")))
    one = docs.select("*", *keys(text_key())).join(kept.hint("shuffle_hash"), KEY, "left_semi")
    return one.dropDuplicates(KEY).select(docs.columns)


def word_prints(docs: DataFrame, tables: tuple[int, ...] = TABLES) -> DataFrame:
    """doc_id, text_key, class (a name of the text's set of 5-word shingles), size and sketch of that set, and prints: for each table a fingerprint of the set of words or word pairs."""
    factors, summands = permutations(SKETCH // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for piece in slices(batch, 200):
                names, sizes, sketches, prints = [], [], [], []
                for text in piece.column(2).to_pylist():
                    found, few = shingles(text or "", LIKE_SHINGLE, known), {n: shingles(text or "", n, known) for n in set(tables)}
                    names.append(class_of(found))
                    sizes.append(len(found))
                    sketches.append(sketch(min_max(found, factors, summands)))
                    prints.append([majority(mixed(few[n], t)) for t, n in enumerate(tables)])
                arrays = [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(prints, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *arrays], ["doc_id", "text_key", "class", "size", "sketch", "prints"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return texts.mapInArrow(run, "doc_id long, text_key long, class long, size long, sketch binary, prints array<bigint>")


def proposed(printed: DataFrame, shard_rows: int = SHARD_ROWS, dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """(pairs, crowds): pairs (a, b) of classes whose fingerprints are equal or near in a table and whose sizes allow the likeness; and the (tab, fp) that have more partners.

    printed: class, size, tab, fp. Of the classes of one fingerprint each meets the least; fingerprints meet by their least classes, two partners each. So pairs grow with the number
    of classes. Every pair that this leaves out is of two classes whose fingerprints are both among the crowds.
    """
    fps = settle(printed.groupBy("tab", "fp").agg(F.count("*").alias("n"), F.min(F.struct("class", "size")).alias("lead")))
    equal = printed.join(fps.filter("n > 1"), ["tab", "fp"]).select(F.struct("class", "size").alias("x"), F.col("lead").alias("y"))
    near = settle(search_shards(fps.select("tab", "fp", F.col("lead.size").alias("size"), (F.col("n") > 1).alias("many")), partners, shard_rows, dense).distinct())
    left, right = fps.select("tab", F.col("fp").alias("a"), F.col("lead").alias("x")), fps.select("tab", F.col("fp").alias("b"), F.col("lead").alias("y"))
    met = near.filter("a <> b").select("tab", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = equal.unionAll(met.join(left, ["tab", "a"]).join(right, ["tab", "b"]).select("x", "y")).filter("x.class <> y.class")
    fits = OF * F.least("x.size", "y.size") >= LIKE * F.greatest("x.size", "y.size")
    return pairs.filter(fits).select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct(), near.filter("a = b").select("tab", F.col("a").alias("fp")).distinct()


def left_in_crowds(printed: DataFrame, crowds: DataFrame, classes: DataFrame, roots: DataFrame, shard_rows: int = SHARD_ROWS, dense: int = DENSE) -> DataFrame:
    """bucket, class, size and root (the group so far) of the classes in crowds that may be alike to one of another group, as `linked` takes them.

    The trees are searched again over the crowds' classes alone. Pairs that are near in a table, of different groups, and not ruled out by sizes and sketches of 5-word shingles are
    looked at inside the shards; a shard gives fewer of them than it has groups. A bucket is what these pairs connect, so both ends of each such pair are in one.
    """
    inside = printed.join(crowds, ["tab", "fp"], "left_semi")
    named = inside.join(roots, inside["class"] == roots.node, "left").select("tab", "fp", "class", "size", F.coalesce("root", "class").alias("root"))
    points = settle(named.join(classes.select("class", "sketch"), "class").select("tab", "fp", F.col("class").alias("name"), "size", "root", "sketch"))
    agreed = search_shards(points, strangers, shard_rows, dense).select("a", "b")
    members = settle(points.select(F.col("name").alias("class"), "size", "root").distinct())
    buckets = components(agreed.unionAll(members.select("root", "class")))
    placed = members.join(buckets.select(F.col("node").alias("class"), F.col("root").alias("bucket")), "class", "left").withColumn("bucket", F.coalesce("bucket", "class"))
    several = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    return placed.join(several, "bucket").select("bucket", "class", "size", "root")


def alike_groups(docs: DataFrame, tables: tuple[int, ...] = TABLES, shard_rows: int = SHARD_ROWS, dense: int = DENSE) -> DataFrame:
    """doc_id, text_key, fp (the class) and component_id of every row, as in `group`, for texts whose likeness is 0.8 or more.

    Likeness is the Jaccard likeness of the sets of 5-word shingles (fewer words: the whole sequence; texts without words are alike). Texts of one set
    are one class, so copies cost nothing. Every link is verified on whole sets, so no text is joined to one that isn't alike. A few partners of each text are verified first; where it has
    more, the whole sets of all those that may be alike and are of other groups meet in a second round. A link can be missed when the fingerprints of its texts lie over RADIUS bits apart in every table, or if fewer than
    CUT of two sketches' bytes agree (seven deviations off at the bound). The README states how many are found.
    """
    rows = settle(word_prints(docs, tables))
    nodes = settle(rows.groupBy("class").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("prints").alias("prints")))
    printed, slim = nodes.select("class", "size", F.posexplode("prints").alias("tab", "fp")), rows.select("doc_id", "text_key", "class")
    pairs, crowds = proposed(printed, shard_rows, dense)
    near = verified(pairs, docs, slim, LIKE_SHINGLE, LIKE, OF)
    crowded = settle(left_in_crowds(printed, crowds, nodes, components(near), shard_rows, dense))
    sets = sets_of(docs, slim, crowded.select("class"), LIKE_SHINGLE)
    roots = components(near.unionAll(linked(crowded, sets, LIKE, OF)))
    named = nodes.join(roots, nodes["class"] == roots.node, "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = settle(named.join(ids, "root").select("class", "component_id"))
    return slim.join(by_class, "class").select("doc_id", "text_key", F.col("class").alias("fp"), "component_id")


def keep_alike(docs: DataFrame, tables: tuple[int, ...] = TABLES) -> DataFrame:
    """One document of each group of alike texts, with all columns of docs; which one as in `keep_one`. Null texts are empty; no rows in, no rows out."""
    return keep_rows(docs, settle(alike_groups(docs, tables)))
