"""SimHash fingerprints and exact near pairs from a forest of vantage-point trees.

A link is a pair of fingerprints that differ in at most `radius` of 64 bits. The bits are split into PARTS parts; two linked fingerprints differ in at most radius // parts bits of at least one part (with three parts and radius 4: one bit of 21 or 22). Hamming distance on a part obeys the triangle inequality, so each part has a vantage-point tree: an inner node holds a vantage code and a distance, codes up to that distance go left, others right, and a search skips a branch where the triangle bounds exclude it. Trees grow until a leaf holds about LEAF fingerprints or codes can't be told apart; there is no bound on depth. Their upper nodes, down to about SHARD fingerprints, are grown on the driver; the nodes below in the task that holds the shard.

Each fingerprint lives in one shard a tree. A linked pair parts at one node, where the left one is near enough to the boundary: so only fingerprints on the left within the radius of a boundary are copied to the right branch, and from there on to every shard that their search reaches. A fingerprint's ball has 1 + 22 codes, so it has at most so many copies a tree, however many shards there are.

The upper nodes come from a bounded sample of the distinct fingerprints (SAMPLE), which decides only how evenly shards are filled; every fingerprint is indexed and no pair is lost. A shard's task grows the tree on over all rows that live there, first by the part's codes, then by whole fingerprints where a dense group shares a code, and compares what meets in its leaves. A shard with more homes or copies than TILE is split into a grid of tiles by salts, on both sides. Equal fingerprints are one entry, so a group of copies costs one. Within a tile links become a spanning forest before they leave the task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import SPACE, documents, forest, id_type, small_batches, string_parts, unused, word_spans, written
from foliant.llm.components import components

SHINGLE, SEED, RADIUS, PARTS = 4, 42, 4, 3
#: Fingerprints that the upper nodes are grown from at most, how many a shard is to hold, and how many a leaf.
SAMPLE, SHARD, LEAF = 1 << 16, 4096, 256
#: Homes and copies of a shard that meet in one task at most.
TILE = 1 << 16


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: How many of the 8 bits of each byte value are set, by place.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer spans go to the library.
_MOST_BYTES = 256


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _round(v: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(v + lane * _P2, 31) * _P1


def xxh64_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each span of bytes, many at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(padded) - 7, "<u8", padded.data, strides=(1,))
    halves = np.ndarray(len(padded) - 3, "<u4", padded.data, strides=(1,))
    found = np.empty(len(begin), np.uint64)
    for at in range(0, len(begin), 1 << 14):
        b = begin[at : at + (1 << 14)]
        n = end[at : at + (1 << 14)] - b
        h = np.full(len(b), np.uint64(seed) + _P5)
        long = np.flatnonzero((n >= 32) & (n <= _MOST_BYTES))
        if len(long):
            own, stripes = b[long], n[long] >> 5
            v = [np.full(len(long), x) for x in (np.uint64((seed + int(_P1) + int(_P2)) % (1 << 64)), np.uint64((seed + int(_P2)) % (1 << 64)), np.uint64(seed), np.uint64((seed - int(_P1)) % (1 << 64)))]
            for i in range(int(stripes.max())):
                on = np.flatnonzero(stripes > i)
                for j in range(4):
                    v[j][on] = _round(v[j][on], lanes[own[on] + (32 * i + 8 * j)])
            x = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for j in range(4):
                x = (x ^ _round(np.zeros(len(long), np.uint64), v[j])) * _P1 + _P4
            h[long] = x
        h += n.astype(np.uint64)
        rest = np.where(n <= _MOST_BYTES, n & 31, 0)
        p = b + np.where(n <= _MOST_BYTES, n - rest, 0)
        for i in range(3):
            on = np.flatnonzero(rest >= 8 * (i + 1))
            if len(on):
                h[on] = _turn(h[on] ^ _round(np.zeros(len(on), np.uint64), lanes[p[on] + 8 * i]), 27) * _P1 + _P4
        p += rest & ~7
        on = np.flatnonzero(rest & 4)
        h[on] = _turn(h[on] ^ halves[p[on]].astype(np.uint64) * _P1, 23) * _P2 + _P3
        p += rest & 4
        for i in range(3):
            on = np.flatnonzero((rest & 3) > i)
            h[on] = _turn(h[on] ^ padded[p[on] + i].astype(np.uint64) * _P5, 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(n > _MOST_BYTES).tolist():
            h[i] = xxhash.xxh64_intdigest(data[int(b[i]) : int(b[i]) + int(n[i])].tobytes(), seed)
        found[at : at + (1 << 14)] = h
    return found


def fingerprints(array: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of each text: A-Z lower-cased, words parted by \\x20 and \\x09-\\x0D, XXH64 of each run of `shingle` words joined by a space (all words where there are fewer), a bit set where over half of the hashes have it. No words: 0."""
    data, starts = string_parts(array)
    begin, end, before = word_spans(data, starts, SPACE)
    found = np.zeros(len(starts) - 1, np.uint64)
    if not len(begin):
        return found
    # all words in a row, each with one space behind it
    sizes = end - begin
    stop = np.cumsum(sizes + 1)
    first, last = stop - sizes - 1, stop - 1
    joined = np.full(int(stop[-1]), 32, np.uint8)
    place = np.arange(int(sizes.sum()))
    word = np.repeat(np.arange(len(sizes)), sizes)
    joined[place + word] = _LOWER[data[place + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)]]
    words = np.diff(before)
    n = np.where(words > 0, np.maximum(1, words - shingle + 1), 0)
    text = np.repeat(np.arange(len(n)), n)
    head = before[:-1][text] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    hashes = xxh64_spans(joined, first[head], last[np.minimum(head + shingle, before[1:][text]) - 1], seed)
    each = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ends = np.cumsum(n)
    for i in np.flatnonzero(n).tolist():
        own = each[ends[i] - n[i] : ends[i]]
        ones = np.concatenate([np.bincount(own[:, k], minlength=256) @ _BITS for k in range(8)])
        found[i] = np.packbits(2 * ones > n[i], bitorder="little").view("<u8")[0]
    return found


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches):
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)).view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, fp long")


class Tree:
    """A vantage-point tree over codes; a leaf has at most `leaf` of them, or codes that no vantage tells apart."""

    def __init__(self, codes: np.ndarray, leaf: float, radius: int):
        self.radius = radius
        self.nodes: list[tuple[int, int, int, int]] = []  # vantage code, distance that still goes left, left, right; children below 0 are leaves
        self.leaves = 0
        self.root = 0
        open_: list[tuple[np.ndarray, int, int]] = [(codes, -1, 0)]  # codes, the node above, and which of its children this is
        while open_:
            some, above, side = open_.pop()
            best = self._split(some) if len(some) > leaf else None
            if best is None:
                self.leaves += 1
                at = -self.leaves
            else:
                at = len(self.nodes)
                self.nodes.append((*best, 0, 0))
                near = np.bitwise_count(some ^ np.uint64(best[0])) <= best[1]
                open_ += [(some[near], at, 2), (some[~near], at, 3)]
            if above < 0:
                self.root = at
            else:
                node = list(self.nodes[above])
                node[side] = at
                self.nodes[above] = tuple(node)

    def _split(self, codes: np.ndarray) -> tuple[int, int] | None:
        """The vantage and distance with the least work below: rows of the larger side and those that are copied."""
        best = None
        for vantage in np.unique(codes[np.linspace(0, len(codes) - 1, 12).astype(int)]).tolist():
            upto = np.cumsum(np.bincount(np.bitwise_count(codes ^ np.uint64(vantage)), minlength=65))
            mu = np.flatnonzero((upto > 0) & (upto < len(codes)))
            if len(mu):
                copied = upto[mu] - np.where(mu >= self.radius, upto[np.maximum(0, mu - self.radius)], 0)
                cost = np.maximum(upto[mu], len(codes) - upto[mu]) + copied
                i = int(np.argmin(cost))
                if best is None or cost[i] < best[0]:
                    best = int(cost[i]), vantage, int(mu[i])
        return best and best[1:]

    def search(self, codes: np.ndarray, lives: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which code reaches which leaf (from 0), and whether it lives there. lives: codes that are in the tree (all, unless given); the others are only searched for. Any two codes within the radius, one of them in the tree, meet in a leaf where at least one lives."""
        rows, leaves, homes = [], [], []
        open_ = [(self.root, np.arange(len(codes)), np.ones(len(codes), bool) if lives is None else lives)]
        while open_:
            node, some, home = open_.pop()
            if not len(some):
                continue
            if node < 0:
                rows.append(some)
                leaves.append(np.full(len(some), -node - 1))
                homes.append(home)
                continue
            vantage, mu, left, right = self.nodes[node]
            far = np.bitwise_count(codes[some] ^ np.uint64(vantage)).astype(np.int64)
            # one that lives here goes to its own side, and as a copy from the left to the right; a copy goes wherever its ball reaches
            to_left = np.where(home, far <= mu, far - self.radius <= mu)
            to_right = far + self.radius > mu
            open_ += [(left, some[to_left], home[to_left]), (right, some[to_right], (home & (far > mu))[to_right])]
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)


class Forest:
    """A tree for each part of the bits."""

    def __init__(self, sample: np.ndarray, total: int, radius: int = RADIUS, parts: int = PARTS):
        self.radius, self.parts = radius, parts
        self.cuts = [64 * p // parts for p in range(parts + 1)]
        of_sample = max(4.0, SHARD * len(sample) / max(1, total))  # what a shard holds of the sample
        self.trees = [Tree(self.codes(sample, p), of_sample, radius // parts) for p in range(parts)]

    def codes(self, fps: np.ndarray, part: int) -> np.ndarray:
        low, high = self.cuts[part], self.cuts[part + 1]
        return fps.view(np.uint64) >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)

    def search(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which fingerprint reaches which shard, and whether it lives there."""
        found = []
        for p, tree in enumerate(self.trees):
            row, leaf, home = tree.search(self.codes(fps, p))
            found.append((row, leaf * self.parts + p, home))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _meet(fps: np.ndarray, home: np.ndarray, radius: int):
    """Blocks of places of fingerprints within radius, one of which lives here."""
    own = np.flatnonzero(home)
    step = max(1, (1 << 20) // max(1, len(own)))
    for a in range(0, len(fps), step):
        far = np.bitwise_count(fps[a : a + step, None] ^ fps[own][None, :])
        i, j = np.nonzero(far <= radius)
        i, j = i + a, own[j]
        keep = (i > j) | ~home[i]
        yield i[keep], j[keep]


def near_pairs(fps: np.ndarray, home: np.ndarray, codes: np.ndarray, code_radius: int, radius: int):
    """Blocks of places of fingerprints within radius, at least one of which lives here (home): a tree over the codes, then over whole fingerprints, leads to the pairs."""

    def below(some: np.ndarray, lives: np.ndarray, by: np.ndarray, reach: int, rest: bool):
        if lives.sum() <= LEAF or not len(some):
            for i, j in _meet(fps[some], lives, radius):
                yield some[i], some[j]
            return
        tree = Tree(by[some[lives]], LEAF, reach)
        row, at, own = tree.search(by[some], lives)
        order = np.argsort(at, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            if not own[part].any():
                continue
            if rest:
                yield from below(some[row[part]], own[part], fps, radius, False)
            else:
                for i, j in _meet(fps[some[row[part]]], own[part], radius):
                    yield some[row[part]][i], some[row[part]][j]

    yield from below(np.arange(len(fps)), home, codes, code_radius, True)


def links(distinct: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """Links u, v that connect just what the pairs of different fingerprints within radius connect. distinct: a written table with fp, each once."""
    total = distinct.count()
    drawn = distinct.select("fp", F.xxhash64("fp").alias("h")).orderBy("h", "fp").limit(SAMPLE).toArrow()  # SAMPLE longs
    trees = Forest(drawn.column("fp").to_numpy(), total, radius, parts)
    tile = TILE

    def places(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(fps), 4096):
                row, shard, home = trees.search(fps[a : a + 4096])
                yield pa.RecordBatch.from_pydict({"fp": fps[a : a + 4096][row], "shard": shard, "home": home})

    placed = distinct.select("fp").mapInArrow(places, "fp long, shard long, home boolean")
    # shards that need a grid: at most a few for each TILE rows, and no more than the sample's leaves
    sizes = placed.groupBy("shard").agg(F.count_if("home").alias("homes"), F.count("*").alias("n")).where(F.col("n") > tile).collect()
    grid = {r["shard"]: (-(-r["homes"] // tile), -(-r["n"] // tile)) for r in sizes}

    def deal(batches):
        """Rows with the tile where they meet: x of the homes, y of all that compare with them."""
        names = np.array(sorted(grid), np.int64)
        wide = np.array([grid[k] for k in names.tolist()], np.int64).reshape(-1, 2)
        for batch in places(batches):
            fp, shard, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            at = np.minimum(np.searchsorted(names, shard), max(0, len(names) - 1))
            hot = names[at] == shard if len(names) else np.zeros(len(shard), bool)
            # role 2: lives here and is compared, 1: lives here, 0: is compared
            out = [(fp[~hot], shard[~hot], np.zeros((~hot).sum(), np.int64), np.where(home[~hot], 2, 0))]
            for own_role, some in ((1, np.flatnonzero(hot & home)), (0, np.flatnonzero(hot))):
                x, y = wide[at[some], 0], wide[at[some], 1]
                salt = (fp[some].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                n = y if own_role else x
                to = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                fixed = np.repeat(salt % (x if own_role else y), n)
                cell = fixed * np.repeat(y, n) + to if own_role else to * np.repeat(y, n) + fixed
                out.append((np.repeat(fp[some], n), np.repeat(shard[some], n), cell, np.full(len(cell), own_role)))
            fp, shard, cell, role = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_pydict({"fp": fp, "shard": shard, "tile": cell.astype(np.int32), "role": role.astype(np.int8)})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["shard"].iloc[0]) % parts
        fps, role = pdf["fp"].to_numpy().view(np.uint64), pdf["role"].to_numpy()
        names = np.unique(fps)
        place = np.searchsorted(names, fps)
        pu, pv = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j in near_pairs(fps, role > 0, trees.codes(fps, part), radius // parts, radius):
            i, j = place[i], place[j]
            pu, pv = np.concatenate([pu, i[i != j]]), np.concatenate([pv, j[i != j]])
            if len(pu) > 1 << 20:
                pu, pv = _tree(len(names), pu, pv)
        pu, pv = _tree(len(names), pu, pv)
        return pd.DataFrame({"u": names[pu].view(np.int64), "v": names[pv].view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "fp long, shard long, tile int, role byte")
    return dealt.groupBy("shard", "tile").applyInPandas(search, "u long, v long")


def _tree(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = forest(n, u, v)
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest doc_id of all rows that links lead to) for each row of docs (doc_id, text).

    Null and empty texts and texts without words have fingerprint zero and are linked like any other. Rows alike in doc_id are told apart by nothing: they have the same component where their texts link. A null doc_id is no component's id unless all its rows have none. Empty tables give no rows, other columns are ignored."""
    table = written(fingerprint_table(docs), "fingerprints")
    distinct = written(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius, parts))
    joined = written(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    # tables on both sides of these joins, so that Spark can split a large group's rows
    least = written(joined.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = written(joined.join(least, "root").select("fp", "component_id"), "named")
    return table.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each group: the one whose id is the component's. Rows that are alike in doc_id and text are one document; of rows that share the least id the one with the smallest text stays."""
    columns = docs.columns
    key, number, own_id, own_key = unused(docs, "key", "number", "own_id", "own_key")
    table = written(docs.select("doc_id", "text").mapInArrow(_with_fp, f"doc_id {id_type(docs)}, text string, fp long").select("doc_id", "fp", F.xxhash64("text").alias("t")), "fingerprints")
    distinct = written(table.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("least")), "distinct")
    roots = components(links(distinct.select("fp")))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("least", F.coalesce("root", "fp").alias("root"))
    stays = joined.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias(own_id), F.col("least.t").alias(own_key))
    kept = docs.withColumn(key, F.xxhash64("text"))
    kept = kept.join(stays, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key)), "left_semi")
    if table.groupBy("doc_id", "t").count().where("count > 1").limit(1).count():
        kept = kept.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(key))).where(F.col(number) == 1)
    return kept.select(*columns)


def _with_fp(batches):
    for batch in small_batches(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fingerprints(batch.column(1)).view(np.int64))], names=["doc_id", "text", "fp"])


def op3_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(documents(spark, sf_dir))


QUERIES = {"op3_vantage_simhash": op3_vantage_simhash}
SQL: dict[str, str] = {}
