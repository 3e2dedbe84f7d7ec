"""N-gram Jaccard join (operator 5): a MinHash LSH forest, then exact counts.

1. Each text becomes a set of hashed word shingles; equal sets become one.
2. Per tree of the forest a set has a path of min-hashes.  Matched prefixes have the
   length at which two sets exactly at the threshold meet with the target recall:
   it follows from the threshold alone, whatever the sets are.
3. The paths of all trees are sorted (range partitions, so no node of a trie lands
   in one task), which is the tries' own order: a node is a run of paths with a
   common prefix, and a set's longest matches stand next to it.  Each set is first
   tied to its predecessor.  Ties are checked on sketches, and connected components
   of them are families.
4. Then every set looks up its whole run: in runs that hold more than one family,
   all sets of different families are compared on sketches, and families that meet
   are joined.  Long runs are cut by size (a link bounds the ratio of sizes), and
   beyond that into a grid of cells of bounded size, none of which is skipped.
5. In a family all sets that can be linked are compared exactly, in blocks.  A
   block gives each set its number of links and its component in the block; two
   blocks that meet give numbers of links, and a forest between components,
   never a list of pairs.
6. Components of the linked sets are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.llm.common import materialize, need, release, row_key, skewed_join, slices
from docskein.llm.components import components

WORDS = 5
TREES = 32
MAX_DEPTH = 12
LONGER = 2  # levels of a path beyond those that the target recall asks for
SKETCH = 256
SAMPLE = 256  # sets that are compared with all others where recall is measured
CELL = 1024  # rows of a run that one cell holds of a side
BLOCK_SETS, BLOCK_BYTES = 1024, 16 << 20
BROADCAST_ROWS = 500_000  # keys of 16 bytes: at most some 20 MB in a task
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
        return x ^ (x >> np.uint64(31))


def _odd(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)


STEPS = _odd(11, 64)  # one factor per word of a shingle
PERMUTATIONS = _odd(23, MAX_DEPTH * TREES)  # one for each depth and tree
CELLS = 1 << 15  # hashes made at a time: 256 KB, within a core's cache


def recall(depth: int, trees: int, similarity: float) -> float:
    """Chance that two sets of this similarity share a prefix in some tree."""
    return 1.0 - (1.0 - similarity**depth) ** trees


def shortened_depth(similarity: float, target: float, trees: int = TREES, start: int = MAX_DEPTH) -> int:
    """Prefixes from full depth, shortened until the target recall is reached."""
    depth = start
    while depth > 1 and recall(depth, trees, similarity) < target:
        depth -= 1
    return depth


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.  Words are what white space
    parts, lower-cased.  A text of fewer words is one shingle of them all; a
    text without words has none."""
    split = [(t or "").lower().split() for t in texts]
    flat = np.array(list(chain.from_iterable(split)), dtype=object)
    hashed = pd.util.hash_array(flat, categorize=True) if len(flat) else np.zeros(0, np.uint64)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for s in split:
            w, at = hashed[at : at + len(s)], at + len(s)
            k = min(words, len(w))
            if not k:
                out.append(np.zeros(0, np.uint64))
                continue
            n = len(w) - k + 1
            total = np.full(n, np.uint64(k))
            for i in range(k):
                total = total + mix(w[i : i + n] * STEPS[i])
            out.append(np.unique(mix(total)))
    return out


def signature(s: np.ndarray, levels: int = MAX_DEPTH) -> np.ndarray:
    """[level, tree] min-hashes, each under a permutation of its own: two sets
    share one with probability equal to their Jaccard similarity, and the trees
    are independent however small the sets."""
    factors = PERMUTATIONS[: levels * TREES]
    out = np.full(len(factors), np.iinfo(np.uint64).max)
    for first in range(0, len(s), CELLS):
        part = s[first : first + CELLS]
        rows = CELLS // len(part)
        for r in range(0, len(out), rows):
            with np.errstate(over="ignore"):
                h = factors[r : r + rows, None] * part
                h = (h ^ (h >> np.uint64(29))) * MIX1
            out[r : r + rows] = np.minimum(out[r : r + rows], h.min(axis=1))
    return out.reshape(levels, TREES)


def tree_paths(sig: np.ndarray) -> bytes:
    """Per tree its number (a byte) and its min-hashes (two bytes each)."""
    levels = len(sig)
    out = np.empty((TREES, 1 + 2 * levels), dtype=np.uint8)
    out[:, 0] = np.arange(TREES)
    out[:, 1:] = np.ascontiguousarray((sig.T >> np.uint64(16)).astype("<u2")).view(np.uint8)
    return out.tobytes()


def sketch(sig: np.ndarray) -> bytes:
    return (sig.ravel()[:SKETCH] & np.uint64(255)).astype(np.uint8).tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimated from sketches: their share of equal bytes, less chance."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def closeness(threshold: float) -> float:
    """The least similarity of sketches that ties: of two sets at the threshold
    one in 30,000 lies below it."""
    return max(0.0, threshold - 4 * (threshold * (1 - threshold) / SKETCH) ** 0.5)


def _base(docs: DataFrame, id_col: str, text_col: str, words: int, levels: int) -> DataFrame:
    """Per row: no, id, text key, set digest, set size, paths, sketch."""
    k1, k2 = row_key(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, k1 bigint, k2 bigint, d1 bigint, d2 bigint, n int, paths binary, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            d1, d2, n, paths, sketches = [], [], [], [], []
            for s in shingle_sets(part.column(3).to_pylist(), words):
                n.append(len(s))
                if not len(s):
                    d1.append(None), d2.append(None), paths.append(None), sketches.append(None)
                    continue
                sig = signature(s, max(levels, SKETCH // TREES))
                with np.errstate(over="ignore"):
                    d1.append(int(mix(s).sum().view(np.int64)))
                    d2.append(int(mix(s ^ MIX1).sum().view(np.int64)))
                paths.append(tree_paths(sig[:levels]))
                sketches.append(sketch(sig))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int32()),
                 pa.array(paths, pa.binary()), pa.array(sketches, pa.binary())],
                names=["id", "k1", "k2", "d1", "d2", "n", "paths", "sketch"],
            )

    return materialize(rows.mapInArrow(run, schema).withColumn("no", F.monotonically_increasing_id()), "rows")


def neighbours(least: int):
    """A pass over sorted (key, node) rows, each of these in rows of its own:
    ties (u, v, depth) of each row to the one before it, where their paths share
    at least ``least`` levels; runs of such a prefix (u, run) for every row that
    shares it with a neighbour; the first and last row of a partition (u, key),
    which stand for runs too, since their neighbours are elsewhere."""
    width = 1 + 2 * least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(u, v=None, depth=None, keys=None, runs=None):
            columns = zip((u, v, depth, keys, runs), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))
            return pa.RecordBatch.from_arrays([pa.nulls(len(u), t) if c is None else pa.array(c, t) for c, t in columns], names=["u", "v", "depth", "key", "run"])

        before, shares = None, False
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            nodes = b.column(1).to_numpy(zero_copy_only=False)
            if before is None:
                yield rows([nodes[0]], keys=[keys[0].tobytes()])
            else:
                keys, nodes = np.concatenate([before[0], keys]), np.concatenate([before[1], nodes])
            shared = np.cumprod(keys[1:] == keys[:-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int32)
            depth = (shared - 1) // 2
            good = np.flatnonzero((depth >= least) & (nodes[1:] != nodes[:-1]))
            u, v = nodes[1:][good], nodes[:-1][good]
            yield rows(np.maximum(u, v), np.minimum(u, v), depth[good])
            # All rows but the last, whose next neighbour is in the next batch.
            met = shared >= width
            inside = np.flatnonzero(np.concatenate([[shares], met[:-1]]) | met) if len(met) else np.zeros(0, np.int64)
            yield rows(nodes[inside], runs=[keys[i, :width].tobytes() for i in inside])
            before, shares = (keys[-1:], nodes[-1:]), bool(met[-1]) if len(met) else shares
        if before is not None:
            key = before[0][0].tobytes()
            yield rows([before[1][0]] * (2 if shares else 1), keys=[key, None][: 2 if shares else 1], runs=[None, key[:width]][: 2 if shares else 1])

    return run


FOUND = "u bigint, v bigint, depth int, key binary, run binary"


def _sorted_tries(forest: DataFrame, levels: int, least: int) -> DataFrame:
    """What ``neighbours`` finds in all tries at once."""
    width = 1 + 2 * levels
    trie = forest.select("node", "paths", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    trie = trie.select(F.expr(f"substring(paths, tree * {width} + 1, {width})").alias("key"), "node")
    return materialize(trie.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(neighbours(least), FOUND), "neighbours")


def _ties(forest: DataFrame, levels: int, least: int, found: DataFrame | None = None) -> DataFrame:
    """(u, v, depth, close): neighbours in some sorted trie, with the longest
    prefix that they share in one and the similarity of their sketches."""
    found = _sorted_tries(forest, levels, least) if found is None else found
    # The last row of a partition and the first of the next: two rows a partition.
    ends = found.where("key IS NOT NULL").select("key", F.col("u").alias("node")).repartition(1).sortWithinPartitions("key", "node").mapInArrow(neighbours(least), FOUND)
    ties = found.unionByName(ends).where("v IS NOT NULL").groupBy("u", "v").agg(F.max("depth").alias("depth"))
    sketches = forest.select("node", "sketch")
    pairs = (
        ties.join(sketches.select(F.col("node").alias("u"), F.col("sketch").alias("a")), "u")
        .join(sketches.select(F.col("node").alias("v"), F.col("sketch").alias("b")), "v").select("u", "v", "depth", "a", "b")
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(part.num_rows, -1) for i in (3, 4))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(likeness(a, b))], names=["u", "v", "depth", "close"])

    return materialize(pairs.mapInArrow(close, "u bigint, v bigint, depth int, close double"), "ties")


def sampled_pairs(forest: DataFrame, levels: int, threshold: float) -> DataFrame:
    """(u, v, depth, close): pairs of a set of the sample (the SAMPLE sets with
    the least hashes) and any set, whose paths agree in a share ``close`` of at
    least ``threshold`` of their min-hashes, and the longest prefix that they
    share in a tree.  Nothing is looked up: every set meets the whole sample.
    A gauge of a table's recall; the join itself does not use it."""
    some = forest.select("node", "paths").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
    nodes = np.array([r["node"] for r in some], np.int64)
    unpack = lambda paths: np.frombuffer(b"".join(paths), np.uint8).reshape(len(paths), TREES, 1 + 2 * levels)[:, :, 1:].copy().view("<u2")
    sample = unpack([bytes(r["paths"]) for r in some]) if some else np.zeros((0, TREES, levels), np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            v, u, depth, close = [], [], [], []
            for node, path in zip(batch.column(0).to_pylist(), unpack(batch.column(1).to_pylist())):
                same = sample == path
                share = same.mean(axis=(1, 2))
                near = np.flatnonzero((share >= threshold) & (nodes != node))
                u += nodes[near].tolist()
                v += [node] * len(near)
                close += share[near].tolist()
                depth += np.cumprod(same[near], axis=2).sum(axis=2).max(axis=1, initial=0).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(depth, pa.int32()), pa.array(close, pa.float64())], names=["u", "v", "depth", "close"])

    return forest.select("node", "paths").mapInArrow(run, "u bigint, v bigint, depth int, close double")


def families_that_meet(families: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """The families of a cell's rows, all compared but for those of one family:
    pairs of families as a forest, so fewer than there are families."""
    least, root = closeness(threshold), {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    order = np.lexsort((families, sizes))
    families, sizes, sketches = families[order], sizes[order], sketches[order]
    out, step = [], 32
    for first in range(0, len(families), step):
        # Rows are in the order of size: those too small for this chunk's smallest are passed over.
        low = int(np.searchsorted(sizes, sizes[first] * (threshold - 1e-9)))
        mine, theirs = slice(first, first + step), slice(low, min(first + step, len(families)))
        other = families[mine, None] != families[None, theirs]
        use = np.flatnonzero(other.any(axis=0))
        if not len(use):
            continue
        hit = other[:, use] & (likeness(sketches[mine, None], sketches[None, theirs][:, use]) >= least)
        r, c = np.nonzero(hit)
        if not len(r):
            continue
        for x, y in np.unique(np.stack([families[mine][r], families[theirs][use][c]], axis=1), axis=0).tolist():
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((x, y))
    return out


def _meet_in_cells(threshold: float):
    """A pass over (cell, family, n, sketch) rows in the order of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []

        def meet():
            families, sizes, sketches = (np.concatenate(x) for x in zip(*kept))
            return families_that_meet(families, sizes, sketches, threshold) if len(families) > 1 else []

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            cells, families, sizes = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            sketches = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])).tolist()
            edges = []
            for lo, hi in zip(starts, [*starts[1:], len(cells)]):
                if kept and cells[lo] != last:
                    edges += meet()
                    kept.clear()
                last = cells[lo]
                kept.append((families[lo:hi], sizes[lo:hi], sketches[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["u", "v"])
        if kept:
            edges = meet()
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return run


def _looked_up(forest: DataFrame, found: DataFrame, family: DataFrame, least: int, threshold: float) -> DataFrame:
    """(node, label): ``family`` after every set has met all of its runs.

    Only runs of more than one family are met.  A run of at most CELL rows is one
    cell.  A longer one is cut into buckets of sizes, each met with the one below;
    what is still longer is parted by a hash, and every two parts meet in a cell of
    their own, so a row is copied once for each part and no cell grows."""
    run = F.xxhash64(F.coalesce("run", F.substring("key", 1, 1 + 2 * least)))
    placed = found.where("v IS NULL").select(F.col("u").alias("node"), run.alias("run"))
    placed = materialize(placed.join(family, "node", "left").select("node", "run", F.coalesce("label", "node").alias("family")), "runs")
    of_run = placed.groupBy("run").agg(F.count(F.lit(1)).alias("f"), F.min("family").alias("low"), F.max("family").alias("high"))
    mixed = materialize(of_run.where("f > 2 AND low < high").select("run", "f", F.col("f").alias("size")), "mixed-runs")
    if mixed.isEmpty():
        return family
    members = skewed_join(placed, mixed, ["run"], "f").join(forest.select("node", "n", "sketch"), "node")
    columns = ("family", "n", "sketch")
    cells = members.where(F.col("size") <= CELL).select(F.xxhash64("run").alias("cell"), *columns)
    if not mixed.where(F.col("size") > CELL).isEmpty():
        step = float(np.log(1 / (threshold - 1e-9)))
        bucket = F.floor(F.log("n") / step).cast("int")
        long = materialize(members.where(F.col("size") > CELL).select("node", "run", *columns, F.explode(F.array(bucket, bucket + 1)).alias("bucket")), "long-runs")
        parts = F.ceil(F.col("f") / CELL).cast("int")
        counts = materialize(long.groupBy("run", "bucket").agg(F.count(F.lit(1)).alias("f")).select("run", "bucket", "f", parts.alias("parts")), "buckets-of-runs")
        long = skewed_join(long, counts, ["run", "bucket"], "f").withColumn("own", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("parts")).cast("int"))
        long = long.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cells = cells.unionByName(long.select(F.xxhash64("run", "bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), *columns))
    met = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_meet_in_cells(threshold), "u bigint, v bigint")
    met = materialize(met.distinct(), "met")
    if met.isEmpty():
        return family
    joined = components(met, "joined").withColumnRenamed("label", "next")
    singles = joined.join(family, "node", "left_anti").select("node", F.col("node").alias("label"))
    every = materialize(family.unionByName(singles), "families-met")
    sizes = every.groupBy("label").agg(F.count(F.lit(1)).alias("f"))
    renamed = materialize(joined.withColumnRenamed("node", "label").join(sizes, "label"), "renamed")
    return skewed_join(every, renamed, ["label"], "f", "left").select("node", F.coalesce("next", "label").alias("label"))


def measured_depth(ties: DataFrame, levels: int, least: int, threshold: float, target: float) -> int:
    """A gauge (see ``sampled_pairs``), not used by the join, which always matches
    prefixes of length ``least``: the greatest length at which
    the pairs at hand (those of ``sampled_pairs``) have the target recall, both as
    the share of them that a prefix of this length finds and, since few pairs prove
    little, by the chance recall(depth, trees, s) that their similarities s give
    (one row of sums is read).  Without such pairs it is ``least``."""
    near, depths = F.col("close") >= threshold, range(least, levels + 1)
    chance = lambda d: 1 - F.pow(1 - F.pow(F.least("close", F.lit(1.0)), F.lit(d)), F.lit(TREES))
    sums = ties.agg(
        F.coalesce(F.count_if(near), F.lit(0)).alias("all"),
        *[F.coalesce(F.count_if(near & (F.col("depth") >= d)), F.lit(0)).alias(f"found{d}") for d in depths],
        *[F.coalesce(F.sum(F.when(near & (F.col("depth") >= d), 1 / chance(d))), F.lit(0.0)).alias(f"meant{d}") for d in depths],
    ).first()
    reached = [d for d in depths if sums[f"found{d}"] and sums[f"found{d}"] >= target * max(sums["all"], sums[f"meant{d}"])]
    return max(reached, default=least)


def linked(a: list[np.ndarray], b: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """[set of a, set of b]: whether the exact similarity reaches the threshold."""
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    _, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
    wide = counts > 1  # what one set alone holds meets nothing
    column = np.cumsum(wide) - 1
    use = wide[place]
    owner, place = owner[use], column[place[use]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((len(a), len(b)), dtype=np.int64)
    step = 4096
    for first in range(0, int(wide.sum()), step):
        lo, hi = np.searchsorted(place, [first, first + step])
        x = np.zeros((len(a) + len(b), step), dtype=np.float32)
        x[owner[lo:hi], place[lo:hi] - first] = 1
        common += np.rint(x[: len(a)] @ x[len(a) :].T).astype(np.int64)
    sizes = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :]
    # common / (sizes - common) >= p / q
    return common * (threshold.denominator + threshold.numerator) >= threshold.numerator * sizes


def _roots(links: np.ndarray) -> np.ndarray:
    """The first member of each one's component, by repeated squaring of reach."""
    root = np.arange(len(links))
    while True:
        low = np.where(links, root[None, :], len(links)).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _sets(packed: bytes, sizes) -> list[np.ndarray]:
    return np.split(np.frombuffer(packed, np.uint64), np.cumsum(sizes)[:-1])


def _diagonal(threshold: Fraction):
    """The sets of a block among each other: one row a block."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        nodes, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in group["members"]]
        hit = linked(sets, sets, threshold)
        np.fill_diagonal(hit, False)
        many = bool(group["many"].iloc[0])
        first = group.iloc[0]
        return pd.DataFrame({
            "family": [first["family"]], "bucket": [first["bucket"]], "block": [first["block"]], "blocks": [first["blocks"]], "next_blocks": [first["next_blocks"]],
            "nodes": [nodes], "copies": [copies], "links": [hit @ copies], "roots": [nodes[_roots(hit)]],
            "sizes": [np.array([len(s) for s in sets])], "packed": [b"".join(group["members"]) if many else None],
        })

    return run


def forest_between(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[dict]:
    """Links between two blocks as a forest over the roots ``a`` and ``b`` of
    their members' components: fewer edges than there are components."""
    (ua, ia), (ub, ib) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
    met = np.zeros((len(ua), len(ub)), dtype=bool)
    r, c = np.nonzero(hit)
    met[ia[r], ib[c]] = True
    n = len(ua)
    both = np.zeros((n + len(ub),) * 2, dtype=bool)
    both[:n, n:], both[n:, :n] = met, met.T
    every, root = np.concatenate([ua, ub]), _roots(both)
    return [{"u": int(every[i]), "v": int(every[k])} for i, k in enumerate(root.tolist()) if i != k]


def _meet(threshold: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), 1):
                x = {k: v[0] for k, v in part.to_pydict().items()}
                hit = linked(_sets(x["a_packed"], x["a_sizes"]), _sets(x["b_packed"], x["b_sizes"]), threshold)
                if not hit.any():
                    continue
                counts = [hit @ np.array(x["b_copies"]), hit.T @ np.array(x["a_copies"])]
                edges = [forest_between(hit, np.array(x["a_roots"]), np.array(x["b_roots"])), []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["family"]] * 2, pa.int64()), pa.array([x["bucket"], x["b_bucket"]], pa.int32()), pa.array([x["block"], x["b_block"]], pa.int32()),
                     pa.array([c.tolist() for c in counts], pa.list_(pa.int64())), pa.array(edges, pa.list_(pa.struct([("u", pa.int64()), ("v", pa.int64())])))],
                    names=["family", "bucket", "block", "links", "edges"],
                )

    return run


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    own = group[group["nodes"].notna()].iloc[0]
    return pd.DataFrame({"nodes": [own["nodes"]], "roots": [own["roots"]], "links": [np.sum([np.asarray(x) for x in group["links"]], axis=0)]})


def _blocks(mates: DataFrame, threshold: float, rows: int) -> DataFrame:
    """``mates`` (sets with their family) plus the block they are compared in.

    A family that fits a block is one.  A larger one is first cut by size: sets
    are linked only if the smaller has at least ``threshold`` times the larger
    one's size, so only neighbouring buckets of that ratio ever meet; buckets
    are cut into blocks by a hash."""
    size = (F.count(F.lit(1)).alias("f"), F.sum(F.col("n").cast("long") * 8).alias("bytes"))
    number = F.greatest(F.ceil(F.col("f") / BLOCK_SETS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    large = materialize(mates.groupBy("family").agg(*size).where(number > 1).select("family", "f", F.lit(True).alias("many")), "large-families")
    columns = ("family", "bucket", "block", "blocks", "next_blocks", "many", "node", "copies", "k1", "k2")
    whole = mates.withColumns({"bucket": F.lit(0), "block": F.lit(0), "blocks": F.lit(1), "next_blocks": F.lit(0), "many": F.lit(False)})
    if large.isEmpty():
        return materialize(whole.select(*columns), "wanted", rows=rows)
    # Sets of large families carry their mark from here on; those of others are blocks.
    marked = materialize(skewed_join(mates, large, ["family"], "f", "left"), "mates", rows=rows)
    small = marked.where("many IS NULL").withColumns({"bucket": F.lit(0), "block": F.lit(0), "blocks": F.lit(1), "next_blocks": F.lit(0), "many": F.lit(False)})
    step = float(np.log(1 / (threshold - 1e-9)))
    placed = marked.where("many").withColumn("bucket", F.floor(F.log(F.col("n")) / step).cast("int"))
    counts = placed.groupBy("family", "bucket").agg(*size).select("family", "bucket", "f", number.alias("blocks"))
    after = counts.select("family", (F.col("bucket") - 1).alias("bucket"), F.col("blocks").alias("next_blocks"))
    counts = materialize(counts.join(after, ["family", "bucket"], "left").withColumn("next_blocks", F.coalesce("next_blocks", F.lit(0))), "buckets")
    placed = skewed_join(placed, counts, ["family", "bucket"], "f").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return materialize(small.select(*columns).unionByName(placed.select(*columns)), "wanted", rows=rows)


def _linked_sets(docs: DataFrame, mates: DataFrame, text_col: str, words: int, threshold: float, rows: int) -> DataFrame:
    """(node, links, label) of the sets in families: the number of other rows
    that they are linked to, and their class."""
    fraction = Fraction(str(threshold))
    wanted = _blocks(mates, threshold, rows)
    place = "family bigint, bucket int, block int"
    longs = "nodes array<bigint>, copies array<bigint>, links array<bigint>, roots array<bigint>"
    inner = materialize(
        _with_sets(docs, wanted, text_col, words).groupBy("family", "bucket", "block")
        .applyInPandas(_diagonal(fraction), f"{place}, blocks int, next_blocks int, {longs}, sizes array<int>, packed binary"), "blocks",
    )
    big = inner.where("packed IS NOT NULL")
    each = lambda df: df.select(F.explode(F.arrays_zip("nodes", "links", "roots")).alias("x")).select(F.col("x.nodes").alias("node"), F.col("x.links").alias("links"), F.col("x.roots").alias("root"))
    small = each(inner.where("packed IS NULL"))
    if big.isEmpty():
        return small.withColumnRenamed("root", "label")
    # A block meets the later ones of its bucket and all of the next bucket.
    own = F.when(F.col("blocks") > F.col("block") + 1, F.transform(F.sequence(F.col("block") + 1, F.col("blocks") - 1), lambda b: F.struct(F.col("bucket").alias("b_bucket"), b.alias("b_block"))))
    more = F.when(F.col("next_blocks") > 0, F.transform(F.sequence(F.lit(0), F.col("next_blocks") - 1), lambda b: F.struct((F.col("bucket") + 1).alias("b_bucket"), b.alias("b_block"))))
    empty = F.array().cast("array<struct<b_bucket:int,b_block:int>>")
    meetings = big.select("family", "bucket", "block", F.explode(F.concat(F.coalesce(own, empty), F.coalesce(more, empty))).alias("m")).select("family", "bucket", "block", "m.*")
    side = lambda prefix, keys: big.select(*[F.col(c).alias(k) for c, k in keys], *[F.col(c).alias(f"{prefix}_{c}") for c in ("packed", "sizes", "copies", "roots")])
    cross = materialize(
        meetings.join(side("a", [("family", "family"), ("bucket", "bucket"), ("block", "block")]), ["family", "bucket", "block"])
        .join(side("b", [("family", "family"), ("bucket", "b_bucket"), ("block", "b_block")]), ["family", "b_bucket", "b_block"])
        .mapInArrow(_meet(fraction), f"{place}, links array<bigint>, edges array<struct<u:bigint,v:bigint>>"), "meetings",
    )
    nothing = F.lit(None).cast("array<bigint>")
    every = big.select("family", "bucket", "block", "nodes", "roots", "links").unionByName(cross.select("family", "bucket", "block", nothing.alias("nodes"), nothing.alias("roots"), "links"))
    totals = every.groupBy("family", "bucket", "block").applyInPandas(_summed, "nodes array<bigint>, roots array<bigint>, links array<bigint>")
    joined = components(cross.select(F.explode("edges").alias("e")).select("e.u", "e.v"), "class", rows=rows)
    told = each(totals).join(joined.select(F.col("node").alias("root"), "label"), "root", "left").select("node", "links", F.coalesce("label", "root").alias("label"))
    return small.withColumnRenamed("root", "label").unionByName(told)


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = 0.8, target_recall: float = 0.9999) -> DataFrame:
    """One row per row: id_col, text key (k1, k2), class_id and n_links.

    Documents are linked when the Jaccard similarity of their sets of
    ``words``-word shingles is at least ``threshold`` (compared exactly, as a
    fraction).  n_links is the number of other rows a row is linked to, copies
    included; class_id is the smallest id of its connected component.

    Null texts and texts without words link to nothing and form classes of
    their own.  Rows that repeat an id are rows like others.  Null ids take
    part; a class of null ids only has a null class_id.  An empty table gives
    an empty table.  All sizes of groups are handled alike: no cap on
    candidates, and no task holds more than two blocks of a family.

    The length of matched prefixes follows from ``threshold`` and ``target_recall``
    (32 trees; 0.8 and 0.9999 give 6 levels); paths have two more, by which the
    sorted tries put the likest sets side by side.
    """
    need(docs, id=id_col, text=text_col)
    least = shortened_depth(threshold, target_recall)
    levels = min(MAX_DEPTH, least + LONGER)
    base = _base(docs, id_col, text_col, words, levels)
    rows = base.select("no", "id", "k1", "k2", "d1", "d2", "n")
    n = rows.count()
    sets = materialize(
        rows.where("d1 IS NOT NULL").groupBy("d1", "d2")
        .agg(F.min("no").alias("node"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2")).alias("k"), F.first("n").alias("n"), F.min("id").alias("id"))
        .select("d1", "d2", "node", "copies", "k.k1", "k.k2", "n", "id"), "sets", rows=n,
    )
    forest = materialize(base.select(F.col("no").alias("node"), "n", "paths", "sketch").join(sets.select("node"), "node", "left_semi"), "forest")
    found = _sorted_tries(forest, levels, least)
    ties = _ties(forest, levels, least, found)
    family = components(ties.where(F.col("close") >= closeness(threshold)).select("u", "v"), "family")
    family = materialize(_looked_up(forest, found, family, least, threshold), "all-families", rows=n)
    release(forest, found)
    mates = materialize(sets.join(family.select("node", F.col("label").alias("family")), "node").select("family", "node", "copies", "k1", "k2", "n"), "families", rows=n)
    told = _linked_sets(docs, mates, text_col, words, threshold, n)
    # Sets that are linked or have copies; all others stand alone.
    known = (
        sets.join(told, "node", "left").where("label IS NOT NULL OR copies > 1")
        .select("d1", "d2", "id", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    known = materialize(known, "known", rows=n)
    names = materialize(known.groupBy("label").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("f")), "names", rows=n)
    known = skewed_join(known, names, ["label"], "f").select("d1", "d2", "copies", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.lit(True).alias("known"))
    out = skewed_join(rows, materialize(known, "told", rows=n), ["d1", "d2"], "copies", "left")
    return out.select(
        F.col("id").alias(id_col), "k1", "k2", F.when(F.col("known"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _with_sets(docs: DataFrame, wanted: DataFrame, text_col: str, words: int) -> DataFrame:
    """``wanted`` plus ``members``: each one's shingle set, from one of the texts
    with its key.  Few keys are broadcast (their number is counted first), so
    that other texts are dropped where they are read; many are shuffled to."""
    k1, k2 = row_key(F.col(text_col))
    keys = wanted.select("k1", "k2").distinct()
    if wanted.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text")).join(keys, ["k1", "k2"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: set[tuple[int, int]] = set()
        for part in slices(batches):
            # Copies side by side need no second look; the rest is left to Spark.
            keys_here = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
            pick = [i for i, k in enumerate(keys_here) if k not in last and keys_here.index(k) == i]
            last = set(keys_here)
            part = part.take(pa.array(pick, pa.int64()))
            made = [s.tobytes() for s in shingle_sets(part.column(2).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], names=["k1", "k2", "members"])

    made = texts.mapInArrow(run, "k1 bigint, k2 bigint, members binary").groupBy("k1", "k2").agg(F.first("members").alias("members"))
    return wanted.join(made, ["k1", "k2"])


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents whose class has a smaller id.

    Rows that repeat both id and text of a kept document are that document and
    stay; so do rows with null ids in classes of null ids only.
    """
    told = similar_documents(docs, id_col=id_col, text_col=text_col, **options)
    gone = told.where(~F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.xxhash64(F.lit(3), F.col(id_col), "k1", "k2").alias("g1"), F.xxhash64("k2", "k1", F.col(id_col)).alias("g2")).distinct()
    gone = materialize(gone, "gone", rows=docs.count())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    k1, k2 = row_key(F.col(text_col))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"))
    keyed = keyed.select("row", F.xxhash64(F.lit(3), "id", "k1", "k2").alias("g1"), F.xxhash64("k2", "k1", "id").alias("g2"))
    left = keyed.join(gone, ["g1", "g2"], "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


# --- query ------------------------------------------------------------------

NAME = "op5_jaccard_join"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_documents(docs).select("doc_id", "class_id", "n_links")
