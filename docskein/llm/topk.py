"""Exact top-k search by inner product (operator 2): ball trees per shard.

Candidates are dealt to shards by nearest pivot, so that shards are balls of
their own; each becomes a ball tree (centre, radius, median splits), kept as one
row beside its root ball.  Queries travel in blocks of one neighbourhood, each
with its k-th scores so far.  A block meets shards in rounds:

1. its own shard, which gives every query a k-th score;
2. the few shards whose root balls promise most, which raise the scores;
3. of all others those whose root ball still reaches some query's k-th score.

A shard whose root bound lies below is never met.  In a shard each query takes
the leaves in the order of their upper bounds q.c + |q| r; bounds are computed
level by level for the queries and nodes still in question, so subtrees below
the k-th score are never opened; queries that take the same leaf are multiplied
with it together.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docskein.llm.common import materialize, need, slices

LEAF = 256
NOTHING = np.iinfo(np.int64).min


class BallTree:
    """Integer vectors in leaves of at most LEAF; node i has children 2i+1, 2i+2."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, nos: np.ndarray) -> None:
        order = np.lexsort((nos, ids))
        vectors, ids, nos = vectors[order], ids[order], nos[order]
        depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / LEAF))))
        parts: list[np.ndarray] = [np.arange(len(ids))]
        x = vectors.astype(np.float64)
        self.depth, centres, radii = depth, [], []
        for level in range(depth + 1):
            for p in parts:
                own = x[p]
                c = own.mean(axis=0) if len(p) else np.zeros(x.shape[1])
                centres.append(c)
                radii.append(np.sqrt(((own - c) ** 2).sum(axis=1).max()) if len(p) else 0.0)
            if level < depth:
                parts = [half for p, c in zip(parts, centres[-len(parts):]) for half in self._halves(x, p, c)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        # Ids ascend within a leaf.
        self.leaves = [np.sort(p) for p in parts]
        self.bounds = np.cumsum([0, *map(len, self.leaves)])
        order = np.concatenate(self.leaves)
        self.vectors, self.ids, self.nos = vectors[order], ids[order], nos[order]

    @staticmethod
    def _halves(x: np.ndarray, p: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Split at the median along the line from the point farthest from the
        centre to the point farthest from that one."""
        own = x[p]
        a = own[((own - centre) ** 2).sum(axis=1).argmax()]
        b = own[((own - a) ** 2).sum(axis=1).argmax()]
        order = np.argsort(own @ (b - a), kind="stable")
        return p[order[: len(p) // 2]], p[order[len(p) // 2 :]]

    def upper_bounds(self, queries: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """[query, leaf] upper bounds; minus infinity where an ancestor's bound
        is below the query's k-th score.  A small margin covers rounding."""
        norm = np.sqrt((queries**2).sum(axis=1))
        bound = np.full((len(queries), 1), np.inf)
        for level in range(self.depth + 1):
            first = 2**level - 1
            if level:
                bound = np.repeat(bound, 2, axis=1)
            rows, nodes = np.flatnonzero((bound > -np.inf).any(axis=1)), np.flatnonzero((bound > -np.inf).any(axis=0))
            if not len(rows):
                return np.full((len(queries), 2**self.depth), -np.inf)
            top = queries[rows] @ self.centres[first + nodes].T + norm[rows, None] * self.radii[first + nodes][None, :]
            top += 1e-6 * (1.0 + np.abs(top))
            open_ = (bound[np.ix_(rows, nodes)] > -np.inf) & (top >= kth[rows, None])
            bound = np.full_like(bound, -np.inf)
            bound[np.ix_(rows, nodes)] = np.where(open_, top, -np.inf)
        return bound


class Best:
    """The k best (score, id, row) of each query so far: ties to smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), NOTHING, dtype=np.int64)
        self.id = np.zeros((n, k), dtype=np.int64)
        self.no = np.full((n, k), -1, dtype=np.int64)

    @property
    def kth(self) -> np.ndarray:
        return self.score[:, -1].astype(np.float64)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, nos: np.ndarray, own: np.ndarray) -> None:
        """Candidates ``ids`` with ``scores`` [row, candidate]; ``own`` is each
        query's row number, which is no candidate of its own."""
        k = self.k
        floor = self.score[rows, -1]
        if scores.shape[1] > k + 1:
            floor = np.maximum(floor, np.partition(scores, -k - 1, axis=1)[:, -k - 1])
        r, c = np.nonzero((scores >= floor[:, None]) & (nos[None, :] != own[:, None]))
        if not len(r):
            return
        r_all = np.concatenate([r, np.repeat(np.arange(len(rows)), k)])
        s_all = np.concatenate([scores[r, c], self.score[rows].ravel()])
        i_all = np.concatenate([ids[c], self.id[rows].ravel()])
        n_all = np.concatenate([nos[c], self.no[rows].ravel()])
        real = n_all >= 0
        r_all, s_all, i_all, n_all = r_all[real], s_all[real], i_all[real], n_all[real]
        order = np.lexsort((n_all, i_all, -s_all, r_all))
        r_all, s_all, i_all, n_all = r_all[order], s_all[order], i_all[order], n_all[order]
        place = np.arange(len(r_all)) - np.searchsorted(r_all, r_all)
        top = place < k
        at = (rows[r_all[top]], place[top])
        self.score[at], self.id[at], self.no[at] = s_all[top], i_all[top], n_all[top]


def search(tree: BallTree, queries: np.ndarray, own: np.ndarray, best: Best) -> int:
    """Improve ``best`` with all candidates of the tree; how many (query, leaf)
    pairs were opened for that."""
    x = queries.astype(np.float64)
    limit = float(np.abs(queries).max(initial=0)) * float(np.abs(tree.vectors).max(initial=0)) * queries.shape[1]
    exact = limit < 2**53
    leaf_x = tree.vectors.astype(np.float64) if exact else tree.vectors
    bound = tree.upper_bounds(x, best.kth)
    order = np.argsort(-bound, axis=1, kind="stable")
    live, opened = np.arange(len(queries)), 0
    for step in range(bound.shape[1]):
        leaf = order[live, step]
        open_ = (bound[live, leaf] >= best.kth[live]) & (bound[live, leaf] > -np.inf)
        live, leaf = live[open_], leaf[open_]  # later leaves have smaller bounds
        opened += len(live)
        if not len(live):
            break
        for l in np.unique(leaf):
            a, b = tree.bounds[l], tree.bounds[l + 1]
            rows = live[leaf == l]
            if exact:
                scores = np.rint(x[rows] @ leaf_x[a:b].T).astype(np.int64)
            else:
                scores = queries[rows] @ leaf_x[a:b].T
            best.offer(rows, scores, tree.ids[a:b], tree.nos[a:b], own[rows])
    return opened


# --- rows ---------------------------------------------------------------------


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(raw: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(raw)))


def _tree(raw: bytes) -> BallTree:
    tree = BallTree.__new__(BallTree)
    tree.__dict__.update(_load(raw))
    tree.depth = int(tree.depth)
    return tree


def scaled(embedding: Column) -> Column:
    """floor(64 x) of each component as double; null for vectors that are null,
    or hold a null or a component that is not finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(embedding, lambda x: F.floor(x.cast("double") * 64)))


PIVOTS, PIVOT_BYTES = 1024, 8 << 20
ROOTS = 4096  # root balls packed into one row
FIRST_SHARDS = 3  # shards of the second round


def exact_topk(
    vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 16_384, min_shards: int = 16, block_rows: int = 2048
) -> DataFrame:
    """query_id, rank (from 1), id_col, score: for each row where ``is_query``
    holds, the ``k`` other rows with the greatest integer inner product.

    Scores are over ``scaled`` components; ties go to the smaller id, and
    between rows that repeat an id to either.  The own row is no candidate,
    other rows with its id are.  Rows with null ids, and vectors that ``scaled``
    rejects, take no part; vectors of different lengths never meet; a query
    with fewer than ``k`` candidates gets all of them.  Empty vectors score 0.
    Sums must fit a long (else they wrap).  An empty table gives an empty one.

    A task holds one shard and one block, whatever the table's size: the first
    grows in number with the rows, the second with the queries.
    """
    return _searched(vectors, is_query, k, id_col, vector_col, shard_rows, min_shards, block_rows)[0]


def pruning(vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 16_384, min_shards: int = 16, block_rows: int = 2048) -> DataFrame:
    """One row on a search with these arguments: meetings of a block and a shard
    out of all, and (query, leaf) pairs opened out of all."""
    return _searched(vectors, is_query, k, id_col, vector_col, shard_rows, min_shards, block_rows)[1]


def _clusters(base: DataFrame, shard_rows: int, min_shards: int, block_rows: int) -> DataFrame:
    """``base`` plus cluster, sub (together the shard) and block.

    Vectors of a length that many rows have go to the nearest of at most PIVOTS
    pivots, which are rows of the table (the first by a hash; any pivots give
    exact results).  Tables of lengths and clusters hold only those with more
    than a quarter of a shard's rows, so their size is bounded by the rows."""
    least = max(1, min(shard_rows, 16 * LEAF) // 4)
    sizes = base.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    sizes = materialize(sizes, "lengths")
    budget = PIVOT_BYTES / (8 * F.greatest(F.col("dim"), F.lit(1)) * max(1, sizes.count()))
    sizes = sizes.select("dim", F.greatest(F.lit(1), F.least(F.lit(PIVOTS), F.greatest(F.ceil(F.col("n") / shard_rows), F.lit(min_shards)), F.floor(budget))).cast("int").alias("pivots"))
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64(F.lit(5), "no"), "no"))
    chosen = base.join(F.broadcast(sizes), "dim").withColumn("rank", rank).where(F.col("rank") <= PIVOTS).where(F.col("rank") <= F.col("pivots"))
    points: dict[int, list] = {}
    for r in chosen.select("dim", "v").toLocalIterator():
        points.setdefault(r.dim, []).append(r.v)
    pivots = base.sparkSession.sparkContext.broadcast({d: np.array(p, dtype=np.float64).reshape(len(p), d) for d, p in points.items()})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            dims, cluster = part.column(4).to_numpy(zero_copy_only=False), np.zeros(part.num_rows, dtype=np.int32)
            for d in np.unique(dims).tolist():
                if len(pivots.value.get(d, ())) > 1:
                    at, p = np.flatnonzero(dims == d), pivots.value[d]
                    x = np.array(part.column(1).take(pa.array(at)).to_pylist(), dtype=np.float64)
                    cluster[at] = ((p**2).sum(axis=1)[None, :] - 2 * (x @ p.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cluster)], names=[*part.schema.names, "cluster"])

    placed = materialize(base.select("id", "v", "q", "no", "dim").mapInArrow(near, "id bigint, v array<bigint>, q boolean, no bigint, dim int, cluster int"), "placed")
    counts = placed.groupBy("dim", "cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("nq")).where(F.col("n") > least)
    counts = counts.select("dim", "cluster", F.ceil(F.col("n") / shard_rows).cast("int").alias("subs"), F.greatest(F.ceil(F.col("nq") / block_rows), F.lit(1)).cast("int").alias("blocks"))
    one = lambda c: F.coalesce(c, F.lit(1))
    return (
        placed.join(F.broadcast(counts), ["dim", "cluster"], "left")
        .withColumn("sub", F.pmod(F.xxhash64("no"), one("subs")).cast("int")).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "no"), one("blocks")).cast("int"))
        .withColumn("home", F.pmod("block", one("subs")).cast("int")).drop("subs", "blocks")
    )


SHARD = ["dim", "cluster", "sub"]


def _searched(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, shard_rows: int, min_shards: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    need(vectors, id=id_col, vector=vector_col)
    base = materialize(
        vectors.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
        .where("id IS NOT NULL AND v IS NOT NULL").withColumn("no", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors",
    )
    placed = _clusters(base, shard_rows, min_shards, block_rows)

    def matrix(group: pd.DataFrame) -> np.ndarray:
        return np.array([*group["v"]], dtype=np.int64).reshape(len(group), -1)

    def plant(group: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(matrix(group), group["id"].to_numpy(), group["no"].to_numpy())
        raw = _dump(depth=np.array(tree.depth), centres=tree.centres, radii=tree.radii, bounds=tree.bounds, vectors=tree.vectors, ids=tree.ids, nos=tree.nos)
        first = group.iloc[0]
        return pd.DataFrame({"dim": [first["dim"]], "cluster": [first["cluster"]], "sub": [first["sub"]], "centre": [tree.centres[0]], "radius": [tree.radii[0]], "leaves": [len(tree.leaves)], "tree": [raw]})

    def ask(group: pd.DataFrame) -> pd.DataFrame:
        x, best, first = matrix(group), Best(len(group), k), group.iloc[0]
        raw = _dump(vectors=x, ids=group["id"].to_numpy(), nos=group["no"].to_numpy(), score=best.score, id=best.id, no=best.no)
        return pd.DataFrame({"dim": [first["dim"]], "of": [first["cluster"]], "block": [first["block"]], "home": [first["home"]], "state": [raw]})

    trees = materialize(
        placed.groupBy(*SHARD).applyInPandas(plant, "dim int, cluster int, sub int, centre array<double>, radius double, leaves int, tree binary"), "trees"
    )
    block = "dim int, of int, block int"
    asked = placed.where("q").groupBy("dim", "cluster", "block").applyInPandas(ask, f"{block}, home int, state binary")
    state = materialize(asked, "asked")
    blocks = ["dim", "of", "block"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Search one shard for one block: the block's best with the shard's."""
        for x in _each(batches):
            s, best = _load(x["state"]), _best(_load(x["state"]), k)
            opened = search(_tree(x["tree"]), s["vectors"], s["nos"], best)
            raw = _dump(score=best.score, id=best.id, no=best.no)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x[c]], pa.int32()) for c in ("dim", "of", "block")), pa.array([opened], pa.int64()), pa.array([raw], pa.binary())], names=["dim", "of", "block", "opened", "found"]
            )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same, giving only rows that the shard added, and one on the work."""
        for x in _each(batches):
            s, best = _load(x["state"]), _best(_load(x["state"]), k)
            opened = search(_tree(x["tree"]), s["vectors"], s["nos"], best)
            r, c = np.nonzero((best.no >= 0) & ~(best.no[:, :, None] == s["no"][:, None, :]).any(axis=2))
            cells = [[*v.tolist(), None] for v in (s["ids"][r], s["nos"][r], best.id[r, c], best.score[r, c])]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (*cells, [None] * len(r) + [opened])], names=["query_id", "query_no", "id", "score", "opened"])

    def searched(meetings: DataFrame, state: DataFrame, work, schema: str) -> DataFrame:
        met = meetings.join(state.select(*blocks, "state"), blocks).join(trees.select(*SHARD, "tree"), SHARD)
        return met.select(*blocks, "state", "tree").mapInArrow(work, schema)

    found_schema = f"{block}, opened bigint, found binary"
    rows = "query_id bigint, query_no bigint, id bigint, score bigint"

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        """A block's state with what some shards found for it."""
        s = _load(group["state"].dropna().iloc[0])
        best = _best(s, k)
        for raw in group["found"].dropna():
            _absorb(best, _load(raw))
        first = group.iloc[0]
        raw = _dump(vectors=s["vectors"], ids=s["ids"], nos=s["nos"], score=best.score, id=best.id, no=best.no)
        return pd.DataFrame({"dim": [first["dim"]], "of": [first["of"]], "block": [first["block"]], "state": [raw]})

    def merged(state: DataFrame, found: DataFrame, name: str) -> DataFrame:
        none = F.lit(None).cast("binary")
        both = state.select(*blocks, "state", none.alias("found")).unionByName(found.select(*blocks, none.alias("state"), "found"))
        return materialize(both.groupBy(*blocks).applyInPandas(merge, f"{block}, state binary"), name)

    # Round 1: the own shard (where it has rows).
    home = state.select(*blocks, F.col("of").alias("cluster"), F.col("home").alias("sub")).join(trees.select(*SHARD), SHARD, "left_semi")
    found0 = materialize(searched(home, state, meet, found_schema), "found-home")
    state = merged(state, found0, "state-home")
    # Round 2: the shards that promise most.
    reach = _reaching(state, trees).join(home, [*blocks, "cluster", "sub"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*blocks).orderBy(F.desc("bound"), "cluster", "sub"))
    best = materialize(reach.withColumn("place", place).where(F.col("place") <= FIRST_SHARDS).select(*blocks, "cluster", "sub"), "best-shards")
    found1 = materialize(searched(best, state, meet, found_schema), "found-best")
    state = merged(state, found1, "state-best")
    # Round 3: all others that still reach a k-th score.
    rest = _reaching(state, trees).join(home.unionByName(best.select(*home.columns)), [*blocks, "cluster", "sub"], "left_anti").select(*blocks, "cluster", "sub")
    found2 = materialize(searched(rest, state, finish, f"{rows}, opened bigint"), "found-rest")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                s = _load(raw)
                r, c = np.nonzero(s["no"] >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s["ids"][r], s["nos"][r], s["id"][r, c], s["score"][r, c])], names=["query_id", "query_no", "id", "score"])

    every = state.select("state").mapInArrow(tell, rows).unionByName(found2.where("query_no IS NOT NULL").select("query_id", "query_no", "id", "score"))
    rank = F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), "id"))
    out = every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
    met = found0.select("opened").unionByName(found1.select("opened")).unionByName(found2.where("query_no IS NULL").select("opened")).agg(F.count(F.lit(1)).alias("meetings"), F.coalesce(F.sum("opened"), F.lit(0)).alias("opened"))
    shards = trees.groupBy("dim").agg(F.count(F.lit(1)).alias("shards"), F.sum("leaves").alias("leaves"))
    queries = placed.where("q").groupBy("dim", "cluster", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("queries"))
    possible = shards.join(queries, "dim").agg(F.sum(F.col("shards") * F.col("blocks")).alias("all_meetings"), F.sum(F.col("leaves") * F.col("queries")).alias("all_leaves"))
    one = F.lit(1).alias("one")
    return out, met.select("*", one).join(possible.select("*", one), "one").drop("one")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: each holds a block or a shard, or both."""
    for batch in batches:
        for part in slices(iter([batch]), 1):
            yield {c: v[0] for c, v in part.to_pydict().items()}


def _best(s: dict[str, np.ndarray], k: int) -> Best:
    best = Best(len(s["ids"]), k)
    best.score, best.id, best.no = s["score"].copy(), s["id"].copy(), s["no"].copy()
    return best


def _absorb(best: Best, found: dict[str, np.ndarray]) -> None:
    """The k best of both, each candidate row once."""
    score, ids, nos = (np.concatenate([a, b], axis=1) for a, b in ((best.score, found["score"]), (best.id, found["id"]), (best.no, found["no"])))
    twice = np.concatenate([np.zeros_like(best.no, dtype=bool), (found["no"][:, :, None] == best.no[:, None, :]).any(axis=2)], axis=1) & (nos >= 0)
    score[twice], nos[twice] = NOTHING, -1
    n, width = score.shape
    row = np.repeat(np.arange(n), width)
    order = np.lexsort((nos.ravel(), ids.ravel(), -score.ravel(), nos.ravel() < 0, row)).reshape(n, width)
    take = order[:, : best.k]
    best.score, best.id, best.no = (x.ravel()[take] for x in (score, ids, nos))


def _reaching(state: DataFrame, trees: DataFrame) -> DataFrame:
    """(dim, of, block, cluster, sub, bound): shards whose root ball reaches the
    k-th score of some query of the block.

    Blocks and roots meet as balls, in groups of ROOTS roots a row: the block
    brings its centre, radius, greatest norm and least k-th score only."""
    groups = trees.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / ROOTS).cast("int").alias("groups"))
    roots = trees.select("dim", "cluster", "sub", "centre", "radius")
    shape = groups.select("dim", "groups")
    # Lengths with one group need no table: only those with more are joined.
    wide = F.broadcast(shape.where("groups > 1"))
    count = F.coalesce("groups", F.lit(1))
    roots = roots.join(wide, "dim", "left").withColumn("g", F.pmod(F.xxhash64("cluster", "sub"), count).cast("int"))
    packed = roots.groupBy("dim", "g").agg(F.collect_list(F.struct("cluster", "sub", "centre", "radius")).alias("roots"))

    def ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            s = _load(r["state"])
            x = s["vectors"].astype(np.float64)
            c = x.mean(axis=0)
            radius, norm, kth = np.sqrt(((x - c) ** 2).sum(axis=1).max()), np.sqrt((x**2).sum(axis=1).max()), s["score"][:, -1].min()
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[k]], pa.int32()) for k in ("dim", "of", "block")), pa.array([c.tolist()], pa.list_(pa.float64())), *(pa.array([float(v)]) for v in (radius, norm, kth))],
                names=["dim", "of", "block", "mid", "spread", "norm", "kth"],
            )

    balls = materialize(state.select("dim", "of", "block", "state").mapInArrow(ball, "dim int, of int, block int, mid array<double>, spread double, norm double, kth double"), "balls")
    balls = balls.join(wide, "dim", "left").withColumn("g", F.explode(F.sequence(F.lit(0), count - 1))).drop("groups")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _each(batches):
            c = np.array([r["centre"] for r in x["roots"]]).reshape(len(x["roots"]), -1)
            radius = np.array([r["radius"] for r in x["roots"]])
            top = c @ np.array(x["mid"]) + x["spread"] * np.sqrt((c**2).sum(axis=1)) + x["norm"] * radius
            top += 1e-6 * (1.0 + np.abs(top))
            at = np.flatnonzero(top >= x["kth"])
            same = lambda v: pa.array([v] * len(at), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [same(x["dim"]), same(x["of"]), same(x["block"]), pa.array([x["roots"][i]["cluster"] for i in at], pa.int32()), pa.array([x["roots"][i]["sub"] for i in at], pa.int32()), pa.array(top[at])],
                names=["dim", "of", "block", "cluster", "sub", "bound"],
            )

    return balls.join(packed, ["dim", "g"]).select("dim", "of", "block", "mid", "spread", "norm", "kth", "roots").mapInArrow(bounds, "dim int, of int, block int, cluster int, sub int, bound double")


# --- query ------------------------------------------------------------------

NAME = "op2_topk"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_topk(vectors, F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
