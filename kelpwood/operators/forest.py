"""Distance forests: bootstrap, splits by the nearest exemplar, level by level for all trees at once.

Every random choice is a hash of the seed and its place, so a forest doesn't depend on partitioning.
A level costs one pass of its rows over the exemplars of their nodes. The exemplars of a node travel
as one array, so a row finds its branch without a shuffle; they are broadcast while their number is
proven small and joined by node beyond that. Levels are cut by checkpoints. Bootstrap copies are held
as multiplicities.

Rows with null idx, a null series or a null label don't train; a candidate that leaves a branch empty is
no split; a node without a valid candidate, pure enough or at ``max_depth`` is a leaf.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpwood.functions import distances as D
from kelpwood.operators import purity as P
from kelpwood.session import broadcast_if_small, checkpointed, number_rows, parallelism

LOG = logging.getLogger(__name__)  # progress of training
MOST_BROADCAST = 20_000  # exemplar arrays that are broadcast at most


@dataclass(frozen=True)
class ForestConfig:
    """All options of training; see the README for how they map to common launchers' options."""

    task: str = "classification"  # or regression
    n_trees: int = 11
    n_candidates: int = 5
    distances: tuple[str, ...] = D.DEFAULT_POOL
    measure_scope: str = "node"  # or tree: one measure a tree
    purity: str = "gini"  # gini, entropy; variance, mad for regression
    purity_threshold: float = 1e-6
    max_depth: int = 0  # 0: no limit
    regression_agg: str = "mean"  # or median, at leaves and over trees
    seed: int = 0
    initial_imputer: str = "mean"
    impute_iterations: int = 5
    alignment: str = "position"  # or dtw
    knn_distances: tuple[str, ...] = ("euclidean",)
    missing_tokens: tuple[str, ...] = ("", "NA", "NaN", "null", "nan", "NAN")
    repeats: int = 1


def draw(*parts: Column | str | int) -> Column:
    """A number from 0 to 2**32 - 1 from the hash of the parts."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    return draw(*parts) / float(1 << 32)


def bootstrap(ids: DataFrame, n_trees: int, seed: int) -> DataFrame:
    """(tree, idx, mult, oob): n draws with replacement a tree, and the rows it left out.

    Places 0..n-1 are handed out in order of idx; draw d of a tree picks place hash % n.
    """
    n = ids.count()
    counted = number_rows(ids.select("idx"), "idx")
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree")
    draws = counted.select(trees, "place").select("tree", (draw(seed, "bag", F.col("tree"), F.col("place")) % max(1, n)).alias("place"))
    mult = draws.groupBy("tree", "place").agg(F.count("*").alias("mult"))
    grid = counted.select("idx", "place", trees)
    return grid.join(mult, ["tree", "place"], "left").select("tree", "idx", F.coalesce("mult", F.lit(0)).alias("mult"), F.col("mult").isNull().alias("oob"))


def _to_exemplars(d: D.Distance, rows: np.ndarray, shapes: np.ndarray, own: np.ndarray, at: np.ndarray, params: dict[str, np.ndarray]) -> np.ndarray:
    """Distances of the pairs (rows[own], shapes[at]) of series of one length, the pairs of a row together. Where the
    distance gives up pairs early, a row's exemplar of the least squared difference is measured first, and none that is
    farther need be measured to the end."""
    if not d.abandons or not len(own):
        return D.evaluate_alike(d, rows, shapes, own, at, params)
    rough = D.evaluate_alike(D.get("euclidean"), rows, shapes, own, at)
    start = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
    size = np.diff(start, append=len(own))
    close = np.flatnonzero(~(rough > np.repeat(np.minimum.reduceat(rough, start), size)))
    first = close[np.flatnonzero(np.diff(own[close], prepend=own[0] - 1))]  # one a row
    rest = np.delete(np.arange(len(own)), first)
    some = lambda part, limit=None: D.evaluate_alike(d, rows, shapes, own[part], at[part], {k: v[part] for k, v in params.items()}, limit)
    out = np.empty(len(own))
    out[first] = some(first)
    most = np.where(np.isnan(out[first]), np.inf, out[first])
    out[rest] = some(rest, np.repeat(most, size)[rest])
    return out


def _nearest(seed: int, names_used: tuple[str, ...]):
    """Branch of the nearest exemplar: identity first, ties by hash, NaN last."""
    known = {D.get(n).name: D.get(n) for n in names_used}  # travels with the function, also a user's own

    @F.arrow_udf(T.IntegerType())
    def branch(where: pa.Array, idx: pa.Array, series: pa.Array, measure: pa.Array, params: pa.Array, exemplars: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(exemplars), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        own = np.repeat(np.arange(len(size)), size)
        flat = exemplars.flatten()
        theirs, branches = (pc.struct_field(flat, n).to_numpy(zero_copy_only=False) for n in ("idx", "branch"))
        shapes = pc.struct_field(flat, "series")
        d = np.full(len(own), np.inf)
        codes = measure.dictionary_encode()
        code = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False)[own]
        table = params.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(D.PARAMS)) if len(own) else np.zeros((0, len(D.PARAMS)))
        even = None if pa.types.is_nested(series.type.value_type) else D.alike(series, shapes)
        for k, name in enumerate(codes.dictionary.to_pylist()):
            at = np.flatnonzero(code == k)
            used = {p: table[own[at], D.PARAMS.index(p)] for p in known[name].params}
            if even is not None and not known[name].multi:
                got = _to_exemplars(known[name], *even, own[at], at, used)
            else:
                got = D.evaluate(known[name], series.take(pa.array(own[at])), shapes.take(pa.array(at)), used)
            d[at] = np.where(np.isnan(got), np.inf, got)
        d[theirs == idx.to_numpy(zero_copy_only=False)[own]] = -1
        some = np.flatnonzero(size)
        out = np.full(len(size), -1)
        if len(some):
            start = (np.cumsum(size) - size)[some]
            least = np.repeat(np.minimum.reduceat(d, start), size[some])
            tied = d == least
            first = np.flatnonzero(tied)
            first = first[np.unique(own[first], return_index=True)[1]]
            out[some] = branches[first]
            before = np.cumsum(size) - size
            for r in some[np.add.reduceat(tied.astype(np.int64), start) > 1]:
                at = np.flatnonzero(tied[(lo := int(before[r])) : lo + int(size[r])]) + lo
                out[r] = min((hashlib.md5(f"{seed}|tie|{where[int(r)].as_py()}|{branches[t]}|{idx[int(r)].as_py()}".encode()).hexdigest(), branches[t]) for t in at)[1]
        return pa.array(out.astype(np.int32), mask=out < 0)

    return branch


def _numeric(rows: DataFrame) -> bool:
    """Whether the series hold numbers only."""
    kind = rows.schema["series"].dataType
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return isinstance(kind, T.NumericType)


@dataclass
class ForestModel:
    """nodes(tree, node, depth, is_leaf, prediction, n, measure, params), exemplars(tree, node, branch,
    idx, series), membership(tree, node, idx, mult, oob), train(idx, series, label)."""

    config: ForestConfig
    nodes: DataFrame
    exemplars: DataFrame
    membership: DataFrame
    train: DataFrame

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        for name in ("nodes", "exemplars", "membership", "train"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(json.dumps(asdict(self.config)),)], "config string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        raw = json.loads(spark.read.text(f"{path}/config").first()[0])
        config = ForestConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
        return cls(config, *(spark.read.parquet(f"{path}/{n}") for n in ("nodes", "exemplars", "membership", "train")))

    def route(self, rows: DataFrame) -> DataFrame:
        """(tree, node, idx): the leaf of every row in every tree."""
        spark = rows.sparkSession
        seed = self.config.seed
        inner = self.exemplars.groupBy("tree", "node").agg(F.collect_list(F.struct("branch", "idx", "series")).alias("exemplars"))
        inner = checkpointed(inner.join(self.nodes.filter("not is_leaf").select("tree", "node", "measure", "params"), ["tree", "node"]))
        inner = broadcast_if_small(inner, MOST_BROADCAST)
        trees = [r["tree"] for r in self.nodes.select("tree").distinct().collect()]
        active = rows.filter("idx is not null and series is not null").select(F.explode(F.array(*[F.lit(t) for t in sorted(trees)])).alias("tree"), F.lit("r").alias("node"), "idx", "series") if trees else None
        done = []
        while active is not None:
            stepped = active.repartition(parallelism(spark), "tree", "idx").join(inner, ["tree", "node"], "left")
            where = F.concat_ws("|", "tree", "node")
            branch = _nearest(seed, self.config.distances)(where, "idx", "series", "measure", "params", "exemplars")
            moved = stepped.filter("exemplars is not null").withColumn("branch", branch)
            done.append(active.join(inner.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "node", "idx"))
            moved = checkpointed(moved.select("tree", F.concat_ws(".", "node", F.col("branch").cast("string")).alias("node"), "idx", "series"))
            active = moved if moved.limit(1).count() else None
        if not done:
            return spark.createDataFrame([], "tree int, node string, idx bigint")
        out = done[0]
        for part in done[1:]:
            out = out.unionByName(part)
        return checkpointed(out)

    def transform(self, rows: DataFrame) -> DataFrame:
        """(idx, prediction): vote of the trees, ties to the smaller label; mean or median in regression."""
        leaves = self.route(rows).join(self.nodes.filter("is_leaf").select("tree", "node", "prediction"), ["tree", "node"])
        return forest_vote(leaves, self.config)

    def tree_stats(self) -> DataFrame:
        """Nodes, leaves, inner nodes, greatest and least depth of the leaves of each tree."""
        leaf = F.col("is_leaf")
        return self.nodes.groupBy("tree").agg(F.count("*").alias("n_nodes"), F.sum(leaf.cast("int")).alias("n_leaves"), F.sum((~leaf).cast("int")).alias("n_inner"), F.max("depth").alias("height"), F.min(F.when(leaf, F.col("depth"))).alias("least_depth"))

    def forest_stats(self) -> DataFrame:
        return self.tree_stats().agg(F.avg("n_nodes").alias("mean_nodes"), F.stddev_pop("n_nodes").alias("sd_nodes"), F.avg("height").alias("mean_height"), F.stddev_pop("height").alias("sd_height"))


def _multi(rows: DataFrame) -> bool:
    return isinstance(rows.schema["series"].dataType.elementType, T.ArrayType)


def forest_vote(leaves: DataFrame, config: ForestConfig) -> DataFrame:
    """(idx, prediction) from one leaf prediction per tree."""
    if config.task == "regression":
        value = F.avg("prediction") if config.regression_agg == "mean" else F.expr("percentile(prediction, 0.5)")
        return leaves.groupBy("idx").agg(value.alias("prediction"))
    votes = leaves.filter("prediction is not null").groupBy("idx", "prediction").agg(F.count("*").alias("n"))
    return votes.groupBy("idx").agg(F.min_by("prediction", F.struct(-F.col("n"), F.col("prediction"))).alias("prediction"))


def _params(cfg: ForestConfig, where: tuple[Column, ...], sigma: Column, longest: Column) -> Column:
    """Parameters of a candidate, in the order of PARAMS; w and delta come as whole numbers."""
    u = lambda name: uniform(cfg.seed, name, *where)
    from_grid = lambda grid, name: F.get(F.array(*[F.lit(float(v)) for v in grid]), F.floor(u(name) * len(grid)).cast("int"))
    band = F.floor(u("w") * ((longest + 1) / 4)).cast("double")
    spread = sigma * (0.2 + 0.8 * u("spread"))
    own = {
        "w": band, "g": F.when(F.col("measure").isin("erp", "erp_i"), spread).otherwise(u("g")), "c": from_grid(D.MSM_GRID, "c"),
        "nu": from_grid(D.TWE_NU, "nu"), "lam": from_grid(D.TWE_LAMBDA, "lam"), "epsilon": spread, "delta": band,
    }
    return F.array(*[own[p].cast("double") for p in D.PARAMS])


def fit(rows: DataFrame, config: ForestConfig | None = None) -> ForestModel:
    """Train a forest on (idx, series, label)."""
    cfg = config or ForestConfig()
    regression = cfg.task == "regression"
    for name in cfg.distances:
        D.get(name)
    if not _numeric(rows):
        raise ValueError("a forest needs series of numbers; give mixed entries numbers first")
    kind = {"gini": "variance", "entropy": "variance"}.get(cfg.purity, cfg.purity) if regression else cfg.purity
    train = checkpointed(rows.filter("idx is not null and series is not null and label is not null").select(F.col("idx").cast("bigint").alias("idx"), "series", F.col("label").cast("double" if regression else "string").alias("label")).dropDuplicates(["idx"]))
    multi, seed = _multi(train), cfg.seed
    pooled = any(D.get(n).name.removesuffix("_i") in ("erp", "lcss") for n in cfg.distances)
    flat = F.flatten("series") if multi else F.col("series")
    length = F.size(F.get("series", F.lit(0))) if multi else F.size("series")
    longest = train.agg(F.coalesce(F.max(length), F.lit(1)).alias("l")).first()["l"]
    state = bootstrap(train, cfg.n_trees, seed).join(train.select("idx", "label"), "idx").select("tree", F.lit("r").alias("node"), "idx", "mult", "oob", "label")
    state = checkpointed(state)
    nodes, exemplars, members, depth = [], [], [], 0
    began = time.monotonic()
    at = ["tree", "node"]
    while state.limit(1).count():
        bag = state.filter("not oob")
        if regression:
            pure = P.numeric_purity(bag, at, "label", kind, F.col("mult"))
            value = F.sum(F.col("mult") * F.col("label")) / F.sum("mult") if cfg.regression_agg == "mean" else F.expr("percentile(label, 0.5, mult)")
            leaf_value = bag.groupBy(*at).agg(value.cast("double").alias("prediction"))
        else:
            counts = P.class_counts(bag, at, "label", F.col("mult"))
            pure = P.class_purity(counts, at, kind)
            leaf_value = counts.groupBy(*at).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("prediction"))
        stats = checkpointed(pure.join(leaf_value, at))
        wide = F.col("purity") > cfg.purity_threshold
        grow = stats.filter(wide & (F.lit(cfg.max_depth) == 0) | wide & (F.lit(depth) < cfg.max_depth)).select(*at)
        active = bag.join(grow, at, "left_semi")
        # exemplars: one of each class, or two
        if regression:
            picks = [F.min_by("idx", F.struct(draw(seed, "ex", F.col("tree"), F.col("node"), c, b, F.col("idx")), F.col("idx"))).alias(f"{c}_{b}") for c in range(cfg.n_candidates) for b in (0, 1)]
            drawn = active.groupBy(*at).agg(*picks)
            drawn = drawn.select(*at, F.explode(F.array(*[F.struct(F.lit(c).alias("cand"), F.lit(b).alias("branch"), F.col(f"{c}_{b}").alias("eidx")) for c in range(cfg.n_candidates) for b in (0, 1)])).alias("e")).select(*at, "e.*")
        else:
            picks = [F.min_by("idx", F.struct(draw(seed, "ex", F.col("tree"), F.col("node"), c, F.col("label"), F.col("idx")), F.col("idx"))).alias(f"c{c}") for c in range(cfg.n_candidates)]
            drawn = active.groupBy(*at, "label").agg(*picks).withColumn("branch", F.row_number().over(Window.partitionBy(*at).orderBy("label")) - 1)
            drawn = drawn.select(*at, "branch", F.posexplode(F.array(*[f"c{c}" for c in range(cfg.n_candidates)])).alias("cand", "eidx"))
        drawn = drawn.join(train.select(F.col("idx").alias("eidx"), "series"), "eidx")
        sigma = P.pooled_deviation(active.join(train.select("idx", flat.alias("flat")), "idx"), at, "flat").select(*at, "sigma") if pooled else None
        where = (F.col("tree"),) if cfg.measure_scope == "tree" else (F.col("tree"), F.col("node"), F.col("cand"))
        pool = F.array(*[F.lit(D.get(n).name) for n in cfg.distances])
        sets = drawn.groupBy(*at, "cand").agg(F.collect_list(F.struct("branch", F.col("eidx").alias("idx"), "series")).alias("exemplars"), F.count("*").alias("k"))
        sets = sets.withColumn("measure", F.get(pool, (draw(seed, "measure", *where) % len(cfg.distances)).cast("int")))
        sets = sets.join(sigma, at, "left") if sigma is not None else sets.withColumn("sigma", F.lit(1.0))
        sets = sets.withColumn("params", _params(cfg, (F.col("tree"), F.col("node"), F.col("cand")), F.col("sigma"), F.lit(longest))).drop("sigma")
        sets = checkpointed(sets)
        by_node = broadcast_if_small(sets, MOST_BROADCAST)
        branch = _nearest(seed, cfg.distances)(F.concat_ws("|", "tree", "node", "cand"), "idx", "series", "measure", "params", "exemplars")

        def routed(some: DataFrame, by: DataFrame) -> DataFrame:
            # an explicit number of partitions: the rows are small, the work on them is not
            spread_out = some.join(train.select("idx", "series"), "idx").repartition(parallelism(rows.sparkSession), "tree", "idx")
            return checkpointed(spread_out.join(by, at).select(*at, "idx", "mult", "oob", "label", "cand", branch.alias("branch")))

        inside, of = routed(active, by_node), [*at, "cand", "branch"]
        children = P.numeric_purity(inside, of, "label", kind, F.col("mult")) if regression else P.class_purity(P.class_counts(inside, of, "label", F.col("mult")), of, kind)
        split = P.weighted_purity(children, [*at, "cand"]).join(sets.select(*at, "cand", "k"), [*at, "cand"]).filter("n_branches = k and k > 1")
        best = checkpointed(split.groupBy(*at).agg(F.min_by("cand", F.struct(F.round("weighted_purity", 12), "cand")).alias("cand")))
        chosen = sets.join(best, [*at, "cand"])
        # rows out of the bag have no say in the choice: they only meet the exemplars that were chosen
        outside = routed(state.filter("oob"), broadcast_if_small(chosen, MOST_BROADCAST))
        nodes.append(stats.join(chosen.select(*at, "measure", "params"), at, "left").select(*at, F.lit(depth).alias("depth"), F.col("measure").isNull().alias("is_leaf"), "prediction", F.col("n").cast("bigint").alias("n"), "purity", "measure", "params"))
        exemplars.append(chosen.select(*at, F.inline("exemplars")))
        members.append(state.join(best.select(*at), at, "left_anti").select(*at, "idx", "mult", "oob"))
        state = checkpointed(inside.join(best, [*at, "cand"]).unionByName(outside).select("tree", F.concat_ws(".", "node", F.col("branch").cast("string")).alias("node"), "idx", "mult", "oob", "label"))
        depth += 1
        LOG.info("forest of %d trees: level %d done after %.1f s", cfg.n_trees, depth, time.monotonic() - began)
    spark = rows.sparkSession
    value = "double" if regression else "string"
    kinds = (f"tree int, node string, depth int, is_leaf boolean, prediction {value}, n bigint, purity double, measure string, params array<double>", f"tree int, node string, branch int, idx bigint, series {train.schema['series'].dataType.simpleString()}", "tree int, node string, idx bigint, mult bigint, oob boolean")
    out = []
    for parts, schema in zip((nodes, exemplars, members), kinds, strict=True):
        whole = spark.createDataFrame([], schema)
        for part in parts:
            whole = whole.unionByName(part)
        out.append(checkpointed(whole))
    return ForestModel(cfg, *out, train)
