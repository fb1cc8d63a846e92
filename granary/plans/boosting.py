"""Quantile boosting on histograms for many keys, horizons and quantiles at once.

Rows are binned once into blocks: byte matrices of a bounded number of rows of one key, kept in the shared folder. A key whose
rows fit a task (TASK_ROWS, by count) is trained there, all trees of one of its horizons in one task, so a run over many keys
is one Spark job. A key with more rows stays where it is: tasks reduce their blocks to histograms and leaf summaries, Spark
adds those up, and only sums of a fixed size reach the driver, which picks the splits; scores are written with the blocks every
few trees, into one of two folders by turns. Both ways call the same functions of granary.operators.trees.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import columns as C
from granary.functions import constants as K
from granary.operators.splits import walk_forward_folds
from granary.operators.trees import (
    Rows, best_splits, boost, histogram, moved, pinball, roots, sampled, scores, summary)
from granary.session import durable, remove, scratch_path, shuffles_dropped, staged

#: Rows of one key and horizon that a task may train alone, at some 140 bytes each, Arrow's copy included.
TASK_ROWS = 7_000_000
#: Keys that share a run; what travels to tasks and driver grows with it: bin edges, and histograms of keys too large for a task.
MODELS_PER_RUN, LARGE_PER_RUN = 256, 16
BLOCK_ROWS = 16_384
#: Residuals a task sends for one leaf.
POINTS = 1024
#: A search grows few trees: up to so many are walked anew instead of writing the scores of all rows.
WALKED_TREES = 24
BROADCAST_LIMIT = 256 * 1024 * 1024


@dataclass(frozen=True)
class BoostParams:
    n_estimators: int = 200
    learning_rate: float = 0.05
    max_depth: int = 4
    min_samples_leaf: int = 10
    subsample: float = 0.8
    bins: int = 32
    random_state: int = 42
    quantiles: Sequence[float] = K.QUANTILES
    rewrite_every: int = 4

    def __post_init__(self):
        if not 2 <= self.bins <= 128:
            raise ValueError("bins must be between 2 and 128: twice a bin is stored in one byte")

    @property
    def nodes(self) -> int:
        """Heap slots of a tree: node i has children 2i and 2i+1, the root is 1."""
        return 2 ** (self.max_depth + 1)


@dataclass
class BoostModel:
    """Trees of every (key, horizon, quantile), indexed [model, slot, tree, node]."""

    keys: Sequence[str]
    key_values: list[tuple]
    features: Sequence[str]
    slots: list[tuple[str, float]]
    learning_rate: float
    start: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    losses: list[dict[tuple[int, int], float]] = field(default_factory=list)

    @property
    def n_trees(self) -> int:
        return self.feature.shape[2]

    def nbytes(self) -> int:
        return self.feature.nbytes + self.threshold.nbytes + self.value.nbytes

    def part(self, models: Sequence[int]) -> BoostModel:
        rows = list(models)
        return replace(self, key_values=[self.key_values[i] for i in rows], start=self.start[rows],
                       feature=self.feature[rows], threshold=self.threshold[rows], value=self.value[rows])

    def stump(self) -> BoostModel:
        """The model before its first tree that splits: every row gets its key's start value."""
        return replace(self, feature=np.full_like(self.feature[:, :, :1], -1), threshold=self.threshold[:, :, :1] * 0,
                       value=self.value[:, :, :1] * 0)

    def training_losses(self, model: int = 0) -> dict[tuple[str, float], list[float]]:
        """Mean pinball loss on all training rows after each tree."""
        return {slot: [round_[(model, s)] for round_ in self.losses if (model, s) in round_] for s, slot in enumerate(self.slots)}

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as rows: one per used node; tree -1 holds the start value, -2 the learning rate, -3 the features in order."""
        rows = []
        for m, s in itertools.product(range(len(self.key_values)), range(len(self.slots))):
            head = (*self.key_values[m], *self.slots[s])
            rows.append((*head, -1, 1, None, None, float(self.start[m, s])))
            rows.append((*head, -2, 1, None, None, float(self.learning_rate)))
            rows += [(*head, -3, i, name, None, None) for i, name in enumerate(self.features)]
            for t in range(self.n_trees):
                for node in _used_nodes(self.feature[m, s, t]):
                    f = int(self.feature[m, s, t, node])
                    rows.append((*head, t, node, self.features[f] if f >= 0 else None,
                                 float(self.threshold[m, s, t, node]) if f >= 0 else None,
                                 None if f >= 0 else float(self.value[m, s, t, node])))
        names = ", ".join(f"`{k}` string" for k in self.keys)
        return spark.createDataFrame(
            rows, f"{names}, horizon string, quantile double, tree int, node int, feature string, "
                  "threshold double, value double")

    @staticmethod
    def from_table(table: DataFrame, keys: Sequence[str]) -> BoostModel:
        """Read back a model table; its size is fixed by trees x nodes x models, not by the data."""
        everything = table.toPandas()
        rows = everything[everything["tree"] >= -1]
        order = everything[everything["tree"] == -3][["node", "feature"]].drop_duplicates().sort_values("node")
        features = list(order["feature"])
        learning_rate = float(everything.loc[everything["tree"] == -2, "value"].iloc[0])
        key_values = sorted(set(rows[list(keys)].itertuples(index=False, name=None)))
        slots = sorted(set(rows[["horizon", "quantile"]].itertuples(index=False, name=None)))
        shape = (len(key_values), len(slots), int(rows["tree"].max()) + 1, 2 * _power(int(rows["node"].max())))
        model = BoostModel(keys, key_values, features, slots, learning_rate,
                           np.zeros(shape[:2]), np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape))
        at_key = {k: i for i, k in enumerate(key_values)}
        at_slot = {s: i for i, s in enumerate(slots)}
        at_feature = {f: i for i, f in enumerate(features)}
        for row in rows.to_dict("records"):
            m, s = at_key[tuple(row[k] for k in keys)], at_slot[(row["horizon"], row["quantile"])]
            if row["tree"] < 0:
                model.start[m, s] = row["value"]
            elif isinstance(row["feature"], str):
                model.feature[m, s, row["tree"], row["node"]] = at_feature[row["feature"]]
                model.threshold[m, s, row["tree"], row["node"]] = row["threshold"]
            else:
                model.value[m, s, row["tree"], row["node"]] = row["value"]
        return model


def _power(n: int) -> int:
    return 1 << max(n, 1).bit_length() - 1


def _used_nodes(feature: np.ndarray) -> Iterator[int]:
    open_nodes = [1]
    while open_nodes:
        node = open_nodes.pop(0)
        yield node
        if feature[node] >= 0:
            open_nodes += [2 * node, 2 * node + 1]


# --- training -----------------------------------------------------------------------------------

def train(df: DataFrame, targets: dict[str, str], features: Sequence[str] = K.FEATURES,
          keys: Sequence[str] = ("commodity",), row_key: Sequence[str] = ("mandi_id", "date"),
          params: BoostParams = BoostParams()) -> BoostModel:
    """One model per (keys, horizon, quantile); `targets` maps a horizon name to its target column.

    Rows miss a target where it is NULL; NULL features count as 0. `row_key` makes the subsample repeatable. `df` is read twice, for
    the sketches and for the blocks: hand in stored rows, no copy is made of them.
    """
    features, horizons, keys = [f for f in features if f in df.columns], list(targets), list(keys)
    kept = _kept(df, targets, features, keys, row_key)
    groups = _sketches(kept, features, horizons, keys, params)
    if not groups:
        raise ValueError("no rows with a target")
    return _join_parts([
        _train_run(kept, groups[begin:begin + MODELS_PER_RUN], features, horizons, keys, params)
        for begin in range(0, len(groups), MODELS_PER_RUN)])


def _kept(df: DataFrame, targets: dict[str, str], features: Sequence[str], keys: Sequence[str], row_key: Sequence[str],
          time: Column | None = None) -> DataFrame:
    """Rows with a target: keys as text, x_ features, y_ targets, a hash of the row key and a month number."""
    has_target = F.lit(False)
    for t in targets.values():
        has_target = has_target | F.col(t).isNotNull()
    for k in keys:
        has_target = has_target & F.col(k).isNotNull()
    return df.where(has_target).select(
        *[F.col(k).cast("string").alias(k) for k in keys],
        *[F.coalesce(C.number(f), F.lit(0.0)).alias(f"x_{f}") for f in features],
        *[C.number(t).alias(f"y_{h}") for h, t in targets.items()],
        F.xxhash64(*keys, *[k for k in row_key if k in df.columns]).alias("row"),
        (F.lit(0) if time is None else time).cast("int").alias("time"))


def _join_parts(parts: list[BoostModel]) -> BoostModel:
    first = parts[0]
    if len(parts) == 1:
        return first
    losses, offset = [{} for _ in first.losses], 0
    for p in parts:
        for round_, mine in zip(losses, p.losses):
            round_.update({(m + offset, s): v for (m, s), v in mine.items()})
        offset += len(p.key_values)
    return replace(
        first, key_values=[k for p in parts for k in p.key_values], losses=losses,
        **{name: np.concatenate([getattr(p, name) for p in parts])
           for name in ("start", "feature", "threshold", "value")})


def _sketches(kept: DataFrame, features: list[str], horizons: list[str], keys: list[str], params: BoostParams) -> list:
    """One row per model: its keys, the quantile sketch of every feature, start value and number of rows of every slot."""
    shares = F.array(*[F.lit(i / params.bins) for i in range(1, params.bins)])
    levels = F.array(*[F.lit(float(q)) for q in params.quantiles])
    return sorted(kept.groupBy(*keys).agg(
        *[F.percentile_approx(f"x_{f}", shares, F.lit(1000)).alias(f"x_{f}") for f in features],
        *[F.percentile_approx(f"y_{h}", levels, F.lit(10_000)).alias(f"y_{h}") for h in horizons],
        *[F.count(f"y_{h}").alias(f"n_{h}") for h in horizons]).collect(),
        key=lambda row: tuple(row[k] for k in keys))


def _edges_and_start(sketches: list, features: list[str], horizons: list[str], params: BoostParams):
    """Bin edges [model, feature, bin] and start values [model, slot]; missing edges are infinite."""
    edges = np.full((len(sketches), len(features), params.bins - 1), np.inf)
    start = np.zeros((len(sketches), len(horizons) * len(params.quantiles)))
    for m, row in enumerate(sketches):
        for i, f in enumerate(features):
            distinct = np.unique(row[f"x_{f}"])
            edges[m, i, :len(distinct)] = distinct
        start[m] = [v for h in horizons for v in (row[f"y_{h}"] or [0.0] * len(params.quantiles))]
    return edges, start


def _blocks(kept: DataFrame, sketches: list, features: list[str], horizons: list[str], keys: list[str],
            edges: np.ndarray) -> DataFrame:
    """The rows of the sketched models as blocks: model, bins, row, time and one y_ per horizon, as bytes."""
    index = kept.sparkSession.createDataFrame(
        [(*[row[k] for k in keys], i) for i, row in enumerate(sketches)], ", ".join(f"`{k}` string" for k in keys) + ", model int")
    names = ["model", *[f"x_{f}" for f in features], "row", "time", *[f"y_{h}" for h in horizons]]
    n_features = len(features)
    schema = ", ".join(["model int", "bins binary", "row binary", "time binary", *[f"y_{h} binary" for h in horizons]])
    fields = ["model", "bins", "row", "time", *[f"y_{h}" for h in horizons]]

    def block(m: int, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(p, axis=-1) for p in zip(*parts)]
        return pa.RecordBatch.from_arrays(
            [pa.array([m], pa.int32()), *[pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns]], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for m in np.unique(columns[0]).tolist():
                mine = np.flatnonzero(columns[0] == m)
                bins = np.stack([2 * np.searchsorted(edges[m, i], columns[1 + i][mine], side="left")
                                 for i in range(n_features)]) if n_features else np.zeros((0, len(mine)))
                part = [bins.astype(np.uint8), *[c[mine] for c in columns[1 + n_features:]]]
                parts = waiting.setdefault(m, [])
                parts.append(part)
                if sum(len(p[1]) for p in parts) >= BLOCK_ROWS:
                    yield block(m, waiting.pop(m))
        for m, parts in waiting.items():
            yield block(m, parts)

    return kept.join(index, keys).select(*names).mapInArrow(run, schema)


def _array(value: bytes, kind: type, lines: int | None = None) -> np.ndarray:
    flat = np.frombuffer(value, kind)
    return flat if lines is None else flat.reshape(lines, -1)


def _gather(table: pa.Table, n_features: int) -> Rows:
    """All blocks (bins, row, time, y) of a table as one, without rows that have no target."""
    def column(name: str, kind: type) -> list[np.ndarray]:
        return [_array(value.as_buffer(), kind) for value in table.column(name)]

    known = [~np.isnan(y) for y in column("y", float)]
    ends = np.cumsum([0, *[np.count_nonzero(k) for k in known]])
    rows = Rows(*[np.empty(shape, kind) for shape, kind in (
        ((n_features, ends[-1]), np.uint8), (ends[-1], float), (ends[-1], np.int64), (ends[-1], np.int32))])
    # Filled block by block: next to Arrow's own copy there is one more, not one for each step.
    for name, kind, into in (("bins", np.uint8, rows.bins), ("y", float, rows.y), ("row", np.int64, rows.row), ("time", np.int32, rows.time)):
        for flat, k, begin, end in zip(column(name, kind), known, ends, ends[1:]):
            into[..., begin:end] = flat.reshape(*into.shape[:-1], len(k))[..., k]
    return rows


def _in_tasks(blocks: DataFrame, models: Sequence[int], horizons: Sequence[str], run: Callable[[pa.Table], pa.Table],
              schema: str) -> DataFrame:
    """`run` on the blocks of each of the models and each horizon, with only its y, every pair of them in a task of its own.

    Tasks go in the order of the models: the largest first, so that none of them is waited for at the end.
    """
    at = F.create_map(*[F.lit(x) for i, m in enumerate(models) for x in (m, i)])[F.col("model")]
    tall = blocks.where(F.col("model").isin(list(models))).select(
        "model", F.posexplode(F.array(*[F.col(f"y_{h}") for h in horizons])).alias("horizon", "y"), "bins", "row", "time",
        (at * len(horizons)).alias("_task"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from run(pa.Table.from_batches(held).drop_columns(["_task"])).to_batches()

    task = (F.col("_task") + F.col("horizon")).cast("int")
    return tall.withColumn("_task", task).repartitionById(len(models) * len(horizons), F.col("_task")).mapInArrow(whole, schema)


def _train_run(kept: DataFrame, sketches: list, features: list[str], horizons: list[str], keys: list[str],
               params: BoostParams) -> BoostModel:
    model, cuts, edges = _empty_model(sketches, features, horizons, keys, params)
    large, small = _by_size(sketches, horizons)
    with staged(_blocks(kept, sketches, features, horizons, keys, edges), "blocks") as blocks:
        if small:
            _train_in_tasks(blocks, small, model, cuts, horizons, params)
        for begin in range(0, len(large), LARGE_PER_RUN):
            _Spread(blocks, large[begin:begin + LARGE_PER_RUN], model, cuts, horizons, params).train()
    for m, f in itertools.product(range(len(sketches)), range(len(features))):
        at = model.feature[m] == f
        model.threshold[m][at] = edges[m, f][cuts[m][at]]
    return model


def _empty_model(sketches: list, features: list[str], horizons: list[str], keys: list[str], params: BoostParams):
    """A model without trees, its cuts as numbers of bins, and the bin edges."""
    edges, start = _edges_and_start(sketches, features, horizons, params)
    slots = [(h, q) for h in horizons for q in params.quantiles]
    shape = (len(sketches), len(slots), params.n_estimators, params.nodes)
    model = BoostModel(keys, [tuple(row[k] for k in keys) for row in sketches], features, slots, params.learning_rate, start,
                       np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape),
                       [{} for _ in range(params.n_estimators)])
    return model, np.zeros(shape, np.int64), edges


def _by_size(sketches: list, horizons: list[str]) -> tuple[list[int], list[int]]:
    """The models with more rows than a task takes, and the others; the largest first. Both ways of training give the same trees."""
    rows = [max(row[f"n_{h}"] for h in horizons) for row in sketches]
    order = sorted(range(len(rows)), key=lambda m: -rows[m])
    return [m for m in order if rows[m] > TASK_ROWS], [m for m in order if rows[m] <= TASK_ROWS]


def _train_in_tasks(blocks: DataFrame, models: list[int], model: BoostModel, cuts: np.ndarray, horizons: list[str],
                    params: BoostParams) -> None:
    """Each (model, horizon) in a task of its own; fills the trees of the given models."""
    n_features, per = len(model.features), len(params.quantiles)

    def run(table: pa.Table) -> pa.Table:
        rows = _gather(table, n_features)
        m, h = table.column("model")[0].as_py(), table.column("horizon")[0].as_py()
        made = []
        for i, q in enumerate(params.quantiles):
            first, *trees = boost(rows, q, params.bins, params.n_estimators, params.learning_rate, params.max_depth,
                                  max(params.min_samples_leaf, 1), params.subsample, params.random_state)
            made.append((m, h * per + i, first, len(rows.y), *[a.tobytes() for a in trees]))
        return pa.Table.from_arrays([pa.array(c) for c in zip(*made)], ["model", "slot", "start", "n", *parts])

    parts = ("feature", "cut", "value", "losses")
    schema = "model long, slot long, start double, n long, " + ", ".join(f"{p} binary" for p in parts)
    with shuffles_dropped(blocks.sparkSession):
        found = _in_tasks(blocks, models, horizons, run, schema).collect()
    for row in found:
        at, nodes = (row["model"], row["slot"]), params.nodes
        if row["n"]:
            model.start[at] = row["start"]
            for target, name, kind in ((model.feature, "feature", np.int32), (cuts, "cut", np.int64), (model.value, "value", float)):
                target[at] = _array(row[name], kind).reshape(-1, nodes)
            for t, loss in enumerate(_array(row["losses"], float)):
                model.losses[t][at] = float(loss)


class _Spread:
    """Models with more rows than a task takes: blocks stay in place and are reduced to sums, level by level.

    With `until`, rows of that month and later ones are left out.
    """

    def __init__(self, blocks: DataFrame, models: list[int], model: BoostModel, cuts: np.ndarray, horizons: list[str],
                 params: BoostParams, until: int | None = None):
        self.model, self.cuts, self.models, self.horizons, self.params = model, cuts, models, horizons, params
        self.slots, self.until = len(model.slots), until
        self.place, self.written, self.stored = scratch_path(blocks.sparkSession, "scored"), 0, 0
        self.blocks = self.given = blocks.where(F.col("model").isin(models))

    def rewrite(self, df: DataFrame) -> None:
        """Write the blocks to a folder of their own and delete that of the last time."""
        path = f"{self.place}/{self.written}"
        df.write.parquet(path)
        self.blocks = df.sparkSession.read.schema(df.schema).parquet(path)
        if self.written:
            remove(df.sparkSession, f"{self.place}/{self.written - 1}")
        self.written += 1

    def walker(self, tree: int, depth: int):
        """A function from a block to (slot, rows, score, node) of each slot: scores before a tree, nodes at a depth of it."""
        at = {m: (self.model.start[m].copy(), self.model.feature[m, :, self.stored:tree + 1], self.cuts[m, :, self.stored:tree + 1],
                  self.model.value[m, :, self.stored:tree]) for m in self.models}
        n_features, per, rate, horizons = len(self.model.features), len(self.params.quantiles), self.params.learning_rate, self.horizons
        n_slots, full, until = self.slots, self.params.max_depth, self.until

        def walk(block: dict):
            start, feature, cut, value = at[block["model"]]
            row, time = _array(block["row"], np.int64), _array(block["time"], np.int32)
            bins, held = _array(block["bins"], np.uint8).reshape(n_features, len(row)), block.get("score")
            for slot in range(n_slots):
                y = _array(block[f"y_{horizons[slot // per]}"], float)
                rows = Rows(bins, y if until is None else np.where(time < until, y, np.nan), row, time)
                total = np.full(len(row), start[slot]) if held is None else _array(held, float, n_slots)[slot].copy()
                for t in range(value.shape[1]):
                    node = roots(len(row), full)
                    for level in range(full):
                        node = moved(bins, node, feature[slot, t], 2 * cut[slot, t], level)
                    total += rate * value[slot, t][node]
                node = roots(len(row), full)
                for level in range(depth):
                    node = moved(bins, node, feature[slot, -1], 2 * cut[slot, -1], level)
                yield slot, rows, total, node

        return walk

    def reduced(self, tree: int, depth: int, per_block: Callable, merge: Callable, finish: Callable) -> list:
        """Sums over all blocks: per_block gives (slot, node, arrays), merge joins two tuples of arrays, finish makes the last.

        Tasks join what they find, and the parts of one (model, slot, node) meet after one exchange of fixed-size rows.
        """
        walk = self.walker(tree, depth)
        schema = "model int, slot int, node int, parts array<binary>"

        def emit(held: dict, last: Callable) -> Iterator[pa.RecordBatch]:
            if held:
                columns = list(zip(*[(*key, [np.ascontiguousarray(a).tobytes() for a in last(key, parts)]) for key, parts in held.items()]))
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, pa.int32()) for c in columns[:3]], pa.array(columns[3], pa.list_(pa.binary()))],
                    ["model", "slot", "node", "parts"])

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for batch in batches:
                for block in batch.to_pylist():
                    for slot, node, parts in per_block(block, walk(block)):
                        key = (block["model"], slot, node)
                        held[key] = merge(held[key], parts) if key in held else parts
            yield from emit(held, lambda key, parts: merge.sent(parts))

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for batch in batches:
                for r in batch.to_pylist():
                    key, parts = (r["model"], r["slot"], r["node"]), merge.read(r["parts"])
                    held[key] = merge(held[key], parts) if key in held else parts
            yield from emit(held, finish)

        found = self.blocks.mapInArrow(local, schema).repartition("model", "slot", "node").mapInArrow(joined, schema)
        with shuffles_dropped(found.sparkSession):
            return [((r["model"], r["slot"], r["node"]), r["parts"]) for r in found.toArrow().to_pylist()]

    def histograms(self, tree: int, level: int, wanted: dict[tuple[int, int], np.ndarray]) -> dict:
        """Histogram of each wanted node, {(model, slot): nodes}, at a level of the growing tree."""
        params, shape = self.params, (len(self.model.features), self.params.bins, 2)

        def per_block(block: dict, slots):
            for slot, rows, score, node in slots:
                nodes = wanted.get((block["model"], slot))
                if nodes is None:
                    continue
                place = np.full(params.nodes, len(nodes))
                place[nodes] = np.arange(len(nodes))
                use = sampled(rows.row, params.subsample, params.random_state, tree) & ~np.isnan(rows.y)
                rows_at = np.where(use, place[node], len(nodes))
                hist = histogram(rows.bins, rows_at, rows.y > score, len(nodes) + 1, params.bins)
                yield from ((slot, int(n), (hist[i],)) for i, n in enumerate(nodes))

        got = self.reduced(tree, level, per_block, _Sum(np.int64), lambda key, parts: parts)
        return {key: _array(parts[0], np.int64).reshape(shape) for key, parts in got}

    def quantiles(self, tree: int, depth: int, share: float) -> dict[tuple[int, int, int], float]:
        """The exact lower_quantile of what rows of each node miss their score by, of that share of the rows.

        Values travel as summaries of at most POINTS of them, whose ranks are known within a bound. What the bound leaves
        between two values is read again, until all of it travels: 35,000,000 rows take three or four passes.
        """
        params, levels = self.params, [q for _, q in self.model.slots]
        found: dict[tuple[int, int, int], float] = {}
        between: dict[tuple[int, int, int], tuple] | None = None
        while between is None or between:
            searched = between

            def per_block(block: dict, slots):
                for slot, rows, score, node in slots:
                    use = ~np.isnan(rows.y)
                    if share < 1:
                        use &= sampled(rows.row, share, params.random_state, tree)
                    miss, at = (rows.y - score)[use], node[use]
                    for leaf in np.unique(at).tolist():
                        values, low, high = miss[at == leaf], None, None
                        if searched is not None:
                            if (block["model"], slot, leaf) not in searched:
                                continue
                            low, high = searched[block["model"], slot, leaf]
                        n, less = len(values), 0
                        if low is not None:
                            less = np.count_nonzero(values <= low)
                            values = values[values > low]
                        if high is not None:
                            values = values[values <= high]
                        yield slot, leaf, (*np.unique(values, return_counts=True), np.array([n, less, 0], np.int64))

            def finish(key: tuple, parts: tuple) -> tuple:
                values, weights, (n, less, off) = parts
                rank = max(math.ceil(levels[key[1]] * n - 1e-9), 1) - less
                upto = np.cumsum(weights)
                if not off:
                    return (values[np.searchsorted(upto, rank)][None],)
                low, high = np.flatnonzero(upto + off < rank), np.flatnonzero(upto - off >= rank)
                return values[low[-1:]], values[high[:1]]

            between = {}
            for key, parts in self.reduced(tree, depth, per_block, _Ranked(), finish):
                ends = [_array(p, float) for p in parts]
                if len(ends) == 1:
                    found[key] = float(ends[0][0])
                else:
                    low, high = (float(e[0]) if len(e) else None for e in ends)
                    was = (searched or {}).get(key, (None, None))
                    between[key] = (was[0] if low is None else low, was[1] if high is None else high)
        return found

    def spent(self, tree: int) -> dict[tuple[int, int], np.ndarray]:
        """Rows and the sum of their losses before a tree."""
        levels = [q for _, q in self.model.slots]

        def per_block(block: dict, slots):
            for slot, rows, score, _ in slots:
                loss = pinball(rows.y - score, levels[slot])[~np.isnan(rows.y)]
                yield slot, 1, (np.array([len(loss), loss.sum()]),)

        return {key[:2]: _array(parts[0], float) for key, parts in self.reduced(tree, 0, per_block, _Sum(float), lambda key, parts: parts)}

    def split(self, tree: int, hists: dict) -> dict[tuple[int, int], np.ndarray]:
        """Sets the best cuts of nodes by their histograms; per (model, slot) the smaller children, which are counted next."""
        counted: dict[tuple[int, int], list[int]] = {}
        keys = sorted(hists)
        if not keys:
            return {}
        q = np.array([self.model.slots[s][1] for _, s, _ in keys])
        found = best_splits(np.stack([hists[k] for k in keys]), q, max(self.params.min_samples_leaf, 1))
        for (m, s, node), feature, cut, left_smaller in zip(keys, *found):
            if feature >= 0:
                self.model.feature[m, s, tree, node], self.cuts[m, s, tree, node] = feature, cut
                counted.setdefault((m, s), []).append(2 * node + (not left_smaller))
        return {pair: np.array(nodes) for pair, nodes in counted.items()}

    def note_losses(self, tree: int) -> None:
        for at, (n, spent) in self.spent(tree + 1).items():
            if n:
                self.model.losses[tree][at] = float(spent / n)

    def train(self, watched: bool = True) -> None:
        params, model = self.params, self.model
        model.start[self.models] = 0.0
        for (m, s, _), value in self.quantiles(0, 0, 1.0).items():
            model.start[m, s] = value
        for t in range(params.n_estimators):
            counted = {pair: np.array([1]) for pair in itertools.product(self.models, range(self.slots))}
            parents: dict = {}
            for level in range(params.max_depth):
                hists = self.histograms(t, level, counted)
                # a child that was not counted is what the other one leaves of the parent
                hists |= {(m, s, node ^ 1): parents[m, s, node // 2] - h for (m, s, node), h in hists.items() if node > 1}
                counted = self.split(t, hists)
                if not counted:
                    break
                parents = hists
            for (m, s, node), value in self.quantiles(t, params.max_depth, params.subsample).items():
                model.value[m, s, t, node] = value
            if watched:
                self.note_losses(t)
            if t + 1 - self.stored == params.rewrite_every and t + 1 < params.n_estimators:
                self.rescore(t + 1)
        if self.written:
            self.blocks = self.given
            remove(self.given.sparkSession, self.place)

    def tried(self, counts: Sequence[int], until: int, end: int) -> dict[tuple[int, int, int], np.ndarray]:
        """After training: [rows trained on, rows from `until` to before `end`, their losses] of each (model, slot, n), n an index of
        `counts` of trees."""
        at = {m: (self.model.start[m], self.model.feature[m], self.cuts[m], self.model.value[m]) for m in self.models}
        n_features, per, rate, horizons, slots = (
            len(self.model.features), len(self.params.quantiles), self.params.learning_rate, self.horizons, self.model.slots)

        def per_block(block: dict, _):
            start, feature, cut, value = at[block["model"]]
            time = _array(block["time"], np.int32)
            next_ = (time >= until) & (time < end)
            bins = _array(block["bins"], np.uint8).reshape(n_features, len(time))[:, next_]
            for slot, (_, q) in enumerate(slots):
                y = _array(block[f"y_{horizons[slot // per]}"], float)
                past, y = np.count_nonzero(~np.isnan(y[time < until])), y[next_]
                known = ~np.isnan(y)
                for i, n in enumerate(counts):
                    said = scores(bins, start[slot], rate, feature[slot, :n], cut[slot, :n], value[slot, :n])
                    yield slot, i, (np.array([past, known.sum(), pinball(y - said, q)[known].sum()]),)

        return {key: _array(parts[0], float) for key, parts in self.reduced(0, 0, per_block, _Sum(float), lambda key, parts: parts)}

    def rescore(self, tree: int) -> None:
        walk, names = self.walker(tree, 0), [c for c in self.blocks.columns if c != "score"]
        kinds = {f.name: f.dataType.simpleString() for f in self.blocks.schema}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = [np.concatenate([total for _, _, total, _ in walk(block)]).tobytes() for block in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(score, pa.binary())], [*names, "score"])

        self.rewrite(self.blocks.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", score binary"))
        self.stored = tree


class _Sum:
    """Adds up arrays of one length."""

    def __init__(self, kind: type):
        self.kind = kind

    def read(self, parts: list[bytes]) -> tuple:
        return tuple(_array(p, self.kind) for p in parts)

    def sent(self, parts: tuple) -> tuple:
        return parts

    def __call__(self, a: tuple, b: tuple) -> tuple:
        return tuple(x + y for x, y in zip(a, b))


class _Ranked:
    """Joins (values in order, weights, [rows, rows below, by how many ranks a value may be off]); up to HELD values are kept."""

    HELD = 16 * POINTS

    def read(self, parts: list[bytes]) -> tuple:
        return _array(parts[0], float), _array(parts[1], np.int64), _array(parts[2], np.int64)

    def cut(self, values: np.ndarray, weights: np.ndarray, counts: np.ndarray, most: int, points: int) -> tuple:
        if len(values) <= most:
            return values, weights, counts
        values, kept = summary(values, weights, points)
        return values, kept, counts + np.array([0, 0, int(weights.sum()) // (2 * points) + 2])

    def sent(self, parts: tuple) -> tuple:
        return self.cut(*parts, POINTS, POINTS)

    def __call__(self, a: tuple, b: tuple) -> tuple:
        values, at = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
        weights = np.zeros(len(values), np.int64)
        np.add.at(weights, at, np.concatenate((a[1], b[1])))
        return self.cut(values, weights, a[2] + b[2], self.HELD, self.HELD // 2)


# --- use ----------------------------------------------------------------------------------------

def predict(df: DataFrame, model: BoostModel | None, sort: bool = True) -> DataFrame:
    """Adds q<quantile>_<horizon> columns; NULL for keys without a model.

    The trees travel to the tasks while they fit a fixed size, else the keys are served in parts that do.
    """
    if model is None or model.n_trees == 0:
        raise RuntimeError("the model has not been fitted")
    per_model = max(model.nbytes() // len(model.key_values), 1)
    size = max(int(BROADCAST_LIMIT // per_model), 1)
    if len(model.key_values) <= size:
        return _predict_part(df, model, sort)
    index = df.sparkSession.createDataFrame(
        [(*k, i // size) for i, k in enumerate(model.key_values)],
        ", ".join(f"`{k}` string" for k in model.keys) + ", _part int")
    tagged = df.join(index, list(model.keys), "left").withColumn("_part", F.coalesce("_part", F.lit(0)))
    frames = [
        _predict_part(tagged.where(F.col("_part") == i).drop("_part"),
                      model.part(range(i * size, min((i + 1) * size, len(model.key_values)))), sort)
        for i in range(math.ceil(len(model.key_values) / size))]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _predict_part(df: DataFrame, model: BoostModel, sort: bool) -> DataFrame:
    depth = int(math.log2(model.feature.shape[3])) - 1
    slots, model_width = model.slots, len(model.features)
    shared = df.sparkSession.sparkContext.broadcast(
        (model.feature, model.threshold, model.value, model.start, model.learning_rate))

    @F.pandas_udf("array<double>")
    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        feature, threshold, value, start, rate = shared.value
        for which, inputs in frames:
            out = np.full((len(which), len(slots)), np.nan)
            for m in which.dropna().unique().astype(int).tolist():
                mine = np.flatnonzero(which == m)
                x = np.zeros((max(model_width, 1), len(mine)))
                if model_width:
                    x[:] = np.stack(inputs.iloc[mine].to_numpy(), axis=1)
                for s in range(len(slots)):
                    total = np.full(len(mine), start[m, s])
                    for f, cut, leaf in zip(feature[m, s], threshold[m, s], value[m, s]):
                        node = roots(len(mine), depth)
                        for level in range(depth):
                            node = moved(x, node, f, cut, level)
                        total += (rate * leaf)[node]
                    out[mine, s] = total
            yield pd.Series([None if np.isnan(row[0]) else row for row in out])

    pairs = [F.lit(x) for i, k in enumerate(model.key_values) for x in ("\x1f".join(map(str, k)), i)]
    key = F.concat_ws("\x1f", *[F.col(k).cast("string") for k in model.keys])
    which = F.try_element_at(F.create_map(*pairs), key)
    inputs = F.array(*[F.coalesce(C.number(f), F.lit(0.0)) if f in df.columns else F.lit(0.0)
                       for f in model.features])
    out = df.withColumn("_p", run(which, inputs))
    horizons = list(dict.fromkeys(h for h, _ in slots))
    made = {}
    for h in horizons:
        mine = sorted((q, i) for i, (horizon, q) in enumerate(slots) if horizon == h)
        values = F.array(*[F.col("_p")[i] for _, i in mine])
        ordered = F.sort_array(values) if sort else values
        for rank, (q, _) in enumerate(mine):
            made[f"q{round(q * 100):02d}_{h}"] = F.when(F.col("_p").isNotNull(), ordered[rank])
    return out.withColumns(made).drop("_p")


def predict_quantile(df: DataFrame, model: BoostModel, horizon: str, quantile: float) -> DataFrame:
    if (horizon, quantile) not in model.slots:
        raise ValueError(f"quantile {quantile} of {horizon} was not trained")
    return predict(df, model, sort=False)


# --- search -------------------------------------------------------------------------------------

def fold_bounds(df: DataFrame, min_train_months: int = 6, val_months: int = 1) -> list[tuple[int, int]]:
    """(until, end) of each fold in months since year 0: it trains before `until` and is tried from there to before `end`."""
    folds = walk_forward_folds(df, min_train_months, val_months).where("role = 'val'")
    month = F.year("month_start") * 12 + F.month("month_start") - 1
    return [(r["lo"], r["hi"] + 1) for r in folds.groupBy("fold").agg(F.min(month).alias("lo"), F.max(month).alias("hi"))
            .orderBy("fold").collect()]


def search_folds(df: DataFrame, targets: dict[str, str], draws: Sequence[BoostParams], bounds: Sequence[tuple[int, int]],
                 features: Sequence[str] = K.FEATURES, keys: Sequence[str] = ("commodity",),
                 row_key: Sequence[str] = ("mandi_id", "date")) -> DataFrame:
    """Per key, draw, fold, horizon and quantile: rows trained on, rows tried on and the sum of their pinball losses.

    All draws and folds read the same blocks: a fold is a bound on the month of a row, checked inside the task, and no row is
    copied. A fold without rows to train or to try has no row. Keys with more rows than a task takes train fold by fold, spread
    over the cluster, on those blocks too. `df` is read twice: hand in stored rows.
    """
    features, horizons, keys = [f for f in features if f in df.columns], list(targets), list(keys)
    month = F.year("date") * 12 + F.month("date") - 1
    kept = _kept(df, targets, features, keys, row_key, month).where(F.col("time").isNotNull())  # rows without a date are in no fold
    schema = (", ".join(f"`{k}` string" for k in keys)
              + ", draw int, fold int, horizon string, quantile double, n_train long, n_val long, loss double")
    made = []
    for bins in sorted({p.bins for p in draws}):
        mine = [(i, p) for i, p in enumerate(draws) if p.bins == bins]
        sketches = _sketches(kept, features, horizons, keys, mine[0][1])
        for begin in range(0, len(sketches), MODELS_PER_RUN):
            run = sketches[begin:begin + MODELS_PER_RUN]
            groups = [tuple(row[k] for k in keys) for row in run]
            large, small = _by_size(run, horizons)
            edges, _ = _edges_and_start(run, features, horizons, mine[0][1])
            with staged(_blocks(kept, run, features, horizons, keys, edges), "blocks") as blocks:
                if small:
                    tried = _tried(groups, mine, bounds, horizons, len(features), keys)
                    made.append(durable(_in_tasks(blocks, small, horizons, tried, schema), "tried"))
                for first in range(0, len(large), LARGE_PER_RUN):
                    rows = _tried_spread(blocks, large[first:first + LARGE_PER_RUN], run, mine, bounds, features, horizons, keys)
                    made.append(df.sparkSession.createDataFrame(rows, schema))
    if not made:
        return df.sparkSession.createDataFrame([], schema)
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def _alike(draws: list) -> list[list]:
    """Draws that differ in the number of trees alone, together."""
    alike: list[list] = []
    for draw in draws:
        kin = [a for a in alike if replace(a[0][1], n_estimators=draw[1].n_estimators) == draw[1]]
        kin[0].append(draw) if kin else alike.append([draw])
    return alike


def _tried(groups: list[tuple], draws: list, bounds: Sequence[tuple[int, int]], horizons: list[str], n_features: int,
           keys: list[str]):
    """What a task does with the rows of one key and horizon: every draw on every fold.

    Rows go in order of time, so a fold is a view of them. Draws that differ in the number of trees alone share their trees.
    """
    alike = _alike(draws)

    def run(table: pa.Table) -> pa.Table:
        rows = _gather(table, n_features).by_time()
        key, h = groups[table.column("model")[0].as_py()], table.column("horizon")[0].as_py()
        made = []
        for kin, (fold, (until, end)) in itertools.product(alike, enumerate(bounds)):
            cuts = np.searchsorted(rows.time, [until, max(until, end)]).tolist()
            past, next_ = rows.between(0, cuts[0]), rows.between(*cuts)
            if not len(past.y) or not len(next_.y):
                continue
            p = max((p for _, p in kin), key=lambda p: p.n_estimators)
            for q in p.quantiles:
                start, *trees, _ = boost(past, q, p.bins, p.n_estimators, p.learning_rate, p.max_depth,
                                         max(p.min_samples_leaf, 1), p.subsample, p.random_state, watched=False)
                for i, own in kin:
                    said = scores(next_.bins, start, p.learning_rate, *[t[:own.n_estimators] for t in trees])
                    loss = pinball(next_.y - said, q)
                    made.append((*key, i, fold + 1, horizons[h], q, len(past.y), len(next_.y), float(loss.sum())))
        width = len(groups[0])
        kinds = [*[pa.string()] * width, pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
        columns = list(zip(*made)) or [[]] * len(kinds)
        names = [*keys, "draw", "fold", "horizon", "quantile", "n_train", "n_val", "loss"]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
    return run


def _tried_spread(blocks: DataFrame, models: list[int], sketches: list, draws: list, bounds: Sequence[tuple[int, int]],
                  features: list[str], horizons: list[str], keys: list[str]) -> list[tuple]:
    """The rows that `_tried` gives, of models too large for a task: each fold trains on the same blocks, within its months."""
    made = []
    for kin, (fold, (until, end)) in itertools.product(_alike(draws), enumerate(bounds)):
        p = max((p for _, p in kin), key=lambda p: p.n_estimators)
        model, cuts, _ = _empty_model(sketches, features, horizons, keys, p)
        spread = _Spread(blocks, models, model, cuts, horizons, replace(p, rewrite_every=max(p.rewrite_every, WALKED_TREES)), until)
        spread.train(watched=False)
        found = spread.tried([own.n_estimators for _, own in kin], until, end)
        for (m, slot, i), (n_train, n_val, loss) in found.items():
            if n_train and n_val:
                made.append((*model.key_values[m], kin[i][0], fold + 1, *model.slots[slot], int(n_train), int(n_val), float(loss)))
    return made


def random_search(df: DataFrame, targets: dict[str, str], grid: dict[str, Sequence], tries: int,
                  features: Sequence[str] = K.FEATURES, keys: Sequence[str] = ("commodity",),
                  min_train_months: int = 6, val_months: int = 1, seed: int = 42,
                  base: BoostParams = BoostParams()) -> list[tuple[BoostParams, float]]:
    """Parameter draws with their validation loss over expanding folds, best first: the mean over rows of each horizon and
    quantile, averaged over these."""
    drawn = random_draws(grid, tries, seed, base)
    found = search_folds(df, targets, drawn, fold_bounds(df, min_train_months, val_months), features, keys)
    slots = found.groupBy("draw", "horizon", "quantile").agg((F.sum("loss") / F.sum("n_val")).alias("loss"))
    losses = {r["draw"]: r["loss"] for r in slots.groupBy("draw").agg(F.avg("loss").alias("loss")).collect()}
    return sorted([(p, losses.get(i, math.inf)) for i, p in enumerate(drawn)], key=lambda r: r[1])


def random_draws(grid: dict[str, Sequence], tries: int, seed: int = 42, base: BoostParams = BoostParams()) -> list[BoostParams]:
    combos = list(itertools.product(*grid.values()))
    return [replace(base, **dict(zip(grid, combo))) for combo in random.Random(seed).sample(combos, min(tries, len(combos)))]
