"""Gradient-boosted quantiles: trees under the pinball loss, several quantiles at once.

A round adds a tree to each quantile's model. The gradient of a row is q where its target lies above the model, and q - 1
elsewhere, so the sum over any set of rows follows from two counts. A level of all trees takes one aggregation: counts by model,
node, feature and bin, added up in the tasks first; its result has models x nodes x features x bins rows at most, whatever the
table. The driver picks the splits. A leaf's value is the quantile of its rows' residuals. Rows carry their models' values and
are written to the shared folder after each round, which cuts their lineage."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.session import scratch_path

BANDS = {"band68_low": 0.16, "band68_high": 0.84, "band95_low": 0.025, "band95_high": 0.975}
PAIRS = (("band68_low", "band68_high"), ("band95_low", "band95_high"))
#: Relative rank error of bin edges and of quantiles of residuals: one in this many rows.
ACCURACY = 10_000


@dataclass
class Node:
    """A split (rows with feature <= threshold go left; missing ones too), or a leaf with a value."""

    feature: str | None = None
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None
    value: float = 0.0

    def expression(self, leaf) -> Column:
        if self.feature is None:
            return leaf(self)
        goes_left = F.col(self.feature).isNull() | (F.col(self.feature) <= F.lit(self.threshold))
        return F.when(goes_left, self.left.expression(leaf)).otherwise(self.right.expression(leaf))

    def as_dict(self) -> dict:
        if self.feature is None:
            return {"value": self.value}
        return {"feature": self.feature, "threshold": self.threshold, "left": self.left.as_dict(), "right": self.right.as_dict()}

    @staticmethod
    def of(d: dict) -> Node:
        return Node(value=d["value"]) if "value" in d else Node(d["feature"], d["threshold"], Node.of(d["left"]), Node.of(d["right"]))


@dataclass
class QuantileModels:
    """base and trees by the name of a band; predictions are base plus the trees' values times the rate."""

    features: list[str]
    rate: float
    base: dict[str, float] = field(default_factory=dict)
    trees: dict[str, list[Node]] = field(default_factory=dict)

    def predict(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """keys and the bands; a pair of bands is null where one of its models is missing."""
        rows = rows.select(*keys, *[F.col(f).cast("double").alias(f) for f in self.features])
        value = lambda name: reduce(lambda a, t: a + F.lit(self.rate) * t.expression(lambda n: F.lit(n.value)), self.trees[name], F.lit(self.base[name]))
        out = []
        for pair in PAIRS:
            both = all(name in self.base for name in pair)
            out += [(value(name) if both else F.lit(None).cast("double")).alias(name) for name in pair]
        return rows.select(*keys, *out)

    def save(self, spark: SparkSession, path: str, **facts) -> None:
        rows = [(name, json.dumps({"base": self.base[name], "rate": self.rate, "features": self.features, "trees": [t.as_dict() for t in self.trees[name]]})) for name in self.base]
        spark.createDataFrame(rows, "model string, content string").coalesce(1).write.mode("overwrite").parquet(f"{path}/models")
        spark.createDataFrame([tuple(map(str, facts.values()))], ", ".join(f"`{k}` string" for k in facts)).coalesce(1).write.mode("overwrite").parquet(f"{path}/model_meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> QuantileModels:
        models = None
        for r in spark.read.parquet(f"{path}/models").collect():  # a row a model
            d = json.loads(r.content)
            models = models or QuantileModels(d["features"], d["rate"])
            models.base[r.model], models.trees[r.model] = d["base"], [Node.of(t) for t in d["trees"]]
        return models


def edges(frame: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Thresholds between bins, from quantiles of each feature; fewer where values repeat, none for a constant one."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = frame.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, ACCURACY).alias(f"q{k}") for k, f in enumerate(features)], *[F.max(F.col(f).cast("double")).alias(f"m{k}") for k, f in enumerate(features)]).first()
    return {f: sorted({x for x in found[f"q{k}"] or [] if x < found[f"m{k}"]}) for k, f in enumerate(features)}


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "boosting")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _best(counts: dict[tuple[int, int], tuple[int, int]], cuts: list[list[float]], q: float, least: int) -> tuple[int, int] | None:
    """(feature, bin) after which the sums of gradients differ most, the first of equals; None if nothing is gained. counts has
    (rows, rows above the model) by feature and bin."""
    best, gain = None, 1e-12
    for f, cut in enumerate(cuts):
        per_bin = [counts.get((f, b), (0, 0)) for b in range(len(cut) + 1)]
        n, above = sum(x[0] for x in per_bin), sum(x[1] for x in per_bin)
        whole = above - n * (1 - q)
        left_n = left_above = 0
        for b in range(len(cut)):
            left_n, left_above = left_n + per_bin[b][0], left_above + per_bin[b][1]
            right_n = n - left_n
            if left_n < least or right_n < least:
                continue
            g = left_above - left_n * (1 - q)
            better = g * g / left_n + (whole - g) ** 2 / right_n - whole * whole / n
            if better > gain * (1 + 1e-9):
                best, gain = (f, b), better
    return best


def fit(frame: DataFrame, features: list[str], target: str = "target", bands: dict[str, float] = BANDS, trees: int = 20, depth: int = 3, rate: float = 0.1, bins: int = 32, least: int = 20) -> QuantileModels:
    """Models of the quantiles of target. Rows without a target are left out; missing features count as smallest. Without rows
    there is no model in the result."""
    rows = frame.filter(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    names = list(bands)
    start = rows.agg(*[F.percentile_approx("_y", F.lit(q), ACCURACY).alias(n) for n, q in bands.items()]).first()
    models = QuantileModels(features, rate)
    if start[0] is None:
        return models
    models.base, models.trees = {n: start[n] for n in names}, {n: [] for n in names}
    found = edges(rows, features, bins)
    cuts = [found[f] for f in features]
    # The number of the bin: how many thresholds lie below the value.
    number = lambda f, cut: F.coalesce(F.size(F.filter(F.array(*map(F.lit, cut)), lambda e: e < F.col(f))), F.lit(0)) if cut else F.lit(0)
    placed = F.array(*[F.when(F.col(f).isNull(), 0).otherwise(number(f, cut)) for f, cut in zip(features, cuts, strict=True)])
    rows = _written(rows.select("_y", *features, placed.alias("_bins"), *[F.lit(start[n]).alias(f"_f{k}") for k, n in enumerate(names)]))
    for _ in range(trees):
        roots = [Node() for _ in names]
        open_nodes = [{0: r} for r in roots]
        numbered = [{id(r): 0} for r in roots]
        for level in range(depth):
            at = [r.expression(lambda n, k=k: F.lit(numbered[k][id(n)] if numbered[k].get(id(n)) in open_nodes[k] else -1)) for k, r in enumerate(roots)]
            each = F.array(*[F.struct(F.lit(k).alias("model"), a.alias("node"), (F.col("_y") > F.col(f"_f{k}")).cast("int").alias("above")) for k, a in enumerate(at)])
            flat = rows.select("_bins", F.explode(each).alias("m")).filter("m.node >= 0").select("m.model", "m.node", "m.above", F.posexplode("_bins").alias("feature", "bin"))
            counts: dict[tuple[int, int], dict] = {}
            for r in flat.groupBy("model", "node", "feature", "bin").agg(F.count("*").alias("n"), F.sum("above").alias("above")).collect():
                counts.setdefault((r.model, r.node), {})[r.feature, r.bin] = (r.n, r.above)
            for k, name in enumerate(names):
                fresh = {}
                for node in list(open_nodes[k].values()):
                    split = _best(counts.get((k, numbered[k][id(node)]), {}), cuts, bands[name], least)
                    if split:
                        node.feature, node.threshold = features[split[0]], cuts[split[0]][split[1]]
                        node.left, node.right = Node(), Node()
                        for child in (node.left, node.right):
                            numbered[k][id(child)] = len(numbered[k])
                            fresh[numbered[k][id(child)]] = child
                open_nodes[k] = fresh
            if not any(open_nodes):
                break
        leaves = [r.expression(lambda n, k=k: F.lit(numbered[k][id(n)])) for k, r in enumerate(roots)]
        each = F.array(*[F.struct(F.lit(k).alias("model"), a.alias("leaf"), (F.col("_y") - F.col(f"_f{k}")).alias("rest")) for k, a in enumerate(leaves)])
        wanted = [F.percentile_approx("rest", F.lit(bands[n]), ACCURACY).alias(f"q{k}") for k, n in enumerate(names)]
        values = {(r.model, r.leaf): r[f"q{r.model}"] for r in rows.select(F.explode(each).alias("m")).select("m.*").groupBy("model", "leaf").agg(*wanted).collect()}
        for k, root in enumerate(roots):
            for leaf in _leaves(root):
                leaf.value = values[k, numbered[k][id(leaf)]]
            models.trees[names[k]].append(root)
        rows = _written(rows.withColumns({f"_f{k}": F.col(f"_f{k}") + F.lit(rate) * r.expression(lambda n: F.lit(n.value)) for k, r in enumerate(roots)}))
    return models


def _leaves(node: Node) -> list[Node]:
    return [node] if node.feature is None else _leaves(node.left) + _leaves(node.right)


def early(frame: DataFrame, time: str, part: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Rows up to the time by which the part of the rows has come, and those after it."""
    when = F.unix_micros(F.col(time).cast("timestamp"))
    cut = frame.agg(F.percentile_approx(when, F.lit(part), ACCURACY)).first()[0]
    return (frame, frame.limit(0)) if cut is None else (frame.filter(when <= cut), frame.filter(when > cut))
