"""Component analysis and reconstruction errors over crops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators.sampling import drawn

#: Rows of each class that the pairwise silhouette takes.
SILHOUETTE_ROWS = 160


def components(crops: DataFrame, k: int, scale: bool = True) -> tuple[DataFrame, list[float], np.ndarray]:
    """Crops with ``scores`` (array), the explained shares, and the loadings; centred, and scaled by the population deviation unless told not to.

    Constant pixels stay zero. The sign of a component is fixed by its largest loading being positive.
    """
    rows = crops.withColumn("_x", array_to_vector("v"))
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=scale).fit(rows)
    rows = scaler.transform(rows)
    model = PCA(k=k, inputCol="_z", outputCol="_s").fit(rows)
    loadings = model.pc.toArray()
    sign = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
    n = rows.count() if scale else 0
    wider = (n / (n - 1)) ** 0.5 if n > 1 else 1.0  # the scaler's deviation is the sample's
    signs = F.array(*[F.lit(float(s) * wider) for s in sign])
    scored = model.transform(rows).withColumn("scores", F.zip_with(vector_to_array("_s"), signs, lambda a, b: a * b)).withColumn("z", F.transform(vector_to_array("_z"), lambda x: x * wider))
    return scored.drop("_x", "_z", "_s"), [float(x) for x in model.explainedVariance], loadings * sign


def explained(spark, shares: list[float]) -> DataFrame:
    """(component, ratio, cumulative)."""
    return spark.createDataFrame([(i + 1, s, float(sum(shares[: i + 1]))) for i, s in enumerate(shares)], "component int, ratio double, cumulative double")


def residuals(scored: DataFrame, loadings: np.ndarray, k: int) -> DataFrame:
    """Adds ``residual``: mean squared error of rebuilding each crop from its first ``k`` components."""
    basis = [[float(x) for x in row] for row in loadings[:, :k]]
    rebuilt = F.array(*[F.aggregate(F.zip_with(F.slice("scores", 1, k), F.array(*[F.lit(x) for x in row]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for row in basis])
    return scored.withColumn("residual", F.aggregate(F.zip_with("z", rebuilt, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("z"))


def silhouette(scored: DataFrame, label: str, key: str, dims: int = 5, rows: int = SILHOUETTE_ROWS) -> DataFrame:
    """(label, silhouette, n): mean silhouette of at most ``rows`` rows of each class, in hash order, Euclidean over the first components."""
    sample = drawn(scored.select(key, label, F.slice("scores", 1, dims).alias("s")), rows, 42, key, label)
    local = sample.toPandas()
    points, names = (np.stack(local["s"].to_numpy()) if len(local) else np.zeros((0, dims))), local[label].to_numpy()
    shared = scored.sparkSession.sparkContext.broadcast((points, names))

    def run(batches):
        own, labels = shared.value
        kinds = sorted(set(labels))
        for b in batches:
            out = []
            for s, name in zip(b["s"], b[label]):
                d = np.linalg.norm(own - np.asarray(s), axis=1)
                inside = labels == name
                a = d[inside].sum() / max(1, inside.sum() - 1)
                other = min((d[labels == k].mean() for k in kinds if k != name), default=0.0)
                out.append(0.0 if inside.sum() < 2 else (other - a) / max(a, other, 1e-12))
            yield pd.DataFrame({label: b[label], "sil": out})

    return sample.mapInPandas(run, f"{label} string, sil double").groupBy(label).agg(F.avg("sil").alias("silhouette"), F.count("*").alias("n"))


def dense_autoencoder(crops: DataFrame, hidden: int = 32, code: int = 8, passes: int = 15, rows: int = 512, parts: int = 16, seed: int = 42) -> DataFrame:
    """(case_id, frame, error, code): a dense autoencoder for each case, fitted with Adam on at most ``rows`` of its background crops, in hash order.

    A case's crops are scored in ``parts`` groups, each joined by its model; without background crops error and code are null.
    """
    background = F.col("class_label").isNotNull() & (F.col("class_label") != "object")
    fitted = drawn(crops.where(background), rows, seed, "frame", "case_id")

    def fit(key, frame: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        x = np.stack(frame.sort_values("frame")["v"].to_numpy())
        sizes = [x.shape[1], hidden, code, hidden, x.shape[1]]
        w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])] + [np.zeros(b) for b in sizes[1:]]
        m1, m2, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(passes):
            for at in range(0, len(x), 32):
                own = x[at : at + 32]
                acts = [own]
                for i in range(4):
                    z = acts[-1] @ w[i] + w[4 + i]
                    acts.append(np.maximum(z, 0) if i < 3 else z)
                delta = 2 * (acts[-1] - own) / own.size
                grads = [None] * 8
                for i in range(3, -1, -1):
                    grads[i], grads[4 + i] = acts[i].T @ delta, delta.sum(axis=0)
                    delta = (delta @ w[i].T) * (acts[i] > 0)
                step += 1
                for i, g in enumerate(grads):
                    m1[i] += 0.1 * (g - m1[i])
                    m2[i] += 0.001 * (g * g - m2[i])
                    w[i] -= 1e-2 * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
        return pd.DataFrame({"case_id": [key[0]], "weights": [[p.ravel().tolist() for p in w]]})

    models = fitted.groupBy("case_id").applyInPandas(fit, "case_id long, weights array<array<double>>")

    def score(key, own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out, codes = np.full(len(own), np.nan), [None] * len(own)
        if len(own) and len(model):
            x = a = np.stack(own["v"].to_numpy())
            w = [np.array(p) for p in model["weights"].iloc[0]]
            for i in range(4):
                a = a @ w[i].reshape(a.shape[1], -1) + w[4 + i]
                a = np.maximum(a, 0) if i < 3 else a
                codes = list(a) if i == 1 else codes
            out = ((a - x) ** 2).mean(axis=1)
        return pd.DataFrame({"case_id": own["case_id"], "frame": own["frame"], "error": out, "code": pd.Series(codes, index=own.index, dtype=object)})

    part = F.pmod(F.xxhash64("frame"), F.lit(parts)).cast("int")
    dealt = crops.select("case_id", "frame", "v", part.alias("part")).groupBy("case_id", "part")
    spread = models.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("case_id", "part")
    return dealt.cogroup(spread).applyInPandas(score, "case_id long, frame long, error double, code array<double>")


def grouped_components(rows: DataFrame, by: str, v: str, k: int = 2, least: int = 8) -> DataFrame:
    """``rows`` with ``scores`` (array of ``k``): the principal components of each group's vectors, centred, all groups in one pass.

    Each Arrow batch adds up count, sum and products of the groups it holds; those small sums are added pixel by pixel over batches, and a group's matrix,
    of the vectors' size, is taken apart in one row. Scores are null for groups of fewer than ``least`` vectors or of vectors shorter than ``k``, and for
    null vectors. A component's sign makes its largest loading positive.
    """
    kind = dict(rows.dtypes)[by]

    def add_up(batches):
        for b in batches:
            out = []
            for key, own in b.dropna(subset=["v"]).groupby("by", sort=False):
                x = np.stack(own["v"].to_numpy()).astype(np.float64)
                x1 = np.hstack([np.ones((len(x), 1)), x])
                out.append((key, (x1.T @ x1).ravel()))
            yield pd.DataFrame(out, columns=["by", "sums"])

    sums = rows.select(F.col(by).alias("by"), F.col(v).cast("array<double>").alias("v")).mapInPandas(add_up, f"by {kind}, sums array<double>")
    added = sums.select("by", F.posexplode("sums").alias("at", "x")).groupBy("by", "at").agg(F.sum("x").alias("x"))
    matrices = added.groupBy("by").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("sums"))

    def take_apart(batches):
        for b in batches:
            out = []
            for key, flat in zip(b["by"], b["sums"]):
                m = np.asarray(flat).reshape(int(np.sqrt(len(flat))), -1)
                n, mean = m[0, 0], m[0, 1:] / m[0, 0]
                if n < least or len(mean) < k:
                    continue
                values, vectors = np.linalg.eigh(m[1:, 1:] / n - np.outer(mean, mean))
                loadings = vectors[:, ::-1][:, :k]
                loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
                out.append((key, mean, [list(c) for c in loadings.T]))
            yield pd.DataFrame(out, columns=["by", "mean", "loadings"])

    models = matrices.mapInPandas(take_apart, f"by {kind}, mean array<double>, loadings array<array<double>>").withColumnRenamed("by", by)
    centred = F.zip_with(F.col(v).cast("array<double>"), "mean", lambda a, m: a - m)
    score = F.transform("loadings", lambda c: F.aggregate(F.zip_with(centred, c, lambda a, w: a * w), F.lit(0.0), lambda s, x: s + x))
    return rows.join(models, by, "left").withColumn("scores", F.when(F.col(v).isNotNull(), score)).drop("mean", "loadings")


def class_separation(scored: DataFrame, quality: DataFrame, background: tuple[str, ...] = ("near_background", "far_background", "random_background")) -> DataFrame:
    """The record of a case's component analysis, from (case_id, class_label, scores) and (case_id, validity, silhouette).

    Centres of the object, the background, compression and overlay classes on the first two scores; distances from the object's (0 without one of
    both), their mean over the deviation of all these scores as separation, the nearest as similarity, and the score that may be shown.
    """
    classes = {"object": ("object",), "background": background, "compression": ("compression_noise",), "hud": ("hud_artifact",)}
    pc = [F.get("scores", F.lit(k)) for k in (0, 1)]
    at = lambda kinds, k: F.avg(F.when(F.col("class_label").isin(*kinds), pc[k]))
    flat = lambda f: (F.sum(f(pc[0])) + F.sum(f(pc[1]))) / (2 * F.count("*"))
    g = scored.groupBy("case_id").agg(
        F.count_if(F.col("class_label") == "object").alias("object_samples"), F.count_if(F.col("class_label") != "object").alias("control_samples"),
        *[at(kinds, k).alias(f"{name}_pc{k + 1}") for name, kinds in classes.items() for k in (0, 1)], flat(lambda c: c).alias("mean"), flat(lambda c: c * c).alias("squares"),
    )
    away = {n: F.coalesce(F.hypot(F.col("object_pc1") - F.col(f"{n}_pc1"), F.col("object_pc2") - F.col(f"{n}_pc2")), F.lit(0.0)) for n in ("background", "compression", "hud")}
    g = g.withColumns({f"{n}_distance": d for n, d in away.items()}).withColumn("scale", F.sqrt(F.greatest(F.col("squares") - F.col("mean") * F.col("mean"), F.lit(0.0))) + 1e-9)
    some = F.filter(F.array(*[F.col(f"{n}_distance") for n in away]), lambda d: d > 0)
    average = F.aggregate(some, F.lit(0.0), lambda s, d: s + d) / F.nullif(F.size(some), F.lit(0))
    shown = F.coalesce("validity", F.lit(0.0)) * (0.5 + F.least(F.lit(0.5), F.greatest(F.lit(0.0), F.coalesce("silhouette", F.lit(0.0)) + 0.15)))
    return g.join(quality.select("case_id", "validity", "silhouette"), "case_id", "left").select(
        "case_id", "object_samples", "control_samples", *[F.coalesce(f"{n}_pc{k}", F.lit(0.0)).alias(f"{n}_pc{k}") for n in ("object", "background") for k in (1, 2)], *[f"{n}_distance" for n in away],
        F.coalesce(average / F.col("scale"), F.lit(0.0)).alias("separation"), F.coalesce(1 / (1 + F.array_min(some) / F.col("scale")), F.lit(0.0)).alias("nearest_similarity"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), shown)).alias("public_safe"),
    )
