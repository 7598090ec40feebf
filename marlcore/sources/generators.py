"""Made-up data sets by name, as feature tables; fixed by their seed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def _blobs(n, rng, centres, spread):
    y = np.arange(n) % len(centres)
    return centres[y] + rng.normal(size=(n, centres.shape[1])) * np.asarray(spread)[y, None], y


#: Centres and spreads of the three blobs.
def blobs(n, noise, rng):
    return _blobs(n, rng, np.array([[-4.0, 0], [3, 3], [4, -4]]), [0.9, 1.1, 0.75])


def moons(n, noise, rng):
    y = np.arange(n) % 2
    t = rng.uniform(0, np.pi, n)
    x = np.where(y[:, None] == 0, np.c_[np.cos(t), np.sin(t)], np.c_[1 - np.cos(t), 0.5 - np.sin(t)])
    return x + rng.normal(size=x.shape) * noise, y


def s_curve(n, noise, rng):
    t = 3 * np.pi * (rng.random(n) - 0.5)
    x = np.c_[np.sin(t), 2 * rng.random(n), np.sign(t) * (np.cos(t) - 1)] + rng.normal(size=(n, 3)) * noise
    return x, np.digitize(t, np.quantile(t, [1 / 3, 2 / 3]))


def smile(n, noise, rng):
    y = np.arange(n) % 3
    t = rng.uniform(np.pi * 1.15, np.pi * 1.85, n)
    eyes = rng.normal(size=(n, 2)) * 0.18
    x = np.where(y[:, None] == 0, eyes + [-1, 1], np.where(y[:, None] == 1, eyes + [1, 1], np.c_[2 * np.cos(t), 2 * np.sin(t) + 0.6]))
    return x + rng.normal(size=x.shape) * noise, y


def wide_blobs(n, noise, rng):
    return _blobs(n, rng, rng.normal(size=(5, 100)) * 4, [1.0] * 5)


def two_views(n, noise, rng):
    z = rng.normal(size=(n, 2))
    x = np.hstack([z @ rng.normal(size=(2, 10)), np.sin(z @ rng.normal(size=(2, 10)))])
    return x + rng.normal(size=x.shape) * noise, None


def square(n, noise, rng):
    y = np.arange(n) % 5
    u, side = rng.uniform(-1, 1, n), rng.integers(4, size=n)
    frame = np.select([side[:, None] == k for k in range(4)], [np.c_[u, np.ones(n)], np.c_[u, -np.ones(n)], np.c_[np.ones(n), u], np.c_[-np.ones(n), u]])
    corner = np.array([[0.5, 0.5], [-0.5, 0.5], [0.5, -0.5], [-0.5, -0.5], [0, 0]])[y]
    x = np.where(y[:, None] == 4, frame, corner + rng.uniform(-0.15, 0.15, (n, 2)))
    return x + rng.normal(size=x.shape) * noise, y


def half_kernel(n, noise, rng):
    y = np.arange(n) % 4
    t = rng.uniform(-2, 2, n)
    centre = np.array([[0, 3.0], [-1.2, 2.2], [1.2, 2.2], [0, 0]])[y]
    x = np.where(y[:, None] == 3, np.c_[t, t * t - 1], centre + rng.normal(size=(n, 2)) * 0.25)
    return x + rng.normal(size=x.shape) * noise, y


def rice(n, noise, rng):
    return _blobs(n, rng, np.array([[7.0, 2.0], [5.5, 2.8], [6.2, 2.3]]), [0.3, 0.25, 0.2])


DATASETS = {f.__name__: f for f in (blobs, moons, s_curve, smile, wide_blobs, two_views, square, half_kernel, rice)}


def generate(spark: SparkSession, name: str, n: int = 480, noise: float = 0.06, seed: int = 42) -> DataFrame:
    """id, f, y of a data set; an unknown name is a ValueError."""
    if name not in DATASETS:
        raise ValueError(f"unknown data set {name}: one of {', '.join(DATASETS)}")
    x, y = DATASETS[name](n, noise, np.random.default_rng(seed))
    return spark.createDataFrame([(i, row.tolist(), None if y is None else int(y[i])) for i, row in enumerate(x)], "id bigint, f array<double>, y int")


def cohort(spark: SparkSession, n: int = 500, genes: int = 2000, batch_strength: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Long expression(sample, feature, value) and phenotypes(sample, subtype, site): five subtypes, three sites with an offset."""
    rng = np.random.default_rng(seed)
    subtype, site = rng.integers(5, size=n), rng.integers(3, size=n)
    x = rng.normal(size=(n, genes)) + (rng.normal(size=(5, genes)) * (rng.random(genes) < 0.1))[subtype] * 2 + batch_strength * rng.normal(size=(3, genes))[site] * 0.3
    rows = spark.createDataFrame([(f"S{i:04d}", r.tolist(), f"T{subtype[i]}", f"B{site[i]}") for i, r in enumerate(x)], "sample string, f array<double>, subtype string, site string")
    long = rows.selectExpr("sample", "posexplode(f) as (g, value)").selectExpr("sample", "concat('G', g) as feature", "value")
    return long, rows.select("sample", "subtype", "site")
