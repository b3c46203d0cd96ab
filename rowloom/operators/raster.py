"""Neighbourhood operators on rasters. Separable ones are window functions over rows and columns; spectra are NumPy kernels,
one tile per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.operators import sequence as Q


def blur(df: DataFrame, value: str, sigma: float, by: tuple[str, ...] = ()) -> DataFrame:
    """df with value blurred by a Gaussian, along rows and then along columns; the border is continued."""
    one = df.withColumn(value, Q.gaussian(value, [*by, "r"], "c", sigma))
    return one.withColumn(value, Q.gaussian(value, [*by, "c"], "r", sigma))


def _box(df: DataFrame, value: str, half: int, f, by: tuple[str, ...]) -> DataFrame:
    for across, along in (("r", "c"), ("c", "r")):
        df = df.withColumn(value, f(value).over(Window.partitionBy(*by, across).orderBy(along).rangeBetween(-half, half)))
    return df


def opened(df: DataFrame, value: str, half: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Least, then greatest, in a square of ±half cells."""
    return _box(_box(df, value, half, F.min, by), value, half, F.max, by)


def closed(df: DataFrame, value: str, half: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    return _box(_box(df, value, half, F.max, by), value, half, F.min, by)


def sheared_mean(df: DataFrame, by: list[str], i: str, t: str, value: str, slopes: list[float], middle: float) -> DataFrame:
    """by, slope, bin, v, n: the mean per bin of t - slope * (i - middle), for each slope."""
    s = df.withColumn("slope", F.explode(F.array(*[F.lit(float(x)) for x in slopes])))
    k = F.floor(F.col(t) - F.col("slope") * (F.col(i) - middle))
    return s.groupBy(*by, "slope", k.alias("bin")).agg(F.avg(value).alias("v"), F.count(F.lit(1)).alias("n"))


def box_statistic(df: DataFrame, by: list[str], row: str, i: str, value: str, rows: int, places: int, spacing: float) -> Column:
    """Mean over its standard error in a box of ±rows and ±places. Sums along the rows first, then across."""
    along = Window.partitionBy(*by, row).orderBy(i).rangeBetween(-places, places)
    s = df.select(*by, row, i, F.sum(value).over(along).alias("_s"), F.sum(F.col(value) * F.col(value)).over(along).alias("_q"), F.count(value).over(along).alias("_n"))
    across = Window.partitionBy(*by, i).orderBy(row).rangeBetween(-rows, rows)
    s = s.select(*by, row, i, F.sum("_s").over(across).alias("_s"), F.sum("_q").over(across).alias("_q"), F.sum("_n").over(across).alias("_n"))
    mean = F.try_divide(F.col("_s"), F.col("_n"))
    var = F.greatest(F.try_divide(F.col("_q"), F.col("_n")) - mean * mean, F.lit(1e-12))
    full = (2 * rows + 1) * (2 * places + 1)
    return s.select(*by, row, i, F.when(F.col("_n") * 2 >= full, mean / F.sqrt(var / F.greatest(F.col("_n") / spacing, F.lit(1.0)))).alias("t"))


def hann(n: int) -> np.ndarray:
    w = np.hanning(n)
    return np.outer(w, w)


def dense(pdf: pd.DataFrame, value: str, size: int) -> np.ndarray:
    a = np.full((size, size), np.nan)
    a[pdf["r"].to_numpy() % size, pdf["c"].to_numpy() % size] = pdf[value].to_numpy(float)
    return a


def power(a: np.ndarray) -> np.ndarray:
    """Power spectrum under a Hann window; unknown cells take the mean."""
    m = np.nanmean(a)
    return np.abs(np.fft.fft2((np.where(np.isnan(a), m, a) - m) * hann(len(a)))) ** 2


def _centroid(p: np.ndarray, ky: int, kx: int) -> tuple[float, float]:
    n = len(p)
    w = fy = fx = 0.0
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            q = p[(ky + dy) % n, (kx + dx) % n]
            w, fy, fx = w + q, fy + q * (ky + dy), fx + q * (kx + dx)
    sy, sx = fy / w, fx / w
    return (sy if sy <= n / 2 else sy - n) / n, (sx if sx <= n / 2 else sx - n) / n


def peak(p: np.ndarray, least_period: float, most_period: float, whiten: bool = False) -> dict | None:
    """ang, per, ring (over the median of its ring), frac (of the band) of the strongest frequency in a band of periods."""
    n = len(p)
    f = np.fft.fftfreq(n)
    fr = np.hypot(*np.meshgrid(f, f, indexing="ij"))
    band = (fr >= 1 / most_period) & (fr <= min(0.5, 1 / least_period)) & (np.arange(n)[:, None] <= n // 2)
    if not band.any():
        return None
    ring_no = np.rint(fr * n).astype(int)
    medians = np.array([max(np.median(p[ring_no == k]), 1e-30) if (ring_no == k).any() else 1e-30 for k in range(ring_no.max() + 1)])
    q = np.where(band, p / medians[ring_no] if whiten else p, -1)
    ky, kx = np.unravel_index(np.argmax(q), q.shape)
    fy, fx = _centroid(p, int(ky), int(kx))
    norm = float(np.hypot(fy, fx))
    if norm == 0:
        return None
    near = sum(p[(ky + a) % n, (kx + b) % n] for a in (-1, 0, 1) for b in (-1, 0, 1))
    return {"ang": float((np.degrees(np.arctan2(fy, fx)) + 90) % 180), "per": 1 / norm, "ring": float(p[ky, kx] / medians[ring_no[ky, kx]]), "frac": float(near / p[band].sum())}


def tile_votes(df: DataFrame, value: str, size: int, least_period: float, most_period: float, by: tuple[str, ...] = ("lot",), stride: int | None = None, least_valid: float = 0.7) -> DataFrame:
    """by, ty, tx, ang, per, ring, frac: a vote of each window for a direction and a period. Windows overlap by half; each is a group of
    size * size cells, whatever the raster's size."""
    stride = stride or size // 2
    k = size // stride
    first = lambda c: F.floor(F.col(c) / stride)
    w = df.select(*by, "r", "c", F.when(F.col("valid"), F.col(value)).alias("v"), F.explode(F.array(*[F.struct((first("r") - i).alias("ty"), (first("c") - j).alias("tx")) for i in range(k) for j in range(k)])).alias("w"))
    w = w.where("w.ty >= 0 AND w.tx >= 0").select(*by, "w.ty", "w.tx", (F.col("r") - F.col("w.ty") * stride).alias("r"), (F.col("c") - F.col("w.tx") * stride).alias("c"), "v")
    keys = [*by, "ty", "tx"]

    def vote(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[keys].head(1).copy()
        a = dense(pdf, "v", size)
        if np.isfinite(a).mean() < least_valid:
            return out.head(0).assign(ang=0.0, per=0.0, ring=0.0, frac=0.0)
        found = peak(power(a), least_period, most_period)
        return out.assign(**found) if found else out.head(0).assign(ang=0.0, per=0.0, ring=0.0, frac=0.0)

    kinds = dict(w.dtypes)
    return w.groupBy(*keys).applyInPandas(vote, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", ang double, per double, ring double, frac double")


def welch(df: DataFrame, value: str, size: int, by: tuple[str, ...] = ("lot",)) -> DataFrame:
    """by, ky, kx, p: the sum of the windows' power spectra. Spectra are made per window and summed by frequency in the JVM."""
    stride = size // 2
    first = lambda c: F.floor(F.col(c) / stride)
    w = df.select(*by, "r", "c", F.when(F.col("valid"), F.col(value)).alias("v"), F.explode(F.array(*[F.struct((first("r") - i).alias("ty"), (first("c") - j).alias("tx")) for i in (0, 1) for j in (0, 1)])).alias("w"))
    w = w.where("w.ty >= 0 AND w.tx >= 0").select(*by, "w.ty", "w.tx", (F.col("r") - F.col("w.ty") * stride).alias("r"), (F.col("c") - F.col("w.tx") * stride).alias("c"), "v")

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        a = dense(pdf, "v", size)
        if np.isfinite(a).mean() < 0.5:
            return pd.DataFrame({**{c: pdf[c].head(0) for c in by}, "ky": [], "kx": [], "p": []})
        p = power(a)[: size // 2 + 1]
        ky, kx = np.indices(p.shape)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "ky": ky.ravel(), "kx": kx.ravel(), "p": p.ravel()})

    kinds = dict(w.dtypes)
    spectra = w.groupBy(*by, "ty", "tx").applyInPandas(spectrum, ", ".join(f"{c} {kinds[c]}" for c in by) + ", ky int, kx int, p double")
    return spectra.groupBy(*by, "ky", "kx").agg(F.sum("p").alias("p"))


def orientation(spectrum: DataFrame, size: int, least_period: float, most_period: float, by: tuple[str, ...] = ("lot",), whiten_below: float = 20.0) -> DataFrame:
    """by, ang, per, ring, frac: the strongest frequency of a summed spectrum; where it is less than `whiten_below` times its ring's median,
    the strongest of the spectrum divided by ring medians."""

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.zeros((size, size))
        p[pdf["ky"], pdf["kx"]] = pdf["p"]
        half = p[1 : size // 2]
        p[size // 2 + 1 :] = np.roll(half[::-1, ::-1], 1, axis=1)  # the other half is its mirror
        found = peak(p, least_period, most_period)
        if found and found["ring"] < whiten_below:
            found = peak(p, least_period, most_period, True)
        return pdf[list(by)].head(1).assign(**(found or {"ang": np.nan, "per": np.nan, "ring": np.nan, "frac": np.nan}))

    kinds = dict(spectrum.dtypes)
    return spectrum.groupBy(*by).applyInPandas(best, ", ".join(f"{c} {kinds[c]}" for c in by) + ", ang double, per double, ring double, frac double")
