"""Series operators that windows and aggregates can't express: Fourier spectra and time warping, one group a call; spectra of long groups in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spectrum(df: DataFrame, key: str, order: list[str], value: str, least: int = 8, most: int = 100_000) -> DataFrame:
    """key, n, peak_period (n over the strongest frequency but 0) and slope (of log power on log frequency). Series under `least` values are left out; those over `most` are transformed in blocks, so no task's memory grows with them."""
    from pyspark.sql import Window as W

    values = df.where(F.col(value).isNotNull()).select(key, *[c for c in order if c != key], F.col(value).cast("double").alias("_v"))
    sizes = values.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"), F.avg("_v").alias("_mean"))
    rows = values.withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy(*order))).select(key, "_i", "_v")
    long = F.broadcast(sizes.where(F.col("_n") > most))
    same = F.col(key).eqNullSafe(F.col("_key"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_i")["_v"].to_numpy()
        if len(x) < least:
            return pd.DataFrame({key: [], "n": [], "peak_period": [], "slope": []})
        power = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2
        f = np.arange(1, len(power) + 1) / len(x)
        ok = power > 1e-12
        slope = np.polyfit(np.log(f[ok]), np.log(power[ok]), 1)[0] if ok.sum() >= 5 else None
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [len(x)], "peak_period": [len(x) / (power.argmax() + 1) if ok.any() else None], "slope": [slope]})

    kind = df.schema[key].dataType.simpleString()
    if sizes.where(F.col("_n") > most).isEmpty():
        return rows.groupBy(key).applyInPandas(run, f"`{key}` {kind}, n long, peak_period double, slope double")
    short = rows.join(long, same, "left_anti").groupBy(key).applyInPandas(run, f"`{key}` {kind}, n long, peak_period double, slope double")
    power = _blocked_power(rows.join(long, same).select(key, (F.col("_i") - 1).cast("long").alias("_i"), (F.col("_v") - F.col("_mean")).alias("_v"), "_n"), key, kind)
    ok, f = F.col("_p") > 1e-12, F.col("_k") / F.col("_n")
    found = power.groupBy(key, F.col("_n").alias("n")).agg(F.max(F.when(ok, F.struct("_p", (-F.col("_k")).alias("_k"))))["_k"].alias("_k"), F.count_if(ok).alias("_c"), F.regr_slope(F.when(ok, F.log("_p")), F.when(ok, F.log(f))).alias("_s"))
    return short.unionByName(found.where(F.col("n") >= least).select(key, "n", (F.col("n") / -F.col("_k")).alias("peak_period"), F.when(F.col("_c") >= 5, F.col("_s")).alias("slope")))


def _sides(n: int) -> tuple[int, int]:
    """Two powers of 2, the second not the smaller one, whose product is over 2n - 1."""
    p = (2 * n - 1).bit_length()
    return 1 << p // 2, 1 << p - p // 2


def _blocked_power(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """key, _n, _k, _p: the powers at frequencies 1 to n // 2 of each series (_i from 0, _v, _n its length).

    Bluestein's form of the transform, exact for each n: the series times a chirp, convolved with the chirp. The convolution is a product of transforms of a power of 2,
    a * b, as transforms of columns of length a and of rows of length b: a task holds one column or row, about the root of 4n values."""
    column = F.pmod("_i", F.pow(F.lit(2.0), F.ceil(F.length(F.bin(2 * F.col("_n") - 1)) / 2)).cast("long"))

    def chirp(m: np.ndarray, n: int) -> np.ndarray:
        return np.exp(1j * np.pi * (m * m % (2 * n)) / n)

    def frame(pdf: pd.DataFrame, **columns: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(columns["_p" if "_p" in columns else "_a"]), "_n": int(pdf["_n"].iloc[0]), **columns})

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        n, j = int(pdf["_n"].iloc[0]), int(pdf["_j"].iloc[0])
        a, b = _sides(n)
        i = pdf["_i"].to_numpy()
        x, at = np.zeros(a, complex), np.arange(a) * b + j
        x[i // b] = pdf["_v"].to_numpy() * chirp(i, n).conj()
        near = np.minimum(at, a * b - at)
        y = np.where(near < n, chirp(np.minimum(near, n), n), 0)
        turn = np.exp(-2j * np.pi * np.arange(a) * j / (a * b))
        x, y = np.fft.fft(x) * turn, np.fft.fft(y) * turn
        return frame(pdf, _j=np.full(a, j), _r=np.arange(a), _a=x.real, _b=x.imag, _c=y.real, _d=y.imag)

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_j")
        n, r = int(pdf["_n"].iloc[0]), int(pdf["_r"].iloc[0])
        a, b = _sides(n)
        z = np.fft.fft(pdf["_a"].to_numpy() + 1j * pdf["_b"].to_numpy()) * np.fft.fft(pdf["_c"].to_numpy() + 1j * pdf["_d"].to_numpy())
        z = np.fft.ifft(z) * np.exp(2j * np.pi * np.arange(b) * r / (a * b))
        return frame(pdf, _j=np.arange(b), _r=np.full(b, r), _a=z.real, _b=z.imag)

    def powers(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        n, j = int(pdf["_n"].iloc[0]), int(pdf["_j"].iloc[0])
        a, b = _sides(n)
        z, k = np.fft.ifft(pdf["_a"].to_numpy() + 1j * pdf["_b"].to_numpy()), np.arange(a) * b + j
        held = (k >= 1) & (k <= n // 2)
        return frame(pdf, _k=k[held], _p=np.abs(z[held]) ** 2)

    head = f"`{key}` {kind}, _n long"
    out = rows.withColumn("_j", column).groupBy(key, "_j").applyInPandas(columns, f"{head}, _j long, _r long, _a double, _b double, _c double, _d double")
    out = out.groupBy(key, "_r").applyInPandas(lines, f"{head}, _j long, _r long, _a double, _b double")
    return out.groupBy(key, "_j").applyInPandas(powers, f"{head}, _k long, _p double")


def warp_distance(a: np.ndarray, b: np.ndarray, window: int | None = None) -> float:
    """Time-warping distance of absolute differences within a band, over the sum of lengths; infinite if either is empty."""
    n, m = len(a), len(b)
    if not n or not m:
        return float("inf")
    w = max(window if window is not None else max(n, m), abs(n - m))
    before = np.full(m + 1, np.inf)
    before[0] = 0.0
    for i in range(1, n + 1):
        now = np.full(m + 1, np.inf)
        for j in range(max(1, i - w), min(m, i + w) + 1):
            now[j] = abs(a[i - 1] - b[j - 1]) + min(before[j], now[j - 1], before[j - 1])
        before = now
    return float(before[m] / (n + m))


def warped(pairs: DataFrame, a: str, b: str, window: int = 50, scale: float = 3.0) -> DataFrame:
    """pairs with distance and similarity of their array columns a and b."""

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else warp_distance(np.asarray(p, float), np.asarray(q, float), window) for p, q in zip(x, y, strict=True)])

    return pairs.withColumn("distance", distance(a, b)).withColumn("similarity", F.exp(-F.col("distance") / max(0.01, scale)))
