"""The robust estimate against a brute-force one, and outliers planted in each feature."""

import random

import numpy as np
import pandas as pd

from logstrata.llm import outliers

P = len(outliers.FEATURES)
# Group sizes of 400 units: a least spread of 0.025, far below that of the clouds here.
SIZE = float(np.log(400))


def cloud(rng, n=400, bad=80):
    """A correlated cloud, and rows that lie across it but within each feature's range."""
    mix = np.array([[1, 0, 0, 0], [.95, .3, 0, 0], [.2, .1, 1, 0], [-.3, .2, .1, .9]])
    good = rng.normal(size=(n - bad, P)) @ mix.T
    across = np.array([1.8, -1.8, 0, 0]) + 0.1 * rng.normal(size=(bad, P))
    return np.vstack([good, across])


def brute(x, kept=outliers.KEPT_SHARE, starts=60):
    """Least determinant of concentration steps from many random starts; distances by it."""
    h, best = int(np.ceil(kept * len(x))), None
    scale = kept / outliers.chi2_cdf(outliers.chi2_quantile(kept, P), P + 2)
    rng = np.random.default_rng(9)
    for _ in range(starts):
        near = x[rng.choice(len(x), P + 1, replace=False)]
        for _ in range(60):
            mean, cov = near.mean(0), np.cov(near.T, bias=True) + 1e-9 * np.eye(P)
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            near = x[np.argsort(d, kind="stable")[:h]]
        mean, cov = near.mean(0), np.cov(near.T, bias=True)
        if best is None or np.linalg.det(cov) < best[0]:
            best = np.linalg.det(cov), mean, cov * scale
    y = x - best[1]
    return np.sqrt(np.einsum("ij,jk,ik->i", y, np.linalg.inv(best[2]), y))


def test_estimate_against_brute_force(spark):
    x = cloud(np.random.default_rng(4))
    rows = pd.DataFrame(x, columns=outliers.FEATURES).assign(g="a", i=range(len(x)))
    for z in outliers.SIZES:
        rows[z] = SIZE
    df = spark.createDataFrame(rows).selectExpr("struct(g) AS __g", "*").drop("g")
    estimate, n_groups = outliers.minimum_covariance(df)
    assert n_groups == 1
    found = outliers._with_distance(outliers._attach(df, estimate, n_groups)) \
        .select("i", "__far").toPandas().sort_values("i")
    got, want = np.sqrt(found["__far"].to_numpy()), brute(x)
    assert np.abs(got - want).max() < 0.05 * want.max()
    # The rows across the cloud are in the range of each feature: only the covariance tells them.
    limit = np.sqrt(outliers.chi2_quantile(1 - 1e-4, P))
    assert (got[-80:] > limit).all() and (got[:-80] > limit).mean() < 0.01
    spread = (x - np.median(x, 0)) / x.std(0)
    assert np.sqrt((spread[-80:] ** 2).sum(1)).max() < limit


def documents(rng):
    """400 texts of 40 lines with some symbols, repeats and words of changing length."""
    def line(words, length=1.0):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(
            max(1, round(length * rng.randint(2, 9))))) for _ in range(words))
    rows = []
    for i in range(400):
        lines = [line(12) for _ in range(40)]
        if i % 3 == 0:
            lines[5] = lines[4]
        rows.append((i, "\n".join(lines) + " &" * (i % 4)))
    for k in range(4):
        rows.append((1000 + k, "\n".join(line(12, 1.7) for _ in range(40))))
        rows.append((2000 + k, "\n".join(line(12) + " $$$#" for _ in range(40))))
        short = [line(1) for _ in range(4)]
        rows.append((3000 + k, "\n".join([line(12) for _ in range(40)] + short * 6)))
        again = line(14)
        rows.append((4000 + k, "\n".join([line(12) + " " + line(1) + str(j) for j in range(40)])
                     + "".join(f"\n{j} {again}" for j in range(7))))
    return [(i, t, "en", "s") for i, t in rows]


def test_outliers_in_each_feature(spark):
    rows = documents(random.Random(3))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = {r.doc_id: r for r in outliers.judge(df).collect()}
    assert not any(r.base_failed for r in judged.values())
    assert {i for i, r in judged.items() if not r.kept} == {i for i, *_ in rows if i >= 1000}


def test_rows_of_one_kind(spark):
    """No spread at all: a row with one symbol is no outlier, one full of them is."""
    text = " ".join(f"word{i:03d}" for i in range(300))
    rows = [(i, text) for i in range(300)] + [(900, text + " $"), (901, "$$ " * 5 + text + "#" * 200)]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows],
                               "doc_id long, text string, lang string, source string")
    assert [r.doc_id for r in outliers.judge(df).where("not kept").collect()] == [901]
