from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logstrata.operators import frequency
from logstrata.operators.numbering import with_line_number, with_runs
from logstrata.operators.skew import with_group_totals


def _rows():
    rows, n = [], 0
    for group in range(7):
        for i in range(group * 3 + 1):
            n += 1
            rows.append((n, f"g{group}" if group else None, f"v{(i * i + group) % 5}",
                         "x" if i % 2 else None))
    return rows


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(_rows(), "line_number long, g string, v string, w string")


def _expected():
    counts = defaultdict(Counter)
    for _, g, v, w in _rows():
        counts[g, "v"][v] += 1
        counts[g, "w"][w] += 1
    out = defaultdict(lambda: [0, 0.0, 0.0])
    for (_, column), values in counts.items():
        for value, n in values.items():
            terms = out[column, value]
            terms[0] += 1
            terms[1] += 1 / len(values)
            terms[2] += n / sum(values.values())
    return out


def test_normalized_frequency(facts):
    got = {(r.column_name, r.value): (r.binary_count, r.binary_count_normalized,
                                      r.aggregate_count_normalized)
           for r in frequency.normalized_frequency(facts, ["v", "w"], "g").collect()}
    expected = _expected()
    assert got.keys() == expected.keys()
    for key, terms in expected.items():
        assert got[key] == pytest.approx(tuple(terms))
    # Both normalised sums add up to the number of groups, for each column.
    for column in ("v", "w"):
        sums = [sum(m[i] for (c, _), m in got.items() if c == column) for i in (1, 2)]
        assert sums == pytest.approx([7, 7])


def test_restriction_keeps_the_denominators(facts):
    got = {r.value: r.binary_count_normalized for r in
           frequency.normalized_frequency(facts, {"v": ["v1"]}, "g").collect()}
    assert got == {"v1": pytest.approx(_expected()["v", "v1"][1])}


def test_value_frequency(facts):
    counts = Counter(("v", r[2]) for r in _rows()) + Counter(("w", r[3]) for r in _rows())
    got = {(r.column_name, r.value): r["count"]
           for r in frequency.value_frequency(facts, ["v", "w"]).collect()}
    assert got == counts
    few = frequency.value_frequency(facts, {"v": ["v0", "v1"]}, drop={"g": "g3"}).collect()
    assert {r.value: r["count"] for r in few} == Counter(
        r[2] for r in _rows() if r[1] != "g3" and r[2] in ("v0", "v1"))


def test_matrix_equals_cells(facts):
    for variant in frequency.MATRIX_VARIANTS:
        wide = frequency.frequency_matrix(
            facts, "v", "g", ["v0", "v1", "v2", "v3", "v4"], variant).collect()
        cells = {(r.g, r.value): r[variant]
                 for r in frequency.frequency_cells(facts, ["v"], "g").collect()}
        for row in wide:
            for value in ("v0", "v1", "v2", "v3", "v4"):
                assert row[value] == pytest.approx(cells.get((row.g, value), 0))
        assert len(wide) == 7


def test_matrix_of_empty_values(facts):
    rows = frequency.frequency_matrix(facts, "w", "g", [None, "", "x"]).collect()
    expected = Counter((r[1], r[3] or "") for r in _rows())
    assert len(rows) == 7
    for row in rows:
        assert (row[""], row["x"]) == (expected[row.g, ""], expected[row.g, "x"])


def test_matrix_of_odd_values(spark):
    rows = [("a", "The"), ("a", "the"), ("b", "the"), ("b", "`"), ("b", "(")]
    df = spark.createDataFrame(rows, "g string, v string")
    wide = frequency.frequency_matrix(df, "v", "g", ["The", "the", "`", "("])
    assert sorted(tuple(r) for r in wide.collect()) == [("a", 1, 1, 0, 0), ("b", 0, 1, 1, 1)]
    with pytest.raises(ValueError):
        frequency.frequency_matrix(df, "v", "g", ["g"])


def test_sub_group(facts):
    got = {(r.g, r.value): r["count"] for r in frequency.frequency_sub_group(
        facts, "g", "v", {"g": ["g1", "g2"]}, ["v1"]).collect()}
    assert got == Counter((r[1], r[2]) for r in _rows() if r[1] in ("g1", "g2") and r[2] != "v1")


def test_side_by_side(facts):
    rows = frequency.side_by_side(frequency.value_frequency(facts, ["w", "v"])).orderBy(
        "row_number").collect()
    assert rows[0].asDict().keys() == {"row_number", "v", "v_value", "w", "w_value"}
    assert [r.v_value for r in rows] == sorted((r.v_value for r in rows), reverse=True)
    assert [r.w_value is None for r in rows] == [False, False, True, True, True]


def test_adjacent_keys(spark):
    df = spark.createDataFrame([(i + 1, k) for i, k in enumerate("AABA")], "n long, k string")
    runs = frequency.grouped_counter(df.withColumn("c", F.lit("z")), ["c"], "k",
                                     run_order="n").collect()
    assert sorted((r.run_start, r.k, r.n) for r in runs) == [(1, "A", 2), (3, "B", 1),
                                                              (4, "A", 1)]


def test_runs_across_blocks(spark):
    # A third of all rows is one run; runs start, end and fill blocks of every kind.
    keys = []
    for i, length in enumerate([5, 1, 40, 3, 1, 1, 17, 16, 2, 33, 1]):
        keys += [None if i == 4 else "k%d" % (i % 3)] * length
    rows = [(i + 1, key) for i, key in enumerate(keys)]
    expected, start = {}, 1
    for i, key in rows:
        if i > 1 and keys[i - 2] != key:
            start = i
        expected[i] = start
    df = spark.createDataFrame(rows, "n long, k string").repartition(3)
    for block in (1, 2, 4, 16, 1000):
        got = {r.n: r.run_start for r in with_runs(df, "k", "n", block_rows=block).collect()}
        assert got == expected, block


def test_line_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"),
                                  (F.col("id") % 2).alias("p")).repartition(5)
    rows = with_line_number(df, [F.desc("p"), "k"]).collect()
    ordered = sorted(rows, key=lambda r: r.line_number)
    assert [r.line_number for r in ordered] == list(range(1, 1001))
    assert [(-r.p, r.k) for r in ordered] == sorted((-r.p, r.k) for r in rows)


def test_group_totals_with_few_shards(spark):
    rows = [(g, i, i) for g, n in ((None, 50), ("hot", 500), ("cold", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, n long")
    got = with_group_totals(df, ["g"], ["i"], {"total": F.col("n")}, shards=8).collect()
    assert len(got) == len(rows)
    assert {(r.g, r.total) for r in got} == {(None, 1225), ("hot", 124750), ("cold", 0)}


def test_a_hot_group_is_spread_and_the_counts_are_shuffled_once(spark, facts):
    plan = frequency.frequency_cells(facts, ["v"], "g")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert "ReusedExchange" in text
    assert "_shard" in text


def test_matrix_moves_listed_cells_only(spark):
    """The cells of other values are one row a group, with their share in the totals."""
    rows = [("g", f"w{i}") for i in range(50)] + [("g", "x"), ("g", "x"), ("g", None), ("g", ""),
                                                  ("h", "other"), (None, "x")]
    df = spark.createDataFrame(rows, "g string, v string")
    cells = frequency.matrix_cells(df, {"v": ["x", ""]}, "g")
    assert cells.count() == 6
    want = {"count": (2.0, 2.0), "binary_count": (1.0, 2.0),
            "binary_count_normalized": (1 / 53, 2 / 53), "aggregate_count_normalized": (2 / 54, 2 / 54)}
    for variant, amounts in want.items():
        found = {r[0]: r[1:] for r in frequency.frequency_matrix(df, "v", "g", ["x", ""], variant).collect()}
        assert found["g"] == pytest.approx(amounts) and found["h"] == (0, 0) and found[None] == (1, 0)
