"""The stored vector index: equal to the scan of all vectors, leaves clusters out, reads few of many."""

import numpy as np
import pytest

from quire.operators import search as S
from quire.operators.vector_index import VectorIndex


def frame(spark, x, name):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} int, dense array<float>")


def clustered(n, groups=12, d=16, seed=1):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(99).normal(size=(groups, d))  # the same groups for units and questions
    return middle[rng.integers(0, groups, n)] + rng.normal(0, 0.08, (n, d))


def ranked(rows):
    return {(r.question_id, r.pos): (r.unit_id, round(r.similarity, 6)) for r in rows.collect()}


@pytest.mark.parametrize("block,centres", [(7, 5), (2048, None), (40, 1)])
def test_equals_the_scan(spark, tmp_path, block, centres):
    rng = np.random.default_rng(2)
    x = np.concatenate([clustered(150), rng.normal(size=(60, 16)), np.zeros((2, 16))])
    x[150:170] = x[:20]  # ties go by id
    units = frame(spark, x, "unit_id").unionByName(spark.createDataFrame([(900, None)], "unit_id int, dense array<float>"))
    asked = frame(spark, np.concatenate([clustered(6, seed=5), rng.normal(size=(4, 16)), np.zeros((1, 16))]), "question_id").unionByName(spark.createDataFrame([(99, None)], "question_id int, dense array<float>"))
    index = VectorIndex.build(units, str(tmp_path / "index"), centres, block)
    assert index.blocks.selectExpr("sum(size(ids))").first()[0] == 212
    assert ranked(index.top(asked, 5)) == ranked(S.dense_top(asked, units, 5))


def test_leaves_out_more_of_more(spark, tmp_path, monkeypatch):
    """Rows read for the same questions grow slower than the units."""
    asked, share = frame(spark, clustered(5, seed=7), "question_id"), []
    for n in (600, 2400):
        units = frame(spark, clustered(n, seed=3), "unit_id")
        index = VectorIndex.build(units, str(tmp_path / f"i{n}"), 12 * n // 600, 50)
        read, scored = [], VectorIndex.scored
        with monkeypatch.context() as m:
            m.setattr(VectorIndex, "scored", lambda self, pairs, *a: read.append(pairs.select("block").distinct()) or scored(self, pairs, *a))
            assert ranked(index.top(asked, 5)) == ranked(S.dense_top(asked, units, 5))
        blocks = {r.block for df in read for r in df.collect()}
        share.append(index.blocks.where(index.blocks.block.isin(list(blocks))).selectExpr("sum(size(ids))").first()[0] / n)
    assert share[0] < 0.7 and share[1] <= share[0]


def test_nothing_to_find(spark, tmp_path):
    empty = spark.createDataFrame([], "unit_id string, dense array<float>")
    index = VectorIndex.build(empty, str(tmp_path / "none"))
    asked = frame(spark, clustered(2), "question_id")
    assert index.top(asked, 3).count() == 0
    one = VectorIndex.build(spark.createDataFrame([("u", [0.0, 0.0])], empty.schema), str(tmp_path / "one"))
    assert [tuple(r) for r in one.top(spark.createDataFrame([(1, [1.0, 0.0])], "question_id int, dense array<float>"), 3).collect()] == [(1, "u", 0.0, 1)]
    assert one.top(asked.limit(0), 3).count() == 0


def test_batches_are_bounded_where_a_row_holds_a_block(spark, tmp_path, monkeypatch):
    from quire.operators import vector_index as X

    bound, write = [], X.materialize
    monkeypatch.setattr(X, "materialize", lambda df, name: bound.append((name, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))) or write(df, name))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    index = VectorIndex.build(frame(spark, clustered(60), "unit_id"), str(tmp_path / "index"), 4, 5)
    assert index.top(frame(spark, clustered(2), "question_id"), 3).count() == 6
    assert {n for name, n in bound if name in ("bounded", "scored")} == {X.ROWS} and len([n for n, _ in bound if n in ("bounded", "scored")]) == 4
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
