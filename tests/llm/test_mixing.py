"""Source targets, curriculum positions, whole and cut documents."""

import pytest
from odd import empty_documents, odd_documents
from pyspark.sql import functions as F

from foldframe.llm import mixing


def water(sizes, weights, budget, cap):
    """Iterated sharing: sources above their cap stop there, the excess goes to the others by weight."""
    left, out, live = budget * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while live:
        total = sum(weights[i] for i in live)
        over = [i for i in live if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in live:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        live = [i for i in live if i not in over]
    return out


@pytest.mark.parametrize("sizes", [[10, 1000, 50, 700, 3], [5], [0, 10, 0], [100, 100, 100, 100]])
def test_targets(spark, sizes):
    names = [chr(97 + i) for i in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, _n long")
    got = {r.source: r._target for r in mixing.source_targets(df, (3, 1, 2), 1.5, 2).collect()}
    want = water(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5, 2)
    assert [got[n] for n in names] == pytest.approx(want)


def test_positions_invert_the_demand():
    for curve in mixing.CURVES:
        assert mixing._areas(curve)[-1] == 1.0


def test_mix_of_odd_rows(spark):
    docs = odd_documents(spark)
    mixed = mixing.mix(mixing.sized(docs, ["doc_id", "source"])).collect()
    assert len(mixed) == docs.count()
    by = {}
    for r in mixed:
        taken = sum(e.taken for e in r._epochs)
        assert taken <= 2 * r._size and all(0 <= e.position <= 1 for e in r._epochs)
        t = by.setdefault(r.source, [0, r._target])
        t[0] += taken
    assert all(int(target) == taken for taken, target in by.values())
    again = mixing.mix(mixing.sized(docs.repartition(5), ["doc_id", "source"])).collect()
    key = lambda rows: sorted(str((r.doc_id, r._size, r._target)) for r in rows)
    assert key(mixed) == key(again)
    assert mixing.mix(mixing.sized(empty_documents(spark), ["doc_id"])).count() == 0


def test_curriculum_follows_the_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"),
                                    F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("id") % 3 + 1).cast("int")).alias("source"))
    order = mixing.training_order(mixing.mix(mixing.sized(docs, ["doc_id", "source"]))).collect()
    p = [r._position for r in order]
    assert p == sorted(p)
    early = [r.source for r in order if r._position < 0.25]
    late = [r.source for r in order if r._position > 0.75]
    assert early.count("x") > 1.5 * late.count("x") and late.count("y") > 1.5 * early.count("y")


def test_whole_documents_keep_columns(spark):
    docs = odd_documents(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
