"""ML-2: the registered forest has the reference's size."""

from foldwise.plans import model_queries as MQ


def test_forest_has_all_trees(spark, sf_small, monkeypatch):
    made = []

    def cv_oof(tr, te, cols, label, fold, make):
        made.append(make(tr))
        return tr.select("id")

    monkeypatch.setattr(MQ.MO, "cv_oof", cv_oof)
    MQ.cv_forest_meta(spark, sf_small)
    assert [m.getNumTrees() for m in made] == [300]


def test_tabular_frame_joins_the_applications_once(spark, sf_small, monkeypatch):
    from foldwise.plans import model_queries as MQ

    seen, plain = spark.sparkContext.accumulator(0), MQ.applications

    def counted(s, sf_dir):
        def count(it):
            for b in it:
                seen.add(b.num_rows)
                yield b
        a = plain(s, sf_dir)
        return a.mapInArrow(count, a.schema)

    n = plain(spark, sf_small).count()
    monkeypatch.setattr(MQ, "applications", counted)
    tr, te = MQ._tab_frame(spark, sf_small)
    assert tr.count() > 0 and te.count() > 0 and seen.value == n
