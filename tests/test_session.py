import pytest

from spatialframes import session


def test_shared_dir_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_settle_keeps_rows_and_schema(spark):
    df = spark.range(10).selectExpr("id", "array(struct(id AS a, 'x' AS b)) AS s", "CAST(id AS decimal(28,12)) AS d")
    out = session.settle(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert sorted(out.collect()) == sorted(df.collect())


def test_a_cluster_without_a_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Fake:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake())
