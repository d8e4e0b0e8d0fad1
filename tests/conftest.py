import pytest

from plumbline import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = build_session(
        "local[8]",
        "plumbline-tests",
        **{
            "spark.sql.shuffle.partitions": 4,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(base / "checkpoints"),
            "spark.sql.warehouse.dir": str(base / "warehouse"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def split_small(spark):
    """Send every ordered operator down its distributed path, with pieces of about fifty rows."""
    spark.conf.set("plumbline.task.rows", "50")
    yield
    spark.conf.unset("plumbline.task.rows")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
