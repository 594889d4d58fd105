import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from earshot.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def middle_dir():
    return "/root/testdata/sf0.01"


@pytest.fixture
def plays_of(spark):
    """Plays from (event_id, user, 'yyyy-MM-dd HH:mm:ss') with fillers for the other columns."""
    from pyspark.sql import functions as F

    def make(rows, **columns):
        df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, at string")
        df = df.withColumn("timestamp", F.col("at").cast("timestamp")).drop("at")
        fill = {
            "track_uri": F.lit("track:1"), "platform": F.lit("iOS"), "ms_played": F.lit(1000).cast("bigint"),
            "track_name": F.lit("t"), "artist_name": F.lit("a"), "album_name": F.lit("b"), "reason_start": F.lit("trackdone"),
            "reason_end": F.lit("trackdone"), "shuffle": F.lit(False), "skipped": F.lit(False),
        }
        return df.withColumns(fill | columns)

    return make
