import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from crowdtrust.session import build_session, checkpoint_root
    s = build_session(master="local[4]", shuffle_partitions=8, app_name="crowdtrust-tests")
    checkpoint_root(s)
    yield s
    s.stop()


def votes_df(spark, rows):
    return spark.createDataFrame(rows, "prompt_id bigint, annotator_id bigint, vote int")
