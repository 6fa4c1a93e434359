"""Registered queries vs their DuckDB oracle on sf0.001 (the driver's gate
runs all of them at sf0.01; here a fast subset)."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF0001
from tools.compare import digest

FAST = ["b1_votes", "p8_vote_compaction", "a10_vote_profile", "e10_majority_vote", "m3_majority_accuracy",
        "e1_onecoin_trust_k5", "e2_onecoin_alpha_k5", "m5_onecoin_history_k5", "e4_twocoin_trust_k5",
        "e4_twocoin_legacy_trust_k5", "e11_known_worker_vote", "e7_prior_injection_k3", "d2_preference_logit",
        "d4_hard_label_loss", "d5_projected_loss_k5", "d9_policy_accuracy", "p1_orientation", "b3_pair_votes",
        "r1_sparsify_l2", "r2_corrupt_adv15", "r3_restrict_crowd_n50", "r9_balanced_assignment", "k2_vocab"]


@pytest.fixture(scope="module")
def con():
    from crowdtrust.sources.fixtures import TABLES
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF0001)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["prompt_id", "trust_weight", "hard_label", "majority_label", "n_votes"]
    assert df.count() == 1473
