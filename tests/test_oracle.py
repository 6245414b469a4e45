"""Every query against its SQL on the smallest tables; queries without SQL must return rows."""

import pathlib

import pytest

from lexiloom.plans import catalog
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"
SLOW = {  # whole learned jobs; tests/test_jobs.py runs them on a small corpus
    "baseline_features_job", "baseline_probes_job", "baseline_first_errors", "word_vectors_job", "evaluation_job",
    "retrieval_report_job", "latent_report_job", "latent_insights", "svm_probe",
}

pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, con, name):
    assert check(spark, con, SF, catalog.queries()[name], catalog.oracle_sql()[name], True) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_query_returns_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_catalogue_is_consistent():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
