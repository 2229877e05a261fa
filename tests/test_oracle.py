"""Every registered query beside its SQL, on the smallest tables.

Many queries show another column of one assessment; it is made once here and shared.
``python -m checks.compare`` runs each of them from the start.
"""

import pytest

from checks import estate
from checks.compare import compare, connect
from checks.queries import ORACLES, QUERIES
from faultline.plans import assessment, migration
from faultline.session import stage

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.fixture(scope="module", autouse=True)
def one_assessment():
    make_estate, assess = estate.estate, assessment.assess
    estates, assessments = [], {}

    def shared_estate(inputs):
        if not estates:
            estates.append(make_estate(inputs))
        return estates[0]

    def shared_assess(rich, *args, **options):
        if args or options or rich is not estates[0]:
            return assess(rich, *args, **options)
        if "rows" not in assessments:
            assessments["rows"] = stage(assess(rich), "assessment")
        return assessments["rows"]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(estate, "estate", shared_estate)
        patch.setattr(assessment, "assess", shared_assess)
        patch.setattr(migration, "assess", shared_assess)
        yield


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    good, note = compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name])
    assert good, note
