import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from keelson.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests")


@pytest.fixture
def rows(spark):
    """DataFrame from tuples and a DDL schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)


LEAD = "lead_id string, full_name string, email string, company_name string, country string, city string"
DOC = "lead_id string, ordinal long, url string, text string, source_type string"


@pytest.fixture
def lead(rows):
    """The lead most evidence cases use."""
    def make(**changes):
        values = {"lead_id": "L1", "full_name": "Example Person", "email": "person@example.com",
                  "company_name": "Example Co", "country": "FR", "city": "Cannes", **changes}
        return rows([tuple(values[c.split()[0]] for c in LEAD.split(", "))], LEAD)
    return make


@pytest.fixture
def docs(rows):
    def make(*items):
        return rows([("L1", i, *item) for i, item in enumerate(items, 1)], DOC)
    return make
