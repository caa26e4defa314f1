import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from evidex.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4)


@pytest.fixture
def write_json(tmp_path):
    def write(name, value):
        path = tmp_path / name
        path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
        return str(path)

    return write


# Spellings that the alias tables must bring together.
SPELLINGS = {"skills": ["Postgres", "Postgre SQL", "Python"], "technologies": ["AWS"]}
ADA = SPELLINGS | {
    "id": "p-0417",
    "full_name": "Ada Brandt",
    "current_title": "Ledger Engineer",
    "summary": "Keeps the books of small banks in order.",
    "location": "Berlin",
    "country": "Germany",
    "age": 36,
    "years_experience": 8,
    "domains": ["FinTech"],
    "education": [{"degree": "Diplom", "university": "HTW Berlin"}],
    "projects": [{"name": "Dunning Letters", "domains": ["Billing"], "technologies": ["GNN"]}],
    "experience": [
        {
            "company": "Norvik",
            "start_date": "2020-09",
            "title": "Bookkeeper of machines",
            "technologies": ["K8s"],
            "domains": ["FinTech"],
            "description": "Moved FinTech ledgers to K8s.",
        }
    ],
}


@pytest.fixture
def ada():
    return json.loads(json.dumps(ADA))
