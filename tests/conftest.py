import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from works_risk.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def work(spark):
    """Rows of the flags table with quiet defaults."""
    import datetime as dt
    from decimal import Decimal

    from pyspark.sql import types as T

    from works_risk.schema import FLAG_COLUMNS, MASTER

    extra = [T.StructField(c, T.BooleanType()) for c in (*FLAG_COLUMNS, "has_duplicate_lead", "is_anomaly")]
    schema = T.StructType([*MASTER.fields, *extra])

    def make(*rows, keep=None):
        zero = Decimal("0.00")
        base = {
            "mp_no": "1", "fy": "2024-2025", "work_no": "1", "mp_name": "A", "mp_state": "S", "state": "S",
            "constituency": "C", "work_category": "", "work_desc": "", "work_status": "",
            "recommended_date": None, "recommended_amount": zero, "sanction_date": None, "sanction_amount": zero,
            "completion_date": None, "amount_disbursed": zero, "exp_pay_count": 0, "exp_total": zero,
            "exp_inprogress": zero, "exp_paid": zero, "exp_vendors": 0, "alloc_limit": zero, "calamity_consent": zero,
            "is_recommended": True, "is_sanctioned": False, "is_completed": False, "has_expenditure": False,
        }
        full = []
        for n, row in enumerate(rows):
            merged = {f.name: False for f in extra} | base | {"work_id": f"MP1/2024-2025/{n}"} | row
            for k, v in merged.items():
                if isinstance(schema[k].dataType, T.DecimalType) and v is not None:
                    merged[k] = Decimal(str(v))
                if isinstance(schema[k].dataType, T.DateType) and isinstance(v, str):
                    merged[k] = dt.date.fromisoformat(v)
            full.append(tuple(merged[f.name] for f in schema.fields))
        return spark.createDataFrame(full, schema)

    return make
