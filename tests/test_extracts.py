from decimal import Decimal

import pytest

from works_risk.functions.cleaning import WORK_ID
from works_risk.operators.dossier import evidence_rows
from works_risk.params import Params
from works_risk.plans.master import master_from_extracts
from works_risk.schema import MASTER
from works_risk.sources.extracts import FILES, ORDINAL, read_extracts

REC = '''WORK,Work category,Work description,State,Hon'ble Members of Parliament,Constituency,Recommended date,RECOMMENDED AMOUNT   ( ₹ )
WS/MP084/2024-2025/1-Tank,Normal/Others,,Kerala,Asha Rao,North,23-Sep-2024,"3,10,000"
WS/MP084/2024-2025/1-Second copy,Other,later row,Goa,Nobody,South,24-Sep-2024,5
WS/MP084/2024-2025/2-Road,Normal/Others,"Road, with ""quotes""",Kerala,Asha Rao,North,bad date,100.50
NA-77 lost file,Normal/Others,No id,Kerala,Asha Rao,North,,7
no id at all,,,,,,,
'''
SAN = """Work,Work description,State,Hon'ble Members of Parliament,Constituency,Sanction Date,Sanction Amount ( ₹ ),Work Status
WS/MP084/2024-2025/1-Tank,Tank from sanction,Goa,Other,South,09-Oct-2024,310000,Physical Inspection
WS/MP9/2023-2024/5-Hall,Hall,Goa,Vik Sen,South,2023-10-09,9000,Done
"""
COM = """Work,Work Description,State,Hon'ble Members of Parliament,Constituency,Completion Date,Amount Disbursed ( ₹ )
WS/MP9/2023-2024/5-Hall,Hall done,Goa,Vik Sen,South,10-Jan-2024,0
WS/MP9/2023-2024/6-Wall,Wall,Goa,Vik Sen,South,10-Jan-2024,40
"""
EXP = """State,Work,Work ID,Expenditure Date,Payment Status,Fund Disbursed Amount ( ₹ ),Vendor Name
Goa,Hall,WS/MP9/2023-2024/5,01-Dec-2023,Payment Success,100,V1
Goa,Hall,WS/MP9/2023-2024/5,,Payment In-Progress,50,V1
Goa,Hall,WS/MP9/2023-2024/5,03-Dec-2023,Payment Success,25,
Goa,Only paid,WS/MP9/2023-2024/7,03-Dec-2023,Payment Success,25,V2
"""
ROSTER = """Sr. No.,State,Hon'ble Members of Parliaments,Constituency,Allocated AMOUNT ( ₹ )
1,Kerala, Asha Rao ,North,100
2,Goa,Vik Sen,South,154773472.11
3,Kerala,Asha Rao,North,200.25
4,Kerala,Blank Amount,North,
"""
CONSENT = (
    "﻿\"Sr. No.\",\"Hon'ble Members of Parliament\",\"Consent Amount ( ₹ )\"\r\n"
    '"1","Vik Sen","70,000"\r\n"2","Vik Sen","5,000"\r\n"Grand Total"," ","75,000"\r\n'
)


@pytest.fixture
def folder(tmp_path):
    for role, text in zip(FILES, (REC, SAN, COM, EXP, ROSTER, CONSENT)):
        (tmp_path / FILES[role]).write_bytes(text.encode())
    return tmp_path


def build(spark, folder, **params):
    p = Params(**params)
    return {r["work_id"]: r for r in master_from_extracts(read_extracts(spark, str(folder)), p).collect()}


def test_master(spark, folder):
    m = build(spark, folder)
    a, b, hall = m["MP084/2024-2025/1"], m["MP084/2024-2025/2"], m["MP9/2023-2024/5"]
    assert set(m) == {"MP084/2024-2025/1", "MP084/2024-2025/2", "NA-77", "MP9/2023-2024/5", "MP9/2023-2024/6", "MP9/2023-2024/7"}
    assert (a["mp_no"], a["fy"], a["work_no"], a["work_title"]) == ("084", "2024-2025", "1", "Tank")
    assert (a["mp_name"], a["state"], a["mp_state"], a["work_desc"]) == ("Asha Rao", "Kerala", "Kerala", "Tank from sanction")
    assert (a["recommended_amount"], a["sanction_amount"], a["work_status"]) == (Decimal("310000"), Decimal("310000"), "Physical Inspection")
    assert str(a["recommended_date"]) == "2024-09-23" and b["recommended_date"] is None
    assert b["work_desc"] == 'Road, with "quotes"' and not b["is_sanctioned"] and b["alloc_limit"] == Decimal("200.25")
    assert (hall["exp_pay_count"], hall["exp_total"], hall["exp_vendors"]) == (2, Decimal("175"), 1)
    assert (hall["exp_paid"], hall["exp_inprogress"]) == (Decimal("125"), Decimal("50"))
    assert hall["amount_disbursed"] == Decimal("175") and m["MP9/2023-2024/6"]["amount_disbursed"] == Decimal("40")
    assert hall["alloc_limit"] == Decimal("154773472.11") and hall["calamity_consent"] == Decimal("5000")
    assert hall["work_category"] == "" and hall["is_sanctioned"] and hall["is_completed"] and not hall["is_recommended"]
    paid = m["MP9/2023-2024/7"]
    assert paid["has_expenditure"] and paid["state"] == "" and paid["alloc_limit"] == 0
    assert m["NA-77"]["mp_no"] == "77" and m["NA-77"]["fy"] == ""


def test_switches(spark, folder):
    m = build(spark, folder, drop_unparseable=True, names_from_expenditure=True, split_payments=False, consent_mode="sum", money_mode="digits")
    assert "NA-77" not in m
    assert m["MP9/2023-2024/7"]["state"] == "Goa"
    hall = m["MP9/2023-2024/5"]
    assert (hall["exp_inprogress"], hall["exp_paid"]) == (0, Decimal("175"))
    assert hall["calamity_consent"] == Decimal("75000") and hall["alloc_limit"] == Decimal("15477347211")


def test_missing_files(spark, tmp_path):
    with pytest.raises(ValueError):
        read_extracts(spark, str(tmp_path))
    (tmp_path / FILES["completed"]).write_text(COM)
    raw = read_extracts(spark, str(tmp_path), tolerant=True)
    m = master_from_extracts(raw, Params())
    assert m.columns[: len(MASTER.fieldNames())] == MASTER.fieldNames()
    assert m.count() == 2 and m.filter("is_recommended or is_sanctioned").count() == 0


def test_upper_house_file_names(spark, folder):
    (folder / "Allocated Limit for Honble MPs.csv").write_text(
        "Sr. No.,State,Hon'ble Members of Parliament,Elected/Nominated,Allocated AMOUNT ( ₹ )\n1,Goa,Vik Sen,Elected MP,12.50\nGrand Total,,,,12.50\n"
    )
    raw = read_extracts(spark, str(folder), chamber="rs")
    m = {r["work_id"]: r for r in master_from_extracts(raw, Params(chamber="rs")).collect()}
    assert m["MP9/2023-2024/5"]["alloc_limit"] == Decimal("12.50") and m["NA-77"]["chamber"] == "rs"


def test_file_order_survives_splitting(spark, tmp_path):
    lines = ["Work,Work Description,Amount Disbursed ( ₹ )"]
    lines += [f"WS/MP1/2020-2021/{i % 50}-x,row {i:05d},{i}" for i in range(20000)]
    (tmp_path / FILES["completed"]).write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        raw = read_extracts(spark, str(tmp_path))
        assert raw.get("completed").rdd.getNumPartitions() > 4
        m = master_from_extracts(raw, Params()).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["work_desc"] for r in m) == [f"row {i:05d}" for i in range(50)]


def test_evidence_row_choice(spark, folder):
    raw = read_extracts(spark, str(folder))
    works = spark.createDataFrame([("MP9/2023-2024/5",), ("MP084/2024-2025/1",)], "work_id string")
    got = {r["work_id"]: r["row_text"] for r in evidence_rows(raw.get("expenditure"), ORDINAL, WORK_ID).join(works, "work_id", "left_semi").collect()}
    assert got == {
        "MP9/2023-2024/5": "State: Goa; Work: Hall; Work ID: WS/MP9/2023-2024/5; Expenditure Date: 01-Dec-2023; Payment Status: Payment Success; "
        "Fund Disbursed Amount ( ₹ ): 100"
    }
    rec = {r["work_id"]: r["row_text"] for r in evidence_rows(raw.get("recommended"), ORDINAL, WORK_ID).collect()}
    assert rec["MP084/2024-2025/1"].startswith("WORK: WS/MP084/2024-2025/1-Tank; Work category: Normal/Others; Work description: nan; State: Kerala")
    both = spark.createDataFrame(
        [(1, "see MP1/2020-2021/1", "MP1/2020-2021/2"), (2, "none", "MP1/2020-2021/1"), (3, "MP1/2020-2021/2", "x")],
        "_ordinal int, work string, status string",
    )
    hits = {r["work_id"]: r["row_text"] for r in evidence_rows(both, "_ordinal", WORK_ID).collect()}
    assert hits["MP1/2020-2021/1"].startswith("work: see") and hits["MP1/2020-2021/2"].startswith("work: MP1/2020-2021/2")
