"""Raw extracts of the works scheme: files, headers and cleaned stage tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from works_risk.functions.cleaning import blank_to_null, day, money, trim_name, unreadable_money, work_id_or_token, work_title
from works_risk.operators.ordering import last_per_key
from works_risk.params import Params
from works_risk.sources.quoted_csv import CORRUPT, read_quoted

# File name of each role.
FILES = {
    "recommended": "Works Recommended.csv",
    "sanctioned": "Works Sanctioned.csv",
    "completed": "Works Completed.csv",
    "expenditure": "Expenditure on Completed and On-going Works as on Date.csv",
    "roster": "18th lok sabha allocated limit for honble MPs.csv",
    "consent": "Amount consented for Calamity.csv",
}
UPPER_HOUSE_FILES = {"roster": "Allocated Limit for Honble MPs.csv"}
WORK_ROLES = ("recommended", "sanctioned", "completed", "expenditure")

# Header names, first present one wins.
MEMBER = ("Hon'ble Members of Parliament", "Hon'ble Members of Parliaments")
ID_HEADERS = {
    "recommended": ("WORK", "Work"),
    "sanctioned": ("Work",),
    "completed": ("Work",),
    "expenditure": ("Work ID",),
}
DESCRIPTION = ("Work description", "Work Description")
CATEGORY = ("Work category", "Work Category")
RECOMMENDED_AMOUNT = ("RECOMMENDED AMOUNT   ( ₹ )", "Recommended Amount")

# Amounts by role, for counting those that hold no number.
AMOUNT_HEADERS = {
    "recommended": RECOMMENDED_AMOUNT,
    "sanctioned": ("Sanction Amount ( ₹ )",),
    "completed": ("Amount Disbursed ( ₹ )",),
    "expenditure": ("Fund Disbursed Amount ( ₹ )",),
    "roster": ("Allocated AMOUNT ( ₹ )",),
    "consent": ("Consent Amount ( ₹ )",),
}

ORDINAL = "_ordinal"
# A folder of extracts may hold one folder per delivery, whose names sort in order of arrival.
DELIVERY = "delivery="


@dataclass(frozen=True)
class Extracts:
    """Raw tables by role; a role without a file is absent. ``marked`` has all rows, with the text of malformed ones."""

    tables: dict[str, DataFrame]
    marked: dict[str, DataFrame] = field(default_factory=dict)

    def get(self, role: str) -> DataFrame | None:
        return self.tables.get(role)


def read_marked(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All-text scan of a CSV file or folder with its file order as ``_ordinal``; the text of a row that has more or fewer
    fields than the header is in ``_corrupt_record``.

    Files are split over tasks, with ``multi_line``, for quoted fields that hold line breaks, by ``read_quoted``.
    """
    if multi_line:
        rows = read_quoted(spark, path)
        place = F.struct(F.col("file").alias("file_path"), F.col("block").alias("file_block_start"), "at")
        return rows.withColumn(ORDINAL, place).drop("file", "block", "at")
    header = spark.read.option("header", True).option("escape", '"').csv(path).schema
    rows = (
        spark.read.schema(T.StructType([*header.fields, T.StructField(CORRUPT, T.StringType())]))
        .option("header", True)
        .option("escape", '"')
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)  # a row is malformed by all of its fields, whichever are asked for
        .csv(path)
    )
    place = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("at")
    )
    return rows.select("*", place.alias(ORDINAL))


def usable(marked: DataFrame, tolerant: bool) -> DataFrame:
    """The rows to work on: all of them as far as they could be read, or with ``tolerant`` those that fit the header."""
    kept = marked.filter(F.col(CORRUPT).isNull()) if tolerant else marked
    return kept.drop(CORRUPT)


def read_csv(spark: SparkSession, path: str, multi_line: bool = False, tolerant: bool = False) -> DataFrame:
    """``read_marked`` without the mark. ``tolerant`` skips malformed lines."""
    return usable(read_marked(spark, path, multi_line), tolerant)


def land(marked: DataFrame, path: str) -> DataFrame:
    """Write a marked table once, so that no later step parses text again and losses are counted in the rows as read.

    Rows stay in the order of the file, and the compression looks back over many of them, so a text that follows its copy is small.
    """
    marked.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return marked.sparkSession.read.parquet(path)


def losses(raw: Extracts) -> DataFrame:
    """``role, rows, malformed, unreadable_amounts`` of every role that has a file: rows as delivered, rows that do not fit
    their header, and amounts of the others that are there but hold no number (and count as 0)."""
    counted = []
    for role, marked in raw.marked.items():
        bad = F.col(CORRUPT).isNotNull()
        amount = field_of(marked, AMOUNT_HEADERS[role])
        counted.append(
            marked.agg(
                F.count(F.lit(1)).alias("rows"),
                F.count_if(bad).alias("malformed"),
                F.count_if(~bad & unreadable_money(amount)).alias("unreadable_amounts"),
            ).select(F.lit(role).alias("role"), "rows", "malformed", "unreadable_amounts")
        )
    return reduce(DataFrame.unionByName, counted)


def deliveries(spark: SparkSession, folder: str) -> list[str]:
    """Folders to look for files in, newest first: ``delivery=<id>`` by descending id, then ``folder`` itself."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{DELIVERY}*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    names = sorted((status.getPath().getName() for status in found), reverse=True)
    return [*[f"{folder}/{name}" for name in names], folder]


def read_extracts(
    spark: SparkSession,
    folder: str,
    chamber: str = "ls",
    multi_line: bool = False,
    tolerant: bool = False,
    landing: str | None = None,
) -> Extracts:
    """Read every role that has a file; at least one work-bearing file must be there.

    A later delivery may bring some files again under their names: of each role the newest delivery that has it counts.
    With ``landing`` the tables are written there first and read back.
    """
    names = FILES | (UPPER_HOUSE_FILES if chamber == "rs" else {})
    places = deliveries(spark, folder)
    marked = {}
    for role, name in names.items():
        for place in places:
            try:
                marked[role] = read_marked(spark, f"{place}/{name}", multi_line)
                break
            except AnalysisException as missing:
                if missing.getCondition() != "PATH_NOT_FOUND":
                    raise
    if not any(role in marked for role in WORK_ROLES):
        raise ValueError(f"no extract with work ids in {folder}")
    if landing is not None:
        marked = {role: land(rows, f"{landing}/{role}") for role, rows in marked.items()}
    return Extracts({role: usable(rows, tolerant) for role, rows in marked.items()}, marked)


def field_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of several header names that the table has, else NULL."""
    found = next((n for n in names if n in df.columns), None)
    return F.lit(None).cast("string") if found is None else F.col(f"`{found}`")


def _ids(df: DataFrame, role: str, params: Params) -> Column:
    return work_id_or_token(field_of(df, ID_HEADERS[role]), params.drop_unparseable)


def description(df: DataFrame) -> Column:
    return blank_to_null(field_of(df, DESCRIPTION))


def _who_and_what(df: DataFrame) -> dict[str, Column]:
    return {
        "work_desc": description(df),
        "state": blank_to_null(field_of(df, ("State",))),
        "mp_name": blank_to_null(field_of(df, MEMBER)),
        "constituency": blank_to_null(field_of(df, ("Constituency",))),
    }


def recommended(df: DataFrame, params: Params) -> DataFrame:
    return _stage(
        df,
        _ids(df, "recommended", params),
        **_who_and_what(df),
        work_title=work_title(field_of(df, ID_HEADERS["recommended"])),
        work_category=blank_to_null(field_of(df, CATEGORY)),
        recommended_date=day(field_of(df, ("Recommended date",))),
        recommended_amount=money(field_of(df, RECOMMENDED_AMOUNT), params.money_mode),
    )


def sanctioned(df: DataFrame, params: Params) -> DataFrame:
    return _stage(
        df,
        _ids(df, "sanctioned", params),
        **_who_and_what(df),
        work_title=work_title(field_of(df, ID_HEADERS["sanctioned"])),
        work_status=blank_to_null(field_of(df, ("Work Status",))),
        sanction_date=day(field_of(df, ("Sanction Date",))),
        sanction_amount=money(field_of(df, ("Sanction Amount ( ₹ )",)), params.money_mode),
    )


def completed(df: DataFrame, params: Params) -> DataFrame:
    return _stage(
        df,
        _ids(df, "completed", params),
        **_who_and_what(df),
        work_title=work_title(field_of(df, ID_HEADERS["completed"])),
        completion_date=day(field_of(df, ("Completion Date",))),
        amount=money(field_of(df, ("Amount Disbursed ( ₹ )",)), params.money_mode),
    )


def expenditure(df: DataFrame, params: Params) -> DataFrame:
    return _stage(
        df,
        _ids(df, "expenditure", params),
        **_who_and_what(df),
        paid_on=blank_to_null(field_of(df, ("Expenditure Date",))),
        payment_status=blank_to_null(field_of(df, ("Payment Status",))),
        amount=money(field_of(df, ("Fund Disbursed Amount ( ₹ )",)), params.money_mode),
        vendor=blank_to_null(field_of(df, ("Vendor Name",))),
    )


def _stage(df: DataFrame, work: Column, **cols: Column) -> DataFrame:
    named = [c.alias(name) for name, c in cols.items()]
    return df.select(work.alias("work_id"), *named, ORDINAL).filter(F.col("work_id").isNotNull())


STAGES = {
    "recommended": recommended,
    "sanctioned": sanctioned,
    "completed": completed,
    "expenditure": expenditure,
}


def _numbered(df: DataFrame) -> DataFrame:
    """Without the total row, whose serial number is not a number."""
    return df.filter(trim_name(field_of(df, ("Sr. No.",))).rlike(r"^\d+$")) if "Sr. No." in df.columns else df


def roster(df: DataFrame, params: Params) -> DataFrame:
    """``mp_name, alloc_limit``; the last row of a name counts."""
    rows = _numbered(df).select(
        trim_name(field_of(df, MEMBER)).alias("mp_name"),
        money(field_of(df, ("Allocated AMOUNT ( ₹ )",)), params.money_mode).alias("alloc_limit"),
        ORDINAL,
    )
    return last_per_key(rows, ["mp_name"], F.col(ORDINAL)).drop(ORDINAL)


def consent(df: DataFrame, params: Params) -> DataFrame:
    """``mp_name, calamity_consent``; the last row of a name, or the sum of its rows."""
    rows = _numbered(df).select(
        trim_name(field_of(df, MEMBER)).alias("mp_name"),
        money(field_of(df, ("Consent Amount ( ₹ )",)), params.money_mode).alias("calamity_consent"),
        ORDINAL,
    )
    if params.consent_mode == "sum":
        return rows.groupBy("mp_name").agg(F.sum("calamity_consent").cast("decimal(18,2)").alias("calamity_consent"))
    return last_per_key(rows, ["mp_name"], F.col(ORDINAL)).drop(ORDINAL)
