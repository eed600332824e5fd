"""The whole batch job, from raw extracts or a prebuilt master to written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from works_risk.functions.vectors import EmbedMany, hashed_trigrams
from works_risk.operators.aggregate import load_summary, offenders, per_mp, ranked, summary
from works_risk.operators.dossier import build_dossiers
from works_risk.operators.duplicates import Sweep, signals_from_links, signals_from_sweep
from works_risk.operators.search import anchor_table
from works_risk.operators.texts import KEY, TEXT, beside, distinct_texts, with_descriptions
from works_risk.params import Params
from works_risk.plans.detect import Earlier, detect, detect_live, live_signals
from works_risk.plans.master import descriptions, master_from_extracts
from works_risk.session import scratch
from works_risk.sources import runs, sinks
from works_risk.sources.extracts import DESCRIPTION, ORDINAL, Extracts, losses, read_extracts


#: What a run must hold to be read back.
TABLES = ("flags", "mps", "anchors")


@dataclass(frozen=True)
class Result:
    """Tables of one run, read back from where they were written."""

    path: str
    flags: DataFrame
    mps: DataFrame
    anchors: DataFrame
    summary: DataFrame
    offenders: DataFrame

    def table(self, name: str) -> DataFrame:
        """Another table of the run: master, texts, losses or dossiers."""
        return self.flags.sparkSession.read.parquet(f"{self.path}/{name}")


def stored(spark: SparkSession, out: str) -> Result:
    """The newest run that was published whole."""
    path = runs.newest(spark, out, TABLES)
    if path is None:
        raise FileNotFoundError(f"no published run in {out}")
    written, mps, anchors = (spark.read.parquet(f"{path}/{name}") for name in TABLES)
    flags = with_descriptions(written, spark.read.parquet(f"{path}/texts")) if KEY in written.columns else written
    return Result(path, flags, mps, anchors, summary(written), offenders(mps))


def write_texts(spark: SparkSession, raws: Iterable[Extracts], path: str) -> DataFrame:
    """Each description of the extracts once, written and read back."""
    distinct_texts(reduce(DataFrame.unionByName, map(descriptions, raws))).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def side_by_side(keyed: DataFrame, texts: DataFrame) -> DataFrame:
    """Works with their descriptions and keys, copies next to each other, for a compressed file."""
    named = beside(keyed, texts, F.col("work_id"))
    return named.withColumn(TEXT, F.coalesce(TEXT, F.lit("")))


def publish(
    flags: DataFrame,
    out: str,
    embed_many: EmbedMany = hashed_trigrams,
    anchors: int | None = None,
    run: str | None = None,
    further: Callable[[DataFrame, str], list[str]] | None = None,
    texts: DataFrame | None = None,
) -> Result:
    """Write flags, roll-up and anchors into a run of ``out`` and commit it. Later steps read the written flags.

    ``further`` writes more tables of the run, given the flags and its folder, and names them. Until all are written the run
    before this one stays the newest. Flags that carry ``text_id`` come with their ``texts``, written in the run as such.
    """
    spark, run = flags.sparkSession, run or runs.begin(out)
    sinks.write_flags(flags, f"{run}/flags")
    written = spark.read.parquet(f"{run}/flags")
    sinks.write_mps(ranked(per_mp(written)), f"{run}/mps")
    anchor_table(written, anchors, embed_many, texts).write.mode("overwrite").option("compression", "zstd").parquet(f"{run}/anchors")
    more = further(written, run) if further else []
    runs.commit(spark, out, run, [*TABLES, *more])
    return stored(spark, out)


def raw_tables(raw: Extracts) -> dict[str, DataFrame]:
    return {role: raw.get(role) for role in ("recommended", "sanctioned", "completed", "expenditure") if raw.get(role) is not None}


def run_extracts(
    spark: SparkSession,
    folder: str,
    out: str,
    params: Params,
    embed_many: EmbedMany | None = hashed_trigrams,
    dossier_limit: int | None = None,
    anchors: int | None = None,
    multi_line: bool = False,
    tolerant: bool = False,
    dossier_files: bool = False,
    since: str | None = None,
) -> Result:
    """Extracts to written flags, roll-up, anchors and dossiers.

    ``dossier_limit`` and ``anchors`` keep only the riskiest works; by default every flagged work gets both. ``multi_line``
    and ``tolerant`` are those of ``read_csv``. ``since`` names the folder of an earlier run: blocks of works in which nothing
    changed since then keep their duplicate signals, and the works compared again are in the table ``compared``.
    Between the steps works carry the key of their description; the run keeps each text once in the table ``texts``.
    A run of other settings, or whose signals are not whole, is not gone on from. ``dossier_files`` also writes a file per dossier, for a limited number of them.
    """
    run = runs.begin(out)
    raw = read_extracts(spark, folder, params.chamber, multi_line, tolerant, f"{run}/raw")
    texts = write_texts(spark, [raw], f"{run}/texts")
    built = side_by_side(master_from_extracts(raw, params, keyed=True), texts)
    built.write.mode("overwrite").option("compression", "zstd").parquet(f"{run}/master")
    losses(raw).write.mode("overwrite").parquet(f"{run}/losses")
    master = spark.read.parquet(f"{run}/master").drop(TEXT)

    earlier = _earlier(spark, since, params, embed_many)
    signals, source, again = live_signals(master, params, embed_many, earlier, texts)
    compared = master if again is None else again
    compared.select("work_id").write.mode("overwrite").parquet(f"{run}/compared")
    if signals is not None:
        basis = F.lit(_basis(params, embed_many) if source == "live" else source).alias("basis")
        signals.select("*", basis).write.mode("overwrite").parquet(f"{run}/signals")
        signals = spark.read.parquet(f"{run}/signals").drop("basis")
    judged = detect(master, params, signals).withColumn("dup_source", F.lit(source))

    def further(flags: DataFrame, path: str) -> list[str]:
        built = build_dossiers(flags, raw_tables(raw), ORDINAL, dossier_limit, texts=texts, long=DESCRIPTION)
        sinks.write_dossiers(built, f"{path}/dossiers")
        if dossier_files:
            sinks.write_dossier_files(spark.read.parquet(f"{path}/dossiers"), f"{path}/files")
        return ["master", "texts", "losses", "compared", "dossiers"]

    return publish(judged, out, embed_many or hashed_trigrams, anchors, run, further, texts)


def _basis(params: Params, embed_many: EmbedMany | None) -> str:
    """What signals depend on besides the works."""
    name = getattr(embed_many, "__qualname__", repr(embed_many))
    used = (params.amount_grain, params.block_on_category, params.duplicate_cosine, params.cross_year_only, params.max_texts)
    return f"{name} {used}"


def _earlier(spark: SparkSession, since: str | None, params: Params, embed_many: EmbedMany | None) -> Earlier | None:
    if since is None or embed_many is None or params.max_texts is not None:
        return None
    try:
        signals = spark.read.parquet(f"{since}/signals")
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    first = signals.first()
    if first is None or first["basis"] != _basis(params, embed_many):
        return None
    master = spark.read.parquet(f"{since}/master")
    return Earlier(master.drop(TEXT), signals.drop("basis")) if KEY in master.columns else None


def run_chambers(
    spark: SparkSession,
    folders: dict[str, str],
    out: str,
    params: Params,
    embed_many: EmbedMany | None = hashed_trigrams,
    multi_line: bool = False,
    tolerant: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Both houses in one job, each with its own extracts: flags and roll-up by ``chamber``, read back from ``out``.

    Each table has a partition per chamber. Only partitions of the given houses are replaced, so one house can be run again
    alone. Works carry the key of their description until the flags are written. Shares, medians and blocks are those of a house, so the result of a house does not depend on the other.
    """
    landed = scratch(spark, "chambers")
    raws = {c: read_extracts(spark, folder, c, multi_line, tolerant, f"{landed}/{c}") for c, folder in folders.items()}
    texts = write_texts(spark, raws.values(), f"{landed}/texts")
    masters = [master_from_extracts(raw, replace(params, chamber=chamber), keyed=True) for chamber, raw in raws.items()]
    reduce(DataFrame.unionByName, masters).write.partitionBy("chamber").parquet(f"{landed}/master")
    master = spark.read.parquet(f"{landed}/master")

    def by_house(make: Callable[[str], DataFrame], name: str) -> DataFrame:
        path = f"{out}/{name}"
        for chamber in folders:
            # Into the house's own folder: a write that deals rows to folders would sort them first.
            made = make(chamber).write.mode("overwrite").option("compression", "zstd")
            made.parquet(f"{path}/chamber={chamber}")
        return spark.read.parquet(path)

    def of(table: DataFrame, chamber: str) -> DataFrame:
        return table.filter(F.col("chamber") == chamber).drop("chamber")

    def judged(chamber: str) -> DataFrame:
        found = side_by_side(detect_live(of(master, chamber), params, embed_many, texts), texts)
        return found.select(*[TEXT if c == KEY else c for c in found.columns if c != TEXT])

    flags = by_house(judged, "flags")
    mps = by_house(lambda chamber: ranked(per_mp(of(flags, chamber))), "mps")
    return flags, mps


def run_master(
    master: DataFrame, sweep: DataFrame | Sweep | None, model: str, out: str, params: Params
) -> Result:
    """A prebuilt master with a prebuilt sweep, stored as links or as a table of pairs, to written tables."""
    if sweep is None:
        signals = None
    elif isinstance(sweep, Sweep):
        signals = signals_from_links(sweep, model, master, params)
    else:
        signals = signals_from_sweep(sweep, model, master, params)
    return publish(detect(master, params, signals), out)


def load_or_run(spark: SparkSession, folder: str, out: str, params: Params) -> tuple[DataFrame, Result]:
    """Use the newest run that was published whole, else run; with a one-row load summary."""
    path = runs.newest(spark, out, TABLES)
    result = stored(spark, out) if path else run_extracts(spark, folder, out, params)
    loaded = load_summary(result.flags, "precomputed" if path else "built").withColumn("detected_at", F.current_timestamp())
    return loaded, result
