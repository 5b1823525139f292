"""Record text to typed rows: parse, judge, split off what is unusable, and narrow the types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions import expressions as X

#: Header keys of a record, and the numeric value of each result.
HEADERS = ("Event", "Site", "UTCDate", "Date", "UTCTime", "White", "Black", "Result", "WhiteElo", "BlackElo", "WhiteRatingDiff", "BlackRatingDiff", "ECO", "Opening", "TimeControl", "Termination")
UNFINISHED = "*"
RESULT_VALUES = {"1-0": 1.0, "0-1": 0.0, "1/2-1/2": 0.5}
SILVER_TYPES = {"WhiteElo": "smallint", "BlackElo": "smallint", "EloAvg": "smallint", "NumMoves": "smallint", "WhiteRatingDiff": "smallint", "BlackRatingDiff": "smallint"}
SILVER_KEEP = ("Result", "WhiteElo", "BlackElo", "EloAvg", "NumMoves", "WhiteRatingDiff", "BlackRatingDiff", "ECO", "Termination", "TimeControl", "Moves")


@dataclass(frozen=True)
class QualityRules:
    """Rules in their order; a bound of 0 is off."""

    require_result: bool = True
    require_moves: bool = True
    min_moves: int = 5
    max_moves: int = 0
    require_elo: bool = True
    min_elo: int = 0
    max_elo: int = 0


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a generator of one row, so that each is evaluated once.

    Filters on columns of a projection are pushed below it with the whole expression in place of every reference; they
    are not pushed below a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def parse_headers(df: DataFrame, keys: Sequence[str] = HEADERS, record: str = "record") -> DataFrame:
    """A column per header key, null where the record has none; the header block is cut and matched once for all keys."""
    names, values = X.header_lists(F.col(record))
    listed = once(df, __names=names, __values=values)
    return listed.select(*df.columns, *[X.header_value(F.col("__names"), F.col("__values"), k).alias(k) for k in keys])


def detect_parse_errors(df: DataFrame, mandatory: str = "Event", record: str = "record") -> DataFrame:
    """``is_error``: the mandatory header or the body is missing."""
    return df.withColumn("is_error", X.header(F.col(record), mandatory).isNull() | X.movetext(F.col(record)).isNull())


def parse_records(df: DataFrame) -> DataFrame:
    """Header columns, derived columns and ``is_error`` of records."""
    parsed = once(parse_headers(once(df, __body=X.movetext(F.col("record")))), __tokens=X.tokenize_moves(F.col("__body")), __white=X.safe_positive_int(F.col("WhiteElo")), __black=X.safe_positive_int(F.col("BlackElo")))
    tokens, white, black = F.col("__tokens"), F.col("__white"), F.col("__black")
    return parsed.select(
        "record",
        (F.col("Event").isNull() | F.col("__body").isNull()).alias("is_error"),
        X.entity_id_from_url(F.col("Site")).alias("GameID"),
        X.coalesce_headers(F.col("Event")).alias("Event"),
        X.coalesce_headers(F.col("UTCDate"), F.col("Date")).alias("Date"),
        X.coalesce_headers(F.col("UTCTime")).alias("Time"),
        X.coalesce_headers(F.col("White")).alias("White"),
        X.coalesce_headers(F.col("Black")).alias("Black"),
        X.coalesce_headers(F.col("Result")).alias("Result"),
        white.alias("WhiteElo"),
        black.alias("BlackElo"),
        X.floor_mean(white, black).alias("EloAvg"),
        F.coalesce(F.size(tokens), F.lit(0)).alias("NumMoves"),
        X.coalesce_headers(F.col("WhiteRatingDiff")).alias("WhiteRatingDiff"),
        X.coalesce_headers(F.col("BlackRatingDiff")).alias("BlackRatingDiff"),
        X.coalesce_headers(F.col("ECO")).alias("ECO"),
        X.coalesce_headers(F.col("Opening")).alias("Opening"),
        X.coalesce_headers(F.col("TimeControl")).alias("TimeControl"),
        X.coalesce_headers(F.col("Termination")).alias("Termination"),
        F.coalesce("__body", F.lit("")).alias("Moves"),
        F.col("WhiteElo").alias("WhiteEloHeader"),
        F.col("BlackElo").alias("BlackEloHeader"),
    )


def quality_filter(df: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """``skip_reason`` and ``skip_detail`` of the first rule that a row breaks; null if none.

    Bounds hold for each side: a missing score counts as 0 for the lower and as 9999 for the upper one.  The detail of a missing
    score has both headers as they stood, where the rows carry them (``WhiteEloHeader``, ``BlackEloHeader``).
    """
    moves, result = F.col("NumMoves"), F.coalesce(F.col("Result"), F.lit(""))
    sides = {"W": F.col("WhiteElo"), "B": F.col("BlackElo")}
    missing = sides["W"].isNull() | sides["B"].isNull()
    low = F.least(*[F.coalesce(c, F.lit(0)) for c in sides.values()])
    high = F.greatest(*[F.coalesce(c, F.lit(9999)) for c in sides.values()])
    told = lambda given: F.concat_ws(" ", *[F.concat(F.lit(f"{side}="), F.coalesce(c.cast("string"), F.lit("None"))) for side, c in given.items()])
    both = told(sides)
    raw = {"W": "WhiteEloHeader", "B": "BlackEloHeader"}
    stood = told({side: F.col(c) for side, c in raw.items()} if set(raw.values()) <= set(df.columns) else sides)
    checks: list[tuple[bool, Column, str, Column]] = [
        (rules.require_result, result == UNFINISHED, "unfinished", result),
        (rules.require_moves, moves == 0, "no_moves", F.lit("")),
        (rules.min_moves > 0, moves < rules.min_moves, "too_short", F.concat(moves.cast("string"), F.lit(f"<{rules.min_moves}"))),
        (rules.max_moves > 0, moves > rules.max_moves, "too_long", F.concat(moves.cast("string"), F.lit(f">{rules.max_moves}"))),
        (rules.require_elo, missing, "missing_elo", stood),
        (rules.min_elo > 0, low < rules.min_elo, "elo_too_low", both),
        (rules.max_elo > 0, high > rules.max_elo, "elo_too_high", both),
    ]
    reason = detail = F.lit(None).cast("string")
    for on, broken, name, text in reversed(checks):
        if on:
            reason, detail = F.when(broken, name).otherwise(reason), F.when(broken, text).otherwise(detail)
    return df.withColumns({"skip_reason": reason, "skip_detail": detail})


def skip_reason_counts(df: DataFrame) -> DataFrame:
    """(reason, n), most frequent first; rows that could not be parsed count under ``error``."""
    reason = F.when(F.col("is_error"), "error").otherwise(F.col("skip_reason"))
    return df.withColumn("reason", reason).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def part_of() -> Column:
    """The part of a judged row: usable, skipped (a rule is broken) or errors (it could not be parsed)."""
    return F.when(F.col("is_error"), "errors").when(F.col("skip_reason").isNotNull(), "skipped").otherwise("usable")


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(usable rows, rows a rule skips, rows that could not be parsed), without loss.

    Each part reads the rows again: persist or write them first where they are costly.
    """
    return tuple(df.where(part_of() == part) for part in ("usable", "skipped", "errors"))


def write_parts(df: DataFrame, path: str) -> None:
    """Judged rows in one pass to ``path``/part=usable (typed), skipped (record, reason, detail) and errors (record).

    It is one write by one job: it commits all parts or none, and a second attempt replaces the first.
    """
    typed = to_silver(df.withColumns({"__record": F.col("record"), "__reason": F.col("skip_reason"), "__detail": F.col("skip_detail"), "__part": part_of()}), keep=("__record", "__reason", "__detail", "__part"))
    usable, skipped = F.col("__part") == "usable", F.col("__part") == "skipped"
    silver = [F.when(usable, F.col(c)).alias(c) for c in typed.columns if not c.startswith("__")]
    rows = typed.select(*silver, F.when(~usable, F.col("__record")).alias("record"), F.when(skipped, F.col("__reason")).alias("skip_reason"), F.when(skipped, F.col("__detail")).alias("skip_detail"), F.col("__part").alias("part"))
    rows.write.mode("overwrite").partitionBy("part").parquet(path)


def read_part(spark: SparkSession, path: str, part: str) -> DataFrame:
    """The rows of one part that ``write_parts`` wrote, with the part's columns; other parts' files are not read."""
    rows = spark.read.parquet(path).where(F.col("part") == part)
    own = {"usable": [c for c in rows.columns if c not in ("record", "skip_reason", "skip_detail", "part")], "skipped": ["record", "skip_reason", "skip_detail"], "errors": ["record"]}
    return rows.select(*own[part], *[c for c in ("batch",) if c in rows.columns and c not in own[part]])


def quarantine_counts(df: DataFrame) -> DataFrame:
    """(part, n) of all rows, in one aggregation."""
    return df.groupBy(part_of().alias("part")).agg(F.count("*").alias("n"))


def project_existing(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in keep if c in df.columns])


def compact_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Narrow columns; what does not fit becomes null."""
    return df.withColumns({c: X.lenient(F.col(c), kind) for c, kind in types.items() if c in df.columns})


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def to_silver(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Parsed rows to the 14 typed columns, and others to keep."""
    kept = compact_types(project_existing(df, [*SILVER_KEEP, *keep]), SILVER_TYPES)
    base, increment = X.time_control(F.col("TimeControl"))
    typed = kept.withColumns({"ResultNumeric": X.map_values(F.col("Result"), RESULT_VALUES).cast("float"), "BaseTime": base.try_cast("smallint"), "Increment": increment.try_cast("smallint"), "GameFormat": X.classify_duration(base, increment)})
    return drop_columns(typed, ["TimeControl"])
