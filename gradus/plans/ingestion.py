"""Queries of sources, record ingestion and streaming, over record texts rendered from the orders table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions import expressions as X
from gradus.operators import ingest as I
from gradus.plans.binding import query, table
from gradus.sources import io
from gradus.sources.records import RecordFiles, plain_path, write_frames
from gradus.streaming.ingest import ingest_progress, ingest_stream, ingested

TOKENS = ("e4", "e5", "Nf3", "Nc6", "O-O", "Bb5+")
CONTROLS = ("300+3", "60", "-", "300+", "1/40", "15+0", "900+10", "1800+30")

#: Numbered move text of 0 to 11 plies; what follows a key is decided by its remainder.
BODIES = [" ".join(f"{(i + 1) // 2}. {TOKENS[(r + i) % 6]}" if i % 2 else TOKENS[(r + i) % 6] for i in range(1, r + 1)) for r in range(12)]

#: SQL of what ingestion should find, straight from the orders.
EXPECTED = """g as (
  select k, k % 101 = 0 as broken,
    case when k % 11 = 0 then null when k % 7 = 0 then 'g' || k else 'https://host/g' || k end as site,
    case when k % 5 = 0 then 'D' || k else strftime(o_orderdate, '%Y.%m.%d') end as date,
    case when k % 13 = 0 then null else 800 + k % 2000 end as w,
    case when k % 17 = 0 then null else 800 + c % 2000 end as b,
    case when k % 10 < 4 then '1-0' when k % 10 < 7 then '0-1' when k % 10 < 9 then '1/2-1/2' else '*' end as result,
    case when k % 6 = 0 then '' when k % 2 = 0 then '+' || (k % 9) else '-' || (k % 9) end as wd,
    case when k % 19 = 0 then '40000' else '+' || (k % 4) end as bd,
    chr(cast(65 + k % 5 as int)) || lpad(cast(k % 100 as varchar), 2, '0') as eco, o_orderpriority as opening,
    (['300+3', '60', '-', '300+', '1/40', '15+0', '900+10', '1800+30'])[k % 8 + 1] as tc,
    case o_orderstatus when 'F' then 'Normal' when 'O' then 'Time forfeit' else 'Abandoned' end as termination,
    cast(k % 12 as int) as plies
  from (select o_orderkey as k, o_custkey as c, * from orders)),
j as (select *, case when w is not null and b is not null then (w + b) // 2 end as elo,
    case tc when '300+3' then 300 when '60' then 60 when '15+0' then 15 when '900+10' then 900 when '1800+30' then 1800 end as base,
    case tc when '300+3' then 3 when '60' then 0 when '15+0' then 0 when '900+10' then 10 when '1800+30' then 30 end as inc from g where not broken),
s as (select *, case when result = '*' then 'unfinished' when plies = 0 then 'no_moves' when plies < 5 then 'too_short' when elo is null then 'missing_elo' when least(w, b) < 900 then 'elo_too_low' when greatest(w, b) > 2600 then 'elo_too_high' end as reason,
    case when result = '*' then '*' when plies = 0 then '' when plies < 5 then plies || '<5' when elo is null then 'W=' || coalesce(cast(w as varchar), '?') || ' B=' || coalesce(cast(b as varchar), '0') when least(w, b) < 900 or greatest(w, b) > 2600 then 'W=' || w || ' B=' || b end as detail from j)"""
RULES = I.QualityRules(min_elo=900, max_elo=2600)


def rendered(spark, sf):
    """(k, record): a record text per order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = lambda x: x.cast("string")
    line = lambda key, value: F.concat(F.lit(f'[{key} "'), value, F.lit('"]'))
    result = F.when(k % 10 < 4, "1-0").when(k % 10 < 7, "0-1").when(k % 10 < 9, "1/2-1/2").otherwise("*")
    sign = F.when(k % 2 == 0, "+").otherwise("-")
    lines = [
        F.when(k % 11 != 0, line("Site", F.when(k % 7 == 0, F.concat(F.lit("g"), number(k))).otherwise(F.concat(F.lit("https://host/g"), number(k))))),
        F.when(k % 5 != 0, line("UTCDate", F.date_format("o_orderdate", "yyyy.MM.dd"))),
        line("Date", F.concat(F.lit("D"), number(k))),
        line("White", F.concat(F.lit("w"), number(c))),
        line("Black", F.concat(F.lit("b"), number(k % 10))),
        line("Result", result),
        line("WhiteElo", F.when(k % 13 == 0, "?").otherwise(number(800 + k % 2000))),
        line("BlackElo", F.when(k % 17 == 0, "0").otherwise(number(800 + c % 2000))),
        line("WhiteRatingDiff", F.when(k % 6 == 0, "").otherwise(F.concat(sign, number(k % 9)))),
        line("BlackRatingDiff", F.when(k % 19 == 0, "40000").otherwise(F.concat(F.lit("+"), number(k % 4)))),
        line("ECO", F.concat(F.chr(65 + k % 5), F.lpad(number(k % 100), 2, "0"))),
        line("Opening", F.col("o_orderpriority")),
        line("TimeControl", F.element_at(F.array(*map(F.lit, CONTROLS)), (k % 8 + 1).cast("int"))),
        line("Termination", F.when(F.col("o_orderstatus") == "F", "Normal").when(F.col("o_orderstatus") == "O", "Time forfeit").otherwise("Abandoned")),
    ]
    body = F.concat_ws(" ", F.nullif(F.element_at(F.array(*map(F.lit, BODIES)), (k % 12 + 1).cast("int")), F.lit("")), result)
    whole = F.concat_ws("\n", F.lit('[Event "Rated game"]'), *lines)
    return table(spark, sf, "orders").select(k.alias("k"), F.when(k % 101 == 0, '[Event "broken"]').otherwise(F.concat(whole, F.lit("\n\n"), body)).alias("record"))


def record_files(spark, sf, name: str = "records") -> str:
    path = io.scratch(spark, name)
    rendered(spark, sf).select(F.concat("record", F.lit("\n"))).write.text(path)
    return path


def parsed(spark, sf):
    return I.parse_records(io.read_records(spark, record_files(spark, sf)))


def judged(spark, sf):
    return I.quality_filter(parsed(spark, sf), RULES)


# Sources ------------------------------------------------------------------------------------------------------------


@query("io1_read_records", f"with {EXPECTED} select count(*) as n, count(*) filter (broken) as broken from g")
def io1(spark, sf):
    records = io.read_records(spark, record_files(spark, sf))
    return records.agg(F.count("*").alias("n"), F.sum((F.col("record") == '[Event "broken"]').cast("long")).alias("broken"))


@query("io2_read_jsonl", "select o_orderkey, o_orderpriority, round(o_totalprice, 2) as price from orders")
def io2(spark, sf):
    path = io.scratch(spark, "jsonl")
    io.write_jsonl(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.round("o_totalprice", 2).alias("price")), path)
    return io.read_jsonl(spark, path, "o_orderkey long, o_orderpriority string, price double").where("_corrupt_record is null").drop("_corrupt_record")


@query("io3_write_jsonl", "select count(*) as lines from orders")
def io3(spark, sf):
    path = io.scratch(spark, "jsonl")
    io.write_jsonl(table(spark, sf, "orders", "o_orderkey", "o_orderstatus"), path)
    return spark.read.text(path).agg(F.count("*").alias("lines"))


@query("io4_write_parquet", "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def io4(spark, sf):
    path = io.scratch(spark, "parquet")
    io.write_parquet(table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice"), path, ["o_orderstatus"], max_records=5000)
    return io.scan_parquet(spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("io5_scan_parquet", "select o_orderpriority, count(*) as n from orders group by 1")
def io5(spark, sf):
    return io.scan_parquet(spark, f"{sf}/orders.parquet", ["o_orderpriority"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("io6_file_inventory", "select count(*) as rows, true as named, true as sized from orders")
def io6(spark, sf):
    """Names and bytes are not in SQL: ``named`` and ``sized`` say whether all files have a name and bytes to go with their rows."""
    files = io.file_inventory(spark, f"{sf}/orders.parquet")
    sized = (F.col("bytes") > 0) & (F.abs(F.col("bytes_per_row") - F.col("bytes") / F.col("rows")) < 1e-5)
    return files.agg(F.sum("rows").alias("rows"), (F.count_distinct("file_name") == F.count("*")).alias("named"), F.bool_and(sized).alias("sized"))


@query("io7_read_prefix", "select o_orderkey from orders limit 1000")
def io7(spark, sf):
    return io.read_prefix(spark, f"{sf}/orders.parquet", 1000).select("o_orderkey")


@query("io8_quarantine", f"with {EXPECTED} select 'errors' as part, count(*) as n from g where broken union all select case when reason is null then 'usable' else 'skipped' end, count(*) from s group by 1")
def io8(spark, sf):
    return I.quarantine_counts(judged(spark, sf))


@query("io12_write_parts", f"with {EXPECTED} select 'errors' as part, '[Event \"broken\"]' as record, null as reason, null as detail, null as ECO, count(*) as n from g where broken group by 1, 2 union all select case when reason is null then 'usable' else 'skipped' end, null, reason, detail, case when reason is null then eco end, count(*) from s group by 1, 3, 4, 5")
def io12(spark, sf):
    path = io.scratch(spark, "parts")
    I.write_parts(judged(spark, sf), path)
    none = lambda name: F.lit(None).cast("string").alias(name)
    errors = I.read_part(spark, path, "errors").select(F.lit("errors").alias("part"), "record", none("reason"), none("detail"), none("ECO"))
    skipped = I.read_part(spark, path, "skipped").select(F.lit("skipped").alias("part"), none("record"), F.col("skip_reason").alias("reason"), F.col("skip_detail").alias("detail"), none("ECO"))
    usable = I.read_part(spark, path, "usable").select(F.lit("usable").alias("part"), none("record"), none("reason"), none("detail"), "ECO")
    return io.union_all([errors, skipped, usable]).groupBy("part", "record", "reason", "detail", "ECO").agg(F.count("*").alias("n"))


@query("io9_union_all", "select o_orderpriority, 2 * count(*) as n from orders group by 1")
def io9(spark, sf):
    rows = table(spark, sf, "orders", "o_orderkey", "o_orderpriority")
    return io.union_all([rows, rows.select("o_orderpriority", "o_orderkey")]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("io10_count_records", "select count(*) as n from lineitem")
def io10(spark, sf):
    return io.count_records(table(spark, sf, "lineitem"))


@query("io15_record_frames", f"with {EXPECTED} select count(*) as n, count(*) filter (broken) as broken, true as split from g")
def io15(spark, sf):
    """Records written as zstd files of many frames and read by frame; ``split``: no fewer tasks read than there are files."""
    path = io.scratch(spark, "frames")
    files = write_frames(rendered(spark, sf).select("record"), path, 500)
    spark.dataSource.register(RecordFiles)
    records = spark.read.format("record_files").option("path", f"{plain_path(path)}/*.zst").load()
    split = F.lit(records.rdd.getNumPartitions() >= files)
    return records.agg(F.count("*").alias("n"), F.sum((F.col("record") == '[Event "broken"]').cast("long")).alias("broken")).withColumn("split", split)


# Ingestion ----------------------------------------------------------------------------------------------------------


@query("in1_parse_headers", f"with {EXPECTED} select k, site, eco, tc from g where not broken")
def in1(spark, sf):
    rows = I.parse_headers(io.read_records(spark, record_files(spark, sf)))
    return rows.where("Result is not null").select(F.substring("Date", 2, 20).cast("long").alias("k"), F.col("Site").alias("site"), F.col("ECO").alias("eco"), F.col("TimeControl").alias("tc"))


@query("in2_split_movetext", f"with {EXPECTED} select plies, count(*) as n from g where not broken group by 1")
def in2(spark, sf):
    body = io.read_records(spark, record_files(spark, sf)).select(X.movetext(F.col("record")).alias("body")).where("body is not null")
    return body.groupBy((F.size(F.filter(F.split("body", " "), lambda t: ~t.rlike(r"^\d+\.$"))) - 1).alias("plies")).agg(F.count("*").alias("n"))


@query("in3_entity_id", f"with {EXPECTED} select case when site is null then '' else 'g' || k end as id, count(*) as n from g where not broken group by 1")
def in3(spark, sf):
    return parsed(spark, sf).where("not is_error").groupBy(F.col("GameID").alias("id")).agg(F.count("*").alias("n"))


@query("in4_coalesce_headers", f"with {EXPECTED} select date, count(*) as n from g where not broken group by 1")
def in4(spark, sf):
    return parsed(spark, sf).where("not is_error").groupBy(F.col("Date").alias("date")).agg(F.count("*").alias("n"))


@query("in5_safe_positive_int", f"with {EXPECTED} select w, b, count(*) as n from g where not broken group by 1, 2")
def in5(spark, sf):
    return parsed(spark, sf).where("not is_error").groupBy(F.col("WhiteElo").cast("long").alias("w"), F.col("BlackElo").cast("long").alias("b")).agg(F.count("*").alias("n"))


@query("in6_floor_mean", f"with {EXPECTED} select elo, count(*) as n from j group by 1")
def in6(spark, sf):
    return parsed(spark, sf).where("not is_error").groupBy(F.col("EloAvg").cast("long").alias("elo")).agg(F.count("*").alias("n"))


@query("in7_ply_count", f"with {EXPECTED} select plies, count(*) as n from j group by 1")
def in7(spark, sf):
    return parsed(spark, sf).where("not is_error").groupBy(F.col("NumMoves").alias("plies")).agg(F.count("*").alias("n"))


@query("in8_quality_filter", f"with {EXPECTED} select reason, detail, count(*) as n from s group by 1, 2")
def in8(spark, sf):
    return judged(spark, sf).where("not is_error").groupBy(F.col("skip_reason").alias("reason"), F.col("skip_detail").alias("detail")).agg(F.count("*").alias("n"))


@query("in9_skip_reason_counts", f"with {EXPECTED} select reason, count(*) as n from (select reason from s where reason is not null union all select 'error' from g where broken) group by 1")
def in9(spark, sf):
    return I.skip_reason_counts(judged(spark, sf))


@query("in10_detect_parse_errors", f"with {EXPECTED} select broken as is_error, count(*) as n from g group by 1")
def in10(spark, sf):
    return I.detect_parse_errors(io.read_records(spark, record_files(spark, sf))).groupBy("is_error").agg(F.count("*").alias("n"))


@query("in11_project_existing", "select l_orderkey, l_tax from lineitem")
def in11(spark, sf):
    return I.project_existing(table(spark, sf, "lineitem"), ["l_orderkey", "absent", "l_tax"])


@query("in12_compact_types", f"with {EXPECTED} select case when wd = '' then null else cast(wd as smallint) end as wd, case when bd = '40000' then null else cast(bd as smallint) end as bd, count(*) as n from j group by 1, 2")
def in12(spark, sf):
    rows = I.compact_types(parsed(spark, sf).where("not is_error"), {"WhiteRatingDiff": "smallint", "BlackRatingDiff": "smallint"})
    return rows.groupBy(F.col("WhiteRatingDiff").alias("wd"), F.col("BlackRatingDiff").alias("bd")).agg(F.count("*").alias("n"))


@query("in13_map_values", "select o_orderstatus, case o_orderstatus when 'F' then 1.0::double when 'O' then 0.0::double end as v, count(*) as n from orders group by 1, 2")
def in13(spark, sf):
    return table(spark, sf, "orders", "o_orderstatus").groupBy("o_orderstatus", X.map_values(F.col("o_orderstatus"), {"F": 1.0, "O": 0.0}).alias("v")).agg(F.count("*").alias("n"))


@query("in14_time_control", f"with {EXPECTED} select tc, base, inc, count(*) as n from j group by 1, 2, 3")
def in14(spark, sf):
    base, inc = X.time_control(F.col("TimeControl"))
    return parsed(spark, sf).where("not is_error").groupBy(F.col("TimeControl").alias("tc"), base.alias("base"), inc.alias("inc")).agg(F.count("*").alias("n"))


_FORMAT = "case when base is null then 'Unknown' when base + 40 * inc < 30 then 'UltraBullet' when base + 40 * inc < 180 then 'Bullet' when base + 40 * inc < 480 then 'Blitz' when base + 40 * inc < 1500 then 'Rapid' else 'Classical' end"


@query("in15_classify_duration", f"with {EXPECTED} select {_FORMAT} as format, count(*) as n from j group by 1")
def in15(spark, sf):
    return parsed(spark, sf).where("not is_error").groupBy(X.classify_duration(*X.time_control(F.col("TimeControl"))).alias("format")).agg(F.count("*").alias("n"))


@query("in16_drop_columns", "select l_orderkey, l_linenumber from lineitem")
def in16(spark, sf):
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_tax", "l_discount")
    return I.drop_columns(rows, ["l_tax", "l_discount", "absent"])


_SILVER = f"select result as Result, cast(w as smallint) as WhiteElo, cast(b as smallint) as BlackElo, cast(elo as smallint) as EloAvg, cast(plies as smallint) as NumMoves, case when wd = '' then null else cast(wd as smallint) end as WhiteRatingDiff, case when bd = '40000' then null else cast(bd as smallint) end as BlackRatingDiff, eco as ECO, termination as Termination, case result when '1-0' then 1.0 when '0-1' then 0.0 else 0.5 end::float as ResultNumeric, cast(base as smallint) as BaseTime, cast(inc as smallint) as Increment, {_FORMAT} as GameFormat from s where reason is null"


@query("in17_to_silver", f"with {EXPECTED} {_SILVER}")
def in17(spark, sf):
    usable, _, _ = I.quarantine(judged(spark, sf))
    return I.to_silver(usable).drop("Moves")


# Streaming ----------------------------------------------------------------------------------------------------------


def _streamed(spark, sf):
    files, out = record_files(spark, sf), io.scratch(spark, "stream")
    running = ingest_stream(spark, files, out, io.scratch(spark, "offsets"), RULES)
    running.awaitTermination()
    return out


@query("st1_ingest_stream", f"with {EXPECTED} {_SILVER}")
def st1(spark, sf):
    return ingested(spark, _streamed(spark, sf)).drop("Moves", "batch")


@query("st3_ingest_frames", f"with {EXPECTED} {_SILVER}")
def st3(spark, sf):
    """ST1 from zstd files by frame, through the record source as a stream."""
    files, out = io.scratch(spark, "frames"), io.scratch(spark, "stream")
    write_frames(rendered(spark, sf).select("record"), files, 1000)
    ingest_stream(spark, f"{plain_path(files)}/*.zst", out, io.scratch(spark, "offsets"), RULES, zstd_frames=True).awaitTermination()
    return ingested(spark, out).drop("Moves", "batch")


@query("st2_ingest_progress", f"with {EXPECTED} select cast(0 as bigint) as batch, count(*) as input_rows, count(*) filter (broken) as errors, (select count(*) from s where reason is null) as usable from g")
def st2(spark, sf):
    return ingest_progress(spark, _streamed(spark, sf)).select("batch", "input_rows", "errors", "usable")


