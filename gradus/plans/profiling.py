"""Queries of column functions, aggregations, relations and samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gradus.functions import expressions as X
from gradus.operators import aggregates as A
from gradus.operators import relations as R
from gradus.operators import sampling as S
from gradus.operators import sketches as K
from gradus.plans.binding import BREAKS, LABELS, NUMBERS, PRIORITIES, SQL_BAND, SQL_Q2, banded_orders, order_sequences, price_band, query, table
from gradus.sources.io import scan_parquet, scratch, write_bucketed, write_parquet

B = SQL_BAND.format(c="o_totalprice")
RANK = "cast(substr(band, 2, 1) as integer) - 1"

# Column functions ---------------------------------------------------------------------------------------------------


@query("sc1_band", f"select o_orderkey, {B} as band, case when o_totalprice < 200000 then 'low' else 'high' end as half from orders")
def sc1(spark, sf):
    return banded_orders(spark, sf).select("o_orderkey", "band", X.band("o_totalprice", [200_000], ["low", "high"], right_closed=False).alias("half"))


@query("sc2_band_rank", f"select band, {RANK} as rank, count(*) as n from (select {B} as band from orders) group by 1, 2")
def sc2(spark, sf):
    return banded_orders(spark, sf).groupBy("band", X.band_rank("band", LABELS).alias("rank")).agg(F.count("*").alias("n"))


@query("sc3_diff", "select l_orderkey, l_linenumber, round(l_extendedprice - l_quantity, 4) as d from lineitem")
def sc3(spark, sf):
    return table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").select("l_orderkey", "l_linenumber", F.round(X.diff(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("d"))


@query("sc4_greatest_least", "select l_orderkey, l_linenumber, greatest(l_quantity, l_tax * 100) as hi, least(l_quantity, l_tax * 100) as lo from lineitem")
def sc4(spark, sf):
    a, b = F.col("l_quantity"), F.col("l_tax") * 100
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))


@query("sc5_code_prefix", "select substr(p_brand, 1, 7) as prefix, count(*) as n from part group by 1")
def sc5(spark, sf):
    return table(spark, sf, "part", "p_brand").groupBy(X.code_prefix(F.col("p_brand"), 7).alias("prefix")).agg(F.count("*").alias("n"))


@query("sc6_clip", "select l_orderkey, l_linenumber, least(greatest(l_quantity, 10), 40) as q from lineitem")
def sc6(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.clip(F.col("l_quantity"), 10.0, 40.0).alias("q"))


@query("sc7_numeric_bins", "select ceil((least(greatest(l_quantity, 10.0), 45.0) - 5) / 5) * 5 + 5 as bin, count(*) as n from lineitem group by 1")
def sc7(spark, sf):
    return table(spark, sf, "lineitem", "l_quantity").groupBy(X.numeric_bins("l_quantity", 5, 5, 45).alias("bin")).agg(F.count("*").alias("n"))


@query("sc8_regex_match", "select cast(sum(cast(regexp_full_match(p_brand, 'Brand#[1-3][0-9]') as int)) as bigint) as valid, cast(sum(cast(not regexp_full_match(p_brand, 'Brand#[1-3][0-9]') as int)) as bigint) as invalid from part")
def sc8(spark, sf):
    hit = F.col("p_brand").rlike("^Brand#[1-3][0-9]$")
    return table(spark, sf, "part", "p_brand").agg(F.sum(hit.cast("long")).alias("valid"), F.sum((~hit).cast("long")).alias("invalid"))


@query("sc9_is_in", "select o_orderpriority, count(*) as n from orders where o_orderpriority in ('1-URGENT', '5-LOW') group by 1")
def sc9(spark, sf):
    return table(spark, sf, "orders", "o_orderpriority").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("sc10_range_filter", "select case when o_totalprice < 120000 then 'low' when o_totalprice < 160000 then 'mid' when o_totalprice < 200000 then 'upper' else 'top' end as name, count(*) as n from orders group by 1")
def sc10(spark, sf):
    return table(spark, sf, "orders", "o_totalprice").groupBy(X.threshold_group("o_totalprice", [120_000, 160_000, 200_000], ["low", "mid", "upper", "top"]).alias("name")).agg(F.count("*").alias("n"))


@query("sc11_fill_null", "select coalesce(nullif(o_orderpriority, '5-LOW'), '?') as p, count(*) as n from orders group by 1")
def sc11(spark, sf):
    return table(spark, sf, "orders", "o_orderpriority").select(F.expr("nullif(o_orderpriority, '5-LOW')").alias("p")).na.fill("?", ["p"]).groupBy("p").agg(F.count("*").alias("n"))


@query("sc12_is_blank", "select doc_id from documents where text is null or length(text) = 0 or doc_id % 100 = 0")
def sc12(spark, sf):
    text = F.when(F.col("doc_id") % 100 == 0, "").otherwise(F.col("text"))
    return table(spark, sf, "documents", "doc_id", "text").where(X.is_blank(text)).select("doc_id")


@query("sc13_log1p", "select l_orderkey, l_linenumber, round(ln(1 + l_quantity), 6) as v from lineitem")
def sc13(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.log1p("l_quantity"), 6).alias("v"))


@query("sc14_clip_scale", "select l_orderkey, l_linenumber, round(least(greatest(l_quantity, 0), 40) / 40.0, 6) as v from lineitem")
def sc14(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.clip_scale(F.col("l_quantity"), 40.0), 6).alias("v"))


@query("sc15_cast_float32", "select l_orderkey, l_linenumber, round(cast(cast(l_extendedprice as float) as double), 3) as v from lineitem")
def sc15(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice").cast("float").cast("double"), 3).alias("v"))


# Aggregations -------------------------------------------------------------------------------------------------------

_DESCRIBE = " union all ".join(f"select '{c}' as column, count(*) as rows, count(*) - count({c}) as nulls, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, cast(min({c}) as double) as min, cast(max({c}) as double) as max, round(quantile_cont({c}, 0.5), 6) as median from lineitem" for c in NUMBERS)


@query("ag1_describe_numeric", _DESCRIBE)
def ag1(spark, sf):
    return A.describe_numeric(table(spark, sf, "lineitem", *NUMBERS), NUMBERS)


@query("ag2_value_counts", "select o_orderpriority as value, count(*) as n, round(100.0 * count(*) / (select count(*) from orders), 6) as pct from orders group by 1 order by n desc, value limit 3")
def ag2(spark, sf):
    return A.value_counts(table(spark, sf, "orders", "o_orderpriority"), "o_orderpriority", 3)


@query("ag3_null_profile", "select 'o_orderkey' as column, cast(0 as bigint) as nulls, 0.0::double as pct union all select 'p', cast(sum(cast(o_orderpriority = '5-LOW' as int)) as bigint), round(100.0 * avg(cast(o_orderpriority = '5-LOW' as int)), 6) from orders")
def ag3(spark, sf):
    return A.null_profile(table(spark, sf, "orders").select("o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("p")))


_BANDS = f"select band, {RANK} as rank, n, round(100.0 * n / sum(n) over (), 6) as pct from (select {B} as band, count(*) as n from orders group by 1)"


@query("ag4_band_counts", _BANDS + " order by rank")
def ag4(spark, sf):
    return A.band_counts(table(spark, sf, "orders", "o_totalprice"), "o_totalprice", BREAKS, LABELS)


@query("ag5_imbalance_ratio", "with c as (select count(*) as n from orders group by case when o_totalprice <= 20000 then 1 when o_totalprice <= 100000 then 2 when o_totalprice <= 250000 then 3 when o_totalprice <= 450000 then 4 else 5 end) select max(n) as largest, min(n) as smallest, round(max(n) / min(n), 6) as ratio, max(n) / min(n) > 3 as imbalanced from c")
def ag5(spark, sf):
    return A.imbalance_ratio(A.band_counts(table(spark, sf, "orders", "o_totalprice"), "o_totalprice", (20_000, 100_000, 250_000, 450_000), LABELS))


@query("ag6_group_mean", "select l_returnflag, l_linestatus, round(avg(l_extendedprice), 6) as mean, count(*) as n from lineitem group by 1, 2 having count(*) > 100")
def ag6(spark, sf):
    return A.group_mean(table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 100)


_CROSS = ", ".join(f"""count(*) filter (o_orderpriority = '{p}') as "{p}\"""" for p in PRIORITIES)


@query("ag7_crosstab", f"select {B} as band, {_CROSS} from orders group by 1")
def ag7(spark, sf):
    return A.crosstab(banded_orders(spark, sf, "o_orderpriority"), "band", "o_orderpriority", PRIORITIES)


_SHARE = ", ".join(f"""round(100.0 * count(*) filter (o_orderpriority = '{p}') / count(*), 6) as "{p}\"""" for p in PRIORITIES)


@query("ag8_row_share", f"select {B} as band, {_SHARE} from orders group by 1")
def ag8(spark, sf):
    return A.row_share(A.crosstab(banded_orders(spark, sf, "o_orderpriority"), "band", "o_orderpriority", PRIORITIES), PRIORITIES)


@query("ag9_distinct_per_group", "select p_type, count(distinct nullif(p_brand, 'Brand#11')) + cast(max(cast(p_brand = 'Brand#11' as int)) as bigint) as n_distinct from part group by 1")
def ag9(spark, sf):
    return A.distinct_per_group(table(spark, sf, "part").select("p_type", F.expr("nullif(p_brand, 'Brand#11')").alias("brand")), "p_type", "brand")


@query("ag10_entropy_by_group", f"with c as (select {B} as band, o_orderpriority as v, count(*) as c from orders group by 1, 2), p as (select band, c, sum(c) over (partition by band) as n from c) select band, cast(max(n) as bigint) as n, round(sum(-(c / n) * log2(c / n)), 6) as entropy from p group by 1")
def ag10(spark, sf):
    return A.entropy_by_group(banded_orders(spark, sf, "o_orderpriority"), "band", "o_orderpriority")


@query("ag11_moments", "with m as (select avg(o_totalprice) as m from orders) select count(o_totalprice) as n, round(max(m), 6) as mean, round(quantile_cont(o_totalprice, 0.5), 6) as median, round(avg(pow(o_totalprice - m, 3)) / pow(avg(pow(o_totalprice - m, 2)), 1.5), 6) as skewness, round(avg(pow(o_totalprice - m, 4)) / pow(avg(pow(o_totalprice - m, 2)), 2) - 3, 6) as kurtosis from orders, m")
def ag11(spark, sf):
    return A.moments(table(spark, sf, "orders", "o_totalprice"), "o_totalprice")


@query("ag12_histogram", "with e as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders), p as (select cast(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) as int) as bin, lo, hi from orders, e) select bin, min(round(lo + bin * ((hi - lo) / 20), 6)) as low, count(*) as n from p group by 1")
def ag12(spark, sf):
    return A.histogram(table(spark, sf, "orders", "o_totalprice"), "o_totalprice", 20)


@query("ag13_box_stats", "with q as (select o_orderpriority as k, quantile_cont(o_totalprice, 0.25) as a, quantile_cont(o_totalprice, 0.5) as b, quantile_cont(o_totalprice, 0.75) as c from orders group by 1), j as (select k, a, b, c, o_totalprice as v, o_totalprice between a - 1.5 * (c - a) and c + 1.5 * (c - a) as i from orders join q on k = o_orderpriority) select k as o_orderpriority, round(max(a), 6) as q1, round(max(b), 6) as median, round(max(c), 6) as q3, round(min(v) filter (i), 6) as low, round(max(v) filter (i), 6) as high, count(*) filter (not i) as outliers from j group by 1")
def ag13(spark, sf):
    return A.box_stats(table(spark, sf, "orders", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice")


@query("ag14_grid_density", "with e as (select min(l_quantity) as a, max(l_quantity) as b, min(l_extendedprice) as c, max(l_extendedprice) as d from lineitem) select cast(least(floor((l_quantity - a) / ((b - a) / 10)), 9) as int) as bx, cast(least(floor((l_extendedprice - c) / ((d - c) / 8)), 7) as int) as by, count(*) as n from lineitem, e group by 1, 2")
def ag14(spark, sf):
    return A.grid_density(table(spark, sf, "lineitem", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", 10, 8)


_CORR = " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[:i])


@query("ag15_corr_matrix", _CORR)
def ag15(spark, sf):
    return A.corr_matrix(table(spark, sf, "lineitem", *NUMBERS), NUMBERS)


@query("ag16_rank_correlations", "select * from (" + " union all ".join(f"select '{c}' as column, round(corr({c}, l_extendedprice), 6) as r from lineitem" for c in ("l_quantity", "l_tax")) + ") order by abs(r) desc, 1")
def ag16(spark, sf):
    return A.rank_correlations(table(spark, sf, "lineitem", *NUMBERS), "l_extendedprice", NUMBERS, exclude=["l_discount"])


@query("ag17_win_rate", "select p_brand, count(*) as n, round(avg(cast(l_returnflag = 'R' as int)), 6) as rate from lineitem join part on l_partkey = p_partkey group by 1 order by n desc, p_brand limit 10")
def ag17(spark, sf):
    rows = table(spark, sf, "lineitem", "l_partkey", "l_returnflag").join(table(spark, sf, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return A.win_rate_by_category(rows, "p_brand", (F.col("l_returnflag") == "R").cast("double"), 10)


@query("ag18_mean_score_by_category", "select o_orderpriority, round(avg(o_totalprice), 6) as mean, count(*) as n from orders group by 1")
def ag18(spark, sf):
    return A.group_mean(table(spark, sf, "orders", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", 0)


@query("ag19_rate_by_band", f"select {B} as band, count(*) as n, round(avg(cast(o_orderstatus = 'P' as int)), 6) as rate from orders group by 1")
def ag19(spark, sf):
    return A.rate_by_band(banded_orders(spark, sf, "o_orderstatus"), "band", F.col("o_orderstatus") == "P")


# Relations ----------------------------------------------------------------------------------------------------------

_TOP_BRANDS = "(select p_brand from part group by 1 order by count(*) desc, p_brand limit 5)"


@query("js1_semi_join_topk", f"select p_partkey, p_brand from part where p_brand in {_TOP_BRANDS}")
def js1(spark, sf):
    return R.semi_join_topk(table(spark, sf, "part", "p_partkey", "p_brand"), "p_brand", 5).select("p_partkey", "p_brand")


@query("js2_lookup_map", "select n_name, r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by 1, 2")
def js2(spark, sf):
    customers = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    nations = R.lookup_map(table(spark, sf, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), table(spark, sf, "region"), "r_regionkey")
    return R.lookup_map(customers, nations, "n_nationkey").groupBy("n_name", "r_name").agg(F.count("*").alias("n"))


@query("js3_hconcat_features", "select o_orderkey, count(*) as lines, round(max(o_totalprice), 2) as price from orders join lineitem on l_orderkey = o_orderkey group by 1")
def js3(spark, sf):
    lines = table(spark, sf, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    return R.hconcat_features([lines, table(spark, sf, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("price"))], "o_orderkey")


_TOP15 = "(select p_brand from part join lineitem on l_partkey = p_partkey where {w} group by 1 order by count(*) desc, p_brand limit 15)"


@query("js4_set_compare", f"with a as {_TOP15.format(w='l_quantity <= 25')}, b as {_TOP15.format(w='l_quantity > 25')} select coalesce(a.p_brand, b.p_brand) as p_brand, case when b.p_brand is null then 'only_a' when a.p_brand is null then 'only_b' else 'both' end as side from a full join b on a.p_brand = b.p_brand")
def js4(spark, sf):
    rows = table(spark, sf, "lineitem", "l_partkey", "l_quantity").join(table(spark, sf, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return R.set_compare(R.top_k(rows.where("l_quantity <= 25"), ["p_brand"], 15), R.top_k(rows.where("l_quantity > 25"), ["p_brand"], 15), "p_brand")


@query("js5_zero_fill_levels", f"select v.band, coalesce(n, 0) as n from (values ('b1'), ('b2'), ('b3'), ('b4'), ('b5'), ('b6')) v(band) left join (select {B} as band, count(*) as n from orders where o_orderpriority = '5-LOW' group by 1) c on v.band = c.band")
def js5(spark, sf):
    counts = banded_orders(spark, sf, "o_orderpriority").where("o_orderpriority = '5-LOW'").groupBy("band").agg(F.count("*").alias("n"))
    return R.zero_fill_levels(counts, "band", [*LABELS, "b6"])


@query("js6_top_k", "select l_partkey, count(*) as n from lineitem group by 1 order by n desc, l_partkey limit 20")
def js6(spark, sf):
    return R.top_k(table(spark, sf, "lineitem", "l_partkey"), ["l_partkey"], 20)


@query("js7_top_k_per_group", "select l_returnflag, l_suppkey, n, cast(rank as int) as rank from (select *, row_number() over (partition by l_returnflag order by n desc, l_suppkey) as rank from (select l_returnflag, l_suppkey, count(*) as n from lineitem group by 1, 2)) where rank <= 15")
def js7(spark, sf):
    return R.top_k_per_group(table(spark, sf, "lineitem", "l_returnflag", "l_suppkey"), "l_returnflag", "l_suppkey", 15)


@query("js8_sort_by_rank", _BANDS)
def js8(spark, sf):
    return R.sort_by_rank(A.band_counts(table(spark, sf, "orders", "o_totalprice"), "o_totalprice", BREAKS, LABELS))


@query("js9_distinct_values", "select distinct p_type from part order by 1")
def js9(spark, sf):
    return R.distinct_values(table(spark, sf, "part", "p_type"), "p_type")


# Samples ------------------------------------------------------------------------------------------------------------


def _ranked(seed: int, where: str = "true") -> str:
    return f"r as (select o_orderkey, o_totalprice, {B} as band, row_number() over (partition by {B} order by md5(o_orderkey || '#{seed}'), o_orderkey) as place, count(*) over (partition by {B}) as n from orders where {where})"


@query("sm1_sample_n", "select o_orderkey from orders order by md5(o_orderkey || '#7'), o_orderkey limit 200")
def sm1(spark, sf):
    return S.sample_n(table(spark, sf, "orders", "o_orderkey"), 200, 7, "o_orderkey")


@query("sm2_stratified_sample", f"with {_ranked(42)} select o_orderkey, band from r where place <= 150")
def sm2(spark, sf):
    return S.stratified_sample(banded_orders(spark, sf), "band", 150, 42, "o_orderkey").select("o_orderkey", "band")


@query("sm3_shuffle", "select o_orderkey from orders")
def sm3(spark, sf):
    return S.shuffle(table(spark, sf, "orders", "o_orderkey"), 42, "o_orderkey")


@query("sm4_prefix_stratified", f"with p as (select * from orders limit 5000), r as (select o_orderkey, {B} as stratum, row_number() over (partition by {B} order by md5(o_orderkey || '#42'), o_orderkey) as place from p) select o_orderkey, stratum from r where place <= 100")
def sm4(spark, sf):
    return S.prefix_stratified(spark, f"{sf}/orders.parquet", 5000, price_band(), 100, 42, "o_orderkey").select("o_orderkey", "stratum")


@query("sm5_sample_report", f"with {_ranked(42)} select band, count(*) as population, count(*) filter (place <= 150) as sampled, count(*) filter (place <= 150) >= least(count(*), 100) as covered from r group by 1")
def sm5(spark, sf):
    rows = banded_orders(spark, sf)
    return S.sample_report(rows, S.stratified_sample(rows, "band", 150, 42, "o_orderkey"), "band", 100)


@query("sm6_stratified_split", f"with {_ranked(42)} select o_orderkey, band, place <= floor(n * 0.2 + 0.5) as is_test from r")
def sm6(spark, sf):
    return S.stratified_split(banded_orders(spark, sf), "band", 0.2, 42, "o_orderkey").select("o_orderkey", "band", "is_test")


@query("sm7_temporal_split", "select split, count(*) as n from (select case when strftime(o_orderdate, '%Y-%m') in ('1995-01', '1995-02') then 'train' when strftime(o_orderdate, '%Y-%m') = '1995-03' then 'validation' end as split from orders) where split is not null group by 1")
def sm7(spark, sf):
    rows = S.temporal_split(table(spark, sf, "orders", "o_orderdate"), F.date_format("o_orderdate", "yyyy-MM"), ["1995-01", "1995-02"], ["1995-03"])
    return rows.groupBy("split").agg(F.count("*").alias("n"))


@query("sm8_reproducible", f"with {_ranked(42)} select count(*) as rows, cast(sum(cast('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 8) as bigint)) as bigint) as checksum, true as same from r where place <= 150")
def sm8(spark, sf):
    draw = lambda: S.content_hash(S.stratified_sample(banded_orders(spark, sf), "band", 150, 42, "o_orderkey"), ["o_orderkey"])
    again = draw().select(F.col("checksum").alias("again"))
    return draw().join(again).select("rows", "checksum", (F.col("checksum") == F.col("again")).alias("same"))  # a row each


@query("sm9_chi_square", f"with {_ranked(42)}, s as (select count(*) as pop, count(*) filter (place <= 150) as got from r group by band), e as (select got, pop * sum(got) over () / sum(pop) over () as want from s) select round(sum(pow(got - want, 2) / want), 6) as chi_square, count(*) - 1 as df from e")
def sm9(spark, sf):
    rows = banded_orders(spark, sf)
    return S.chi_square_representative(rows, S.stratified_sample(rows, "band", 150, 42, "o_orderkey"), "band")


# Stored profiles and heavy hitters ----------------------------------------------------------------------------------


def _stored(spark, sf):
    """Where the orders' monthly summaries lie; the months are written in two goes, as if the later years had just arrived."""
    path, month = scratch(spark, "profiles"), F.date_format("o_orderdate", "yyyy-MM")
    rows = table(spark, sf, "orders", "o_orderdate", "o_totalprice", "o_custkey")
    for some in (rows.where("year(o_orderdate) < 1997"), rows.where("year(o_orderdate) >= 1997")):
        K.store(K.summarise(some, month, ["o_totalprice"], ["o_custkey"], ["o_custkey"]), path)
    return path


def _yearly(spark, sf):
    return K.merged(spark, _stored(spark, sf), F.substring(F.col("part").cast("string"), 1, 4))


def _years(spark, sf):
    return table(spark, sf, "orders", "o_orderdate", "o_totalprice", "o_custkey").withColumn("by", F.date_format("o_orderdate", "yyyy"))


@query("ag20_stored_quantiles", "select strftime(o_orderdate, '%Y') as by, count(*) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 2) as std, min(o_totalprice) as min, max(o_totalprice) as max, true as close from orders group by 1")
def ag20(spark, sf):
    """Yearly profiles from monthly sketches; ``close``: the ranks of all quartiles are within three times the sketch's error, or two rows."""
    found = K.stored_numbers(_yearly(spark, sf), ["o_totalprice"])
    ranks = _years(spark, sf).join(found.select("by", "n", "quantiles"), "by").groupBy("by", "n").agg(*[F.avg((F.col("o_totalprice") <= F.col("quantiles")[k]).cast("double")).alias(f"r{k}") for k in range(3)])
    close = F.greatest(*[F.abs(F.col(f"r{k}") - p) for k, p in enumerate((0.25, 0.5, 0.75))]) <= 3 * K.rank_error() + 2 / F.col("n")
    return found.join(ranks.select("by", close.alias("close")), "by").select("by", "n", F.round("mean", 4).alias("mean"), F.round("std", 2).alias("std"), "min", "max", "close")


@query("ag21_stored_distinct", "select strftime(o_orderdate, '%Y') as by, count(*) as rows, count(distinct o_custkey) as exact, true as close from orders group by 1")
def ag21(spark, sf):
    """``close``: the estimate is within four standard errors of the exact count."""
    found = K.stored_distinct(_yearly(spark, sf), ["o_custkey"])
    exact = _years(spark, sf).groupBy("by").agg(F.count_distinct("o_custkey").alias("exact"))
    return found.join(exact, "by").select("by", "rows", "exact", (F.abs(F.col("distinct") - F.col("exact")) <= 4 * K.distinct_error() * F.col("exact") + 1).alias("close"))


@query("ag22_stored_density", "with p as (select strftime(o_orderdate, '%Y') as by, o_totalprice as v from orders) select \"by\", cast(bin as int) as bin, 50000.0::double * bin as low, round(count(*) filter (v <= 50000 * (bin + 1) and (v > 50000 * bin or bin = 0)) / count(*), 6) as exact, true as close from p, range(10) r(bin) group by 1, 2, 3")
def ag22(spark, sf):
    """The drift of densities (DR2) from stored sketches, beside the exact shares."""
    found = K.stored_density(_yearly(spark, sf), "o_totalprice", 10, (0, 500_000))
    place = F.greatest(F.ceil(F.col("o_totalprice") / 50_000) - 1, F.lit(0)).cast("int")
    counts = _years(spark, sf).groupBy("by", place.alias("bin")).agg(F.count("*").alias("c"))
    total = _years(spark, sf).groupBy("by").agg(F.count("*").alias("n"))
    both = found.join(total, "by").join(counts, ["by", "bin"], "left").withColumn("exact", F.round(F.coalesce("c", F.lit(0)) / F.col("n"), 6))
    return both.select("by", "bin", "low", "exact", (F.abs(F.col("share") - F.col("exact")) <= 6 * K.rank_error()).alias("close"))


@query("js10_stored_set_sizes", "with a as (select distinct o_custkey as c from orders where o_orderdate < timestamp '1997-01-01'), b as (select distinct o_custkey as c from orders where o_orderdate >= timestamp '1997-01-01') select case when b.c is null then 'only_a' when a.c is null then 'only_b' else 'both' end as side, count(*) as exact, true as close from a full join b on a.c = b.c group by 1")
def js10(spark, sf):
    """Customers before and from 1997 on, by stored theta sketches; ``close``: within four standard errors of all customers."""
    path = _stored(spark, sf)
    months = [r["part"] for r in spark.read.parquet(path).select(F.col("part").cast("string").alias("part")).distinct().collect()]  # a row per month
    a, b = (K.merged(spark, path, parts=[m for m in months if (m < "1997") == early]) for early in (True, False))
    rows, cut = table(spark, sf, "orders", "o_custkey", "o_orderdate"), F.lit("1997-01-01").cast("timestamp")
    exact = R.set_compare(rows.where(F.col("o_orderdate") < cut), rows.where(F.col("o_orderdate") >= cut), "o_custkey").groupBy("side").agg(F.count("*").alias("exact"))
    total = rows.agg(F.count_distinct("o_custkey").alias("total"))  # a row
    met = exact.join(K.stored_set_sizes(a, b, "o_custkey"), "side").join(total)
    return met.select("side", "exact", (F.abs(F.col("n") - F.col("exact")) <= 4 * K.distinct_error() * F.col("total") + 1).alias("close"))


@query("js11_heavy_top_k", f"with {SQL_Q2} select array_to_string(tokens[1:3], ' ') as prefix, count(*) as n from q2 group by 1 order by n desc, prefix limit 20")
def js11(spark, sf):
    return K.heavy_top_k(order_sequences(spark, sf).select(X.prefix(F.col("tokens"), 3).alias("prefix")), "prefix", 20)


# Layouts that prune -------------------------------------------------------------------------------------------------


@query("io13_month_partitions", "select split, count(*) as n from (select case when strftime(o_orderdate, '%Y-%m') in ('1995-01', '1995-02') then 'train' when strftime(o_orderdate, '%Y-%m') = '1995-03' then 'validation' end as split from orders) where split is not null group by 1")
def io13(spark, sf):
    """SM7 over month folders: only the folders named are read."""
    path = scratch(spark, "months")
    write_parquet(table(spark, sf, "orders", "o_orderkey", "o_orderdate").withColumn("month", F.date_format("o_orderdate", "yyyy-MM")).repartition("month"), path, ["month"])
    rows = S.temporal_split(scan_parquet(spark, path), F.col("month").cast("string"), ["1995-01", "1995-02"], ["1995-03"])
    return rows.groupBy("split").agg(F.count("*").alias("n"))


@query("io14_bucketed_join", "select o_orderkey, count(*) as lines, round(max(o_totalprice), 2) as price from orders join lineitem on l_orderkey = o_orderkey group by 1")
def io14(spark, sf):
    """JS3 over tables in buckets by key: grouping and join need no shuffle."""
    names = {t: f"gradus_{t}_{uuid.uuid4().hex}" for t in ("orders", "lines")}
    write_bucketed(table(spark, sf, "orders", "o_orderkey", "o_totalprice"), scratch(spark, "orders"), names["orders"], "o_orderkey", 8)
    write_bucketed(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), scratch(spark, "lines"), names["lines"], "o_orderkey", 8)
    lines = spark.table(names["lines"]).groupBy("o_orderkey").agg(F.count("*").alias("lines"))
    return R.hconcat_features([lines, spark.table(names["orders"]).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))], "o_orderkey")
