"""Queries of token sequences and features."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gradus.functions import expressions as X
from gradus.operators import features as E
from gradus.operators import sequences as Q
from gradus.operators.relations import top_k
from gradus.plans.binding import BREAKS, LABELS, PRIORITIES, STATUSES, SQL_BAND, SQL_Q, SQL_Q2, banded_orders, order_sequences, query, table, user_sequences
from gradus.sources.io import load_artifacts, save_artifacts, scratch

B = SQL_BAND.format(c="o_totalprice")
CHOSEN = ("AF", "NF", "RO")
MOVES = "'1. ' || e || ' e5 2. Nf3 ' || n || ' 3. O-O ' || r"
SQL_MOVES = f"m as (select o_orderkey as k, case when o_orderkey % 3 = 0 then 'd4' else 'e4' end as e, case when o_orderkey % 4 = 0 then 'O-O-O' else 'Bb5+' end as n, case o_orderkey % 4 when 0 then '1-0' when 1 then '0-1' when 2 then '1/2-1/2' else '*' end as r from orders)"


def moves(spark, sf):
    """(k, text): move text made from order keys."""
    k = F.col("o_orderkey")
    e, n = F.when(k % 3 == 0, "d4").otherwise("e4"), F.when(k % 4 == 0, "O-O-O").otherwise("Bb5+")
    r = F.element_at(F.array(*map(F.lit, ("1-0", "0-1", "1/2-1/2", "*"))), (k % 4 + 1).cast("int"))
    return table(spark, sf, "orders", "o_orderkey").select(k.alias("k"), F.concat(F.lit("1. "), e, F.lit(" e5 2. Nf3 "), n, F.lit("\t3. O-O "), r).alias("text"))


# Sequences ----------------------------------------------------------------------------------------------------------


@query("sq1_tokenize_moves", f"with {SQL_MOVES} select k, e || ' e5 Nf3 ' || n || ' O-O' as tokens from m")
def sq1(spark, sf):
    return moves(spark, sf).select("k", F.array_join(X.tokenize_moves(F.col("text")), " ").alias("tokens"))


@query("sq2_first_token", f"with {SQL_Q2} select tokens[1] as first, count(*) as n from q2 group by 1")
def sq2(spark, sf):
    return order_sequences(spark, sf).groupBy(X.first_token(F.col("tokens")).alias("first")).agg(F.count("*").alias("n"))


@query("sq3_prefix", f"with {SQL_Q} select k, array_to_string(tokens[1:6], ' ') as p6, array_to_string(tokens[1:20], ' ') as p20 from q")
def sq3(spark, sf):
    return user_sequences(spark, sf).select("k", X.prefix(F.col("tokens"), 6).alias("p6"), X.prefix(F.col("tokens"), 20).alias("p20"))


@query("sq4_collect_sequence", f"with {SQL_Q2} select k, array_to_string(tokens, ' ') as tokens from q2")
def sq4(spark, sf):
    return order_sequences(spark, sf).select("k", F.array_join("tokens", " ").alias("tokens"))


SQL_GRAMS = "g as (select k, unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n} - 1], ' '))) as gram from (select k, tokens[1:{first}] as t from {of}))"


@query("sq5_ngrams", f"with {SQL_Q}, {SQL_GRAMS.format(n=3, first=10, of='q')} select gram, count(*) as n from g group by 1")
def sq5(spark, sf):
    return Q.ngram_counts(user_sequences(spark, sf), "tokens", 3)


@query("sq6_top_ngrams_by_group", f"with {SQL_Q2}, g as (select band, unnest(list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i + 1], ' '))) as gram from (select band, tokens[1:10] as t from q2)), c as (select band, gram, count(*) as n from g group by 1, 2) select band, gram, n, cast(rank as int) as rank from (select *, row_number() over (partition by band order by n desc, gram) as rank from c) where rank <= 15")
def sq6(spark, sf):
    return Q.top_ngrams_by_group(order_sequences(spark, sf), "band", "tokens", 2, 15)


@query("sq14_heavy_ngrams_by_group", f"with {SQL_Q2}, g as (select band, unnest(list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i + 1], ' '))) as gram from (select band, tokens[1:10] as t from q2)), c as (select band, gram, count(*) as n from g group by 1, 2) select band, gram, n, cast(rank as int) as rank from (select *, row_number() over (partition by band order by n desc, gram) as rank from c) where rank <= 15")
def sq14(spark, sf):
    """SQ6 through the heavy hitters of each band."""
    return Q.top_ngrams_by_group(order_sequences(spark, sf), "band", "tokens", 2, 15, tracked=1000)


_SHARES = ", ".join(f"""round(100.0 * count(*) filter (f = '{t}') / count(*), 6) as "{t}\"""" for t in CHOSEN)


@query("sq7_first_token_share", f"with {SQL_Q2} select band, {_SHARES} from (select band, tokens[1] as f from q2) where f in {CHOSEN} group by 1")
def sq7(spark, sf):
    return Q.first_token_share(order_sequences(spark, sf), "band", "tokens", CHOSEN)


@query("sq8_prefix_concentration", f"with {SQL_Q2}, c as (select array_to_string(tokens[1:3], ' ') as prefix, band, count(*) as c from q2 group by 1, 2), p as (select prefix, sum(c) as n, max(c) as m, min_by(band, (-c, band)) as d from c group by 1) select prefix, cast(n as bigint) as n, round(m / n, 6) as share, d as dominant from p order by n desc, prefix limit 20")
def sq8(spark, sf):
    return Q.prefix_concentration(order_sequences(spark, sf).withColumn("prefix", X.prefix(F.col("tokens"), 3)), "prefix", "band", 20)


@query("sq9_signal_strength", f"with {SQL_Q2}, c as (select d as depth, array_to_string(tokens[1:d], ' ') as prefix, band, count(*) as c from q2, (values (1), (3), (5)) v(d) group by 1, 2, 3), p as (select depth, prefix, sum(c) as n, max(c) as m from c group by 1, 2), r as (select *, row_number() over (partition by depth order by n desc, prefix) as place from p), a as (select depth, round(avg(m / n), 6) as avg_share from r where place <= 20 group by 1) select depth, avg_share, case when avg_share < 0.3 then 'weak' when avg_share < 0.5 then 'moderate' else 'strong' end as label from a")
def sq9(spark, sf):
    return Q.signal_strength(order_sequences(spark, sf), "tokens", "band", (1, 3, 5))


_ROWS = ", ".join(f"round(100.0 * count(*) filter (band = '{b}') / count(*), 6) as {b}" for b in LABELS)


@query("sq10_sequence_band_matrix", f"with {SQL_Q2}, p as (select array_to_string(tokens[1:3], ' ') as prefix, band from q2), t as (select prefix from p group by 1 order by count(*) desc, prefix limit 20) select prefix, {_ROWS} from p where prefix in (select prefix from t) group by 1")
def sq10(spark, sf):
    return Q.sequence_band_matrix(order_sequences(spark, sf).withColumn("prefix", X.prefix(F.col("tokens"), 3)), "prefix", "band", LABELS)


@query("sq11_sequence_entropy_by_band", f"with {SQL_Q2}, c as (select band, array_to_string(tokens[1:3], ' ') as v, count(*) as c from q2 group by 1, 2), p as (select band, c, sum(c) over (partition by band) as n from c), e as (select band, round(sum(-(c / n) * log2(c / n)), 6) as entropy from p group by 1) select v.band, coalesce(entropy, 0.0::double) as entropy from (values ('b1'), ('b2'), ('b3'), ('b4'), ('b5'), ('b6')) v(band) left join e on v.band = e.band")
def sq11(spark, sf):
    return Q.sequence_entropy_by_band(order_sequences(spark, sf).withColumn("prefix", X.prefix(F.col("tokens"), 3)), "prefix", "band", [*LABELS, "b6"])


@query("sq12_sequence_quality", f"with {SQL_Q}, s as (select case when k % 10 = 0 then null when k % 10 = 1 then [] else tokens end as t from q) select count(*) as rows, count(*) filter (t is null) as missing, count(*) filter (len(t) = 0) as empty, round(avg(len(t)), 6) as mean_tokens, cast(sum(coalesce(len(list_filter(t, lambda x: x = 'click')), 0)) as bigint) as bad_tokens from s")
def sq12(spark, sf):
    tokens = F.when(F.col("k") % 10 == 0, F.lit(None)).when(F.col("k") % 10 == 1, F.array().cast("array<string>")).otherwise(F.col("tokens"))
    return Q.sequence_quality(user_sequences(spark, sf).select(tokens.alias("tokens")), "tokens", "^(?!click$).*$")


@query("sq13_book_depth", f"with {SQL_Q2}, p as (select k, d as depth, array_to_string(tokens[1:d], ' ') as prefix from q2, range(1, 21) r(d) where d <= len(tokens)), b as (select prefix from p group by 1 having count(*) >= 50), f as (select k, max(depth) as depth from p where prefix in (select prefix from b) group by 1) select q2.k, cast(coalesce(depth, 0) as int) as depth from q2 left join f on q2.k = f.k")
def sq13(spark, sf):
    return Q.book_depth(order_sequences(spark, sf), "k", "tokens", 50)


# Features -----------------------------------------------------------------------------------------------------------

_VOCAB = "v as (select p_brand, row_number() over (order by count(*) desc, p_brand) - 1 as i from part group by 1 qualify i < 10)"


@query("fe1_fit_topn_vocab", f"with {_VOCAB} select p_brand, n, cast(i as int) as i from (select p_brand, count(*) as n from part group by 1) join v using (p_brand)")
def fe1(spark, sf):
    parts = table(spark, sf, "part", "p_brand")
    vocab = E.fit_topn_vocab(parts, "p_brand", 10)
    return top_k(parts, ["p_brand"], 10).select("p_brand", "n", F.array_position(F.array(*map(F.lit, vocab)), F.col("p_brand")).cast("int").alias("i")).withColumn("i", F.col("i") - 1)


_HOT = ", ".join(f"""cast(o_orderpriority = '{p}' as int)::float as "p_{p}\"""" for p in PRIORITIES[:3])


@query("fe2_one_hot", f"select o_orderkey, {_HOT} from orders")
def fe2(spark, sf):
    return E.one_hot(table(spark, sf, "orders", "o_orderkey", "o_orderpriority"), "o_orderpriority", PRIORITIES[:3], "p").drop("o_orderpriority")


@query("fe3_topn_index", f"with {_VOCAB} select p_partkey, cast(coalesce(i, 10) as int) as p_brand_index from part left join v using (p_brand)")
def fe3(spark, sf):
    parts = table(spark, sf, "part", "p_partkey", "p_brand")
    return E.topn_index(parts, "p_brand", E.fit_topn_vocab(parts, "p_brand", 10)).select("p_partkey", "p_brand_index")


@query("fe4_target_encode", f"select o_orderkey, cast(substr({B}, 2, 1) as int) - 1 as y from orders")
def fe4(spark, sf):
    return banded_orders(spark, sf).select("o_orderkey", E.target_encode(F.col("band"), LABELS).alias("y"))


_FIRST = ", ".join(f"""cast(tokens[1] = '{t}' as int)::float as "first_{t}\"""" for t in CHOSEN)


@query("fe5_first_token_one_hot", f"with {SQL_Q2} select k, {_FIRST}, cast(tokens[1] not in {CHOSEN} as int)::float as first_other from q2")
def fe5(spark, sf):
    return E.first_token_one_hot(order_sequences(spark, sf).select("k", "tokens"), "tokens", CHOSEN).drop("tokens")


@query("fe6_scaled_numerics", "select l_orderkey, l_linenumber, round(ln(1 + l_extendedprice), 6) as price_log, round(ln(1 + l_tax), 6) as tax_log, round(least(greatest(l_quantity, 0), 40) / 40.0, 6) as quantity_norm from lineitem")
def fe6(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.log1p("l_extendedprice"), 6).alias("price_log"), F.round(F.log1p("l_tax"), 6).alias("tax_log"), F.round(X.clip_scale(F.col("l_quantity"), 40.0), 6).alias("quantity_norm"))


@query("fe7_seq_entropy", f"with {SQL_Q}, t as (select k, unnest(tokens[1:10]) as t from q), c as (select k, t, count(*) as c from t group by 1, 2), p as (select k, c, sum(c) over (partition by k) as n from c) select k, round(sum(-(c / n) * log2(c / n)), 6) + 0.0 as entropy from p group by 1")
def fe7(spark, sf):
    return user_sequences(spark, sf).select("k", (F.round(X.seq_entropy(F.col("tokens"), 10), 6) + 0.0).alias("entropy"))


@query("fe8_token_flags", f"with {SQL_MOVES} select k, true as kingside, n = 'O-O-O' as queenside from m")
def fe8(spark, sf):
    tokens = X.tokenize_moves(F.col("text"))
    return moves(spark, sf).select("k", X.token_flag(tokens, "O-O[+#]?", 20).alias("kingside"), X.token_flag(tokens, "O-O-O[+#]?", 20).alias("queenside"))


@query("fe9_token_count_matching", f"with {SQL_Q} select k, cast(len(list_filter(tokens[1:15], lambda x: x like '%c%')) as int) as hits from q")
def fe9(spark, sf):
    return user_sequences(spark, sf).select("k", X.token_count_matching(F.col("tokens"), "c", 15).alias("hits"))


@query("fe10_token_ratio_matching", f"with {SQL_Q} select k, round(len(list_filter(tokens[1:10], lambda x: x like 'c%')) / len(tokens[1:10]), 6) as ratio from q")
def fe10(spark, sf):
    return user_sequences(spark, sf).select("k", F.round(X.token_ratio_matching(F.col("tokens"), "^c", 10), 6).alias("ratio"))


@query("fe11_token_lengths", f"with {SQL_Q} select k, array_to_string(list_concat(list_transform(tokens[1:10], lambda x: length(x)), [0, 0, 0, 0, 0, 0, 0, 0, 0, 0])[1:10], ',') as lengths from q")
def fe11(spark, sf):
    return user_sequences(spark, sf).select("k", F.array_join(X.token_lengths(F.col("tokens"), 10).cast("array<string>"), ",").alias("lengths"))


@query("fe12_opening_family", f"with {SQL_Q2} select case when tokens[1] in ('AF', 'RF') then 'closed' when tokens[1] = 'NO' then 'open' else 'other' end as family, count(*) as n from q2 group by 1")
def fe12(spark, sf):
    return order_sequences(spark, sf).groupBy(E.opening_family(F.col("tokens"), {"closed": ("AF", "RF"), "open": ("NO",)}).alias("family")).agg(F.count("*").alias("n"))


_TFIDF = f"{SQL_Q}, g as (select k, unnest(list_transform(range(1, len(tokens)), lambda i: array_to_string(tokens[i:i + 1], ' '))) as gram from q), d as (select gram, count(distinct k) as df from g group by 1 order by df desc, gram limit 20), v as (select gram, df, ln((1 + (select count(*) from q)) / (1 + df)) + 1 as idf from d)"


@query("fe13_fit_tfidf", f"with {_TFIDF} select gram, df, round(idf, 6) as idf from v")
def fe13(spark, sf):
    return E.fit_tfidf(user_sequences(spark, sf), "k", "tokens", 2, 20).withColumn("idf", F.round("idf", 6))


@query("fe14_transform_tfidf", f"with {_TFIDF}, w as (select k, gram, count(*) * max(idf) as w from g join v using (gram) group by 1, 2) select k, gram, round(w / sqrt(sum(w * w) over (partition by k)), 6) as w from w")
def fe14(spark, sf):
    rows = user_sequences(spark, sf)
    return E.transform_tfidf(rows, "k", "tokens", 2, E.fit_tfidf(rows, "k", "tokens", 2, 20))


@query("fe15_svd")
def fe15(spark, sf):
    rows = user_sequences(spark, sf)
    model = E.fit_tfidf(rows, "k", "tokens", 2, 20)
    vocab = [r["gram"] for r in model.collect()]  # as many rows as the vocabulary
    weights = E.transform_tfidf(rows, "k", "tokens", 2, model)
    _, vectors = E.fit_svd(weights, "k", vocab, 5)
    return E.project_svd(weights, "k", vocab, vectors)


_GRAM = f"with {_TFIDF}, w as (select k, gram, count(*) * max(idf) as w from g join v using (gram) group by 1, 2), u as (select k, gram, round(w / sqrt(sum(w * w) over (partition by k)), 6) as w from w), p1 as (select a.gram as a, b.gram as b, sum(a.w * b.w) as s from u a join u b using (k) group by 1, 2), p2 as (select x.a, y.b, sum(x.s * y.s) as s from p1 x join p1 y on x.b = y.a group by 1, 2)"


@query("fe21_singular_values", f"{_GRAM} select 2 as power, round(sum(s) filter (a = b), 4) as total from p1 union all select 4, round(sum(s) filter (a = b) / 1000, 4) from p2 union all select 6, round(sum(p1.s * p2.s) / 1000000, 4) from p1 join p2 on p1.b = p2.a and p1.a = p2.b")
def fe21(spark, sf):
    """Sums of powers of the singular values, in units of 1, 10^3 and 10^6: those of the matrix are traces of its square's powers."""
    rows = user_sequences(spark, sf)
    model = E.fit_tfidf(rows, "k", "tokens", 2, 20)
    values, _ = E.fit_svd(E.transform_tfidf(rows, "k", "tokens", 2, model), "k", [r["gram"] for r in model.collect()], 20)
    sums = [(p, float((values**p).sum() / unit)) for p, unit in ((2, 1), (4, 1e3), (6, 1e6))]
    return spark.createDataFrame(sums, "power int, total double").withColumn("total", F.round("total", 4))


@query("fe16_min_length_gate", f"with {SQL_Q2}, r as (select priority, count(*) as rows, count(*) filter (len(tokens) < 2) as dropped, round(100.0 * avg(cast(len(tokens) < 2 as int)), 6) as rate from q2 group by 1) select *, case when rate <= 1.5 then 'pass' when rate <= 3 then 'warn' else 'fail' end as verdict from r")
def fe16(spark, sf):
    return E.min_length_gate(order_sequences(spark, sf), "tokens", "priority", 2)


_BUILT = f"""select k, cast(substr(band, 2, 1) as int) - 1 as y, {", ".join(f'''cast(priority = '{p}' as int)::float as "p_{p}"''' for p in PRIORITIES)}, round(ln(1 + price), 6) as price_log, round(least(greatest(len(tokens), 0), 7) / 7.0, 6) as length_norm, cast(tokens[1] = 'NO' as int)::float as first_no from q2"""


def _features(rows):
    hot = [(f"p_{p}", (F.col("priority") == p).cast("float")) for p in PRIORITIES]
    spec = [("y", E.target_encode(F.col("band"), LABELS)), *hot, ("price_log", F.round(F.log1p("price"), 6)), ("length_norm", F.round(X.clip_scale(F.size("tokens").cast("double"), 7.0), 6)), ("first_no", (X.first_token(F.col("tokens")) == "NO").cast("float"))]
    return E.assemble_features(rows, spec, "k")


@query("fe17_assemble_features", f"with {SQL_Q2} {_BUILT}")
def fe17(spark, sf):
    return _features(order_sequences(spark, sf))


@query("fe18_leakage_check", "select *, forbidden or abs(r) > 0.95 as leaks from (" + " union all ".join(f"select '{c}' as column, {str(c == 'l_discount').lower()} as forbidden, round(corr({e}, l_extendedprice), 6) as r from lineitem" for c, e in (("l_quantity", "l_quantity"), ("l_discount", "l_discount"), ("l_tax", "l_tax"), ("copy", "2 * l_extendedprice"))) + ")")
def fe18(spark, sf):
    rows = table(spark, sf, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax").withColumn("copy", F.col("l_extendedprice") * 2)
    return E.leakage_check(rows, "l_extendedprice", forbidden=["l_discount"])


@query("fe19_verify_feature_store", "select case when m < '1997' then 'train' else 'validation' end as split, count(*) as rows, cast(sum(cast(p as int)) as bigint) as nulls, true as same_schema from (select strftime(o_orderdate, '%Y') as m, o_orderpriority = '5-LOW' as p from orders) group by 1")
def fe19(spark, sf):
    rows = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy").alias("m"), F.expr("nullif(o_orderpriority, '5-LOW')").alias("p"))
    return E.verify_feature_store(rows.where("m < '1997'"), rows.where("m >= '1997'"))


SPEC = E.FeatureSpec("k", "band", LABELS, "tokens", "code", list("12345"), "status", STATUSES, "base", "inc", ("NO", "AF"), 7.0, 2, 10, 2, 20, 3)
#: Names under which the feature build sees the tokens, so that castling, checks and pawn moves occur.
NAMES = {"AF": "e4", "RF": "O-O", "NF": "O-O-O", "NO": "Nf3+"}
WHOLE = replace(SPEC, firsts=("Nf3+", "e4"), grams=6, factors=6)  # as many factors as grams: a basis of all of them
_NAMED = "list_transform(tokens, lambda x: case x " + " ".join(f"when '{a}' then '{b}'" for a, b in NAMES.items()) + " else x end)"
_SPLIT = f"""{SQL_Q2}, f as (select q2.k, band, {_NAMED} as tokens, o_orderstatus as status, substr(priority, 1, 1) || '-' || (o_custkey % 40) as code, o_custkey % 1800 as base, o_custkey % 30 as inc, case when o_orderdate < timestamp '1997-01-01' then 'train' else 'validation' end as split from q2 join orders on q2.k = o_orderkey where len(tokens) >= 2),
v as (select code, row_number() over (order by count(*) desc, code) as place from f where split = 'train' group by 1 qualify place <= 10),
g as (select k, split, unnest(list_transform(range(1, len(tokens)), lambda i: array_to_string(tokens[i:i + 1], ' '))) as gram from f),
b as (select gram from g where split = 'train' group by 1 order by count(distinct k) desc, gram limit 6), h as (select distinct k from g where gram in (select gram from b)),
e as (select k, sum(-(c / n) * log2(c / n)) as entropy from (select k, t, count(*) as c, sum(count(*)) over (partition by k) as n from (select k, unnest(tokens[1:20]) as t from f) group by 1, 2) group by 1)"""
_CHECKS = "len(list_filter(tokens[1:15], lambda x: regexp_matches(x, '[+#]$')))"
_PAWNS = "len(list_filter(tokens[1:10], lambda x: regexp_matches(x, '^[a-h]'))) / len(tokens[1:10])"


def _float_sql(e: str) -> str:
    """Features are written as float."""
    return f"round(({e})::float::double, 4)"


_GATHERED = ", ".join(
    [_float_sql(f"(substr(code, 1, 1) = '{v}')::int") + f' as "cat_{v}"' for v in "12345"]
    + [_float_sql(f"(status = '{v}')::int") + f' as "kind_{v}"' for v in STATUSES]
    + [_float_sql("ln(1 + base)") + " as base_log", _float_sql("ln(1 + inc)") + " as increment_log", _float_sql("least(len(tokens), 7) / 7.0") + " as length_norm"]
    + [_float_sql(f"(tokens[1] = '{v}')::int") + f' as "first_{v}"' for v in WHOLE.firsts]
    + [_float_sql(f"(tokens[1] not in {WHOLE.firsts})::int") + " as first_other", _float_sql("greatest(entropy, 0)") + " as entropy"]
    + [_float_sql(f"list_contains(tokens[1:20], '{t}')::int") + f" as {name}" for t, name in (("O-O", "kingside"), ("O-O-O", "queenside"))]
    + [_float_sql(_CHECKS) + " as checks", _float_sql(_PAWNS) + " as pawn_ratio"]
)


def built(spark, sf, spec=SPEC, names=None):
    """(the gate of both splits, the folder with the written features)."""
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus").withColumnRenamed("o_orderkey", "k")
    code = F.concat(F.substring("priority", 1, 1), F.lit("-"), (F.col("o_custkey") % 40).cast("string"))
    tokens = F.transform("tokens", lambda t: F.coalesce(X.map_values(t, names), t)) if names else F.col("tokens")
    rows = order_sequences(spark, sf).join(orders, "k").select("k", "band", tokens.alias("tokens"), F.col("o_orderstatus").alias("status"), code.alias("code"), (F.col("o_custkey") % 1800).alias("base"), (F.col("o_custkey") % 30).alias("inc"), "o_orderdate")
    path, out, cut = scratch(spark, "sequences"), scratch(spark, "features"), F.lit("1997-01-01").cast("timestamp")
    rows.write.parquet(path)  # both splits come from sequences that are collected once
    rows = spark.read.schema(rows.schema).parquet(path)
    return E.build_features({"train": rows.where(F.col("o_orderdate") < cut).drop("o_orderdate"), "validation": rows.where(F.col("o_orderdate") >= cut).drop("o_orderdate")}, spec, out), out


@query("fe20_build_features", f"with {_SPLIT} select f.k, split, cast(substr(band, 2, 1) as int) - 1 as y, coalesce(place, 0) as code_place, {_GATHERED}, case when h.k is null then 0.0 else 1.0 end::double as svd_length from f left join v using (code) left join e on e.k = f.k left join h on h.k = f.k")
def fe20(spark, sf):
    _, out = built(spark, sf, WHOLE, NAMES)
    codes = load_artifacts(spark, f"{out}/artifacts", "v1")["codes"]
    place = sum((F.col(f"`code_{v}`") * (k + 1) for k, v in enumerate(codes)), F.lit(0)).cast("long").alias("code_place")
    names = [*[f"cat_{v}" for v in WHOLE.letters], *[f"kind_{v}" for v in STATUSES], "base_log", "increment_log", "length_norm", *[f"first_{v}" for v in WHOLE.firsts], "first_other", "entropy", "kingside", "queenside", "checks", "pawn_ratio"]
    length = F.round(F.sqrt(sum((F.col(f"svd_{k}") * F.col(f"svd_{k}") for k in range(WHOLE.factors)), F.lit(0.0))), 4) + 0.0
    split = F.when(F.contains("_metadata.file_path", F.lit("/train/")), "train").otherwise("validation").alias("split")
    rows = spark.read.parquet(f"{out}/train", f"{out}/validation").select("k", split, F.col("band").cast("int").alias("y"), place, length.alias("svd_length"), *[F.col(f"`{c}`") for c in names])
    return rows.select("k", "split", "y", "code_place", "svd_length", *[(F.round(F.col(f"`{c}`").cast("double"), 4) + 0.0).alias(c) for c in names])


@query("io11_artifacts", f"with {_VOCAB} select cast(coalesce(i, 10) as int) as p_brand_index, count(*) as n from part left join v using (p_brand) group by 1")
def io11(spark, sf):
    parts = table(spark, sf, "part", "p_brand")
    path = scratch(spark, "artifacts")
    save_artifacts(spark, {"vocab": E.fit_topn_vocab(parts, "p_brand", 10), "breaks": list(BREAKS)}, path, "v1")
    vocab = load_artifacts(spark, path, "v1")["vocab"]
    return E.topn_index(parts, "p_brand", vocab).groupBy("p_brand_index").agg(F.count("*").alias("n"))
