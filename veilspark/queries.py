"""Registered queries of the library's operators, each with the SQL that must give the same rows.

`QUERIES` maps a name to a function of (spark, sf_dir); `ORACLES` a name to DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import noise
from .operators import encode, evaluate, features, marginal, predicates, selection
from .operators.consistency import norm_cut
from .plans.domain import Domain, all_cliques

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Codes of the line items' attributes, as both engines compute them.
LINE_SQL = """(select l_orderkey, l_extendedprice,
  case l_returnflag when 'A' then 0 when 'N' then 1 when 'R' then 2 end as flag,
  case l_linestatus when 'F' then 0 when 'O' then 1 end as status,
  l_linenumber - 1 as line, l_quantity::bigint - 1 as quantity,
  round(l_discount * 100)::bigint as discount, round(l_tax * 100)::bigint as tax from lineitem)"""
LINE_DOMAIN = Domain({"flag": 3, "status": 2, "line": 7, "quantity": 50, "discount": 11, "tax": 9})


def coded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with public domains: no fitting pass over the data."""
    df = table(spark, sf_dir, "lineitem")
    code = lambda c, values: F.coalesce(*[F.when(F.col(c) == v, F.lit(i)) for i, v in enumerate(values)]).cast("long")
    return df.select(
        "l_orderkey", "l_extendedprice", code("l_returnflag", "ANR").alias("flag"), code("l_linestatus", "FO").alias("status"), (F.col("l_linenumber") - 1).cast("long").alias("line"),
        (F.col("l_quantity").cast("long") - 1).alias("quantity"), F.round(F.col("l_discount") * 100).cast("long").alias("discount"), F.round(F.col("l_tax") * 100).cast("long").alias("tax"),
    )


def halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Even and odd orders, as real and synthetic rows."""
    return df.where("l_orderkey % 2 = 0"), df.where("l_orderkey % 2 = 1")


def _marginal_sql(cliques: list[tuple[str, ...]], where: str = "true", n: str = "count(*)::bigint") -> str:
    width = max(map(len, cliques))
    keys = lambda c: ", ".join(f"{c[j]}::bigint as k{j + 1}" if j < len(c) else f"null::bigint as k{j + 1}" for j in range(width))
    return " union all ".join(f"select '{','.join(c)}' as clique, {keys(c)}, {n} as n from {LINE_SQL} where {where} group by {', '.join(c)}" for c in cliques)


# --- encoders ---------------------------------------------------------------------------


@register("""with a as (select l_returnflag v, dense_rank() over (order by l_returnflag) - 1 c from lineitem group by 1),
b as (select l_tax v, dense_rank() over (order by l_tax) - 1 c from lineitem group by 1)
select l_orderkey, l_linenumber, a.c::bigint as l_returnflag, b.c::bigint as l_tax from lineitem join a on l_returnflag = a.v join b on l_tax = b.v""")
def ordinal_encode(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_tax")
    return encode.ordinal_encode(df, ["l_returnflag", "l_tax"])


@register("""select 'p_brand' as attr, (dense_rank() over (order by p_brand) - 1)::bigint as code, count(*)::bigint as n from part group by p_brand
union all select 'p_size', (dense_rank() over (order by p_size) - 1)::bigint, count(*)::bigint from part group by p_size""")
def onehot_counts(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return encode.one_hot_counts(df, {c: encode.ordinal_map(df, c) for c in ("p_brand", "p_size")})


@register("""with b as (select min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem)
select least(99, floor((l_extendedprice - lo) / ((hi - lo) / 100)))::bigint as bin, count(*)::bigint as n from lineitem, b group by 1""")
def kbins_uniform(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    lo, hi = encode.bounds(df, "l_extendedprice")["l_extendedprice"]
    return df.groupBy(encode.uniform_bin(F.col("l_extendedprice"), lo, hi).alias("bin")).agg(F.count("*").alias("n"))


@register("""with b as (select min(o_totalprice) lo, max(o_totalprice) hi from orders)
select least(99, floor((log2(o_totalprice - (lo - 0.01::double)) - log2(0.01::double)) / ((log2(hi - (lo - 0.01::double)) - log2(0.01::double)) / 100)))::bigint as bin, count(*)::bigint as n from orders, b group by 1""")
def kbins_log(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    lo, hi = encode.bounds(df, "o_totalprice")["o_totalprice"]
    return df.groupBy(encode.log_bin(F.col("o_totalprice"), lo, hi).alias("bin")).agg(F.count("*").alias("n"))


@register("""with b as (select min(c_acctbal) lo, max(c_acctbal) hi from customer)
select c_custkey, round(lo + (hi - lo) / 100 * (least(99, floor((c_acctbal - lo) / ((hi - lo) / 100))) + 0.5::double), 6) as middle from customer, b""")
def kbins_inverse_mid(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    lo, hi = encode.bounds(df, "c_acctbal")["c_acctbal"]
    code = encode.uniform_bin(F.col("c_acctbal"), lo, hi)
    return df.select("c_custkey", F.round(encode.bin_middle(code, lo, hi), 6).alias("middle"))


@register("""select (o_orderkey * 65537 % 4294967296) >> 16 as subnet, floor(ln(1 + o_totalprice) / ln(2))::bigint as power,
case when o_custkey < 1024 then o_custkey else 1024 + floor((o_custkey - 1024) / 100) end::bigint as port, count(*)::bigint as n from orders group by all""")
def network_bins(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    address = F.col("o_orderkey") * 65537 % 4294967296
    return df.groupBy(encode.subnet(address, 16).alias("subnet"), encode.power_bin(1 + F.col("o_totalprice"), 2).alias("power"), encode.port_bin(F.col("o_custkey")).alias("port")).agg(F.count("*").alias("n"))


@register("""with c as (select props, count(*) n from events group by 1), t as (select sum(n) total from c)
select case when c.n <= total * 0.01::double then 'R' else props end as props, sum(c.n)::bigint as n from c, t group by 1""")
def rare_merge(spark, sf_dir):
    df = encode.rare_merged(table(spark, sf_dir, "events"), "props", 0.01)
    return df.groupBy("props").agg(F.count("*").alias("n"))


@register("select p_type as value, (row_number() over (order by count(*) desc, p_type) - 1)::bigint as code, count(*)::bigint as n from part group by p_type")
def freq_ordered_ids(spark, sf_dir):
    return encode.frequency_map(table(spark, sf_dir, "part"), "p_type")


@register("""with b as (select min(p_retailprice) lo, max(p_retailprice) hi from part)
select p_partkey, round(-1 + (p_retailprice - lo) / (hi - lo) * 2, 9) as scaled, round_even(99 * (p_retailprice - lo) / (hi - lo), 0)::bigint as rescaled from part, b""")
def minmax_scale(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    lo, hi = encode.bounds(df, "p_retailprice")["p_retailprice"]
    x = F.col("p_retailprice")
    return df.select("p_partkey", F.round(encode.minmax(x, lo, hi, -1.0, 1.0), 9).alias("scaled"), encode.rescaled_99(x, lo, hi).alias("rescaled"))


@register("""with r as (select l_extendedprice x, row_number() over (order by l_extendedprice) - 1 i, count(*) over () n from lineitem)
select max(case when i = ceil(0.05::double * (n - 1)) then x end) as lo, max(case when i = floor(0.95::double * (n - 1)) then x end) as hi from r""")
def quantile_bounds(spark, sf_dir):
    return encode.quantile_rows(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.05, 0.95)


@register("""select o_orderkey, round((o_totalprice - m) / s, 6) as z from orders, (select avg(o_totalprice) m, stddev_pop(o_totalprice) s from orders)""")
def target_standardize(spark, sf_dir):
    return encode.standardised(table(spark, sf_dir, "orders"), "o_totalprice", "z").select("o_orderkey", F.round("z", 6).alias("z"))


@register("""with s as (select o_orderpriority p, sum(o_totalprice) s, count(*) n from orders group by 1)
select o_orderkey, round((s - o_totalprice) / (n - 1), 4) as loo from orders join s on o_orderpriority = p""")
def loo_encode(spark, sf_dir):
    return encode.leave_one_out(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "loo").select("o_orderkey", F.round("loo", 4).alias("loo"))


@register("""with c as (select o_totalprice v, count(*) n from orders group by 1), r as (select v, (sum(n) over (order by v) - (n - 1) / 2.0::double) / sum(n) over () as cdf from c)
select o_orderkey, round(cdf, 9) as cdf from orders join r on v = o_totalprice""")
def empirical_cdf(spark, sf_dir):
    return encode.empirical_cdf(table(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey", F.round("cdf", 9).alias("cdf"))


@register("""select 'flag' as attr, count(distinct l_returnflag)::bigint as size, count(*) filter (l_returnflag is null)::bigint as missing from lineitem
union all select 'quantity', count(distinct l_quantity)::bigint, count(*) filter (l_quantity is null)::bigint from lineitem
union all select 'discount', count(distinct l_discount)::bigint, count(*) filter (l_discount is null)::bigint from lineitem""")
def domain_sizes(spark, sf_dir):
    names = {"flag": "l_returnflag", "quantity": "l_quantity", "discount": "l_discount"}
    row = table(spark, sf_dir, "lineitem").agg(*[f(F.col(c)).alias(f"{a}_{k}") for a, c in names.items() for k, f in (("size", F.count_distinct), ("missing", lambda x: F.count_if(x.isNull())))])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(f"{a}_size").alias("size"), F.col(f"{a}_missing").alias("missing")) for a in names]))
    return row.select(each.alias("e")).select("e.*")


# --- marginals --------------------------------------------------------------------------

ONE, TWO, THREE = (all_cliques(LINE_DOMAIN, k) for k in (1, 2, 3))
SMALL = [c for c in THREE if LINE_DOMAIN.size(c) <= 1000]


@register(_marginal_sql(ONE))
def marginal_1way(spark, sf_dir):
    return marginal.marginals(coded_lines(spark, sf_dir), ONE)


@register(_marginal_sql(TWO))
def marginal_2way(spark, sf_dir):
    return marginal.marginals(coded_lines(spark, sf_dir), TWO)


@register(_marginal_sql(SMALL))
def marginal_3way(spark, sf_dir):
    return marginal.marginals(coded_lines(spark, sf_dir), SMALL)


@register(_marginal_sql(ONE + TWO))
def marginal_all_pairs(spark, sf_dir):
    return marginal.marginals(coded_lines(spark, sf_dir), ONE + TWO)


@register("select clique, k1, k2, round(n, 2) as n from (" + _marginal_sql([("flag", "status"), ("line", "discount")], n="sum(l_extendedprice)") + ")")
def marginal_weighted(spark, sf_dir):
    out = marginal.marginals(coded_lines(spark, sf_dir), [("flag", "status"), ("line", "discount")], weight="l_extendedprice", collapse=False)
    return out.withColumn("n", F.round("n", 2))


ZERO_SQL = f"""select f.f as flag, q.q as quantity, coalesce(n, 0)::bigint as n from (select unnest(range(3)) f) f cross join (select unnest(range(50)) q) q
left join (select flag, quantity, count(*) n from {LINE_SQL} where tax = 8 and discount = 3 group by 1, 2) on flag = f.f and quantity = q.q"""


@register(ZERO_SQL)
def marginal_zero_filled(spark, sf_dir):
    return marginal.zero_filled(coded_lines(spark, sf_dir).where("tax = 8 and discount = 3"), LINE_DOMAIN, ("flag", "quantity"))


@register(f"select (flag * 77 + line * 11 + discount)::bigint as cell, flag::bigint as flag, line::bigint as line, discount::bigint as discount, count(*)::bigint as n from {LINE_SQL} group by all")
def marginal_cells(spark, sf_dir):
    clique = ("flag", "line", "discount")
    counts = coded_lines(spark, sf_dir).groupBy(marginal.cell_id(LINE_DOMAIN, clique).alias("cell")).agg(F.count("*").alias("n"))
    return counts.select("cell", *marginal.cell_codes(LINE_DOMAIN, clique, F.col("cell")), "n")


@register(f"select line::bigint as line, count(*)::bigint as n from {LINE_SQL} group by 1")
def marginal_project(spark, sf_dir):
    big = coded_lines(spark, sf_dir).groupBy("flag", "line", "tax").agg(F.count("*").alias("n"))
    return marginal.project(marginal.project(big, ["flag", "line"]), ["line"])


@register(f"select line::bigint as line, count(*) filter (flag = 0)::bigint as c0, count(*) filter (flag = 1)::bigint as c1, count(*) filter (flag = 2)::bigint as c2 from {LINE_SQL} group by 1")
def marginal_pivot(spark, sf_dir):
    return marginal.pivoted(coded_lines(spark, sf_dir).groupBy("line", "flag").agg(F.count("*").alias("n")), "line", "flag", range(3))


@register(" union all ".join(f"select '{a}' as feature, {a}::bigint as code, flag::bigint as target, count(*)::bigint as n, round(count(*) / sum(count(*)) over (partition by flag), 9)::double as p from {LINE_SQL} group by {a}, flag" for a in ("status", "tax")))
def conditional_marginal(spark, sf_dir):
    return marginal.conditional(coded_lines(spark, sf_dir), ["status", "tax"], "flag").withColumn("p", F.round("p", 9))


def _u_sql(seed: str, key: str) -> str:
    return f"((('0x' || substr(md5('{seed}|' || {key}), 1, 8))::bigint + 1) / 4294967297.0::double)"


def _gauss_sql(seed: str, sigma: float, key: str) -> str:
    return f"({sigma}::double * sqrt(-2 * ln({_u_sql(seed + 'a', key)})) * cos(2 * pi() * {_u_sql(seed + 'b', key)}))"


NOISY = f"select flag, quantity, n + {_gauss_sql('s', 3.0, 'flag || chr(124) || quantity')} as y from ({ZERO_SQL})"


@register(f"select flag, quantity, round(y, 5) as y from ({NOISY})")
def noisy_marginal_keyed(spark, sf_dir):
    cells = marginal_zero_filled(spark, sf_dir)
    return cells.select("flag", "quantity", F.round(F.col("n") + noise.keyed_gaussian("s", 3.0, "flag", "quantity"), 5).alias("y"))


@register(f"select flag, quantity, round(greatest(y, 0) / sum(greatest(y, 0)) over (), 8) as share from ({NOISY})")
def noisy_marginal_clipped(spark, sf_dir):
    cells = marginal_zero_filled(spark, sf_dir).withColumn("y", F.greatest(F.lit(0.0), F.col("n") + noise.keyed_gaussian("s", 3.0, "flag", "quantity")))
    return cells.join(cells.agg(F.sum("y").alias("total"))).select("flag", "quantity", F.round(F.col("y") / F.col("total"), 8).alias("share"))


@register(f"""with a as (select flag::bigint flag, count(*) n from {LINE_SQL} group by 1), b as (select tax::bigint tax, count(*) n from {LINE_SQL} group by 1)
select flag, tax, round(a.n * b.n / (select count(*) from lineitem)::double, 6) as expected from a, b""")
def independent_product(spark, sf_dir):
    return marginal.independent_product(coded_lines(spark, sf_dir), "flag", "tax").withColumn("expected", F.round("expected", 6))


@register(f"""select 'flag' as clique, flag::bigint as cell, round((sum(case when l_orderkey % 2 = 0 then 2.0 else 0 end)::double * 1 + sum(case when l_orderkey % 2 = 1 then 2.0 else 0 end)::double * 3) / 4, 6) as y from {LINE_SQL} group by flag""")
def merge_measurements(spark, sf_dir):
    real, synthetic = halves(coded_lines(spark, sf_dir))
    rows = [df.groupBy(F.lit("flag").alias("clique"), F.col("flag").alias("cell")).agg((2.0 * F.count("*")).alias("y")).withColumn("weight", F.lit(w)) for df, w in ((real, 1.0), (synthetic, 3.0))]
    return marginal.merged_measurements(rows[0].unionByName(rows[1])).withColumn("y", F.round("y", 6))


@register(" union all ".join(
    f"""select '{a},{b}' as clique, round(sum(abs(coalesce(t.n, 0) - x.n * y.n / z.n::double)), 4) as indif from (select {a} a, count(*) n from {LINE_SQL} group by 1) x
cross join (select {b} b, count(*) n from {LINE_SQL} group by 1) y cross join (select count(*) n from lineitem) z
left join (select {a} a, {b} b, count(*) n from {LINE_SQL} group by 1, 2) t on t.a = x.a and t.b = y.b"""
    for a, b in (("flag", "status"), ("flag", "line"), ("flag", "tax"), ("status", "line"), ("status", "tax"), ("line", "tax"))
))
def indif_pairs(spark, sf_dir):
    return marginal.dependence(coded_lines(spark, sf_dir), ["flag", "status", "line", "tax"]).withColumn("indif", F.round("indif", 4))


@register(f"select flag::bigint as flag, status::bigint as status, line::bigint as line, round(count(*) / (select count(*) from lineitem), 9)::double as share from {LINE_SQL} group by all")
def empirical_support(spark, sf_dir):
    return marginal.support(coded_lines(spark, sf_dir), ["flag", "status", "line"]).withColumn("share", F.round("share", 9))


@register(f"""select l.l as line, q.q as quantity, d.d as discount, t.t as tax from (select unnest(range(7)) l) l, (select unnest(range(50)) q) q, (select unnest(range(11)) d) d, (select unnest(range(9)) t) t
anti join (select distinct line, quantity, discount, tax from {LINE_SQL}) s on l.l = s.line and q.q = s.quantity and d.d = s.discount and t.t = s.tax""")
def missing_support(spark, sf_dir):
    """Cells of four attributes that no line item occupies."""
    return marginal.missing_support(coded_lines(spark, sf_dir), LINE_DOMAIN, ("line", "quantity", "discount", "tax"))


# --- counting queries -------------------------------------------------------------------

PLANES = [((0.5, -1.0, 2.0), 3.0), ((1.0, 1.0, -3.0), 10.0), ((-0.25, 0.75, 0.5), 0.0)]
PLANE_SQL = lambda body: " union all ".join(f"select {i}::bigint as plane, flag::bigint as target, round({body(w, b)} / (select count(*) from lineitem), 6)::double as share from {LINE_SQL} group by flag" for i, (w, b) in enumerate(PLANES))
COLUMNS = ("quantity", "discount", "tax")


@register(PLANE_SQL(lambda w, b: f"count(*) filter (quantity * ({w[0]}) + discount * ({w[1]}) + tax * ({w[2]}) > {b})"))
def halfspace_counts(spark, sf_dir):
    return predicates.halfspaces(coded_lines(spark, sf_dir), COLUMNS, PLANES, "flag").withColumn("share", F.round("share", 6))


@register(PLANE_SQL(lambda w, b: f"sum(1 / (1 + exp(-0.5 * (quantity * ({w[0]}::double) + discount * ({w[1]}::double) + tax * ({w[2]}::double) - ({b}::double)))))"))
def halfspace_smooth(spark, sf_dir):
    return predicates.halfspaces(coded_lines(spark, sf_dir), COLUMNS, PLANES, "flag", smooth=0.5).withColumn("share", F.round("share", 6))


@register(f"""select 0::bigint as prefix, status::bigint as target, round(count(*) filter (quantity > 20 and tax > 3) / (select count(*) from lineitem), 9)::double as share from {LINE_SQL} group by status
union all select 1, status::bigint, round(count(*) filter (discount > 5) / (select count(*) from lineitem), 9)::double from {LINE_SQL} group by status""")
def prefix_threshold_counts(spark, sf_dir):
    return predicates.prefixes(coded_lines(spark, sf_dir), [{"quantity": 20, "tax": 3}, {"discount": 5}], "status").withColumn("share", F.round("share", 9))


HIST_SQL = f"(select h.h as code, coalesce(n, 0)::bigint as n from (select unnest(range(50)) h) h left join (select quantity, count(*) n from {LINE_SQL} group by 1) on quantity = h.h)"


def _quantities(spark, sf_dir):
    return predicates.histogram(coded_lines(spark, sf_dir), "quantity", 50)


@register(f"select code, sum(n) over (order by code)::bigint as n from {HIST_SQL}")
def prefix_sums(spark, sf_dir):
    return predicates.prefix_sums(_quantities(spark, sf_dir))


@register(f"select code, sum(n) over (order by code desc)::bigint as n from {HIST_SQL}")
def suffix_sums(spark, sf_dir):
    return predicates.suffix_sums(_quantities(spark, sf_dir))


@register(f"select a.code as lo, b.code as hi, sum(c.n)::bigint as n from {HIST_SQL} a join {HIST_SQL} b on a.code <= b.code join {HIST_SQL} c on c.code between a.code and b.code group by 1, 2")
def range_queries(spark, sf_dir):
    return predicates.all_ranges(_quantities(spark, sf_dir))


@register(f"select a.code as lo, sum(c.n)::bigint as n from {HIST_SQL} a join {HIST_SQL} c on c.code between a.code and a.code + 7 where a.code <= 42 group by 1")
def width_k_ranges(spark, sf_dir):
    return predicates.width_ranges(_quantities(spark, sf_dir), 8)


@register(f"select k::bigint as k, sum(pow(code::double, k) * n)::double as moment from {HIST_SQL}, (select unnest([1, 2, 3]) k) group by 1")
def moment_queries(spark, sf_dir):
    return predicates.moments(_quantities(spark, sf_dir), [1, 2, 3])


@register(" union all ".join(f"select {level}::bigint as level, (code // {64 >> level})::bigint as block, sum(case when code % {64 >> level} < {32 >> level} then n else -n end)::bigint as n from {HIST_SQL.replace('range(50)', 'range(64)')} group by 2" for level in range(6)))
def haar_wavelet(spark, sf_dir):
    return predicates.haar(predicates.histogram(coded_lines(spark, sf_dir), "quantity", 64), 64)


BOXES = [(0, 0, 24, 0, 8), (1, 5, 10, 2, 5), (2, 49, 49, 0, 0), (3, 10, 40, 3, 8)]


@register("select q.query::bigint as query, coalesce(count(quantity), 0)::bigint as n from (values " + ", ".join(map(str, BOXES)) + f") q(query, a, b, c, d) left join {LINE_SQL} on quantity between a and b and tax between c and d group by 1")
def box_queries(spark, sf_dir):
    counts = coded_lines(spark, sf_dir).groupBy("quantity", "tax").agg(F.count("*").alias("n"))
    queries = spark.createDataFrame(BOXES, "query long, quantity_lo long, quantity_hi long, tax_lo long, tax_hi long")
    return predicates.boxes(counts, queries, ["quantity", "tax"])


@register(f"""with g as (select l.l as line, t.t as tax from (select unnest(range(7)) l) l, (select unnest(range(9)) t) t)
select g.line, g.tax, count(x.line)::bigint as n from g left join {LINE_SQL} x on x.line <= g.line and x.tax <= g.tax group by 1, 2""")
def prefix_2d_queries(spark, sf_dir):
    return predicates.prefix_2d(marginal.zero_filled(coded_lines(spark, sf_dir), LINE_DOMAIN, ("line", "tax")), "line", "tax")


CONJUNCTIONS = [{"flag": i % 3, "quantity": (i % 25, i % 25 + 20 - i // 300 * 3), "tax": (i % 4, i % 4 + 3)} for i in range(1000)]
_asked = "(values " + ", ".join(str((i, q["flag"], *q["quantity"], *q["tax"])) for i, q in enumerate(CONJUNCTIONS)) + ") q(query, f, a, b, c, d)"
_many = lambda where: f"select q.query::bigint as query, count(x.quantity)::bigint as n, count(x.quantity) / (select count(*)::double from {LINE_SQL} where {where}) as share from {_asked} left join (select flag, quantity, tax from {LINE_SQL} where {where}) x on flag = f and quantity between a and b and tax between c and d group by 1"


@register(f"select query, n, round(share, 9) as share from ({_many('true')})")
def predicate_counts(spark, sf_dir):
    return predicates.selectivities(coded_lines(spark, sf_dir), CONJUNCTIONS).withColumn("share", F.round("share", 9))


ERRORS = f"select r.query, r.share as real, s.share as synthetic, abs(r.share - s.share) as error from ({_many('l_orderkey % 2 = 0')}) r join ({_many('l_orderkey % 2 = 1')}) s using (query)"


@register(f"select query, round(real, 9) as real, round(synthetic, 9) as synthetic, round(error, 9) as error from ({ERRORS})")
def query_error(spark, sf_dir):
    out = evaluate.query_error(*halves(coded_lines(spark, sf_dir)), CONJUNCTIONS)
    return out.select("query", *[F.round(c, 9).alias(c) for c in ("real", "synthetic", "error")])


@register("select count(*)::bigint as n, " + ", ".join(f"round({f}, 9) as {a}" for f, a in (("avg(error)", "mean"), ("max(error)", "max"), ("min(error)", "min"), ("sum(error)", "total"), ("quantile_cont(error, 0.5)", "median"), ("avg(error * error)", "mse"), ("stddev_pop(error)", "deviation"))) + f" from ({ERRORS})")
def workload_errors(spark, sf_dir):
    out = evaluate.error_summary(evaluate.query_error(*halves(coded_lines(spark, sf_dir)), CONJUNCTIONS), "error")
    return out.select("n", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


# --- evaluation -------------------------------------------------------------------------


def _tvd_sql(cliques) -> str:
    side = lambda c, k: f"(select {', '.join(c)}, count(*) / sum(count(*)) over ()::double as p from {LINE_SQL} where l_orderkey % 2 = {k} group by {', '.join(c)})"
    return " union all ".join(f"select '{','.join(c)}' as clique, sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2 as tvd from {side(c, 0)} a full join {side(c, 1)} b using ({', '.join(c)})" for c in cliques)


def _tvd(cliques, sql: str, name: str):
    def query(spark, sf_dir):
        return evaluate.marginal_tvd(*halves(coded_lines(spark, sf_dir)), cliques).withColumn("tvd", F.round("tvd", 9))

    query.__name__ = name
    return register(sql)(query)


tvd_1way = _tvd(ONE, f"select clique, round(tvd, 9) as tvd from ({_tvd_sql(ONE)})", "tvd_1way")
tvd_2way = _tvd(TWO, f"select clique, round(tvd, 9) as tvd from ({_tvd_sql(TWO)})", "tvd_2way")
tvd_3way = _tvd(SMALL, f"select clique, round(tvd, 9) as tvd from ({_tvd_sql(SMALL)})", "tvd_3way")
KINDS = evaluate.tvd_kinds(["quantity", "discount", "tax"], ["status", "line"], "flag")


@register("select kind, round(avg(tvd), 9) as tvd, count(*)::bigint as pairs from (" + _tvd_sql(list(KINDS)) + ") join (values " + ", ".join(f"('{','.join(c)}', '{k}')" for c, k in KINDS.items()) + ") k(clique, kind) using (clique) group by kind")
def tvd_by_kind(spark, sf_dir):
    tvd = evaluate.marginal_tvd(*halves(coded_lines(spark, sf_dir)), list(KINDS))
    kind = F.coalesce(*[F.when(F.col("clique") == ",".join(c), k) for c, k in KINDS.items()])
    return tvd.groupBy(kind.alias("kind")).agg(F.round(F.avg("tvd"), 9).alias("tvd"), F.count("*").alias("pairs"))


@register(f"select round(avg(tvd), 9) as tvd from ({_tvd_sql(TWO)})")
def marginal_2way_tvd(spark, sf_dir):
    """The flagship: mean total variation distance of all two-way marginals."""
    return evaluate.marginal_tvd(*halves(coded_lines(spark, sf_dir)), TWO).agg(F.round(F.avg("tvd"), 9).alias("tvd"))


PREDICTED_SQL = "(select case when l_returnflag = 'N' then 1 else 0 end as y, case when l_linestatus = 'O' then 1 else 0 end as p, l_quantity / 50 + l_tax as score from lineitem)"


def _predicted(spark, sf_dir):
    is_ = lambda c, v: F.when(F.col(c) == v, 1).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(is_("l_returnflag", "N").alias("y"), is_("l_linestatus", "O").alias("p"), (F.col("l_quantity") / 50 + F.col("l_tax")).alias("score"))


@register(f"""with c as (select count(*) filter (y = 1 and p = 1) tp, count(*) filter (y = 0 and p = 0) tn, count(*) filter (y = 0 and p = 1) fp, count(*) filter (y = 1 and p = 0) fn from {PREDICTED_SQL})
select round((tp + tn) / (tp + tn + fp + fn)::double, 9) as accuracy, round((2 * tp / (2 * tp + fp + fn)::double + 2 * tn / (2 * tn + fp + fn)::double) / 2, 9) as macro_f1 from c""")
def confusion_metrics(spark, sf_dir):
    return evaluate.classification(_predicted(spark, sf_dir), "y", "p").select(F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@register(f"""with r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as r from {PREDICTED_SQL})
select round((sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0::double) / (count(*) filter (y = 1) * (count(*) filter (y = 0))::double), 9) as auc from r""")
def roc_auc_rank(spark, sf_dir):
    return evaluate.roc_auc(_predicted(spark, sf_dir), "y", "score").withColumn("auc", F.round("auc", 9))


@register("select round(sqrt(avg(pow(l_extendedprice - l_quantity * 1400, 2))), 4) as rmse, round(1 - sum(pow(l_extendedprice - l_quantity * 1400, 2)) / (count(*) * var_pop(l_extendedprice)), 8) as r2 from lineitem")
def rmse_r2(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_quantity") * 1400)
    return evaluate.regression(df, "l_extendedprice", "p").select(F.round("rmse", 4).alias("rmse"), F.round("r2", 8).alias("r2"))


@register("select event_type, count(value)::bigint as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as deviation from events group by 1")
def seeds_mean_std(spark, sf_dir):
    out = evaluate.runs_summary(table(spark, sf_dir, "events"), F.col("value"), "event_type")
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


# --- selection, allocation, post-processing ----------------------------------------------


@register(f"""select clique, round(tvd + -0.05::double * ln(-ln({_u_sql('g', 'clique')})), 6) as noisy from (select clique, round(tvd, 9) as tvd from ({_tvd_sql(TWO)})) where clique <> 'flag,status' order by 2 desc, 1 limit 5""")
def topq_selection(spark, sf_dir):
    scores = tvd_2way(spark, sf_dir)
    top = selection.top_noisy(scores, "clique", "tvd", 5, 0.05, "g", scores.where("clique = 'flag,status'"))
    return top.select("clique", F.round("noisy", 6).alias("noisy"))


@register(f"""with z as (select flag * 50 + quantity as cell, y - 10 as y from ({NOISY})), d as (select *, sum(case when y < 0 then -y else 0 end) over () as debt, greatest(y, 0) as up from z),
r as (select *, sum(up) over (order by up, cell rows unbounded preceding) as run from d) select cell, round(greatest(0, least(up, run - debt)), 5) as y from r""")
def norm_cut_window(spark, sf_dir):
    cells = marginal_zero_filled(spark, sf_dir).select((F.col("flag") * 50 + F.col("quantity")).alias("cell"), (F.col("n") + noise.keyed_gaussian("s", 3.0, "flag", "quantity") - 10).alias("y"))
    return norm_cut(cells, "cell", "y").withColumn("y", F.round("y", 5))


@register(f"""with e as (select code, n, round_even(sum(n) over (order by code) / sum(n) over ()::double * 1000, 0)::bigint as edge from {HIST_SQL})
select code, n, edge - coalesce(lag(edge) over (order by code), 0) as take from e""")
def proportional_allocation(spark, sf_dir):
    return selection.proportional(_quantities(spark, sf_dir), 1000, "n", "code")


@register(f"""with e as (select code, n, n * 777 / sum(n) over ()::double as exact from {HIST_SQL})
select code, n, floor(exact)::bigint + (row_number() over (order by round(exact - floor(exact), 9) desc, code) <= 777 - sum(floor(exact)) over ())::bigint as take from e""")
def largest_remainder(spark, sf_dir):
    return selection.largest_remainder(_quantities(spark, sf_dir), 777, "n", "code")


# --- joins, sets, features ---------------------------------------------------------------


@register("select r_name, n_name, count(*)::bigint as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")
def dimension_join(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("customers"))


@register("""with s as (select distinct l_returnflag, l_linestatus, l_tax from lineitem where l_orderkey % 10 = 0)
select l_returnflag, l_linestatus, l_tax, count(*)::bigint as n from lineitem join s using (l_returnflag, l_linestatus, l_tax) where l_orderkey % 10 <> 0 group by 1, 2, 3""")
def support_join(spark, sf_dir):
    keys = ["l_returnflag", "l_linestatus", "l_tax"]
    df = table(spark, sf_dir, "lineitem")
    known = df.where("l_orderkey % 10 = 0").select(*keys).distinct()
    return df.where("l_orderkey % 10 <> 0").join(known, keys).groupBy(*keys).agg(F.count("*").alias("n"))


@register("""select side, l_returnflag, count(*)::bigint as n from (select 'real' as side, l_returnflag from lineitem where l_orderkey % 2 = 0
union all select 'synthetic', l_returnflag from lineitem where l_orderkey % 2 = 1 union all select 'merged', l_returnflag from lineitem) group by 1, 2""")
def merged_union(spark, sf_dir):
    real, synthetic = halves(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"))
    merged = real.unionByName(synthetic)
    return real.withColumn("side", F.lit("real")).unionByName(synthetic.withColumn("side", F.lit("synthetic"))).unionByName(merged.withColumn("side", F.lit("merged"))).groupBy("side", "l_returnflag").agg(F.count("*").alias("n"))


@register("""with q as (select vec_id q, embedding::double[] x from embeddings where vec_id % 20 <> 0), t as (select vec_id k, embedding::double[] y from embeddings where vec_id % 20 = 0),
d as (select q, k, list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from q, t),
b as (select q, arg_min(k, struct_pack(d := d, k := k)) as k from d group by 1) select k as vec_id, count(*)::bigint as votes from b group by 1""")
def neighbor_votes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return features.nearest_votes(e.where("vec_id % 20 <> 0"), e.where("vec_id % 20 = 0"), "vec_id", "embedding")


FREQUENCIES = [[((i * 7 + j * 3) % 11 - 5) / 4 for j in range(64)] for i in range(4)]


@register(" union all ".join(f"select {i}::bigint as feature, '{k}' as kind, round(avg(0.5::double * {k}(list_sum(list_transform(list_zip(embedding::double[], {w}::double[]), lambda p: p[1] * p[2])))), 6) as mean from embeddings" for i, w in enumerate(FREQUENCIES) for k in ("cos", "sin")))
def rff_mean(spark, sf_dir):
    return features.fourier_means(table(spark, sf_dir, "embeddings"), "embedding", FREQUENCIES).withColumn("mean", F.round("mean", 6))


_MMD = lambda a, b: f"(select avg(exp(-list_sum(list_transform(list_zip(x.e, y.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 2)) from (select embedding::double[] e from embeddings where label % 2 = {a}) x, (select embedding::double[] e from embeddings where label % 2 = {b}) y)"


@register(f"select round({_MMD(0, 0)} + {_MMD(1, 1)} - 2 * {_MMD(0, 1)}, 6) as mmd")
def mmd_biased(spark, sf_dir):
    """Discrepancy of the vectors with even and with odd labels."""
    e = table(spark, sf_dir, "embeddings")
    a, b = e.where("label % 2 = 0"), e.where("label % 2 = 1")
    return features.discrepancy(a, b, "embedding", 1.0).select(F.round("mmd", 6).alias("mmd"))


@register("""select c_custkey, round((c_acctbal - lo) / (hi - lo), 9) as unit, greatest(0, least(5000, c_acctbal)) as clipped from customer, (select min(c_acctbal) lo, max(c_acctbal) hi from customer)""")
def value_clip(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    lo, hi = encode.bounds(df, "c_acctbal")["c_acctbal"]
    return df.select("c_custkey", F.round(encode.minmax(F.col("c_acctbal"), lo, hi), 9).alias("unit"), F.greatest(F.lit(0.0), F.least(F.lit(5000.0), F.col("c_acctbal"))).alias("clipped"))


@register("""select time_bucket(interval 1 day, ts) as start, event_type, count(*)::bigint as n from events group by 1, 2""")
def windowed_marginal(spark, sf_dir):
    """On a table here; the same function takes a stream."""
    from .streaming.marginals import windowed_marginal as counted

    out = counted(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 day", "1 hour")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register(f"""with c as (select quantity, count(*) n from {LINE_SQL} group by 1), k as (select quantity, n, n >= (select avg(n) from c) as kept from c)
select case when kept then quantity else -1 end::bigint as code, sum(n)::bigint as n from k group by 1""")
def significant_values(spark, sf_dir):
    """Values whose count stays above a threshold keep their code, the rest share one."""
    counts = coded_lines(spark, sf_dir).groupBy("quantity").agg(F.count("*").alias("n"))
    kept = counts.join(counts.agg(F.avg("n").alias("least"))).withColumn("code", F.when(F.col("n") >= F.col("least"), F.col("quantity")).otherwise(F.lit(-1).cast("long")))
    return kept.groupBy("code").agg(F.sum("n").alias("n"))


@register("""with e as (select vec_id, embedding::double[] e from embeddings)
select round(median(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))), 6) as distance from e a join e b on a.vec_id < b.vec_id""")
def median_distance(spark, sf_dir):
    """Median distance of all pairs of vectors, the length scale of a kernel."""
    return spark.createDataFrame([(features.median_distance(table(spark, sf_dir, "embeddings"), "embedding"),)], "distance double").select(F.round("distance", 6).alias("distance"))


# --- stochastic queries: no SQL form -----------------------------------------------------

RHO = 0.5


def _generator():
    import numpy as np

    return np.random.default_rng(11)  # a fixed seed makes the query repeatable; a private release takes none


@register()
def aim_synth(spark, sf_dir):
    """As many synthetic line items as the noisy total, by adaptive measurement of two-way marginals."""
    from .operators import synthesize

    model, _ = synthesize.aim(coded_lines(spark, sf_dir), LINE_DOMAIN, synthesize.two_way_workload(LINE_DOMAIN), RHO, rng=_generator())
    return synthesize.sample(spark, model, round(model.total))


@register()
def mst_synth(spark, sf_dir):
    """As many synthetic line items as the noisy total, by a private spanning tree of two-way marginals."""
    from .operators import synthesize

    model, _ = synthesize.mst(coded_lines(spark, sf_dir), LINE_DOMAIN, RHO, rng=_generator())
    return synthesize.sample(spark, model, round(model.total))


@register()
def mst_tvd(spark, sf_dir):
    """Total variation distance of all two-way marginals of real and synthetic line items."""
    real = coded_lines(spark, sf_dir)
    return evaluate.marginal_tvd(real, mst_synth(spark, sf_dir), TWO)


@register()
def consistency_loop(spark, sf_dir):
    """clique, k1, k2, n: noisy two-way marginals of four attributes made non-negative and consistent."""
    from functools import reduce

    from .operators import consistency

    domain = LINE_DOMAIN.project(["flag", "status", "line", "tax"])
    cliques = all_cliques(domain, 2)
    lines = coded_lines(spark, sf_dir)
    noisy = [marginal.zero_filled(lines, domain, c).select(F.lit(",".join(c)).alias("clique"), F.col(c[0]).alias("k1"), F.col(c[1]).alias("k2"), (F.col("n") + noise.keyed_gaussian("agree", 20.0, F.lit(",".join(c)), *c)).alias("n")) for c in cliques]
    return consistency.consistent(reduce(DataFrame.unionByName, noisy), domain, cliques)


@register()
def privtree_bins(spark, sf_dir):
    """bin, lo, n: private binary splitting of prices, then the rows counted in its bins."""
    from .operators import partition

    df, lo, hi, bins = table(spark, sf_dir, "lineitem"), 0.0, 131072.0, 1024
    edges = partition.privtree(partition.fine_histogram(df, "l_extendedprice", lo, hi, bins), 1.0, rng=_generator())
    points = [lo + (hi - lo) / bins * e for e in edges]
    code = encode.interval_code(F.col("l_extendedprice"), [*points, hi])
    return df.groupBy(code.alias("bin")).agg(F.min("l_extendedprice").alias("least"), F.count("*").alias("n"))


@register()
def dawa_bins(spark, sf_dir):
    """bin, n: the private least-cost partition of prices."""
    from .operators import partition

    df, lo, hi, bins = table(spark, sf_dir, "lineitem"), 0.0, 131072.0, 1024
    edges = partition.dawa(partition.fine_histogram(df, "l_extendedprice", lo, hi, bins), 1.0, rng=_generator())
    code = encode.interval_code(F.col("l_extendedprice"), [*(lo + (hi - lo) / bins * e for e in edges), hi])
    return df.groupBy(code.alias("bin")).agg(F.count("*").alias("n"))


@register()
def ml_utility(spark, sf_dir):
    """trained_on, model, accuracy, macro_f1 on the odd orders, after training on even orders or on synthetic rows."""
    from .operators import learn

    real, test = halves(coded_lines(spark, sf_dir))
    return learn.utility({"real": real, "synthetic": mst_synth(spark, sf_dir)}, test, ["line", "quantity", "discount", "tax", "status"], "flag", models=("tree",))


@register()
def gum_synth(spark, sf_dir):
    """Synthetic line items by updating independent rows towards noisy two-way marginals."""
    from .functions.budget import Ledger
    from .operators import records, synthesize

    domain = LINE_DOMAIN.project(["flag", "status", "line", "tax"])
    pairs = all_cliques(domain, 2)
    answers = synthesize.datavectors(coded_lines(spark, sf_dir), domain, [*((a,) for a in domain), *pairs])
    ledger = Ledger(RHO)
    measure = synthesize.Measurer(answers, ledger, _generator())
    found = {c: measure(c, RHO / len(answers)).counts for c in answers}
    return records.synthesized(spark, domain, {a: found[a,] for a in domain}, max(1, round(float(found["line",].sum()))), {c: found[c] for c in pairs})


@register("""with o as (select distinct p_retailprice v from part), s as (select o_orderkey, 900 + o_totalprice / 500 as x from orders),
lo as (select o_orderkey, x, max(v) v from s left join o on v <= x group by 1, 2), hi as (select o_orderkey, min(v) v from s left join o on v >= x group by 1)
select o_orderkey, case when lo.v is null or hi.v - x < x - lo.v then hi.v else lo.v end as snapped from lo join hi using (o_orderkey)""")
def nearest_snap(spark, sf_dir):
    from .operators.snap import snapped

    orders = table(spark, sf_dir, "orders").select("o_orderkey", (900 + F.col("o_totalprice") / 500).alias("p_retailprice"))
    return snapped(orders, table(spark, sf_dir, "part").select("p_retailprice"), "p_retailprice").withColumnRenamed("p_retailprice", "snapped")


def _share_sql(seed: str, key: str) -> str:
    return f"((('0x' || substr(md5('{seed}|' || {key}), 1, 8))::bigint + 1) / 4294967297.0::double)"


@register(f"select o_orderkey, case when {_share_sql('split', 'o_orderkey')} <= 0.8::double then 'train' when {_share_sql('split', 'o_orderkey')} <= 0.9::double then 'val' else 'test' end as split from orders")
def hash_split(spark, sf_dir):
    from .operators import subsets

    return subsets.split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", {"train": 0.8, "val": 0.1, "test": 0.1})


@register(f"""with u as (select o_orderkey, o_orderpriority, {_share_sql('strata', 'o_orderkey')} u, count(*) over (partition by o_orderpriority) n from orders)
select o_orderkey, o_orderpriority from u qualify row_number() over (partition by o_orderpriority order by u, o_orderkey) <= greatest(1, round(n * 0.15::double))""")
def stratified_sample(spark, sf_dir):
    from .operators import subsets

    return subsets.stratified(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 0.15)


@register(f"select o_orderkey, o_orderstatus from orders where {_share_sql('bias', 'o_orderkey')} <= case o_orderstatus when 'F' then 0.2::double when 'O' then 0.7 else 1 end")
def biased_subset(spark, sf_dir):
    from .operators import subsets

    return subsets.biased(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", {"F": 0.2, "O": 0.7})


@register(f"select p_partkey, case when {_share_sql('wrong', 'p_partkey')} <= 0.3::double then (p_size - 1 + 1 + floor({_share_sql('wrongp_size', 'p_partkey')} * 49)::bigint) % 50 else p_size - 1 end::bigint as p_size from part")
def corrupted_subset(spark, sf_dir):
    from .operators import subsets

    return subsets.corrupted(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 1).cast("long").alias("p_size")), "p_partkey", {"p_size": 50}, 0.3)


@register(f"""select p_partkey, coalesce(case when p_size > 10 then p_size - 1 end, (select count(*) from (select unnest(range(1, 10)) i) where i / 10.0::double <= {_share_sql('fill', 'p_partkey')}))::bigint as p_size from part""")
def imputed_codes(spark, sf_dir):
    from .operators import subsets

    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size") - 1).cast("long").alias("p_size"))
    return subsets.imputed(part, "p_partkey", "p_size", [1.0] * 10)


@register(" union all ".join(f"select label, {i}::bigint as feature, '{k}' as kind, round(avg(0.5::double * {k}(list_sum(list_transform(list_zip(embedding::double[], {w}::double[]), lambda p: p[1] * p[2])))), 6) as mean from embeddings group by label" for i, w in enumerate(FREQUENCIES) for k in ("cos", "sin")))
def label_mean_embedding(spark, sf_dir):
    return features.fourier_means(table(spark, sf_dir, "embeddings"), "embedding", FREQUENCIES, "label").withColumn("mean", F.round("mean", 6))


@register("select round(sum(tvd * w) / sum(w), 9) as tvd from (select kind, avg(tvd) as tvd, count(*) as w from (" + _tvd_sql(list(KINDS)) + ") join (values " + ", ".join(f"('{','.join(c)}', '{k}')" for c, k in KINDS.items()) + ") k(clique, kind) using (clique) group by kind)")
def tvd_weighted_summary(spark, sf_dir):
    """Mean of the kinds' distances by their numbers of pairs."""
    kinds = evaluate.marginal_tvd(*halves(coded_lines(spark, sf_dir)), list(KINDS))
    kind = F.coalesce(*[F.when(F.col("clique") == ",".join(c), k) for c, k in KINDS.items()])
    by = kinds.groupBy(kind.alias("kind")).agg(F.avg("tvd").alias("tvd"), F.count("*").alias("w"))
    return by.agg(F.round(F.sum(F.col("tvd") * F.col("w")) / F.sum("w"), 9).alias("tvd"))


def _ratio_sql(parts: tuple, x: str) -> str:
    def polynomial(coefficients: tuple) -> str:
        out = f"{coefficients[0]!r}::double"
        for c in coefficients[1:]:
            out = f"({out} * {x} + {c!r}::double)"
        return out

    return f"{polynomial(parts[0])} / {polynomial(parts[1])}"


@register(f"""with c as (select o_totalprice v, count(*) n from orders group by 1), r as (select v, (sum(n) over (order by v) - (n - 1) / 2.0::double) / sum(n) over () - 0.5::double / sum(n) over () as p from c),
t as (select v, p - 0.5 as q, 0.180625::double - (p - 0.5) * (p - 0.5) as c, sqrt(-ln(least(p, 1 - p))) - 1.6::double as f, sqrt(-ln(least(p, 1 - p))) - 5 as e from r),
z as (select v, case when abs(q) <= 0.425 then q * {_ratio_sql(encode._CENTRE, "c")} else sign(q) * case when e <= 0 then {_ratio_sql(encode._FLANK, "f")} else {_ratio_sql(encode._TAIL, "e")} end end as z from t)
select o_orderkey, round(z, 8) as score from orders join z on v = o_totalprice""")
def normal_scores(spark, sf_dir):
    return encode.quantile_normal(table(spark, sf_dir, "orders"), "o_totalprice", "score").select("o_orderkey", F.round("score", 8).alias("score"))


@register("""with c as (select props, count(*) n from events group by 1)
select case when n < round_even((select count(*) from events) * 0.0105::double, 0) then '__rare__' else events.props end as props, count(*)::bigint as n from events join c using (props) group by 1""")
def rare_by_frequency(spark, sf_dir):
    return encode.rare_by_rows(table(spark, sf_dir, "events"), "props", 0.0105).groupBy("props").agg(F.count("*").alias("n"))


# --- whole tables to codes and back --------------------------------------------------------


_ORDER_CODES = """(with p as (select o_orderpriority v, (row_number() over (order by o_orderpriority) - 1)::bigint c from orders group by 1),
b as (select min(o_totalprice) lo, max(o_totalprice) hi from orders)
select o_orderkey, p.c as priority, least(99, floor((o_totalprice - lo) / ((hi - lo) / 100)))::bigint as price, o_orderpriority as name, lo, hi from orders join p on o_orderpriority = p.v, b)"""


def _order_codes(spark, sf_dir):
    from .operators.discretize import Discretizer

    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    fitted = Discretizer().fit(df, ["priority", "price"])
    return fitted, fitted.transform(df)


@register(f"select o_orderkey, priority, price from {_ORDER_CODES}")
def discretized(spark, sf_dir):
    return _order_codes(spark, sf_dir)[1]


@register(f"select o_orderkey, name as priority, round(lo + (hi - lo) / 100 * (price + 0.5::double), 6) as price from {_ORDER_CODES}")
def discretizer_inverse(spark, sf_dir):
    fitted, codes = _order_codes(spark, sf_dir)
    return fitted.inverse(codes).withColumn("price", F.round("price", 6))


def _gauss_sql(seed: str, sigma: float, key: str) -> str:
    return f"({sigma}::double * sqrt(-2 * ln({_share_sql(seed + 'a', key)})) * cos(2 * pi() * {_share_sql(seed + 'b', key)}))"


@register(f"""with c as (select props v, count(*) + {_gauss_sql('rare', 2.0, 'props')} y from events group by 1), t as (select sum(greatest(0, y)) total from c)
select case when y < 6 or y <= total * 0.01::double then 'R' else props end as props, count(*)::bigint as n from events join c on props = v, t group by 1""")
def rare_merge_noisy(spark, sf_dir):
    from .operators.discretize import rare_merged_noisy

    return rare_merged_noisy(table(spark, sf_dir, "events"), "props", 2.0, 0.01, "rare").groupBy("props").agg(F.count("*").alias("n"))


@register("""with f as (select min(ts) first from events)
select floor((epoch_us(ts) // 1000000 - epoch_us(first) // 1000000) / 3600.0)::bigint as hour, ((value >= 10)::int + (value >= 50)::int + (value >= 100)::int)::bigint as step, count(*)::bigint as n from events, f where value is not null group by all""")
def time_and_step_bins(spark, sf_dir):
    from .operators import discretize

    df = discretize.time_bin(table(spark, sf_dir, "events").where("value is not null"), "ts", 3600, "hour")
    return df.groupBy("hour", discretize.stepped(F.col("value"), [10, 50, 100]).alias("step")).agg(F.count("*").alias("n"))


HOT = {"size": 50, "brand": 25}
_PART_CODES = "(select p_partkey, (p_size - 1)::bigint as size, (dense_rank() over (order by p_brand) - 1)::bigint as brand from part)"


def _part_codes(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 1).cast("long").alias("size"), F.col("p_brand").alias("brand"))
    return encode.ordinal_encode(df, ["brand"])


@register(f"select slot, count(*)::bigint as n from (select size as slot from {_PART_CODES} union all select 50 + brand from {_PART_CODES}) group by 1")
def onehot_slots(spark, sf_dir):
    from .operators.discretize import hot_slots

    return hot_slots(_part_codes(spark, sf_dir), "p_partkey", HOT).groupBy("slot").agg(F.count("*").alias("n"))


@register(f"select p_partkey, size, brand from {_PART_CODES}")
def onehot_round_trip(spark, sf_dir):
    from .operators.discretize import from_slots, hot_slots

    return from_slots(hot_slots(_part_codes(spark, sf_dir), "p_partkey", HOT), "p_partkey", HOT)


_TOTALS = " union all ".join(f"select {s * s * k}::double as variance, sum(n + {_gauss_sql('tot', float(s), a)}) as total from (select {a}, count(*) n from {LINE_SQL} group by 1)" for a, k, s in (("flag", 3, 2), ("line", 7, 3), ("tax", 9, 4)))


@register(f"select round(sum(total / variance) / sum(1 / variance), 6) as total, round(1 / sum(1 / variance), 9) as variance from ({_TOTALS})")
def combined_total(spark, sf_dir):
    """The number of line items from noisy marginals of three attributes, weighted by inverse variance."""
    from functools import reduce

    from .operators.discretize import running_total

    counts = marginal.marginals(coded_lines(spark, sf_dir), [("flag",), ("line",), ("tax",)])
    part = lambda a, s: counts.where(F.col("clique") == a).agg(F.sum(F.col("n") + noise.keyed_gaussian("tot", float(s), "k1")).alias("total"), F.lit(float(s * s * LINE_DOMAIN[a])).alias("variance"))
    totals = reduce(DataFrame.unionByName, [part("flag", 2), part("line", 3), part("tax", 4)])
    return running_total(totals).select(F.round("total", 6).alias("total"), F.round("variance", 9).alias("variance"))


RANGES_2D = [(i, i % 3 * 5, 20 + i % 7 * 4, i % 4, 4 + i % 6) for i in range(40)]


@register("select q.query::bigint as query, count(l.quantity)::bigint as n from (values " + ", ".join(map(str, RANGES_2D)) + f") q(query, al, ah, bl, bh) left join {LINE_SQL} l on quantity between al and ah and discount between bl and bh group by 1")
def range_2d_queries(spark, sf_dir):
    cells = marginal.zero_filled(coded_lines(spark, sf_dir), LINE_DOMAIN, ("quantity", "discount"))
    queries = spark.createDataFrame(RANGES_2D, "query long, a_lo long, a_hi long, b_lo long, b_hi long")
    return predicates.range_2d(cells, "quantity", "discount", queries)


@register(f"""select flag::bigint as flag, line::bigint as line, round(count(*) + (-1.5::double * sign({_share_sql('lap', "flag || '|' || line")} - 0.5::double) * ln(1 - 2 * abs({_share_sql('lap', "flag || '|' || line")} - 0.5::double))), 6) as y from {LINE_SQL} group by flag, line""")
def laplace_marginal(spark, sf_dir):
    """Counts with Laplace noise."""
    counts = marginal.marginals(coded_lines(spark, sf_dir), [("flag", "line")])
    return counts.select(F.col("k1").alias("flag"), F.col("k2").alias("line"), F.round(F.col("n") + noise.keyed_laplace("lap", 1.5, "k1", "k2"), 6).alias("y"))


DISJUNCTS = [[{"flag": i % 3, "quantity": (i, i + 15)}, {"tax": (i % 5, i % 5 + 2), "status": i % 2}] for i in range(20)]


@register(" union all ".join(f"select {i}::bigint as query, count(*)::bigint as n from {LINE_SQL} where (flag = {a['flag']} and quantity between {a['quantity'][0]} and {a['quantity'][1]}) or (tax between {b['tax'][0]} and {b['tax'][1]} and status = {b['status']})" for i, (a, b) in enumerate(DISJUNCTS)))
def disjunct_counts(spark, sf_dir):
    return predicates.disjunctions(coded_lines(spark, sf_dir), DISJUNCTS)


@register(f"""with q as (select i as query, floor({_share_sql('lo', 'i')} * 50)::bigint a, floor({_share_sql('hi', 'i')} * 50)::bigint b from (select unnest(range(200)) i))
select query::bigint as query, count(l.quantity)::bigint as n from q left join {LINE_SQL} l on l.quantity between least(a, b) and greatest(a, b) group by 1""")
def random_ranges(spark, sf_dir):
    """Counts of 200 ranges with keyed random ends."""
    end = lambda s: F.floor(noise.keyed_uniform(s, "id") * 50).cast("long")
    asked = spark.range(200).select(F.col("id").alias("query"), F.least(end("lo"), end("hi")).alias("lo"), F.greatest(end("lo"), end("hi")).alias("hi"))
    return predicates.ranges(predicates.histogram(coded_lines(spark, sf_dir), "quantity", 50), asked)


@register(f"select quantity, count(*)::bigint as n from {LINE_SQL} group by 1 having count(*) >= (select count(*) / 50.0::double from lineitem) order by n desc, quantity limit 12")
def top_above_mean(spark, sf_dir):
    """At most 12 of the quantities that stand at least as often as the mean of the domain."""
    counts = coded_lines(spark, sf_dir).groupBy("quantity").agg(F.count("*").alias("n"))
    return selection.top_above(counts, "quantity", "n", 12, counts.agg(F.sum("n")).first()[0] / 50)


@register("select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P')")
def index_filter(spark, sf_dir):
    """Line items of a table of row ids, by a semi join."""
    ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(ids, "l_orderkey", "left_semi")


@register("select c_nationkey as nation from customer union select s_nationkey from supplier")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@register(" union all ".join(f"select '{c}' as attr, count({c})::bigint as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as deviation, min({c})::double as least, max({c})::double as greatest from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def described(spark, sf_dir):
    """Number, mean, deviation and range of columns, all from one pass."""
    columns = ("l_quantity", "l_extendedprice", "l_discount")
    fields = lambda c: F.struct(F.lit(c).alias("attr"), F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("deviation"), F.min(c).alias("least"), F.max(c).alias("greatest"))
    return table(spark, sf_dir, "lineitem").agg(F.array(*map(fields, columns)).alias("e")).select(F.explode("e").alias("e")).select("e.*")


# --- reweighted supports, query numbers, public rows ---------------------------------------

WEIGHED = ("flag", "status", "line", "tax")
WEIGHED_PAIRS = all_cliques(LINE_DOMAIN.project(WEIGHED), 2)


def _reweighted_sql(rounds: int) -> str:
    """The rounds of multiplicative weights as a chain of tables, from equal weights."""
    pairs = " union all ".join("select '{0},{1}' as clique, {0} as k1, {1} as k2, sum({{w}}) as share from {{t}} group by all".format(*c) for c in WEIGHED_PAIRS)
    match = " ".join(f"when '{a},{b}' then {a} = k1 and {b} = k2" for a, b in WEIGHED_PAIRS)
    cols = ", ".join(WEIGHED)
    steps = [f"measured as ({pairs.format(w='share', t=f'(select *, 1::double / count(*) over () as share from {LINE_SQL} where l_orderkey % 2 = 0)')})", f"t0 as (select {cols}, 0::double as log, 1::double / count(*) over () as w from (select distinct {cols} from {LINE_SQL}))"]
    for r in range(1, rounds + 1):
        steps += [
            f"q{r} as (select clique, k1, k2, sum(y) as error from (select clique, k1, k2, share as y from measured union all select clique, k1, k2, -share from ({pairs.format(w='w', t=f't{r - 1}')})) group by all order by abs(error) desc, clique, k1, k2 limit 1)",
            f"u{r} as (select {cols}, log + case when case clique {match} end then error else 0 end as log from t{r - 1}, q{r})", f"t{r} as (select *, exp(log) / sum(exp(log)) over () as w from u{r})",
        ]
    joins = " ".join(f"join t{r} using ({cols})" for r in range(1, rounds))
    mean = " + ".join(f"t{r}.w" for r in range(1, rounds + 1))
    return f"with {', '.join(steps)} select {cols}, round(t{rounds}.w, 9) as last, round(({mean}) / {rounds}, 9) as mean from t{rounds} {joins}"


@register(_reweighted_sql(3))
def reweighted_support(spark, sf_dir):
    """Weights of all occupied cells after three rounds towards the two-way shares of even orders."""
    from .operators import reweight

    lines = coded_lines(spark, sf_dir)
    measured = reweight.measured_shares(halves(lines)[0], WEIGHED_PAIRS)
    out, _ = reweight.multiplicative_weights(lines.select(*WEIGHED).distinct(), measured, WEIGHED_PAIRS, 3, settle=2)
    return out.select(*WEIGHED, F.round("last", 9).alias("last"), F.round("mean", 9).alias("mean"))


def _first(attr: str) -> int:
    return sum(LINE_DOMAIN[a] for a in LINE_DOMAIN.attrs[: LINE_DOMAIN.attrs.index(attr)])


def _query_index_sql() -> str:
    parts, at = [], 0
    for a, b in TWO:
        m, n = LINE_DOMAIN[a], LINE_DOMAIN[b]
        code = lambda x: f"(c // {n})" if x == a else f"(c % {n})" if x == b else "-1"  # noqa: B023, E731
        codes = ", ".join(f"{code(x)}::bigint as {x}" for x in LINE_DOMAIN)
        parts.append(f"select ({at} + c)::bigint as query, '{a},{b}' as clique, ({_first(a)} + c // {n})::bigint as p1, ({_first(b)} + c % {n})::bigint as p2, {codes}, coalesce(m.n, 0)::bigint as n from range({m * n}) r(c) left join (select {a} as x, {b} as y, count(*) as n from {LINE_SQL} group by all) m on m.x = c // {n} and m.y = c % {n}")
        at += m * n
    return " union all ".join(parts)


@register(_query_index_sql())
def query_index(spark, sf_dir):
    """Every query of the two-way workload: its number, one-hot positions, attribute codes and answer."""
    from .operators import query_index as index

    out = index.answered(marginal.marginals(coded_lines(spark, sf_dir), TWO), LINE_DOMAIN, TWO)
    return out.select("query", "clique", F.col("positions")[0].alias("p1"), F.col("positions")[1].alias("p2"), *LINE_DOMAIN, "n")


@register()
def public_filter(spark, sf_dir):
    """Odd vectors, as public rows, filtered towards the noisy mean embedding of even vectors and their labels."""
    from .operators import public_filter as public

    e = table(spark, sf_dir, "embeddings")
    embedding = public.embedded(F.col("embedding"), FREQUENCIES, F.col("label"), range(10))
    target = public.mean_embedding(e.where("vec_id % 2 = 0"), embedding, 0.001)
    return public.filtered(e.where("vec_id % 2 = 1"), "vec_id", embedding, target)


@register(f"""with l as (select line as sep, tax, l_orderkey from {LINE_SQL}),
m as (select sep, tax, count(*) as n from l where l_orderkey % 2 = 0 group by all),
s as (select c.sep, t.tax, coalesce(n, 0) as n from (select distinct sep from l) c cross join range({LINE_DOMAIN["tax"]}) t(tax) left join m using (sep, tax)),
v as (select sep, tax, sum(n) over (partition by sep order by tax) / sum(n) over (partition by sep)::double as v from s),
k as (select sep, count(*) as rows from l group by 1),
e as (select sep, tax, case when tax = {LINE_DOMAIN["tax"] - 1} then rows else floor(v * rows + 0.5) end as edge from v join k using (sep))
select sep::bigint as line, tax::bigint as tax, (edge - coalesce(lag(edge) over (partition by sep order by tax), 0))::bigint as n from e qualify n > 0""")
def appended_attribute(spark, sf_dir):
    """Counts of lines and an appended tax: every line's rows follow the shares of even orders to within one."""
    from .operators import append, synthesize

    lines = coded_lines(spark, sf_dir)
    clique = ("line", "tax")
    target = synthesize.datavectors(halves(lines)[0], LINE_DOMAIN, [clique])[clique]
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), (F.col("l_linenumber") - 1).cast("long").alias("line"))
    out = append.appended(rows, "id", LINE_DOMAIN, append.Leaf("tax", ("line",), clique), target)
    return out.groupBy("line", "tax").agg(F.count("*").alias("n"))


def _uniform_sql(seed: str, *keys: str) -> str:
    return f"((('0x' || substr(md5('{seed}|' || " + " || '|' || ".join(f"{k}::varchar" for k in keys) + "), 1, 8))::bigint::double + 1) / 4294967297.0::double)"


@register(f"""with rows as (select o_orderkey as key, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as status, cast(substr(o_orderpriority, 1, 1) as int) - 1 as priority from orders),
each as (select 'status' as "column", status as category, key from rows union all select 'priority', priority, key from rows),
placed as (select *, row_number() over (partition by "column", category order by md5(key::varchar), key) - 1 as k from each),
counts as (select "column", category, count(*) as n from each group by all),
shares as (select *, sum(ln(1 + n)) over (partition by "column" order by category) / sum(ln(1 + n)) over (partition by "column") as upto from counts),
asked as (select c_custkey as request, case least(1, floor({_uniform_sql("conditioncolumn", "c_custkey")} * 2)) when 0 then 'status' else 'priority' end as "column", {_uniform_sql("conditioncategory", "c_custkey")} as u, {_uniform_sql("conditionrow", "c_custkey")} as r from customer),
drawn as (select request, a."column", count(*) filter (s.upto <= a.u) as category, any_value(r) as r from asked a join shares s on a."column" = s."column" group by 1, 2)
select request, d."column", d.category::bigint as category, p.k::bigint as k, p.key from drawn d join counts c on c."column" = d."column" and c.category = d.category
join placed p on p."column" = d."column" and p.category = d.category and p.k = least(floor(d.r * c.n), c.n - 1)""")
def conditional_rows(spark, sf_dir):
    """For each customer a keyed draw: a column, one of its categories by log frequency, one of the orders of that category."""
    from .operators import postings

    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("priority"))
    return postings.conditional_sample(table(spark, sf_dir, "customer"), "c_custkey", orders, "o_orderkey", {"status": 3, "priority": 5})


# --- selection by coins, integer noise -----------------------------------------------------


@register(f"""with s as (select s_nationkey, s_suppkey, s_acctbal, max(s_acctbal) over (partition by s_nationkey) as top from supplier),
c as (select *, {_uniform_sql("flipcoin", "s_nationkey", "s_suppkey")} as coin, {_uniform_sql("fliporder", "s_nationkey", "s_suppkey")} as place from s)
select s_nationkey, arg_min(s_suppkey, struct_pack(a := place, b := s_suppkey)) as s_suppkey from c where s_acctbal = top or coin <= exp(0.002 * (s_acctbal - top) / 2) group by 1""")
def permute_flip(spark, sf_dir):
    """One supplier of each nation by permute-and-flip over the balances."""
    from .operators import mechanisms

    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return mechanisms.permute_and_flip(s, "s_suppkey", "s_acctbal", 0.002, "flip", by=["s_nationkey"]).select("s_nationkey", "s_suppkey")


@register("""with b as (select 1 + s_nationkey % 5 as d, max(s_acctbal) as q from supplier group by 1)
select s_suppkey, round(min((s_acctbal - q - 3 * (1 + s_nationkey % 5 - d)) / (1 + s_nationkey % 5 + d)), 6) as scaled from supplier, b group by s_suppkey""")
def comparable_scores(spark, sf_dir):
    """Scores of suppliers whose sensitivities differ, as margins of sensitivity 1."""
    from .operators import mechanisms

    s = table(spark, sf_dir, "supplier").withColumn("d", 1 + F.col("s_nationkey") % 5)
    return mechanisms.comparable(s, "s_acctbal", "d", 3.0).select("s_suppkey", F.round("scaled", 6).alias("scaled"))


@register()
def integer_noise(spark, sf_dir):
    """All cells of (line, tax) with their counts and exact discrete Gaussian noise of variance 12.25."""
    from fractions import Fraction

    from .functions import exact

    cells = marginal.zero_filled(coded_lines(spark, sf_dir), LINE_DOMAIN, ("line", "tax"))
    return cells.withColumn("noisy", F.col("n") + exact.exact_gaussian("integers", Fraction(49, 4), "line", "tax"))


# --- other bins, draws inside bins, significant values -------------------------------------

_PRICE_LOG = "least(99, floor((log2(o_totalprice - (lo - 0.01::double)) - log2(0.01::double)) / ((log2(hi - (lo - 0.01::double)) - log2(0.01::double)) / 100)))"


@register(f"""with b as (select min(o_totalprice) lo, max(o_totalprice) hi from orders)
select o_orderkey, {_PRICE_LOG}::bigint as code,
round(pow(2::double, log2(0.01::double) + (log2(hi - (lo - 0.01::double)) - log2(0.01::double)) / 100 * ({_PRICE_LOG} + {_uniform_sql("inverseo_totalprice", "o_orderkey")})) + (lo - 0.01::double), 4) as draw from orders, b""")
def discretizer_log_draws(spark, sf_dir):
    """Prices coded by logarithmic bins, and drawn back inside their bins."""
    from .operators.discretize import Discretizer

    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    fitted = Discretizer(method="exp").fit(df, ["o_totalprice"])
    codes = fitted.transform(df)
    drawn = fitted.inverse(codes.withColumn("code", F.col("o_totalprice")), "o_orderkey")
    return drawn.select("o_orderkey", "code", F.round("o_totalprice", 4).alias("draw"))


@register("""with b as (select min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem), c as (select l_orderkey, l_linenumber, least(99, floor((l_extendedprice - lo) / ((hi - lo) / 100))) as code, lo, hi,
l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as id from lineitem, b)
select id, code::bigint as code, round(lo + (hi - lo) / 100 * (code + """ + _uniform_sql("inversel_extendedprice", "id") + """), 6) as draw from c""")
def discretizer_draws(spark, sf_dir):
    """Prices coded by equal bins, and drawn back inside their bins."""
    from .operators.discretize import Discretizer

    df = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), "l_extendedprice")
    fitted = Discretizer().fit(df, ["l_extendedprice"])
    drawn = fitted.inverse(fitted.transform(df).withColumn("code", F.col("l_extendedprice")), "id")
    return drawn.select("id", "code", F.round("l_extendedprice", 6).alias("draw"))


@register()
def discretizer_private(spark, sf_dir):
    """method, code, n: prices coded by private splitting and by private partition."""
    from .operators.discretize import Discretizer

    df = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    out = [Discretizer(method=m, rng=_generator()).fit(df, ["l_extendedprice"]).transform(df).groupBy(F.col("l_extendedprice").alias("code")).agg(F.count("*").alias("n")).withColumn("method", F.lit(m)) for m in ("privtree", "dawa")]
    return out[0].unionByName(out[1])


@register(f"""with c as (select props as value, count(*) as n from events where props is not null group by 1), k as (select value, n + {_gauss_sql('signal', 35.0, 'value')} >= 105 as kept, n from c),
m as (select value, n, kept, case when kept then count(*) filter (kept) over (order by value) - 1 else count(*) filter (kept) over () end as code from k)
select code::bigint as code, sum(n)::bigint as n, count(*)::bigint as values from m group by 1""")
def significant_codes(spark, sf_dir):
    """Codes of event properties whose noisy count is three deviations or more, and one for all others; rows and values of each."""
    from .operators.discretize import SignificantValues

    df = table(spark, sf_dir, "events").select("event_id", "props")
    fitted = SignificantValues.fit(df, "props", 35.0, "signal")
    coded = fitted.encode(df, "props").groupBy(F.col("props").alias("code")).agg(F.count("*").alias("n"))
    return coded.where("code is not null").join(fitted.codes.groupBy("code").agg(F.count("*").alias("values")), "code")


@register()
def mode_values(spark, sf_dir):
    """Every event's value as a mode of the fitted mixture and deviations from it, and back."""
    from .operators import mixture

    df = table(spark, sf_dir, "events").select("event_id", "value")
    fitted = mixture.fit_modes(df, "value", rounds=25)
    out = fitted.transform(df, "value", "event_id", mode="mode", value="normal")
    return fitted.inverse(out, "back", "mode", "normal")


@register()
def adaptive_synth(spark, sf_dir):
    """As many synthetic line items as the noisy total, by adaptive selection of two-way marginals with doubling budgets."""
    from .operators import synthesize

    model, _, _ = synthesize.adaptive(coded_lines(spark, sf_dir), LINE_DOMAIN, RHO, rng=_generator())
    return synthesize.sample(spark, model, round(model.total))
