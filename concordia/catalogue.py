"""The registered queries of the reconciliation operators, and the DuckDB SQL that states the same results.

Both sides derive their inputs from the test tables: a table rendered to text, a changed copy of it, and cells with
injected variants (null tokens, blanks, separators, padded numbers).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.functions import (
    canonical, composite_key, full_row, fuzzy_equal, fuzzy_index_key, fuzzy_key, matching_columns, row_hash, shortened,
)
from concordia.operators.align import HASH, ONCE, RID, common_columns, prepared
from concordia.operators.bag import matched
from concordia.operators.duplicates import duplicate_keys, duplicate_totals
from concordia.operators.keys import cell_class, detect_key, name_excluded, profile, uniqueness
from concordia.operators.pairing import pair_rows
from concordia.options import Options
from concordia.plans.reconcile import Reconciliation, reconcile
from concordia.sources.lines import errant_quotes, expand_row_text, file_delimiters, line_delimiter_column
from concordia.staging import shared_folder, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- derived inputs, in Spark and in SQL -----------------------------------------------------------------

ORDER_COLUMNS = ["O_ORDERKEY", "O_CUSTKEY", "O_ORDERSTATUS", "O_TOTALPRICE", "O_ORDERDATE", "O_ORDERPRIORITY"]


def money(c: str):
    return F.col(c).cast("decimal(18,2)").cast("string")


def orders_source(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("O_ORDERKEY"), F.col("o_custkey").cast("string").alias("O_CUSTKEY"), F.col("o_orderstatus").alias("O_ORDERSTATUS"),
        money("o_totalprice").alias("O_TOTALPRICE"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("O_ORDERDATE"), F.col("o_orderpriority").alias("O_ORDERPRIORITY"),
    )


def orders_target(spark, sf_dir) -> DataFrame:
    """Missing where key % 101 = 0, dearer where key % 97 = 0, other case, T in dates, and new keys from key % 211 = 0."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    base = table(spark, sf_dir, "orders").where(k % 101 != 0).select(
        k.cast("string").alias("O_ORDERKEY"), F.col("o_custkey").cast("string").alias("O_CUSTKEY"), F.lower("o_orderstatus").alias("O_ORDERSTATUS"),
        F.when(k % 97 == 0, price + 1).otherwise(price).cast("decimal(18,2)").cast("string").alias("O_TOTALPRICE"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("O_ORDERDATE"), F.col("o_orderpriority").alias("O_ORDERPRIORITY"),
    )
    new = table(spark, sf_dir, "orders").where(k % 211 == 0).select(
        (k + 1_000_000_000).cast("string").alias("O_ORDERKEY"), F.col("o_custkey").cast("string").alias("O_CUSTKEY"), F.col("o_orderstatus").alias("O_ORDERSTATUS"),
        price.cast("string").alias("O_TOTALPRICE"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("O_ORDERDATE"), F.col("o_orderpriority").alias("O_ORDERPRIORITY"),
    )
    return base.unionByName(new)


ORDERS_SQL = """
s as (select o_orderkey as k, cast(o_orderkey as varchar) as a, cast(o_custkey as varchar) as b, o_orderstatus as c,
  cast(cast(o_totalprice as decimal(18,2)) as varchar) as d, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as e, o_orderpriority as f from orders),
t as (select o_orderkey as k, cast(o_orderkey as varchar) as a, cast(o_custkey as varchar) as b, lower(o_orderstatus) as c,
  cast(cast(case when o_orderkey % 97 = 0 then cast(o_totalprice as decimal(18,2)) + 1 else cast(o_totalprice as decimal(18,2)) end as decimal(18,2)) as varchar) as d,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000' as e, o_orderpriority as f from orders where o_orderkey % 101 <> 0
  union all
  select o_orderkey + 1000000000, cast(o_orderkey + 1000000000 as varchar), cast(o_custkey as varchar), o_orderstatus,
  cast(cast(o_totalprice as decimal(18,2)) as varchar), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderpriority from orders where o_orderkey % 211 = 0)
"""
#: Canonical text of a two-decimal number.
MONEY_SQL = "regexp_replace(regexp_replace({0}, '0+$', ''), '\\.$', '')"
ROW_SQL = "{0}.a || '|' || {0}.b || '|' || {0}.c || '|' || {0}.d || '|' || {0}.e || '|' || {0}.f"
MISSING_T = f"""select 'MISSING_IN_TARGET' as discrepancy_type, 'O_ORDERKEY=' || s.a as composite_key, 'ALL' as column_name, {ROW_SQL.format('s')} as source_value,
  'ROW_NOT_FOUND' as target_value, {ROW_SQL.format('s')} as full_source_row, 'ROW_NOT_FOUND' as full_target_row from s where not exists (select 1 from t where t.k = s.k)"""
MISSING_S = f"""select 'MISSING_IN_SOURCE' as discrepancy_type, 'O_ORDERKEY=' || t.a as composite_key, 'ALL' as column_name, 'ROW_NOT_FOUND' as source_value,
  {ROW_SQL.format('t')} as target_value, 'ROW_NOT_FOUND' as full_source_row, {ROW_SQL.format('t')} as full_target_row from t where not exists (select 1 from s where t.k = s.k)"""
MISMATCH = f"""select 'VALUE_MISMATCH' as discrepancy_type, 'O_ORDERKEY=' || s.a as composite_key, 'O_TOTALPRICE' as column_name, {MONEY_SQL.format('s.d')} as source_value,
  {MONEY_SQL.format('t.d')} as target_value, {ROW_SQL.format('s')} as full_source_row, {ROW_SQL.format('t')} as full_target_row from s join t using (k) where s.d <> t.d"""
DIFF_SQL = f"with {ORDERS_SQL}, diff as ({MISSING_T} union all {MISSING_S} union all {MISMATCH})"


def orders_diff(spark, sf_dir) -> Reconciliation:
    return reconcile(orders_source(spark, sf_dir), orders_target(spark, sf_dir), Options(keys=("O_ORDERKEY",)))


# --- canonical cells --------------------------------------------------------------------------------------


def variant(case: list[str], key: str = "o_orderkey"):
    """A CASE over key % n that both engines read."""
    return f"case {key} % {len(case)} " + " ".join(f"when {i} then {x}" for i, x in enumerate(case)) + " end"


def canonical_query(name: str, cells: list[str], rule: str, **settings) -> None:
    """Canonical form of injected cells of orders; *rule* is the same in SQL over column v."""
    pick = variant(cells)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(pick).alias("v"))
        return df.select("o_orderkey", "v", canonical(F.col("v"), **settings).alias("canonical"))

    QUERIES[name] = run
    ORACLES[name] = f"select o_orderkey, v, {rule} as canonical from (select o_orderkey, {pick} as v from orders)"


KEY = "cast(o_orderkey as string)"
canonical_query(
    "canonical_null", ["''", "' null '", "'None'", "'NaN'", "'nat'", "'N/A'", "'na'", "'#N/A'", "'x'", "o_orderpriority", "cast(null as string)"],
    "case when lower(trim(v)) in ('', 'null', 'none', 'nan', 'nat', 'n/a', 'na', '#n/a') then null else v end",
)
canonical_query(
    "canonical_bool", ["'TRUE'", "' yes '", "'Y'", "'False'", "'no'", "'n'", "'t'", "'on'"],
    "case when lower(trim(v)) in ('true', 'yes', 'y') then 'true' when lower(trim(v)) in ('false', 'no', 'n') then 'false' else v end",
)
canonical_query(
    "canonical_timestamp",
    ["concat('2024-01-05T10:20:30.', cast(o_orderkey as string))", "'2024-01-05 10:20:30'", "'2024-13-45T99:99:99'", "' 2024-01-05T10:20:30 '", "'05/01/2024'", "'2024-01-05T10:20'"],
    r"case when regexp_matches(trim(v), '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?$') then replace(substr(trim(v), 1, 19), 'T', ' ') else v end",
)
canonical_query(
    "canonical_timestamp_precision", ["concat('2024-01-05T10:20:30.', cast(o_orderkey as string))", "'2024-01-05 10:20:30'", "'2024-01-05T10:20:30.123456789'"],
    r"case when v like '%.%' then replace(substr(v, 1, 20), 'T', ' ') || rpad(substr(v, 21, 3), 3, '0') else replace(v, 'T', ' ') end", timestamp_precision=3,
)
canonical_query(
    "canonical_date", ["'2024-02-30'", "' 2024-02-03 '", "'1899-01-01'", "'2024-13-01'", "'01/02/2024'", "'2100-12-31'"],
    "case when trim(v) in ('2024-02-30', '2024-02-03', '2100-12-31') then trim(v) else v end",
)
canonical_query(
    "canonical_integer",
    [KEY, f"concat('000', {KEY})", f"concat('+', {KEY})", f"concat('-', {KEY})", f"concat('1,234,', {KEY})", f"concat(' ', {KEY})", f"concat({KEY}, '99999999999999999999999999999999999999')", "'-0'", "'0000'"],
    r"""case when v <> trim(v) then v else (with n as (select replace(replace(v, ',', ''), '+', '') as x)
      select case when ltrim(x, '-0') = '' then '0' when x like '-%' then '-' || ltrim(x, '-0') else ltrim(x, '0') end from n) end""",
)
canonical_query(
    "canonical_decimal",
    [f"concat({KEY}, '.50')", f"concat({KEY}, '.000')", f"concat('-', {KEY}, '.1250')", f"concat({KEY}, '.')", "'.5'", f"concat('1,0', {KEY}, '.25')", "'1.5 '", "'1.2.3'", "'-0.0'", "'1e5'", "'2.50E-3'", "'1d'"],
    r"""case when v in ('1.5 ', '1.2.3', '1d') then v when v = '.5' then '0.5' when v = '-0.0' then '0' when v = '1e5' then '100000' when v = '2.50E-3' then '0.0025'
      else (with n as (select replace(v, ',', '') as x), m as (select regexp_replace(regexp_replace(x, '(\.\d*?)0*$', '\1'), '\.$', '') as y from n)
      select case when y in ('-0', '') then '0' else y end from m) end""",
)
canonical_query(
    "canonical_skip", ["''", "' NaN '", "'null'", "'TRUE'", "'007'", "o_orderpriority"], "case when lower(trim(v)) in ('', 'nan', 'nat') then null else v end", normalise=False,
)

# --- fuzzy keys -------------------------------------------------------------------------------------------

NAMES = ["c_name", "replace(c_name, '#', ' / ')", "concat(' ', lower(c_name), '  ')", "replace(c_name, '#', '_(x)-')", "'<null>'", "'N/A'", "concat(c_name, '|', c_mktsegment)"]
FUZZY_SQL = r"""case when lower(trim({0})) in ('', 'null', 'none', 'nan', 'nat', 'n/a', 'na', '<null>') then 'NULL' else
  upper(trim(regexp_replace(regexp_replace(regexp_replace(trim({0}), '[/|\\]', ' ', 'g'), '\s+', ' ', 'g'), '[_\-.()\[\]{{}}]', '', 'g'))) end"""


@query(f"select c_custkey, v, {FUZZY_SQL.format('v')} as fuzzy from (select c_custkey, {variant(NAMES, 'c_custkey')} as v from customer)")
def fuzzy_key_form(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.expr(variant(NAMES, "c_custkey")).alias("v"))
    return df.select("c_custkey", "v", fuzzy_key(F.col("v")).alias("fuzzy"))


@query(f"""select c_custkey, 'NAME=' || {FUZZY_SQL.format('v')} || '||NATION=' || cast(c_nationkey as varchar) || '||SEGMENT=' || upper(c_mktsegment) as fuzzy
  from (select *, {variant(NAMES, 'c_custkey')} as v from customer)""")
def fuzzy_index(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("*", F.expr(variant(NAMES, "c_custkey")).alias("v"))
    cells = [F.col("v"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), F.col("c_custkey").cast("string")]
    return df.select("c_custkey", fuzzy_index_key(["NAME", "NATION", "SEGMENT", "KEY"], cells).alias("fuzzy"))


@query("""select o_orderkey, case when a = b then 'EXACT' when abs(x - y) <= 100 or abs(x - y) / greatest(abs(x), abs(y), 1) <= 0.01 then 'FUZZY_NUMERIC' else 'DIFFERENT' end as verdict
  from (select o_orderkey, cast(o_orderkey as varchar) as a, cast(o_orderkey + (o_orderkey % 7) * 40 as varchar) as b, cast(o_orderkey as double) as x,
  cast(o_orderkey + (o_orderkey % 7) * 40 as double) as y from orders)""")
def fuzzy_equal_numeric(spark, sf_dir):
    k = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", fuzzy_equal(k.cast("string"), (k + (k % 7) * 40).cast("string")).alias("verdict"))


PADDED = ["' 5 '", "'77'", "'1_000'", "'1001'", "'１２'", "'15'", "'1__0'", "'1e2'", "' 1,000 '", "'inf'", "'abc'", "'-5.'", "'٣٤.５'", "'_1'"]


@query(f"""with c as (select o_orderkey, {variant(PADDED)} as a, {variant(PADDED, '(o_orderkey // 14)')} as b from orders),
  n(v, x) as (values (' 5 ', 5.0::double), ('77', 77), ('1_000', 1000), ('1001', 1001), ('１２', 12), ('15', 15), ('1e2', 100), (' 1,000 ', 1000), ('-5.', -5), ('٣٤.５', 34.5), ('inf', 'inf'::double))
  select o_orderkey, a, b, case when a = b then 'EXACT' when x.x is not null and y.x is not null then
    case when abs(x.x - y.x) <= 100 or (isfinite(x.x) and isfinite(y.x) and abs(x.x - y.x) / greatest(abs(x.x), abs(y.x), 1) <= 0.01) then 'FUZZY_NUMERIC' else 'DIFFERENT' end
    when regexp_replace(trim(a), '[_.-]', '', 'g') <> '' and abs(length(regexp_replace(trim(a), '[_.-]', '', 'g')) - length(regexp_replace(trim(b), '[_.-]', '', 'g'))) <= 2
      and (contains(upper(regexp_replace(trim(a), '[_.-]', '', 'g')), upper(regexp_replace(trim(b), '[_.-]', '', 'g'))) or contains(upper(regexp_replace(trim(b), '[_.-]', '', 'g')), upper(regexp_replace(trim(a), '[_.-]', '', 'g'))))
    then 'FUZZY_STRING' else 'DIFFERENT' end as verdict
  from c left join n x on c.a = x.v left join n y on c.b = y.v""")
def fuzzy_equal_padded(spark, sf_dir):
    """Cells that are numbers but for blanks, commas, underscores or digits of other scripts."""
    second = variant(PADDED, "cast(floor(o_orderkey / 14) as long)")
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(variant(PADDED)).alias("a"), F.expr(second).alias("b"))
    return df.select("o_orderkey", "a", "b", fuzzy_equal(F.col("a"), F.col("b")).alias("verdict"))


OTHER = ["c_name", "replace(c_name, '#', '/')", "lower(c_name)", "concat(c_name, 'ab')", "concat(c_name, 'abcd')", "'other text'", "cast(null as string)"]


@query(f"""select c_custkey, case when b is null then 'DIFFERENT' when a = b then 'EXACT' when fa = fb then 'FUZZY_STRING'
  when abs(length(fa) - length(fb)) <= greatest(2, least(length(fa), length(fb)) // 10) and (contains(fa, fb) or contains(fb, fa)) then 'FUZZY_STRING' else 'DIFFERENT' end as verdict
  from (select *, {FUZZY_SQL.format('a')} as fa, {FUZZY_SQL.format('b')} as fb from (select c_custkey, c_name as a, {variant(OTHER, 'c_custkey')} as b from customer))""")
def fuzzy_equal_string(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("a"), F.expr(variant(OTHER, "c_custkey")).alias("b"))
    return df.select("c_custkey", fuzzy_equal(F.col("a"), F.col("b")).alias("verdict"))


# --- rows ---------------------------------------------------------------------------------------------------


@query("""select o_orderkey, 'KEY=' || o_orderkey || '||STATUS=' || coalesce(case when o_orderkey % 3 = 0 then null else o_orderstatus end, 'NULL') as composite_key from orders""")
def composite_keys(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", composite_key(["KEY", "STATUS"], [F.col("o_orderkey").cast("string"), status]).alias("composite_key"))


@query("""select o_orderkey, o_orderkey || '|' || coalesce(case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then '' else o_orderstatus end, 'NULL') || '|' || o_orderpriority as full_row
  from orders""")
def full_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(k % 3 == 1, F.lit("")).when(k % 3 == 2, F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", full_row([k.cast("string"), status, F.col("o_orderpriority")]).alias("full_row"))


@query("""select o_orderkey, substr(sha256(concat_ws(chr(0), lower(cast(o_orderkey as varchar)), coalesce(lower(case when o_orderkey % 5 = 0 then null else o_orderstatus end), chr(1) || 'NULL'),
  lower(o_orderpriority))), 1, 32) as row_hash from orders""")
def row_hashes(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", row_hash([F.col("o_orderkey").cast("string"), status, F.col("o_orderpriority")]).alias("row_hash"))


@query("select page_id, case when length(url) > 30 then substr(url, 1, 30) || '...' else url end as shown from pages")
def display_truncation(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", shortened(F.col("url"), 30).alias("shown"))


@query("""select a.l_orderkey, a.l_linenumber, b.l_linenumber as other, a.l_returnflag, b.l_returnflag as other_flag,
  cast((a.l_returnflag = b.l_returnflag) as int) + cast((a.l_linestatus = lower(b.l_linestatus) or a.l_linestatus = b.l_linestatus or lower(a.l_linestatus) = lower(b.l_linestatus)) as int)
  + cast((case when a.l_linenumber = 1 then null else 'x' end is not distinct from case when b.l_linenumber = 2 then null else 'x' end) as int) as score
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey""")
def match_scores(spark, sf_dir):
    """Score of row pairs: equal cells whatever the case, nulls equal to nulls."""
    return _scores(table(spark, sf_dir, "lineitem"))


def _scores(lines: DataFrame) -> DataFrame:
    cols = ["l_orderkey", "l_partkey", "l_suppkey"]
    df = lines.select(*cols, "l_linenumber", "l_returnflag", "l_linestatus")
    b = df.select(*cols, F.col("l_linenumber").alias("other"), F.col("l_returnflag").alias("other_flag"), F.lower("l_linestatus").alias("other_status"))
    score = matching_columns([
        (F.col("l_returnflag"), F.col("other_flag")), (F.col("l_linestatus"), F.col("other_status")),
        (F.when(F.col("l_linenumber") != 1, F.lit("x")), F.when(F.col("other") != 2, F.lit("x"))),
    ])
    return df.join(b, cols).select("l_orderkey", "l_linenumber", "other", "l_returnflag", "other_flag", score.alias("score"))


@query("""select * from (values (1, 'B', 'both'), (2, 'A', 'both'), (3, 'S1', 'source'), (4, 'S2', 'source'), (5, 'T1', 'target')) v(place, column_name, side)""")
def align_columns(spark, sf_dir):
    s = table(spark, sf_dir, "nation").select(F.lit("1").alias("B"), F.lit("1").alias("S2"), F.lit("1").alias("A"), F.lit("1").alias("S1"))
    t = table(spark, sf_dir, "nation").select(F.lit("1").alias("A"), F.lit("1").alias("T1"), F.lit("1").alias("B"))
    both, left, right = common_columns(s, t)
    rows = [(c, "both") for c in both] + [(c, "source") for c in left] + [(c, "target") for c in right]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "place int, column_name string, side string")


# --- bag matching and duplicates: lineitem projected to few columns, target without some rows ------------------

FLAGS = ["L_RETURNFLAG", "L_LINESTATUS", "L_LINENUMBER", "L_QUANTITY"]


def flags(spark, sf_dir, keep: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(keep).select(
        F.col("l_returnflag").alias("L_RETURNFLAG"), F.col("l_linestatus").alias("L_LINESTATUS"), F.col("l_linenumber").cast("string").alias("L_LINENUMBER"), money("l_quantity").alias("L_QUANTITY")
    )


def flags_diff(spark, sf_dir) -> Reconciliation:
    s, t = flags(spark, sf_dir, "l_suppkey % 10 <> 1"), flags(spark, sf_dir, "l_suppkey % 10 <> 2")
    return reconcile(s, t, Options(keys=("L_RETURNFLAG", "L_LINESTATUS", "L_LINENUMBER", "L_QUANTITY"), order_by=tuple(FLAGS)))


FLAG_HASH = f"substr(sha256(concat_ws(chr(0), case when l_returnflag = 'N' then 'false' else lower(l_returnflag) end, lower(l_linestatus), cast(l_linenumber as varchar), {MONEY_SQL.format('cast(cast(l_quantity as decimal(18,2)) as varchar)')})), 1, 32)"
FLAG_SQL = f"""with s as (select {FLAG_HASH} as hash, count(*) as ns from lineitem where l_suppkey % 10 <> 1 group by all),
t as (select {FLAG_HASH} as hash, count(*) as nt from lineitem where l_suppkey % 10 <> 2 group by all),
c as (select hash, coalesce(ns, 0) as ns, coalesce(nt, 0) as nt from s full join t using (hash))"""


@query(f"{FLAG_SQL} select hash, least(ns, nt) as n from c where least(ns, nt) > 0")
def bag_match(spark, sf_dir):
    r = flags_diff(spark, sf_dir)
    return matched(r.source, r.counts).groupBy(F.col(HASH).alias("hash")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{FLAG_SQL} select hash, ns - nt as n from c where ns > nt")
def bag_residual_source(spark, sf_dir):
    return flags_diff(spark, sf_dir).source_residual.groupBy(F.col(HASH).alias("hash")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{FLAG_SQL} select hash, nt - ns as n from c where nt > ns")
def bag_residual_target(spark, sf_dir):
    return flags_diff(spark, sf_dir).target_residual.groupBy(F.col(HASH).alias("hash")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{FLAG_SQL} select 'DUPLICATE_COUNT_MISMATCH' as discrepancy_type, 'HASH:' || substr(hash, 1, 16) as composite_key, 'ALL' as column_name, ns || ' occurrences' as source_value,
  nt || ' occurrences' as target_value, 'N/A' as full_source_row, 'N/A' as full_target_row from c where ns > 0 and nt > 0 and ns <> nt""")
def duplicate_count_mismatch(spark, sf_dir):
    return flags_diff(spark, sf_dir).count_mismatches


def _duplicates_sql(side: str, keep: str) -> str:
    q = MONEY_SQL.format("cast(cast(l_quantity as decimal(18,2)) as varchar)")
    flag = "case when l_returnflag = 'N' then 'false' else l_returnflag end"  # N is a boolean token
    row = f"{flag} || '|' || l_linestatus || '|' || l_linenumber || '|' || {q}"
    own, none = ("row", "'N/A'") if side == "SOURCE" else ("'N/A'", "row")
    return f"""select 'DUPLICATE_IN_{side}' as discrepancy_type, k as composite_key, 'IDENTICAL_ROWS_COUNT=' || n as column_name, {own} as source_value, {none} as target_value,
      {own} as full_source_row, {none} as full_target_row from (select {row} as row, 'L_RETURNFLAG=' || {flag} || '||L_LINESTATUS=' || l_linestatus || '||L_LINENUMBER=' || l_linenumber
      || '||L_QUANTITY=' || {q} as k, count(*) as n from lineitem where {keep} group by all having count(*) > 1)"""


@query(_duplicates_sql("SOURCE", "l_suppkey % 10 <> 1"))
def duplicates_source(spark, sf_dir):
    return flags_diff(spark, sf_dir).duplicates("SOURCE")


@query(_duplicates_sql("TARGET", "l_suppkey % 10 <> 2"))
def duplicates_target(spark, sf_dir):
    return flags_diff(spark, sf_dir).duplicates("TARGET")


@query(f"{FLAG_SQL} select count(*) as unique_rows, cast(coalesce(sum(ns), 0) as bigint) as total_rows from s where ns > 1")
def duplicates_total(spark, sf_dir):
    return duplicate_totals(flags_diff(spark, sf_dir).source)


@query("select 'L_ORDERKEY=' || l_orderkey || '||L_LINENUMBER=' || l_linenumber as composite_key, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_key_report(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("L_ORDERKEY"), F.col("l_linenumber").cast("string").alias("L_LINENUMBER"))
    return duplicate_keys(prepared(df, df.columns, Options()), df.columns, ONCE)


# --- the whole difference ------------------------------------------------------------------------------------


@query(f"{DIFF_SQL} select * from diff where discrepancy_type = 'MISSING_IN_TARGET'")
def missing_in_target(spark, sf_dir):
    return orders_diff(spark, sf_dir).missing("TARGET")


@query(f"{DIFF_SQL} select * from diff where discrepancy_type = 'MISSING_IN_SOURCE'")
def missing_in_source(spark, sf_dir):
    return orders_diff(spark, sf_dir).missing("SOURCE")


@query(f"{DIFF_SQL} select * from diff where discrepancy_type = 'VALUE_MISMATCH'")
def value_mismatch(spark, sf_dir):
    return orders_diff(spark, sf_dir).mismatches


@query(f"{DIFF_SQL} select * from diff")
def diff_full(spark, sf_dir):
    return orders_diff(spark, sf_dir).discrepancies


@query(f"{DIFF_SQL} select discrepancy_type, count(*) as n from diff group by all")
def diff_by_type(spark, sf_dir):
    return orders_diff(spark, sf_dir).by_type()


@query(f"{DIFF_SQL} select column_name, count(*) as n from diff where discrepancy_type = 'VALUE_MISMATCH' group by all order by n desc, column_name limit 10")
def top_mismatch_columns(spark, sf_dir):
    return orders_diff(spark, sf_dir).top_columns()


@query(f"""{DIFF_SQL} select discrepancy_type, composite_key, column_name, case when length(source_value) > 50 then substr(source_value, 1, 50) || '...' else source_value end as source_value,
  case when length(target_value) > 50 then substr(target_value, 1, 50) || '...' else target_value end as target_value from diff order by 1, 2, 3 limit 5""")
def report_sample(spark, sf_dir):
    return orders_diff(spark, sf_dir).sample()


@query(f"""{DIFF_SQL} select (select count(*) from s) as source_rows, (select count(*) from t) as target_rows,
  (select count(*) from s join t using (k) where s.d = t.d) as exact_matches, (select count(*) from s join t using (k) where s.d <> t.d) as key_matches,
  (select count(*) from diff where discrepancy_type = 'MISSING_IN_TARGET') as only_in_source, (select count(*) from diff where discrepancy_type = 'MISSING_IN_SOURCE') as only_in_target""")
def diff_summary(spark, sf_dir):
    return orders_diff(spark, sf_dir).summary()


@query(f"""with {ORDERS_SQL}, p as (select s.k, s.a as sa, t.a as ta, s.b as sb, t.b as tb, lower(s.c) = lower(t.c) as c, s.d <> t.d as d from s join t using (k))
  select 'O_ORDERKEY=' || sa as composite_key, 'O_TOTALPRICE' as column_name from p where d""")
def diff_detected_key(spark, sf_dir):
    """The same difference with the key left to detection: where it is, not what it says."""
    r = reconcile(orders_source(spark, sf_dir), orders_target(spark, sf_dir))
    return r.mismatches.select("composite_key", "column_name")


def customers(spark, sf_dir, changed: bool) -> DataFrame:
    name, k = F.col("c_name"), F.col("c_custkey")
    if changed:
        name = F.when(k % 5 == 0, F.replace(name, F.lit("#"), F.lit(" / "))).when(k % 5 == 1, F.lower(name)).otherwise(name)
    name = F.when(k % 5 == 0, F.replace(name, F.lit("#"), F.lit(" "))).otherwise(name) if not changed else name
    segment = F.when(k % 7 == 0, F.lit("CHANGED")).otherwise(F.col("c_mktsegment")) if changed else F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(name.alias("C_LABEL"), segment.alias("C_MKTSEGMENT"), F.col("c_nationkey").cast("string").alias("C_NATIONKEY"))


CUSTOMER_SQL = """with p as (select c_custkey as k, case when c_custkey % 5 = 0 then replace(c_name, '#', ' ') else c_name end as a,
  case when c_custkey % 5 = 0 then replace(c_name, '#', ' / ') when c_custkey % 5 = 1 then lower(c_name) else c_name end as b, c_mktsegment as m,
  case when c_custkey % 7 = 0 then 'CHANGED' else c_mktsegment end as n, cast(c_nationkey as varchar) as o from customer),
q as (select *, lower(a) <> lower(b) or m <> n as open, case when a = b then 'C_LABEL=' || a else 'C_LABEL=' || a || ' ~> C_LABEL=' || b end as composite_key,
  a || '|' || m || '|' || o as full_source_row, b || '|' || n || '|' || o as full_target_row from p)"""


@query(f"""{CUSTOMER_SQL} select 'KEY_VALUE_MISMATCH' as discrepancy_type, composite_key, 'C_LABEL' as column_name, a as source_value, b as target_value, full_source_row, full_target_row
  from q where open and a <> b union all
  select 'VALUE_MISMATCH', composite_key, 'C_MKTSEGMENT', m, n, full_source_row, full_target_row from q where open and m <> n""")
def key_value_mismatch(spark, sf_dir):
    """Keys that differ by slashes, blanks or case are matched fuzzily, and the difference reported."""
    r = reconcile(customers(spark, sf_dir, False), customers(spark, sf_dir, True), Options(keys=("C_LABEL",)))
    return r.mismatches


@query("""with x as (select l_orderkey as k, l_linenumber as n, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice) as r from lineitem),
s as (select k, n, count(*) as c from x group by all), t as (select k, n, count(*) as c from x where r > 1 or k % 40 = 0 group by all)
select k as l_orderkey, n as l_linenumber, least(s.c, t.c) as pairs from s join t using (k, n)""")
def greedy_pairs(spark, sf_dir):
    """Pairs per key where keys repeat on both sides and no cell but the key agrees: every key pairs as often as it can."""
    return _key_pairs(table(spark, sf_dir, "lineitem"))


def _key_pairs(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    text = lambda d, side: d.select(F.col("l_orderkey").cast("string").alias("K"), F.col("l_linenumber").cast("string").alias("N"), F.concat(F.lit(side), F.col("l_partkey").cast("string")).alias("P"))
    s, t = text(df, "s"), text(df.withColumn("r", r).where("r > 1 or l_orderkey % 40 = 0"), "t")
    options = Options(keys=("K", "N"), order_by=("K", "N", "P"))
    found = reconcile(s, t, options)
    key = lambda d, rid: d.select(F.col(RID).alias(rid), F.col(f"{ONCE}.K").cast("long").alias("l_orderkey"), F.col(f"{ONCE}.N").cast("int").alias("l_linenumber"))
    pairs = found.pairs.join(key(found.source_residual, "s_rid"), "s_rid")
    return pairs.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("pairs"))


@query("""with p as (select o_orderkey as k from orders)
  select cast(k as varchar) as k, 'B' as chosen from p""")
def best_candidate(spark, sf_dir):
    """Two targets per key: the one with more equal cells wins, whichever comes first."""
    return _chosen(table(spark, sf_dir, "orders"))


def _chosen(df: DataFrame) -> DataFrame:
    k = F.col("o_orderkey").cast("string").alias("K")
    s = df.select(k, F.lit("x").alias("A"), F.lit("y").alias("B"), F.lit("z").alias("C"))
    worse = df.select(k, F.lit("1").alias("A"), F.lit("y").alias("B"), F.lit("2").alias("C"))
    better = df.select(k, F.lit("X").alias("A"), F.lit("y").alias("B"), F.lit("3").alias("C"))
    r = reconcile(s, worse.unionByName(better), Options(keys=("K",), order_by=("K", "C")))
    t = r.target_residual.select(F.col(RID).alias("t_rid"), F.col(f"{ONCE}.K").alias("k"), F.col(f"{ONCE}.A").alias("a"))
    return r.pairs.join(t, "t_rid").select("k", F.when(F.col("a") == "X", "B").otherwise("A").alias("chosen"))


# --- key detection ---------------------------------------------------------------------------------------------


def _part_text(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "part")
    return stage(df.select(F.col("p_partkey").alias("rid"), F.col("p_partkey").cast("string").alias("P_PARTKEY"), F.col("p_brand").alias("P_BRAND"), F.col("p_type").alias("P_TYPE"), F.col("p_size").cast("string").alias("P_SIZE"),
                           F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("P_CODE")), "part-text")


@query("""with p as (select p_partkey as rid, cast(p_partkey as varchar) as P_PARTKEY, p_brand as P_BRAND, p_type as P_TYPE, cast(p_size as varchar) as P_SIZE, case when p_size % 3 = 0 then p_brand end as P_CODE from part),
u as (select rid, 'P_PARTKEY' as column_name, P_PARTKEY as value from p union all select rid, 'P_BRAND', P_BRAND from p union all select rid, 'P_TYPE', P_TYPE from p
  union all select rid, 'P_SIZE', P_SIZE from p union all select rid, 'P_CODE', P_CODE from p)
select column_name, count(*) as n_rows, count(value) as non_null, count(distinct value) as n_unique from u group by all""")
def column_profile(spark, sf_dir):
    df = _part_text(spark, sf_dir)
    return profile(df, [c for c in df.columns if c != "rid"], "rid").select("column_name", "n_rows", "non_null", "n_unique")


RANKED_SQL = """with p as (select row_number() over (order by p_partkey) as r, cast(p_partkey as varchar) as P_PARTKEY, p_brand as P_BRAND, p_type as P_TYPE, cast(p_size as varchar) as P_SIZE,
  case when p_size % 3 = 0 then p_brand end as P_CODE from part),
u as (select 0 as col, r, 'P_PARTKEY' as column_name, P_PARTKEY as v from p union all select 1, r, 'P_BRAND', P_BRAND from p union all select 2, r, 'P_TYPE', P_TYPE from p
  union all select 3, r, 'P_SIZE', P_SIZE from p union all select 4, r, 'P_CODE', P_CODE from p),
k as (select col, case when v in ('0', '1') then 'b' when regexp_matches(v, '^[0-9]+$') then 'i' when regexp_matches(v, '^[A-Za-z0-9_-]+$') and regexp_matches(v, '[A-Za-z]') and regexp_matches(v, '[0-9]') then 'n'
  when regexp_matches(v, '^[A-Za-z_-]+$') and length(v) <= 20 then 'a' else 't' end as k, row_number() over (partition by col order by r) as i from u where v is not null),
s as (select col, count(*) as m, count(*) filter (k = 'b') as b, count(*) filter (k = 'i') as i, count(*) filter (k = 'n') as n, count(*) filter (k = 'a') as a, count(*) filter (k = 't') as t from k where i <= 50 group by col),
d as (select col, column_name, count(*) as n_rows, count(v) as filled, count(distinct v) as n_unique from u group by all),
c as (select d.*, case when m is null then 'empty' when n / m > 0.5 then 'alphanumeric' when i / m > 0.5 then 'integer' when a / m > 0.5 then 'alphabetic_code' when b / m > 0.3 then 'boolean' when t / m > 0.5 then 'text' else 'mixed' end as col_type from d left join s using (col)),
e as (select *, case col_type when 'empty' then -100 when 'alphanumeric' then 150 when 'integer' then 140 when 'alphabetic_code' then 80 when 'boolean' then -100 when 'text' then -30 else 0 end + n_unique / n_rows * 50 + filled / n_rows * 30
  - case when n_unique < 10 then 80 else 0 end - case when filled / n_rows < 0.5 then 50 else 0 end as p from c)
select column_name, col_type, round(p, 6) as priority, cast(row_number() over (order by p desc, col) as int) as place from e"""


@query(RANKED_SQL)
def column_ranking(spark, sf_dir):
    """Class, priority and rank of every column, from its first fifty cells and its counts."""
    from pyspark.sql import Window

    df = _part_text(spark, sf_dir)
    found = profile(df, [c for c in df.columns if c != "rid"], "rid")
    place = F.row_number().over(Window.orderBy(F.desc("priority"), "col"))  # a row per column
    return found.select("column_name", "col_type", F.round("priority", 6).alias("priority"), place.alias("place"))


CLASS_CELLS = ["'yes'", "'0'", "'2024-01-02 03:04:05'", "'2024-01-02'", "'load.csv'", "'x_20240102_y.z'", KEY, "'-12'", "'3.50'", f"concat('AB-', {KEY})", "'ABC_x'", "'two words'", "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'#1'"]


@query(f"""select o_orderkey, v, case when v in ('yes', '0') or (o_orderkey % {len(CLASS_CELLS)} = 6 and v = '1') then 'boolean' when v in ('2024-01-02 03:04:05', '2024-01-02') then 'timestamp'
  when v in ('load.csv', 'x_20240102_y.z') then 'filename' when regexp_matches(v, '^-?\\d+$') then 'integer' when v = '3.50' then 'decimal' when v like 'AB-%' then 'alphanumeric'
  when v = 'ABC_x' then 'alphabetic' else 'text' end as class from (select o_orderkey, {variant(CLASS_CELLS)} as v from orders)""")
def cell_classes(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(variant(CLASS_CELLS)).alias("v"))
    return df.select("o_orderkey", "v", cell_class(F.col("v")).alias("class"))


@query("select 'part' as table_name, 1 as place, 'P_PARTKEY' as column_name union all select 'conversations', 1, 'CONV_ID' union all select 'conversations', 2, 'TURN'")
def detected_key(spark, sf_dir):
    """A single unique column, and a pair of columns that only together identify rows."""
    part = _part_text(spark, sf_dir)
    conv = stage(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("rid"), F.col("conv_id").cast("string").alias("CONV_ID"), F.col("turn").cast("string").alias("TURN")), "conv-text")
    rows = [("part", i, c) for i, c in enumerate(detect_key(part, [c for c in part.columns if c != "rid"], "rid"), 1)]
    rows += [("conversations", i, c) for i, c in enumerate(detect_key(conv, ["CONV_ID", "TURN"], "rid"), 1)]
    return spark.createDataFrame(rows, "table_name string, place int, column_name string")


@query("""select 'l_orderkey' as key, round(count(distinct l_orderkey) / count(*), 9) as uniqueness from lineitem
  union all select 'l_orderkey,l_linenumber', round(count(distinct (l_orderkey, l_linenumber)) / count(*), 9) from lineitem""")
def key_uniqueness(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    rows = [(",".join(k), round(uniqueness(df, k), 9)) for k in (["l_orderkey"], ["l_orderkey", "l_linenumber"])]
    return spark.createDataFrame(rows, "key string, uniqueness double")


NAMES_TRIED = ["P_PARTKEY", "P_NAME", "RETAIL_PRICE", "CORPORATE_ID", "PRODUCTS", "EVENT_ID", "TS", "ROW_KEY", "O_ORDERSTATUS", "REGION", "HASH_KEY", "ROW_HASH", "CREATED_BY", "UPDATER"]
NAMES_OUT = ["P_NAME", "RETAIL_PRICE", "CORPORATE_ID", "PRODUCTS", "TS", "ROW_KEY", "O_ORDERSTATUS", "ROW_HASH", "CREATED_BY", "UPDATER"]


@query(f"select column_name, column_name in ({', '.join(map(repr, NAMES_OUT))}) as excluded from (select unnest([{', '.join(map(repr, NAMES_TRIED))}]) as column_name)")
def name_exclusion(spark, sf_dir):
    return spark.createDataFrame([(n, name_excluded(n)) for n in NAMES_TRIED], "column_name string, excluded boolean")


# --- delimited text ----------------------------------------------------------------------------------------------

LINES = ["'a|b,c'", "concat('a;b;', cast(o_orderkey as string))", "'a~b'", "concat('x', chr(9), 'y')", "'no delimiter'", "''", "'a,b|c'", "'1;2~3;4~5~6'"]


@query(f"""select o_orderkey, v, case when v = '' or v = 'no delimiter' then ',' when v like 'a|%' or v like 'a,b|%' then '|' when v like 'a;b;%' then ';' when v = 'a~b' then '~' when v like 'x%' then chr(9) else '~' end as delimiter
  from (select o_orderkey, {variant(LINES)} as v from orders)""")
def delimiter_vote(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(variant(LINES)).alias("v"))
    return df.select("o_orderkey", "v", line_delimiter_column(F.col("v")).alias("delimiter"))


QUOTED = ["concat('\"', cast(o_orderkey as string), '|b\"')", "'\"a\",\"b\"'", "'\"\"a\",\"b\"\"'", "'\"'", "'a\"b'", "'\"a\"|\"b\"'", "'\"\"'"]


@query(f"""select o_orderkey, v, o_orderkey % {len(QUOTED)} in (0, 2, 6) as errant from (select o_orderkey, {variant(QUOTED)} as v from orders)""")
def errant_quote_test(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(variant(QUOTED)).alias("v"))
    return df.select("o_orderkey", "v", errant_quotes(F.col("v")).alias("errant"))


@query("""select cast(l_orderkey as varchar) as COL_1, l_returnflag as COL_2, case when l_linenumber % 3 = 0 then '' else l_linestatus end as COL_3 from lineitem""")
def row_text_expand(spark, sf_dir):
    """Lines of two to four cells; the first has three."""
    n = F.col("l_linenumber") % 3
    first = F.concat_ws("|", F.col("l_orderkey").cast("string"), "l_returnflag")
    line = F.when(n == 0, first).when(n == 1, F.concat_ws("|", first, "l_linestatus", F.lit("extra"))).otherwise(F.concat_ws("|", first, "l_linestatus"))
    order = F.when(n == 2, 0).otherwise(1)
    df = table(spark, sf_dir, "lineitem").select(order.alias("o"), line.alias("ROW_TEXT"))
    return expand_row_text(df, "o").drop("o")


@query("""select cast(c_custkey as varchar) as KEY, '"' || c_name || '"' as NAME, case when c_custkey % 4 = 0 then null else c_mktsegment end as COL_3 from customer""")
def mixed_delimiter_rows(spark, sf_dir):
    """A comma header over pipe data of unequal width, written and read back."""
    from concordia.sources.delimited import read_delimited

    path = f"{shared_folder(spark)}/concordia/mixed-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    line = F.concat_ws("|", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), F.col("c_name"), F.lit('"')), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")))
    body = table(spark, sf_dir, "customer").select(F.lit(1).alias("o"), line.alias("value"))
    head = spark.createDataFrame([(0, "Key, Name")], "o int, value string")
    head.unionByName(body).coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)
    return read_delimited(spark, path)


@query("""select cast(c_custkey as varchar) as C_CUSTKEY, case when c_custkey % 3 = 0 then c_name || '|"x"' else c_name end as C_NAME, case when c_custkey % 4 = 0 then '' else c_mktsegment end as C_MKTSEGMENT
  from customer""")
def delimited_rows(spark, sf_dir):
    """Quoted cells with delimiters and doubled quotes, blanks after delimiters and short lines, written and read back."""
    from concordia.sources.delimited import read_delimited

    path = f"{shared_folder(spark)}/concordia/quoted-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('"'), F.col("c_name"), F.lit('|""x"""'))).otherwise(F.col("c_name"))
    line = F.concat_ws("| ", F.col("c_custkey").cast("string"), name, F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")))
    body = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 12 == 1, 1).otherwise(2).alias("o"), line.alias("value"))
    head = spark.createDataFrame([(0, "c_custkey|c_name|c_mktsegment")], "o int, value string")
    head.unionByName(body).coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)
    return read_delimited(spark, path)


def _written(spark, sf_dir: str, label: str, lines: DataFrame) -> str:
    """The path of a one-file folder with *lines* (o, n, value) by o and n."""
    path = f"{shared_folder(spark)}/concordia/{label}-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    lines.coalesce(1).sortWithinPartitions("o", "n").select("value").write.mode("overwrite").text(path)
    return path


def _file(spark, sf_dir: str, label: str, header: str, name: str, key: str, line) -> DataFrame:
    """A file of a header and a line for each row of a table, read back."""
    from concordia.sources.delimited import read_delimited

    body = table(spark, sf_dir, name).select(F.lit(1).alias("o"), F.col(key).alias("n"), line.alias("value"))
    head = body.limit(1).select(F.lit(0).alias("o"), F.lit(0).cast(body.schema["n"].dataType).alias("n"), F.lit(header).alias("value"))
    return read_delimited(spark, _written(spark, sf_dir, label, head.unionByName(body)))


@query("select cast(c_custkey as varchar) as KEY, c_name as NAME from customer")
def cleaned_lines_rows(spark, sf_dir):
    """Lines wrapped in quotes as a whole, some of them and the header, are repaired."""
    line = F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name")
    return _file(spark, sf_dir, "wrapped", '"key|name"', "customer", "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('"'), line, F.lit('"'))).otherwise(line))


@query("select cast(c_custkey as varchar) as KEY, c_name as NAME from customer where c_custkey % 5 <> 0 or c_custkey = (select min(c_custkey) from customer)")
def overwide_lines(spark, sf_dir):
    """Lines with more cells than the header and the first line are left out."""
    extra = F.when((F.col("c_custkey") % 5 == 0) & (F.col("c_custkey") > 1), F.lit("extra"))
    return _file(spark, sf_dir, "overwide", "key|name", "customer", "c_custkey", F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", extra))


@query("""select cast(c_custkey as varchar) as KEY, case when c_custkey % 4 = 0 then c_name || chr(10) || chr(10) || 'two, "' || c_mktsegment || '"' else c_name end as NOTE from customer""")
def multiline_cells(spark, sf_dir):
    """Quoted cells that run over several lines."""
    name = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('"'), "c_name", F.lit('\n\ntwo, ""'), "c_mktsegment", F.lit('"""'))).otherwise(F.col("c_name"))
    return _file(spark, sf_dir, "multiline", "key,note", "customer", "c_custkey", F.concat_ws(",", F.col("c_custkey").cast("string"), name))


@query("select * from (values ('agree', '|', '|'), ('differ', ',', ';'), ('header only', '~', '~'), ('nothing', ',', ','), ('plain data', ';', ';')) t(file, header, data)")
def file_vote(spark, sf_dir):
    """Delimiters of header and data over the lines of small files."""
    files = {"agree": ["a|b", "1|2,3", "4|5"], "differ": ["a,b", "1;2", "3;4,5"], "header only": ["a~b"], "nothing": [], "plain data": ["a;b", "x", "y"]}
    return spark.createDataFrame([(k, *file_delimiters(v)) for k, v in files.items()], "file string, header string, data string")


@query("select * from (values ('/in/acct_20240101_120000.csv', 'acct'), ('acct_main.csv', 'acct_main'), ('a_1_b.csv', 'a_1_b'), ('x_1_2.tar.gz', 'x_1_2.tar')) t(path, table_name)")
def table_names(spark, sf_dir):
    from concordia.cli import table_name

    paths = ["/in/acct_20240101_120000.csv", "acct_main.csv", "a_1_b.csv", "x_1_2.tar.gz"]
    return spark.createDataFrame([(p, table_name(p)) for p in paths], "path string, table_name string")


def _report_path(spark, sf_dir: str, label: str) -> str:
    return f"{shared_folder(spark)}/concordia/{label}-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}/report"


@query(f"{DIFF_SQL} select * from diff")
def report_csv_rows(spark, sf_dir):
    """The report as one CSV file, read back."""
    from concordia.sinks.report import write_report

    r = orders_diff(spark, sf_dir)
    files = write_report(r.report, _report_path(spark, sf_dir, "csv"), r.columns, "csv")
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(files[0])


@query(f"""{DIFF_SQL}, n as (select count(*) as n from diff), f as (select 'report_part' || i || '.xlsx' as file, least(100, n - 100 * (i - 1)) as n_rows from n, range(1, 1000000) t(i) where 100 * (i - 1) < n)
  select case when n <= 100 then 'report.xlsx' else file end as file, cast(n_rows as bigint) as n_rows from f, n""")
def report_xlsx_parts(spark, sf_dir):
    """The report as worksheets of 100 rows at most: the rows that each file has."""
    from concordia.sinks.report import write_report

    r = orders_diff(spark, sf_dir)
    files = [f for f in write_report(r.report, _report_path(spark, sf_dir, "xlsx"), r.columns, "xlsx", rows=100) if f.endswith(".xlsx")]

    def rows(content):
        import io
        import zipfile

        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return z.read("xl/worksheets/sheet1.xml").count(b"<row ") - 1

    read = spark.read.format("binaryFile").load(files)
    return read.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.udf(rows, "long")("content").alias("n_rows"))
