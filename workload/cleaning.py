"""Profiling and value standardisation over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcemeld.functions.standard import Value, standardise
from sourcemeld.functions.steps import Chain, Step, error_reason, run_chains
from sourcemeld.functions.text import meaningful_list, meaningful_map, meaningful_text, meaningful_value
from sourcemeld.functions.policy import mapping_decision, step_decision, value_decision
from sourcemeld.operators.planning import column_facts
from sourcemeld.operators.profile import column_types, distinct_values, file_manifest, profile
from sourcemeld.contract import Entity, Field
from sourcemeld.operators.standardise import Mapped, last_success, standardise_source
from sourcemeld.session import Scratch
from sourcemeld.sources.readers import data_columns, read_csv, read_folder, read_parquet, stack_sources, to_json_rows
from workload.party import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def apply(c, operation: str, **params):
    """(value, error) of one step on a text column."""
    out = standardise(Value(c), operation, params)
    return out.col, F.lit(None).cast("string") if out.error is None else out.error


def _profile_sql(name: str, columns: list[tuple[str, str]], key: str) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns):
        v = f"{c}::varchar"
        parts.append(
            f"select '{name}.parquet' as source_file, '{c}' as column_name, {i} as ordinal, "
            f"case when count({c}) = 0 then 'unknown' "
            f"when count(*) filter (regexp_matches({v}, '^[+-]?(0|[1-9][0-9]*)$')) = count({c}) then 'integer' "
            f"when count(*) filter (regexp_matches({v}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')) = count({c}) then 'number' "
            f"else 'string' end as inferred_type, count(*) as n_rows, count(*) - count({c}) as n_nulls, "
            f"(select string_agg(x, '|' order by k) from (select {v} as x, {key} as k from {name} where {c} is not null order by {key} limit 5)) as samples "
            f"from {name}"
        )
    return " union all ".join(parts)


@query(
    "profile_columns",
    " union all ".join(
        [
            _profile_sql(
                "customer",
                [("c_custkey", ""), ("c_name", ""), ("c_nationkey", ""), ("c_acctbal", ""), ("c_mktsegment", "")],
                "c_custkey",
            ),
            _profile_sql(
                "part",
                [("p_partkey", ""), ("p_name", ""), ("p_brand", ""), ("p_type", ""), ("p_size", ""), ("p_retailprice", "")],
                "p_partkey",
            ),
        ]
    ),
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [profile(read_parquet(spark, f"{sf_dir}/{t}.parquet")) for t in ("customer", "part")]
    return stack_sources(frames).select(
        "source_file", F.col("column").alias("column_name"), "ordinal", "inferred_type", "n_rows", "n_nulls",
        F.array_join("samples", "|").alias("samples"),
    )


_TABLES = ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(
    "file_manifest",
    " union all ".join(f"select '{t}.parquet' as source_file, count(*) as row_count from {t}" for t in _TABLES),
)
def manifest_query(spark, sf_dir):
    return stack_sources([
        file_manifest(table(spark, sf_dir, t).select(F.col("_metadata.file_name").alias("source_file"))) for t in _TABLES
    ])


@query(
    "distinct_values",
    "select 'o_orderpriority' as column_name, o_orderpriority as value, count(*) as n_rows from orders group by all "
    "union all select 'o_orderstatus', o_orderstatus, count(*) from orders group by all",
)
def distinct_values_query(spark, sf_dir):
    orders = read_parquet(spark, f"{sf_dir}/orders.parquet")
    found = distinct_values(orders, ["o_orderpriority", "o_orderstatus"])
    return found.select(F.col("column").alias("column_name"), "value", "n_rows")


_BLANKED = "concat('\\t ', replace(c_name, '#', ' \\n '), '  ', c_mktsegment, ' ')"
_BLANKED_SQL = "(chr(9) || ' ' || replace(c_name, '#', ' ' || chr(10) || ' ') || '  ' || c_mktsegment || ' ')"


@query(
    "clean_text",
    f"""with m as (select c_custkey, {_BLANKED_SQL} as raw from customer),
    t as (select c_custkey, raw, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as trimmed from m)
    select c_custkey, trimmed, regexp_replace(trimmed, '\\s+', ' ', 'g') as collapsed, lower(raw) as lowered, upper(raw) as uppered,
    regexp_replace(trimmed, '\\s+', ' ', 'g') as named, lower(trimmed) as mailed from t""",
)
def clean_text(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_BLANKED).alias("raw"))
    raw = F.col("raw")
    ops = {
        "trimmed": "trim", "collapsed": "collapse_whitespace", "lowered": "lowercase", "uppered": "uppercase",
        "named": "normalize_name", "mailed": "normalize_email",
    }
    return df.select("c_custkey", *[apply(raw, op)[0].alias(name) for name, op in ops.items()])


@query(
    "clean_phone",
    """select 'c' || c_custkey as party, regexp_replace('+91 (' || c_custkey || ')-' || c_nationkey || ' ext', '\\D', '', 'g') as phone from customer
    union all select 's' || s_suppkey, regexp_replace('n/a ' || s_name, '\\D', '', 'g') from supplier""",
)
def clean_phone(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) as party", "concat('+91 (', c_custkey, ')-', c_nationkey, ' ext') as raw")
    s = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) as party", "concat('n/a ', s_name) as raw")
    return c.unionByName(s).select("party", apply(F.col("raw"), "normalize_phone")[0].alias("phone"))


_PRICE = "concat('₹', format_number(l_extendedprice, 2), ' incl.')"


@query(
    "clean_numbers",
    """with m as (select l_orderkey, l_linenumber, l_partkey,
      case when l_linenumber = 7 then 'none' else '₹' || format('{:,.2f}', l_extendedprice) || ' incl.' end as raw from lineitem),
    e as (select *, nullif(regexp_extract(replace(raw, ',', ''), '(-?\\d+(?:\\.\\d+)?)', 1), '') as t from m)
    select l_orderkey, l_linenumber, l_partkey, t::double as number, regexp_extract(t, '^(-?\\d+)', 1)::bigint as whole,
    round(t::decimal(28, 10), 1)::double as rounded, case when t is null then 'No number found in ''' || raw || '''' end as error from e""",
)
def clean_numbers(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.expr(f"case when l_linenumber = 7 then 'none' else {_PRICE} end").alias("raw")
    )
    raw = F.col("raw")
    number, error = apply(raw, "extract_number")
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", number.alias("number"), apply(raw, "normalize_integer")[0].alias("whole"),
        apply(raw, "normalize_decimal", precision=1)[0].alias("rounded"), error.alias("error"),
    )


@query(
    "json_numbers",
    "select event_id, nullif(regexp_extract(props, '(-?\\d+(?:\\.\\d+)?)', 1), '')::bigint as k from events",
)
def json_numbers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", apply(F.col("props"), "normalize_integer")[0].alias("k"))


_DATE_SHAPES = [
    ("yyyy-MM-dd", "%Y-%m-%d"), ("dd/MM/yyyy", "%d/%m/%Y"), ("MMM dd, yyyy", "%b %d, %Y"), ("d MMMM yyyy", "%-d %B %Y"),
    ("yyyy/MM/dd", "%Y/%m/%d"), ("dd-MM-yyyy", "%d-%m-%Y"), ("yyyyMMdd", "%Y%m%d"), ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
]


def _date_raw(column: str, key: str, engine: str) -> str:
    cases = []
    for i, (java, c) in enumerate(_DATE_SHAPES):
        shown = f"date_format({column}, '{java}')" if engine == "spark" else f"strftime({column}, '{c}')"
        cases.append(f"when {key} % 10 = {i} then {shown}")
    month_first = "concat(month({0}), '/', day({0}), '/', year({0}))".format(column)
    return f"case {' '.join(cases)} when {key} % 10 = 8 then {month_first} else 'unknown' end"


@query(
    "parse_dates",
    f"""with m as (select o_orderkey, {_date_raw('o_orderdate', 'o_orderkey', 'duckdb')} as raw from orders),
    p as (select *, coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%Y/%m/%d'), try_strptime(raw, '%Y-%m-%d %H:%M:%S'),
      try_strptime(raw, '%d/%m/%Y'), try_strptime(raw, '%d-%m-%Y'), try_strptime(raw, '%m/%d/%Y'), try_strptime(raw, '%b %d, %Y'),
      try_strptime(raw, '%d %B %Y'), try_strptime(raw, '%Y%m%d')) as d from m)
    select o_orderkey, raw, strftime(d, '%Y-%m-%d') as parsed, case when d is null then 'Unable to parse date ''' || raw || '''' end as error from p""",
)
def parse_dates(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_date_raw("o_orderdate", "o_orderkey", "spark")).alias("raw"))
    value, error = apply(F.col("raw"), "parse_date_auto")
    return df.select("o_orderkey", "raw", value.alias("parsed"), error.alias("error"))


@query(
    "parse_dates_fixed",
    """with m as (select o_orderkey, case when o_orderkey % 9 = 0 then strftime(o_orderdate, '%Y.%m.%d') else strftime(o_orderdate, '%d/%m/%Y') end as raw from orders),
    p as (select *, try_strptime(raw, '%d/%m/%Y') as d from m)
    select o_orderkey, strftime(d, '%b %d, %Y') as shown, case when d is null then 'date ''' || raw || ''' does not match format ''%d/%m/%Y''' end as error from p""",
)
def parse_dates_fixed(spark, sf_dir):
    raw = "case when o_orderkey % 9 = 0 then date_format(o_orderdate, 'yyyy.MM.dd') else date_format(o_orderdate, 'dd/MM/yyyy') end"
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(raw).alias("raw"))
    value, error = apply(F.col("raw"), "parse_date", format="%d/%m/%Y", outputFormat="%b %d, %Y")
    return df.select("o_orderkey", value.alias("shown"), error.alias("error"))


@query(
    "parse_datetimes",
    """with m as (select event_id, case event_id % 4 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') when 1 then strftime(ts, '%m/%d/%Y %I:%M %p')
      when 2 then strftime(ts, '%d %b %Y %H:%M') else strftime(ts, '%Y%m%d') end as raw from events)
    select event_id, strftime(coalesce(try_strptime(raw, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(raw, '%m/%d/%Y %I:%M %p'), try_strptime(raw, '%d %b %Y %H:%M'),
      try_strptime(raw, '%Y%m%d')), '%Y-%m-%dT%H:%M:%S') as parsed from m""",
)
def parse_datetimes(spark, sf_dir):
    raw = """case event_id % 4 when 0 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") when 1 then date_format(ts, 'MM/dd/yyyy hh:mm a')
      when 2 then date_format(ts, 'dd MMM yyyy HH:mm') else date_format(ts, 'yyyyMMdd') end"""
    df = table(spark, sf_dir, "events").select("event_id", F.expr(raw).alias("raw"))
    return df.select("event_id", apply(F.col("raw"), "parse_datetime_auto")[0].alias("parsed"))


_PRIORITY = {"1-URGENT": "P1", " 2-high ": "P2", "3-MEDIUM": "P3", "5-low": "P5"}


@query(
    "map_values",
    """select o_orderkey, case lower(trim(o_orderpriority)) when '1-urgent' then 'P1' when '2-high' then 'P2' when '3-medium' then 'P3' when '5-low' then 'P5' end as mapped,
    case when lower(trim(o_orderpriority)) not in ('1-urgent', '2-high', '3-medium', '5-low') then 'unmapped_value' end as error from orders""",
)
def map_values(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat(' ', o_orderpriority, '  ') as raw")
    value, error = apply(F.col("raw"), "map_value", mapping=_PRIORITY)
    return df.select("o_orderkey", value.alias("mapped"), error.alias("error"))


_FLAGS = "['Yes', 'no', '1', 'INACTIVE', ' working ', 'left', 'maybe', null]"


@query(
    "booleans",
    f"""with m as (select doc_id, {_FLAGS}[(doc_id % 8 + 1)::int] as raw, quality from labels)
    select doc_id, case when lower(trim(raw)) in ('yes', '1', 'working') then true when lower(trim(raw)) in ('no', 'inactive', 'left') then false end as flag,
    case when raw is null or trim(raw) = 'maybe' then 'Unable to normalize boolean value ''' || coalesce(raw, '') || '''' end as error,
    quality = 1 as good from m""",
)
def booleans(spark, sf_dir):
    flags = "element_at(array('Yes', 'no', '1', 'INACTIVE', ' working ', 'left', 'maybe', null), cast(doc_id % 8 + 1 as int))"
    df = table(spark, sf_dir, "labels").select("doc_id", F.expr(flags).alias("raw"), F.col("quality").cast("string").alias("quality"))
    value, error = apply(F.col("raw"), "normalize_boolean")
    good, _ = apply(F.col("quality"), "normalize_boolean")
    return df.select("doc_id", value.alias("flag"), error.alias("error"), good.alias("good"))


@query(
    "split_join",
    """with m as (select p_partkey, case when p_partkey % 10 = 0 then '' else p_brand || ' ; ' || p_name || ';;' || p_type || '; ' end as raw from part),
    s as (select p_partkey, case when raw = '' then [] else list_filter(list_transform(string_split(raw, ';'), lambda x: trim(x)), lambda x: x <> '') end as parts from m)
    select p_partkey, len(parts)::int as n_parts, coalesce(array_to_string(parts, ' | '), '') as joined from s""",
)
def split_join(spark, sf_dir):
    raw = "case when p_partkey % 10 = 0 then '' else concat(p_brand, ' ; ', p_name, ';;', p_type, '; ') end"
    df = table(spark, sf_dir, "part").select("p_partkey", F.expr(raw).alias("raw"))
    parts = standardise(Value(F.col("raw")), "split", {"separator": ";"})
    joined = standardise(Value(F.col("parts"), parts.kind), "join", {"separator": " | "})
    return df.select("p_partkey", parts.col.alias("parts")).select(
        "p_partkey", F.size("parts").alias("n_parts"), joined.col.alias("joined")
    )


@query(
    "chain_with_errors",
    """with m as (select c_custkey, case when c_custkey % 6 = 0 then '  n/a ' when c_custkey % 6 = 1 then '' else '  ' || c_acctbal || ' USD ' end as raw from customer),
    e as (select *, nullif(regexp_extract(raw, '(-?\\d+(?:\\.\\d+)?)', 1), '') as t from m)
    select c_custkey, case when t is null then trim(raw) else (round(t::decimal(28, 10), 1)::double)::varchar end as value,
      case when trim(raw) <> '' and t is null then 'No number found in ''' || trim(raw) || '''' end as error,
      case when trim(raw) <> '' and t is null then 'trim' else 'trim,normalize_decimal' end as applied,
      case when trim(raw) <> '' and t is null then 'invalid_record' end as reason,
      trim(raw) as stopped_value, 'new_transformation' as stopped_error, 'unsupported_operation' as unknown_error,
      'unsupported_operation' as unknown_reason from e""",
)
def chain_with_errors(spark, sf_dir):
    raw = "case when c_custkey % 6 = 0 then '  n/a ' when c_custkey % 6 = 1 then '' else concat('  ', c_acctbal, ' USD ') end"
    df = table(spark, sf_dir, "customer").select("c_custkey", F.expr(raw).alias("raw"))
    out = run_chains(
        df,
        [
            Chain("a", F.col("raw"), (Step("trim"), Step("normalize_decimal", {"decimals": 1}))),
            Chain("b", F.col("raw"), (Step("trim"), Step("soundex_key", proposed="group by sound"), Step("uppercase"))),
            Chain("c", F.col("raw"), (Step("no_such_step"),)),
        ],
    )
    value = F.col("a__value")
    shown = F.when(F.col("a__error").isNull() & (value != ""), value.try_cast("double").cast("string")).otherwise(F.coalesce(value, F.lit("")))
    return out.select(
        "c_custkey", shown.alias("value"), F.col("a__error").alias("error"), F.array_join("a__applied", ",").alias("applied"),
        error_reason(F.col("a__error")).alias("reason"), F.col("b__value").alias("stopped_value"), F.col("b__error").alias("stopped_error"),
        F.col("c__error").alias("unknown_error"), error_reason(F.col("c__error")).alias("unknown_reason"),
    )


@query(
    "last_success",
    """with m as (select c_custkey, case when c_custkey % 3 = 0 then 'x' else c_acctbal::varchar end as a,
      case when c_custkey % 4 = 0 then 'none' when c_custkey % 4 = 1 then '' else c_nationkey::varchar end as b from customer)
    select c_custkey, case when c_custkey % 4 = 1 then null when c_custkey % 4 <> 0 then b::double when c_custkey % 3 <> 0 then a::double end as chosen from m""",
)
def last_success_query(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "case when c_custkey % 3 = 0 then 'x' else cast(c_acctbal as string) end as a",
        "case when c_custkey % 4 = 0 then 'none' when c_custkey % 4 = 1 then '' else cast(c_nationkey as string) end as b",
    )
    out = run_chains(df, [Chain(n, F.col(n), (Step("extract_number"),)) for n in ("a", "b")])
    chosen = last_success([(F.col(f"{n}__value"), F.col(f"{n}__error")) for n in ("a", "b")])
    return out.select("c_custkey", chosen.try_cast("double").alias("chosen"))


@query(
    "column_facts",
    """with m as (select case when l_linenumber = 3 then format('{:,.2f}', l_extendedprice) else l_extendedprice::varchar end as price, l_quantity::varchar as quantity,
      l_returnflag || ';' || l_linestatus as flags from lineitem),
    v as (select 'price' as column_name, price as v from m union all select 'quantity', quantity from m union all select 'flags', flags from m)
    select column_name, bool_or(regexp_matches(v, '[0-9]') and not regexp_matches(v, '^-?[0-9]*[.]?[0-9]*$')) as noisy_number,
    bool_or(contains(v, ';')) as has_semicolon, bool_or(contains(v, ',')) as has_comma, bool_or(contains(v, '|')) as has_pipe from v group by 1""",
)
def column_facts_query(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "'lineitem' as source_file", "0 as source_row_number",
        "case when l_linenumber = 3 then format_number(l_extendedprice, 2) else cast(l_extendedprice as string) end as price",
        "cast(l_quantity as string) as quantity", "concat(l_returnflag, ';', l_linestatus) as flags",
    )
    return column_facts(df, ["price", "quantity", "flags"]).withColumnRenamed("column", "column_name")


@query(
    "meaningful_values",
    """select event_id, trim(case when event_id % 3 = 0 then '  ' else event_type end) <> '' as text_ok, event_id % 3 <> 0 as list_ok, event_id % 5 <> 0 and event_id % 3 <> 0 as map_ok from events""",
)
def meaningful_values(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr(
        "event_id", "case when event_id % 3 = 0 then '  ' else event_type end as t",
        "case when event_id % 5 = 0 then '' else 'key' end as k",
    )
    t = F.col("t")
    return df.select(
        "event_id", meaningful_text(t).alias("text_ok"), meaningful_list(F.array(F.lit("x"), t)).alias("list_ok"),
        meaningful_map(F.create_map(F.col("k"), t)).alias("map_ok"),
    )


_NESTED = {  # remainder -> JSON, whether it says something
    0: ('{"a":[1,{"b":"x"}]}', True), 1: ('{"a":[1,{"b":" \\t"}]}', False), 2: ('[[["",1]]]', False), 3: ('{"a":{}}', False), 4: ('{"a":[]}', False), 5: ('{" ":1}', False),
    6: ("null", False), 7: ("0", True), 8: ("false", True), 9: ('"null {} [] \\"\\", "', True), 10: ('{"k\\"":["\\" ,"," :\\" "]}', True), 11: ('{"a":[{"b":[{"c":null}]}]}', False), 12: ('"\\u00a0"', False), 13: ("{}", False),
}


@query(
    "meaningful_nested",
    "select event_id, case event_id % " + str(len(_NESTED)) + " " + " ".join(f"when {i} then {str(ok).lower()}" for i, (_, ok) in _NESTED.items()) + " end as ok from events",
)
def meaningful_nested(spark, sf_dir):
    """Whether values of any depth say something in each of their parts."""
    text = F.lit(None).cast("string")
    for i, (said, _) in _NESTED.items():
        text = F.when(F.col("event_id") % len(_NESTED) == i, said).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", meaningful_value(F.parse_json(text)).alias("ok"))


@query(
    "policy_decisions",
    """select vec_id, case when (s >= 0.86 and m >= 0.08) or s >= 0.6 then 'auto' else 'escalate' end as mapping,
      case when label < 5 or vec_id % 2 = 0 then 'auto' else 'escalate' end as step, case when label in (0, 3) then 'auto' else 'escalate' end as value
      from (select *, (vec_id % 100) / 100.0 as s, (vec_id % 20) / 100.0 as m from embeddings)""",
)
def policy_decisions(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "label", "(vec_id % 100) / 100.0d as s", "(vec_id % 20) / 100.0d as m",
        "case when label = 0 then '' else cast(label as string) end as l",
    )
    return df.select(
        "vec_id", mapping_decision(F.col("s"), F.col("m")).alias("mapping"),
        step_decision(F.col("label") < 5, F.col("vec_id") % 2 == 0).alias("step"),
        value_decision(F.col("l"), F.lit(" 3 ")).alias("value"),
    )


@query(
    "json_rows",
    """select to_json({'n_nationkey': n_nationkey, 'n_name': case when n_nationkey % 4 = 0 then null else n_name end, 'n_regionkey': n_regionkey, 'n_customers': n}) as json
    from nation left join (select c_nationkey, count(*) as n from customer group by 1) on c_nationkey = n_nationkey""",
)
def json_rows(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"))
    n = table(spark, sf_dir, "nation").withColumn("n_name", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")))
    joined = n.join(counts, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return to_json_rows(joined.select("n_nationkey", "n_name", "n_regionkey", "n_customers"))


@query(
    "exact_numbers",
    """select l_orderkey, l_linenumber, round((l_orderkey || '.' || lpad((l_partkey % 1000)::varchar, 3, '0') || '4999999999')::decimal(38,16), 3)::double as rounded,
    l_orderkey || '.' || lpad((l_partkey % 1000)::varchar, 3, '0') || '49' as shown,
    case when l_linenumber = 1 and l_orderkey > 0 then 'Number out of range in ''' || l_orderkey || repeat('0', 20) || '''' end as problem
    from lineitem""",
)
def exact_numbers(spark, sf_dir):
    """Digits after the tenth place decide a rounding once; long texts stay as they are; overflow is told as such (zeros are no overflow)."""
    part = "concat(l_orderkey, '.', lpad(cast(l_partkey % 1000 as string), 3, '0'))"
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"concat({part}, '4999999999') as long", f"concat({part}, '49') as short",
        "case when l_linenumber = 1 then concat(l_orderkey, repeat('0', 20)) end as huge",
    )
    out = run_chains(df, [Chain("short", F.col("short"), (Step("extract_number"),)), Chain("huge", F.col("huge"), (Step("normalize_integer"),))])
    rounded = apply(F.col("long"), "normalize_decimal", decimals=3)[0]
    return out.select("l_orderkey", "l_linenumber", rounded.alias("rounded"), F.col("short__value").alias("shown"), F.col("huge__error").alias("problem"))


@query(
    "value_map_paths",
    """with m as (select o_orderkey, case when o_orderkey % 5 = 0 then '' when o_orderkey % 5 = 1 then lower(o_orderpriority)
      when o_orderkey % 5 = 2 then 'QQQ' else ' ' || o_orderpriority || ' ' end as raw from orders)
    select o_orderkey, case when trim(raw) = '' then null when lower(trim(raw)) in ('1-urgent', '2-high') then 'top' when lower(trim(raw)) = 'qqq' then 'odd' end as value,
      case when trim(raw) = '' or lower(trim(raw)) in ('1-urgent', '2-high', 'qqq') then null else 'unmapped_value' end as error
    from m""",
)
def value_map_paths(spark, sf_dir):
    """A value map answers trimmed values, then values without case; blanks are missing, the rest is unmapped."""
    df = table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as record_id", "'orders' as source_file", "cast(o_orderkey as bigint) as source_row_number",
        "case when o_orderkey % 5 = 0 then '' when o_orderkey % 5 = 1 then lower(o_orderpriority) "
        "when o_orderkey % 5 = 2 then 'QQQ' else concat(' ', o_orderpriority, ' ') end as raw",
    )
    answers = spark.createDataFrame([("1-URGENT", "top"), ("2-HIGH", "top"), ("qqq", "odd"), ("4-none", None)], "value string, target string")
    entity = Entity("orders", (Field("level", "string"),))
    out = standardise_source(df, entity, [Mapped("raw", "level", (Step("trim"),), answers, 4)])
    return out.select(F.col("source_row_number").alias("o_orderkey"), F.col("level").alias("value"), F.get("step_errors", F.lit(0))["error"].alias("error"))


@query(
    "csv_folders",
    """select 'zone=' || c_nationkey % 5 as folder, count(*) as n_rows, count(*) as n_ids, sum(c_custkey)::bigint as keys, count(*) as n_places from customer group by 1""",
)
def csv_folders(spark, sf_dir):
    """Files of equal names in several folders, written and read back: no id and no row number meets twice."""
    root = Scratch(spark).root + "/csv"
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "concat('zone=', c_nationkey % 5) as folder")
    df.withColumn("place", F.col("folder")).write.partitionBy("place").csv(root, header=True)
    back = read_csv(spark, root, multi_line=False)
    return back.groupBy("folder").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("record_id").alias("n_ids"), F.sum(F.col("c_custkey").cast("bigint")).alias("keys"),
        F.count_distinct("source_file", "source_row_number").alias("n_places"),
    )


@query(
    "mixed_folder",
    """with files as (select 'account,note,name' as header, c_custkey as key, 'line one' || chr(10) || 'said "' || c_mktsegment || '", then' || chr(10) || c_custkey as note, c_name as name from customer
      union all select 'part number,note', p_partkey, p_brand || ',' || chr(10) || p_type, null from part)
    select header, count(*) as n_rows, count(*) as n_ids, 0::bigint as n_gaps, sum(key)::bigint as keys, sum(length(note))::bigint as n_chars, min(note) as first_note, max(name) as last_name from files group by 1""",
)
def mixed_folder(spark, sf_dir):
    """Files of two headers with line ends, quotes and separators inside quotes, in one folder: a frame for each header."""
    root = Scratch(spark).root + "/csv"
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as account", "concat('line one\n', 'said \"', c_mktsegment, '\", then\n', c_custkey) as note", "c_name as name"
    )
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey as `part number`", "concat(p_brand, ',\n', p_type) as note")
    for folder, rows in (("a", customers), ("b", parts)):
        rows.write.csv(f"{root}/{folder}", header=True, quoteAll=True, escape='"')
    out = []
    for frame in read_folder(spark, root, recursiveFileLookup=True):
        names = data_columns(frame)
        files = frame.groupBy("source_file").agg((F.max("source_row_number") - F.count(F.lit(1)) - 1).alias("gaps"))
        summed = frame.agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct("record_id").alias("n_ids"), F.sum(F.col(f"`{names[0]}`").cast("bigint")).alias("keys"),
            F.sum(F.length("note")).alias("n_chars"), F.min("note").alias("first_note"), (F.max("name") if "name" in names else F.lit(None).cast("string")).alias("last_name"),
        )
        out.append(summed.join(F.broadcast(files.agg(F.sum("gaps").alias("n_gaps")))).withColumn("header", F.lit(",".join(names))))
    return stack_sources(out)


@query(
    "type_kinds",
    """with m as (select case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%d/%m/%Y') end as day,
      strftime(o_orderdate, '%Y-%m-%d') || case when o_orderkey % 3 = 0 then '' else 'T10:30:00' end as moment,
      case when o_orderstatus = 'F' then 'True' else 'false' end as flag, case when o_orderkey % 7 = 0 then 'none' else strftime(o_orderdate, '%Y-%m-%d') end as loose from orders),
    t as (select unnest([('day', day), ('moment', moment), ('flag', flag), ('loose', loose)]) as c from m),
    k as (select c[1] as column_name, case when regexp_matches(c[2], '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})$') then 'date'
      when regexp_matches(c[2], '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$') then 'datetime' when lower(c[2]) in ('true', 'false') then 'boolean' else 'string' end as kind from t)
    select column_name, case when bool_and(kind = 'date') then 'date' when bool_and(kind in ('date', 'datetime')) then 'datetime' when bool_and(kind = 'boolean') then 'boolean' else 'string' end as inferred_type,
      count(*) as n_rows from k group by 1""",
)
def type_kinds(spark, sf_dir):
    """Dates, moments and flags are told from texts over all rows."""
    df = table(spark, sf_dir, "orders").selectExpr(
        "'orders.csv' as source_file", "o_orderkey as source_row_number",
        "date_format(o_orderdate, case when o_orderkey % 2 = 0 then 'yyyy-MM-dd' else 'dd/MM/yyyy' end) as day",
        "concat(date_format(o_orderdate, 'yyyy-MM-dd'), case when o_orderkey % 3 = 0 then '' else 'T10:30:00' end) as moment",
        "case when o_orderstatus = 'F' then 'True' else 'false' end as flag",
        "case when o_orderkey % 7 = 0 then 'none' else date_format(o_orderdate, 'yyyy-MM-dd') end as loose",
    )
    return column_types(df).select(F.col("column").alias("column_name"), "inferred_type", "n_rows")
