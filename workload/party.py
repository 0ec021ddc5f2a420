"""Messy sources derived from the given tables, and the contract they are moved into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcemeld.contract import Contract, contract_from_dict
from sourcemeld.functions.steps import Step
from sourcemeld.operators.identity import exact_identity
from sourcemeld.operators.standardise import Mapped, standardise_source
from sourcemeld.session import Scratch
from sourcemeld.sources.readers import stack_sources, with_lineage

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def party_contract() -> Contract:
    def field(name, **more):
        return {"name": name, **more}

    return contract_from_dict(
        {
            "entities": [
                {
                    "entity_name": "party",
                    "description": "A company we do business with",
                    "source_precedence": ["crm.csv", "billing.csv"],
                    "fields": [
                        field("party_id", required=True, unique=True, aliases=["cust no", "account"]),
                        field("email", unique=True, aliases=["mail", "email address"]),
                        field("name", required=True, aliases=["full name", "client name"]),
                        field("phone", aliases=["mobile"]),
                        field("balance", data_type="number"),
                        field("segment", enum_values=SEGMENTS),
                        field("since", data_type="date", aliases=["start date"]),
                        field("active", data_type="boolean", aliases=["enabled"]),
                    ],
                }
            ]
        }
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the day of their first order."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
    c = table(spark, sf_dir, "customer")
    return c.join(first, c.c_custkey == first.o_custkey, "left").drop("o_custkey")


def crm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = customers(spark, sf_dir).selectExpr(
        "c_custkey",
        "concat('C-', c_custkey) as `Cust No`",
        "concat('  ', upper(c_name), ' ') as `Full Name`",
        "concat('CUST', c_custkey, '@Example.COM') as `Email`",
        "concat('+91 (', lpad(c_custkey, 10, '9'), ')') as `Mobile`",
        "concat('₹', c_acctbal) as `Balance`",
        "lower(c_mktsegment) as `Segment`",
        "date_format(first_order, 'dd/MM/yyyy') as `Since`",
    )
    return with_lineage(df, F.lit("crm.csv"), F.col("c_custkey") + 2).drop("c_custkey")


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ", ".join(f"'{s}'" for s in SEGMENTS)
    df = customers(spark, sf_dir).where("c_custkey % 3 <> 0").selectExpr(
        "c_custkey",
        "case when c_custkey % 5 <> 0 then concat('C-', c_custkey) end as `Account`",
        "case when c_custkey % 7 <> 0 then concat('cust', c_custkey, '@example.com') end as `Mail`",
        "c_name as `Client Name`",
        f"case when c_custkey % 11 = 0 then element_at(array({names}), cast(array_position(array({names}), c_mktsegment) % 5 + 1 as int)) "
        "else c_mktsegment end as `Segment`",
        "date_format(first_order, 'MMM dd, yyyy') as `Start Date`",
    )
    return with_lineage(df, F.lit("billing.csv"), F.col("c_custkey") + 2).drop("c_custkey")


def portal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = customers(spark, sf_dir).where("c_custkey % 4 = 0").selectExpr(
        "c_custkey",
        "concat('cust', c_custkey, '@example.com') as `Email Address`",
        "concat(case when c_custkey % 8 = 0 then '92' else '91' end, lpad(c_custkey, 10, '9')) as `Phone`",
        "element_at(array('yes', 'no', '1', '0'), cast((c_custkey div 4) % 4 + 1 as int)) as `Enabled`",
        "date_format(first_order, 'yyyy-MM-dd') as `Since`",
    )
    return with_lineage(df, F.lit("portal.csv"), F.col("c_custkey") + 2).drop("c_custkey")


def sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [crm(spark, sf_dir), billing(spark, sf_dir), portal(spark, sf_dir)]


def _steps(*operations) -> tuple[Step, ...]:
    return tuple(o if isinstance(o, Step) else Step(o) for o in operations)


_SEGMENT = Step("map_value", {"mapping": {s: s for s in SEGMENTS}})
PLANS = {
    "crm": [
        Mapped("Cust No", "party_id", _steps("trim")),
        Mapped("Full Name", "name", _steps("trim")),
        Mapped("Email", "email", _steps("normalize_email")),
        Mapped("Mobile", "phone", _steps("normalize_phone")),
        Mapped("Balance", "balance", _steps("normalize_decimal")),
        Mapped("Segment", "segment", _steps(_SEGMENT)),
        Mapped("Since", "since", _steps("parse_date_auto")),
    ],
    "billing": [
        Mapped("Account", "party_id", _steps("trim")),
        Mapped("Mail", "email", _steps("normalize_email")),
        Mapped("Client Name", "name", _steps("trim")),
        Mapped("Segment", "segment", _steps(_SEGMENT)),
        Mapped("Start Date", "since", _steps("parse_date_auto")),
    ],
    "portal": [
        Mapped("Email Address", "email", _steps("normalize_email")),
        Mapped("Phone", "phone", _steps("normalize_phone")),
        Mapped("Enabled", "active", _steps("normalize_boolean")),
        Mapped("Since", "since", _steps("parse_date_auto")),
    ],
}


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised records of the three sources under the contract, fixed mapping."""
    entity = party_contract().entity("party")
    frames = sources(spark, sf_dir)
    return stack_sources([standardise_source(f, entity, plan) for f, plan in zip(frames, PLANS.values())])


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records with their exact identity group, written once."""
    scratch = Scratch(spark)
    records = scratch.write(canonical(spark, sf_dir), "records")
    groups = exact_identity(records, party_contract().entity("party"), scratch, rows=records.count())
    return records.join(groups, "record_id")


# --- the same in SQL --------------------------------------------------------------------

_SEG = "[" + ", ".join(f"'{s}'" for s in SEGMENTS) + "]"
SOURCES_SQL = f"""
first_order as (select o_custkey, min(o_orderdate) as first_order from orders group by 1),
cust as (select c.*, f.first_order from customer c left join first_order f on c.c_custkey = f.o_custkey),
crm as (select c_custkey as k, 'crm.csv#' || lpad((c_custkey + 2)::varchar, 12, '0') as record_id,
  'C-' || c_custkey as cust_no, '  ' || upper(c_name) || ' ' as full_name, 'CUST' || c_custkey || '@Example.COM' as email,
  '+91 (' || lpad(c_custkey::varchar, 10, '9') || ')' as mobile, '₹' || c_acctbal as balance, lower(c_mktsegment) as segment,
  strftime(first_order, '%d/%m/%Y') as since from cust),
billing as (select c_custkey as k, 'billing.csv#' || lpad((c_custkey + 2)::varchar, 12, '0') as record_id,
  case when c_custkey % 5 <> 0 then 'C-' || c_custkey end as account,
  case when c_custkey % 7 <> 0 then 'cust' || c_custkey || '@example.com' end as mail, c_name as client_name,
  case when c_custkey % 11 = 0 then {_SEG}[(list_position({_SEG}, c_mktsegment) % 5 + 1)::int] else c_mktsegment end as segment,
  strftime(first_order, '%b %d, %Y') as start_date from cust where c_custkey % 3 <> 0),
portal as (select c_custkey as k, 'portal.csv#' || lpad((c_custkey + 2)::varchar, 12, '0') as record_id,
  'cust' || c_custkey || '@example.com' as email_address,
  (case when c_custkey % 8 = 0 then '92' else '91' end) || lpad(c_custkey::varchar, 10, '9') as phone,
  ['yes', 'no', '1', '0'][((c_custkey // 4) % 4 + 1)::int] as enabled, strftime(first_order, '%Y-%m-%d') as since
  from cust where c_custkey % 4 = 0)"""

CANON_SQL = SOURCES_SQL + f""",
canon as (
  select record_id, 'crm.csv' as source_file, k + 2 as source_row_number, trim(cust_no) as party_id, lower(trim(email)) as email,
    trim(full_name) as name, regexp_replace(mobile, '\\D', '', 'g') as phone,
    round(regexp_extract(balance, '(-?\\d+(?:\\.\\d+)?)', 1)::decimal(20, 6), 2)::double as balance,
    case when upper(segment) in (select unnest({_SEG})) then upper(segment) end as segment,
    strftime(try_strptime(since, '%d/%m/%Y'), '%Y-%m-%d') as since, null::varchar as active from crm
  union all select record_id, 'billing.csv', k + 2, trim(account), lower(trim(mail)), trim(client_name), null, null, segment,
    strftime(try_strptime(start_date, '%b %d, %Y'), '%Y-%m-%d'), null from billing
  union all select record_id, 'portal.csv', k + 2, null, lower(trim(email_address)), null, regexp_replace(phone, '\\D', '', 'g'), null, null,
    strftime(try_strptime(since, '%Y-%m-%d'), '%Y-%m-%d'), case when enabled in ('yes', '1') then 'true' else 'false' end from portal)"""

# Groups by a recursive closure over shared keys, written differently from the engine's way.
GROUPS_SQL = CANON_SQL + """,
keyed as (select record_id, 'p' || party_id as key from canon where party_id is not null
  union all select record_id, 'e' || email from canon where email is not null),
linked as (select distinct a.record_id as a, b.record_id as b from keyed a join keyed b using (key)),
reach as (select record_id as a, record_id as b from canon union select r.a, l.b from reach r join linked l on r.b = l.a),
grouped as (select a as record_id, min(b) as group_id, count(*) as n from reach group by 1),
members as (select c.*, g.group_id, g.n as n_members from canon c join grouped g using (record_id))"""

# One surviving record per group: precedence crm, billing, others; then record id.
MERGED_SQL = GROUPS_SQL + """,
ranked as (select *, case source_file when 'crm.csv' then 0 when 'billing.csv' then 1 else 2 end as rank from members),
merged as (select group_id, """ + ", ".join(
    f"arg_min({f}, {{'r': rank, 'i': record_id}}) filter ({f} is not null) as {f}"
    for f in ("party_id", "email", "name", "phone", "balance", "segment", "since", "active")
) + """, count(*) as n_members, min(record_id) as primary_id,
  string_agg(distinct source_file, ',' order by source_file) as source_files,
  """ + ", ".join(
    f"(count(distinct lower(trim({f}::varchar))) > 1) as x_{f}, coalesce(bool_and(rank < 2) filter ({f} is not null), true) as s_{f}"
    for f in ("party_id", "email", "name", "phone", "balance", "segment", "since", "active")
) + """ from ranked group by group_id),
keyed_merged as (select *, coalesce(party_id, email, primary_id) as record_key from merged)"""


def with_sql(ctes: str, select: str) -> str:
    return f"with recursive {ctes.strip()} {select}"
