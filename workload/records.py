"""Identity, survivorship, validation, review, delivery and results over the derived sources."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcemeld.contract import Contract, Entity, Field, contract_fields, load_contract
from sourcemeld.operators import push as P
from sourcemeld.operators import results as R
from sourcemeld.operators import review as V
from sourcemeld.operators.fuzzy import best_candidates, fuzzy_identity
from sourcemeld.operators.identity import exact_identity, group_evidence, orphans, record_key, record_summary
from sourcemeld.operators.survivorship import (
    apply_corrections,
    conflict_values,
    correction_audit,
    duplicate_values,
    member_status,
    merge_groups,
)
from sourcemeld.operators.validation import group_status, missing_fields, typed, validate, violation_rows
from sourcemeld.plans.deliver import push_batch
from sourcemeld.plans.lifecycle import advance
from sourcemeld.plans.reconcile import run
from sourcemeld.session import Scratch
from sourcemeld.sources.readers import admission
from sourcemeld.sources.sinks import AuditTrail, RunTables, TargetStore
from workload.matching import ratio_sql
from workload.party import CANON_SQL, GROUPS_SQL, MERGED_SQL, SEGMENTS, canonical, crm, members, party_contract, sources, table, with_sql

QUERIES, SQL = {}, {}
FIELDS = ("party_id", "email", "name", "phone", "balance", "segment", "since", "active")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def entity():
    return party_contract().entity("party")


def shown(prefix: str = "") -> list:
    return [F.col(f).try_cast("double").alias(f) if f == "balance" else F.col(f) for f in FIELDS]


_COLUMNS = ", ".join(FIELDS)


# --- projection and identity ------------------------------------------------------------


@query("project_union", with_sql(CANON_SQL, f"select record_id, source_file, source_row_number, {_COLUMNS}, 'TRANSFORMED' as status from canon"))
def project_union(spark, sf_dir):
    return canonical(spark, sf_dir).select("record_id", "source_file", "source_row_number", *shown(), "status")


@query(
    "exact_identity",
    with_sql(GROUPS_SQL, "select record_id, group_id, case when n_members > 1 then 'exact' else 'single' end as method from members"),
)
def exact_identity_query(spark, sf_dir):
    return members(spark, sf_dir).select("record_id", "group_id", "method")


@query(
    "chained_identity",
    "select o_orderkey, lpad((o_orderkey // 120 * 120)::varchar, 12, '0') as group_id from orders",
)
def chained_identity(spark, sf_dir):
    """Long chains: overlapping blocks of four orders tie 120 orders together, hop by hop."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "lpad(o_orderkey, 12, '0') as record_id",
        "concat('c', o_orderkey div 4) as party_id",
        "case when (o_orderkey + 2) % 120 >= 4 then concat('d', (o_orderkey + 2) div 4) end as email",
    )
    groups = exact_identity(orders, entity(), Scratch(spark))
    return groups.select(F.col("record_id").cast("bigint").alias("o_orderkey"), "group_id")


@query(
    "hot_key_identity",
    """select o_orderkey, lpad((case when o_orderkey % 3 = 0 then 0 when o_orderkey % 3 = 1 then o_orderkey else o_orderkey - 1 end)::varchar, 12, '0') as group_id,
    case when o_orderkey % 3 = 1 and o_orderkey + 1 not in (select o_orderkey from orders) then 'single' else 'exact' end as method from orders""",
)
def hot_key_identity(spark, sf_dir):
    """One key holds a third of all rows."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "lpad(o_orderkey, 12, '0') as record_id",
        "case when o_orderkey % 3 = 0 then 'everyone' end as party_id",
        "case when o_orderkey % 3 <> 0 then concat('pair', o_orderkey div 3) end as email",
    )
    groups = exact_identity(orders, entity(), Scratch(spark))
    return groups.select(F.col("record_id").cast("bigint").alias("o_orderkey"), "group_id", "method")


@query(
    "group_evidence",
    with_sql(
        GROUPS_SQL,
        """select group_id, count(*) as n_members, case when count(*) > 1 then 'exact' else 'single' end as method,
        case when count(*) > 1 then concat_ws(',', case when count(distinct party_id) = 1 then 'party_id' end, case when count(distinct email) = 1 then 'email' end) else '' end as matched from members group by 1""",
    ),
)
def group_evidence_query(spark, sf_dir):
    found = group_evidence(members(spark, sf_dir), entity())
    return found.select("group_id", "n_members", "method", F.array_join("matched_fields", ",").alias("matched"))


_FUZZY_SQL = f"""twins as (
  select 'a' || lpad(c_custkey::varchar, 9, '0') as record_id, c_name as first_name, c_mktsegment as last_name, case when c_custkey % 5 <> 0 then 'c' || c_custkey end as email,
    'x' || (case when c_custkey % 10 < 4 then c_custkey - c_custkey % 2 else c_custkey end) as phone, null::varchar as date_of_birth from customer
  union all select 'b' || lpad(c_custkey::varchar, 9, '0'), 'Cutsomer' || substr(c_name, 9), c_mktsegment, null,
    'x' || (c_custkey - c_custkey % 3), null from customer where c_custkey % 2 = 0),
pairs as (select a.record_id as a, b.record_id as b, a.first_name as fa, b.first_name as fb, a.last_name as la, b.last_name as lb,
    case when a.email is not null and b.email is not null then (a.email = b.email)::int end as e, (a.phone = b.phone)::int as p
  from twins a join twins b on a.record_id <> b.record_id and a.phone = b.phone),
fs as (select fa, fb, {ratio_sql('fa', 'fb')} as r from (select distinct fa, fb from pairs)), ls as (select la, lb, {ratio_sql('la', 'lb')} as r from (select distinct la, lb from pairs)),
scored as (select a, b, (fs.r + ls.r + coalesce(e, 0) + p) / (3 + case when e is null then 0 else 1 end) as s from pairs join fs using (fa, fb) join ls using (la, lb)),
tops as (select a, b, s, coalesce(lead(s) over w, 0) as second, row_number() over w as rn from scored where s >= 0.72 window w as (partition by a order by s desc, b)),
best as (select a, b, s, second, s >= 0.9 and round(s - second, 9) >= 0.08 as clear from tops where rn = 1),
mutual as (select x.a, x.b from best x join best y on x.a = y.b and x.b = y.a where x.clear and y.clear)"""


def _twins(spark, sf_dir) -> DataFrame:
    """Customers and misspelt copies without a mail address; phones are shared by neighbours."""
    c = table(spark, sf_dir, "customer")
    first = c.selectExpr(
        "concat('a', lpad(c_custkey, 9, '0')) as record_id", "c_name as first_name", "c_mktsegment as last_name",
        "case when c_custkey % 5 <> 0 then concat('c', c_custkey) end as email",
        "concat('x', case when c_custkey % 10 < 4 then c_custkey - c_custkey % 2 else c_custkey end) as phone", "cast(null as string) as date_of_birth",
    )
    second = c.where("c_custkey % 2 = 0").selectExpr(
        "concat('b', lpad(c_custkey, 9, '0')) as record_id", "concat('Cutsomer', substr(c_name, 9)) as first_name", "c_mktsegment as last_name",
        "cast(null as string) as email", "concat('x', c_custkey - c_custkey % 3) as phone", "cast(null as string) as date_of_birth",
    )
    return first.unionByName(second)


@query(
    "fuzzy_identity",
    f"with {_FUZZY_SQL} select record_id, coalesce(least(record_id, m.b), record_id) as group_id, case when m.b is null then 'single' else 'fuzzy' end as method from twins left join mutual m on m.a = record_id",
)
def fuzzy_identity_query(spark, sf_dir):
    return fuzzy_identity(_twins(spark, sf_dir), Scratch(spark))[0]


@query(
    "ambiguous_matches",
    f"with {_FUZZY_SQL} select a as record_id, b as partner, round(s, 4) as score, round(second, 4) as second, 'ambiguous_match' as reason_code from best where a not in (select a from mutual)",
)
def ambiguous_matches(spark, sf_dir):
    return fuzzy_identity(_twins(spark, sf_dir), Scratch(spark))[1]


_HOT_SQL = f"""people as (select lpad(c_custkey::varchar, 9, '0') as record_id, 'p' || (c_custkey * 7919 % 100000) as first_name, c_mktsegment as last_name,
    case when c_custkey % 3 = 0 then '000' else 'x' || c_custkey // 2 end as phone from customer),
pairs as (select a.record_id as a, b.record_id as b, a.first_name as fa, b.first_name as fb, a.last_name as la, b.last_name as lb from people a join people b on a.record_id <> b.record_id and a.phone = b.phone),
fs as (select fa, fb, {ratio_sql('fa', 'fb')} as r from (select distinct fa, fb from pairs)), ls as (select la, lb, {ratio_sql('la', 'lb')} as r from (select distinct la, lb from pairs)),
scored as (select a, b, (fs.r + ls.r + 1) / 3 as s from pairs join fs using (fa, fb) join ls using (la, lb)),
tops as (select a, b, s, coalesce(lead(s) over w, 0) as second, row_number() over w as rn from scored where s >= 0.72 window w as (partition by a order by s desc, b))"""


@query("hot_phone_matches", f"with {_HOT_SQL} select a as record_id, b as partner, round(s, 6) as score, round(second, 6) as second from tops where rn = 1")
def hot_phone_matches(spark, sf_dir):
    """One phone on a third of all customers, all of them different."""
    people = table(spark, sf_dir, "customer").selectExpr(
        "lpad(c_custkey, 9, '0') as record_id", "concat('p', c_custkey * 7919 % 100000) as first_name", "c_mktsegment as last_name",
        "case when c_custkey % 3 = 0 then '000' else concat('x', c_custkey div 2) end as phone",
    )
    found = best_candidates(people, Scratch(spark), ["first_name", "last_name"], ["phone"], tile_rows=200)
    return found.select("record_id", "partner", F.round("score", 6).alias("score"), F.round("second", 6).alias("second"))


@query(
    "record_keys",
    with_sql(
        CANON_SQL,
        """select record_id, coalesce(party_id, email) as record_key, concat_ws(',', 'party_id=' || party_id, 'email=' || email, 'name=' || name) as summary from canon""",
    ),
)
def record_keys(spark, sf_dir):
    df = canonical(spark, sf_dir)
    shown_map = F.array_join(
        F.transform(F.map_entries(record_summary(entity(), df.columns)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )
    return df.select("record_id", record_key(entity(), df.columns).alias("record_key"), shown_map.alias("summary"))


@query(
    "orphan_check",
    """select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey % 7 <> 0)""",
)
def orphan_check(spark, sf_dir):
    child = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(o_custkey as string) as o_custkey")
    parent = table(spark, sf_dir, "customer").where("c_nationkey % 7 <> 0").selectExpr("cast(c_custkey as string) as c_custkey")
    return orphans(child, parent, "o_custkey", "c_custkey").select("o_orderkey", F.col("o_custkey").cast("bigint").alias("o_custkey"))


# --- survivorship -----------------------------------------------------------------------


@query("survivorship", with_sql(MERGED_SQL, f"select group_id, record_key, {_COLUMNS}, n_members, primary_id, source_files from keyed_merged"))
def survivorship(spark, sf_dir):
    merged = merge_groups(members(spark, sf_dir), entity())
    return merged.select("group_id", "record_key", *shown(), "n_members", "primary_id", F.array_join("source_files", ",").alias("source_files"))


_CONFLICT_SQL = " union all ".join(f"select group_id, '{f}' as field, s_{f} as silent from merged where x_{f}" for f in FIELDS)


@query("conflicts", with_sql(MERGED_SQL, _CONFLICT_SQL))
def conflicts(spark, sf_dir):
    return merge_groups(members(spark, sf_dir), entity()).select("group_id", F.inline("conflicts"))


_OPEN_SQL = MERGED_SQL + ", open_conflicts as (" + " union all ".join(
    f"select group_id, record_key, primary_id, '{f}' as field from keyed_merged where x_{f} and not s_{f}" for f in FIELDS
) + ")"


@query(
    "conflict_values",
    with_sql(
        _OPEN_SQL,
        """, cells as (""".join(["", " union all ".join(f"select group_id, source_file, '{f}' as field, {f}::varchar as value from members where {f} is not null" for f in FIELDS) + ")"])
        + " select o.group_id, o.record_key, o.field, source_file, value, count(*) as n_rows from open_conflicts o join cells c on c.group_id = o.group_id and c.field = o.field group by all",
    ),
)
def conflict_values_query(spark, sf_dir):
    m = Scratch(spark).write(members(spark, sf_dir), "members")
    return conflict_values(m, merge_groups(m, entity()), entity())


def _corrections(spark, sf_dir) -> DataFrame:
    """Approved corrections: a phone for every 16th customer, twice; a name for some keyless ones."""
    c = table(spark, sf_dir, "customer")
    rows = [
        c.where("c_custkey % 16 = 0").selectExpr(
            "'party' as entity", "concat('C-', c_custkey) as record_key", "'phone' as field", f"concat('{v}', c_custkey) as value",
            f"timestamp_ntz'2024-01-0{day} 00:00:00' as decided_at", f"'d{day}' as decision_id",
        )
        for v, day in (("777", 2), ("111", 1))
    ]
    rows.append(
        c.where("c_custkey % 35 = 0").selectExpr(
            "'party' as entity", "concat('billing.csv#', lpad(c_custkey + 2, 12, '0')) as record_key", "'party_id' as field",
            "case when c_custkey % 2 = 0 then '' else concat('N-', c_custkey) end as value", "timestamp_ntz'2024-01-01 00:00:00' as decided_at", "'d3' as decision_id",
        )
    )
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_FIXES_SQL = MERGED_SQL + """, fixes as (select 'C-' || c_custkey as record_key, 'phone' as field, '777' || c_custkey as value from customer where c_custkey % 16 = 0
  union all select 'billing.csv#' || lpad((c_custkey + 2)::varchar, 12, '0'), 'party_id', 'N-' || c_custkey from customer where c_custkey % 35 = 0 and c_custkey % 2 <> 0),
corrected as (select m.* replace (coalesce(fp.value, phone) as phone, coalesce(fi.value, party_id) as party_id, x_phone and fp.value is null as x_phone, x_party_id and fi.value is null as x_party_id)
  from keyed_merged m left join fixes fp on fp.record_key = m.record_key and fp.field = 'phone' left join fixes fi on fi.record_key = m.record_key and fi.field = 'party_id')"""
_ANY_OPEN = "concat_ws(',', " + ", ".join(f"case when x_{f} and not s_{f} then '{f}' end" for f in FIELDS) + ")"


@query("corrections", with_sql(_FIXES_SQL, f"select record_key, party_id, phone, {_ANY_OPEN} as open_conflicts from corrected"))
def corrections(spark, sf_dir):
    merged = merge_groups(members(spark, sf_dir), entity())
    fixed = apply_corrections(merged, _corrections(spark, sf_dir), entity())
    return fixed.select("record_key", "party_id", "phone", F.array_join("open_conflicts", ",").alias("open_conflicts"))


@query("correction_audit", with_sql(_FIXES_SQL, "select f.record_key, f.field, f.value from fixes f join keyed_merged m using (record_key)"))
def correction_audit_query(spark, sf_dir):
    merged = merge_groups(members(spark, sf_dir), entity())
    return correction_audit(apply_corrections(merged, _corrections(spark, sf_dir), entity()), entity())


@query(
    "duplicate_values",
    "select 'party_id' as field, 'n' || (c_nationkey::varchar) as value, count(*) as n_groups from customer group by all having count(*) > 1",
)
def duplicate_values_query(spark, sf_dir):
    """Surviving records that share a unique value after corrections."""
    c = table(spark, sf_dir, "customer").selectExpr("concat(' N', c_nationkey, ' ') as party_id", "cast(null as string) as email")
    return duplicate_values(c, entity())


_STATUS_SQL = _FIXES_SQL + f""", judged as (select *, ({_ANY_OPEN} <> '' or party_id is null or name is null) as held from corrected),
statuses as (select m.record_id, m.group_id, m.source_file, m.source_row_number, j.record_key, case when held then 'CONSULTANT_REVIEW' when m.record_id = j.primary_id then 'READY_TO_PUSH' else 'RECONCILED' end as status
  from members m join judged j using (group_id))"""


def _checked(spark, sf_dir, m: DataFrame) -> DataFrame:
    fixed = apply_corrections(merge_groups(m, entity()), _corrections(spark, sf_dir), entity())
    return group_status(validate(fixed, entity()))


def _status(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    m = Scratch(spark).write(members(spark, sf_dir), "members")
    checked = Scratch(spark).write(_checked(spark, sf_dir, m), "checked")
    return checked, member_status(m, checked).withColumn("entity", F.lit("party"))


@query("member_status", with_sql(_STATUS_SQL, "select record_id, group_id, record_key, status from statuses"))
def member_status_query(spark, sf_dir):
    return _status(spark, sf_dir)[1].select("record_id", "group_id", "record_key", "status")


# --- validation -------------------------------------------------------------------------

_ENUM_TEXT = "Value must be one of " + str(list(SEGMENTS)).replace("'", "''")


@query(
    "validate_errors",
    f"""with m as (select c_custkey, case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then '' else 'C-' || c_custkey end as party_id,
      case when c_custkey % 5 = 0 then lower(c_mktsegment) else c_mktsegment end as segment, case when c_custkey % 7 = 0 then c_acctbal || ' USD' else c_acctbal::varchar end as balance,
      case when c_custkey % 11 = 0 then '2024-02-30' when c_custkey % 11 = 1 then '05/06/2024' else '2024-02-03' end as since, case when c_custkey % 13 = 0 then 'yes' else 'true' end as active from customer)
    select c_custkey, 'party_id' as field, 'required' as code, 'Required field is missing' as message from m where coalesce(party_id, '') = ''
    union all select c_custkey, 'segment', 'enum', '{_ENUM_TEXT}' from m where segment <> upper(segment)
    union all select c_custkey, 'balance', 'type', 'Value does not match type number' from m where try_cast(balance as double) is null
    union all select c_custkey, 'since', 'type', 'Value does not match type date' from m where try_strptime(since, '%Y-%m-%d') is null
    union all select c_custkey, 'active', 'type', 'Value does not match type boolean' from m where active = 'yes'""",
)
def validate_errors(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then '' else concat('C-', c_custkey) end as party_id",
        "cast(null as string) as email", "c_name as name", "cast(null as string) as phone",
        "case when c_custkey % 7 = 0 then concat(c_acctbal, ' USD') else cast(c_acctbal as string) end as balance",
        "case when c_custkey % 5 = 0 then lower(c_mktsegment) else c_mktsegment end as segment",
        "case when c_custkey % 11 = 0 then '2024-02-30' when c_custkey % 11 = 1 then '05/06/2024' else '2024-02-03' end as since",
        "case when c_custkey % 13 = 0 then 'yes' else 'true' end as active",
    )
    return violation_rows(validate(df, entity()), "c_custkey")


@query(
    "quarantine",
    with_sql(
        MERGED_SQL,
        """select record_key, concat_ws(',', case when party_id is null then 'party_id' end, case when name is null then 'name' end) as missing,
        'Missing required field for ' || record_key as title from keyed_merged where party_id is null or name is null""",
    ),
)
def quarantine_query(spark, sf_dir):
    checked = validate(merge_groups(members(spark, sf_dir), entity()), entity())
    missing = missing_fields(F.col("violations"))
    return checked.where(F.size("violations") > 0).select(
        "record_key", F.array_join(missing, ",").alias("missing"), F.concat(F.lit("Missing required field for "), "record_key").alias("title")
    )


@query(
    "typed_records",
    with_sql(MERGED_SQL, "select record_key, party_id, name, balance, since, active::boolean as active from keyed_merged where party_id is not null and name is not null"),
)
def typed_records(spark, sf_dir):
    checked = validate(merge_groups(members(spark, sf_dir), entity()), entity())
    t = typed(checked.where(F.size("violations") == 0), entity(), "record_key")
    return t.select("record_key", "party_id", "name", "balance", F.col("since").cast("string").alias("since"), "active")


# --- reviews and decisions --------------------------------------------------------------


def _items(spark, sf_dir) -> DataFrame:
    """Review items of the merged records: one per open conflict and per invalid record."""
    checked = validate(merge_groups(members(spark, sf_dir), entity()), entity())
    checked = Scratch(spark).write(checked, "checked")
    clash = V.review_items(
        checked.select("*", F.explode("open_conflicts").alias("conflict")),
        reason_code="conflicting_values", entity="party", record_id=F.col("primary_id"), record_key=F.col("record_key"), field=F.col("conflict"),
        title=F.concat(F.lit("Conflicting values for "), "conflict"), source_file=F.element_at("source_files", 1),
    )
    invalid = V.review_items(
        checked.where((F.size("open_conflicts") == 0) & (F.size("violations") > 0)),
        reason_code="invalid_record", entity="party", record_id=F.col("primary_id"), record_key=F.col("record_key"), violations=F.col("violations"),
        title=F.lit("Missing required field"), source_file=F.element_at("source_files", 1),
    )
    return V.with_review_id(clash.unionByName(invalid))


_REVIEW_SQL = _OPEN_SQL + """, items as (select 'conflicting_values' as reason_code, record_key, primary_id as record_id, field, null as codes,
    sha256('conflicting_values|party|' || primary_id || '|' || field || '|') as review_id from open_conflicts
  union all select 'invalid_record', record_key, primary_id, null, codes, sha256('invalid_record|party|' || codes) from
    (select *, concat_ws(',', case when name is null then 'name:required' end, case when party_id is null then 'party_id:required' end) as codes from keyed_merged)
    where codes <> '' and group_id not in (select group_id from open_conflicts))"""


@query(
    "review_queue",
    with_sql(_REVIEW_SQL, "select review_id, reason_code, field, min(record_key) as record_key, count(*) as n_items from items group by all"),
)
def review_queue(spark, sf_dir):
    items = _items(spark, sf_dir)
    first = V.review_members(items).groupBy("review_id").agg(F.min("record_key").alias("record_key"))
    return V.review_queue(items).drop("record_key").join(first, "review_id").select("review_id", "reason_code", "field", "record_key", "n_items")


@query("review_members", with_sql(_REVIEW_SQL, "select distinct review_id, record_key, record_id from items"))
def review_members(spark, sf_dir):
    return V.review_members(_items(spark, sf_dir))


@query(
    "field_level_reviews",
    """select reason_code, source_field, error, count(*) as n_items, sha256(reason_code || '|party|' || source_field || '|active|' || error) as review_id from
    (select case event_type when 'error' then 'unmapped_value' else 'unsupported_operation' end as reason_code, event_type as source_field, case event_type when 'error' then 'unmapped_value' else 'unsupported_operation' end as error from events) group by all""",
)
def field_level_reviews(spark, sf_dir):
    """A failing column is one question, however many rows it fails in."""
    failed = table(spark, sf_dir, "events").selectExpr(
        "concat('r', event_id) as record_id", "event_type", "case event_type when 'error' then 'unmapped_value' else 'unsupported_operation' end as error"
    )
    items = V.review_items(
        failed, reason_code=F.col("error"), entity="party", record_id=F.col("record_id"), source_field=F.col("event_type"), target_field="active", error=F.col("error")
    )
    return V.review_queue(items).select("reason_code", "source_field", "error", "n_items", "review_id")


_DECISION_SQL = _REVIEW_SQL + """, decided as (select *, case when length(record_key) % 4 = 0 then 'review is not open' when length(record_key) % 4 = 1 and reason_code = 'invalid_record' then 'field is not failing'
  when length(record_key) % 4 = 2 then 'decision is empty' end as problem from items)"""


def _decisions(items: DataFrame) -> DataFrame:
    """Answers to the open items, right and wrong ones, by the length of the record key."""
    n = F.length("record_key") % 4
    field = F.when(F.col("reason_code") == "invalid_record", F.lit("party_id")).otherwise(F.col("field"))
    value = F.when(n == 2, F.lit(" ")).otherwise(F.concat(F.lit("fixed "), "record_key"))
    return items.select(
        F.concat(F.lit("d-"), "record_key", F.lit("-"), F.coalesce("field", F.lit("record"))).alias("decision_id"),
        F.when(n == 0, F.lit("closed")).otherwise(F.col("review_id")).alias("review_id"),
        "reason_code", "entity", "record_id", "record_key", F.lit(None).cast("string").alias("source_field"), F.lit(None).cast("string").alias("target_field"),
        F.create_map(F.when(n == 1, F.lit("balance")).otherwise(field), value).alias("corrections"),
        F.lit(None).cast("map<string,string>").alias("value_map"), F.lit(None).cast(V.DECISION_COLUMNS["steps"]).alias("steps"),
        F.lit("clerk").alias("actor"), F.lit("2024-05-01 10:00:00").cast("timestamp_ntz").alias("decided_at"),
    )


def _decided(spark, sf_dir):
    items = Scratch(spark).write(_items(spark, sf_dir), "items")
    queue = V.review_queue(items)
    return queue, V.check_decisions(_decisions(items), queue)


@query("decision_checks", with_sql(_DECISION_SQL, "select 'd-' || record_key || '-' || coalesce(field, 'record') as decision_id, problem from decided"))
def decision_checks(spark, sf_dir):
    return _decided(spark, sf_dir)[1].select("decision_id", "problem")


@query(
    "open_after_decisions",
    with_sql(_DECISION_SQL, """select distinct review_id, reason_code from items i where not exists
      (select 1 from decided d where d.problem is null and d.review_id = i.review_id and d.record_key = i.record_key)"""),
)
def open_after_decisions(spark, sf_dir):
    """A review of many records stays open until each of them is answered."""
    items = Scratch(spark).write(_items(spark, sf_dir), "items")
    queue = V.review_queue(items)
    accepted, _ = V.split_decisions(V.check_decisions(_decisions(items), queue))
    return V.open_reviews(queue, accepted, V.review_members(items)).select("review_id", "reason_code")


@query(
    "review_states",
    with_sql(
        _DECISION_SQL,
        """, answered as (select distinct review_id from decided where problem is null)
        select distinct review_id, reason_code, case when review_id in (select * from answered) then 'RESOLVED' when reason_code = 'invalid_record' then 'OPEN' else 'SUPERSEDED' end as state from items""",
    ),
)
def review_states(spark, sf_dir):
    """The next run asks only about invalid records; unanswered conflicts of the first are superseded."""
    queue, checked = _decided(spark, sf_dir)
    accepted, _ = V.split_decisions(checked)
    return V.review_states(queue, queue.where("reason_code = 'invalid_record'"), accepted)


@query(
    "decision_log",
    with_sql(
        _DECISION_SQL,
        "select 'clerk' as actor, 'ESCALATION_RESOLVED' as action, reason_code as reason, review_id, record_key from decided where problem is null",
    ),
)
def decision_log(spark, sf_dir):
    accepted, _ = V.split_decisions(_decided(spark, sf_dir)[1])
    return V.decision_log(accepted).drop("decided_at")


@query(
    "replayed_corrections",
    with_sql(
        _DECISION_SQL,
        "select record_key, case when reason_code = 'invalid_record' then 'party_id' when length(record_key) % 4 = 1 then 'balance' else field end as field, 'fixed ' || record_key as value from decided where problem is null",
    ),
)
def replayed_corrections(spark, sf_dir):
    accepted, _ = V.split_decisions(_decided(spark, sf_dir)[1])
    return V.field_corrections(accepted).select("record_key", "field", "value")


@query(
    "value_answers",
    """select event_type as source_column, 'v' || (user_id % 10) as value, arg_max('t' || event_id, event_id) as target from events group by all""",
)
def value_answers(spark, sf_dir):
    """Every event is a decision that maps one value; the latest per column and value wins."""
    text = F.lit(None).cast("string")
    d = table(spark, sf_dir, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("decision_id"), text.alias("review_id"), F.lit("unmapped_value").alias("reason_code"),
        F.lit("party").alias("entity"), text.alias("record_id"), text.alias("record_key"), F.col("event_type").alias("source_field"), text.alias("target_field"),
        F.lit(None).cast("map<string,string>").alias("corrections"),
        F.create_map(F.concat(F.lit("v"), F.col("user_id") % 10), F.concat(F.lit("t"), "event_id")).alias("value_map"),
        F.lit(None).cast(V.DECISION_COLUMNS["steps"]).alias("steps"), F.lit("clerk").alias("actor"), F.lit("2024-05-01 10:00:00").cast("timestamp_ntz").alias("decided_at"),
    )
    return V.value_answers(d).select("source_column", "value", "target")


# --- typed resolutions ------------------------------------------------------------------

_RESOLUTIONS = {  # remainder of the key -> review, resolution, problem
    0: ("closed", '{"target_field":"email"}', "review is not open"),
    1: ("map", "{}", "decision is empty"),
    2: ("map", '{"target_field":5}', "target is no text"),
    3: ("map", '{"target_field":"email","transformations":{"operation":"trim"}}', "steps are no list"),
    4: ("map", '{"target_field":"email","transformations":[{"operation":"trim"},{"params":{"a":[1]}}]}', "an operation is empty"),
    5: ("map", '{"mappings":"email"}', "mappings are no list"),
    6: ("map", '{"mappings":[{"source_field":"A","target_field":"email"},{"source_field":"B"}]}', "a mapping is incomplete"),
    7: ("map", '{"mappings":[{"source_field":"A","target_field":"email","transformations":[{"params":{"s":{"t":1}}}]}]}', "an operation is empty"),
    8: ("map", '{"target_field":"name","source_field":"A"}', "target is not a candidate"),
    9: ("map", '{"target_field":"email","source_field":"Z"}', "source column is not on offer"),
    10: ("llm", '{"source_field":"A"}', "a mapping is needed"),
    11: ("bad", '{"target_field":"name"}', "a correction is needed"),
    12: ("bad", '{"corrections":{"zip":"1"}}', "field is not failing"),
    13: ("bad", '{"corrections":{"name":"n","age":7}}', None),
    14: ("val", '{"transformations":[{"operation":"map_value","params":{"mapping":{"BUILDING":"X","MACHINERY":"Y"}}}]}', "a value has no allowed target"),
    15: ("val", '{"transformations":[{"operation":"trim"},{"operation":"map_value","params":{"mapping":{%s}}}]}' % ",".join(f'"{s}":"{"XY"[i % 2]}"' for i, s in enumerate(SEGMENTS)), None),
    16: ("map", '{"target_field":"email","source_field":"B","note":[[{"deep":{"deeper":"  "}}]]}', "decision is empty"),
    17: ("llm", '{"mappings":[{"source_field":"A","target_field":"email"}]}', None),
}


def _resolutions(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers of every kind, the open reviews and the values they ask about: all segments of the customers."""
    c = table(spark, sf_dir, "customer")
    review, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, text, _) in _RESOLUTIONS.items():
        mine = F.col("c_custkey") % len(_RESOLUTIONS) == i
        review, said = F.when(mine, name).otherwise(review), F.when(mine, text).otherwise(said)
    answers = c.select(
        F.concat(F.lit("d"), "c_custkey").alias("decision_id"), review.alias("review_id"), F.lit(None).cast("string").alias("record_key"), F.lit("clerk").alias("actor"),
        F.lit("2024-05-01 10:00:00").cast("timestamp_ntz").alias("decided_at"), F.parse_json(said).alias("resolution"),
    )
    shape = ", ".join(f"{n} {t}" for n, t in V.REVIEW_COLUMNS.items())
    rows = [
        {"reason_code": "ambiguous_mapping", "candidates": ["email", "phone"], "available_source_fields": ["A", "B"]}, {"reason_code": "llm_unavailable"},
        {"reason_code": "invalid_record", "violations": [("name", "required", ""), ("age", "type", "")]}, {"reason_code": "unmapped_value", "allowed_values": ["X", "Y"]},
    ]
    rows = [tuple((row | {"entity": "party"}).get(n) for n in V.REVIEW_COLUMNS) for row in rows]
    kinds = F.create_map(*[F.lit(x) for x in ("ambiguous_mapping", "map", "llm_unavailable", "llm", "invalid_record", "bad", "unmapped_value", "val")])
    queue = spark.createDataFrame(rows, shape).withColumn("review_id", F.element_at(kinds, F.col("reason_code")))
    return answers, queue, c.select(F.lit("val").alias("review_id"), F.col("c_mktsegment").alias("value")).distinct()


@query(
    "resolution_checks",
    "select 'd' || c_custkey as decision_id, case c_custkey % " + str(len(_RESOLUTIONS)) + " " + " ".join(f"when {i} then '{p}'" for i, (_, _, p) in _RESOLUTIONS.items() if p) + " end as problem from customer",
)
def resolution_checks(spark, sf_dir):
    """Every rule for typed answers, with nested lists and maps among them."""
    return V.check_resolutions(*_resolutions(spark, sf_dir)).select("decision_id", "problem")


@query(
    "resolution_rows",
    """select 'd' || c_custkey as decision_id, 'A' || c_nationkey as source_field, 'email' as target_field, 'split' as operation, ';' as separator, '["x",' || c_nationkey || ']' as keep from customer
    union all select 'd' || c_custkey, 'B', 'phone', null, null, null from customer""",
)
def resolution_rows(spark, sf_dir):
    """Several mappings in one answer, each with steps of its own whose parameters are texts and lists."""
    said = F.concat(
        F.lit('{"mappings":[{"source_field":"A'), "c_nationkey", F.lit('","target_field":"email","transformations":[{"operation":"split","params":{"separator":";","keep":["x",'),
        "c_nationkey", F.lit(']}}]},{"source_field":"B","target_field":"phone"}]}'),
    )
    _, queue, values = _resolutions(spark, sf_dir)
    answers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("d"), "c_custkey").alias("decision_id"), F.lit("llm").alias("review_id"), F.lit(None).cast("string").alias("record_key"), F.lit("clerk").alias("actor"),
        F.lit("2024-05-01 10:00:00").cast("timestamp_ntz").alias("decided_at"), F.parse_json(said).alias("resolution"),
    )
    accepted, _ = V.split_decisions(V.check_resolutions(answers, queue, values))
    rows = V.decisions_of(accepted, queue).where("source_field is not null")
    step = F.get("steps", F.lit(0))
    return rows.select("decision_id", "source_field", "target_field", step["operation"].alias("operation"), F.try_element_at(step["params"], F.lit("separator")).alias("separator"), F.try_element_at(step["params"], F.lit("keep")).alias("keep"))


# --- delivery ---------------------------------------------------------------------------


@query(
    "natural_keys",
    """select c_custkey, case when c_custkey % 3 = 0 then c_custkey::varchar when c_custkey % 3 = 1 then 'N' || c_nationkey
      else substr(sha256(to_json({'code': code, 'customer_id': cid, 'name': c_name})), 1, 20) end as key from
    (select *, case when c_custkey % 3 = 0 then ' ' || c_custkey || ' ' when c_custkey % 3 = 1 then '' end as cid, case when c_custkey % 3 = 1 then 'N' || c_nationkey end as code from customer)""",
)
def natural_keys(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "case when c_custkey % 3 = 0 then concat(' ', c_custkey, ' ') when c_custkey % 3 = 1 then '' end as customer_id",
        "case when c_custkey % 3 = 1 then concat('N', c_nationkey) end as code", "c_name as name",
    )
    return df.select("c_custkey", P.natural_key(["customer_id", "code", "name"]).alias("key"))


def _target(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """What an earlier run left: a target table and its ledger."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 4 = 1")
    target = c.selectExpr("concat('C-', c_custkey) as record_key", "c_name as name", "cast(c_nationkey as string) as nation")
    ledger = c.selectExpr("concat('run:', c_custkey) as idem_key", "concat('C-', c_custkey) as record_key")
    return target, ledger


def _ready(spark, sf_dir) -> DataFrame:
    """Customers of this run; orders add later versions of their customer."""
    c = table(spark, sf_dir, "customer").selectExpr(
        "lpad(c_custkey, 12, '0') as record_id", "concat('C-', c_custkey) as record_key", "concat('run:', c_custkey) as idem_key",
        "upper(c_name) as name", "cast(c_nationkey as string) as nation",
    )
    o = table(spark, sf_dir, "orders").selectExpr(
        "concat('o', lpad(o_orderkey, 12, '0')) as record_id", "concat('C-', o_custkey) as record_key", "concat('order:', o_orderkey) as idem_key",
        "concat('order ', o_orderkey) as name", "o_orderstatus as nation",
    )
    return c.unionByName(o)


_PUSH_SQL = """ready as (select lpad(c_custkey::varchar, 12, '0') as record_id, 'C-' || c_custkey as record_key, 'run:' || c_custkey as idem_key, upper(c_name) as name, c_nationkey::varchar as nation from customer
  union all select 'o' || lpad(o_orderkey::varchar, 12, '0'), 'C-' || o_custkey, 'order:' || o_orderkey, 'order ' || o_orderkey, o_orderstatus from orders),
target as (select 'C-' || c_custkey as record_key, c_name as name, c_nationkey::varchar as nation from customer where c_custkey % 4 = 1),
ledger as (select 'run:' || c_custkey as idem_key, 'C-' || c_custkey as record_key from customer where c_custkey % 4 = 1),
outcomes as (select *, case when record_key like '%7' then 'rejected' when idem_key in (select idem_key from ledger) then 'idempotent_replay' else 'accepted' end as outcome from ready)"""


def _reject():
    return F.col("record_key").endswith("7")


@query("push_outcomes", f"with {_PUSH_SQL} select record_id, record_key as target_key, outcome from outcomes")
def push_outcomes(spark, sf_dir):
    _, ledger = _target(spark, sf_dir)
    return P.push_outcomes(_ready(spark, sf_dir), ledger, _reject()).select("record_id", "target_key", "outcome")


_AFTER_SQL = f"""{_PUSH_SQL}, after as (select record_key, arg_max(name, age) as name, arg_max(nation, age) as nation from
  (select record_key, name, nation, '0' as age from target union all select record_key, name, nation, '1' || record_id from outcomes where outcome = 'accepted') group by 1)"""


@query("upsert_target", f"with {_AFTER_SQL} select * from after")
def upsert_target(spark, sf_dir):
    target, ledger = _target(spark, sf_dir)
    accepted = P.push_outcomes(_ready(spark, sf_dir), ledger, _reject()).where("outcome = 'accepted'")
    return P.upsert(target, accepted, ["name", "nation"])


def _pushed(spark, sf_dir):
    target, ledger = _target(spark, sf_dir)
    ready = _ready(spark, sf_dir)
    outcomes = Scratch(spark).write(P.push_outcomes(ready, ledger, _reject()), "outcomes")
    accepted = outcomes.where("outcome = 'accepted'")
    status = P.pushed_status(ready.withColumn("status", F.lit("READY_TO_PUSH")), outcomes)
    return P.upsert(target, accepted, ["name", "nation"]), P.extend_ledger(ledger, accepted), status, outcomes


@query("push_failures", f"with {_PUSH_SQL} select 'target_api_failure' as reason_code, record_id, record_key, 'Target failed for party' as title from outcomes where outcome = 'rejected'")
def push_failures(spark, sf_dir):
    return P.failure_reviews(_pushed(spark, sf_dir)[3], "party").drop("entity")


@query(
    "retry_failed",
    f"""with {_AFTER_SQL} select record_key, arg_max(name, age) as name, arg_max(nation, age) as nation from
    (select record_key, name, nation, '0' as age from after union all select record_key, name, nation, '1' || record_id from outcomes where outcome = 'rejected') group by 1""",
)
def retry_failed(spark, sf_dir):
    """Push, then push again: failures go through, everything else is a replay."""
    target, ledger, status, _ = _pushed(spark, sf_dir)
    pushed = status.where("status in ('PUSH_FAILED', 'PUSHED')").drop("target_key")
    again = P.push_outcomes(pushed, ledger, failed=F.col("status") == "PUSH_FAILED")
    return P.upsert(target, again.where("outcome = 'accepted'"), ["name", "nation"])


@query(
    "rollback_run",
    f"with {_AFTER_SQL} select record_key, name, nation from after where record_key not in (select record_key from outcomes where outcome <> 'rejected')",
)
def rollback_run(spark, sf_dir):
    target, ledger, status, _ = _pushed(spark, sf_dir)
    return P.rolled_back(target, ledger, status)[0]


@query(
    "rollback_status",
    f"""with {_PUSH_SQL} select case when outcome = 'rejected' then 'PUSH_FAILED' else 'ROLLED_BACK' end as status, count(*) as n_records,
    case when outcome = 'rejected' then 'PARTIAL_FAILURE' else 'COMPLETED' end as run_status from outcomes group by all""",
)
def rollback_status(spark, sf_dir):
    target, ledger, status, _ = _pushed(spark, sf_dir)
    counts = P.rolled_back(target, ledger, status)[2].groupBy("status").agg(F.count(F.lit(1)).alias("n_records"))
    return counts.withColumn("run_status", R.delivered_status(F.when(F.col("status") == "PUSH_FAILED", F.col("n_records")).otherwise(0)))


# --- the target store -------------------------------------------------------------------

SITE = Entity("site", (Field("name"), Field("amount", "number"), Field("day", "date")))

_SITE_SQL = """ready as (select lpad(c_custkey::varchar, 12, '0') as record_id, 'C-' || c_custkey as record_key, 'run:' || c_custkey as idem_key, upper(c_name) as name, c_acctbal::double as amount, null::date as day from customer
  union all select 'o' || lpad(o_orderkey::varchar, 12, '0'), 'C-' || o_custkey, 'order:' || o_orderkey, 'order ' || o_orderkey, o_totalprice::double, o_orderdate::date from orders),
early as (select 'C-' || c_custkey as record_key, 'run:' || c_custkey as idem_key, c_name as name, c_acctbal::double as amount from customer where c_custkey % 4 = 1),
outcomes as (select *, case when record_key like '%7' then 'rejected' when idem_key in (select idem_key from early) then 'idempotent_replay' else 'accepted' end as outcome from ready)"""
_SITE_AFTER = """select record_key, arg_max({name: name, amount: amount, day: day}, age) as p from
  (select record_key, name, amount, null::date as day, '0' as age from early union all select record_key, name, amount, day, '1' || record_id from outcomes where %s) group by 1"""
_SITE_SHOWN = "record_key, p.name as name, p.amount as amount, strftime(p.day, '%Y-%m-%d') as day"


def _site_batches(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """What an earlier run wrote, and the batch of this one, as canonical texts."""
    c = table(spark, sf_dir, "customer")
    early = c.where("c_custkey % 4 = 1").selectExpr(
        "lpad(c_custkey, 12, '0') as record_id", "concat('C-', c_custkey) as record_key", "concat('run:', c_custkey) as idem_key",
        "c_name as name", "cast(c_acctbal as string) as amount", "cast(null as string) as day",
    )
    mine = c.selectExpr(
        "lpad(c_custkey, 12, '0') as record_id", "concat('C-', c_custkey) as record_key", "concat('run:', c_custkey) as idem_key",
        "upper(c_name) as name", "cast(c_acctbal as string) as amount", "cast(null as string) as day",
    )
    orders = table(spark, sf_dir, "orders").selectExpr(
        "concat('o', lpad(o_orderkey, 12, '0')) as record_id", "concat('C-', o_custkey) as record_key", "concat('order:', o_orderkey) as idem_key",
        "concat('order ', o_orderkey) as name", "cast(o_totalprice as string) as amount", "date_format(o_orderdate, 'yyyy-MM-dd') as day",
    )
    return early, mine.unionByName(orders)


def _site_store(spark, sf_dir):
    """(store, batch, outcomes) after an earlier run and one push that refuses some keys."""
    scratch = Scratch(spark)
    store = TargetStore(spark, f"{scratch.root}/target", buckets=8)
    early, batch = (scratch.write(b, "batch") for b in _site_batches(spark, sf_dir))
    push_batch(early, store, SITE, scratch)
    return store, batch, push_batch(batch, store, SITE, scratch, _reject()), scratch


def _site_rows(store) -> DataFrame:
    return store.current(SITE).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("store_push", f"with {_SITE_SQL} select {_SITE_SHOWN} from ({_SITE_AFTER % "outcome = 'accepted'"})")
def store_push(spark, sf_dir):
    """Typed rows of the target after two pushes through the store."""
    store, *_ = _site_store(spark, sf_dir)
    return _site_rows(store)


@query("store_replay", f"with {_SITE_SQL} select case when outcome = 'rejected' then outcome else 'idempotent_replay' end as outcome, count(*) as n_records, count(*) filter (outcome = 'accepted') as n_first from outcomes group by 1")
def store_replay(spark, sf_dir):
    """The same batch again writes nothing: the ledger knows what the first push accepted."""
    store, batch, first, scratch = _site_store(spark, sf_dir)
    again = push_batch(batch, store, SITE, scratch, _reject()).select("record_id", "outcome")
    accepted = first.select("record_id", (F.col("outcome") == "accepted").alias("first"))
    return again.join(accepted, "record_id").groupBy("outcome").agg(F.count(F.lit(1)).alias("n_records"), F.count_if("first").alias("n_first"))


@query("store_retry", f"with {_SITE_SQL} select {_SITE_SHOWN} from ({_SITE_AFTER % "outcome <> 'idempotent_replay'"})")
def store_retry(spark, sf_dir):
    """What was refused goes through under its old keys, and files are merged in between."""
    store, batch, first, scratch = _site_store(spark, sf_dir)
    store.compact(SITE)
    failed = batch.join(first.where("outcome = 'rejected'").select("record_id"), "record_id", "left_semi")
    push_batch(scratch.write(failed, "failed"), store, SITE, scratch, failed=F.lit(True))
    return _site_rows(store)


@query(
    "store_rollback",
    f"""with {_SITE_SQL} select {_SITE_SHOWN}, (select count(*) from early where record_key not in (select record_key from outcomes where outcome <> 'rejected')) as n_ledger
    from ({_SITE_AFTER % 'false'}) where record_key not in (select record_key from outcomes where outcome <> 'rejected')""",
)
def store_rollback(spark, sf_dir):
    """The keys that the run has written are gone, their ledger entries with them."""
    store, batch, first, _ = _site_store(spark, sf_dir)
    store.delete(SITE, first.where("outcome <> 'rejected'").select(F.col("target_key").alias("record_key")))
    ledger = store.ledger(SITE).agg(F.count(F.lit(1)).alias("n_ledger"))
    return _site_rows(store).join(F.broadcast(ledger))


@query("store_listing", "select 'site' as entity, count(*) as n_rows from customer where c_custkey % 4 = 1 union all select 'nation', count(*) from nation")
def store_listing(spark, sf_dir):
    """All entities of a target with their rows."""
    scratch = Scratch(spark)
    store = TargetStore(spark, f"{scratch.root}/target", buckets=4)
    nation = Entity("nation", (Field("n_name"), Field("n_regionkey", "integer")))
    push_batch(scratch.write(_site_batches(spark, sf_dir)[0], "batch"), store, SITE, scratch)
    rows = table(spark, sf_dir, "nation").selectExpr("n_name", "n_regionkey", "cast(n_nationkey as string) as record_id", "n_name as record_key", "n_name as idem_key")
    push_batch(scratch.write(rows, "batch"), store, nation, scratch)
    return R.union_table([t.groupBy().agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("entity"), "n_rows") for n, t in store.listing(Contract((SITE, nation))).items()])


@query(
    "derived_tables",
    "select 'run-a' as run_id, 'second' as attempt, c_nationkey, count(*) as n_rows from customer where c_custkey % 2 = 0 group by 3 union all select 'run-b', 'first', c_nationkey, count(*) from customer group by 3",
)
def derived_tables(spark, sf_dir):
    """A run's second attempt replaces the rows of its first; other runs keep theirs."""
    c = table(spark, sf_dir, "customer")
    tables = RunTables(spark, f"{Scratch(spark).root}/runs")
    for run_id, attempt, rows in (("run-a", "first", c), ("run-b", "first", c), ("run-a", "second", c.where("c_custkey % 2 = 0"))):
        tables.save(run_id, {"records": rows.withColumn("attempt", F.lit(attempt))})
    return tables.read("records").groupBy("run_id", "attempt", "c_nationkey").agg(F.count(F.lit(1)).alias("n_rows"))


# --- results ----------------------------------------------------------------------------


@query(
    "run_stats",
    with_sql(
        _STATUS_SQL,
        f"""select count(distinct source_file) as files, count(*) as records, (select count(*) from judged where held) as reviews,
        count(*) filter (status = 'READY_TO_PUSH') as ready_to_push, 0::bigint as pushed, 0::bigint as push_failed, 'CONSULTANT_REVIEW' as run_status from statuses""",
    ),
)
def run_stats(spark, sf_dir):
    checked, status = _status(spark, sf_dir)
    held = checked.where("group_status = 'CONSULTANT_REVIEW'")
    return R.run_stats(status, held).withColumn("run_status", R.reconciled_status(F.col("reviews")))


@query(
    "record_preview",
    with_sql(_STATUS_SQL, "select record_id, status from statuses where status = 'READY_TO_PUSH'"),
)
def record_preview(spark, sf_dir):
    return R.preview(_status(spark, sf_dir)[1]).select("record_id", "status")


@query(
    "target_tables",
    "select case when c_custkey % 2 = 0 then 'party' else 'site' end as entity, count(*) as n_rows from customer where c_custkey % 3 = 0 group by 1",
)
def target_tables(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(
        "case when c_custkey % 2 = 0 then 'party' else 'site' end as entity", "case when c_custkey % 3 = 0 then 'PUSHED' else 'PUSH_FAILED' end as status"
    )
    return R.target_counts(rows)


@query(
    "source_tables",
    "select 'customer' as source_file, c_custkey + 2 as source_row_number, c_name as name from customer union all select 'supplier', s_suppkey + 2, s_name from supplier",
)
def source_tables(spark, sf_dir):
    frames = [
        table(spark, sf_dir, t).selectExpr(f"'{t}' as source_file", f"{k} + 2 as source_row_number", f"{n} as name")
        for t, k, n in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"))
    ]
    return R.source_table(R.union_table(frames))


@query(
    "union_of_columns",
    "select p_partkey as id, p_brand as brand, null::bigint as nation from part union all select s_suppkey, null, s_nationkey from supplier",
)
def union_of_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_brand as brand")
    supplier = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "cast(s_nationkey as bigint) as nation")
    return R.union_table([part, supplier])


@query("key_union", "select distinct event_type as key from events union select distinct 'u' || (user_id % 7) from events")
def key_union(spark, sf_dir):
    maps = table(spark, sf_dir, "events").select(
        F.create_map(F.col("event_type"), F.lit(1), F.concat(F.lit("u"), F.col("user_id") % 7), F.lit(2)).alias("row")
    )
    return R.all_keys(maps, "row")


@query(
    "activity_feed",
    """select strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at, type, message from (select distinct date_trunc('second', ts) as created_at, 'history' as type, event_type as message from events where event_id % 2 = 0
    union select date_trunc('second', ts), case when user_id % 2 = 0 then 'live' else 'history' end, event_type from events) order by created_at desc, type, message limit 160""",
)
def activity_feed(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type as message", "cast(date_trunc('second', ts) as timestamp_ntz) as created_at")
    history = e.where("event_id % 2 = 0").withColumn("type", F.lit("history"))
    live = e.withColumn("type", F.when(F.col("user_id") % 2 == 0, "live").otherwise("history"))
    feed = R.activity_feed(history, live)
    return feed.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("merged_targets", f"with {_AFTER_SQL} select count(*) as n_rows, min(record_key) as first_key, max(record_key) as last_key from after")
def merged_targets(spark, sf_dir):
    target, *_ = _pushed(spark, sf_dir)
    return target.agg(F.count(F.lit(1)).alias("n_rows"), F.min("record_key").alias("first_key"), F.max("record_key").alias("last_key"))


# --- the whole run ----------------------------------------------------------------------

_STEP_COLUMNS = "record_key, party_id, email, name, phone, balance, segment, since, active, n_members"


@query(
    "end_to_end",
    with_sql(
        MERGED_SQL,
        f"""select {_STEP_COLUMNS}, concat_ws(',', case when party_id is null then 'party_id:required' end, case when name is null then 'name:required' end) as violations,
        {_ANY_OPEN} as open_conflicts, case when {_ANY_OPEN} <> '' or party_id is null or name is null then 'CONSULTANT_REVIEW' else 'READY_TO_PUSH' end as status from keyed_merged""",
    ),
)
def end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are profiled, mapped, planned, standardised, grouped, merged and checked."""
    done = run(spark, sources(spark, sf_dir), party_contract())
    merged = done.by_entity["party"].merged
    codes = F.array_join(F.transform("violations", lambda v: F.concat_ws(":", v["field"], v["code"])), ",")
    return merged.select(
        "record_key", *shown(), "n_members", codes.alias("violations"), F.array_join("open_conflicts", ",").alias("open_conflicts"),
        F.col("group_status").alias("status"),
    )


@query(
    "two_sittings",
    """select 1 as sitting, 'MAPPING' as stage, 'CONSULTANT_REVIEW' as status, 1::bigint as n_open, null::bigint as n_ready, null as origins
    union all select 2, 'VALIDATING', 'READY_TO_PUSH', 0, count(*), min('o' || c_custkey % 3) || '-' || max('o' || c_custkey % 3) from customer""",
)
def two_sittings(spark, sf_dir):
    """A required field without a source is one question; the run stops there, and goes on with the answer."""
    base = party_contract().entity("party")
    contract = Contract((replace(base, fields=(*base.fields, Field("origin", required=True))),))
    source = crm(spark, sf_dir)
    source = source.withColumn("Zq", F.concat(F.lit("o"), F.regexp_extract("Cust No", "[0-9]+", 0).cast("int") % 3))
    tables = RunTables(spark, f"{Scratch(spark).root}/runs")
    first = advance(spark, tables, "run", [source], contract)
    queue = tables.read("queue", ["run"])
    told = {"decision_id": F.lit("d1"), "source_field": F.lit("Zq"), "actor": F.lit("clerk"), "decided_at": F.lit("2024-05-01 10:00:00")}
    told |= {n: F.col(n) for n in ("review_id", "reason_code", "entity", "target_field")}
    answers = queue.where("target_field = 'origin'").select(*[told.get(n, F.lit(None)).cast(t).alias(n) for n, t in V.DECISION_COLUMNS.items()])
    n_first = queue.agg(F.count(F.lit(1)).alias("n_open")).withColumns({"n_ready": F.lit(None).cast("bigint"), "origins": F.lit(None).cast("string")})
    shown = [Scratch(spark).write(n_first.select(F.lit(1).alias("sitting"), F.lit(first.stage).alias("stage"), F.lit(first.status).alias("status"), "*"), "first")]
    second = advance(spark, tables, "run", [source], contract, answers)
    waiting = tables.read("queue", ["run"]).agg(F.count(F.lit(1)).alias("n_open"))
    ready = tables.read("canonical_party", ["run"]).where("group_status = 'READY_TO_PUSH'")
    ready = ready.agg(F.count(F.lit(1)).alias("n_ready"), F.concat_ws("-", F.min("origin"), F.max("origin")).alias("origins"))
    shown.append(waiting.join(F.broadcast(ready)).select(F.lit(2).alias("sitting"), F.lit(second.stage).alias("stage"), F.lit(second.status).alias("status"), "*"))
    return R.union_table(shown)


@query(
    "enriched_items",
    with_sql(
        CANON_SQL,
        """select record_id, source_file, coalesce(party_id, email, record_id) as record_key, coalesce(name, '') as shown_name, party_id as shown_id from canon""",
    ),
)
def enriched_items(spark, sf_dir):
    """Questions that name a record only get its file, key and summary from it."""
    df = Scratch(spark).write(canonical(spark, sf_dir), "canonical")
    known = df.select(
        "record_id", "source_file", F.coalesce(record_key(entity(), df.columns), F.col("record_id")).alias("record_key"), record_summary(entity(), df.columns).alias("summary")
    )
    items = V.enrich(V.review_items(df.select("record_id"), reason_code="invalid_record", entity="party", record_id=F.col("record_id")), known)
    said = lambda name: F.try_element_at("summary", F.lit(name))
    return items.select("record_id", "source_file", "record_key", F.coalesce(said("name"), F.lit("")).alias("shown_name"), said("party_id").alias("shown_id"))


@query(
    "step_overrides",
    """select event_type as source_column, arg_max('op' || user_id, event_id) as operation, arg_max('p' || event_id, event_id) as param from events where user_id % 3 <> 0 group by 1""",
)
def step_overrides(spark, sf_dir):
    """Every event is a decision about the steps of a column, some without steps; the latest with steps counts."""
    e = table(spark, sf_dir, "events")
    given = {
        "decision_id": F.lpad(F.col("event_id").cast("string"), 12, "0"), "reason_code": F.lit("new_transformation"), "entity": F.lit("party"), "source_field": F.col("event_type"),
        "steps": F.when(F.col("user_id") % 3 != 0, F.array(F.struct(F.concat(F.lit("op"), "user_id").alias("operation"), F.create_map(F.lit("p"), F.concat(F.lit("p"), "event_id")).alias("params")))),
        "decided_at": F.lit("2024-05-01 10:00:00"),
    }
    told = V.step_overrides(e.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in V.DECISION_COLUMNS.items()]))
    step = F.element_at("steps", 1)
    return told.select("source_column", step["operation"].alias("operation"), F.element_at(step["params"], "p").alias("param"))


@query(
    "audit_trail",
    """select run_id, action, n_events, first_at from (select case when o_orderkey % 2 = 0 then 'even' else 'odd' end as run_id, o_orderstatus as action, count(*) as n_events,
      strftime(min(o_orderdate), '%Y-%m-%d') as first_at from orders group by 1, 2)""",
)
def audit_trail(spark, sf_dir):
    """Events of two runs, appended in two writes and read by run."""
    audit = AuditTrail(spark, f"{Scratch(spark).root}/audit")
    rows = table(spark, sf_dir, "orders").selectExpr(
        "case when o_orderkey % 2 = 0 then 'even' else 'odd' end as run_id", "cast(o_orderdate as timestamp_ntz) as created_at", "cast(o_orderkey as string) as record_id",
        "'agent' as actor", "o_orderstatus as action", "o_orderkey % 5 as part",
    )
    for part in ("part < 2", "part >= 2"):
        audit.append(rows.where(part).drop("part"))
    read = [audit.read(run_id) for run_id in ("even", "odd")]
    return R.union_table([r.groupBy("run_id", "action").agg(F.count(F.lit(1)).alias("n_events"), F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("first_at")) for r in read])


@query(
    "file_admission",
    """select c_custkey, 'file_' || c_custkey || ['.csv', '.XLSX', '.json', '', '.csv.gz'][c_custkey % 5 + 1] as source_file, c_custkey % 5 < 2 as accepted, c_custkey % 5 = 0 as readable,
    case c_custkey % 5 when 2 then 'Unsupported file type: .json' when 3 then 'Unsupported file type: unknown' when 4 then 'Unsupported file type: .gz' end as reason from customer""",
)
def file_admission(spark, sf_dir):
    """Which of many files are taken in, and why others are not."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".csv", ".XLSX", ".json", "", ".csv.gz")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    files = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("/in/day/file_"), "c_custkey", suffix).alias("path"))
    return admission(files).select("c_custkey", "source_file", "accepted", "readable", "reason")


@query(
    "contract_tables",
    """select 'region_' || n_regionkey as entity, n_regionkey::integer as entity_ordinal, lower(n_name) as field, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::integer as ordinal,
    case when n_nationkey % 2 = 0 then 'integer' else 'string' end as data_type, n_nationkey % 3 = 0 as required, 'the ' || lower(n_name) as alias from nation""",
)
def contract_tables(spark, sf_dir):
    """A contract text of all regions with their nations as fields, loaded and shown as tables."""
    fields = F.struct(
        "n_nationkey", F.lower("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "integer").otherwise("string").alias("data_type"),
        (F.col("n_nationkey") % 3 == 0).alias("required"), F.array(F.concat(F.lit("the "), F.lower("n_name"))).alias("aliases"),
    )
    # Metadata typed in by people: one row per region.
    regions = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(fields)).alias("fields")).orderBy("n_regionkey")
    texts = [r["text"] for r in regions.select(F.to_json(F.struct(F.concat(F.lit("region_"), "n_regionkey").alias("entity_name"), "fields")).alias("text")).collect()]
    loaded = load_contract("contract.json", '{"entities": [' + ", ".join(texts) + "]}")
    return contract_fields(spark, loaded).select("entity", "entity_ordinal", "field", "ordinal", "data_type", "required", F.element_at("aliases", 1).alias("alias"))
