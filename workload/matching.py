"""Entity detection and field matching over a catalog with one file per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcemeld.contract import Contract, contract_from_dict, contract_fields
from sourcemeld.functions.text import exact_label
from sourcemeld.operators import matching as M
from sourcemeld.operators.planning import enum_plan, unresolved_reviews
from sourcemeld.operators.skew import spread
from sourcemeld.session import Scratch
from workload.party import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# Header variants of the files: (column, inferred type); "{n}" is the customer's nation.
VARIANTS = {
    "crm-{k}.csv": [("Cust No", "string"), ("Full  Name", "string"), ("E-mail", "string"), ("Mobile Phone", "string"), ("Segment", "string")],
    "customer_{k}.csv": [("customer_number", "integer"), ("Company Name", "string"), ("Mail Address", "string"), ("Telephone", "integer"), ("Market Segment", "string"), ("Note {n}", "string")],
    "sales-{k}.csv": [("Order No", "string"), ("Customer Number", "string"), ("Order Date", "date"), ("Total Amount", "number"), ("Status", "string")],
    "orders_{k}.csv": [("order_id", "integer"), ("cust_id", "integer"), ("Date of Order", "date"), ("Total", "number"), ("Order State", "string"), ("Priority", "string")],
    "parts-{k}.csv": [("Part Number", "string"), ("Part Name", "string"), ("Brand", "string"), ("Kind", "string"), ("Retail Price", "number"), ("Shelf {n}", "integer")],
    "misc_{k}.csv": [("Code", "string"), ("Name", "string"), ("Value", "number"), ("Remark", "string")],
}


def trade_contract() -> Contract:
    def f(name, *aliases, kind="string", required=False, description=""):
        return {"name": name, "aliases": list(aliases), "data_type": kind, "required": required, "description": description}

    return contract_from_dict(
        {
            "entities": [
                {
                    "entity_name": "customer",
                    "description": "Buyer",
                    "fields": [
                        f("customer_id", "cust no", "customer number", required=True, description="Stable number"),
                        f("first_name", "given name"),
                        f("last_name", "surname"),
                        f("company_name", "full name", required=True),
                        f("email", "mail"),
                        f("phone", "mobile"),
                        f("segment", "market segment"),
                        f("tax_code", required=True),
                    ],
                },
                {
                    "entity_name": "orders",
                    "description": "Sale",
                    "fields": [
                        f("order_id", "order no", required=True),
                        f("customer_id", "cust id", required=True),
                        f("order_date", "date of order", kind="date"),
                        f("total_price", "total", kind="number"),
                        f("status"),
                        f("delivery_date", kind="date", required=True),
                    ],
                },
                {
                    "entity_name": "part",
                    "description": "Item",
                    "fields": [
                        f("part_id", "part number", required=True),
                        f("part_name"),
                        f("brand"),
                        f("part_type", "type"),
                        f("price", kind="number"),
                    ],
                },
            ]
        }
    )


def _variant_rows():
    return [
        (v, file, i, column, kind)
        for v, (file, columns) in enumerate(VARIANTS.items())
        for i, (column, kind) in enumerate(columns)
    ]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, column, ordinal, inferred_type): the headers of one file per customer."""
    shapes = F.broadcast(
        spark.createDataFrame(_variant_rows(), "variant long, file string, ordinal int, name string, inferred_type string")
    )
    c = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_nationkey", "case when c_custkey % 60 = 5 then 5L else c_custkey % 5 end as variant"
    )
    # A small file is few splits, and each of its rows becomes a file of five columns.
    return spread(c, "c_custkey").join(shapes, "variant").select(
        F.replace("file", F.lit("{k}"), F.col("c_custkey").cast("string")).alias("source_file"),
        F.replace("name", F.lit("{n}"), F.col("c_nationkey").cast("string")).alias("column"),
        "ordinal",
        "inferred_type",
    )


# --- SQL building blocks ----------------------------------------------------------------


def lcs_sql(a: str, b: str) -> str:
    return (
        f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: [i]), "
        f"lambda best, i: list_reduce(list_transform(range(1, len({b}) + 1), lambda j: [j]), "
        f"lambda acc, j: list_append(acc, greatest(acc[len(acc)], best[j[1] + 1], best[j[1]] + "
        f"(case when substr({b}, j[1], 1) = substr({a}, i[1], 1) then 1 else 0 end))), [0::bigint]), "
        f"list_transform(range(0, len({b}) + 1), lambda z: 0::bigint))[len({b}) + 1]"
    )


def ratio_sql(a: str, b: str) -> str:
    return f"(case when {a} = {b} then 1::double when len({a}) * len({b}) = 0 then 0::double else 2::double * {lcs_sql(a, b)} / (len({a}) + len({b})) end)"


def scored_sql(pairs: str, out: str) -> str:
    """CTEs from ``pairs`` (.., a, b) to ``out`` (.., score)."""
    own = "lambda x: not list_contains"
    return f"""
{out}_w as (select *, list_sort(list_distinct(string_split(a, ' '))) as wa, list_sort(list_distinct(string_split(b, ' '))) as wb from {pairs}),
{out}_s as (select *, list_filter(wa, lambda x: list_contains(wb, x)) as sh, list_filter(wa, {own}(wb, x)) as oa, list_filter(wb, {own}(wa, x)) as ob from {out}_w),
{out}_t as (select *, array_to_string(sh, ' ') as s, array_to_string(list_concat(sh, oa), ' ') as sa, array_to_string(list_concat(sh, ob), ' ') as sb from {out}_s),
{out} as (select *, greatest({ratio_sql('a', 'b')}, case when len(sh) > 0 and (len(oa) = 0 or len(ob) = 0) then 1::double
   when len(sh) > 0 then greatest({ratio_sql('sa', 'sb')}, 2::double * len(s) / (len(s) + len(sa)), 2::double * len(s) / (len(s) + len(sb)))
   else {ratio_sql('sa', 'sb')} end) as score from {out}_t)"""


def _quote(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _contract_values(contract: Contract) -> str:
    rows = []
    for i, e in enumerate(contract.entities):
        for k, f in enumerate(e.fields):
            for text in (f.name, *f.aliases):
                words = " ".join((f.name, f.description, *f.aliases))
                rows.append(
                    f"({_quote(e.name)}, {i}, {_quote(f.name)}, {k}, {_quote(text)}, {_quote(f.data_type)}, {_quote(words)}, {text == f.name})"
                )
    return f"contract(entity, entity_ordinal, field, field_ordinal, label_text, data_type, words, is_name) as (values {', '.join(rows)})"


_NORMAL = "regexp_replace(trim(lower(translate({0}, '_-', '  '))), '\\s+', ' ', 'g')"
CATALOG_SQL = (
    "shapes(variant, file, ordinal, name, inferred_type) as (values "
    + ", ".join(f"({v}, {_quote(f)}, {i}::int, {_quote(c)}, {_quote(t)})" for v, f, i, c, t in _variant_rows())
    + "), catalog as (select replace(file, '{k}', c_custkey::varchar) as source_file, replace(name, '{n}', c_nationkey::varchar) as col, ordinal, inferred_type "
    "from customer join shapes on variant = case when c_custkey % 60 = 5 then 5 else c_custkey % 5 end)"
)
SCORES_SQL = (
    CATALOG_SQL
    + ", "
    + _contract_values(trade_contract())
    + f""", labels as (select distinct lower(trim(translate(col, '_-', '  '))) as query from catalog),
pairs as (select query, entity, entity_ordinal, field, field_ordinal, {_NORMAL.format('query')} as a, {_NORMAL.format('label_text')} as b from labels, contract),
{scored_sql('pairs', 'sc')},
scores as materialized (select query, entity, entity_ordinal, field, field_ordinal, max(score) as raw_score, bool_or(a = b) as exact from sc group by all)"""
)


def _scores(spark, sf_dir):
    """Label scores are small and read by several operators, so they are written once."""
    cat = catalog(spark, sf_dir)
    contract = trade_contract()
    return cat, contract, Scratch(spark).write(M.label_scores(M.distinct_labels(cat), contract), "scores")


@query("label_similarity", f"with {SCORES_SQL} select query, entity, field, round(raw_score, 6) as raw_score, exact from scores")
def label_similarity(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    scores = M.label_scores(M.distinct_labels(cat), trade_contract())
    return scores.select("query", "entity", "field", F.round("raw_score", 6).alias("raw_score"), "exact")


def _described(e) -> str:
    """Name, description, field names, their descriptions, their aliases."""
    told = [e.name, e.description] + [f.name for f in e.fields]
    for f in e.fields:
        told += [f.description] if f.description else []
    for f in e.fields:
        told += list(f.aliases)
    return " | ".join(told)


_DESCRIPTIONS = ", ".join(
    f"({_quote(e.name)}, {i}, {_quote(_described(e))})" for i, e in enumerate(trade_contract().entities)
)
ENTITIES_SQL = (
    SCORES_SQL
    + f""", best as (select query, entity, entity_ordinal, max(raw_score) as best from scores group by all),
per_file as (select source_file, entity, entity_ordinal, avg(best) as mean, avg(case when best >= 0.72 then 1.0 else 0.0 end) as covered
  from catalog join best on query = lower(trim(translate(col, '_-', '  '))) group by all),
profiled as (select source_file, entity, entity_ordinal,
  round((least(1.0, 0.55 * mean + 0.39 * covered + case when contains({_NORMAL.format('source_file')}, {_NORMAL.format('entity')}) then 0.06 else 0 end))::decimal(38, 20), 4)::double as score from per_file),
top1 as (select *, row_number() over w as rn, score - coalesce(lead(score) over w, 0) as margin from profiled window w as (partition by source_file order by score desc, entity_ordinal)),
descriptions(entity, entity_ordinal, description) as (values {_DESCRIPTIONS}),
texts as (select source_file, source_file || ' | ' || string_agg(col, ' | ' order by ordinal) as text from catalog
  where source_file in (select source_file from top1 where rn = 1 and not (score >= 0.86 or margin >= 0.08)) group by 1),
dpairs as (select source_file, entity, entity_ordinal, {_NORMAL.format('text')} as a, {_NORMAL.format('description')} as b from texts, descriptions),
{scored_sql('dpairs', 'dsc')},
top2 as (select source_file, entity, score, row_number() over w as rn, score - coalesce(lead(score) over w, 0) as margin
  from (select * replace (round(score::decimal(38, 20), 4)::double as score) from dsc) window w as (partition by source_file order by score desc, entity_ordinal)),
entities as materialized (select source_file, entity, score, margin, 'auto' as decision from top1 where rn = 1 and (score >= 0.86 or margin >= 0.08)
  union all select source_file, case when score >= 0.6 then entity end, score, margin,
    case when score >= 0.6 and margin >= 0.06 then 'described' when score >= 0.6 then 'fallback' else 'review' end from top2 where rn = 1)"""
)


@query(
    "entity_detect",
    f"with {ENTITIES_SQL} select source_file, entity, score, round(margin, 4) as margin, decision from entities",
)
def entity_detect(spark, sf_dir):
    cat, contract, scores = _scores(spark, sf_dir)
    return M.detect_entities(cat, contract, scores).withColumn("margin", F.round("margin", 4))


def _choices(spark, sf_dir):
    """Outside answers for the files that the ladder leaves open."""
    return table(spark, sf_dir, "customer").where("c_custkey % 60 = 5").selectExpr(
        "concat('misc_', c_custkey, '.csv') as source_file", "case when c_custkey % 7 = 0 then 'nobody' else 'part' end as entity"
    )


@query(
    "entity_choices",
    f"""with {ENTITIES_SQL}, choices as (select 'misc_' || c_custkey || '.csv' as source_file from customer where c_custkey % 60 = 5 and c_custkey % 7 <> 0)
    select e.source_file, case when e.decision in ('fallback', 'review') and c.source_file is not null then 'part' else entity end as entity,
    case when e.decision in ('fallback', 'review') and c.source_file is not null then 'chosen' else decision end as decision
    from entities e left join choices c using (source_file)""",
)
def entity_choices(spark, sf_dir):
    cat, contract, scores = _scores(spark, sf_dir)
    found = M.detect_entities(cat, contract, scores, choices=_choices(spark, sf_dir))
    return found.select("source_file", "entity", "decision")


# Words of each domain, the pairs that speak against a match and the domains that speak for one.
_DOMAINS = {
    "identifier": "id identifier number no code key",
    "name": "name given first last surname family fname",
    "email": "email mail",
    "phone": "phone mobile telephone tel contact",
    "date": "date dob birth birthday joining doj hire start joined",
    "status": "status state active inactive",
    "type": "type kind category",
    "organization": "department dept team org organisation division unit business",
}
_PAIRS_AGAINST = "name identifier, identifier name, email phone, phone email, date identifier, date status, type status"
_DOMAINS_FOR = "identifier name email phone date organization status"


def _domain_list(words: str) -> str:
    tests = ", ".join(
        f"case when list_has_any({words}, [{', '.join(_quote(w) for w in vocabulary.split())}]) then '{d}' end"
        for d, vocabulary in _DOMAINS.items()
    )
    return f"list_filter([{tests}], lambda x: x is not null)"


_SPLIT = "string_split(regexp_replace(trim(lower(translate({0}, '_-/', '   '))), '\\s+', ' ', 'g'), ' ')"
_AGAINST = " or ".join(f"(list_contains(mine, '{a}') and list_contains(theirs, '{b}'))" for a, b in (pair.split() for pair in _PAIRS_AGAINST.split(", ")))
_AGREED = " or ".join(f"(list_contains(mine, '{d}') and list_contains(theirs, '{d}'))" for d in _DOMAINS_FOR.split())
CANDIDATES_SQL = (
    ENTITIES_SQL
    + f""", facts as (select entity, field, any_value(data_type) as data_type, {_domain_list(_SPLIT.format('any_value(words)'))} as theirs,
  (field like '%first_name%' or field like '%last_name%') and entity = 'customer' as is_part,
  list(lower(trim(translate(label_text, '_-', '  ')))) filter (not is_name) as aliases from contract group by entity, field),
ranked as (select *, row_number() over (partition by query, entity order by raw_score desc, field_ordinal) as raw_rank from scores),
judged as (select r.*, f.data_type, f.theirs, f.is_part, {_SPLIT.format('query')} as words, {_domain_list(_SPLIT.format('query'))} as mine,
  case when query = lower(translate(r.field, '_', ' ')) then 'exact name' when list_contains(f.aliases, query) then 'exact alias' else 'similarity' end as match
  from ranked r join facts f using (entity, field) where raw_rank <= 5),
lowered as (select *, raw_score * (case when len(mine) > 0 and len(theirs) > 0 and not list_has_any(mine, theirs) then 0.15::double else 1 end)
  * (case when list_contains(mine, 'name') and is_part and not list_has_any(words, ['first', 'last', 'given', 'surname', 'family', 'fname']) then 0.55::double else 1 end)
  * (case when {_AGAINST} then 0.42::double else 1 end) as s from judged),
adjusted as (select *, round((case when {_AGREED} then least(1.0::double, s + 0.08::double) else s end)::decimal(38, 20), 4)::double as score from lowered),
candidates as materialized (select *, row_number() over w as rank, score - coalesce(lead(score) over w, 0) as margin
  from adjusted window w as (partition by query, entity order by score desc, raw_rank)),
choices as materialized (select c.source_file, c.col as source_column, c.ordinal, c.inferred_type, x.*
  from catalog c join entities e on c.source_file = e.source_file and e.entity is not null
  join candidates x on x.query = lower(trim(translate(c.col, '_-', '  '))) and x.entity = e.entity),
fit as (select *, inferred_type in ('unknown', 'string') or inferred_type = data_type or (inferred_type in ('integer', 'number') and data_type in ('integer', 'number'))
  or (inferred_type = 'date' and data_type in ('date', 'datetime')) as fits from choices where rank = 1),
staged as materialized (select *, case when match <> 'similarity' or (score >= 0.86 and margin >= 0.08 and fits) then 'auto'
  when score >= 0.4 and fits and (margin < 0.15 or score < 0.86) then 'undecided' else 'dropped' end as stage from fit)"""
)


def _columns(spark, sf_dir):
    cat, contract, scores = _scores(spark, sf_dir)
    entities = Scratch(spark).write(M.detect_entities(cat, contract, scores), "entities")
    return cat, contract, entities, M.column_candidates(cat, entities, M.match_candidates(scores, contract))


_SHOWN = ["entity", "source_file", "source_column", "target_field", "confidence", "match", "decision"]


@query(
    "match_candidates",
    f"with {CANDIDATES_SQL} select query, entity, field as target_field, score, round(raw_score::decimal(38, 20), 4)::double as raw_score, match, rank::int as rank from candidates",
)
def match_candidates(spark, sf_dir):
    _, contract, scores = _scores(spark, sf_dir)
    return M.match_candidates(scores, contract).select("query", "entity", "target_field", "score", "raw_score", "match", "rank")


@query(
    "field_match",
    f"""with {CANDIDATES_SQL}, others as (select query, entity, string_agg(field || '=' || printf('%.4f', score), ',' order by rank) as alternatives from candidates where rank in (2, 3) group by all)
    select s.entity, source_file, source_column, case when stage <> 'dropped' then field end as target_field, score as confidence, round(margin, 4) as margin, match,
    case stage when 'undecided' then 'fallback' else stage end as decision, alternatives from staged s left join others o on o.query = s.query and o.entity = s.entity""",
)
def field_match(spark, sf_dir):
    *_, choices = _columns(spark, sf_dir)
    shown = F.array_join(
        F.transform("alternatives", lambda a: F.concat(a["field"], F.lit("="), F.format_string("%.4f", a["score"]))), ","
    )
    return M.decide_fields(choices).select(*_SHOWN, "margin", shown.alias("alternatives"))


@query(
    "proposal_admission",
    f"""with {CANDIDATES_SQL}, proposed(entity, source_column, target_field, needs_review) as (values ('customer', 'Telephone', 'email', false), ('customer', 'Company Name', 'last_name', false),
      ('orders', 'Total Amount', 'status', true), ('orders', 'Order State', 'invented', false), ('part', 'Kind', 'brand', false)),
    proposals as (select p.* from proposed p),
    valid as materialized (select c.entity, c.source_file, c.source_column, min(p.target_field) as target from proposals p join choices c
      on p.entity = c.entity and p.source_column = c.source_column and p.target_field = c.field where not needs_review group by all)
    select s.entity, s.source_file, s.source_column, case when stage = 'undecided' then coalesce(v.target, field) when stage = 'auto' then field end as target_field, score as confidence, match,
    case when stage = 'undecided' and v.target is not null then 'proposed' when stage = 'undecided' then 'fallback' else stage end as decision
    from staged s left join valid v on s.entity = v.entity and s.source_file = v.source_file and s.source_column = v.source_column""",
)
def proposal_admission(spark, sf_dir):
    *_, choices = _columns(spark, sf_dir)
    proposals = spark.createDataFrame(
        [
            ("customer", "Telephone", "email", False), ("customer", "Company Name", "last_name", False),
            ("orders", "Total Amount", "status", True), ("orders", "Order State", "invented", False), ("part", "Kind", "brand", False),
        ],
        "entity string, source_column string, target_field string, needs_review boolean",
    )
    return M.decide_fields(choices, proposals=proposals).select(*_SHOWN)


@query(
    "mapping_override",
    f"""with {CANDIDATES_SQL} select entity, source_file, source_column, case when entity = 'part' and source_column = 'Kind' then 'part_type'
      when entity = 'customer' and source_column = 'Mail Address' then 'email' when stage <> 'dropped' then field end as target_field,
    case when (entity = 'part' and source_column = 'Kind') or (entity = 'customer' and source_column = 'Mail Address') then 1.0::double else score end as confidence, match,
    case when (entity = 'part' and source_column = 'Kind') or (entity = 'customer' and source_column = 'Mail Address') then 'override' when stage = 'undecided' then 'fallback' else stage end as decision from staged""",
)
def mapping_override(spark, sf_dir):
    *_, choices = _columns(spark, sf_dir)
    overrides = spark.createDataFrame(
        [("part", "Kind", "part_type"), ("customer", "Mail Address", "email")], "entity string, source_column string, target_field string"
    )
    return M.decide_fields(choices, overrides=overrides).select(*_SHOWN)


_REQUIRED = ", ".join(
    f"({_quote(e.name)}, {_quote(f.name)})" for e in trade_contract().entities for f in e.fields if f.required
)
GAPS_SQL = (
    CANDIDATES_SQL
    + f""", offered as (select entity, string_agg(distinct col, ',' order by col) as available from catalog join entities using (source_file) where entity is not null group by 1),
gaps as (select r.entity, r.field as target_field from (values {_REQUIRED}) r(entity, field) where r.entity in (select entity from entities)
  and not exists (select 1 from staged s where s.entity = r.entity and s.field = r.field and stage <> 'dropped'))"""
)


@query(
    "required_coverage",
    f"with {GAPS_SQL} select entity, target_field, available from gaps join offered using (entity)",
)
def required_coverage(spark, sf_dir):
    cat, contract, entities, choices = _columns(spark, sf_dir)
    gaps = M.missing_required(M.decide_fields(choices), contract_fields(spark, contract), cat, entities)
    return gaps.select("entity", "target_field", F.array_join("available_source_fields", ",").alias("available"))


@query(
    "suppressed_reviews",
    f"""with {GAPS_SQL} select s.entity, source_file, source_column, not exists (select 1 from choices c join gaps g on g.entity = c.entity and g.target_field = c.field
      where c.source_file = s.source_file and c.source_column = s.source_column and c.rank <= 3) as suppressed from staged s where stage = 'dropped'""",
)
def suppressed_reviews(spark, sf_dir):
    """Weak columns as mapping reviews: which of them would be asked, which suppressed."""
    cat, contract, entities, choices = _columns(spark, sf_dir)
    mapping = Scratch(spark).write(M.decide_fields(choices), "mapping")
    gaps = M.missing_required(mapping, contract_fields(spark, contract), cat, entities)
    weak = mapping.where("decision = 'dropped'").select(
        "entity", "source_file", "source_column", F.lit(None).cast("string").alias("target_field"),
        F.concat(F.array("best_field"), F.col("alternatives.field")).alias("candidates"),
    )
    return M.split_mapping_reviews(weak, gaps).select("entity", "source_file", "source_column", "suppressed")


@query(
    "available_columns",
    f"with {GAPS_SQL} select entity, available from offered",
)
def available_columns(spark, sf_dir):
    cat, _, entities, _ = _columns(spark, sf_dir)
    return M.available_columns(cat, entities).select("entity", F.array_join("available_source_fields", ",").alias("available"))


# --- vectors ----------------------------------------------------------------------------


def _topics(n: int) -> Contract:
    return contract_from_dict({"entities": [{"entity_name": "topic", "fields": [{"name": f"topic {i}"} for i in range(n)]}]})


@query(
    "vector_rank",
    f"""with parts as (select label, generate_subscripts(embedding, 1) as pos, unnest(embedding)::double as x from embeddings),
    centres as (select label, list(m order by pos) as centre from (select label, pos, avg(x) as m from parts group by all) group by label),
    grid as (select e.vec_id, c.label, 'vec' || e.vec_id as a, 'topic ' || c.label as b, e.embedding::double[] as v, c.centre from embeddings e, centres c),
    {scored_sql('grid', 'sc')},
    best as (select vec_id, label, greatest(score, list_cosine_similarity(v, centre)) as s from sc),
    ranked as (select *, row_number() over w as rn, s - lead(s) over w as margin from best window w as (partition by vec_id order by s desc, label))
    select vec_id, 'topic ' || label as field, round(s, 4) as score, round(margin, 4) as margin from ranked where rn = 1""",
)
def vector_rank(spark, sf_dir):
    """Columns known only by vectors are re-ranked by the vectors of the target labels."""
    e = table(spark, sf_dir, "embeddings")
    count = e.select("label").distinct().count()
    contract = _topics(count)
    means = (
        e.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "m")))["m"].alias("vector"))
        .select(F.concat(F.lit("topic "), "label").alias("label"), "vector")
    )
    own = e.select(F.concat(F.lit("vec"), "vec_id").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    scores = M.label_scores(own.select(exact_label(F.col("label")).alias("query")), contract)
    near = M.rerank_by_vectors(scores, contract, means.unionByName(own))
    order = Window.partitionBy("query").orderBy(F.desc("raw_score"), "field_ordinal")
    ranked = near.withColumns({"rn": F.row_number().over(order), "next": F.lead("raw_score").over(order)}).where("rn = 1")
    return ranked.select(
        F.substring("query", 4, 20).cast("bigint").alias("vec_id"), "field", F.round("raw_score", 4).alias("score"),
        F.round(F.col("raw_score") - F.col("next"), 4).alias("margin"),
    )


# --- enumerated values ------------------------------------------------------------------

_ALLOWED = ["URGENT", "HIGH", "MEDIUM", "LOW", "ACTIVE", "INACTIVE"]
_EXISTING = {"p1": "URGENT", "p9": "NOWHERE"}
_VALUES = "case o_orderkey % 8 when 0 then o_orderpriority when 1 then 'p1' when 2 then 'p9' when 3 then ' High ' when 4 then concat('currently ', o_orderstatus) when 5 then concat('left_', o_custkey % 50) when 6 then concat(substr(o_orderpriority, 3), ' prio') else concat('zz', o_custkey) end"
_LIST = "[" + ", ".join(f"'{a}'" for a in _ALLOWED) + "]"
ENUM_SQL = f"""vals as (select distinct trim({_VALUES}) as value from orders),
tiers as (select value, {_NORMAL.format('value')} as nv, case when value = 'p1' then 'URGENT' end as known, list_filter({_LIST}, lambda x: lower(x) = lower(value))[1] as equal,
  case when list_has_any(string_split({_NORMAL.format('value')}, ' '), ['active', 'working', 'employed', 'current', 'currently']) then 'ACTIVE'
    when list_has_any(string_split({_NORMAL.format('value')}, ' '), ['inactive', 'left', 'terminated', 'former', 'exited', 'resigned', 'retired']) then 'INACTIVE' end as word from vals),
epairs as (select value, nv as a, lower(unnest({_LIST})) as b, unnest({_LIST}) as option, unnest(range(6)) as place from tiers where known is null and equal is null and word is null),
{scored_sql('epairs', 'esc')},
top as (select value, arg_max(option, (score, -place)) as option, max(score) as score from esc group by 1),
plan as (select t.value, coalesce(known, equal, word, case when score >= 0.6 then option end) as target,
  case when known is not null then 'existing' when equal is not null then 'equal' when word is not null then 'word' when score >= 0.6 then 'lexical' else 'unresolved' end as tier,
  round(score, 4) as score from tiers t left join top using (value))"""


def _enum_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.expr(_VALUES).alias("value"))


@query("enum_plan", f"with {ENUM_SQL} select * from plan")
def enum_plan_query(spark, sf_dir):
    return enum_plan(_enum_values(spark, sf_dir), _ALLOWED, _EXISTING)


@query(
    "enum_answers",
    f"""with {ENUM_SQL} select value, case when tier = 'unresolved' and value = 'p9' then 'LOW' else target end as target,
    case when tier = 'unresolved' and value = 'p9' then 'answered' else tier end as tier from plan""",
)
def enum_answers(spark, sf_dir):
    values = _enum_values(spark, sf_dir)
    answers = values.selectExpr("trim(value) as value").where("value in ('p9') or value like 'zz%'").distinct().selectExpr(
        "value", "case when value = 'p9' then 'LOW' else 'NOT ALLOWED' end as target"
    )
    return enum_plan(values, _ALLOWED, _EXISTING, answers).drop("score")


@query(
    "unresolved_values",
    f"with {ENUM_SQL} select 'orders.csv' as source_file, value as unresolved_value from plan where tier = 'unresolved'",
)
def unresolved_values(spark, sf_dir):
    plan = enum_plan(_enum_values(spark, sf_dir), _ALLOWED, _EXISTING)
    return unresolved_reviews(plan.withColumn("owner", F.lit(0)), {0: ("orders", "orders.csv", "prio", "priority")}).select("source_file", "unresolved_value")
