"""The registered corpus queries and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcemeld.llm.bpe_codec import encode
from sourcemeld.llm.centroid_clusters import clusters
from sourcemeld.llm.decontaminate import find_leaks
from sourcemeld.llm.exact_dedup import find_copies
from sourcemeld.llm.integers import long_sum
from sourcemeld.llm.language_id import held_out, identify, learn
from sourcemeld.llm.minhash_dedup import components
from sourcemeld.llm.quality import fit, measure, score
from sourcemeld.llm.repeat_removal import remove_repeats, removed_bytes
from sourcemeld.llm.sharding import TABLE_SIZE, fill_table, place
from sourcemeld.llm.token_counts import count_tokens
from sourcemeld.llm.top_k import nearest
from sourcemeld.llm.url_filter import filter_urls
from sourcemeld.llm.vector_codes import compress
from sourcemeld.llm.vocabulary import load_vocabulary
from sourcemeld.operators.skew import lookup_join, sized_join
from sourcemeld.session import Scratch
from sourcemeld.settings import LIMITS

QUERIES, SQL = {}, {}

#: Vocabulary files; the folder is the installed package's.
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COUNT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DUPLICATE_SQL = r"""
with recursive lowered as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents
), worded as (
  select doc_id, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as w from lowered
), shingled as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) end as s
  from worded
), sets as (
  select s, min(doc_id) as node from (select doc_id, list_sort(s) as s from shingled) where len(s) > 0 group by s
), postings as (
  select node, len(s) as n, unnest(s) as g from sets
), shared as (
  select a.node as a, b.node as b, count(*) as common, any_value(a.n + b.n) as total
  from postings a join postings b on a.g = b.g and a.node < b.node
  group by a.node, b.node
), links as (
  select a, b from shared where 100 * common >= 75 * (total - common)
), steps(node, root) as (
  select node, node from sets
  union
  select case when l.a = steps.node then l.b else l.a end, root from steps join links l on l.a = steps.node or l.b = steps.node
), roots as (
  select node, min(root) as root from steps group by node
)
select doc_id, len(shingled.s)::bigint as n_shingles, coalesce(root, doc_id) as component_id, doc_id = coalesce(root, doc_id) as kept
from shingled left join sets on list_sort(shingled.s) = sets.s left join roots using (node)
"""


@query("op1_near_duplicates", DUPLICATE_SQL)
def op1_near_duplicates(spark, sf_dir):
    return components(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))


@query("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, load_vocabulary(COUNT_VOCABULARY))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


SHARDS = [f"shard-{i:03d}" for i in range(64)]

# The filled table stands in the SQL as a list; tests hold it against a plain rebuild.
SHARD_SQL = f"""
with placed as (
  select doc_id, (('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint % {TABLE_SIZE})::integer as slot from documents
), filled as (select {fill_table(SHARDS)} as shard_of)
select doc_id, slot, 'shard-' || lpad(cast(shard_of[slot + 1] as varchar), 3, '0') as shard from placed, filled
"""


@query("op4_sharding", SHARD_SQL)
def op4_sharding(spark, sf_dir):
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


@query("op5_bpe_codec")
def op5_bpe_codec(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, load_vocabulary(MULTI_RANKS), decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
BLOCKED_HOSTS = [f"{name}.example.{zone}" for name in ("casino-win", "cheap-pills", "free-bets", "spam-farm") for zone in ("com", "net", "org")]

URL_SQL = r"""
with parts as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), rules(rule_host, rule_path, judged) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), listed(listed_host) as (
  values ('casino-win.example.com'), ('casino-win.example.net'), ('casino-win.example.org'),
    ('cheap-pills.example.com'), ('cheap-pills.example.net'), ('cheap-pills.example.org'),
    ('free-bets.example.com'), ('free-bets.example.net'), ('free-bets.example.org'),
    ('spam-farm.example.com'), ('spam-farm.example.net'), ('spam-farm.example.org')
), fitting as (
  select page_id, rule_host || rule_path as rule, judged,
    row_number() over (partition by page_id order by length(rule_host || rule_path) desc, length(rule_host) desc) as place
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule, coalesce(judged, case when exists (
    select 1 from listed where host = listed_host or ends_with(host, '.' || listed_host)) then 'block' else 'allow' end) as verdict
from parts left join (select * from fitting where place = 1) using (page_id)
"""


@query("op7_url_filter", URL_SQL)
def op7_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES, BLOCKED_HOSTS, Scratch(spark), keep=["page_id"])


@query("op8_repeat_removal")
def op8_repeat_removal(spark, sf_dir):
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark), length=50)
    return cut.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed_bytes(F.col("removed")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op9_decontamination")
def op9_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), Scratch(spark)).drop("print")


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    predicted = identify(docs.select("doc_id", "text"), learn(docs))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op6_quality")
def op6_quality(spark, sf_dir):
    scratch = Scratch(spark)
    measured = measure(table(spark, sf_dir, "documents"), scratch)
    scored = score(measured, fit(measured, table(spark, sf_dir, "labels"), scratch))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


NEAREST_SQL = """
with whole as (
  select vec_id, [floor(256 * x::double) for x in embedding] as v from embeddings
  where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is not null and isfinite(x)]) = len(embedding)
), scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from whole q join whole c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 5
"""


@query("op2_top_k", NEAREST_SQL)
def op2_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    usable = vectors.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = usable.select("vec_id", F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("v"))
    return nearest(whole.where("vec_id % 50 = 0"), whole, k=5)


def _rounds(n: int, assign: str, update: str) -> str:
    """Steps of an iteration, written out: assignment i by the state before it, then state i + 1."""
    steps = [assign.format(i=0)]
    for i in range(n):
        steps += [update.format(i=i, j=i + 1), assign.format(i=i + 1)]
    return ", ".join(steps)


WHOLE_SQL = """
  select vec_id, label, embedding from embeddings
  where embedding is not null and len(embedding) {size} and len([x for x in embedding if x is not null and isfinite(x)]) = len(embedding)
"""
# Floor of a quotient: the division of whole numbers rounds towards zero.
FLOOR_SQL = "((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::bigint"

CLUSTER_ROUND_SQL = """a{i} as (
  select vec_id, arg_min(c, (far, c)) as c, min(far) as far from (
    select vec_id, c, sum((p.v - k.v) * (p.v - k.v))::bigint as far from parts p join c{i} k using (d) group by vec_id, c
  ) group by vec_id
)"""
CLUSTER_NEXT_SQL = """c{j} as (
  select k.c, k.d, coalesce(n.v, k.v) as v from c{i} k left join (select c, d, FLOOR as v from a{i} join parts using (vec_id) group by c, d) n on k.c = n.c and k.d = n.d
)""".replace("FLOOR", FLOOR_SQL)

CLUSTER_SQL = f"""
with whole as ({WHOLE_SQL.format(size="= 64")}), parts as (
  select vec_id, unnest(range(1, 65)) as d, unnest([floor(64 * x::double)::bigint for x in embedding]) as v from whole
), seeds as (
  select vec_id, row_number() over (order by sha256('1:' || vec_id)) - 1 as c from whole qualify c < 16
), c0 as (select c, d, v from seeds join parts using (vec_id)),
{_rounds(3, CLUSTER_ROUND_SQL, CLUSTER_NEXT_SQL)}, printed as (
  select c, sha256(string_agg(v::varchar, ',' order by d)) as print from c3 group by c
)
select vec_id, c::integer as cluster, far as distance, sum(far) over (partition by c)::bigint as cluster_inertia, sum(far) over ()::bigint as inertia, print as centroid_sha256
from a3 join printed using (c)
"""


@query("op11_centroid_clusters", CLUSTER_SQL)
def op11_centroid_clusters(spark, sf_dir):
    found, centroids = clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), Scratch(spark), k=16, rounds=3, scale=64, width=64)
    inertia = found.groupBy("cluster").agg(long_sum("distance").alias("cluster_inertia"))  # a row per centroid
    total = inertia.agg(long_sum("cluster_inertia").alias("inertia"))
    prints = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids)], "cluster int, centroid string")
    told = inertia.join(prints, "cluster").join(F.broadcast(total)).withColumn("centroid_sha256", F.sha2("centroid", 256))
    return found.select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


COPIES_SQL = r"""
with normal as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents
)
select doc_id, min(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
  row_number() over (partition by body order by doc_id) = 1 as kept, sha256(body) as text_sha256
from normal
"""


@query("op12_exact_dedup", COPIES_SQL)
def op12_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_copies(docs, Scratch(spark), content=F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


CODES_ROUND_SQL = """a{i} as (
  select vec_id, p, arg_min(e, (far, e)) as e, min(far) as far from (
    select vec_id, x.p, e, sum((x.v - k.v) * (x.v - k.v))::bigint as far from parts x join c{i} k on x.p = k.p and x.d = k.d group by vec_id, x.p, e
  ) group by vec_id, p
)"""
CODES_NEXT_SQL = """c{j} as (
  select k.p, k.e, k.d, coalesce(n.v, k.v) as v from c{i} k left join (
    select p, e, d, FLOOR as v from a{i} join parts using (vec_id, p) group by p, e, d
  ) n on k.p = n.p and k.e = n.e and k.d = n.d
)""".replace("FLOOR", FLOOR_SQL)

CODES_SQL = f"""
with whole as ({WHOLE_SQL.format(size="= 64")}), parts as (
  select vec_id, unnest(range(0, 64)) // 8 as p, unnest(range(0, 64)) % 8 as d, unnest([floor(4096 * x::double)::bigint for x in embedding]) as v from whole
), seeds as (select vec_id, row_number() over (order by vec_id) - 1 as e from whole qualify e < 16),
c0 as (select p, e, d, v from seeds join parts using (vec_id)),
{_rounds(6, CODES_ROUND_SQL, CODES_NEXT_SQL)}, coded as (
  select vec_id, string_agg(printf('%02x', e), '' order by p) as code, sum(far)::bigint as error from a6 group by vec_id
), books as (select sha256(string_agg(v::varchar, ',' order by p, e, d)) as print from c6)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, print as codebooks_sha256 from coded join whole using (vec_id), books
"""


@query("op13_vector_codes", CODES_SQL)
def op13_vector_codes(spark, sf_dir):
    coded, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), Scratch(spark))
    prints = books.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("part", "entry", "numbers"))).alias("all"))
    prints = prints.select("dim", F.sha2(F.array_join(F.flatten("all.numbers"), ","), 256).alias("codebooks_sha256"))
    code = F.array_join(F.transform("codes", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    rows = coded.select("vec_id", "dim", code.alias("code"), "error", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("own"))
    labels = rows.groupBy("own").agg(long_sum("error").alias("label_error"))
    many = labels.count()
    met = sized_join(rows, labels, "own", many) if many <= LIMITS.broadcast_rows else lookup_join(rows, labels, "own")
    return met.join(F.broadcast(prints), "dim").select("vec_id", "code", "error", "label_error", "codebooks_sha256")
