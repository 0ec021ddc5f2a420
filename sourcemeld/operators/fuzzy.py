"""Fuzzy identity: pair records that share no unique key but look alike.

The score of two records is the mean over the fields filled on both sides: text similarity
for names, 1 or 0 for exact fields. Only scores of at least 0.72 matter, which fixes the
blocks: from the fields two records can have in common (the masks in use are known) follows
how many exact fields must agree, so records meet in a block per agreeing combination. Pairs
that can score without any agreeing exact field meet through rare letters of their names
(prefix filter). No qualifying pair is missed.

Equal records are collapsed first, so copies cost one row. A block of at most one tile is compared
as a whole. A big block (a phone number that a third of all rows share) is split by the names its
pairs have in common and searched from near to far: records whose names differ by a letter or two meet
through the texts that are left when letters are dropped; whoever then has two partners
that nobody not met yet can beat is done, and only the others are compared with all of the block, tile by tile.
A task sees two tiles at most and returns two partners per record.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemeld.contract import column
from sourcemeld.functions import kernels
from sourcemeld.functions import similarity as _similarity  # noqa: F401  registers the kernels
from sourcemeld.functions.text import blank_to_null, match_key
from sourcemeld.operators.skew import lookup_join, spread
from sourcemeld.session import Scratch
from sourcemeld.settings import AMBIGUOUS_MATCH, LIMITS, PAIR_MARGIN, PAIR_REVIEW_SCORE, PAIR_SCORE

# Fields compared by similarity and by equality.
NAME_FIELDS = ("first_name", "last_name")
EXACT_FIELDS = ("email", "phone", "date_of_birth")
# Letters dropped on each side in the rounds over big blocks, and the longest name that takes part in them.
NEAR_ROUNDS = (1, 2)
NEAR_LENGTH = 40
# Fixed value: letters from rare to common.
RARE_LETTERS = "zqxjkvbpygfwmucldrhsnioate "


@dataclass(frozen=True)
class Block:
    common: int
    agree: int


def _bits(mask: int) -> int:
    return bin(mask).count("1")


@dataclass
class Entrants:
    """Who enters a block kind."""

    masks: set[tuple[int, int]]


def block_plan(masks: list[tuple[int, int]], floor: float = PAIR_REVIEW_SCORE) -> dict[Block, Entrants]:
    """For each block kind the (exact mask, name mask) combinations that must enter it."""
    plan: dict[Block, Entrants] = {}
    for left, right in product(masks, masks):
        common, names = left[0] & right[0], _bits(left[1] & right[1])
        parts = names + _bits(common)
        if not parts:
            continue
        agree = common
        while True:
            if (names + _bits(agree)) / parts >= floor - 1e-12:
                entrants = plan.setdefault(Block(common, agree), Entrants(set()))
                entrants.masks.update((left, right))
            if agree == 0:
                break
            agree = (agree - 1) & common
    return plan


def letter_keys(text: Column, floor: float = PAIR_REVIEW_SCORE) -> Column:
    """Rare letters, or pairs of them, such that texts with ratio >= floor share at least one key.

    ratio >= t needs t * n / (2 - t) letters of a text of length n in common, so one of them is
    among its first n - that + 1 in a fixed order, and two among one letter more. Two are asked for where
    two letters must agree in any text of two letters and more (t above 2/3). A repeated letter counts as a new one.
    """
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    order = F.split(F.lit(RARE_LETTERS), "")

    def numbered(c: Column, i: Column) -> Column:
        return F.struct(
            F.array_position(order, F.lower(c)).alias("rank"),
            c.alias("letter"),
            F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda x: x == c)).alias("nth"),
        )

    n = F.length(text)
    together = 2 if floor > 2 / 3 else 1
    needed = F.ceil(n * F.lit(floor / (2 - floor)) - 1e-9)
    prefix = F.slice(F.array_sort(F.transform(letters, numbered)), F.lit(1), F.greatest(F.lit(1), (n - needed + together).cast("int")))
    marks = F.transform(prefix, lambda m: F.concat(m["letter"], m["nth"].cast("string")))
    if together == 1:
        return marks
    pairs = F.flatten(
        F.transform(
            marks,
            lambda a, i: F.transform(
                F.slice(marks, i + 2, F.greatest(F.lit(0), F.size(marks) - i - 1)), lambda b: F.concat_ws("\u0002", a, b)
            ),
        )
    )
    return F.when(n > 1, pairs).otherwise(F.array(text))


def _profiles(records: DataFrame, names: list[str], exacts: list[str], apart: DataFrame | None) -> DataFrame:
    """Equal records collapsed: pid (smallest id), last id, number of copies, values and masks."""
    values = records.select(
        "record_id",
        *[blank_to_null(F.col(f)).alias(f"n{k}") for k, f in enumerate(names)],
        *[match_key(F.col(f)).alias(f"e{k}") for k, f in enumerate(exacts)],
    )
    if apart is None:
        values = values.withColumn("apart", F.lit(None).cast("array<string>"))
    else:
        both = apart.select("record_a", "record_b").unionByName(
            apart.select(F.col("record_b").alias("record_a"), F.col("record_a").alias("record_b"))
        )
        told = both.groupBy("record_a").agg(F.array_sort(F.collect_set("record_b")).alias("apart"))
        values = values.join(told.withColumnRenamed("record_a", "record_id"), "record_id", "left")

    def mask(prefix: str, n: int) -> Column:
        bits = [F.when(F.col(f"{prefix}{k}").isNotNull(), 1 << k).otherwise(0) for k in range(n)]
        return sum(bits[1:], bits[0]) if bits else F.lit(0)

    fields = [*[f"n{k}" for k in range(len(names))], *[f"e{k}" for k in range(len(exacts))]]
    alone = F.when(F.col("apart").isNotNull(), F.col("record_id")).alias("alone")
    return (
        values.groupBy(*fields, "apart", alone)
        .agg(F.min("record_id").alias("pid"), F.max("record_id").alias("last_id"), F.count(F.lit(1)).alias("copies"))
        .withColumns({"emask": mask("e", len(exacts)), "nmask": mask("n", len(names))})
        .where("emask + nmask > 0")
        .drop("alone")
    )


def _tagged(keys: Column, tag: str) -> Column:
    return F.transform(keys, lambda x: F.concat_ws("\u0001", F.lit(tag), x))


def _placed(keys: Column, spec: Block) -> Column:
    common, agree = F.lit(spec.common).cast("bigint"), F.lit(spec.agree).cast("bigint")
    return F.transform(keys, lambda x: F.struct(common.alias("common"), agree.alias("agree"), x.alias("block")))


def _name_keys(names: list[str], ratio: float, tag: str) -> Column:
    """Letter keys of all filled names."""
    none = F.array().cast("array<string>")
    return F.flatten(
        F.array(*[F.coalesce(_tagged(letter_keys(F.col(f"n{k}"), ratio), f"{tag}:{k}"), none) for k in range(len(names))])
    )


def _block_keys(plan: dict[Block, Entrants], names: list[str], floor: float) -> Column:
    """Array of (common, agree, block) a profile enters."""
    mask = F.concat_ws(":", "emask", "nmask")
    entries = []
    for spec, entrants in sorted(plan.items(), key=lambda x: (x[0].common, x[0].agree)):
        enters = mask.isin(*[f"{e}:{n}" for e, n in sorted(entrants.masks)])
        agreed = [F.col(f"e{k}") for k in range(16) if spec.agree >> k & 1]
        tag = f"{spec.common}:{spec.agree}"
        if agreed:
            keys = F.array(F.concat_ws("\u0001", F.lit(tag), *agreed))
        else:
            keys = _name_keys(names, floor, tag)
        empty = F.array().cast("array<struct<common:bigint,agree:bigint,block:string>>")
        entries.append(F.when(enters, _placed(keys, spec)).otherwise(empty))
    return F.flatten(F.array(*entries))


_TOP = "array<struct<order:double,other:string,other_copies:bigint>>"


def _compared(blocks: DataFrame, names: int, exacts: int, floor: float) -> DataFrame:
    """(pid, other, other_copies, score): up to two partners of each record per pair of tiles of its block.

    ``blocks`` has a row per record and block with the block's tiles. Seekers of a big block have tiles of their own; they
    meet all tiles, and two tiles without a seeker never meet.
    """
    spot = F.xxhash64("pid")
    among_others = F.col("seek_tiles") + F.pmod(spot, F.greatest("other_tiles", F.lit(1)))
    place = F.when(F.col("seeker"), F.pmod(spot, F.col("seek_tiles"))).when(F.col("other_tiles") > 0, among_others).otherwise(0)
    meets = F.col("seek_tiles") + F.when(F.col("seeker"), F.col("other_tiles")).otherwise(0)
    tiled = (
        blocks.withColumns({"tile": place.cast("int"), "against": F.explode(F.sequence(F.lit(0), meets - 1))})
        .withColumns({"tile_a": F.least("tile", "against"), "tile_b": F.greatest("tile", "against")})
        .drop("n", "seek_tiles", "other_tiles", "against")
    )
    group = ["block", "tile_a", "tile_b"]
    return (
        spread(tiled.withColumns({c: F.col(c).cast("bigint") for c in ("emask", "nmask", "both")}), *group)
        .sortWithinPartitions(*group, "pid")
        .mapInArrow(kernels.best_partners(names, exacts, floor), "pid string, other string, other_copies bigint, score double")
    )


def _sized(keyed: DataFrame, tile_rows: int) -> DataFrame:
    """(block, n, seek_tiles, other_tiles) of every block in which a seeker can meet somebody."""
    seekers = F.count_if("seeker")
    return (
        keyed.groupBy("block")
        .agg(F.count(F.lit(1)).alias("n"), seekers.alias("__s"))
        .where("n > 1 and __s > 0")
        .select(
            "block", "n", F.when(F.col("n") <= tile_rows, 1).otherwise(F.ceil(F.col("__s") / tile_rows)).cast("int").alias("seek_tiles"),
            F.when(F.col("n") <= tile_rows, 0).otherwise(F.ceil((F.col("n") - F.col("__s")) / tile_rows)).cast("int").alias("other_tiles"),
        )
    )


def _top(found: DataFrame) -> DataFrame:
    """(pid, top): the two best partners; equal scores by the smaller id."""
    entry = F.struct((-F.col("score")).alias("order"), "other", "other_copies")
    return found.groupBy("pid").agg(F.slice(F.array_sort(F.collect_set(entry)), 1, 2).cast(_TOP).alias("top"))


def dropped(text: Column, letters: int) -> Column:
    """The text and all that is left of it when up to ``letters`` letters are dropped."""
    kept = F.array(text)
    for _ in range(letters):
        fewer = F.transform(
            kept, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
        )
        kept = F.array_distinct(F.concat(kept, F.flatten(F.filter(fewer, lambda x: F.size(x) > 0))))
    return kept


def _best_unmet(length: Column, lengths: Column, letters: int) -> Column:
    """Largest ratio of a text to one of the given lengths from which it differs by more than ``letters`` letters on a side."""

    def ratio(other: Column) -> Column:
        low, high = F.least(length, other), F.greatest(length, other)
        shared = F.when(high - low <= letters, high - letters - 1).otherwise(low)
        return 2.0 * F.greatest(shared, F.lit(0)) / (length + other)

    return F.array_max(F.transform(lengths, ratio))


def _by_names(big: DataFrame, scratch: Scratch, names: int) -> DataFrame:
    """Rows of big blocks, once per set of names that a pair can have in common.

    Adds ``both`` (that set), the number of ``shared`` names, of ``parts`` that count and of exact fields that ``agreed``, ``chosen`` (the name
    among them with the most different values in the block) and the ``lengths`` that it takes there.
    """
    # Only sets that two masks of the block leave in common; a record without a partner for a set would seek it in vain.
    mask = F.col("nmask").cast("int")
    masks = scratch.write(big.groupBy("block").agg(F.collect_set(mask).alias("masks")), "masks")  # 2^names entries at the most
    inside = F.array_distinct(F.transform("masks", lambda m: m.bitwiseAND(mask)))
    parted = lookup_join(big, masks, "block").withColumn("both", F.explode(inside)).drop("masks")
    parted = parted.withColumn("block", F.concat_ws("\u0004", "block", F.col("both").cast("string")))
    options = []
    for k in range(names):
        name = F.when(F.col("both").bitwiseAND(1 << k) != 0, F.col(f"n{k}"))
        sizes = F.collect_set(F.least(F.length(name), F.lit(NEAR_LENGTH + 1)))  # NEAR_LENGTH + 1 entries at the most
        options.append(F.struct(F.approx_count_distinct(name).alias("values"), F.lit(k).alias("k"), sizes.alias("lengths")))
    best = F.array_max(F.array(*options)) if options else F.lit(None).cast("struct<values:bigint,k:int,lengths:array<int>>")
    facts = scratch.write(parted.groupBy("block").agg(best.alias("best")).select("block", "best.k", "best.lengths"), "names")
    chosen = F.lit(None).cast("string")
    for k in range(names):
        chosen = F.when((F.col("k") == k) & (F.col("both") > 0), F.col(f"n{k}")).otherwise(chosen)
    shared = F.bit_count(F.col("both").cast("bigint"))
    counts = {"chosen": chosen, "shared": shared, "agreed": F.bit_count("agree"), "parts": shared + F.bit_count("common")}
    return lookup_join(parted, facts, "block").withColumns(counts).where("parts > 0").drop("k")


def _seeking(rows: DataFrame, top: DataFrame, letters: int, floor: float) -> DataFrame:
    """Marks the records that somebody whom the round of ``letters`` has not brought to them may still suit better."""
    second = F.coalesce(-F.try_element_at("top", F.lit(2))["order"], F.lit(0.0))
    length = F.length("chosen")
    near = _best_unmet(length, F.col("lengths"), letters)
    reach = F.when(length <= NEAR_LENGTH - letters, near).otherwise(1.0)
    reach = F.when(F.col("both") > 0, reach + F.col("shared") - 1).otherwise(0.0)
    unmet = (reach + F.col("agreed")) / F.col("parts")
    joined = rows.drop("seeker", "known").join(top, "pid", "left")
    open_ = (F.col("parts") > 0) & (unmet >= floor - 1e-9) & (second <= unmet + 1e-9)
    return joined.withColumns({"seeker": open_, "known": second}).drop("top")


def _search_big(big: DataFrame, found: DataFrame, scratch: Scratch, names: int, exacts: int, floor: float, tile_rows: int) -> DataFrame:
    """``found`` and the partners inside big blocks: rounds over near names first, then whoever is left against all."""
    state = scratch.write(_by_names(big, scratch, names).withColumns({"seeker": F.lit(True), "known": F.lit(0.0)}), "big-blocks")
    inner = ("chosen", "lengths", "parts", "shared", "agreed")
    for letters in (*NEAR_ROUNDS, None):
        if letters is None:
            keyed = state.drop(*inner)
        else:
            near = state.where(F.col("chosen").isNotNull() & (F.length("chosen") <= NEAR_LENGTH))
            near = near.withColumn("key", F.explode(dropped(F.col("chosen"), letters)))
            keyed = scratch.write(near.withColumn("block", F.concat_ws("\u0005", "block", "key")).drop("key", *inner), "near")
        sizes = scratch.write(_sized(keyed, tile_rows), "sizes")
        met = lookup_join(keyed, sizes, "block").where("n is not null")
        found = found.unionByName(scratch.write(_compared(met, names, exacts, floor), "found"))
        if letters is not None:
            state = scratch.write(_seeking(state, _top(found), letters, floor), "seeking")
            if state.where("seeker").isEmpty():
                break
    return found


def best_candidates(
    records: DataFrame,
    scratch: Scratch,
    names: list[str],
    exacts: list[str],
    apart: DataFrame | None = None,
    floor: float = PAIR_REVIEW_SCORE,
    tile_rows: int | None = None,
) -> DataFrame:
    """(record_id, partner, score, second): best partner of every record that has one >= floor."""
    tile_rows = tile_rows or LIMITS.tile_rows
    profiles = scratch.write(_profiles(records, names, exacts, apart), "profiles")
    # At most 2^(number of fields) combinations.
    masks = [(r.emask, r.nmask) for r in profiles.select("emask", "nmask").distinct().collect()]
    plan = block_plan(masks, floor)
    values = [*[f"n{k}" for k in range(len(names))], *[f"e{k}" for k in range(len(exacts))]]
    carried = ["pid", "copies", "emask", "nmask", "apart", *values]
    if plan:
        entered = profiles.select(*carried, F.explode(_block_keys(plan, names, floor)).alias("k")).select(*carried, "k.*")
        roles = {"both": F.lit(-1), "seeker": F.lit(True), "known": F.lit(0.0)}
        keyed = scratch.write(entered.dropDuplicates(["pid", "block"]).withColumns(roles), "blocks")
        sizes = scratch.write(_sized(keyed, tile_rows), "sizes")
        met = lookup_join(keyed, sizes, "block", keyed.count()).where("n is not null")
        found = _compared(met.where(F.col("n") <= tile_rows), len(names), len(exacts), floor)
        if not sizes.where(F.col("n") > tile_rows).isEmpty():
            big = met.where(F.col("n") > tile_rows).drop("n", "seek_tiles", "other_tiles", *roles)
            found = _search_big(big, scratch.write(found, "found"), scratch, len(names), len(exacts), floor, tile_rows)
        top = _top(found)
    else:
        top = profiles.select("pid", F.lit(None).cast(_TOP).alias("top")).limit(0)
    known = profiles.select("pid", "last_id", "copies", *values, "apart").join(top, "pid", "left")
    near = F.coalesce(-F.col("top")[0]["order"], F.lit(0.0))
    after = F.coalesce(-F.try_element_at("top", F.lit(2))["order"], F.lit(0.0))
    single = F.col("copies") == 1
    per_profile = known.withColumns(
        {
            "score": F.when(single, near).otherwise(1.0),
            "second": F.when(F.col("copies") > 2, 1.0)
            .when(F.col("copies") == 2, near)
            .when(F.col("top")[0]["other_copies"] > 1, near)
            .otherwise(after),
            "partner": F.when(single, F.col("top")[0]["other"]),
        }
    ).where(F.col("score") >= floor)
    alone = per_profile.where("copies = 1").select(F.col("pid").alias("record_id"), "partner", "score", "second")
    twins = per_profile.where("copies = 2").select(
        F.inline(
            F.array(
                F.struct(F.col("pid").alias("record_id"), F.col("last_id").alias("partner"), "score", "second"),
                F.struct(F.col("last_id").alias("record_id"), F.col("pid").alias("partner"), "score", "second"),
            )
        )
    )
    # One text for all values, so that a crowd of equal records is a hot key of one lookup.
    whole = F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("whole")
    crowd = per_profile.where("copies > 2").select(whole, "pid", "last_id").groupBy("whole").agg(F.min("pid").alias("pid"), F.max("last_id").alias("last_id"))
    shown = records.select(
        "record_id",
        *[blank_to_null(F.col(f)).alias(f"n{k}") for k, f in enumerate(names)],
        *[match_key(F.col(f)).alias(f"e{k}") for k, f in enumerate(exacts)],
    ).select("record_id", whole)
    copies = (
        lookup_join(shown, crowd, "whole")
        .where("pid is not null")
        .select(
            "record_id",
            F.when(F.col("record_id") == F.col("pid"), F.col("last_id")).otherwise(F.col("pid")).alias("partner"),
            F.lit(1.0).alias("score"),
            F.lit(1.0).alias("second"),
        )
    )
    return alone.unionByName(twins).unionByName(copies)


def fuzzy_identity(
    records: DataFrame,
    scratch: Scratch,
    names: list[str] | None = None,
    exacts: list[str] | None = None,
    apart: DataFrame | None = None,
    tile_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(groups, reviews) for records without an exact group.

    Two records pair when each is the other's best partner with a score of at least 0.90 and
    a lead of 0.08. Whoever stays single with a partner of at least 0.72 goes to review.
    ``apart`` (record_a, record_b) are approved decisions that two records differ.
    """
    names = [column(f) for f in (names or NAME_FIELDS) if column(f) in records.columns]
    exacts = [column(f) for f in (exacts or EXACT_FIELDS) if column(f) in records.columns]
    ids = records.select("record_id")
    if not names and not exacts:
        none = ids.limit(0)
        reviews = none.select(
            "record_id", F.lit("").alias("partner"), F.lit(0.0).alias("score"), F.lit(0.0).alias("second"), F.lit("").alias("reason_code")
        )
        return ids.select("record_id", F.col("record_id").alias("group_id"), F.lit("single").alias("method")), reviews
    best = scratch.write(best_candidates(records, scratch, names, exacts, apart, tile_rows=tile_rows), "best")
    clear = best.where((F.col("score") >= PAIR_SCORE) & (F.round(F.col("score") - F.col("second"), 9) >= PAIR_MARGIN))
    mutual = clear.select("record_id", "partner").join(
        clear.select(F.col("partner").alias("record_id"), F.col("record_id").alias("partner")), ["record_id", "partner"]
    )
    groups = ids.join(mutual, "record_id", "left").select(
        "record_id",
        F.when(F.col("partner").isNotNull(), F.least("record_id", "partner")).otherwise(F.col("record_id")).alias("group_id"),
        F.when(F.col("partner").isNotNull(), "fuzzy").otherwise("single").alias("method"),
    )
    reviews = best.join(mutual.select("record_id"), "record_id", "left_anti").select(
        "record_id", "partner", F.round("score", 4).alias("score"), F.round("second", 4).alias("second"),
        F.lit(AMBIGUOUS_MATCH).alias("reason_code"),
    )
    return groups, reviews
