"""Domain tables in their valid form, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgauge.session import table

PADDLE, MANGA = "engine-paddle", "engine-manga"


def page_key(page: Column) -> Column:
    """Official spelling of a page id in any spelling: its number in eight digits; null without digits."""
    digits = F.regexp_replace(F.translate(page, "０１２３４５６７８９", "0123456789"), "[^0-9]", "")
    return F.when(digits != "", F.concat(F.lit("pg-"), F.lpad(F.regexp_replace(digits, "^0+(?=.)", ""), 8, "0")))


def page_key_sql(page: str) -> str:
    return f"'pg-' || lpad(ltrim(regexp_replace(translate({page}, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g'), '0'), 8, '0')"


def latest(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Of each key the row that is greatest by ``by``: one partial aggregation, no window."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*df.columns), F.struct(*by)).alias("_r")).select("_r.*")


def benchmark_regions(spark: SparkSession, d: str) -> DataFrame:
    """The valid row of every benchmark region: the one that arrived last."""
    return latest(table(spark, d, "ocr_benchmark_regions"), "region_id", ["received_at", "row_id"]).withColumn("page_id", page_key(F.col("page_id")))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """The valid row of every routing observation."""
    return latest(table(spark, d, "routing_observations"), "observation_id", ["received_at", "row_id"]).withColumn("page_id", page_key(F.col("page_id")))


def regions(spark: SparkSession, d: str) -> DataFrame:
    """The valid version of every read region, with its role's policy."""
    valid = latest(table(spark, d, "partial_regions"), "region_id", ["updated_at", "row_id"])
    role = F.coalesce("region_role", F.lit("unknown"))
    return valid.withColumn("role", role).withColumn("policy", F.when(role.isin("dialogue", "caption"), "replace").otherwise("preserve-with-annotation"))


def golden(spark: SparkSession, d: str) -> DataFrame:
    """Reference regions without repeated deliveries."""
    return table(spark, d, "golden_regions").where("region_id is not null").dropDuplicates(["region_id"])


REGIONS_SQL = f"""
    bench as (
        select * exclude (page_id, k), {page_key_sql('page_id')} as page_id from (
            select *, row_number() over (partition by region_id order by received_at desc, row_id desc) as k from ocr_benchmark_regions where region_id is not null
        ) where k = 1
    )"""
OBSERVATIONS_SQL = f"""
    obs as (
        select * exclude (page_id, k), {page_key_sql('page_id')} as page_id from (
            select *, row_number() over (partition by observation_id order by received_at desc, row_id desc) as k from routing_observations where observation_id is not null
        ) where k = 1
    )"""
READ_SQL = """
    read as (
        select * exclude (k), coalesce(region_role, 'unknown') as role, case when region_role in ('dialogue', 'caption') then 'replace' else 'preserve-with-annotation' end as policy from (
            select *, row_number() over (partition by region_id order by updated_at desc, row_id desc) as k from partial_regions where region_id is not null
        ) where k = 1
    )"""
SPACE_SQL = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def norm_sql(x: str) -> str:
    """Normal form in SQL; exact for texts whose only compatibility characters are these."""
    return f"regexp_replace(translate(replace({x}, '…', '...'), '！？０１２３４５６７８９', '!?0123456789'), '{SPACE_SQL}', '', 'g')"


def distance_sql(source: str, pairs: list[tuple[str, str, str]], result: str) -> str:
    """Common table expressions that add edit distances in code points to ``source``.

    SQL's own distance counts bytes.  After common ends are cut off, letters of both sides get a
    byte each and those of one side only a common one; with too many letters the table of
    distances is filled line by line.
    """
    out, before = [], source
    same = "coalesce(nullif(list_position(list_transform(range(1, least(len(_l), len(_r)) + 1), lambda i: _l[i] = _r[i]), false), 0) - 1, least(len(_l), len(_r)))"
    code = "array_to_string(list_transform({0}, lambda x: chr(coalesce(nullif(list_position(_a, x), 0) + 2, {1})::int)), '')"
    line = (
        "list_transform([list_transform(list_concat([acc[1] + 1], list_transform(range(1, len(x) + 1), lambda j: least(acc[j + 1] + 1, acc[j] + x[j]))), lambda v, k: (v - k)::bigint)], "
        "lambda u: list_transform(range(1, len(u) + 1), lambda j: (j + list_min(u[1:j]))::bigint))[1]"
    )
    for i, (a, b, name) in enumerate(pairs):
        t = f"{result}_{i}"
        out.append(f"""
    {t}a as (select *, string_split({a}, '') as _l, string_split({b}, '') as _r from {before}),
    {t}b as (select *, {same} as _p from {t}a),
    {t}c as (select * replace (list_reverse(_l[_p + 1:]) as _l, list_reverse(_r[_p + 1:]) as _r) from {t}b),
    {t}d as (select *, {same} as _s from {t}c),
    {t}e as (select * replace (_l[_s + 1:] as _l, _r[_s + 1:] as _r) from {t}d),
    {t}f as (select *, list_distinct(list_intersect(_l, _r)) as _a from {t}e),
    {t} as (select * exclude (_l, _r, _p, _s, _a), case when {a} is null or {b} is null then null when len(_l) = 0 then len(_r) when len(_r) = 0 then len(_l)
        when len(_a) <= 120 then levenshtein({code.format('_l', 1)}, {code.format('_r', 2)})
        else list_reduce(list_transform(_l, lambda c: list_transform(_r, lambda o: (o <> c)::bigint)), lambda acc, x: {line}, range(0, len(_r) + 1))[-1] end as {name} from {t}f)""")
        before = t
    return ",".join(out) + f",\n    {result} as (select * from {before})"
