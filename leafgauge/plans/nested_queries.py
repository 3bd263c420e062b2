"""Queries over the raw scene snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafgauge.operators.nested import flatten_scenes
from leafgauge.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Text nodes of readable scenes with their page and innermost group."""
    return flatten_scenes(table(spark, d, "scene_snapshots"))["text_nodes"].select("snapshot_id", "page_id", "parent_id", "node_id").distinct()


def p5_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of readable scenes."""
    return flatten_scenes(table(spark, d, "scene_snapshots"))["pages"]


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Group nodes with their parents."""
    return flatten_scenes(table(spark, d, "scene_snapshots"))["groups"]


def p5_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Recognition candidates of text nodes."""
    return flatten_scenes(table(spark, d, "scene_snapshots"))["candidates"]


def queries() -> dict:
    return {f.__name__: f for f in (p5_found, p5_pages, p5_groups, p5_candidates)}


_NODES = """
    with recursive raw as (
        select snapshot_id, case when try_cast(scene as json) is null then null when json_type(scene) = 'VARCHAR' then try_cast(scene::json ->> '$' as json) else scene::json end as j
        from scene_snapshots where scene is not null and try_cast(scene as json) is not null
    ), readable as (select snapshot_id, case when json_exists(j, '$.scene') then j -> '$.scene' else j end as j from raw where j is not null and json_type(j) = 'OBJECT'),
    page_entries as (
        select snapshot_id, cast(null as varchar) as k, unnest(cast(j -> '$.pages' as json[])) as p from readable where json_type(j, '$.pages') = 'ARRAY'
        union all
        select snapshot_id, k, json_extract(j, '$.pages."' || k || '"') from (select snapshot_id, j, unnest(json_keys(j, '$.pages')) as k from readable where json_type(j, '$.pages') = 'OBJECT')
    ), pages as (select distinct snapshot_id, coalesce(p ->> '$.id', p ->> '$.pageId', k) as page_id, p from page_entries),
    tree as (
        select snapshot_id, page_id, page_id as parent_id, page_id as node_id, p -> '$.nodes' as kids, false as is_text, false as is_group, p as n from pages
        union all
        select t.snapshot_id, t.page_id, t.node_id, coalesce(e.n ->> '$.id', e.k), e.n -> '$.kind.group.nodes', json_exists(e.n, '$.kind.text'), json_exists(e.n, '$.kind.group'), e.n
        from tree t, lateral (
            select unnest(case when json_type(t.kids) = 'ARRAY' then list_transform(cast(t.kids as json[]), lambda x: {'k': cast(null as varchar), 'n': x})
                               when json_type(t.kids) = 'OBJECT' then list_transform(json_keys(t.kids), lambda x: {'k': x, 'n': json_extract(t.kids, '$."' || x || '"')}) end) as u
        ) x, lateral (select x.u.k as k, x.u.n as n) e
    )
"""


def oracle_sql() -> dict[str, str]:
    comps = "select distinct snapshot_id, c ->> '$.pageId' as page_id, c ->> '$.ownerId' as node_id, c ->> '$.type' as type from (select snapshot_id, unnest(cast(j -> '$.components' as json[])) as c from readable where json_type(j, '$.components') = 'ARRAY')"
    return {
        "p5_found": f"""{_NODES}
            select distinct snapshot_id, page_id, parent_id, node_id from tree where is_text
            union select snapshot_id, page_id, page_id, node_id from ({comps}) where type = 'SourceText'
        """,
        "p5_pages": f"""{_NODES}, listed as (
                select snapshot_id, unnest(list_transform(cast(j -> '$.pages' as json[]), lambda x, i: {{'k': cast(null as varchar), 'p': x, 'i': i - 1}})) as e from readable where json_type(j, '$.pages') = 'ARRAY'
                union all select snapshot_id, unnest(list_transform(list_sort(json_keys(j, '$.pages')), lambda x, i: {{'k': x, 'p': json_extract(j, '$.pages."' || x || '"'), 'i': i - 1}})) from readable where json_type(j, '$.pages') = 'OBJECT'
            ), owned as (
                select snapshot_id, unnest(list_transform(cast(j -> '$.components' as json[]), lambda x, i: {{'p': x ->> '$.pageId', 'i': i - 1}})) as c from readable where json_type(j, '$.components') = 'ARRAY'
            )
            select distinct snapshot_id, coalesce(e.p ->> '$.id', e.p ->> '$.pageId', e.p ->> '$.page_id', e.k) as page_id, e.i::int as page_index, try_cast(e.p ->> '$.width' as double) as width, try_cast(e.p ->> '$.height' as double) as height from listed
            union select snapshot_id, c.p, min(c.i)::int, null, null from owned where c.p is not null group by snapshot_id, c.p
        """,
        "p5_candidates": f"""{_NODES}, c as (
                select snapshot_id, page_id, node_id, unnest(list_transform(cast(n -> '$.kind.text.ocrCandidates' as json[]), lambda x, i: {{'c': x, 'i': i - 1}})) as e from tree where is_text and json_type(n, '$.kind.text.ocrCandidates') = 'ARRAY'
            )
            select distinct snapshot_id, page_id, node_id, e.i::int as candidate_index, e.c ->> '$.engine' as engine, e.c ->> '$.text' as candidate_text from c
        """,
        "p5_groups": f"{_NODES} select distinct snapshot_id, page_id, parent_id, node_id as group_id, n ->> '$.kind.group.name' as group_name from tree where is_group",
    }
