"""Deeply nested scene documents as flat tables that keep parent-child links.

A scene is parsed into a VARIANT.  Nested higher-order functions walk pages, groups and
nodes, attach the ancestors' keys and positions on the way down, ``flatten`` joins the
arrays of one level with those of the next, and one ``inline`` per target table emits rows.
There is no Python and no shuffle besides the final removal of repeated deliveries.

Shapes that are read: pages and nodes as arrays or as objects keyed by id; ids in the
object (``id`` or the alias of its kind) or as the key; the scene itself, one wrapped in
``{"epoch": .., "scene": ..}`` and one encoded as a JSON string again (any number of such
layers); the component layout, where a ``SourceText`` component's owner is a
text node and ``Parent`` components, if any, name the enclosing group.

Depth is not limited: one projection unrolls ``LEVELS`` levels of groups; what is nested
deeper comes out as a remainder that the next projection takes, until none is left.

Null and unreadable scenes give no rows.  Nodes without any id keep a null ``node_id``.
Repeated deliveries of a snapshot give each row once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgauge.session import cut

LEVELS = 3
#: String layers around a scene, at most.
LAYERS = 31

_ENTRY = "array<struct<key:string,val:variant>>"


def _entries(v: str) -> str:
    """SQL: children of an array or object as (key, val) in document order."""
    return (
        f"coalesce(transform(try_variant_get({v}, '$', 'array<variant>'), _x -> named_struct('key', cast(null as string), 'val', _x)), "
        f"transform(map_entries(try_variant_get({v}, '$', 'map<string,variant>')), _e -> named_struct('key', _e.key, 'val', _e.value)), "
        f"cast(array() as {_ENTRY}))"
    )


def _text(v: str, path: str) -> str:
    return f"try_variant_get({v}, '{path}', 'string')"


def _id(entry: str, *names: str) -> str:
    return "coalesce(" + ", ".join([*(_text(f"{entry}.val", f"$.{n}") for n in names), f"{entry}.key"]) + ")"


def _has(v: str, path: str) -> str:
    """SQL: the path leads to a value; JSON's null is one."""
    return f"(try_variant_get({v}, '{path}', 'variant') is not null)"


def readable_scenes(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, scene variant) of the snapshots whose scene is a JSON object.

    Each string layer escapes the quotes of the one inside and so doubles their number of signs: more than LAYERS
    of them don't fit into a string.
    """
    blank = "trim(both '\ufeff \t\r\n' from {0})"
    peeled = f"aggregate(sequence(1, {LAYERS}), {blank.format('scene')}, (t, i) -> if(startswith(t, '\"'), {blank.format(_text('try_parse_json(t)', '$'))}, t))"
    df = snapshots.select("snapshot_id", F.expr(peeled).alias("t")).where("startswith(t, '{')").select("snapshot_id", F.expr("try_parse_json(t)").alias("v")).where("v is not null")
    inner = F.expr("case when try_variant_get(v, '$.scene.pages', 'variant') is not null or try_variant_get(v, '$.scene.components', 'variant') is not null then try_variant_get(v, '$.scene', 'variant') else v end")
    return df.select("snapshot_id", inner.alias("scene"))


def scene_pages(scenes: DataFrame) -> DataFrame:
    """(snapshot_id, page_id, page_index, width, height, nodes) from the scenes' page trees."""
    pages = _entries("try_variant_get(scene, '$.pages', 'variant')")
    rows = (
        f"transform({pages}, (p, i) -> named_struct('page_id', {_id('p', 'id', 'pageId', 'page_id')}, 'page_index', i, "
        "'width', try_variant_get(p.val, '$.width', 'double'), 'height', try_variant_get(p.val, '$.height', 'double'), "
        "'nodes', try_variant_get(p.val, '$.nodes', 'variant')))"
    )
    return scenes.select("snapshot_id", F.expr(f"inline({rows})"))


def _walk(nodes: str, parent: str, level: int) -> str:
    """SQL: array of node structs below ``nodes``, groups unrolled ``level`` more times."""
    n, i = f"n{level}", f"i{level}"
    me = _id(n, "id", "nodeId", "node_id")
    kids = f"try_variant_get({n}.val, '$.kind.group.nodes', 'variant')"
    is_group, is_text = _has(f"{n}.val", "$.kind.group"), _has(f"{n}.val", "$.kind.text")
    own = (
        f"named_struct('parent_id', {parent}, 'node_id', {me}, 'node_index', {i}, 'is_text', {is_text}, 'is_group', {is_group}, "
        f"'node', {n}.val, 'rest', {f'if({is_group}, {kids}, null)' if level == 0 else 'cast(null as variant)'})"
    )
    if level == 0:
        return f"transform({_entries(nodes)}, ({n}, {i}) -> {own})"
    below = _walk(kids, me, level - 1)
    return f"flatten(transform({_entries(nodes)}, ({n}, {i}) -> if({is_group}, concat(array({own}), {below}), array({own}))))"


def scene_nodes(pages: DataFrame) -> DataFrame:
    """All nodes at any depth: (snapshot_id, page_id, parent_id, node_id, node_index, is_text, is_group, node)."""
    todo = pages.select("snapshot_id", "page_id", F.col("page_id").alias("_parent"), F.col("nodes").alias("_nodes"))
    done: DataFrame | None = None
    while True:
        rows = todo.select("snapshot_id", "page_id", F.expr(f"inline({_walk('_nodes', '_parent', LEVELS)})"))
        part = rows.drop("rest")
        done = part if done is None else done.unionByName(part)
        deeper = rows.where("rest is not null").select("snapshot_id", "page_id", F.col("node_id").alias("_parent"), F.col("rest").alias("_nodes"))
        # The remainder is cut as JSON text: it is small, mostly empty, and needs no second walk.
        deeper = cut(deeper.withColumn("_nodes", F.to_json("_nodes"))).withColumn("_nodes", F.expr("parse_json(_nodes)"))
        if deeper.isEmpty():
            return done
        todo = deeper


def scene_components(scenes: DataFrame) -> DataFrame:
    """(snapshot_id, page_id, owner_id, component_type, component_index, value) of the component layout."""
    parts = _entries("try_variant_get(scene, '$.components', 'variant')")
    rows = (
        f"transform({parts}, (c, i) -> named_struct('page_id', {_text('c.val', '$.pageId')}, 'owner_id', {_text('c.val', '$.ownerId')}, "
        f"'component_type', {_text('c.val', '$.type')}, 'component_index', i, 'value', try_variant_get(c.val, '$.value', 'variant')))"
    )
    return scenes.select("snapshot_id", F.expr(f"inline({rows})"))


def flatten_scenes(snapshots: DataFrame) -> dict[str, DataFrame]:
    """The related flat tables ``pages``, ``groups``, ``text_nodes`` and ``candidates``.

    * pages: snapshot_id, page_id, page_index, width, height
    * groups: snapshot_id, page_id, parent_id, group_id, group_name
    * text_nodes: snapshot_id, page_id, parent_id, node_id, source_text, translation, confidence
    * candidates: snapshot_id, page_id, node_id, candidate_index, engine, candidate_text

    ``snapshots`` needs ``snapshot_id`` and ``scene``; other columns are ignored.
    """
    scenes = readable_scenes(snapshots)
    trees = scene_pages(scenes)
    nodes = scene_nodes(trees)
    comps = scene_components(scenes)
    pages = trees.drop("nodes").unionByName(
        comps.where("page_id is not null").groupBy("snapshot_id", "page_id").agg(F.min("component_index").alias("page_index")).withColumns({"width": F.lit(None).cast("double"), "height": F.lit(None).cast("double")})
    )
    groups = nodes.where("is_group").selectExpr("snapshot_id", "page_id", "parent_id", "node_id as group_id", f"{_text('node', '$.kind.group.name')} as group_name")
    texts = nodes.where("is_text").selectExpr(
        "snapshot_id", "page_id", "parent_id", "node_id", f"{_text('node', '$.kind.text.text')} as source_text", f"{_text('node', '$.kind.text.translation')} as translation",
        "try_variant_get(node, '$.kind.text.confidence', 'double') as confidence",
    )
    owned = comps.where("owner_id is not null").groupBy("snapshot_id", "page_id", F.col("owner_id").alias("node_id")).agg(
        F.max(F.expr("component_type = 'SourceText'")).alias("is_text"),
        F.max(F.expr(f"if(component_type in ('Parent', 'Group'), coalesce({_text('value', '$.parentId')}, {_text('value', '$.groupId')}, {_text('value', '$.id')}), null)")).alias("up"),
        F.max(F.expr(f"if(component_type = 'SourceText', {_text('value', '$.text')}, null)")).alias("source_text"),
        F.max(F.expr(f"if(component_type = 'Translation', {_text('value', '$.text')}, null)")).alias("translation"),
        F.max(F.expr("if(component_type = 'SourceText', try_variant_get(value, '$.confidence', 'double'), null)")).alias("confidence"),
    )
    texts = texts.unionByName(owned.where("is_text").selectExpr("snapshot_id", "page_id", "coalesce(up, page_id) as parent_id", "node_id", "source_text", "translation", "confidence"))
    cands = nodes.where("is_text").select(
        "snapshot_id", "page_id", "node_id",
        F.expr(f"inline(transform({_entries('''try_variant_get(node, '$.kind.text.ocrCandidates', 'variant')''')}, (c, i) -> named_struct('candidate_index', i, 'engine', {_text('c.val', '$.engine')}, 'candidate_text', {_text('c.val', '$.text')})))"),
    )
    return {"pages": pages.distinct(), "groups": groups.distinct(), "text_nodes": texts.distinct(), "candidates": cands.distinct()}
