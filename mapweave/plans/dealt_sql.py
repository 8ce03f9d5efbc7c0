"""SQL that answers the core's p queries over whole tables."""

_POINTS = """pts as (select id, lon, lat from (select id, max_by(coalesce(visible, true), (vs, ts)) as live, max_by({'v': lon}, (vs, ts)).v as lon, max_by({'v': lat}, (vs, ts)).v as lat from full_nodes group by id)
  where live and lon between -1800000000 and 1800000000 and lat between -900000000 and 900000000 and not (lon = -1800000000 and lat = -900000000))"""
_NEAR = """select least(a.id, b.id) as id_a, greatest(a.id, b.id) as id_b from pts a join pts b on b.lat between a.lat and a.lat + 2698 and (b.lat > a.lat or a.id < b.id)
  where 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians((b.lat - a.lat) / 1e7) / 2), 2) + cos(radians(a.lat / 1e7)) * cos(radians(b.lat / 1e7)) * pow(sin(radians((b.lon - a.lon) / 1e7) / 2), 2)))) <= 30"""
_EDGES = """ring as (select region_id, ring_no, coalesce(ring_label like '!%', false) as hole, verts as vs from loc_test_polygons),
edge as (select region_id, ring_no, hole, unnest(vs) as a, unnest(list_concat(vs[2:], vs[1:1])) as b from ring),
odd as (select id, region_id, ring_no, hole from pts join edge on (a.lat > pts.lat) <> (b.lat > pts.lat)
  and (b.lat > a.lat) = ((pts.lon - a.lon)::hugeint * (b.lat - a.lat) < (b.lon - a.lon)::hugeint * (pts.lat - a.lat)) group by all having count(*) % 2 = 1)"""
_INSIDE = "select id, region_id from odd group by all having bool_or(not hole) and not bool_or(hole)"

SQL = {
    "p2_found": """
with e as (select distinct quadtree, entry_id, block_idx, qt_count from qt_entries where quadtree >= 0 and qt_count is not null),
r as (select *, sum(qt_count) over (partition by quadtree order by block_idx, entry_id rows unbounded preceding) as run, sum(qt_count) over (partition by quadtree) as total from e)
select quadtree, arg_min(entry_id, (block_idx, entry_id)) as entry_id from r where run * 2 >= total group by quadtree""",
    "p2_tile_totals": "select quadtree, count(*) as n_rows, cast(sum(qt_count) as bigint) as total from qt_entries where quadtree >= 0 and qt_count is not null group by quadtree",
    "p3_found": """
with c as (select cast(object_type as integer) as object_type, id, vs, ts, seq, change_type = 1 as dead from osc_changes where vs >= 1),
b as (select 0 as object_type, id, vs, ts, not coalesce(visible, true) as dead from full_nodes union all select 1, id, vs, ts, not coalesce(visible, true) from full_ways union all select 2, id, vs, ts, not coalesce(visible, true) from full_relations),
s as (select * from c union all select object_type, id, vs, ts, -1, dead from b where (object_type, id) in (select (object_type, id) from c)),
w as (select *, row_number() over (partition by object_type, id order by vs desc, ts desc, seq desc) as k from s)
select object_type, id, vs from w where k = 1 and not dead""",
    "p5_found": """
with recursive live as (select id from (select id, max_by(coalesce(visible, true), (vs, ts)) as v from full_relations group by id) where v),
l as (select distinct relation_id as p, mem_ref as c from rel_members where mem_type = 2 and relation_id in (select id from live) and mem_ref in (select id from live)),
t as (select distinct p as id, p as root, cast(0 as bigint) as n, cast(p as varchar) as path from l where p not in (select c from l)
  union all select l.c, t.root, t.n + 1, t.path || '/' || l.c from t join l on l.p = t.id)
select id as relation_id, root as root_id, n as n_above, path as id_path from t
union all select x, -1, -1, '' from (select p as x from l union select c from l) where x not in (select id from t)""",
    "p5_descendants": """
with recursive live as (select id from (select id, max_by(coalesce(visible, true), (vs, ts)) as v from full_relations group by id) where v),
l as (select distinct relation_id as p, mem_ref as c from rel_members where mem_type = 2 and relation_id in (select id from live) and mem_ref in (select id from live)),
ok as (select distinct p as id from l where p not in (select c from l) union select l.c from ok join l on l.p = ok.id),
t as (select p as a, c as b, cast(1 as bigint) as n from l where p in (select id from ok) union all select t.a, l.c, t.n + 1 from t join l on l.p = t.b)
select a as relation_id, b as descendant_id, n as steps from t""",
    "p6_found": """
with st as (select 0 as kind, id, max_by(coalesce(visible, true), (vs, ts)) as live, min(loaded_at) as first from full_nodes group by id
  union all select 1, id, max_by(coalesce(visible, true), (vs, ts)), min(loaded_at) from full_ways group by id
  union all select 2, id, max_by(coalesce(visible, true), (vs, ts)), min(loaded_at) from full_relations group by id),
w as (select id, vs, ts, min(loaded_at) as loaded, max(coalesce(visible, true)) as live, any_value(refs) as refs, row_number() over (partition by id order by vs desc, ts desc) as k from full_ways group by id, vs, ts),
r as (select id, vs, ts, min(loaded_at) as loaded, max(coalesce(visible, true)) as live, row_number() over (partition by id order by vs desc, ts desc) as k from full_relations group by id, vs, ts),
f as (select 'full_ways' as src_table, id as src_id, 0 as mem_type, unnest(refs) as ref_id, ts, loaded from w where k = 1 and live
  union all select 'rel_members', relation_id, cast(mem_type as integer), mem_ref, r.ts, r.loaded from rel_members join r on r.id = relation_id where k = 1 and live and mem_type between 0 and 2),
o as (select distinct src_table, src_id, mem_type, ref_id, strftime(make_timestamp(ts * 1000000), '%Y-%m') as ym,
  case when st.id is null then 'missing' when not st.live then 'deleted' when st.first > loaded then 'late' end as reason
  from f left join st on st.kind = mem_type and st.id = ref_id where ref_id is not null)
select * from o where reason is not null""",
}
# A value is cut into quoted pieces, protected characters, runs of what an item may hold, and single other characters,
# each of which becomes the mark (a private character) that the rest is then split at.
_FREE = r"[\p{L}\p{M}\p{Nd}\p{Zs}.\-]+"
_PIECE = rf'(?s)\\.|\\$|"(?:[^"\\]|\\.|"")*(?:"|$)|{_FREE}|.'
_UNQUOTED = """regexp_replace(regexp_replace(case when regexp_full_match(x, '(?s)"(?:[^"\\\\]|\\\\.|"")*"') then x[2:-2] else x[2:] end, '""', '"', 'g'), '(?s)\\\\(.)', '\\1', 'g')"""
SQL["p7_found"] = f"""
with t as (select seq, unnest(tag_keys) as k, unnest(tag_vals) as v, unnest(range(1, greatest(len(tag_keys), len(tag_vals)) + 1)) as pos from osc_changes),
l as (select * from t where v is not null and k in (select tag from style_entries where is_list)),
p as (select seq, pos, list_transform(regexp_extract_all(v, '{_PIECE}'), lambda x: case when x[1] = chr(92) then x[2:] when x[1] = '"' then {_UNQUOTED} when regexp_full_match(x, '{_FREE}') then x else chr(57345) end) as ps from l),
i as (select seq, pos, list_filter(list_transform(string_split(array_to_string(ps, ''), chr(57345)), lambda s: regexp_replace(s, '^[\\p{{Zs}}\\s]+|[\\p{{Zs}}\\s]+$', '', 'g')), lambda s: s <> '') as it from p)
select seq, cast(pos as integer) as tag_pos, cast(generate_subscripts(it, 1) as integer) as item_pos, unnest(it) as item from i where len(it) >= 2"""
SQL["p6_per_month"] = f"select src_table, ym, reason, count(*) as n_refs from ({SQL['p6_found']}) group by all"
SQL["p4_near"] = f"with {_POINTS} {_NEAR}"
SQL["p4_inside"] = f"with {_POINTS}, {_EDGES} {_INSIDE}"
SQL["p4_found"] = f"with {_POINTS}, {_EDGES} select 'near' as match_kind, id_a, id_b from ({_NEAR}) union all select 'inside', id, region_id from ({_INSIDE})"
