"""Standard SQL for the queries of log.py, over views named as the tables."""

from lamina.functions.canon import CREATED
from lamina.operators.messages import NOT_SPACE
from lamina.plans.problems_sql import COLLISIONS, IDS, ISLANDS, MESSAGES, P5_FOUND, as_data
from lamina.schemas import ACTIONS, OP_TYPES

#: The op log: first deliveries.
LOG = f"""{MESSAGES},
log AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY document_id, site_id, seq ORDER BY delivery_id) = 1)"""
#: The winning generation of each feature, and, for geometries edited by themselves, the base alone.
WIN = """win AS (SELECT document_id, feature_id, gen_site, gen_seq, ts AS gen_ts, geometry FROM gens
  QUALIFY row_number() OVER (PARTITION BY document_id, feature_id ORDER BY ts DESC, gen_site DESC, gen_seq DESC) = 1)"""
BASE_ONLY = "win AS (SELECT document_id, feature_id, gen_site, gen_seq, ts AS gen_ts, geometry FROM gens WHERE gen_seq = 0 AND geometry IS NOT NULL)"
GENS = f"""{LOG},
base AS (SELECT DISTINCT document_id, feature_id, geometry FROM base_features),
gens AS (
  SELECT document_id, feature_id, site_id AS gen_site, seq AS gen_seq, ts, geometry FROM log WHERE type IN ('insert_feature', 'set_geometry')
  UNION ALL SELECT document_id, feature_id, '', 0, 0, geometry FROM base
),
{WIN}"""


def parts_of(text: str) -> str:
    """Coordinates of a geometry as [part][ring][position][value]."""
    c = f"json_extract({text}, '$.coordinates')"
    return f"""CASE json_extract_string({text}, '$.type')
    WHEN 'Point' THEN [[[CAST({c} AS DOUBLE[])]]]
    WHEN 'LineString' THEN [[CAST({c} AS DOUBLE[][])]]
    WHEN 'Polygon' THEN [CAST({c} AS DOUBLE[][][])]
    WHEN 'MultiPoint' THEN list_transform(CAST({c} AS DOUBLE[][]), lambda x: [[x]])
    WHEN 'MultiLineString' THEN list_transform(CAST({c} AS DOUBLE[][][]), lambda x: [x])
    WHEN 'MultiPolygon' THEN CAST({c} AS DOUBLE[][][][]) END"""


def flat(source: str, keys: str) -> str:
    """Open rings of relation ``source`` (keys, type, parts) as rows (keys, type, p, r, k, coord)."""
    return f"""SELECT {keys}, type, p, r, unnest(range(len(ring))) AS k, unnest(ring) AS coord FROM (
      SELECT {keys}, type, p, r, CASE WHEN ends_with(type, 'Polygon') AND len(ring) >= 2 AND ring[1] = ring[len(ring)] THEN ring[1:len(ring) - 1] ELSE ring END AS ring FROM (
        SELECT {keys}, type, p, unnest(range(len(part))) AS r, unnest(part) AS ring FROM (
          SELECT {keys}, type, unnest(range(len(parts))) AS p, unnest(parts) AS part FROM {source})))"""


TABLES = f"""{GENS},
shapes AS (SELECT document_id, feature_id, gen_site, gen_seq, json_extract_string(geometry, '$.type') AS type, {parts_of('geometry')} AS parts FROM win WHERE geometry IS NOT NULL),
cur AS (
  SELECT e.*, s.type AS g_type, len(s.parts[1][1][1]) AS dims, geometry_op.action AS action, geometry_op.part_id AS part_id, geometry_op.ring_id AS ring_id, geometry_op.vertex_id AS vertex_id
  FROM log e JOIN shapes s ON e.document_id = s.document_id AND e.feature_id = s.feature_id AND coalesce(e.gen.site_id, '') = s.gen_site AND coalesce(e.gen.seq, 0) = s.gen_seq
  WHERE e.type = 'edit_geometry'
),
fresh AS (
  SELECT document_id, feature_id, 'part:' || site_id || ':' || seq AS part_id, site_id, seq, ts, json_extract_string(geometry_op.part, '$.type') AS type, {parts_of('geometry_op.part')} AS parts, dims
  FROM cur WHERE action = 'add_part' AND starts_with(g_type, 'Multi') AND json_extract_string(geometry_op.part, '$.type') = g_type[6:]
),
v_initial AS ({flat('shapes', 'document_id, feature_id')}),
v_fresh AS ({flat('(SELECT * FROM fresh WHERE len(parts[1][1][1]) = dims)', 'document_id, feature_id, part_id, site_id, seq, ts')}),
parts AS (
  SELECT *, EXISTS (SELECT 1 FROM cur c WHERE c.action = 'remove_part' AND starts_with(c.g_type, 'Multi') AND c.document_id = a.document_id AND c.feature_id = a.feature_id AND c.part_id = a.part_id) AS deleted FROM (
    SELECT DISTINCT document_id, feature_id, 'part:' || p AS part_id, replace(type, 'Multi', '') AS part_type FROM v_initial
    UNION ALL SELECT DISTINCT document_id, feature_id, part_id, type FROM v_fresh) a
),
new_rings AS (
  SELECT c.document_id, c.feature_id, c.part_id, 'ring:' || c.site_id || ':' || c.seq AS ring_id, c.site_id, c.seq, c.ts,
    CASE WHEN geometry_op.ring[1] = geometry_op.ring[len(geometry_op.ring)] THEN geometry_op.ring[1:len(geometry_op.ring) - 1] ELSE geometry_op.ring END AS ring
  FROM cur c SEMI JOIN (SELECT * FROM parts WHERE part_type = 'Polygon') p ON c.document_id = p.document_id AND c.feature_id = p.feature_id AND c.part_id = p.part_id
  WHERE c.action = 'add_ring' AND len(list_filter(geometry_op.ring, lambda x: len(x) <> dims)) = 0
),
rings AS (
  SELECT *, NOT exterior AND EXISTS (SELECT 1 FROM cur c WHERE c.action = 'remove_ring' AND c.document_id = a.document_id AND c.feature_id = a.feature_id AND c.part_id = a.part_id AND c.ring_id = a.ring_id) AS deleted FROM (
    SELECT DISTINCT document_id, feature_id, 'part:' || p AS part_id, 'ring:' || p || ':' || r AS ring_id, CAST(r AS INTEGER) AS pos, CAST(NULL AS BIGINT) AS ts, r = 0 AND ends_with(type, 'Polygon') AS exterior, replace(type, 'Multi', '') AS part_type FROM v_initial
    UNION ALL SELECT DISTINCT document_id, feature_id, part_id, 'ring:' || site_id || ':' || seq || ':' || r, CAST(r AS INTEGER), NULL, r = 0 AND type = 'Polygon', type FROM v_fresh
    UNION ALL SELECT document_id, feature_id, part_id, ring_id, NULL, ts, false, 'Polygon' FROM new_rings WHERE len(list_distinct(list_transform(ring, lambda x: [x[1], x[2]]))) >= 3) a
),
touched AS (
  SELECT c.*, r.part_type FROM cur c JOIN rings r ON c.document_id = r.document_id AND c.feature_id = r.feature_id AND c.part_id = r.part_id AND c.ring_id = r.ring_id
  WHERE c.action = 'delete_vertex' OR len(c.geometry_op.coord) = c.dims
),
created AS (
  SELECT document_id, feature_id, 'part:' || p AS part_id, 'ring:' || p || ':' || r AS ring_id, 'init:' || r || ':' || k AS vertex_id, k AS pos, CAST(NULL AS VARCHAR) AS after_id, CAST(NULL AS BIGINT) AS ts, CAST(NULL AS VARCHAR) AS site_id, CAST(NULL AS BIGINT) AS seq, coord FROM v_initial
  UNION ALL SELECT document_id, feature_id, part_id, 'ring:' || site_id || ':' || seq || ':' || r, 'v:' || site_id || ':' || seq || ':' || r || ':' || k, k, NULL, NULL, NULL, NULL, coord FROM v_fresh
  UNION ALL SELECT document_id, feature_id, part_id, ring_id, 'v:' || site_id || ':' || seq || ':' || k, k, NULL, NULL, NULL, NULL, coord FROM (SELECT document_id, feature_id, part_id, ring_id, site_id, seq, unnest(range(len(ring))) AS k, unnest(ring) AS coord FROM new_rings SEMI JOIN rings USING (document_id, feature_id, part_id, ring_id))
  UNION ALL SELECT document_id, feature_id, part_id, ring_id, 'op:' || site_id || ':' || seq, NULL, nullif(geometry_op.after_vertex_id, ''), ts, site_id, seq, geometry_op.coord FROM touched WHERE action = 'insert_vertex' AND part_type <> 'Point'
),
moves AS (SELECT document_id, feature_id, part_id, ring_id, vertex_id, geometry_op.coord AS coord FROM touched WHERE action = 'move_vertex'
  QUALIFY row_number() OVER (PARTITION BY document_id, feature_id, part_id, ring_id, vertex_id ORDER BY ts DESC, site_id DESC, seq DESC) = 1),
dead AS (SELECT DISTINCT document_id, feature_id, part_id, ring_id, vertex_id FROM touched WHERE action = 'delete_vertex' AND part_type <> 'Point'),
vertices AS (
  SELECT c.* EXCLUDE (coord), coalesce(m.coord, c.coord) AS coord, d.vertex_id IS NOT NULL AS deleted FROM created c
  LEFT JOIN moves m ON m.document_id = c.document_id AND m.feature_id = c.feature_id AND m.part_id = c.part_id AND m.ring_id = c.ring_id AND m.vertex_id = c.vertex_id
  LEFT JOIN dead d ON d.document_id = c.document_id AND d.feature_id = c.feature_id AND d.part_id = c.part_id AND d.ring_id = c.ring_id AND d.vertex_id = c.vertex_id
)"""
#: Sibling ranks and paths: the initial successor of a vertex ranks after all that is inserted below it.
ORDERED = f"""{TABLES},
kids AS (
  SELECT v.*, CASE WHEN v.pos IS NULL THEN v.after_id ELSE p.vertex_id END AS parent FROM vertices v
  LEFT JOIN vertices p ON v.pos IS NOT NULL AND p.pos = v.pos - 1 AND p.document_id = v.document_id AND p.feature_id = v.feature_id AND p.part_id = v.part_id AND p.ring_id = v.ring_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY document_id, feature_id, part_id, ring_id, parent ORDER BY pos IS NOT NULL, ts DESC, site_id DESC, seq DESC) AS place FROM kids
),
paths AS (
  SELECT document_id, feature_id, part_id, ring_id, vertex_id, deleted, [place] AS path FROM ranked WHERE parent IS NULL
  UNION ALL
  SELECT r.document_id, r.feature_id, r.part_id, r.ring_id, r.vertex_id, r.deleted, list_append(p.path, r.place)
  FROM paths p JOIN ranked r ON r.parent = p.vertex_id AND r.document_id = p.document_id AND r.feature_id = p.feature_id AND r.part_id = p.part_id AND r.ring_id = p.ring_id
),
ordered AS (SELECT * EXCLUDE (path), row_number() OVER (PARTITION BY document_id, feature_id, part_id, ring_id ORDER BY path) - 1 AS ord FROM paths)"""
STRUCTURE = f"""{ORDERED},
p_no AS (SELECT p.*, row_number() OVER (PARTITION BY p.document_id, p.feature_id ORDER BY f.ts NULLS FIRST, f.site_id, f.seq, CASE WHEN f.ts IS NULL THEN CAST(p.part_id[6:] AS INTEGER) END) - 1 AS part_no
  FROM parts p LEFT JOIN fresh f USING (document_id, feature_id, part_id) WHERE NOT p.deleted),
r_no AS (SELECT r.*, row_number() OVER (PARTITION BY r.document_id, r.feature_id, r.part_id ORDER BY r.pos NULLS LAST, r.ts, n.site_id, n.seq) - 1 AS ring_no
  FROM rings r LEFT JOIN new_rings n USING (document_id, feature_id, part_id, ring_id) WHERE NOT r.deleted)"""

SQL = {
    "generation_winner": f"WITH {GENS} SELECT document_id, feature_id, gen_site, gen_seq, gen_ts FROM win",
    "edit_generation_status": f"""WITH {GENS}
SELECT e.document_id, e.site_id, e.seq,
  CASE WHEN g.document_id IS NOT NULL AND w.gen_site = coalesce(e.gen.site_id, '') AND w.gen_seq = coalesce(e.gen.seq, 0) THEN 'current'
    WHEN g.document_id IS NOT NULL THEN 'superseded' WHEN e.gen IS NULL OR r.document_id IS NOT NULL THEN 'quarantined' ELSE 'buffered' END AS status
FROM log e
LEFT JOIN gens g ON g.document_id = e.document_id AND g.feature_id = e.feature_id AND g.gen_site = coalesce(e.gen.site_id, '') AND g.gen_seq = coalesce(e.gen.seq, 0)
LEFT JOIN win w ON w.document_id = e.document_id AND w.feature_id = e.feature_id
LEFT JOIN log r ON r.document_id = e.document_id AND r.site_id = e.gen.site_id AND r.seq = e.gen.seq
WHERE e.type = 'edit_geometry'""",
    "geometry_parts": f"WITH {TABLES} SELECT document_id, feature_id, part_id, part_type, deleted FROM parts",
    "ring_order": f"WITH {TABLES} SELECT document_id, feature_id, part_id, ring_id, pos, ts, exterior, deleted FROM rings",
    "vertex_state": f"WITH {TABLES} SELECT document_id, feature_id, part_id, ring_id, vertex_id, coord[1] AS x, coord[2] AS y, deleted FROM vertices",
    "rga_order": f"WITH RECURSIVE {ORDERED} SELECT document_id, feature_id, part_id, ring_id, vertex_id, ord FROM ordered",
    "structure_view": f"""WITH RECURSIVE {STRUCTURE}
SELECT o.document_id, o.feature_id, o.part_id, o.ring_id, o.vertex_id, p.part_no, r.ring_no,
  row_number() OVER (PARTITION BY o.document_id, o.feature_id, o.part_id, o.ring_id ORDER BY o.ord) - 1 AS "index"
FROM ordered o JOIN p_no p USING (document_id, feature_id, part_id) JOIN r_no r USING (document_id, feature_id, part_id, ring_id) WHERE NOT o.deleted""",
}

CLOCK_ROWS = """entries AS (SELECT document_id, unnest(map_entries(vector_clock)) AS e FROM delta_batches)"""
LIFE = """life AS (
  SELECT document_id, feature_id, bool_or(type = 'base') AS is_base, max(CASE WHEN type = 'insert_feature' THEN row(ts, site_id, seq) END) AS created,
    max(CASE WHEN type = 'delete_feature' THEN row(ts, site_id, seq) END) AS deleted
  FROM (SELECT document_id, feature_id, type, ts, site_id, seq FROM log WHERE type IN ('insert_feature', 'delete_feature')
        UNION ALL SELECT document_id, feature_id, 'base', 0, '', 0 FROM base_features) GROUP BY document_id, feature_id
),
lives AS (SELECT *, CASE WHEN deleted IS NULL THEN is_base OR created IS NOT NULL ELSE coalesce(created > deleted, false) END AS visible FROM life)"""
WRITES = """w AS (
  SELECT document_id, feature_id, property_key, ts, site_id, seq, type = 'delete_property' AS gone, property_value AS value FROM log WHERE type IN ('set_property', 'delete_property')
  UNION ALL
  SELECT document_id, feature_id, e.key, ts, site_id, seq, false, e.value FROM (SELECT document_id, feature_id, ts, site_id, seq, unnest(map_entries(properties)) AS e FROM log WHERE type = 'insert_feature')
  UNION ALL
  SELECT document_id, feature_id, e.key, 0, '', 0, false, e.value FROM (SELECT document_id, feature_id, unnest(map_entries(properties)) AS e FROM (SELECT DISTINCT document_id, feature_id, properties FROM base_features))
),
won AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY document_id, feature_id, property_key ORDER BY ts DESC, site_id DESC, seq DESC) = 1)"""
RINGS = f"""{MESSAGES},
sent AS (
  SELECT 'geometry:' || delivery_id AS origin, geometry FROM m WHERE type IN ('insert_feature', 'set_geometry')
  UNION ALL SELECT 'part:' || delivery_id, geometry_op.part FROM m WHERE geometry_op.action = 'add_part'
  UNION ALL SELECT DISTINCT 'base:' || document_id || '/' || feature_id, geometry FROM base_features
),
polygons AS (SELECT origin, json_extract_string(geometry, '$.type') AS type, {parts_of('geometry')} AS parts FROM sent WHERE geometry IS NOT NULL AND json_valid(geometry) AND json_extract_string(geometry, '$.type') IN ('Polygon', 'MultiPolygon')),
r AS (
  SELECT 'ring:' || delivery_id AS origin, 0 AS part_no, 0 AS ring_no, geometry_op.ring AS ring FROM m WHERE geometry_op.action = 'add_ring' AND geometry_op.ring IS NOT NULL
  UNION ALL SELECT origin, CAST(p AS INTEGER), CAST(r AS INTEGER), list(coord ORDER BY k) FROM ({flat('polygons', 'origin')}) GROUP BY origin, p, r
),
c AS (SELECT origin, part_no, ring_no, ring, CASE WHEN len(ring) < 3 OR (ring[1][1] = ring[-1][1] AND ring[1][2] = ring[-1][2]) THEN ring ELSE list_append(ring, ring[1]) END AS shut FROM r)"""
PLACE = "origin, part_no, ring_no"


def area(ring: str) -> str:
    """Twice the shoelace area."""
    return f"list_sum(list_transform(range(1, len({ring}) + 1), lambda i: {ring}[i][1] * {ring}[i % len({ring}) + 1][2] - {ring}[i % len({ring}) + 1][1] * {ring}[i][2]))"


SQL |= {
    "op_dedup": f"WITH {LOG} SELECT document_id, type, count(*) AS ops FROM log GROUP BY document_id, type",
    "frontier": f"WITH {MESSAGES}, {IDS}, {ISLANDS} SELECT document_id, site_id, coalesce(max(hi) FILTER (WHERE lo = 1), 0) AS frontier, max(hi) AS highest FROM islands GROUP BY document_id, site_id",
    "staged_ops": f"WITH {MESSAGES}, {IDS}, {ISLANDS} SELECT document_id, site_id, lo, hi FROM islands WHERE lo > 1",
    "sequence_gaps": f"""WITH {MESSAGES}, {IDS}, {ISLANDS}
SELECT document_id, site_id, below + 1 AS lo, lo - 1 AS hi FROM (SELECT *, coalesce(lag(hi) OVER (PARTITION BY document_id, site_id ORDER BY lo), 0) AS below FROM islands) WHERE below + 1 <= lo - 1""",
    "applied_clock": f"WITH {MESSAGES} SELECT document_id, site_id, max(seq) AS applied FROM m GROUP BY document_id, site_id",
    "lamport_clock": f"WITH {MESSAGES} SELECT document_id, max(ts) AS clock FROM m GROUP BY document_id",
    "clock_merge": f"WITH {CLOCK_ROWS} SELECT document_id, e.key AS site_id, max(e.value) AS seq FROM entries GROUP BY document_id, e.key",
    "delta_since": f"""WITH {LOG}, {CLOCK_ROWS}, peer AS (SELECT document_id, e.key AS site_id, min(e.value) AS known FROM entries GROUP BY document_id, e.key)
SELECT l.document_id, l.site_id, l.seq, l.type FROM log l LEFT JOIN peer p ON p.document_id = l.document_id AND p.site_id = l.site_id WHERE l.seq > coalesce(p.known, 0)""",
    "clock_pairs": """SELECT batch_id, CAST(list_sum(list_transform(list_distinct(list_concat(map_keys(vector_clock), map_keys(compacted))),
    lambda k: greatest(coalesce(vector_clock[k], 0), coalesce(compacted[k], 0)))) AS BIGINT) AS merged_total,
  len(list_filter(map_entries(compacted), lambda e: e.value > coalesce(vector_clock[e.key], 0))) = 0 AS covered
FROM (SELECT * FROM delta_batches WHERE compacted IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch_id) = 1)""",
    "compaction_gap": f"""WITH {MESSAGES}, {IDS}, {ISLANDS}, f AS (SELECT document_id, site_id, max(hi) FILTER (WHERE lo = 1) AS frontier FROM islands GROUP BY document_id, site_id),
n AS (SELECT DISTINCT batch_id, document_id, e.key AS site_id, e.value AS needed FROM (SELECT batch_id, document_id, unnest(map_entries(compacted)) AS e FROM delta_batches))
SELECT batch_id, count(*) AS sites FROM n LEFT JOIN f USING (document_id, site_id) WHERE needed > coalesce(frontier, 0) GROUP BY batch_id""",
    "outbox_pending": """SELECT id, CAST(len(pending) AS BIGINT) AS pending, greatest(synced_through, list_max(list_transform(pending, lambda o: o.seq))) AS watermark FROM (
  SELECT id, synced_through, list_filter(coalesce(outbox_ops, []), lambda o: o.site_id = site_id AND o.seq > synced_through) AS pending FROM replica_snapshots
  QUALIFY row_number() OVER (PARTITION BY id) = 1)""",
    "feature_liveness": f"WITH {LOG}, {LIFE} SELECT document_id, feature_id, is_base, created[1] AS created_ts, deleted[1] AS deleted_ts, visible FROM lives",
    "visible_features": f"WITH {LOG}, {LIFE} SELECT document_id, feature_id FROM lives WHERE visible",
    "property_lww": f"WITH {LOG}, {WRITES} SELECT document_id, feature_id, property_key, ts, site_id, seq, gone FROM won",
    "property_tombstones": f"WITH {LOG}, {WRITES} SELECT document_id, feature_id, property_key, ts, site_id, seq FROM won WHERE gone",
    "property_values": f"WITH {LOG}, {LIFE}, {WRITES} SELECT document_id, feature_id, property_key, value FROM won SEMI JOIN (SELECT * FROM lives WHERE visible) USING (document_id, feature_id) WHERE NOT gone",
    "geometry_layout": f"WITH {TABLES}, {LIFE} SELECT document_id, feature_id, CASE WHEN len(parts[1][1][1]) = 3 THEN 'XYZ' ELSE 'XY' END AS layout FROM shapes SEMI JOIN (SELECT * FROM lives WHERE visible) USING (document_id, feature_id)",
    "vertex_at_index": f"WITH RECURSIVE s AS ({SQL['structure_view']}) SELECT document_id, feature_id, part_id, ring_id, vertex_id FROM s WHERE \"index\" = 2",
    "signed_area": f"WITH {RINGS} SELECT {PLACE}, round(CASE WHEN len(ring) < 3 THEN 0.0 ELSE {area('ring')} / 2 END, 6) AS area FROM r",
    "dedup_positions": f"""WITH {RINGS}, d AS (SELECT {PLACE}, list_append(ring, ring[len(ring)]) AS ring FROM r)
SELECT {PLACE}, CAST(len(list_filter(range(1, len(ring) + 1), lambda i: i = 1 OR NOT (ring[i][1] = ring[i - 1][1] AND ring[i][2] = ring[i - 1][2]))) AS INTEGER) AS positions FROM d""",
    "close_ring": f"WITH {RINGS} SELECT {PLACE}, CAST(len(shut) AS INTEGER) AS positions, shut[len(shut)][1] AS last_x FROM c",
    "orient_ring": f"""WITH {RINGS}, t AS (SELECT {PLACE}, shut, {area('shut')} AS twice, len(shut) AS n FROM c)
SELECT {PLACE}, CASE WHEN twice > 0 THEN shut[n - 2][1] ELSE shut[2][1] END AS x, CASE WHEN twice > 0 THEN shut[n - 2][2] ELSE shut[2][2] END AS y,
  CASE WHEN twice < 0 THEN shut[n - 2][1] ELSE shut[2][1] END AS outer_x, CASE WHEN twice < 0 THEN shut[n - 2][2] ELSE shut[2][2] END AS outer_y FROM t""",
    "degenerate_ring": f"""WITH {RINGS}, k AS (SELECT {PLACE}, list_filter(range(1, len(ring) + 1), lambda i: i = 1 OR NOT (ring[i][1] = ring[i - 1][1] AND ring[i][2] = ring[i - 1][2])) AS kept, ring FROM r)
SELECT {PLACE}, true AS cut, len(kept) - CASE WHEN len(kept) >= 2 AND ring[kept[1]][1] = ring[kept[len(kept)]][1] AND ring[kept[1]][2] = ring[kept[len(kept)]][2] THEN 1 ELSE 0 END < 3 AS whole FROM k""",
}
SQL |= {
    "stream_merge": P5_FOUND,
    "op_store": SQL["delta_since"],
    "snapshot_state": """SELECT snapshot_id, f.id AS feature_id, f.base AS base, f.create_reg.ts AS created_ts, f.delete_reg.ts AS deleted_ts, f.geometry.type AS type,
  CAST(coalesce(list_sum(list_transform(f.geometry.parts, lambda p: list_sum(list_transform(p.rings, lambda r: len(r.vertices))))), 0) AS BIGINT) AS vertices
FROM (SELECT id AS snapshot_id, unnest(features) AS f FROM replica_snapshots QUALIFY row_number() OVER (PARTITION BY id) = 1)""",
}


def number(x: str) -> str:
    """A double as the engine writes it, for the magnitudes that need no exponent."""
    plain = f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"
    return f"CASE WHEN abs({x}) BETWEEN 1e-4 AND 1e15 OR {x} = 0 THEN {plain} END"


def position(coord: str) -> str:
    return f"'[' || array_to_string(list_transform({coord}, lambda x: {number('x')}), ',') || ']'"


#: Exported geometries: positions of visible vertices in document order, put together ring by ring.
EXPORTED = f"""{STRUCTURE},
shown AS (
  SELECT o.document_id, o.feature_id, o.part_id, o.ring_id, o.ord, {position('v.coord')} AS text
  FROM ordered o JOIN vertices v USING (document_id, feature_id, part_id, ring_id, vertex_id) WHERE NOT o.deleted
),
lines AS (SELECT document_id, feature_id, part_id, ring_id, string_agg(text, ',' ORDER BY ord) AS body, min_by(text, ord) AS head FROM shown GROUP BY document_id, feature_id, part_id, ring_id),
ring_texts AS (
  SELECT r.document_id, r.feature_id, r.part_id, r.pos, r.ts, n.site_id, n.seq, r.part_type, l.head,
    CASE WHEN l.body IS NULL THEN '[]' WHEN r.part_type = 'Polygon' THEN '[' || l.body || ',' || l.head || ']' ELSE '[' || l.body || ']' END AS text
  FROM rings r LEFT JOIN lines l USING (document_id, feature_id, part_id, ring_id) LEFT JOIN new_rings n USING (document_id, feature_id, part_id, ring_id)
  WHERE NOT r.deleted OR r.part_type <> 'Polygon'
),
part_texts AS (
  SELECT document_id, feature_id, part_id, CASE part_type WHEN 'Polygon' THEN '[' || string_agg(text, ',' ORDER BY pos NULLS LAST, ts, site_id, seq) || ']' WHEN 'Point' THEN min(head) ELSE min(text) END AS text
  FROM ring_texts GROUP BY document_id, feature_id, part_id, part_type
),
bodies AS (SELECT p.document_id, p.feature_id, string_agg(t.text, ',' ORDER BY p.part_no) AS body FROM p_no p JOIN part_texts t USING (document_id, feature_id, part_id) GROUP BY p.document_id, p.feature_id),
exported AS (
  SELECT s.document_id, s.feature_id, s.type, CAST(coalesce(len(s.parts[1][1][1]), 2) AS INTEGER) AS dims,
    '{{"type":"' || s.type || '","coordinates":' || CASE WHEN starts_with(s.type, 'Multi') THEN '[' || coalesce(b.body, '') || ']' ELSE b.body END || '}}' AS geometry
  FROM shapes s LEFT JOIN bodies b USING (document_id, feature_id)
)"""
NORMAL = f"""b AS (SELECT DISTINCT document_id, feature_id, geometry FROM base_features),
shapes AS (SELECT document_id, feature_id, json_extract_string(geometry, '$.type') AS type, {parts_of('geometry')} AS parts FROM b WHERE geometry IS NOT NULL),
v AS (SELECT * EXCLUDE (coord), {position('coord')} AS text FROM ({flat('shapes', 'document_id, feature_id')})),
rings AS (
  SELECT document_id, feature_id, type, p, r, '[' || string_agg(text, ',' ORDER BY k) || CASE WHEN ends_with(type, 'Polygon') THEN ',' || min_by(text, k) ELSE '' END || ']' AS text, min_by(text, k) AS head
  FROM v GROUP BY document_id, feature_id, type, p, r
),
parts AS (
  SELECT document_id, feature_id, type, p, CASE WHEN ends_with(type, 'Polygon') THEN '[' || string_agg(text, ',' ORDER BY r) || ']' WHEN ends_with(type, 'Point') THEN min(head) ELSE min(text) END AS text
  FROM rings GROUP BY document_id, feature_id, type, p
),
whole AS (SELECT document_id, feature_id, '{{"type":"' || type || '","coordinates":' || CASE WHEN starts_with(type, 'Multi') THEN '[' || string_agg(text, ',' ORDER BY p) || ']' ELSE min(text) END || '}}' AS geometry FROM parts GROUP BY document_id, feature_id, type)"""
_TEXT = lambda x: f"CAST(to_json({x}) AS VARCHAR)"
FEATURES = f"""{EXPORTED}, {LIFE}, {WRITES},
held AS (SELECT document_id, feature_id, string_agg({_TEXT('property_key')} || ':' || {as_data('value')}, ',' ORDER BY property_key) AS members FROM won WHERE NOT gone GROUP BY document_id, feature_id),
features AS (
  SELECT l.document_id, l.feature_id, e.geometry,
    '{{"type":"Feature","id":' || {_TEXT('l.feature_id')} || ',"geometry":' || coalesce(e.geometry, 'null') || ',"properties":{{' || coalesce(h.members, '') || '}}}}' AS feature
  FROM (SELECT * FROM lives WHERE visible) l LEFT JOIN exported e USING (document_id, feature_id) LEFT JOIN held h USING (document_id, feature_id)
)"""


def kept(ring: str) -> str:
    """Numbers of the positions that don't repeat the one before in the plane."""
    return f"list_filter(range(1, len({ring}) + 1), lambda i: i = 1 OR NOT ({ring}[i][1] = {ring}[i - 1][1] AND {ring}[i][2] = {ring}[i - 1][2]))"


def shut(ring: str) -> str:
    """Whether a ring ends where it begins, in the plane."""
    return f"({ring}[1][1] = {ring}[-1][1] AND {ring}[1][2] = {ring}[-1][2])"


#: Exported geometries read back: closed rings by polygon and ring number.
READ = f"""{EXPORTED},
closed AS (
  SELECT document_id, feature_id, type, p, unnest(range(len(part))) AS r, unnest(part) AS ring FROM (
    SELECT document_id, feature_id, type, unnest(range(len(parts))) AS p, unnest(parts) AS part FROM (
      SELECT document_id, feature_id, type, {parts_of('geometry')} AS parts FROM exported WHERE type IN ('Polygon', 'MultiPolygon')))
)"""
#: The four basic repairs, ring by ring; a dropped exterior drops its polygon.
REPAIRED = f"""{READ},
thin AS (SELECT * EXCLUDE (ring), list_transform({kept('ring')}, lambda i: ring[i]) AS a FROM closed),
shut AS (SELECT * EXCLUDE (a), CASE WHEN len(a) >= 3 AND NOT {shut('a')} THEN list_append(a, a[1]) ELSE a END AS b FROM thin),
turned AS (
  SELECT * EXCLUDE (b), CASE WHEN len(b) >= 3 AND (CASE WHEN r = 0 THEN {area('b')} < 0 ELSE {area('b')} > 0 END)
    THEN list_append(list_reverse(b[1:len(b) - 1]), b[len(b) - 1]) ELSE b END AS c FROM shut
),
sound AS (SELECT *, len({kept('c')}) - CASE WHEN len({kept('c')}) >= 2 AND {shut('c')} THEN 1 ELSE 0 END >= 3 AS good FROM turned),
whole AS (SELECT document_id, feature_id, p, '[' || string_agg('[' || array_to_string(list_transform(c, lambda q: {position('q')}), ',') || ']', ',' ORDER BY r) FILTER (WHERE good) || ']' AS text
  FROM sound GROUP BY document_id, feature_id, p HAVING bool_and(good OR r > 0)),
fixed AS (SELECT document_id, feature_id, string_agg(text, ',' ORDER BY p) AS body FROM whole GROUP BY document_id, feature_id)"""


def turn(a: str, b: str, c: str) -> str:
    """Sign of the turn a → b → c; points are prefixes of columns x and y."""
    return f"sign(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"


def on(a: str, b: str, c: str) -> str:
    """Whether c, in line with a and b, lies between them."""
    return f"({c}x BETWEEN least({a}x, {b}x) AND greatest({a}x, {b}x) AND {c}y BETWEEN least({a}y, {b}y) AND greatest({a}y, {b}y))"


#: Sides of closed rings, pairs of sides that meet, and where each corner lies to the other rings of its polygon.
SIDES = f"""{READ},
corners AS (SELECT document_id, feature_id, p, r, k, ring[k][1] AS x, ring[k][2] AS y, ring[k + 1][1] AS nx, ring[k + 1][2] AS ny FROM (SELECT *, unnest(range(1, len(ring))) AS k FROM closed)),
sides AS (SELECT *, row_number() OVER (PARTITION BY document_id, feature_id, p, r ORDER BY k) AS n, count(*) OVER (PARTITION BY document_id, feature_id, p, r) AS sides FROM corners WHERE x <> nx OR y <> ny),
facing AS (
  SELECT s.document_id, s.feature_id, s.p, s.r, s.n, s.sides, t.p AS p2, t.r AS r2, t.n AS n2,
    s.x AS ax, s.y AS ay, s.nx AS ex, s.ny AS ey, t.x AS cx, t.y AS cy, t.nx AS dx, t.ny AS dy
  FROM sides s JOIN sides t ON s.document_id = t.document_id AND s.feature_id = t.feature_id AND (s.p < t.p OR s.p = t.p AND (s.r < t.r OR s.r = t.r AND s.n < t.n))
    AND greatest(s.x, s.nx) >= least(t.x, t.nx) AND greatest(t.x, t.nx) >= least(s.x, s.nx) AND greatest(s.y, s.ny) >= least(t.y, t.ny) AND greatest(t.y, t.ny) >= least(s.y, s.ny)
),
turns AS (SELECT *, {turn('a', 'e', 'c')} AS t1, {turn('a', 'e', 'd')} AS t2, {turn('c', 'd', 'a')} AS t3, {turn('c', 'd', 'e')} AS t4 FROM facing),
met AS (
  SELECT *, CASE WHEN t1 = 0 AND t2 = 0 AND t3 = 0 AND t4 = 0 THEN
      CASE len(list_distinct(list_filter([CASE WHEN {on('a', 'e', 'c')} THEN [cx, cy] END, CASE WHEN {on('a', 'e', 'd')} THEN [dx, dy] END, CASE WHEN {on('c', 'd', 'a')} THEN [ax, ay] END, CASE WHEN {on('c', 'd', 'e')} THEN [ex, ey] END], lambda q: q IS NOT NULL)))
        WHEN 0 THEN NULL WHEN 1 THEN 'touch' ELSE 'overlap' END
    WHEN t1 * t2 < 0 AND t3 * t4 < 0 THEN 'cross'
    WHEN t1 = 0 AND {on('a', 'e', 'c')} OR t2 = 0 AND {on('a', 'e', 'd')} OR t3 = 0 AND {on('c', 'd', 'a')} OR t4 = 0 AND {on('c', 'd', 'e')} THEN 'touch' END AS how FROM turns
),
seats AS (
  SELECT c.document_id, c.feature_id, c.p, c.r, c.k, o.r AS outer_r,
    bool_or({turn('o.', 'o.n', 'c.')} = 0 AND {on('o.', 'o.n', 'c.')}) AS border,
    count(*) FILTER (WHERE (o.y > c.y) <> (o.ny > c.y) AND ({turn('o.', 'o.n', 'c.')} > 0) = (o.ny > o.y)) % 2 = 1 AS odd
  FROM corners c JOIN sides o ON c.document_id = o.document_id AND c.feature_id = o.feature_id AND c.p = o.p AND c.r <> o.r
  GROUP BY c.document_id, c.feature_id, c.p, c.r, c.k, o.r
),
within AS (SELECT document_id, feature_id, p, r, outer_r, min_by(odd, k) FILTER (WHERE NOT border) AS inside FROM seats GROUP BY document_id, feature_id, p, r, outer_r),
far_seats AS (
  SELECT c.document_id, c.feature_id, c.p, c.k, o.p AS outer_p, o.r AS outer_r,
    bool_or({turn('o.', 'o.n', 'c.')} = 0 AND {on('o.', 'o.n', 'c.')}) AS border,
    count(*) FILTER (WHERE (o.y > c.y) <> (o.ny > c.y) AND ({turn('o.', 'o.n', 'c.')} > 0) = (o.ny > o.y)) % 2 = 1 AS odd
  FROM corners c JOIN sides o ON c.document_id = o.document_id AND c.feature_id = o.feature_id AND c.p <> o.p WHERE c.r = 0
  GROUP BY c.document_id, c.feature_id, c.p, c.k, o.p, o.r
),
far AS (SELECT document_id, feature_id, p, outer_p, outer_r, min_by(odd, k) FILTER (WHERE NOT border) AS inside FROM far_seats GROUP BY document_id, feature_id, p, outer_p, outer_r),
problems AS (
  SELECT document_id, feature_id, p, 1 AS phase, r AS a, 0 AS b, 0 AS c, CASE WHEN len(ring) < 4 THEN ' has fewer than 4 positions' ELSE ' winds the wrong way' END AS what FROM closed
    WHERE len(ring) < 4 OR CASE WHEN r = 0 THEN {area('ring')} < 0 ELSE {area('ring')} > 0 END
  UNION ALL SELECT DISTINCT document_id, feature_id, p, 2, r, 0, 0, ' intersects itself' FROM met WHERE p = p2 AND r = r2 AND how IS NOT NULL AND NOT (how = 'touch' AND n2 - n IN (1, sides - 1))
  UNION ALL SELECT DISTINCT document_id, feature_id, p, 3, r, r2, 0, 'cross' FROM met WHERE p = p2 AND r <> r2 AND how IN ('cross', 'overlap')
  UNION ALL SELECT document_id, feature_id, p, 3, 0, r, 1, 'outside' FROM within WHERE outer_r = 0 AND NOT coalesce(inside, false)
  UNION ALL SELECT document_id, feature_id, p, 3, outer_r, r, 1, 'nested' FROM within WHERE outer_r > 0 AND r > outer_r AND inside
  UNION ALL SELECT document_id, feature_id, p, 3, r, outer_r, 1, 'nested' FROM within WHERE r > 0 AND outer_r > r AND inside
  UNION ALL SELECT DISTINCT document_id, feature_id, 1000000, 4, p, p2, 0, 'polygons' FROM met WHERE p <> p2 AND how IN ('cross', 'overlap')
  UNION ALL SELECT document_id, feature_id, 1000000, 4, least(p, outer_p), greatest(p, outer_p), 1, 'inside' FROM far GROUP BY document_id, feature_id, p, outer_p
    HAVING bool_or(outer_r = 0 AND coalesce(inside, true)) AND NOT coalesce(bool_or(outer_r > 0 AND inside), false)
)"""
WIRE_GEOMETRY = "type IN ('insert_feature', 'set_geometry') AND geometry IS NOT NULL AND geometry <> '' AND NOT regexp_matches(geometry, '^[ \\t\\r\\n]*null[ \\t\\r\\n]*$')"


def _blank(column: str) -> str:
    return f"NOT coalesce(regexp_matches({column}, '{NOT_SPACE}'), false)"


_RANGE = "BETWEEN 1 AND 4611686018427387903"
_CREATED = " ".join(
    f"WHEN geometry_op.action = '{action}' AND coalesce(geometry_op.{field}, '') <> '' AND geometry_op.{field} <> '{prefix}:' || site_id || ':' || seq THEN '{field} must be derived from the operation'"
    for action, (field, prefix) in CREATED.items()
)
_EDIT = "type = 'edit_geometry' AND"
_LACKS = lambda field: f"coalesce(geometry_op.{field}, '') = ''"
_ACTION = "coalesce(geometry_op.action, '')"


def _bad_clock(clock: str) -> str:
    return f"len(list_filter(map_entries({clock}), lambda e: {_blank('e.key')} OR e.value IS NULL OR e.value < 0 OR e.value >= 4611686018427387904)) > 0"


DELTA_ERROR = f"""CASE WHEN coalesce(version, 0) <> 3 THEN 'unsupported version' WHEN {_blank('d.document_id')} THEN 'document_id is required' WHEN {_blank('d.site_id')} THEN 'site_id is required'
  WHEN clock IS NULL OR clock < 0 OR clock >= 4611686018427387904 THEN 'clock is out of range'
  WHEN {_bad_clock('vector_clock')} OR {_bad_clock('compacted')} THEN 'invalid vector clock'
  WHEN len(list_filter(map_entries(coalesce(compacted, MAP {{}})), lambda e: e.value > coalesce(vector_clock[e.key], 0))) > 0 THEN 'compacted exceeds the vector clock'
  WHEN n.ts > clock THEN 'an operation is newer than the clock' END"""
SQL |= {
    "delta_refusals": f"""WITH {MESSAGES}, {IDS}, {ISLANDS}, newest AS (SELECT batch_id, max(ts) AS ts FROM m WHERE batch_id IS NOT NULL GROUP BY batch_id),
heads AS (SELECT document_id, min(base_hash) AS base_hash FROM replica_snapshots GROUP BY document_id),
k AS (SELECT document_id, map_from_entries(list(row(site_id, frontier))) AS known FROM (
  SELECT document_id, site_id, coalesce(max(hi) FILTER (WHERE lo = 1), 0) AS frontier FROM islands GROUP BY document_id, site_id) GROUP BY document_id)
SELECT coalesce({DELTA_ERROR}, CASE WHEN h.document_id IS NULL THEN 'DocumentMismatch' WHEN d.base_hash IS DISTINCT FROM h.base_hash THEN 'BaseMismatch'
  WHEN len(list_filter(map_entries(coalesce(compacted, MAP {{}})), lambda e: e.value > coalesce(k.known[e.key], 0))) > 0 THEN 'CompactionGap' END) AS refused, count(*) AS batches
FROM delta_batches d LEFT JOIN newest n USING (batch_id) LEFT JOIN heads h ON h.document_id = d.document_id LEFT JOIN k ON k.document_id = d.document_id GROUP BY 1""",
    "ring_sizes": f"""WITH RECURSIVE {ORDERED}
SELECT r.document_id, r.feature_id, r.part_id, r.ring_id, count(v.vertex_id) FILTER (WHERE NOT v.deleted) AS visible, count(v.vertex_id) AS total
FROM rings r LEFT JOIN ordered v USING (document_id, feature_id, part_id, ring_id) GROUP BY ALL""",
    "export_geometry": f"WITH RECURSIVE {EXPORTED} SELECT document_id, feature_id, type, dims, geometry FROM exported",
    "geometry_from_tables": f"WITH RECURSIVE {EXPORTED} SELECT document_id, feature_id, type, dims, geometry FROM exported",
    "single_geometries": f"""SELECT e.document_id || '/' || e.feature_id AS geometry_id, e.type, e.geometry, sha256(n.geometry) AS lineage
FROM (WITH RECURSIVE {EXPORTED.replace(WIN, BASE_ONLY)} SELECT * FROM exported) e JOIN (WITH {NORMAL} SELECT * FROM whole) n USING (document_id, feature_id)""",
    "stream_edits": f"WITH RECURSIVE {EXPORTED} SELECT document_id, feature_id, geometry FROM exported",
    "rebase_base": f"""WITH RECURSIVE {EXPORTED}, {LIFE}, {WRITES},
held AS (SELECT document_id, feature_id, string_agg(property_key || '=' || coalesce(value, ''), chr(10) ORDER BY property_key) AS properties FROM won WHERE NOT gone GROUP BY document_id, feature_id)
SELECT l.document_id, l.feature_id, e.geometry, coalesce(h.properties, '') AS properties
FROM (SELECT * FROM lives WHERE visible) l LEFT JOIN exported e USING (document_id, feature_id) LEFT JOIN held h USING (document_id, feature_id)""",
    "polygon_repair": f"""WITH RECURSIVE {REPAIRED}
SELECT e.document_id, e.feature_id, CASE WHEN NOT ends_with(e.type, 'Polygon') THEN e.geometry
  ELSE '{{"type":"' || e.type || '","coordinates":' || CASE WHEN e.type = 'Polygon' THEN coalesce(f.body, '[]') ELSE '[' || coalesce(f.body, '') || ']' END || '}}' END AS geometry
FROM exported e LEFT JOIN fixed f USING (document_id, feature_id)""",
    "polygon_validity": f"""WITH RECURSIVE {SIDES}
SELECT document_id, feature_id, CASE WHEN phase < 3 THEN CASE WHEN a = 0 THEN 'exterior ring' ELSE 'interior ring ' || a END || what
  WHEN what = 'cross' THEN 'rings ' || a || ' and ' || b || ' cross or share a line' WHEN what = 'outside' THEN 'interior ring ' || b || ' isn''t inside the exterior'
  WHEN what = 'nested' THEN 'interior rings ' || a || ' and ' || b || ' are nested' ELSE 'polygons ' || a || ' and ' || b || ' overlap' || CASE WHEN what = 'polygons' THEN ' or share a line' ELSE '' END END AS problem
FROM problems QUALIFY row_number() OVER (PARTITION BY document_id, feature_id ORDER BY p, phase, a, b, c) = 1""",
    "identity_collisions": COLLISIONS,
    "delta_wire": f"""WITH {LOG}, {CLOCK_ROWS}, {IDS}, {ISLANDS},
peer AS (SELECT document_id, e.key AS site_id, min(e.value) AS known FROM entries GROUP BY document_id, e.key),
heads AS (SELECT document_id, max(row(version, site_id, base_hash)) AS h FROM delta_batches GROUP BY document_id),
clocks AS (SELECT document_id, max(ts) AS clock FROM log GROUP BY document_id),
vectors AS (SELECT document_id, string_agg({_TEXT('site_id')} || ':' || n, ',' ORDER BY site_id) AS body FROM (
  SELECT document_id, site_id, coalesce(max(hi) FILTER (WHERE lo = 1), 0) AS n FROM islands GROUP BY document_id, site_id) GROUP BY document_id),
ops AS (
  SELECT l.document_id, l.site_id, l.seq, '{{"type":' || {_TEXT('type')} || ',"site_id":' || {_TEXT('l.site_id')} || ',"seq":' || l.seq || ',"ts":' || ts || ',"feature_id":' || {_TEXT('feature_id')}
    || coalesce(',"geometry":' || {as_data('geometry')}, '')
    || CASE WHEN coalesce(cardinality(properties), 0) > 0 THEN ',"properties":{{' || array_to_string(list_transform(list_sort(map_entries(properties)), lambda e: {_TEXT('e.key')} || ':' || {as_data('e.value')}), ',') || '}}' ELSE '' END
    || coalesce(',"property_key":' || {_TEXT("nullif(property_key, '')")}, '') || coalesce(',"property_value":' || {as_data('property_value')}, '')
    || coalesce(',"gen":{{"site_id":' || {_TEXT('gen.site_id')} || ',"seq":' || gen.seq || '}}', '')
    || CASE WHEN geometry_op IS NULL THEN '' ELSE ',"geometry_op":{{"action":' || {_TEXT('geometry_op.action')}
      || {' || '.join(f"""coalesce(',"{c}":' || {_TEXT(f"nullif(geometry_op.{c}, '')")}, '')""" for c in ('part_id', 'ring_id', 'vertex_id', 'after_vertex_id'))}
      || CASE WHEN coalesce(len(geometry_op.coord), 0) > 0 THEN ',"coord":' || {position('geometry_op.coord')} ELSE '' END
      || CASE WHEN coalesce(len(geometry_op.ring), 0) > 0 THEN ',"ring":[' || array_to_string(list_transform(geometry_op.ring, lambda q: {position('q')}), ',') || ']' ELSE '' END
      || coalesce(',"part":' || {as_data('geometry_op.part')}, '') || '}}' END || '}}' AS text
  FROM log l LEFT JOIN peer p ON p.document_id = l.document_id AND p.site_id = l.site_id WHERE l.seq > coalesce(p.known, 0)
),
lists AS (SELECT document_id, string_agg(text, ',' ORDER BY site_id, seq) AS body FROM ops GROUP BY document_id)
SELECT document_id, '{{"version":' || h[1] || ',"document_id":' || {_TEXT('document_id')} || ',"site_id":' || {_TEXT('h[2]')} || ',"base_hash":' || {_TEXT('h[3]')} || ',"clock":' || clock
  || ',"vector_clock":{{' || v.body || '}},"ops":[' || coalesce(o.body, '') || ']}}' AS delta
FROM heads JOIN clocks USING (document_id) JOIN vectors v USING (document_id) LEFT JOIN lists o USING (document_id)""",
    "export_features": f"WITH RECURSIVE {FEATURES} SELECT * FROM features",
    "export_feature_collection": f"""WITH RECURSIVE {FEATURES}
SELECT document_id, '{{"type":"FeatureCollection","features":[' || string_agg(feature, ',' ORDER BY feature_id) || ']}}' AS collection FROM features GROUP BY document_id""",
    "lineage_hash": f"""WITH {NORMAL},
once AS (SELECT DISTINCT document_id, feature_id, properties FROM base_features),
texts AS (
  SELECT o.document_id, o.feature_id, '{{"id":' || {_TEXT('o.feature_id')} || ',"geometry":' || coalesce(w.geometry, 'null') || ',"properties":' || CASE WHEN cardinality(o.properties) > 0
    THEN '{{' || array_to_string(list_transform(list_sort(map_entries(o.properties)), lambda e: {_TEXT('e.key')} || ':' || {as_data('e.value')}), ',') || '}}' ELSE 'null' END || '}}' AS text
  FROM once o LEFT JOIN whole w USING (document_id, feature_id)
)
SELECT document_id, sha256('{{"document_id":' || {_TEXT('document_id')} || ',"features":[' || string_agg(text, ',' ORDER BY feature_id) || ']}}') AS base_hash FROM texts GROUP BY document_id""",
    "normalized_geometry": f"WITH {NORMAL} SELECT b.document_id, b.feature_id, w.geometry FROM b LEFT JOIN whole w USING (document_id, feature_id)",
    "envelope_errors": f"""SELECT CASE {_CREATED}
  WHEN {_blank('site_id')} THEN 'site_id is required' WHEN NOT coalesce(seq {_RANGE}, false) THEN 'seq is out of range' WHEN NOT coalesce(ts {_RANGE}, false) THEN 'ts is out of range'
  WHEN {_blank('feature_id')} THEN 'feature_id is required'
  WHEN coalesce(type, '') NOT IN ({', '.join(f"'{t}'" for t in OP_TYPES)}) THEN 'unknown operation type'
  WHEN {WIRE_GEOMETRY} AND NOT json_valid(geometry) THEN 'geometry must be JSON'
  WHEN type = 'insert_feature' AND len(list_filter(map_values(properties), lambda v: coalesce(v, '') = '')) > 0 THEN 'property values must be JSON'
  WHEN type IN ('set_property', 'delete_property') AND {_blank('property_key')} THEN 'property_key is required'
  WHEN type = 'set_property' AND NOT coalesce(property_value <> '' AND json_valid(property_value), false) THEN 'property_value must be JSON'
  WHEN {_EDIT} geometry_op IS NULL THEN 'geometry_op is required'
  WHEN {_EDIT} {_ACTION} NOT IN ({', '.join(f"'{a}'" for a in ACTIONS)}) THEN 'unknown geometry action'
  WHEN {_EDIT} {_ACTION} <> 'add_part' AND {_LACKS('part_id')} THEN 'part_id is required'
  WHEN {_EDIT} {_ACTION} IN ('insert_vertex', 'move_vertex', 'delete_vertex', 'remove_ring') AND {_LACKS('ring_id')} THEN 'ring_id is required'
  WHEN {_EDIT} {_ACTION} IN ('move_vertex', 'delete_vertex') AND {_LACKS('vertex_id')} THEN 'vertex_id is required'
  WHEN {_EDIT} {_ACTION} = 'add_ring' AND coalesce(len(geometry_op.ring), 0) = 0 THEN 'ring coordinates are required'
  WHEN {_EDIT} {_ACTION} = 'add_part' AND {_LACKS('part')} THEN 'a part geometry is required' END AS error, count(*) AS deliveries
FROM op_messages GROUP BY 1""",
    "state_table": f"""WITH RECURSIVE {ORDERED}, {LIFE},
held AS (SELECT DISTINCT document_id, feature_id FROM log WHERE type <> 'edit_geometry' UNION SELECT document_id, feature_id FROM base_features),
counts AS (SELECT document_id, feature_id, count(*) AS n FROM ordered GROUP BY document_id, feature_id)
SELECT h.document_id, h.feature_id, coalesce(l.is_base, false) AS base, l.created[1] AS created_ts, l.deleted[1] AS deleted_ts, s.type, coalesce(c.n, 0) AS vertices
FROM held h LEFT JOIN life l USING (document_id, feature_id) LEFT JOIN shapes s USING (document_id, feature_id) LEFT JOIN counts c USING (document_id, feature_id)""",
    "delta_errors": f"""WITH {MESSAGES}, newest AS (SELECT batch_id, max(ts) AS ts FROM m WHERE batch_id IS NOT NULL GROUP BY batch_id)
SELECT {DELTA_ERROR} AS error, count(*) AS batches
FROM delta_batches d LEFT JOIN newest n USING (batch_id) GROUP BY 1""",
}
