"""Standard SQL for the queries of problems.py, over views named as the tables."""

from lamina.operators.messages import NOT_SPACE

#: Rows that are messages.
MESSAGES = f"""m AS (
  SELECT * FROM op_messages
  WHERE regexp_matches(document_id, '{NOT_SPACE}') AND regexp_matches(site_id, '{NOT_SPACE}')
    AND regexp_matches(type, '{NOT_SPACE}') AND regexp_matches(feature_id, '{NOT_SPACE}')
    AND seq BETWEEN 1 AND 4611686018427387903 AND ts BETWEEN 1 AND 4611686018427387903
)"""
IDS = "ids AS (SELECT DISTINCT document_id, site_id, seq FROM m)"
ISLANDS = """islands AS (
  SELECT document_id, site_id, min(seq) AS lo, max(seq) AS hi FROM (
    SELECT *, seq - row_number() OVER (PARTITION BY document_id, site_id ORDER BY seq) AS island FROM ids)
  GROUP BY document_id, site_id, island
)"""
MARKS = """marks AS (
  SELECT document_id, site_id, coalesce(through_seq, 0) AS through_seq, staged_seqs FROM (
    SELECT *, row_number() OVER (PARTITION BY document_id, site_id
      ORDER BY finished_at DESC NULLS LAST, coalesce(through_seq, 0) DESC, coalesce(len(staged_seqs), 0) DESC) AS place
    FROM sync_runs WHERE lower(status) = 'succeeded') WHERE place = 1
)"""
REMAINING = """remaining AS (
  SELECT i.* FROM ids i LEFT JOIN marks k ON i.document_id = k.document_id AND i.site_id = k.site_id
  WHERE i.seq > coalesce(k.through_seq, 0) AND NOT coalesce(list_contains(k.staged_seqs, i.seq), false)
)"""

def canonical(x: str, depth: int = 3) -> str:
    """Canonical text of a JSON text as far down as ``depth``: members sorted, no spaces; numbers keep their spelling at the top only."""
    if not depth:
        return f"CAST(json({x}) AS VARCHAR)"
    k, e = f"k{depth}", f"e{depth}"
    return (
        f"CASE json_type({x}) WHEN 'OBJECT' THEN '{{' || array_to_string(list_transform(list_sort(json_keys({x})), lambda {k}: CAST(to_json({k}) AS VARCHAR) || ':' || {canonical(f'json_extract({x}, {_member(k)})', depth - 1)}), ',') || '}}' "
        f"WHEN 'ARRAY' THEN '[' || array_to_string(list_transform(json_extract({x}, '$[*]'), lambda {e}: {canonical(e, depth - 1)}), ',') || ']' "
        f"WHEN 'VARCHAR' THEN CAST(json({x}) AS VARCHAR) ELSE regexp_replace(CAST({x} AS VARCHAR), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') END"
    )


def _member(k: str) -> str:
    return f"'$.\"' || {k} || '\"'"


def as_data(x: str) -> str:
    """A JSON text as data: canonical, or marked as no JSON; null for the empty text."""
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL WHEN json_valid({x}) THEN {canonical(x)} ELSE '!' || {x} END"


def _made(field: str, action: str, prefix: str) -> str:
    return f"CASE WHEN geometry_op.action = '{action}' AND coalesce(geometry_op.{field}, '') = '' THEN '{prefix}:' || site_id || ':' || seq ELSE geometry_op.{field} END"


#: Messages with their content as data.
CONTENT = f"""contents AS (
  SELECT delivery_id, document_id, site_id, seq, [
    type, CAST(ts AS VARCHAR), feature_id, property_key, {as_data('geometry')}, {as_data('property_value')}, CAST(gen AS VARCHAR), geometry_op.action,
    CAST(list_sort(list_transform(map_entries(coalesce(properties, MAP {{}})), lambda e: to_json(e.key) || ':' || coalesce({as_data('e.value')}, ''))) AS VARCHAR),
    {', '.join(_made(*m) for m in (('part_id', 'add_part', 'part'), ('ring_id', 'add_ring', 'ring'), ('vertex_id', 'insert_vertex', 'op')))},
    geometry_op.after_vertex_id, CAST(geometry_op.coord AS VARCHAR), CAST(geometry_op.ring AS VARCHAR), {as_data('geometry_op.part')}, CAST(geometry_op IS NULL AS VARCHAR)] AS content
  FROM m)"""
P1_FOUND = f"""WITH {MESSAGES}, {CONTENT}
SELECT delivery_id FROM contents QUALIFY min(delivery_id) OVER (PARTITION BY document_id, site_id, seq, content) < delivery_id"""
COLLISIONS = f"""WITH {MESSAGES}, {CONTENT}
SELECT document_id, site_id, seq, count(DISTINCT content) AS contents FROM contents GROUP BY document_id, site_id, seq HAVING count(DISTINCT content) > 1"""
P1_RANGES = f"WITH {MESSAGES}, {IDS}, {ISLANDS} SELECT document_id, site_id, lo, hi FROM islands"
P1_ACCEPTED = f"WITH {MESSAGES} SELECT document_id, site_id, seq, min(delivery_id) AS first_delivery, count(*) AS deliveries FROM m GROUP BY document_id, site_id, seq"
P2_FOUND = f"WITH {MESSAGES}, {IDS}, {MARKS}, {REMAINING} SELECT document_id, site_id, seq FROM remaining"
P2_MARKS = f"WITH {MARKS} SELECT document_id, site_id, through_seq, CAST(coalesce(len(staged_seqs), 0) AS INTEGER) AS staged FROM marks"
P2_ITEMS = f"""WITH {MESSAGES}, {IDS}, {MARKS}, {REMAINING}
SELECT document_id, site_id, seq >> 10 AS block, count(*) AS records, min(seq) AS lo, max(seq) AS hi,
  sha256('["' || document_id || '","' || site_id || '","' || CAST(seq >> 10 AS VARCHAR) || '"]') AS item_id
FROM remaining GROUP BY document_id, site_id, seq >> 10"""

ORPHANS = f"""{MESSAGES},
edits AS (
  SELECT document_id, site_id, seq, min(received_at) AS t, min(feature_id) AS feature_id,
    coalesce(min(gen.site_id), '') AS gen_site, coalesce(min(gen.seq), 0) AS gen_seq, min(geometry_op.action) AS action,
    CASE WHEN min(geometry_op.action) <> 'add_part' THEN min(geometry_op.part_id) END AS part_id,
    CASE WHEN min(geometry_op.action) IN ('insert_vertex', 'move_vertex', 'delete_vertex', 'remove_ring') THEN min(geometry_op.ring_id) END AS ring_id,
    CASE WHEN min(geometry_op.action) IN ('move_vertex', 'delete_vertex') THEN min(geometry_op.vertex_id) END AS vertex_id,
    CASE WHEN min(geometry_op.action) = 'insert_vertex' THEN min(geometry_op.after_vertex_id) END AS after_id
  FROM m WHERE type = 'edit_geometry' GROUP BY document_id, site_id, seq
),
gens AS (
  SELECT document_id, feature_id, site_id AS gen_site, seq AS gen_seq, min(received_at) AS since
  FROM m WHERE type IN ('insert_feature', 'set_geometry') GROUP BY document_id, feature_id, site_id, seq
  UNION ALL
  SELECT DISTINCT document_id, feature_id, '', 0, CAST(NULL AS TIMESTAMP) FROM base_features
),
el AS (
  SELECT document_id, feature_id, coalesce(gen.site_id, '') AS gen_site, coalesce(gen.seq, 0) AS gen_seq, kind, part_id,
    ring_id, vertex_id, min(created_at) AS since, min(deleted_at) AS until
  FROM geometry_elements GROUP BY document_id, feature_id, coalesce(gen.site_id, ''), coalesce(gen.seq, 0), kind, part_id, ring_id, vertex_id
),
checked AS (
  SELECT e.*,
    CASE WHEN g.document_id IS NULL THEN 'missing' WHEN g.since > e.t THEN 'late' END AS r0,
    CASE WHEN e.part_id IS NULL THEN NULL WHEN p.document_id IS NULL THEN 'missing' WHEN p.since > e.t THEN 'late' WHEN p.until < e.t THEN 'deleted' END AS r1,
    CASE WHEN e.ring_id IS NULL THEN NULL WHEN r.document_id IS NULL THEN 'missing' WHEN r.since > e.t THEN 'late' WHEN r.until < e.t THEN 'deleted' END AS r2,
    CASE WHEN e.vertex_id IS NULL THEN NULL WHEN v.document_id IS NULL THEN 'missing' WHEN v.since > e.t THEN 'late' WHEN v.until < e.t THEN 'deleted' END AS r3,
    CASE WHEN e.after_id IS NULL THEN NULL WHEN a.document_id IS NULL THEN 'missing' WHEN a.since > e.t THEN 'late' WHEN a.until < e.t THEN 'deleted' END AS r4
  FROM edits e
  LEFT JOIN gens g ON g.document_id = e.document_id AND g.feature_id = e.feature_id AND g.gen_site = e.gen_site AND g.gen_seq = e.gen_seq
  LEFT JOIN el p ON p.kind = 'part' AND p.document_id = e.document_id AND p.feature_id = e.feature_id AND p.gen_site = e.gen_site AND p.gen_seq = e.gen_seq AND p.part_id = e.part_id
  LEFT JOIN el r ON r.kind = 'ring' AND r.document_id = e.document_id AND r.feature_id = e.feature_id AND r.gen_site = e.gen_site AND r.gen_seq = e.gen_seq AND r.part_id = e.part_id AND r.ring_id = e.ring_id
  LEFT JOIN el v ON v.kind = 'vertex' AND v.document_id = e.document_id AND v.feature_id = e.feature_id AND v.gen_site = e.gen_site AND v.gen_seq = e.gen_seq AND v.part_id = e.part_id AND v.ring_id = e.ring_id AND v.vertex_id = e.vertex_id
  LEFT JOIN el a ON a.kind = 'vertex' AND a.document_id = e.document_id AND a.feature_id = e.feature_id AND a.gen_site = e.gen_site AND a.gen_seq = e.gen_seq AND a.part_id = e.part_id AND a.ring_id = e.ring_id AND a.vertex_id = e.after_id
),
orphans AS (
  SELECT document_id, site_id, seq,
    CASE WHEN r0 IS NOT NULL THEN 'gen' WHEN r1 IS NOT NULL THEN 'part_id' WHEN r2 IS NOT NULL THEN 'ring_id' WHEN r3 IS NOT NULL THEN 'vertex_id' ELSE 'after_vertex_id' END AS ref_field,
    coalesce(r0, r1, r2, r3, r4) AS reason, strftime(t, '%Y-%m') AS period
  FROM checked WHERE coalesce(r0, r1, r2, r3, r4) IS NOT NULL
)"""
P4_FOUND = f"WITH {ORPHANS} SELECT * FROM orphans"
P4_COUNTS = f"WITH {ORPHANS} SELECT document_id, ref_field, reason, period, count(*) AS orphans FROM orphans GROUP BY document_id, ref_field, reason, period"


def current(op: str) -> str:
    """Current properties over a CTE ``op`` of messages."""
    return f"""w AS (
  SELECT document_id, feature_id, property_key, ts, site_id, seq, type = 'delete_property' AS gone FROM {op} WHERE type IN ('set_property', 'delete_property')
  UNION ALL
  SELECT document_id, feature_id, unnest(map_keys(properties)), ts, site_id, seq, false FROM {op} WHERE type = 'insert_feature'
  UNION ALL
  SELECT document_id, feature_id, unnest(map_keys(properties)), 0, '', 0, false FROM base_features
),
won AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, feature_id, property_key ORDER BY ts DESC, site_id DESC, seq DESC) AS place FROM w) WHERE place = 1 AND NOT gone
),
life AS (
  SELECT document_id, feature_id, max(CASE WHEN type = 'insert_feature' THEN row(ts, site_id, seq) END) AS created,
    max(CASE WHEN type = 'delete_feature' THEN row(ts, site_id, seq) END) AS deleted, bool_or(type = 'base') AS is_base
  FROM (SELECT document_id, feature_id, type, ts, site_id, seq FROM {op} WHERE type IN ('insert_feature', 'delete_feature')
        UNION ALL SELECT document_id, feature_id, 'base', 0, '', 0 FROM base_features)
  GROUP BY document_id, feature_id
),
alive AS (SELECT document_id, feature_id FROM life WHERE CASE WHEN deleted IS NULL THEN is_base OR created IS NOT NULL ELSE coalesce(created > deleted, false) END)
SELECT won.document_id, won.feature_id, won.property_key, won.site_id, won.seq FROM won SEMI JOIN alive USING (document_id, feature_id)"""


COMMITTED = """marks2 AS (
  SELECT document_id, site_id, coalesce(max(hi) FILTER (WHERE lo = 1), 0) AS frontier, max(hi) AS highest FROM islands GROUP BY document_id, site_id
),
gaps AS (
  SELECT document_id, min(edge) AS until FROM (
    SELECT k.document_id, k.site_id, coalesce(max(m.ts), 0) AS edge FROM marks2 k LEFT JOIN m ON m.document_id = k.document_id AND m.site_id = k.site_id AND m.seq = k.frontier
    WHERE k.highest > k.frontier GROUP BY k.document_id, k.site_id) GROUP BY document_id
),
committed AS (
  SELECT m.* FROM m JOIN marks2 f ON m.document_id = f.document_id AND m.site_id = f.site_id LEFT JOIN gaps g ON g.document_id = m.document_id
  WHERE m.seq <= f.frontier AND (g.until IS NULL OR m.ts <= g.until)
)"""
P5_FOUND = f"WITH {MESSAGES}, {current('m')}"
P5_COMMITTED = f"WITH {MESSAGES}, {IDS}, {ISLANDS}, {COMMITTED}, {current('committed')}"

#: Coordinates of a geometry as [part][ring][position][value].
_C = "json_extract(g, '$.coordinates')"
P3_FOUND = f"""WITH s AS (SELECT * FROM replica_snapshots QUALIFY row_number() OVER (PARTITION BY id) = 1),
lists AS (
  SELECT id, 'outbox_ops' AS op_list, outbox_ops AS ops FROM s UNION ALL SELECT id, 'retained_ops', retained_ops FROM s UNION ALL SELECT id, 'pending_ops', pending_ops FROM s
),
ops AS (SELECT id AS snapshot_id, op_list, unnest(range(len(ops))) AS op_no, unnest(ops) AS op FROM lists WHERE ops IS NOT NULL),
texts AS (
  SELECT snapshot_id, op_list, op_no, op.geometry_op.ring AS ring, CASE WHEN json_valid(op.geometry) THEN op.geometry END AS g, CASE WHEN json_valid(op.properties['owner']) THEN op.properties['owner'] END AS o FROM ops
),
shapes AS (
  SELECT snapshot_id, op_list, op_no, CASE json_extract_string(g, '$.type')
    WHEN 'Point' THEN [[[CAST({_C} AS DOUBLE[])]]] WHEN 'LineString' THEN [[CAST({_C} AS DOUBLE[][])]] WHEN 'Polygon' THEN [CAST({_C} AS DOUBLE[][][])]
    WHEN 'MultiPoint' THEN list_transform(CAST({_C} AS DOUBLE[][]), lambda x: [[x]]) WHEN 'MultiLineString' THEN list_transform(CAST({_C} AS DOUBLE[][][]), lambda x: [x])
    WHEN 'MultiPolygon' THEN CAST({_C} AS DOUBLE[][][][]) END AS parts
  FROM texts WHERE json_type(g) = 'OBJECT' AND {_C} IS NOT NULL
),
positions AS (
  SELECT snapshot_id, op_list, op_no, part_no, ring_no, unnest(range(len(ring))) AS item_no, unnest(ring) AS position FROM (
    SELECT snapshot_id, op_list, op_no, part_no, unnest(range(len(part))) AS ring_no, unnest(part) AS ring FROM (
      SELECT snapshot_id, op_list, op_no, unnest(range(len(parts))) AS part_no, unnest(parts) AS part FROM shapes))
),
owners AS (
  SELECT snapshot_id, op_list, op_no, unnest(range(len(members))) AS part_no, unnest(members) AS member FROM (
    SELECT *, CASE json_type(o) WHEN 'ARRAY' THEN json_extract(o, '$[*]') WHEN 'NULL' THEN [] ELSE [CAST(o AS JSON)] END AS members FROM texts WHERE o IS NOT NULL)
)
SELECT snapshot_id, op_list, op_no, 'geometry' AS field, part_no, ring_no, item_no FROM positions WHERE len(position) > 0
UNION ALL SELECT snapshot_id, op_list, op_no, 'ring', 0, 0, unnest(range(len(ring))) FROM texts WHERE ring IS NOT NULL
UNION ALL SELECT snapshot_id, op_list, op_no, 'owner', part_no, 0, 0 FROM owners
UNION ALL SELECT snapshot_id, op_list, op_no, 'owner_share', part_no, 0, unnest(range(CAST(json_array_length(member, '$.shares') AS BIGINT))) FROM owners
  WHERE json_type(member) = 'OBJECT' AND json_type(member, '$.shares') = 'ARRAY'"""

SQL = {
    "p1_found": P1_FOUND,
    "p1_ranges": P1_RANGES,
    "p1_accepted": P1_ACCEPTED,
    "p2_found": P2_FOUND,
    "p2_marks": P2_MARKS,
    "p2_items": P2_ITEMS,
    "p3_found": P3_FOUND,
    "p4_found": P4_FOUND,
    "p4_counts": P4_COUNTS,
    "p5_found": P5_FOUND,
    "p5_committed": P5_COMMITTED,
}
