"""Column types of the wire tables, as Spark DDL and as StructTypes."""


REF = "struct<site_id:string,seq:bigint>"
STAMP = "struct<ts:bigint,site_id:string,seq:bigint>"
GEOMETRY_OP = (
    "struct<action:string,part_id:string,ring_id:string,vertex_id:string,after_vertex_id:string,"
    "coord:array<double>,ring:array<array<double>>,part:string>"
)
#: The eleven columns of one operation.
OP_COLUMNS = (
    "type", "site_id", "seq", "ts", "feature_id", "geometry", "properties",
    "property_key", "property_value", "gen", "geometry_op",
)
OP_FIELDS = (
    "type string, site_id string, seq bigint, ts bigint, feature_id string, geometry string, "
    f"properties map<string,string>, property_key string, property_value string, gen {REF}, geometry_op {GEOMETRY_OP}"
)
OPS_DDL = f"document_id string, {OP_FIELDS}"
BASE_DDL = "document_id string, feature_id string, geometry string, properties map<string,string>"
CLOCK_DDL = "document_id string, site_id string, seq bigint"

KEY = f"struct<init:int,stamp:{STAMP}>"
VERTEX = f"struct<id:string,parent:string,key:{KEY},coord:array<double>,deleted:boolean,move_reg:{STAMP}>"
RING = f"struct<id:string,key:{KEY},exterior:boolean,deleted:boolean,vertices:array<{VERTEX}>>"
PART = f"struct<id:string,key:{KEY},part_type:string,deleted:boolean,rings:array<{RING}>>"
GEOMETRY = f"struct<type:string,dims:int,parts:array<{PART}>>"
PROPERTY = f"struct<value:string,deleted:boolean,reg:{STAMP}>"
FEATURE = (
    f"struct<id:string,base:boolean,create_reg:{STAMP},delete_reg:{STAMP},gen_id:{REF},gen_stamp:{STAMP},"
    f"seen_gens:array<{REF}>,properties:map<string,{PROPERTY}>,geometry:{GEOMETRY}>"
)
#: One operation as a struct.
OP_STRUCT = "struct<" + ",".join(f.replace(" ", ":", 1) for f in OP_FIELDS.split(", ")) + ">"
#: One snapshot as a row.
SNAPSHOT_DDL = (
    "version int, id string, document_id string, site_id string, base_hash string, clock bigint, vector_clock map<string,bigint>, applied map<string,bigint>, "
    f"synced_through bigint, outbox_ops array<{OP_STRUCT}>, retained_ops array<{OP_STRUCT}>, pending_ops array<{OP_STRUCT}>, features array<{FEATURE}>"
)

OP_TYPES = ("insert_feature", "delete_feature", "set_geometry", "set_property", "delete_property", "edit_geometry")
ACTIONS = ("insert_vertex", "move_vertex", "delete_vertex", "add_ring", "remove_ring", "add_part", "remove_part")
GEOMETRY_TYPES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")
#: Exclusive bound of every counter on the wire.
COUNTER_BOUND = 1 << 62
WIRE_VERSION = 3
