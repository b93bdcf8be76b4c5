"""Row types of the engine's tables, declared once."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

RAW_FILES = _struct(("doc_id", S), ("file_name", S), ("ext", S), ("content", T.BinaryType()))
CHUNKS = _struct(("doc_id", S), ("ordinal", I), ("bid", S), ("text", S), ("n_tokens", I))
CHUNK_ENTITIES = _struct(("doc_id", S), ("bid", S), ("ordinal", I), ("pos", I), ("name", S), ("type", S))
RELATIONS = _struct(
    ("doc_id", S), ("bid", S), ("ordinal", I), ("rel_idx", I), ("source", S), ("target", S),
    ("relation", S), ("context", S), ("weight", D), ("origin", S), ("edit_id", S),
)
ENTITY_LABELS = _struct(("doc_id", S), ("name", S), ("label", S), ("first_pos", L))
RESPONSES = _struct(
    ("request_id", S), ("attempt", I), ("provider", S), ("raw", S), ("finish_reason", S),
)
REQUESTS = _struct(
    ("request_id", S), ("depth", I), ("text", S),
    ("candidates", T.ArrayType(S)), ("sources", T.ArrayType(S)),
)
MUTATIONS = _struct(
    ("doc_id", S), ("seq", L), ("revision", I), ("operation", S), ("node_id", S), ("name", S),
    ("entity_type", S), ("edge_id", S), ("source", S), ("target", S), ("relation", S),
    ("context", S), ("weight", D),
)
GRAPH_VERSIONS = _struct(
    ("doc_id", S), ("revision", I), ("operation", S), ("created_at", T.TimestampType()),
)
STAGE_EVENTS = _struct(
    ("job_id", S), ("seq", L), ("stage", S), ("completed", I), ("total", I), ("item_seconds", D),
)
EDGES = _struct(
    ("graph_id", S), ("source", S), ("target", S), ("edge_id", S), ("label", S), ("title", S),
    ("weight", D),
)
NODES = _struct(("graph_id", S), ("node", S), ("label", S))
COMMUNITIES = _struct(("graph_id", S), ("node", S), ("community_id", L))
RAG_MESSAGES = _struct(("doc_id", S), ("pos", I), ("role", S), ("content", S))

# What a model answers for one chunk; both spellings of each field are accepted.
ENTITY_ITEM = "struct<name:string,entity:string,type:string,label:string>"
RELATION_ITEM = (
    "struct<source:string,target:string,relation:string,context:string,weight:string>"
)
