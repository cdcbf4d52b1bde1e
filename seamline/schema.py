"""Declared schemas. Nothing in the package infers one."""

from pyspark.sql import types as T

SOURCE_FILES = "service STRING, path STRING, content STRING"

# Position of a fact inside its service's contract: extraction pass, file (path
# components, so that files sort by directory), then numbers within the file.
# It is a sort key, not a dense counter, so giving it to a row needs no window.
ORD = "struct<phase:int,file:array<string>,seq:array<int>>"

# One long table holds all facts; columns a section does not use stay null.
FACTS = (
    "service STRING, section STRING, ord " + ORD + ", "
    "method STRING, path STRING, norm_path STRING, handler STRING, target STRING, "
    "caller STRING, topic STRING, schema STRING, publisher STRING, "
    "class_name STRING, file STRING, kind STRING, message STRING, line BIGINT"
)

SERVICE = "service"
HTTP_PROVIDERS = "http_providers"
HTTP_CONSUMERS = "http_consumers"
TOPICS_PUBLISHED = "topics_published"
TOPICS_SUBSCRIBED = "topics_subscribed"
EVENT_SCHEMAS = "event_schemas"
EXTRACTION_WARNINGS = "extraction_warnings"

# section -> the columns that make it up, in document order
SECTIONS = {
    HTTP_PROVIDERS: ["method", "path", "handler", "line"],
    TOPICS_PUBLISHED: ["topic", "schema", "publisher", "line"],
    HTTP_CONSUMERS: ["target", "method", "path", "caller", "line"],
    TOPICS_SUBSCRIBED: ["topic", "handler", "line"],
    EVENT_SCHEMAS: ["class_name", "file", "line"],
    EXTRACTION_WARNINGS: ["kind", "file", "line", "message"],
}

# section -> where its list sits in a contract document
DOCUMENT_PATHS = {
    HTTP_PROVIDERS: "provides.http",
    TOPICS_PUBLISHED: "provides.topics_published",
    HTTP_CONSUMERS: "consumes.http",
    TOPICS_SUBSCRIBED: "consumes.topics_subscribed",
    EVENT_SCHEMAS: "event_schemas",
    EXTRACTION_WARNINGS: "_extraction_warnings",
}

# Configuration tables.
DIM_ENV = "side STRING, env STRING, target STRING"  # side: backend | frontend
DIM_WRAPPERS = "kind STRING, name STRING, target STRING, prefix STRING"  # kind: object | function
DIM_SERVICES = "service STRING, kind STRING"  # kind: backend | frontend

# Syntax rows of one Python file, see operators.syntax.
EXPRESSION = (
    "struct<kind:string,leaf:string,text:string,base:string,parts:array<string>,"
    "lead_base:string,lead_attr:string,dump:string>"
)
SCOPE = "struct<id:int,name:string>"
PY_NODES = (
    "service string, path string, has_publish boolean, has_client boolean, "
    "node_id int, visit_id int, kind string, line int, name string, parent string, "
    "top_class " + SCOPE + ", unit " + SCOPE + ", functions array<" + SCOPE + ">, "
    "func string, attr string, recv string, nargs int, "
    "arg0 " + EXPRESSION + ", arg1 " + EXPRESSION + ", "
    "keywords array<struct<arg:string,value:" + EXPRESSION + ">>, "
    "value " + EXPRESSION + ", peel_base string, peel_attr string, self_attr string, tuple_names array<string>, "
    "params array<string>, bases array<string>, "
    "decorated struct<name:string,line:int>, source string, imported string"
)


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
