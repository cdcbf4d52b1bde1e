"""Fixed values.

These must equal what existing contract files and code bases already use, so
they are stated here once, as plain text.  Everything that names a particular
service, environment variable or client wrapper is *configuration* and is passed
in as a table (see ``schema.DIM_*``), never written in code.
"""

# HTTP
HTTP_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
HTTP_VERBS = ["get", "post", "put", "patch", "delete", "head", "options"]
DEFAULT_METHOD = "GET"
PARAM = "{param}"
UNNAMED_PART = "param"

# contract documents
EXTRACTOR_VERSION = "0.1.0"

# back-end file layout
APP_DIR = "app/"
CLIENT_DIR = "app/services/"
SETTINGS_FILE = "app/core/config.py"
SETTINGS_FILE_FALLBACK = "app/config.py"
EVENT_SCHEMA_FILE = "app/schemas/events.py"
PUBLISH_TEXT = ".publish("
CLIENT_TEXT = "httpx"

# names looked for in back-end code
ROUTER_CLASS = "APIRouter"
INCLUDE_METHOD = "include_router"
ROUTER_NAME = "router"
ROUTER_SUFFIX = "_router"
SCHEMA_BASE = "BaseModel"
SETTINGS_NAME = "settings"
BASE_URL_ATTRIBUTES = ["base_url", "_base_url", "url"]
UNPACKED_URL_NAMES = ["url", "endpoint", "_url"]
PROXY_METHOD_PARAMS = ["method", "verb"]
PROXY_PATH_PARAM = "path"
MODULE_CALLER = "<module>"

# warnings
UNRESOLVED_SETTINGS = "unresolved_settings_topic"
UNRESOLVED_SETTINGS_MESSAGE = (
    "topic=settings.%s could not be resolved — inline a literal at the publish "
    "site or add a literal default in app/core/config.py"
)
DYNAMIC_TOPIC = "dynamic_topic"
DYNAMIC_TOPIC_MESSAGE = "topic is a dynamic expression (%s)"
DYNAMIC_TOPIC_WIDTH = 80

# subscriber convention
EVENT_PATH = r"/events/([^/]+)$"

# front-end file layout
FRONTEND_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".vue", ".mjs"]
FRONTEND_SKIPPED_DIRS = [
    "node_modules", ".next", ".nuxt", ".output", "dist", "build", ".gitnexus",
    ".pnpm-store", ".cache", ".turbo", "coverage", "__pycache__", ".git",
    ".venv", "venv", "public", "static", ".claude",
]

# front-end call patterns; groups are listed with each
METHOD_OPTION = (
    r"(?:\s*,\s*\{[^{}]*?method:\s*['\"](GET|POST|PUT|PATCH|DELETE)['\"])?"
)
WRAPPER_CALL = (  # receiver, verb, path
    r"\b([a-zA-Z_][a-zA-Z0-9_]*)\.(get|post|put|patch|delete)\s*"
    r"\(\s*event\s*,\s*[`'\"](/[^`'\"]+)[`'\"]"
)
REQUEST_CALL = (  # function, path, method
    r"\b([a-zA-Z_][a-zA-Z0-9_]*Request)\s*(?:<[^>]+>)?\s*"
    r"\(\s*event\s*,\s*[`'\"](/[^`'\"]+)[`'\"]" + METHOD_OPTION
)
API_FETCH_CALL = (  # path, method
    r"\bapiFetch\s*(?:<[^>]+>)?\s*\(\s*[`'\"](/[^`'\"]+)[`'\"]" + METHOD_OPTION
)
TEMPLATE_FETCH_CALL = (  # base, path, method
    r"\bfetch\s*\(\s*`\$\{([a-zA-Z_][a-zA-Z0-9_.]*)\}(/[^`]+)`" + METHOD_OPTION
)
ENV_CONSTANT = (  # variable, environment name
    r"const\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"
    r"(?:import\.meta\.env|process\.env)\.([A-Z_][A-Z0-9_]*)"
)
ENV_ACCESS = r"(?:process\.env|import\.meta\.env)\.([A-Za-z0-9_$]+)"  # name
RUNTIME_CONFIG = r"(?:useRuntimeConfig\(\)|\bconfig)\.([a-zA-Z_][a-zA-Z0-9_]*)"  # key
API_FETCH_DEFINITION = (  # base
    r"fetch\s*\(\s*`\$\{([A-Za-z_][A-Za-z0-9_.]*)\}\$\{endpoint"
)
FALLBACK_URL = (  # url; the first %s is the constant's name
    r"(?:const|let|var)\s+%s\s*=\s*"
    r"(?:import\.meta\.env|process\.env)\.[A-Z_]+\s*\|\|\s*['\"]([^'\"]+)['\"]"
)
URL_PATH = r"https?://[^/]+(/[^?#]+)"  # path
