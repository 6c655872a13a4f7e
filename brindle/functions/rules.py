"""Names, extensions and patterns that extraction goes by."""

# Languages by extension, for tool output.
LANGUAGE_BY_EXTENSION = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java",
    ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
}

# Names that are no functions of the source.
BUILTINS = (
    "console", "JSON", "Math", "Date", "Array", "Object", "String", "Number", "Boolean", "Promise", "Map", "Set", "WeakMap", "WeakSet", "Proxy", "Reflect",
    "Symbol", "Error", "parseInt", "parseFloat", "isNaN", "isFinite", "encodeURI", "decodeURI", "setTimeout", "setInterval", "clearTimeout", "clearInterval",
    "require", "module", "exports", "__dirname", "__filename", "HTTPException", "len", "open", "response", "request",
)
NOT_COMPONENTS = ("console", "JSON", "Math", "Date", "Array", "Object", "Promise")
HTTP_METHODS = ("get", "post", "put", "patch", "delete", "options", "head")

# Words that searches leave out.
STOP_WORDS = ("the", "a", "an", "is", "are", "where", "find", "show", "all", "in", "this", "handler", "endpoint", "route")
STOP_WORDS_SHORT = STOP_WORDS[:11]

# Kinds and names of language-server symbols by code.
SYMBOLS = {
    1: ("file_path", "File"), 2: ("function", "Module"), 3: ("function", "Namespace"), 4: ("function", "Package"), 5: ("class", "Class"), 6: ("function", "Method"),
    7: ("function", "Property"), 8: ("function", "Field"), 9: ("class", "Constructor"), 10: ("class", "Enum"), 11: ("class", "Interface"), 12: ("function", "Function"),
    13: ("function", "Variable"), 14: ("function", "Constant"),
}

# Patterns of lines of tool output, in order of trial: (pattern, group of the name).
IMPORT_LINES = (r"^(from\s+[\w.]+\s+import\s+.+)$", r"^(import\s+.+)$", r"^(const|let|var)\s+.+\s*=\s*require\(.+\)", r"^(?:const|let|var)\s+\w+\s*=\s*require\(")
FUNCTION_LINES = (
    (r"^(?!await|raise|return|yield|if|elif|else|for|while|try|except|with|as|import|from|pass|break|continue|lambda)(?:async\s+)?def\s+([A-Za-z_][\w]*)\s*\(", 1),
    (r"^(?!await|\.|\(|const|let|var|return|if|for|while|try|catch|import|from|export|class)(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(", 1),
    (r"^(?!await|\.|return|\(|if|for|while|try|catch)(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", 1),
    (r"^(?!await|\.|return|\(|if|for|while|try|catch)(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*=\s*async\s+[A-Za-z_$][\w$]*\s*=>", 1),
    (r"^module\.exports\s*=\s*(?:require\(|[a-zA-Z_]\w*\()", 0),
    (r"^exports\.[a-zA-Z_][\w]*\s*=\s*function", 0),
    (r"^(?!if|for|switch|select|return|go|defer|import|from)func\s+([A-Za-z_][\w]*)\s*\(", 1),
    (r"^(?!if|for|while|return|try|catch|private|public|protected|static)(?:public|private|protected)?\s*(?:static\s+)?[\w<>\[\]]+\s+([A-Za-z_][\w]*)\s*\([^)]*\)\s*[{(]?\s*$", 1),
)
CLASS_LINES = (r"^class\s+([A-Za-z_][\w]*)", r"^(?:export\s+)?class\s+([A-Za-z_$][\w$]*)", r"^(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)", r"^(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*=")
# (pattern, group of the method, group of the path)
ROUTE_LINES = (
    (r"""@(router|app)\.(get|post|put|patch|delete|options|head)\(["']([^"']+)["']""", 2, 3),
    (r"""\b(router|app)\.(get|post|put|patch|delete|options|head)\(["']([^"']+)["']""", 2, 3),
    (r"""@(Get|Post|Put|Patch|Delete|Options|Head)\(["']?([^"')]*)["']?\)""", 1, 2),
)
ERROR_OUTPUT = r"(?i)error|failed|exception|traceback|cannot find|not recognized"
LSP_ERROR = r"(?i)no lsp server|error|failed|not found"

# Patterns over whole files.  (kind, pattern, text, tags, confidence): {0} is the name.
SOURCE_RULES = (
    ("function", r"(?<![\w])(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(", "function {0}(...)", ("function", "{0}"), 0.9),
    ("function", r"(?<![\w])const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>", "const {0} = (...) => ...", ("function", "arrow", "{0}"), 0.9),
    ("function", r"(?<![\w])const\s+([A-Za-z_$][\w$]*)\s*=\s*async\s+[A-Za-z_$][\w$]*\s*=>", "const {0} = async (...) => ...", ("function", "arrow", "async", "{0}"), 0.9),
    ("class", r"(?<![\w])(?:export\s+)?class\s+([A-Za-z_$][\w$]*)", "class {0}", ("class", "{0}"), 0.95),
    ("interface", r"(?<![\w])(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)", "interface {0}", ("interface", "{0}"), 0.95),
    ("type", r"(?<![\w])(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*=", "type {0} = ...", ("type", "{0}"), 0.95),
    ("class", r"(?<![\w])(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)", "enum {0}", ("enum", "{0}"), 0.95),
)
SOURCE_IMPORT = r"""(?m)^import\s+(?:(?:\{[^}]*\}|[A-Za-z_$][\w$]*)\s+from\s+)?['"]([^'"]+)['"]"""
SOURCE_EXPORT = r"(?m)^export\s+(?:\{([^}]*)\}|default|function|class|const|let)"
EXPRESS_ROUTE = r"""(?:app|router)\.(get|post|put|patch|delete|options|head)\s*\(\s*["']([^"']+)["']\s*,"""
DECORATOR_ROUTE = r"""@([A-Za-z]+)\s*\(\s*["']([^"']+)["']\s*,"""
FASTIFY_ROUTE = r"""fastify\.(get|post|put|patch|delete|options|head)\s*\(\s*["']([^"']+)["']\s*,"""
APP_ROUTE = r"(?i)export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s*\("
PAGES_ROUTE = r"(?i)(?:export\s+)?(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s*\("
FALLBACK_COMPONENT = r"(?:export\s+(?:default\s+)?)?(?:function|const)\s+([A-Z][a-zA-Z0-9]*)\s*(?:=|\()"
COMPONENTS = (
    r"(?:export\s+)?function\s+([A-Z][a-zA-Z0-9]*)\s*\(",
    r"class\s+([A-Z][a-zA-Z0-9]*)\s+extends\s+React\.Component",
    r"const\s+([A-Z][a-zA-Z0-9]*)\s*=\s*(?:\([^)]*\)\s*=>|<)",
    r"const\s+([A-Z][a-zA-Z0-9]*)\s*=\s*function",
    r"export\s+default\s+([A-Z][a-zA-Z0-9]*)",
)

# What tells a framework.
EXPRESS_APP = r"""require\s*\(\s*["']express["']\s*\)|from\s+["']express["']|app\s*=\s*express\(\)|express\(\)"""
EXPRESS_CALLS = r"\.(get|post|put|patch|delete|options|head)\s*\("
FASTIFY_APP = r"""require\s*\(\s*["']fastify["']\s*\)|from\s+["']fastify["']|fastify\s*\(\s*\)|const\s+\w+\s*=\s*require\s*\(\s*["']fastify["']"""
FASTIFY_CALLS = r"fastify\.(get|post|put|patch|delete|options|head|route)\s*\("
NEXT_PROJECT = r"""\bnext\b|\buse client\b|\buse server\b|from\s+["']next"""
REACT_PROJECT = r"""\bReact\b|\bjsx\b|\btsx\b|from\s+["']react["']|from\s+["']@mui|from\s+["']tailwindcss|from\s+["']next"""
REACT_COMPONENTS = r"function\s+[A-Z][a-zA-Z0-9]*|class\s+[A-Z][a-zA-Z0-9]*\s+extends\s+React\.Component|const\s+[A-Z][a-zA-Z0-9]*\s*=\s*(?:\([^)]*\)\s*=>|<)"

# Rules for single lines of fixture sources: (kind, pattern); a route's second group is its path.
FIXTURE_RULES = (
    ("route", r"""(?i)router\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]"""),
    ("route", r"""(?i)app\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]"""),
    ("route", r"""(?i)server\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]"""),
    ("route", r"""(?i)FastifyInstance.*\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]"""),
    ("function", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
    ("function", r"(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[^=])\s*=>"),
    ("class", r"(?:export\s+)?class\s+(\w+)"),
    ("interface", r"(?:export\s+)?interface\s+(\w+)"),
    ("type", r"(?:export\s+)?type\s+(\w+)"),
    ("import", r"""import\s+(?:\{[^}]+\}|[\w]+)\s+from\s+['"]([^'"]+)['"]"""),
    ("import", r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""),
)
