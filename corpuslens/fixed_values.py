"""Tables, patterns and texts the results depend on.

They are data, not logic. Every operator takes them as defaulted arguments, so a
caller can replace any of them.
"""

# Extension -> language the block analysis supports (case-sensitive).
SUPPORTED_EXTENSIONS = {
    ".py": "python",
    ".pyw": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".m": "matlab",
    ".matlab": "matlab",
    ".jl": "julia",
}

# Extension -> language for reporting (lower-cased extension).
REPORTING_EXTENSIONS = {
    ".py": "python",
    ".pyw": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".m": "matlab",
    ".matlab": "matlab",
    ".jl": "julia",
    ".java": "java",
    ".go": "go",
    ".rb": "ruby",
    ".php": "php",
    ".c": "c",
    ".h": "c",
    ".cpp": "c++",
    ".cc": "c++",
    ".cxx": "c++",
    ".hpp": "c++",
    ".cs": "c#",
    ".rs": "rust",
    ".swift": "swift",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".scala": "scala",
    ".dart": "dart",
    ".sh": "shell",
    ".bash": "shell",
    ".pl": "perl",
    ".r": "r",
    ".lua": "lua",
    ".ex": "elixir",
    ".exs": "elixir",
    ".hs": "haskell",
    ".clj": "clojure",
}

# Language -> display name.
LANGUAGE_DISPLAY_NAMES = {
    "python": "Python",
    "javascript": "JavaScript",
    "typescript": "TypeScript",
    "matlab": "MATLAB",
    "julia": "Julia",
    "java": "Java",
    "go": "Go",
    "ruby": "Ruby",
    "php": "PHP",
    "c": "C",
    "c++": "C++",
    "c#": "C#",
    "rust": "Rust",
    "swift": "Swift",
    "kotlin": "Kotlin",
    "scala": "Scala",
    "dart": "Dart",
    "shell": "Shell",
    "perl": "Perl",
    "r": "R",
    "lua": "Lua",
    "elixir": "Elixir",
    "haskell": "Haskell",
    "clojure": "Clojure",
}

# Languages with block analysis.
SUPPORTED_LANGUAGES = ("python", "javascript", "typescript", "matlab", "julia")

# Extension -> technology label, and extensions whose content is mined.
TECHNOLOGY_EXTENSIONS = {
    ".py": "Python",
    ".js": "JavaScript",
    ".jsx": "JavaScript",
    ".ts": "TypeScript",
    ".tsx": "TypeScript",
    ".go": "Go",
    ".rb": "Ruby",
    ".java": "Java",
}
SCANNABLE_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx")

# Directories a scan never enters.
IGNORED_DIRECTORIES = (".git", "node_modules", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache")

# File names with a meaning of their own.
ENTRY_POINT_FILENAMES = (
    "main.py", "manage.py", "app.py", "wsgi.py", "asgi.py", "__main__.py",
    "index.js", "server.js", "app.js", "index.ts", "server.ts",
)
MANIFEST_MANAGERS = {
    "requirements.txt": "Python (pip)",
    "pyproject.toml": "Python (uv/poetry)",
    "Pipfile": "Python (pipenv)",
    "package.json": "Node.js",
    "go.mod": "Go",
    "Gemfile": "Ruby",
    "pom.xml": "Java (Maven)",
    "build.gradle": "Java/Kotlin (Gradle)",
    "Cargo.toml": "Rust",
}
CONFIG_FILENAMES = (
    "config.py", "settings.py", ".env", ".env.example", ".env.sample",
    "config.yaml", "config.yml", "docker-compose.yml", "Dockerfile",
)
SEGMENT_CATEGORIES = {
    "services": "services",
    "service": "services",
    "routers": "routers",
    "router": "routers",
    "routes": "routers",
    "models": "database models",
    "jobs": "background jobs",
    "tasks": "background jobs",
    "workers": "background jobs",
}

# Content patterns (Java regex syntax; (?U) = Unicode classes).
ROUTER_HINTS = ("APIRouter(", "Blueprint(", "express.Router(")
ENDPOINT_PATTERN = r"""(?U)@(?:router|app)\.(get|post|put|delete|patch)\(\s*["']([^"']+)["']"""
MODEL_BASE_HINTS = ("Base)", "models.Model", "db.Model", "Base,")
JOB_PATTERN = r"(?U)@(?:celery_app\.task|shared_task|task)\(|class\s+\w*Job\b"
AUTH_PATTERN = r"(?iU)\b(jwt|oauth|authenticate|login_required|require_admin|authorization)\b"
ENV_VAR_PATTERN = r"""(?U)os\.(?:getenv|environ\.get)\(\s*["']([A-Z0-9_]+)["']"""
# Texts of which every match of a pattern above holds one; a plain search for them is far cheaper.
ENDPOINT_HINTS = ("@router.", "@app.")
JOB_HINTS = ("task(", "Job")
ENV_VAR_HINTS = ("os.getenv", "os.environ.get")
IMPORT_PATTERN = r"(?m)^[^\S\n]*+(?:from|import)\s+([A-Za-z_][A-Za-z0-9_.]*)"

# Risky path patterns, in the order they are tried.
RISKY_PATH_PATTERNS = (
    r"(^|/)migrations/",
    r"(^|/)migrations\.py$",
    r"(^|/)tests?/",
    r"(^|/)urls(_v\d+)?\.py$",
    r"(^|/)views?(_.*)?\.py$",
    r"(^|/)settings?(_.*)?\.py$",
    r"(^|/)(asgi|wsgi)\.py$",
)
DEFAULT_IGNORE_PATTERNS = (
    "*/migrations/*", "*/migrations.py", "*/tests/*", "*/test_*.py", "*/urls.py", "*/urls_*.py",
    "*/views.py", "*/views_*.py", "*/settings.py", "*/settings_*.py", "*/asgi.py", "*/wsgi.py",
)

# Secret formats and placeholders.
URL_CREDENTIALS = r"(?U)://[^\s/@][^\s/@:]*+:[^\s/@]++@"
KNOWN_TOKENS = (
    r"(?U)\b("
    r"ghp_[A-Za-z0-9]{20,}|gho_[A-Za-z0-9]{20,}|ghu_[A-Za-z0-9]{20,}|ghs_[A-Za-z0-9]{20,}"
    r"|ghr_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}"
    r"|gl(?:pat|dt|rt|cbt|ptt|ft|imt|agent|soat|oas)-[A-Za-z0-9\-_]{15,}"
    r"|sk-[A-Za-z0-9_-]{16,}"
    r")\b"
)
AUTH_HEADER_VALUE = r"(?iU)\b(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{8,}"
URL_PLACEHOLDER = "://***:***@"
TOKEN_PLACEHOLDER = "***REDACTED-TOKEN***"

# Limits.
COVERAGE_THRESHOLD = 0.5
LOW_CONTENT_MIN_LINES = 4
MAX_SCANNED_FILES = 3000
MAX_LISTED_EDGES = 80
MAX_LISTED_DEPENDENCIES = 60
PREVIEW_ITEMS = 8
RUNS_KEPT_PER_REPOSITORY = 6
CLONES_KEPT = 10
RECENT_RUNS = 8
RECENT_RUNS_PER_REPOSITORY = 10
RUN_LIST_LIMIT = 100
LOG_TAIL_LINES = 80
ARTIFACT_PREVIEW_CHARS = 120_000
SUMMARY_CHARS = 240
CHANGE_BUDGET = 50
RATE_LIMIT_REQUESTS = 20
RATE_LIMIT_WINDOW_SECONDS = 3600
PRESERVED_ARTIFACTS = r"\.(csv|json|txt)$"
LOG_ARTIFACTS = r"\.(log|txt)$"

# Configuration file candidates, best first, and directories never searched.
CONFIG_CANDIDATES = ("docs/conf.py", "docs/source/conf.py", "source/conf.py")
CONFIG_IGNORED_PARTS = ("build", "_build", ".git", "node_modules")

# Run lifecycle texts.
RUNNING_INTERRUPTED = "Run was interrupted because the server stopped before the job could finish."
QUEUED_INTERRUPTED = "Run was interrupted because the server stopped before the queued job could start."
UNEXPECTED_EXIT = "Job process exited unexpectedly before the run could finish."
CANCELLED_RUNNING = "Run was cancelled while execution was in progress."
CANCELLED_QUEUED = "Run was cancelled before execution started."
DELETED_REPOSITORY = "Deleted repository"
ARCHITECTURE_ENDPOINT = "/generate-architecture-docs"

# The 18 report sections in report order.
SECTION_NAMES = (
    "project overview", "entry points", "services", "routers", "modules and packages",
    "internal dependencies", "external dependencies", "data flow", "background jobs",
    "database models", "configuration", "environment variables", "authentication flow",
    "API endpoints", "sequence diagrams", "architecture diagrams", "repository structure",
    "technology stack",
)
CRITICAL_SECTIONS = ("entry points", "repository structure")
FLOW_STAGES = (
    ("API endpoints", "API endpoint"),
    ("routers", "router"),
    ("services", "service"),
    ("database models", "database model"),
)

# Default marker that tells a generated document from a manual one.
GENERATED_MARKER = ".. GENERATED ARCHITECTURE DRAFT"

# Host allow-list and owner/repo shape.
ALLOWED_HOSTS = {"github": ("github.com",), "gitlab": ("gitlab.com",)}
GITHUB_REPO_PATH = r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.]+[A-Za-z0-9_.-]*$"
