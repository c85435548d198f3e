"""Values that results depend on."""

# Classification of source files.
CODE_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".rs", ".go", ".java", ".rb", ".php", ".cs")
MAX_BYTES = 1_500_000
TEST_PATTERNS = ("test_*.py", "*_test.py", "*.test.ts", "*.test.tsx", "*.test.js", "*.test.jsx", "*.spec.ts", "*.spec.tsx", "*.spec.js", "*.spec.jsx", "*_test.go", "*_test.rs")
TEST_DIRS = ("tests", "test", "__tests__", "spec", "specs")
IGNORED_DIRS = (".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", "target", ".next", ".cache")
LANGUAGES = {".py": "Python", ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".rs": "Rust", ".go": "Go", ".rb": "Ruby"}

# Side effects, as regex and label.
SIDE_EFFECTS = (
    (
        r"""\b(?:cursor|conn|connection|session|db|engine)\.execute\s*\(\s*['"]\s*(?:INSERT|UPDATE|MERGE)\b"""
        r"""|\b(?:Session|session|db\.session)\.add(?:_all)?\s*\("""
        r"""|\.objects\.(?:create|bulk_create|update|update_or_create|get_or_create)\s*\("""
        r"""|\b\w+\.\w+\.(?:create|bulk_create|insert_one|insert_many|update_one|update_many|save)\s*\("""
        r"""|\b(?:INSERT\s+INTO|UPDATE\s+\w+\s+SET|MERGE\s+INTO)\b""",
        "DB write",
    ),
    (
        r"""\b(?:cursor|conn|connection|session|db|engine)\.execute\s*\(\s*['"]\s*DELETE\b"""
        r"""|\.objects\.(?:delete|filter\([^)]*\)\.delete)\s*\("""
        r"""|\b\w+\.\w+\.(?:delete_one|delete_many|remove)\s*\("""
        r"""|\bDELETE\s+FROM\b""",
        "DB delete",
    ),
    (r"""\bsmtplib\.|\bsend_mail\s*\(|\bsendmail\s*\(|\bsendEmail\s*\(|\bEmailMessage\s*\(|\bemail\.mime|\bmailer\.send\s*\(""", "Email send"),
    (
        r"""\brequests\.(?:get|post|put|patch|delete|head|options|request|Session)\s*\("""
        r"""|\b(?:httpx|aiohttp|urllib3)\.(?:get|post|put|patch|delete|request|Client|AsyncClient)\b"""
        r"""|\burllib\.request\.urlopen\s*\("""
        r"""|\baxios\.(?:get|post|put|patch|delete|request|create)\s*\("""
        r"""|\bfetch\s*\(\s*['"`]https?://"""
        r"""|\bsocket\.(?:connect|create_connection)\s*\("""
        r"""|\bhttp\.client\.HTTP""",
        "Network call",
    ),
    (
        r"""\bsubprocess\.(?:run|call|check_call|check_output|Popen)\s*\("""
        r"""|\bos\.(?:system|popen|spawn[lvep]+|exec[lvep]+)\s*\("""
        r"""|\bcommands\.getoutput\s*\("""
        r"""|\bshell_exec\s*\(""",
        "Shell execution",
    ),
    (
        r"""\b(?:open|Path\([^)]*\)\.write_text|Path\([^)]*\)\.write_bytes)\s*\([^)]*['"][wax]\b"""
        r"""|\bshutil\.(?:copy|copy2|copyfile|copytree|rmtree|move)\s*\("""
        r"""|\bos\.(?:remove|unlink|rename|mkdir|makedirs|rmdir)\s*\(""",
        "Filesystem write",
    ),
)

# Security findings, as regex and label; the last needs both.
FINDINGS = (
    (r"""(?i)(api[_-]?key|secret|token|password)\s*=\s*['"][^'"]{12,}['"]""", "possible hardcoded secret"),
    (r"""(?i)(select|insert|update|delete)\s+.*(%\s*|\.format\(|\+\s*\w+|f['"])""", "possible SQL injection"),
    (r"""\b(eval|exec)\s*\(""", "unsafe eval/exec"),
    (r"""subprocess\.[\w_]+\([^\n)]*shell\s*=\s*True""", "shell=True command execution"),
    (r"""(?i)pickle\.loads?\s*\(""", "unsafe pickle deserialization"),
    (r"""(?i)yaml\.load\s*\([^\n)]*(Loader\s*=\s*yaml\.Loader|Loader\s*=\s*Loader)?""", "unsafe yaml.load"),
)
RANDOMNESS = (r"""(?i)random\.(random|randint|choice|choices)\s*\(""", r"""(?i)token|secret|password|salt|nonce|key|crypto""", "non-cryptographic randomness")

# Imports and routes.
REQUIRE = r"""\brequire\s*\(\s*['"]([^'"]+)['"]\s*\)"""
IMPORT_FROM = r"""\b(?:import|from|export\s+(?:\*|\{[^}]*\}))\s+(?:[^'"]*?\s+from\s+)?['"]([^'"]+)['"]"""
GO_IMPORT = r"""^\s*(?:import\s+)?(?:[A-Za-z_]\w*\s+)?['"]([^'"]+)['"]"""
RUST_USE = r"""^\s*use\s+([A-Za-z_][\w:]*)"""
ROUTE_DICT = r"""['"]([A-Z]+\s+/[^'"]+)['"]\s*:\s*([A-Za-z_][\w.]*)"""
ROUTE_CALL = r"""(?i)\b(?:router|app)\.(get|post|put|patch|delete)\(['"]([^'"]+)['"]\s*,\s*([A-Za-z_][\w.]*)"""

# Declarations by line, as kind and regex.
LINE_SYMBOLS = (
    ("class", r"\b(?:export\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("function", r"\b(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)"),
    ("function", r"\b(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"),
)

# Calls by line; Cls(...).m(, Cls.m(, v.m( and v = Cls(.
CALL_OF_NEW = r"\b([A-Z][A-Za-z0-9_]*)\s*\([^)]*\)\s*\.\s*([A-Za-z_][A-Za-z0-9_]*)\s*\("
CALL_OF_CLASS = r"\b([A-Z][A-Za-z0-9_]*)\s*\.\s*([A-Za-z_][A-Za-z0-9_]*)\s*\("
CALL_OF_NAME = r"\b([a-z_][\w]*)\s*\.\s*([A-Za-z_][A-Za-z0-9_]*)\s*\("
MADE_OF_CLASS = r"\b([a-z_][\w]*)\s*=\s*([A-Z][\w]*)\s*\("

# What a relative import may stand for, best first, and the extensions that may stand for another source.
STEMS = ("", ".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", "/index.js", "/index.ts", "/index.jsx", "/index.tsx", "/__init__.py")
SCRIPT_EXTENSIONS = (".js", ".mjs", ".cjs", ".jsx")

# Roles, by the words that a path holds, in order; the last for other files. Analyzers' precision and confidence.
TEST_ROLE = "test coverage"
ROLES = ((("service",), "domain/service logic"), (("controller", "route"), "request/API flow"), (("db", "model", "schema"), "data/model layer"))
OTHER_ROLE = "source"
CONFIDENCE = {"python_ast": ("exact_range", "high"), "syntax_scan": ("syntax_aware", "medium"), "regex": ("heuristic", "low")}

# Commands without a shell counterpart, and what is said of them.
NO_ANALOGUE = ("symbol", "callgraph", "tests-for", "impact", "review", "refs", "blame", "sdiff", "api", "preflight")
NO_ANALOGUE_TEXT = "(no direct shell equivalent — would have required multiple grep+sed)"

# What an absolute import may resolve to, best first, and source roots.
ABSOLUTE = ("/__init__.py", "/index.js", "/index.ts", "/index.jsx", "/index.tsx", ".py", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs")
SOURCE_ROOTS = ("src", "lib", "pkg", "internal")

# Risk words in paths.
IMPACT_WORDS = ("auth", "db", "session", "payment")
PREFLIGHT_WORDS = ("auth", "db", "session", "payment", "billing")
