"""Names, word lists and patterns that decide what is a finding.

These must stay as they are for results to agree with published ones.
"""

# Supported file endings and the language of each.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
}

# Directory names that are never entered.
IGNORED_DIRECTORIES = (
    ".git",
    "node_modules",
    ".venv",
    "venv",
    "dist",
    "build",
    ".next",
    "coverage",
    "__pycache__",
    ".omx",
    ".pytest_cache",
)

# Words that mark a value as a placeholder, not a secret.
PLACEHOLDER_WORDS = (
    "example",
    "dummy",
    "test",
    "changeme",
    "your_api_key",
    "xxxxx",
    "sample",
    "placeholder",
)

# Words that make randomness a security matter.
SECURITY_WORDS = ("token", "secret", "password", "session", "otp", "auth", "reset", "csrf")

# Python calls that open a network connection.
NETWORK_CALLS = (
    "requests.get",
    "requests.post",
    "requests.put",
    "requests.delete",
    "requests.patch",
    "requests.request",
    "httpx.get",
    "httpx.post",
    "httpx.put",
    "httpx.delete",
    "httpx.patch",
    "httpx.request",
    "urllib.request.urlopen",
    "urllib3.request",
    "aiohttp.request",
    "socket.create_connection",
    "socket.socket.connect",
    "boto3.client",
)

# Parts of a dotted name that hint at request data.
REQUEST_WORDS = ("request", "req", "query", "form", "body", "args", "params", "data")

# Python calls that start a process.
EXEC_CALLS = (
    "subprocess.run",
    "subprocess.Popen",
    "subprocess.call",
    "subprocess.check_call",
    "subprocess.check_output",
    "os.system",
    "os.popen",
    "os.execv",
    "os.execve",
    "os.execvp",
)

# Python calls that draw predictable random numbers.
RANDOM_CALLS = (
    "random.random",
    "random.randint",
    "random.randrange",
    "random.choice",
    "random.choices",
)

# SQL words looked for in JavaScript lines and in Python strings.
JS_SQL_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "DROP")
PY_SQL_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "UNION")

# Markers of request data in the first argument of a JavaScript call.
JS_REQUEST_MARKERS = ("req.", "request.", "params.", "query.", "body.", "args.", "data.", "${")

# Names that hold secrets, per language.
PY_SECRET_NAMES = (
    r"password|passwd|pwd|api[_-]?key|apikey|secret|token|credential|access[_-]?key"
)
JS_SECRET_NAMES = r"password|passwd|pwd|api_?key|secret|token|credential"

# Shapes of tokens issued by providers.
SK_TOKEN_PY = r"sk-[A-Za-z0-9]{20,}"
SK_TOKEN_JS = r"sk-[A-Za-z0-9-]{20,}"
GHP_TOKEN = r"ghp_[A-Za-z0-9]{36}"
AKIA_TOKEN = r"AKIA[0-9A-Z]{16}"
PEM_HEADER = r"-----BEGIN (?:RSA|EC|DSA|OPENSSH|PGP) PRIVATE KEY-----"
JWT_TOKEN = r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9._-]{10,}\.[A-Za-z0-9._-]{10,}"

# Aliases of rule ids.
RULE_ALIASES = {
    "HARDCODED_SECRETS": "NO_HARDCODED_SECRETS",
    "COMMAND_INJECTION": "NO_EXEC",
    "SQL_INJECTION": "SQL_PARAM_BINDING",
    "DEBUG_MODE_ON": "NO_DEBUG_MODE",
    "WEAK_HASH": "NO_WEAK_RANDOM",
    "NO_INSECURE_HASH": "NO_WEAK_RANDOM",
}

# Order of severities, worst first, and the label each is shown with.
SEVERITY_LABELS = {
    "critical": "● CRITICAL",
    "high": "▲ HIGH",
    "medium": "■ MEDIUM",
    "low": "▪ LOW",
}

# Limits.
MAX_ATTEMPTS_PER_FILE = 20
