"""The seven rules with their texts.

These must stay as they are for results to agree with published ones.
"""

from typing import NamedTuple


class Rule(NamedTuple):
    rule_id: str
    severity: str
    raw_nl: str
    description: str
    guidance: str
    why: str
    fix: str
    patch_title: str
    patch_summary: str


# Fixed values, in the order rules are listed in results.
RULES = (
    Rule(
        rule_id="NO_HARDCODED_SECRETS",
        severity="critical",
        raw_nl="No hardcoded secrets",
        description="Hardcoding passwords or API keys exposes credentials immediately when the repository is accessed.",
        guidance="Replace the secret with an environment variable lookup. Do not put the real value back in the code.",
        why="Putting a password or API key in your code is like taping your house key to the front door.\n"
        "  Bots scan GitHub and steal exposed secrets in under 3 minutes (GitGuardian).",
        fix="Use os.environ.get('API_KEY') or process.env.API_KEY — keep secrets out of the code.",
        patch_title="Moved secret values out of the code",
        patch_summary="Replaced hardcoded keys or passwords with environment variable lookups so no actual secret "
        "remains in the code even if the repository is exposed.",
    ),
    Rule(
        rule_id="NO_NETWORK",
        severity="critical",
        raw_nl="No unvalidated external network calls",
        description="Sending requests to unvalidated addresses can allow internal network scanning or leaking "
        "sensitive data.",
        guidance="Do not call user-supplied URLs directly. Use an allow-list of trusted domains or a fixed endpoint.",
        why="Fetching a URL typed by a user lets attackers hit private servers inside your cloud.\n"
        "  One request to 169.254.169.254 can steal your AWS credentials. (SSRF)",
        fix="Check the URL against an allow-list of trusted domains before making the request.",
        patch_title="Blocked unvalidated external network calls",
        patch_summary="Prevented user input from flowing directly to network destinations by blocking or restricting "
        "to a fixed safe endpoint.",
    ),
    Rule(
        rule_id="NO_EXEC",
        severity="critical",
        raw_nl="No shell execution",
        description="Running shell commands as strings allows a single input to execute arbitrary server commands.",
        guidance="Remove the shell string execution. Use a safe argument list (shell=False) or block the operation.",
        why="Running a shell command as a string lets an attacker sneak in extra commands with a semicolon.\n"
        "  One bad input → full server takeover. (CVSS 9.8 / Remote Code Execution)",
        fix="Use subprocess.run(['cmd', arg], shell=False) — pass arguments as a list, never a string.",
        patch_title="Removed shell command injection path",
        patch_summary="Replaced string-based shell execution with list-argument execution or a block so user input "
        "cannot be interpreted as server commands.",
    ),
    Rule(
        rule_id="SQL_PARAM_BINDING",
        severity="high",
        raw_nl="SQL parameter binding required",
        description="Embedding user values directly in SQL strings allows attackers to alter query structure with "
        "their input.",
        guidance="Replace string-interpolated SQL with parameterized queries (placeholders + bound values).",
        why="Putting user input inside a SQL string lets attackers type '; DROP TABLE users;--\n"
        "  and delete your entire database. (OWASP #3 — SQL Injection)",
        fix="Use cursor.execute('SELECT ... WHERE name=?', (name,)) — let the driver handle quoting.",
        patch_title="Switched SQL to parameterized queries",
        patch_summary="Passed user values as bound parameters to the DB driver instead of interpolating them into the "
        "SQL string, keeping the query structure fixed.",
    ),
    Rule(
        rule_id="NO_DEBUG_MODE",
        severity="high",
        raw_nl="No debug mode in production",
        description="Deploying with debug mode enabled exposes internal server state and configuration.",
        guidance="Replace the hardcoded debug=True with an environment variable check.",
        why="Shipping with debug=True turns on an interactive console anyone on the internet can reach.\n"
        "  They can run any Python or JS code they want on your server. (CWE-16)",
        fix="Use DEBUG = os.environ.get('DEBUG', 'false').lower() == 'true' so it is off by default.",
        patch_title="Disabled debug mode in the production default",
        patch_summary="Replaced the hardcoded debug=True with an environment variable or production-safe condition so "
        "internal details are not exposed to users.",
    ),
    Rule(
        rule_id="NO_WEAK_RANDOM",
        severity="high",
        raw_nl="No weak random in security context",
        description="Generating tokens or credentials with weak random allows attackers to predict values and hijack "
        "sessions.",
        guidance="Use the secrets or crypto module for tokens, sessions, and OTPs instead of the math random functions.",
        why="Math.random() and random.random() are guessable — like rolling a dice with a pattern.\n"
        "  An attacker can predict your tokens and take over accounts. (CWE-330)",
        fix="Use secrets.token_hex(32) in Python or crypto.randomUUID() in JS for security tokens.",
        patch_title="Replaced predictable random with cryptographically secure random",
        patch_summary="Replaced weak random used for security tokens, sessions, or OTPs with the secrets or crypto "
        "module so values cannot be predicted.",
    ),
    Rule(
        rule_id="NO_BARE_EXCEPT",
        severity="medium",
        raw_nl="No bare except blocks",
        description="Swallowing exceptions silently hides attack indicators and failure causes, allowing dangerous "
        "behavior to continue.",
        guidance="Replace the empty except/catch with specific error handling and a log statement.",
        why="An empty catch block hides errors like sweeping dirt under a rug.\n"
        "  Attacks and crashes go unnoticed — average breach detection time: 207 days (IBM).",
        fix="Use except Exception as e: logger.warning(e) so every problem gets logged.",
        patch_title="Made silently swallowed exceptions visible",
        patch_summary="Added specific error handling or logging to empty except/catch blocks so failures and attack "
        "signals are no longer hidden.",
    ),
)

RULE_IDS = tuple(rule.rule_id for rule in RULES)

# Texts for a rule that is not one of the seven.
OTHER_GUIDANCE = "Replace the violation with a safe alternative."
OTHER_PATCH_TITLE = "Replaced security violation with a safe implementation"
OTHER_PATCH_SUMMARY = (
    "Fixed only the detected vulnerable code with the smallest change needed, preserving existing behavior as much "
    "as possible."
)
OTHER_PATCH_GUIDANCE = "Replace the detected violation with a safe alternative."

# Fixed value: what the reference field of an explanation begins with.
REFERENCE = "spec.md#"

# Importance and frequency estimate of rules and candidates, and why a candidate was left out.
IMPORTANCE = (
    ("NO_HARDCODED_SECRETS", 5.00, None, None),
    ("NO_EXEC", 4.70, None, None),
    ("SQL_PARAM_BINDING", 4.20, None, None),
    ("NO_NETWORK", 3.70, None, None),
    ("NO_DEBUG_MODE", 3.55, None, None),
    ("NO_WEAK_RANDOM", 3.55, None, None),
    ("NO_BARE_EXCEPT", 3.00, 3.0, None),
    ("INSECURE_DESERIALIZATION", 4.20, None, "not detected by syntax yet"),
    ("CORS_WILDCARD", 2.95, None, "too many false positives"),
    ("INSECURE_COOKIE", 2.60, None, "JavaScript only"),
)
