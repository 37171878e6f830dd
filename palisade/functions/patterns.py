"""Detection patterns (fixed values) and the one place that adapts them to the JVM regex engine."""

from __future__ import annotations

import re

# Fixed values: (family, confidence, pattern, description), in evaluation order. Confidence 1.0 is HIGH.
# A pattern marked with (?i) ignores case.
SIGNATURES = [
    ("sqli", 1.0, r"(?i)union\s+(?:all\s+)?select\s+", "UNION SELECT injection"),
    ("sqli", 1.0, r"(?i)'\s*(?:or|and)\s+['\d].*?--", "Tautology with comment"),
    ("sqli", 1.0, r"(?i)'[\s]*--", "Quote-comment bypass"),
    ("sqli", 1.0, r"(?i)'[\s]*#", "Quote-hash bypass"),
    ("sqli", 1.0, r"(?i)(?:'\s*(?:or|and)\s+'\d+'='['\d]|'\s*or\s+\d+=\d+)", "Classic OR/AND tautology"),
    ("sqli", 1.0, r"(?i);\s*(?:drop|truncate|delete|insert|update|create|alter)\s+", "Stacked query"),
    ("sqli", 1.0, r"(?i)(?:sleep\s*\(\s*\d+|benchmark\s*\(\s*\d+|pg_sleep\s*\(\s*\d+|waitfor\s+delay)", "Time-based blind injection"),
    ("sqli", 1.0, r"(?i)from\s+information_schema\s*\.", "Information schema probe"),
    ("sqli", 1.0, r"(?i)(?:sysobjects|syscolumns|sys\.tables|sys\.columns|pg_catalog)", "System table access"),
    ("sqli", 1.0, r"(?i)(?:exec|execute)\s+(?:xp_cmdshell|sp_executesql|sp_makewebtask)", "SQL exec command"),
    ("sqli", 1.0, r"""(?i)(?:load_file\s*\(|into\s+(?:out|dump)file\s*['"])""", "SQL file read/write"),
    ("sqli", 0.7, r"""(?i)['"].*?(?:select|insert|update|delete|drop|union|exec)""", "Quote with SQL keyword"),
    ("sqli", 0.65, r"(?i)(?:--|#|/\*[\s\S]*?\*/)\s*$", "SQL comment at end"),
    ("sqli", 0.7, r"(?i)(?:select|union|insert|update|delete|drop).{0,30}(?:from|where|table|database)", "Multiple SQL keywords"),
    ("sqli", 0.65, r"(?i)(?:0x[0-9a-f]{4,}|char\s*\(\s*\d+)", "SQL hex/char encoding"),
    ("sqli", 0.75, r"(?i)having\s+\d+=\d+|group\s+by\s+.+having", "HAVING clause injection"),
    ("xss", 1.0, r"(?i)<script[\s>]", "Script tag"),
    ("xss", 1.0, r"(?i)<script[^>]+src\s*=", "Script with src"),
    ("xss", 1.0, r"(?i)javascript\s*:", "JavaScript protocol"),
    ("xss", 1.0, r"""(?i)on(?:error|load|click|mouseover|focus|blur|change|submit|keypress|keydown|keyup)\s*=\s*['"]?(?:alert|eval|document|window|location|fetch)""", "Event handler with JS"),
    ("xss", 1.0, r"(?i)(?:eval|setTimeout|setInterval)\s*\(", "JS code execution"),
    ("xss", 1.0, r"(?i)document\s*\.\s*(?:cookie|write|location|domain|referrer)", "DOM access"),
    ("xss", 1.0, r"(?i)vbscript\s*:", "VBScript protocol"),
    ("xss", 1.0, r"(?i)<svg[^>]+on\w+\s*=", "SVG event handler"),
    ("xss", 1.0, r"""(?i)<iframe[^>]+src\s*=\s*['"]?(?:javascript|data|vbscript)""", "Iframe injection"),
    ("xss", 1.0, r"(?i)data\s*:\s*text/html", "Data URI HTML"),
    ("xss", 0.75, r"""(?i)on\w{2,20}\s*=\s*['"]""", "Generic event handler"),
    ("xss", 0.8, r"""(?i)<(?:img|body|input|form|a|link|meta|object|embed)[^>]+(?:src|href|action|data)\s*=\s*['"]?(?:javascript|vbscript|data)""", "HTML tag with JS URI"),
    ("xss", 0.7, r"(?i)(?:alert|prompt|confirm)\s*\(", "XSS alert/prompt/confirm"),
    ("xss", 0.65, r"(?i)&#x[0-9a-f]+;|&#\d+;", "HTML entity encoding"),
    ("xss", 0.8, r"(?i)expression\s*\(", "CSS expression"),
    ("path_traversal", 1.0, r"(?:\.\./){3,}|(?:\.\.\\){3,}", "Multiple directory traversal"),
    ("path_traversal", 1.0, r"(?i)/etc/(?:passwd|shadow|hosts|group|sudoers|crontab)", "/etc sensitive file"),
    ("path_traversal", 1.0, r"(?i)(?:c:\\windows\\|\\system32\\|\\syswow64\\)", "Windows system path"),
    ("path_traversal", 1.0, r"(?i)/proc/(?:self|version|cmdline|environ|net/)", "/proc access"),
    ("path_traversal", 1.0, r"(?i)(?:\.htaccess|\.htpasswd|web\.config|php\.ini|nginx\.conf)", "Server config file"),
    ("path_traversal", 1.0, r"(?i)(?:\.ssh/|id_rsa|authorized_keys|\.aws/credentials)", "Credentials file"),
    ("path_traversal", 1.0, r"%00|\\x00|\x00", "Null byte injection"),
    ("path_traversal", 0.8, r"(?:\.\./){2}|(?:\.\.\\){2}", "Directory traversal"),
    ("path_traversal", 0.9, r"(?i)(?:%2e%2e%2f|%2e%2e/|\.\.%2f|%252e%252e)", "Encoded path traversal"),
    ("path_traversal", 0.9, r"(?i)(?:%2e%2e%5c|%252e%252e%255c)", "Encoded Windows traversal"),
    ("path_traversal", 0.75, r"(?i)\.\./.*?\.(?:conf|cfg|ini|log|bak|sql|db|env)", "Traversal to config file"),
    ("cmdi", 1.0, r"(?i)(?:;|\||&&|`|\$\()\s*(?:cat|ls|id|whoami|uname|pwd|wget|curl|nc|netcat|bash|sh|python|perl|ruby|php)\b", "Shell command after separator"),
    ("cmdi", 1.0, r"\$\([^)]+\)|`[^`]+`", "Command substitution"),
    ("cmdi", 1.0, r"(?i)(?:bash|nc|netcat|python|perl|ruby)\s+.*?(?:\d{1,3}\.){3}\d{1,3}\s+\d{2,5}", "Reverse shell"),
    ("cmdi", 1.0, r"(?i)/(?:bin|usr/bin|sbin|usr/sbin)/(?:bash|sh|nc|wget|curl|python|perl|ruby|php)", "Binary path execution"),
    ("cmdi", 1.0, r"\$(?:PATH|IFS|HOME|SHELL|USER|LD_PRELOAD)\b", "Environment variable injection"),
    ("cmdi", 1.0, r"(?i)>\s*/etc/|>\s*/var/www/|>\s*/tmp/", "Output redirection to system path"),
    ("cmdi", 0.7, r"(?i)\|\s*(?:grep|awk|sed|cut|head|tail|sort|uniq|wc|xargs)\b", "Pipe with text command"),
    ("cmdi", 0.75, r"(?i);\s*(?:echo|printf|sleep|ping|nslookup|dig)\b", "Semicolon with command"),
    ("cmdi", 0.7, r"`[^`]{3,}`", "Backtick expression"),
    ("cmdi", 0.65, r"&&\s*\w+|;\s*\w+\s*;", "Chained commands"),
]

# Text that must occur (in lower case, any of the listed) before a signature can match, in the order of
# SIGNATURES. A plain substring test is far cheaper than the pattern it saves.
SIGNATURE_GUARDS = [
    ["union"], ["'"], ["'"], ["'"], ["'"], [";"], ["sleep", "benchmark", "waitfor"], ["information_schema"],
    ["sysobjects", "syscolumns", "sys.", "pg_catalog"], ["xp_cmdshell", "sp_"], ["load_file", "into"],
    ["'", '"'], ["--", "#", "*/"], ["from", "where", "table", "database"], ["0x", "char"], ["having"],
    ["<script"], ["<script"], ["javascript"], ["alert", "eval", "document", "window", "location", "fetch"],
    ["eval", "settimeout", "setinterval"], ["document"], ["vbscript"], ["<svg"], ["<iframe"], ["text/html"],
    ["'", '"'], ["javascript", "vbscript", "data"], ["alert", "prompt", "confirm"], ["&#"], ["expression"],
    ["../", "..\\"], ["/etc/"], ["windows", "system32", "syswow64"], ["/proc/"],
    [".htaccess", ".htpasswd", "web.config", "php.ini", "nginx.conf"], [".ssh/", "id_rsa", "authorized_keys", ".aws/"],
    ["%00", "\\x00", "\x00"], ["../", "..\\"], ["%2e", "%252e", "..%2f"], ["%5c", "%255c"], ["../"],
    [";", "|", "&&", "`", "$("], ["$(", "`"], ["bash", "nc", "netcat", "python", "perl", "ruby"], ["bin/"],
    ["$path", "$ifs", "$home", "$shell", "$user", "$ld_preload"], [">"], ["|"], [";"], ["`"], ["&&", ";"],
]

# More such lists by description: some text of each must occur as well.
MORE_GUARDS = {
    "Tautology with comment": [["--"], ["or", "and"]], "Quote-comment bypass": [["--"]], "Quote-hash bypass": [["#"]],
    "Classic OR/AND tautology": [["="], ["or", "and"]],
    "Stacked query": [["drop", "truncate", "delete", "insert", "update", "create", "alter"]],
    "Quote with SQL keyword": [["select", "insert", "update", "delete", "drop", "union", "exec"]],
    "Multiple SQL keywords": [["select", "union", "insert", "update", "delete", "drop"]],
    "HAVING clause injection": [["=", "group"]], "JavaScript protocol": [[":"]], "Event handler with JS": [["on"], ["="]],
    "JS code execution": [["("]], "DOM access": [["."]], "SVG event handler": [["on"], ["="]], "Generic event handler": [["on"], ["="]],
    "HTML tag with JS URI": [["<"], ["="]], "XSS alert/prompt/confirm": [["("]], "CSS expression": [["("]],
    "Shell command after separator": [["cat", "ls", "id", "whoami", "uname", "pwd", "wget", "curl", "nc", "bash", "sh", "python", "perl", "ruby", "php"]],
    "Reverse shell": [["."]], "Output redirection to system path": [["/etc/", "/var/www/", "/tmp/"]],
    "Pipe with text command": [["grep", "awk", "sed", "cut", "head", "tail", "sort", "uniq", "wc", "xargs"]],
    "Semicolon with command": [["echo", "printf", "sleep", "ping", "nslookup", "dig"]],
}

# By description: some text of the first list must come before one of the second in the same line.
IN_ORDER = {"Quote with SQL keyword": (("'", '"'), ("select", "insert", "update", "delete", "drop", "union", "exec"))}

# First-layer rules over lower-cased text.
STATIC_SQLI = [
    r"union\s+select", r"or\s+1\s*=\s*1", r"drop\s+table", r"insert\s+into",
    r"delete\s+from", r"update\s+\w+\s+set", r"--", r";\s*--",
]
STATIC_XSS = [r"<script>", r"javascript:", r"onerror=", r"onload="]
# Text that must occur (in lower case) before a body pattern can match, in their order.
STATIC_GUARDS = ["union", "=", "drop", "insert", "delete", "update", "--", "--", "<script>", "javascript:", "onerror=", "onload="]
STATIC_PATH = [r"\.\./", r"\.\.\\"]
STATIC_AGENTS = ["sqlmap", "nikto", "nmap", "curl", "masscan"]
TOOL_AGENTS = ["curl", "python", "wget", "httpclient"]

# Honeypot families.
HONEYPOT_FAMILIES = {
    "SQLi": [
        r"(?i)(\bor\b|\band\b)\s+\d+\s*=\s*\d+",
        r"(?i)(union\s+select|sleep\()",
        r"(?i)(--|#|/\*)\s*\w*",
        r"""(?i)('|")\s*or\s*('|")?1('|")?\s*=\s*('|")?1""",
    ],
    "XSS": [r"(?i)<script[^>]*>", r"(?i)on\w+\s*=", r"(?i)javascript:", r"(?i)alert\s*\("],
    "PathTraversal": [r"\.\./\.\./", r"(?i)/etc/passwd", r"(?i)system32\\\\cmd\.exe"],
    "RFI_LFI": [r"(?i)(file|php|data):\/\/", r"(?i)(\?|&)file=", r"(?i)(\?|&)(path|page|include|inc|template)="],
    "CmdInjection": [r"(\||;|&&|\bexec\b|\bcurl\b|\bwget\b|\bnslookup\b)", r"(?i)(;|\|\|)\s*(cat|ls|whoami|id)"],
    "SSRF": [r"(?i)(\?|&)(url|target|dest|u)=https?://", r"(?i)169\.254\.169\.254"],
    "AuthBruteforce": [r"(?i)/wp-login\.php|/admin|/login", r"(?i)password=\w{0,}"],
}
HONEYPOT_FLOOR = 0.25
# Text that must occur (in lower case, one of each list) before a family's pattern can match, in their order.
HONEYPOT_GUARDS = {
    "SQLi": [[["="], ["or", "and"]], [["union", "sleep("]], [["--", "#", "/*"]], [["="], ["or"], ["1"]]],
    "XSS": [[["<script"], [">"]], [["on"], ["="]], [["javascript:"]], [["alert"], ["("]]],
    "PathTraversal": [[["../../"]], [["/etc/passwd"]], [["system32"]]],
    "RFI_LFI": [[["://"], ["file", "php", "data"]], [["file="]], [["path=", "page=", "include=", "inc=", "template="]]],
    "CmdInjection": [[["|", ";", "&&", "exec", "curl", "wget", "nslookup"]], [[";", "||"], ["cat", "ls", "whoami", "id"]]],
    "SSRF": [[["://"], ["="]], [["169.254.169.254"]]],
    "AuthBruteforce": [[["/wp-login.php", "/admin", "/login"]], [["password="]]],
}

# Compact payload features.
COMPACT_SQL = r"(?i)(select|union|insert|drop|or\s+1=1)"
COMPACT_XSS = r"(?i)(<script|onerror=|alert\()"
COMPACT_PATH = r"(?i)(\.\./|\.\.\\|/etc/passwd)"
COMPACT_CMD = r"(?i)(;|\|\||&&|\b(cat|ls|whoami)\b)"

# The four in their order, with literals that match by themselves and those without which the rest can't match, in lower case.
COMPACT = [
    (COMPACT_SQL, ["select", "union", "insert", "drop"], ["1=1"]), (COMPACT_XSS, ["<script", "onerror=", "alert("], []),
    (COMPACT_PATH, ["../", "..\\", "/etc/passwd"], []), (COMPACT_CMD, [";", "||", "&&"], ["cat", "ls", "whoami"]),
]

# Inputs a usable rule must leave alone, and the bare wildcards.
BENIGN_SAMPLES = [
    "/api/status", "/health", "GET", "POST",
    "application/json", "text/html",
    "Mozilla/5.0 (Windows NT 10.0)",
    "localhost", "127.0.0.1",
    "username=alice", "search=hello world",
    "page=1&limit=20", "id=42",
]
WILDCARDS = [".*", ".+", ".{0,}", ".{1,}", "(?s).*"]

# The headers whose values are scanned.
SCANNED_HEADERS = ["referer", "x-forwarded-for", "user-agent", "x-custom-header"]

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
DIGIT = r"\p{Nd}"


END = r"(?:\n?\z)"


#: What Python's engine takes and the JVM's does not.
NOT_PORTABLE = r"\(\?\(|\\N\{|\(\?[a-zA-Z]*[aL]"


def portable(pattern: str) -> str:
    r"""Spell ``\w \s \d``, their negations, ``.``, ``$`` and ``\Z`` so that they keep their meaning in JVM and RE2 engines.

    Those engines read the shorthands as ASCII only, end ``.`` at other line breaks than ``\n``, and differ in ``$`` and
    ``\Z`` before a final line break. A negation beside other members of a class stays as it is.
    """
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    dot_all = bool(flags and "s" in flags[1])
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        alone = None if in_class else re.match(r"\[(\^?)\\([WSD])\]", pattern[i:])
        if alone or (two in (r"\W", r"\S", r"\D") and not in_class):
            body = {"W": WORD, "S": SPACE, "D": DIGIT}[alone[2] if alone else two[1]]
            out.append(f"[{body}]" if alone and alone[1] else f"[^{body}]")
            i += alone.end() if alone else 2
            continue
        if two == r"\Z" and not in_class:
            out.append(r"\z")
            i += 2
            continue
        if two in (r"\w", r"\s", r"\d"):
            body = {"w": WORD, "s": SPACE, "d": DIGIT}[two[1]]
            if in_class and two == r"\s" and pattern[i + 2:i + 4] == r"\S":
                out.append(r"\s\S")
                i += 4
                continue
            out.append(body if in_class else f"[{body}]")
            i += 2
            continue
        if two[:1] == "\\":
            out.append(pattern[i:i + 2])
            i += 2
            continue
        ch = pattern[i]
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        plain = not in_class
        out.append(END if plain and ch == "$" else r"[^\n]" if plain and ch == "." and not dot_all else ch)
        i += 1
    return "".join(out)


def jvm(pattern: str) -> str:
    r"""A portable pattern as the JVM takes it: case folding beyond ASCII, ``$`` without width, named groups.

    Names lose what the JVM doesn't allow in them; rules only ask whether a pattern matches.
    """
    names: dict[str, str] = {}
    name = lambda n: names.setdefault(n, f"g{len(names)}x")
    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{name(m[1])}>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{name(m[1])}>", out)
    out = re.sub(r"^\(\?([a-zA-Z]*i[a-zA-Z]*)\)", lambda m: f"(?{m[1]}u)" if "u" not in m[1] else m[0], out)
    return out.replace(END, r"(?=\n?\z)")


def compiles(pattern: str) -> bool:
    try:
        re.compile(pattern, re.IGNORECASE | re.DOTALL)
    except re.error:
        return False
    return True
