"""Fixed values that results depend on: name patterns, presets, plans, rules."""

# Criticality by the first pattern that a lower-cased name contains, and the default of each node type.
CRITICALITY = {
    "file": ([("__init__.py", 0.9), ("models.py", 0.8), ("views.py", 0.8), ("controllers", 0.8), ("services", 0.7), ("utils", 0.6), ("config", 0.7), ("settings", 0.7), ("constants", 0.6), ("exceptions", 0.6), ("middleware", 0.7), ("serializers", 0.7), ("validators", 0.7), ("permissions", 0.8), ("auth", 0.9), ("security", 0.9), ("api", 0.8), ("tests", 0.3), ("migrations", 0.4)], 0.5),
    "class": ([("controller", 0.9), ("service", 0.8), ("model", 0.8), ("view", 0.7), ("serializer", 0.7), ("validator", 0.7), ("manager", 0.7), ("exception", 0.6), ("test", 0.2)], 0.5),
    "function": ([("__init__", 0.8), ("save", 0.7), ("create", 0.7), ("update", 0.7), ("delete", 0.7), ("get", 0.6), ("post", 0.6), ("put", 0.6), ("patch", 0.6), ("validate", 0.7), ("authenticate", 0.9), ("authorize", 0.9), ("process", 0.6), ("handle", 0.6), ("setup", 0.6), ("teardown", 0.5), ("test_", 0.2)], 0.4),
}
CRITICALITY_ELSE = 0.5

# Weights of the five ranking factors, and of graph and semantic scores in fusion.
RANK_WEIGHTS = {"semantic": 0.4, "graph": 0.3, "criticality": 0.15, "frequency": 0.1, "efficiency": 0.05}
FUSION = {"graph": 0.4, "semantic": 0.6, "no_graph": 0.1, "no_semantic": 0.0}
DECAY = 0.8

# Fixed values: (context window, recommended budget, maximum budget, characters per token) of each model.
PRESETS = {
    "gpt-4": (8192, 4000, 6000, 4.0),
    "gpt-4-turbo": (128000, 16000, 64000, 4.0),
    "gpt-4o": (128000, 16000, 64000, 4.0),
    "gpt-3.5-turbo": (16385, 8000, 12000, 4.0),
    "claude-3-opus": (200000, 32000, 100000, 3.5),
    "claude-3.5-sonnet": (200000, 32000, 100000, 3.5),
    "claude-3-haiku": (200000, 16000, 50000, 3.5),
}

# Fixed values: (repositories, requests a day, requests a month, tokens a request) of each plan; -1: unlimited.
PLANS = {"free": (1, 100, 1000, 4000), "pro": (5, 1000, 10000, 16000), "team": (20, 5000, 50000, 32000), "enterprise": (-1, -1, -1, 100000)}

# Weights of edge types in weighted expansion, and its threshold.
EDGE_WEIGHTS = {"CALLS": 0.9, "IMPORTS": 0.6, "EXTENDS": 1.0}
WEIGHT_THRESHOLD = 0.1

# An impacted path that contains one of these raises the risk.
CRITICAL_PATHS = ["__init__.py", "main.py", "app.py", "api/", "core/", "config/"]

# Upper bounds of the complexity ranks; above the last is F. Hot spots start at 11.
COMPLEXITY_RANKS = [("A", 5), ("B", 10), ("C", 20), ("D", 30), ("E", 40)]
HOT_COMPLEXITY = 11

# Budget allocation.
RESERVED_TOKENS, USEFUL_SHARE, TRUNCATION_OVERHEAD = 500, 100, 50

# Directories that file scans skip.
SKIPPED_DIRS = ["__pycache__", ".venv", "venv", "env", "node_modules", ".git", ".tox", "dist", "build", ".pytest_cache", ".mypy_cache", ".coverage"]

# Code-fence language by file extension.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "cpp": "cpp", "c": "c", "cs": "csharp", "php": "php", "rb": "ruby", "go": "go", "rs": "rust", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "bash", "sql": "sql", "html": "html", "css": "css", "json": "json", "xml": "xml", "yaml": "yaml", "yml": "yaml", "md": "markdown"}

# Upper bounds of request-duration buckets, in seconds.
DURATION_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]

# Files whose nodes start a context if none are named, in this order.
ENTRY_FILES = ["main.py", "app.py", "__init__.py", "index.py"]
