"""Word lists and constants that results depend on."""

# Words that carry no meaning for ranking.
STOP = ("a", "an", "the", "is", "in", "on", "at", "to", "for", "of", "and", "or", "but", "we", "our", "this", "that", "how", "what", "why",
        "where", "when", "are", "was", "be", "by", "as", "it", "its", "i", "use", "using", "used", "with", "from", "into", "than", "then",
        "do", "does", "did", "have", "has", "had", "can", "should", "would")
# Words that carry no meaning for duplicates and contradictions.
GUARD_STOP = ("a", "an", "the", "is", "in", "on", "at", "to", "for", "of", "and", "or", "but", "we", "our", "this", "that")
# Punctuation stripped from both ends of a word.
PUNCTUATION = ".,!?;:()[]\"'`<>"
# Related terms by stem.
RELATED = {
    "sqlite": ["database"], "postgresql": ["database"], "postgres": ["database"], "mysql": ["database"], "mariadb": ["database"], "mongodb": ["database"],
    "datastore": ["database"], "persistence": ["database"], "persistent": ["database"], "oltp": ["database"], "olap": ["database", "analytics"], "duckdb": ["database", "analytics"],
    "redis": ["cache", "key-value"], "ephemeral": ["cache"], "jaccard": ["duplicate"], "sequencematcher": ["duplicate"], "stdlib": ["dependency"], "pip": ["dependency", "package"],
    "fastapi": ["framework", "api"], "flask": ["framework", "api"], "django": ["framework", "api"], "starlette": ["framework", "api"], "hot": ["tier"], "warm": ["tier"], "cold": ["tier"],
    "monitor": ["track"], "telemetry": ["track", "observability"], "trace": ["track", "observability"], "exception": ["error"], "errors": ["error"], "sentry": ["error", "observability"],
    "loki": ["log", "observability"], "elasticsearch": ["log", "observability"], "prometheus": ["metric", "observability"], "mimir": ["metric", "observability"], "opentelemetry": ["track", "observability"],
    "jwt": ["auth", "token"], "oauth2": ["auth", "token"], "oauth": ["auth", "token"], "pkce": ["auth", "native"], "argon2id": ["hash", "password", "kdf"], "argon2": ["hash", "password", "kdf"],
    "bcrypt": ["hash", "password", "kdf"], "kdf": ["hash", "password"], "hashing": ["hash"], "credentials": ["auth", "token"], "httponly": ["cookie", "token"], "cookies": ["cookie"],
    "kafka": ["messaging", "events", "stream"], "rabbitmq": ["messaging"], "amqp": ["messaging"], "nats": ["messaging", "rpc"], "kubernetes": ["deploy", "orchestration"],
    "k8s": ["deploy", "orchestration", "kubernetes"], "helm": ["deploy", "kubernetes", "manifest"], "argocd": ["deploy", "gitops"], "gitops": ["deploy"], "serverless": ["deploy", "lambda"],
    "lambda": ["deploy", "serverless"], "manifest": ["config"], "react": ["frontend", "ui"], "tailwind": ["styling", "css", "frontend"], "styled": ["styling", "css"], "tanstack": ["frontend", "fetching"],
    "ssr": ["frontend", "render"], "airflow": ["orchestration", "workflow"], "dbt": ["transform", "etl"], "iceberg": ["lakehouse", "table"], "onnx": ["inference", "ml"], "hnsw": ["ann", "vector", "index"],
    "ann": ["vector", "index"], "approximate": ["ann", "vector"], "nearest": ["ann", "vector"], "neighbor": ["ann", "vector"], "embedding": ["vector", "ml"], "encoder": ["vector", "embedding", "ml"],
    "reranker": ["retrieval", "ml"], "ner": ["entity", "extraction", "ml"], "pytest": ["test"], "hypothesis": ["test", "fuzz"], "e2e": ["test", "browser"],
}
# Marks between the two sides of a choice.
MARKERS = (" vs ", " over ", " instead of ", " not ", " rather than ")
# Phrases that say a choice was replaced.
REPLACED = ("instead of", "rather than", " over ", " not ", " vs ", "replace", "replaced", "migrate", "migrated", "moved to", "switch", "switched", "drop", "dropped",
            "deprecate", "deprecated", "abandon", "abandoned", "no longer")
# Phrases that say a decision was taken.
CUES = ("chose", "chosen", "over", "switched to", "switch to", "instead of", "rather than", "because", "replaced", "replace", "migrated to", "migrate to",
        "decided to", "decided", "opted for", "opted", "in favor of", "moved to", "adopted", "settled on", "going with", "went with")
# Commit types that may hold a decision.
TYPES = ("feat", "fix", "refactor", "perf")
# The forms of commit subjects that the format prescribes: type(scope)!: subject, merges, versions.
CONVENTIONAL = r"^([a-z]+)(?:\([^)]*\))?!?:\s*(.+)$"
MERGE = r"(?i)^(merge\b|revert\b)"
VERSION = r"(?i)^(?:\s*(?:bump|release|version|v?\d+\.\d+)\b.*$|\bv?\d+\.\d+\.\d+\b)"
# Budgets, weights and limits.
HOT_BUDGET, WARM_BUDGET, CHARS = 500, 2500, 4
WHAT_WEIGHT, RECENCY_WEIGHT, CONFIDENCE_WEIGHT = 0.25, 0.05, 0.05
HALF_LIFE, FLOOR, STEP = 90.0, 0.25, 0.25
SIMILAR, LEAST_WORDS = 0.45, 5
POLICY_SAMPLE, POLICY_RATE = 5, 0.10
RRF_K, HEAD, MARGIN = 60, 10, 0.15
OPPOSED, MACHINE_CONFIDENCE = 0.80, 0.6
#: Parts of made-up records, to see how ranking holds among many that are beside the point; combined, they give over a million.
TOOLS = ("Terraform", "Ansible", "Kafka", "RabbitMQ", "Nginx", "Envoy", "Grafana", "Jenkins", "Gradle", "Bazel", "Pulumi", "Vault", "Consul", "Istio", "Airflow", "Redis", "Postgres", "Spark", "Flink", "Trino")
ROLES = ("gateway", "scheduler", "registry", "mirror", "collector", "proxy", "builder", "planner", "watcher", "archive", "relay", "broker", "indexer", "balancer")
AIMS = ("builds", "releases", "alerts", "backups", "billing", "search", "routing", "image storage", "load tests", "nightly jobs", "secrets", "dashboards", "invoices", "mail", "exports", "reports", "uploads", "sessions")
MANNERS = ("in every region", "on spare nodes", "behind a flag", "with two replicas", "by the hour", "on demand", "in staging first", "without downtime", "per tenant", "at the edge", "for a trial", "in one cluster", "on bare metal", "with quotas")
REASONS = ("costs less", "starts faster", "needs fewer hands", "scales further", "breaks less often", "is known to the team", "keeps history", "is easy to audit", "has good tests", "fits the budget", "leaves room to grow", "is simple to move")
