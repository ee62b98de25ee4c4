"""Engine settings.  Every value that a corpus owner may change is a field."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values (formats, path categories in order of definition, routing words, tool names, limits).
SUPPORTED_FORMATS = (".md", ".txt", ".pdf", ".py", ".json")
CATEGORY_MAPPINGS = (
    ("security/redteam", "redteam"),
    ("security/blueteam", "blueteam"),
    ("security/ctf", "ctf"),
    ("security", "security"),
    ("logscale", "logscale"),
    ("development", "development"),
    ("general", "general"),
)
KEYWORD_ROUTES = (
    ("logscale", ("logscale", "lql", "cql", "humio", "crowdstrike query", "formattime", "groupby", "base64decode", "case{}", "regex")),
    ("redteam", ("pentest", "exploit", "payload", "reverse shell", "privilege escalation", "lateral movement", "c2", "beacon", "cobalt strike", "metasploit")),
    ("blueteam", ("detection", "sigma", "yara", "ioc", "threat hunting", "incident response", "forensics", "malware analysis")),
    ("ctf", ("ctf", "flag", "hackthebox", "htb", "tryhackme", "picoctf", "writeup", "challenge")),
    ("development", ("python", "typescript", "javascript", "api", "fastapi", "django", "react", "nodejs")),
    (
        "security",
        (
            "anti-bot", "antibot", "js challenge", "javascript challenge", "cdp detection", "runtime.enable", "puppeteer", "playwright",
            "selenium", "nodriver", "stealth", "undetected", "ja3", "ja4", "tls fingerprint", "fingerprinting", "curl_cffi", "got-scraping",
            "impersonate", "http/2 settings", "browser fingerprint", "canvas fingerprint", "webgl fingerprint", "navigator.webdriver",
            "audio context", "hardware concurrency", "waf bypass", "aws waf", "cloudflare bypass", "akamai bypass", "datadome", "perimeterx",
            "imperva bypass", "8kb bypass", "body size limit", "json sqli", "behavioral", "mouse movement", "ghost-cursor", "humanized",
            "flaresolverr", "turnstile", "rebrowser", "botbrowser",
        ),
    ),
)
TOOL_NAMES = (
    "nmap", "burp", "metasploit", "wireshark", "hydra", "john", "hashcat", "gobuster", "nikto", "sqlmap", "nuclei", "ffuf",
    "bloodhound", "mimikatz", "responder", "crackmapexec", "impacket",
)
DEFAULT_CATEGORY = "general"
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
DEFAULT_RESULTS, MAX_RESULTS = 5, 20
RRF_K, MISSING_RANK = 60, 1000
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
EMBEDDING_MODEL, EMBEDDING_DIM = "nomic-embed-text", 768


@dataclass(frozen=True)
class EngineConfig:
    """Settings of one engine.

    root: folder of the index tables.  documents: folder of the files to index.
    packed: folder of Parquet tables whose rows are these files (path below
    ``documents``, modificationTime, length, content), where they are too many
    and too small to list and open each.
    filter_scope: "semantic" filters the vector leg only, "both" the keyword leg too.
    vector_search: "exact" measures all vectors, "approximate" those of the
    ``probes`` lists nearest to the query; without a number, as many as were
    measured to find 0.95 of the ten nearest when the lists were made.
    """

    root: str = "index"
    documents: str = "documents"
    packed: str | None = None
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    supported_formats: tuple[str, ...] = SUPPORTED_FORMATS
    category_mappings: tuple[tuple[str, str], ...] = CATEGORY_MAPPINGS
    keyword_routes: tuple[tuple[str, tuple[str, ...]], ...] = KEYWORD_ROUTES
    tool_names: tuple[str, ...] = TOOL_NAMES
    default_results: int = DEFAULT_RESULTS
    max_results: int = MAX_RESULTS
    embedding_model: str = EMBEDDING_MODEL
    embedding_dim: int = EMBEDDING_DIM
    filter_scope: str = "semantic"
    vector_search: str = "exact"
    probes: int | None = None

    def __post_init__(self) -> None:
        # 0 stands for the default, as in an unset option
        object.__setattr__(self, "chunk_size", self.chunk_size or CHUNK_SIZE)
        object.__setattr__(self, "chunk_overlap", self.chunk_overlap or CHUNK_OVERLAP)
        if self.chunk_size < 1 or self.chunk_overlap < 0:
            raise ValueError("chunk_size must be positive and chunk_overlap not negative")
        if self.filter_scope not in ("semantic", "both"):
            raise ValueError("filter_scope is semantic or both")
        if self.vector_search not in ("exact", "approximate") or (self.probes is not None and self.probes < 1):
            raise ValueError("vector_search is exact or approximate, with a probe at least")

    @property
    def categories(self) -> list[str]:
        """What a search may be filtered by."""
        return [c for c, _ in self.keyword_routes] + [DEFAULT_CATEGORY]
