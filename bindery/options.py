"""Typed options of one run."""

from __future__ import annotations

from dataclasses import dataclass, field

# Defaults and constants that results depend on.
DEFAULT_EXTENSIONS = ".txt, .py, .md, .json, .xml, .csv"
ARCHIVE_NAMES = ("archive", "archived", "archives")
SENSITIVE_PATTERNS = (
    ".env", ".env.local", ".env.production", ".env.development",
    "secrets.yaml", "secrets.yml", "secrets.json",
    "credentials.json", "credentials.yaml",
    "id_rsa", "id_dsa", "id_ed25519",
    "*.pem", "*.key", "*.p12", "*.pfx",
    "*.db", "*.sqlite", "*.sqlite3",
    "api_keys.txt", "tokens.txt",
    ".npmrc", ".pypirc",
    ".bash_history", ".zsh_history", ".python_history",
    ".aws/credentials", ".aws/config",
)
PRICES_PER_MILLION = {
    "gpt-4o": 2.50,
    "gpt-4o-mini": 0.15,
    "claude-3.5-sonnet": 3.00,
    "claude-3-opus": 15.00,
}
DEFAULT_PRICE = 2.50
SOFT_LIMIT = 32000
HARD_LIMIT = 128000
PROMPT_TEMPLATES = {
    "Code Review": (
        "You are a senior software engineer. Review this code for:\n"
        "- Code quality and best practices\n- Potential bugs\n"
        "- Performance issues\n- Security vulnerabilities"
    ),
    "Documentation": (
        "You are a technical writer. Generate comprehensive documentation for this codebase including:\n"
        "- Overview\n- Architecture\n- API documentation\n- Usage examples"
    ),
    "Refactoring": (
        "You are an expert in code refactoring. Analyze this code and suggest improvements for:\n"
        "- Code structure\n- Design patterns\n- Maintainability\n- Testability"
    ),
}


def parse_extensions(listed: str) -> list[str]:
    """``".txt, py"`` to ``[".txt", ".py"]``; lower-cased, empties dropped."""
    names = [part.strip().lower() for part in listed.split(",")]
    return list(dict.fromkeys(n if n.startswith(".") else "." + n for n in names if n))


@dataclass(frozen=True)
class Source:
    """One folder to read and the bundle it becomes.

    ``bundle`` names the output; paths inside it start with the folder's own name.
    A run takes its sources in the order they are listed.
    """

    root: str
    bundle: str
    exclude_subfolders: bool = False
    include_archive: bool = False

    @property
    def top(self) -> str:
        return self.root.rstrip("/").rsplit("/", 1)[-1] or self.bundle


@dataclass(frozen=True)
class Options:
    """What a run keeps, changes and prints. ``None`` or 0 means no bound."""

    extensions: str = DEFAULT_EXTENSIONS
    include_archive: bool = False
    respect_ignore: bool = True
    detect_binary: bool = True
    safe_mode: bool = True
    min_size_kb: float | None = None
    max_size_kb: float | None = None
    modified_after: str | None = None
    outline: bool = False
    redact: bool = True
    names: tuple[str, ...] = ()
    minify: bool = False
    output_format: str = "standard"
    show_tree: bool = True
    prompt: str = ""
    generated_by: str = "Bindery"
    as_of: str = "1970-01-01 00:00:00"
    model: str = "gpt-4o"
    soft_limit: int = SOFT_LIMIT
    hard_limit: int = HARD_LIMIT
    sensitive_patterns: tuple[str, ...] = field(default=SENSITIVE_PATTERNS)
