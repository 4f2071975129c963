"""Fixed value tables, ranks and row schemas shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language name and id by file extension.
LANGUAGE_OF = {
    "py": ("Python", "python"),
    "pyw": ("Python", "python"),
    "pyi": ("Python", "python"),
    "js": ("JavaScript", "javascript"),
    "jsx": ("JavaScript", "javascript"),
    "mjs": ("JavaScript", "javascript"),
    "ts": ("TypeScript", "typescript"),
    "tsx": ("TypeScript", "typescript"),
    "java": ("Java", "java"),
    "c": ("C", "c"),
    "h": ("C", "c"),
    "cpp": ("C++", "cpp"),
    "cc": ("C++", "cpp"),
    "cxx": ("C++", "cpp"),
    "hpp": ("C++", "cpp"),
    "cs": ("C#", "csharp"),
    "go": ("Go", "go"),
    "rs": ("Rust", "rust"),
    "rb": ("Ruby", "ruby"),
    "php": ("PHP", "php"),
    "swift": ("Swift", "swift"),
    "kt": ("Kotlin", "kotlin"),
    "kts": ("Kotlin", "kotlin"),
    "scala": ("Scala", "scala"),
    "sh": ("Shell", "bash"),
    "bash": ("Shell", "bash"),
    "zsh": ("Shell", "bash"),
    "sql": ("SQL", "sql"),
    "md": ("Markdown", "markdown"),
    "txt": ("Text", "text"),
    "yml": ("YAML", "yaml"),
    "yaml": ("YAML", "yaml"),
    "toml": ("TOML", "toml"),
    "json": ("JSON", "json"),
    "tf": ("Terraform", "hcl"),
    "hcl": ("HCL", "hcl"),
}
DEFAULT_LANGUAGE = ("Code", "text")
PYTHON_EXTENSIONS = ("py", "pyw", "pyi")

# Directories that a source scan leaves out.
SKIP_DIRS = (
    ".git", ".hg", ".svn", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "__pycache__", "node_modules",
    "venv", ".venv", "env", ".env", "site-packages", "dist", "build", "eggs", ".eggs",
)

# Ordinals; the default of each producer is given beside it.
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1, "": 0}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1, "": 0}
SECRET_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
SEVERITIES = ("critical", "high", "medium", "low", "info")
EMOJI = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵", "info": "⚪"}
MODEL_DEFAULTS = ("medium", "high")
SCANNER_DEFAULTS = ("low", "low")

#: The canonical finding; order of fields is the order of output.
FINDING_DDL = (
    "title string, description string, category string, reported_severity string, reported_confidence string, severity string, confidence string, "
    "file string, line_number int, end_line int, affected_code string, reasoning string, suggested_remediation string, source_tools array<string>, "
    "primary_tool string, cwe_id string, test_id string, more_info string, fingerprint string, merge_notes array<string>, duplicate_count int"
)

CHANGE_DDL = (
    "file_path string, change_type string, is_python boolean, function_name string, class_name string, old_start int, old_lines int, "
    "new_start int, new_lines int, diff_content string, added_lines array<string>, removed_lines array<string>"
)


@dataclass(frozen=True)
class Config:
    """Typed settings; ``from_env`` reads REVIEW_<NAME> variables and validates them."""

    max_file_bytes: int = 524_288
    chunk_chars: int = 4000
    prompt_tokens: int = 4000
    context_tokens: int = 2500
    related_per_function: int = 3
    related_total: int = 8
    min_relevance: float = 0.35
    max_revisions: int = 2
    line_block: int = 60
    api_key: str = field(default="", repr=False)
    model: str = "stub"

    def __post_init__(self) -> None:
        for name in ("max_file_bytes", "chunk_chars", "prompt_tokens", "context_tokens", "related_per_function", "related_total", "line_block"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not 0 <= self.min_relevance <= 1:
            raise ValueError("min_relevance must be between 0 and 1")

    @classmethod
    def from_env(cls, env: dict[str, str]) -> Config:
        kinds = {k: type(v.default) for k, v in cls.__dataclass_fields__.items()}
        return cls(**{k: kind(env[f"REVIEW_{k.upper()}"]) for k, kind in kinds.items() if f"REVIEW_{k.upper()}" in env})

    def shown(self) -> list[tuple[str, str]]:
        """Settings by variable, as they may be shown: of a key only whether it is set."""
        mask = lambda name, v: ("*" * 8 if v else "(not set)") if name.endswith("key") else str(v)
        return [(f"REVIEW_{name.upper()}", mask(name, getattr(self, name))) for name in self.__dataclass_fields__]

    @property
    def ready(self) -> bool:
        return self.model == "stub" or bool(self.api_key)


def lookup(table: dict[str, object], key: Column, default: object) -> Column:
    """A literal map look-up with a default, also for null keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(key, F.lit("\0"))), F.lit(default))


def severity_rank(c: Column) -> Column:
    return lookup(SEVERITY_RANK, c, 0)


def confidence_rank(c: Column) -> Column:
    return lookup(CONFIDENCE_RANK, c, 0)
