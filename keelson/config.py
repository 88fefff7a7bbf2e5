"""Rules and policies as plain objects, validated on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Risk names in ascending order.
RISKS = ["none", "low", "medium", "high", "critical"]

# Filesystem types that are skipped unless the policy says otherwise; the same
# types count as costly to scan when a policy does include them.
VIRTUAL_FILESYSTEMS = [
    "autofs",
    "bpf",
    "cgroup",
    "cgroup2",
    "configfs",
    "debugfs",
    "devpts",
    "devtmpfs",
    "efivarfs",
    "fuse.gvfsd-fuse",
    "fuse.portal",
    "mqueue",
    "proc",
    "pstore",
    "securityfs",
    "squashfs",
    "sysfs",
    "tracefs",
]

DEFAULT_TOP = 1000


class ConfigError(ValueError):
    """A rule set or a policy that cannot be used."""


def is_root(path: str) -> bool:
    return path == "/" or path == "" or path[1:3] in (":/", ":\\")


@dataclass(frozen=True)
class Policy:
    """What is scanned, and how."""

    scan_paths: tuple = ("/",)
    db_path: str | None = None
    exclusions: tuple = ()
    excluded_filesystems: tuple = tuple(VIRTUAL_FILESYSTEMS)
    metadata_rules: tuple = ()
    scan_byte_limit: int = 0
    config_hash: str | None = None

    def __post_init__(self):
        if self.scan_byte_limit < 0:
            raise ConfigError("scan_byte_limit must not be negative")
        for name in ("scan_paths", "exclusions", "metadata_rules"):
            if any(not isinstance(p, str) or not p.strip() for p in getattr(self, name)):
                raise ConfigError(f"{name} must hold non-empty paths")

    @property
    def excluded_roots(self) -> list[str]:
        return [*([self.db_path] if self.db_path else []), *self.exclusions]

    @property
    def metadata_directories(self) -> list[str]:
        """Rules naming one directory: a trailing slash, or a filesystem root."""
        return [p for kind, p in map(_metadata_rule, self.metadata_rules) if kind == "directory"]

    @property
    def metadata_roots(self) -> list[str]:
        """Rules naming a subtree: ``/p`` or ``/p/*``."""
        return [p for kind, p in map(_metadata_rule, self.metadata_rules) if kind == "subtree"]


def _metadata_rule(rule: str):
    rule = rule.strip()
    if is_root(rule):
        return "directory", rule
    for suffix, kind in (("/*", "subtree"), ("\\*", "subtree"), ("/", "directory"),
                         ("\\", "directory")):
        if rule.endswith(suffix) and len(rule) > len(suffix):
            return kind, rule[: -len(suffix)]
    return "subtree", rule


@dataclass(frozen=True)
class Selector:
    """One test of a rule. ``proceed=False`` ends the rule for a line that matched."""

    kind: str
    description: str = ""
    match: tuple = ()
    exclude: tuple = ()
    risk: str = "critical"
    proceed: bool = True
    insensitive: bool = False

    def __post_init__(self):
        if self.risk not in RISKS:
            raise ConfigError(f"invalid risk {self.risk}")

    @property
    def risk_level(self) -> int:
        return RISKS.index(self.risk)


@dataclass(frozen=True)
class LogRule:
    name: str
    selectors: tuple = ()
    description: str = ""
    group_by: str | None = None

    def __post_init__(self):
        if not self.name:
            raise ConfigError("a rule needs a name")


@dataclass(frozen=True)
class LogSource:
    name: str
    rules: tuple = ()
    kind: str = "file"
    description: str = "not supplied"
    top: int = DEFAULT_TOP
    path: str | None = None
    container: str | None = None
    since: str | None = None
    unit: str | None = None
    trim_prefix: str | None = None
    reset: str | None = None
    group_by: str | None = None
    report_to: str | None = None

    def label(self, override: str | None = None) -> str:
        """What is read, as reports show it: a path, or the journal command with its filters."""
        if override is not None:
            return override
        if self.kind != "journal":
            return self.path or ""
        given = (("-u", self.unit), ("--since", self.since), ("CONTAINER_NAME=", self.container))
        args = " ".join(f"{k}{'' if k.endswith('=') else ' '}{v}" for k, v in given if v is not None)
        return f"journalctl {args}"

    def __post_init__(self):
        if self.kind not in ("file", "journal", "table"):
            raise ConfigError(f"invalid log source type {self.kind}")
        if " " in self.name:
            raise ConfigError(f"log source name '{self.name}' may not contain blanks")
        if self.kind == "file" and not self.path:
            raise ConfigError(f"log source {self.name} has no path")


@dataclass(frozen=True)
class LogAudit:
    """A rule set with the log sources that use it."""

    rules: tuple = ()
    sources: tuple = ()
    by_name: dict = field(init=False, repr=False, compare=False, default_factory=dict)

    def __post_init__(self):
        for rule in self.rules:
            self.by_name.setdefault(rule.name, rule)
        seen = set()
        for source in self.sources:
            if source.name in seen:
                raise ConfigError(f"duplicate log source name '{source.name}'")
            seen.add(source.name)
            self.rules_of(source)

    def rules_of(self, source: LogSource) -> list[LogRule]:
        """The rules of a source in its own order; a rule listed twice counts twice."""
        missing = [name for name in source.rules if name not in self.by_name]
        if missing:
            raise ConfigError(f"log source {source.name} uses unknown rule {missing[0]}")
        return [self.by_name[name] for name in source.rules]

    def group_pattern(self, source: LogSource) -> str | None:
        """The source's own grouping, else that of its first rule having one."""
        if source.group_by is not None:
            return source.group_by
        return next((r.group_by for r in self.rules_of(source) if r.group_by is not None), None)

    def source(self, name: str) -> LogSource:
        for candidate in self.sources:
            if candidate.name == name:
                return candidate
        raise ConfigError(f"there is no log source named {name}")

    def choose(self, name: str | None = None, path: str | None = None) -> LogSource:
        """Pick the source to scan from a source name, a rule name and/or a path.

        A source name with a path reads that path with the source's rules. A rule name needs a
        path and reads it with that rule alone. A path alone needs exactly one file source.
        """
        if name is not None and any(s.name == name for s in self.sources):
            chosen = self.source(name)
            return replace(chosen, path=path, kind="file") if path else chosen
        if name is not None and name in self.by_name:
            if not path:
                raise ConfigError(f"rule {name} needs a path")
            return LogSource(name="Virtual", description="Virtual", rules=(name,), path=path)
        if name is not None:
            raise ConfigError(f"there is no log source or rule named {name}")
        if not path:
            raise ConfigError("name a log source, a rule or a path")
        files = [s for s in self.sources if s.kind == "file"]
        if len(files) != 1:
            raise ConfigError("the path is ambiguous: name the log source or the rule")
        return replace(files[0], path=path)


@dataclass(frozen=True)
class AlertPolicy:
    """Who is told about a result."""

    send_on_fail: bool = False
    send_on_success: bool = False
    from_address: str = ""
    fail_to: str = ""
    success_to: str = ""
