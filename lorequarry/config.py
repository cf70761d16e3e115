"""Configuration: frozen dataclasses, read from TOML."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path

from .errors import KnowledgeError


@dataclass(frozen=True)
class Storage:
    mode: str = "embedded"
    path: str = "./data"
    namespace: str = "lorequarry"
    database: str = "knowledge"


@dataclass(frozen=True)
class Embedding:
    model: str = "hashing"
    onnx_path: str = "auto"
    tokenizer: str = "auto"
    dimension: int = 0
    max_input_tokens: int = 0
    device: str = "cpu"
    batch_size: int = 32


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 512
    overlap_tokens: int = 64


@dataclass(frozen=True)
class Search:
    default_mode: str = "hybrid"
    top_k: int = 10
    rrf_k: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75


@dataclass(frozen=True)
class Upload:
    max_file_mb: int = 100
    allowed_dirs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Graph:
    #: Wiki links, front matter and the order of headings make entities and edges too.
    extended: bool = False


@dataclass(frozen=True)
class Config:
    storage: Storage = field(default_factory=Storage)
    embedding: Embedding = field(default_factory=Embedding)
    chunking: Chunking = field(default_factory=Chunking)
    search: Search = field(default_factory=Search)
    upload: Upload = field(default_factory=Upload)
    graph: Graph = field(default_factory=Graph)

    def __post_init__(self):
        check_windows(self.chunking.max_tokens, self.chunking.overlap_tokens)
        if self.storage.mode != "embedded":
            raise KnowledgeError("E_CONFIG", f"storage.mode {self.storage.mode!r} isn't supported")

    def to_dict(self) -> dict:
        return asdict(self)


def check_windows(max_tokens: int, overlap_tokens: int) -> None:
    """Windows must move on: 0 <= overlap < max_tokens."""
    if max_tokens < 1 or not 0 <= overlap_tokens < max_tokens:
        raise KnowledgeError("E_VALIDATION", f"overlap_tokens {overlap_tokens} must be at least 0 and below max_tokens {max_tokens}")


def _built(base, given: Mapping):
    """base with the values of given; keys that it doesn't have are ignored, as are those of later versions."""
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    changes = {}
    for key, value in given.items():
        if key not in known:
            continue
        old = known[key]
        if is_dataclass(old):
            if not isinstance(value, Mapping):
                raise KnowledgeError("E_CONFIG", f"{key} must be a table")
            changes[key] = _built(old, value)
        elif isinstance(old, tuple):
            changes[key] = tuple(value)
        elif isinstance(old, float) and isinstance(value, int) and not isinstance(value, bool):
            changes[key] = float(value)
        elif type(value) is not type(old):
            raise KnowledgeError("E_CONFIG", f"{key} must be a {type(old).__name__}")
        else:
            changes[key] = value
    return replace(base, **changes)


def from_toml(text: str) -> Config:
    try:
        return _built(Config(), tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise KnowledgeError("E_CONFIG", str(e)) from e


def default_paths() -> list[Path]:
    return [Path("lorequarry.toml"), Path.home() / ".config" / "lorequarry" / "config.toml"]


def load(path: str | Path | None = None, env: Mapping[str, str] | None = None) -> Config:
    """The given file, else the first of default_paths() that exists, else the defaults; then variables LOREQUARRY_SECTION__KEY."""
    found = Path(path) if path else next((p for p in default_paths() if p.exists()), None)
    if path and not found.exists():
        raise KnowledgeError("E_CONFIG", f"no such file: {path}")
    config = from_toml(found.read_text()) if found else Config()
    for name, value in sorted((os.environ if env is None else env).items()):
        m = re.fullmatch(r"LOREQUARRY_([A-Z]+)__([A-Z0-9_]+)", name)
        if m:
            config = _built(config, {m[1].lower(): {m[2].lower(): parse_scalar(value)}})
    return config


def parse_scalar(text: str) -> bool | int | float | str:
    """A bool, else an int, else a float, else the text."""
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _literal(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return '"' + str(value).replace("\\", "\\\\").replace('"', '\\"') + '"'


def set_key(text: str, dotted: str, value: str) -> str:
    """TOML text with one dotted key set, everything else as it was: in its section, an inline table, or a new section."""
    section, _, key = dotted.partition(".")
    if not section or not key or "." in key:
        raise KnowledgeError("E_CONFIG", f"expected section.key, got {dotted!r}")
    new, lines = _literal(parse_scalar(value)), text.splitlines()
    entry = re.compile(rf"(\s*{re.escape(key)}\s*=\s*)([^#]*?)(\s*(?:#.*)?)$")
    for i, line in enumerate(lines):
        if m := re.match(rf"(\s*{re.escape(section)}\s*=\s*\{{)(.*)(\}}.*)$", line):
            inner, n = re.subn(rf"(\b{re.escape(key)}\s*=\s*)(\"[^\"]*\"|[^,\s]+)", lambda x: x[1] + new, m[2])
            if not n:
                inner = f"{m[2].rstrip()}{', ' if m[2].strip() else ' '}{key} = {new} "
            lines[i] = m[1] + inner + m[3]
            break
        if re.match(rf"\s*\[{re.escape(section)}\]", line):
            end = next((j for j in range(i + 1, len(lines)) if re.match(r"\s*\[", lines[j])), len(lines))
            for j in range(i + 1, end):
                if m := entry.match(lines[j]):
                    lines[j] = m[1] + new + m[3]
                    break
            else:
                lines.insert(i + 1, f"{key} = {new}")
            break
    else:
        lines += [*([""] if lines else []), f"[{section}]", f"{key} = {new}"]
    out = "\n".join(lines) + "\n"
    from_toml(out)
    return out


def parse_filters(pairs: list[str]) -> dict[str, str]:
    """KEY=VALUE pairs, repeated or separated by commas."""
    out = {}
    for pair in (x for p in pairs for x in p.split(",")):
        key, sign, value = pair.partition("=")
        if not sign or not key.strip():
            raise KnowledgeError("E_VALIDATION", f"expected KEY=VALUE, got {pair!r}")
        out[key.strip()] = value
    return out
