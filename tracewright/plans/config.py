"""Configuration: corpora by name, thresholds, and the transcripts found where their tool writes them."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from .thresholds import with_thresholds

FILE = "tracewright.json"
ARTEFACTS = Path(__file__).resolve().parent.parent / "artefacts"


class ConfigError(ValueError):
    """A configuration that cannot be used."""


@dataclass
class CorpusConfig:
    adapter: str
    source: str
    alphabet: str
    domain: str | None = None
    segmenter: str | None = None


@dataclass
class Config:
    root: Path
    corpora: dict[str, CorpusConfig] = field(default_factory=dict)
    thresholds: dict = field(default_factory=with_thresholds)
    segmenter: str = "null"
    seed: int = 1
    workspace: Path | None = None

    def corpus(self, name: str) -> CorpusConfig:
        if name not in self.corpora:
            raise ConfigError(f"no corpus {name!r}; there are {', '.join(sorted(self.corpora)) or 'none'}")
        return self.corpora[name]


def shipped(name: str) -> Path | None:
    """An artefact that comes with the package."""
    at = ARTEFACTS / name
    return at if at.exists() else None


def contracts_for(domain: str) -> Path | None:
    """The clause set of a domain; a colon in its name is a dash in the file's."""
    return shipped(f"contracts.{domain.replace(':', '-')}.yaml")


def load(folder: str = ".", file: str = FILE) -> Config:
    """The configuration in a folder; paths in it are relative to it. An alphabet without a separator is a shipped one. Without a file, the defaults."""
    at = (Path(folder) / file).resolve()
    raw = json.loads(at.read_text()) if at.exists() else {}
    root = at.parent

    def path(spec: str) -> str:
        return spec if "://" in spec else str((root / spec).resolve())

    corpora = {}
    for name, c in (raw.get("corpora") or {}).items():
        if not isinstance(c.get("adapter"), str) or not isinstance(c.get("source"), str):
            raise ConfigError(f"corpora.{name} needs an adapter and a source")
        alphabet = c.get("alphabet") or f"alphabet.{name}.yaml"
        own = None if "/" in alphabet or "\\" in alphabet else shipped(alphabet)
        corpora[name] = CorpusConfig(c["adapter"], path(c["source"]), str(own or path(alphabet)), c.get("domain"), c.get("segmenter"))
    return Config(root, corpora, with_thresholds(raw.get("thresholds")), raw.get("segmenter", "null"), raw.get("seed", 1), (root / raw.get("workspace", ".tracewright")).resolve())


def local_corpus(home: str | None = None) -> tuple[CorpusConfig, int, int] | None:
    """The transcripts under the home folder, with their numbers of projects and sessions; nothing if there are none."""
    root = Path(home or Path.home()) / ".claude" / "projects"
    found = [n for d in sorted(root.iterdir()) if d.is_dir() and (n := len(list(d.glob("*.jsonl"))))] if root.is_dir() else []
    if not found:
        return None
    return CorpusConfig("cc", str(root), str(ARTEFACTS / "alphabet.cc.yaml"), "transcripts", "intent"), len(found), sum(found)


def revision(source: str) -> str:
    """Sixteen hex digits of a source's bytes: of a file, or of all files of a folder in order, with their relative names."""
    digest, root = hashlib.sha256(), Path(source)

    def add(at: Path, name: str) -> None:
        if at.is_dir():
            for child in sorted(os.listdir(at)):
                add(at / child, f"{name}/{child}" if name else child)
            return
        digest.update(name.encode())
        with at.open("rb") as f:
            while part := f.read(1 << 20):
                digest.update(part)

    add(root, "")
    return digest.hexdigest()[:16]


def commit() -> str | None:
    """The commit of the code at hand, if there is one."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def run_id(command: str, at_ms: int) -> str:
    """A name for a run: its command, its time to the second, and six hex digits."""
    when = datetime.fromtimestamp(at_ms / 1000, timezone.utc).strftime("%Y%m%dT%H%M%S")
    return f"{command}-{when}-{hashlib.sha1(f'{command}{at_ms}{os.getpid()}'.encode()).hexdigest()[:6]}"
