"""Settings: a YAML file with a default for every value."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from ..functions import constants as K


@dataclass(frozen=True)
class Settings:
    """Values captured when a plan is built."""

    person_max: int = K.PERSON_MAX
    person_stopwords: tuple[str, ...] = K.PERSON_STOPWORDS
    org_max: int = K.ORG_MAX
    min_core: int = K.MIN_CORE
    clients: str | None = None
    persons: str | None = None
    extra_patterns: tuple[tuple[str, str], ...] = ()
    ner_engine: str = "ja_ginza"
    ner_score: float = 0.5
    llm_enabled: bool = False
    llm_endpoint: str = "http://localhost:11434"
    llm_model: str = "qwen2.5-coder:7b"
    llm_chunk: int = 700
    llm_timeout: float = 30.0
    llm_remote: bool = False
    encrypt: bool = False
    raw: dict = field(default_factory=dict, compare=False, repr=False)


def from_dict(data: object) -> Settings:
    """Settings of a parsed file; sections that aren't mappings, and a file that isn't one, count as empty."""
    from ..operators.detect import extra_patterns

    data = data if isinstance(data, dict) else {}
    part = lambda n: data[n] if isinstance(data.get(n), dict) else {}
    s, d, r, n, m, c = (part(k) for k in ("structural", "denylist", "regex", "ner", "llm", "security"))
    base = Settings()
    return Settings(
        person_max=int(s.get("person_max_len", base.person_max)),
        person_stopwords=tuple(s.get("person_stopwords", base.person_stopwords)),
        org_max=int(s.get("org_name_max_len", base.org_max)),
        min_core=int(d.get("min_core_len", base.min_core)),
        clients=d.get("clients_csv"),
        persons=d.get("persons_csv"),
        extra_patterns=tuple(extra_patterns(r.get("extra_patterns") or ())),
        ner_engine=n.get("engine", base.ner_engine),
        ner_score=float(n.get("score_threshold", base.ner_score)),
        llm_enabled=bool(m.get("enabled", base.llm_enabled)),
        llm_endpoint=str(m.get("endpoint", base.llm_endpoint)),
        llm_model=str(m.get("model", base.llm_model)),
        llm_chunk=int(m.get("chunk_chars", base.llm_chunk)),
        llm_timeout=float(m.get("timeout_sec", base.llm_timeout)),
        llm_remote=bool(m.get("allow_remote", base.llm_remote)),
        encrypt=bool(c.get("encrypt_by_default", base.encrypt)),
        raw=data,
    )


def load(path: str | None = None) -> Settings:
    """Settings of a file on the driver; one that isn't there gives the defaults. Nothing is written."""
    target = path or default_path()
    if not os.path.exists(target):
        return Settings()
    import yaml

    with open(target, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f))


def home() -> str:
    """The working folder, looked up when called."""
    return os.environ.get("SPARKVEIL_HOME") or os.getcwd()


def default_path() -> str:
    return os.path.join(home(), "config.yaml")


TEMPLATE = """\
# Settings; every line may be left out.
structural:
  person_max_len: 4
  org_name_max_len: 24
  person_stopwords: [皆, みな, お客, 客, 奥, 各位]
denylist:
  clients_csv: data/clients.csv
  persons_csv: data/persons.csv
  min_core_len: 3
regex:
  extra_patterns: []   # items: {pattern: "...", type: PHONE}
ner:
  engine: ja_ginza
  score_threshold: 0.5
llm:
  enabled: false
  endpoint: http://localhost:11434
  allow_remote: false
security:
  encrypt_by_default: false
"""


def ensure_file(path: str | None = None) -> bool:
    """Writes the template unless the file is there; whether it was written."""
    target = path or default_path()
    if os.path.exists(target):
        return False
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    with open(target, "x", encoding="utf-8") as f:
        f.write(TEMPLATE)
    return True
