"""Free text: redaction by rules that must not overlap, and shell commands in parts."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.batches import bounded_batches
from ..plans.alphabet import ArtefactError

# Patterns of text profiles.
PATTERNS = {
    "email": S.EMAIL,
    "phone": S.PHONE,
    "url": r"\bhttps?://[^\s<>\"')\]]+",
    "path": r"(?:[A-Za-z]:|~|\.\.?)[\\/]+(?:[\w.-]+[\\/]+)*[\w.-]+|(?<![\w.-])[\\/]+(?:[\w.-]+[\\/]+)+[\w.-]+|(?:[\w.-]+[\\/]+){2,}[\w.-]+|[\w-]+[\\/]+[\w-]+\.[A-Za-z0-9]{1,8}\b",
}
SURROGATE = re.compile(r"[\w.-]+#[0-9a-f]{12}|h#[0-9a-f]{24}", re.ASCII)


@dataclass
class Rule:
    pattern: str
    strategy: str
    name: str
    regex: re.Pattern


def parse_profile(source: str | dict) -> tuple[str, int, list[Rule]]:
    raw = yaml.safe_load(source) if isinstance(source, str) else source
    if not raw.get("rules"):
        raise ArtefactError("rules: must not be empty")
    out = []
    for i, r in enumerate(raw["rules"]):
        at = f"rules[{i}]"
        if r.get("pattern") not in (*PATTERNS, "digits", "literal"):
            raise ArtefactError(f"{at}: unknown pattern")
        if r.get("strategy") not in ("token", "hash", "drop"):
            raise ArtefactError(f"{at}: unknown strategy")
        if r["pattern"] == "literal" and not r.get("match"):
            raise ArtefactError(f"{at}: a literal needs a match")
        if r.get("minDigits", 6) < 2:
            raise ArtefactError(f"{at}: minDigits must be 2 or more")
        expression = r["match"] if r["pattern"] == "literal" else rf"\d{{{r.get('minDigits', 6)},}}" if r["pattern"] == "digits" else PATTERNS[r["pattern"]]
        out.append(Rule(r["pattern"], r["strategy"], r.get("as") or r["pattern"], re.compile(expression, re.ASCII)))
    return raw["corpus"], raw["version"], out


def redact_one(text: str, corpus: str, rules: list[Rule]) -> tuple[str, dict[str, int]]:
    """The redacted text, and how often each rule fired. Whatever has the form of a surrogate is left alone."""
    fired: dict[str, int] = {}
    for r in rules:
        closed = [m.span() for m in SURROGATE.finditer(text)]
        next_closed, n = 0, 0

        def put(m: re.Match) -> str:
            nonlocal next_closed, n
            # matches and closed spans both come in order
            while next_closed < len(closed) and closed[next_closed][1] <= m.start():
                next_closed += 1
            if m.end() == m.start() or (next_closed < len(closed) and closed[next_closed][0] < m.end()):
                return m.group()
            n += 1
            return _surrogate(r, corpus, m.group())

        text = r.regex.sub(put, text)
        fired[r.name] = fired.get(r.name, 0) + n
    return text, fired


def _surrogate(r: Rule, corpus: str, found: str) -> str:
    if r.strategy == "drop":
        return f"<{r.name}>"
    if r.strategy == "hash":
        return "h#" + hashlib.sha256(found.encode()).hexdigest()[:24]
    return f"{r.name}#" + hashlib.sha256(f"{corpus}\0{r.name}\0{found}".encode()).hexdigest()[:12]


def redact_text(text: Column, profile: str) -> Column:
    """(after, fired) of a text column: a span of one rule's surrogate is closed to later rules, which no built-in expresses."""
    corpus, _, rules = parse_profile(profile)
    bounded_batches(SparkSession.active())

    @F.pandas_udf("after string, fired map<string,int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else redact_one(t, corpus, rules) for t in texts]
        return pd.DataFrame(rows, columns=["after", "fired"])

    return run(text)


def preview(rows: DataFrame, text: str, profile: str) -> DataFrame:
    """``rows`` with what a profile would make of a text: before, after, and how often each rule fired."""
    return rows.withColumn("_r", redact_text(F.col(text), profile)).select("*", F.col(text).alias("before"), "_r.after", "_r.fired").drop("_r")


def profile_id(profile: str) -> str:
    """What an annotation says about the profile its text left under."""
    corpus, version, _ = parse_profile(profile)
    return f"text.{corpus}@{version}"


def joined_text(rows: DataFrame, keys: list[str], seq: str, text: str) -> DataFrame:
    """Texts that are not blank, in order, joined by newlines; null if there is none."""
    kept = F.array_sort(F.collect_list(F.when(F.trim(F.col(text)) != "", F.struct(F.col(seq).alias("seq"), F.col(text).alias("text")))))
    return rows.groupBy(*keys).agg(F.nullif(F.array_join(F.transform(kept, lambda x: x["text"]), "\n"), F.lit("")).alias("text"))


# Words of the shell, flags that take a value, and the mark of a heredoc.
PREFIXES = frozenset("sudo time nohup exec command env nice xargs".split())
KEYWORDS = frozenset("for do done if then else elif fi while until case esac in function select return break continue".split())
MULTIPLEXERS = frozenset("git npm npx pnpm yarn bun gh aws gcloud az docker kubectl cargo go python python3 node dotnet terraform systemctl apt brew".split())
VALUE_FLAGS = frozenset("-C -c --git-dir --work-tree --exec-path --config --prefix --cwd -w --workspace".split())
_HEREDOC = re.compile(r"(?<!<)<<-?\s*(['\"]?)([A-Za-z_][A-Za-z0-9_]*)\1(?!<)")


def without_heredocs(command: str) -> str:
    out, tags = [], []
    for line in command.split("\n"):
        if tags:
            if line.strip() == tags[0]:
                tags.pop(0)
            continue
        out.append(line)
        tags = [m[2] for m in _HEREDOC.finditer(line)]
    return "\n".join(out)


#: A quoted run, an escaped character, a separator, or what is none of them.
_TOKEN = re.compile(r"""(?P<quoted>'[^']*(?:'|$)|"(?:\\.|[^"\\])*(?:"|\\?$)|`(?:\\.|[^`\\])*(?:`|\\?$))|\\.|(?P<cut>&&|\|\||[;\n])|[^'"`\\;&|\n]+|.""", re.DOTALL)


def segments(command: str) -> list[str]:
    """Parts between && || ; and newlines outside quotes."""
    out = [""]
    for m in _TOKEN.finditer(without_heredocs(command)):
        if m["cut"]:
            out.append("")
        else:
            out[-1] += m.group()
    return [s.strip() for s in out if s.strip()]


def _command(segment: str) -> list[str]:
    """The words of a segment from its command on: assignments and prefixes are left out, a substitution's command counts."""
    words = segment.split()
    while words and re.match(r"[A-Za-z_]\w*=", words[0], re.ASCII):
        if m := re.match(r"\w+=(?:\$\(|`)(.+)", words[0], re.ASCII):
            words[0] = m[1]
            break
        words.pop(0)
    while words and words[0] in PREFIXES:
        words.pop(0)
    if not words or words[0].startswith("#"):
        return []
    name = words[0].lstrip("('\"`").rstrip("/").rpartition("/")[2]
    return [name, *words[1:]] if re.fullmatch(r"[A-Za-z_][\w.+-]*", name, re.ASCII) else []


def is_syntax(segment: str) -> bool:
    return _command(segment)[:1] != [] and _command(segment)[0] in KEYWORDS


def verb_of(segment: str) -> tuple[str | None, str | None]:
    """The command of a segment and, for tools of many commands, its first word that is no flag, no flag's value and no path."""
    verb, *words = _command(segment) or [None]
    if verb is None or verb in KEYWORDS:
        return None, None
    if verb in MULTIPLEXERS:
        skip = False
        for w in words:
            if skip or w.startswith("-"):
                skip = not skip and w in VALUE_FLAGS
            elif not re.search(r"[/\\]", w):
                return verb, w if re.fullmatch(r"[A-Za-z_][\w:.-]*", w, re.ASCII) else None
    return verb, None


_PARTS = pa.list_(pa.struct([(name, pa.string()) for name in ("segment", "verb", "sub")]))


def shell_parts(command: Column) -> Column:
    """array<struct<segment, verb, sub>> of a command, without syntax words; one part without a verb if there is none."""
    bounded_batches(SparkSession.active())

    @F.arrow_udf("array<struct<segment: string, verb: string, sub: string>>")
    def run(commands: pa.Array) -> pa.Array:
        place: dict[str | None, int] = {}  # of each command that the batch holds; one is split once
        rows = [place.setdefault(c, len(place)) for c in commands.to_pylist()]
        out = []
        for c in place:
            got = [] if c is None else [{"segment": s, "verb": v, "sub": b} for s in segments(c) for v, b in [verb_of(s)] if not is_syntax(s)]
            out.append(got or [{"segment": "", "verb": None, "sub": None}])
        return pa.array(out, _PARTS).take(pa.array(rows, pa.int64()))

    return run(command)
