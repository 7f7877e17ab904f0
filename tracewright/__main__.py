"""The command line: ``python -m tracewright [audit] [corpus] [--contracts FILE] [--json]``."""

from __future__ import annotations

import sys
from pathlib import Path

USAGE = """python -m tracewright [report] [CORPUS] [--contracts FILE] [--json]
python -m tracewright audit [CORPUS] [--json]

Without CORPUS the transcripts under the home folder are read. Corpora are named in tracewright.json.
Nothing leaves this machine."""


def main(argv: list[str], out=print, err=lambda s: print(s, file=sys.stderr), folder: str = ".", home: str | None = None, spark=None) -> int:
    from .operators import report as R
    from .operators.check import parse_contracts
    from .plans import config as conf
    from .plans.corpus import load

    if "--help" in argv or "-h" in argv:
        out(USAGE)
        return 0
    given = argv.index("--contracts") if "--contracts" in argv else None
    file = argv[given + 1] if given is not None and given + 1 < len(argv) else None
    words = [a for k, a in enumerate(argv) if not a.startswith("-") and (given is None or k != given + 1)]
    what = words.pop(0) if words and words[0] in ("audit", "report") else "report"
    config = conf.load(folder)
    if words:
        name = words[0]
        try:
            own = config.corpus(name)
        except conf.ConfigError as e:
            err(str(e))
            return 1
    else:
        found = conf.local_corpus(home)
        if not found:
            err("no transcripts found; name a corpus: " + (", ".join(sorted(config.corpora)) or "none is configured"))
            return 1
        own, projects, sessions = found
        name = "cc-local"
        err(f"reading {sessions} sessions of {projects} projects")
    clauses = None
    if what == "report":
        file = file or conf.contracts_for(own.domain or name)
        if not file or not Path(file).exists():
            err(f"no clauses for {name}: none are shipped for {own.domain or name!r}, and no --contracts was given")
            return 1
        clauses = parse_contracts(Path(file).read_text())
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("tracewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    corpus = load(spark, own.adapter, own.source, Path(own.alphabet).read_text(), name, segmenter=own.segmenter or config.segmenter, store=str(config.workspace / name))
    if not words and (skipped := sessions - corpus.interactions.count()):
        err(f"{skipped} of them have no action and cannot be checked")
    if what == "audit":
        figures = R.audit(corpus, config.thresholds["unknownRateGate"], config.thresholds["minInstances"])
        out(R.as_json(figures) if "--json" in argv else R.render_audit(figures))
    else:
        figures = R.report(corpus, clauses, str(own.domain or name))
        out(R.as_json(figures) if "--json" in argv else R.render_report(figures))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
