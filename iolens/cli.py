"""python -m iolens.cli trace_path=... [view_types=time_range,proc_name] [preset=...] [output=console] [output_path=...]"""

from __future__ import annotations

import sys
from dataclasses import fields

from iolens.api import Request, analyze
from iolens.runtime import session
from iolens.sinks import SINKS


def parse(args: list[str]) -> tuple[Request, str, str | None]:
    """A request, the output's name and its path, from key=value arguments."""
    given = dict(a.split("=", 1) for a in args)
    output, path = given.pop("output", "console"), given.pop("output_path", None)
    kinds = {f.name: f.type for f in fields(Request)}
    unknown = set(given) - set(kinds)
    if unknown or output not in SINKS:
        raise SystemExit(f"unknown: {', '.join(sorted(unknown)) or output}")
    values = {}
    for k, v in given.items():
        kind = kinds[k]
        values[k] = v.split(",") if kind.startswith("list") else float(v) if kind == "float" else v.lower() == "true" if kind == "bool" else v
    return Request(**values), output, path


def main(args: list[str] | None = None) -> None:
    request, output, path = parse(sys.argv[1:] if args is None else args)
    result = analyze(session(), request)
    SINKS[output](result, *([path] if path else []))


if __name__ == "__main__":
    main()
