"""Program texts in files: a header line, then one JSON string a line; they are compiled anew on loading."""

from __future__ import annotations

import json

from ..plans.env import Env
from ..plans.program import Program

HEADER = "VERDIGRIS PROGRAMS 1"


def save_programs(programs: dict[str, Program | str], path: str) -> None:
    with open(path, "w") as f:
        f.write(HEADER + "\n")
        for name, p in sorted(programs.items()):
            f.write(json.dumps([name, p if isinstance(p, str) else p.text]) + "\n")


def load_programs(env: Env, path: str) -> dict[str, Program]:
    with open(path) as f:
        if f.readline().rstrip("\n") != HEADER:
            raise ValueError("not a file of programs")
        return {name: env.compile(text) for name, text in map(json.loads, f)}
