"""Runs of untrusted programs against their tests, in child processes with limits; off unless asked for."""

from __future__ import annotations

import os
import resource
import subprocess
import sys
import tempfile

import pandas as pd
from pyspark.sql import DataFrame

#: Limits of a child process: address space in bytes, file size in bytes.
MEMORY, FILE = 1 << 30, 1 << 24


def _limit() -> None:
    resource.setrlimit(resource.RLIMIT_AS, (MEMORY, MEMORY))
    resource.setrlimit(resource.RLIMIT_FSIZE, (FILE, FILE))


def run_program(files: dict[str, str], main: str, timeout: float) -> tuple[bool, str | None]:
    """(passed, error) of one program in an empty folder of its own, which goes afterwards."""
    with tempfile.TemporaryDirectory() as folder:
        for name, body in files.items():
            with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
                f.write(body)
        try:
            done = subprocess.run(
                [sys.executable, "-I", "-c", f"import sys; sys.path.insert(0, '.'); exec(compile(open({main!r}).read(), {main!r}, 'exec'), {{'__name__': '__main__'}})"],
                cwd=folder, capture_output=True, text=True, timeout=timeout, preexec_fn=_limit, env={"PATH": os.environ.get("PATH", "")}, check=False,
            )
        except subprocess.TimeoutExpired:
            return False, "TIMEOUT"
    return done.returncode == 0, None if done.returncode == 0 else done.stderr.strip()[-4000:]


def canonical(program: str | None, test: str | None, entry: str | None, timeout: float) -> tuple[bool, str | None]:
    """Run a program, then its test, which must define check(candidate), then the check."""
    for value, name in ((program, "program"), (test, "test"), (entry, "entry point")):
        if not value:
            return False, f"missing {name}"
    main = f"{program}\n\n{test}\n\nassert callable(globals().get('check')), 'no check(candidate)'\ncheck({entry})\n"
    return run_program({"main.py": main}, "main.py", timeout)


def run_tests(df: DataFrame, key: str, allow: bool = False, timeout: float = 10.0) -> DataFrame:
    """(key, passed, error) for rows with program, test and entry_point. It executes what the rows hold."""
    if not allow:
        raise PermissionError("running programs from data must be allowed explicitly")

    def run(frames):
        for pdf in frames:
            found = [canonical(p, t, e, timeout) for p, t, e in zip(pdf["program"], pdf["test"], pdf["entry_point"], strict=True)]
            yield pd.DataFrame({key: pdf[key], "passed": [f[0] for f in found], "error": [f[1] for f in found]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "program", "test", "entry_point").mapInPandas(run, f"{key} {kind}, passed boolean, error string")
