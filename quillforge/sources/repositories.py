"""Version-controlled trees as tables: heads of remotes, and the files of a commit.

Each task asks the remotes of its rows itself, with a process that is killed when
it takes too long; a clone lives in a folder of the task and goes with it.
"""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..io import importable
from .files import MOST_BYTES


def _git(*args: str, seconds: float, cwd: str | None = None, data: bytes | None = None) -> bytes:
    """What a command prints; an error if it fails or does not end in time (then it is killed)."""
    env = os.environ | {"GIT_TERMINAL_PROMPT": "0", "GIT_CONFIG_NOSYSTEM": "1", "GIT_LFS_SKIP_SMUDGE": "1"}
    return subprocess.run(["git", "-c", "safe.directory=*", *args], capture_output=True, check=True, timeout=seconds, cwd=cwd, input=data, env=env).stdout


_FAILED = (subprocess.CalledProcessError, subprocess.TimeoutExpired, OSError)


def remote_heads(remotes: DataFrame, seconds: float = 10) -> DataFrame:
    """SRC-10, SRC-11: (url, reachable, head) for remotes(url); head is null for one that is not reachable or has no commit. Repeated rows are asked again."""
    importable(remotes.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    found = _git("ls-remote", "--", url or "", "HEAD", seconds=seconds).decode().split()
                    rows.append((url, True, found[0] if found else None))
                except _FAILED:
                    rows.append((url, False, None))
            yield pd.DataFrame(rows, columns=["url", "reachable", "head"])

    return remotes.select("url").mapInPandas(run, "url string, reachable boolean, head string")


def _checked_out(url: str, commit: str | None, folder: str, seconds: float) -> str | None:
    """The commit whose objects are in the folder now: the one asked for, else the tip; none for an empty repository."""
    _git("init", "--quiet", "--bare", folder, seconds=seconds)
    if commit is None:
        tip = _git("ls-remote", "--", url, "HEAD", seconds=seconds).decode().split()
        if not tip:
            return None
    _git("fetch", "--quiet", "--depth=1", "--", url, commit or "HEAD", seconds=seconds, cwd=folder)
    return _git("rev-parse", "FETCH_HEAD", seconds=seconds, cwd=folder).decode().strip()


def git_files(remotes: DataFrame, most_bytes: int = MOST_BYTES, seconds: float = 600) -> DataFrame:
    """SRC-01: (url, commit, path, content, length, error) for the regular files of remotes(url, commit).

    Shallow: one commit is fetched, the pinned one or, where commit is null, the
    tip. A commit that the remote does not give out is an error, never another
    commit. Content is null beyond most_bytes. Links and submodules are left out.
    A remote that fails, and one without commits, gives one row without a path.
    """
    importable(remotes.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url, pinned in zip(batch["url"], batch["commit"], strict=True):
                with tempfile.TemporaryDirectory() as folder:
                    try:
                        commit = _checked_out(url or "", pinned, folder, seconds)
                        listed = _git("ls-tree", "-r", "-l", "-z", commit, seconds=seconds, cwd=folder).split(b"\0") if commit else []
                    except _FAILED as e:
                        reason = (getattr(e, "stderr", None) or str(e).encode()).decode(errors="replace").strip()
                        yield _frame([(url, pinned, None, None, None, reason or "failed")])
                        continue
                    if commit is None:
                        yield _frame([(url, None, None, None, None, None)])
                    for entry in listed:
                        if not entry:
                            continue
                        head, path = entry.split(b"\t", 1)
                        mode, kind, blob, size = head.split()
                        if kind == b"blob" and mode != b"120000":
                            content = _git("cat-file", "blob", blob.decode(), seconds=seconds, cwd=folder) if int(size) <= most_bytes else None
                            yield _frame([(url, commit, path.decode(errors="replace"), content, int(size), None)])

    return remotes.select("url", "commit").mapInPandas(run, "url string, commit string, path string, content binary, length long, error string")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["url", "commit", "path", "content", "length", "error"]).astype({"length": "Int64"})
