"""What git says of a folder."""

from __future__ import annotations

import os
import subprocess

from ..functions.names import canonical_remote, clean_path

SECONDS = 2


def _git(folder: str, *args: str) -> str:
    try:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=SECONDS, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return done.stdout.strip() if done.returncode == 0 else ""


def identity(folder: str) -> dict[str, str] | None:
    """Root, common directory and remote of the repository that a folder is in; asked on the driver, for few folders."""
    if not os.path.isdir(folder) or not (root := _git(folder, "rev-parse", "--show-toplevel")):
        return None
    common = _git(folder, "rev-parse", "--git-common-dir")
    common = common if os.path.isabs(common) else os.path.join(folder, common)
    return {"repo_root": clean_path(root), "common_dir": clean_path(os.path.realpath(common)), "remote_url": canonical_remote(_git(folder, "config", "--get", "remote.origin.url"))}
