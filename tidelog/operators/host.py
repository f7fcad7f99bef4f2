"""What the machine is, as a record and as JSON."""

from __future__ import annotations

import json
import os
import platform
import subprocess


def _first_line(*command: str) -> str:
    try:
        return subprocess.run(command, capture_output=True, text=True, timeout=5, check=True).stdout.strip().split("\n")[0]
    except (OSError, subprocess.SubprocessError, IndexError):
        return "unknown"


def _cpu() -> str:
    try:
        with open("/proc/cpuinfo") as f:
            return next((line.partition(":")[2].strip() for line in f if line.startswith("model name")), platform.processor() or "unknown")
    except OSError:
        return platform.processor() or "unknown"


def _mount(path: str) -> tuple[str, str]:
    """File system and device of the longest mount point above a path."""
    best, at = ("unknown", "unknown"), ""
    try:
        with open("/proc/mounts") as f:
            for line in f:
                device, point, kind = line.split()[:3]
                if os.path.abspath(path).startswith(point) and len(point) >= len(at):
                    best, at = (kind, device), point
    except OSError:
        pass
    return best


def platform_info(path: str = ".", spark=None) -> dict[str, object]:
    kind, device = _mount(path)
    info = {"interpreter": f"{platform.python_implementation()} {platform.python_version()}", "os_kernel": f"{platform.system()} {platform.release()}", "architecture": platform.machine(), "cpu_model": _cpu(), "logical_cpus": os.cpu_count(), "filesystem": kind, "storage_device": device, "java": _first_line("java", "--version"), "revision": _first_line("git", "rev-parse", "HEAD")}
    if spark is not None:
        info |= {"spark": spark.version, "master": spark.sparkContext.master}
    return info


def as_json(info: dict[str, object]) -> str:
    return json.dumps(info, ensure_ascii=True)
