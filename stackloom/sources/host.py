"""Where a host keeps kernel symbols, debug objects and threads: driver-side paths."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from pathlib import Path

_LISTED = re.compile(rb"\s*0*[1-9a-fA-F][0-9a-fA-F]*\s+\S\s+\S")
#: Where distributions put a release's symbol map, and kernel images of a running system.
SYSTEM_MAPS = ("/boot/System.map-{0}", "/usr/lib/debug/boot/System.map-{0}", "/lib/modules/{0}/System.map", "/usr/lib/debug/lib/modules/{0}/System.map")
KERNEL_IMAGES = ("/run/booted-system/kernel", "/run/current-system/kernel")


def debug_dir(home: str) -> str:
    return f"{home.rstrip('/')}/.debug"


def build_id_object(folder: str, build_id: str) -> str:
    return f"{folder}/.build-id/{build_id[:2]}/{build_id[2:]}/elf"


def cached_kallsyms(folder: str, build_id: str) -> list[str]:
    """Both layouts of a cached kernel symbol listing."""
    base = f"{folder}/[kernel.kallsyms]/{build_id}"
    return [f"{base}/kallsyms", base]


def system_maps(release: str, images: Iterable[str] = ()) -> list[str]:
    """Candidates in order, each once: beside a kernel image first."""
    usual = [p.format(release) for p in SYSTEM_MAPS]
    beside = [x for image in images for x in (str(Path(image).parent / "System.map"), *usual)]
    return list(dict.fromkeys([*beside, *usual]))


def current_system_maps() -> list[str]:
    release = Path("/proc/sys/kernel/osrelease")
    images = [str(Path(p).resolve()) for p in KERNEL_IMAGES if Path(p).exists()]
    return system_maps(release.read_text().strip() if release.exists() else "", images)


def is_listing(path: str) -> bool:
    """Whether a file lists kernel symbols, at least one of them not at address 0."""
    try:
        with open(path, "rb") as f:
            return any(_LISTED.match(line) for line in f)
    except OSError:
        return False


def first_listing(paths: Iterable[str]) -> str | None:
    """The first of the paths that is a listing which can be read."""
    return next((p for p in paths if is_listing(p)), None)


def thread_ids(pid: int, proc: str = "/proc") -> list[int]:
    """Thread ids of a process, ascending."""
    folder = Path(proc) / str(pid) / "task"
    found = sorted(int(p.name) for p in folder.iterdir() if p.name.isdigit())
    if not found:
        raise FileNotFoundError(f"no thread ids in {folder}")
    return found


def same_file(path: str, inode: int | None, device: tuple[int, int] | None = None) -> bool:
    """Whether a recorded object is still the file at path."""
    try:
        s = Path(path).stat()
    except OSError:
        return False
    return (inode in (None, 0) or s.st_ino == inode) and (device is None or (os.major(s.st_dev), os.minor(s.st_dev)) == device)


def object_file(path: str, build_id: str | None = None, inode: int | None = None, device: tuple[int, int] | None = None, folder: str | None = None) -> str | None:
    """Where the symbols of a mapped object are: its cached copy, else the file itself while it is the one recorded.

    A bracketed mapping has a cached copy or none, and the kernel's own is listed elsewhere.
    """
    if path.startswith(("[kernel", "[guest.kernel]")):
        return None
    if folder and build_id and Path(cached := build_id_object(folder, build_id)).is_file():
        return cached
    return path if not path.startswith("[") and Path(path).is_file() and same_file(path, inode, device) else None
