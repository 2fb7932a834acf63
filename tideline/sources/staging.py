"""Staging of archives: byte-range planning and download, zip in and out, atomic copies. Driver-side utilities, no dataflow."""

from __future__ import annotations

import os
import shutil
import ssl
import time
import urllib.request
import zipfile
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def byte_ranges(spark: SparkSession, total: int, n: int) -> DataFrame:
    """part, first and last byte of n equal ranges; the last takes the remainder."""
    size = total // n
    return spark.range(n).select(F.col("id").cast("int").alias("part"), (F.col("id") * size).alias("first"), F.when(F.col("id") == n - 1, total - 1).otherwise((F.col("id") + 1) * size - 1).cast("long").alias("last"))


def temp_path(path: Path, suffix: str = "_tmp") -> Path:
    return path.with_name(f"{path.stem}{suffix}{path.suffix}")


def total_bytes(path: str | Path) -> int:
    path = Path(path)
    return path.stat().st_size if path.is_file() else sum(p.stat().st_size for p in path.rglob("*") if p.is_file())


def remove(path: str | Path) -> None:
    path = Path(path)
    shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)


def download(url: str, target_path: str, min_size_bytes: int = 12 << 30, max_retries: int = 10, retry_delay: float = 3.0, chunk_size: int = 1 << 20, timeout: float = 30, replace: bool = False, num_connections: int = 8, verify: bool = True) -> bool:
    """Fetches url in parallel ranges if the server has them, resumes parts, and moves the whole into place; False if all tries fail.

    Certificates are verified unless verify is False."""
    target = Path(target_path)
    if target.exists() and not replace:
        return target.stat().st_size >= min_size_bytes
    context = None if verify else ssl._create_unverified_context()
    fetch = lambda first=None, last=None, method="GET": urllib.request.urlopen(urllib.request.Request(url, method=method, headers={} if first is None else {"Range": f"bytes={first}-{last}"}), timeout=timeout, context=context)

    def part(i: int, first: int, last: int) -> Path:
        path = target.with_name(f"{target.name}.part{i}")
        have = path.stat().st_size if path.exists() else 0
        if first + have <= last:
            with fetch(first + have, last) as r, path.open("ab") as out:
                shutil.copyfileobj(r, out, chunk_size)
        if path.stat().st_size != last - first + 1:
            raise OSError(f"part {i} is incomplete")
        return path

    for attempt in range(max_retries):
        try:
            with fetch(method="HEAD") as r:
                size, ranged = int(r.headers.get("Content-Length") or 0), r.headers.get("Accept-Ranges") == "bytes"
            whole = temp_path(target)
            if ranged and size:
                step = size // num_connections
                plan = [(i, i * step, size - 1 if i == num_connections - 1 else (i + 1) * step - 1) for i in range(num_connections)]
                with ThreadPoolExecutor(num_connections) as pool:
                    parts = list(pool.map(lambda p: part(*p), plan))
                with whole.open("wb") as out:
                    for p in parts:
                        with p.open("rb") as f:
                            shutil.copyfileobj(f, out, chunk_size)
                for p in parts:
                    p.unlink()
            else:
                with fetch() as r, whole.open("wb") as out:
                    shutil.copyfileobj(r, out, chunk_size)
            if whole.stat().st_size < min_size_bytes:
                raise OSError(f"{whole.stat().st_size} bytes are fewer than {min_size_bytes}")
            os.replace(whole, target)
            return True
        except OSError:
            if attempt + 1 < max_retries:
                time.sleep(retry_delay)
    return False


def extract_zip(zip_path: str, extract_to: str, replace: bool = False, max_workers: int = 4) -> bool:
    """Whether extract_to holds the archive's members afterwards. A target that exists counts as done unless replace is set.

    Members are written to a new folder beside the target by a pool of readers, which takes its place when all are there."""
    target = Path(extract_to)
    if target.exists() and not replace:
        return True
    staged = target.with_name(f"{target.name}.{os.getpid()}.part")
    remove(staged)
    try:
        staged.mkdir(parents=True)
        with zipfile.ZipFile(zip_path) as z:
            members = sorted(z.infolist(), key=lambda m: -m.file_size)  # the largest first, so that workers end together

        def unpack(member: zipfile.ZipInfo) -> None:
            with zipfile.ZipFile(zip_path) as z:
                z.extract(member, staged)

        with ThreadPoolExecutor(max_workers) as pool:
            for done in [pool.submit(unpack, m) for m in members]:
                done.result()
        remove(target)
        os.replace(staged, target)
    except (OSError, zipfile.BadZipFile):
        remove(staged)
        return False
    return True


def create_zip(src_dir: str, dst_zip_path: str) -> bool:
    """All files below src_dir, stored without compression."""
    src, dst = Path(src_dir), Path(dst_zip_path)
    if not src.is_dir():
        return False
    staged = temp_path(dst)
    with zipfile.ZipFile(staged, "w", zipfile.ZIP_STORED) as z:
        for p in sorted(src.rglob("*")):
            if p.is_file():
                z.write(p, p.relative_to(src))
    os.replace(staged, dst)
    return True


def safe_copy(src: str, dst: str, max_retries: int = 7, retry_delay: float = 10.0, chunk_size: int = 128 << 20, force_sync: bool = False) -> bool:
    """Copies a file or folder with retries; files appear whole."""
    a, b = Path(src), Path(dst)
    for attempt in range(max_retries):
        try:
            if a.is_dir():
                remove(b)
                shutil.copytree(a, b)
            else:
                b.parent.mkdir(parents=True, exist_ok=True)
                staged = temp_path(b)
                with a.open("rb") as f, staged.open("wb") as out:
                    shutil.copyfileobj(f, out, chunk_size)
                    if force_sync:
                        out.flush()
                        os.fsync(out.fileno())
                os.replace(staged, b)
            return True
        except OSError:
            if attempt + 1 < max_retries:
                time.sleep(retry_delay)
    return False
