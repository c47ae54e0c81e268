"""Files of a store: staged writes, manifests, digests."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class StoreError(ValueError):
    """A store is missing, damaged, or not what it should be."""


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def staging(spark: SparkSession, target: str, overwrite: bool) -> str:
    """A sibling of the target to write into; refuses an existing target unless it may be replaced."""
    if exists(spark, target) and not overwrite:
        raise StoreError(f"{target} exists; pass overwrite=True to replace it")
    return f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"


def commit(spark: SparkSession, staged: str, target: str) -> None:
    """Rename into place; what was there is kept aside until that has worked, and put back if not."""
    src, fs = _hadoop(spark, staged)
    dst, _ = _hadoop(spark, target)
    aside = None
    if fs.exists(dst):
        aside, _ = _hadoop(spark, f"{target.rstrip('/')}.old-{uuid.uuid4().hex}")
        if not fs.rename(dst, aside):
            raise StoreError(f"{target} can't be replaced")
    if not fs.rename(src, dst):
        if aside is not None:
            fs.rename(aside, dst)
        raise StoreError(f"{target} can't be committed")
    if aside is not None:
        fs.delete(aside, True)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _hadoop(spark, path)
    try:
        stream = fs.open(p)
        try:
            return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
    except Py4JJavaError as e:
        raise StoreError(f"{path} can't be read") from e


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def listing(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(relative path, bytes) of data files, sorted."""
    root, fs = _hadoop(spark, folder)
    base, out = fs.makeQualified(root).toString().rstrip("/"), []
    found = fs.listFiles(root, True)
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString()[len(base) + 1 :]
        if not any(x.startswith(("_", ".")) for x in name.split("/")):
            out.append((name, f.getLen()))
    return sorted(out)


def hashes(spark: SparkSession, places: list[str]) -> list[str]:
    """SHA-256 of each file; files are hashed by tasks, a stretch at a time."""
    if not places:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for i in batch.column(0).to_pylist():
                place, local = places[i], fs.LocalFileSystem()
                where, at = (local, "/" + place[5:].lstrip("/")) if place.startswith("file:") else fs.FileSystem.from_uri(place) if "://" in place else (local, place)
                h = hashlib.sha256()
                with where.open_input_stream(at, compression=None) as f:
                    while chunk := f.read(4 << 20):
                        h.update(chunk)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([h.hexdigest()])], ["i", "sha256"])

    rows = spark.range(0, len(places), 1, min(len(places), 200)).mapInArrow(run, "i long, sha256 string").collect()  # one row a file
    return [r.sha256 for r in sorted(rows)]


def digests(spark: SparkSession, folder: str) -> list[dict]:
    """Path, bytes and SHA-256 of each data file."""
    files = listing(spark, folder)
    found = hashes(spark, [f"{folder.rstrip('/')}/{name}" for name, _ in files])
    return [{"path": name, "bytes": size, "sha256": h} for (name, size), h in zip(files, found, strict=True)]


def stamp(spark: SparkSession, path: str) -> str:
    """A digest of names, sizes and times of what lies at a path."""
    root, fs = _hadoop(spark, path)
    found, out = fs.listFiles(root, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(out)).encode()).hexdigest()


def payload_digest(entries: list[dict]) -> str:
    return hashlib.sha256("\n".join(f"{e['path']}\t{e['bytes']}\t{e['sha256']}" for e in sorted(entries, key=lambda e: e["path"])).encode()).hexdigest()


def canonical_digest(manifest: dict) -> str:
    """Of the manifest without what differs between equal runs."""
    kept = {k: v for k, v in manifest.items() if k not in ("timings", "created_utc", "elapsed", "integrity")}
    return hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()


def seal(spark: SparkSession, folder: str, manifest: dict) -> dict:
    """Write manifest.json with its digests, and the file's own digest beside it."""
    entries = digests(spark, folder)
    manifest = manifest | {"integrity": {"files": entries, "payload_sha256": payload_digest(entries), "canonical_sha256": canonical_digest(manifest)}}
    text = json.dumps(manifest, indent=1, sort_keys=True)
    write_text(spark, f"{folder}/manifest.json", text)
    write_text(spark, f"{folder}/manifest.sha256", hashlib.sha256(text.encode()).hexdigest())
    return manifest


def open_manifest(spark: SparkSession, folder: str, kind: str, version: int) -> dict:
    if not exists(spark, f"{folder}/manifest.json"):
        raise StoreError(f"{folder} has no manifest")
    text = read_text(spark, f"{folder}/manifest.json")
    if hashlib.sha256(text.encode()).hexdigest() != read_text(spark, f"{folder}/manifest.sha256").strip():
        raise StoreError("the manifest doesn't match its digest")
    manifest = json.loads(text)
    if manifest.get("format") != kind or manifest.get("version") != version:
        raise StoreError(f"not a {kind} of version {version}")
    if manifest["integrity"]["canonical_sha256"] != canonical_digest(manifest):
        raise StoreError("the manifest doesn't match its canonical digest")
    return manifest


def check_payload(spark: SparkSession, folder: str, manifest: dict) -> None:
    now = [e for e in digests(spark, folder) if e["path"] not in ("manifest.json", "manifest.sha256")]
    if payload_digest(now) != manifest["integrity"]["payload_sha256"]:
        raise StoreError("files of the store are missing or changed")
