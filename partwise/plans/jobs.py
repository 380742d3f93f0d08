"""Jobs as a service would offer them, as plain functions: take a file in, run it, follow it, hand out its results, forget it."""

from __future__ import annotations

import os
import re
import shutil
import threading
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from partwise.operators import filters, inference
from partwise.plans.config import parse
from partwise.plans.pipeline import run
from partwise.sources.readers import detect, load, unpacked

# Ratios by their names, and bounds of a service.
RATIOS = {"70/30": [7, 3], "80/20": [8, 2], "90/10": [9, 1], "70/15/15": [70, 15, 15], "80/10/10": [8, 1, 1]}
MOST_BYTES, KEEP_SECONDS = 500 * 1024 * 1024, 24 * 3600


def ratio(name: str) -> list[int]:
    """The ratios of a name; 8 to 2 for unknown ones."""
    return RATIOS.get(name, [8, 2])


def message(error: Exception) -> str:
    """What a user is told about an error."""
    text = str(error)
    if isinstance(error, KeyError) or "UNRESOLVED_COLUMN" in text or "FIELD_NOT_FOUND" in text:
        column = re.search(r"`([^`]+)`", text)
        return f"Column {column[1] if column else text} not found in the data. Check the entity columns."
    if isinstance(error, ImportError):
        return f"Missing dependency: {text}"
    if isinstance(error, ValueError):
        return f"Configuration error: {text}"
    return f"{'Splitting failed' if isinstance(error, RuntimeError) else 'Unexpected error'}: {text}"


@dataclass
class Job:
    folder: Path
    input: str = ""
    status: str = "uploaded"
    progress: int = 0
    log: list[str] = field(default_factory=list)
    error: str | None = None
    technique_folders: list[str] = field(default_factory=list)


class Jobs:
    """A registry of jobs under a folder: uploaded, running, then completed or failed. Safe to use from several threads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.jobs, self.lock = spark, Path(folder), {}, threading.Lock()

    def take(self, name: str, content: bytes, most: int = MOST_BYTES) -> dict:
        """Store a file (a ZIP is unpacked) and look at it: job, format, preview, stats, hints; or the error that loading it gave."""
        if len(content) > most:
            raise ValueError(f"more than {most} bytes")
        job_id = uuid.uuid4().hex[:12]
        job = Job(self.folder / job_id)
        (job.folder / "in").mkdir(parents=True)
        path = job.folder / "in" / (re.sub(r"[^\w.-]", "_", os.path.basename(name)).lstrip(".") or "input")
        path.write_bytes(content)
        job.input = unpacked(str(path), str(job.folder / "unpacked")) if zipfile.is_zipfile(path) and path.suffix == ".zip" else str(path)
        with self.lock:
            self.jobs[job_id] = job
        try:
            fmt = detect(job.input)
            rows = load(self.spark, job.input, fmt).persist()
            shown = filters.visible(rows)
            types = [tuple(r) for r in inference.column_types(rows, [c for c, t in rows.dtypes if t == "string" and c in shown]).collect()]
            ligand = "has_ligand" in shown and not rows.where("has_ligand").isEmpty()
            out = {
                "job": job_id, "format": fmt, "columns": shown, "preview": [r.asDict() for r in filters.preview(rows, "_row_id").collect()],
                "stats": filters.stats(rows, shown[:50]).first().asDict(), "hints": inference.hints(types, fmt, shown, ligand),
            }
            rows.unpersist()
            return out
        except Exception as e:  # a file that can't be loaded is told about, not refused
            return {"job": job_id, "error": message(e)}

    def start(self, job_id: str, raw: dict, wait: bool = False) -> None:
        """Run the configuration (without dataset paths) on the job's file, in a thread; an error if it runs already."""
        with self.lock:
            job = self.jobs[job_id]
            if job.status == "running":
                raise RuntimeError("the job runs already")
            job.status, job.progress, job.error = "running", 0, None
        thread = threading.Thread(target=self._run, args=(job_id, raw), daemon=True)
        thread.start()
        if wait:
            thread.join()

    def _run(self, job_id: str, raw: dict) -> None:
        job = self.jobs[job_id]

        def told(percent: int, text: str) -> None:
            with self.lock:
                job.progress = percent
                job.log.append(text)

        try:
            data = {"name": job_id, **raw.get("dataset", {}), "input": job.input, "output": str(job.folder / "out")}
            self.spark.sparkContext.addJobTag(f"partwise-{job_id}")
            result = run(self.spark, parse({**raw, "dataset": data}), write=True, progress=told)
            job.technique_folders = sorted(result.assignments)
            end, error = "completed", None
        except Exception as e:
            end, error = "failed", message(e)
            told(job.progress, error)
        finally:
            self.spark.sparkContext.removeJobTag(f"partwise-{job_id}")
        with self.lock:
            job.status, job.error = end, error

    def status(self, job_id: str) -> dict:
        with self.lock:
            job = self.jobs[job_id]
            return {"status": job.status, "progress": job.progress, "log": [*job.log], "error": job.error}

    def follow(self, job_id: str, every: float = 0.3, most: float = 600) -> Iterator[dict]:
        """Status with the new lines of the log, until the job ends or nothing has come for so long."""
        seen, last = 0, time.monotonic()
        while time.monotonic() - last < most:
            now = self.status(job_id)
            new, seen = now["log"][seen:], len(now["log"])
            if new or now["status"] in ("completed", "failed"):
                last = time.monotonic()
                yield {**now, "log": new}
            if now["status"] in ("completed", "failed"):
                return
            time.sleep(every)

    def files(self, job_id: str) -> dict[str, list[str]]:
        """Names of written files, by technique; those of all under ""."""
        out = self.jobs[job_id].folder / "out"
        found: dict[str, list[str]] = {}
        for path in sorted(p for p in out.rglob("*") if p.is_file() and not p.name.startswith((".", "_"))):
            name = str(path.relative_to(out))
            owner = next((t for t in self.jobs[job_id].technique_folders if any(part.removeprefix("split_").startswith(f"{t}_") for part in Path(name).parts)), "")
            found.setdefault(owner, []).append(name)
        return found

    def results(self, job_id: str, technique: str | None = None) -> str:
        """A ZIP file of all results, or of one technique's; only of a completed job."""
        job = self.jobs[job_id]
        if job.status != "completed":
            raise ValueError(f"the job is {job.status}")
        names = self.files(job_id)
        if technique is not None and technique not in names:
            raise ValueError(f"no results of {technique}")
        path = job.folder / f"results{'_' + technique if technique else ''}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for owner, each in names.items():
                for name in each if technique in (None, owner) else []:
                    z.write(job.folder / "out" / name, name)
        return str(path)

    def expire(self, seconds: float = KEEP_SECONDS) -> list[str]:
        """Forget and delete jobs that don't run and whose folder wasn't touched for so long."""
        with self.lock:
            gone = [k for k, j in self.jobs.items() if j.status != "running" and (not j.folder.exists() or time.time() - j.folder.stat().st_mtime > seconds)]
            for k in gone:
                shutil.rmtree(self.jobs.pop(k).folder, ignore_errors=True)
        return gone
