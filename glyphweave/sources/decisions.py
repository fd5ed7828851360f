"""The log of clerical decisions as a file: one JSON document to which events are only added."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import SparkSession

SCHEMA, VERSION = "glyphweave/decisions", 1
#: The kinds of events, and what names one of them.
EVENTS = {"runs": "run_id", "thresholds": "event_id", "decisions": "event_id"}


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


class _Files:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.at = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def beside(self, suffix: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.at.getParent(), self.at.getName() + suffix)

    def read(self) -> str | None:
        if not self.fs.exists(self.at):
            return None
        stream = self.fs.open(self.at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, text: str) -> None:
        """The new file is written whole under another name; the old one is kept as ``.bak``, then the new one takes its place."""
        fresh, kept = self.beside(f".{uuid.uuid4().hex}"), self.beside(".bak")
        stream = self.fs.create(fresh, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self.at):
            self.fs.delete(kept, False)
            self.fs.rename(self.at, kept)
        if not self.fs.rename(fresh, self.at):
            raise OSError(f"the log could not be replaced; it is in {fresh.toString()}, the one before in {kept.toString()}")


def append_decisions(spark: SparkSession, path: str, runs: Sequence[Mapping] = (), thresholds: Sequence[Mapping] = (), decisions: Sequence[Mapping] = ()) -> dict[str, int]:
    """Add events to the log at ``path``, or begin one; returns how many of each kind were new.

    The log holds what people decided, one event a verdict, so it is read and written by the driver. Events
    without an id get one, and a time and a number in the order given; an event whose id the log has is not added again,
    so the same call can be made twice. Events are never changed or removed: a verdict is withdrawn by one of ``clear``.
    """
    files = _Files(spark, path)
    text = files.read()
    log = json.loads(text) if text else {"schema": SCHEMA, "format_version": VERSION, "created": _now()}
    if log.get("format_version") != VERSION or not str(log.get("schema", "")).endswith("/decisions"):
        raise ValueError("this is no decision log of version 1")
    added = {}
    for kind, name, new in zip(EVENTS, EVENTS.values(), (runs, thresholds, decisions), strict=True):
        held = log.setdefault(kind, [])
        known, number = {e.get(name) for e in held}, max([-1, *(e.get("seq", -1) for e in held)])
        for event in map(dict, new):
            if event.get(name) in known and event.get(name) is not None:
                continue
            event.setdefault(name, uuid.uuid4().hex)
            if kind == "decisions" and event.get("decision") not in ("include", "exclude", "clear"):
                raise ValueError("a decision is include, exclude or clear")
            if kind == "runs":
                event.setdefault("started", _now())
            else:
                number += 1
                event.setdefault("seq", number)
                event.setdefault("at", _now())
            known.add(event[name])
            held.append(event)
            added[kind] = added.get(kind, 0) + 1
    log["updated"] = _now()
    files.replace(json.dumps(log, indent=2, ensure_ascii=False) + "\n")
    return {k: added.get(k, 0) for k in EVENTS}
