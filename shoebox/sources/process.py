"""Answers of another program, asked line by line: fingerprints, recognition, or whatever reads a path and writes a line of JSON.

Each task keeps one child. A line is sent when the one before is answered, so a child that dies or hangs costs the line it had, and a new one goes on with the next. Lines that are no JSON object, or name another path, are passed over.
"""

from __future__ import annotations

import json
import queue
import subprocess
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds that a child has for a line.
LIMIT = 120.0


class Child:
    """A running program and the lines that it has written."""

    def __init__(self, command: list[str]):
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        self.lines: queue.SimpleQueue[bytes | None] = queue.SimpleQueue()
        threading.Thread(target=self._read, daemon=True).start()

    def _read(self) -> None:
        for line in self.process.stdout:
            self.lines.put(line)
        self.lines.put(None)

    def answer(self, path: str, limit: float) -> str | None:
        """The line for a path; null if the child ends or takes longer than the limit, and then it is of no more use."""
        try:
            self.process.stdin.write(path.encode() + b"\n")
            self.process.stdin.flush()
            while (line := self.lines.get(timeout=limit)) is not None:
                try:
                    found = json.loads(line)
                except ValueError:
                    continue
                if isinstance(found, dict) and found.get("path", path) == path:
                    return line.decode("utf8", "replace").strip()
        except (OSError, queue.Empty):
            pass
        self.stop()
        return None

    def stop(self) -> None:
        self.process.kill()
        self.process.wait()
        for pipe in (self.process.stdin, self.process.stdout):
            try:
                pipe.close()
            except OSError:  # what was not sent any more
                pass

    @property
    def running(self) -> bool:
        return self.process.poll() is None


def answered(rows: DataFrame, command: list[str], schema: str, column: Column | str = "path", limit: float = LIMIT, name: str = "answer") -> DataFrame:
    """Columns + answer: what the program wrote for each row's path, parsed by the schema; null for null paths, paths with a line break, and those without an answer.

    The program must be there on every worker, read lines of UTF-8 and write each answer at once.
    """
    asked = rows.withColumn("__asked", F.col(column) if isinstance(column, str) else column)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        child = None
        try:
            for batch in batches:
                lines: list[str | None] = []
                for path in batch.column(batch.schema.get_field_index("__asked")).to_pylist():
                    if path is None or not path.strip() or "\n" in path or "\r" in path:
                        lines.append(None)
                        continue
                    if child is None or not child.running:
                        child = Child(command)
                    lines.append(child.answer(path, limit))
                yield batch.append_column("__line", pa.array(lines, pa.string()))
        finally:
            if child is not None:
                child.stop()

    return asked.mapInArrow(ask, f"{kinds}, __line string").withColumn(name, F.from_json("__line", schema)).drop("__asked", "__line")


def fingerprints(rows: DataFrame, command: list[str], column: Column | str = "path", limit: float = LIMIT) -> DataFrame:
    """Columns + phash from a program that answers with 16 hexadecimal digits; null for what is none."""
    got = answered(rows, command, "path string, phash string, error string", column, limit, "__answer")
    digits = F.col("__answer.phash")
    return got.withColumn("phash", F.when(digits.rlike("^[0-9a-fA-F]{16}$"), F.conv(digits, 16, -10).cast("bigint"))).drop("__answer")
