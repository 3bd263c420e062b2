"""Server-sent event texts, as a batch function and as a stream source with offsets."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "position long, id string, event string, data string"


def parse_events(text: str):
    """(id, event, data) of each message; ids persist, comments don't count, a last message without end counts."""
    last_id, event, data = None, None, []
    for line in [*text.replace("\r\n", "\n").split("\n"), ""]:
        if line == "":
            if data:
                yield last_id, event, "\n".join(data)
                event, data = None, []
        elif not line.startswith(":"):
            field, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if field == "event":
                event = value
            elif field == "id" and "\0" not in value:
                last_id = value
            elif field == "data":
                data.append(value)


class _Stream(SimpleDataSourceStreamReader):
    """Reads a growing file; the offset is the number of messages seen, so a restart resumes after them."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self):
        return {"message": 0}

    def _rows(self):
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8", newline="") as f:
            text = f.read()
        cut = text.replace("\r\n", "\n").rfind("\n\n")  # a message that is still being written waits
        return [(i, *m) for i, m in enumerate(parse_events(text.replace("\r\n", "\n")[: cut + 2] if cut >= 0 else ""))]

    def read(self, start):
        rows = self._rows()[start["message"] :]
        return iter(rows), {"message": start["message"] + len(rows)}

    def readBetweenOffsets(self, start, end):
        return iter(self._rows()[start["message"] : end["message"]])


class ServerSentEvents(DataSource):
    """Format ``sse``; option ``path``: a file that grows by messages."""

    @classmethod
    def name(cls):
        return "sse"

    def schema(self):
        return SCHEMA

    def simpleStreamReader(self, schema):
        return _Stream(self.options["path"])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A finished event text as rows."""
    with open(path, encoding="utf-8", newline="") as f:
        return spark.createDataFrame([(i, *m) for i, m in enumerate(parse_events(f.read()))], SCHEMA)
