"""Table functions for SQL.

    tables.register(spark)
    SELECT r.request_id, s.slot, s.text, s.numeric FROM requests r, LATERAL slots(r.body, r.provider, r.redact_system) s
    SELECT * FROM restored(TABLE(frames))

``slots`` lists a body's redactable fields, ``reply_slots`` a reply's: one row each, or one with ``error`` for a body
that cannot be walked.  ``restored`` restores streamed replies; it asks for its own partitioning and order, passes
rows through one by one and never holds a reply.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from veilspark.operators import bodies
from veilspark.streaming import replies

SLOT = T.StructType().add("slot", "integer").add("text", "string").add("numeric", "boolean").add("error", "string")
NEEDED = ("request_id", "provider", "seq", "frame", "tokens")


def _is_text(argument: AnalyzeArgument) -> bool:
    return isinstance(argument.dataType, (T.StringType, T.NullType)) and not argument.isTable


def _slots(reply: bool, dialects: dict):
    class Slots:
        """A body's fields in the order that fixes token numbers."""

        @staticmethod
        def analyze(body: AnalyzeArgument, provider: AnalyzeArgument, redact_system: AnalyzeArgument | None = None, strict: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not (_is_text(body) and _is_text(provider)):
                raise ValueError("slots takes a body and a provider, both strings")
            for flag in (redact_system, strict):
                if flag is not None and not isinstance(flag.dataType, (T.BooleanType, T.NullType)):
                    raise ValueError("redact_system and strict are booleans")
            return AnalyzeResult(schema=SLOT)

        def eval(self, body: str | None, provider: str | None, redact_system: bool | None = None, strict: bool | None = None) -> Iterator[tuple]:
            error, fields = bodies.listed(body, provider, redact_system is not False, dialects, reply, bool(strict))
            if error:
                yield None, None, None, error
            for slot, text, numeric in fields:
                yield slot, text, numeric, None

    return F.udtf(Slots, useArrow=True)


def _restored(streams: dict):
    class Restored:
        """Frames of replies (request_id, provider, seq, frame; tokens as JSON) to restored frames."""

        @staticmethod
        def analyze(frames: AnalyzeArgument) -> AnalyzeResult:
            if not frames.isTable:
                raise ValueError("restored takes a table of frames")
            kinds = {f.name: f.dataType for f in frames.dataType}
            lacking = [n for n in NEEDED if n not in kinds]
            if lacking:
                raise ValueError(f"the table of frames lacks {', '.join(lacking)}")
            out = T.StructType().add("request_id", kinds["request_id"]).add("seq", "long").add("part", "integer").add("frame", "string")
            return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn("request_id"), PartitioningColumn("provider")], orderBy=[OrderingColumn("seq")])

        def __init__(self):
            self.reply = self.last = None

        def eval(self, row: Row) -> Iterator[tuple]:
            if self.reply is None:
                self.reply = replies.Reply(row["provider"], json.loads(row["tokens"] or "{}"), streams=streams)
            self.last = row["request_id"], row["seq"]
            for part, frame in enumerate(self.reply.frame(row["frame"])):
                yield *self.last, part, frame

        def terminate(self) -> Iterator[tuple]:
            for part, frame in enumerate(self.reply.end() if self.reply else ()):
                yield *self.last, 1000 + part, frame

    return F.udtf(Restored, useArrow=False)  # with Arrow, every row's output would be a batch of its own


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL, with the dialects that are registered now."""
    spark.udtf.register("slots", _slots(False, dict(bodies.REQUESTS)))
    spark.udtf.register("reply_slots", _slots(True, dict(bodies.REPLIES)))
    spark.udtf.register("restored", _restored(dict(replies.STREAMS)))
