"""Restoring streamed replies: a token may be split over frames, so each reply holds back a tail that may still grow.

``restore_frames`` does a finished table of frames, sorted by reply; ``restore_stream`` is the same step as a
stateful streaming operator with the held tail, the block index, the next frame number and the vault as its
state, and frames that come early kept by their numbers until their turn.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, MapState, StatefulProcessor, StatefulProcessorHandle, TimerValues

from veilspark.operators.bodies import dump

TOKEN = re.compile("<[A-Z][A-Z0-9_]*>")
GROWING = re.compile("<[A-Z0-9_]*$")
OUT = "request_id string, seq bigint, part int, frame string"
OUT_NAMES = [x.split()[0] for x in OUT.split(", ")]
PLACE = "tail string, block int, next bigint, last bigint, provider string"
BLOCK = 256
#: For ``restore_stream``: set spark.sql.streaming.stateStore.providerClass to it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Restorer:
    """The text that is safe to emit after each delta."""

    def __init__(self, tokens: dict[str, str], tail: str = ""):
        self.tokens, self.tail = tokens, tail

    def _known(self, text: str) -> str:
        return TOKEN.sub(lambda m: self.tokens.get(m[0], m[0]), text)

    def push(self, delta: str) -> str:
        text = self.tail + delta
        growing = GROWING.search(text)
        cut = growing.start() if growing else len(text)
        self.tail = text[cut:]
        return self._known(text[:cut])

    def end(self) -> str:
        """A tail that begins exactly one token stands for it."""
        text, self.tail = self.tail, ""
        growing = GROWING.search(text)
        if growing:
            fits = [v for k, v in self.tokens.items() if k.startswith(growing[0])]
            if len(fits) == 1:
                return self._known(text[: growing.start()] + fits[0])
        return self._known(text)


def _object(data: str) -> dict:
    """The frame's JSON object; anything else, whatever its shape or depth, says nothing about the text."""
    try:
        return _as_dict(json.loads(data))
    except (ValueError, RecursionError):
        return {}


def _as_dict(value: object) -> dict:
    return value if isinstance(value, dict) else {}


def _index(j: dict) -> int | None:
    index = j.get("index")
    return index if isinstance(index, int) and not isinstance(index, bool) and 0 <= index < 1 << 31 else None


@dataclass(frozen=True)
class Event:
    """What a frame means for the text: a piece of it (``text``), the end of a block (``ends``) or of the reply (``stops``)."""

    text: str | None = None
    block: int | None = None
    ends: bool = False
    stops: bool = False


def openai_event(j: dict) -> Event:
    choices = j.get("choices")
    choice = _as_dict(choices[0]) if isinstance(choices, list) and choices else {}
    content = _as_dict(choice.get("delta")).get("content")
    over = choice.get("finish_reason") is not None
    return Event(text=content) if isinstance(content, str) and content else Event(ends=over)


def openai_frame(text: str, _: int = 0) -> str:
    return f"data: {dump({'choices': [{'index': 0, 'delta': {'content': text}}]})}\n\n"


def anthropic_event(j: dict) -> Event:
    kind, delta = j.get("type"), _as_dict(j.get("delta"))
    text = delta.get("text")
    if kind == "content_block_delta" and delta.get("type") == "text_delta":
        return Event(text=text if isinstance(text, str) else "", block=_index(j))
    return Event(block=_index(j), ends=kind == "content_block_stop", stops=kind == "message_stop")


def anthropic_frame(text: str, block: int = 0) -> str:
    delta = {"type": "content_block_delta", "index": block, "delta": {"type": "text_delta", "text": text}}
    return f"event: content_block_delta\ndata: {dump(delta)}\n\n"


#: Dialects of event streams: what a frame's JSON means, and the frame of a piece of text. ``register_stream`` adds one.
STREAMS: dict[str, tuple[Callable[[dict], Event], Callable[[str, int], str]]] = {
    "openai": (openai_event, openai_frame), "anthropic": (anthropic_event, anthropic_frame),
}


def register_stream(name: str, event: Callable[[dict], Event], frame: Callable[[str, int], str]) -> None:
    STREAMS[name] = event, frame


def event_of(provider: str, data: str, streams: dict | None = None) -> Event:
    return Event(ends=True, stops=True) if data == "[DONE]" else (streams or STREAMS)[provider][0](_object(data))


def parse_delta(provider: str, data: str) -> tuple[str, bool]:
    """Text of a frame's data, and whether it ends the reply."""
    e = event_of(provider, data)
    return e.text or "", e.stops or (e.ends and provider == "openai")


class Reply:
    """One reply: frames in, frames out."""

    def __init__(self, provider: str, tokens: dict[str, str], tail: str = "", block: int = 0, streams: dict | None = None):
        self.provider, self.block, self.text, self.stopped = provider, block, Restorer(tokens, tail), False
        self.streams = streams or STREAMS

    def _emit(self, text: str, block: int) -> list[str]:
        return [self.streams[self.provider][1](text, block)] if text else []

    def frame(self, frame: str) -> list[str]:
        """A piece of text goes on as far as it is settled; what was held goes before the frame that ends it; others as they are."""
        line = next((x for x in frame.split("\n") if x.startswith("data:")), "")
        data = line[5:].strip()
        if not data:
            return [frame]
        event = event_of(self.provider, data, self.streams)
        self.stopped |= event.stops
        block = self.block if event.block is None else event.block
        if event.text is not None:
            self.block = block
            return self._emit(self.text.push(event.text), block)
        return [*self._emit(self.text.end(), block), frame] if event.ends else [frame]

    def end(self) -> list[str]:
        return self._emit(self.text.end(), self.block)


def restore_frames(frames: DataFrame, vaults: DataFrame) -> DataFrame:
    """``frames`` (request_id, provider, seq, frame) and ``vaults`` (request_id, tokens: token to value) to restored frames.
    Frames without a request_id are one reply in each dialect, and an id that stands for requests with different tokens restores nothing."""
    none = lambda kind: F.lit(None).cast(kind)
    listed = vaults.select("request_id", none("string").alias("provider"), none("bigint").alias("seq"), none("string").alias("frame"), F.to_json("tokens").alias("tokens"))
    return restore_listed(frames.select("request_id", "provider", "seq", F.coalesce("frame", F.lit("")).alias("frame"), none("string").alias("tokens")).unionByName(listed))


def restore_listed(rows: DataFrame) -> DataFrame:
    """``restore_frames`` of one table of both: rows without a frame are vaults (tokens as JSON).

    Rows are sorted by reply, vaults first, and one pass carries a reply's state along, so no reply has to fit in a task and
    no vault is copied to every frame."""
    streams = dict(STREAMS)
    schema = T.StructType.fromDDL(OUT)

    def known(texts: set[str]) -> dict[str, str]:
        return json.loads(texts.pop()) if len(texts) == 1 else {}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, texts, place, reply, last = object(), set(), object(), None, -1

        def ended() -> list[tuple]:
            return [(owner, last, 1000 + k, f) for k, f in enumerate(reply.end())] if reply else []

        for batch in batches:
            out: list[tuple] = []
            for request, provider, seq, frame, text in zip(*(batch.column(n).to_pylist() for n in ("request_id", "provider", "seq", "frame", "tokens")), strict=True):
                if request != owner:
                    out += ended()
                    owner, texts, place, reply = request, set(), object(), None
                if frame is None:
                    texts |= {text} if text is not None and request is not None else set()
                    continue
                if provider != place:
                    out += ended()
                    place, reply = provider, Reply(provider, known(set(texts)), streams=streams)
                last = int(seq)
                out += [(request, last, k, f) for k, f in enumerate(reply.frame(frame))]
            yield _batch(out)
        if reply:
            yield _batch(ended())

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=OUT_NAMES)

    given = rows.select(F.col("request_id").cast("string"), "provider", "seq", "frame", "tokens").repartition("request_id")
    return given.sortWithinPartitions("request_id", F.col("frame").isNotNull(), "provider", "seq").mapInArrow(fold, schema)


class Waiting:
    """Frames that came early, in blocks of ``BLOCK`` numbers in the state: a batch reads and writes the blocks that it touches."""

    def __init__(self, state: MapState):
        self.state, self.open, self.any = state, {}, state.exists()

    def _block(self, number: int) -> dict[str, str]:
        if number not in self.open:
            stored = self.state.getValue((number,)) if self.any and self.state.containsKey((number,)) else None
            self.open[number] = json.loads(stored[0]) if stored else {}
        return self.open[number]

    def put(self, seq: int, frame: str) -> None:
        self._block(seq // BLOCK)[str(seq)] = frame

    def take(self, seq: int) -> str | None:
        return self._block(seq // BLOCK).pop(str(seq), None)

    def all(self) -> list[tuple[int, str]]:
        """Those of the state, in order."""
        blocks = [json.loads(v[0]) for _, v in self.state.iterator()] if self.any else []
        return sorted((int(s), f) for block in blocks for s, f in block.items())

    def keep(self) -> None:
        for number, frames in self.open.items():
            if frames:
                self.state.updateValue((number,), (json.dumps(frames),))
            elif self.any and self.state.containsKey((number,)):
                self.state.removeKey((number,))


class Restoring(StatefulProcessor):
    """One reply's state: frames that came early, the place that was reached, and the vault."""

    def __init__(self, streams: dict, timeout: int | None):
        self.streams, self.timeout = streams, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getMapState("early", "block bigint", "frames string")
        self.tokens = handle.getValueState("tokens", "tokens string")
        self.place = handle.getValueState("place", PLACE)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:  # noqa: N803
        for text in initialState["tokens"]:
            self.tokens.update((text,))

    def _resume(self) -> tuple[Reply, int, int]:
        """The reply where it was left, the next number, and the last one passed on."""
        tail, block, after, last, provider = self.place.get() or ("", 0, 0, -1, "openai")
        stored = self.tokens.get()
        return Reply(provider, json.loads(stored[0]) if stored else {}, tail, block, self.streams), after, last

    def _alarm(self, at: int | None) -> None:
        if self.timeout:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)

    def _over(self, key: tuple, reply: Reply, last: int) -> list[tuple]:
        """What is held goes on, and everything is let go."""
        rows = [(key[0], last, 1000 + k, f) for k, f in enumerate(reply.end())]
        for state in (self.early, self.tokens, self.place):
            state.clear()
        return rows

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        given, provider, texts = {}, None, []
        for part in rows:
            provider = part["provider"].iloc[0]
            texts += [t for t in part["tokens"] if t] if "tokens" in part else []
            given |= dict(zip(map(int, part["seq"]), part["frame"], strict=True))
        if texts and not self.tokens.exists():
            self.tokens.update((texts[0],))
        reply, after, last = self._resume()
        reply.provider = provider or reply.provider
        waiting, out = Waiting(self.early), []
        while not reply.stopped:
            frame = given.pop(after, None)
            frame = waiting.take(after) if frame is None else frame
            if frame is None:
                break
            out += [(key[0], after, k, f) for k, f in enumerate(reply.frame(frame))]
            last, after = after, after + 1
        if reply.stopped:
            out += self._over(key, reply, last)
            self._alarm(None)
        else:
            for seq, frame in given.items():
                if seq >= after:
                    waiting.put(seq, frame)
            waiting.keep()
            self.place.update((reply.text.tail, reply.block, after, last, reply.provider))
            self._alarm(timerValues.getCurrentProcessingTimeInMs() + self.timeout if self.timeout else None)
        yield pd.DataFrame(out, columns=OUT_NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        reply, _, last = self._resume()
        out: list[tuple] = []
        for seq, frame in Waiting(self.early).all():
            out += [(key[0], seq, k, f) for k, f in enumerate(reply.frame(frame))]
            last = seq
        out += self._over(key, reply, last)
        yield pd.DataFrame(out, columns=OUT_NAMES)

    def close(self) -> None:
        pass


def restore_stream(frames: DataFrame, timeout: int | None = 600_000, vaults: DataFrame | None = None) -> DataFrame:
    """Streaming ``frames`` (request_id, provider, seq, frame; seq from 0 without gaps; tokens as JSON, unless the vault is known from the start)
    to restored frames.  ``vaults`` (request_id, tokens as JSON) is the state to begin with when the query first starts.

    A reply ends with its stop frame, when its state is let go; or after ``timeout`` milliseconds without frames, when frames that wait for one
    that never came go on in their order, with the held tail behind them. Frames behind the end are a new reply.  The session's state store
    has to be one with column families (``STATE_STORE``)."""
    start = vaults.select("request_id", "tokens").groupBy("request_id") if vaults is not None else None
    grouped = frames.groupBy("request_id")
    return grouped.transformWithStateInPandas(Restoring(dict(STREAMS), timeout), OUT, "Append", "ProcessingTime" if timeout else "None", initialState=start)


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per key and tumbling window; works on streams, where rows later than ``late`` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
