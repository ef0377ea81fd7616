"""Line items of documents that arrive in pieces.

Pieces of a document (key, seq from 0, text, last, ts) come in any batches and any order. State
holds, for each document, what the reader of lines has not closed yet: the line that may go on,
the block of pairs, the last item (which a block may take as its title), and pieces that came
before their turn. Items are emitted as soon as nothing that follows can change them; the
rest when the last piece is there, or when no piece came for ``wait`` of event time. A line
may be cut anywhere. What comes out is what the batch form says of whole texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.documents import Reader

PIECES = "doc_id string, seq long, text string, last boolean, ts timestamp"
ITEMS = "doc_id string, pos int, item string, n_pairs int"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Unfinished:
    """A document that is being read: a reader and what it has not closed, as one JSON text and back."""

    def __init__(self, saved: str | None = None) -> None:
        self.reader, s = Reader(), json.loads(saved) if saved else {}
        self.reader.held, self.reader.lines = s.get("held"), s.get("lines", [])
        self.reader.block = [tuple(p) for p in s.get("block", [])]
        self.reader.items = [(t, [tuple(p) for p in pairs]) for t, pairs in s.get("items", [])]
        self.tail: str = s.get("tail", "")  # a line without its end
        self.whole: str | None = s.get("whole", "")  # all of a document without an item so far
        self.said, self.turn, self.early = s.get("said", 0), s.get("turn", 0), s.get("early", {})

    def saved(self) -> str:
        r = self.reader
        return json.dumps({"held": r.held, "lines": r.lines, "block": r.block, "items": r.items, "tail": self.tail, "whole": self.whole, "said": self.said, "turn": self.turn, "early": self.early})

    def take(self, seq: int, text: str, last: bool) -> bool:
        """Takes a piece, and those after it that were early; whether the document is over."""
        if seq >= self.turn:
            self.early[str(seq)] = [text, last]
        while (piece := self.early.pop(str(self.turn), None)) is not None:
            self.turn += 1
            text, last = piece
            self.whole = None if self.whole is None else self.whole + text
            lines = (self.tail + text).splitlines(keepends=True)
            # a carriage return may be half a line's end
            self.tail = lines.pop() if lines and (lines[-1].splitlines() == [lines[-1]] or lines[-1].endswith("\r")) else ""
            for line in lines:
                self.reader.take(line.splitlines()[0])
            if last:
                return True
        return False

    def closed(self) -> list[tuple[str, int]]:
        """Items that nothing can change any more, each with the number of its pairs."""
        r = self.reader
        out, r.items = r.items[:-1], r.items[-1:]
        r.lines = r.lines[-(len(r.block) + 1) :]
        if out or r.items:
            self.whole = None
        return [(t, len(p)) for t, p in out]

    def rest(self) -> list[tuple[str, int]]:
        """All other items of a document that is over. One without any is an item itself."""
        for line in self.tail.splitlines():
            self.reader.take(line)
        out = self.reader.done()
        whole = (self.whole or "").strip()
        return [(t, len(p)) for t, p in out] or ([(whole, 0)] if whole and not self.said else [])


class ItemReader(StatefulProcessor):
    """Emits the items of each document as its pieces come."""

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("unfinished", "saved string, timer long")

    def _rows(self, key, doc: Unfinished, items: list[tuple[str, int]]) -> pd.DataFrame:
        text = lambda values: pd.Series(values, dtype=object)
        pos, pairs = range(doc.said, doc.said + len(items)), [n for _, n in items]
        out = pd.DataFrame({"doc_id": text([key[0]] * len(items)), "pos": pd.Series(pos, dtype="int32"), "item": text([t for t, _ in items]), "n_pairs": pd.Series(pairs, dtype="int32")})
        doc.said += len(items)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        saved, timer = self.state.get() if self.state.exists() else (None, None)
        doc, over, latest = Unfinished(saved), False, 0
        for part in rows:
            latest = max(latest, int(part["ts"].max().value // 1_000_000))
            for r in part.sort_values("seq").itertuples(index=False):
                over = doc.take(int(r.seq), r.text or "", bool(r.last)) or over
        if timer is not None:
            self.handle.deleteTimer(timer)
        if over:
            yield self._rows(key, doc, doc.rest())
            self.state.clear()
            return
        yield self._rows(key, doc, doc.closed())
        timer = max(latest + self.wait_ms, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.state.update((doc.saved(), timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            doc = Unfinished(self.state.get()[0])
            # what is missing never came: pieces behind the gap are read as they are
            for seq in sorted(map(int, list(doc.early))):
                doc.turn = seq
                doc.take(seq, *doc.early[str(seq)])
            yield self._rows(key, doc, doc.rest())
            self.state.clear()

    def close(self) -> None:
        pass


def stream_items(pieces: DataFrame, wait_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """ITEMS of a stream of PIECES. The session's state store must be ``STORE``."""
    typed = pieces.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("seq").cast("long").alias("seq"), "text", "last", "ts").withWatermark("ts", late)
    return typed.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=ItemReader(wait_ms), outputStructType=ITEMS, outputMode="Append", timeMode="EventTime")
