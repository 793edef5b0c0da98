"""Generation of long sources that arrive piece by piece: the chunks of generate_long, with state between them.

Pieces (key, piece, ids, last) come in any order over any number of batches; piece counts from 0 and last marks the
final one. A chunk is given to the model as soon as all of its ids are there, prompted by the tail of what
the source has been given so far, and what comes of it is a row (key, chunk, target, done). The rows of a key in the order
of chunk are the target that generate_long makes of the whole source.

State by key: pieces that wait for an earlier one, the ids of the chunk that is open (`most` and a piece at most),
and what was given so far. It takes part in checkpoints, so a restart goes on within a source. What comes
twice or after the end is dropped, for `forget` milliseconds of processing time if that is set; then all
of the key is forgotten. It needs the state store of RocksDB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auralake.config import ship
from auralake.operators.models import IDS, Generator, long_prompt, once, tail_length
from auralake.streaming.partials import with_state

_IDS = T.StructType().add("ids", IDS)


class LongSource(StatefulProcessor):
    def __init__(self, make: Callable[[], Generator], most: int, overlap: int, marks: tuple[int, int, int], limit: int, prompt: tuple[list[int], list[int]], forget: int | None, options: dict):
        self.make, self.most, self.overlap, self.marks, self.limit, self.prompt, self.forget, self.options = make, most, overlap, marks, limit, prompt, forget, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = () if self.forget is None else (self.forget,)
        self.waiting = handle.getMapState("waiting", T.StructType().add("piece", "integer"), T.StructType().add("ids", IDS).add("last", "boolean"), *ttl)
        # The next piece, the next chunk, whether the last piece has been taken in, whether all is done, the length of the tail.
        self.about = handle.getValueState("about", T.StructType().add("piece", "integer").add("chunk", "integer").add("ended", "boolean").add("done", "boolean").add("tail", "integer"), *ttl)
        self.open = handle.getValueState("open", _IDS, *ttl)
        self.given = handle.getListState("given", _IDS, *ttl)

    def _tail(self, n: int) -> list[int]:
        """The last n ids given so far; all of them for 0, as a slice from -0 is."""
        parts = [list(p[0]) for p in self.given.get()]
        found: list[int] = []
        while parts and (not n or len(found) < n):
            found = parts.pop() + found
        return found[-n:]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        piece, chunk, ended, done, tail = self.about.get() if self.about.exists() else (0, 0, False, False, 0)
        if done:
            for _ in rows:
                pass
            return
        for r in rows:
            if r.piece is not None and r.piece >= piece and not self.waiting.containsKey((r.piece,)):
                self.waiting.updateValue((r.piece,), (list(r.ids or []), bool(r.last)))
        ids = list(self.open.get()[0]) if self.open.exists() else []
        while not ended and self.waiting.containsKey((piece,)):
            more, ended = self.waiting.getValue((piece,))
            self.waiting.removeKey((piece,))
            ids, piece = ids + list(more), piece + 1
        model, step = once(self.make), self.most - self.overlap
        # ids begins where the next chunk does. A chunk that the source's end cuts short is its last one, and a
        # source that ends with a whole chunk has what lies behind the step as one more.
        while not done:
            if len(ids) < self.most and not ended:
                break
            if not ids:
                done = True
                yield Row(key=key[0], chunk=chunk, target=[], done=True)
                break
            part, context = ids[: self.most], self._tail(tail) if chunk else []
            new = model.generate([long_prompt(part, not chunk, context, self.marks, self.prompt)], **self.options)[0][: self.limit]
            self.given.appendValue((list(new),))
            tail = tail_length(len(new), len(part), not chunk, self.overlap)
            short, ids = len(ids) < self.most, ids[step:]
            done = ended and (short or not ids)
            yield Row(key=key[0], chunk=chunk, target=[int(i) for i in new], done=done)
            chunk += 1
        self.about.update((piece, chunk, ended, done, tail))
        if done:
            self.waiting.clear()
            self.open.clear()
            self.given.clear()
        else:
            self.open.update((ids,))

    def close(self) -> None:
        pass


def generate_long_stream(pieces: DataFrame, key: str, make: Callable[[], Generator], most: int, overlap: int, marks: tuple[int, int, int], limit: int = 1024, prompt: tuple[list[int], list[int]] = ([], []), forget: int | None = None, **options: object) -> DataFrame:
    """key, chunk, target and done of a stream of pieces (key, piece, ids, last); overlap has to be less than most."""
    with_state(pieces.sparkSession)
    ship(pieces.sparkSession)
    out = T.StructType([T.StructField("key", pieces.schema[key].dataType)]).add("chunk", "integer").add("target", IDS).add("done", "boolean")
    rows = pieces.selectExpr(f"`{key}` AS key", "cast(piece AS int) piece", "cast(ids AS array<int>) ids", "coalesce(last, false) last")
    step = LongSource(make, most, overlap, marks, limit, prompt, forget, options)
    return rows.groupBy("key").transformWithState(step, out, "Append", "None" if forget is None else "ProcessingTime").withColumnRenamed("key", key)
