"""State of many keys in pages, so that one call to the state store brings the entries of many keys.

A call from a Python worker to the store costs about as much as a thousand look-ups in a dictionary. Keys are therefore dealt to a fixed
number of cells (``cell``), the stream is grouped by cell, and a cell keeps its entries in pages.
"""

from __future__ import annotations

import pickle
from zlib import crc32

from pyspark.sql import Column, functions as F

#: Cells of a stream. A checkpoint holds for one number only.
CELLS = 1024
#: Entries of a page on the average of those that a batch touches; pages of a cell that are held at once.
PAGE, HELD = 256, 2048
_HEAD = -1


def cell(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(CELLS)).cast("int")


class Pages:
    """Stands for the handle of a processor of one key, whose states become entries in the pages of a cell.

    The entry of (state, key, user key) is in a page by its hash. Pages are added one at a time and share the entries of an older one (linear
    hashing), so a batch reads and writes the pages that its keys need, however long the stream has run. With a time to live an entry is
    dropped so long after its own last update.
    """

    def __init__(self, handle, ttl_ms: int | None):
        self.store, self.ttl_ms = handle.getMapState("pages", "page bigint", "entries binary", ttl_ms), ttl_ms
        self.key: tuple = ()

    def getValueState(self, name: str, schema: str, ttl_ms: int | None = None) -> Entry:
        return Entry(self, name)

    def getMapState(self, name: str, user_key: str, schema: str, ttl_ms: int | None = None) -> Entry:
        return Entry(self, name)

    def open(self, timer_values) -> None:
        self.now = timer_values.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        head = self.store.getValue((_HEAD,))
        self.n, self.held, self.changed = int.from_bytes(head[0]) if head else 1, {}, set()

    def close(self) -> None:
        """Write what has changed, in as many pages as it needs by now."""
        while self.changed and sum(map(len, self.held.values())) > PAGE * len(self.held):
            self._split()
        if self.changed:
            self.store.updateValue((_HEAD,), (self.n.to_bytes(8),))
        self._write()

    def get(self, name: str, user_key: tuple | None):
        found = self._page(entry := (name, self.key, user_key))[1].get(entry)
        return found and found[1]

    def put(self, name: str, user_key: tuple | None, value: tuple) -> None:
        number, page = self._page(entry := (name, self.key, user_key))
        page[entry] = (self.now, value)
        self.changed.add(number)

    def _number(self, entry: tuple) -> int:
        at, half = crc32(repr(entry).encode()), 1 << (self.n.bit_length() - 1)
        return at % (2 * half) if at % (2 * half) < self.n else at % half

    def _page(self, entry: tuple) -> tuple[int, dict]:
        number = self._number(entry)
        if number not in self.held:
            if len(self.held) >= HELD:
                self._write()
            self.held[number] = self._read(number)
        return number, self.held[number]

    def _read(self, number: int) -> dict:
        kept = self.store.getValue((number,))
        page = pickle.loads(kept[0]) if kept else {}
        return {k: v for k, v in page.items() if v[0] + self.ttl_ms > self.now} if self.ttl_ms else page

    def _split(self) -> None:
        old, new = self.n - (1 << (self.n.bit_length() - 1)), self.n
        page = self.held[old] if old in self.held else self._read(old)
        self.n += 1
        self.held[old], self.held[new] = {}, {}
        for entry, value in page.items():
            self.held[self._number(entry)][entry] = value
        self.changed |= {old, new}

    def _write(self) -> None:
        for number in sorted(self.changed):
            self.store.updateValue((number,), (pickle.dumps(self.held[number], 5),))
        self.held, self.changed = {}, set()


class Entry:
    """A value state or a map state of the key that ``Pages`` is at."""

    def __init__(self, pages: Pages, name: str):
        self.pages, self.name = pages, name

    def get(self):
        return self.pages.get(self.name, None)

    def exists(self) -> bool:
        return self.get() is not None

    def update(self, value: tuple) -> None:
        self.pages.put(self.name, None, value)

    def getValue(self, user_key: tuple):
        return self.pages.get(self.name, user_key)

    def containsKey(self, user_key: tuple) -> bool:
        return self.getValue(user_key) is not None

    def updateValue(self, user_key: tuple, value: tuple) -> None:
        self.pages.put(self.name, user_key, value)
