"""Decoding of PostgreSQL logical replication messages (``pgoutput``, protocol 1)
into transactions, after the public protocol documentation.

A transaction is a dict: ``commit_lsn, end_lsn, commit_us`` (microseconds of the
Unix epoch), ``relations`` (those its changes need) and ``changes``.  A change has
``oid, kind`` (I U D T), ``old``, ``new`` (lists of cells or None), ``cascade``,
``restart``.  A cell is ``(kind, data)`` with kind ``n`` null, ``t`` text, ``b``
binary, ``u`` unchanged; only t and b have data, and empty data is not null.
"""

from __future__ import annotations

import struct

#: Microseconds between the Unix epoch and 2000-01-01, the protocol's epoch.
EPOCH_US = 946_684_800_000_000
_NUMBERS = {form: struct.Struct(">" + form) for form in "BHIQiq"}


class DecodeError(ValueError):
    """A message that the protocol does not allow here."""


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise DecodeError("message ends early")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def number(self, form: str) -> int:
        one = _NUMBERS[form]
        return one.unpack(self.take(one.size))[0]

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise DecodeError("unterminated text")
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out

    def tuple(self) -> list[tuple[str, bytes | None]]:
        cells = []
        for _ in range(self.number("H")):
            kind = chr(self.number("B"))
            if kind in "nu":
                cells.append((kind, None))
            elif kind in "tb":
                cells.append((kind, self.take(self.number("i"))))
            else:
                raise DecodeError(f"unknown cell kind {kind!r}")
        return cells


class Decoder:
    """Assembles transactions; relation metadata is cached by OID and replaced when
    the stream announces it anew.  After an error the open transaction is gone."""

    def __init__(self, boundary_prefix: str | None = None):
        self.relations: dict[int, dict] = {}
        self.current: dict | None = None
        self.prefix = boundary_prefix

    def decode(self, data: bytes) -> dict | None:
        """The transaction that this message completes, if it does."""
        if not data:
            raise DecodeError("empty message")
        try:
            handler = getattr(self, f"_{chr(data[0])}", None)
            return handler(Cursor(data[1:])) if handler else None  # types and origins change no rows
        except (DecodeError, UnicodeDecodeError, struct.error):
            self.current = None
            raise

    def _R(self, c: Cursor):
        oid = c.number("I")
        namespace, name, identity = c.text(), c.text(), chr(c.number("B"))
        columns = []
        for _ in range(c.number("H")):
            flags, column, kind = c.number("B"), c.text(), c.number("I")
            c.number("i")  # type modifier
            columns.append({"name": column, "type_oid": kind, "is_key": bool(flags & 1)})
        self.relations[oid] = {"oid": oid, "namespace": namespace, "name": name, "identity": identity, "columns": columns}

    def _B(self, c: Cursor):
        if self.current is not None:
            raise DecodeError("begin inside a transaction")
        self.current = {"commit_lsn": c.number("Q"), "commit_us": c.number("q") + EPOCH_US, "relations": {}, "changes": []}

    def _add(self, oid: int, kind: str, old=None, new=None, cascade=False, restart=False):
        if self.current is None:
            raise DecodeError("change outside a transaction")
        if oid not in self.relations:
            raise DecodeError(f"change of unknown relation {oid}")
        self.current["relations"][oid] = self.relations[oid]
        self.current["changes"].append({"oid": oid, "kind": kind, "old": old, "new": new, "cascade": cascade, "restart": restart})

    def _I(self, c: Cursor):
        oid = c.number("I")
        if c.take(1) != b"N":
            raise DecodeError("insert without a new row")
        self._add(oid, "I", new=c.tuple())

    def _U(self, c: Cursor):
        oid, old, mark = c.number("I"), None, c.take(1)
        if mark in (b"K", b"O"):
            old, mark = c.tuple(), c.take(1)
        if mark != b"N":
            raise DecodeError("update without a new row")
        self._add(oid, "U", old, c.tuple())

    def _D(self, c: Cursor):
        oid, mark = c.number("I"), c.take(1)
        if mark not in (b"K", b"O"):
            raise DecodeError("delete without an old row")
        self._add(oid, "D", old=c.tuple())

    def _T(self, c: Cursor):
        n, options = c.number("I"), c.number("B")
        if options & ~3:
            raise DecodeError(f"unknown truncate options {options}")
        for oid in [c.number("I") for _ in range(n)]:
            self._add(oid, "T", cascade=bool(options & 1), restart=bool(options & 2))

    def _C(self, c: Cursor) -> dict:
        if self.current is None:
            raise DecodeError("commit outside a transaction")
        c.number("B")
        commit, end, when = c.number("Q"), c.number("Q"), c.number("q")
        if commit != self.current["commit_lsn"] or end < commit:
            raise DecodeError("commit does not fit its begin")
        done, self.current = self.current, None
        return done | {"end_lsn": end, "commit_us": when + EPOCH_US, "relations": list(done["relations"].values())}

    def _M(self, c: Cursor) -> dict | None:
        """A boundary message is an empty transaction at its position."""
        transactional, lsn, prefix = c.number("B") & 1, c.number("Q"), c.text()
        if prefix != self.prefix or transactional:
            return None
        if self.current is not None or not lsn:
            raise DecodeError("boundary message inside a transaction or without a position")
        return {"commit_lsn": lsn, "end_lsn": lsn, "commit_us": 0, "relations": [], "changes": []}
