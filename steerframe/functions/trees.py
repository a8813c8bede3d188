"""Settings trees of one Arrow batch: read member by member, written from sorted paths.

A tree is read in one pass with a stack of its open objects, whatever its depth; only arrays,
which are values here, are left to the JSON library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, chain
from json.decoder import scanstring
from typing import NamedTuple

import pyarrow as pa

_SPACE = re.compile(r"[ \t\n\r]*")
# A member of the common kind up to where the next one starts: an object that opens, or a value,
# the ends of objects behind it, and the comma before a name. All else is read step by step.
_PLAIN_MEMBER = re.compile(
    r'"([^"\\\x00-\x1f]*)"[ \t\n\r]*:[ \t\n\r]*(?:\{[ \t\n\r]*|'
    r'("[^"\\\x00-\x1f]*(?:\\["\\/bfnrt][^"\\\x00-\x1f]*)*"|true|false|null'
    r"|-?(?:0|[1-9][0-9]{0,99})(?:\.[0-9]{1,99})?(?:[eE][+-]?[0-9]{1,99})?)[ \t\n\r]*(?=[,}])"
    r'([} \t\n\r]*)(,[ \t\n\r]*(?="))?)'
)


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON value")


_VALUES = json.JSONDecoder(parse_constant=_no_number)

# Trees whose nodes are held as objects at a time.
SLICE = 500


class Node(NamedTuple):
    """A member of an object: ``value`` is its JSON text as written, null for an object,
    ``values`` the number of values at and below it.

    Members are numbered in the order they are written; those below this one have the numbers
    from ``entry + 1`` up to and without ``leave``.
    """

    path: list[str]
    entry: int
    leave: int
    values: int
    value: str | None


def _scan(text: str | None, objects: bool) -> list:
    """The fields of ``Node`` for all members of a tree's objects, or what ``leaves`` gives for
    its values alone."""
    if text is None:
        raise ValueError("no tree")
    space, member = _SPACE.match, _PLAIN_MEMBER.match

    def expect(at: int, mark: str) -> int:
        if text[at : at + 1] != mark:
            raise ValueError(f"expected {mark} at {at}")
        return space(text, at + 1).end()

    def close() -> None:
        path.pop()
        if objects:
            node = open_nodes.pop()
            node[2], node[3] = len(out), found - node[3]

    out: list = []
    open_nodes: list[list] = []  # the objects on the path, if they are asked for
    path: list[str] = []
    at = expect(space(text, 0).end(), "{")
    first, found = True, 0
    while True:
        if text[at : at + 1] == "}":
            at = space(text, at + 1).end()
            if not path:
                break
            close()
            first = False
            continue
        if not first:
            at = expect(at, ",")
        plain = member(text, at)
        if plain:
            name, value, ends, comma = plain.groups()
            at = plain.end()
        else:
            if text[at : at + 1] != '"':
                raise ValueError(f"expected a name at {at}")
            name, at = scanstring(text, at + 1)
            at = expect(space(text, at).end(), ":")
            value = ends = comma = None
            if text[at : at + 1] == "{":
                at = space(text, at + 1).end()
            else:
                try:
                    _, end = _VALUES.raw_decode(text, at)
                except RecursionError:
                    raise ValueError(f"array too deep at {at}") from None
                value, at = text[at:end], space(text, end).end()
        if value is None:
            first = True
            path.append(name)
            if objects:
                # a path is copied only where it is asked for: deep trees have long ones
                node = [list(path), len(out), len(out) + 1, found, None]
                out.append(node)
                open_nodes.append(node)
            continue
        own = [*path, name]
        out.append([own, len(out), len(out) + 1, 1, value] if objects else (own, value, None))
        found += 1
        first = comma is not None
        closed = ends.count("}") if ends else 0
        if closed > len(path):  # the tree ends here
            at, first = plain.start(3), False
        elif objects:
            for _ in range(closed):
                close()
        elif closed:
            del path[-closed:]
    if at != len(text):
        raise ValueError(f"text after the tree at {at}")
    return out


def nodes(text: str | None) -> list[Node]:
    """All members of the objects of a tree; a ``ValueError`` says why a text is no tree."""
    return [Node(*node) for node in _scan(text, True)]


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    """Rows' values as Arrow; lists of strings are made from one flat list of them."""
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    absent = None
    if None in values:
        absent = pa.array([v is None for v in values], pa.bool_())
        values = [v or () for v in values]
    ends = pa.array(list(accumulate(map(len, values), initial=0)), pa.int32())
    flat = pa.array(list(chain.from_iterable(values)), kind.value_type)
    return pa.ListArray.from_arrays(ends, flat, mask=absent).cast(kind)


def read_batches(
    batches: Iterator[pa.RecordBatch], keys: list[str], rows_of: Callable[[str | None], list[tuple]],
    schema: pa.Schema,
) -> Iterator[pa.RecordBatch]:
    """The rows of each tree (the column after the keys) beside its keys."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            owners, rows = [], []
            for i, text in enumerate(part.column(len(keys)).to_pylist()):
                own = rows_of(text)
                rows += own
                owners += [i] * len(own)
            taken = [part.column(i).take(pa.array(owners, pa.int32())) for i in range(len(keys))]
            made = list(zip(*rows)) if rows else [()] * (len(schema) - len(keys))
            columns = [_column(c, f.type) for c, f in zip(made, list(schema)[len(keys) :])]
            yield pa.RecordBatch.from_arrays([*taken, *columns], schema=schema)


def leaves(text: str | None) -> list[tuple]:
    """(path, value, error) of each value; a text that is no tree gives one row with its error."""
    try:
        return _scan(text, False)
    except ValueError as e:
        return [(None, text, str(e))]


def members(text: str | None) -> list[tuple]:
    """(path, entry, leave, values, value, error) of each member."""
    try:
        return [(*n, None) for n in nodes(text)]
    except ValueError as e:
        return [(None, None, None, None, text, str(e))]


_quoted = json.JSONEncoder(ensure_ascii=False).encode


class TreeWriter:
    """Puts one tree together from its paths in ascending order.

    The open nodes are a stack. A path that comes again opens a node of the same name again.
    """

    def __init__(self, value_name: str, children_name: str):
        self.value = json.dumps(value_name) + ":"
        self.children = json.dumps(children_name) + ":{"
        self.parts: list[str] = ["{"]
        self.path: list[str] = []
        self.has_entry = [False]  # of the children of the root and of each open node
        self.has_value: list[bool] = []

    def _close_to(self, depth: int) -> None:
        while len(self.path) > depth:
            self.parts.append("}}" if self.has_entry.pop() else "}")
            self.path.pop()
            self.has_value.pop()

    def _open(self, name: str) -> None:
        if self.has_entry[-1]:
            self.parts.append(",")
        elif self.path:
            self.parts.append(("," if self.has_value[-1] else "") + self.children)
        self.has_entry[-1] = True
        self.parts.append(_quoted(name) + ":{")
        self.path.append(name)
        self.has_entry.append(False)
        self.has_value.append(False)

    def add(self, path: list[str] | None, value: str | None) -> None:
        if not path:
            return
        common, most = 0, min(len(path) - 1, len(self.path))
        while common < most and path[common] == self.path[common]:
            common += 1
        self._close_to(common)
        for name in path[common:]:
            self._open(name)
        if value is not None:
            self.parts.append(self.value + value)
            self.has_value[-1] = True

    def text(self) -> str:
        self._close_to(0)
        return "".join([*self.parts, "}"])


def written_batches(
    batches: Iterator[pa.RecordBatch], keys: list[str], names: tuple[str, str], schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """One tree for each run of rows with the same keys; rows are sorted by keys and path."""
    writer, now, last = None, None, None
    done: list[str] = []
    owners: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        rows = pa.Table.from_batches(owners).combine_chunks()
        columns = [rows.column(i).combine_chunks() for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(done, pa.string())], schema=schema)

    for batch in batches:
        owner = batch.select(keys)
        for i, (*key, path, value) in enumerate(
            zip(*(batch.column(c).to_pylist() for c in [*keys, "path", "value"]))
        ):
            if writer is None or key != now:
                if writer is not None:
                    owners.append(last)
                    done.append(writer.text())
                    if len(done) >= SLICE:
                        yield packed()
                        owners, done = [], []
                writer, now, last = TreeWriter(*names), key, owner.slice(i, 1)
            writer.add(path, value)
    if writer is not None:
        owners.append(last)
        done.append(writer.text())
    if done:
        yield packed()
