"""Shape kinds of variables, inferred from shape, start and count, and their validation."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

#: Marks of special dimensions.
JOINED_DIM = 2**64 - 2
LOCAL_VALUE_DIM = 2**64 - 3
IRREGULAR_DIM = 2**64 - 4


class ShapeKind(Enum):
    GLOBAL_VALUE = "GlobalValue"
    GLOBAL_ARRAY = "GlobalArray"
    JOINED_ARRAY = "JoinedArray"
    LOCAL_VALUE = "LocalValue"
    LOCAL_ARRAY = "LocalArray"


class ShapeError(ValueError):
    """Dimensions that contradict each other."""


def infer(shape: Sequence[int] = (), start: Sequence[int] = (), count: Sequence[int] = (), is_string: bool = False) -> ShapeKind:
    """The kind that the three dimension lists describe."""
    shape, start, count = tuple(shape), tuple(start), tuple(count)
    special = (JOINED_DIM, LOCAL_VALUE_DIM)
    if any(d in special for d in (*start, *count)):
        raise ShapeError("special dimensions belong to the shape")
    if is_string and (count or (shape and shape != (LOCAL_VALUE_DIM,))):
        raise ShapeError("strings are single values")
    if shape == (LOCAL_VALUE_DIM,):
        if start or count:
            raise ShapeError("a local value has neither start nor count")
        return ShapeKind.LOCAL_VALUE
    if LOCAL_VALUE_DIM in shape:
        raise ShapeError("a local value has one dimension")
    if shape.count(JOINED_DIM) > 1:
        raise ShapeError("one joined dimension at most")
    if JOINED_DIM in shape:
        if len(count) != len(shape):
            raise ShapeError("a joined array needs a count for each dimension")
        if any(start):
            raise ShapeError("a joined array's blocks have no start")
        if any(c > s for s, c in zip(shape, count, strict=True) if s != JOINED_DIM):
            raise ShapeError("count exceeds shape")
        return ShapeKind.JOINED_ARRAY
    if shape:
        if not start and not count:
            return ShapeKind.GLOBAL_ARRAY
        if len(start) != len(shape) or len(count) != len(shape):
            raise ShapeError("shape, start and count differ in rank")
        for s, b, c in zip(shape, start, count, strict=True):
            if b > s or c > s or b + c > s:
                raise ShapeError("start and count exceed shape")
        return ShapeKind.GLOBAL_ARRAY
    if start:
        raise ShapeError("start without shape")
    return ShapeKind.LOCAL_ARRAY if count else ShapeKind.GLOBAL_VALUE


def change(old: Sequence[int], new: Sequence[int], kind: ShapeKind, constant: bool = False) -> tuple[int, ...]:
    """``new`` as the shape of a variable that had ``old``, where that is allowed."""
    if constant or kind not in (ShapeKind.GLOBAL_ARRAY, ShapeKind.JOINED_ARRAY):
        raise ShapeError("this variable's shape is fixed")
    if len(old) != len(new):
        raise ShapeError("a variable keeps its rank")
    return tuple(new)
