"""Errors raised before anything runs: wrong arguments, missing bands, unaligned grids."""


class PixeltideError(ValueError):
    """Base of all argument errors."""


class TypeMismatch(PixeltideError, TypeError):
    """An argument has the wrong type, or an operator does not accept this kind of cube."""


class LengthMismatch(PixeltideError):
    """Two arguments, or an argument and the bands, differ in length."""


class BandMissing(PixeltideError):
    """A band that an operator needs is not in the cube."""


class OutOfRange(PixeltideError):
    """A number lies outside its allowed range."""


class NotAligned(PixeltideError):
    """Items are on different grids or in different reference systems where one grid is needed."""


class BadBox(PixeltideError):
    """Not a bounding box."""


def need(condition: bool, error: type[PixeltideError], message: str) -> None:
    if not condition:
        raise error(message)


def need_bands(have, wanted) -> None:
    missing = [b for b in wanted if b not in have]
    need(not missing, BandMissing, f"bands {missing} are not among {list(have)}")
