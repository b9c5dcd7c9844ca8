"""Error classes of the library."""


class MosaicError(Exception):
    """Any refusal of this library."""


class InputError(MosaicError):
    """Missing or unsuitable input."""


class ScaleError(MosaicError):
    """Units or coordinate system that do not fit the request."""


class GeometryError(MosaicError):
    """Geometry that can't be used."""


class DependencyError(MosaicError):
    """A part that is not there."""


class ComputeLimitError(MosaicError):
    """A guard on the size of a computation."""
