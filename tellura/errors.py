"""Errors of the library."""


class TelluraError(Exception):
    """Base of all errors raised here."""


class PathError(TelluraError):
    pass


class PathNotFoundError(PathError):
    pass


class NotFileError(PathError):
    pass


class NotDirectoryError(PathError):
    pass


class WriteError(TelluraError):
    """A target exists and may not be replaced."""


class MetadataReadError(TelluraError):
    pass


class ProjectCreateError(TelluraError):
    pass


class ProjectLoadError(TelluraError):
    pass


class MeasurementNotFoundError(TelluraError):
    pass


class SiteNotFoundError(TelluraError):
    pass


class TimeDataReadError(TelluraError):
    pass


class ChannelNotFoundError(TelluraError):
    def __init__(self, chan: str, chans: object = ()):
        super().__init__(f"channel {chan} is not among {sorted(map(str, chans))}")


class CalibrationFileNotFound(TelluraError):
    pass


class CalibrationFileReadError(TelluraError):
    pass


class ProcessRunError(TelluraError):
    pass


class ParameterError(TelluraError, ValueError):
    """A parameter is outside its range."""
