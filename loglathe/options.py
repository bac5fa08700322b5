"""Job parameters, checked when the job is built."""

from __future__ import annotations

from dataclasses import dataclass, fields

from loglathe.functions import fixed
from loglathe.functions.charset import canonical

_BOOLEANS = ("remove_duplicates", "remove_ansi", "expand_message", "bind_sql_args", "strip_k8s")


@dataclass(frozen=True)
class ParseOptions:
    """How files become records. ``cap`` is None by default: Spark needs no memory guard."""

    encoding: str = "utf-8"
    log_levels: tuple[str, ...] = ()
    remove_duplicates: bool = True
    remove_ansi: bool = True
    expand_message: bool = True
    bind_sql_args: bool = False
    strip_k8s: bool = False
    cap: int | None = None

    def __post_init__(self):
        for name in _BOOLEANS:
            if not isinstance(getattr(self, name), bool):
                raise ValueError(f"{name} must be a boolean")
        if not isinstance(self.encoding, str):
            raise ValueError("encoding must be a string")
        if self.encoding != "auto":
            canonical(self.encoding)
        if isinstance(self.log_levels, str) or not all(isinstance(x, str) for x in self.log_levels):
            raise ValueError("log_levels must be a list of strings")
        levels = tuple(x.strip().upper() for x in self.log_levels if x.strip())
        object.__setattr__(self, "log_levels", levels)
        if self.cap is not None and (
            isinstance(self.cap, bool) or not isinstance(self.cap, int) or self.cap < 1
        ):
            raise ValueError("cap must be a positive integer or None")

    @classmethod
    def of(cls, **values) -> ParseOptions:
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return cls(**values)


DEFAULT_CAP = fixed.MAX_RECORDS
