"""What compilation has to say: coded errors and warnings."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed codes and what they stand for.
CODES = {
    "PROJECT001": "no models found",
    "PROJECT002": "duplicate model id",
    "PROJECT003": "duplicate pinned id",
    "PROJECT004": "invalid model name",
    "PROJECT005": "unreadable file",
    "PROJECT006": "ambiguous namespace",
    "PROJECT007": "target collision",
    "PROJECT008": "invalid seed",
    "PROJECT009": "duplicate seed",
    "CONFIG001": "invalid configuration",
    "CONFIG002": "unknown model in configuration",
    "PARSE001": "SQL can't be parsed",
    "PARSE002": "malformed directive",
    "PARSE003": "unknown directive",
    "RESOLUTION001": "ambiguous reference",
    "DEPENDENCIES001": "dependency across workflows",
    "TYPE001": "unknown column",
    "TYPE002": "ambiguous column",
    "TYPE003": "duplicate output column",
    "TYPE004": "set operands differ in width",
    "TYPE005": "contract violated",
    "GRAPH001": "dependency cycle",
    "MODEL001": "not a single query",
}


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    where: str = ""
    severity: str = "error"

    def __str__(self) -> str:
        return f"{self.severity}[{self.code}] {self.where + ': ' if self.where else ''}{self.message}"


def error(code: str, message: str, where: object = "") -> Diagnostic:
    return Diagnostic(code, message, str(where), "error")


def warning(code: str, message: str, where: object = "") -> Diagnostic:
    return Diagnostic(code, message, str(where), "warning")
