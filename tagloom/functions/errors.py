"""Why a document cannot be read or written."""

from __future__ import annotations

#: The codes of all failures.
CODES = ("UnexpectedEof", "UnknownTag", "InvalidTag", "InvalidLength", "InvalidData", "InvalidUtf8", "MissingField", "DuplicateField", "Message")

ERROR = "struct<code:string,expected:tinyint,actual:tinyint,detail:string>"


class DocumentError(Exception):
    """The first thing that is wrong; later ones are never looked for."""

    def __init__(self, code: str, expected: int | None = None, actual: int | None = None, detail: str | None = None):
        super().__init__(code, expected, actual, detail)
        self.code, self.expected, self.actual, self.detail = code, expected, actual, detail

    def row(self) -> dict:
        actual = self.actual
        if actual is not None and actual > 127:  # TINYINT keeps the bits
            actual -= 256
        return {"code": self.code, "expected": self.expected, "actual": actual, "detail": self.detail}
