"""Errors with the codes and exit codes that callers can rely on."""

from __future__ import annotations

#: The codes and the exit codes of a command line that fails with them.
EXIT_CODES = {
    "E_CONFIG": 2,
    "E_DB": 3,
    "E_UNSUPPORTED_FORMAT": 4,
    "E_IO": 5,
    "E_DOCUMENT_NOT_FOUND": 6,
    "E_EMBEDDING": 7,
    "E_VALIDATION": 8,
    "E_MODEL_MISMATCH": 9,
    "E_TOKENIZE": 10,
}


class KnowledgeError(Exception):
    """An error with one of the codes of EXIT_CODES."""

    def __init__(self, code: str, message: str):
        if code not in EXIT_CODES:
            raise ValueError(f"unknown error code {code}")
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message

    @property
    def exit_code(self) -> int:
        return EXIT_CODES[self.code]


def code_of(error: BaseException) -> tuple[str, int]:
    """Code and exit code of an error, looking through its causes; ("E_INTERNAL", 1) for any other."""
    seen: BaseException | None = error
    while seen is not None:
        if isinstance(seen, KnowledgeError):
            return seen.code, seen.exit_code
        seen = seen.__cause__ or seen.__context__
    return "E_INTERNAL", 1
