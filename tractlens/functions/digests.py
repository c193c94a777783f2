"""SHA-256 whose state can be handed from task to task.

`hashlib` keeps its state to itself. The library under it, which Python loads anyway, has the same
digest over a plain structure of 112 bytes.
"""

from __future__ import annotations

import ctypes

_STATE = 112


def _library() -> ctypes.CDLL | None:
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        library.SHA256_Update.argtypes = (ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t)
        library.SHA256_Init.argtypes = (ctypes.c_char_p,)
        library.SHA256_Final.argtypes = (ctypes.c_char_p, ctypes.c_char_p)
    except (ImportError, OSError, AttributeError):
        return None
    return library


def sha256_steps() -> bool:
    """Whether this Python's library gives the state away."""
    return _library() is not None


def sha256_step(state: bytes | None, data: bytes) -> bytes:
    """The state after more bytes; without one, that of a new digest."""
    held, library = ctypes.create_string_buffer(state or b"", _STATE), _library()
    if state is None:
        library.SHA256_Init(held)
    library.SHA256_Update(held, data, len(data))
    return held.raw


def sha256_end(state: bytes) -> str:
    held, digest = ctypes.create_string_buffer(state, _STATE), ctypes.create_string_buffer(32)
    _library().SHA256_Final(digest, held)
    return digest.raw.hex()
