"""The key of keyed digests, from the environment. It is configuration and never a column."""

from __future__ import annotations

import os
import sys
from pathlib import Path

#: A key as hexadecimal digits, or a file that holds one; bytes that a key should have at least.
VARIABLE, FILE_VARIABLE, LEAST = "LACUNA_HMAC_KEY", "LACUNA_HMAC_KEY_FILE", 32


def resolve_key() -> bytes | None:
    """The configured key, or None: chains are then checked without one, and none is made up.

    A short key in the variable is used with a warning. One that is no
    hexadecimal number is passed over for the file; a short file is not used.
    """
    if said := os.environ.get(VARIABLE, "").strip():
        try:
            key = bytes.fromhex(said)
        except ValueError:
            print(f"{VARIABLE} is not hexadecimal; {FILE_VARIABLE} is tried", file=sys.stderr)
        else:
            if len(key) < LEAST:
                print(f"{VARIABLE} has {len(key)} bytes; {LEAST} are advised", file=sys.stderr)
            return key
    if said := os.environ.get(FILE_VARIABLE, "").strip():
        try:
            key = Path(said).read_bytes().strip()
        except OSError as e:
            print(f"{said}: {e.strerror}", file=sys.stderr)
            return None
        if len(key) >= LEAST:
            return key
        print(f"{said} has {len(key)} bytes; {LEAST} are needed", file=sys.stderr)
    return None
