"""The manifest: which tables are live, and how far the log has been flushed."""

from __future__ import annotations

import json

from pyarrow import fs

from .wal import put_file

NAME = "MANIFEST"
FIELDS = {"tables": list, "next_file_num": int, "last_flushed_wal": int, "last_seq": int}
EMPTY = {"tables": [], "next_file_num": 0, "last_flushed_wal": 0, "last_seq": 0}


def read_manifest(folder: str) -> tuple[dict, bool]:
    """The manifest of a folder and whether there is one; without one, the state of a new engine. Missing fields are empty;
    a file that is no manifest is an error."""
    store, at = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{at}/{NAME}").type != fs.FileType.File:
        return {**EMPTY, "tables": []}, False
    with store.open_input_stream(f"{at}/{NAME}", compression=None) as f:
        state = json.loads(f.read())
    if not isinstance(state, dict) or any(k in state and type(state[k]) is not FIELDS[k] for k in FIELDS):
        raise ValueError(f"{folder}/{NAME} is no manifest")
    return {k: state.get(k, [] if kind is list else 0) for k, kind in FIELDS.items()}, True


def write_manifest(folder: str, state: dict) -> None:
    """Replace the manifest as a whole: readers see the old one or the new one. Small, whatever the data."""
    put_file(folder, NAME, json.dumps({k: state[k] for k in FIELDS}, indent=2).encode())
